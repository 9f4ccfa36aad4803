"""A modified Kneser-Ney model over characters, counted, joined and stored by Spark.

Symbols are UTF-16 units as they stand, so no letter is folded into another and an ``ORDER``-gram is exactly one long; a run of ASCII
letters and digits that holds a digit (numbers, keys, telephone numbers) is read as one ``0``. A line is a sequence of its own.
Nothing is capped: the tables of n-grams grow with the corpus and are never collected or broadcast by this module.

Lines fall into two folds by a hash of their symbols, and a line is scored by the model of the other fold's lines. A text
therefore never vouches for itself, and neither do its copies or a passage that many texts share.

Scoring. Texts are read in blocks of ``BLOCK_ROWS`` rows of a file, which are the same however a read is split. Each block names its
distinct n-grams; these meet the model in a join; probabilities come back to the block as sorted arrays of n-grams, packed by the tasks
of the join, just ahead of the block's texts in one sorted stream, and each symbol finds its own by binary search.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchloom.llm.arrow import pieces
from merchloom.llm.shingles import stored

ORDER = 4
BITS = 16
#: Chance of a symbol below the unigrams: all units alike.
FLOOR = 2.0 ** -BITS
BLOCK_ROWS = 8192
#: Text bytes of one step of vectorised work.
STEP_BYTES = 1 << 19
#: Distinct n-grams that a task holds before it passes their counts on.
HELD = 1 << 20

_ALNUM, _DIGIT, _LETTER = 1, 2, 4
_KINDS = np.zeros(1 << BITS, np.uint8)
_KINDS[[c for c in range(128) if chr(c).isalnum()]] |= _ALNUM
_KINDS[[c for c in range(128) if chr(c).isdigit()]] |= _DIGIT
# a letter beyond 16 bits counts by its first unit
_KINDS[[c for c in range(1 << BITS) if chr(c).isalpha() or 0xD800 <= c < 0xDC00]] |= _LETTER
_NEWLINE = 10


def _sums(values: np.ndarray, starts: np.ndarray, kind: type) -> np.ndarray:
    """Sums of the runs that begin at ``starts``; the last run ends with the array."""
    return np.add.reduceat(values, starts, dtype=kind) if len(starts) else np.zeros(0, kind)


def grams(texts: Sequence[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(n-gram that ends at each symbol, fold of its line, symbols per text, letters per text).

    An n-gram near the start of a line has zeros in front. Every line ends with a newline; empty lines have no symbols.
    """
    coded = [((t or b"").decode("utf-8", "replace") + "\n").encode("utf-16-le", "replace") for t in texts]
    units = np.frombuffer(b"".join(coded), "<u2")
    begins = np.cumsum([0, *[len(c) // 2 for c in coded]])[:-1]
    units, begins = _without_numbers(units, begins)
    size = len(units)
    ends = units == _NEWLINE
    starts = np.concatenate([[0], np.flatnonzero(ends) + 1])[:-1] if size else np.zeros(0, np.int64)
    codes = units.astype(np.uint64)
    wide = codes.copy()
    for k in range(1, min(ORDER, size)):
        before = wide[:-k] << np.uint64(BITS * k)
        for j in range(k):  # within k symbols of a line's start there is nothing of that line
            at = starts + (j - k)
            before[at[(at >= 0) & (at < len(before))]] = 0
        codes[k:] |= before
    marks = _sums((codes ^ (codes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9), starts, np.uint64)
    marks = (marks ^ (marks >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    folds = np.repeat((marks >> np.uint64(63)).astype(np.int8), np.diff(starts, append=size))
    letters = _sums((_KINDS[units] & _LETTER) > 0, begins, np.int64)
    empty = starts[ends[starts]]
    if not len(empty):
        return codes.view(np.int64), folds, np.diff(begins, append=size), letters
    live = np.ones(size, bool)
    live[empty] = False
    return codes[live].view(np.int64), folds[live], _sums(live, begins, np.int64), letters


def _without_numbers(units: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols with every run of ASCII letters and digits that holds a digit as one zero, and where texts begin then."""
    kinds = _KINDS[units]
    digits = np.flatnonzero(kinds & _DIGIT)
    if not len(digits):
        return units, begins
    edges = np.flatnonzero(np.diff((kinds & _ALNUM).astype(np.int8), prepend=0, append=0))
    heads, tails = edges[::2], edges[1::2]
    runs = np.unique(np.searchsorted(heads, digits, "right") - 1)
    change = np.zeros(len(units) + 1, np.int8)
    change[heads[runs] + 1] += 1
    change[tails[runs]] -= 1
    kept = np.cumsum(change[:-1], dtype=np.int8) == 0
    units = units.copy()
    units[heads[runs]] = 48
    held = _sums(kept, begins, np.int64)
    return units[kept], np.cumsum(held) - held


def placed(docs: DataFrame) -> DataFrame:
    """All columns with ``_block``, a number that the rows of one stretch of a file share.

    It depends on the row's place in its file alone, not on the splits of a read. Rows that don't come straight from Parquet files are written first.
    """
    where = F.xxhash64("_metadata.file_path", F.floor(F.col("_metadata.row_index") / BLOCK_ROWS)).alias("_block")
    try:
        return docs.select("*", where)
    except AnalysisException:
        return stored(docs, "texts").select("*", where)


def count_blocks(rows: DataFrame, text_col: str) -> DataFrame:
    """``block, fold, gram, n``: how often each block's lines of a fold hold an n-gram, as tasks found it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (block, fold), parts in sorted(held.items()):
                codes, counts = _merged(parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(codes), block)), pa.array(np.full(len(codes), fold, np.int8)), pa.array(codes), pa.array(counts)],
                    ["block", "fold", "gram", "n"])
            held.clear()

        for part, texts in pieces(batches, text_col, STEP_BYTES):
            blocks = part.column(part.schema.get_field_index("_block")).to_numpy()
            codes, folds, sizes, _ = grams(texts)
            of = np.repeat(blocks, sizes)
            for block in np.unique(blocks):
                for fold in (0, 1):
                    found = np.unique(codes[(of == block) & (folds == fold)], return_counts=True)
                    if len(found[0]):
                        parts = held.setdefault((int(block), fold), [])
                        parts.append(found)
                        size += len(found[0])
            if size > HELD:
                held.update({key: [_merged(parts)] for key, parts in held.items()})
                size = sum(len(parts[0][0]) for parts in held.values())
                if size > HELD // 2:
                    yield from flush()
                    size = 0
        yield from flush()

    return rows.select("_block", text_col).mapInArrow(count, "block long, fold tinyint, gram long, n long")


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    codes, counts = (np.concatenate([p[k] for p in parts]) for k in range(2))
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[starts], np.add.reduceat(counts, starts)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of sorted arrays per block and fold for what a task holds of ``block, fold, gram, cost``."""
    held: list[tuple[np.ndarray, ...]] = []

    def packed() -> pa.RecordBatch:
        block, fold, gram, cost = (np.concatenate([h[k] for h in held]) for k in range(4))
        order = np.lexsort((gram, fold, block))
        block, fold, gram, cost = block[order], fold[order], gram[order], cost[order]
        cuts = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (fold[1:] != fold[:-1])]))
        ends = [*cuts[1:], len(block)]
        held.clear()
        return pa.RecordBatch.from_arrays([
            pa.array(block[cuts]), pa.array(fold[cuts]), pa.array([gram[a:b].astype("<i8").tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary()),
            pa.array([cost[a:b].astype("<f4").tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary())], ["block", "fold", "grams", "costs"])

    for batch in batches:
        if batch.num_rows:
            held.append(tuple(batch.column(k).to_numpy() for k in range(4)))
        if sum(len(h[0]) for h in held) >= HELD:
            yield packed()
    if held:
        yield packed()


def _bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``block, row, text`` as bundles of one block: rows, lengths of texts (-1 for a null) and all texts compressed together."""
    codec = pa.Codec("zstd")
    for part, texts in pieces(batches, "text", STEP_BYTES):
        blocks = part.column(0).to_numpy()
        cuts = np.flatnonzero(np.concatenate([[True], blocks[1:] != blocks[:-1]])) if len(blocks) else np.zeros(0, np.int64)
        offsets = pa.array([*cuts, len(blocks)], pa.int32())
        ends = [*cuts[1:], len(blocks)]
        whole = [b"".join(t or b"" for t in texts[a:b]) for a, b in zip(cuts, ends, strict=True)]
        lengths = pa.array([-1 if t is None else len(t) for t in texts], pa.int64())
        yield pa.RecordBatch.from_arrays([
            pa.array(blocks[cuts]), pa.ListArray.from_arrays(offsets, part.column(1)), pa.ListArray.from_arrays(offsets, lengths),
            pa.array([codec.compress(w, asbytes=True) for w in whole], pa.binary())], ["block", "rows", "lengths", "texts"])


def _unbundled(lengths: list[int], texts: bytes) -> list[bytes | None]:
    whole = pa.Codec("zstd").decompress(texts, sum(n for n in lengths if n > 0), asbytes=True) if texts else b""
    out, at = [], 0
    for n in lengths:
        out.append(None if n < 0 else whole[at:at + n])
        at += max(n, 0)
    return out


def _low(gram: Column | str, order: int) -> Column:
    """The last ``order`` symbols of an n-gram."""
    gram = F.col(gram) if isinstance(gram, str) else gram
    return gram if order >= ORDER else gram.bitwiseAND(F.lit((1 << BITS * order) - 1))


def _context(gram: Column | str) -> Column:
    """The n-gram without its last symbol."""
    return F.shiftrightunsigned(gram, BITS)


def _discounts(level: DataFrame) -> DataFrame:
    """``fold, d1, d2, d3``: what is taken from counts of 1, 2 and 3 or more, from the counts of counts."""
    n = {k: F.sum(F.when(F.col("n") == k, 1).otherwise(0)) for k in (1, 2, 3, 4)}
    found = level.groupBy("fold").agg(*[n[k].alias(f"n{k}") for k in n])
    y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))
    cut = [F.lit(k) - F.try_divide((k + 1) * y * F.col(f"n{k + 1}"), F.col(f"n{k}")) for k in (1, 2, 3)]
    seen = (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col("n3") > 0)
    return found.select("fold", *[F.when(seen & (d > 0) & (d < k), d).otherwise(F.lit(k / 2)).alias(f"d{k}") for k, d in enumerate(cut, 1)])


def fit(counts: DataFrame) -> dict[str, list[DataFrame]]:
    """The model of every fold from a written table ``fold, gram, n``: tables ``fold, gram, p`` and ``fold, context, weight`` per order, lowest first.

    The highest order has counts, lower ones the number of symbols seen in front. ``p`` is interpolated; after a
    context, what is left for unseen symbols is ``weight`` times their chance one order below.
    """
    levels = {ORDER: counts}
    for order in range(ORDER - 1, 0, -1):
        above = levels[order + 1]
        levels[order] = stored(above.groupBy("fold", _low("gram", order).alias("gram")).agg(F.count(F.lit(1)).alias("n")), "grams")
    below, chances, contexts = None, [], []
    for order in range(1, ORDER + 1):
        level = levels[order].join(_discounts(levels[order]), "fold").withColumn("context", _context("gram"))
        taken = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        level = level.select("fold", "gram", "context", "n", taken.alias("taken"))
        context = level.groupBy("fold", "context").agg(F.sum("n").alias("total"), F.sum("taken").alias("left"))
        context = stored(context.select("fold", "context", "total", (F.col("left") / F.col("total")).alias("weight")), "contexts")
        own = level.join(context, ["fold", "context"])
        if below is None:
            under = own.withColumn("under", F.lit(FLOOR))
        else:
            under = own.withColumn("suffix", _low("gram", order - 1)).join(
                below.select("fold", F.col("gram").alias("suffix"), F.col("p").alias("under")), ["fold", "suffix"])
        p = (F.col("n") - F.col("taken")) / F.col("total") + F.col("weight") * F.col("under")
        below = stored(under.select("fold", "gram", p.alias("p")), "chances")
        chances.append(below)
        contexts.append(context.select("fold", "context", "weight"))
    return {"chances": chances, "contexts": contexts}


def look_up(model: dict[str, list[DataFrame]], asked: DataFrame, order: int = ORDER) -> DataFrame:
    """``fold, gram, p`` for distinct n-grams ``fold, gram``, seen by the model or not."""
    if order == 0:
        return asked.withColumn("p", F.lit(FLOOR))
    shorter = asked.select("fold", _low("gram", order - 1).alias("gram")).distinct()
    if order > 1:
        below = look_up(model, shorter, order - 1)
    else:
        below = shorter.withColumn("p", F.lit(FLOOR))
    rows = asked.withColumn("context", _context("gram")).withColumn("suffix", _low("gram", order - 1))
    rows = rows.join(model["chances"][order - 1], ["fold", "gram"], "left").join(model["contexts"][order - 1], ["fold", "context"], "left")
    rows = rows.join(below.select("fold", F.col("gram").alias("suffix"), F.col("p").alias("under")), ["fold", "suffix"])
    return rows.select("fold", "gram", F.coalesce("p", F.coalesce("weight", F.lit(1.0)) * F.col("under")).alias("p"))


def scored(docs: DataFrame, text_col: str, carried: Sequence[str], finish: Callable[[list[bytes | None]], list[pa.Array]] | None = None,
           more: str = "") -> DataFrame:
    """The ``carried`` columns of ``docs`` with ``_cost``, minus the log chance of a text's symbols, and ``_letters``, the number of its letters.

    The model is counted over the texts of ``docs``; a text is moved once, to its block. ``finish`` may give further columns, named in ``more``, from the texts of
    a piece. A null text is empty and costs nothing. The result should be written before it is used twice.
    """
    rows = placed(docs)
    counted = stored(count_blocks(rows, text_col), "counts")
    # a line is scored by the model of the other fold
    other = (1 - F.col("fold")).cast("tinyint").alias("fold")
    grams_of = stored(counted.groupBy("fold", "gram").agg(F.sum("n").alias("n")), "grams")
    cost = look_up(fit(grams_of.select(other, "gram", "n")), grams_of.select("fold", "gram")).select("fold", "gram", (-F.log("p")).cast("float").alias("cost"))
    answers = counted.select("block", "fold", "gram").join(cost, ["fold", "gram"]).select("block", "fold", "gram", "cost").mapInArrow(
        _pack, "block long, fold tinyint, grams binary, costs binary")

    whole = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carried) if c != text_col])
    texts = rows.select(F.col("_block").alias("block"), whole.alias("row"), F.col(text_col).alias("text"))
    kind = f"array<{texts.schema['row'].dataType.simpleString()}>"
    none = lambda name, kind: F.lit(None).cast(kind).alias(name)
    bundles = texts.mapInArrow(_bundle, f"block long, rows {kind}, lengths array<long>, texts binary")
    both = answers.select("*", none("rows", kind), none("lengths", "array<long>"), none("texts", "binary")).unionByName(
        bundles.select("block", F.lit(2).cast("tinyint").alias("fold"), none("grams", "binary"), none("costs", "binary"), "rows", "lengths", "texts"))
    # as many partitions as blocks, so that a task's share does not grow with the corpus
    blocks = max(1, counted.select("block").distinct().count())
    ordered = both.repartition(blocks, "block").sortWithinPartitions("block", "fold")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, list] = {}
        block = None
        for batch in batches:
            blocks, folds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], (blocks[1:] != blocks[:-1]) | (folds[1:] != folds[:-1])])) if len(blocks) else []
            for start, end in zip(edges, [*edges[1:], len(blocks)], strict=True):
                part = batch.slice(start, end - start)
                if blocks[start] != block:
                    block, tables = blocks[start], {}
                if folds[start] < 2:
                    tables.setdefault(int(folds[start]), []).append([part.column(k).to_pylist() for k in (2, 3)])
                    continue
                for fold, parts in tables.items():
                    if isinstance(parts, list):
                        keys, values = (np.frombuffer(b"".join(x for p in parts for x in p[k]), kind) for k, kind in enumerate(("<i8", "<f4")))
                        order = np.argsort(keys)
                        tables[fold] = keys[order], values[order].astype(np.float64)
                for at in range(part.num_rows):
                    found = _unbundled(part.column(5)[at].as_py(), part.column(6)[at].as_py())
                    codes, folds_of, sizes, letters = grams(found)
                    costs = np.zeros(len(codes))
                    for fold in (0, 1):
                        mine = np.flatnonzero(folds_of == fold)
                        if len(mine):
                            keys, values = tables.get(fold, (np.zeros(0, np.int64), np.zeros(0)))
                            spot = np.searchsorted(keys, codes[mine])
                            if spot.max() == len(keys) or (keys[spot] != codes[mine]).any():
                                raise RuntimeError("a block holds an n-gram that was not counted: the files have changed")
                            costs[mine] = values[spot]
                    cost = np.zeros(len(sizes))
                    full = np.flatnonzero(sizes)
                    cost[full] = _sums(costs, (np.cumsum(sizes) - sizes)[full], np.float64)
                    own = [pa.array(found, pa.binary()).cast(pa.string())] if text_col in carried else []
                    yield pa.RecordBatch.from_arrays(
                        [part.column(4).slice(at, 1).flatten(), *own, pa.array(cost), pa.array(letters), *(finish(found) if finish else [])],
                        ["row", *["text"][:len(own)], "_cost", "_letters", *names])

    names = [part.split()[0] for part in more.split(", ")] if more else []
    own = "text string, " if text_col in carried else ""
    schema = f"row {texts.schema['row'].dataType.simpleString()}, {own}_cost double, _letters long" + (f", {more}" if more else "")
    return ordered.mapInArrow(run, schema).select(
        *[F.col("text" if c == text_col else f"row.c{i}").alias(c) for i, c in enumerate(carried)], "_cost", "_letters", *names)
