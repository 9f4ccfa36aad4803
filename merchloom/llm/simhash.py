"""SimHash near-duplicates by meeting in the middle of two Hamming balls.

Two fingerprints that differ in at most three bits have a common neighbour that is at most two flips
away from one and one flip from the other. Every distinct fingerprint emits its ball: one of even parity
itself and all single flips; one of odd parity also the flips of two bits. Fingerprints three bits apart
have different parity, so an even one meets an odd one; those two bits apart meet at single flips. Of
the double flips those within one half of the word are enough: two of any three bits share a half.

All members of a meeting point (variant) that are at most one flip away from it lie within two bits of
each other, and within three of every other member. So each meeting point gives a star of true links to
its smallest near member, never all pairs. A variant has at most ``1 + 64 + 992`` members, as
fingerprints are distinct, and copies of a text share one fingerprint; no group is hot.

Variants are dealt into buckets by a hash and travel as packed blocks of (variant, flip) pairs, 10
bytes each; the fingerprint is recovered from both. A bucket is joined in one task, and their number
follows the number of fingerprints.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchloom.llm.arrow import pieces
from merchloom.session import cut_lineage

SHINGLE_WORDS = 3
SEED = 42
RADIUS = 3
#: Fingerprints whose balls one step spreads, and pairs that a bucket holds on average.
SPREAD = 8192
BUCKET_PAIRS = 1 << 20


def _flips() -> np.ndarray:
    """Flip masks: none, the single bits, then the pairs of bits within one half of the word."""
    single = [1 << i for i in range(64)]
    double = [single[i] | single[j] for h in (0, 32) for i in range(h, h + 32) for j in range(h, i)]
    return np.array([0, *single, *double], np.uint64)


FLIPS = _flips()
NEAR = 65  # flips of at most one bit come first


def fingerprint(data: bytes | None) -> int:
    """SimHash of lower-cased words in shingles, repeats included; 0 without a word."""
    words = (data or b"").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= SHINGLE_WORDS:
        hashes = [xxhash.xxh64_intdigest(line, SEED)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = [0, *(ends[:-SHINGLE_WORDS] + 1).tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], SEED) for a, b in zip(starts, ends[SHINGLE_WORDS - 1:].tolist(), strict=True)]
    bits = np.zeros(64, np.int64)
    rows = np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8)
    for at in range(0, len(rows), 1 << 16):
        bits += np.unpackbits(rows[at:at + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > len(rows)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp``: the fingerprint as a signed long."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in pieces(batches, "text"):
            found = np.array([fingerprint(text) for text in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(found)], ["doc_id", "fp"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def _odd(x: np.ndarray) -> np.ndarray:
    for shift in (32, 16, 8, 4, 2, 1):
        x = x ^ (x >> np.uint64(shift))
    return (x & np.uint64(1)).astype(bool)


def ball(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(variants, flip numbers) of distinct unsigned fingerprints."""
    odd = _odd(fps)
    near, far = fps[~odd], fps[odd]
    variants = np.concatenate([(near[:, None] ^ FLIPS[:NEAR]).ravel(), (far[:, None] ^ FLIPS).ravel()])
    flips = np.concatenate([np.tile(np.arange(NEAR, dtype=np.uint16), len(near)), np.tile(np.arange(len(FLIPS), dtype=np.uint16), len(far))])
    return variants, flips


def _bucket(variants: np.ndarray, buckets: int) -> np.ndarray:
    mixed = (variants ^ (variants >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return ((mixed >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def stars(variants: np.ndarray, flips: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (smallest near member, member) of every variant that two or more fingerprints reach."""
    order = np.argsort(variants)
    variants, flips = variants[order], flips[order]
    same = variants[1:] == variants[:-1]
    shared = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    variants, flips = variants[shared], flips[shared]
    if not len(variants):
        return variants, variants
    members = variants ^ FLIPS[flips]
    first = np.concatenate([[0], np.flatnonzero(variants[1:] != variants[:-1]) + 1])
    group = np.repeat(np.arange(len(first)), np.diff([*first, len(variants)]))
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    center = np.minimum.reduceat(np.where(flips < NEAR, members, top), first)
    some = np.zeros(len(first), bool)
    some[group[flips < NEAR]] = True
    linked = some[group] & (members != center[group])
    return center[group][linked], members[linked]


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of links, each member tied to the smallest member of its part."""
    names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = ends[:len(a)], ends[len(a):]
    root = np.arange(len(names))
    while True:
        low = np.minimum(root[left], root[right])
        fresh = root.copy()
        np.minimum.at(fresh, root[left], low)
        np.minimum.at(fresh, root[right], low)
        fresh = fresh[fresh]
        if (fresh == root).all():
            break
        root = fresh
    tied = root != np.arange(len(names))
    return names[root[tied]], names[tied]


def links(distinct: DataFrame, fp_col: str = "fp", bucket_pairs: int = BUCKET_PAIRS) -> DataFrame:
    """``a, b``: ties among distinct fingerprints with the same parts as all pairs within ``RADIUS`` bits.

    Every link of a meeting point is checked to lie within the radius. A bucket then replaces its links
    by one tie per fingerprint, to the smallest of the part that they form.
    """
    total = distinct.count()
    buckets = max(1, -(-total * len(FLIPS) // (2 * bucket_pairs)))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(fps), SPREAD):
                variants, flips = ball(fps[at:at + SPREAD])
                to = _bucket(variants, buckets)
                order = np.argsort(to, kind="stable")
                variants, flips, to = variants[order], flips[order], to[order]
                cuts = np.searchsorted(to, np.arange(buckets + 1))
                full = np.flatnonzero(np.diff(cuts))
                yield pa.RecordBatch.from_arrays([
                    pa.array(full.astype(np.int32)),
                    pa.array([variants[cuts[k]:cuts[k + 1]].tobytes() for k in full], pa.binary()),
                    pa.array([flips[cuts[k]:cuts[k + 1]].tobytes() for k in full], pa.binary()),
                ], ["bucket", "variants", "flips"])

    def meet(group: pa.Table) -> pa.Table:
        variants, flips = (np.frombuffer(b"".join(group.column(c).to_pylist()), kind) for c, kind in ((1, np.uint64), (2, np.uint16)))
        a, b = stars(variants, flips)
        close = distance(a, b) <= RADIUS
        a, b = forest(a[close], b[close])
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    # few bytes, but many variants: dealt out evenly before they are spread
    even = distinct.select(fp_col).repartition(max(1, -(-total // SPREAD)))
    blocks = even.mapInArrow(spread, "bucket int, variants binary, flips binary")
    return blocks.groupBy("bucket").applyInArrow(meet, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node of its part for every node that an edge touches.

    Rounds of star contraction: every node ties its larger neighbours to its smallest one, then its
    smaller ones. Each round is written to the shared folder; a part of d hops takes about log d rounds.
    Neighbours are reduced by a minimum and joined back, so a node with many of them is no list.
    """
    current = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        # large star: larger neighbours of a node go to the smallest of its neighbours and itself
        both = current.select("u", "v").union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: smaller neighbours, and the node itself, go to the smallest of them
        small = large.where("u <> v").distinct()
        lower = small.groupBy("u").agg(F.min("v").alias("m"))
        moved = small.join(lower, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        following = cut_lineage(moved.union(lower.select("u", F.col("m").alias("v"))).distinct())
        if _same(current, following):
            return following.select(F.col("u").alias("node"), F.col("v").alias("root"))
        current = following


def _same(a: DataFrame, b: DataFrame) -> bool:
    def sums(df: DataFrame):
        mixed = F.xxhash64("u", "v")
        return df.agg(F.count(F.lit(1)), F.bit_xor(mixed), F.sum(mixed.bitwiseAND(F.lit((1 << 31) - 1)))).first()

    return sums(a) == sums(b)


def rooted(marked: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """``doc_id, fp, root, component_id`` per row of ``doc_id, fp``, over the given edges or those within the radius."""
    distinct = cut_lineage(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    parts = components(links(distinct.select("fp")) if edges is None else edges)
    tied = distinct.join(parts, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    least = tied.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.join(tied.join(least, "root").select("fp", "root", "component_id"), "fp")


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp, root, component_id`` per row: ``root`` is the smallest fingerprint of the component."""
    return rooted(cut_lineage(fingerprints(docs, id_col, text_col)))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id``: one row per row of ``docs``.

    The component is the smallest non-null id that links lead to, the document's own included. Null and
    empty texts have fingerprint zero and are linked like any other.
    """
    return grouped(docs, id_col, text_col).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         group: Callable[[DataFrame, str, str], DataFrame] = grouped, mark: Callable[[bytes | None], int] = fingerprint) -> DataFrame:
    """One document of each component, that with the smallest id, with the columns of ``docs``.

    ``group`` gives the components, ``mark`` the number of a text by which it names them.

    Rows without an id stay only where no document of their component has one. Of several rows that are
    left with one id, each component keeps the one with the smallest text. The list of kept ids is
    joined by a hash of the ids, so texts are dealt out once and not sorted; they are read for repeated or missing
    ids only where there are any.
    """
    every = cut_lineage(group(docs, id_col, text_col).select("doc_id", "fp", "root", F.expr("doc_id <=> component_id").alias("stays")))
    found = every.where("stays").drop("stays")
    # an id that has one row is enough to find it
    counted = cut_lineage(every.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.max("stays").alias("stays")).where("stays").select(
        "doc_id", F.expr("rows = 1 AND doc_id IS NOT NULL").alias("single")))

    def having(condition: str) -> DataFrame:
        ids = counted.where(condition).select(F.col("doc_id").alias("_kept")).hint("shuffle_hash")
        return docs.join(ids, docs[id_col].eqNullSafe(F.col("_kept")), "left_semi")

    @F.pandas_udf("long")
    def fp_of(texts: pd.Series) -> pd.Series:
        found = [mark(None if text is None else text.encode()) for text in texts]
        return pd.Series(np.array(found, np.uint64).view(np.int64))

    once = having("single")
    if counted.where("NOT single").isEmpty():
        return once
    several = having("NOT single")
    rows = several.select(F.struct(*[several[c] for c in docs.columns]).alias("_row"), fp_of(several[text_col]).alias("fp"))
    repeated = counted.where("NOT single").select(F.col("doc_id").alias("_kept"))
    parts = found.join(repeated, F.col("doc_id").eqNullSafe(F.col("_kept")), "left_semi").distinct().select(
        F.col("doc_id").alias("_id"), F.col("fp").alias("_fp"), F.col("root").alias("_root"))
    same = F.col(f"_row.{id_col}").eqNullSafe(F.col("_id")) & (F.col("fp") == F.col("_fp"))
    first = F.struct(F.col(f"_row.{text_col}"), F.to_json("_row"))
    chosen = rows.join(parts, same).groupBy("_id", "_root").agg(F.min_by("_row", first).alias("_row")).select("_row.*")
    return once.unionByName(chosen)
