"""Quality rules: text statistics and perplexity bands per language.

The log perplexity of a text is its cost under the model of ``kneser`` per letter, so signs, digits and marks that are strewn among the letters
count in full however well they can be foretold. A document is rejected by the model if it lies outside the band of its language
and length: the median of that language and octave of letters, plus or minus ``width`` times the distance to the 80th and 20th
percentile, and ``ALLOWANCE`` nats a document for a line of another kind (a licence line, a name, an address).
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merchloom.llm import kneser
from merchloom.llm.arrow import BLANKS
from merchloom.llm.shingles import stored
from merchloom.session import ship_code

#: Distances to the quantiles that a band spans.
WIDTH = 2.5
#: Quantiles that the spread is read off, and the least spread, in nats a letter.
QUANTILE, LEAST_SPREAD = 0.2, 0.005
#: Nats that a document may lie outside, whatever its length.
ALLOWANCE = 40.0
#: Bins to the nat of the histogram that the bands are read off.
BINS = 1 << 12
#: Texts are compared with those of their octave of letters, of these; an octave of fewer documents takes the whole language's band.
OCTAVES, LEAST_DOCUMENTS = (4, 14), 30


def _repeated_words(words: list[bytes], window: int = 5) -> int:
    """Words inside windows of ``window`` words that occur twice or more, the first one included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = np.zeros(n, np.uint64)
    for k in range(window):
        mixed = (mixed ^ ids[k:n + k]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    order = np.sort(mixed)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    found = np.flatnonzero(np.isin(mixed, twice))
    seen = Counter(tuple(words[i:i + window]) for i in found)  # equal hashes are checked word by word
    covered = np.zeros(len(words) + 1, np.int64)
    for i in found:
        if seen[tuple(words[i:i + window])] > 1:
            covered[i] += 1
            covered[i + window] -= 1
    return int((np.cumsum(covered) > 0).sum())


def base_statistics(data: bytes | None) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a text."""
    data = data or b""
    words = data.split()
    chars = len(data.decode("utf-8", "replace")) - (len(data) - len(data.translate(None, BLANKS)))
    signs = len(data) - len(data.translate(None, b"#*$%&|<>"))
    lines = [line for line in data.split(b"\n") if line.strip()]
    return len(words), chars, signs, len(lines) - len(set(lines)), _repeated_words(words)


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 10 or 100 * n_repeat_words > 20 * n_words


_STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SCORES = ", ".join(f"_{c} long" for c in _STATS) + ", _base_failed boolean"


def _base_columns(texts: list[bytes | None]) -> list[pa.Array]:
    found = [base_statistics(text) for text in texts]
    return [*[pa.array([b[k] for b in found], pa.int64()) for k in range(5)], pa.array([base_failed(b[0], b[4]) for b in found], pa.bool_())]


def _scored(docs: DataFrame, text_col: str, carried: list[str]) -> DataFrame:
    """The carried columns with base statistics and log perplexity under names with an underscore, written once."""
    ship_code(docs.sparkSession)
    rows = kneser.scored(docs, text_col, carried, _base_columns, _SCORES)
    perplexity = F.when(F.col("_letters") > 0, F.col("_cost") / F.col("_letters"))
    return stored(rows.withColumn("_log_perplexity", perplexity).drop("_cost"), "scores")


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per document: ``doc_id, lang``, base statistics, ``letters, base_failed`` and ``log_perplexity`` (null without a letter).

    Null and empty texts fail the base rules. Repeated rows and ids count as often as they occur.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    return _scored(narrow, "text", ["doc_id", "lang"]).select(
        "doc_id", "lang", *[F.col(f"_{c}").alias(c) for c in (*_STATS, "letters", "base_failed", "log_perplexity")])


def _octave(letters: Column) -> Column:
    return F.greatest(F.lit(OCTAVES[0]), F.least(F.lit(OCTAVES[1]), F.floor(F.log2(letters.cast("double"))).cast("int")))


def bands(stats: DataFrame) -> DataFrame:
    """(lang, octave, documents, middle, low, high) over the documents that pass the base rules; a null octave is the whole language.

    A missing language is a language of its own. Quantiles are read off a histogram of ``BINS`` bins to the nat, so
    reruns agree and a language that holds most rows is still counted by many tasks.
    """
    rows = stats.where("NOT base_failed AND log_perplexity IS NOT NULL")
    counted = rows.groupBy("lang", _octave(F.col("letters")).alias("octave"), F.floor(F.col("log_perplexity") * BINS).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = counted.groupBy("lang", F.lit(None).cast("int").alias("octave"), "bin").agg(F.sum("n").alias("n"))
    group = Window.partitionBy("lang", "octave")
    upto = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counted.unionByName(every).select("lang", "octave", "bin", F.sum("n").over(upto).alias("upto"), F.sum("n").over(group).alias("all"))
    quantile = lambda q: F.min(F.when(F.col("upto") >= F.col("all") * q, (F.col("bin") + 0.5) / BINS))
    return placed.groupBy("lang", "octave").agg(
        F.max("all").alias("documents"), quantile(0.5).alias("middle"), quantile(QUANTILE).alias("low"), quantile(1 - QUANTILE).alias("high"))


def judge(stats: DataFrame, width: float = WIDTH, allowance: float = ALLOWANCE) -> DataFrame:
    """Adds ``lower`` and ``upper``, the band for each document's language and length, and ``kept``.

    A text without a letter has no perplexity and lies outside. A language of which no document passes the base rules has no band.
    """
    found = stored(bands(stats), "bands")  # its size is known then, and a small one goes to the documents
    whole = found.where("octave IS NULL").select(*[F.col(c).alias(f"whole_{c}") for c in ("lang", "middle", "low", "high")])
    parts = found.where((F.col("octave").isNotNull()) & (F.col("documents") >= LEAST_DOCUMENTS)).select(
        *[F.col(c).alias(f"part_{c}") for c in ("lang", "octave", "middle", "low", "high")])
    rows = stats.join(whole, F.col("lang").eqNullSafe(F.col("whole_lang")), "left").join(
        parts, F.col("lang").eqNullSafe(F.col("part_lang")) & (_octave(F.col("letters")) == F.col("part_octave")), "left")
    middle, low, high = (F.coalesce(f"part_{c}", f"whole_{c}") for c in ("middle", "low", "high"))
    room = allowance / F.greatest("letters", F.lit(1))
    lower = middle - width * F.greatest(middle - low, F.lit(LEAST_SPREAD)) - room
    upper = middle + width * F.greatest(high - middle, F.lit(LEAST_SPREAD)) + room
    inside = F.coalesce(F.col("log_perplexity").between(F.col("lower"), F.col("upper")), F.lit(False))
    return rows.select(*stats.columns, lower.alias("lower"), upper.alias("upper")).withColumn("kept", ~F.col("base_failed") & inside)


def keep(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", width: float = WIDTH) -> DataFrame:
    """The documents that ``judge`` keeps, with all their columns; every text is scored once."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    inner = docs.toDF(*names)
    text, lang = (names[docs.columns.index(c)] for c in (text_col, lang_col))
    rows = _scored(inner, text, names).withColumnsRenamed({f"_{c}": c for c in ("letters", "base_failed", "log_perplexity")}).withColumn("lang", F.col(lang))
    return judge(rows, width).where("kept").select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])
