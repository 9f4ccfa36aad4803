"""Exact histogram of encoded lengths, and what suffix sums over it answer for every context limit."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from merchloom.llm.arrow import pieces
from merchloom.llm.tokens import Encoder
from merchloom.session import cut_lineage, ship_code

#: Lengths per block of the two-level suffix sums.
BLOCK = 256


def length_histogram(docs: DataFrame, vocabulary: str, text_col: str = "text") -> DataFrame:
    """(n_tokens, n_docs) over all documents, counted in each task first; a null text has no token."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, found = Encoder(vocabulary), Counter()
        for _, texts in pieces(batches, text_col):
            found.update(len(encoder.encode((text or b"").decode("utf-8", "replace"))) // 4 for text in texts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], ["n_tokens", "n_docs"])

    ship_code(docs.sparkSession)
    return docs.select(text_col).mapInArrow(count, "n_tokens long, n_docs long").groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """Per length L that occurs: totals of the documents of L tokens or more, and answers at the context limit L.

    ``docs_at_least`` and ``tokens_at_least`` are suffix sums. ``truncated_total`` is the sum of
    min(length, L) over all documents, ``quantile`` the share of documents that fit into L. Sums are taken
    inside blocks of ``BLOCK`` lengths and then over the blocks, so only one row per block meets in one task.
    """
    histogram = cut_lineage(histogram)  # read twice, and documents are not to be encoded twice
    rows = histogram.select("n_tokens", "n_docs", F.floor(F.col("n_tokens") / BLOCK).alias("_block"))
    inside = Window.partitionBy("_block").orderBy(F.desc("n_tokens"))
    tokens = F.col("n_tokens") * F.col("n_docs")
    blocks = rows.groupBy("_block").agg(F.sum("n_docs").alias("_docs"), F.sum(tokens).alias("_tokens"))
    after = Window.orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    later = blocks.select(
        "_block", F.coalesce(F.sum("_docs").over(after), F.lit(0)).alias("_docs_after"),
        F.coalesce(F.sum("_tokens").over(after), F.lit(0)).alias("_tokens_after"),
        F.sum("_docs").over(Window.partitionBy()).alias("_all_docs"), F.sum("_tokens").over(Window.partitionBy()).alias("_all_tokens"))
    summed = rows.withColumn("_docs", F.sum("n_docs").over(inside)).withColumn("_tokens", F.sum(tokens).over(inside)).join(later, "_block")
    at_least, tokens_at_least = F.col("_docs") + F.col("_docs_after"), F.col("_tokens") + F.col("_tokens_after")
    return summed.select(
        "n_tokens", "n_docs", at_least.alias("docs_at_least"), tokens_at_least.alias("tokens_at_least"),
        (F.col("_all_tokens") - tokens_at_least + F.col("n_tokens") * at_least).alias("truncated_total"),
        ((F.col("_all_docs") - at_least + F.col("n_docs")) / F.col("_all_docs")).alias("quantile"))


def at_limits(histogram: DataFrame, limits: DataFrame, limit_col: str = "context_limit") -> DataFrame:
    """The columns of ``suffix_sums`` for any limits: each enters the histogram as a length of no document."""
    wanted = limits.select(F.col(limit_col).cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("n_docs"), F.lit(True).alias("_asked"))
    known = histogram.select("n_tokens", "n_docs", F.lit(False).alias("_asked"))
    both = known.unionByName(wanted).groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"), F.max("_asked").alias("_asked"))
    asked = both.where("_asked").select(F.col("n_tokens").alias(limit_col))
    sums = suffix_sums(both.select("n_tokens", "n_docs"))
    return asked.join(sums, F.col(limit_col) == F.col("n_tokens")).drop("n_tokens")
