"""Export plans: by quota per category, or the first rows of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchloom.operators import quality
from merchloom.operators.ranking import numbered
from merchloom.sources import sinks


def quota_export(scored: DataFrame, key: str, total: int, minimum: int, maximum: int) -> DataFrame:
    """All rows with ``exported`` and ``place``: the best rows of each category within the budget."""
    allocation = quality.allocate_quota(quality.category_counts(scored), total, minimum, maximum)
    chosen = quality.select_by_quota(scored, allocation, maximum, key).select(key, "place")
    return scored.join(chosen, key, "left").withColumn("exported", F.col("place").isNotNull())


def quota_summary(df: DataFrame, category: str = "category") -> DataFrame:
    """Exported rows per category."""
    return df.where("exported").groupBy(F.trim(category).alias("category")).agg(F.count(F.lit(1)).alias("rows"))


def direct_export(df: DataFrame, key: str, limit: int = 0, required: Sequence[str] = sinks.REQUIRED_COLUMNS) -> tuple[DataFrame, DataFrame]:
    """(export frame of the first ``limit`` rows by key, then by all columns; rows that stay). 0 exports all."""
    if limit == 0:
        return sinks.export_columns(df, required), df.limit(0)
    placed = numbered(df, [F.col(key), *[F.col(c) for c in df.columns if c != key]], "_place")
    return sinks.export_columns(placed.where(F.col("_place") <= limit).drop("_place"), required), placed.where(F.col("_place") > limit).drop("_place")
