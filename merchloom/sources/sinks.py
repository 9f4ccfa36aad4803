"""Writers: export frames, partitioned splits, moves with a backup, table replacement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from merchloom.functions.text import sanitize_cell, sanitize_list_cell
from merchloom.functions.urls import normalize_url

# Columns every export starts with.
REQUIRED_COLUMNS = (
    "sku", "title", "description", "sub_description", "image", "original_price", "discount_price",
    "variant_name", "variant_value", "category",
)
KEPT, MOVED = "kept", "moved"
VERSION = "_version"


def export_columns(df: DataFrame, required: Sequence[str] = REQUIRED_COLUMNS) -> DataFrame:
    """Export frame: required columns first and filled with '', extras after, every cell cleaned."""
    types = {f.name: f.dataType for f in df.schema.fields}

    def cell(name: str) -> Column:
        if name not in types:
            return F.lit("").alias(name)
        if isinstance(types[name], T.ArrayType):
            return sanitize_list_cell(name).alias(name)
        return sanitize_cell(F.col(name).cast("string")).alias(name)

    return df.select(*[cell(c) for c in [*required, *[c for c in df.columns if c not in required]]])


def write_csv(df: DataFrame, path: str, titles: dict[str, str] | None = None) -> None:
    """CSV with display titles, every cell quoted and quotes doubled."""
    out = df.select(*[F.col(c).alias((titles or {}).get(c, c)) for c in df.columns])
    out.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def split_by_category(df: DataFrame, categories: Column, unmatched: str = "unmatched") -> DataFrame:
    """One row per (row, category); rows without a category go to ``unmatched``."""
    filled = F.when(F.size(categories) > 0, categories).otherwise(F.array(F.lit(unmatched)))
    return df.withColumn("category_out", F.explode(filled))


def write_split(df: DataFrame, column: str, path: str, max_rows: int = 1_000_000) -> None:
    """One folder per value; each task writes its own files, so a large value is spread over many."""
    df.write.option("maxRecordsPerFile", max_rows).partitionBy(column).parquet(path)


def write_lines(df: DataFrame, url: str, path: str) -> None:
    """Distinct normalised URLs, sorted, as text."""
    distinct_lines(df, url).write.text(path)


def distinct_lines(df: DataFrame, url: str) -> DataFrame:
    return df.select(normalize_url(url).alias("value")).where("value <> ''").distinct().orderBy("value")


def with_verdict(df: DataFrame, moved: Column, reason: Column, source: str, now: Column, field: Column | None = None,
                 keyword: Column | None = None) -> DataFrame:
    """Rows marked as kept or moved; moved ones carry reason, matched field and keyword, source and time."""
    hit = F.coalesce(moved, F.lit(False))

    def stamp(value: Column | None) -> Column:
        return F.when(hit, value if value is not None else F.lit(""))

    return df.withColumns({
        "move_reason": stamp(reason), "match_field": stamp(field), "match_keyword": stamp(keyword),
        "source_table": stamp(F.lit(source)), "moved_at": stamp(now), "verdict": F.when(hit, MOVED).otherwise(KEPT)})


def move_with_backup(marked: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """(kept rows, backed-up rows) of one write partitioned by the verdict.

    Each row is judged once and lands in exactly one half. The source is untouched; it is replaced by
    the kept half only after this write has succeeded.
    """
    marked.write.partitionBy("verdict").parquet(path)
    stored = marked.sparkSession.read.schema(marked.schema).parquet(path)
    stamps = ["move_reason", "match_field", "match_keyword", "source_table", "moved_at"]
    return stored.where(F.col("verdict") == KEPT).drop("verdict", *stamps), stored.where(F.col("verdict") == MOVED).drop("verdict")


def copy_table(df: DataFrame, path: str, drop: Sequence[str] = (), clear: bool = True) -> None:
    """Copy a table without its internal ids; ``clear`` replaces the target."""
    df.drop(*drop).write.mode("overwrite" if clear else "append").parquet(path)


def replace_table(df: DataFrame, root: str, version: int) -> str:
    """Write the next version of a table beside the current one and return its path.

    A plan may still read the current version while the next is written, so nothing is overwritten.
    """
    path = f"{root.rstrip('/')}/{VERSION}={version}"
    df.write.mode("errorifexists").parquet(path)
    return path


def current_table(spark: SparkSession, root: str) -> DataFrame:
    """The newest version of a table written by :func:`replace_table`; a version's files appear when its job is committed.

    A table that has no version yet is Spark's error of a missing path.
    """
    versions = spark.read.parquet(root)
    newest = versions.agg(F.max(VERSION)).first()[0]  # from the folders' names; no file is read
    return versions.where(F.col(VERSION) == newest).drop(VERSION)
