"""Which category a table stands for, and which table a category belongs to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchloom.functions.base import any_of
from merchloom.functions.text import normalize_collection_name, slugify
from merchloom.operators.ranking import first_per_key


def resolve_expected(df: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """Add ``expected``: target of the exact alias, else of the longest alias found in the name.

    Aliases with Latin letters match as whole words, others by containment either way. Names are
    resolved once each. Word runs and character grams turn both tests into equi-joins.
    """
    names = df.select(normalize_collection_name(column).alias("_name")).distinct().where("_name <> ''")
    latin = aliases.where(F.col("alias").rlike("[a-z]")).select("alias", "target")
    other = aliases.where(~F.col("alias").rlike("[a-z]") & (F.col("alias") != "")).select("alias", "target")
    words = F.split("_name", " ")
    sizes = sorted(r[0] for r in latin.select(F.size(F.split("alias", " "))).distinct().collect())

    def runs(n: int) -> F.Column:
        starts = F.sequence(F.lit(1), F.size(words) - (n - 1))
        return F.when(F.size(words) >= n, F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(
            F.array().cast("array<string>"))

    pieces = F.array_distinct(F.concat(*[runs(n) for n in sizes])) if sizes else F.array().cast("array<string>")
    by_word = names.select("_name", F.explode(pieces).alias("alias")).join(latin, "alias")
    # an alias inside the name starts at one of the name's characters; a name inside an alias likewise
    chars = F.regexp_extract_all(F.col("_name"), F.lit(r"(?s)([^\x00-\x7F])"), 1)
    foreign = names.where(F.col("_name").rlike(r"[^\x00-\x7F]"))
    left = foreign.select("_name", F.explode(F.array_distinct(chars)).alias("_char"))
    right = other.select("alias", "target", F.explode(F.array_distinct(F.regexp_extract_all("alias", F.lit(r"(?s)([^\x00-\x7F])"), 1))).alias("_char"))
    by_part = (
        left.join(right, "_char").where(any_of([F.contains("_name", F.col("alias")), F.contains("alias", F.col("_name"))]))
        .select("_name", "alias", "target").distinct()
    )
    hits = by_word.select("_name", "alias", "target").unionByName(by_part)
    best = first_per_key(hits, ["_name"], [
        (F.col("_name") == F.col("alias")).desc(), F.length("alias").desc(), F.col("alias")])
    return (
        df.withColumn("_name", normalize_collection_name(column))
        .join(best.select("_name", F.col("target").alias("expected")), "_name", "left")
        .withColumn("expected", F.coalesce("expected", F.lit(""))).drop("_name")
    )


def resolve_targets(wanted: DataFrame, tables: DataFrame, aliases: DataFrame, preferred: DataFrame) -> DataFrame:
    """Target table per (category, source table): a preferred name that exists, else the best-scored
    table that stands for the category, else the first preferred name, else a slug.
    """
    keys = ["category", "source_table"]
    asked = wanted.select(*keys).distinct()
    named = (
        asked.join(preferred.select("category", "ord", F.lower("name").alias("_lower")), "category")
        .join(tables.select("name", F.lower("name").alias("_lower")), "_lower")
        .where(F.col("name") != F.col("source_table"))
    )
    by_name = first_per_key(named, keys, [F.col("ord"), F.col("name")]).select(*keys, F.col("name").alias("_preferred"))
    known = resolve_expected(tables, "name", aliases).where("expected <> ''").withColumnRenamed("expected", "category")
    exact = normalize_collection_name("name") == normalize_collection_name("category")
    score = (
        F.when(exact, 100).otherwise(0) + F.when(F.col("name").rlike("[A-Za-z]"), 10).otherwise(0)
        + F.when(F.col("name").rlike("[ _]"), 5).otherwise(0) + F.least(F.length("name"), F.lit(30))
    )
    scored = asked.join(known, "category").where(F.col("name") != F.col("source_table")).withColumn("_score", score)
    by_score = first_per_key(scored, keys, [F.col("_score").desc(), F.lower("name"), F.col("name")]).select(
        *keys, F.col("name").alias("_scored"))
    first = first_per_key(preferred, ["category"], [F.col("ord")]).select("category", F.col("name").alias("_first"))
    return (
        asked.join(by_name, keys, "left").join(by_score, keys, "left").join(first, "category", "left")
        .select(*keys, F.coalesce("_preferred", "_scored", "_first", slugify("category")).alias("table_name"))
    )
