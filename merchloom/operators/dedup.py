"""De-duplication by title, key, domain and picture."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchloom.functions.base import all_of, text_or_empty
from merchloom.functions.urls import extract_domain, public_url
from merchloom.operators.ranking import first_per_key, numbered
from merchloom.session import cut_lineage

BULK_IMAGE_LIMIT = 20


def by_title_first(df: DataFrame, title: str, order: Sequence[str]) -> DataFrame:
    """First row per trimmed lower-case title; rows with a blank title are dropped."""
    keyed = df.withColumn("_key", F.lower(text_or_empty(title))).where("_key <> ''")
    return first_per_key(keyed, ["_key"], [F.col(o) for o in order]).drop("_key")


def by_title_min_id(df: DataFrame, title: str, key: str) -> DataFrame:
    """Lowest id per exact trimmed title; rows with a blank title are all kept."""
    keyed = df.withColumn("_key", text_or_empty(title))
    kept = first_per_key(keyed.where("_key <> ''"), ["_key"], [F.col(key)])
    return kept.unionByName(keyed.where("_key = ''")).drop("_key")


def by_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], keyless: bool = True) -> DataFrame:
    """One row per key in the given order; rows without a key pass through."""
    kept = first_per_key(df.where(has_key(keys)), keys, order)
    return kept.unionByName(df.where(~has_key(keys))) if keyless else kept


def has_key(keys: Sequence[str]) -> Column:
    """Every key column is filled."""
    return all_of([F.coalesce(F.col(k).cast("string"), F.lit("")) != "" for k in keys])


def by_domain(df: DataFrame, url: str, order: Sequence[str], existing: DataFrame | None = None) -> DataFrame:
    """First URL per public domain; translated pages and known domains are left out."""
    cleaned = df.withColumn("clean_url", public_url(url)).withColumn("domain", extract_domain("clean_url"))
    usable = cleaned.where((F.col("domain") != "") & ~F.contains("clean_url", F.lit("translate.google.com")))
    if existing is not None:
        usable = usable.join(existing.select(F.lower("domain").alias("domain")).distinct(), "domain", "left_anti")
    return first_per_key(usable, ["domain"], [F.col(o) for o in order])


def title_groups(df: DataFrame, title: str) -> DataFrame:
    """Titles that occur more than once: rows and how many could go."""
    groups = df.groupBy(text_or_empty(title).alias("title")).agg(F.count(F.lit(1)).alias("rows"))
    return groups.where("title <> '' AND rows > 1").withColumn("deletable", F.col("rows") - 1)


def title_summary(df: DataFrame, title: str) -> DataFrame:
    """One row: repeated titles, rows that could go, rows without a title (they stay), rows that would remain."""
    groups = df.groupBy(text_or_empty(title).alias("title")).agg(F.count(F.lit(1)).alias("n"))
    named = F.col("title") != ""
    return groups.agg(
        F.count_if(named & (F.col("n") > 1)).alias("groups"), F.coalesce(F.sum(F.when(named, F.col("n") - 1)), F.lit(0)).alias("deletable"),
        F.coalesce(F.sum(F.when(~named, F.col("n"))), F.lit(0)).alias("blank"), F.coalesce(F.sum(F.when(named, 1).otherwise(F.col("n"))), F.lit(0)).alias("remaining"))


def title_examples(df: DataFrame, title: str, n: int = 15) -> DataFrame:
    """The most repeated titles."""
    return title_groups(df, title).select("title", "rows").orderBy(F.desc("rows"), "title").limit(n)


def image_frequency(df: DataFrame, images: str) -> DataFrame:
    """Occurrences of every non-blank image over all lists; counted before the shuffle as well."""
    return (
        df.select(F.explode(images).alias("image")).where("image <> ''")
        .groupBy("image").agg(F.count(F.lit(1)).alias("uses"))
    )


def remove_bulk_images(df: DataFrame, key: str, images: str, limit: int = BULK_IMAGE_LIMIT) -> DataFrame:
    """Drop every row with an image used more than ``limit`` times.

    Images and keys meet in narrow pairs, pre-aggregated before the shuffle; the rows are then left out by
    key, and Spark broadcasts the keys when they are few.
    """
    heavy = image_frequency(df, images).where(F.col("uses") > limit).select("image")
    pairs = df.select(key, F.explode(images).alias("image")).where("image <> ''")
    bad = pairs.join(heavy, "image", "left_semi").select(key).distinct()
    return df.join(bad, key, "left_anti")


def repeated_pages(df: DataFrame, key: str, page: str, signature: Column, limit: int = 2) -> DataFrame:
    """Pages in reading order until an unchanged signature has repeated ``limit`` times in a row.

    Keeps everything before the page at which reading stops; ``repeats`` counts the run so far. A key
    may own a large share of all pages, so no window is opened per key: pages are numbered over the
    whole table, a page meets the one before it by number, and as reading stops at ``limit`` it is
    enough to look that many pages back.
    """
    rows = numbered(df.select(key, page, signature.alias("_sig")), [F.col(key), F.col(page)], "_n")
    before = rows.select(key, (F.col("_n") + 1).alias("_n"), F.col("_sig").alias("_before"))
    flags = rows.join(before, [key, "_n"], "left").select(
        key, page, "_n", F.coalesce((F.col("_sig") == F.col("_before")) & (F.col("_sig") != ""), F.lit(False)).alias("_same_0"))
    flags = cut_lineage(flags)
    looked = flags
    for back in range(1, limit):
        earlier = flags.select(key, (F.col("_n") + back).alias("_n"), F.col("_same_0").alias(f"_same_{back}"))
        looked = looked.join(earlier, [key, "_n"], "left")
    run, repeats = F.lit(True), F.lit(0)
    for back in range(limit):
        run = run & F.coalesce(f"_same_{back}", F.lit(False))
        repeats = repeats + F.when(run, 1).otherwise(0)
    counted = looked.select(key, page, repeats.alias("repeats"))
    stops = counted.where(F.col("repeats") >= limit).groupBy(key).agg(F.min(page).alias("_stop"))
    kept = counted.join(stops, key, "left").where(F.col("_stop").isNull() | (F.col(page) < F.col("_stop"))).drop("_stop")
    return df.join(kept, [key, page])
