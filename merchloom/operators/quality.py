"""Quality score, quota allocation and ranked selection per category."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchloom.functions.base import text_or_empty
from merchloom.functions.text import strip_html, title_words
from merchloom.functions.urls import parse_price_first
from merchloom.operators import rules as R
from merchloom.operators.ranking import first_rows, running_sum, top_per_group

NO_TITLE_SCORE = -9999


def with_quality(df: DataFrame, title: str = "title", category: str = "category", desc: str = "description",
                 image: str = "image", prices: Sequence[str] = ("discount_price", "original_price"),
                 variant_name: Column | None = None, variant_value: Column | None = None,
                 image_count: Column | None = None) -> DataFrame:
    """Add ``quality``, ``title_len`` and ``desc_len``, the sort key of an export."""
    profile = R.PROFILES["strict"]
    staged = R.with_language_reason(df, title, category, desc, "_language").select(
        "*", F.coalesce(strip_html(title, strict=True), F.lit("")).alias("_title"),
        F.length(F.coalesce(strip_html(desc, strict=True), F.lit(""))).alias("desc_len"),
        R.basic_reject_reason(title, desc, list(prices), profile).alias("_reason"),
        R.bad_image(image).alias("_bad_image"), parse_price_first(*prices).alias("_price"))
    staged = staged.select("*", F.length("_title").alias("title_len"), F.size(title_words("_title")).alias("_words"),
                           F.size(F.array_distinct(title_words(F.lower("_title")))).alias("_distinct"))
    words, distinct, size, text = (F.col(c) for c in ("_words", "_distinct", "title_len", "desc_len"))
    reason, price = F.col("_reason"), F.col("_price")
    has_variant = F.lit(False)
    if variant_name is not None and variant_value is not None:
        has_variant = (text_or_empty(variant_name) != "") & (text_or_empty(variant_value) != "")
    several = F.coalesce(image_count, F.lit(1)) > 1 if image_count is not None else F.lit(False)
    # Points per feature.
    points = (
        F.when(words < 3, -500).when(words >= 5, 120).otherwise(40)
        + F.when(distinct >= 4, 100).when(distinct >= 2, 40).otherwise(0)
        + F.when(size.between(30, 80), 180).when(size.between(20, 29), 60).when(size.between(81, 120), 20)
        .when(size < 20, -300).otherwise(0)
        + F.when(text == 0, -600).when(text < 30, -250).when(text < 60, 30).when(text < 150, 150).otherwise(300)
        + F.when(reason == "", 80).when(reason.isin("empty", "numeric_title"), -400).when(reason == "short_title", -300)
        .when(reason == "bad_price", -150).otherwise(0)
        + F.when(F.col("_language") == "", 150).otherwise(-400)
        + F.when(F.col("_bad_image"), -250).when(several, 150).otherwise(60)
        + F.when(price.between(profile.min_price, profile.max_price), 100).when(price.isNotNull(), -50).otherwise(-100)
        + F.when(F.coalesce(F.col(category), F.lit("")) != "", 60).otherwise(0)
        + F.when(has_variant, 80).otherwise(0)
    )
    scored = staged.withColumn("quality", F.when(size == 0, NO_TITLE_SCORE).otherwise(points))
    return scored.withColumn("title_len", F.when(size == 0, 0).otherwise(size)).drop(
        "_title", "_language", "_reason", "_bad_image", "_price", "_words", "_distinct")


def quality_order(key: str) -> list[Column]:
    """Best rows first; the text of the key settles ties."""
    return [F.col("quality").desc(), F.col("title_len").desc(), F.col("desc_len").desc(), F.col(key).cast("string").desc()]


def category_counts(df: DataFrame, category: str = "category") -> DataFrame:
    """Rows per trimmed non-blank category."""
    return (
        df.select(F.trim(F.coalesce(F.col(category), F.lit(""))).alias("name")).where("name <> ''")
        .groupBy("name").agg(F.count(F.lit(1)).alias("count"))
    )


def allocate_quota(counts: DataFrame, total: int, minimum: int, maximum: int) -> DataFrame:
    """Rows each category may export: ``minimum`` each while the budget lasts, the rest in the same order.

    Categories are taken by size, then name. What those before a category have taken is a parallel prefix sum.
    """
    if minimum < 1:
        raise ValueError("minimum must be at least 1")
    places = total // minimum if maximum >= minimum else 0
    order = [F.col("count").desc(), F.col("name")]
    eligible = counts.where(F.col("count") >= minimum)
    chosen = first_rows(eligible, order, places) if places else eligible.limit(0)
    room = chosen.select("name", "count", (F.least(F.col("count"), F.lit(maximum)) - minimum).alias("_room"))
    ranked = running_sum(room, order, "_room", "_before", "_n")
    extra = F.greatest(F.lit(0), F.least(F.col("_room"), F.lit(total) - F.col("_n") * minimum - F.col("_before")))
    return ranked.select("name", "count", (extra + minimum).cast("bigint").alias("allocated"))


def select_by_quota(scored: DataFrame, allocation: DataFrame, maximum: int, key: str, category: str = "category") -> DataFrame:
    """The best ``allocated`` rows of each category, with their rank."""
    quota = allocation.select(F.col("name").alias("_name"), "allocated")
    chosen = scored.join(quota, F.trim(F.col(category)) == F.col("_name"))
    ranked = top_per_group(chosen, ["_name"], quality_order(key), maximum, rank="place", salt_by=[key])
    return ranked.where(F.col("place") <= F.col("allocated")).drop("_name", "allocated")
