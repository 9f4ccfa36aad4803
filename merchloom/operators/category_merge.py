"""Category clean-up over the distinct categories of a table, applied back by join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchloom.functions.categories import DROP_ROW, OTHER, category_key, clean_category_path, key_text
from merchloom.functions.similarity import jaccard
from merchloom.functions.text import squeeze_words
from merchloom.operators.fuzzy import similar_pairs
from merchloom.operators.lexicon import substring_hits
from merchloom.operators.ranking import first_per_key
from merchloom.session import cut_lineage

SMALL_CATEGORY = 30
WORD_SCORE_MIN, CLOSE_MIN = 0.40, 62.0
# Public labels small categories may be spread over.
PUBLIC_LABELS = (
    "Best Seller", "Featured", "Accessories", "Other", "New Arrival", "Exclusive", "Limited Edition", "Hot Sale",
    "Most Popular", "Trending", "Special Offer", "Flash Sale",
)


def with_clean_category(df: DataFrame, column: str) -> DataFrame:
    """Add ``clean_category`` and its ``cat_key``; a narrow step, so that the input is read once."""
    cleaned = df.withColumn("clean_category", clean_category_path(column))
    keyed = cleaned.withColumn("cat_key", category_key("clean_category"))
    return keyed.withColumn("cat_key", F.when(F.col("cat_key") == "", "other").otherwise(F.col("cat_key")))


def representatives(df: DataFrame, key: str = "cat_key", label: str = "clean_category", rows: str | None = None) -> DataFrame:
    """Rows per key and its most frequent spelling; the smaller spelling wins a tie. ``rows`` names a column of counts."""
    spellings = df.groupBy(key, label).agg((F.sum(rows) if rows else F.count(F.lit(1))).alias("_n"))
    totals = spellings.groupBy(key).agg(F.sum("_n").alias("rows"))
    best = first_per_key(spellings, [key], [F.col("_n").desc(), F.col(label)])
    return totals.join(best.select(key, F.col(label).alias("representative")), key)


def best_category(small: DataFrame, large: DataFrame) -> DataFrame:
    """Best large category for each small one: (small, target), ``Other`` when nothing fits.

    Tiers: equal key; small key inside the large key or its first words; shared words scored by
    Jaccard and length; closest spelling. Both sides are distinct categories and every tier is an
    equi-join: on the key, on character grams, on word prefixes, on a shared word, on letter tokens.
    The last tier runs only for what the others left over.
    """
    s = small.select("category").distinct().withColumn("_sk", category_key("category")).withColumn(
        "_sc", key_text("_sk")).withColumn("_sw", F.array_distinct(squeeze_words("_sc")))
    g = large.select(F.col("category").alias("target")).distinct().withColumn("_lk", category_key("target")).withColumn(
        "_lc", key_text("_lk")).withColumn("_lw", F.array_distinct(squeeze_words("_lc")))
    # distinct categories feed every tier: worked out once, not once per tier
    # few bytes, but many pairs: dealt out to all cores, where a small table would stay in one partition
    cores = s.sparkSession.sparkContext.defaultParallelism
    g = cut_lineage(g.where("_lc <> ''").repartition(cores, "target"))
    s = cut_lineage(s.repartition(cores, "category"))
    usable = s.where("_sk <> ''")
    equal = usable.join(g, usable["_sk"] == g["_lk"]).select("category", "target", F.lit(1).alias("_tier"), F.lit(0.0).alias("_score"))
    inside = substring_hits(g.select("target", "_lk"), ["target"], "_lk", usable.select("category", F.col("_sk").alias("term")))
    words = F.split("_lc", " ")
    starts = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda n: F.array_join(F.slice(words, 1, n), " "))
    heads = g.where(F.size(words) > 1).select("target", F.explode(starts).alias("_sc"))
    headed = usable.join(heads, "_sc")
    contained = inside.select("category", "target").unionByName(headed.select("category", "target")).distinct().select(
        "category", "target", F.lit(2).alias("_tier"), F.lit(0.0).alias("_score"))
    shared = (
        usable.select("category", "_sw", F.explode("_sw").alias("_w"))
        .join(g.select("target", "_lw", F.explode("_lw").alias("_w")), "_w").drop("_w").distinct()
    )
    sizes = F.least(F.size("_sw"), F.size("_lw")) / F.greatest(F.size("_sw"), F.size("_lw"))
    worded = shared.withColumn("_score", jaccard(F.col("_sw"), F.col("_lw")) * (0.75 + 0.25 * sizes)).where(
        F.col("_score") >= WORD_SCORE_MIN).select("category", "target", F.lit(3).alias("_tier"), "_score")
    found = cut_lineage(equal.unionByName(contained).unionByName(worded))
    left = usable.join(found.select("category").distinct(), "category", "left_anti")
    pairs = similar_pairs(left, "_sc", g, "_lc", CLOSE_MIN / 100)
    close = left.join(pairs, "_sc").join(g.select("target", "_lc"), "_lc").select(
        "category", "target", F.lit(4).alias("_tier"), F.col("score").alias("_score"))
    ranked = first_per_key(found.unionByName(close), ["category"], [
        F.col("_tier"), F.round("_score", 9).desc(), F.col("target")])
    return s.select("category").join(ranked.select("category", "target"), "category", "left").withColumn(
        "target", F.coalesce("target", F.lit(OTHER)))


def merge_map(counts: DataFrame, threshold: int = SMALL_CATEGORY) -> DataFrame:
    """(cat_key, target) for small categories that fit a large one."""
    counts = cut_lineage(counts)
    large = counts.where((F.col("rows") >= threshold) & (F.col("representative") != OTHER))
    small = counts.where((F.col("rows") < threshold) & (F.col("representative") != OTHER))
    matched = best_category(small.select(F.col("representative").alias("category")), large.select(F.col("representative").alias("category")))
    useful = matched.where((F.col("target") != OTHER) & (F.col("target") != F.col("category")))
    return small.join(useful.withColumnRenamed("category", "representative"), "representative").select("cat_key", "target")


def clean_and_merge(df: DataFrame, column: str, threshold: int = SMALL_CATEGORY) -> DataFrame:
    """Clean every category, drop CJK-only rows, then fold small categories into large ones."""
    # distinct spellings are cleaned, rows only look theirs up
    raws = df.groupBy(F.col(column).alias("_raw")).agg(F.count(F.lit(1)).alias("_rows"))
    cleaned = cut_lineage(with_clean_category(raws, "_raw").where(F.col("clean_category") != DROP_ROW))
    mapping = merge_map(representatives(cleaned, rows="_rows"), threshold)
    final = cleaned.join(mapping, "cat_key", "left").select("_raw", F.coalesce("target", "clean_category").alias("_final"))
    return df.join(final, F.col(column).eqNullSafe(F.col("_raw"))).withColumn(column, F.col("_final")).drop("_raw", "_final")


def small_categories(df: DataFrame, column: str, threshold: int) -> DataFrame:
    """Categories below the threshold with their row counts."""
    return df.groupBy(F.col(column).alias("category")).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") < threshold)


def relabel_small(df: DataFrame, column: str, threshold: int, label: str | None = "Other", key: str | None = None) -> DataFrame:
    """Rows of small categories get one label; with ``label=None`` a public label.

    That is picked by the row's ``key``, so the rows of a category are spread, or without a key by the hash of
    the normalised category, so they stay together. Blank categories are left alone.
    """
    small = small_categories(df, column, threshold).where("trim(category) <> ''").select(F.col("category").alias(column), F.lit(True).alias("_small"))
    choices = F.array(*[F.lit(c) for c in PUBLIC_LABELS])
    if label is None:
        hashed = F.conv(F.substring(F.md5(F.lower(F.trim(column)).cast("binary")), 1, 8), 16, 10).cast("bigint")
        value = F.get(choices, F.pmod(F.col(key) if key else hashed, F.lit(len(PUBLIC_LABELS))).cast("int"))
    else:
        value = F.lit(label)
    return df.join(small, column, "left").withColumn(column, F.when(F.col("_small"), value).otherwise(F.col(column))).drop("_small")


def merge_statistics(before: DataFrame, after: DataFrame, column: str) -> DataFrame:
    """Row and category counts before and after a merge."""
    def stats(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(column).alias("categories")).withColumn("step", F.lit(name))

    return stats(before, "before").unionByName(stats(after, "after"))
