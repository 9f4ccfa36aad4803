"""Composed clean-up plans: one lazy plan per job, a verdict column instead of staged deletes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchloom.functions.base import first_reason, text_or_empty
from merchloom.functions.categories import DROP_ROW
from merchloom.functions.text import clean_description, clean_tags, clean_title
from merchloom.operators import category_merge as M
from merchloom.operators import dedup, rules, taxonomy
from merchloom.operators.lexicon import Lexicon
from merchloom.session import cut_lineage

PRICES = ("discount_price", "original_price")


def process_all(df: DataFrame, key: str, nodes: DataFrame, image_limit: int = dedup.BULK_IMAGE_LIMIT) -> DataFrame:
    """Clean title, description, tags and category, then drop rows with over-used images."""
    # pictures are not changed by the cleaning: over-used ones are found on the narrow raw rows
    out = dedup.remove_bulk_images(df, key, "images", image_limit)
    out = out.withColumn("title", clean_title("title")).withColumn("description", clean_description("description"))
    if "tags" in df.columns:
        out = out.withColumn("tags", clean_tags("tags"))
    named = taxonomy.normalize_to_taxonomy(out, "category", nodes)
    return named.withColumn("category", F.col("normalized")).drop("normalized", "known")


def core_verdicts(df: DataFrame, key: str, nodes: DataFrame, prohibited: tuple[str, ...], image_limit: int = dedup.BULK_IMAGE_LIMIT) -> DataFrame:
    """Cleaned, title-distinct rows with the first rule they fail, '' for those to keep."""
    processed = process_all(df, key, nodes, image_limit)
    distinct = dedup.by_title_first(processed, "title", [key])
    tags = [F.array_join("tags", " ")] if "tags" in df.columns else []
    ruled = rules.RuleSet.core().add_rule(
        "prohibited", lambda d: ~rules.contains_any(prohibited, d["title"], d["description"], *tags))
    return ruled.verdict(distinct, "verdict")


def verdict_counts(df: DataFrame, verdict: str = "verdict") -> DataFrame:
    """Rows per verdict; kept rows count as ``kept``."""
    name = F.when(F.col(verdict) == "", "kept").otherwise(F.col(verdict))
    return df.groupBy(name.alias(verdict)).agg(F.count(F.lit(1)).alias("rows"))


@dataclass(frozen=True)
class Checks:
    """Checks by name, each adding a reason column to the frame; '' means passed."""

    profile: rules.RuleProfile = rules.PROFILES["strict"]
    lexicon_terms: tuple[str, ...] = ()
    prohibited: Lexicon | None = None

    def basic(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_r", rules.basic_reject_reason("title", "description", list(PRICES), self.profile))

    def lexicon(self, df: DataFrame) -> DataFrame:
        hit = rules.lexicon_word_match(self.lexicon_terms, "title", "category", "description")
        return df.withColumn("_r", F.when(hit, "lexicon").otherwise(""))

    def image(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_r", F.when(rules.bad_image("image"), "bad_image").otherwise(""))

    def english(self, df: DataFrame) -> DataFrame:
        return rules.with_language_reason(df, name="_r")

    def category(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_r", F.when(F.col("clean_category") == DROP_ROW, "cjk_category").otherwise(""))

    def forbidden(self, df: DataFrame) -> DataFrame:
        found = self.prohibited.first_match(df)
        return found.withColumn("_r", F.when(F.col("match_field") != "", "forbidden_keyword").otherwise(""))


def staged_verdict(df: DataFrame, steps: list[Callable[[DataFrame], DataFrame]], name: str = "verdict") -> DataFrame:
    """Add the first reason any of the ordered steps gives."""
    reasons = []
    for number, step in enumerate(steps):
        column = f"_reason_{number}"
        df = step(df).withColumnRenamed("_r", column)
        reasons.append(column)
    first = F.coalesce(*[F.expr(f"nullif({c}, '')") for c in reasons], F.lit(""))
    return df.withColumn(name, first).drop(*reasons)


def extract_to_clean(df: DataFrame, lexicon_terms: tuple[str, ...]) -> DataFrame:
    """Verdicts of the raw-to-clean job: basic, lexicon, image, language, category."""
    checks = Checks(lexicon_terms=lexicon_terms)
    keyed = M.with_clean_category(df, "category")
    return staged_verdict(keyed, [checks.basic, checks.lexicon, checks.image, checks.english, checks.category])


def staging_to_clean(df: DataFrame, prohibited: Lexicon) -> DataFrame:
    """Verdicts of the staging job: as above without the lexicon, with prohibited rows to recycle."""
    checks = Checks(prohibited=prohibited)
    keyed = M.with_clean_category(df, "category")
    return staged_verdict(keyed, [checks.basic, checks.image, checks.english, checks.category, checks.forbidden])


def merge_clean(kept: DataFrame, threshold: int = M.SMALL_CATEGORY) -> DataFrame:
    """Kept rows with their cleaned category, small ones folded into large ones."""
    kept = cut_lineage(kept)  # counted and joined, and no verdict is given twice
    mapping = M.merge_map(M.representatives(kept), threshold)
    return kept.join(mapping, "cat_key", "left").withColumn(
        "category", F.coalesce("target", "clean_category")).drop("cat_key", "clean_category", "target")


def bulk_cleanup(df: DataFrame, prohibited: Lexicon) -> DataFrame:
    """Verdicts of the bulk path: raw-text checks, any price out of range, Latin ratios, then terms."""
    profile = rules.PROFILES["strict"].with_(price_mode="any")
    title, desc = F.coalesce("title", F.lit("")), F.coalesce("description", F.lit(""))
    picture = F.coalesce("image", F.lit(""))
    markers = rules.any_of([F.contains(F.lower(picture), F.lit(m)) for m in rules.BAD_IMAGE_MARKERS])
    basic = first_reason([
        ("empty", (title == "") | (desc == "")),
        ("short_title", F.length(title) < profile.min_title), ("short_desc", F.length(desc) < profile.min_desc),
        ("numeric_title", title.rlike(rules.NUMERIC_TITLE)), ("bad_image", (picture == "") | markers),
        ("bad_price", rules.bad_price(list(PRICES), profile)),
        ("non_english", rules.bulk_language_reject("title", "category", "description")),
    ])
    checked = prohibited.first_match(df.withColumn("_basic", basic))
    forbidden = F.when(F.col("match_field") != "", "forbidden_keyword").otherwise("")
    return checked.withColumn("verdict", F.coalesce(F.expr("nullif(_basic, '')"), forbidden)).drop("_basic")


def full_cleanup(df: DataFrame, prohibited: Lexicon, threshold: int = M.SMALL_CATEGORY) -> DataFrame:
    """Bulk clean-up, then category clean-up and merge of what is left."""
    kept = bulk_cleanup(df, prohibited).where("verdict = ''").drop("verdict", "match_field", "match_keyword")
    return M.clean_and_merge(cut_lineage(kept), "category", threshold)


def collection_filter(collections: DataFrame, title: str, nodes: DataFrame) -> DataFrame:
    """Collections whose title fits the taxonomy go on as ``filtered``, the others stay ``unfiltered``."""
    flagged = taxonomy.overlap_flag(collections, title, nodes, "_fits")
    return flagged.withColumn("stage", F.when(F.col("_fits"), "filtered").otherwise("unfiltered")).drop("_fits")


def discover(results: DataFrame, existing: DataFrame, min_products: int, url: str = "url", order: str = "result_id") -> DataFrame:
    """Captured search results to store rows: new public domains on a known platform with enough products."""
    fresh = dedup.by_domain(results, url, [order], existing)
    known = F.col("platform").isin("Shopify", "WooCommerce", "Magento", "BigCommerce")
    return fresh.where(known & (F.col("product_count") >= min_products)).select(
        "domain", "clean_url", "platform", "product_count", text_or_empty("category").alias("category"), F.lit("unfiltered").alias("stage"))
