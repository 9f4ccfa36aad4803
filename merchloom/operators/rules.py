"""Validity rules: predicates, ordered reject reasons and composable rule lists."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchloom.functions.base import (
    NOT_ALNUM, ColumnLike, all_of, any_of, col, first_reason, join_nonblank, re_escape, text_or_empty,
)
from merchloom.functions.language import (
    has_accent, has_non_latin, is_english, latin_letters, letters, non_english_reason,
)
from merchloom.functions.text import strip_html
from merchloom.functions.urls import parse_price_first

# Markers of placeholder pictures.
BAD_IMAGE_MARKERS = ("coming-soon", "noimage", "default", ".svg")
PLACEHOLDER_IMAGE = (
    r"(?i)(coming[\s_.-]*soon|no[\s_.-]*image|placeholder|\.svg|logo|default|missing|empty|blank|"
    r"unavailable|not[\s_-]*available|sample|demo|temp|dummy|generic|stock[\s_-]*photo)"
)
NUMERIC_TITLE = r"^\s*\d+\s*$"


@dataclass(frozen=True)
class RuleProfile:
    """Thresholds of one rule set; see :data:`PROFILES`."""

    min_title: int
    min_desc: int
    min_price: float = 3.0
    max_price: float = 6000.0
    price_mode: str = "first"  # first parseable price, or any of them out of range
    price_required: bool = False

    def with_(self, **changes) -> RuleProfile:
        return replace(self, **changes)


# Title and description lengths of the four rule sets.
PROFILES = {
    "core": RuleProfile(min_title=5, min_desc=0, price_required=True),
    "strict": RuleProfile(min_title=15, min_desc=30),
    "v1": RuleProfile(min_title=8, min_desc=30),
    "mongo": RuleProfile(min_title=8, min_desc=30, price_mode="any"),
}


def price_range(price: ColumnLike, profile: RuleProfile = PROFILES["core"]) -> Column:
    return F.coalesce(col(price).between(profile.min_price, profile.max_price), F.lit(False))


def title_length(title: ColumnLike, profile: RuleProfile = PROFILES["core"]) -> Column:
    return F.length(text_or_empty(title)) >= profile.min_title


def image_valid(images: ColumnLike) -> Column:
    """No image URL looks like a placeholder; an empty list passes."""
    return ~F.coalesce(F.exists(col(images), lambda i: i.rlike(PLACEHOLDER_IMAGE)), F.lit(False))


def bad_image(image: ColumnLike) -> Column:
    text = F.lower(text_or_empty(image))
    return (text == "") | any_of([F.contains(text, F.lit(m)) for m in BAD_IMAGE_MARKERS])


def bad_price(prices: list[ColumnLike], profile: RuleProfile) -> Column:
    def outside(price: Column) -> Column:
        return F.coalesce((price < profile.min_price) | (price > profile.max_price), F.lit(profile.price_required))

    if profile.price_mode == "any":
        return any_of([F.coalesce((parse_price_first(p) < profile.min_price) | (parse_price_first(p) > profile.max_price),
                                  F.lit(False)) for p in prices])
    return outside(parse_price_first(*prices))


def basic_reject_reason(title: ColumnLike, desc: ColumnLike, prices: list[ColumnLike], profile: RuleProfile) -> Column:
    """First of empty, short_desc, short_title, numeric_title, bad_price that applies; '' for a good row."""
    name, text = text_or_empty(title), text_or_empty(desc)
    return first_reason([
        ("empty", (name == "") | (text == "")),
        ("short_desc", F.length(text) < profile.min_desc),
        ("short_title", F.length(name) < profile.min_title),
        ("numeric_title", name.rlike(NUMERIC_TITLE)),
        ("bad_price", bad_price(prices, profile)),
    ])


def combined_reject(title: ColumnLike, desc: ColumnLike, image: ColumnLike, prices: list[ColumnLike],
                    profile: RuleProfile = PROFILES["mongo"]) -> Column:
    """One OR over image markers, price bounds, missing or short text and numeric titles (raw, untrimmed)."""
    def short(value: ColumnLike, size: int) -> Column:
        return F.coalesce((F.length(col(value)) < size) & ~F.contains(col(value), F.lit("\n")), F.lit(False))

    picture = F.coalesce(col(image), F.lit(""))
    markers = any_of([F.contains(F.lower(picture), F.lit(m)) for m in BAD_IMAGE_MARKERS])
    return (
        (picture == "") | markers | bad_price(prices, profile)
        | (F.coalesce(col(desc), F.lit("")) == "") | short(desc, profile.min_desc) | short(title, profile.min_title)
        | F.coalesce(col(title).rlike(NUMERIC_TITLE), F.lit(False))
    )


def with_language_reason(df: DataFrame, title: str = "title", category: str = "category", desc: str = "description",
                         name: str = "language_reason") -> DataFrame:
    """Add the first reason to call the row non-English, on text free of HTML."""
    staged = df.select(
        "*", F.coalesce(strip_html(title, strict=True), F.lit("")).alias("_t"),
        F.coalesce(strip_html(category, strict=True), F.lit("")).alias("_c"),
        F.coalesce(strip_html(desc, strict=True), F.lit("")).alias("_d"))
    texts = staged.select("*", join_nonblank(F.col("_t"), F.col("_c")).alias("_primary"),
                          join_nonblank(F.col("_t"), F.col("_c"), F.col("_d")).alias("_combined"))
    return texts.withColumn(name, non_english_reason(F.col("_primary"), F.col("_d"), F.col("_combined"))).drop(
        "_t", "_c", "_d", "_primary", "_combined")


def bulk_language_reject(title: ColumnLike, category: ColumnLike, desc: ColumnLike) -> Column:
    """The bulk path: foreign script or accents in the title, then Latin ratios on raw text."""
    name, cat, text = (F.coalesce(col(c), F.lit("")) for c in (title, category, desc))
    primary = F.trim(F.concat_ws(" ", name, cat))
    combined = F.trim(F.concat_ws(" ", primary, text))
    p, pl, c, cl = letters(primary), latin_letters(primary), letters(combined), latin_letters(combined)
    by_ratio = (
        F.when(p == 0, False)
        .when((p >= 12) & (pl < 0.55 * p), True)
        .when((pl < 8) & (c >= 80) & (cl < 0.45 * c), True)
        .when(has_non_latin(text), (p < 8) | (pl < 0.5 * p))
        .otherwise(False)
    )
    return has_non_latin(name) | has_accent(name) | by_ratio


def word_pattern(terms: list[str] | tuple[str, ...]) -> str:
    """Pattern for any of the terms as a whole word, longest first."""
    body = "|".join(re_escape(t.lower()) for t in sorted(terms, key=lambda t: (-len(t), t)))
    return f"(^|{NOT_ALNUM})({body})({NOT_ALNUM}|$)"


def lexicon_word_match(terms: list[str] | tuple[str, ...], *columns: ColumnLike) -> Column:
    """A term of the list occurs as a whole word in one of the columns."""
    return F.lower(join_nonblank(*[text_or_empty(c) for c in columns])).rlike(word_pattern(terms))


def contains_any(terms: list[str] | tuple[str, ...], *columns: ColumnLike) -> Column:
    """A term occurs anywhere, also inside a longer word."""
    text = F.lower(F.concat_ws(" ", *[F.coalesce(col(c), F.lit("")) for c in columns]))
    return any_of([F.contains(text, F.lit(t.lower())) for t in terms])


def recycle_if_matched(terms: list[str] | tuple[str, ...], title: ColumnLike, category: ColumnLike, desc: ColumnLike,
                       only_blank: bool = True) -> Column:
    """Category matches; or title and text match, by default only when the category is blank."""
    pattern = word_pattern(terms)
    in_category = F.lower(text_or_empty(category)).rlike(pattern)
    in_text = F.lower(F.concat_ws(" ", text_or_empty(title), text_or_empty(desc))).rlike(pattern)
    return in_category | (in_text & (text_or_empty(category) == "")) if only_blank else in_category | in_text


@dataclass
class RuleSet:
    """An AND of named rules that callers may extend with Columns or Python predicates."""

    rules: dict[str, Callable[[DataFrame], Column]] = field(default_factory=dict)

    @classmethod
    def core(cls, images: str = "images") -> RuleSet:
        return cls({
            "price_range": lambda df: price_range(df["price"]),
            "title_length": lambda df: title_length(df["title"]),
            "image_valid": lambda df: image_valid(df[images]),
            "is_english": lambda df: is_english(F.concat_ws(" ", df["title"], df["description"])),
        })

    def add_rule(self, name: str, rule: Callable[[DataFrame], Column]) -> RuleSet:
        self.rules[name] = rule
        return self

    def add_python_rule(self, name: str, predicate: Callable[..., bool], *columns: str) -> RuleSet:
        """A plain Python predicate over columns, evaluated in Arrow batches."""
        def evaluate(frame: pd.DataFrame) -> pd.Series:
            values = zip(*[frame[c] for c in columns], strict=True)
            return pd.Series([bool(predicate(*v)) for v in values], dtype=bool)

        return self.add_rule(name, lambda df: F.pandas_udf(evaluate, "boolean")(F.struct(*columns)))

    def verdict(self, df: DataFrame, name: str = "failed_rule") -> DataFrame:
        """Add the name of the first failing rule, '' for a valid row."""
        return df.withColumn(name, first_reason([(n, ~F.coalesce(rule(df), F.lit(False))) for n, rule in self.rules.items()]))

    def valid(self, df: DataFrame) -> DataFrame:
        return df.where(all_of([rule(df) for rule in self.rules.values()]))
