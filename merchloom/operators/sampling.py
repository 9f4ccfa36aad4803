"""Small samples per store, search and status predicates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchloom.functions.base import NOT_ALNUM, all_of, any_of, strip
from merchloom.functions.language import NON_LATIN, is_non_english, latin_letters
from merchloom.operators.ranking import top_per_group


def sample_text(df: DataFrame, keys: Sequence[str], text: str, order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` texts per key joined by blanks; at most ``n`` rows per key reach one task."""
    first = top_per_group(df.select(*keys, *order, text), list(keys), [F.col(o) for o in order], n)
    pairs = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_text"))))
    return first.groupBy(*keys).agg(F.array_join(F.transform(pairs, lambda p: p["_text"]), " ").alias("sample"))


def store_language(df: DataFrame, store: str, text: str, order: Sequence[str], n: int = 5) -> DataFrame:
    return sample_text(df, [store], text, order, n).withColumn("english", ~is_non_english("sample"))


def store_language_structured(df: DataFrame, store: str, text: str, order: Sequence[str], n: int = 20) -> DataFrame:
    """The accent-ratio variant over the usable texts among the first ``n``."""
    first = top_per_group(df.select(store, *order, text), [store], [F.col(o) for o in order], n)
    plain = first.withColumn(text, strip(F.regexp_replace(text, "<[^>]+>", ""))).where(F.length(text) >= 20)
    pairs = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_text"))))
    joined = plain.groupBy(store).agg(F.lower(F.array_join(F.transform(pairs, lambda p: p["_text"]), " ")).alias("sample"))
    counted = joined.select(
        "*", latin_letters("sample").alias("_latin"),
        F.length(F.regexp_replace("sample", NOT_ALNUM + "+", "")).alias("_plain"),
        F.length(F.regexp_replace("sample", r"[^\x{e0}-\x{f6}\x{f8}-\x{fe}]+", "")).alias("_accents"))
    foreign = F.col("sample").rlike(NON_LATIN) | ((F.col("_latin") > 0) & (F.col("_accents") > 0.3 * F.col("_latin")))
    bad = (F.col("_plain") >= 30) & (foreign | (F.col("_latin") < 0.6 * F.col("_plain")))
    return counted.select(store, "sample", (~bad).alias("english"))


def confirm_language(df: DataFrame, store: str, page: str, text: str, order: Sequence[str], n: int = 5) -> DataFrame:
    """A store is rejected only when the samples of page 1 and of page 2 are both non-English."""
    samples = sample_text(df.where(F.col(page).isin(1, 2)), [store, page], text, order, n)
    verdicts = samples.groupBy(store).agg(
        F.count(F.lit(1)).alias("_pages"), F.bool_and(is_non_english("sample")).alias("_all_foreign"))
    return verdicts.select(store, ((F.col("_pages") == 2) & F.col("_all_foreign")).alias("rejected"))


def search(df: DataFrame, keyword: str, columns: Sequence[str]) -> DataFrame:
    """Rows with the keyword in any of the columns, case ignored."""
    needle = F.lit(keyword.lower())
    return df.where(any_of([F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), needle) for c in columns]))


def by_status(df: DataFrame, equal: Mapping[str, str], differ: Mapping[str, str]) -> DataFrame:
    """Equality and inequality on status columns; a missing status counts as different."""
    conditions: list[Column] = [F.col(c) == v for c, v in equal.items()]
    conditions += [~F.col(c).eqNullSafe(v) for c, v in differ.items()]
    return df.where(all_of(conditions))
