"""Matching a catalog to an ordered list of two-level labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchloom.functions.base import let, text_or_empty
from merchloom.functions.similarity import text_score, title_score, token_set
from merchloom.operators.ranking import top_per_group
from merchloom.session import cut_lineage

PER_LABEL_LIMIT = 2000
FALLBACK_MIN = 50_000
CATALOG_MIN = 75.0

Label = tuple[str, str]


def with_first_label(df: DataFrame, names: Sequence[str], category: Column, title: Column) -> DataFrame:
    """Rows taken by a label, with ``label_no`` and ``score`` of the first label in the given order that scores.

    The labels are the lines of one request. A product stops at its first hit, so it belongs to one
    label and is never multiplied. Categories repeat, so their scores are worked out per distinct one.
    """
    if not names:
        return df.limit(0).withColumn("label_no", F.lit(None).cast("int")).withColumn("score", F.lit(0.0))
    labels = F.array(*[F.lit(name) for name in names])
    spellings = df.select(category.alias("_cat")).distinct()
    scores = spellings.withColumn("_scores", F.transform(labels, lambda name: text_score(name, F.col("_cat"))))
    none = F.struct(F.lit(None).cast("int").alias("label_no"), F.lit(0.0).alias("score"))
    entries = F.transform("_scores", lambda score, i: F.struct(i.alias("no"), F.get(labels, i).alias("name"), score.alias("score")))

    def step(found: Column, entry: Column) -> Column:
        def hit(score: Column) -> Column:
            return F.struct(F.when(score > 0, entry["no"]).alias("label_no"), score.alias("score"))

        best = F.when(entry["score"] >= 100.0, entry["score"]).otherwise(F.greatest(entry["score"], title_score(entry["name"], title)))
        return F.when(found["score"] > 0, found).otherwise(let(best, hit))

    joined = df.withColumn("_cat", category).join(scores, "_cat")
    return joined.withColumn("_m", F.aggregate(entries, none, step)).where(F.col("_m.score") > 0).select("*", "_m.*").drop("_m", "_cat", "_scores")


def assign_labels(df: DataFrame, labels: Sequence[Label], key: str, category: str = "category", title: str = "title",
                  limit: int = PER_LABEL_LIMIT, fallback_min: int = FALLBACK_MIN) -> DataFrame:
    """Rows with their label, phase and score: by secondary name, then by primary name if too few.

    Every product goes to one label. Per label the rows of the first phase come first, then the
    better score; a label keeps at most ``limit`` rows.
    """
    cat, name = text_or_empty(category), text_or_empty(title)

    def matched(rows: DataFrame, names: Sequence[str], phase: int) -> DataFrame:
        return with_first_label(rows, names, cat, name).withColumn("phase", F.lit(phase))

    # scoring is the costly part: the matched rows are kept, so that counting them does not repeat it
    rows = cut_lineage(matched(df, [second for _, second in labels], 1))
    per_label = rows.groupBy("label_no").agg(F.least(F.count(F.lit(1)), F.lit(limit)).alias("n"))
    if per_label.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"] < fallback_min:
        rest = df.join(rows.select(key), key, "left_anti")
        rows = rows.unionByName(matched(rest, [primary for primary, _ in labels], 2))
    return top_per_group(rows, ["label_no"], [F.col("phase"), F.round("score", 9).desc(), F.col(key)], limit, rank="place", salt_by=[key])


def catalog_filter(df: DataFrame, label: str, category: str, title: str, minimum: float = CATALOG_MIN) -> DataFrame:
    """Products whose type or title reaches the token-set score against one label."""
    best = F.greatest(token_set(F.lit(label), text_or_empty(category)), token_set(F.lit(label), text_or_empty(title)))
    return df.withColumn("score", best).where(F.col("score") >= minimum)
