"""Keyed tables without row-level updates: anti joins, upserts, stage moves, import diffs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchloom.functions.base import ColumnLike, blank_to_null, col, text_or_empty
from merchloom.functions.urls import bare_domain, normalize_url
from merchloom.operators.dedup import by_key, has_key
from merchloom.operators.ranking import first_per_key


def not_stored(new: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows whose key is not stored yet."""
    return new.join(stored.select(*keys).distinct(), list(keys), "left_anti")


def insertable(batch: DataFrame, stored: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows to append: last per key within the batch, unseen keys only; keyless rows pass through."""
    # keyless rows stay out of the join, where they would all meet in one task
    fresh = not_stored(by_key(batch, keys, order, keyless=False), stored, keys)
    return fresh.select(*batch.columns).unionByName(batch.where(~has_key(keys)))


def exclude_blacklisted(urls: DataFrame, url: str, blacklist: DataFrame) -> DataFrame:
    """Drop URLs that are on the blacklist once both are normalised."""
    banned = blacklist.select(normalize_url("url").alias("_url")).distinct()
    return urls.withColumn("_url", normalize_url(url)).join(banned, "_url", "left_anti").drop("_url")


def upsert(stored: DataFrame, news: DataFrame, keys: Sequence[str], now: Column,
           created: str = "created_at", updated: str = "updated_at", flag: str = "change", order: Sequence[Column] = ()) -> DataFrame:
    """Stored rows with the given fields replaced, plus the new rows, and how each row changed.

    Of several new rows with one key the first in ``order`` counts, ties broken by all columns. A row with a NULL
    in its key equals no other: stored ones stay, new ones are added. A field that is NULL in ``news`` keeps its stored value. ``created`` survives an update. The
    caller writes the result to a new place and swaps it in; see ``sources.sinks.replace_table``.
    """
    fields = [c for c in news.columns if c not in keys and c not in (created, updated)]
    one = first_per_key(news.dropna(subset=list(keys)), keys, [*order, *[F.col(c).asc_nulls_last() for c in news.columns]])
    renamed = [*keys, *[F.col(c).alias(f"_n_{c}") for c in fields], F.lit(True).alias("_new")]
    right = one.select(*renamed)
    left = stored.withColumn("_old", F.lit(True))
    joined = left.dropna(subset=list(keys)).join(right, list(keys), "full_outer")
    # rows without a key stay out of the join, where they would all meet in one task
    keyless = ~has_key(keys)
    joined = joined.unionByName(left.where(keyless), allowMissingColumns=True).unionByName(
        news.where(keyless).select(*renamed), allowMissingColumns=True)
    is_new, hit = F.col("_old").isNull(), F.col("_new").isNotNull()
    differs = F.lit(False)
    for name in fields:
        if name in stored.columns:
            differs = differs | (F.col(f"_n_{name}").isNotNull() & ~F.col(f"_n_{name}").eqNullSafe(F.col(name)))
    change = F.when(is_new, "new").when(~hit, "kept").when(differs, "updated").otherwise("unchanged")
    out = [F.col(k) for k in keys]
    for name in [c for c in stored.columns if c not in keys]:
        if name == created:
            out.append(F.when(is_new, now).otherwise(F.col(name)).alias(name))
        elif name == updated:
            out.append(F.when(is_new | (hit & differs), now).otherwise(F.col(name)).alias(name))
        elif name in fields:
            out.append(F.coalesce(f"_n_{name}", name).alias(name))
        else:
            out.append(F.col(name))
    return joined.select(*out, change.alias(flag))


def import_outcome(merged: DataFrame, flag: str = "change") -> DataFrame:
    """Created, updated and skipped counts of an import."""
    return merged.agg(F.count_if(F.col(flag) == "new").alias("created"), F.count_if(F.col(flag) == "updated").alias("updated"),
                      F.count_if(F.col(flag) == "unchanged").alias("skipped"))


def merge_keep_last(old: DataFrame, new: DataFrame, domain: str, time: str, tie: str) -> DataFrame:
    """Old and new rows, last appended per lower-case domain, in time order with unknown times last."""
    both = old.withColumn("_turn", F.lit(0)).unionByName(new.withColumn("_turn", F.lit(1)), allowMissingColumns=True)
    keyed = both.withColumn("_key", F.lower(F.col(domain)))
    kept = first_per_key(keyed, ["_key"], [F.col("_turn").desc(), F.col(tie).desc()])
    return kept.drop("_key", "_turn").orderBy(F.col(time).asc_nulls_last(), tie)


def update_by_ids(df: DataFrame, ids: DataFrame, key: str, changes: Mapping[str, Column]) -> DataFrame:
    """Set columns on the rows whose id is listed."""
    marked = df.join(ids.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left")
    hit = F.coalesce("_hit", F.lit(False))
    return marked.select(*[F.when(hit, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in df.columns])


def delete_by_ids(df: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, one-row table with the number of deleted rows)."""
    listed = ids.select(key).distinct()
    deleted = df.join(listed, key, "left_semi").agg(F.count(F.lit(1)).alias("deleted"))
    return df.join(listed, key, "left_anti"), deleted


def rename_categories(df: DataFrame, mapping: DataFrame, column: str, existing: DataFrame) -> DataFrame:
    """Plan of a rename: target and action per source category; nothing is changed."""
    present = df.groupBy(F.col(column).alias("source")).agg(F.count(F.lit(1)).alias("rows"))
    targets = existing.select(F.col("category").alias("target"), F.lit(True).alias("_taken"))
    return (
        present.join(mapping, "source").join(targets, "target", "left")
        .select("source", "target", "rows", F.when(F.col("_taken"), "skip").otherwise("rename").alias("action"))
    )


def apply_rename(df: DataFrame, plan: DataFrame, column: str, origin: str) -> DataFrame:
    """Carry out the ``rename`` rows of a plan, also inside the ``origin`` text of each row."""
    active = plan.where("action = 'rename'").select(F.col("source").alias(column), F.col("target").alias("_target"))
    joined = df.join(active, column, "left")
    renamed = F.coalesce("_target", F.col(column)).alias(column)
    swapped = F.when(F.col("_target").isNotNull(), F.replace(F.col(origin), F.col(column), F.col("_target"))).otherwise(F.col(origin))
    return joined.select(*[renamed if c == column else swapped.alias(c) if c == origin else F.col(c) for c in df.columns])


def move_stage(urls: DataFrame, facts: DataFrame, source: str, target: str, keys: Sequence[str] = ("category", "domain")) -> DataFrame:
    """Rows of ``source`` that have facts go to ``target`` with them; the others stay as they are.

    One pass over one table with a stage column: nothing is removed from one place and added to another.
    """
    info = facts.withColumn("_hit", F.lit(True))
    joined = urls.join(info, list(keys), "left")
    moves = F.coalesce("_hit", F.lit(False)) & (F.col("stage") == source)
    extra = [F.when(moves, F.col(c)).alias(c) for c in facts.columns if c not in keys]
    kept = [c for c in urls.columns if c not in ("stage",)]
    return joined.select(*kept, F.when(moves, target).otherwise(F.col("stage")).alias("stage"), *extra)


def sync_servers(items: DataFrame, stored: DataFrame, now: Column) -> DataFrame:
    """Server rows from a loosely typed feed, upserted by domain; blanks never overwrite."""
    feed = items.select(
        bare_domain("domain").alias("domain"), blank_to_null("ip").alias("ip"), blank_to_null("main_category").alias("main_category"))
    latest = feed.where("domain <> ''").groupBy("domain").agg(
        F.max("ip").alias("ip"), F.max("main_category").alias("main_category"))
    return upsert(stored, latest, ["domain"], now)


def first_listing(listings: DataFrame, product: str, order: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    """Product to the first menu entry that lists it."""
    return first_per_key(listings, [product], order).select(product, *columns)


def label_or_key(df: DataFrame, labels: DataFrame, key: str, label: str, default: ColumnLike | None = None) -> DataFrame:
    """Left join to a label table; rows without a label fall back to the default or the key itself."""
    fallback = col(default) if default is not None else F.col(key)
    return df.join(labels, key, "left").withColumn(label, F.coalesce(label, fallback))


def with_rate(df: DataFrame, rates: DataFrame, currency: str) -> tuple[DataFrame, DataFrame]:
    """(rows with their rate, rows whose currency is unknown)."""
    table = rates.select(F.upper(text_or_empty("code")).alias(currency), "rate")
    keyed = df.withColumn(currency, F.upper(text_or_empty(currency)))
    return keyed.join(table, currency), keyed.join(table, currency, "left_anti")
