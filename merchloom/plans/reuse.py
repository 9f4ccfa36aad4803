"""Pool of store URLs that may be used again after a cooldown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchloom.functions.base import text_or_empty
from merchloom.operators.ranking import top_per_group

COOLDOWN_DAYS = 30
BLOCKED = ("disabled", "deleted")


def cooldown_end(used_at: Column) -> Column:
    return used_at + F.make_dt_interval(days=F.lit(COOLDOWN_DAYS))


def pool_from_usage(usage: DataFrame) -> DataFrame:
    """Pool rows out of usage rows: the cooldown runs from the last use."""
    pool = usage.withColumn("next_reusable_at", cooldown_end(F.col("last_used_at")))
    for name, kind in (("mode2_count", "int"), ("last_matched", "boolean"), ("updated_at", "timestamp_ntz")):
        if name not in pool.columns:
            pool = pool.withColumn(name, F.lit(0 if kind == "int" else None).cast(kind))
    return pool


def reusable(now: Column) -> Column:
    blocked = F.lower(text_or_empty("status")).isin(*BLOCKED)
    cooling = F.coalesce(F.col("next_reusable_at") > now, F.lit(False))
    return ~blocked & ~cooling


def eligible(now: Column, max_use: int = 0, max_mode2: int = 0) -> Column:
    """Reusable and under the use limits; a limit of 0 means none."""
    ok = reusable(now)
    if max_use > 0:
        ok = ok & (F.coalesce("use_count", F.lit(0)) < max_use)
    if max_mode2 > 0:
        ok = ok & (F.coalesce("mode2_count", F.lit(0)) < max_mode2)
    return ok


def pool_summary(pool: DataFrame, now: Column) -> DataFrame:
    counts = {name: F.col("status") == name for name in ("queued", "cooldown", "new")}
    counts |= {"matched": F.col("last_matched"), "unmatched": ~F.col("last_matched"), "reusable": reusable(now)}
    return pool.groupBy("category").agg(F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(n) for n, c in counts.items()])


def release_limit(pool: DataFrame, per_category: int) -> DataFrame:
    """Oldest-updated rows first, at most ``per_category`` each; 0 means all."""
    if per_category == 0:
        return pool
    return top_per_group(pool, ["category"], [F.col("updated_at").asc_nulls_first(), F.col("url")], per_category, salt_by=["url"])


def insert_new(pool: DataFrame, tasks: DataFrame, now: Column) -> DataFrame:
    """Pool with the tasks whose (category, url) is not in it yet, as new rows."""
    fresh = tasks.select("category", "url").dropDuplicates().join(pool.select("category", "url"), ["category", "url"], "left_anti")
    added = fresh.withColumns({"status": F.lit("new"), "use_count": F.lit(0).cast("bigint"), "updated_at": now})
    return pool.unionByName(added, allowMissingColumns=True)


def release(pool: DataFrame, now: Column, per_category: int = 0, queued: DataFrame | None = None, **limits: int) -> DataFrame:
    """Eligible rows to put back into the task list; already queued URLs do not use up the limit."""
    ready = pool.where(eligible(now, **limits))
    if queued is not None:
        ready = ready.join(queued.select("url").distinct(), "url", "left_anti")
    return release_limit(ready, per_category).withColumn("status", F.lit("queued")).withColumn("updated_at", now)


def consume(pool: DataFrame, used: DataFrame, now: Column, mode: int = 1) -> DataFrame:
    """Pool after the given (category, url, matched) rows were used once."""
    hits = used.groupBy("category", "url").agg(F.bool_or("matched").alias("_matched"), F.count(F.lit(1)).alias("_uses"))
    joined = pool.join(hits, ["category", "url"], "left")
    hit = F.col("_uses").isNotNull()

    def swap(name: str, value: Column) -> Column:
        return F.when(hit, value).otherwise(F.col(name)).alias(name)

    changed = {
        "status": swap("status", F.lit("cooldown")), "last_used_at": swap("last_used_at", now),
        "first_used_at": swap("first_used_at", F.coalesce("first_used_at", now)),
        "next_reusable_at": swap("next_reusable_at", cooldown_end(now)), "updated_at": swap("updated_at", now),
        "last_matched": swap("last_matched", F.col("_matched")),
        "use_count": (F.coalesce("use_count", F.lit(0)) + F.coalesce("_uses", F.lit(0))).alias("use_count"),
        "mode2_count": (F.coalesce("mode2_count", F.lit(0)) + (F.coalesce("_uses", F.lit(0)) if mode == 2 else F.lit(0))).alias("mode2_count"),
    }
    return joined.select(*[changed.get(c, F.col(c)) for c in pool.columns])
