"""Use and cooldown of reusable URLs as streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from merchloom.plans.reuse import COOLDOWN_DAYS, cooldown_end
from merchloom.session import drop_scratch, scratch_count, scratch_path
from merchloom.streaming.ingest import batch_log, run_available

KEYS = ("category", "url")
OUTPUT = "category string, url string, status string, at timestamp"
_COOLDOWN_US = COOLDOWN_DAYS * 86_400_000_000


def record_uses(uses: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Log of (category, url, use_count, first_used_at, last_used_at, last_matched) per batch, without any state.

    Of several uses at the last moment a match counts.
    """
    def write(batch: DataFrame, number: int) -> None:
        last = F.max(F.struct("used_at", "matched"))
        rows = batch.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("use_count"), F.min("used_at").alias("first_used_at"), last.alias("_last"))
        batch_log(path)(rows.select(
            *KEYS, "use_count", "first_used_at", F.col("_last.used_at").alias("last_used_at"), F.col("_last.matched").alias("last_matched")), number)

    return run_available(uses, checkpoint, write)


USES = "category string, url string, use_count bigint, first_used_at timestamp, last_used_at timestamp, last_matched boolean"


def pool_totals(log: DataFrame, now: Column | None = None) -> DataFrame:
    """The pool out of the log: uses are added up for ever, the first use stays, the cooldown runs from the last one."""
    last = F.max(F.struct("last_used_at", "last_matched"))
    rows = log.groupBy(*KEYS).agg(F.sum("use_count").alias("use_count"), F.min("first_used_at").alias("first_used_at"), last.alias("_last"))
    pool = rows.select(*KEYS, "use_count", "first_used_at", F.col("_last.last_used_at").alias("last_used_at"),
                       cooldown_end(F.col("_last.last_used_at")).alias("next_reusable_at"), F.col("_last.last_matched").alias("last_matched"))
    if now is None:
        return pool
    return pool.withColumn("status", F.when(F.col("next_reusable_at") > now, "cooldown").otherwise("reusable"))


OPEN = "category string, url string, first bigint, last bigint, told boolean, mark bigint"


def _spans(points: DataFrame) -> DataFrame:
    """Cooldowns out of first and last uses, in microseconds: what begins before another one ends lengthens it."""
    by_key = Window.partitionBy(*KEYS).orderBy("first", "last")
    reach = F.max("last").over(by_key.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("first") > reach + _COOLDOWN_US, 1).otherwise(0)).over(by_key.rowsBetween(Window.unboundedPreceding, 0))
    marked = points.withColumn("_reach", reach).withColumn("_island", island)
    return marked.groupBy(*KEYS, "_island").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.max("told").alias("told")).drop("_island")


def record_events(uses: DataFrame, path: str, checkpoint: str, delay: str = "1 day") -> StreamingQuery:
    """Log of (category, url, status, at): an event at each start (``cooldown``) and end (``reusable``) of a cooldown.

    ``uses`` has (category, url, used_at, matched); uses without a time are left out. Uses in any order join and lengthen the cooldowns
    that are not over; these are a small table per batch beside the checkpoint, so a repeated batch finds what the one before it left. Uses may be
    late by ``delay``; an event is told once the newest use less the delay has passed it, when no use can change it any more, so the events
    don't depend on the batches. A use that comes later than that is left out. Totals come from :func:`pool_totals`.
    """
    held = f"{checkpoint}-open"
    seconds = " + ".join(f"extract({unit} FROM CAST(INTERVAL {delay} AS INTERVAL DAY TO SECOND)) * {n}" for unit, n in (("DAY", 86_400), ("HOUR", 3_600), ("MINUTE", 60), ("SECOND", 1)))
    late = F.expr(f"CAST(({seconds}) * 1000000 AS BIGINT)")

    def write(batch: DataFrame, number: int) -> None:
        spark, since = batch.sparkSession, scratch_count(batch.sparkSession)
        before = spark.read.schema(OPEN).parquet(f"{held}/{number - 1}") if number else spark.createDataFrame([], OPEN)
        # the mark goes with the table, as a row without a key
        old = before.where("mark IS NOT NULL").agg(F.max("mark").alias("mark")).first()["mark"]
        us = F.unix_micros("used_at")
        timed = batch.where("used_at IS NOT NULL")
        newest = timed.agg(F.max(us - late).alias("mark")).first()["mark"]
        mark = max((m for m in (old, newest) if m is not None), default=None)
        if old is not None:
            timed = timed.where(us > old)
        fresh = timed.groupBy(*KEYS, us.alias("first")).agg(F.lit(False).alias("told")).select(*KEYS, "first", F.col("first").alias("last"), "told")
        place = scratch_path(spark, "cooldowns")  # read twice
        _spans(fresh.unionByName(before.where("mark IS NULL").drop("mark"))).write.parquet(place)
        spans = spark.read.parquet(place)
        passed = lambda at: F.coalesce(at <= F.lit(mark).cast("long"), F.lit(False))
        end = F.col("last") + _COOLDOWN_US
        begun = F.when(~F.col("told") & passed(F.col("first")), F.struct(F.lit("cooldown").alias("status"), F.timestamp_micros("first").alias("at")))
        over = F.when(passed(end), F.struct(F.lit("reusable").alias("status"), F.timestamp_micros(end).alias("at")))
        events = spans.select(*KEYS, F.explode(F.array_compact(F.array(begun, over))).alias("_e")).select(*KEYS, "_e.status", "_e.at")
        batch_log(path)(events, number)
        left = spans.where(~passed(end)).select(*KEYS, "first", "last", (F.col("told") | passed(F.col("first"))).alias("told"), F.lit(None).cast("long").alias("mark"))
        note = spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in left.schema.fields[:-1]], F.lit(mark).cast("long").alias("mark"))
        left.unionByName(note).write.mode("overwrite").parquet(f"{held}/{number}")
        drop_scratch(spark, since, since + 1)

    return run_available(uses, checkpoint, write)
