"""Streaming ingestion: idempotent batch logs, keyed inserts and upserts, daily totals, due rows.

Every sink writes one folder per micro-batch and replaces that folder when the batch is repeated, so
a restart never doubles rows. Tables keyed by something are kept in buckets of their key; see :mod:`merchloom.streaming.buckets`.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from merchloom.functions.dates import day_text
from merchloom.operators.sites import schedule_due
from merchloom.streaming.buckets import KeyedTable

BATCH = "batch_id"


def read_files(spark: SparkSession, path: str, schema, per_trigger: int = 1) -> DataFrame:
    """Stream of parquet files in the order of their times."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def run_available(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Process everything that is there in micro-batches and stop."""
    query = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).foreachBatch(write).start()
    )
    query.awaitTermination()
    return query


def batch_log(path: str) -> Callable[[DataFrame, int], None]:
    """Writer of one folder per batch; repeating a batch replaces its folder."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{BATCH}={number}")

    return write


def read_log(spark: SparkSession, path: str, schema) -> DataFrame:
    """All batches of a log with their number."""
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields if f.name != BATCH)
    return spark.read.schema(f"{ddl}, {BATCH} BIGINT").parquet(path)


def append_buffer(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append every row once."""
    return run_available(stream, checkpoint, batch_log(path))


def insert_unseen(stream: DataFrame, table: KeyedTable, last_first: Sequence[Column], checkpoint: str, known: DataFrame | None = None) -> StreamingQuery:
    """Insert rows whose key was not seen before, in the table or in ``known``.

    Of several rows of a key in one batch the last counts, that is the first in ``last_first``; rows without a key are skipped.
    The table itself is the memory: a key that returns after any time is found, and no state grows beside it.
    """
    return run_available(stream, checkpoint, lambda batch, number: table.insert_absent(batch, number, last_first, known))


def upsert_orders(stream: DataFrame, table: KeyedTable, checkpoint: str) -> StreamingQuery:
    """Keep the newest row per key, the first in the table's ``order``; rows may come in any order and in any batch."""
    return run_available(stream, checkpoint, lambda batch, number: table.put(batch, number, table.order))


def orders_daily(stream: DataFrame, path: str, checkpoint: str, time: str = "order_time", amount: str = "order_amount") -> StreamingQuery:
    """Count and revenue per day and batch; :func:`daily_totals` adds them up. No order is too late to count."""
    def write(batch: DataFrame, number: int) -> None:
        days = batch.groupBy(day_text(F.col(time)).alias("d")).agg(F.count(F.lit(1)).alias("cnt"), F.sum(amount).alias("revenue"))
        batch_log(path)(days, number)

    return run_available(stream, checkpoint, write)


def daily_totals(log: DataFrame) -> DataFrame:
    return log.groupBy("d").agg(F.sum("cnt").alias("cnt"), F.sum("revenue").alias("revenue"))


def due_rows(stream: DataFrame, now: Column, path: str, checkpoint: str) -> StreamingQuery:
    """Scheduled rows whose time has come, once per trigger."""
    return run_available(schedule_due(stream, now), checkpoint, batch_log(path))
