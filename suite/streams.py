"""Streams over files split from events and orders, compared with their final tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from merchloom.session import scratch_path
from merchloom.streaming import cooldown as C
from merchloom.streaming import ingest as I
from merchloom.streaming.buckets import KeyedTable
from suite import query


def _files(t, df, order: str, parts: int = 3):
    """The rows as ``parts`` sets of files in the order of a column; a trigger reads one file."""
    path = scratch_path(t.spark, "in")
    at = F.col(order).cast("timestamp").cast("double") if order in ("ts", "used_at", "order_time") else F.col(order)
    share = ", ".join(str((i + 1) / parts) for i in range(parts - 1))
    bounds = df.select(at.alias("v")).selectExpr(f"percentile_approx(v, array({share})) AS b").first()["b"]
    edges = [None, *bounds, None]
    # one write after the other: the stream reads files in the order of their times
    for low, high in zip(edges, edges[1:], strict=False):
        part = df if low is None else df.where(at > low)
        (part if high is None else part.where(at <= high)).write.mode("append").parquet(path)
    return I.read_files(t.spark, path, df.schema)


@query("stream_append_buffer", "SELECT event_id, event_type, value FROM events")
def _(t):
    rows = t.events.select("event_id", "event_type", "value")
    out = scratch_path(t.spark, "buffer")
    I.append_buffer(_files(t, rows, "event_id"), out, out + "-cp")
    return I.read_log(t.spark, out, rows.schema).drop(I.BATCH)


@query("stream_dedup_insert", """
SELECT DISTINCT user_id, event_type FROM events WHERE (user_id, event_type) NOT IN (SELECT (user_id, event_type) FROM events WHERE event_id % 60 = 7)
""".replace("(user_id, event_type) NOT IN (SELECT (user_id, event_type) FROM events WHERE event_id % 60 = 7)",
            "NOT EXISTS (SELECT 1 FROM events s WHERE s.event_id % 60 = 7 AND s.user_id = events.user_id AND s.event_type = events.event_type)"))
def _(t):
    rows = t.events.select("event_id", "user_id", "event_type")
    stored = t.events.where("event_id % 60 = 7").select("user_id", "event_type")
    out = scratch_path(t.spark, "dedup")
    table = KeyedTable(t.spark, out, rows.schema, ["user_id", "event_type"], buckets=8)
    I.insert_unseen(_files(t, rows, "event_id"), table, [F.col("event_id").desc()], out + "-cp", stored)
    return table.rows().select("user_id", "event_type")


_USES = """SELECT user_id, ts, event_type = 'click' AS matched FROM {events}
 UNION ALL SELECT user_id, ts + INTERVAL 65 DAY, event_type <> 'click' FROM {events} WHERE user_id % 3 = 0"""


@query("stream_cooldown", f"""
WITH e AS ({_USES.replace("{events}", "events")})
SELECT 'cat' || user_id % 5 AS category, 'https://u' || user_id || '.example' AS url, count(*) AS use_count, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_used_at, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_used_at,
       strftime(max(ts) + INTERVAL 30 DAY, '%Y-%m-%d %H:%M:%S') AS next_reusable_at, bool_or(matched) FILTER (ts = mx) AS last_matched,
       CASE WHEN max(ts) + INTERVAL 30 DAY > (SELECT max(ts) FROM events) + INTERVAL 10 DAY THEN 'cooldown' ELSE 'reusable' END AS status
FROM (SELECT *, max(ts) OVER (PARTITION BY user_id) AS mx FROM e) GROUP BY user_id
""")
def _(t):
    rows = t.sql(f"SELECT concat('cat', user_id % 5) AS category, concat('https://u', user_id, '.example') AS url, CAST(ts AS TIMESTAMP) AS used_at, matched FROM ({_USES})")
    out = scratch_path(t.spark, "cooldown")
    C.record_uses(_files(t, rows, "used_at"), out, out + "-cp")
    now = t.sql("SELECT CAST(max(ts) AS TIMESTAMP) + INTERVAL 10 DAY AS now FROM {events}").first()["now"]
    pool = C.pool_totals(t.spark.read.schema(f"{C.USES}, {I.BATCH} BIGINT").parquet(out), F.lit(now))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return pool.select("category", "url", "use_count", stamp("first_used_at"), stamp("last_used_at"), stamp("next_reusable_at"), "last_matched", "status")


@query("stream_cooldown_events", f"""
WITH e AS (SELECT 'cat' || user_id % 5 AS category, 'https://u' || user_id || '.example' AS url, ts FROM ({_USES.replace("{events}", "events")})),
s AS (SELECT *, CASE WHEN ts > lag(ts) OVER (PARTITION BY url ORDER BY ts) + INTERVAL 30 DAY THEN 1 ELSE 0 END AS fresh FROM e),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY url ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island FROM s),
spans AS (SELECT category, url, min(ts) AS first, max(ts) AS last FROM n GROUP BY category, url, island)
SELECT category, url, 'cooldown' AS status, strftime(first, '%Y-%m-%d %H:%M:%S') AS at FROM spans WHERE first <= (SELECT max(ts) - INTERVAL 60 DAY FROM e)
UNION ALL SELECT category, url, 'reusable', strftime(last + INTERVAL 30 DAY, '%Y-%m-%d %H:%M:%S') FROM spans
WHERE last + INTERVAL 30 DAY <= (SELECT max(ts) - INTERVAL 60 DAY FROM e)
""")
def _(t):
    rows = t.sql(f"SELECT concat('cat', user_id % 5) AS category, concat('https://u', user_id, '.example') AS url, CAST(ts AS TIMESTAMP) AS used_at, matched FROM ({_USES})")
    out = scratch_path(t.spark, "cooldown-events")
    # files of one part come in any order, so uses are late by what a part spans
    C.record_events(_files(t, rows, "used_at", 4), out, out + "-cp", "60 days")
    events = t.spark.read.schema(f"{C.OUTPUT}, {I.BATCH} BIGINT").parquet(out)
    return events.select("category", "url", "status", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("stream_orders_upsert", """
WITH u AS (SELECT o_custkey, o_orderstatus, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders) SELECT o_custkey, o_orderstatus, o_totalprice FROM u WHERE rn = 1
""")
def _(t):
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    out = scratch_path(t.spark, "upsert")
    # files of one part come in any order, so what comes later may be older
    table = KeyedTable(t.spark, out, rows.schema, ["o_custkey"], buckets=8, order=[F.col("o_orderkey").desc()])
    I.upsert_orders(_files(t, rows, "o_orderkey"), table, out + "-cp")
    return table.rows().drop("o_orderkey")


@query("stream_orders_daily", "SELECT strftime(o_orderdate, '%Y-%m-%d') AS d, count(*) AS cnt, round(sum(o_totalprice), 2) AS revenue FROM orders GROUP BY 1")
def _(t):
    rows = t.orders.select("o_orderkey", F.col("o_orderdate").alias("order_time"), F.col("o_totalprice").alias("order_amount"))
    out = scratch_path(t.spark, "daily")
    # files by key, so that every batch brings orders of days long past
    I.orders_daily(_files(t, rows, "o_orderkey"), out, out + "-cp")
    log = t.spark.read.schema(f"d STRING, cnt BIGINT, revenue DOUBLE, {I.BATCH} BIGINT").parquet(out)
    return I.daily_totals(log).withColumn("revenue", F.round("revenue", 2))


@query("stream_schedule_due", "SELECT id, domain FROM v_site WHERE schedule_enabled = '1' AND report_status <> 'reported' AND schedule_time <> '' AND schedule_time <= '2024-01-06 08:00:00'")
def _(t):
    out = scratch_path(t.spark, "due")
    now = F.lit("2024-01-06 08:00:00").cast("timestamp")
    sites = t.v_site
    I.due_rows(_files(t, sites, "id"), now, out, out + "-cp")
    return I.read_log(t.spark, out, sites.schema).select("id", "domain")
