"""Site registry, URL pool and layer statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from merchloom.operators import dedup as U
from merchloom.operators import keyed as Y
from merchloom.operators import ranking as K
from merchloom.operators import sites as S
from merchloom.plans import reuse as P
from suite import query


@query("site_funnel", """
SELECT count(*) AS total, count(*) FILTER (report_status = 'new') AS local, count(*) FILTER (report_status = 'reported') AS reported,
       count(*) FILTER (schedule_enabled = '1') AS scheduled, count(*) FILTER (build_status = 'built') AS built FROM v_site
""")
def _(t):
    return S.funnel(t.v_site, {"local": F.col("report_status") == "new", "reported": F.col("report_status") == "reported",
                               "scheduled": F.col("schedule_enabled") == "1", "built": F.col("build_status") == "built"})


@query("built_funnel", """
SELECT build_status, count(*) AS total, count(*) FILTER (id % 2 = 0) AS main_done, count(*) FILTER (id % 5 = 0) AS extra_done, count(*) FILTER (schedule_time <> '') AS timed FROM v_site GROUP BY 1
""")
def _(t):
    return S.funnel(t.v_site, {"main_done": F.col("id") % 2 == 0, "extra_done": F.col("id") % 5 == 0, "timed": F.col("schedule_time") != ""}, "build_status")


_NOW = "timestamp '2024-01-05 12:00:00'"


@query("reuse_eligible", f"""
SELECT url, category FROM v_reuse WHERE status NOT IN ('disabled', 'deleted') AND NOT last_used_at + INTERVAL 30 DAY > timestamp '2024-03-20 00:00:00' AND use_count < 68
""")
def _(t):
    pool = P.pool_from_usage(t.v_reuse)
    now = F.lit("2024-03-20 00:00:00").cast("timestamp_ntz")
    return pool.where(P.eligible(now, max_use=68)).select("url", "category")


@query("reuse_pool_summary", """
SELECT category, count(*) AS total, count(*) FILTER (status = 'queued') AS queued, count(*) FILTER (status = 'cooldown') AS cooldown, count(*) FILTER (status = 'new') AS new,
       count(*) FILTER (use_count % 2 = 0) AS matched, count(*) FILTER (use_count % 2 = 1) AS unmatched,
       count(*) FILTER (status <> 'disabled' AND NOT last_used_at + INTERVAL 30 DAY > timestamp '2024-03-20 00:00:00') AS reusable FROM v_reuse GROUP BY 1
""")
def _(t):
    pool = P.pool_from_usage(t.v_reuse.withColumn("last_matched", F.col("use_count") % 2 == 0))
    return P.pool_summary(pool, F.lit("2024-03-20 00:00:00").cast("timestamp_ntz"))


@query("reuse_release_limit", """
WITH e AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY last_used_at, url) AS rn FROM v_reuse WHERE status <> 'disabled')
SELECT category, url FROM e WHERE rn <= 3
""")
def _(t):
    pool = P.pool_from_usage(t.v_reuse).withColumn("updated_at", F.col("last_used_at"))
    released = P.release_limit(pool.where("status <> 'disabled'"), 3)
    return released.select("category", "url")


@query("schedule_due", "SELECT id, domain FROM v_site WHERE schedule_enabled = '1' AND report_status <> 'reported' AND schedule_time <> '' AND schedule_time <= '2024-01-06 08:00:00'")
def _(t):
    return S.schedule_due(t.v_site, F.lit("2024-01-06 08:00:00").cast("timestamp")).select("id", "domain")


@query("pending_work", """
WITH s AS (SELECT CASE WHEN build_status = 'built' AND id % 4 <> 0 AND id % 5 <> 0 THEN 'built_both_missing' WHEN build_status = 'built' AND id % 4 <> 0 THEN 'built_main_missing'
      WHEN build_status = 'built' AND id % 5 <> 0 THEN 'built_extra_missing' WHEN report_status <> 'reported' THEN 'local'
      WHEN id % 2 = 1 AND build_status <> 'built' THEN 'reported_resolved' ELSE '' END AS stage FROM v_site)
SELECT stage, count(*) AS n FROM s WHERE stage <> '' GROUP BY 1
""")
def _(t):
    stage = S.pending_stage(F.col("report_status") == "reported", F.col("id") % 2 == 1, F.col("build_status") == "built", F.col("id") % 4 == 0, F.col("id") % 5 == 0)
    return t.v_site.select(stage.alias("stage")).where("stage <> ''").groupBy("stage").agg(F.count(F.lit(1)).alias("n"))


@query("completeness_order", """
SELECT id, CAST(id % 2 = 0 AS INT) + CAST(id % 3 = 0 AS INT) + CAST(schedule_time <> '' AS INT) AS done FROM v_site WHERE build_status = 'built' ORDER BY 2, 1
""")
def _(t):
    done = S.completeness({"main": F.col("id") % 2 == 0, "extra": F.col("id") % 3 == 0, "timed": F.col("schedule_time") != ""})
    return t.v_site.where("build_status = 'built'").select("id", done.alias("done")).orderBy("done", "id")


@query("import_consolidate", """
WITH d AS (SELECT s_suppkey AS id, 'd' || s_suppkey % 40 AS domain FROM supplier)
SELECT id, domain, CASE WHEN id = max(id) OVER (PARTITION BY domain) THEN 'update' ELSE 'delete' END AS action FROM d
""")
def _(t):
    return S.consolidate_duplicates(t.sql("SELECT s_suppkey AS id, concat('d', s_suppkey % 40) AS domain FROM {supplier}")).select("id", "domain", "action")


@query("number_from_max", """
WITH m AS (SELECT max(s_suppkey) AS top FROM supplier)
SELECT c_custkey, top + row_number() OVER (ORDER BY c_name DESC, c_custkey) AS site_id FROM customer, m
""")
def _(t):
    top = t.supplier.agg(F.max("s_suppkey").alias("top")).first()["top"]
    new = t.customer.select("c_custkey", "c_name")
    return K.numbered(new, [F.col("c_name").desc(), F.col("c_custkey")], "site_id", top + 1).select("c_custkey", "site_id")


@query("distinct_sorted", "SELECT DISTINCT n_name AS ip FROM nation JOIN customer ON c_nationkey = n_nationkey ORDER BY 1")
def _(t):
    return t.v_order.select(F.col("ip")).where("trim(ip) <> ''").unionByName(
        t.sql("SELECT n_name AS ip FROM {nation} JOIN {customer} ON c_nationkey = n_nationkey")).distinct().orderBy("ip")


@query("max_id", "SELECT max(c_custkey) + 1 AS next_id FROM customer")
def _(t):
    return t.customer.agg((F.max("c_custkey") + 1).alias("next_id"))


@query("layer_stats", """
SELECT coalesce(lang, 'TOTAL') AS category, count(*) FILTER (quality IS NULL) AS raw, count(quality) AS clean FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ROLLUP (lang)
""")
def _(t):
    layered = t.documents.select("doc_id", "lang").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    counts = layered.rollup("lang").agg(F.count_if(F.col("quality").isNull()).alias("raw"), F.count("quality").alias("clean"))
    return counts.select(F.coalesce("lang", F.lit("TOTAL")).alias("category"), "raw", "clean")


@query("status_refresh", """
WITH f AS (SELECT id, domain, 'R' || id AS rid, CASE id % 4 WHEN 0 THEN '3' WHEN 1 THEN '4' ELSE '2' END AS st FROM v_site WHERE id % 2 = 0 OR id % 9 = 0),
     s AS (SELECT id, domain, report_status, build_status, CASE WHEN id % 8 = 0 THEN '3' ELSE '1' END AS ds FROM v_site)
SELECT s.id, coalesce(CASE WHEN report_status = 'reported' THEN rid END, '') AS report_id, CASE WHEN rid IS NOT NULL AND report_status = 'reported' THEN st ELSE ds END AS domain_status,
       CASE WHEN rid IS NOT NULL AND report_status = 'reported' AND st = '3' AND ds <> '3' THEN 'NOW' ELSE '' END AS resolved_time,
       CASE WHEN rid IS NOT NULL AND report_status = 'reported' AND st = '4' THEN 'built' ELSE build_status END AS build_status,
       CASE WHEN s.id % 5 = 0 THEN 'earlier' WHEN rid IS NOT NULL AND report_status = 'reported' AND st = '4' THEN 'NOW' ELSE '' END AS build_time
FROM s LEFT JOIN f ON s.domain = f.domain
""")
def _(t):
    sites = t.v_site.select(
        "id", "domain", "report_status", "build_status", F.lit("").alias("report_id"), F.when(F.col("id") % 8 == 0, "3").otherwise("1").alias("domain_status"),
        *[F.lit("").alias(c) for c in ("resolved_time", "main_status", "extra_status", "main_time", "extra_time")],
        F.when(F.col("id") % 5 == 0, "earlier").otherwise("").alias("build_time"))
    fetched = t.v_site.where("id % 2 = 0 OR id % 9 = 0").select(
        F.upper("domain").alias("domain"), F.concat(F.lit("R"), "id").alias("report_id"),
        F.when(F.col("id") % 4 == 0, 3).when(F.col("id") % 4 == 1, 4).otherwise(2).alias("status"))
    return S.refresh_status(sites, fetched, F.lit("NOW")).select("id", "report_id", "domain_status", "resolved_time", "build_status", "build_time")


@query("reuse_insert_new", """
SELECT url, category, CASE WHEN use_count % 2 = 0 THEN status ELSE 'new' END AS status, CASE WHEN use_count % 2 = 0 THEN use_count ELSE 0 END AS use_count FROM v_reuse
""")
def _(t):
    pool = t.v_reuse.where("use_count % 2 = 0").withColumn("updated_at", F.col("last_used_at"))
    tasks = t.v_reuse.select("category", "url").union(t.v_reuse.select("category", "url"))
    return P.insert_new(pool, tasks, F.lit("2024-03-20 00:00:00").cast("timestamp_ntz")).select("url", "category", "status", "use_count")


@query("sync_servers", """
SELECT 'h' || s_suppkey || '.example' AS domain, CASE WHEN s_suppkey % 3 = 0 THEN 'old' ELSE '10.0.0.' || s_suppkey END AS ip, CASE WHEN s_suppkey % 2 = 0 THEN 'kept' END AS main_category,
       CASE WHEN s_suppkey % 2 = 1 THEN 'new' WHEN s_suppkey % 3 = 0 THEN 'unchanged' ELSE 'updated' END AS change FROM supplier WHERE NOT (s_suppkey % 3 = 0 AND s_suppkey % 2 = 1)
UNION ALL SELECT 'h' || s_suppkey || '.example', NULL, NULL, 'new' FROM supplier WHERE s_suppkey % 3 = 0 AND s_suppkey % 2 = 1
""")
def _(t):
    feed = t.sql("SELECT concat(' https://WWW.h', s_suppkey, '.example/') AS domain, IF(s_suppkey % 3 = 0, ' ', concat('10.0.0.', s_suppkey)) AS ip, CAST(NULL AS STRING) AS main_category FROM {supplier}")
    stored = t.sql("SELECT concat('h', s_suppkey, '.example') AS domain, 'old' AS ip, 'kept' AS main_category FROM {supplier} WHERE s_suppkey % 2 = 0")
    return Y.sync_servers(feed, stored, F.lit("now")).select("domain", "ip", "main_category", "change")


@query("reuse_cycle", """
WITH p AS (SELECT url, category, status, use_count, first_used_at, last_used_at FROM v_reuse),
     e AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY last_used_at, url) AS rn FROM p
           WHERE status NOT IN ('disabled', 'deleted') AND NOT last_used_at + INTERVAL 30 DAY > timestamp '2024-03-20 00:00:00'),
     r AS (SELECT url FROM e WHERE rn <= 4)
SELECT p.url, p.category, CASE WHEN r.url IS NOT NULL THEN 'cooldown' ELSE status END AS status, use_count + CASE WHEN r.url IS NOT NULL THEN 1 ELSE 0 END AS use_count,
       strftime(CASE WHEN r.url IS NOT NULL THEN timestamp '2024-03-20 00:00:00' ELSE last_used_at END, '%Y-%m-%d %H:%M:%S') AS last_used_at,
       strftime(CASE WHEN r.url IS NOT NULL THEN timestamp '2024-04-19 00:00:00' ELSE last_used_at + INTERVAL 30 DAY END, '%Y-%m-%d %H:%M:%S') AS next_reusable_at
FROM p LEFT JOIN r ON p.url = r.url
""")
def _(t):
    now = F.lit("2024-03-20 00:00:00").cast("timestamp_ntz")
    pool = P.pool_from_usage(t.v_reuse).withColumn("updated_at", F.col("last_used_at"))
    released = P.release(pool, now, per_category=4)
    consumed = P.consume(pool, released.select("category", "url").withColumn("matched", F.lit(True)), now)
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return consumed.select("url", "category", "status", "use_count", stamp("last_used_at"), stamp("next_reusable_at"))
