"""Export frames, moves, inserts and upserts."""

from __future__ import annotations

from pyspark.sql import functions as F

from merchloom.operators import keyed as Y
from merchloom.session import scratch_path
from merchloom.sources import sinks as K
from suite import duck, query

S = duck.strip


def _cell(value: str) -> str:
    """A cell without control characters, cut to what a sheet holds."""
    clean = rf"regexp_replace({value}, '[\x00-\x1F\x7F]+', '', 'g')"
    return f"substring({clean}, 1, 32760) || CASE WHEN length({clean}) > 32760 THEN '...(truncated)' ELSE '' END"


@query("export_columns", f"""
SELECT '' AS sku, {_cell(S('title'))} AS title, {_cell(S('description'))} AS description, '' AS sub_description, {_cell("coalesce(image, '')")} AS image,
       '' AS variant_name, '' AS variant_value, {_cell("trim(category)")} AS category, {_cell("lang || ', ' || domain")} AS tags, CAST(product_id AS VARCHAR) AS product_id FROM v_product
""")
def _(t):
    rows = t.v_product.withColumn("tags", F.array("lang", F.lit(" "), "domain"))
    return K.export_columns(rows.select("category", "title", "description", "image", "tags", "product_id")).drop("original_price", "discount_price")


@query("split_by_category", """
SELECT product_id, c AS category FROM (SELECT product_id, unnest(CASE WHEN category = '' THEN ['unmatched'] WHEN product_id % 5 = 0 THEN [lower(split_part(category, ' > ', 1)), 'fifth'] ELSE [lower(split_part(category, ' > ', 1))] END) AS c FROM v_product)
""")
def _(t):
    first = F.lower(F.substring_index("category", " > ", 1))
    categories = F.when(F.col("category") == "", F.array().cast("array<string>")).when(F.col("product_id") % 5 == 0, F.array(first, F.lit("fifth"))).otherwise(F.array(first))
    path = scratch_path(t.spark, "split")
    K.write_split(K.split_by_category(t.v_product.select("product_id", "category"), categories).drop("category"), "category_out", path)
    return t.spark.read.parquet(path).select("product_id", F.col("category_out").alias("category"))


@query("move_with_backup", """
SELECT product_id, CASE WHEN image IS NULL OR image LIKE '%coming-soon%' THEN 'moved' ELSE 'kept' END AS half, CASE WHEN image IS NULL OR image LIKE '%coming-soon%' THEN 'bad_image' END AS reason FROM v_product
""")
def _(t):
    from merchloom.operators.rules import bad_image
    marked = K.with_verdict(t.v_product, bad_image("image"), F.lit("bad_image"), "catalog_raw", F.current_timestamp())
    kept, moved = K.move_with_backup(marked, scratch_path(t.spark, "move"))
    return kept.select("product_id", F.lit("kept").alias("half"), F.lit(None).cast("string").alias("reason")).unionByName(
        moved.select("product_id", F.lit("moved").alias("half"), F.col("move_reason").alias("reason")))


@query("insert_if_absent", """
WITH b AS (SELECT event_id, CASE WHEN event_id % 40 <> 0 THEN user_id * 10 + event_id % 5 END AS k, ts FROM events WHERE event_id % 2 = 0), s AS (SELECT DISTINCT user_id * 10 + event_id % 5 AS k FROM events WHERE event_id % 22 = 1)
SELECT event_id, k FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ts DESC, event_id DESC) AS rn FROM b WHERE k IS NOT NULL) WHERE rn = 1 AND k NOT IN (SELECT k FROM s)
UNION ALL SELECT event_id, k FROM b WHERE k IS NULL
""")
def _(t):
    key = F.col("user_id") * 10 + F.col("event_id") % 5
    batch = t.events.where("event_id % 2 = 0").select("event_id", F.when(F.col("event_id") % 40 != 0, key).alias("k"), "ts")
    stored = t.events.where("event_id % 22 = 1").select(key.alias("k"))
    return Y.insertable(batch, stored, ["k"], [F.col("ts").desc(), F.col("event_id").desc()]).select("event_id", "k")


_UPSERT = """
WITH old AS (SELECT o_orderkey, o_orderstatus, o_totalprice, 'then' AS created_at, 'then' AS updated_at FROM orders WHERE o_orderkey % 3 <> 0),
     new AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN o_orderstatus ELSE 'X' END AS o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 2 = 0)
SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, coalesce(n.o_orderstatus, o.o_orderstatus) AS o_orderstatus,
       CASE WHEN o.o_orderkey IS NULL THEN 'now' ELSE 'then' END AS created_at,
       CASE WHEN o.o_orderkey IS NULL OR (n.o_orderstatus IS NOT NULL AND n.o_orderstatus <> o.o_orderstatus) THEN 'now' ELSE 'then' END AS updated_at,
       CASE WHEN o.o_orderkey IS NULL THEN 'new' WHEN n.o_orderkey IS NULL THEN 'kept' WHEN n.o_orderstatus IS NOT NULL AND n.o_orderstatus <> o.o_orderstatus THEN 'updated' ELSE 'unchanged' END AS change
FROM old o FULL JOIN new n ON o.o_orderkey = n.o_orderkey
"""


def _upserted(t):
    old = t.orders.where("o_orderkey % 3 <> 0").select("o_orderkey", "o_orderstatus", "o_totalprice", F.lit("then").alias("created_at"), F.lit("then").alias("updated_at"))
    status = F.when(F.col("o_orderkey") % 5 == 0, None).when(F.col("o_orderkey") % 5 == 1, F.col("o_orderstatus")).otherwise("X")
    new = t.orders.where("o_orderkey % 2 = 0").select("o_orderkey", status.alias("o_orderstatus"), "o_totalprice")
    return Y.upsert(old, new, ["o_orderkey"], F.lit("now"))


@query("upsert_by_key", _UPSERT)
def _(t):
    root = scratch_path(t.spark, "upsert")
    K.replace_table(_upserted(t), root, 1)
    return K.current_table(t.spark, root).drop("o_totalprice")


@query("append_merge_keep_last", """
WITH a AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN upper('u' || user_id) ELSE 'u' || user_id END AS domain, CASE WHEN event_id % 4 <> 0 THEN ts END AS ts, event_id % 2 AS turn FROM events)
SELECT event_id, domain, ts FROM (SELECT *, row_number() OVER (PARTITION BY lower(domain) ORDER BY turn DESC, event_id DESC) AS rn FROM a) WHERE rn = 1 ORDER BY ts NULLS LAST, event_id
""")
def _(t):
    rows = t.sql("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN upper(concat('u', user_id)) ELSE concat('u', user_id) END AS domain, CASE WHEN event_id % 4 <> 0 THEN ts END AS ts FROM {events}")
    return Y.merge_keep_last(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1"), "domain", "ts", "event_id")


@query("export_distinct_lines", "SELECT DISTINCT rtrim(raw_url, '/') AS value FROM v_url ORDER BY 1")
def _(t):
    path = scratch_path(t.spark, "lines")
    K.write_lines(t.v_url, "raw_url", path)
    return t.spark.read.text(path)


@query("copy_table", "SELECT c_name, c_acctbal FROM customer UNION ALL SELECT c_name, c_acctbal FROM customer WHERE c_custkey % 2 = 0")
def _(t):
    path = scratch_path(t.spark, "copy")
    rows = t.customer.select("c_custkey", "c_name", "c_acctbal")
    K.copy_table(rows, path, drop=["c_custkey"])
    K.copy_table(rows.where("c_custkey % 2 = 0"), path, drop=["c_custkey"], clear=False)
    return t.spark.read.parquet(path)


_MAP = "SELECT * FROM (VALUES ('PROMO', 'deals'), ('SMALL', 'LARGE'), ('NONE', 'x')) AS m(source, target)"


@query("rename_category", f"""
WITH m AS ({_MAP}), plan AS (SELECT source, target, count(*) AS rows, CASE WHEN target IN (SELECT p_type FROM part) THEN 'skip' ELSE 'rename' END AS action FROM part JOIN m ON p_type = source GROUP BY source, target)
SELECT p_partkey, coalesce(target, p_type) AS p_type, CASE WHEN target IS NOT NULL THEN replace('from ' || p_type, p_type, target) ELSE 'from ' || p_type END AS origin,
       (SELECT string_agg(source || '>' || target || ':' || rows || ':' || action, ',' ORDER BY source) FROM plan) AS plan
FROM part LEFT JOIN plan ON source = p_type AND action = 'rename'
""")
def _(t):
    parts = t.part.select("p_partkey", "p_type", F.concat(F.lit("from "), "p_type").alias("origin"))
    plan = Y.rename_categories(parts, t.spark.sql(_MAP), "p_type", parts.select(F.col("p_type").alias("category")).distinct())
    shown = F.concat("source", F.lit(">"), "target", F.lit(":"), "rows", F.lit(":"), "action")
    listing = plan.agg(F.array_join(F.array_sort(F.collect_list(shown)), ",").alias("plan")).first()["plan"]
    return Y.apply_rename(parts, plan, "p_type", "origin").withColumn("plan", F.lit(listing))


@query("bulk_update_by_ids", """
SELECT id, CASE WHEN id % 6 = 1 THEN 'built' ELSE build_status END AS build_status, CASE WHEN id % 6 = 1 THEN '2024-02-01 00:00:00' ELSE schedule_time END AS schedule_time FROM v_site
""")
def _(t):
    sites = t.v_site.select("id", "build_status", "schedule_time")
    return Y.update_by_ids(sites, sites.where("id % 6 = 1"), "id", {"build_status": F.lit("built"), "schedule_time": F.lit("2024-02-01 00:00:00")})


@query("bulk_delete_by_ids", "SELECT id, domain, (SELECT count(*) FROM v_site WHERE id % 7 = 2) AS deleted FROM v_site WHERE id % 7 <> 2")
def _(t):
    left, deleted = Y.delete_by_ids(t.v_site.select("id", "domain"), t.v_site.where("id % 7 = 2"), "id")
    return left.withColumn("deleted", F.lit(deleted.first()["deleted"]))


@query("export_csv", """SELECT s_suppkey AS "Id", s_name || '"x", y' AS "Site name" FROM supplier""")
def _(t):
    path = scratch_path(t.spark, "csv")
    K.write_csv(t.supplier.select("s_suppkey", F.concat("s_name", F.lit('"x", y')).alias("s_name")), path, {"s_suppkey": "Id", "s_name": "Site name"})
    return t.spark.read.option("header", True).option("escape", '"').schema("`Id` BIGINT, `Site name` STRING").csv(path)


@query("upsert_full_outer", "WITH u AS (" + _UPSERT.strip() + ") SELECT change, count(*) AS rows FROM u GROUP BY 1")
def _(t):
    return _upserted(t).groupBy("change").agg(F.count(F.lit(1)).alias("rows"))


@query("import_outcome", "WITH u AS (" + _UPSERT.strip() + ") SELECT count(*) FILTER (change = 'new') AS created, count(*) FILTER (change = 'updated') AS updated, count(*) FILTER (change = 'unchanged') AS skipped FROM u")
def _(t):
    return Y.import_outcome(_upserted(t))
