"""Scans and flatteners."""

from __future__ import annotations

from pyspark.sql import functions as F

from merchloom.functions.text import normalize_text
from merchloom.operators import taxonomy
from merchloom.session import scratch_path
from merchloom.sources import readers as R
from suite import duck, query


@query("scan_jsonl", """
SELECT title, description, category, original_price, discount_price, unique_key FROM v_product
""")
def _(t):
    odd, even = F.col("product_id") % 2 == 1, F.col("product_id") % 2 == 0
    lines = t.v_product.select(
        F.when(odd, F.col("title")).alias("标题"), F.when(even, F.col("title")).alias("title"),
        F.when(odd, F.col("description")).alias("描述"), F.when(even, F.col("description")).alias("desc"),
        F.when(odd, F.col("category")).alias("分类"), F.when(even, F.col("category")).alias("category"),
        F.col("original_price").cast("string").alias("原价"),
        F.coalesce(F.col("discount_price").cast("string"), F.lit("")).alias("折扣价"), "unique_key")
    path = scratch_path(t.spark, "jsonl")
    lines.write.json(path)
    return R.read_products_jsonl(t.spark, path).select(
        "title", "description", "category", "original_price", "discount_price", "unique_key")


@query("scan_tabular_alias", """
SELECT lower(replace(s_name, '#', '-')) AS domain, CAST(s_acctbal AS VARCHAR) AS note FROM supplier WHERE s_suppkey % 10 <> 3
""")
def _(t):
    rows = t.sql("""SELECT CAST(s_acctbal AS STRING) AS `Free Text `, CASE WHEN s_suppkey % 10 = 3 THEN ' ' ELSE concat(' ', lower(replace(s_name, '#', '-'))) END AS ` Domain Name`
                    FROM {supplier}""")
    path = scratch_path(t.spark, "csv")
    rows.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return R.read_table_file(t.spark, path, {"domain": ("domain", "domain_name", "url"), "note": ("note", "free_text")}, "domain")


@query("scan_text_rows", """
SELECT s_name AS name, CAST(s_suppkey AS VARCHAR) AS code FROM supplier WHERE s_suppkey % 9 <> 4
""")
def _(t):
    lines = t.sql("""SELECT concat(CASE WHEN s_suppkey % 9 = 4 THEN ' ' ELSE s_name END, CASE s_suppkey % 3 WHEN 0 THEN '\\t' WHEN 1 THEN ',' ELSE '|' END,
                     ' ', s_suppkey) AS value FROM {supplier}""")
    return R.split_text_rows(lines, ["name", "code"])


@query("scan_url_lines", """
SELECT CASE WHEN page_id % 5 = 1 THEN 'https://' || split_part(url, '://', 2) WHEN page_id % 5 = 2 THEN url || '/collections/all' ELSE url END AS url,
       CASE WHEN page_id % 5 = 2 THEN 'collection' ELSE 'store' END AS kind
FROM pages WHERE page_id % 5 NOT IN (3, 4)
""")
def _(t):
    lines = t.sql("""SELECT CASE page_id % 5 WHEN 0 THEN concat('  ', url, ' ') WHEN 1 THEN split(url, '://')[1] WHEN 2 THEN concat(url, '/collections/all')
                     WHEN 3 THEN concat('# ', url) ELSE CASE WHEN page_id % 2 = 0 THEN '   ' ELSE 'no host' END END AS value FROM {pages}""")
    return R.classify_url_lines(lines)


# two products per document; the JSON text is built by Spark from the tables
_PAYLOADS = """
SELECT d.source AS store, CASE d.doc_id % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'GBP' ELSE 'XXX' END AS currency, 'misc' AS category,
  to_json(named_struct('products', array(
    named_struct('id', CAST(d.doc_id * 2 AS STRING), 'title', concat(' ', p.p_name, ' ', d.doc_id), 'handle', concat('h', d.doc_id), 'body_html', concat('<p>', d.text, '</p>'),
      'product_type', p.p_type, 'tags', concat(p.p_brand, ', , ', d.lang),
      'images', array(named_struct('src', concat('https://img.example/', d.doc_id, '.jpg?v=', p.p_size)), named_struct('src', '')),
      'variants', array(named_struct('sku', concat('S', d.doc_id), 'price', CAST(p.p_retailprice AS STRING), 'compare_at_price', CAST(p.p_retailprice * 2 AS STRING))),
      'options', array(named_struct('name', 'Title', 'values', array('x')), named_struct('name', 'Size', 'values', array('S', CAST(p.p_size AS STRING))))),
    named_struct('id', '', 'title', concat(p.p_name, ' alt'), 'handle', concat('alt', d.doc_id), 'body_html', CASE WHEN d.doc_id % 3 = 0 THEN ' ' ELSE d.lang END,
      'product_type', '', 'tags', to_json(array(p.p_brand, d.lang)), 'images', NULL, 'variants', NULL, 'options', NULL)))) AS payload
FROM {documents} d JOIN {part} p ON d.doc_id = p.p_partkey
"""


@query("malformed_payloads", "SELECT doc_id FROM documents WHERE doc_id % 9 = 4")
def _(t):
    captured = t.documents.selectExpr("doc_id", """CASE WHEN doc_id % 9 = 4 THEN concat('{"products": [{"title": "', left(text, 5)) ELSE '{"products": []}' END AS payload""")
    return R.malformed_payloads(captured, "payload").select("doc_id")


@query("flatten_catalog", """
WITH b AS (SELECT * FROM documents d JOIN part p ON d.doc_id = p.p_partkey)
SELECT 'https://' || source || '/products/h' || doc_id AS source_url, ' ' || p_name || ' ' || doc_id AS title, 'S' || doc_id AS sku, p_retailprice AS price,
       p_retailprice * 2 AS compare_at_price, '<p>' || text || '</p>' AS body_html, p_brand || '|' || lang AS tags,
       'https://img.example/' || doc_id || '.jpg?v=' || p_size AS images, p_type AS product_type FROM b
UNION ALL
SELECT 'https://' || source || '/products/alt' || doc_id, p_name || ' alt', '', 0.0, NULL, CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE lang END, p_brand || '|' || lang, '', '' FROM b
""")
def _(t):
    flat = R.flatten_catalog(t.sql(_PAYLOADS), "store", "payload")
    return flat.withColumn("tags", F.array_join("tags", "|")).withColumn("images", F.array_join("images", "|")).drop("handle")


_RATES = "SELECT * FROM (VALUES ('usd ', 1.0), ('EUR', 1.25), ('GBP', 1.5)) AS r(code, rate)"


@query("flatten_catalog_localized", f"""
WITH b AS (SELECT *, CASE doc_id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 1.25 ELSE 1.5 END AS rate FROM documents d JOIN part p ON d.doc_id = p.p_partkey WHERE doc_id % 4 <> 3)
SELECT CAST(doc_id * 2 AS VARCHAR) AS product_id, 'S' || doc_id AS sku, p_name || ' ' || doc_id AS title, '<p>' || text || '</p>' AS description,
       'https://img.example/' || doc_id || '.jpg' AS image, floor(p_retailprice * 2 * rate * 10 + 0.5) / 10 AS original_price, floor(p_retailprice * rate * 10 + 0.5) / 10 AS discount_price,
       'Size^S#' || p_size AS variant, p_type AS category, source || '|||id|||' || doc_id * 2 AS unique_key FROM b
""")
def _(t):
    rates = R.clean_rates(t.sql(_RATES).withColumn("rate", F.col("rate").cast("double")))
    rows = R.flatten_catalog_localized(t.sql(_PAYLOADS), "store", "payload", "currency", rates, "category")
    tenth = lambda c: (F.floor(F.col(c) * 10 + 0.5) / 10).alias(c)
    return rows.select("product_id", "sku", "title", "description", "image", tenth("original_price"), tenth("discount_price"),
                       "variant", "category", "unique_key")


@query("scan_taxonomy", """
WITH n AS (SELECT unnest([lower(p_type), lower(p_brand), lower(p_name)]) AS node, p_partkey FROM part WHERE p_partkey % 8 <> 0)
SELECT DISTINCT node FROM n
""")
def _(t):
    lines = t.sql("""SELECT concat(CASE p_partkey % 8 WHEN 0 THEN '# ' WHEN 1 THEN '12 - ' ELSE ' ' END, p_type, ' > ', p_brand, '>', p_name, ' ') AS value FROM {part}
                     UNION ALL SELECT ' ' FROM {region}""")
    return taxonomy.flatten_taxonomy(lines)


# depths one to five by part number, and one tree in 31 that is no JSON
_TREES = """
SELECT p_partkey, CASE WHEN p_partkey % 31 = 0 THEN concat(chr(123), p_name)
       WHEN p_partkey % 5 = 0 THEN to_json(map(p_type, map(p_brand, array(p_name, upper(p_name)))))
       WHEN p_partkey % 5 = 1 THEN to_json(map(p_type, map(p_brand, map(concat('Size ', p_size), array(p_name)))))
       WHEN p_partkey % 5 = 2 THEN to_json(map(p_type, array(p_name)))
       WHEN p_partkey % 5 = 3 THEN to_json(map(p_type, map(p_brand, map(concat('Size ', p_size), map('Deep', array(p_name))))))
       ELSE to_json(map(p_type, map(p_brand, map(concat('Size ', p_size), map('Deep', map('Deeper', p_name)))))) END AS tree FROM {part}
"""
_TREE_ROWS = """
SELECT p_partkey, p_type AS level1, CASE WHEN p_partkey % 5 <> 2 THEN p_brand END AS level2,
       CASE p_partkey % 5 WHEN 1 THEN 'Size ' || p_size WHEN 3 THEN 'Size ' || p_size || '|||Deep' WHEN 4 THEN 'Size ' || p_size || '|||Deep|||Deeper' END AS level3, p_name AS keyword
FROM part WHERE p_partkey % 31 <> 0
UNION ALL SELECT p_partkey, p_type, p_brand, NULL, upper(p_name) FROM part WHERE p_partkey % 5 = 0 AND p_partkey % 31 <> 0
"""


@query("flatten_keyword_tree", _TREE_ROWS)
def _(t):
    return R.flatten_keyword_tree(t.sql(_TREES), "tree", ["p_partkey"]).drop("path")


@query("malformed_trees", "SELECT p_partkey FROM part WHERE p_partkey % 31 = 0")
def _(t):
    return R.malformed_trees(t.sql(_TREES), "tree").select("p_partkey")


@query("tree_phrases", f"""
SELECT DISTINCT lower(x) AS phrase FROM (SELECT unnest([level1, replace(level2, '#', ' '), keyword] || string_split(coalesce(level3, level1), '|||')) AS x FROM ({_TREE_ROWS})) WHERE x IS NOT NULL
""")
def _(t):
    return R.tree_phrases(R.flatten_keyword_tree(t.sql(_TREES), "tree"))


@query("scan_rates", """
SELECT 'C' || n_nationkey AS code, max(n_nationkey * 0.25 + 1) AS rate FROM nation GROUP BY 1
""")
def _(t):
    rows = t.sql("""SELECT concat(' c', n_nationkey) AS nation, max(n_nationkey * CAST(0.25 AS DOUBLE) + 1) AS exchange_rate_usd FROM {nation} GROUP BY 1""")
    path = scratch_path(t.spark, "rates")
    rows.write.json(path)
    listed = t.spark.read.schema("nation STRING, exchange_rate_usd DOUBLE").json(path)
    mapped = listed.where("exchange_rate_usd >= 4").select(F.to_json(F.create_map("nation", "exchange_rate_usd")).alias("m"))
    plain = listed.where("exchange_rate_usd < 4").select(F.col("nation").alias("code"), F.col("exchange_rate_usd").alias("rate"))
    return R.clean_rates(plain).unionByName(R.rates_from_map(mapped, "m"))


@query("scan_rate_list", "SELECT 'N' || n_nationkey AS code, n_nationkey * 0.5 + 1 AS rate FROM nation WHERE n_nationkey % 5 <> 4")
def _(t):
    rows = t.sql("SELECT concat(' n', n_nationkey) AS nation, IF(n_nationkey % 5 = 4, NULL, n_nationkey * CAST(0.5 AS DOUBLE) + 1) AS exchange_rate_usd FROM {nation}")
    # one document with a list over several lines, as the table is stored; it has a row per currency
    listed = rows.agg(F.replace(F.to_json(F.collect_list(F.struct("nation", "exchange_rate_usd"))), F.lit("},"), F.lit("},\n")).alias("value"))
    path = scratch_path(t.spark, "rate-list")
    listed.write.text(path)
    return R.read_rates(t.spark, path)


@query("unknown_currency", "SELECT product_id FROM v_product WHERE currency NOT IN ('USD', 'EUR', 'GBP')")
def _(t):
    return R.unknown_currency(t.v_product.select("product_id", "currency"), "currency", t.spark.sql(_RATES)).select("product_id")


@query("scan_partitions", """
SELECT event_id, event_type, value FROM events WHERE event_type = 'click'
""")
def _(t):
    path = scratch_path(t.spark, "events")
    t.events.select("event_id", "value", "event_type").write.partitionBy("event_type").parquet(path)
    return R.scoped(t.spark.read.parquet(path), "event_type", "click").select("event_id", "event_type", "value")


@query("scan_jdbc_sites", """
SELECT id, domain, CASE WHEN id % 4 = 0 THEN 'new' ELSE report_status END AS report_status, build_status, schedule_time FROM v_site
""")
def _(t):
    holes = t.v_site.select(
        "id", "domain", F.when(F.col("id") % 4 != 0, F.col("report_status")).alias("report_status"),
        F.expr("nullif(build_status, '')").alias("build_status"), F.expr("nullif(schedule_time, '')").alias("schedule_time"))
    return R.normalize_sites(holes)


@query("scan_pages", "SELECT page_id, url, length(html) AS html_chars FROM pages")
def _(t):
    return R.read_pages(t.spark, f"{t.sf_dir}/pages.parquet").select("page_id", "url", F.length("html").alias("html_chars"))
