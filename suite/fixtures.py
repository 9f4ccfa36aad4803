"""Catalog, order, URL, store, site and pool views over the given tables.

The SQL of every view runs unchanged in Spark and in DuckDB. ``{name}`` stands for a table or an
earlier view; in the oracle it becomes a CTE name.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

VIEWS: dict[str, str] = {
    "v_product": """
SELECT d.doc_id AS product_id,
       split_part(d.text, chr(10), 1) AS title,
       d.text AS description,
       CASE CAST(p.p_size AS BIGINT) % 4 WHEN 0 THEN p.p_type || ' > ' || p.p_brand
            WHEN 1 THEN lower(p.p_type) || 's' WHEN 2 THEN '' ELSE p.p_type END AS category,
       CASE WHEN d.doc_id % 17 = 0 THEN NULL WHEN d.doc_id % 13 = 0 THEN CAST(1.5 AS DOUBLE)
            WHEN d.doc_id % 11 = 0 THEN CAST(7000 AS DOUBLE) ELSE p.p_retailprice END AS discount_price,
       p.p_retailprice * 1.25 AS original_price,
       CASE WHEN d.doc_id % 19 = 0 THEN NULL
            WHEN d.doc_id % 9 = 0 THEN 'https://img.example/coming-soon.png'
            ELSE 'https://img.example/' || CAST(d.doc_id % 37 AS VARCHAR(20)) || '.jpg' END AS image,
       CASE d.doc_id % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'GBP' ELSE 'XXX' END AS currency,
       d.source AS domain, d.lang AS lang,
       d.source || '|||id|||' || CAST(d.doc_id AS VARCHAR(20)) AS unique_key
FROM {documents} d JOIN {part} p ON d.doc_id = p.p_partkey
""",
    "v_order": """
SELECT o.o_orderkey AS order_id,
       'site' || CAST(o.o_custkey % 50 AS VARCHAR(20)) || '.example' AS domain,
       n.n_name AS ip, o.o_orderdate AS order_time,
       CASE o.o_orderkey % 9 WHEN 0 THEN 'pending' WHEN 1 THEN 'processing' WHEN 2 THEN 'completed'
            WHEN 3 THEN 'completed' WHEN 4 THEN 'cancelled' WHEN 5 THEN 'failed' WHEN 6 THEN 'on-hold'
            WHEN 7 THEN 'refunded' ELSE 'trash' END AS order_status,
       o.o_totalprice AS order_amount, o.o_orderpriority AS order_category
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey
""",
    "v_url": """
SELECT page_id, url AS raw_url,
       CASE page_id % 3 WHEN 0 THEN 'unfiltered' WHEN 1 THEN 'filtered' ELSE 'crawled' END AS stage,
       'cat' || CAST(page_id % 5 AS VARCHAR(20)) AS category
FROM {pages}
""",
    "v_store": """
SELECT page_id AS store_id, url AS raw_url,
       lower(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS meta_text
FROM {pages}
""",
    "v_site": """
SELECT s_suppkey AS id, lower(replace(s_name, '#', '-')) || '.example' AS domain,
       CASE WHEN s_suppkey % 3 = 0 THEN 'reported' ELSE 'new' END AS report_status,
       CASE WHEN s_suppkey % 6 = 0 THEN 'built' ELSE '' END AS build_status,
       CASE WHEN s_suppkey % 4 = 0 THEN '1' ELSE '0' END AS schedule_enabled,
       CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE '2024-01-0' || CAST(1 + s_suppkey % 9 AS VARCHAR(20)) || ' 08:00:00' END AS schedule_time
FROM {supplier}
""",
    "v_reuse": """
SELECT 'https://u' || CAST(user_id AS VARCHAR(20)) || '.example' AS url, 'cat' || CAST(user_id % 5 AS VARCHAR(20)) AS category,
       CASE user_id % 4 WHEN 0 THEN 'new' WHEN 1 THEN 'queued' WHEN 2 THEN 'cooldown' ELSE 'disabled' END AS status,
       count(*) AS use_count, min(ts) AS first_used_at, max(ts) AS last_used_at
FROM {events} GROUP BY user_id
""",
    # messy category strings: every separator style, entities, numeric heads, junk and CJK-only paths
    "v_rawcat": """
SELECT p_partkey AS id,
       CASE p_partkey % 16
            WHEN 0 THEN p_type || ' > ' || p_brand || ' > ' || p_name
            WHEN 1 THEN '12 - 4 > ' || p_type || '/' || p_name
            WHEN 2 THEN p_type || ' &amp; ' || p_name
            WHEN 3 THEN 'Home | ' || p_type || ' | ' || p_brand
            WHEN 4 THEN '女装 > 连衣裙'
            WHEN 5 THEN ' n/a '
            WHEN 6 THEN lower(p_name) || 's'
            WHEN 7 THEN p_type || '->' || p_name || 'es'
            WHEN 8 THEN '12345'
            WHEN 9 THEN p_brand || '|||' || p_name || '|||x'
            WHEN 10 THEN 'all_' || p_type || ':' || p_name
            WHEN 11 THEN '  '
            WHEN 12 THEN p_type || ', ' || p_name || '; ' || p_brand
            WHEN 13 THEN 'Category > unknown > ' || p_name
            WHEN 14 THEN p_type || chr(9) || p_name || chr(10) || 'Children'
            ELSE 'Women ' || p_type || ' → ' || p_name || ' 裙子' END AS raw
FROM {part_spread}
""",
    "v_site_text": """
SELECT s_suppkey AS id,
       CASE s_suppkey % 7 WHEN 0 THEN '2024-03-05 10:20:30' WHEN 1 THEN '2024-03-05 10:2' || CAST(s_suppkey % 10 AS VARCHAR(20))
            WHEN 2 THEN '2024-0' || CAST(1 + s_suppkey % 9 AS VARCHAR(20)) || '-11T07:30:15' WHEN 3 THEN 'soon' WHEN 4 THEN ''
            WHEN 5 THEN ' 2024-01-0' || CAST(1 + s_suppkey % 9 AS VARCHAR(20)) || ' 08:00:00 ' ELSE '2024-13-45 08:00:00' END AS raw_time,
       CASE s_suppkey % 6 WHEN 0 THEN ' nan ' WHEN 1 THEN 'NaN' WHEN 2 THEN ' ' || s_name || ' ' WHEN 3 THEN 'yes'
            WHEN 4 THEN ' TRUE' ELSE '0' END AS raw_cell,
       ' Site_Name-(' || CAST(s_suppkey AS VARCHAR(20)) || ')' AS raw_header
FROM {supplier}
""",
}


def _template(sql: str) -> str:
    return re.sub(r"\{(\w+?)(_spread)?\}", r"\1", sql)


def with_views(sql: str) -> str:
    """Prefix the oracle SQL with the CTEs of the views it names."""
    needed = [name for name in VIEWS if re.search(rf"\b{name}\b", sql)]
    if not needed:
        return sql.strip()
    ctes = ",\n".join(f"{name} AS ({_template(VIEWS[name]).strip()})" for name in needed)
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


class Tables:
    """Lazy access to the parquet tables and the views as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def spread(self, name: str) -> DataFrame:
        """The table; one that is read in fewer splits than there are cores is dealt out to all cores.

        Text work is bound by the processor, and a single small file would keep one core busy.
        """
        df, cores = self.table(name), self.spark.sparkContext.defaultParallelism
        return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df

    def sql(self, sql: str) -> DataFrame:
        """Run SQL whose ``{name}`` placeholders are tables or views."""
        names = set(re.findall(r"\{(\w+)\}", sql))
        return self.spark.sql(sql, **{name: getattr(self, name) for name in names})

    def __getattr__(self, name: str) -> DataFrame:
        if name in ("documents", "pages"):
            return self.spread(name)
        if name in BASE_TABLES:
            return self.table(name)
        if name.endswith("_spread"):
            return self.spread(name.removesuffix("_spread"))
        if name in VIEWS:
            return self.sql(VIEWS[name])
        raise AttributeError(name)
