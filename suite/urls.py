"""URL, price, variant and key functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from merchloom.functions import urls as U
from suite import duck, query

_RAW_URL = """
SELECT page_id, CASE page_id % 6 WHEN 0 THEN ' ' || url || '/ ' WHEN 1 THEN regexp_replace(url, '^https?://', '')
       WHEN 2 THEN replace(url, '.example.', '.myshopify.') || '/' WHEN 3 THEN replace(url, '.example.com/', '.example.com:8080/')
       WHEN 4 THEN 'http://www.shop' || CAST(page_id AS VARCHAR(20)) || '.myshopify.com/collections/sale-' || CAST(page_id % 7 AS VARCHAR(20)) || '/x?y=1'
       ELSE url END AS raw
FROM {pages}
"""
_RAW = "raw AS (" + _RAW_URL.replace("{pages}", "pages") + ")"
_HOST = r"regexp_extract(raw, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"


@query("normalize_url", rf"""
WITH {_RAW},
 s AS (SELECT page_id, raw, CASE WHEN {duck.strip('raw')} = '' THEN '' WHEN regexp_matches({duck.strip('raw')}, '^https?://') THEN {duck.strip('raw')}
              ELSE 'https://' || {duck.strip('raw')} END AS full_url FROM raw),
 h AS (SELECT page_id, rtrim(full_url, '/') AS normalized,
              regexp_replace(lower(split_part(split_part(split_part(split_part(full_url, '://', 2), '/', 1), '?', 1), '#', 1)), '^www\.', '') AS host,
              split_part(full_url, '://', 1) AS scheme, {_HOST} AS netloc FROM s)
SELECT page_id, normalized, scheme || '://' || host AS base,
       CASE WHEN netloc = '' THEN '' ELSE 'https://' || regexp_replace(replace(netloc, '.myshopify.com', '.com'), '^www\.', '') END AS public_url,
       CASE WHEN contains(netloc, '.myshopify.com') THEN 'https://' || netloc END AS hosted_url
FROM h
""")
def _(t):
    return t.sql(_RAW_URL).select(
        "page_id", U.normalize_url("raw").alias("normalized"), U.base_url("raw").alias("base"),
        U.public_url("raw").alias("public_url"), U.hosted_url("raw").alias("hosted_url"))


@query("extract_domain", rf"""
WITH {_RAW}, h AS (SELECT page_id, raw, lower({_HOST}) AS host FROM raw)
SELECT page_id, regexp_replace(host, '^www\.', '') AS domain, split_part(regexp_replace(host, '^www\.', ''), ':', 1) AS no_port,
       array_to_string(string_split(split_part(host, ':', 1), '.')[-2:], '.') AS registrable,
       split_part(regexp_replace(trim(regexp_replace(lower({duck.strip('raw')}), 'https?://', ''), '/'), '^www\.', ''), '.', 1) AS label
FROM h
""")
def _(t):
    return t.sql(_RAW_URL).select(
        "page_id", U.extract_domain("raw").alias("domain"), U.extract_domain("raw", keep_port=False).alias("no_port"),
        U.registrable_domain(U.url_netloc("raw")).alias("registrable"), U.site_label("raw").alias("label"))


@query("collection_handle", rf"""
WITH {_RAW}
SELECT page_id, CASE WHEN contains(raw, '/collections/') THEN split_part(split_part(split_part(raw, '/collections/', 2), '/', 1), '?', 1) END AS handle FROM raw
""")
def _(t):
    return t.sql(_RAW_URL).select("page_id", U.collection_handle("raw").alias("handle"))


@query("parse_domain_list", r"""
WITH l AS (SELECT c.conv_id, c.turn, p.url AS a, q.url AS b FROM (SELECT *, conv_id % (SELECT count(*) FROM pages) AS one, (conv_id + turn) % (SELECT count(*) FROM pages) AS two FROM conversations) c
           JOIN pages p ON p.page_id = c.one JOIN pages q ON q.page_id = c.two),
 d AS (SELECT conv_id, turn, regexp_replace(trim(regexp_replace(lower(a), 'https?://', ''), '/'), '^www\.', '') AS a,
              regexp_replace(trim(regexp_replace(lower(b), 'https?://', ''), '/'), '^www\.', '') AS b FROM l)
SELECT conv_id, turn, CASE WHEN a = b THEN a ELSE a || '|' || b END AS domains FROM d
""")
def _(t):
    lists = t.sql("""
        SELECT c.conv_id, c.turn, concat(' ', p.url, ' , ', q.url, '；', upper(p.url), ' ') AS raw
        FROM (SELECT *, conv_id % (SELECT count(*) FROM {pages}) AS one, (conv_id + turn) % (SELECT count(*) FROM {pages}) AS two FROM {conversations}) c
        JOIN {pages} p ON p.page_id = c.one JOIN {pages} q ON q.page_id = c.two""")
    return lists.select("conv_id", "turn", F.array_join(U.parse_domain_list("raw"), "|").alias("domains"))


_RATE = "CASE n_nationkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 1.0836 WHEN 2 THEN 0.146 ELSE 0.0067 END"


@query("convert_price", f"""
SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE floor(p_retailprice * {_RATE} * 100 + 0.5) / 100 END AS usd
FROM part JOIN nation ON p_partkey % 25 = n_nationkey
""")
def _(t):
    priced = t.sql(f"""
        SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'free' WHEN p_partkey % 7 = 1 THEN format_number(p_retailprice, 2)
               ELSE CAST(p_retailprice AS STRING) END AS price, CAST({_RATE} AS DOUBLE) AS rate
        FROM {{part}} JOIN {{nation}} ON p_partkey % 25 = n_nationkey""")
    usd = U.convert_price("price", "rate")
    return priced.select("p_partkey", (F.floor(usd * 100 + 0.5) / 100).alias("usd"))


_PAYLOAD = """
SELECT p_partkey,
       array(named_struct('src', CASE WHEN p_partkey % 5 = 0 THEN ' ' ELSE concat('https://img.example/', p_partkey, '.jpg?v=', p_size) END),
             named_struct('src', concat('https://img.example/alt', p_partkey, '.png?w=3'))) AS images,
       array(named_struct('sku', concat(' S', p_partkey, ' '), 'title', 'Default Title'), named_struct('sku', 'x', 'title', p_name)) AS variants,
       array(named_struct('name', 'Title', 'values', array('Default Title')), named_struct('name', 'Color', 'values', split(p_name, ' ')),
             named_struct('name', ' Size ', 'values', array(CAST(p_size AS STRING), 'XL')), named_struct('name', '', 'values', array('z'))) AS options
FROM {part}
"""


@query("variant_string", """
SELECT p_partkey, 'S' || p_partkey AS sku, 'Color^' || replace(p_name, ' ', '#') || '|||Size^' || p_size || '#XL' AS variant, p_name AS titles FROM part
""")
def _(t):
    return t.sql(_PAYLOAD).select("p_partkey", U.first_sku("variants").alias("sku"), U.variant_string("options").alias("variant"),
                                  U.variant_titles("variants").alias("titles"))


@query("first_prices", """
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_retailprice * 2 END AS original_price, CASE WHEN p_partkey % 4 = 1 THEN NULL ELSE p_retailprice END AS discount_price FROM part WHERE p_partkey % 9 <> 5
UNION ALL SELECT p_partkey, NULL, NULL FROM part WHERE p_partkey % 9 = 5
""")
def _(t):
    rows = t.sql("""SELECT p_partkey, CASE WHEN p_partkey % 9 <> 5 THEN array(named_struct('compare_at_price', CASE WHEN p_partkey % 3 <> 0 THEN CAST(p_retailprice * 2 AS STRING) END,
        'price', CASE WHEN p_partkey % 4 = 1 THEN '' ELSE CAST(p_retailprice AS STRING) END), named_struct('compare_at_price', '1', 'price', '2')) END AS variants FROM {part}""")
    return rows.select("p_partkey", U.first_prices("variants").alias("p")).select("p_partkey", "p.*")


@query("unique_key", """
SELECT product_id, CASE WHEN product_id % 3 = 0 THEN domain || '|||fallback|||' || trim(lower(title), ' ' || chr(9) || chr(10) || chr(13)) || '|||' || coalesce(lower(image), '')
                        ELSE domain || '|||id|||' || product_id END AS product_key FROM v_product
""")
def _(t):
    pid = F.when(F.col("product_id") % 3 != 0, F.col("product_id"))
    return t.v_product.select("product_id", U.unique_key("domain", pid, "title", "image").alias("product_key"))


@query("main_image", """
SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'https://img.example/alt' || p_partkey || '.png' ELSE 'https://img.example/' || p_partkey || '.jpg' END AS image FROM part
""")
def _(t):
    return t.sql(_PAYLOAD).select("p_partkey", U.main_image("images").alias("image"))


@query("parse_price_first", """
SELECT product_id, CASE WHEN product_id % 7 = 0 THEN original_price ELSE coalesce(discount_price, original_price) END AS price FROM v_product
""")
def _(t):
    text = F.when(F.col("product_id") % 7 == 0, "call us").otherwise(F.concat(F.lit(" "), F.col("discount_price").cast("string")))
    return t.v_product.select("product_id", U.parse_price_first(text, "original_price").alias("price"))


@query("same_site_family", rf"""
WITH p AS (SELECT a.page_id, {_HOST.replace('raw', 'a.url')} AS src, {_HOST.replace('raw', 'b.url')} AS dst,
                  a.page_id % 4 = 0 AS checked, split_part(regexp_replace(regexp_replace(b.url, '^[^:]*://[^/]*', ''), '[?#].*$', ''), '#', 1) AS dst_path
           FROM (SELECT *, (page_id * 7 + 3) % (SELECT count(*) FROM pages) AS other FROM pages) a JOIN pages b ON b.page_id = a.other)
SELECT page_id, CASE WHEN array_to_string(string_split(src, '.')[-2:], '.') <> array_to_string(string_split(dst, '.')[-2:], '.') THEN 'FINAL_HOST_CROSS_DOMAIN'
                     WHEN checked AND coalesce(nullif(rtrim(dst_path, '/'), ''), '/') <> '/en' THEN 'FINAL_PATH_CHANGED' ELSE 'OK' END AS verdict FROM p
""")
def _(t):
    from merchloom.operators.sites import redirect_verdict
    pairs = t.sql("""SELECT a.page_id, a.url AS src, b.url AS final_url, CASE WHEN a.page_id % 4 = 0 THEN '/en/' END AS check_path
                     FROM (SELECT *, (page_id * 7 + 3) % (SELECT count(*) FROM {pages}) AS other FROM {pages}) a JOIN {pages} b ON b.page_id = a.other""")
    return pairs.select("page_id", redirect_verdict(U.url_netloc("src"), "final_url", "check_path").alias("verdict"))
