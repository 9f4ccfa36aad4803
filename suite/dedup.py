"""De-duplication, picture counts, quality ranking and quotas."""

from __future__ import annotations

from pyspark.sql import functions as F

from merchloom.operators import dedup as U
from merchloom.operators import quality as Q
from suite import duck, query
from suite.filters import _LANG_SQL, _basic_sql

S = duck.strip


@query("dedup_title_first", f"SELECT product_id, title FROM (SELECT *, row_number() OVER (PARTITION BY lower({S('title')}) ORDER BY product_id) AS rn FROM v_product WHERE {S('title')} <> '') WHERE rn = 1")
def _(t):
    return U.by_title_first(t.v_product.select("product_id", "title"), "title", ["product_id"])


_LINES = "SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN '  ' ELSE text END AS title FROM {documents}"


@query("dedup_keep_min_id", f"""
WITH l AS ({_LINES.replace('{documents}', 'documents')})
SELECT doc_id, title FROM (SELECT *, row_number() OVER (PARTITION BY {S('title')} ORDER BY doc_id) AS rn FROM l) WHERE rn = 1 OR {S('title')} = ''
""")
def _(t):
    return U.by_title_min_id(t.sql(_LINES), "title", "doc_id")


@query("dedup_key_last", """
SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE event_id % 50 <> 0) WHERE rn = 1
UNION ALL SELECT event_id, NULL, event_type FROM events WHERE event_id % 50 = 0
""")
def _(t):
    rows = t.events.withColumn("user_id", F.when(F.col("event_id") % 50 != 0, F.col("user_id")))
    return U.by_key(rows, ["user_id", "event_type"], [F.col("ts").desc(), F.col("event_id").desc()]).select("event_id", "user_id", "event_type")


@query("dedup_domain", r"""
WITH h AS (SELECT page_id, regexp_replace(lower(regexp_extract(raw_url, '^https?://([^/?#]+)', 1)), '^www\.', '') AS domain FROM v_url)
SELECT page_id, domain FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY page_id) AS rn FROM h WHERE domain NOT IN (SELECT domain FROM h WHERE page_id % 25 = 3)) WHERE rn = 1
""")
def _(t):
    from merchloom.functions.urls import extract_domain
    known = t.v_url.where("page_id % 25 = 3").select(F.upper(extract_domain("raw_url")).alias("domain"))
    return U.by_domain(t.v_url, "raw_url", ["page_id"], known).select("page_id", "domain")


_IMAGES = "array(coalesce(image, ''), concat('https://img.example/set', product_id % 60, '.png'))"


@query("image_frequency", """
WITH i AS (SELECT unnest([coalesce(image, ''), 'https://img.example/set' || product_id % 60 || '.png']) AS image FROM v_product) SELECT image, count(*) AS uses FROM i WHERE image <> '' GROUP BY 1
""")
def _(t):
    return U.image_frequency(t.v_product.select(F.expr(_IMAGES).alias("images")), "images")


@query("bulk_image_removal", """
WITH i AS (SELECT product_id, unnest([coalesce(image, ''), 'https://img.example/set' || product_id % 60 || '.png']) AS image FROM v_product),
     c AS (SELECT image FROM i WHERE image <> '' GROUP BY 1 HAVING count(*) > 20)
SELECT product_id FROM v_product WHERE product_id NOT IN (SELECT product_id FROM i JOIN c USING (image))
""")
def _(t):
    rows = t.v_product.select("product_id", F.expr(_IMAGES).alias("images"))
    return U.remove_bulk_images(rows, "product_id", "images").select("product_id")


@query("duplicate_titles", f"SELECT {S('title')} AS title, count(*) AS rows, count(*) - 1 AS deletable FROM v_product WHERE {S('title')} <> '' GROUP BY 1 HAVING count(*) > 1")
def _(t):
    return U.title_groups(t.v_product, "title")


@query("duplicate_title_summary", f"""
WITH g AS (SELECT coalesce({S('title')}, '') AS title, count(*) AS n FROM v_product GROUP BY 1)
SELECT count(*) FILTER (title <> '' AND n > 1) AS groups, CAST(coalesce(sum(n - 1) FILTER (title <> ''), 0) AS BIGINT) AS deletable,
       CAST(coalesce(sum(n) FILTER (title = ''), 0) AS BIGINT) AS blank, CAST(coalesce(sum(CASE WHEN title = '' THEN n ELSE 1 END), 0) AS BIGINT) AS remaining FROM g
""")
def _(t):
    return U.title_summary(t.v_product, "title")


@query("duplicate_title_examples", f"SELECT {S('title')} AS title, count(*) AS rows FROM v_product WHERE {S('title')} <> '' GROUP BY 1 HAVING count(*) > 1 ORDER BY rows DESC, title LIMIT 15")
def _(t):
    return U.title_examples(t.v_product, "title")


@query("repeated_page_stop", """
WITH s AS (SELECT conv_id, turn, CASE WHEN turn >= 2 + conv_id % 3 THEN 'same' ELSE text END AS sig FROM conversations),
     l AS (SELECT *, coalesce(sig = lag(sig) OVER (PARTITION BY conv_id ORDER BY turn) AND sig <> '', false) AS same FROM s),
     r AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM l),
     n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, run ORDER BY turn) - 1 AS repeats FROM r),
     z AS (SELECT *, max(CASE WHEN repeats >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS stopped FROM n)
SELECT conv_id, turn, repeats FROM z WHERE stopped = 0
""")
def _(t):
    signature = F.when(F.col("turn") >= 2 + F.col("conv_id") % 3, "same").otherwise(F.col("text"))
    return U.repeated_pages(t.conversations, "conv_id", "turn", signature).select("conv_id", "turn", "repeats")


SCORE_SQL = f"""
{_LANG_SQL},
base AS (SELECT *, length(t) AS tl, length(d) AS dl, len(regexp_extract_all(t, '[A-Za-z]{{2,}}')) AS wc, len(list_distinct(regexp_extract_all(lower(t), '[a-z]{{2,}}'))) AS uc,
   {_basic_sql(15, 30)} AS reason, coalesce(discount_price, original_price) AS price FROM lang),
scored AS (SELECT product_id, category, title, CASE WHEN tl = 0 THEN -9999 ELSE
   CASE WHEN wc < 3 THEN -500 WHEN wc >= 5 THEN 120 ELSE 40 END + CASE WHEN uc >= 4 THEN 100 WHEN uc >= 2 THEN 40 ELSE 0 END
   + CASE WHEN tl BETWEEN 30 AND 80 THEN 180 WHEN tl BETWEEN 20 AND 29 THEN 60 WHEN tl BETWEEN 81 AND 120 THEN 20 WHEN tl < 20 THEN -300 ELSE 0 END
   + CASE WHEN dl = 0 THEN -600 WHEN dl < 30 THEN -250 WHEN dl < 60 THEN 30 WHEN dl < 150 THEN 150 ELSE 300 END
   + CASE reason WHEN '' THEN 80 WHEN 'empty' THEN -400 WHEN 'numeric_title' THEN -400 WHEN 'short_title' THEN -300 WHEN 'bad_price' THEN -150 ELSE 0 END
   + CASE WHEN language_reason = '' THEN 150 ELSE -400 END + CASE WHEN image IS NULL OR image LIKE '%coming-soon%' THEN -250 WHEN product_id % 4 = 1 THEN 150 ELSE 60 END
   + CASE WHEN price BETWEEN 3 AND 6000 THEN 100 WHEN price IS NOT NULL THEN -50 ELSE -100 END + CASE WHEN category <> '' THEN 60 ELSE 0 END
   + CASE WHEN product_id % 3 = 0 THEN 80 ELSE 0 END END AS quality, tl AS title_len, dl AS desc_len FROM base)
"""


def scored(t):
    return Q.with_quality(t.v_product, variant_name=F.lit("Size"), variant_value=F.when(F.col("product_id") % 3 == 0, "XL"),
                          image_count=F.when(F.col("product_id") % 4 == 1, 2).otherwise(1))


@query("quality_score", f"WITH {SCORE_SQL} SELECT product_id, quality, title_len, desc_len FROM scored")
def _(t):
    return scored(t).select("product_id", "quality", "title_len", "desc_len")


@query("category_counts", "SELECT trim(category) AS name, count(*) AS count FROM v_product WHERE trim(category) <> '' GROUP BY 1 ORDER BY 2 DESC, 1")
def _(t):
    return Q.category_counts(t.v_product).orderBy(F.col("count").desc(), "name")


def quota_sql(counts: str, total: int, low: int, high: int) -> str:
    return f"""
ranked AS (SELECT name, count, row_number() OVER (ORDER BY count DESC, name) AS rn FROM ({counts}) WHERE count >= {low}),
chosen AS (SELECT name, count, rn, least(count, {high}) - {low} AS room FROM ranked WHERE rn <= {total} // {low}),
rest AS (SELECT {total} - count(*) * {low} AS rest FROM chosen),
quota AS (SELECT name, count, CAST({low} + greatest(0, least(room, rest - coalesce(sum(room) OVER (ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS allocated FROM chosen, rest)
"""


_PART_COUNTS = "SELECT p_brand || ' ' || p_type AS name, count(*) AS count FROM part GROUP BY 1"


@query("quota_allocation", f"WITH {quota_sql(_PART_COUNTS, 900, 10, 14)} SELECT name, count, allocated FROM quota")
def _(t):
    counts = Q.category_counts(t.part.withColumn("category", F.concat_ws(" ", "p_brand", "p_type")))
    return Q.allocate_quota(counts, 900, 10, 14)


_CAT_COUNTS = "SELECT trim(category) AS name, count(*) AS count FROM v_product WHERE trim(category) <> '' GROUP BY 1"
TOPK_SQL = f"""{SCORE_SQL}, {quota_sql(_CAT_COUNTS, 300, 20, 45)},
placed AS (SELECT s.*, name, allocated, row_number() OVER (PARTITION BY name ORDER BY quality DESC, title_len DESC, desc_len DESC, CAST(product_id AS VARCHAR) DESC) AS place FROM scored s JOIN quota ON trim(category) = name)
"""


@query("topk_per_category_quality", f"WITH {TOPK_SQL} SELECT product_id, category, quality, place FROM placed WHERE place <= allocated")
def _(t):
    allocation = Q.allocate_quota(Q.category_counts(t.v_product), 300, 20, 45)
    return Q.select_by_quota(scored(t), allocation, 45, "product_id").select("product_id", "category", "quality", "place")
