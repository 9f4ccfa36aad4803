"""Composed jobs over the whole catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from merchloom.functions import html as H
from merchloom.operators import category_merge as M
from merchloom.plans import cleanup as P
from merchloom.plans import export as X
from merchloom.session import scratch_path
from merchloom.sources import sinks as K
from suite import duck, query
from suite.categories import best_sql, key_sql
from suite.dedup import TOPK_SQL, scored
from suite.filters import _LANG_SQL, _basic_sql
from suite.lexicon import LEXICON, _FIRST

S = duck.strip
_IMAGE_LIMIT = 24
_PROHIBITED = ("hehely", "rewh rewh", "worthless", "orre")
_NODES = "SELECT DISTINCT p_type AS node FROM {part} UNION SELECT 'promo'"

_PROCESSED = f"""
img AS (SELECT image FROM v_product WHERE image IS NOT NULL GROUP BY 1 HAVING count(*) > {_IMAGE_LIMIT}),
pro AS (SELECT product_id, replace({S('title')}, chr(10), ' ') AS title, substring({duck.strip_html('description')}, 1, 5000) AS description,
   CASE WHEN lower({duck.ws('category')}) IN ('standard', 'economy', 'large', 'medium', 'promo', 'small') THEN {duck.title_case(duck.ws('category'))}
        WHEN regexp_replace(lower({duck.ws('category')}), 's$', '') IN ('standard', 'economy', 'large', 'medium', 'promo', 'small') THEN {duck.title_case("regexp_replace(lower(" + duck.ws('category') + "), 's$', '')")} ELSE {duck.ws('category')} END AS category,
   image, discount_price FROM v_product WHERE image IS NULL OR image NOT IN (SELECT image FROM img)),
ded AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower({S('title')}) ORDER BY product_id) AS rn FROM pro WHERE {S('title')} <> '') WHERE rn = 1),
ver AS (SELECT *, CASE WHEN NOT coalesce(discount_price BETWEEN 3 AND 6000, false) THEN 'price_range' WHEN length({S('title')}) < 5 THEN 'title_length'
   WHEN coalesce(image, '') LIKE '%coming-soon%' THEN 'image_valid' WHEN {duck.non_english("(title || ' ' || description)")} THEN 'is_english'
   WHEN {' OR '.join(f"contains(lower(title || ' ' || description), '{k}')" for k in _PROHIBITED)} OR product_id % 10 = 3 THEN 'prohibited' ELSE '' END AS verdict FROM ded)
"""


def _catalog(t):
    return t.v_product.withColumn("price", F.col("discount_price")).withColumn("images", F.array_compact(F.array("image"))).withColumn(
        "tags", F.when(F.col("product_id") % 10 == 3, F.array(F.lit(" "), F.lit(" Not Worthless "))))


@query("process_all", f"WITH {_PROCESSED} SELECT product_id, title, description, category FROM pro")
def _(t):
    return P.process_all(_catalog(t), "product_id", t.sql(_NODES), _IMAGE_LIMIT).select("product_id", "title", "description", "category")


@query("extract_clean_core", f"WITH {_PROCESSED} SELECT CASE WHEN verdict = '' THEN 'kept' ELSE verdict END AS verdict, count(*) AS rows FROM ver GROUP BY 1")
def _(t):
    return P.verdict_counts(P.core_verdicts(_catalog(t), "product_id", t.sql(_NODES), _PROHIBITED, _IMAGE_LIMIT))


@query("extract_clean_rows", f"WITH {_PROCESSED} SELECT product_id, title, verdict FROM ver")
def _(t):
    return P.core_verdicts(_catalog(t), "product_id", t.sql(_NODES), _PROHIBITED, _IMAGE_LIMIT).select("product_id", "title", "verdict")


def _stage(key: str, sql: str, step):
    @query(key, sql)
    def _(t):
        return P.staged_verdict(t.v_product, [step]).select("product_id", "verdict")


_CHECKS = P.Checks(lexicon_terms=("worthless", "ononst"), prohibited=LEXICON)
_stage("stage_basic", f"SELECT product_id, {_basic_sql(15, 30)} AS verdict FROM v_product", _CHECKS.basic)
_stage("stage_image", "SELECT product_id, CASE WHEN image IS NULL OR image LIKE '%coming-soon%' THEN 'bad_image' ELSE '' END AS verdict FROM v_product", _CHECKS.image)
_stage("stage_english", f"WITH {_LANG_SQL} SELECT product_id, language_reason AS verdict FROM lang", _CHECKS.english)
_stage("stage_forbidden", f"WITH {_FIRST} SELECT product_id, CASE WHEN match_field <> '' THEN 'forbidden_keyword' ELSE '' END AS verdict FROM first_hit", _CHECKS.forbidden)


@query("stage_forbidden_recycle", f"WITH {_FIRST} SELECT product_id, match_field, match_keyword, 'forbidden_keyword' AS move_reason FROM first_hit WHERE match_field <> ''")
def _(t):
    found = LEXICON.first_match(t.v_product).withColumnsRenamed({"match_field": "hit_field", "match_keyword": "hit_keyword"})
    marked = K.with_verdict(found, F.col("hit_field") != "", F.lit("forbidden_keyword"), "catalog_clean", F.current_timestamp(), F.col("hit_field"), F.col("hit_keyword"))
    _, recycled = K.move_with_backup(marked, scratch_path(t.spark, "recycle"))
    return recycled.select("product_id", "match_field", "match_keyword", "move_reason")


_LETTERS = f"""
blk0 AS (SELECT *, trim(title || ' ' || category) AS p, trim(trim(title || ' ' || category) || ' ' || description) AS a FROM v_product),
blk1 AS (SELECT *, {duck.letters('p')} AS pl, {duck.latin('p')} AS pa, {duck.letters('a')} AS al, {duck.latin('a')} AS aa FROM blk0),
blk AS (SELECT b.product_id, b.category, CASE WHEN title = '' OR description = '' THEN 'empty' WHEN length(title) < 15 THEN 'short_title' WHEN length(description) < 30 THEN 'short_desc' WHEN regexp_matches(title, '^\\s*[0-9]+\\s*$') THEN 'numeric_title'
   WHEN image IS NULL OR image LIKE '%coming-soon%' THEN 'bad_image' WHEN coalesce(discount_price < 3 OR discount_price > 6000, false) OR original_price < 3 OR original_price > 6000 THEN 'bad_price'
   WHEN regexp_matches(title, {duck.NON_LATIN}) OR regexp_matches(title, {duck.ACCENTED}) OR (pl > 0 AND ((pl >= 12 AND pa < 0.55 * pl) OR (al >= 80 AND aa < 0.45 * al AND pa < 8) OR (regexp_matches(description, {duck.NON_LATIN}) AND (pl < 8 OR pa < 0.5 * pl)))) THEN 'non_english'
   WHEN match_field <> '' THEN 'forbidden_keyword' ELSE '' END AS verdict FROM blk1 b JOIN first_hit USING (product_id))
"""


@query("bulk_cleanup", f"WITH {_FIRST}, {_LETTERS} SELECT product_id, verdict FROM blk")
def _(t):
    return P.bulk_cleanup(t.v_product, LEXICON).select("product_id", "verdict")


def _path_sql(source: str, out: str) -> str:
    """CTE ``out(c, clean)``: the cleaned path of the fixture's own category spellings."""
    return f"""{out} AS (SELECT c, CASE WHEN c = '' THEN 'Other' ELSE array_to_string(list_filter(list_transform(string_split(c, '>'), lambda x: {S('x')}), lambda x: length(x) > 1), '|||') END AS clean FROM (SELECT DISTINCT category AS c FROM {source}))"""


def merge_sql(source: str, threshold: int) -> str:
    """CTEs up to ``merged(product_id, category)`` for the rows of ``source``."""
    return f"""
{_path_sql(source, 'cp')}, cr AS (SELECT product_id, clean FROM {source} JOIN cp ON c = category),
{key_sql('cr', 'clean', 'ck')}, cx AS (SELECT product_id, clean, cat_key FROM cr JOIN ck ON c = clean),
cs AS (SELECT cat_key, clean, count(*) AS n FROM cx GROUP BY ALL), rp AS (SELECT cat_key, sum(n) AS n, first(clean ORDER BY n DESC, clean) AS rep FROM cs GROUP BY cat_key),
{best_sql(f"SELECT rep AS category FROM rp WHERE n < {threshold} AND rep <> 'Other'", f"SELECT rep AS category FROM rp WHERE n >= {threshold} AND rep <> 'Other'")},
mt AS (SELECT cat_key, target FROM rp JOIN best ON best.category = rep WHERE n < {threshold} AND rep <> 'Other' AND target NOT IN ('Other', rep)),
merged AS (SELECT product_id, coalesce(target, clean) AS category FROM cx LEFT JOIN mt USING (cat_key))
"""


@query("full_cleanup", f"WITH {_FIRST}, {_LETTERS}, fk AS (SELECT * FROM blk WHERE verdict = ''), {merge_sql('fk', 30)} SELECT product_id, category FROM merged")
def _(t):
    return P.full_cleanup(t.v_product, LEXICON).select("product_id", "category")


_EXTRACT = f"""
{_LANG_SQL},
ex AS (SELECT product_id, category, coalesce(nullif({_basic_sql(15, 30)}, ''), CASE WHEN regexp_matches(lower(title || ' ' || category || ' ' || description), '(^|[^a-z0-9])(worthless|ononst)([^a-z0-9]|$)') THEN 'lexicon'
   WHEN image IS NULL OR image LIKE '%coming-soon%' THEN 'bad_image' WHEN language_reason <> '' THEN language_reason ELSE '' END) AS verdict FROM lang)
"""


@query("extract_to_clean", f"WITH {_EXTRACT} SELECT product_id, verdict FROM ex")
def _(t):
    return P.extract_to_clean(t.v_product, ("worthless", "ononst")).select("product_id", "verdict")


@query("extract_to_clean_merged", f"WITH {_EXTRACT}, ek AS (SELECT * FROM ex WHERE verdict = ''), {merge_sql('ek', 20)} SELECT product_id, category FROM merged")
def _(t):
    return P.merge_clean(P.extract_to_clean(t.v_product, ("worthless", "ononst")).where("verdict = ''"), 20).select("product_id", "category")


@query("staging_to_clean", f"""
WITH {_FIRST}, {_LANG_SQL}
SELECT product_id, coalesce(nullif({_basic_sql(15, 30)}, ''), CASE WHEN image IS NULL OR image LIKE '%coming-soon%' THEN 'bad_image' WHEN language_reason <> '' THEN language_reason WHEN match_field <> '' THEN 'forbidden_keyword' ELSE '' END) AS verdict,
       match_field, match_keyword FROM lang JOIN first_hit USING (product_id)
""")
def _(t):
    return P.staging_to_clean(t.v_product, LEXICON).select("product_id", "verdict", "match_field", "match_keyword")


@query("quota_export", f"WITH {TOPK_SQL} SELECT s.product_id, p.place <= p.allocated AS exported, CASE WHEN p.place <= p.allocated THEN p.place END AS place FROM scored s JOIN placed p USING (product_id) UNION ALL SELECT product_id, false, NULL FROM scored WHERE product_id NOT IN (SELECT product_id FROM placed)")
def _(t):
    return X.quota_export(scored(t), "product_id", 300, 20, 45).select("product_id", "exported", "place")


@query("quota_summary", f"WITH {TOPK_SQL} SELECT trim(category) AS category, count(*) AS rows FROM placed WHERE place <= allocated GROUP BY 1")
def _(t):
    return X.quota_summary(X.quota_export(scored(t), "product_id", 300, 20, 45))


@query("direct_export", "SELECT '' AS sku, CAST(p_partkey AS VARCHAR) AS p_partkey, p_name AS title, 'out' AS half FROM part WHERE p_partkey < 700 UNION ALL SELECT NULL, CAST(p_partkey AS VARCHAR), p_name, 'left' FROM part WHERE p_partkey >= 700")
def _(t):
    out, left = X.direct_export(t.part.select("p_partkey", F.col("p_name").alias("title")), "p_partkey", 700)
    return out.select("sku", "p_partkey", "title", F.lit("out").alias("half")).unionByName(
        left.select(F.lit(None).cast("string").alias("sku"), F.col("p_partkey").cast("string"), "title", F.lit("left").alias("half")))


@query("discover_filter_stage", r"""
WITH h AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]+)', 1)), '^www\.', '') AS domain FROM pages),
     f AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY page_id) AS rn FROM h WHERE domain NOT IN (SELECT domain FROM h WHERE page_id % 19 = 4))
SELECT domain, 'https://' || domain AS clean_url, CASE page_id % 3 WHEN 0 THEN 'Shopify' ELSE 'Magento' END AS platform, page_id % 40 AS product_count, 'unfiltered' AS stage FROM f WHERE rn = 1 AND page_id % 3 < 2 AND page_id % 40 >= 10
""")
def _(t):
    captured = t.sql("""SELECT page_id AS result_id, url, html, CASE WHEN page_id % 3 = 0 THEN to_json(map('published_products_count', page_id)) END AS meta,
        CAST(NULL AS STRING) AS products, CASE WHEN page_id % 3 = 1 THEN 'Magento/2.4' END AS version, page_id % 40 AS product_count, 'cat' AS category FROM {pages}""")
    probed = captured.withColumn("platform", H.detect_platform("html", "meta", "products", "version")["platform"])
    from merchloom.functions.urls import extract_domain
    existing = t.pages.where("page_id % 19 = 4").select(extract_domain("url").alias("domain"))
    return P.discover(probed, existing, 10).drop("category")


@query("collection_filter", """
WITH n AS (SELECT DISTINCT lower(p_name) AS node FROM part WHERE p_size = 3), w AS (SELECT DISTINCT unnest(list_filter(string_split(node, ' '), lambda x: length(x) >= 3 AND x NOT IN ('all','the','and','for','with','new','sale','shop','best','top'))) AS w FROM n)
SELECT p_partkey, CASE WHEN lower(p_name) IN (SELECT node FROM n) OR len(list_intersect(string_split(lower(p_name), ' '), (SELECT list(w) FROM w))) > 0 THEN 'filtered' ELSE 'unfiltered' END AS stage FROM part
""")
def _(t):
    nodes = t.sql("SELECT DISTINCT p_name AS node FROM {part} WHERE p_size = 3")
    return P.collection_filter(t.part.select("p_partkey", "p_name"), "p_name", nodes).select("p_partkey", "stage")
