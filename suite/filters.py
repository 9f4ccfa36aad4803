"""Predicates, reject reasons and language tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from merchloom.functions import language as L
from merchloom.functions import text as T
from merchloom.functions.base import all_of
from merchloom.operators import rules as R
from merchloom.operators import sampling
from suite import duck, query

S = duck.strip
_PRICES = ["discount_price", "original_price"]


@query("price_range", "SELECT product_id, coalesce(discount_price BETWEEN 3 AND 6000, false) AS ok FROM v_product")
def _(t):
    return t.v_product.select("product_id", R.price_range("discount_price").alias("ok"))


@query("title_length", f"SELECT product_id, title FROM v_product WHERE length({S('title')}) >= 5")
def _(t):
    return t.v_product.where(R.title_length("title")).select("product_id", "title")


@query("image_valid", r"""
SELECT product_id, NOT (product_id % 5 = 1 OR (product_id % 5 = 2 AND regexp_matches(coalesce(image, ''), 'coming-soon'))) AS ok FROM v_product
""")
def _(t):
    images = (F.when(F.col("product_id") % 5 == 0, F.array().cast("array<string>"))
              .when(F.col("product_id") % 5 == 1, F.array(F.lit("https://x/a.jpg"), F.lit("https://x/NO_image.png")))
              .when(F.col("product_id") % 5 == 2, F.array(F.coalesce("image", F.lit("https://x/b.jpg"))))
              .otherwise(F.array(F.lit("https://x/c.jpg"))))
    return t.v_product.select("product_id", R.image_valid(images).alias("ok"))


@query("is_english", f"SELECT doc_id, NOT {duck.non_english('text')} AS english FROM documents")
def _(t):
    return t.documents.select("doc_id", L.is_english("text").alias("english"))


@query("is_english_sample", f"""
WITH r AS (SELECT source, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents),
     s AS (SELECT source, string_agg(text, ' ' ORDER BY doc_id) AS sample FROM r WHERE rn <= 5 GROUP BY source)
SELECT source, NOT {duck.non_english('sample')} AS english FROM s
""")
def _(t):
    return sampling.store_language(t.documents, "source", "text", ["doc_id"], 5).select("source", "english")


@query("is_english_sample_structured", rf"""
WITH r AS (SELECT source, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents),
     s AS (SELECT source, lower(string_agg({S("regexp_replace(text, '<[^>]+>', '', 'g')")}, ' ' ORDER BY doc_id)) AS sample FROM r
           WHERE rn <= 20 AND length({S("regexp_replace(text, '<[^>]+>', '', 'g')")}) >= 20 GROUP BY source),
     c AS (SELECT source, sample, len(regexp_extract_all(sample, '[a-z]')) AS latin, len(regexp_extract_all(sample, '[a-z0-9]')) AS plain,
                  len(regexp_extract_all(sample, '[\x{{e0}}-\x{{f6}}\x{{f8}}-\x{{fe}}]')) AS accents FROM s)
SELECT source, NOT (plain >= 30 AND (regexp_matches(sample, {duck.NON_LATIN}) OR (latin > 0 AND accents > 0.3 * latin) OR latin < 0.6 * plain)) AS english FROM c
""")
def _(t):
    return sampling.store_language_structured(t.documents, "source", "text", ["doc_id"], 20).select("source", "english")


@query("store_language_confirm", f"""
WITH p AS (SELECT source, doc_id % 3 + 1 AS page, doc_id, text FROM documents),
     r AS (SELECT *, row_number() OVER (PARTITION BY source, page ORDER BY doc_id) AS rn FROM p WHERE page <= 2),
     s AS (SELECT source, page, string_agg(text, ' ' ORDER BY doc_id) AS sample FROM r WHERE rn <= 5 GROUP BY source, page),
     v AS (SELECT source, count(*) = 2 AND bool_and({duck.non_english('sample')}) AS rejected FROM s GROUP BY source)
SELECT source, rejected FROM v
""")
def _(t):
    paged = t.documents.withColumn("page", F.col("doc_id") % 3 + 1)
    return sampling.confirm_language(paged, "source", "page", "text", ["doc_id"], 5)


_TERMS = ("hehely", "rewh rewh", "worthless", "orre")


@query("prohibited_substring", f"""
SELECT product_id, {' OR '.join(f"contains(lower(title || ' ' || description || ' ' || category), '{k}')" for k in _TERMS)} AS hit FROM v_product
""")
def _(t):
    return t.v_product.select("product_id", R.contains_any(_TERMS, "title", "description", "category").alias("hit"))


_CORE_SQL = f"""CASE WHEN NOT coalesce(discount_price BETWEEN 3 AND 6000, false) THEN 'price_range' WHEN length({S('title')}) < 5 THEN 'title_length'
     WHEN coalesce(image, '') LIKE '%coming-soon%' THEN 'image_valid' WHEN {duck.non_english("(title || ' ' || description)")} THEN 'is_english'
     WHEN product_id % 6 = 5 THEN 'sixth' WHEN length(category) % 2 = 1 THEN 'odd_category' ELSE '' END"""


def _core_rules():
    rules = R.RuleSet.core().add_rule("sixth", lambda df: df["product_id"] % 6 != 5)
    return rules.add_python_rule("odd_category", lambda c: len(c) % 2 == 0, "category")


def _with_core_columns(t):
    return t.v_product.withColumn("price", F.col("discount_price")).withColumn("images", F.array_compact(F.array("image")))


@query("composite_valid", f"SELECT product_id FROM v_product WHERE {_CORE_SQL} = ''")
def _(t):
    return _core_rules().valid(_with_core_columns(t)).select("product_id")


@query("custom_rule", f"SELECT product_id, {_CORE_SQL} AS failed_rule FROM v_product")
def _(t):
    return _core_rules().verdict(_with_core_columns(t)).select("product_id", "failed_rule")


def _basic_sql(title: int, desc: int, any_price: bool = False, required: bool = False) -> str:
    p = "coalesce(discount_price, original_price)"
    bad = f"({p} < 3 OR {p} > 6000)" if not any_price else "(coalesce(discount_price < 3 OR discount_price > 6000, false) OR original_price < 3 OR original_price > 6000)"
    return f"""CASE WHEN {S('title')} = '' OR {S('description')} = '' THEN 'empty' WHEN length({S('description')}) < {desc} THEN 'short_desc'
        WHEN length({S('title')}) < {title} THEN 'short_title' WHEN regexp_matches({S('title')}, '^\\s*[0-9]+\\s*$') THEN 'numeric_title' WHEN {bad} THEN 'bad_price' ELSE '' END"""


@query("basic_reject_reason", f"""
SELECT product_id, {_basic_sql(5, 0)} AS core, {_basic_sql(15, 30)} AS strict, {_basic_sql(8, 30)} AS v1, {_basic_sql(8, 30, True)} AS mongo FROM v_product
""")
def _(t):
    return t.v_product.select("product_id", *[R.basic_reject_reason("title", "description", _PRICES, p).alias(n) for n, p in R.PROFILES.items()])


@query("bad_image", "SELECT product_id, image IS NULL OR image LIKE '%coming-soon%' AS bad FROM v_product")
def _(t):
    return t.v_product.select("product_id", R.bad_image("image").alias("bad"))


@query("mongo_or_clean", r"""
SELECT product_id FROM v_product
WHERE NOT (image IS NULL OR image LIKE '%coming-soon%' OR coalesce(discount_price < 3 OR discount_price > 6000, false) OR original_price < 3 OR original_price > 6000
   OR description = '' OR (length(description) < 30 AND NOT contains(description, chr(10))) OR length(title) < 8 OR regexp_matches(title, '^\s*[0-9]+\s*$'))
""")
def _(t):
    return t.v_product.where(~R.combined_reject("title", "description", "image", _PRICES)).select("product_id")


@query("lexicon_word_match", rf"""
SELECT product_id, regexp_matches(lower(title || ' ' || category || ' ' || description), '(^|[^a-z0-9])(rewh rewh|worthless|hehely|orre)([^a-z0-9]|$)') AS hit FROM v_product
""")
def _(t):
    return t.v_product.select("product_id", R.lexicon_word_match(_TERMS, "title", "category", "description").alias("hit"))


_LANG_SQL = f"""
lang0 AS (SELECT *, {duck.strip_html('title', True)} AS t, {duck.strip_html('category', True)} AS c, {duck.strip_html('description', True)} AS d FROM v_product),
lang1 AS (SELECT *, array_to_string(list_filter([t, c], lambda x: x <> ''), ' ') AS p, array_to_string(list_filter([t, c, d], lambda x: x <> ''), ' ') AS a FROM lang0),
lang2 AS (SELECT *, {duck.letters('p')} AS pl, {duck.latin('p')} AS pa, {duck.letters('a')} AS al, {duck.latin('a')} AS aa FROM lang1),
lang AS (SELECT *, CASE WHEN regexp_matches(p, {duck.NON_LATIN}) THEN 'non_latin_primary'
       WHEN regexp_matches(d, {duck.NON_LATIN}) AND (pl < 8 OR pa < 0.5 * pl) THEN 'non_latin_desc_with_weak_primary'
       WHEN pl >= 12 AND pa < 0.55 * pl THEN 'low_latin_primary' WHEN al >= 80 AND aa < 0.45 * al AND pa < 8 THEN 'low_latin_combined'
       WHEN regexp_matches(p, {duck.ACCENTED}) THEN 'european_accent' ELSE '' END AS language_reason FROM lang2)
"""


@query("non_english_reason", f"WITH {_LANG_SQL} SELECT product_id, language_reason FROM lang")
def _(t):
    return R.with_language_reason(t.v_product).select("product_id", "language_reason")


@query("mostly_cjk", r"""
WITH c AS (SELECT id, raw, len(regexp_extract_all(raw, '[\x{4e00}-\x{9fff}]')) AS k, len(regexp_extract_all(raw, '[A-Za-z]')) AS e, len(regexp_extract_all(raw, '[0-9]')) AS n FROM v_rawcat)
SELECT id, k > 0 AND e = 0 AND k >= 0.8 * (k + n) AS cjk, regexp_matches(raw, '[\x{0600}-\x{06ff}]') AS arabic FROM c
""")
def _(t):
    return t.v_rawcat.select("id", L.mostly_cjk("raw").alias("cjk"), L.contains_arabic("raw").alias("arabic"))


@query("recycle_if_category_or_blank", r"""
WITH m AS (SELECT product_id, category, regexp_matches(lower(category), '(^|[^a-z0-9])(worthless|promos|economy)([^a-z0-9]|$)') AS in_cat,
                  regexp_matches(lower(title || ' ' || description), '(^|[^a-z0-9])(worthless|promos|economy)([^a-z0-9]|$)') AS in_text FROM v_product)
SELECT product_id, in_cat OR (in_text AND category = '') AS recycle, in_cat OR in_text AS recycle_v1 FROM m
""")
def _(t):
    terms = ("worthless", "promos", "economy")
    return t.v_product.select("product_id", R.recycle_if_matched(terms, "title", "category", "description").alias("recycle"),
                              R.recycle_if_matched(terms, "title", "category", "description", only_blank=False).alias("recycle_v1"))


@query("keyword_search", "SELECT id, domain FROM v_site WHERE domain ILIKE '%0001%' OR CAST(id AS VARCHAR) ILIKE '%0001%' OR report_status ILIKE '%0001%'")
def _(t):
    return sampling.search(t.v_site, "0001", ["id", "domain", "report_status"]).select("id", "domain")


@query("status_filter", """
SELECT order_id FROM v_order WHERE order_status = 'completed' AND order_category IS DISTINCT FROM '1-URGENT'
""")
def _(t):
    return sampling.by_status(t.v_order, {"order_status": "completed"}, {"order_category": "1-URGENT"}).select("order_id")


@query("time_range", """
SELECT order_id, 'days' AS kind FROM v_order WHERE order_time >= '1997-03-01' AND order_time <= '1997-03-31 23:59:59'
UNION ALL SELECT order_id, 'month' FROM v_order WHERE order_time >= '1996-12-01' AND order_time < '1997-01-01'
""")
def _(t):
    from merchloom.operators.orders import in_days, in_month
    orders = t.v_order
    return (orders.where(in_days("order_time", "1997-03-01", "1997-03-31")).select("order_id", F.lit("days").alias("kind"))
            .unionByName(orders.where(in_month("order_time", 1996, 12)).select("order_id", F.lit("month").alias("kind"))))


@query("drop_status", "SELECT order_id, order_status FROM v_order WHERE order_status NOT IN ('on-hold', 'trash')")
def _(t):
    return t.v_order.where(~F.col("order_status").isin("on-hold", "trash")).select("order_id", "order_status")


@query("min_count", "SELECT p_brand, count(*) AS products FROM part GROUP BY p_brand HAVING count(*) >= 80")
def _(t):
    return t.part.groupBy("p_brand").agg(F.count(F.lit(1)).alias("products")).where("products >= 80")


@query("profiles", f"""
SELECT product_id, {_basic_sql(20, 100)} AS reason FROM v_product
""")
def _(t):
    wide = R.PROFILES["strict"].with_(min_title=20, min_desc=100)
    return t.v_product.select("product_id", R.basic_reject_reason("title", "description", _PRICES, wide).alias("reason"))
