"""Fuzzy scores, label assignment, store classification and wrong-table scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from merchloom.functions import similarity as S
from merchloom.functions.text import normalize_text
from merchloom.functions.urls import extract_domain
from merchloom.operators import fuzzy as Z
from merchloom.operators import labels as L
from merchloom.operators import multilabel as M
from merchloom.operators import stores as T
from merchloom.operators import targets as G
from merchloom.session import cut_lineage, scratch_path
from merchloom.sources import sinks as K
from suite import duck, query
from suite.text import _stem_sql


def ratio_sql(a: str, b: str) -> str:
    return f"(CASE WHEN greatest(length({a}), length({b})) = 0 THEN 100.0 ELSE 100.0 * (1 - levenshtein({a}, {b}) / greatest(length({a}), length({b}))) END)"


def tok(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({x}), '[^a-z0-9]+'), lambda w: w <> '')"


def fuzzy_sql(name: str, src: str) -> str:
    """CTE ``name`` = ``src`` plus token-set, token-sort, windowed, overlap and combined scores of (target, source)."""
    return f"""
{name}0 AS (SELECT *, list_distinct({tok('target')}) AS ta, list_distinct({tok('source')}) AS tb, array_to_string(list_sort({tok('target')}), ' ') AS oa, array_to_string(list_sort({tok('source')}), ' ') AS ob,
   CASE WHEN length(target) > length(source) THEN lower(source) ELSE lower(target) END AS sh, CASE WHEN length(target) > length(source) THEN lower(target) ELSE lower(source) END AS lo,
   list_distinct(list_filter(regexp_extract_all(lower(target), '[a-z]+'), lambda w: length(w) >= 3)) AS kw FROM {src}),
{name}1 AS (SELECT *, list_sort(list_intersect(ta, tb)) AS both_w, list_sort(list_filter(ta, lambda w: NOT list_contains(tb, w))) AS la, list_sort(list_filter(tb, lambda w: NOT list_contains(ta, w))) AS lb FROM {name}0),
{name}2 AS (SELECT *, array_to_string(both_w, ' ') AS c, array_to_string(both_w || la, ' ') AS l, array_to_string(both_w || lb, ' ') AS r FROM {name}1),
{name}3 AS (SELECT *, CASE WHEN len(ta) = 0 OR len(tb) = 0 THEN 0.0 WHEN len(both_w) > 0 AND (len(la) = 0 OR len(lb) = 0) THEN 100.0
     ELSE greatest(CASE WHEN len(both_w) > 0 THEN greatest({ratio_sql('c', 'l')}, {ratio_sql('c', 'r')}) ELSE 0.0 END, {ratio_sql('l', 'r')}) END AS set_score,
   {ratio_sql('oa', 'ob')} AS sort_score,
   CASE WHEN length(sh) = 0 THEN 0.0 ELSE list_max(list_transform(range(1, greatest(1, length(lo) - length(sh) + 1) + 1), lambda i: {ratio_sql('sh', 'substring(lo, i, length(sh))')})) END AS part_score,
   len(list_filter(kw, lambda w: contains(lower(source), w))) AS hits FROM {name}2),
{name} AS (SELECT *, CASE WHEN length(target) = 0 OR length(source) = 0 THEN 0.0 WHEN set_score >= 85 THEN set_score WHEN sort_score >= 95 THEN sort_score WHEN length(target) >= 5 AND part_score >= 75 THEN part_score ELSE 0.0 END AS fuzzy,
   CASE WHEN hits >= 2 OR (len(kw) <= 3 AND hits >= 1) THEN least(100.0, hits / len(kw) * 100 + 50) ELSE 0.0 END AS overlap FROM {name}3)
"""


_PAIRS = """SELECT a.p_partkey AS id, a.p_name || ' ' || lower(a.p_type) AS target, CASE a.p_partkey % 5 WHEN 0 THEN lower(a.p_type) || ' ' || a.p_name WHEN 1 THEN b.p_name || ' ' || a.p_name
            WHEN 2 THEN 'a ' || substring(a.p_name, 2) || ' ' || lower(b.p_type) || ' box' WHEN 3 THEN '' ELSE b.p_name END AS source
            FROM (SELECT *, (p_partkey * 7 + 3) % (SELECT count(*) FROM {part}) AS other FROM {part_spread}) a JOIN {part} b ON b.p_partkey = a.other"""
_PAIRS_D = _PAIRS.replace("{part_spread}", "part").replace("{part}", "part")


@query("fuzzy_score", f"WITH pairs AS ({_PAIRS_D}), {fuzzy_sql('f', 'pairs')} SELECT id, round(set_score, 4) AS set_score, round(sort_score, 4) AS sort_score, round(part_score, 4) AS part_score, round(fuzzy, 4) AS fuzzy FROM f")
def _(t):
    r = lambda c, n: F.round(c, 4).alias(n)
    return t.sql(_PAIRS).select("id", r(S.token_set("target", "source"), "set_score"), r(S.token_sort("target", "source"), "sort_score"),
                                r(S.partial("target", "source"), "part_score"), r(S.fuzzy_score("target", "source"), "fuzzy"))


@query("keyword_overlap", f"WITH pairs AS ({_PAIRS_D}), {fuzzy_sql('f', 'pairs')} SELECT id, round(overlap, 4) AS overlap FROM f")
def _(t):
    return t.sql(_PAIRS).select("id", F.round(S.keyword_overlap("target", "source"), 4).alias("overlap"))


_LABELS = [("Economy goods", "red ring"), ("Large things", "small bolt set"), ("Promo", "blue widget"), ("Brand", "standard gear")]
_ITEMS = "SELECT p_partkey AS product_id, p_type AS category, p_name || ' ' || p_brand AS title FROM {part_spread}"


def _label_sql(limit: int) -> str:
    values = ", ".join(f"({i}, '{p}', '{s}')" for i, (p, s) in enumerate(_LABELS))
    pairs = """SELECT product_id, label_no, phase, target, unnest([category, CASE WHEN length(title) >= 10 THEN title ELSE '' END]) AS source
               FROM items, (SELECT label_no, 1 AS phase, second AS target FROM lab UNION ALL SELECT label_no, 2, prim FROM lab)"""
    return f"""
lab AS (SELECT * FROM (VALUES {values}) AS l(label_no, prim, second)), items AS ({_ITEMS.replace('{part_spread}', 'part')}), lp AS ({pairs}), {fuzzy_sql('lf', 'lp')},
ls AS (SELECT product_id, label_no, phase, max(greatest(fuzzy, overlap)) AS score FROM lf GROUP BY ALL HAVING max(greatest(fuzzy, overlap)) > 0),
la AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY phase, label_no) AS pick FROM ls),
lk AS (SELECT *, row_number() OVER (PARTITION BY label_no ORDER BY phase, round(score, 9) DESC, product_id) AS place FROM la WHERE pick = 1)
"""


@query("match_catalog_to_labels", f"WITH {_label_sql(40)} SELECT product_id, label_no, phase, round(score, 4) AS score, place FROM lk WHERE place <= 40")
def _(t):
    rows = L.assign_labels(t.sql(_ITEMS), _LABELS, "product_id", limit=40)
    return rows.select("product_id", "label_no", "phase", F.round("score", 4).alias("score"), "place")


@query("exclusive_assignment", f"WITH {_label_sql(40)} SELECT product_id, label_no FROM lk WHERE phase = 1")
def _(t):
    return L.with_first_label(t.sql(_ITEMS), [second for _, second in _LABELS], F.col("category"), F.col("title")).select("product_id", "label_no")


@query("topk_per_label_score", f"WITH {_label_sql(40)}, p1 AS (SELECT *, row_number() OVER (PARTITION BY label_no ORDER BY round(score, 9) DESC, product_id) AS nth FROM lk WHERE phase = 1) SELECT product_id, label_no FROM p1 WHERE nth <= 150")
def _(t):
    from merchloom.operators.ranking import top_per_group
    taken = L.with_first_label(t.sql(_ITEMS), [second for _, second in _LABELS], F.col("category"), F.col("title"))
    return top_per_group(taken, ["label_no"], [F.round("score", 9).desc(), F.col("product_id")], 150, salt_by=["product_id"]).select("product_id", "label_no")


@query("catalog_phase_filter", f"WITH pairs AS (SELECT product_id, 'red ring brand' AS target, unnest([category, title]) AS source FROM ({_ITEMS.replace('{part_spread}', 'part')})), {fuzzy_sql('f', 'pairs')} SELECT product_id, round(max(set_score), 4) AS score FROM f GROUP BY 1 HAVING max(set_score) >= 75")
def _(t):
    return L.catalog_filter(t.sql(_ITEMS), "red ring brand", "category", "title").select("product_id", F.round("score", 4).alias("score"))


_RULES = """SELECT * FROM (VALUES ('pet', 'domain', 'therth', 1), ('pet', 'domain', 'thti-on', 2), ('pet', 'phrase', 'that', 3), ('pet', 'phrase', 'aulich', 4), ('pet', 'strong', 'sch', 5), ('pet', 'ignored', 'that', 6),
  ('bag', 'domain', 'cheap pills', 1), ('bag', 'domain', 'pills', 2), ('bag', 'phrase', 'attion', 3), ('bag', 'phrase', 'thanedble', 4), ('bag', 'phrase', 'tion', 5), ('bag', 'strong', 'laleen', 6),
  ('garden', 'domain', 'spamfarm', 1), ('garden', 'domain', 'thspamfarm', 2), ('garden', 'phrase', 'ther', 3), ('garden', 'phrase', 'enau', 4), ('garden', 'strong', 'nicht', 5),
  ('auto', 'phrase', 'that', 1), ('auto', 'phrase', 'with', 2), ('camera', 'phrase', 'ascirr', 1), ('camera', 'domain', 'thther', 2), ('electronics', 'phrase', 'ascirr', 1), ('electronics', 'domain', 'therex', 2)) AS r(category, kind, phrase, ord)"""


def _stores(t):
    anchors = F.regexp_extract_all(F.regexp_extract("html", "(?is)<nav[^>]*>(.*?)</nav>", 1), F.lit("(?is)(<a [^>]*>.*?</a>)"), 1)
    names = F.transform(anchors, lambda a: F.regexp_replace(a, "<[^>]*>", ""))
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return t.pages.select(
        F.col("page_id").alias("store_id"), F.when(F.col("page_id") % 17 != 0, normalize_text(extract_domain("url"), "compact")).otherwise("").alias("domain_compact"),
        normalize_text(title, "word").alias("meta_text"), F.transform(names, lambda n: normalize_text(n, "word")).alias("titles"),
        F.transform(names, lambda n: normalize_text(n, "compact")).alias("handles"), (F.col("page_id") % 150).alias("collection_count"),
        (F.col("page_id") % 11 != 3).alias("is_shop"), (F.col("page_id") % 23 == 5).alias("has_arabic"), (F.col("page_id") % 2 == 0).alias("fetch_failed"))


def _word(x: str) -> str:
    return duck.ws(f"regexp_replace(lower({duck.strip(x)}), '[^\\p{{L}}\\p{{N}}_\\s&''-]', ' ', 'g')")


_STORE_SQL = f"""
rl AS ({_RULES}),
st AS (SELECT page_id AS store_id, CASE WHEN page_id % 17 <> 0 THEN regexp_replace(regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]+)', 1)), '^www\\.', ''), '[^a-z0-9]', '', 'g') ELSE '' END AS d,
   {_word("regexp_extract(html, '<title>([^<]*)</title>', 1)")} AS m, list_transform(regexp_extract_all(regexp_extract(html, '(?is)<nav[^>]*>(.*?)</nav>', 1), '(?is)<a [^>]*>.*?</a>'), lambda a: regexp_replace(a, '<[^>]*>', '', 'g')) AS names,
   page_id % 150 AS cc FROM pages),
tx AS (SELECT store_id, 'domain' AS field, d AS x FROM st UNION ALL SELECT store_id, 'meta', m FROM st
   UNION ALL SELECT store_id, 'title', {_word('n')} FROM (SELECT store_id, unnest(names) AS n FROM st) UNION ALL SELECT store_id, 'handle', regexp_replace(lower(n), '[^a-z0-9]+', '', 'g') FROM (SELECT store_id, unnest(names) AS n FROM st)),
sg AS (SELECT * FROM (VALUES ('domain', 'domain', 'domain', true, 4, 0, 12), ('meta', 'meta', 'phrase', false, 4, 4, 12), ('title', 'title', 'phrase', false, 4, 6, 18), ('handle', 'handle', 'phrase', true, 5, 3, 9),
   ('strong_meta', 'meta', 'strong', false, 1, 5, 15), ('strong_title', 'title', 'strong', false, 1, 7, 21), ('strong_handle', 'handle', 'strong', true, 1, 4, 12)) AS s(signal, field, kind, compact, min_len, weight, cap)),
tm AS (SELECT signal, field, category, CASE WHEN compact THEN regexp_replace(phrase, '[^a-z0-9]+', '', 'g') ELSE phrase END AS term, min(ord) AS ord, any_value(weight) AS weight, any_value(cap) AS cap, any_value(min_len) AS min_len
   FROM sg JOIN rl ON rl.kind = sg.kind OR (sg.kind = 'phrase' AND rl.kind = 'strong')
   WHERE NOT (sg.kind = 'phrase' AND EXISTS (SELECT 1 FROM rl i WHERE i.kind = 'ignored' AND i.category = rl.category AND i.phrase = rl.phrase)) GROUP BY ALL),
ht AS (SELECT DISTINCT store_id, signal, category, term, ord, weight, cap FROM tx JOIN tm ON tx.field = tm.field AND contains(tx.x, tm.term) WHERE length(term) >= min_len AND x <> ''),
hs AS (SELECT store_id, category, signal, count(*) AS n, CASE WHEN signal = 'domain' THEN least(12, 8 + (count(*) - 1) * 2) ELSE least(any_value(cap), least(count(*), 3) * any_value(weight)) END AS points,
   signal || ':' || array_to_string(list(term ORDER BY ord, term)[:3], ', ') AS note FROM ht GROUP BY store_id, category, signal),
hc AS (SELECT store_id, category, sum(points) AS raw, count(*) FILTER (signal IN ('domain', 'meta', 'strong_meta')) AS anchors, coalesce(sum(n) FILTER (signal LIKE 'strong%'), 0) AS strong,
   list(note ORDER BY list_position(['domain', 'meta', 'title', 'handle', 'strong_meta', 'strong_title', 'strong_handle'], signal)) AS notes FROM hs GROUP BY ALL),
hp AS (SELECT hc.*, cc, CASE WHEN anchors > 0 THEN 0 WHEN category = 'pet' AND cc >= 120 AND strong < 3 THEN 15 WHEN category = 'bag' AND cc >= 100 AND strong < 2 THEN 10
   WHEN category = 'garden' AND cc >= 80 AND strong < 2 THEN 12 WHEN category = 'auto' AND cc >= 40 AND strong < 2 THEN 12 ELSE 0 END AS penalty FROM hc JOIN st USING (store_id)),
sc AS (SELECT store_id, category, CAST(greatest(0, raw - penalty) AS BIGINT) AS score, array_to_string(notes || CASE WHEN penalty > 0 THEN ['focus_penalty:' || category || '_mixed_store'] ELSE [] END, ';') AS signals FROM hp WHERE raw - penalty > 0),
dm AS (SELECT store_id, category, max(length(term)) AS lo, count(*) AS n, sum(length(term)) AS tot, list(term ORDER BY length(term) DESC, term) AS terms FROM ht WHERE signal = 'domain' GROUP BY ALL),
dr AS (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY lo DESC, n DESC, tot DESC, category) AS rn, count(*) OVER (PARTITION BY store_id, lo, n, tot) AS ties FROM dm),
dd AS (SELECT store_id, category, 'domain_direct:' || array_to_string(terms[:3], ', ') AS matched FROM dr WHERE rn = 1 AND ties = 1),
rk AS (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY score DESC, category) AS rn FROM sc),
bs AS (SELECT a.store_id, a.category AS best, a.score, a.signals, b.category AS second, coalesce(b.score, 0) AS second_score,
   (SELECT count(*) FROM sc x WHERE x.store_id = a.store_id AND x.score = a.score AND x.category IN ('camera', 'electronics')) = 2 AS pair FROM rk a LEFT JOIN rk b ON a.store_id = b.store_id AND b.rn = 2 WHERE a.rn = 1),
jd AS (SELECT st.store_id, dd.category AS direct, dd.matched, bs.*, CASE WHEN d = '' THEN 'invalid_url' WHEN st.store_id % 23 = 5 THEN 'arabic_content' WHEN st.store_id % 11 = 3 AND st.store_id % 2 = 0 THEN 'fetch_failed' WHEN st.store_id % 11 = 3 THEN 'not_shopify'
   WHEN dd.category IS NOT NULL THEN 'classified' WHEN best IS NULL THEN 'no_match' WHEN pair THEN 'classified' WHEN score >= 14 AND score - second_score >= 6 THEN 'classified' ELSE 'low_confidence' END AS status
   FROM st LEFT JOIN dd ON dd.store_id = st.store_id LEFT JOIN bs ON bs.store_id = st.store_id),
cl AS (SELECT store_id, status, CASE WHEN status NOT IN ('classified', 'low_confidence') THEN NULL WHEN direct IS NOT NULL THEN direct WHEN pair THEN 'camera' ELSE best END AS best_category,
   CASE WHEN status NOT IN ('classified', 'low_confidence') THEN NULL WHEN direct IS NOT NULL THEN 100 ELSE score END AS best_score,
   CASE WHEN status NOT IN ('classified', 'low_confidence') THEN NULL WHEN direct IS NOT NULL THEN '' WHEN pair THEN 'electronics' ELSE coalesce(second, '') END AS second_category,
   CASE WHEN status NOT IN ('classified', 'low_confidence') THEN NULL WHEN direct IS NOT NULL THEN 0 WHEN pair THEN score ELSE second_score END AS second_score,
   CASE WHEN status NOT IN ('classified', 'low_confidence') THEN NULL WHEN direct IS NOT NULL THEN matched ELSE signals END AS signals, status = 'classified' AND direct IS NULL AND pair AS tie FROM jd)
""".replace("jd AS (SELECT st.store_id, dd.category AS direct, dd.matched, bs.*,", "jd AS (SELECT st.store_id, dd.category AS direct, dd.matched, bs.best, bs.score, bs.signals, bs.second, bs.second_score, bs.pair,")


@query("score_store", f"WITH {_STORE_SQL} SELECT store_id, category, score, signals FROM sc")
def _(t):
    return T.score_stores(_stores(t), "store_id", t.spark.sql(_RULES)).select("store_id", "category", "score", F.array_join("matched_signals", ";").alias("signals"))


@query("domain_direct", f"WITH {_STORE_SQL} SELECT store_id, category, matched FROM dd")
def _(t):
    return T.domain_direct(_stores(t), "store_id", t.spark.sql(_RULES))


@query("classify_store", f"WITH {_STORE_SQL} SELECT store_id, status, best_category, best_score, second_category, second_score, signals FROM cl")
def _(t):
    found = T.classify_stores(_stores(t), "store_id", t.spark.sql(_RULES))
    return found.select("store_id", "status", "best_category", "best_score", "second_category", "second_score", F.array_join("matched_signals", ";").alias("signals"))


@query("classify_routes", f"WITH {_STORE_SQL} SELECT store_id, unnest(CASE WHEN tie THEN [best_category, second_category] ELSE [best_category] END) AS target FROM cl WHERE status = 'classified'")
def _(t):
    return T.route_stores(T.classify_stores(_stores(t), "store_id", t.spark.sql(_RULES)), "store_id")


@query("classify_status_counts", f"WITH {_STORE_SQL} SELECT status, count(*) AS n FROM cl GROUP BY 1")
def _(t):
    return T.classify_stores(_stores(t), "store_id", t.spark.sql(_RULES)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("best_and_runner_up", f"""
WITH {_STORE_SQL}
SELECT a.store_id, a.category AS best, a.score, coalesce(b.category, '') AS second, a.score - coalesce(b.score, 0) AS margin FROM rk a LEFT JOIN rk b ON a.store_id = b.store_id AND b.rn = 2 WHERE a.rn = 1
""")
def _(t):
    scores = T.score_stores(_stores(t), "store_id", t.spark.sql(_RULES))
    two = T.best_and_runner_up(scores, ["store_id"], [F.col("score").desc(), F.col("category")], "score", ["category"])
    return two.select("store_id", F.col("category").alias("best"), F.col("best_value").alias("score"), F.coalesce("second_name", F.lit("")).alias("second"),
                      (F.col("best_value") - F.coalesce("second_value", F.lit(0))).alias("margin"))


_KEYWORDS = """SELECT * FROM (VALUES ('metal', 'rings'), ('metal', 'bolt'), ('metal', 'red gear wheel'), ('fun', 'games'), ('fun', 'gizmo'), ('fun', 'blue toy box'), ('cheap', 'promotion'), ('cheap', 'eco'),
   ('size', 'smalls'), ('size', 'larger things'), ('rare', 'hot gear'), ('women', '女装')) AS k(category, keyword)"""
_STEMMED = lambda x: _stem_sql(duck.ws(f"regexp_replace(lower({duck.strip(x)}), '[&/,;:\\-•·()（）\\[\\]\\x22“”''’`]+', ' ', 'g')"))


def multi_sql(name: str, texts: str) -> str:
    """CTE ``name(norm, category)`` by brute force over every text and keyword."""
    return f"""
{name}_k AS (SELECT DISTINCT category, {_STEMMED('keyword')} AS kw FROM ({_KEYWORDS})), {name}_t AS (SELECT DISTINCT norm FROM ({texts}) WHERE norm <> ''),
{name}_s AS (SELECT DISTINCT norm, category FROM {name}_t, {name}_k WHERE (regexp_matches(kw, '[a-z]') AND regexp_matches(norm, '(^|[^a-z0-9])' || kw || '([^a-z0-9]|$)')) OR (NOT regexp_matches(kw, '[a-z]') AND contains(norm, kw))),
{name}_w AS (SELECT norm, unnest(list_filter(string_split(norm, ' '), lambda x: x <> '')) AS w FROM {name}_t), {name}_kw AS (SELECT category, kw, len(string_split(kw, ' ')) AS n, unnest(string_split(kw, ' ')) AS k FROM {name}_k),
{name}_l AS (SELECT norm, category, kw, n, count(*) AS pairs FROM {name}_w, {name}_kw WHERE (n = 1 AND length(w) >= 4 AND length(k) >= 4 AND (starts_with(w, k) OR starts_with(k, w) OR rtrim(rtrim(w, 's'), 'e') = rtrim(rtrim(k, 's'), 'e')))
    OR (n > 1 AND (starts_with(w, k) OR starts_with(k, w))) GROUP BY ALL HAVING n = 1 OR count(*) >= greatest(1, n * 0.6)),
{name} AS (SELECT norm, category FROM {name}_s UNION SELECT norm, category FROM {name}_l)
"""


_MULTI = """SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' & ' || p_type WHEN 2 THEN 'Promo ' || p_brand || ' sizes' WHEN 3 THEN p_type || ' toys' WHEN 4 THEN '' ELSE '女装 ' || p_brand END AS label FROM {part}"""


@query("multi_label_keywords", f"WITH src AS (SELECT id, label, {_STEMMED('label')} AS norm FROM ({_MULTI.replace('{part}', 'part')})), {multi_sql('ml', 'SELECT norm FROM src')} SELECT DISTINCT norm, category FROM ml")
def _(t):
    texts = t.sql(_MULTI).select(normalize_text("label", "stem").alias("norm"))
    return M.multi_label(texts, "norm", t.spark.sql(_KEYWORDS))


@query("classify_distinct_join_back", f"""
WITH src AS (SELECT id, label, {_STEMMED('label')} AS norm FROM ({_MULTI.replace('{part}', 'part')})), {multi_sql('ml', 'SELECT norm FROM src')}, g AS (SELECT norm, string_agg(category, ',' ORDER BY category) AS cats FROM ml GROUP BY 1)
SELECT id, coalesce(cats, '') AS categories FROM src LEFT JOIN g USING (norm)
""")
def _(t):
    return M.classify_distinct(t.sql(_MULTI), "label", t.spark.sql(_KEYWORDS)).select("id", F.array_join("categories", ",").alias("categories"))


@query("top_unmatched", f"""
WITH src AS (SELECT id, label, {_STEMMED('label')} AS norm FROM (SELECT p_partkey AS id, p_brand || CASE WHEN p_size % 4 = 0 THEN ' bolt' ELSE ' thing' END AS label FROM part)), {multi_sql('ml', 'SELECT norm FROM src')}
SELECT label, count(*) AS rows FROM src WHERE norm NOT IN (SELECT norm FROM ml) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20
""")
def _(t):
    rows = t.sql("SELECT p_partkey AS id, concat(p_brand, CASE WHEN p_size % 4 = 0 THEN ' bolt' ELSE ' thing' END) AS label FROM {part}")
    return M.top_unmatched(M.classify_distinct(rows, "label", t.spark.sql(_KEYWORDS)), "label")


_ALIASES = "SELECT * FROM (VALUES ('ring', 'Jewelry'), ('bolt', 'Hardware'), ('red gear', 'Hardware'), ('promo', 'Deals'), ('small', 'Mini'), ('economy', 'Budget'), ('gizmo', 'Toys'), ('女装', 'Women')) AS a(alias, target)"
_TABLE_ITEMS = """SELECT p_partkey AS id, CASE p_partkey % 7 WHEN 0 THEN '女装 ' || p_name ELSE p_name || '/' || p_brand END AS title, p_type AS category,
   CASE p_partkey % 4 WHEN 0 THEN 'ring store' WHEN 1 THEN 'Promo_12' WHEN 2 THEN 'small' ELSE 'gizmo-house' END AS source_table, p_name || ' of the ' || p_type AS description FROM {part}"""


def _broad(x: str) -> str:
    return duck.ws(f"regexp_replace(lower({duck.strip(x)}), '[_/&|>\\-:;,()\\[\\].]+', ' ', 'g')")


_MISMATCH_SQL = f"""
al AS ({_ALIASES}), it AS (SELECT *, CASE id % 4 WHEN 0 THEN 'Jewelry' WHEN 1 THEN 'Deals' WHEN 2 THEN 'Mini' ELSE 'Toys' END AS expected, {_broad('title')} AS bt, {_broad('category')} AS bc FROM ({_TABLE_ITEMS.replace('{part}', 'part')})),
hi AS (SELECT DISTINCT id, f, target FROM (SELECT id, 't' AS f, bt AS x FROM it UNION ALL SELECT id, 'c', bc FROM it), al WHERE (regexp_matches(alias, '[a-z]') AND contains(' ' || x || ' ', ' ' || alias || ' ')) OR (NOT regexp_matches(alias, '[a-z]') AND contains(x, alias))),
po AS (SELECT id, target, sum(CASE f WHEN 't' THEN 2 ELSE 3 END) AS s FROM hi GROUP BY ALL), ro AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, target) AS rn FROM po),
ju AS (SELECT it.id, expected, a.target AS predicted, a.s AS top, coalesce(b.s, 0) AS second, coalesce(e.s, 0) AS es,
   EXISTS (SELECT 1 FROM hi WHERE hi.id = it.id AND f = 't' AND target = expected) AS in_t, EXISTS (SELECT 1 FROM hi WHERE hi.id = it.id AND f = 'c' AND target = expected) AS in_c
   FROM it JOIN ro a ON a.id = it.id AND a.rn = 1 LEFT JOIN ro b ON b.id = it.id AND b.rn = 2 LEFT JOIN po e ON e.id = it.id AND e.target = expected),
mm AS (SELECT *, predicted = expected OR (in_c AND es >= 3) OR es >= 4 OR (in_t AND es >= greatest(top - 1, 3)) OR (in_c AND es >= top - 1) AS pass FROM ju),
mi AS (SELECT id, expected, predicted, CAST(top AS BIGINT) AS top_score, CAST(second AS BIGINT) AS second_score FROM mm WHERE NOT pass AND top >= 3 AND top - second >= 1 AND es < 3)
"""


def _expected_items(t):
    return G.resolve_expected(t.sql(_TABLE_ITEMS), "source_table", t.spark.sql(_ALIASES))


@query("mismatch_scan", f"WITH {_MISMATCH_SQL} SELECT id, expected, predicted, top_score, second_score FROM mi")
def _(t):
    return M.mismatch_scan(_expected_items(t), "id", t.spark.sql(_ALIASES)).select("id", "expected", "predicted", "top_score", "second_score")


def judge_sql(name: str, hits: str) -> str:
    """CTE ``name``: best, second and expected score per row of ``hits(id, f, target)``."""
    return f"""
{name}_h AS ({hits}), {name}_p AS (SELECT id, target, sum(CASE f WHEN 't' THEN 2 WHEN 'c' THEN 3 ELSE 1 END) AS s FROM {name}_h GROUP BY ALL),
{name}_r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, target) AS rn FROM {name}_p),
{name} AS (SELECT it.id, expected, a.target AS predicted, a.s AS top, coalesce(b.s, 0) AS second, coalesce(e.s, 0) AS es,
   EXISTS (SELECT 1 FROM {name}_h h WHERE h.id = it.id AND f = 't' AND target = expected) AS in_t, EXISTS (SELECT 1 FROM {name}_h h WHERE h.id = it.id AND f = 'c' AND target = expected) AS in_c
   FROM it JOIN {name}_r a ON a.id = it.id AND a.rn = 1 LEFT JOIN {name}_r b ON b.id = it.id AND b.rn = 2 LEFT JOIN {name}_p e ON e.id = it.id AND e.target = expected)
"""


_PASS = "(predicted = expected OR (in_c AND es >= 3) OR es >= 4 OR (in_t AND es >= greatest(top - 1, 3)) OR (in_c AND es >= top - 1))"
_HEAVY_SQL = f"""
{_MISMATCH_SQL},
hv AS (SELECT id FROM mm WHERE NOT pass AND predicted <> expected AND NOT in_c AND top >= 3 AND top - second >= 1 AND es < top),
nx AS (SELECT id, f, {_STEMMED('x')} AS norm FROM (SELECT id, 't' AS f, title AS x FROM it UNION ALL SELECT id, 'c', category FROM it UNION ALL SELECT id, 'd', description FROM it) WHERE id IN (SELECT id FROM hv)),
{multi_sql('hm', 'SELECT norm FROM nx')},
{judge_sql('pj', "SELECT id, f, hm.category AS target FROM nx JOIN hm USING (norm) WHERE f <> 'd'")},
rf AS (SELECT id FROM pj WHERE NOT {_PASS} AND predicted <> expected AND top >= 3 AND top - second >= 1 AND es < top AND NOT (in_c AND es >= 3)),
dn AS (SELECT norm FROM hm GROUP BY 1 HAVING count(*) <= 4),
{judge_sql('dj', "SELECT id, f, hm.category AS target FROM nx JOIN hm USING (norm) WHERE id IN (SELECT id FROM rf) AND (f <> 'd' OR norm IN (SELECT norm FROM dn))")}
"""


@query("mismatch_scan_heavy", f"""WITH {_HEAVY_SQL}
SELECT id, expected, predicted, CAST(top AS BIGINT) AS top_score, CAST(second AS BIGINT) AS second_score FROM dj WHERE predicted <> expected AND NOT in_t AND NOT in_c AND top >= 3 AND top - second >= 1 AND es < top - 1""")
def _(t):
    return M.mismatch_scan(_expected_items(t), "id", t.spark.sql(_ALIASES), t.spark.sql(_KEYWORDS), quick=False).select("id", "expected", "predicted", "top_score", "second_score")


@query("mismatch_scan_rules", f"""WITH {_MISMATCH_SQL},
un AS (SELECT id FROM mm WHERE NOT pass AND id NOT IN (SELECT id FROM mi)),
dx AS (SELECT id, {_STEMMED('description')} AS norm FROM it WHERE id IN (SELECT id FROM un)), {multi_sql('dm', 'SELECT norm FROM dx')},
dk AS (SELECT norm FROM dm GROUP BY 1 HAVING count(*) <= 4),
{judge_sql('qj', "SELECT id, f, target FROM hi WHERE id IN (SELECT id FROM un) UNION ALL SELECT id, 'd', dm.category FROM dx JOIN dm USING (norm) WHERE norm IN (SELECT norm FROM dk)")}
SELECT id, expected, predicted, top_score, second_score FROM mi
UNION ALL SELECT id, expected, predicted, CAST(top AS BIGINT), CAST(second AS BIGINT) FROM qj WHERE NOT {_PASS} AND top >= 3 AND top - second >= 1 AND es < 3""")
def _(t):
    return M.mismatch_scan(_expected_items(t), "id", t.spark.sql(_ALIASES), t.spark.sql(_KEYWORDS)).select("id", "expected", "predicted", "top_score", "second_score")


@query("relocate_mismatches", f"""
WITH {_MISMATCH_SQL}
SELECT it.id, CASE WHEN mi.id IS NULL THEN source_table WHEN predicted = 'Jewelry' AND source_table <> 'ring store' THEN 'ring store' WHEN predicted = 'Mini' AND source_table <> 'small' THEN 'small' WHEN predicted = 'Deals' AND source_table <> 'Promo_12' THEN 'Promo_12'
       WHEN predicted = 'Toys' AND source_table <> 'gizmo-house' THEN 'gizmo-house' ELSE lower(predicted) END AS table_name, mi.id IS NOT NULL AS moved FROM it LEFT JOIN mi ON mi.id = it.id
""")
def _(t):
    items = _expected_items(t)
    found = M.mismatch_scan(items, "id", t.spark.sql(_ALIASES)).select("id", "predicted")
    marked = cut_lineage(items.join(found, "id", "left"))
    tables = marked.select(F.col("source_table").alias("name")).distinct()
    no_preference = t.spark.createDataFrame([], "category string, ord int, name string")
    moves = marked.where("predicted IS NOT NULL").select(F.col("predicted").alias("category"), "source_table")
    targets = G.resolve_targets(moves, tables, t.spark.sql(_ALIASES), no_preference).withColumnRenamed("category", "predicted")
    placed = marked.join(targets, ["predicted", "source_table"], "left")
    return placed.select("id", F.coalesce("table_name", "source_table").alias("table_name"), F.col("predicted").isNotNull().alias("moved"))


@query("delete_mismatches", f"WITH {_MISMATCH_SQL} SELECT it.id, CASE WHEN mi.id IS NULL THEN 'kept' ELSE 'moved' END AS half, predicted AS keyword FROM it LEFT JOIN mi ON mi.id = it.id")
def _(t):
    items = _expected_items(t)
    found = M.mismatch_scan(items, "id", t.spark.sql(_ALIASES)).select("id", "predicted")
    marked = K.with_verdict(items.join(found, "id", "left"), F.col("predicted").isNotNull(), F.lit("wrong_category"), "catalog", F.current_timestamp(), F.lit("category"), F.col("predicted"))
    kept, moved = K.move_with_backup(marked, scratch_path(t.spark, "mismatch"))
    none = F.lit(None).cast("string")
    return kept.select("id", F.lit("kept").alias("half"), none.alias("keyword")).unionByName(moved.select("id", F.lit("moved").alias("half"), F.col("match_keyword").alias("keyword")))


_FILL_RULES = """SELECT * FROM (VALUES (0, 'A', 'a1', NULL, 'orre'), (1, 'A', 'a2', 'x', 'rewh rewh'), (2, 'B', 'b1', NULL, 'hehely'), (3, 'B', 'b2', NULL, 'the of'), (4, 'C', 'c1', 'z', 'worthless')) AS r(rule_order, level1, level2, level3, keyword)"""


@query("fill_blank_category", f"""
WITH r AS ({_FILL_RULES}), p AS (SELECT product_id, lower(title || ' ' || description) AS x FROM v_product WHERE trim(category) = ''),
 h AS (SELECT product_id, min(rule_order) AS o FROM p, r WHERE contains(x, lower(keyword)) GROUP BY 1)
SELECT p.product_id, f.level1 || '|||' || f.level2 || CASE WHEN f.level3 IS NOT NULL THEN '|||' || f.level3 ELSE '' END || '|||' || f.keyword AS new_category, h.o IS NOT NULL AS by_rule
FROM p LEFT JOIN h USING (product_id) JOIN r f ON f.rule_order = coalesce(h.o, p.product_id % 5)
""")
def _(t):
    rules = t.spark.sql(_FILL_RULES)
    return M.fill_blank_category(t.v_product, "product_id", rules, "product_id").select("product_id", "new_category", "by_rule")


_LINES = "SELECT DISTINCT p_type || ' > ' || p_name AS line FROM {part} WHERE p_size % 3 = 0"
_NAMES = "SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN p_name || ' ' || lower(p_type) WHEN 1 THEN lower(p_type) || 's ' || p_name WHEN 2 THEN p_name ELSE substring(p_name, 1, 3) || ' ' || p_type END AS name FROM {part}"


@query("taxonomy_best_line", f"""
WITH n AS ({_NAMES.replace('{part}', 'part')}), l AS ({_LINES.replace('{part}', 'part')}), p AS (SELECT name, line, array_to_string(list_sort({tok('name')}), ' ') AS a, array_to_string(list_sort({tok('line')}), ' ') AS b FROM n, l),
 s AS (SELECT name, line, {ratio_sql('a', 'b')} AS score FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY round(score, 9) DESC, line) AS rn FROM s WHERE score >= 80)
SELECT n.name, coalesce(trim(split_part(line, '>', 1)), 'other') AS top FROM n LEFT JOIN r ON r.name = n.name AND rn = 1
""")
def _(t):
    names, lines = t.sql(_NAMES), t.sql(_LINES)
    best = Z.best_line(names, "name", lines, "line")
    return names.join(best, "name", "left").select("name", F.coalesce(F.trim(F.substring_index("line", ">", 1)), F.lit("other")).alias("top"))


_PHRASES = "SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_name || 'x' ELSE replace(p_name, 'e', 'y') END AS phrase FROM {part} WHERE p_size = 9"


@query("strong_phrase_match", f"""
WITH k AS ({_PHRASES.replace('{part}', 'part')}), t AS (SELECT DISTINCT p_name || CASE WHEN p_partkey % 2 = 0 THEN '!' ELSE ' ' || p_type END AS title FROM part),
 m AS (SELECT title, trim(replace(lower(title), '!', ' ')) AS x FROM t), l AS (SELECT DISTINCT lower(phrase) AS phrase FROM k)
SELECT title, bool_or((length(phrase) >= 3 AND contains(x, phrase)) OR (length(phrase) >= 5 AND {ratio_sql('x', 'phrase')} >= 88)) AS hit FROM m, l GROUP BY 1
""")
def _(t):
    titles = t.sql("SELECT DISTINCT concat(p_name, CASE WHEN p_partkey % 2 = 0 THEN '!' ELSE concat(' ', p_type) END) AS title FROM {part}")
    hit = Z.strong_matches(titles, "title", t.sql(_PHRASES)).withColumn("hit", F.lit(True))
    return titles.join(hit, "title", "left").select("title", F.coalesce("hit", F.lit(False)).alias("hit"))


@query("domain_matches", r"""
WITH d AS (SELECT DISTINCT url, regexp_replace(regexp_replace(split_part(split_part(regexp_replace(lower(url), '^https?://(www\.)?', ''), '/', 1), '?', 1),
     '\.(com|net|org|co\.uk|shop|store|ca|au|us|io).*', ''), '[^\p{L}\p{N}_]', '', 'g') AS name FROM pages)
SELECT url FROM d WHERE contains(name, 'blog') OR contains(name, 'tionsh')
""")
def _(t):
    words = t.spark.sql("SELECT explode(array('Blog', 'tionshs', 'nowheres')) AS keyword")
    return Z.domain_matches(t.pages, "url", words)
