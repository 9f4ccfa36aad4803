"""Look-ups, anti joins, stage moves, hierarchies and nearest categories."""

from __future__ import annotations

from pyspark.sql import functions as F

from merchloom.functions import categories as C
from merchloom.functions import urls as U
from merchloom.operators import keyed as Y
from merchloom.operators import semantic, taxonomy
from merchloom.operators import targets as G
from suite import duck, query


@query("anti_existing", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(t):
    return Y.not_stored(t.documents.select("doc_id", "source"), t.labels, ["doc_id"])


@query("blacklist_exclude", r"SELECT page_id, raw_url, stage FROM v_url WHERE rtrim(raw_url, '/') NOT IN (SELECT rtrim(raw_url, '/') FROM v_url WHERE page_id % 8 = 3)")
def _(t):
    banned = t.v_url.where("page_id % 8 = 3").select(F.concat(F.lit(" "), "raw_url", F.lit("/")).alias("url"))
    return Y.exclude_blacklisted(t.v_url, "raw_url", banned).select("page_id", "raw_url", "stage")


_RATES = "SELECT * FROM (VALUES ('USD', 1.0), ('EUR', 1.25), ('GBP', 1.5)) AS r(code, rate)"


@query("currency_lookup", f"""
WITH r AS ({_RATES}) SELECT product_id, CASE WHEN rate IS NULL THEN 'quarantine' ELSE 'priced' END AS half, floor(original_price * rate * 10 + 0.5) / 10 AS usd FROM v_product LEFT JOIN r ON code = currency
""")
def _(t):
    rates = t.spark.sql(_RATES).withColumn("rate", F.col("rate").cast("double"))
    priced, unknown = Y.with_rate(t.v_product.select("product_id", "original_price", "currency"), rates, "currency")
    usd = U.convert_price("original_price", "rate")
    return priced.select("product_id", F.lit("priced").alias("half"), (F.floor(usd * 10 + 0.5) / 10).alias("usd")).unionByName(
        unknown.select("product_id", F.lit("quarantine").alias("half"), F.lit(None).cast("double").alias("usd")))


@query("taxonomy_word_overlap", """
WITH n AS (SELECT DISTINCT lower(p_name) AS node FROM part WHERE p_size = 3), w AS (SELECT DISTINCT unnest(list_filter(string_split(node, ' '), lambda x: length(x) >= 3 AND x NOT IN ('all','the','and','for','with','new','sale','shop','best','top'))) AS w FROM n),
     t AS (SELECT doc_id, lower(trim(text) || ' ' || p_name) AS title FROM documents JOIN part ON p_partkey = doc_id)
SELECT doc_id, title IN (SELECT node FROM n) OR len(list_intersect(regexp_split_to_array(title, '\\s+'), (SELECT list(w) FROM w))) > 0 AS hit FROM t
""")
def _(t):
    nodes = t.sql("SELECT DISTINCT p_name AS node FROM {part} WHERE p_size = 3")
    titles = t.sql("SELECT doc_id, concat(trim(text), ' ', p_name) AS title FROM {documents} JOIN {part} ON p_partkey = doc_id")
    return taxonomy.overlap_flag(titles, "title", nodes).select("doc_id", "hit")


@query("merge_map_apply", """
SELECT product_id, CASE WHEN lower(regexp_replace(category, 's$', '')) IN ('promo', 'small') THEN 'Merged' ELSE category END AS category FROM v_product
""")
def _(t):
    mapping = t.spark.sql("SELECT * FROM (VALUES ('promo', 'Merged'), ('small', 'Merged')) AS m(cat_key, target)")
    keyed = t.v_product.select("product_id", "category", C.category_key("category").alias("cat_key"))
    return Y.label_or_key(keyed, mapping, "cat_key", "target", "category").select("product_id", F.col("target").alias("category"))


@query("nav_category_join", """
WITH l AS (SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS rn FROM lineitem)
SELECT p_partkey, 'menu' || l_suppkey AS level1, 'sub' || l_linenumber AS level2 FROM part LEFT JOIN l ON l_partkey = p_partkey AND rn = 1
""")
def _(t):
    listings = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"), F.concat(F.lit("menu"), "l_suppkey").alias("level1"), F.concat(F.lit("sub"), "l_linenumber").alias("level2"))
    first = Y.first_listing(listings, "p_partkey", [F.col("l_orderkey"), F.col("l_linenumber")], ["level1", "level2"])
    return t.part.select("p_partkey").join(first, "p_partkey", "left")


_ALIAS = "SELECT * FROM (VALUES ('promo', 'Deals'), ('promo brand 1', 'House'), ('ring', 'Jewelry'), ('女装', 'Women'), ('small', 'Mini'), ('large bolt', 'Hardware')) AS a(alias, target)"


@query("alias_longest_first", f"""
WITH a AS ({_ALIAS}), n AS (SELECT id, {duck.strip("regexp_replace(" + duck.ws("translate(lower(raw), '_-&/', '    ')") + ", '[0-9]+$', '')")} AS name FROM v_rawcat),
     h AS (SELECT id, target, row_number() OVER (PARTITION BY id ORDER BY name = alias DESC, length(alias) DESC, alias) AS rn FROM n, a
           WHERE name = alias OR (regexp_matches(alias, '[a-z]') AND contains(' ' || name || ' ', ' ' || alias || ' ')) OR (NOT regexp_matches(alias, '[a-z]') AND name <> '' AND (contains(name, alias) OR contains(alias, name))))
SELECT n.id, coalesce(target, '') AS expected FROM n LEFT JOIN h ON n.id = h.id AND rn = 1
""")
def _(t):
    return G.resolve_expected(t.v_rawcat, "raw", t.spark.sql(_ALIAS)).select("id", "expected")


@query("target_table_resolve", """
WITH tables AS (SELECT DISTINCT p_type || CASE WHEN p_size % 2 = 0 THEN '_' || p_size ELSE '' END AS name FROM part WHERE p_type <> 'MEDIUM'),
     alias AS (SELECT * FROM (VALUES ('promo', 'promo'), ('small', 'small'), ('economy', 'economy'), ('large', 'big things'), ('standard', 'standard')) AS a(alias, target)),
     preferred AS (SELECT * FROM (VALUES ('small', 1, 'SMALL_44'), ('small', 2, 'SMALL_10'), ('gone', 1, 'Gone_Table')) AS p(category, ord, name)),
     wanted AS (SELECT DISTINCT category FROM (SELECT unnest(['promo', 'small', 'economy', 'big things', 'gone', 'No Such & Thing']) AS category)),
     pref AS (SELECT w.category, t.name, row_number() OVER (PARTITION BY w.category ORDER BY ord) AS rn FROM wanted w JOIN preferred p ON p.category = w.category JOIN tables t ON lower(t.name) = lower(p.name) WHERE t.name <> 'PROMO'),
     cand AS (SELECT a.target AS category, t.name, CASE WHEN trim(regexp_replace(replace(lower(t.name), '_', ' '), '[0-9]+$', '')) = a.target THEN 100 ELSE 0 END + 10 + CASE WHEN contains(t.name, '_') THEN 5 ELSE 0 END + least(length(t.name), 30) AS score
              FROM tables t JOIN alias a ON a.alias = trim(regexp_replace(replace(lower(t.name), '_', ' '), '[0-9]+$', '')) WHERE t.name <> 'PROMO'),
     best AS (SELECT category, name, row_number() OVER (PARTITION BY category ORDER BY score DESC, lower(name)) AS rn FROM cand)
SELECT w.category, coalesce(p.name, b.name, (SELECT name FROM preferred x WHERE x.category = w.category ORDER BY ord LIMIT 1), trim(regexp_replace(lower(w.category), '[^a-z0-9]+', '_', 'g'), '_')) AS table_name
FROM wanted w LEFT JOIN pref p ON p.category = w.category AND p.rn = 1 LEFT JOIN best b ON b.category = w.category AND b.rn = 1
""")
def _(t):
    tables = t.sql("SELECT DISTINCT concat(p_type, CASE WHEN p_size % 2 = 0 THEN concat('_', p_size) ELSE '' END) AS name FROM {part} WHERE p_type <> 'MEDIUM'")
    alias = t.spark.sql("SELECT * FROM (VALUES ('promo', 'promo'), ('small', 'small'), ('economy', 'economy'), ('large', 'big things'), ('standard', 'standard')) AS a(alias, target)")
    preferred = t.spark.sql("SELECT * FROM (VALUES ('small', 1, 'SMALL_44'), ('small', 2, 'SMALL_10'), ('gone', 1, 'Gone_Table')) AS p(category, ord, name)")
    wanted = t.spark.sql("SELECT explode(array('promo', 'small', 'economy', 'big things', 'gone', 'No Such & Thing')) AS category")
    return G.resolve_targets(wanted.withColumn("source_table", F.lit("PROMO")), tables, alias, preferred).select("category", "table_name")


@query("parent_lookup", """
WITH RECURSIVE n AS (SELECT 'r' || r_regionkey AS id, NULL AS parent, r_name AS name FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation
     UNION ALL SELECT 'c' || c_custkey, CASE WHEN c_custkey % 50 = 0 THEN 'lost' ELSE 'n' || c_nationkey END, c_name FROM customer
     UNION ALL SELECT 's' || s_suppkey, CASE WHEN s_suppkey % 25 <> 1 THEN 's' || (s_suppkey - 1) END, s_name FROM supplier),
 w AS (SELECT id, name AS path, 1 AS depth FROM n WHERE parent IS NULL UNION ALL SELECT n.id, w.path || ' > ' || n.name, depth + 1 FROM n JOIN w ON n.parent = w.id)
SELECT id, path, depth FROM w
""")
def _(t):
    nodes = t.sql("""SELECT concat('r', r_regionkey) AS id, CAST(NULL AS STRING) AS parent, r_name AS name FROM {region} UNION ALL SELECT concat('n', n_nationkey), concat('r', n_regionkey), n_name FROM {nation}
                     UNION ALL SELECT concat('c', c_custkey), CASE WHEN c_custkey % 50 = 0 THEN 'lost' ELSE concat('n', c_nationkey) END, c_name FROM {customer}""")
    chain = t.sql("SELECT concat('s', s_suppkey) AS id, CASE WHEN s_suppkey % 25 <> 1 THEN concat('s', s_suppkey - 1) END AS parent, s_name AS name FROM {supplier}")
    return taxonomy.parent_paths(nodes.unionByName(chain))


@query("stage_move", r"""
WITH u AS (SELECT page_id, category, stage, regexp_replace(lower(regexp_extract(raw_url, '^https?://([^/?#]+)', 1)), '^www\.', '') AS domain FROM v_url),
     f AS (SELECT category, domain, count(*) AS products FROM u WHERE page_id % 2 = 0 GROUP BY ALL)
SELECT page_id, u.category, u.domain, CASE WHEN products IS NOT NULL AND stage = 'unfiltered' THEN 'filtered' ELSE stage END AS stage, CASE WHEN stage = 'unfiltered' THEN products END AS products
FROM u LEFT JOIN f ON u.category = f.category AND u.domain = f.domain
""")
def _(t):
    urls = t.v_url.select("page_id", "category", U.extract_domain("raw_url").alias("domain"), "stage")
    facts = urls.where("page_id % 2 = 0").groupBy("category", "domain").agg(F.count(F.lit(1)).alias("products"))
    return Y.move_stage(urls, facts, "unfiltered", "filtered")


@query("path_hierarchy_counts", """
WITH p AS (SELECT CASE WHEN p_size % 3 = 0 THEN p_type WHEN p_size % 3 = 1 THEN p_type || '|||' || p_brand ELSE p_brand || '|||' || p_type || '|||' || p_name END AS path FROM part WHERE p_type <> 'PROMO' OR p_size % 3 = 0),
     c AS (SELECT path, string_split(path, '|||') AS s, count(*) AS n FROM p GROUP BY ALL),
     l AS (SELECT array_to_string(s[:k], '|||') AS node, CASE WHEN k > 1 THEN array_to_string(s[:k-1], '|||') END AS parent, k AS level, n, k = len(s) AS leaf FROM (SELECT s, n, unnest(range(1, len(s) + 1)) AS k FROM c))
SELECT node, parent, level, CAST(sum(n) AS BIGINT) AS total, CAST(sum(CASE WHEN leaf THEN n ELSE 0 END) AS BIGINT) AS own, CASE WHEN parent IS NOT NULL THEN 'child' WHEN bool_or(NOT leaf) THEN 'parent' ELSE 'flat' END AS kind FROM l GROUP BY node, parent, level
""")
def _(t):
    paths = t.sql("""SELECT CASE WHEN p_size % 3 = 0 THEN p_type WHEN p_size % 3 = 1 THEN concat(p_type, '|||', p_brand) ELSE concat(p_brand, '|||', p_type, '|||', p_name) END AS path
                     FROM {part} WHERE p_type <> 'PROMO' OR p_size % 3 = 0""")
    return taxonomy.level_counts(paths, "path")


_CENTROID_SQL = """
d AS (SELECT vec_id, label, unnest(embedding) AS x, unnest(range(1, 65)) AS i FROM embeddings),
c AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS x FROM d GROUP BY ALL),
cn AS (SELECT label, sqrt(sum(x * x)) AS n FROM c GROUP BY 1), vn AS (SELECT vec_id, sqrt(sum(CAST(x AS DOUBLE) * x)) AS n FROM d GROUP BY 1),
s AS (SELECT d.vec_id, c.label, sum(CAST(d.x AS DOUBLE) * c.x) / any_value(cn.n) / any_value(vn.n) AS sim FROM d JOIN c ON c.i = d.i JOIN cn ON cn.label = c.label JOIN vn ON vn.vec_id = d.vec_id GROUP BY d.vec_id, c.label)
"""


@query("semantic_nearest", f"""
WITH {_CENTROID_SQL}
SELECT vec_id, label AS nearest, round(sim, 4) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(sim, 9) DESC, label) AS rn FROM s) WHERE rn = 1
""")
def _(t):
    index = semantic.centroids(t.embeddings, "label", "embedding")
    best = semantic.nearest(t.embeddings.select("vec_id", "embedding"), "vec_id", "embedding", index, "label", "vector")
    return best.select("vec_id", F.col("label").alias("nearest"), F.round("similarity", 4).alias("similarity"))


@query("semantic_category", f"""
WITH {_CENTROID_SQL},
 p AS (SELECT v.vec_id, m.label AS main, k.label AS sub, m.sim AS main_sim, k.sim AS path_sim, (m.sim + k.sim) / 2 AS score, CASE WHEN k.label % 2 = 0 THEN 2 ELSE 1 END AS depth
       FROM embeddings v JOIN s m ON m.vec_id = v.vec_id AND m.label < 5 AND m.sim >= 0.1 JOIN s k ON k.vec_id = v.vec_id AND k.label % 5 = m.label),
 r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY CASE WHEN path_sim >= 0.3 THEN depth ELSE 0 END DESC, round(score, 9) DESC, main, sub) AS rn FROM p)
SELECT e.vec_id, coalesce('m' || main || '|||' || 'p' || sub, 'Others') AS category FROM embeddings e LEFT JOIN r ON r.vec_id = e.vec_id AND rn = 1
""")
def _(t):
    index = semantic.centroids(t.embeddings, "label", "embedding")
    mains = index.where("label < 5").select(F.concat(F.lit("m"), "label").alias("main"), "vector")
    paths = index.select(F.concat(F.lit("m"), F.col("label") % 5).alias("main"), F.concat(F.lit("p"), "label").alias("path"), F.when(F.col("label") % 2 == 0, 2).otherwise(1).alias("depth"), "vector")
    return semantic.classify(t.embeddings.select("vec_id", "embedding"), "vec_id", "embedding", mains, paths, 0.1, 0.3).select("vec_id", "category")
