"""Category clean-up, merging and counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from merchloom.functions import categories as C
from merchloom.operators import category_merge as M
from suite import duck, query
from suite.text import _PATH_SQL, _SING_STRICT

S = duck.strip


def key_sql(source: str, column: str, out: str) -> str:
    """CTE ``out(column, cat_key)`` with the category key of every distinct value."""
    return f"""
{out}_p AS (SELECT c, unnest(parts) AS part, unnest(range(1, len(parts) + 1)) AS part_no FROM (
   SELECT c, list_filter(list_transform(string_split(c, '|||'), lambda x: {S('x')}), lambda x: x <> '') AS parts FROM (SELECT DISTINCT {column} AS c FROM {source}))),
{out}_w AS (SELECT c, part, part_no, unnest(CASE WHEN len(t) = 0 THEN [NULL] ELSE t END) AS w, unnest(range(1, greatest(len(t), 1) + 1)) AS n FROM (SELECT *, regexp_extract_all(lower(part), '[a-z0-9]+') AS t FROM {out}_p)),
{out}_k AS (SELECT c, part_no, coalesce(string_agg({_SING_STRICT}, ' ' ORDER BY n), lower(any_value(part))) AS k FROM {out}_w GROUP BY c, part_no),
{out} AS (SELECT c, string_agg(k, '|||' ORDER BY part_no) AS cat_key FROM {out}_k GROUP BY c)
"""


_CLEAN = f"""
{_PATH_SQL},
{key_sql('cleaned', 'category', 'ck')},
rows AS (SELECT id, raw, category, coalesce(nullif(cat_key, ''), 'other') AS cat_key FROM cleaned LEFT JOIN ck ON ck.c = category),
spell AS (SELECT cat_key, category, count(*) AS n FROM rows WHERE category <> 'DROP_ROW' GROUP BY ALL),
reps AS (SELECT cat_key, CAST(sum(n) AS BIGINT) AS rows, first(category ORDER BY n DESC, category) AS representative FROM spell GROUP BY cat_key)
"""


@query("clean_category", f"WITH {_CLEAN} SELECT id, category AS clean_category, cat_key FROM rows")
def _(t):
    return M.with_clean_category(t.v_rawcat, "raw").select("id", "clean_category", "cat_key")


@query("category_representative", f"WITH {_CLEAN} SELECT cat_key, rows, representative FROM reps")
def _(t):
    return M.representatives(M.with_clean_category(t.v_rawcat, "raw").where("clean_category <> 'DROP_ROW'"))


@query("small_categories", "SELECT p_brand || ' ' || p_type AS category, count(*) AS rows FROM part GROUP BY 1 HAVING count(*) < 12")
def _(t):
    return M.small_categories(t.part.withColumn("c", F.concat_ws(" ", "p_brand", "p_type")), "c", 12)


def best_sql(small: str, large: str) -> str:
    """CTE ``best(category, target)``: brute force over all pairs of distinct categories."""
    return f"""
sm AS (SELECT DISTINCT category FROM ({small})), lg AS (SELECT DISTINCT category AS target FROM ({large})),
{key_sql('sm', 'category', 'sk')}, {key_sql('lg', 'target', 'lk')},
pair AS (SELECT s.c AS category, l.c AS target, s.cat_key AS sk, l.cat_key AS lk, trim(replace(s.cat_key, '|||', ' ')) AS sc, trim(replace(l.cat_key, '|||', ' ')) AS lc FROM sk s, lk l WHERE s.cat_key <> '' AND l.cat_key <> ''),
pw AS (SELECT *, list_distinct(string_split(sc, ' ')) AS sw, list_distinct(string_split(lc, ' ')) AS lw FROM pair),
ps AS (SELECT *, len(list_intersect(sw, lw)) / len(list_distinct(list_concat(sw, lw))) * (0.75 + 0.25 * least(len(sw), len(lw)) / greatest(len(sw), len(lw))) AS wscore,
          (1 - levenshtein(sc, lc) / greatest(length(sc), length(lc))) * 100 AS lscore FROM pw),
pt AS (SELECT *, CASE WHEN sk = lk THEN 1 WHEN contains(lk, sk) OR starts_with(lc, sc || ' ') THEN 2 WHEN wscore >= 0.40 THEN 3 WHEN lscore >= 62 THEN 4 END AS tier FROM ps),
pr AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY tier, round(CASE WHEN tier = 3 THEN wscore WHEN tier = 4 THEN lscore ELSE 0 END, 9) DESC, target) AS rn FROM pt WHERE tier IS NOT NULL),
best AS (SELECT sm.category, coalesce(target, 'Other') AS target FROM sm LEFT JOIN pr ON pr.category = sm.category AND rn = 1)
"""


_SMALL = """SELECT CASE p_partkey % 6 WHEN 0 THEN p_name || 's' WHEN 1 THEN upper(p_type) WHEN 2 THEN replace(p_name, 'e', 'o') WHEN 3 THEN p_name || '|||' || p_type WHEN 4 THEN substring(p_name, 2, 4)
            ELSE 'x' || p_name || 'q' END AS category FROM {part} UNION SELECT '|||'"""
_LARGE = "SELECT CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_type || '|||' || p_name ELSE p_name || ' set' END AS category FROM {part} WHERE p_size < 15"


@query("best_category", "WITH " + best_sql(_SMALL.replace("{part}", "part"), _LARGE.replace("{part}", "part")) + " SELECT category, target FROM best")
def _(t):
    return M.best_category(t.sql(_SMALL), t.sql(_LARGE))


@query("best_category_match", "WITH " + best_sql("SELECT DISTINCT p_brand || ' ' || p_name AS category FROM part", "SELECT DISTINCT p_name AS category FROM part WHERE p_size % 2 = 0")
       + " SELECT target, count(*) AS n FROM best GROUP BY 1")
def _(t):
    small = t.sql("SELECT DISTINCT concat(p_brand, ' ', p_name) AS category FROM {part}")
    large = t.sql("SELECT DISTINCT p_name AS category FROM {part} WHERE p_size % 2 = 0")
    return M.best_category(small, large).groupBy("target").agg(F.count(F.lit(1)).alias("n"))


@query("category_cleanup", f"""
WITH {_CLEAN},
{best_sql("SELECT representative AS category FROM reps WHERE rows < 30 AND representative <> 'Other'", "SELECT representative AS category FROM reps WHERE rows >= 30 AND representative <> 'Other'")},
mm AS (SELECT cat_key, target FROM reps JOIN best ON best.category = representative WHERE rows < 30 AND representative <> 'Other' AND target <> 'Other' AND target <> representative)
SELECT id, coalesce(target, category) AS category FROM rows LEFT JOIN mm ON mm.cat_key = rows.cat_key WHERE category <> 'DROP_ROW'
""")
def _(t):
    return M.clean_and_merge(t.v_rawcat, "raw", 30).select("id", F.col("raw").alias("category"))


@query("category_merge", """
WITH c AS (SELECT p_partkey, p_brand || ' ' || p_type AS c FROM part), s AS (SELECT c, count(*) AS n FROM c GROUP BY 1)
SELECT p_partkey, CASE WHEN n < 12 THEN 'Other' ELSE c END AS merged,
       CASE WHEN n < 12 THEN ['Best Seller','Featured','Accessories','Other','New Arrival','Exclusive','Limited Edition','Hot Sale','Most Popular','Trending','Special Offer','Flash Sale'][p_partkey % 12 + 1] ELSE c END AS public FROM c JOIN s USING (c)
""")
def _(t):
    rows = t.part.select("p_partkey", F.concat_ws(" ", "p_brand", "p_type").alias("merged")).withColumn("public", F.col("merged"))
    return M.relabel_small(M.relabel_small(rows, "merged", 12), "public", 12, None, "p_partkey")


@query("category_merge_statistics", """
WITH c AS (SELECT p_brand || ' ' || p_type AS c FROM part), s AS (SELECT c, count(*) AS n FROM c GROUP BY 1)
SELECT 'before' AS step, count(*) AS rows, count(DISTINCT c) AS categories FROM c UNION ALL SELECT 'after', count(*), count(DISTINCT CASE WHEN n < 12 THEN 'Other' ELSE c END) FROM c JOIN s USING (c)
""")
def _(t):
    rows = t.part.select("p_partkey", F.concat_ws(" ", "p_brand", "p_type").alias("c"))
    return M.merge_statistics(rows, M.relabel_small(rows, "c", 12), "c")


@query("reason_counts", f"""
SELECT CASE WHEN {S('title')} = '' OR {S('description')} = '' THEN 'empty' WHEN length({S('description')}) < 30 THEN 'short_desc' WHEN length({S('title')}) < 15 THEN 'short_title'
       WHEN regexp_matches({S('title')}, '^\\s*[0-9]+\\s*$') THEN 'numeric_title' WHEN coalesce(discount_price, original_price) NOT BETWEEN 3 AND 6000 THEN 'bad_price' ELSE '' END AS reason, count(*) AS rows FROM v_product GROUP BY 1
""")
def _(t):
    from merchloom.operators import rules as R
    reason = R.basic_reject_reason("title", "description", ["discount_price", "original_price"], R.PROFILES["strict"])
    return t.v_product.select(reason.alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))
