"""Term lists: whole-word hits, safe contexts, first match, phrases from tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from merchloom.operators import lexicon as L
from suite import duck, query

LEXICON = L.Lexicon(
    terms=("hehely", "Rewh rewh", "worthless", "orre", "by-nc", "the of", "裙子", "2,4-x"),
    broad=frozenset({"orre", "worthless", "the of"}),
    safe={"hehely": ("hehely hehely",), "the of": ("and the of", "of the of")},
    category_terms=("promos", "economy"),
)

_KW = """kw AS (SELECT * FROM (VALUES ('hehely', 'hehely hehely', 'hehely hehely', false), ('rewh rewh', '#none#', '#none#', false), ('worthless', '#none#', '#none#', true), ('orre', '#none#', '#none#', true),
   ('by nc', '#none#', '#none#', false), ('the of', 'and the of', 'of the of', true), ('2,4 x', '#none#', '#none#', false)) AS k(kw, s1, s2, broad))"""
_HITS = f"""
{_KW},
f AS (SELECT product_id, 1 AS field_no, 'title' AS field, replace(lower({duck.strip('title')}), '-', ' ') AS x FROM v_product
      UNION ALL SELECT product_id, 2, 'category', replace(lower({duck.strip('category')}), '-', ' ') FROM v_product
      UNION ALL SELECT product_id, 3, 'description', replace(lower({duck.strip('description')}), '-', ' ') FROM v_product),
h AS (SELECT product_id, field_no, field, kw, broad, length(regexp_extract(x, '(?s)^(.*?)(?:^|[^a-z0-9])' || kw || '(?:[^a-z0-9]|$)', 1)) AS pos
      FROM f, kw WHERE regexp_matches(x, '(^|[^a-z0-9])' || kw || '([^a-z0-9]|$)') AND NOT contains(x, s1) AND NOT contains(x, s2))
"""


@query("prohibited_terms", f"WITH {_HITS} SELECT product_id, field, kw AS keyword FROM h")
def _(t):
    fields = F.create_map(*[x for f in ("title", "category", "description") for x in (F.lit(f), LEXICON.hits(f))])
    return (t.v_product.select("product_id", F.explode(fields).alias("field", "_h"))
            .select("product_id", "field", F.explode("_h").alias("keyword")))


_FIRST = f"""
{_HITS},
ranked AS (SELECT product_id, field, kw, row_number() OVER (PARTITION BY product_id ORDER BY (field_no = 3 AND broad), field_no, pos, kw) AS rn FROM h),
first_hit AS (SELECT p.product_id, p.category, coalesce(field, CASE WHEN regexp_matches(lower(p.category), '(^|[^a-z0-9])(promos|economy)([^a-z0-9]|$)') THEN 'category' END, '') AS match_field,
     coalesce(kw, CASE WHEN regexp_matches(lower(p.category), '(^|[^a-z0-9])promos([^a-z0-9]|$)') THEN 'apparel:promos'
                       WHEN regexp_matches(lower(p.category), '(^|[^a-z0-9])economy([^a-z0-9]|$)') THEN 'apparel:economy' END, '') AS match_keyword
   FROM v_product p LEFT JOIN ranked r ON p.product_id = r.product_id AND rn = 1)
"""


@query("prohibited_first_match", f"WITH {_FIRST} SELECT product_id, match_field, match_keyword FROM first_hit")
def _(t):
    return LEXICON.first_match(t.v_product).select("product_id", "match_field", "match_keyword")


@query("category_lexicon_match", r"""
SELECT product_id, CASE WHEN regexp_matches(lower(category), '(^|[^a-z0-9])promos([^a-z0-9]|$)') THEN 'apparel:promos' WHEN regexp_matches(lower(category), '(^|[^a-z0-9])economy([^a-z0-9]|$)') THEN 'apparel:economy'
       WHEN domain = 'src7' THEN 'apparel:promos' ELSE '' END AS match FROM v_product
""")
def _(t):
    source = F.when(F.col("domain") == "src7", "Hot/Promos > x").otherwise("plain")
    return t.v_product.select("product_id", LEXICON.category_match("category", source).alias("match"))


@query("check_product", f"""
WITH {_FIRST}
SELECT p.product_id, match_field <> '' AS blocked, match_field AS field, match_keyword AS keyword, regexp_matches(lower(title || ' ' || v.category || ' ' || description), '(^|[^a-z0-9])(ononst|inoran)([^a-z0-9]|$)') AS listed
FROM first_hit p JOIN v_product v USING (product_id)
""")
def _(t):
    from merchloom.operators.rules import lexicon_word_match
    found = LEXICON.first_match(t.v_product)
    return found.select("product_id", F.struct((F.col("match_field") != "").alias("blocked"), F.col("match_field").alias("field"), F.col("match_keyword").alias("keyword"),
                        lexicon_word_match(("ononst", "inoran"), "title", "category", "description").alias("listed")).alias("r")).select("product_id", "r.*")


@query("field_hits", f"""
WITH {_HITS}
SELECT product_id, field, string_agg(kw, ',' ORDER BY pos, kw) AS keywords FROM h GROUP BY ALL
""")
def _(t):
    names = ("title", "category", "description")
    hits = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[LEXICON.hits(n) for n in names]))
    exploded = t.v_product.select("product_id", F.explode(hits).alias("field", "_h")).where(F.size("_h") > 0)
    return exploded.select("product_id", "field", F.array_join("_h", ",").alias("keywords"))


# every run of three words or more between other signs, of whole passages
_RUNS = r"regexp_extract_all(lower(text), '([a-z]+(?: [a-z]+){2,})', 1)"
_TERMS = f"k AS (SELECT DISTINCT unnest({_RUNS}) AS term FROM benchmark UNION SELECT 'orre' UNION SELECT 'rewh rewh')"


@query("phrase_contains", f"""
WITH {_TERMS}
SELECT doc_id, term FROM documents, k WHERE regexp_matches(replace(lower(text), '-', ' '), '(^|[^a-z0-9])' || term || '([^a-z0-9]|$)')
""")
def _(t):
    runs = t.benchmark.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+(?: [a-z]+){2,})"), 1)).alias("term"))
    terms = runs.union(t.spark.sql("SELECT 'orre' UNION SELECT 'rewh rewh'")).distinct()
    return L.ngram_hits(t.documents, ["doc_id"], "text", terms)


@query("phrase_contains_compact", """
WITH k AS (SELECT DISTINCT regexp_replace(lower(text), '[^a-z0-9]+', '', 'g') AS term FROM benchmark WHERE length(regexp_replace(lower(text), '[^a-z0-9]+', '', 'g')) >= 4)
SELECT doc_id, term FROM documents, k WHERE contains(regexp_replace(lower(text), '[^a-z0-9]+', '', 'g'), term)
""")
def _(t):
    from merchloom.functions.text import normalize_text
    terms = t.benchmark.select(normalize_text("text", "compact").alias("term")).where("length(term) >= 4").distinct()
    return L.substring_hits(t.documents.select("doc_id", normalize_text("text", "compact").alias("x")), ["doc_id"], "x", terms)


@query("lexicon_tables", """
WITH k AS (SELECT p_type AS category, lower(p_name) AS term FROM part GROUP BY ALL),
     ignored AS (SELECT DISTINCT p_type AS category, lower(p_name) AS term FROM part WHERE p_size = 7)
SELECT c.c_custkey, k.category, k.term FROM (SELECT c_custkey, lower(c_mktsegment) || ' ' || p_name || '-' || p_brand AS x FROM customer JOIN part ON p_partkey = c_custkey) c
JOIN k ON contains(c.x, k.term) WHERE (k.category, k.term) NOT IN (SELECT (category, term) FROM ignored)
""".replace("(k.category, k.term) NOT IN (SELECT (category, term) FROM ignored)", "NOT EXISTS (SELECT 1 FROM ignored i WHERE i.category = k.category AND i.term = k.term)"))
def _(t):
    rules = t.sql("SELECT DISTINCT p_type AS category, lower(p_name) AS term FROM {part}")
    ignored = t.sql("SELECT DISTINCT p_type AS category, lower(p_name) AS term FROM {part} WHERE p_size = 7")
    texts = t.sql("SELECT c_custkey, concat(lower(c_mktsegment), ' ', p_name, '-', p_brand) AS x FROM {customer} JOIN {part} ON p_partkey = c_custkey")
    return L.substring_hits(texts, ["c_custkey"], "x", rules.join(ignored, ["category", "term"], "left_anti"))
