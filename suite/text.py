"""Text functions over documents, pages and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from merchloom.functions import text as T
from merchloom.functions import categories as C
from merchloom.operators import taxonomy
from suite import duck, query


@query("strip_html", f"""
SELECT page_id, {duck.strip_html('html')} AS plain, {duck.strip_html('html', True)} AS strict FROM pages
""")
def _(t):
    return t.pages.select("page_id", T.strip_html("html").alias("plain"), T.strip_html("html", strict=True).alias("strict"))


@query("clean_title", f"""
SELECT doc_id, replace({duck.strip('text')}, chr(10), ' ') AS title FROM documents
""")
def _(t):
    return t.documents.select("doc_id", T.clean_title("text").alias("title"))


@query("clean_description", f"""
SELECT doc_id, substring({duck.strip_html('text')}, 1, 5000) AS description FROM documents
""")
def _(t):
    return t.documents.select("doc_id", T.clean_description("text").alias("description"))


@query("clean_tags", f"""
SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, '.'), lambda x: {duck.strip('x')}), lambda x: x <> ''), '|') AS tags
FROM documents
""")
def _(t):
    tags = T.clean_tags(F.split("text", r"\."))
    return t.documents.select("doc_id", F.array_join(tags, "|").alias("tags"))


@query("sanitize_cell", rf"""
WITH c AS (SELECT doc_id, regexp_replace({duck.strip('text')}, '[\x00-\x1F\x7F]+', '', 'g') AS cell FROM documents)
SELECT doc_id, CASE WHEN length(cell) > 32760 THEN substring(cell, 1, 32760) || '...(truncated)' ELSE cell END AS cell FROM c
""")
def _(t):
    return t.documents.select("doc_id", T.sanitize_cell("text").alias("cell"))


def _stem_sql(x: str) -> str:
    word = r"[^\p{L}\p{N}_]"
    for pattern, replacement in T.STEM_GROUPS:
        start = "()" if pattern == "s" else f"(^|{word})"
        x = f"regexp_replace({x}, '{start}{pattern}({word}|$)', '\\1{replacement}\\{2 if pattern == 's' else 3}', 'g')"
    return x


@query("normalize_text", rf"""
WITH b AS (SELECT doc_id, lower({duck.strip('text')}) AS x FROM documents)
SELECT doc_id,
       {duck.ws(r"regexp_replace(x, '->|[|>→:/\\\n\r\t&]', ' ', 'g')")} AS path,
       {duck.ws(r"regexp_replace(x, '[_/&|>\-:;,()\[\].]+', ' ', 'g')")} AS broad,
       {duck.ws(r"regexp_replace(x, '[^\p{L}\p{N}_\s&''-]', ' ', 'g')")} AS word,
       regexp_replace(x, '[^a-z0-9]+', '', 'g') AS compact
FROM b
""")
def _(t):
    modes = ("path", "broad", "word", "compact")
    return t.documents.select("doc_id", *[T.normalize_text("text", m).alias(m) for m in modes])


@query("normalize_stem", rf"""
WITH s AS (SELECT doc_id, {duck.ws(r"regexp_replace(lower(" + duck.strip("'bags ' || text") + r"), '[&/,;:\-•·()（）\[\]\x22“”''’`]+', ' ', 'g')")} AS x
           FROM documents)
SELECT doc_id, {_stem_sql('x')} AS stem FROM s
""")
def _(t):
    return t.documents.select("doc_id", T.normalize_text(F.concat(F.lit("bags "), "text"), "stem").alias("stem"))


_SING_CORE = r"""
CASE WHEN w IN ('women','men','children','feet','teeth','mice','geese','oxen','knives','lives','wives')
       THEN map(['women','men','children','feet','teeth','mice','geese','oxen','knives','lives','wives'],
                ['woman','man','child','foot','tooth','mouse','goose','ox','knife','life','wife'])[w]
     WHEN length(w) <= 2 THEN w
     WHEN w LIKE '%ies' AND length(w) > 4 THEN w[:-4] || 'y'
     WHEN w LIKE '%ves' AND length(w) > 4 THEN w[:-4] || 'f'
     WHEN regexp_matches(w, '(ses|xes|zes|ches|shes)$') THEN w[:-3]
     WHEN regexp_matches(w, '[^sui]s$') AND length(w) > 3 THEN w[:-2]
     WHEN w LIKE '%ing' AND length(w) > 5 THEN CASE WHEN w[-4] = w[-5] THEN w[:-5] ELSE w[:-4] END
     WHEN w LIKE '%ied' AND length(w) > 4 THEN w[:-4] || 'y'
     WHEN w LIKE '%ed' AND length(w) > 4 THEN w[:-3]
     ELSE w END"""
_SING_STRICT = r"""
CASE WHEN w IN ('children','men','women','people','teeth','feet','geese','mice')
       THEN map(['children','men','women','people','teeth','feet','geese','mice'],
                ['child','man','woman','person','tooth','foot','goose','mouse'])[w]
     WHEN length(w) <= 3 THEN w
     WHEN w LIKE '%ies' AND length(w) > 4 THEN w[:-4] || 'y'
     WHEN regexp_matches(w, '(ches|shes|xes|zes|sses)$') AND length(w) > 4 THEN w[:-3]
     WHEN regexp_matches(w, '[^sui]s$') THEN w[:-2]
     ELSE w END"""


@query("singularize", f"""
SELECT w AS word, {_SING_CORE} AS core, {_SING_STRICT} AS strict
FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents)
""")
def _(t):
    words = t.documents.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1))).alias("word"))
    return words.distinct().select("word", T.singularize("word").alias("core"), T.singularize("word", "strict").alias("strict"))


@query("first_segment", f"""
WITH c AS (SELECT id, {duck.strip('raw')} AS x FROM v_rawcat)
SELECT id, CASE WHEN contains(x, '|||') THEN {duck.strip("split_part(x, '|||', 1)")}
                WHEN contains(x, '>') THEN {duck.strip("split_part(x, '>', 1)")}
                WHEN contains(x, '|') THEN {duck.strip("split_part(x, '|', 1)")}
                WHEN contains(x, ',') THEN {duck.strip("split_part(x, ',', 1)")}
                WHEN contains(x, ';') THEN {duck.strip("split_part(x, ';', 1)")}
                WHEN contains(x, '/') THEN {duck.strip("split_part(x, '/', 1)")}
                WHEN contains(x, ' - ') THEN {duck.strip("split_part(x, ' - ', 1)")}
                ELSE x END AS segment FROM c
""")
def _(t):
    return t.v_rawcat.select("id", T.first_segment("raw").alias("segment"))


@query("slugify", f"""
SELECT id, coalesce(nullif(trim(regexp_replace(lower({duck.strip('raw')}), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'mismatch_target') AS slug,
       coalesce(nullif(regexp_replace({duck.strip('raw')}, '[\\\\/:*?"<>|]+', '_', 'g'), ''), 'export') AS file_name
FROM v_rawcat
""".replace("\\\\\\\\", "\\\\"))
def _(t):
    return t.v_rawcat.select("id", T.slugify("raw").alias("slug"), T.safe_file_name("raw").alias("file_name"))


@query("normalize_collection_name", f"""
SELECT id, {duck.strip("regexp_replace(" + duck.ws("translate(lower(raw), '_-&/', '    ')") + ", '[0-9]+$', '')")} AS name
FROM v_rawcat
""")
def _(t):
    return t.v_rawcat.select("id", T.normalize_collection_name("raw").alias("name"))


@query("split_keywords", f"""
SELECT id, array_to_string(list_filter(list_transform(regexp_split_to_array(raw, '[;,\\n]'), lambda x: {duck.strip('x')}), lambda x: x <> ''), '#') AS keywords
FROM v_rawcat
""")
def _(t):
    return t.v_rawcat.select("id", F.array_join(T.split_keywords("raw"), "#").alias("keywords"))


@query("title_tokens", """
SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z]{2,}')) AS words,
       len(list_distinct(regexp_extract_all(lower(text), '[a-z]{2,}'))) AS distinct_words,
       len(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: length(w) >= 3))) AS keywords
FROM documents
""")
def _(t):
    return t.documents.select(
        "doc_id", F.size(T.title_words("text")).alias("words"),
        F.size(F.array_distinct(T.title_words(F.lower("text")))).alias("distinct_words"),
        F.size(T.title_keywords("text")).alias("keywords"))


@query("clean_cell", f"""
SELECT id, CASE WHEN lower({duck.strip('raw_cell')}) = 'nan' THEN '' ELSE {duck.strip('raw_cell')} END AS cell,
       regexp_replace(lower(raw_header), '[ _()-]', '', 'g') AS header,
       CASE WHEN lower({duck.strip('raw_cell')}) IN ('1','true','yes','on') THEN '1' ELSE '0' END AS flag
FROM v_site_text
""")
def _(t):
    return t.v_site_text.select(
        "id", T.clean_cell("raw_cell").alias("cell"), T.normalize_header("raw_header").alias("header"),
        T.bool_flag("raw_cell").alias("flag"))


_PATH_SQL = f"""
clean0 AS (SELECT id, raw, replace({duck.strip('raw')}, '_', ' ') AS v FROM v_rawcat),
clean1 AS (SELECT id, raw, regexp_matches(regexp_replace(lower(v), '[ &|>:/\\\\\\t\\n\\r]', '', 'g'), '^[0-9]*$') AS is_empty,
             list_filter(list_transform(regexp_split_to_array(replace(v, '&amp;', '&'), '->|→|>|:|/|\\\\|\\||&|\\r|\\n|\\t|,|;'),
                         lambda x: {duck.strip('x')}), lambda x: x <> '') AS p FROM clean0),
clean2 AS (SELECT id, raw, is_empty, CASE WHEN regexp_matches(replace(replace(p[1], '.', ''), '-', ''), '^[0-9]+$') THEN p[2:] ELSE p END AS p FROM clean1),
clean3 AS (SELECT id, raw, is_empty, list_filter(p, lambda x: length(x) > 1 AND lower(x) NOT IN ('', '-', '--', '---', 'none', 'null', 'unknown', 'other', 'others', 'na', 'n/a', 'test', 'demo', 'temp')) AS p FROM clean2),
clean4 AS (SELECT id, raw, is_empty OR len(p) = 0 OR (len(p) = 1 AND length(p[1]) <= 2 AND NOT regexp_matches(p[1], '\\p{{L}}')) AS is_empty,
             CASE WHEN lower(p[1]) IN ('home', 'root', 'main', 'category', 'categories', 'top', 'uncategorized', 'other', 'others', 'misc', 'miscellaneous', 'all', 'everything') THEN p[2:] ELSE p END AS p FROM clean3),
clean5 AS (SELECT id, raw, p, is_empty OR len(p) = 0 AS is_empty, array_to_string(p, '|||') AS j FROM clean4),
cleaned AS (SELECT id, raw, p, CASE WHEN is_empty THEN 'Other'
             WHEN len(regexp_extract_all(j, '[\\x{{4e00}}-\\x{{9fff}}]')) > 0 AND NOT regexp_matches(j, '[A-Za-z]')
                  AND len(regexp_extract_all(j, '[\\x{{4e00}}-\\x{{9fff}}]')) >= 0.8 * len(regexp_extract_all(j, '[\\x{{4e00}}-\\x{{9fff}}0-9]')) THEN 'DROP_ROW'
             ELSE j END AS category FROM clean5)
"""


@query("clean_category_path", f"WITH {_PATH_SQL} SELECT id, category FROM cleaned")
def _(t):
    return t.v_rawcat.select("id", C.clean_category_path("raw").alias("category"))


@query("relabel_by_lexicon", f"""WITH {_PATH_SQL}
SELECT id, CASE WHEN category IN ('Other', 'DROP_ROW') THEN category ELSE array_to_string(list_transform(p, lambda x:
    CASE WHEN regexp_matches(lower(x), '(^|[^a-z0-9])widget([^a-z0-9]|$)') THEN 'Gadgets'
         WHEN regexp_matches(lower(x), '(^|[^a-z0-9])brand#2([^a-z0-9]|$)') THEN 'House brand' ELSE x END), '|||') END AS category FROM cleaned
""")
def _(t):
    relabel = (("widget", "Gadgets"), ("Brand#2", "House brand"))
    return t.v_rawcat.select("id", C.clean_category_path("raw", relabel).alias("category"))


@query("category_key", f"""
WITH w AS (SELECT id, part_no, part, word_no, w FROM (
             SELECT id, part_no, part, unnest(CASE WHEN len(regexp_extract_all(lower(part), '[a-z0-9]+')) = 0 THEN [NULL] ELSE regexp_extract_all(lower(part), '[a-z0-9]+') END) AS w,
                    unnest(range(1, greatest(len(regexp_extract_all(lower(part), '[a-z0-9]+')), 1) + 1)) AS word_no
             FROM (SELECT id, unnest(parts) AS part, unnest(range(1, len(parts) + 1)) AS part_no FROM (
                   SELECT id, list_filter(list_transform(string_split(raw, '|||'), lambda x: {duck.strip('x')}), lambda x: x <> '') AS parts FROM v_rawcat)))),
     keyed AS (SELECT id, part_no, coalesce(string_agg({_SING_STRICT}, ' ' ORDER BY word_no), lower(any_value(part))) AS k FROM w GROUP BY id, part_no),
     joined AS (SELECT id, string_agg(k, '|||' ORDER BY part_no) AS k FROM keyed GROUP BY id)
SELECT v.id, coalesce(j.k, '') AS cat_key FROM v_rawcat v LEFT JOIN joined j ON v.id = j.id
""")
def _(t):
    return t.v_rawcat.select("id", C.category_key("raw").alias("cat_key"))


@query("normalize_category_to_taxonomy", f"""
WITH nodes AS (SELECT DISTINCT lower(p_name) AS node FROM part WHERE p_size % 3 = 0 UNION SELECT 'men' UNION SELECT 'child' UNION SELECT 't-shirt'),
     raw AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 6 THEN 'T-shirts' WHEN p_partkey % 3 = 0 THEN ' ' || upper(p_name) || ' ' WHEN p_partkey % 3 = 1 THEN p_name || 's' ELSE p_type END AS raw FROM part),
     cleaned AS (SELECT id, {duck.ws('raw')} AS v FROM raw),
     words AS (SELECT id, v, n, lower(ww) AS w FROM (SELECT id, v, unnest(string_split(v, ' ')) AS ww, unnest(range(1, len(string_split(v, ' ')) + 1)) AS n FROM cleaned)),
     singular AS (SELECT id, any_value(v) AS v, string_agg({_SING_CORE}, ' ' ORDER BY n) AS s FROM words GROUP BY id)
SELECT id, CASE WHEN lower(v) IN (SELECT node FROM nodes) THEN {duck.title_case('v')} WHEN s IN (SELECT node FROM nodes) THEN {duck.title_case('s')} ELSE v END AS category,
       lower(v) IN (SELECT node FROM nodes) OR s IN (SELECT node FROM nodes) AS known
FROM singular
""")
def _(t):
    nodes = t.sql("SELECT DISTINCT lower(p_name) AS node FROM {part} WHERE p_size % 3 = 0 UNION SELECT 'men' UNION SELECT 'child' UNION SELECT 't-shirt'")
    raw = t.sql("SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 6 THEN 'T-shirts' WHEN p_partkey % 3 = 0 THEN ' ' || upper(p_name) || ' ' WHEN p_partkey % 3 = 1 THEN p_name || 's' ELSE p_type END AS raw FROM {part}")
    return taxonomy.normalize_to_taxonomy(raw, "raw", nodes).select("id", F.col("normalized").alias("category"), "known")
