"""Several categories per text by keyword lists, and products that sit in the wrong table."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchloom.functions.base import ColumnLike, col
from merchloom.functions.text import normalize_text
from merchloom.operators.lexicon import ngram_hits, substring_hits
from merchloom.session import cut_lineage

LOOSE_SHARE = 0.6
LOOSE_WORD = 4
#: Signs that words of the dictionary meet by; a pair of words is then compared in full.
HEAD = 3
DESC_LABEL_LIMIT = 4
_NONE = "array<string>"
TITLE_POINTS, CATEGORY_POINTS, DESC_POINTS = 2, 3, 1


def _stem(word: ColumnLike) -> Column:
    return F.rtrim(F.rtrim(col(word), F.lit("s")), F.lit("e"))


def _words(value: ColumnLike) -> Column:
    return F.filter(F.split(col(value), " "), lambda w: w != "")


def text_id(text: ColumnLike) -> Column:
    """32 bytes that stand for a text in joins and shuffles."""
    return F.unhex(F.sha2(col(text), 256))


def multi_label(texts: DataFrame, text: str, rules: DataFrame) -> DataFrame:
    """Distinct (text, category) for distinct normalised texts and rules (category, keyword); see :func:`label_ids`."""
    named = texts.select(F.col(text).alias("_x")).distinct().where("_x <> ''").withColumn("_t", text_id("_x"))
    return label_ids(named, "_t", "_x", rules).join(named, "_t").select(F.col("_x").alias(text), "category")


def label_ids(texts: DataFrame, key: str, text: str, rules: DataFrame) -> DataFrame:
    """Distinct (key, category) for texts with one key each and rules (category, keyword).

    A category is hit strictly when one of its keywords stands in the text as whole words. Where it is
    not, it is hit loosely: a one-word keyword by prefix or stem of a text word, a longer one when
    enough of its words do so. The distinct words of all texts meet the distinct words of all keywords once, in a
    dictionary; occurrences only look their word up in it. Words travel with the key of their text, never with the text.
    """
    t = texts.select(F.col(key).alias("_t"), F.col(text).alias("_x")).where("_x <> ''")
    k = rules.select("category", normalize_text("keyword", "stem").alias("term")).where("term <> ''").distinct()
    latin = k.where(F.col("term").rlike("[a-z]"))
    other = k.where(~F.col("term").rlike("[a-z]"))
    strict = ngram_hits(t, ["_t"], "_x", latin).select("_t", "category").unionByName(
        substring_hits(t, ["_t"], "_x", other).select("_t", "category")).distinct()
    tw = t.select("_t", F.posexplode(_words("_x")).alias("_i", "_w"))
    kw = k.select("category", "term", F.size(_words("term")).alias("_n"), F.posexplode(_words("term")).alias("_j", "_k"))

    met = _dictionary(tw.select("_w").distinct(), kw.select("_k").distinct())
    whole = F.col("_prefix") & (F.length("_w") >= LOOSE_WORD) & (F.length("_k") >= LOOSE_WORD)
    known = met.join(kw, "_k")
    # a one-word keyword is decided by the word alone, whatever stands around it
    alone = known.where((F.col("_n") == 1) & (whole | F.col("_stem"))).select("_w", "category").distinct()
    one_word = tw.select("_t", "_w").distinct().join(alone, "_w").select("_t", "category")
    touching = tw.join(known.where("_n > 1 AND _prefix").select("_w", "category", "term", "_n", "_j"), "_w")
    several = (
        touching.groupBy("_t", "category", "term", "_n").agg(F.count(F.lit(1)).alias("_pairs"))
        .where(F.col("_pairs") >= F.greatest(F.lit(1.0), F.col("_n") * LOOSE_SHARE)).select("_t", "category")
    )
    hits = strict.unionByName(one_word).unionByName(several).distinct()
    return hits.withColumnRenamed("_t", key)


def _dictionary(words: DataFrame, keys: DataFrame) -> DataFrame:
    """``_w, _k, _prefix, _stem``: pairs of distinct words where one begins with the other, or both have one stem.

    Words meet by their first ``HEAD`` signs and are then compared in full; a shorter word, of which there are few, meets
    the longer ones as their beginning. All of this grows with the number of distinct words only.
    """
    def by_head(a: DataFrame, x: str, b: DataFrame, y: str) -> DataFrame:
        """Pairs where ``x`` begins with ``y``."""
        head = lambda c: F.substring(c, 1, HEAD)
        full = a.where(F.length(x) >= HEAD).withColumn("_h", head(x)).join(b.where(F.length(y) >= HEAD).withColumn("_h", head(y)), "_h").where(
            F.startswith(F.col(x), F.col(y))).select(x, y)
        starts = F.explode(F.transform(F.sequence(F.lit(1), F.least(F.length(x), F.lit(HEAD - 1))), lambda n: F.substring(F.col(x), F.lit(1), n)))
        return full.union(a.select(x, starts.alias(y)).join(b.where(F.length(y) < HEAD), y).select(x, y))

    begun = by_head(words, "_w", keys, "_k").select("_w", "_k").union(by_head(keys, "_k", words, "_w").where("_k <> _w").select("_w", "_k"))
    long_words, long_keys = words.where(F.length("_w") >= LOOSE_WORD), keys.where(F.length("_k") >= LOOSE_WORD)
    stems = long_words.withColumn("_s", _stem("_w")).join(long_keys.withColumn("_s", _stem("_k")), "_s").select("_w", "_k")
    both = begun.withColumn("_prefix", F.lit(True)).unionByName(stems.withColumn("_prefix", F.lit(False)))
    return both.groupBy("_w", "_k").agg(F.max("_prefix").alias("_prefix"), F.min("_prefix").alias("_all")).select(
        "_w", "_k", "_prefix", (~F.col("_all")).alias("_stem"))


def label_lists(hits: DataFrame, text: str, name: str) -> DataFrame:
    """Sorted list of categories per distinct text or key; as long as the rule list has categories."""
    return hits.groupBy(text).agg(F.array_sort(F.collect_set("category")).alias(name))


def classify_distinct(df: DataFrame, column: str, rules: DataFrame, name: str = "categories") -> DataFrame:
    """Add the list of matched categories, worked out once per distinct normalised value."""
    return with_lists(df, {name: column}, "stem", lambda texts, key, text: label_ids(texts, key, text, rules))


def top_unmatched(df: DataFrame, column: str, categories: str = "categories", n: int = 20) -> DataFrame:
    """Most frequent values without any category."""
    missed = df.where((F.size(categories) == 0) & (F.trim(column) != ""))
    return missed.groupBy(column).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.col("rows").desc(), column).limit(n)


def with_lists(df: DataFrame, columns: Mapping[str, str], mode: str, find: Callable[[DataFrame, str, str], DataFrame]) -> DataFrame:
    """Add a list of categories per column, found once per distinct normalised text of all columns.

    ``columns`` maps the new list's name to the text column; ``find`` maps a table of texts with their ids,
    and the names of both columns, to (id, category) hits. Only ids with hits are kept and joined back.
    """
    out = df.withColumns({f"_n_{name}": text_id(normalize_text(column, mode)) for name, column in columns.items()})
    names = F.array_distinct(F.array(*[normalize_text(column, mode) for column in columns.values()]))
    texts = df.select(F.explode(names).alias("_n")).where("_n <> ''").select(text_id("_n").alias("_id"), "_n").groupBy("_id").agg(F.any_value("_n").alias("_n"))
    lists = cut_lineage(label_lists(find(texts, "_id", "_n"), "_id", "_list"))
    for name in columns:
        mine = lists.select(F.col("_id").alias(f"_n_{name}"), F.col("_list").alias(name))
        out = out.drop(name).join(mine, f"_n_{name}", "left").withColumn(name, F.coalesce(name, F.array().cast(_NONE))).drop(f"_n_{name}")
    return out


def alias_hits(aliases: DataFrame) -> Callable[[DataFrame, str, str], DataFrame]:
    """Finder of (id, target) by aliases: with Latin letters as words between blanks, others anywhere."""
    named = aliases.select(F.col("alias").alias("term"), F.col("target").alias("category"))

    def find(texts: DataFrame, key: str, text: str) -> DataFrame:
        latin = ngram_hits(texts, [key], text, named.where(F.col("term").rlike("[a-z]")), lambda c: F.split(col(c), " "))
        other = substring_hits(texts, [key], text, named.where(~F.col("term").rlike("[a-z]")))
        return latin.select(key, "category").unionByName(other.select(key, "category")).distinct()

    return find


def ranked_scores(title: Column, category: Column, desc: Column | None = None) -> Column:
    """Categories with their points, best first, name as tie-break."""
    lists = [(title, TITLE_POINTS), (category, CATEGORY_POINTS)] + ([(desc, DESC_POINTS)] if desc is not None else [])
    names = lists[0][0]
    for values, _ in lists[1:]:
        names = F.array_union(names, values)

    def points(name: Column) -> Column:
        total = F.lit(0)
        for values, weight in lists:
            total = total + F.when(F.array_contains(values, name), weight).otherwise(0)
        return F.struct((-total).alias("n"), name.alias("category"))

    return F.array_sort(F.transform(names, points))


class Verdict:
    """Decision rules over one row's ranked scores and its expected category."""

    def __init__(self, expected: ColumnLike, ranked: ColumnLike, title: ColumnLike, category: ColumnLike):
        self.expected, ranked = col(expected), col(ranked)
        self.any = F.size(ranked) > 0
        self.top = F.get(ranked, F.lit(0))["category"]
        self.top_score = F.coalesce(-F.get(ranked, F.lit(0))["n"], F.lit(0))
        self.second_score = F.coalesce(-F.get(ranked, F.lit(1))["n"], F.lit(0))
        mine = F.get(F.filter(ranked, lambda r: r["category"] == self.expected), F.lit(0))
        self.expected_score = F.coalesce(-mine["n"], F.lit(0))
        self.in_title = F.array_contains(col(title), self.expected)
        self.in_category = F.array_contains(col(category), self.expected)
        self.is_top = F.coalesce(self.top == self.expected, F.lit(False))
        self.clear = (self.top_score >= 3) & (self.top_score - self.second_score >= 1)

    def fast_pass(self) -> Column:
        score, top = self.expected_score, self.top_score
        return (
            ~self.any | self.is_top | (self.in_category & (score >= 3)) | (score >= 4)
            | (self.in_title & (score >= F.greatest(top - 1, F.lit(3)))) | (self.in_category & (score >= top - 1))
        )

    def quick_mismatch(self) -> Column:
        return self.any & ~self.fast_pass() & self.clear & (self.expected_score < 3)

    def heavy_candidate(self) -> Column:
        return self.any & ~self.is_top & ~self.in_category & self.clear & (self.expected_score < self.top_score)

    def refine_candidate(self) -> Column:
        settled = self.in_category & (self.expected_score >= 3)
        return self.any & ~self.is_top & self.clear & (self.expected_score < self.top_score) & ~settled

    def confident_mismatch(self) -> Column:
        primary = self.in_title | self.in_category
        return self.any & ~self.is_top & ~primary & self.clear & (self.expected_score < self.top_score - 1)


def _report(df: DataFrame, key: str, verdict: Verdict) -> DataFrame:
    return df.select(key, F.col("expected"), verdict.top.alias("predicted"), verdict.top_score.alias("top_score"),
                     verdict.second_score.alias("second_score"), "title_matches", "category_matches", "desc_matches")


def _with_desc(df: DataFrame, desc: str, rules: DataFrame) -> DataFrame:
    """Add the categories of the description, none when there are too many, and the new ranking."""
    found = with_lists(df, {"desc_matches": desc}, "stem", lambda texts, key, text: label_ids(texts, key, text, rules))
    kept = F.when(F.size("desc_matches") > DESC_LABEL_LIMIT, F.array().cast(_NONE)).otherwise(F.col("desc_matches"))
    return found.withColumn("desc_matches", kept).withColumn(
        "ranked", ranked_scores(F.col("title_matches"), F.col("category_matches"), F.col("desc_matches")))


def mismatch_scan(df: DataFrame, key: str, aliases: DataFrame, rules: DataFrame | None = None, quick: bool = True,
                  title: str = "title", category: str = "category", desc: str = "description") -> DataFrame:
    """Products whose texts point to another category than the ``expected`` one of their table.

    The alias pass settles most rows. What it leaves goes through the keyword rules and, only then,
    through the description. Rows carry the scores and the lists of hits.
    """
    columns = {"title_matches": title, "category_matches": category}
    by_alias = ranked_scores(F.col("title_matches"), F.col("category_matches"))
    broad = with_lists(df.select(key, "expected", title, category, desc), columns, "broad", alias_hits(aliases)).withColumns(
        {"desc_matches": F.array().cast(_NONE), "ranked": by_alias})
    first = Verdict("expected", "ranked", "title_matches", "category_matches")
    open_rows = broad.where(~first.fast_pass())
    if quick:
        sure = _report(open_rows.where(first.quick_mismatch()), key, first)
        if rules is None:
            return sure
        unsure = cut_lineage(open_rows.where(~first.quick_mismatch()).drop("ranked"))
        return sure.unionByName(_report(_with_desc(unsure, desc, rules).where(first.quick_mismatch()), key, first))
    if rules is None:
        raise ValueError("the heavy scan needs keyword rules")
    heavy = cut_lineage(open_rows.where(first.heavy_candidate()).drop("ranked"))
    primary = with_lists(heavy, columns, "stem", lambda texts, key, text: label_ids(texts, key, text, rules)).withColumn("ranked", by_alias)
    candidates = cut_lineage(primary.where(~first.fast_pass() & first.refine_candidate()).drop("ranked"))
    return _report(_with_desc(candidates, desc, rules).where(first.confident_mismatch()), key, first)


def fill_blank_category(df: DataFrame, key: str, rules: DataFrame, number: ColumnLike | None = None,
                        title: str = "title", category: str = "category", desc: str = "description") -> DataFrame:
    """Blank categories get the path of the first keyword rule whose keyword stands anywhere in title and text.

    Rules are (rule_order, level1, level2, level3, keyword). Rows that no rule matches take the path of
    the rule their number (or the hash of their key) points to, instead of a random one.
    """
    blank = df.where(F.trim(F.coalesce(F.col(category), F.lit(""))) == "")
    path = F.concat_ws("|||", "level1", "level2", "level3", "keyword")
    ruled = rules.select("rule_order", F.lower("keyword").alias("term"), path.alias("_path"))
    texts = blank.select(key, F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(desc, F.lit("")))).alias("_x"))
    hits = substring_hits(texts, [key], "_x", ruled.select("term", "rule_order", "_path"))
    first = hits.groupBy(key).agg(F.min(F.struct("rule_order", "_path", "term")).alias("_hit"))
    count = rules.count()
    numbered = ruled.select(F.col("rule_order").alias("_slot"), F.col("_path").alias("_fallback"))
    spot = F.pmod(col(number) if number is not None else F.xxhash64(key), F.lit(count))
    return (
        blank.join(first, key, "left").withColumn("_slot", spot).join(numbered, "_slot", "left")
        .select(key, F.coalesce("_hit._path", "_fallback").alias("new_category"), F.col("_hit.term").alias("hit_keyword"),
                F.col("_hit").isNotNull().alias("by_rule"))
    )
