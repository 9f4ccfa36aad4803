"""Similarity joins that meet on tokens instead of comparing all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchloom.functions import similarity as S
from merchloom.functions.base import NOT_ALNUM, ColumnLike, col, text_or_empty
from merchloom.functions.text import normalize_text
from merchloom.operators.lexicon import substring_hits
from merchloom.operators.ranking import first_per_key

# a fixed order of signs, rare ones first; any order is right, a rare-first one makes short join groups
RARE_FIRST = "zqxjkvbpygfwmucldrhsnioate "


#: From this ratio on pairs of signs are enough to meet on; they are far more selective than single signs.
BIGRAM_RATIO = 0.75


def edit_tokens(text: ColumnLike, min_ratio: float) -> Column:
    """Prefix of a text's sorted tokens that any text of ``min_ratio`` or more must share one of.

    A token is a sign, or two signs in a row, and how often it has occurred before. A partner of a text of n signs
    is at most ``n / min_ratio`` long, so at most ``e = n * (1 / min_ratio - 1)`` edits away; an edit
    changes one sign or two pairs. By the prefix rule of set-similarity joins the first ``e + 1`` or
    ``2 * e + 1`` tokens of both in one fixed order overlap. A text too short for pairs allows no edit
    at all and meets its equal only.
    """
    size = 2 if min_ratio >= BIGRAM_RATIO else 1
    whole = col(text)
    signs = F.split(whole, "")
    edits = F.floor(F.length(whole) * F.lit(1 / min_ratio - 1) + 1e-9).cast("int")
    parts = signs if size == 1 else F.transform(F.sequence(F.lit(1), F.greatest(F.length(whole) - 1, F.lit(1))), lambda i: F.substring(whole, i, F.lit(2)))

    def token(part: Column, i: Column) -> Column:
        seen = F.size(F.filter(F.slice(parts, 1, i + 1), lambda s: s == part))
        rank = F.instr(F.lit(RARE_FIRST), F.substring(part, 1, 1)) + (F.instr(F.lit(RARE_FIRST), F.substring(part, 2, 1)) if size == 2 else F.lit(0))
        return F.struct((-seen).alias("n"), rank.alias("r"), part.alias("s"))

    ordered = F.array_sort(F.transform(parts, token))
    prefix = F.transform(F.slice(ordered, 1, size * edits + 1), lambda t: F.concat(t["s"], t["n"].cast("string")))
    return prefix if size == 1 else F.when(edits == 0, F.array(F.concat(F.lit("="), whole))).otherwise(F.array_append(prefix, F.concat(F.lit("="), whole)))


def similar_pairs(left: DataFrame, left_text: str, right: DataFrame, right_text: str, min_ratio: float) -> DataFrame:
    """Distinct (left text, right text, score) with an edit ratio of ``min_ratio`` (0-1) or more."""
    a = left.select(left_text).distinct().where(F.length(left_text) > 0)
    b = right.select(right_text).distinct().where(F.length(right_text) > 0)
    a = a.select(left_text, F.explode(edit_tokens(left_text, min_ratio)).alias("_token"))
    b = b.select(right_text, F.explode(edit_tokens(right_text, min_ratio)).alias("_token"))
    shorter, longer = F.least(F.length(left_text), F.length(right_text)), F.greatest(F.length(left_text), F.length(right_text))
    pairs = a.join(b, "_token").where(shorter >= min_ratio * longer).select(left_text, right_text).distinct()
    return pairs.withColumn("score", S.ratio(F.col(left_text), F.col(right_text))).where(F.col("score") >= 100 * min_ratio)


def sorted_words(value: ColumnLike) -> Column:
    """Words in order, as token-sort scores compare them."""
    return F.array_join(F.array_sort(F.filter(F.split(F.lower(col(value)), NOT_ALNUM + "+"), lambda w: w != "")), " ")


def best_line(names: DataFrame, name: str, lines: DataFrame, line: str, min_score: float = 80.0) -> DataFrame:
    """Best taxonomy line per distinct name by token-sort ratio: (name, line, score)."""
    a = names.select(name).distinct().withColumn("_a", sorted_words(name))
    b = lines.select(line).distinct().withColumn("_b", sorted_words(line))
    pairs = similar_pairs(a, "_a", b, "_b", min_score / 100)
    scored = a.join(pairs, "_a").join(b, "_b").select(name, line, "score")
    return first_per_key(scored, [name], [F.round("score", 9).desc(), F.col(line)])


def strong_matches(titles: DataFrame, title: str, phrases: DataFrame, min_ratio: float = 0.88) -> DataFrame:
    """Distinct titles that contain a phrase of three signs or more, or resemble one of five or more; both normalised."""
    named = titles.select(F.col(title).alias("_raw"), normalize_text(title, "word").alias("_t")).distinct()
    texts = named.select("_t").distinct().select("_t", F.unhex(F.sha2("_t", 256)).alias("_id"))
    terms = phrases.select(normalize_text("phrase", "word").alias("term")).distinct()
    contained = substring_hits(texts, ["_id"], "_t", terms.where(F.length("term") >= 3)).select("_id")
    similar = similar_pairs(texts, "_t", terms.where(F.length("term") >= 5), "term", min_ratio).select(F.unhex(F.sha2("_t", 256)).alias("_id"))
    hit = contained.unionByName(similar).distinct()
    return named.withColumn("_id", F.unhex(F.sha2("_t", 256))).join(hit, "_id", "left_semi").select(F.col("_raw").alias(title))


def domain_matches(stores: DataFrame, url: str, keywords: DataFrame) -> DataFrame:
    """Distinct stores whose domain, without its ending, holds a keyword or its form without a final s."""
    host = F.substring_index(F.substring_index(F.regexp_replace(F.lower(text_or_empty(url)), r"^https?://(www\.)?|^www\.", ""), "/", 1), "?", 1)
    name = F.regexp_replace(F.regexp_replace(host, r"\.(com|net|org|co\.uk|shop|store|ca|au|us|io).*", ""), r"[^\p{L}\p{N}_]", "")
    word = F.lower(F.col("keyword"))
    forms = keywords.select(F.explode(F.array(word, F.regexp_replace(word, "s$", ""))).alias("term")).where("term <> ''").distinct()
    named = stores.select(url, name.alias("_name")).distinct()
    hit = substring_hits(named.select("_name").distinct().withColumn("_x", F.col("_name")), ["_name"], "_x", forms).select("_name").distinct()
    return named.join(hit, "_name", "left_semi").select(url)
