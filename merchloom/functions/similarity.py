"""Word-set and edit-distance scores on a 0-100 scale.

All ratios are ``100 * (1 - levenshtein / longer length)``. Token scores work on sorted distinct
words. Expressions stay in the JVM; nothing here starts a Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from merchloom.functions.base import NOT_ALNUM, ColumnLike, col, let
from merchloom.functions.text import title_keywords

TOKEN_SET_MIN = 85.0
TOKEN_SORT_MIN = 95.0
PARTIAL_MIN = 75.0
PARTIAL_MIN_LEN = 5


def ratio(a: Column, b: Column) -> Column:
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 100.0).otherwise(100.0 * (1 - F.levenshtein(a, b) / longer))


def words(value: ColumnLike) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(col(value)), NOT_ALNUM + "+"), lambda w: w != ""))


def token_sort(a: ColumnLike, b: ColumnLike) -> Column:
    def flat(value: ColumnLike) -> Column:
        return F.array_join(F.array_sort(F.filter(F.split(F.lower(col(value)), NOT_ALNUM + "+"), lambda w: w != "")), " ")

    return ratio(flat(a), flat(b))


def token_set(a: ColumnLike, b: ColumnLike) -> Column:
    """Best ratio among common words, common + rest of a, common + rest of b."""
    def score(pair: Column) -> Column:
        both = F.array_sort(F.array_intersect(pair["a"], pair["b"]))
        only_a = F.array_sort(F.array_except(pair["a"], pair["b"]))
        only_b = F.array_sort(F.array_except(pair["b"], pair["a"]))
        return let(F.struct(both.alias("both"), only_a.alias("a"), only_b.alias("b")), parts)

    def parts(sets: Column) -> Column:
        both = sets["both"]
        texts = F.struct(F.array_join(both, " ").alias("c"), F.array_join(F.concat(both, sets["a"]), " ").alias("l"),
                         F.array_join(F.concat(both, sets["b"]), " ").alias("r"))
        contained = (F.size(both) > 0) & ((F.size(sets["a"]) == 0) | (F.size(sets["b"]) == 0))
        return F.when(contained, 100.0).otherwise(let(texts, best))

    def best(t: Column) -> Column:
        # a part without common words has an empty first text and scores 0 against both
        common = F.when(t["c"] != "", F.greatest(ratio(t["c"], t["l"]), ratio(t["c"], t["r"]))).otherwise(0.0)
        return F.greatest(common, ratio(t["l"], t["r"]))

    def guarded(pair: Column) -> Column:
        return F.when((F.size(pair["a"]) == 0) | (F.size(pair["b"]) == 0), 0.0).otherwise(score(pair))

    return let(F.struct(words(a).alias("a"), words(b).alias("b")), guarded)


def partial(needle: ColumnLike, text: ColumnLike) -> Column:
    """Best ratio of the shorter string against every window of its length in the longer one."""
    def score(pair: Column) -> Column:
        size = F.length(pair["s"])
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(pair["l"]) - size + 1))
        return F.when(size == 0, 0.0).otherwise(
            F.array_max(F.transform(starts, lambda i: ratio(pair["s"], F.substring(pair["l"], i, size))))
        )

    a, b = F.lower(col(needle)), F.lower(col(text))
    swap = F.length(a) > F.length(b)
    return let(F.struct(F.when(swap, b).otherwise(a).alias("s"), F.when(swap, a).otherwise(b).alias("l")), score)


def fuzzy_score(target: ColumnLike, source: ColumnLike) -> Column:
    """Token-set, then token-sort, then windowed ratio: the first that reaches its threshold."""
    empty = F.coalesce((F.length(col(target)) == 0) | (F.length(col(source)) == 0), F.lit(True))
    long_enough = F.length(col(target)) >= PARTIAL_MIN_LEN

    def by_window(score: Column) -> Column:
        return F.when(score >= PARTIAL_MIN, score).otherwise(0.0)

    def by_sort(score: Column) -> Column:
        windowed = F.when(long_enough, let(partial(target, source), by_window)).otherwise(0.0)
        return F.when(score >= TOKEN_SORT_MIN, score).otherwise(windowed)

    def by_set(score: Column) -> Column:
        return F.when(score >= TOKEN_SET_MIN, score).otherwise(let(token_sort(target, source), by_sort))

    return F.when(empty, 0.0).otherwise(let(token_set(target, source), by_set))


def keyword_overlap(target: ColumnLike, source: ColumnLike) -> Column:
    """Share of the target's words found inside the source, as a score with a bonus of 50."""
    def score(pair: Column) -> Column:
        total = F.size(pair["k"])
        hits = F.size(F.filter(pair["k"], lambda w: F.contains(pair["s"], w)))
        enough = (hits >= 2) | ((total <= 3) & (hits >= 1))
        return F.when(enough, F.least(F.lit(100.0), hits / total * 100 + 50)).otherwise(0.0)

    keywords = title_keywords(target)
    return F.coalesce(let(F.struct(keywords.alias("k"), F.lower(col(source)).alias("s")), score), F.lit(0.0))


def text_score(target: ColumnLike, source: ColumnLike) -> Column:
    """The better of word overlap and fuzzy score; a full overlap needs no second look."""
    return let(keyword_overlap(target, source), lambda o: F.when(o >= 100.0, o).otherwise(F.greatest(o, fuzzy_score(target, source))))


def title_score(target: ColumnLike, title: ColumnLike) -> Column:
    """Score of a label against a title; titles under ten letters say nothing."""
    return F.when(F.length(col(title)) >= 10, text_score(target, title)).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)
