"""Store classification from domain, page text, collection titles and handles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merchloom.functions.text import normalize_text
from merchloom.operators.lexicon import substring_hits
from merchloom.operators.ranking import top_per_group
from merchloom.session import cut_lineage


@dataclass(frozen=True)
class Signal:
    """Where a rule phrase is looked for, and what a hit is worth."""

    name: str
    field: str
    kind: str
    compact: bool
    min_len: int
    weight: int
    cap: int


# Weights and caps of the seven signals; the domain signal starts at 8 and adds 2 per further hit.
SIGNALS = (
    Signal("domain", "domain", "domain", True, 4, 0, 12),
    Signal("meta", "meta", "phrase", False, 4, 4, 12),
    Signal("title", "title", "phrase", False, 4, 6, 18),
    Signal("handle", "handle", "phrase", True, 5, 3, 9),
    Signal("strong_meta", "meta", "strong", False, 1, 5, 15),
    Signal("strong_title", "title", "strong", False, 1, 7, 21),
    Signal("strong_handle", "handle", "strong", True, 1, 4, 12),
)
# Fixed values: (category, collections from, strong hits below, penalty) for unanchored mixed stores.
MIXED_PENALTIES = (("pet", 120, 3, 15), ("bag", 100, 2, 10), ("garden", 80, 2, 12), ("auto", 40, 2, 12))
# Two categories whose tie at the top counts as classified for both.
TIE_PAIR = ("camera", "electronics")
MIN_SCORE, MIN_MARGIN = 14, 6
DIRECT_SCORE = 100
KEPT_HITS = 3


def signal_terms(rules: DataFrame) -> DataFrame:
    """Rules (category, kind, phrase, ord) as (field, signal, category, term, ord); ignored ones left out.

    Kinds are ``domain``, ``phrase``, ``strong`` and ``ignored``; strong phrases count as phrases too.
    """
    plain = rules.withColumn("_plain", normalize_text("phrase", "word"))
    ignored = plain.where("kind = 'ignored'").select("category", "_plain", F.lit(True).alias("_ignored")).distinct()
    signals = F.array(*[F.struct(
        F.lit(s.field).alias("field"), F.lit(s.name).alias("signal"), F.lit(s.kind).alias("wanted"),
        F.lit(s.compact).alias("compact"), F.lit(s.min_len).alias("min_len")) for s in SIGNALS])
    rows = plain.join(ignored, ["category", "_plain"], "left").select("*", F.explode(signals).alias("s")).select("*", "s.*")
    as_phrase = (F.col("wanted") == "phrase") & F.col("kind").isin("phrase", "strong") & F.col("_ignored").isNull()
    usable = rows.where(as_phrase | ((F.col("wanted") != "phrase") & (F.col("kind") == F.col("wanted"))))
    term = F.when(F.col("compact"), normalize_text("_plain", "compact")).otherwise(F.col("_plain"))
    return usable.withColumn("term", term).where(F.length("term") >= F.col("min_len")).groupBy(
        "field", "signal", "category", "term").agg(F.min("ord").alias("ord"))


def store_texts(stores: DataFrame, key: str) -> DataFrame:
    """Stores (domain_compact, meta_text, titles, handles) as one row per distinct text and field."""
    single = stores.select(key, F.explode(F.create_map(
        F.lit("domain"), F.col("domain_compact"), F.lit("meta"), F.col("meta_text"))).alias("field", "text"))
    titles = stores.select(key, F.lit("title").alias("field"), F.explode("titles").alias("text"))
    handles = stores.select(key, F.lit("handle").alias("field"), F.explode("handles").alias("text"))
    return single.unionByName(titles).unionByName(handles).where(F.length("text") > 0)


def signal_hits(stores: DataFrame, key: str, rules: DataFrame) -> DataFrame:
    """Distinct (store, signal, category, term, ord): which rule terms were found where."""
    found = substring_hits(store_texts(stores, key), [key, "field"], "text", signal_terms(rules), on=["field"])
    return found.select(key, "signal", "category", "term", "ord").distinct()


def _points(s: Signal) -> Column:
    n = F.col(f"_n_{s.name}")
    if s.weight == 0:
        return F.when(n > 0, F.least(F.lit(s.cap), 8 + (n - 1) * 2)).otherwise(0)
    return F.least(F.lit(s.cap), F.least(n, F.lit(KEPT_HITS)) * s.weight)


def score_stores(stores: DataFrame, key: str, rules: DataFrame) -> DataFrame:
    """(store, category, score, matched_signals) for every category with a positive score."""
    return score_hits(stores, key, signal_hits(stores, key, rules))


def score_hits(stores: DataFrame, key: str, hits: DataFrame) -> DataFrame:
    """The scores of :func:`score_stores` out of hits that are already there."""
    # a category has a bounded list of terms, so each collected list is bounded as well
    aggregates = []
    for s in SIGNALS:
        mine = F.when(F.col("signal") == s.name, F.struct("ord", "term"))
        aggregates += [F.count(mine).alias(f"_n_{s.name}"), F.array_sort(F.collect_list(mine)).alias(f"_t_{s.name}")]
    grouped = hits.groupBy(key, "category").agg(*aggregates)
    score = F.lit(0)
    notes = []
    for s in SIGNALS:
        score = score + _points(s)
        names = F.array_join(F.transform(F.slice(f"_t_{s.name}", 1, KEPT_HITS), lambda t: t["term"]), ", ")
        notes.append(F.when(F.col(f"_n_{s.name}") > 0, F.concat(F.lit(f"{s.name}:"), names)))
    anchored = (F.col("_n_domain") > 0) | (F.col("_n_meta") > 0) | (F.col("_n_strong_meta") > 0)
    strong = F.col("_n_strong_meta") + F.col("_n_strong_title") + F.col("_n_strong_handle")
    sized = grouped.join(stores.select(key, "collection_count"), key)
    penalty, tag = F.lit(0), F.lit(None).cast("string")
    for category, collections, below, minus in MIXED_PENALTIES:
        mixed = (F.col("category") == category) & ~anchored & (F.col("collection_count") >= collections) & (strong < below)
        penalty = F.when(mixed, minus).otherwise(penalty)
        tag = F.when(mixed, f"focus_penalty:{category}_mixed_store").otherwise(tag)
    return sized.select(
        key, "category", F.greatest(F.lit(0), score - penalty).alias("score"),
        F.array_compact(F.array(*notes, tag)).alias("matched_signals")).where("score > 0")


def domain_direct(stores: DataFrame, key: str, rules: DataFrame) -> DataFrame:
    """(store, category, matched) by keywords inside the domain: longest, then most, then longest in
    total; a tie between categories gives none."""
    terms = signal_terms(rules).where("signal = 'domain'")
    texts = store_texts(stores, key).where("field = 'domain'")
    return direct_hits(key, substring_hits(texts, [key, "field"], "text", terms, on=["field"]))


def direct_hits(key: str, hits: DataFrame) -> DataFrame:
    """The choice of :func:`domain_direct` out of domain hits that are already there."""
    ranked = hits.groupBy(key, "category").agg(
        F.max(F.length("term")).alias("longest"), F.count(F.lit(1)).alias("hits"), F.sum(F.length("term")).alias("total"),
        F.array_sort(F.collect_list(F.struct((-F.length("term")).alias("n"), "term"))).alias("_terms"))
    order = [F.col("longest").desc(), F.col("hits").desc(), F.col("total").desc(), F.col("category")]
    two = best_and_runner_up(ranked.withColumn("_rank_key", F.struct("longest", "hits", "total")), [key], order, "_rank_key", ["category", "_terms"])
    clear = two.where("second_value IS NULL OR second_value <> best_value")
    names = F.array_join(F.transform(F.slice("_terms", 1, KEPT_HITS), lambda t: t["term"]), ", ")
    return clear.select(key, "category", F.concat(F.lit("domain_direct:"), names).alias("matched"))


def best_and_runner_up(df: DataFrame, keys: list[str], order: list[Column], value: str, carry: list[str]) -> DataFrame:
    """Best row per key with its value and the value (and first carried column) of the runner-up."""
    top = top_per_group(df, keys, order, 2, rank="_place")
    window = Window.partitionBy(*keys).orderBy("_place")
    return (
        top.withColumn("second_value", F.lead(value).over(window)).withColumn("second_name", F.lead(carry[0]).over(window))
        .where("_place = 1").select(*keys, *carry, F.col(value).alias("best_value"), "second_value", "second_name")
    )


def classify_stores(stores: DataFrame, key: str, rules: DataFrame, min_score: int = MIN_SCORE, min_margin: int = MIN_MARGIN) -> DataFrame:
    """Status, best and second category with scores for every store.

    Stores carry ``domain_compact``, ``meta_text``, ``titles``, ``handles``, ``collection_count`` and
    the flags ``is_shop``, ``has_arabic`` and ``fetch_failed``.
    """
    # texts are read once; the hits are a small part of them and serve all decisions
    hits = cut_lineage(signal_hits(stores, key, rules))
    direct = direct_hits(key, hits.where("signal = 'domain'")).select(key, F.col("category").alias("_direct"), F.col("matched").alias("_direct_note"))
    scores = score_hits(stores, key, hits)
    order = [F.col("score").desc(), F.col("category")]
    two = best_and_runner_up(scores, [key], order, "score", ["category", "matched_signals"]).select(
        key, F.col("category").alias("_best"), F.col("best_value").alias("_score"), F.col("second_name").alias("_second"),
        F.coalesce("second_value", F.lit(0)).alias("_second_score"), "matched_signals")
    tied = scores.join(two.select(key, "_score"), key).where(
        (F.col("score") == F.col("_score")) & F.col("category").isin(*TIE_PAIR)).groupBy(key).agg(F.count(F.lit(1)).alias("_tied"))
    facts = stores.select(key, "domain_compact", "is_shop", "has_arabic", "fetch_failed").join(direct, key, "left").join(two, key, "left").join(tied, key, "left")
    pair = F.coalesce(F.col("_tied") == 2, F.lit(False))
    margin = F.col("_score") - F.col("_second_score")
    status = (
        F.when(F.coalesce("domain_compact", F.lit("")) == "", "invalid_url").when(F.col("has_arabic"), "arabic_content")
        .when(~F.col("is_shop") & F.col("fetch_failed"), "fetch_failed").when(~F.col("is_shop"), "not_shopify")
        .when(F.col("_direct").isNotNull(), "classified").when(F.col("_best").isNull(), "no_match")
        .when(pair, "classified").when((F.col("_score") >= min_score) & (margin >= min_margin), "classified")
        .otherwise("low_confidence")
    )
    judged = facts.withColumn("status", status)
    scored = F.col("status").isin("classified", "low_confidence")
    by_domain = scored & F.col("_direct").isNotNull()
    return judged.select(
        key, "status",
        F.when(by_domain, F.col("_direct")).when(scored & pair, TIE_PAIR[0]).when(scored, F.col("_best")).alias("best_category"),
        F.when(by_domain, DIRECT_SCORE).when(scored, F.col("_score")).alias("best_score"),
        F.when(by_domain, "").when(scored & pair, TIE_PAIR[1]).when(scored, F.coalesce("_second", F.lit(""))).alias("second_category"),
        F.when(by_domain, 0).when(scored & pair, F.col("_score")).when(scored, F.col("_second_score")).alias("second_score"),
        F.when(by_domain, F.array("_direct_note")).when(scored, F.col("matched_signals")).alias("matched_signals"),
        (scored & ~by_domain & pair).alias("is_tie"))


def route_stores(classified: DataFrame, key: str) -> DataFrame:
    """(store, target) rows of the classified stores; a tied pair goes to both categories."""
    targets = F.when(F.col("is_tie"), F.array("best_category", "second_category")).otherwise(F.array("best_category"))
    return classified.where("status = 'classified'").select(key, F.explode(targets).alias("target"))
