"""Mixing sources to target weights by weighted sampling without replacement.

Each source has a target number of words. Whole epochs take every document of a source; the rest of the
target goes to the documents with the smallest exponential keys ``-ln(u) / quality``, ``u`` a number drawn
from the document's id. Sorted by key, documents are taken while their middle lies within the rest, so a source
ends within half a document of its target.

Prefix sums are taken over ranges of keys first, pre-aggregated per task; single documents are only
ordered in the one range of each source where its rest ends. That fixes one cut per source, and every
document compares itself with the cut of its source: no text is moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merchloom.operators.ranking import numbered
from merchloom.session import cut_lineage

#: Key ranges per unit of the exponential key; a power of two, so that ranges are exact.
RANGES = 4096
#: Up to so many sources their cuts are sent to every task; beyond it rows and cuts are shuffled.
BROADCAST_SOURCES = 10_000
MOST_EPOCHS = 3
_BLANKS = " \t\n\x0b\x0c\r"


def word_count(text: Column) -> Column:
    """Runs of characters other than the six ASCII blanks; 0 for null."""
    inner = F.btrim(text, F.lit(_BLANKS))
    runs = F.regexp_count(inner, F.lit("[ \\t-\\r]+"))
    return F.when(text.isNull() | (inner == ""), F.lit(0)).otherwise(runs + 1).cast("long")


def symbol_quality(text: Column) -> Column:
    """1 for a text without symbols, less the more of its characters are symbols."""
    chars = F.coalesce(F.length(text), F.lit(0))
    kept = F.coalesce(F.length(F.translate(text, "#*$%&|<>", "")), F.lit(0))
    return F.lit(1.0) / (F.lit(1.0) + F.lit(20.0) * (chars - kept).cast("double") / F.greatest(chars, F.lit(1)).cast("double"))


def exponential_key(item: Column, quality: Column) -> Column:
    """``-ln(u) / quality`` with ``u`` from 52 bits of the MD5 of the item; ``quality`` must be positive."""
    drawn = F.conv(F.substring(F.md5(item.cast("binary")), 1, 13), 16, 10).cast("double")
    return -F.ln((drawn + F.lit(1.0)) / F.lit(float(2**52 + 1))) / quality


def keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> list[Column]:
    """The columns a decision needs: ``_source, _item, _size, _key, _range``; a null id is an empty one."""
    item = F.coalesce(docs[id_col].cast("string"), F.lit(""))
    key = exponential_key(item, symbol_quality(docs[text_col]))
    return [docs[source_col].alias("_source"), item.alias("_item"), word_count(docs[text_col]).alias("_size"),
            key.alias("_key"), F.floor(key * RANGES).alias("_range")]


def targets(rows: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """``_source, _source_size, _target``: shares by repeating weights, at most ``MOST_EPOCHS`` times a source.

    Sources are numbered by code point, null last. What a full source can't take is shared again by
    weight among the others; each round is one aggregate over the sources.
    """
    sizes = rows.groupBy("_source").agg(F.sum("_size").alias("_source_size"))
    order = [F.col("_source").asc_nulls_last()]
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("_number"), F.lit(len(weights))) + 1).cast("int"))
    ranked = cut_lineage(numbered(sizes, order, "_number", 0).select("_source", "_source_size", weight.alias("_weight")))
    limit = F.col("_source_size") * MOST_EPOCHS
    level, before = 0.0, None
    while level != before:
        full = limit <= F.lit(level) * F.col("_weight") if before is not None else F.lit(False)
        taken, free, total = ranked.agg(
            F.sum(F.when(full, limit).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("_weight"))), F.sum("_source_size")).first()
        before, level = level, (total - taken) / free if free else level
    return ranked.select("_source", "_source_size", F.least(limit.cast("double"), F.lit(level) * F.col("_weight")).alias("_target"))


def cuts(rows: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Per source: ``_source_size, _target, _epochs`` and the last key range, key and item taken once more."""
    goal = cut_lineage(targets(rows, weights))
    epochs = F.when(F.col("_source_size") > 0, F.floor(F.col("_target") / F.col("_source_size"))).otherwise(0)
    goal = goal.select("*", epochs.alias("_epochs")).withColumn("_rest", F.col("_target") - F.col("_epochs") * F.col("_source_size"))
    ranges = rows.groupBy("_source", "_range").agg(F.sum("_size").alias("_words"))
    upto = Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    passed = ranges.select("_source", "_range", "_words", (F.sum("_words").over(upto) - F.col("_words")).alias("_before")).alias("p")
    # the last range that begins within the rest; all ranges before it are taken whole
    g = goal.alias("g")
    last = passed.join(g, F.col("p._source").eqNullSafe(F.col("g._source"))).where("p._before <= g._rest").groupBy("p._source").agg(
        F.max(F.struct("p._range", "p._before", "g._rest")).alias("at")).select("_source", "at.*").alias("l")
    r = rows.alias("r")
    inside = r.join(last, F.col("r._source").eqNullSafe(F.col("l._source")) & (F.col("r._range") == F.col("l._range"))).groupBy(
        "r._source", "r._range", "r._key", "r._item").agg(F.sum("r._size").alias("_words"), F.first("l._before").alias("_start"), F.first("l._rest").alias("_rest"))
    ordered = Window.partitionBy("_source").orderBy("_key", "_item").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = F.col("_start") + F.sum("_words").over(ordered) - F.col("_words") / F.lit(2.0)
    taken = inside.select("_source", "_key", "_item", (middle <= F.col("_rest")).alias("_in")).where("_in").groupBy("_source").agg(
        F.max(F.struct("_key", "_item")).alias("_cut")).alias("t")
    return g.join(last, F.col("g._source").eqNullSafe(F.col("l._source")), "left").join(
        taken, F.col("g._source").eqNullSafe(F.col("t._source")), "left").select(
        "g._source", "g._source_size", "g._target", "g._epochs", F.col("l._range").alias("_last_range"),
        F.col("t._cut._key").alias("_cut_key"), F.col("t._cut._item").alias("_cut_item"))


def times(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` with ``_source_size, _target`` and ``_times``, how often the mix takes each.

    Rows of one source and id are taken or left together. The cuts must be materialised.
    """
    r, c = rows.alias("r"), found.alias("c")
    side = F.broadcast(c) if found.count() <= BROADCAST_SOURCES else c
    within = (F.col("r._key") < F.col("c._cut_key")) | (F.col("r._key") == F.col("c._cut_key")) & (F.col("r._item") <= F.col("c._cut_item"))
    beyond = (F.col("r._range") < F.col("c._last_range")) | (F.col("r._range") == F.col("c._last_range")) & F.coalesce(within, F.lit(False))
    more = beyond & (F.col("r._size") > 0)  # a text without words is no part of the rest
    return r.join(side, F.col("r._source").eqNullSafe(F.col("c._source"))).select(
        "r.*", "c._source_size", "c._target", (F.col("c._epochs") + F.coalesce(more, F.lit(False)).cast("long")).alias("_times"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """The mixed documents: each as often as the mix takes it, with the columns of ``docs``.

    Null and empty texts weigh nothing: they follow the epochs of their source, and are never counted.
    """
    found = cut_lineage(cuts(cut_lineage(docs.select(*keyed(docs, id_col, text_col, source_col))), weights))
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_doc"), *keyed(docs, id_col, text_col, source_col))
    taken = times(whole, found).where("_times > 0")
    return taken.select("_doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times")))).select("_doc.*")


def amounts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
            weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every row of ``docs``."""
    rows = cut_lineage(docs.select(docs[id_col].alias("doc_id"), *keyed(docs, id_col, text_col, source_col)))
    found = cut_lineage(cuts(rows.drop("doc_id"), weights))
    return times(rows, found).select(
        "doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"),
        (F.col("_size") * F.col("_times")).alias("taken"))


#: The rows of ``amounts`` over the table ``documents``.
ORACLE = r"""
WITH doc AS (
  SELECT doc_id, source, coalesce(CAST(doc_id AS VARCHAR), '') AS item,
         coalesce(len(regexp_extract_all(text, '[^ \t-\r]+')), 0) AS size,
         coalesce(length(text), 0) AS chars,
         coalesce(length(text), 0) - coalesce(length(translate(text, '#*$%&|<>', '')), 0) AS signs
  FROM documents
), keyed AS (
  SELECT *, -ln((CAST(CAST('0x' || substr(md5(item), 1, 13) AS BIGINT) AS DOUBLE) + 1.0) / 4503599627370497.0)
            / (1.0 / (1.0 + 20.0 * CAST(signs AS DOUBLE) / CAST(greatest(chars, 1) AS DOUBLE))) AS key
  FROM doc
), src AS (
  SELECT source, sum(size) AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight
  FROM keyed GROUP BY source
), full_order AS (
  SELECT *, 3 * source_size / weight AS ratio,
         sum(source_size) OVER () AS total, sum(weight) OVER () AS all_weight,
         row_number() OVER (ORDER BY 3 * source_size / weight, source NULLS LAST) AS n
  FROM src
), levels AS (
  SELECT *, (total - (coalesce(sum(3 * source_size) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))
            / CAST(all_weight - coalesce(sum(weight) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS level
  FROM full_order
), goal AS (
  SELECT source, CAST(source_size AS BIGINT) AS source_size,
         least(CAST(3 * source_size AS DOUBLE), weight * (SELECT arg_min(level, n) FROM levels WHERE level <= ratio)) AS target
  FROM src
), epochs AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM goal
), placed AS (
  SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
         sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.item) AS upto,
         sum(k.size) OVER (PARTITION BY k.source, k.key, k.item) AS own
  FROM keyed k JOIN epochs e ON k.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * (epochs + CASE WHEN upto - own / 2.0 <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM placed
"""
