"""Merkle manifest of a dataset: leaves per source, a tree over each source, a tree over the sources.

Nodes of a tree are grouped by ``FAN``; what is left of a level alone is a run too and is hashed. Only every ``LEVELS``-th level is
stored. The nodes between two stored levels belong to aligned subtrees of at most ``FAN ** LEVELS`` stored descendants, so a
subtree is one small group: building hashes it up to its stored top, and extracting proofs hashes it once more, reads the
siblings of every descendant off it and lets it go. The siblings above a stored node are found once for that
node and shared by all its descendants, from the root downwards.

A proof is an array of steps from the leaf to the root. A step is what the run's hash is taken of, with ``*`` in place of the node
on the way; ``fold`` takes a leaf through it. Places come from a range partition with offsets, so a source of any size is numbered and
grouped by many tasks; the driver learns the height of the highest tree and the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchloom.llm.checksums import CRC_TABLE, crc32_sql
from merchloom.llm.shingles import stored
from merchloom.operators.ranking import numbered
from merchloom.session import ship_code

FAN = 3
#: Levels from one stored level to the next; a subtree has at most FAN ** LEVELS = 729 stored descendants.
LEVELS = 6
SUBTREE = FAN ** LEVELS
#: No tree is higher: FAN ** 39 is the last power that fits into a long.
_HIGHEST = 39
#: Stands for the node in a step of its proof.
OWN = "*"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of strings joined together."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """A value as ``bytes:value``, a null as ``-``."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return digest(*map(field, values))


def _hash(parts: Sequence[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def climb(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes of a subtree, level by level, ``levels`` times upwards."""
    found = [nodes]
    for _ in range(levels):
        below = found[-1]
        found.append([_hash(below[i:i + FAN]) for i in range(0, len(below), FAN)])
    return found


def steps_of(nodes: list[str], levels: int) -> list[list[str]]:
    """For each node of a subtree the steps to the subtree's top."""
    found = climb(nodes, levels)
    out = []
    for place in range(len(nodes)):
        steps = []
        for level in found[:levels]:
            start = place - place % FAN
            steps.append("".join([*level[start:place], OWN, *level[place + 1:start + FAN]]))
            place //= FAN
        out.append(steps)
    return out


def height(size: Column) -> Column:
    """How often a level of that many nodes is grouped until one is left."""
    return F.size(F.filter(F.array(*[F.lit(FAN ** k).cast("long") for k in range(_HIGHEST + 1)]), lambda power: power < size))


@dataclass
class Forest:
    """Trees by number: the stored levels, lowest first, and a root per tree.

    ``levels[j]`` has ``tree, height, place, node`` of the trees with more than ``(j - 1) * LEVELS`` levels, the lowest may have more columns.
    """

    levels: list[DataFrame]
    roots: DataFrame


def _subtrees(level: DataFrame, at: int) -> DataFrame:
    """``tree, chunk, height, rise, nodes`` of the subtrees over a stored level that are to be climbed; other columns of it go with the nodes."""
    more = [c for c in level.columns if c not in ("tree", "height")]
    rise = F.least(F.lit(LEVELS), F.col("height") - at * LEVELS).cast("int")
    return level.where(F.col("height") > at * LEVELS).groupBy("tree", F.floor(F.col("place") / SUBTREE).alias("chunk")).agg(
        F.first("height").alias("height"), F.array_sort(F.collect_list(F.struct(*more))).alias("nodes")).select(
            "tree", "chunk", "height", rise.alias("rise"), "nodes")


def _digests(column: pa.ListArray) -> Iterator[list[str]]:
    """The ``node`` values of each row of an array of structs."""
    nodes = column.values.field("node")
    offsets = column.offsets.to_pylist()
    for start, end in zip(offsets[:-1], offsets[1:], strict=True):
        yield nodes.slice(start, end - start).to_pylist()


def grow(nodes: DataFrame) -> Forest:
    """The trees over ``tree, height, place, node``; places count from 0 without gaps, heights follow from the sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tops = [climb(found, rise)[-1][0] for found, rise in zip(_digests(batch.column(4)), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(tops, pa.string())], ["tree", "place", "height", "node"])

    levels = [nodes]
    top = nodes.agg(F.max("height")).first()[0] or 0
    for at in range(-(-top // LEVELS)):
        found = _subtrees(levels[-1].select("tree", "height", "place", "node"), at)
        levels.append(stored(found.mapInArrow(run, "tree long, place long, height int, node string"), "merkle"))
    roots = [level.where(F.col("height") <= at * LEVELS).select("tree", "node") for at, level in enumerate(levels)]
    return Forest(levels, reduce(DataFrame.unionByName, roots))


def descend(forest: Forest, above: DataFrame) -> DataFrame:
    """``steps``, the proof, for every node of the lowest level, with the columns of that level but ``height``.

    ``above`` has per tree the ``steps`` that lead from its root further up; its other columns are handed down.
    """
    carried = [c for c in above.columns if c not in ("tree", "steps")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [steps_of(found, rise) for found, rise in zip(_digests(batch.column(2)), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *batch.columns[2:], pa.array(own, pa.list_(pa.list_(pa.string())))], [batch.schema.names[0], *batch.schema.names[2:], "own"])

    upper = None
    for at in reversed(range(len(forest.levels))):
        level = forest.levels[at]
        more = [c for c in level.columns if c not in ("tree", "height")]
        found = level.where(F.col("height") <= at * LEVELS).join(above, "tree").select("tree", *more, "steps", *carried)
        if upper is not None:
            parents = upper.select("tree", F.col("place").alias("chunk"), "steps", *carried)
            joined = _subtrees(level, at).join(parents, ["tree", "chunk"]).select("tree", "rise", "nodes", "steps", *carried)
            fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in joined.schema if f.name != "rise")
            each = joined.mapInArrow(run, f"{fields}, own array<array<string>>").select(
                "tree", "steps", *carried, F.explode(F.arrays_zip("nodes", "own")).alias("one"))
            found = found.unionByName(each.select(
                "tree", *[F.col(f"one.nodes.{c}").alias(c) for c in more], F.concat("one.own", "steps").alias("steps"), *carried))
        upper = stored(found, "merkle-steps") if at else found
    return upper


def fold(claim: Column, steps: Column) -> Column:
    """The root that a leaf leads to through the steps of a proof."""
    return F.aggregate(steps, claim, lambda node, step: digest(F.replace(step, F.lit(OWN), node)))


def proof_digest(steps: Column) -> Column:
    """One digest of all siblings of a proof, level by level, left to right."""
    return digest(F.replace(F.array_join(steps, ""), F.lit(OWN), F.lit("")))


def prove(leaves: DataFrame, key_col: str = "key", part_col: str = "part", leaf_col: str = "leaf") -> DataFrame:
    """All columns of ``leaves`` with ``subroot, root`` and ``steps``, the proof of each leaf.

    Leaves ascend by key in their part, parts ascend too, nulls first and strings by their bytes; leaves of one key ascend by
    digest, repeated rows are leaves of their own. A part of one leaf has that leaf as its root, one part alone has the root
    of all. An empty table gives none. A leaf must not be null.
    """
    ship_code(leaves.sparkSession)
    rows = leaves.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(leaves.columns)]).alias("row"),
                         F.col(part_col).alias("part"), F.col(key_col).alias("key"), F.col(leaf_col).alias("node"))
    rows = numbered(rows, [F.col("part").asc_nulls_first(), F.col("key").asc_nulls_first(), F.col("node")], "number", 0)
    parts = rows.groupBy(F.col("part").alias("name")).agg(F.min("number").alias("first"), F.count(F.lit(1)).alias("size"))
    parts = numbered(parts, [F.col("name").asc_nulls_first()], "tree", 0)
    trees = grow(rows.join(parts, F.col("part").eqNullSafe(F.col("name"))).select(
        "tree", height(F.col("size")).cast("int").alias("height"), (F.col("number") - F.col("first")).alias("place"), "node", "row"))
    subroots = stored(trees.roots, "merkle-roots")
    size = F.lit(subroots.count())
    crown = grow(subroots.select(F.lit(0).cast("long").alias("tree"), height(size).cast("int").alias("height"), F.col("tree").alias("place"), "node"))
    root = crown.roots.first()
    none = leaves.sparkSession.range(1).select(F.lit(0).cast("long").alias("tree"), F.array().cast("array<string>").alias("steps"))
    tops = stored(descend(crown, none).select(F.col("place").alias("tree"), F.col("node").alias("subroot"), "steps"), "merkle-tops")
    return descend(trees, tops).select(
        *[F.col(f"row.c{i}").alias(c) for i, c in enumerate(leaves.columns)], "subroot", F.lit(root["node"] if root else None).cast("string").alias("root"), "steps")


def _sql_field(name: str) -> str:
    text = f"CAST({name} AS VARCHAR)"
    return f"coalesce(octet_length(encode({text})) || ':' || {text}, '-')"


def _oracle(fan: int = FAN) -> str:
    """All levels of all trees by recursion, then every leaf's way up through them."""
    fields = lambda text: " || ".join(map(_sql_field, ("doc_id", "source", "lang", "n_chars", text)))
    grow_up = lambda name, first: f"""{name} AS (
    {first}
    UNION ALL
    SELECT tree, lvl + 1, run, sha256(string_agg(node, '' ORDER BY place)), any_value((cnt + {fan - 1}) // {fan})
    FROM (SELECT *, place // {fan} AS run FROM {name} WHERE cnt > 1) GROUP BY tree, lvl, run)"""  # noqa: E731
    runs = lambda name: f"""{name}_runs AS (
    SELECT tree, lvl, place // {fan} AS run, list(node ORDER BY place) AS nodes FROM {name} WHERE cnt > 1 GROUP BY ALL)"""  # noqa: E731
    walk = lambda name, of, start: f"""{name} AS (
    {start}
    UNION ALL
    SELECT w.item, w.tree, w.lvl + 1, w.place // {fan}, w.sibs || array_to_string(nodes[1:place % {fan}] || nodes[place % {fan} + 2:], ''),
        sha256(array_to_string(nodes[1:place % {fan}] || [w.node] || nodes[place % {fan} + 2:], ''))
    FROM {name} w JOIN {of}_runs r ON r.tree = w.tree AND r.lvl = w.lvl AND r.run = w.place // {fan}),
{name}_end AS (SELECT * FROM {name} QUALIFY row_number() OVER (PARTITION BY item ORDER BY lvl DESC) = 1)"""  # noqa: E731
    return f"""
WITH RECURSIVE {CRC_TABLE},
tampered AS (
    SELECT *, CASE WHEN {crc32_sql("CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS claimed
    FROM documents, tab),
hashed AS (SELECT doc_id, source, sha256({fields("text")}) AS leaf, sha256({fields("claimed")}) AS claim FROM tampered),
leaves AS (
    SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER () AS item,
        row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS cnt
    FROM hashed),
{grow_up("trees", "SELECT tree, 0 AS lvl, place, leaf AS node, cnt FROM leaves")},
subroots AS (SELECT tree, node FROM trees WHERE cnt = 1),
{grow_up("crown", "SELECT 0 AS tree, 0 AS lvl, tree AS place, node, (SELECT count(*) FROM subroots) AS cnt FROM subroots")},
top AS (SELECT node AS root FROM crown WHERE cnt = 1),
{runs("trees")},
{runs("crown")},
{walk("inner", "trees", "SELECT item, tree, 0 AS lvl, place, '' AS sibs, claim AS node FROM leaves")},
{walk("outer", "crown", "SELECT item, 0 AS tree, 0 AS lvl, tree AS place, sibs, node FROM inner_end")}
SELECT l.doc_id, l.leaf, s.node AS subroot, top.root, sha256(o.sibs) AS proof_sha256, o.node AS folded_root, o.node = top.root AS verified
FROM leaves l JOIN subroots s ON s.tree = l.tree JOIN outer_end o ON o.item = l.item, top
""".replace("inner", "inward").replace("outer", "outward")


ORACLE = _oracle()
