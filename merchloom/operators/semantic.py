"""Nearest category vectors for rows that bring their own vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchloom.operators.ranking import first_per_key, numbered
from merchloom.session import cut_lineage, ship_code

#: Index entries of a block, rows of a part, blocks whose pivots make one row, leading signs that put like vectors together.
BLOCK_VECTORS, PART_ROWS, PIVOTS, SIGNS = 4096, 2048, 1024, 16
MAIN_MIN, PATH_MIN = 0.4, 0.5


def centroids(df: DataFrame, label: str, vector: str) -> DataFrame:
    """Mean vector per label; summed per position, so that a hot label is pre-aggregated."""
    places = df.select(label, F.posexplode(vector).alias("_i", "_x"))
    means = places.groupBy(label, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_x"))
    # one short array per label: as many entries as the vectors have dimensions
    packed = means.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("_i", "_x"))).alias("_v"))
    return packed.select(label, F.transform("_v", lambda e: e["_x"]).alias("vector"))


def _whole(vector: str) -> Column:
    return F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull())


def _unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms == 0, 1.0, norms)


@dataclass(frozen=True)
class _Scoring:
    """How rows are ranked against index entries, and how high the rank can be at most inside a block.

    ``rank`` takes unit row vectors, one matrix of unit vectors per index vector and the depths, and gives rank and similarity per row and
    entry; ``bound`` takes one upper bound of the cosine per row and index vector, and the greatest depth. A rank of -inf is no match.
    """

    rank: Callable[[np.ndarray, list[np.ndarray], np.ndarray], tuple[np.ndarray, np.ndarray]]
    bound: Callable[[list[np.ndarray], int], np.ndarray]


def _packed_rows(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``part, keys, vectors``: rows as unit vectors in parts of ``PART_ROWS``, where they lie."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for at in range(0, batch.num_rows, PART_ROWS):
                piece = batch.slice(at, PART_ROWS)
                keys = pa.ListArray.from_arrays(pa.array([0, piece.num_rows], pa.int32()), piece.column(0))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number]), keys, pa.array([_matrix(piece.column(1)).tobytes()], pa.binary())], ["part", "keys", "vectors"])
                number += 1

    kind = df.schema[key].dataType.simpleString()
    return cut_lineage(df.select(key, vector).mapInArrow(pack, f"part long, keys array<{kind}>, vectors binary"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit vectors of a list column."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return _unit(flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0)))


def _packed_index(index: DataFrame, order: str, label: str, vectors: list[str], depth: str) -> tuple[DataFrame, int]:
    """Blocks of the index, and their number: entries of like signs lie together, sorted by ``order`` inside a block.

    ``block, orders, labels, depths``, per vector its matrix, the centre of the block and the widest angle to it.
    """
    signs = F.transform(F.slice(vectors[-1], 1, SIGNS), lambda x: x > 0)
    rows = numbered(index.select(F.col(order).alias("_o"), F.col(label).alias("_l"), F.col(depth).cast("int").alias("_d"), signs.alias("_s"), *vectors),
                    [F.col("_s"), F.col("_o")], "_n", 0)

    def pack(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by("_o")
        mats = [_matrix(group.column(v).combine_chunks()) for v in vectors]
        centres = [_unit(m.mean(axis=0, keepdims=True)) for m in mats]
        radii = [float(np.arccos(np.clip((m @ c.T).min(), -1.0, 1.0))) for m, c in zip(mats, centres, strict=True)]
        lists = {name: pa.ListArray.from_arrays(pa.array([0, len(group)], pa.int32()), group.column(of).combine_chunks())
                 for name, of in (("orders", "_o"), ("labels", "_l"), ("depths", "_d"))}
        data = {"matrices": mats, "centres": centres}
        return pa.table({"block": group.column("block").slice(0, 1), **lists, "radii": pa.array([radii], pa.list_(pa.float64())), **{
            name: pa.array([[m.tobytes() for m in found]], pa.list_(pa.binary())) for name, found in data.items()}})

    kinds = [index.schema[c].dataType.simpleString() for c in (order, label)]
    blocks = rows.withColumn("block", F.floor(F.col("_n") / BLOCK_VECTORS)).groupBy("block").applyInArrow(
        pack, f"block long, orders array<{kinds[0]}>, labels array<{kinds[1]}>, depths array<int>, radii array<double>, matrices array<binary>, centres array<binary>")
    blocks = cut_lineage(blocks)
    return blocks, blocks.count()


def _best(rows: DataFrame, key: str, vector: str, index: DataFrame, order: str, label: str, vectors: list[str], depth: str, scoring: _Scoring) -> DataFrame:
    """``key, label, similarity, rank``: the entry of the highest rank per row, then the first in order; rows without a match are left out.

    An exact join with pivots. Rows first meet the blocks whose centres are nearest to some of them; the centres
    and radii then tell which other blocks can hold a better entry for any row of a part, and only those pairs are
    compared. Rows and index are read once, and nothing of the index passes the driver.
    """
    ship_code(rows.sparkSession)
    parts = _packed_rows(rows, key, vector)
    blocks, total = _packed_index(index, order, label, vectors, depth)
    # the pivots of many blocks make one row
    pivots = blocks.select(F.floor(F.col("block") / PIVOTS).alias("group"), F.struct(
        "block", "centres", "radii", F.array_max("depths").alias("depth")).alias("one")).groupBy("group").agg(F.array_sort(F.collect_list("one")).alias("pivots"))
    pivots = cut_lineage(pivots)
    groups = F.explode(F.sequence(F.lit(0), F.lit(max(0, -(-total // PIVOTS) - 1))).cast("array<long>")).alias("group")

    def cosines(held: np.ndarray, pivot: dict) -> list[np.ndarray]:
        return [np.clip(held @ np.frombuffer(c), -1.0, 1.0) for c in pivot["centres"]]

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                held = np.frombuffer(row["vectors"]).reshape(row["n"], -1)
                near = np.array([sum(cosines(held, p)) for p in row["pivots"]])
                found = sorted({row["pivots"][k]["block"] for k in near.argmax(axis=0)})
                yield pa.RecordBatch.from_arrays([pa.array([row["part"]] * len(found), pa.int64()), pa.array(found, pa.int64())], ["part", "block"])

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            types = batch.schema.field("labels").type.value_type, batch.schema.field("orders").type.value_type
            for row in batch.to_pylist():
                held = np.frombuffer(row["vectors"]).reshape(row["n"], -1)
                mats = [np.frombuffer(m).reshape(len(row["labels"]), -1) for m in row["matrices"]]
                rank, similarity = scoring.rank(held, mats, np.array(row["depths"]))
                best = np.argmax(rank, axis=1)
                at = np.flatnonzero(rank[np.arange(len(held)), best] > -np.inf)
                best = best[at]
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["part"]] * len(at), pa.int64()), pa.array(at.astype(np.int32)), pa.array([row["labels"][k] for k in best], types[0]),
                    pa.array([row["orders"][k] for k in best], types[1]), pa.array(rank[at, best]), pa.array(similarity[at, best])],
                    ["part", "at", "label", "order", "rank", "similarity"])

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                held = np.frombuffer(row["vectors"]).reshape(row["n"], -1)
                bar = np.full(len(held), -np.inf)
                for one in row["reached"] or []:
                    bar[one["at"]] = one["rank"]
                done, found = set(row["seen"] or []), []
                for pivot in row["pivots"]:
                    if pivot["block"] not in done:
                        most = [np.cos(np.maximum(np.arccos(c) - r - 1e-7, 0.0)) for c, r in zip(cosines(held, pivot), pivot["radii"], strict=True)]
                        bound = scoring.bound(most, pivot["depth"])
                        if ((bound > -np.inf) & (bound + 1e-6 >= bar)).any():
                            found.append(pivot["block"])
                yield pa.RecordBatch.from_arrays([pa.array([row["part"]] * len(found), pa.int64()), pa.array(found, pa.int64())], ["part", "block"])

    kinds = [index.schema[c].dataType.simpleString() for c in (label, order)]
    result = f"part long, at int, label {kinds[0]}, order {kinds[1]}, rank double, similarity double"
    sized = parts.withColumn("n", F.size("keys"))
    pairs = cut_lineage(sized.select("part", "n", "vectors", groups).join(pivots, "group").drop("group").mapInArrow(home, "part long, block long"))
    compare = lambda wanted: sized.select("part", "n", "vectors").join(wanted, "part").join(blocks, "block").mapInArrow(ranked, result)
    reached = cut_lineage(compare(pairs))
    bars = reached.groupBy("part", "at").agg(F.max("rank").alias("rank")).groupBy("part").agg(F.collect_list(F.struct("at", "rank")).alias("reached"))
    seen = pairs.groupBy("part").agg(F.collect_set("block").alias("seen"))
    open_pairs = sized.select("part", "n", "vectors", groups).join(bars, "part", "left").join(seen, "part", "left").join(pivots, "group").drop("group").mapInArrow(
        rest, "part long, block long")
    both = reached.unionByName(compare(cut_lineage(open_pairs)))
    first = first_per_key(both, ["part", "at"], [F.desc("rank"), F.col("order")])
    keys = parts.select("part", F.posexplode("keys").alias("at", "key"))
    return keys.join(first, ["part", "at"]).select(F.col("key").alias(key), "label", "similarity", "rank")


def nearest(df: DataFrame, key: str, vector: str, index: DataFrame, label: str, index_vector: str) -> DataFrame:
    """Label with the highest cosine per row; the lower label wins a tie.

    Rows and index entries whose vector is NULL or holds one have no label and no row here. The index may have any size; see :func:`_best`.
    """
    def rank(rows: np.ndarray, mats: list[np.ndarray], depths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        similarity = rows @ mats[0].T
        return np.round(similarity, 9), similarity

    entries = index.where(_whole(index_vector)).select(F.col(label).alias("_label"), F.col(label).alias("_order"), F.col(index_vector).alias("_vector"), F.lit(0).alias("_depth"))
    scoring = _Scoring(rank, lambda most, depth: most[0])
    found = _best(df.where(_whole(vector)), key, vector, entries, "_order", "_label", ["_vector"], "_depth", scoring)
    return found.select(key, F.col("label").alias(label), "similarity")


def classify(df: DataFrame, key: str, vector: str, mains: DataFrame, paths: DataFrame,
             main_min: float = MAIN_MIN, path_min: float = PATH_MIN, other: str = "Others") -> DataFrame:
    """Category path per row: main category at or above its threshold, then the best path below it.

    A deeper path wins when it reaches ``path_min``; otherwise the mean of both cosines decides.
    Rows without a whole vector are ``other``. Tables: ``mains(main, vector)`` and ``paths(main, path, depth, vector)``.
    """
    def rank(rows: np.ndarray, mats: list[np.ndarray], depths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        main, path = rows @ mats[0].T, rows @ mats[1].T
        mean = np.round((main + path) / 2, 9)
        # depth first, then the mean
        return np.where(main >= main_min, np.where(path >= path_min, depths, 0) * 10.0 + mean, -np.inf), mean

    def bound(most: list[np.ndarray], depth: int) -> np.ndarray:
        main, path = most
        return np.where(main + 1e-9 >= main_min, np.where(path + 1e-9 >= path_min, depth, 0) * 10.0 + (main + path) / 2, -np.inf)

    tops = mains.where(_whole("vector")).select("main", F.col("vector").alias("_main"))
    entries = paths.where(_whole("vector")).join(tops, "main").select(
        F.concat_ws("|||", "main", "path").alias("_label"), F.concat_ws("\u0001", "main", "path").alias("_order"), "_main", F.col("vector").alias("_path"), "depth")
    found = _best(df.where(_whole(vector)), key, vector, entries, "_order", "_label", ["_main", "_path"], "depth", _Scoring(rank, bound))
    return df.join(found.select(key, F.col("label").alias("category")), key, "left").withColumn("category", F.coalesce("category", F.lit(other)))
