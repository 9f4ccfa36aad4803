"""Exact top-k inner products over an impact-ordered index, read a score at a time.

Vectors are turned into integers and dealt into index blocks. In a block every component is a posting:
its impact is quantised into ``LEVELS`` levels, and postings of one level, dimension and sign make a
segment. Segments are stored by descending impact. A query block adds up the segments of an index block in
that order; a vector's unread rest is known by its length, so its score lies within ``|q| * rest`` of the
sum so far. A query stops early only if that proves that few vectors can still be among its best; those
are rescored exactly, and so are all possible members of a query that has read everything.

Every pair of blocks is a group of fixed size of its own. Queries are compared with all rows, as they must
be, but neither side is broadcast, and only the best of each pair are passed on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merchloom.session import cut_lineage

LEVELS = 32
BLOCK_ROWS = 8192
QUERY_ROWS = 512
#: A query may stop before the last segment if at most so many vectors can still be among its best.
FEW = 64
#: Shares of the unread squared length at which it is tried to prove that.
STOPS = (0.1, 0.03)
#: Components are below this bound, so that all sums of products are exact.
BOUND = 1 << 24


#: Rows of a block of vectors that are scored with whole numbers of any size.
WIDE_ROWS = 64


def integers(vector: Column, scale: int = 256) -> Column:
    """``floor(scale * x)`` of every component, as a double; null for a vector that is null or holds null, NaN or infinity."""
    scaled = F.transform(vector, lambda x: x.cast("double") * scale)
    fine = F.forall(scaled, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    # a double of 2^53 or more is whole
    return F.when(vector.isNotNull() & fine, F.transform(scaled, lambda x: F.when(F.abs(x) < F.lit(2.0**53), F.floor(x).cast("double")).otherwise(x)))


def wide(vector: Column) -> Column:
    """Too large for sums of products in a long: a component of ``BOUND`` or more, or 16,384 components or more."""
    return (F.size(vector) >= 1 << 14) | F.exists(vector, lambda x: F.abs(x) >= F.lit(float(BOUND)))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of integers; shorter vectors are filled up with zeros."""
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(values.offsets.to_numpy())
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), int(sizes.max()) if len(sizes) else 0), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def segments(vectors: np.ndarray, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(impacts, dimensions, ends, postings) of a block, by descending size of the impact.

    An impact is the middle of its level. Components of the lowest level have none and stay unread.
    """
    step = max(1, int(np.abs(vectors).max(initial=0)) // levels)
    level = np.abs(vectors) // step
    row, dim = np.nonzero(level)
    value, size = vectors[row, dim], level[row, dim]
    order = np.lexsort((row, value < 0, dim, -size))
    row, dim, impact = row[order], dim[order], (np.sign(value) * (size * step + step // 2))[order]
    if not len(row):
        return (np.zeros(0, np.int64),) * 4
    last = np.flatnonzero(np.append((impact[1:] != impact[:-1]) | (dim[1:] != dim[:-1]), True))
    return impact[last], dim[last], last + 1, row


def best(ids: np.ndarray, vectors: np.ndarray, index: tuple, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, row number, score) of the ``k`` best rows of a block for every query, ties to smaller ids."""
    width = max(vectors.shape[1], queries.shape[1])
    vectors, queries = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (vectors, queries))
    impacts, dims, ends, postings = index
    most = int(np.abs(queries).sum(axis=1).max(initial=0)) * int(np.abs(vectors).max(initial=0)) * 2
    kind = np.int32 if most < 2**31 else np.int64
    length = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
    rest = (vectors.astype(np.float64) ** 2).sum(axis=1)
    whole = rest.sum()
    sums = np.zeros((len(vectors), len(queries)), kind)
    active = np.arange(len(queries))
    weights = np.ascontiguousarray(queries.T.astype(kind))
    found: list[tuple[int, np.ndarray, np.ndarray]] = []
    stops = list(STOPS)

    def settle(last: bool) -> None:
        nonlocal sums, active, weights
        slack = np.sqrt(np.maximum(rest, 0.0))[:, None] * (length[active] * (1 + 1e-9))[None, :] + 1e-6
        own = ids[:, None] == query_ids[active][None, :]
        low = np.where(own, -np.inf, sums - slack)
        bar = np.partition(low, len(low) - k, axis=0)[len(low) - k] if len(low) >= k else np.full(len(active), -np.inf)
        possible = (sums + slack >= bar) & ~own
        done = np.full(len(active), True) if last else possible.sum(axis=0) <= FEW
        for column in np.flatnonzero(done):
            rows = np.flatnonzero(possible[:, column])
            exact = vectors[rows] @ queries[active[column]]
            top = np.lexsort((ids[rows], -exact))[:k]
            found.append((active[column], rows[top], exact[top]))
        if done.any():
            sums, active = np.ascontiguousarray(sums[:, ~done]), active[~done]
            weights = np.ascontiguousarray(weights[:, ~done])

    start = 0
    for at in range(len(ends)):
        if not len(active):
            break
        rows, impact, dim = postings[start:ends[at]], impacts[at], dims[at]
        start = ends[at]
        sums[rows] += weights[dim] * kind(impact)
        value = vectors[rows, dim].astype(np.float64)
        rest[rows] += (value - impact) ** 2 - value ** 2
        lower = at + 1 < len(ends) and abs(impacts[at + 1]) != abs(impact)
        if lower and stops and rest.sum() <= stops[0] * whole:
            stops.pop(0)
            settle(False)
    if len(active):
        settle(True)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return (np.concatenate([np.full(len(r), q) for q, r, _ in found]), np.concatenate([r for _, r, _ in found]),
            np.concatenate([s for _, _, s in found]))


def _dealt(rows: DataFrame, size: int, name: str) -> tuple[DataFrame, int]:
    """Rows dealt evenly into groups of about ``size``, and the number of groups. Results don't depend on who is where."""
    groups = max(1, -(-rows.count() // size))
    return rows.withColumn(name, F.pmod(F.monotonically_increasing_id(), F.lit(groups))), groups


def build_index(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, int]:
    """One row per block of (id, integer vector) rows: ids, vectors and segments; and the number of blocks."""

    def build(group: pa.Table) -> pa.Table:
        vectors = matrix(group.column("vector"))
        parts = (group.column("id").to_numpy().astype(np.int64), vectors, *segments(vectors))
        return pa.table({"block": group.column("block").slice(0, 1), "width": pa.array([vectors.shape[1]], pa.int32())} | {
            name: pa.array([part.astype(np.int64).tobytes() if name in ("ids", "ends") else part.astype(np.int32).tobytes()], pa.binary())
            for name, part in zip(("ids", "vectors", "impacts", "dims", "ends", "postings"), parts, strict=True)})

    dealt, blocks = _dealt(rows, block_rows, "block")
    packed = dealt.groupBy("block").applyInArrow(
        build, "block long, width int, ids binary, vectors binary, impacts binary, dims binary, ends binary, postings binary")
    return cut_lineage(packed), blocks


def _packed_queries(rows: DataFrame, query_rows: int) -> tuple[DataFrame, int]:
    def pack(group: pa.Table) -> pa.Table:
        vectors = matrix(group.column("vector"))
        return pa.table({
            "part": group.column("part").slice(0, 1), "query_width": pa.array([vectors.shape[1]], pa.int32()),
            "query_ids": pa.array([group.column("id").to_numpy().astype(np.int64).tobytes()], pa.binary()),
            "queries": pa.array([vectors.astype(np.int32).tobytes()], pa.binary())})

    dealt, parts = _dealt(rows, query_rows, "part")
    return dealt.groupBy("part").applyInArrow(pack, "part long, query_width int, query_ids binary, queries binary"), parts


def _pairs(held: DataFrame, asked: DataFrame, blocks: int) -> DataFrame:
    """Every block with every part of the queries, which is repeated for each block.

    Spark takes the repeated parts to be as small as one copy of them and would send them all through the driver, hence the hint.
    """
    repeated = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")))
    return held.join(repeated.hint("merge"), "block")


def exact(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``query_id, vec_id, score``: the ``k`` best of each block of rows for each query, with whole numbers of any size.

    A score that doesn't fit into a long is an error.
    """
    left, blocks = _dealt(rows, WIDE_ROWS, "block")
    right, _ = _dealt(queries, WIDE_ROWS, "part")
    left = left.groupBy("block").agg(F.collect_list(F.struct("id", "vector")).alias("rows"))
    right = right.groupBy("part").agg(F.collect_list(F.struct("id", "vector")).alias("queries"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pair in batch.to_pylist():
                held = [(r["id"], [int(x) for x in r["vector"]]) for r in pair["rows"]]
                out = []
                for query in pair["queries"]:
                    mine = [int(x) for x in query["vector"]]
                    scores = sorted((-sum(map(int.__mul__, mine, vector)), i) for i, vector in held if i != query["id"])[:k]
                    out += [(query["id"], i, -score) for score, i in scores]
                if any(not -2**63 <= score < 2**63 for _, _, score in out):
                    raise ValueError("a score does not fit into a long")
                yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], pa.int64()) for c in range(3)], ["query_id", "vec_id", "score"])

    return _pairs(left, right, blocks).select("rows", "queries").mapInArrow(search, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
          block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the best rows by integer inner product for each query row.

    Rows with the query's id are its own and no candidates. Vectors or ids that are null, and vectors with
    null or non-finite components, take no part. Vectors too large for the index are scored one by one, in blocks. Query rows of one
    id are answered once, for the smallest of their vectors; repeated candidates are rows of their own.
    """
    vector = integers(F.col(vector_col))
    rows = cut_lineage(vectors.select(F.col(id_col).cast("long").alias("id"), vector.alias("vector"), is_query.alias("asks")).where(
        "id IS NOT NULL AND vector IS NOT NULL").withColumn("wide", wide(F.col("vector"))))
    queries = rows.where("asks").groupBy("id").agg(F.min("vector").alias("vector")).withColumn("wide", wide(F.col("vector")))
    index, blocks = build_index(rows.where("NOT wide").select("id", "vector"), block_rows)
    asked, parts = _packed_queries(queries.where("NOT wide").select("id", "vector"), query_rows)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pair in batch.to_pylist():
                as_int, as_long = (lambda name, kind=kind: np.frombuffer(pair[name], kind) for kind in (np.int32, np.int64))  # noqa: B023
                ids, query_ids = as_long("ids"), as_long("query_ids")
                block = as_int("vectors").reshape(len(ids), pair["width"]).astype(np.int64)
                queries = as_int("queries").reshape(len(query_ids), pair["query_width"]).astype(np.int64)
                segment = (as_int("impacts").astype(np.int64), as_int("dims"), as_long("ends"), as_int("postings"))
                q, r, score = best(ids, block, segment, query_ids, queries, k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(query_ids[q]), pa.array(ids[r]), pa.array(score.astype(np.int64))], ["query_id", "vec_id", "score"])

    # only queries are repeated
    near = _pairs(index, asked, blocks).drop("block", "part").mapInArrow(search, "query_id long, vec_id long, score long")
    large = rows.where("wide").select("id", "vector")
    if not large.isEmpty():
        near = near.union(exact(large, queries.select("id", "vector"), k)).union(
            exact(rows.where("NOT wide").select("id", "vector"), queries.where("wide").select("id", "vector"), k))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The rows of ``top_k`` over the table ``embeddings``, for queries whose id is divisible by 50.
ORACLE = """
WITH whole AS (
  SELECT vec_id, [floor(CAST(x AS DOUBLE) * 256) for x in embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
