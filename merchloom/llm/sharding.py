"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has ``CELLS`` cells. Every shard owns ``replicas`` virtual nodes on cells drawn from its number;
a document lies on the cell of its id's hash and belongs to the next virtual node clockwise. Shards may
hold equal numbers of rows, at most one apart: keys that find their shard full go on clockwise to the next
virtual node whose shard has room. Keys enter in the order of the ring, so the result does not depend on
the order of the rows.

Only the number of keys per virtual node, a table of fixed size, is needed to see where shards run full.
The walk over it gives for every virtual node which of its ranked keys go to which shard, in
``virtual nodes + shards`` pieces at most, and rows take their place from these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from merchloom.session import cut_lineage

CELLS = 1 << 16
REPLICAS = 256


def _drawn(item: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(item.cast("binary")), 1, digits), 16, 10).cast("long")


def ring(spark: SparkSession, shards: int, replicas: int = REPLICAS) -> DataFrame:
    """``cell, arc, shard`` for every cell: the next virtual node clockwise and its shard; of two on one cell the smaller shard's counts."""
    if not 0 < shards <= CELLS // 4:
        raise ValueError(f"1 to {CELLS // 4} shards")
    nodes = spark.range(shards * replicas).select(
        F.pmod("id", F.lit(shards)).cast("int").alias("shard"),
        _drawn(F.concat_ws("/", F.lit("shard"), F.pmod("id", F.lit(shards)), F.floor(F.col("id") / shards)), 4).alias("cell"))
    nodes = nodes.groupBy("cell").agg(F.min("shard").alias("shard"))
    marks = nodes.select(F.struct(F.col("cell").alias("arc"), "shard").alias("node"), "cell")
    # cells of fixed number: one task is enough to look for the next node
    ahead = Window.orderBy(F.desc("cell"))
    cells = spark.range(CELLS).select(F.col("id").alias("cell")).join(marks, "cell", "left")
    found = cells.select("cell", F.last("node", ignorenulls=True).over(ahead).alias("node"), F.min("node").over(Window.partitionBy()).alias("first"))
    return found.select("cell", F.coalesce("node", "first").alias("node")).select("cell", "node.arc", "node.shard")


def walk(arcs: list[tuple[int, int, int]], shards: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (arc, first rank, end rank, shard, first slot) from (arc, shard, keys) in the order of the ring."""
    total = sum(n for _, _, n in arcs)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    pieces = []
    for at, (arc, _, keys) in enumerate(arcs):
        rank, step = 0, at
        while rank < keys:
            shard = arcs[step % len(arcs)][1]
            taken = min(keys - rank, room[shard])
            if taken:
                pieces.append((arc, rank, rank + taken, shard, used[shard]))
                rank, room[shard], used[shard] = rank + taken, room[shard] - taken, used[shard] + taken
            step += 1
    return pieces


def assign(docs: DataFrame, shards: int = 24, replicas: int = REPLICAS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, arc, home, shard, slot`` for every row.

    ``home`` is the shard of the row's own virtual node, ``slot`` its gapless number in ``shard``. A null id
    is hashed as an empty one, rows of one id are neighbours on the ring; a null text is empty.
    """
    item = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(
        F.col(id_col).alias("doc_id"), item.alias("item"), (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), _drawn(item, 15).alias("position"))
    cells = cut_lineage(ring(docs.sparkSession, shards, replicas))
    # CELLS rows, whatever the size of the table
    rows = cut_lineage(narrow.withColumn("cell", F.shiftright("position", 44)).join(F.broadcast(cells), "cell").drop("cell"))
    counted = {r["arc"]: r["keys"] for r in rows.groupBy("arc").agg(F.count(F.lit(1)).alias("keys")).collect()}
    arcs = sorted((r["arc"], r["shard"]) for r in cells.select("arc", "shard").distinct().collect())
    if len({shard for _, shard in arcs}) < shards:
        raise ValueError("a shard has no cell of its own: use more replicas")
    pieces = walk([(arc, shard, counted.get(arc, 0)) for arc, shard in arcs], shards)
    placed = docs.sparkSession.createDataFrame(pieces, "arc long, low long, high long, to int, first long")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("arc").orderBy("position", "item", "text_crc32", "size")) - 1)
    inside = (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    return ranked.join(F.broadcast(placed), "arc").where(inside).select(
        "doc_id", "size", "text_crc32", "arc", F.col("shard").alias("home"), F.col("to").alias("shard"),
        (F.col("first") + F.col("rank") - F.col("low")).alias("slot"))
