"""The ring against keys that are placed one by one."""

import hashlib
import zlib
from collections import Counter

import pytest

from merchloom.llm import queries, sharding


def number(text, digits):
    return int(hashlib.md5(text.encode()).hexdigest()[:digits], 16)


def brute(rows, shards, replicas):
    nodes = {}
    for s in range(shards):
        for r in range(replicas):
            cell = number(f"shard/{s}/{r}", 4)
            nodes[cell] = min(s, nodes.get(cell, s))
    cells = sorted(nodes)
    room = [len(rows) // shards + (s < len(rows) % shards) for s in range(shards)]
    used, out = [0] * shards, []
    keyed = []
    for doc, text in rows:
        item = "" if doc is None else str(doc)
        data = (text or "").encode()
        position = number(item, 15)
        cell = position >> 44
        at = next((i for i, c in enumerate(cells) if c >= cell), 0)
        keyed.append((at, position, item, zlib.crc32(data), len(data) + 8, doc))
    for at, _, _, crc, size, doc in sorted(keyed, key=lambda k: k[:5]):
        step = at
        while used[nodes[cells[step % len(cells)]]] == room[nodes[cells[step % len(cells)]]]:
            step += 1
        shard = nodes[cells[step % len(cells)]]
        out.append((doc, size, crc, shard, used[shard]))
        used[shard] += 1
    return sorted(out, key=repr)


def got(frame):
    return sorted(((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in frame.collect()), key=repr)


def test_query_against_one_by_one(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    found = queries.queries()["op9_sharding"](spark, sf)
    assert got(found) == brute(rows, 24, sharding.REPLICAS)
    counts = Counter(r.shard for r in found.collect())
    assert max(counts.values()) - min(counts.values()) <= 1 and set(counts) == set(range(24))


@pytest.mark.parametrize("shards,replicas", [(1, 1), (3, 2), (7, 40)])
def test_edges(spark, shards, replicas):
    texts = [None, "", "é" * 30_000, "same", "same", "a\nb"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "x"), (None, None), (5, "a\nb"), (5, "a\nb"), (5, "other")]
    frame = spark.createDataFrame([(*r, 1, "q") for r in rows], "doc_id long, text string, shard int, cell string")
    assert got(sharding.assign(frame, shards, replicas)) == brute(rows, shards, replicas)
    assert sharding.assign(frame.limit(0), shards, replicas).count() == 0


def test_one_more_shard_moves_few_rows(spark):
    docs = spark.range(40_000).selectExpr("id AS doc_id", "'t' AS text")
    before, after = ({r.doc_id: r.shard for r in sharding.assign(docs, n).collect()} for n in (24, 25))
    moved = sum(before[k] != after[k] for k in before)
    assert moved / len(before) < 0.12
    stayed = sharding.assign(docs, 24)
    assert stayed.where("home = shard").count() / len(before) > 0.93


def test_walk_fills_every_shard():
    pieces = sharding.walk([(0, 0, 9), (5, 1, 0), (7, 2, 1)], 3)
    assert pieces == [(0, 0, 4, 0, 0), (0, 4, 7, 1, 0), (0, 7, 9, 2, 0), (7, 0, 1, 2, 2)]
