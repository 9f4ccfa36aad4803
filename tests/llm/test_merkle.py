"""Merkle manifest: every tree and proof against a plain build, tampering, edges."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from merchloom.llm import merkle, queries


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(nodes):
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, place in enumerate(at):
            start = place - place % 3
            proofs[i] += [n for k, n in enumerate(nodes[start:start + 3], start) if k != place]
            at[i] = place // 3
        nodes = [sha(*nodes[k:k + 3]) for k in range(0, len(nodes), 3)]
    return nodes[0], proofs


def brute(leaves):
    """(subroot, root, proof) by (part, place) from sorted leaf digests per part."""
    order = sorted(leaves, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree(leaves[s]) for s in order}
    root, above = tree([trees[s][0] for s in order])
    return {(s, k): (trees[s][0], root, sha(*trees[s][1][k], *above[i])) for i, s in enumerate(order) for k in range(len(leaves[s]))}


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 5}, {None: 1, "a": 2, "b": 7, "é": 800, "Z": 2300, "c": 730, "d": 729}, {f"s{k:04}": 1 + k % 3 for k in range(800)}])
def test_every_proof(spark, sizes):
    rows = [(s, k) for s, n in sizes.items() for k in range(n)]
    random.Random(1).shuffle(rows)
    frame = spark.createDataFrame(rows, "part string, key long").withColumn("leaf", merkle.leaf(F.col("part"), F.col("key")))
    proved = merkle.prove(frame).withColumn("folded", merkle.fold(F.col("leaf"), F.col("steps"))).withColumn("proof", merkle.proof_digest(F.col("steps")))
    got = {(r.part, r.key): (r.subroot, r.root, r.proof, r.folded) for r in proved.collect()}
    want = brute({s: [sha(field(s), field(k)) for k in range(n)] for s, n in sizes.items()})
    assert got == {at: (*found, found[1]) for at, found in want.items()}


def test_only_every_sixth_level_is_stored(spark):
    nodes = spark.range(2000).select(F.lit(0).cast("long").alias("tree"), F.lit(7).alias("height"), F.col("id").alias("place"), merkle.digest(F.col("id").cast("string")).alias("node"))
    forest = merkle.grow(nodes)
    assert [level.count() for level in forest.levels] == [2000, 3, 1]
    assert merkle._subtrees(nodes, 0).selectExpr("max(size(nodes)) AS n").first().n == merkle.SUBTREE


def test_query_against_plain_build(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    parts = {}
    for row in docs:
        parts.setdefault(row[1], []).append((row[0], sha(*map(field, row)), row[4]))
    for found in parts.values():
        found.sort()
    want = brute({s: [leaf for _, leaf, _ in found] for s, found in parts.items()})
    got = {r.doc_id: r for r in queries.queries()["op12_merkle"](spark, sf).collect()}
    assert len(got) == len(docs)
    for s, found in parts.items():
        for k, (doc, leaf, text) in enumerate(found):
            r = got[doc]
            assert (r.leaf, r.subroot, r.root, r.proof_sha256) == (leaf, *want[(s, k)])
            spoiled = zlib.crc32(str(doc).encode()) % 2 == 0 and "\n" in (text or "")
            assert r.verified == (not spoiled) and (r.folded_root == r.root) == r.verified


def test_edges(spark):
    rows = [(None, None, None, None, None), (None, None, None, None, None), (1, "", "en", 5, "same"), (1, "", "en", 5, "same"), (2, "x", None, None, ""), (3, "x", "en", 1, "y" * 300_000)]
    frame = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, node string, tree string")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    leaves = frame.select("doc_id", "source", "node", "tree", merkle.leaf(*fields).alias("leaf"))
    got = merkle.prove(leaves, "doc_id", "source").withColumn("folded", merkle.fold(F.col("leaf"), F.col("steps"))).collect()
    assert len(got) == 6 and all(r.folded == r.root and r.node == r.tree == "clash" for r in got)
    twice, once = sha(field(1), field(""), field("en"), field(5), field("same")), sha("-----")
    assert {r.leaf for r in got if r.doc_id is None} == {once}
    assert {r.subroot for r in got if r.source == ""} == {sha(twice, twice)}
    empty = merkle.prove(leaves.limit(0), "doc_id", "source")
    assert empty.count() == 0 and empty.columns == [*leaves.columns, "subroot", "root", "steps"]
