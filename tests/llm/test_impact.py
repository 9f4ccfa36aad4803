"""Exact top-k against brute force."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from merchloom.llm import impact


def brute(rows, asks, k):
    """rows: (id, vector or None)."""
    whole = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows
             if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    queries = {}
    for i, v in whole:
        if asks(i):
            queries[i] = min(v, queries.get(i, v))
    out = []
    for q, v in queries.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in whole if i != q)  # noqa: B905
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def got(spark, rows, k=5, **sizes):
    frame = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<float>, rank int, score string")
    return sorted(tuple(r) for r in impact.top_k(frame, F.col("vec_id") % 5 == 0, k, **sizes).collect())


@pytest.mark.parametrize("block_rows,query_rows", [(7, 3), (50, 1000)])
def test_blocks_give_the_same_rows(spark, block_rows, query_rows):
    draw = np.random.default_rng(3)
    rows = [(i, [float(x) for x in np.float32(draw.normal(0, 0.2, 6))]) for i in range(100)]
    rows += [(i, rows[0][1]) for i in range(100, 130)] + [(131, [0.0] * 6), (135, [0.0] * 6)]
    assert got(spark, rows, block_rows=block_rows, query_rows=query_rows) == brute(rows, lambda i: i % 5 == 0, 5)


def test_edges(spark):
    rows = [(0, [1.0, 2.0]), (5, None), (10, [1.0, None]), (15, [float("nan"), 1.0]), (20, [float("inf"), 0.0]), (25, []), (1, [0.5, 0.25]),
            (2, [0.5, 0.25]), (2, [0.5, 0.25]), (None, [9.0, 9.0]), (3, [-1.0]), (30, [0.1]), (30, [0.1])]
    assert got(spark, rows) == brute(rows, lambda i: i % 5 == 0, 5)
    assert got(spark, []) == [] and got(spark, [(0, [1.0])]) == []


def test_large_components_take_part(spark):
    rows = [(0, [1.0, 2.0]), (1, [70000.0, 1.0]), (2, [1.0, 1.0]), (5, [-3.0e5, 2.0]), (10, [5.0e6, 1.0]), (3, [1.0e-3] * 16_400), (4, [2.0e5, -1.0]), (4, [2.0e5, -1.0]), (15, [0.5])]
    assert got(spark, rows) == brute(rows, lambda i: i % 5 == 0, 5)
    assert got(spark, rows, k=2, block_rows=2, query_rows=1) == brute(rows, lambda i: i % 5 == 0, 2)
    with pytest.raises(Exception, match="does not fit"):
        got(spark, [(0, [3.0e18]), (1, [3.0e18])])


def test_repeated_queries_do_not_pass_the_driver(spark):
    rows = [(i, [float(i % 7), float(i % 11)]) for i in range(60)] + [(61, [70000.0, 1.0]), (65, [5.0e6, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = impact.top_k(frame, F.col("vec_id") % 5 == 0, block_rows=7, query_rows=3)
    assert sorted(tuple(r) for r in found.collect()) == brute(rows, lambda i: i % 5 == 0, 5)
    plan = found._jdf.queryExecution().executedPlan().toString()  # as it ran
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") >= 3


@given(st.integers(1, 60), st.integers(1, 12), st.integers(0, 2**32 - 1), st.sampled_from([1, 3, 40, 5000]), st.integers(1, 7))
@settings(max_examples=150, deadline=None)
def test_best_is_exact(n, width, seed, scale, k):
    draw = np.random.default_rng(seed)
    vectors = draw.integers(-scale, scale + 1, (n, width))
    vectors[draw.random(n) < 0.3] = vectors[0]
    ids = draw.permutation(n).astype(np.int64)
    few, impact.FEW = impact.FEW, 2
    try:
        q, r, s = impact.best(ids, vectors, impact.segments(vectors), ids[:9], vectors[:9], k)
    finally:
        impact.FEW = few
    want = []
    for j in range(min(9, n)):
        scored = sorted((-int(vectors[i] @ vectors[j]), int(ids[i])) for i in range(n) if i != j)
        want += [(j, i, -v) for v, i in scored[:k]]
    assert sorted(zip(q.tolist(), ids[r].tolist(), s.tolist(), strict=True)) == sorted(want)


def test_segments_run_by_descending_impact():
    vectors = np.array([[64, -3, 0], [-64, 10, 2]])
    impacts, dims, ends, postings = impact.segments(vectors, levels=8)
    assert (np.diff(np.abs(impacts)) <= 0).all() and ends[-1] == len(postings) == 3
    assert {(int(d), int(r)) for d, r in zip(np.repeat(dims, np.diff([0, *ends])), postings, strict=True)} == {(0, 0), (0, 1), (1, 1)}
