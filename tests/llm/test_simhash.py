"""SimHash classes against brute force over all pairs."""

import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from merchloom.llm import queries, simhash


def brute_fingerprint(text):
    words = []
    for word in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or ""):
        words.append("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in word))
    if not words:
        return 0
    n = max(1, len(words) - 2)
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 3]), seed=42) for i in range(n)]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > n)


def brute_classes(rows):
    """rows: (id, fingerprint); smallest id reachable over links of at most three bits."""
    fps = sorted({f for _, f in rows})
    parent = {f: f for f in fps}

    def top(f):
        while parent[f] != f:
            f = parent[f]
        return f

    values = np.array(fps, np.uint64)
    for f in fps:
        for g in values[np.bitwise_count(values ^ np.uint64(f)) <= 3].tolist():
            parent[top(g)] = top(f)
    least = {}
    for i, f in rows:
        if i is not None:
            least[top(f)] = min(i, least.get(top(f), i))
    return sorted((i, format(f, "016x"), least.get(top(f))) for i, f in rows if i is not None)


def got(frame):
    return sorted(tuple(r) for r in frame.collect() if r.doc_id is not None)


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query_against_all_pairs(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet").select("doc_id", "text").collect()
    want = brute_classes([(r.doc_id, brute_fingerprint(r.text)) for r in rows])
    assert got(queries.queries()["op8_simhash"](spark, f"/root/testdata/sf{sf}")) == want


@given(st.text("aB ÄßI\t\n\x1c é\x0b", max_size=40))
@settings(max_examples=200, deadline=None)
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=5))
@settings(max_examples=400, deadline=None)
def test_balls_meet_exactly_within_the_radius(fp, bits):
    other = fp
    for b in bits:
        other ^= 1 << b
    pair = np.unique(np.array([fp, other], np.uint64))
    a, b = simhash.stars(*simhash.ball(pair))
    a, b = (x[simhash.distance(a, b) <= 3] for x in (a, b))
    assert bool(len(a)) == (0 < len(bits) <= 3)


def test_chains_and_dense_groups(spark):
    draw = random.Random(5)
    fps = set()
    for _ in range(12):
        at = draw.getrandbits(64)
        for _ in range(60):  # chains of small steps
            fps.add(at)
            for b in draw.sample(range(64), draw.randint(1, 4)):
                at ^= 1 << b
    center = draw.getrandbits(64)
    fps |= {center ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(i)}
    fps = sorted(fps)
    frame = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    for pairs in (1 << 14, 1 << 30):
        links = [(r.a, r.b) for r in simhash.links(frame, bucket_pairs=pairs).collect()]
        assert links
        parts = {r.node: r.root for r in simhash.components(spark.createDataFrame(links, "a long, b long")).collect()}
        parts = {int(np.int64(k).view(np.uint64)): int(np.int64(v).view(np.uint64)) for k, v in parts.items()}
        want = {f: c for f, _, c in brute_classes([(f, f) for f in fps])}
        groups = {}
        for f in fps:
            groups.setdefault(parts.get(f, f), set()).add(want[f])
        assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want.values()))


def test_edges(spark):
    texts = [None, "", "  \n", "a", "A", "a b", "a b c", "word " * 30_000, "a b c", "a b c d"]
    rows = [(100 - i, t, "clash") for i, t in enumerate(texts)] + [(50, "a", "x"), (50, "a", "x"), (None, "a b c d", "x"), (None, "lone one here now", "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    assert got(simhash.classes(frame)) == brute_classes([(i, brute_fingerprint(t)) for i, t, _ in rows])
    assert simhash.classes(frame).count() == len(rows)
    assert simhash.classes(frame.limit(0)).count() == 0


def test_forest_keeps_parts():
    a, b = np.array([5, 9, 9, 2], np.uint64), np.array([9, 7, 8, 3], np.uint64)
    assert sorted(zip(*(x.tolist() for x in simhash.forest(a, b)), strict=True)) == [(2, 3), (5, 7), (5, 8), (5, 9)]
