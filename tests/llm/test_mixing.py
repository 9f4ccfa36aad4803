"""The mix against its SQL and against a plain walk through the keys."""

from collections import Counter

import hashlib
import math
from collections import defaultdict

import duckdb
import pyarrow as pa
import pytest

from merchloom.llm import mixing

KINDS = "doc_id long, text string, source string, target string, _key int"


def brute(rows):
    items = []
    for doc, text, source in rows:
        text = text or ""
        size, chars = len(text.encode().split()), len(text)
        quality = 1 / (1 + 20 * sum(c in "#*$%&|<>" for c in text) / max(chars, 1))
        name = "" if doc is None else str(doc)
        u = (int(hashlib.md5(name.encode()).hexdigest()[:13], 16) + 1) / (2**52 + 1)
        items.append((source, -math.log(u) / quality, name, size, doc))
    total = defaultdict(int)
    for source, _, _, size, _ in items:
        total[source] += size
    ranked = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(ranked)}
    full, level = set(), 0.0
    while True:
        free = sum(w for s, w in weight.items() if s not in full)
        level = (sum(total.values()) - sum(3 * total[s] for s in full)) / free if free else level
        more = {s for s in ranked if 3 * total[s] <= level * weight[s]} - full
        if not more:
            break
        full |= more
    out = []
    for source in ranked:
        target = min(3.0 * total[source], level * weight[source])
        epochs = int(target // total[source]) if total[source] else 0
        rest, before = target - epochs * total[source], 0
        groups = defaultdict(list)
        for s, key, name, size, doc in items:
            if s == source:
                groups[key, name].append((size, doc))
        for at in sorted(groups):
            own = sum(size for size, _ in groups[at])
            more = before + own / 2 <= rest
            before += own
            out += [(doc, size, total[source], target, size * (epochs + more)) for size, doc in groups[at]]
    return out


def norm(rows):
    return sorted(((r[0] is not None, r[0] or 0, r[1], r[2], round(r[3], 6), r[4]) for r in rows))


ROWS = ([(i, "word " * (i % 7) + "$ " * (i % 3), f"s{i % 4}") for i in range(60)] + [(i, "w " * 300, "big") for i in range(60, 70)]
        + [(70, None, None), (71, "", "s1"), (72, "x " * 20_000, None), (73, "a b\x1cc", "é"), (73, "a b\x1cc", "é"), (None, "one two", "é"), (74, "z", "Z"), (75, None, "empty")])


@pytest.mark.parametrize("limit", [10_000, 0])
def test_against_a_plain_walk(spark, monkeypatch, limit):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", limit)
    frame = spark.createDataFrame([(*r, "clash", 1) for r in ROWS], KINDS)
    got = [tuple(r) for r in mixing.amounts(frame).collect()]
    assert norm(got) == norm(brute(ROWS))
    assert all(taken <= 3 * size for _, size, _, _, taken in got)
    assert norm(tuple(r) for r in mixing.amounts(frame.repartition(5)).collect()) == norm(got)


def test_sql_says_the_same():
    con = duckdb.connect()
    documents = pa.table({"doc_id": pa.array([r[0] for r in ROWS], pa.int64()), "text": [r[1] for r in ROWS], "source": [r[2] for r in ROWS]})  # noqa: F841
    assert norm(con.execute(mixing.ORACLE).fetchall()) == norm(brute(ROWS))


def test_mix_repeats_documents(spark):
    frame = spark.createDataFrame([(*r, "clash", 1) for r in ROWS], KINDS)
    mixed = [tuple(r) for r in mixing.mix(frame).select("doc_id", "text", "source").collect()]
    words = lambda rows: sum(len((t or "").encode().split()) for _, t, _ in rows)
    assert words(mixed) == sum(r[4] for r in brute(ROWS)) and set(mixed) <= set(ROWS)


def test_nothing_to_mix(spark):
    frame = spark.createDataFrame([], KINDS)
    assert mixing.amounts(frame).count() == 0 and mixing.mix(frame).count() == 0
    silent = spark.createDataFrame([(1, None, None, "", 0), (2, "", "a", "", 0)], KINDS)
    assert [r.taken for r in mixing.amounts(silent).collect()] == [0, 0]


def test_texts_without_words_follow_the_epochs(spark):
    rows = [(1, "one two three", "b"), (2, "", "b"), (3, None, "b"), (4, " ", "a"), (5, "w " * 40, "a"), (6, "", None), (7, None, "c")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    times = Counter(r.doc_id for r in mixing.mix(frame).collect())
    # b weighs 2 and is full at three epochs; a takes the rest, less than one epoch; c and null have no word
    assert times[1] == times[2] == times[3] == 3
    assert times[4] == times[6] == times[7] == 0 and times[5] <= 1
