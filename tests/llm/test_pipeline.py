"""Every stage of the corpus pipeline against brute force on its own input."""

from collections import Counter

import numpy as np
import pytest
from test_shingles import brute
from test_tokens import check_packing

import corpus_pipeline
from merchloom.llm import language, mixing, packing, perplexity, queries, simhash

SF = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    out["documents"] = docs
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return out


def rows(frame):
    return [tuple(r) for r in frame.select(*COLUMNS).collect()]


def test_columns_and_clean_documents(spark, stages):
    assert all(stages[name].columns == COLUMNS for name, _ in corpus_pipeline.STAGES[:-1])
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    clean = {r.doc_id for r in labels.where("quality = 1 AND toxic = 0").collect()}
    junk = {r.doc_id for r in labels.where("quality = 0").collect()}
    first = {r.doc_id for r in stages["quality_rules"].collect()}
    # short documents and repeated lines fail the base rules whatever their label
    base = {d for d, t, *_ in rows(stages["documents"]) if perplexity.base_failed(*np.array(perplexity.base_statistics((t or "").encode()))[[0, 4]])}
    assert len(clean - base - first) <= 0.01 * len(clean) and len((junk - base) & first) <= 0.15 * len(junk - base)
    second = {r.doc_id for r in stages["language_id"].collect()}
    assert len((first & clean) - second) <= 0.005 * len(clean)


def test_quality_stage_agrees_with_the_query(spark, stages):
    kept = {r.doc_id for r in queries.queries()["op1_quality_rules"](spark, SF).where("kept").collect()}
    assert kept == {r.doc_id for r in stages["quality_rules"].collect()}


def test_near_duplicate_stage(stages):
    before, after = rows(stages["language_id"]), rows(stages["near_duplicates"])
    assert sorted(r[0] for r in after) == brute([(r[0], r[1]) for r in before])
    assert set(after) <= set(before)


def test_mix_stage(stages):
    before, after = rows(stages["near_duplicates"]), Counter(rows(stages["source_mix"]))
    size = {r[0]: len((r[1] or "").encode().split()) for r in before}
    total = Counter()
    for r in before:
        total[r[3]] += size[r[0]]
    weights = {s: 1 + i % 3 for i, s in enumerate(sorted(total))}
    level, full = 0.0, set()
    while True:
        level = (sum(total.values()) - sum(3 * total[s] for s in full)) / sum(w for s, w in weights.items() if s not in full)
        more = {s for s, w in weights.items() if 3 * total[s] <= level * w} - full
        if not more:
            break
        full |= more
    for source in total:
        taken = sum(n * size[r[0]] for r, n in after.items() if r[3] == source)
        longest = max(size[r[0]] for r in before if r[3] == source)
        assert abs(taken - min(3 * total[source], level * weights[source])) <= longest
    assert set(after) <= set(before) and max(after.values()) <= 3


def test_packing_stage(stages, tokenizer):
    docs = stages["source_mix"].select("doc_id", "text").distinct().collect()
    want = {r.doc_id: [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1] for r in docs}
    times = Counter(r.doc_id for r in stages["source_mix"].select("doc_id").collect())
    pieces = stages["packing"].collect()
    got = Counter()
    for r in pieces:
        got[r.doc_id] += r.length
    assert got == {d: len(want[d]) * n for d, n in times.items()}
    check_packing([r for r in queries.packed_rows(stages["near_duplicates"]).collect() if r.doc_id in want], {
        r.doc_id: [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]
        for r in stages["near_duplicates"].select("doc_id", "text").collect() if r.doc_id in want}, packing.SEQUENCE_TOKENS, whole=False)


EDGES = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "one two three", "en", "a", 13), (3, "one two three", "en", "a", 13), (3, "other words here now", "xx", "b", 1),
         (None, "one two three", "en", "a", 13), (None, "quite alone it is", None, None, 1), (None, "a lone one too", None, None, 1), (9, "one two three", None, "b", 13), (12, "quite alone it is", "en", "a", 1), (12, "one two three", "en", "z", 1), (10, "long " * 20_000, "en", "b", 1)]
KINDS = "doc_id long, text string, lang string, source string, n_chars long"


def test_edges(spark):
    frame = spark.createDataFrame(EDGES, KINDS)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, frame, SF).columns == COLUMNS and set(rows(stage(spark, frame, SF))) <= set(EDGES)
        assert stage(spark, frame.limit(0), SF).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, frame, SF).count() > len(EDGES)


def test_one_row_of_each_group(spark):
    kept = Counter(rows(simhash.keep(spark.createDataFrame(EDGES, KINDS))))
    assert kept == Counter([EDGES[0], EDGES[2], EDGES[4], EDGES[9], EDGES[11], (None, "a lone one too", None, None, 1)])


def test_clashing_columns(spark):
    frame = spark.createDataFrame([(1, "a b c", "en", "s", 1, 2.0, "x", 3)], f"{KINDS}, fp double, root string, _times int")
    assert simhash.keep(frame).columns == frame.columns == mixing.mix(frame).columns
    assert mixing.mix(frame).count() == 1
    model = language.assemble({}, language.inverse(0, np.zeros(language.BUCKETS, np.int64)))
    assert language.keep(frame, model).columns == frame.columns
