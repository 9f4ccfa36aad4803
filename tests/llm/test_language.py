"""Language identification: held-out accuracy, edges, what it may not read."""

import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from merchloom.llm import language, queries

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    found = queries.queries()["op6_language"](spark, SF)
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = found.join(truth, "doc_id").collect()
    assert len(rows) == truth.count()
    held = [r for r in rows if r.held_out and r.lang]
    assert len(held) > 100 and np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_clean_documents_are_not_rejected(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1 AND toxic = 0")
    rows = queries.queries()["op6_language"](spark, SF).join(labels, "doc_id").collect()
    assert np.mean([r.rejected for r in rows]) < 0.005


def model_of(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return language.fit(docs, F.lit(True))


def test_edges(spark):
    texts = [None, "", "123 %%", "the dog", "der hund", "the dog " * 20_000, "the dog"]
    docs = spark.createDataFrame([(None if i == 6 else i, t, 0.5, "q") for i, t in enumerate(texts)], "doc_id long, text string, score double, lang_pred string")
    model = model_of(spark)
    got = {r.doc_id: r for r in language.identify(docs, model).collect()}
    assert [got[i].lang_pred for i in range(6)] == ["und", "und", "und", "en", "de", "en"] and got[None].lang_pred == "en"
    assert [got[i].score for i in range(3)] == [0, 0, 0]
    assert language.identify(docs.limit(0), model).count() == 0
    kept = language.keep(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got.values() if not r.rejected}


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "abc", None), (2, None, "en")], "doc_id long, text string, lang string")
    model = language.fit(docs, F.lit(True))
    assert model.languages == [] and {r.lang_pred for r in language.identify(docs, model).collect()} == {"und"}


def test_sample_is_bounded_and_unseen_labels_do_not_count(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("abc def").alias("text"), F.lit("en").alias("lang"))
    assert language.sampled_ids(docs, F.lit(True), "doc_id", "lang", 300).count() == 300
    base = spark.read.parquet(f"{SF}/documents.parquet")
    changed = base.withColumn("lang", F.when(queries.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    a, b = (language.fit(d, ~queries.held_out()) for d in (base, changed))
    assert a.languages == b.languages and np.allclose(a.centroids, b.centroids)


def test_trigrams_do_not_cross_texts():
    rows = language.trigram_counts([b"ab", b"cd", b"", None])
    assert rows.sum(axis=1).tolist() == [2, 2, 0, 0]
    assert (rows[0] == language.trigram_counts([b"!AB??"])[0]).all()


def plain_trigrams(text):
    """Counts by bucket, from code points one by one."""
    low = [0] + [language._letters()[ord(c)] for c in text or ""] + [0]
    line = [c for i, c in enumerate(low) if c or i == 0 or low[i - 1]]
    line = line if not line or line[-1] == 0 else [*line, 0]
    counts = Counter()
    for a, b, c in zip(line, line[1:], line[2:], strict=False):
        if b:
            mixed = (int(a) * 0x9E3779B97F4A7C15 + int(b) * 0xC2B2AE3D27D4EB4F + int(c) * 0x165667B19E3779F9) % 2**64
            counts[((mixed ^ mixed >> 31) * 0xBF58476D1CE4E5B9 % 2**64) >> 52] += 1
    return counts


def plain_prediction(model, text):
    counts = plain_trigrams(text)
    if not counts:
        return "und", 0.0
    vector = {k: math.log1p(n) * float(model.idf[k]) for k, n in counts.items()}
    length = math.sqrt(sum(v * v for v in vector.values()))
    near = [(sum(v * float(c[k]) for k, v in vector.items()) / length, language_) for c, language_ in zip(model.centroids, model.of, strict=True)]
    best = max(score for score, _ in near)
    return {model.languages[k] for score, k in near if score > best - 1e-6}, best


def test_predictions_against_plain_cosines(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit(docs, ~queries.held_out())
    texts = {r.doc_id: r.text for r in docs.collect()}
    texts |= {-1: None, -2: "", -3: "12 + 3", -4: "Ünï-cødé the", -5: "a"}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for row in language.identify(frame, model).collect():
        names, score = plain_prediction(model, texts[row.doc_id])
        assert row.lang_pred == names or row.lang_pred in names
        assert abs(row.score - min(1.0, max(0.0, score))) < 1e-4
