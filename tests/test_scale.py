"""Hot keys, bounded tasks, exact fall-backs and the plans behind them."""

import random

import pytest
from pyspark.sql import functions as F

from merchloom.functions import similarity as S
from merchloom.operators import category_merge, dedup, fuzzy, lexicon, quality, ranking, semantic
from merchloom.operators.orders import in_month
from merchloom.session import scratch_path

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("k", [1, 20, 150])
def test_top_per_group_with_a_hot_group(spark, k):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 40)).alias("g"), F.pmod(F.hash("id"), F.lit(50)).alias("v"))
    got = ranking.top_per_group(rows, ["g"], [F.col("v").desc(), F.col("id")], k, salt_by=["id"]).collect()
    groups = {}
    for r in rows.collect():
        groups.setdefault(r["g"], []).append((-r["v"], r["id"]))
    want = {(g, i) for g, members in groups.items() for _, i in sorted(members)[:k]}
    assert {(r["g"], r["id"]) for r in got} == want


def test_rank_filters_run_before_the_shuffle(spark):
    rows = spark.range(100).select("id", (F.col("id") % 3).alias("g"))
    text = plan(ranking.first_per_key(rows, ["g"], [F.col("id")]))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_time_filters_and_columns_reach_the_scan(spark):
    orders = spark.read.parquet(f"{SF_DIR}/orders.parquet")
    text = plan(orders.where(in_month("o_orderdate", 1997, 5)).groupBy("o_orderstatus").count())
    assert "GreaterThanOrEqual(o_orderdate" in text and "LessThan(o_orderdate" in text
    assert "o_totalprice" not in text


def test_numbering_is_consecutive_in_order(spark):
    rows = spark.range(1000).select("id", F.pmod(F.hash("id"), F.lit(7)).alias("v"))
    got = {r["id"]: r["n"] for r in ranking.numbered(rows, [F.col("v").desc(), F.col("id")], "n", 11).collect()}
    want = sorted(rows.collect(), key=lambda r: (-r["v"], r["id"]))
    assert [got[r["id"]] for r in want] == list(range(11, 1011))


def test_deep_pages_equal_short_ones(spark, monkeypatch):
    rows = spark.range(500)
    short = [r["id"] for r in ranking.first_rows(rows, [F.col("id").desc()], 20, 100).collect()]
    monkeypatch.setattr(ranking, "DRIVER_LIMIT", 0)
    deep = [r["id"] for r in ranking.first_rows(rows, [F.col("id").desc()], 20, 100).collect()]
    assert sorted(short) == sorted(deep) == list(range(380, 400))


def test_bulk_images(spark):
    rows = spark.range(300).select("id", F.array(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")), F.concat(F.lit("s"), F.col("id") % 20)).alias("images"))
    kept = {r["id"] for r in dedup.remove_bulk_images(rows, "id", "images").collect()}
    assert kept == {i for i in range(300) if i % 3}


def _words(rng, n, size):
    return ["".join(rng.choice("abcde") for _ in range(rng.randint(1, size))) for _ in range(n)]


def test_ngram_hits_equal_brute_force(spark):
    rng = random.Random(1)
    texts = [(i, " ".join(_words(rng, 12, 2)).replace("e", rng.choice(["e", "-", ",", "  "]))) for i in range(60)]
    terms = sorted({" ".join(_words(rng, rng.randint(1, 3), 2)) for _ in range(40)})
    t, k = spark.createDataFrame(texts, "id int, x string"), spark.createDataFrame([(w,) for w in terms], "term string")
    import re

    want = {(i, w) for i, x in texts for w in terms if re.search(rf"(^|[^a-z0-9]){w.replace('-', ' ')}([^a-z0-9]|$)", x.replace("-", " "))}
    assert {(r["id"], r["term"]) for r in lexicon.ngram_hits(t, ["id"], "x", k).collect()} == want

def test_ngram_hits_leave_the_words_where_they_are(spark):
    """Vocabulary and anchors turn out small only when counted; no word of a text is shuffled to meet them."""
    path = scratch_path(spark, "texts")
    spark.range(4000).selectExpr("id", "concat_ws(' ', transform(sequence(0, 59), i -> concat('w', (id * 61 + i) % 9973))) AS x").write.parquet(path)
    t, k = spark.read.parquet(path), spark.createDataFrame([(f"w{i} w{i + 1}",) for i in range(40)], "term string")
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    held = {name: spark.conf.get(name, None) for name in names}
    spark.conf.set(names[0], "100KB")  # texts are larger, what is looked for is not
    spark.conf.set(names[1], "100KB")
    try:
        found = lexicon.ngram_hits(t, ["id"], "x", k)
        rows, ran = found.collect(), plan(found)
    finally:
        for name, value in held.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    want = {(i, f"w{n % 9973} w{n % 9973 + 1}") for i in range(4000) for n in range(i * 61, i * 61 + 59) if n % 9973 < 40}
    assert {(r["id"], r["term"]) for r in rows} == want
    assert "hashpartitioning(_word" not in ran


def test_ngram_hits_edges_and_long_terms(spark):
    rng = random.Random(4)
    body = ["".join(rng.choice("abc") for _ in range(3)) for _ in range(400)]
    texts = [(1, " ".join(body)), (1, "other row of one id stun gun"), (None, "a stun gun here"), (2, None), (3, ""), (4, "stun, gun"), (5, "gun stun gun stun")]
    terms = [" ".join(body[7:29]), " ".join(body[100:104]), "stun gun", "gun", "never said", " ".join(body[:2] + ["never"]), None, "here"]
    t = spark.createDataFrame([(*r, "extra") for r in texts], "id int, x string, _w string").drop("_w")
    k = spark.createDataFrame([(w, n) for n, w in enumerate(terms)] + [("gun", 3)], "term string, n int")
    got = {(r["id"], r["n"]) for r in lexicon.ngram_hits(t, ["id"], "x", k).collect()}
    assert got == {(1, 0), (1, 1), (1, 2), (1, 3), (None, 2), (None, 3), (None, 7), (4, 3), (5, 2), (5, 3)}
    assert lexicon.ngram_hits(t, ["id"], "x", k.limit(0)).count() == 0


def test_places_do_not_grow_with_term_lengths(spark):
    """What the texts emit is decided by the anchors alone: terms of many lengths at one rare word give one row a place."""
    words = [f"w{i}" for i in range(60)]
    text = " ".join(words)
    few = spark.createDataFrame([(" ".join(words[20:23]),)], "term string")
    many = spark.createDataFrame([(" ".join(words[20:20 + n]),) for n in range(1, 30)], "term string")
    t = spark.createDataFrame([(i, text if i == 0 else text.replace("w20", "x")) for i in range(40)], "id int, x string")
    parts = lambda k: lexicon._anchors(t.select("id", lexicon.boundary_words("x").alias("_w")), k.select(
        lexicon.boundary_words("term").alias("_w")).withColumn("_gram", F.array_join("_w", " ")))
    assert {r["_word"] for r in parts(few).collect()} == {r["_word"] for r in parts(many).collect()} == {"w20"}
    assert lexicon.ngram_hits(t, ["id"], "x", many).count() == 29


def test_substring_hits_equal_brute_force(spark):
    rng = random.Random(2)
    texts, terms = _words(rng, 80, 20), sorted(set(_words(rng, 60, 7)))
    t, k = spark.createDataFrame(list(enumerate(texts)), "id int, x string"), spark.createDataFrame([(w,) for w in terms], "term string")
    got = {(r["id"], r["term"]) for r in lexicon.substring_hits(t, ["id"], "x", k).collect()}
    assert got == {(i, w) for i, x in enumerate(texts) for w in terms if w in x}


@pytest.mark.parametrize("share", [0.62, 0.8, 0.88])
def test_similar_pairs_lose_nothing(spark, share):
    rng = random.Random(3)
    left = sorted(set(_words(rng, 60, 12)))
    right = sorted({"".join(c for c in w if rng.random() > 0.15) + rng.choice(["", "a", "bc"]) for w in left} | set(_words(rng, 40, 12)) - {""})
    a = spark.createDataFrame([(w,) for w in left], "a string")
    b = spark.createDataFrame([(w,) for w in right if w], "b string")
    want = {(r["a"], r["b"]) for r in a.crossJoin(b).where(S.ratio(F.col("a"), F.col("b")) >= 100 * share).collect()}
    assert {(r["a"], r["b"]) for r in fuzzy.similar_pairs(a, "a", b, "b", share).collect()} == want


def _allocate(items, total, low, high):
    chosen, left = [], total
    for name, count in items:
        if left < low:
            break
        base = min(low, count, high)
        if base >= low:
            chosen.append([name, count, base])
            left -= base
    for entry in chosen:
        extra = max(0, min(min(entry[1], high) - entry[2], left))
        entry[2] += extra
        left -= extra
    return {name: got for name, _, got in chosen}


@pytest.mark.parametrize("total,low,high", [(100, 10, 30), (95, 7, 7), (5, 10, 20), (1000, 1, 40), (60, 20, 10)])
def test_quota_equals_the_two_pass_loop(spark, total, low, high):
    rng = random.Random(total)
    items = sorted(((f"c{i}", rng.randint(1, 60)) for i in range(15)), key=lambda c: (-c[1], c[0]))
    got = {r["name"]: r["allocated"] for r in quality.allocate_quota(spark.createDataFrame(items, "name string, count long"), total, low, high).collect()}
    assert got == _allocate(items, total, low, high)
    assert sum(got.values()) <= total and all(low <= v <= high for v in got.values())


def test_semantic_blocks_agree(spark, monkeypatch):
    vectors = spark.read.parquet(f"{SF_DIR}/embeddings.parquet")
    index = semantic.centroids(vectors, "label", "embedding")
    whole = {r["vec_id"]: r["label"] for r in semantic.nearest(vectors.select("vec_id", "embedding"), "vec_id", "embedding", index, "label", "vector").collect()}
    monkeypatch.setattr(semantic, "BLOCK_VECTORS", 3)
    blocks = {r["vec_id"]: r["label"] for r in semantic.nearest(vectors.select("vec_id", "embedding"), "vec_id", "embedding", index, "label", "vector").collect()}
    assert whole == blocks


def test_pivot_join_equals_brute_force(spark, monkeypatch):
    """Clustered entries in many small blocks, ties, zero vectors, repeated keys; blocks that can't win are not compared."""
    import numpy as np

    draw = np.random.default_rng(8)
    centres = draw.normal(size=(12, 20))
    entries = [(f"l{k:03}", (centres[k % 12] + draw.normal(size=20) * 0.05).tolist()) for k in range(150)] + [("zero", [0.0] * 20)]
    entries += [("a-twin", entries[7][1]), ("z-twin", entries[7][1])]
    rows = [(k, (centres[k % 3] + draw.normal(size=20) * 0.05).tolist()) for k in range(90)] + [(200, entries[7][1]), (201, [0.0] * 20), (5, entries[9][1])]
    monkeypatch.setattr(semantic, "BLOCK_VECTORS", 8)
    monkeypatch.setattr(semantic, "PART_ROWS", 16)
    monkeypatch.setattr(semantic, "PIVOTS", 5)

    def unit(v):
        n = np.linalg.norm(v)
        return np.array(v) / (n or 1.0)

    want = []
    for key, v in rows:
        sims = [(-round(float(unit(v) @ unit(w)), 9), label) for label, w in entries]
        want.append((key, min(sims)[1]))
    r = spark.createDataFrame(rows, "id long, v array<double>").coalesce(2)
    i = spark.createDataFrame(entries, "label string, w array<double>")
    got = sorted((x.id, x.label) for x in semantic.nearest(r, "id", "v", i, "label", "w").collect())
    assert got == sorted(want)
    mains = spark.createDataFrame([(f"m{k}", centres[k].tolist()) for k in range(12)], "main string, vector array<double>")
    paths = i.select(F.concat(F.lit("m"), F.pmod(F.xxhash64("label"), F.lit(12))).alias("main"), F.col("label").alias("path"), (F.length("label") % 3).cast("int").alias("depth"), F.col("w").alias("vector"))
    top = {x.main: unit(x.vector) for x in mains.collect()}
    choices = [(x.main, x.path, x.depth, unit(x.vector)) for x in paths.collect()]
    best = {}
    for key, v in rows:
        u, options = unit(v), []
        for main, path, depth, w in choices:
            a, b = float(u @ top[main]), float(u @ w)
            if a >= 0.4:
                options.append((-((depth if b >= 0.5 else 0) * 10.0 + round((a + b) / 2, 9)), f"{main}\u0001{path}", f"{main}|||{path}"))
        best.setdefault(key, set()).add(min(options)[2] if options else "Others")
    found = semantic.classify(r.where("id <> 5"), "id", "v", mains, paths).collect()
    assert {x.id: x.category for x in found} == {k: next(iter(v)) for k, v in best.items() if k != 5}


def test_running_sums_have_no_global_window(spark):
    rng = random.Random(6)
    rows = [(i, rng.randint(0, 9), rng.choice([None, 1, 2, 50])) for i in range(500)]
    frame = spark.createDataFrame(rows, "id int, g int, v int").repartition(7)
    found = ranking.running_sum(frame, [F.col("g").desc(), F.col("id")], "v", "before", "n")
    want, total = {}, 0
    for i, _, v in sorted(rows, key=lambda r: (-r[1], r[0])):
        want[i] = total
        total += v or 0
    assert {r.id: (r.before, r.n) for r in found.collect()} == {i: (b, 500) for i, b in want.items()}
    assert ranking.running_sum(frame.limit(0), [F.col("g").desc()], "v", "before", "n").count() == 0


def test_newest_version_of_a_table(spark, tmp_path):
    from merchloom.sources import sinks

    root = str(tmp_path / "t")
    for version in (1, 2, 10):
        sinks.replace_table(spark.range(version).withColumn("v", F.lit(version)), root, version)
    assert sinks.current_table(spark, root).groupBy("v").count().collect()[0][:] == (10, 10)
    assert sinks.current_table(spark, root).columns == ["id", "v"]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        sinks.current_table(spark, str(tmp_path / "none"))


def test_moved_and_kept_rows_are_the_whole_table(spark, tmp_path):
    from merchloom.sources import sinks

    rows = spark.range(200).withColumn("x", F.when(F.col("id") % 7 > 0, F.col("id") % 5))
    marked = sinks.with_verdict(rows, F.col("x") == 2, F.lit("two"), "t", F.current_timestamp())
    kept, moved = sinks.move_with_backup(marked, str(tmp_path / "out"))
    kept_ids, moved_ids = [{r["id"] for r in half.collect()} for half in (kept, moved)]
    assert kept_ids | moved_ids == set(range(200)) and not kept_ids & moved_ids
    assert kept.columns == rows.columns


def test_no_best_category_without_large_ones(spark):
    none = spark.createDataFrame([], "category string")
    small = spark.createDataFrame([("Shoes",), ("",)], "category string")
    assert {r["target"] for r in category_merge.best_category(small, none).collect()} == {"Other"}


def test_cluster_without_shared_folder_is_refused(spark):
    from merchloom import session

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

    class Fake:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        session.shared_dir(Fake())


@pytest.mark.parametrize("limit", [1, 2, 3])
def test_repeated_pages_equal_the_reading_loop(spark, limit):
    rng = random.Random(limit)
    rows = [(k, p, rng.choice(["a", "a", "b", ""])) for k, n in (("hot", 120), ("x", 9), ("y", 1), ("z", 30)) for p in range(0, 3 * n, 3)]
    want = set()
    for key in {k for k, _, _ in rows}:
        last, same = None, 0
        for _, page, sig in sorted(r for r in rows if r[0] == key):
            same = same + 1 if sig and sig == last else 0
            if same >= limit:
                break
            want.add((key, page, same))
            last = sig
    table = spark.createDataFrame(rows, "k string, p int, s string")
    got = {(r["k"], r["p"], r["repeats"]) for r in dedup.repeated_pages(table, "k", "p", F.col("s"), limit).collect()}
    assert got == want


def test_keyless_rows_pass_an_insert(spark):
    from merchloom.operators import keyed

    batch = spark.createDataFrame([(1, "a", 1), (2, "a", 2), (3, None, 1), (4, None, 1), (5, "", 1), (6, "b", 1)], "id int, k string, t int")
    stored = spark.createDataFrame([("b",)], "k string")
    got = {r["id"] for r in keyed.insertable(batch, stored, ["k"], [F.col("t").desc()]).collect()}
    assert got == {2, 3, 4, 5}
