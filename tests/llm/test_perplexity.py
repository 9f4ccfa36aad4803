"""Base rules, the n-gram model, its tables in Spark and the bands against plain versions."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from merchloom.llm import kneser as K
from merchloom.llm import perplexity as P
from merchloom.llm import queries

SF = "/root/testdata/sf0.001"
TEXT = st.text("ab cA.!9$é\n\t\x1cß日🙂", max_size=60)


def brute_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, dup, seen = text.split("\n"), 0, set()
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    inside = {i + k for i, w in enumerate(windows) if w in twice for k in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside)


@given(TEXT | st.lists(st.sampled_from(["a", "b", "c\n", "d"]), max_size=60).map(" ".join))
@settings(max_examples=300, deadline=None)
def test_base_statistics(text):
    assert P.base_statistics(text.encode()) == brute_base(text)


def plain_lines(text):
    """Lines that are not empty, as tuples of UTF-16 units that end with a newline."""
    text = re.sub(r"[0-9A-Za-z]*[0-9][0-9A-Za-z]*", "0", text or "")
    for line in text.split("\n"):
        if line:
            data = (line + "\n").encode("utf-16-le")
            yield tuple(data[i] | data[i + 1] << 8 for i in range(0, len(data), 2))


def plain_grams(line):
    padded = (0,) * (K.ORDER - 1) + line
    return [padded[i:i + K.ORDER] for i in range(len(line))]


def code(gram):
    value = 0
    for unit in gram:
        value = value << K.BITS | unit
    return value - (1 << 64) if value >= 1 << 63 else value


@given(st.lists(TEXT | st.none(), max_size=6))
@settings(max_examples=300, deadline=None)
def test_grams(texts):
    codes, folds, sizes, letters = K.grams([None if t is None else t.encode() for t in texts])
    lines = [list(plain_lines(t)) for t in texts]
    assert codes.tolist() == [code(g) for found in lines for line in found for g in plain_grams(line)]
    assert sizes.tolist() == [sum(map(len, found)) for found in lines]
    plain = [re.sub(r"[0-9A-Za-z]*[0-9][0-9A-Za-z]*", "0", t or "") for t in texts]
    assert letters.tolist() == [sum(c.isalpha() or ord(c) > 0xFFFF for c in t) for t in plain]
    at, fold_of = 0, {}
    for line in (line for found in lines for line in found):
        got = set(folds[at:at + len(line)].tolist())
        assert len(got) == 1 and fold_of.setdefault(line, got) == got  # a line is in one fold wherever it stands
        at += len(line)


def fold(line):
    return int(K.grams([np.array(line[:-1], "<u2").tobytes().decode("utf-16-le").encode()])[1][0])


class Plain:
    """Modified Kneser-Ney with dictionaries."""

    def __init__(self, lines):
        self.levels = {K.ORDER: Counter(g for line in lines for g in plain_grams(line))}
        for n in range(K.ORDER - 1, 0, -1):
            self.levels[n] = Counter(g[1:] for g in self.levels[n + 1])
        self.cut, self.context = {}, {}
        for n, counts in self.levels.items():
            of = Counter(counts.values())
            cut = {1: 0.5, 2: 1.0, 3: 1.5}
            if of[1] and of[2] and of[3]:
                y = of[1] / (of[1] + 2 * of[2])
                for k in (1, 2, 3):
                    d = k - (k + 1) * y * of[k + 1] / of[k]
                    cut[k] = d if 0 < d < k else cut[k]
            self.cut[n] = cut
            sums = defaultdict(lambda: [0, 0.0])
            for g, c in counts.items():
                sums[g[:-1]][0] += c
                sums[g[:-1]][1] += cut[min(c, 3)]
            self.context[n] = sums

    def chance(self, gram):
        if not gram:
            return K.FLOOR
        n, below = len(gram), self.chance(gram[1:])
        if gram[:-1] not in self.context[n]:
            return below
        total, left = self.context[n][gram[:-1]]
        count = self.levels[n][gram]
        own = count - self.cut[n][min(count, 3)] if count else 0
        return own / total + left / total * below


def plain_costs(texts):
    lines = [list(plain_lines(t)) for t in texts]
    every = [line for found in lines for line in found]
    of = {line: fold(line) for line in set(every)}
    models = {f: Plain([line for line in every if of[line] != f]) for f in (0, 1)}
    return [sum(-math.log(models[of[line]].chance(g)) for line in found for g in plain_grams(line)) for found in lines]


@pytest.fixture(scope="module")
def scored(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    texts += [None, "", "日本語の文です。\n日本の文\n日本語", "Да нет\nнет да\nда", "🙂 a\n🙂 b", "one\n\n\ntwo 2x9 3\n", texts[0]]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    return texts, {r.doc_id: r for r in K.scored(frame, "text", ["doc_id"]).collect()}


def test_costs_are_modified_kneser_ney(scored):
    texts, got = scored
    assert len(got) == len(texts)
    for i, want in enumerate(plain_costs(texts)):
        assert got[i]._cost == pytest.approx(want, rel=1e-6, abs=1e-6)
    assert got[0]._cost == got[len(texts) - 1]._cost


def test_blocks_do_not_change_costs(spark, scored, monkeypatch):
    texts, want = scored
    monkeypatch.setattr(K, "BLOCK_ROWS", 3)
    monkeypatch.setattr(K, "HELD", 500)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r._cost for r in K.scored(frame, "text", ["doc_id"]).collect()}
    assert all(got[i] == pytest.approx(want[i]._cost, rel=1e-9) for i in got) and len(got) == len(want)


def test_chances_add_up_to_one(spark):
    texts = ["abab cab\nabc abd", "bad cab\ndab", "a b c d\nabba"] * 2
    codes, folds, _, _ = K.grams([t.encode() for t in texts])
    counts = Counter(zip(folds.tolist(), codes.tolist(), strict=True))
    frame = spark.createDataFrame([(f, g, n) for (f, g), n in counts.items()], "fold byte, gram long, n long")
    model = K.fit(frame)
    contexts = [code((0, 0, ord("a"))), code((0, ord("a"), ord("b"))), code((ord("x"), ord("y"), ord("z")))]
    asked = spark.range(1 << K.BITS).select(F.explode(F.array(*[F.lit(c) for c in contexts])).alias("c"), "id").select(
        F.lit(0).cast("byte").alias("fold"), (F.col("c") * (1 << K.BITS) + F.col("id")).alias("gram"))
    sums = K.look_up(model, asked).groupBy(F.shiftrightunsigned("gram", K.BITS).alias("c")).agg(F.sum("p").alias("p")).collect()
    assert len(sums) == 3 and all(r.p == pytest.approx(1.0) for r in sums)


def brute_bands(rows):
    """kept per id from (id, lang, letters, base_failed, log perplexity)."""
    octave = lambda n: max(P.OCTAVES[0], min(P.OCTAVES[1], int(math.log2(n)))) if n else None

    def quantiles(values):
        bins = sorted(math.floor(v * P.BINS) for v in values)
        at = lambda q: (bins[max(0, math.ceil(len(bins) * q) - 1)] + 0.5) / P.BINS
        return at(0.5), at(P.QUANTILE), at(1 - P.QUANTILE)

    groups = defaultdict(list)
    for _, lang, letters, failed, value in rows:
        if not failed and value is not None:
            groups[lang].append(value)
            groups[lang, octave(letters)].append(value)
    out = {}
    for doc, lang, letters, failed, value in rows:
        group = groups[lang, octave(letters)] if letters else []
        group = group if len(group) >= P.LEAST_DOCUMENTS else groups[lang]
        kept = False
        if not failed and value is not None and group:
            middle, low, high = quantiles(group)
            room = P.ALLOWANCE / max(letters, 1)
            kept = middle - P.WIDTH * max(middle - low, P.LEAST_SPREAD) - room <= value <= middle + P.WIDTH * max(high - middle, P.LEAST_SPREAD) + room
        out[doc] = kept
    return out


def test_bands(spark):
    draw = random.Random(4)
    rows = [(i, draw.choice(["en", "en", "en", None, "x"]), draw.choice([0, 1, 30, 200, 210, 5000]), draw.random() < 0.1, draw.gauss(2, 0.2 + (i % 9 == 0))) for i in range(600)]
    rows = [(*r[:4], None if r[2] == 0 else abs(r[4])) for r in rows] + [(1000, "alone", 50, False, 3.0), (1001, "failed", 50, True, 3.0)]
    frame = spark.createDataFrame(rows, "doc_id long, lang string, letters long, base_failed boolean, log_perplexity double")
    assert {r.doc_id: r.kept for r in P.judge(frame).collect()} == brute_bands(rows)


@pytest.fixture(scope="module")
def judged(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    return docs, labels, {r.doc_id: r for r in queries.queries()["op1_quality_rules"](spark, sf).collect()}


def test_query_rejects_junk_and_keeps_clean(judged):
    docs, labels, got = judged
    assert len(got) == len(docs)
    for d, r in got.items():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_base(docs[d].text)
        assert r.base_failed == P.base_failed(r.n_words, r.n_repeat_words) and not (r.kept and r.base_failed)
    passed = {d for d in labels if not got[d].base_failed}
    clean = [got[d].kept for d in passed if labels[d].quality == 1]
    junk = [got[d].kept for d in passed if labels[d].quality == 0]
    assert sum(clean) >= 0.99 * len(clean) and sum(junk) <= 0.15 * len(junk) and len(junk) > 20


def test_spoiled_texts_are_rejected(spark, judged):
    docs, labels, got = judged
    draw = random.Random(5)
    clean = [d for d in labels if labels[d].quality == 1 and got[d].kept and got[d].n_words >= 100][:150]
    cyrillic = "абвгдежзийклмнопрстуфхцчшщыэюя"
    map_of = {c: cyrillic[i] for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")}
    russian = lambda text: "".join(map_of.get(c.lower(), c) for c in text if c.lower() in map_of or not c.isalpha())
    rows = [(d, r.text, r.lang) for d, r in docs.items()]
    rows += [(10_000 + d, russian(docs[d].text), "ru") for d in docs if docs[d].lang == "en" and docs[d].text]
    rows += [(20_000 + d, re.sub("[а-я]", lambda _: draw.choice(cyrillic), russian(docs[d].text)), "ru") for d in clean[:20] if docs[d].lang == "en"]
    shuffled = {}
    for d in clean[::6]:
        words = docs[d].text.split()
        draw.shuffle(words)
        shuffled[30_000 + d] = " ".join(words)
    rows += [(d, text, docs[d - 30_000].lang) for d, text in shuffled.items()]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    kept = {r.doc_id: r.kept for r in P.judge(P.statistics(frame)).collect()}
    random_letters = [kept[d] for d in kept if 20_000 <= d < 30_000]
    assert len(random_letters) > 5 and not any(random_letters)
    transcribed = [kept[10_000 + d] for d in clean if 10_000 + d in kept]
    assert sum(transcribed) >= 0.95 * len(transcribed)
    assert sum(kept[d] for d in shuffled) <= 0.35 * len(shuffled)


def test_edges(spark):
    rows = [(1, None, "en"), (2, "", "en"), (None, "one two three four five six seven eight nine ten eleven", None), (3, "7 8 9 10 11 12 13 14 15 16 17", "en"),
            (4, "word " * 40_000, "en"), (5, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "xx"), (5, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "xx")]
    frame = spark.createDataFrame([(*r, 1.5, "clash", "x") for r in rows], "doc_id long, text string, lang string, letters double, fold string, _cost string")
    got = P.judge(P.statistics(frame)).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert by_id[1].base_failed and by_id[2].base_failed and by_id[1].log_perplexity is None
    assert by_id[3].log_perplexity is None and not by_id[3].kept and not by_id[3].base_failed
    assert by_id[None].kept and by_id[5].kept
    kept = P.keep(frame)
    assert kept.columns == frame.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 5, 5]
    assert P.keep(frame.limit(0)).count() == 0 and P.statistics(frame.limit(0)).count() == 0
