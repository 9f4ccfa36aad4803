"""Encoding, length histogram and packing."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from merchloom.llm import lengths, packing, queries
from merchloom.llm.queries import vocabulary
from merchloom.llm.tokens import Encoder

TEXTS = ["", " ", "a", None, "a  b\n\n c\t", "don't we'll", "<|endoftext|> x", "Ünï ßó 日本語 🙂 é", "x" * 5000, "½ ²3\x1cq\x85 \xa0z", "a b " * 4000]


@pytest.fixture(scope="module")
def encoder():
    return Encoder(vocabulary())


@given(st.text(max_size=60) | st.text("ab <|>'s\n\té ½9", max_size=60))
@settings(max_examples=300, deadline=None)
def test_ids_are_the_tokenizers(encoder, tokenizer, text):
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_ids_of_documents(encoder, tokenizer, docs):
    for row in docs.select("text").collect():
        assert np.frombuffer(encoder.encode(row.text), "<u4").tolist() == tokenizer.encode(row.text, add_special_tokens=False).ids


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, ids string, length string")


def test_histogram_against_brute_force(spark, tokenizer):
    texts = TEXTS * 2
    sizes = np.array([len(tokenizer.encode(t or "", add_special_tokens=False).ids) for t in texts])
    hist = lengths.length_histogram(frame(spark, texts), vocabulary())
    for r in lengths.suffix_sums(hist).collect():
        n = r.n_tokens
        assert (r.n_docs, r.docs_at_least, r.tokens_at_least) == ((sizes == n).sum(), (sizes >= n).sum(), sizes[sizes >= n].sum())
        assert r.truncated_total == np.minimum(sizes, n).sum() and r.quantile == pytest.approx((sizes <= n).mean())
    asked = spark.createDataFrame([(n,) for n in (0, 3, 100, 2048, 10**6)], "context_limit long")
    got = {r.context_limit: r.truncated_total for r in lengths.at_limits(hist, asked).collect()}
    assert got == {n: np.minimum(sizes, n).sum() for n in (0, 3, 100, 2048, 10**6)}
    assert lengths.suffix_sums(lengths.length_histogram(frame(spark, []), vocabulary())).count() == 0


def check_packing(rows, want, length, whole=True):
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(docs) == set(want)
    for doc, parts in docs.items():
        ids = np.array(want[doc], "<u4")
        parts.sort(key=lambda r: r.start)
        assert [r.start for r in parts] == np.cumsum([0, *[r.length for r in parts]])[:-1].tolist()
        assert sum(r.length for r in parts) == len(ids) and {r.doc_tokens for r in parts} == {len(ids)}
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes()) for r in parts)
    for parts in sequences.values() if whole else ():
        parts.sort(key=lambda r: r.offset)
        assert [r.offset for r in parts] == np.cumsum([0, *[r.length for r in parts]])[:-1].tolist()
        total = sum(r.length for r in parts)
        assert total == length or total < length and total & (total - 1) == 0


def test_packing_covers_every_id_once(spark, docs, tokenizer):
    some = frame(spark, TEXTS)
    want = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(TEXTS)}
    check_packing(queries.packed_rows(some).collect(), want, packing.SEQUENCE_TOKENS)
    want = {r.doc_id: [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1] for r in docs.collect()}
    rows = queries.packed_rows(docs)
    check_packing(rows.collect(), want, packing.SEQUENCE_TOKENS)
    assert sorted(rows.collect()) == sorted(rows.collect())
    assert queries.packed_rows(some.limit(0)).count() == 0


@given(st.lists(st.integers(1, 63), max_size=40), st.booleans())
@settings(max_examples=200, deadline=None)
def test_lots_are_filled_and_balanced(sizes, last):
    packer = packing.Packer(64, 1.0, 0.02)
    for doc, n in enumerate(sizes):
        assert packer.add(doc, n) == []
    placed = packer.close_lot(last)
    filled = defaultdict(int)
    for (_, _, n), s, offset in placed:
        assert offset == filled[s]
        filled[s] += n
    assert sum(filled.values()) + packer.held == sum(sizes) and packer.held < 64
    assert all(n == 64 for n in filled.values()) or last
    assert not last or packer.held == 0


def test_longest_piece_goes_to_the_cheapest_sequence():
    placed, rest = packing.deal([(0, 0, 10), (1, 0, 40), (2, 0, 30)], [64, 64], 1.0, 0.1)
    assert not rest and {p[0]: s for p, s, _ in placed} == {1: 0, 2: 1, 0: 1}


def test_repeated_and_missing_ids_are_documents_of_their_own(spark):
    rows = queries.packed_rows(spark.createDataFrame([(None, "a b"), (7, "a b"), (7, "a b")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.doc_tokens) for r in rows if r.start == 0) == [(0, 3), (7, 3), (7, 3)]
