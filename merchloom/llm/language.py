"""Language identification by the nearest of several centroids per language.

A text is the set of letter trigrams of its case-folded words, hashed into ``BUCKETS`` dimensions,
weighted by TF-IDF and normalised. Labelled texts of one language are clustered into ``CENTROIDS``
centroids; the language of the centroid with the largest cosine wins. A text that is too far from all
centroids of its language, measured against the language's own texts, is marked as rejected.

The model is fitted on a bounded sample: per language at most ``SAMPLE`` texts, those with the smallest
hash of their id. Every text is classified as a whole.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchloom.llm.arrow import code_points, pieces
from merchloom.operators.ranking import top_per_group
from merchloom.session import cut_lineage

BUCKETS = 4096
CENTROIDS = 4
SAMPLE = 400
MAX_LANGUAGES = 1000
#: A text is rejected below this share of the cosine that its language's texts of its length have.
MIN_SHARE = 0.35
#: Trigrams at which a text's expected cosine is 0.7 of that of a long text.
SHORT = 60
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """Lower-case code point of each letter, 0 for everything else."""
    table = np.zeros(sys.maxunicode + 1, np.uint32)
    for c in range(len(table)):
        char = chr(c)
        if char.isalpha():
            low = char.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def trigram_counts(texts: list[bytes | None]) -> np.ndarray:
    """One row of hashed trigram counts per text. A trigram is a letter and its neighbours; a word's ends count as one blank."""
    parts = []
    for text in texts:
        parts += [code_points(text or b""), np.zeros(1, np.uint32)]
    sizes = [len(p) for p in parts[::2]]
    line = _letters()[np.concatenate([np.zeros(1, np.uint32), *parts])]
    of = np.repeat(np.arange(len(texts)), np.array(sizes) + 1)
    of = np.concatenate([[0], of])
    kept = np.ones(len(line), bool)
    kept[1:] = (line[1:] != 0) | (line[:-1] != 0)
    line, of = line[kept].astype(np.uint64), of[kept]
    mixed = line[:-2] * np.uint64(0x9E3779B97F4A7C15) + line[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + line[2:] * np.uint64(0x165667B19E3779F9)
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(52)
    middle = line[1:-1] != 0
    cells = of[1:-1][middle] * BUCKETS + mixed[middle].astype(np.int64)
    return np.bincount(cells, minlength=len(texts) * BUCKETS).reshape(len(texts), BUCKETS)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF rows; a text without letters stays zero."""
    out = np.log1p(counts).astype(np.float32) * idf
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def expected_share(trigrams: np.ndarray) -> np.ndarray:
    """Share of a long text's cosine that a text of so many trigrams reaches."""
    return np.sqrt(trigrams / (trigrams + SHORT))


def cluster(rows: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Centroids by spherical k-means; the first are chosen farthest from each other, so reruns agree."""
    centers = [rows.mean(axis=0)]
    for _ in range(min(k, len(rows)) - 1):
        nearest = np.max(rows @ np.array(centers).T, axis=1)
        centers.append(rows[int(np.argmin(nearest))])
    found = np.array(centers)
    for _ in range(rounds):
        found = found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)
        to = np.argmax(rows @ found.T, axis=1)
        found = np.array([rows[to == c].mean(axis=0) if (to == c).any() else found[c] for c in range(len(found))])
    return (found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)).astype(np.float32)


@dataclass
class Model:
    """``languages`` in code-point order; rows of ``centroids`` belong to ``of``; ``usual`` is a language's median cosine."""

    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    of: np.ndarray
    usual: np.ndarray

    def predict(self, texts: list[bytes | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, rejected) per text; equal cosines go to the first language."""
        counts = trigram_counts(texts)
        total = counts.sum(axis=1)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        near = weighted(counts, self.idf) @ self.centroids.T
        best = np.array([near[:, self.of == k].max(axis=1) for k in range(len(self.languages))]).T
        to = best.argmax(axis=1)
        score = np.clip(best[np.arange(len(texts)), to].astype(np.float64), 0.0, 1.0)
        score[total == 0] = 0.0
        names = [self.languages[k] if n else UNKNOWN for k, n in zip(to, total, strict=True)]
        return names, score, score < MIN_SHARE * self.usual[to] * expected_share(np.maximum(total, 1))


def sampled_ids(docs: DataFrame, usable: Column, id_col: str, lang_col: str, per_language: int) -> DataFrame:
    """(id, language) of the training sample: narrow columns only, and a hot language is ranked by many tasks."""
    rows = docs.where(usable & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.xxhash64(id_col).alias("draw"))
    return top_per_group(rows, ["lang"], ["draw", "id"], per_language, salt_by=["id"]).select("id", "lang").distinct()


def fit(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        per_language: int = SAMPLE, k: int = CENTROIDS) -> Model:
    """Learn from the rows for which ``usable`` holds and whose language is known.

    The ids of the sample, ``per_language * MAX_LANGUAGES`` at most, are sent to every task, so only sampled
    texts are moved. At most ``per_language`` texts of a language meet in one task, and ``(k + 1) * BUCKETS`` numbers
    per language reach the driver; more than ``MAX_LANGUAGES`` languages are refused.
    """
    chosen = cut_lineage(sampled_ids(docs, usable, id_col, lang_col, per_language))
    if chosen.count() > per_language * MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages: is {lang_col} a language column?")
    texts = docs.where(usable & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).join(F.broadcast(chosen), ["id", "lang"], "left_semi")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, found in pieces(batches, "text"):
            counts = trigram_counts(found)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), pa.array([c.astype("<u4").tobytes() for c in counts], pa.binary())], ["id", "lang", "counts"])

    kind = docs.schema[id_col].dataType.simpleString()
    counted = texts.mapInArrow(vectors, f"id {kind}, lang string, counts binary")

    sample = cut_lineage(counted)

    def matrix(group: pd.DataFrame) -> np.ndarray:
        return np.stack([np.frombuffer(c, "<u4") for c in group.sort_values("id")["counts"]]).astype(np.int64)

    def found_in(group: pd.DataFrame) -> pd.DataFrame:
        texts, found = frequencies(matrix(group))
        return pd.DataFrame({"lang": group["lang"].iloc[:1], "texts": [texts], "found": [found.tobytes()]})

    parts = sample.groupBy("lang").applyInPandas(found_in, "lang string, texts long, found binary").collect()
    idf = inverse(sum(r.texts for r in parts), sum((np.frombuffer(r.found, np.int64) for r in parts), np.zeros(BUCKETS, np.int64)))
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def centers_of(group: pd.DataFrame) -> pd.DataFrame:
        centers, usual = learn(matrix(group), shared.value, k)
        return pd.DataFrame({"lang": group["lang"].iloc[:1], "centers": [centers.tobytes()], "usual": [usual]})

    learned = sample.groupBy("lang").applyInPandas(centers_of, "lang string, centers binary, usual double").collect()
    return assemble({r.lang: (np.frombuffer(r.centers, np.float32).reshape(-1, BUCKETS), r.usual) for r in learned}, idf)


def frequencies(rows: np.ndarray) -> tuple[int, np.ndarray]:
    """(texts with a letter, texts that hold each trigram)."""
    return int((rows.sum(axis=1) > 0).sum()), (rows > 0).sum(axis=0).astype(np.int64)


def inverse(texts: int, found: np.ndarray) -> np.ndarray:
    return (np.log((1 + texts) / (1 + found)) + 1).astype(np.float32)


def learn(rows: np.ndarray, idf: np.ndarray, k: int = CENTROIDS) -> tuple[np.ndarray, float]:
    """(centroids, usual cosine) of one language; texts without letters teach nothing."""
    rows = rows[rows.sum(axis=1) > 0]
    if not len(rows):
        return np.zeros((0, BUCKETS), np.float32), 0.0
    unit = weighted(rows, idf)
    centers = cluster(unit, k)
    return centers, float(np.median((unit @ centers.T).max(axis=1) / expected_share(rows.sum(axis=1))))


def assemble(learned: dict[str, tuple[np.ndarray, float]], idf: np.ndarray) -> Model:
    languages = sorted(lang for lang, (centers, _) in learned.items() if len(centers))
    parts = [learned[lang][0] for lang in languages]
    of = [number for number, centers in enumerate(parts) for _ in range(len(centers))]
    return Model(languages, idf, np.concatenate([np.zeros((0, BUCKETS), np.float32), *parts]), np.array(of, np.int64),
                 np.array([learned[lang][1] for lang in languages]))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, rejected`` from the text alone; ``und`` and score 0 without a letter."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in pieces(batches, "text", rows=512):
            names, score, rejected = shared.value.predict(texts)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                ["doc_id", "lang_pred", "score", "rejected"])

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def keep(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The documents that are not rejected, with all their columns and without moving a text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in pieces(batches, text_col, rows=512):
            yield rows.filter(pa.array(~shared.value.predict(texts)[2]))

    return docs.mapInArrow(run, docs.schema)
