"""Quality scores by nearest-neighbour voting among labelled latent-semantic vectors.

A text is a bag of terms: trigrams of character classes (each ASCII sign a class of its own, letters by
case, digits, blanks, line ends, bytes beyond ASCII) and counts of how it repeats itself. Labelled texts give
the terms' weights (log count times inverse document frequency) and, by a truncated singular value
decomposition, the latent space. Their vectors are broadcast; every document takes exact cosine products with all
of them, block by block, and its NEIGHBOURS nearest vote with their labels, weighted by similarity.

The labelled texts are a sample of at most MAX_LABELLED, those of the smallest hashes of their doc_ids, half of
either label where there are enough; votes are weighted back to the labels' shares in all labelled rows.

Defined cases: a null text is empty; a text without terms has the zero vector and the score of the labels'
share; a null or odd label is no label; repeated label rows vote once; without labelled rows every score is 0.5;
a null doc_id is scored like any other; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearsay.llm.common import table

#: The most labelled texts that are learnt from.
MAX_LABELLED = 6000
DIMENSIONS = 48
NEIGHBOURS = 25
#: Cosines are raised to this power as weights of the votes.
SHARPNESS = 8
THRESHOLD = 0.3
#: Documents compared at once.
BLOCK = 256
#: Words among which a word counts as seen before.
WINDOW = 400

_OTHER = 27
_SIGNS = b"!#$%&*.,;:?|\"'()-/=<>@_"
CLASSES = 32


def _classes() -> bytes:
    own = bytearray([_OTHER]) * 256
    for k, c in enumerate(_SIGNS):
        own[c] = 4 + k
    own[ord("a") : ord("z") + 1] = bytes([0]) * 26
    own[ord("A") : ord("Z") + 1] = bytes([1]) * 26
    own[ord("0") : ord("9") + 1] = bytes([2]) * 10
    own[ord(" ")] = own[ord("\t")] = 3
    own[ord("\n")] = own[ord("\r")] = 28
    own[128:256] = bytes([29]) * 128
    return bytes(own)


_TABLE = _classes()
TRIGRAMS = CLASSES**3
#: Terms beyond the trigrams: pairs of equal neighbouring words, words seen before in their window (over all windows of the text), lines seen before, capitals, signs and so on in proportion.
REPEATS = 6
TERMS = TRIGRAMS + 16 * REPEATS


def _shares(text: bytes) -> list[float]:
    words = text.split()
    n = max(1, len(words))
    lines = text.split(b"\n")
    codes = np.frombuffer(text.translate(_TABLE), np.uint8)
    letters = max(1, int(np.count_nonzero((codes < 2) | (codes == 29))))
    return [
        sum(map(bytes.__eq__, words, words[1:])) / n,
        sum(map(bytes.__eq__, words, words[2:])) / n,
        1 - len(set(lines)) / len(lines),
        np.count_nonzero(codes == 1) / letters,
        np.count_nonzero((codes > 3) & (codes < 28)) / max(1, len(codes)),
        1 - sum(len({*words[at : at + WINDOW]}) for at in range(0, len(words), WINDOW)) / n,
    ]


def terms(text: bytes) -> np.ndarray:
    """Counts of all terms. A share of s adds weight to the first 16 * sqrt(s) of its 16 terms."""
    out = np.zeros(TERMS, np.float32)
    if not text:
        return out
    codes = np.frombuffer(text.translate(_TABLE), np.uint8).astype(np.int32)
    if len(codes) > 2:
        found = np.bincount((codes[:-2] * CLASSES + codes[1:-1]) * CLASSES + codes[2:], minlength=TRIGRAMS)
        out[:TRIGRAMS] = np.log1p(found * (1000 / len(codes)))
    for k, share in enumerate(_shares(text)):
        out[TRIGRAMS + 16 * k : TRIGRAMS + 16 * k + round(16 * min(1, max(0, share)) ** 0.5)] = 2
    return out


@dataclass(frozen=True)
class Neighbours:
    """A fitted space: the terms kept, their map into it, and the labelled vectors with the weights of their votes."""

    kept: np.ndarray
    project: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    prior: float

    def vectors_of(self, texts: list[bytes]) -> np.ndarray:
        found = np.stack([terms(t)[self.kept] for t in texts]) @ self.project
        return found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not len(self.vectors):
            return np.full(len(texts), 0.5)
        out = []
        for at in range(0, len(texts), BLOCK):
            cosine = self.vectors_of(texts[at : at + BLOCK]) @ self.vectors.T
            k = min(NEIGHBOURS, cosine.shape[1])
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            vote = np.maximum(np.take_along_axis(cosine, near, 1), 0) ** SHARPNESS * self.weights[near]
            total = vote.sum(1)
            out.append(np.where(total > 0, (vote * self.labels[near]).sum(1) / np.maximum(total, 1e-30), self.prior))
        return np.clip(np.concatenate(out), 0, 1).astype(np.float64)


Sparse = tuple[np.ndarray, np.ndarray]


def sparse(text: bytes) -> Sparse:
    """Places and counts of the terms that a text has."""
    counts = terms(text)
    at = np.flatnonzero(counts)
    return at.astype(np.int32), counts[at]


def fit(found: list[Sparse], labels: list[int], share: float) -> Neighbours:
    """found: terms of labelled texts. share: of label 1 among all labelled rows."""
    y = np.array(labels, np.float32)
    if not len(y):
        none = np.zeros((0, 0), np.float32)
        return Neighbours(np.zeros(0, np.int64), none, none, y, y, 0.5)
    seen = np.zeros(TERMS, np.int64)
    for at, _ in found:
        seen[at] += 1
    kept = np.flatnonzero(seen >= min(3, len(y)))
    idf = np.log((1 + len(y)) / (1 + seen[kept])).astype(np.float32) + 0.5
    place = np.full(TERMS, -1)
    place[kept] = np.arange(len(kept))
    rows = np.zeros((len(y), len(kept)), np.float32)
    for row, (at, counts) in zip(rows, found):
        own = place[at] >= 0
        row[place[at][own]] = counts[own]
    rows *= idf
    k = min(DIMENSIONS, *rows.shape) if rows.size else 0
    values, vectors = np.linalg.eigh((rows.T @ rows).astype(np.float64)) if rows.shape[1] <= rows.shape[0] else (None, None)
    right = vectors[:, ::-1][:, :k] if values is not None else np.linalg.svd(rows, full_matrices=False)[2][:k].T
    project = (idf[:, None] * right).astype(np.float32)
    places = rows @ right.astype(np.float32)
    places /= np.maximum(np.linalg.norm(places, axis=1, keepdims=True), 1e-12)
    ones = max(1e-9, float(y.mean()))
    weights = np.where(y > 0, share / ones, (1 - share) / max(1e-9, 1 - ones)).astype(np.float32)
    return Neighbours(kept, project, places, y, weights, share)


def held_out(doc_id: Column) -> Column:
    """Rows that are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Neighbours:
    """docs (doc_id, text), labels (doc_id, quality): learns from rows that aren't held out."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    total = {r[0]: r[1] for r in known.groupBy("quality").count().collect()}
    if not total:
        return fit([], [], 0.5)
    share, half = total.get(1, 0) / sum(total.values()), MAX_LABELLED // 2
    most = {0: max(half, MAX_LABELLED - total.get(1, 0)), 1: max(half, MAX_LABELLED - total.get(0, 0))}
    chosen = None
    for q, n in most.items():
        part = known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        chosen = part if chosen is None else chosen.union(part)
    texts = docs.where(F.col("doc_id").isNotNull()).join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", F.col("text").cast("binary"))
    rows = texts.mapInArrow(_terms, "doc_id long, quality int, at array<int>, counts array<float>").toArrow()
    found = sorted(zip(rows["doc_id"].to_pylist(), (x.values.to_numpy() for x in rows["at"]), (x.values.to_numpy() for x in rows["counts"]), rows["quality"].to_pylist()), key=lambda r: (r[0], len(r[1]), r[1].tolist(), r[2].tolist()))
    return fit([(at, counts) for _, at, counts, _ in found], [q for *_, q in found], share)


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [sparse(x.as_py() or b"") for x in batch.column(2)]
        more = [pa.array([f[k] for f in found], pa.list_(kind)) for k, kind in ((0, pa.int32()), (1, pa.float32()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int32()), *more], ["doc_id", "quality", "at", "counts"])


def score_documents(docs: DataFrame, model: Neighbours) -> DataFrame:
    """(doc_id, score) of every row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.as_py() or b"" for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.scores(texts) if texts else np.zeros(0))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, "doc_id long, score double")


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that the classifier rejects. Rows of one doc_id go together; rows without one stay."""
    rejected = score_documents(docs, train(docs, labels)).where((F.col("score") < THRESHOLD) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return docs.join(rejected, "doc_id", "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    """op1: score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return score_documents(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
