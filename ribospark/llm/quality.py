"""Quality classifier: naive Bayes support vectors (NBSVM).

A text is the set of its n-grams: byte trigrams, word shapes and pairs of them, and runs of
one word repeated, hashed into ``DIMS`` indicators. Indicators are scaled by the log ratio of
their smoothed counts in the two classes; on these a linear hinge-loss model is fitted by dual
coordinate descent, and a sigmoid fitted on rows kept apart turns margins into scores.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, pieces

DIMS = 1 << 17
TRIGRAM_DIMS = 1 << 16
PIECE = 1 << 20

_SHAPES = bytes(b"A"[0] if 65 <= c <= 90 else b"a"[0] if 97 <= c <= 122 else b"0"[0] if 48 <= c <= 57 else b"u"[0] if c >= 128 else c for c in range(256))
_RUNS = [re.compile(b"\x01" * n) for n in (2, 3, 6)]


def _hash(token: bytes) -> int:
    h = 1469598103934665603  # FNV-1a
    for c in token:
        h = ((h ^ c) * 1099511628211) & 0xFFFFFFFFFFFFFFFF
    return TRIGRAM_DIMS + (h ^ (h >> 32)) % (DIMS - TRIGRAM_DIMS)


def ngrams(text: str | None, known: dict[bytes, int]) -> np.ndarray:
    """Sorted indicator numbers of a whole text; ``known`` remembers hashes of shapes."""
    data = (text or "").encode()
    parts = []
    raw = np.frombuffer(data, np.uint8)
    for a in range(0, len(raw), PIECE):  # a piece at a time, so that a very long text takes no more memory
        b = raw[a : a + PIECE + 2].astype(np.uint32)
        if len(b) >= 3:
            codes = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
            parts.append(np.unique((codes * np.uint32(2654435761)) >> np.uint32(16)))
    shaped = np.frombuffer(data.translate(_SHAPES), np.uint8)
    shapes = shaped[np.flatnonzero(np.diff(shaped, prepend=0))].tobytes().split()
    tokens = set(shapes)
    tokens.update(b"%s %s" % p for p in set(zip(shapes, shapes[1:], strict=False)))
    words = data.split()
    same = bytes(x == y for x, y in zip(words, words[1:], strict=False))
    tokens.update(b"run %d" % i for i, run in enumerate(_RUNS) if run.search(same))
    extra = []
    for t in tokens:
        if t not in known:
            if len(known) > 200_000:
                known.clear()
            known[t] = _hash(t)
        extra.append(known[t])
    return np.unique(np.concatenate([*parts, np.array(extra, np.uint32)])).astype(np.int32) if parts or extra else np.zeros(0, np.int32)


@dataclass(frozen=True)
class QualityModel:
    """Weights over the indicators (log-count ratios multiplied in), bias, and the sigmoid's slope and offset."""

    weights: bytes
    bias: float
    slope: float
    offset: float

    def margin(self, found: np.ndarray, weights: np.ndarray) -> float:
        return float(weights[found].sum() / np.sqrt(max(len(found), 1))) + self.bias

    def score(self, margin: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30))))


def fit(rows: list[np.ndarray], labels: np.ndarray, cost: float = 1.0, epochs: int = 20, smooth: float = 1.0, seed: int = 1) -> QualityModel:
    """Fit on indicator sets with 0/1 labels; every fifth row is kept apart for the sigmoid."""
    labels = np.asarray(labels, np.int64)
    if len(labels) < 10 or labels.min() == labels.max():
        share = (labels.sum() + 1) / (len(labels) + 2)
        return QualityModel(np.zeros(DIMS).tobytes(), 0.0, 0.0, float(np.log(share / (1 - share))))
    counts = np.full((2, DIMS), smooth)
    train = np.arange(len(rows)) % 5 != 4
    for i in np.flatnonzero(train):
        counts[labels[i], rows[i]] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    order, y = np.flatnonzero(train), np.where(labels == 1, 1.0, -1.0)
    values = {i: ratio[rows[i]] / np.sqrt(max(len(rows[i]), 1)) for i in order}
    norms = {i: float(v @ v) + 1.0 for i, v in values.items()}
    w, bias, alpha, rng = np.zeros(DIMS), 0.0, np.zeros(len(rows)), np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(order):
            gradient = y[i] * (w[rows[i]] @ values[i] + bias) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), cost)
            step = (new - alpha[i]) * y[i]
            if step:
                w[rows[i]] += step * values[i]
                bias += step
                alpha[i], moved = new, max(moved, abs(step))
        if moved < 1e-3:
            break
    weights = w * ratio
    model = QualityModel(weights.tobytes(), bias, 1.0, 0.0)
    apart = np.flatnonzero(~train)
    margins = np.array([model.margin(rows[i], weights) for i in apart])
    slope, offset = _sigmoid(margins, labels[apart])
    return QualityModel(model.weights, bias, slope, offset)


def _sigmoid(margins: np.ndarray, labels: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and offset of P(label 1), by Newton's method on smoothed targets (Platt)."""
    n1, n0 = int(labels.sum()), int((1 - labels).sum())
    t = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margins, np.ones_like(margins)], 1)
    theta = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        theta = theta - np.clip(np.linalg.solve(hessian, x.T @ (p - t) + 1e-3 * (theta - [1.0, 0.0])), -2, 2)
    return float(max(theta[0], 1e-6)), float(theta[1])


def _indicators(batches):
    known: dict[bytes, int] = {}
    for batch in pieces(batches):
        found = [ngrams(x, known) for x in batch.column(2).to_pylist()]
        yield pa.record_batch({"place": batch.column(0), "label": batch.column(1), "found": pa.array([x.tobytes() for x in found], pa.binary())})


def _fitted(table: pa.Table) -> pa.Table:
    table = table.sort_by([("place", "ascending"), ("found", "ascending"), ("label", "ascending")])
    m = fit([np.frombuffer(x, np.int32) for x in table["found"].to_pylist()], table["label"].to_numpy())
    return pa.table({"weights": pa.array([m.weights], pa.binary()), "bias": [m.bias], "slope": [m.slope], "offset": [m.offset]})


def held_out(id_col: Column, folds: int = 5) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds == 0


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = 8000) -> QualityModel:
    """Fit on at most ``max_train`` labelled rows outside the held-out fold, those with the least hashes of their ids.

    Rows without id or label are left out; of several labels of one id the larger counts. Without
    two classes the model scores every text the smoothed share of label 1.
    """
    bounded_batches(docs.sparkSession)
    chosen = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where("id IS NOT NULL AND label IN (0, 1)")
    chosen = chosen.where(~held_out(F.col("id"))).groupBy("id").agg(F.max("label").alias("label"))
    chosen = materialize(chosen.withColumn("place", F.xxhash64("id")).orderBy("place", "id").limit(max_train), "labels")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")  # at most max_train ids
    rows = materialize(texts.select("place", "label", "text").mapInArrow(_indicators, "place long, label int, found binary"), "indicators")
    rows = rows.orderBy("place", F.xxhash64("found")).limit(max_train).withColumn("all", F.lit(1))
    got = rows.groupBy("all").applyInArrow(_fitted, "weights binary, bias double, slope double, offset double").first()
    return QualityModel(bytes(got.weights), got.bias, got.slope, got.offset) if got else fit([], np.zeros(0, np.int64))


def _scorer(model: QualityModel):
    def score(batches):
        weights, known = np.frombuffer(model.weights, np.float64), {}
        for batch in pieces(batches):
            at = batch.schema.get_field_index("_text")
            scores = [model.score(model.margin(ngrams(x, known), weights)) for x in batch.column(at).to_pylist()]
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names) if i != at}
            yield pa.record_batch(columns | {"score": pa.array(scores, pa.float64())})

    return score


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row per input row: ``doc_id, held_out, score, predicted``. The text alone makes the score; null counts as empty.

    Ids may be null or repeated. An empty table gives an empty result; very long texts are taken whole.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"))
    rows = rows.mapInArrow(_scorer(model), "doc_id long, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: QualityModel, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with their own columns."""
    bounded_batches(docs.sparkSession)
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)], F.col(text_col).alias("_text"))
    schema = ", ".join(f"c{i} {t}" for i, (_, t) in enumerate(docs.dtypes)) + ", score double"
    kept = plain.mapInArrow(_scorer(model), schema).where(F.col("score") >= threshold)
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
