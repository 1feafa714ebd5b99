"""Quality classifier: random Fourier features, ridge by partition-summed normal equations, isotonic calibration.

Statistics of a text are standardised and mapped to cosines and sines of seeded random
projections, which approximate a Gaussian kernel. The labelled sample lies in PARTS partitions; each
adds up its part of the normal equations, apart for each of FOLDS folds, and the driver adds the PARTS * FOLDS matrices. The ridge
scores are calibrated by the pool-adjacent-violators algorithm over score bins: each labelled row is scored by the
weights of the other folds, so the calibration does not see the scores of rows that the weights were fitted to.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, in_sample, sample_limit, slices, stage, table
from .textstats import TextStats

#: Labelled documents, about, from which the classifier is fitted.
SAMPLE_ROWS = 12_000
FREQUENCIES = 160
RIDGE = 1e-3
SEED = 5
#: Partitions that add up equations, and folds for the calibration: the driver gets so many matrices, whatever the input's size.
PARTS, FOLDS = 4, 4
BINS = 400
N_FEATURES = 16


def features(text: str | None) -> list[float]:
    """Statistics of the whole text; an empty or null text has zeros."""
    t = TextStats(text)
    n = max(t.n_words, 1)
    chars, letters, lines = max(t.word_chars, 1), max(t.n_lower + t.n_upper, 1), max(len(t.lines), 1)
    commas, stops, pipes = t.text.count(","), t.text.count("."), t.text.count(" | ")
    return [
        np.log1p(t.n_words), t.word_chars / n, min(t.n_symbols / n, 1.0), t.n_digits / chars, t.n_upper / letters, t.n_dup_lines / lines,
        t.n_distinct_words / n, t.n_repeat_words / n, min(t.n_exclaim / n, 1.0), commas / n, stops / n, min(pipes / n, 1.0),
        np.log1p(n / lines), (chars - letters) / chars, np.log1p(max(map(len, t.words), default=0)), t.text.count("?") / n,
    ]


@dataclass
class Model:
    """Standardisation, random projection, ridge weights and the calibration's steps."""

    mean: np.ndarray
    scale: np.ndarray
    omega: np.ndarray
    weights: np.ndarray | None = None
    xs: np.ndarray | None = None
    ys: np.ndarray | None = None

    def kernel(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        p = z @ self.omega
        return np.hstack([np.cos(p), np.sin(p), z, np.ones((len(z), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.kernel(x) @ self.weights

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.xs, self.ys)


def pool(score: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of label on score (sorted by score): middle and value of each block."""
    blocks: list[list[float]] = []
    for s, y, w in zip(score, label, weight, strict=True):
        blocks.append([s * w, y * w, w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_ROWS) -> Model | None:
    """A model from docs (doc_id, text) and labels (doc_id, quality 0 or 1); None without any label.

    At most about ``sample`` labels count, chosen by hash of the id, so the labels' side of the join
    has a bounded size. Null ids and null labels are left out; equal ids each count.
    """
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").cast("double").alias("y"))
    n = known.count()
    part = in_sample("doc_id", sample_limit(sample, n), SEED)
    some = docs.select("doc_id", "text").join(F.broadcast(known.filter(part)), "doc_id")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array([features(t) for t in b.column("text").to_pylist()], pa.list_(pa.float64())), b.column("y"), b.column("fold"), b.column("k")], ["x", "y", "fold", "k"])

    fold = F.pmod(F.xxhash64("doc_id", F.lit(SEED + 1)), F.lit(FOLDS)).cast("int").alias("fold")
    rows = some.select("text", "y", fold, F.xxhash64("doc_id").alias("k")).mapInArrow(measure, "x array<double>, y double, fold int, k long")
    rows = stage(rows, "labelled")
    at = [F.col("x")[i] for i in range(N_FEATURES)]
    r = rows.select(F.count("*"), *[F.avg(c) for c in at], *[F.stddev_pop(c) for c in at]).first()
    if not r[0]:
        return None
    rng = np.random.default_rng(SEED)
    model = Model(np.array(r[1 : N_FEATURES + 1]), np.maximum(np.array(r[N_FEATURES + 1 :]), 1e-3), rng.normal(size=(N_FEATURES, FREQUENCIES)) / np.sqrt(N_FEATURES / 2))
    size = 2 * FREQUENCIES + N_FEATURES + 1

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FOLDS, size, size + 1))
        for b in batches:
            x = model.kernel(np.array(b.column("x").to_pylist(), dtype=float).reshape(-1, N_FEATURES))
            y, fold = (b.column(c).to_numpy(zero_copy_only=False) for c in ("y", "fold"))
            for f in np.unique(fold):
                total[f] += x[fold == f].T @ np.hstack([x, y[:, None]])[fold == f]
        for f in range(FOLDS):
            if total[f].any():
                yield pa.RecordBatch.from_arrays([pa.array([f], pa.int32()), pa.array([total[f].tobytes()], pa.binary())], ["fold", "m"])

    eq = np.zeros((FOLDS, size, size + 1))
    for p in rows.coalesce(PARTS).mapInArrow(equations, "fold int, m binary").collect():
        eq[p["fold"]] += np.frombuffer(p["m"]).reshape(size, size + 1)

    def solve(e: np.ndarray) -> np.ndarray:
        return np.linalg.solve(e[:, :-1] + RIDGE * e[-1, -2] * np.eye(size), e[:, -1])  # e[-1, -2]: number of rows, by the constant feature

    model.weights = solve(eq.sum(0))
    others = np.stack([solve(eq.sum(0) - eq[f]) if eq[f].any() and (eq.sum(0) - eq[f])[-1, -2] > 0 else model.weights for f in range(FOLDS)])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = model.kernel(np.array(b.column("x").to_pylist(), dtype=float).reshape(-1, N_FEATURES))
            s = (x * others[b.column("fold").to_numpy()]).sum(1)
            yield pa.RecordBatch.from_arrays([pa.array(np.floor(np.clip(s, -0.5, 1.5) * BINS).astype(np.int64)), pa.array(s), b.column("y")], ["bin", "s", "y"])

    bins = rows.mapInArrow(binned, "bin long, s double, y double").groupBy("bin").agg(F.avg("s").alias("s"), F.avg("y").alias("y"), F.count("*").alias("n")).orderBy("bin").collect()
    model.xs, model.ys = pool(*(np.array([b[c] for b in bins], dtype=float) for c in ("s", "y", "n")))
    return model


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score (0 to 1) and predicted for each row of docs (doc_id, text; others are ignored); 0.5 for all without a model."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            s = quality_scores(b.column("text").to_pylist(), model)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(predict, f"doc_id {id_type}, score double, predicted int")


def quality_scores(texts: list[str | None], model: Model | None) -> np.ndarray:
    if model is None or not texts:
        return np.full(len(texts), 0.5)
    return np.clip(model.predict(np.array([features(t) for t in texts], dtype=float).reshape(-1, N_FEATURES)), 0.0, 1.0)


def keep_good(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of docs, all columns, whose score is 0.5 or more."""

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield b.filter(pa.array(quality_scores(b.column("text").to_pylist(), model) >= 0.5))

    return docs.mapInArrow(good, docs.schema)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.filter(crc_mod(F.col("doc_id"), 3) != 1))
    return score(docs, model).select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")
