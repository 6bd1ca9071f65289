"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Statistics of the whole text (lengths, character classes, repetition) are
standardised and mapped by random Fourier features, whose inner products
approximate a Gaussian kernel.  Each partition sums its normal equations; the
sums add up in Spark, and the ridge weights are the solution of one system of
fixed size.  Raw scores become probabilities by isotonic regression on a fold
that the weights have not seen, over a histogram of at most ``BINS`` bins.

Learning uses a sample of the labelled rows bounded by ``max_rows`` (expected
size, chosen by a hash of the id); what reaches the driver has a fixed size.

Defined results
---------------
* null and empty texts have the statistics of a text without characters and are
  scored like any other.
* several labels of one id count with their mean; null labels do not count.
* without labels, or with one class only, every score is the mean label (0 with
  no label at all).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of

BINS = 512
_CLASS = np.zeros(256, np.int64)  # 0: other
for _i, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\r\n", b".,;:'\"()-?", bytes(range(128, 256))), 1):
    _CLASS[list(_chars)] = _i
STATISTICS = 21


def statistics(text: str | None) -> list[float]:
    """A fixed number of statistics of one whole text."""
    raw = (text or "").encode("utf-8", "replace")
    n = len(raw)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    classes = np.bincount(_CLASS, weights=counts, minlength=8) / max(1, n)
    p = counts[counts > 0] / max(1, n)
    words = raw.split()
    m = len(words)
    known = Counter(words)
    top = known.most_common(2)
    lines = raw.split(b"\n")
    return [
        np.log1p(n),
        np.log1p(m),
        *classes,
        float(-(p * np.log(p)).sum()),
        n / max(1, m),
        len(known) / max(1, m),
        len(known) / max(1.0, m**0.5),
        (top[0][1] if top else 0) / max(1, m),
        (top[1][1] if len(top) > 1 else 0) / max(1, m),
        len(set(lines)) / max(1, len(lines)),
        np.log1p(n / max(1, len(lines))),
        counts[ord("|")] / max(1, m),
        counts[ord("!")] / max(1, m),
        (counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum()) / max(1, m),
    ]


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    steps: np.ndarray  # raw score, probability
    fallback: float

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        waves = np.cos(z @ self.frequencies + self.phases) * np.sqrt(2 / self.frequencies.shape[1])
        return np.hstack([np.ones((len(z), 1)), z, waves])

    def score(self, stats: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(stats), self.fallback)
        raw = self.features(stats) @ self.weights
        if not len(self.steps):
            return np.clip(raw, 0, 1)
        return np.interp(raw, self.steps[:, 0], self.steps[:, 1])


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """(centre, fitted) of each block of the non-decreasing least-squares fit, by pooling adjacent violators; x ascending.

    Scores between two centres are read off the line between them, which keeps the order inside a block.
    """
    blocks: list[list[float]] = []  # mean, weight, weighted sum of x
    for xi, yi, wi in zip(x, y, w, strict=True):
        blocks.append([yi, wi, xi * wi])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b = blocks.pop()
            a = blocks[-1]
            blocks[-1] = [(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]]
    return np.array([(b[2] / b[1], b[0]) for b in blocks], dtype=float).reshape(-1, 2)


def _summed(rows: DataFrame, width: int, equations) -> np.ndarray:
    """Sum of the (k x width) matrices that ``equations`` makes of each partition, row by row in Spark."""

    def partial(batches):
        total = None
        for batch in batches:
            part = equations(batch)
            total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total), dtype=np.int32), "v": [r.tobytes() for r in total]})

    def add(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": part["i"].iloc[:1], "v": [sum(np.frombuffer(v) for v in part["v"]).tobytes()]})

    got = rows.mapInPandas(partial, "i int, v binary").groupBy("i").applyInPandas(add, "i int, v binary").orderBy("i").collect()
    return np.stack([np.frombuffer(r.v) for r in got]) if got else np.zeros((0, width))


def _stats(batch: pd.DataFrame) -> np.ndarray:
    return np.array([np.frombuffer(s) for s in batch["stats"]]).reshape(-1, STATISTICS)


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, waves: int = 192, width: float = 4.0, ridge: float = 1.0, seed: int = 7) -> QualityModel:
    """Learn from ``labels`` (doc_id, quality) of the documents that are not held out."""
    known = labels.where((fold_of(F.col("doc_id")) != 0) & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.avg("quality").alias("y"))
    total = known.count()
    if total > max_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(total)) < max_rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # about max_rows ids

    def measure(batches):
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "y": batch["y"], "stats": [np.asarray(statistics(t), float).tobytes() for t in batch["text"]]})

    id_type = docs.schema["doc_id"].dataType.simpleString()
    # The statistics of the sample (under 200 bytes a row) are read four times and the texts once.
    rows = sample.mapInPandas(measure, f"doc_id {id_type}, y double, stats binary").withColumn("fold", fold_of(F.col("doc_id"))).persist()
    try:
        moments = _summed(rows, STATISTICS + 1, lambda b: np.stack([np.r_[len(b), np.zeros(STATISTICS)], np.r_[b["y"].sum(), _stats(b).sum(axis=0)], np.r_[0, (_stats(b) ** 2).sum(axis=0)]]))
        if not len(moments):
            return _empty(0.0)
        n, mean, y_mean = moments[0, 0], moments[1, 1:] / moments[0, 0], moments[1, 0] / moments[0, 0]
        if y_mean in (0, 1):
            return _empty(float(y_mean))
        scale = np.sqrt(np.maximum(moments[2, 1:] / n - mean**2, 1e-9)) + 1e-6
        draw = np.random.default_rng(seed)
        model = QualityModel(mean, scale, draw.normal(size=(STATISTICS, waves)) / width, draw.uniform(0, 2 * np.pi, waves), np.zeros(0), np.zeros((0, 2)), float(y_mean))

        def equations(b):
            x = model.features(_stats(b))
            return np.hstack([x.T @ x, (x.T @ b["y"].to_numpy())[:, None]])

        size = 1 + STATISTICS + waves
        sums = _summed(rows.where("fold in (2, 3, 4)"), size + 1, equations)
        if not len(sums):
            return _empty(float(y_mean))
        penalty = ridge * np.eye(size)
        penalty[0, 0] = 1e-9
        model.weights = np.linalg.solve(sums[:, :-1] + penalty, sums[:, -1])

        def histogram(b):
            raw = np.clip(model.features(_stats(b)) @ model.weights, -0.5, 1.5)
            bins = np.minimum(((raw + 0.5) / 2 * BINS).astype(int), BINS - 1)
            return np.stack([np.bincount(bins, weights=w, minlength=BINS) for w in (np.ones(len(b)), b["y"].to_numpy(), raw)])

        seen = _summed(rows.where("fold = 1"), BINS, histogram)
        if len(seen) and (full := seen[0] > 0).any():
            model.steps = isotonic(seen[2, full] / seen[0, full], seen[1, full] / seen[0, full], seen[0, full])
        return model
    finally:
        rows.unpersist()


def _empty(mean: float) -> QualityModel:
    return QualityModel(*[np.zeros(0)] * 5, np.zeros((0, 2)), mean)


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """``docs`` with a column ``quality_score`` between 0 and 1; all other columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            stats = np.array([statistics(t) for t in batch], float).reshape(-1, STATISTICS)
            yield pd.Series(shared.value.score(stats))

    return docs.withColumn("quality_score", F.pandas_udf(scored, "double")(F.col("text")))
