"""Whitening of embeddings by principal components from a spectral divide-and-conquer.

Vectors are quantised to integers ``floor(256 * c)``.  Each distinct vector counts once: its sums are exact, its
covariance is centred before multiplying and summed by partitions up a tree, so the driver sees one matrix of
dimension x dimension and no vector.  The eigenvectors come from polar decompositions: the QDWH iteration gives the
polar factor U of the shifted covariance, (U + I) / 2 projects on the eigenvalues above the shift, an orthonormal
basis of its range and its complement splits the matrix in two, and so on until single components are left.  The
fitted model has a fixed size (``dimension * components`` doubles, dimension at most ``MOST_DIMENSIONS``) and travels
with the tasks that whiten all rows.

Defined results
---------------
* rows whose vector is null or holds a null or non-finite entry are dropped; rows with a null ``vec_id`` stay.
* vectors of different lengths are whitened apart, each with the fit of its own length (at most ``MOST_LENGTHS``);
  vectors without entries have no components and give no row.
* repeated rows and copies of a vector each get their rows; they count once in the fit.
* components with an eigenvalue of zero (to rounding) give no row, as nothing can be divided by it: a single distinct
  vector gives none at all, and an empty table none.
* components of equal eigenvalues are some orthonormal basis of their space; either sign may come out.
* ``deviation`` is exact while it fits a long and is held at the long's limit beyond.
* other columns are never read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint_folder, remove

SCALE, MOST_DIMENSIONS, MOST_LENGTHS, FAN = 256, 4096, 64, 16
EPS = float(np.finfo(float).eps)


# -- spectral divide and conquer ---------------------------------------------------------------------------------


def polar_factor(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a square matrix by the QR-based dynamically weighted Halley iteration."""
    d = len(a)
    x = a / max(np.sqrt(np.linalg.norm(a, 1) * np.linalg.norm(a, np.inf)), np.finfo(float).tiny)
    try:
        low = 1 / (np.linalg.norm(np.linalg.inv(x), 1) * np.sqrt(d))
    except np.linalg.LinAlgError:
        low = 0.0
    low = min(max(low if np.isfinite(low) else 0.0, EPS), 1.0)
    eye = np.eye(d)
    for _ in range(30):
        root = np.cbrt(4 * (1 - low**2) / low**4)
        wa = np.sqrt(1 + root) + 0.5 * np.sqrt(8 - 4 * root + 8 * (2 - low**2) / (low**2 * np.sqrt(1 + root)))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        before = x
        if wc > 100:
            q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, eye]))
            x = (wb / wc) * x + (wa - wb / wc) / np.sqrt(wc) * (q[:d] @ q[d:].T)
        else:
            x = (wb / wc) * x + (wa - wb / wc) * np.linalg.solve(eye + wc * (x.T @ x), x.T).T
        low = min(low * (wa + wb * low**2) / (1 + wc * low**2), 1.0)
        if abs(1 - low) < 10 * EPS and np.linalg.norm(x - before) <= (5 * EPS) ** (1 / 3):
            break
    return x


def _divided(a: np.ndarray, shift: float, size: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the spaces of ``a`` above and below ``shift``; None where the shift does not divide it."""
    d = len(a)
    u = polar_factor(a - shift * np.eye(d))
    projector = ((u + u.T) / 2 + np.eye(d)) / 2
    rank = round(float(np.trace(projector)))
    if not 0 < rank < d:
        return None
    start = projector @ np.random.default_rng(d).standard_normal((d, rank))
    for _ in range(3):
        q, _ = np.linalg.qr(start, mode="complete")
        above, below = q[:, :rank], q[:, rank:]
        if np.linalg.norm(below.T @ a @ above) <= 100 * d * EPS * size:
            return above, below
        start = projector @ above
    return None


def eigenpairs(a: np.ndarray, wanted: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns."""
    a = (a + a.T) / 2
    wanted, size = min(wanted or len(a), len(a)), float(np.linalg.norm(a))
    values: list[float] = []
    vectors: list[np.ndarray] = []
    # Invariant subspaces still to be split, the uppermost last.
    open_spaces = [(a, np.eye(len(a)))] if len(a) else []
    while open_spaces and len(values) < wanted:
        block, basis = open_spaces.pop()
        d = len(block)
        mean = float(np.trace(block)) / d
        if d == 1 or np.linalg.norm(block - mean * np.eye(d)) <= 4 * d * EPS * size:
            values += [float(v) for v in np.diag(block)]
            vectors += list(basis.T)
            continue
        diagonal = np.sort(np.diag(block))
        # The mean of the eigenvalues always lies between two of them; the median halves the work where it does.
        shifts = [float(np.median(diagonal)), mean, *(mean + t * (diagonal[-1] - diagonal[0]) for t in (1e-3, -1e-3, 0.05, -0.05))]
        parts = next((p for p in (_divided(block, s, size) for s in shifts) if p), None)
        if parts is None:  # eigenvalues that rounding does not tell apart
            values += [float(v) for v in np.diag(block)]
            vectors += list(basis.T)
            continue
        for part in reversed(parts):
            inner = part.T @ block @ part
            open_spaces.append(((inner + inner.T) / 2, basis @ part))
    order = np.argsort([-v for v in values], kind="stable")[:wanted]
    return np.array(values)[order], np.array(vectors).reshape(-1, len(a))[order].T


# -- the fit ------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    """The fit of vectors of one length: n distinct ones, their exact sums, and per component eigenvalue and vector."""

    n: int
    sums: np.ndarray  # exact: int64, or Python integers where they need more
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exactly."""
        most = self.n * max(1, _most(x)) + _most(self.sums)
        if most < 2**62:
            return self.n * x - self.sums.astype(np.int64)
        return self.n * x.astype(object) - self.sums.astype(object)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (self.centred(x).astype(float) / self.n) @ self.vectors / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> np.ndarray:
        c = self.centred(x)
        if c.dtype != object and float(_most(c)) ** 2 * max(1, x.shape[1]) < 2**62:
            return (c * c).sum(axis=1)
        return np.array([min(sum(int(v) ** 2 for v in row), 2**63 - 1) for row in c], np.int64)


def _most(x: np.ndarray) -> int:
    return max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0


def quantised(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, x array<long>) of the rows that take part."""
    v = F.col(vector)
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return rows.where(v.isNotNull() & fine).select("vec_id", F.transform(v, lambda c: F.floor(F.lit(SCALE) * c.cast("double")).cast("long")).alias("x"))


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in the batch, matrix) for each length of vectors."""
    x = batch.column(batch.schema.get_field_index("x"))
    lengths = np.asarray(pc.list_value_length(x))
    for d in np.unique(lengths):
        places = np.flatnonzero(lengths == d)
        if d:
            yield places, np.asarray(x.take(pa.array(places)).flatten()).reshape(len(places), d)


def _sums(fit: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """{length: (number, exact sums)} of the distinct vectors."""

    def partial(batches):
        held: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for _, m in _matrices(batch):
                n, s = held.get(m.shape[1], (0, np.zeros(m.shape[1], object)))
                exact = m.sum(axis=0) if _most(m) * len(m) < 2**62 else m.astype(object).sum(axis=0)
                held[m.shape[1]] = (n + len(m), s + exact.astype(object))
        rows = [(d, n, i, str(v)) for d, (n, s) in held.items() for i, v in enumerate(s)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.int32(), pa.string()))], ["dim", "n", "place", "part"]
        )

    added = fit.mapInArrow(partial, "dim int, n long, place int, part string").groupBy("dim", "place").agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))
    found: dict[int, tuple[int, dict[int, int]]] = {}
    for r in added.collect():  # as many rows as entries of a vector, for each length
        found.setdefault(r["dim"], (r["n"], {}))[1][r["place"]] = int(r["total"])
    fits = lambda s: all(abs(v) < 2**62 for v in s)
    ordered = {d: (n, [s[i] for i in range(d)]) for d, (n, s) in found.items()}
    return {d: (n, np.array(s, np.int64 if fits(s) else object)) for d, (n, s) in ordered.items()}


MOMENTS = "dim int, node int, n long, mean binary, m2 binary"


def _merged(rows) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, mean and centred sums of products of the union of parts."""
    n, mean, m2 = 0, 0.0, 0.0
    for k, m, p in rows:
        delta, total = m - mean, n + k
        m2 = m2 + p + np.outer(delta, delta) * (n * k / total)
        mean, n = mean + delta * (k / total), total
    return n, mean, m2


def _moments(fit: DataFrame, image: Callable[[int, np.ndarray], np.ndarray | None]) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """{length: (n, mean, centred sums of products)} of ``image`` of all vectors: by partition, then up a tree."""

    def table(rows) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 5
        types = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["dim", "node", "n", "mean", "m2"])

    def partial(batches):
        from pyspark import TaskContext

        node = TaskContext.get().partitionId() // FAN
        held: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for _, x in _matrices(batch):
                z = image(x.shape[1], x)
                if z is None or not z.shape[1]:
                    continue
                mean = z.mean(axis=0)
                own = (len(z), mean, (z - mean).T @ (z - mean))
                held[x.shape[1]] = _merged([held[x.shape[1]], own]) if x.shape[1] in held else own
        yield table([(d, node, n, np.ascontiguousarray(m).tobytes(), np.ascontiguousarray(p).tobytes()) for d, (n, m, p) in held.items()])

    def unpacked(n, m, p):
        m = np.frombuffer(m)
        return n, m, np.frombuffer(p).reshape(len(m), len(m))

    def merge(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        n, m, p = _merged(unpacked(r["n"], r["mean"], r["m2"]) for r in rows)
        return pa.Table.from_batches([table([(rows[0]["dim"], rows[0]["node"] // FAN, n, m.tobytes(), np.ascontiguousarray(p).tobytes())])])

    parts = fit.mapInArrow(partial, MOMENTS)
    left = -(-fit.rdd.getNumPartitions() // FAN)
    while True:
        parts = parts.groupBy("dim", "node").applyInArrow(merge, MOMENTS)
        if left <= 1:
            break
        left = -(-left // FAN)
    return {r["dim"]: unpacked(r["n"], bytes(r["mean"]), bytes(r["m2"])) for r in parts.collect()}  # one row a length


def fit(vectors: DataFrame, components: int = 4) -> dict[int, Model]:
    """{length: model} from the distinct ``x`` of ``vectors`` (an output of :func:`quantised`)."""
    spark = vectors.sparkSession
    folder = f"{checkpoint_folder(spark)}/whitening-{uuid.uuid4().hex}"
    vectors.select("x").distinct().write.parquet(folder)
    distinct = spark.read.parquet(folder)
    try:
        sums = _sums(distinct)
        if len(sums) > MOST_LENGTHS or max(sums, default=0) > MOST_DIMENSIONS:
            raise ValueError(f"vectors of {len(sums)} lengths up to {max(sums)}: at most {MOST_LENGTHS} lengths up to {MOST_DIMENSIONS} are fitted")
        nothing = np.zeros(0)
        empty = {d: Model(n, s, nothing, np.zeros((d, 0)), 0.0) for d, (n, s) in sums.items()}
        models = {}
        for d, (n, _, m2) in _moments(distinct, lambda d, x: empty[d].centred(x).astype(float) / empty[d].n).items():
            covariance = m2 / n
            values, axes = eigenpairs(covariance, components)
            real = values > 8 * d * EPS * max(float(values[0]), 0.0)
            models[d] = Model(n, sums[d][1], values[real], axes[:, real], float(np.trace(covariance)))
        for d, (n, _, m2) in _moments(distinct, lambda d, x: models[d].whitened(x) if d in models else None).items():
            m = models[d]
            models[d] = Model(m.n, m.sums, m.values, m.vectors, m.trace, float(np.abs(m2 / n - np.eye(len(m.values))).max()))
        return models
    finally:
        remove(spark, folder)


def whiten(vectors: DataFrame, models: dict[int, Model]) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every row and component."""
    id_type = vectors.schema["vec_id"].dataType.simpleString()

    def rows(batches):
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("vec_id"))
            for places, x in _matrices(batch):
                m = models.get(x.shape[1])
                k = len(m.values) if m else 0
                if not k:
                    continue
                times = len(x)
                again = lambda v, t: pa.array(np.repeat(v, k), t)
                every = lambda v, t: pa.array(np.tile(v, times), t)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(np.repeat(places, k))), every(np.arange(1, k + 1), pa.int32()), pa.array(np.full(times * k, m.n), pa.int64()), again(m.deviation(x), pa.int64()),
                        pa.array(m.whitened(x).reshape(-1), pa.float64()), every(m.values / m.trace, pa.float64()), pa.array(np.full(times * k, m.identity_error), pa.float64()),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    schema = f"vec_id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return vectors.select("vec_id", "x").mapInArrow(rows, schema)
