"""Operator 13 against numpy's eigenvalues and plain integers."""

import numpy as np
import pytest

from fieldloom.llm import queries, whitening

SF = "/root/testdata/sf0.001"


def brute(rows, components=4):
    """{(vec_id, component): (n, deviation, |whitened|, explained)}; rows are (vec_id, vector)."""
    kept = [(i, [int(np.floor(256 * np.float64(c))) for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    m = np.array(fit, float)
    n, sums = len(fit), [sum(x[k] for x in fit) for k in range(m.shape[1])]
    z = m - np.array(sums) / n
    e, v = np.linalg.eigh(z.T @ z / n)
    e, v = e[::-1][:components], v[:, ::-1][:, :components]
    out = []
    for i, x in kept:
        w = np.abs((np.array(x) - np.array(sums) / n) @ v / np.sqrt(e))
        out += [(i, k + 1, n, sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)), w[k], e[k] / np.trace(z.T @ z / n)) for k in range(len(e))]
    return sorted(out)


def check(got, want):
    got = sorted((r["vec_id"], r["component"], r["n"], r["deviation"], abs(r["whitened"]), r["explained"]) for r in got)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose([g[4:] for g in got], [w[4:] for w in want], rtol=1e-6, atol=1e-6)


def test_query(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = queries.QUERIES["op13_whitening"](spark, SF).collect()
    check(got, brute([(r["vec_id"], r["embedding"]) for r in table.collect()]))
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-8


def test_nulls_copies_and_clashing_columns(spark):
    random = np.random.default_rng(3)
    rows = [(i, [float(c) for c in random.normal(size=6) * [5, 3, 2, 1, 0.5, 0.1]]) for i in range(60)]
    rows += [(100 + i, rows[0][1]) for i in range(50)] + [(7, rows[7][1]), (200, None), (201, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (202, [float("nan")] + [0.0] * 5), (203, [float("inf")] + [0.0] * 5)]
    df = spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], "vec_id long, embedding array<float>, x string, n int, component int").repartition(5)
    vectors = whitening.quantised(df)
    got = whitening.whiten(vectors, whitening.fit(vectors)).collect()
    check(got, brute([(r["vec_id"], r["embedding"]) for r in df.collect()]))
    assert len({r["whitened"] for r in got if r["component"] == 1 and (r["vec_id"] == 0 or 100 <= r["vec_id"] < 150)}) == 1


def test_nothing_to_divide_by(spark):
    for rows in ([], [(1, [1.0, 2.0])], [(1, [])], [(1, [1.0, 1.0]), (2, [1.0, 1.0])]):
        vectors = whitening.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
        assert whitening.whiten(vectors, whitening.fit(vectors)).count() == 0
    # Rank one: a single component.  Two lengths: each has its own fit.
    vectors = whitening.quantised(spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 4.0]), (None, [4.0, 8.0]), (4, [1.0]), (5, [3.0])], "vec_id long, embedding array<double>"))
    got = whitening.whiten(vectors, whitening.fit(vectors)).collect()
    assert sorted((r["vec_id"] or 0, r["component"], r["n"]) for r in got) == [(0, 1, 3), (1, 1, 3), (2, 1, 3), (4, 1, 2), (5, 1, 2)]
    assert all(r["explained"] == pytest.approx(1) for r in got)


def test_large_numbers_are_exact(spark):
    rows = [(i, [float(i * 10**4), float(-i)]) for i in range(40)]
    vectors = whitening.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    check(whitening.whiten(vectors, whitening.fit(vectors, 1)).collect(), brute(rows, 1))


@pytest.mark.parametrize("values", [[9, 4, 1, 0.25], [5, 5, 5, 1, 1], [1e12, 1, 1e-6], [3, 2.9999999, 1], [0, 0, 7], [1e3] * 3])
def test_eigenpairs(values):
    random = np.random.default_rng(len(values))
    q, _ = np.linalg.qr(random.normal(size=(len(values),) * 2))
    a = q @ np.diag(values) @ q.T
    e, v = whitening.eigenpairs(a)
    size = max(values)
    assert np.allclose(e, sorted(values, reverse=True), atol=1e-12 * size)
    assert np.allclose(v.T @ v, np.eye(len(values)), atol=1e-12)
    assert np.allclose(v * e @ v.T, a, atol=1e-12 * size)


def test_eigenpairs_of_a_larger_matrix():
    random = np.random.default_rng(5)
    m = random.normal(size=(300, 96)) * np.linspace(3, 0.1, 96)
    a = m.T @ m / 300
    e, v = whitening.eigenpairs(a, 4)
    want, axes = np.linalg.eigh(a)
    assert np.allclose(e, want[::-1][:4], rtol=1e-12)
    assert np.allclose(np.abs((v * axes[:, ::-1][:, :4]).sum(axis=0)), 1, atol=1e-10)
