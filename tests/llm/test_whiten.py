"""Whitening against exact integer sums and an eigendecomposition of the whole covariance."""

import math
from fractions import Fraction

import numpy as np
import pytest

from vellumine.llm import queries, whiten

FOLDER = "/root/testdata/sf0.01"


def integer(vector):
    if vector is None or any(c is None or not math.isfinite(c) for c in vector):
        return None
    return tuple(math.floor(256 * float(c)) for c in vector)


def slow(rows, k=4):
    sound = [(i, integer(v)) for i, v in rows]
    sound = [(i, x) for i, x in sound if x is not None]
    fit = sorted(set(x for _, x in sound))
    n, d = len(fit), len(fit[0])
    sums = [sum(x[j] for x in fit) for j in range(d)]
    centred = {x: np.array([float(Fraction(n * a - s, n)) for a, s in zip(x, sums)]) for x in fit}
    m = np.array([centred[x] for x in fit])
    values, axes = np.linalg.eigh(m.T @ m / n)
    values, axes = values[::-1], axes[:, ::-1]
    out = []
    for i, x in sound:
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        for c in range(min(k, d)):
            out.append((i, c + 1, n, deviation, float(centred[x] @ axes[:, c]) / math.sqrt(values[c]), values[c] / values.sum()))
    return out


def compare(found, wanted, rel=1e-6):
    key = lambda r: (r[1], r[0], r[3])
    found, wanted = sorted(map(tuple, found), key=key), sorted(wanted, key=key)
    assert [r[:4] for r in found] == [r[:4] for r in wanted]
    for c in {r[1] for r in wanted}:
        mine, theirs = (np.array([r[4] for r in rows if r[1] == c]) for rows in (found, wanted))
        sign = np.sign(mine @ theirs)
        assert np.allclose(mine * sign, theirs, rtol=rel, atol=rel)
    assert np.allclose([r[5] for r in found], [r[5] for r in wanted], rtol=1e-4)
    assert max((r[6] for r in found), default=0) <= 1e-4


def test_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    found = queries.op12_whiten(spark, FOLDER)
    assert dict(found.dtypes)["deviation"] == "bigint"
    compare(found.collect(), slow(rows))


def test_small_eigenvalues_and_repeats(spark):
    """Directions seven powers of ten apart, large means, and a vector that most rows repeat."""
    rng = np.random.default_rng(5)
    turned = np.linalg.qr(rng.normal(size=(6, 6)))[0]
    made = rng.normal(size=(300, 6)) * [1e4, 1e2, 1, 1e-1, 2e-3, 2e-3] @ turned + 4e3
    rows = [(i, v.tolist()) for i, v in enumerate(made)] + [(1000 + i, made[0].tolist()) for i in range(500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    compare([(*r[:3], int(r[3]), *r[4:]) for r in whiten.whiten(df).collect()], slow(rows), 1e-5)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 0.0]), (None, [0.5, -0.0]), (5, [0.5, 0.0]), (5, [-0.25, 1.0]), (6, [0.1, 0.7]), (7, [0.3])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, whitened string")
    found = whiten.whiten(df).collect()
    padded = [(i if i is not None else -1, [*v, 0.0][:2] if v else v) for i, v in rows]
    compare([(-1 if r[0] is None else r[0], *r[1:3], int(r[3]), *r[4:]) for r in found], slow(padded))


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])]])
def test_nothing_to_fit(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert whiten.whiten(df).collect() == []


def test_without_variance(spark):
    one = whiten.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")).collect()
    assert [(r["component"], r["n"], r["whitened"], r["explained"]) for r in one] == [(1, 1, 0.0, 0.0), (2, 1, 0.0, 0.0)] * 2
    line = [(i, [float(i), 2.0 * i, 3.0 * i]) for i in range(10)]
    found = whiten.whiten(spark.createDataFrame(line, "vec_id long, embedding array<double>")).collect()
    assert {(r["component"], round(r["explained"], 9)) for r in found} == {(1, 1.0), (2, 0.0), (3, 0.0)}
    assert all(r["identity_error"] < 1e-9 for r in found)


def test_exact_deviations():
    """Beyond 64 bits too."""
    x = np.array([[2**50, -(2**50)], [3, 5]], np.int64)
    n, sums = 10**9, [7 * 10**9 + 3, -5]
    assert whiten.deviations(x, n, sums) == [sum((n * a - s) ** 2 for a, s in zip(r, sums)) for r in x.tolist()]
