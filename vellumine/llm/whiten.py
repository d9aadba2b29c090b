"""Embedding whitening by shifted CholeskyQR.

Entries become integers ``floor(scale * c)``; the fit list is each distinct vector once, written as compact bytes to the shared
folder. Its size and sums are exact integers, so rows are centred without cancellation.

Factorisation: a Gram pass sums the outer products of the rows, every task its own part and then Spark entry by entry; the
Gram matrix, shifted so that rounding can't make it indefinite, has a Cholesky factor R. The next pass solves each centred row
through the triangular product of all factors so far and sums again, until these rows are orthonormal. The composed factor then
has the singular values and right vectors of all centred rows: the covariance itself, whose small eigenvalues a plain Gram
matrix would lose, is never decomposed. The driver holds matrices of the dimension's square only.

A last pass measures the covariance of the whitened fit list against the identity.

Defined cases: rows whose vector is null or holds a null, infinite or NaN entry are left out. Entries beyond 2 ** 52 times
1 / ``scale`` count as that bound. Vectors shorter than the longest one count as padded with zeros. Null or repeated ids are rows like
others. A component without variance (all fit vectors equal, or fewer directions than components) has whitened 0 and explained 0
and isn't compared with the identity. No rows, or vectors without entries: an empty result. Reruns agree up to rounding.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumine.llm.common import map_arrow, sliced
from vellumine.session import shared_folder

BOUND = float(2**52)
#: Gram passes at most; each divides what is not yet orthonormal by many powers of ten.
PASSES = 8
DECIMAL = pa.decimal128(38, 0)


class Fit(NamedTuple):
    """Rows of the fit list, exact sums, and the components: a column each, with eigenvalues and their share of the trace."""

    n: int
    sums: list[int]
    axes: np.ndarray
    values: np.ndarray
    shares: np.ndarray
    identity_error: float


def integers(vectors: pa.Array, scale: float) -> Iterator[tuple[int, np.ndarray]]:
    """(place, integer vector) of each sound row."""
    offsets = vectors.offsets.to_numpy()
    entries = vectors.values.to_numpy(zero_copy_only=False)  # nulls become NaN
    broken = np.r_[0, np.cumsum(~np.isfinite(entries))]
    sound = (broken[offsets[1:]] == broken[offsets[:-1]]) & ~vectors.is_null().to_numpy(zero_copy_only=False)
    with np.errstate(invalid="ignore", over="ignore"):
        whole = np.nan_to_num(np.clip(np.floor(entries * scale), -BOUND, BOUND), nan=0.0).astype(np.int64)
    for i in np.flatnonzero(sound).tolist():
        yield i, whole[offsets[i] : offsets[i + 1]]


def packed(x: np.ndarray) -> bytes:
    """Bytes that equal vectors share, whatever zeros they end with: the width of an entry, and the entries."""
    used = np.flatnonzero(x)
    x = x[: used[-1] + 1 if len(used) else 0]
    most = int(np.abs(x).max(initial=0))
    width = next(w for w in (1, 2, 4, 8) if most < 2 ** (8 * w - 1))
    return bytes([width]) + x.astype(f"<i{width}").tobytes()


def unpacked(codes: list[bytes], d: int) -> np.ndarray:
    out = np.zeros((len(codes), d), np.int64)
    for row, code in zip(out, codes):
        x = np.frombuffer(code, f"<i{code[0]}", offset=1)
        row[: len(x)] = x
    return out


def codes(rows: DataFrame, scale: float) -> DataFrame:
    """``code`` and ``width`` (entries) of each sound vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(packed(x), len(x)) for _, x in integers(batch.column("vector"), scale)]
            arrays = [pa.array([c for c, _ in found], pa.binary()), pa.array([w for _, w in found], pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, names=["code", "width"])

    return map_arrow(rows.select("vector"), run, "code binary, width int")


def summed(fit: DataFrame, d: int, size: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over the fit list of ``part`` (block of integer rows to ``size`` doubles): tasks first, then entry by entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            total += part(unpacked(batch.column("code").to_pylist(), d))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["i", "v"])

    out = np.zeros(size)
    for r in map_arrow(fit.select("code"), run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r["i"]] = r["v"]
    return out


def exact_sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * d
        for batch in batches:
            for block in sliced(iter([batch]), 512):  # 512 entries of 2 ** 52 fit in 64 bits
                x = unpacked(block.column("code").to_pylist(), d)
                n += len(x)
                total = [a + b for a, b in zip(total, x.sum(0).tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(range(d + 1), pa.int32()), pa.array(map(Decimal, [*total, n]), DECIMAL)], names=["i", "v"])

    rows = map_arrow(fit.select("code"), run, "i int, v decimal(38,0)").groupBy("i").agg(F.sum("v").alias("v")).collect()
    found = {r["i"]: int(r["v"]) for r in rows}
    return found.get(d, 0), [found.get(i, 0) for i in range(d)]


def centre(n: int, sums: list[int]) -> Callable[[np.ndarray], np.ndarray]:
    """Rows minus their mean: its whole part in integers, the rest in doubles."""
    floors = np.array([s // n for s in sums], np.int64)
    rest = np.array([float(Fraction(s % n, n)) for s in sums])
    return lambda x: (x - floors).astype(np.float64) - rest


def solve(rows: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Q with Q @ upper = rows, column after column."""
    out = np.empty_like(rows)
    for j in range(rows.shape[1]):
        out[:, j] = (rows[:, j] - out[:, :j] @ upper[:j, j]) / upper[j, j]
    return out


def learn(fit: DataFrame, d: int, components: int) -> Fit | None:
    """Components of the distinct integer vectors ``code``; None if there are none."""
    n, sums = exact_sums(fit, d)
    if not n or not d:
        return None
    centred, unit = centre(n, sums), np.finfo(float).eps
    factor, gram = np.eye(d), np.zeros((d, d))
    for number in range(PASSES):
        upper = factor.copy()

        def part(x: np.ndarray) -> np.ndarray:
            q = solve(centred(x), upper) if number else centred(x)
            return (q.T @ q).ravel()

        gram = summed(fit, d, d * d, part).reshape(d, d)
        gram = (gram + gram.T) / 2
        near = np.linalg.eigvalsh(gram)
        if number and np.minimum(np.abs(near), np.abs(near - 1)).max() < 1e3 * d * unit:
            break
        if not near[-1] > 0:
            break
        shift = min(11 * d * (n + d + 1) * unit / 2, 1e-4) * near[-1]
        factor = np.linalg.cholesky(gram + shift * np.eye(d)).T @ factor
    values, turned = np.linalg.eigh(gram)  # what the last pass has left beside the identity
    last = np.sqrt(np.maximum(values, 0))[:, None] * turned.T
    _, lengths, axes = np.linalg.svd(last @ factor)
    signs = np.sign(axes[np.arange(d), np.abs(axes).argmax(1)])
    k = min(components, d)
    axes, found = (axes * signs[:, None])[:k].T, lengths[:k]
    flat = found <= 8 * d * unit * lengths[0]
    values = np.where(flat, 0.0, found**2 / n)
    trace = float((lengths**2).sum()) / n
    model = Fit(n, sums, axes, values, values / trace if trace else values, 0.0)
    white = whitened(model)

    def moments(x: np.ndarray) -> np.ndarray:
        z = white(centred(x))
        return np.r_[z.sum(0), (z.T @ z).ravel()]

    found = summed(fit, d, k + k * k, moments) / n
    covariance = found[k:].reshape(k, k) - np.outer(found[:k], found[:k])
    live = ~flat
    error = np.abs(covariance - np.eye(k))[np.ix_(live, live)].max(initial=0.0)
    return model._replace(identity_error=float(error))


def whitened(model: Fit) -> Callable[[np.ndarray], np.ndarray]:
    scale = np.where(model.values > 0, 1 / np.sqrt(np.where(model.values > 0, model.values, 1)), 0.0)
    axes = model.axes * scale
    return lambda rows: rows @ axes


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Exact sums over the dimensions of (n * x - S) ** 2."""
    floors, rest = np.array([s // n for s in sums], np.int64), [s % n for s in sums]
    y = x - floors
    most = int(np.abs(y).max(initial=0))
    wide = max(most * most, most * n) * len(sums) >= 2**63
    if wide:
        y = y.astype(object)
    squares, mixed = (y * y).sum(1).tolist(), (y * np.array(rest, object if wide else np.int64)).sum(1).tolist()
    fixed = sum(r * r for r in rest)
    return [n * n * a - 2 * n * b + fixed for a, b in zip(squares, mixed)]


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 4, scale: float = 256.0) -> DataFrame:
    """A row per sound vector and component: ``key``, component, n, deviation (decimal(38,0), exact), whitened, explained,
    identity_error."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"{key} {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    folder = shared_folder(spark, "whitening")
    codes(rows, scale).groupBy("code").agg(F.max("width").alias("width")).write.parquet(folder)
    fit = spark.read.schema("code binary, width int").parquet(folder)
    d = fit.agg(F.max("width")).first()[0] or 0
    model = learn(fit, d, components)
    if model is None:
        return spark.createDataFrame([], schema)
    n, sums = model.n, model.sums
    k, centred, white = len(model.values), centre(n, sums), whitened(model)
    shares, error = model.shares, model.identity_error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(integers(batch.column("vector"), scale))
            x = np.zeros((len(found), d), np.int64)
            for row, (_, v) in zip(x, found):
                row[: len(v)] = v
            keys = batch.column("key").take(pa.array(np.repeat([i for i, _ in found], k).astype(np.int64)))
            dev = pa.array([Decimal(v) for v in deviations(x, n, sums) for _ in range(k)], DECIMAL)
            m = len(found)
            arrays = [
                keys, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)), dev,
                pa.array(white(centred(x)).ravel()), pa.array(np.tile(shares, m)), pa.array(np.full(m * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return map_arrow(rows, run, schema)
