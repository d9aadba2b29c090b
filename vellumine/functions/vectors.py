"""Vector algebra on array columns, accumulated in double."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumine.functions.text import let


def _fold(pairs: Column) -> Column:
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _fold(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_fold(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance (not squared)."""
    step = lambda x, y: x.cast("double") - y.cast("double")
    return F.sqrt(_fold(F.transform(F.zip_with(a, b, step), lambda d: d * d)))


def cosine(a: Column, b: Column) -> Column:
    base = norm(a) * norm(b)
    return F.when(base > 0, dot(a, b) / base).otherwise(0.0)


def normalize(a: Column) -> Column:
    def scale(v: Column) -> Column:
        return let(
            norm(v),
            lambda size: F.transform(v, lambda x: F.when(size > 0, x.cast("double") / size).otherwise(x.cast("double"))),
        )

    return let(a, scale)


def similarity_from_distance(distance: Column, metric: str) -> Column:
    """Similarity in [0, 1]; ``cosine`` expects the true distance of unit vectors."""
    raw = {
        "cosine": 1 - distance * distance / 2,
        "euclidean": F.exp(-(distance * distance) / 2),
        "dot": distance,
    }[metric]
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


def hashed_vector(words: Column, dim: int = 64) -> Column:
    """Deterministic stand-in embedding: md5-bucketed word counts, L2-normalised.

    Built-in functions only: no model, no Python worker.
    """
    bucket = lambda w: (
        F.conv(F.substring(F.md5(w.cast("binary")), 1, 8), 16, 10).cast("bigint") % dim
    ).cast("int")
    count = lambda bs: F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(bs, lambda b: b == i)).cast("double")
    )
    return normalize(let(F.transform(words, bucket), count))


DIM = 64


#: Texts whose words a worker holds as objects, and words that it knows before it starts anew.
SLICE_TEXTS, KNOWN_WORDS = 64, 1 << 16


class _Buckets(dict):
    """Bucket of each word, digested when first asked for. A full dictionary becomes the older one, so that words that return stay."""

    def __init__(self):
        self.older: dict[str, int] = {}

    def __missing__(self, word: str) -> int:
        if len(self) >= KNOWN_WORDS:
            self.older = dict(self)
            self.clear()
        found = self.older.get(word)
        if found is None:
            found = int.from_bytes(hashlib.md5(word.encode()).digest()[:4], "big") % DIM
        self[word] = found
        return found


def lower_words(text: str | None) -> list[str]:
    """Words of a text, each letter lower-cased by itself as in SQL: Python alone makes two characters of the dotted I and looks
    around a sigma."""
    return (text or "").replace("İ", "i").replace("Σ", "σ").lower().split()


@F.arrow_udf(T.DoubleType())
def fused_dot(a: pa.Array, b: pa.Array) -> pa.Array:
    """Inner product added entry after entry, products unrounded, as DuckDB adds it: equal to the last digit, for few rows whose
    scores meet a threshold. Null where a side is null."""

    def add(x: list | None, y: list | None) -> float | None:
        if x is None or y is None:
            return None
        total = 0.0
        for u, v in zip(x, y):
            total = math.fma(u, v, total)
        return total

    return pa.array([add(x.as_py(), y.as_py()) for x, y in zip(a, b)], pa.float64())


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def hashed_text_vector(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """``hashed_vector`` of the lower-cased words of a text, for whole tables.

    A worker digests each distinct word about once; a text is one histogram over buckets. Memory holds one
    Arrow batch, the words of one slice and a bounded dictionary, whatever the table and its vocabulary.
    """
    known = _Buckets()
    for batch in batches:
        out = np.zeros((len(batch), DIM))
        for start in range(0, len(batch), SLICE_TEXTS):
            words = [lower_words(text) for text in batch.slice(start, SLICE_TEXTS).to_pylist()]
            sizes = list(map(len, words))
            buckets = np.fromiter(map(known.__getitem__, chain.from_iterable(words)), np.int64, sum(sizes))
            cells = np.repeat(np.arange(len(words)) * DIM, sizes) + buckets
            out[start : start + len(words)] = np.bincount(cells, minlength=len(words) * DIM).reshape(-1, DIM)
        size = np.linalg.norm(out, axis=1, keepdims=True)
        np.divide(out, size, out=out, where=size > 0)
        yield pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, DIM), pa.int32()), pa.array(out.reshape(-1)))
