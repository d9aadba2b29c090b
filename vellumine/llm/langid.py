"""Language identification by error-correcting output codes.

Every language is a codeword of bits; each bit has a binary logistic classifier over byte n-gram frequencies that says on
which side of the bit a text's language lies. A text gets the language whose codeword has the least logistic loss, summed
over the bits: a few wrong bits are corrected. The score is the soft minimum over the codewords' losses, and a text is
``ambiguous`` if the runner-up's loss is within ``margin`` of the least.

Codewords: all two-sided splits of the languages while there are at most 5, else a fixed pseudo-random code of
``15 ceil(log2 languages)`` bits.

Features: lower-cased text, bytes 1-, 2- and 3-grams hashed to ``FEATURES`` counts, square roots of their shares. Whole
texts are read. Training takes about ``sample`` labelled rows of each language (by hash of the id), each in whole.

Defined cases: a null text or one without a letter is ``und`` with score 0, not ambiguous; without a labelled row every
text is ``und``; with one language every other text is of it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine.llm.common import hash_sample, map_arrow, sliced, texts_of

FEATURES = 1 << 12
SAMPLE = 400
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
#: Bytes whose n-grams are counted at once.
SPAN = 1 << 20


class Model(NamedTuple):
    languages: list[str]
    code: np.ndarray  # languages x bits, -1 or 1
    weights: np.ndarray  # features x bits
    bias: np.ndarray


def codewords(n: int, seed: int = 7) -> np.ndarray:
    if n <= 5:
        splits = [[1 if m >> i & 1 else -1 for i in range(n)] for m in range(1, 2 ** max(0, n - 1))]
        return np.array(splits, float).reshape(len(splits), n).T
    rng = np.random.default_rng(seed)
    bits = 15 * math.ceil(math.log2(n))
    return np.where(rng.permuted(np.tile(np.arange(n), (bits, 1)), axis=1) < n // 2, 1.0, -1.0).T


def profile(text: str) -> np.ndarray:
    """Square roots of the shares of hashed n-grams."""
    data = np.frombuffer(text.lower().encode("utf-8"), np.uint8)
    counts = np.zeros(FEATURES, np.float64)
    for start in range(0, len(data), SPAN):
        part = data[max(0, start - 2) : start + SPAN].astype(np.uint32)
        skip = min(start, 2)
        gram = part * np.uint32(0x01000193)
        for size in (1, 2, 3):
            if size > 1:
                gram = (gram[:-1] ^ part[size - 1 :]) * np.uint32(0x9E3779B1)
            new = gram[max(0, skip - size + 1) :]
            counts += np.bincount((new ^ np.uint32(size * 0x5BD1)) >> np.uint32(7) & np.uint32(FEATURES - 1), minlength=FEATURES)
    total = counts.sum()
    return np.sqrt(counts / total).astype(np.float32) if total else counts.astype(np.float32)


def fit(x: np.ndarray, languages: list[str], rounds: int = 300, rate: float = 8.0, decay: float = 1e-4) -> Model:
    """One logistic classifier per bit of the code, by accelerated gradient steps over all rows."""
    names = sorted(set(languages))
    code = codewords(len(names))
    if not names:
        return Model(names, code, np.zeros((FEATURES, 0), np.float32), np.zeros(0, np.float32))
    y = code[np.searchsorted(names, languages)]
    share = np.bincount(np.searchsorted(names, languages), minlength=len(names))
    row_weight = (len(languages) / len(names) / share)[np.searchsorted(names, languages)][:, None] / max(1, len(languages))
    x = x.astype(np.float64)
    w, b = np.zeros((x.shape[1], code.shape[1])), np.zeros(code.shape[1])
    vw, vb = w.copy(), b.copy()
    for k in range(rounds if len(names) > 1 else 0):
        slope = -y / (1 + np.exp(np.clip(y * (x @ vw + vb), -50, 50))) * row_weight
        w2, b2 = vw - rate * (x.T @ slope + decay * vw), vb - rate * slope.sum(0)
        pull = k / (k + 3)
        vw, vb = w2 + pull * (w2 - w), b2 + pull * (b2 - b)
        w, b = w2, b2
    return Model(names, code, w.astype(np.float32), b.astype(np.float32))


def learn(docs: DataFrame, train: Column, sample: int = SAMPLE) -> Model:
    """Model of the rows that meet ``train`` and have a language; about ``sample`` of each language reach the driver,
    as profiles of ``FEATURES`` numbers."""
    rows = docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull())
    ids = F.broadcast(hash_sample(rows, "lang", sample))  # about ``sample`` ids of each language
    picked = rows.select("doc_id", "lang", "text").join(ids, ["doc_id", "lang"], "left_semi").dropDuplicates(["doc_id", "lang"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            kept = [(la, profile(t).tobytes()) for la, t in zip(batch.column("lang").to_pylist(), texts_of(batch)) if LETTER.search(t)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in kept], pa.string()), pa.array([k[1] for k in kept], pa.binary())], names=["lang", "x"]
            )

    found = map_arrow(picked, run, "lang string, x binary").toArrow()
    x = np.frombuffer(b"".join(found["x"].to_pylist()), np.float32).reshape(-1, FEATURES)
    names = found["lang"].to_pylist()
    order = sorted(range(len(names)), key=lambda i: (names[i], x[i].tobytes()))
    return fit(x[order], [names[i] for i in order])


def decode(model: Model, x: np.ndarray, margin: float = 0.1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the nearest codeword, its score, and whether the next one is near."""
    sides = x @ model.weights + model.bias
    loss = np.stack([np.logaddexp(0, -sides * word).sum(1) for word in model.code], 1)
    best = loss.argmin(1)
    share = np.exp(loss.min(1, keepdims=True) - loss)
    if loss.shape[1] > 1:
        two = np.partition(loss, 1, axis=1)
        near = two[:, 1] - two[:, 0] < margin * max(1, model.code.shape[1])
    else:
        near = np.zeros(len(x), bool)
    return best, 1 / share.sum(1), near


def identify(docs: DataFrame, model: Model, margin: float = 0.1) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1), ambiguous of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(tuple(model))  # FEATURES x bits numbers, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*sent.value)
        for batch in sliced(batches):
            texts = texts_of(batch)
            known = [i for i, t in enumerate(texts) if m.languages and LETTER.search(t)]
            names, scores, near = [UNKNOWN] * len(texts), [0.0] * len(texts), [False] * len(texts)
            if known:
                best, score, close = decode(m, np.stack([profile(texts[i]) for i in known]), margin)
                for k, i in enumerate(known):
                    names[i], scores[i], near[i] = m.languages[best[k]], float(score[k]), bool(close[k])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names), pa.array(scores, pa.float64()), pa.array(near)],
                names=["doc_id", "lang_pred", "score", "ambiguous"],
            )

    kind = docs.select("doc_id").schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return map_arrow(rows, run, f"doc_id {kind}, lang_pred string, score double, ambiguous boolean")
