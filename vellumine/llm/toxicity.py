"""Toxicity by cumulative-link ordinal regression on sparse text features.

Features are words (runs of letters, lower case) and their prefixes of 4 to 6 letters; a feature's value is the number of
different words of the text that carry it, so a text's sum is over its different words. From labelled rows, features that
stand much oftener in toxic texts are chosen (smoothed log-odds and support); a text's severity for training is 0 without
the label, else 1 to ``GRADES`` by how many different words with chosen features it has (``GRADE_STEPS``). The ordinal
model ``P(grade <= k) = logistic(threshold_k - w x)`` shares one weight vector across ordered thresholds; its weights are
fitted with an L1 penalty. It gives the probability of each grade, the expected severity, and the toxic decision.

Training takes about ``sample`` rows of each label (by hash of the id), in whole; counting features over them
runs as a grouped aggregate, and the driver gets at most ``FEATURES`` chosen features and the rows' sparse values.

Defined cases: a null or wordless text has no features and gets the model's base rate; without toxic rows in training all
severities are 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine.llm.common import hash_sample, map_arrow, sliced, texts_of
from vellumine.session import cut_lineage

SAMPLE = 4000
FEATURES = 2000
PREFIXES = (4, 5, 6)
#: Different toxic words from which a toxic text has the next grade.
GRADE_STEPS = (3, 6)
GRADES = len(GRADE_STEPS) + 1
WORDS = regex.compile(r"\p{L}+")
CACHE = 500_000


class Model(NamedTuple):
    weights: dict[str, float]
    thresholds: np.ndarray


def features(word: str) -> list[str]:
    """``=word`` and its prefixes that are shorter."""
    return ["=" + word, *[word[:n] for n in PREFIXES if len(word) >= n]]


def grade_probabilities(score: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """Rows of P(grade = 0 .. GRADES)."""
    upto = 1 / (1 + np.exp(-np.clip(thresholds[None, :] - score[:, None], -50, 50)))
    return np.diff(np.concatenate([np.zeros((len(score), 1)), upto, np.ones((len(score), 1))], 1), axis=1)


def fit(rows: list[np.ndarray], grades: np.ndarray, n_features: int, rounds: int = 400, rate: float = 0.2, penalty: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds; ``rows`` are feature numbers with repeats. Proximal gradient on the likelihood."""
    lengths = np.array([len(r) for r in rows])
    flat = np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64)
    owner = np.repeat(np.arange(len(rows)), lengths)
    row_weight = 1 / np.bincount(np.minimum(grades, 1), minlength=2).clip(1)[np.minimum(grades, 1)]
    row_weight /= row_weight.sum()
    w = np.zeros(n_features)
    base, gaps = 0.0, np.zeros(GRADES - 1)  # thresholds: base, then base + running sums of exp(gaps)
    seen = np.zeros(n_features)
    for _ in range(rounds):
        thresholds = base + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        score = np.bincount(owner, w[flat], len(rows))
        upto = 1 / (1 + np.exp(-np.clip(thresholds[None, :] - score[:, None], -50, 50)))
        full = np.concatenate([np.zeros((len(rows), 1)), upto, np.ones((len(rows), 1))], 1)
        at = np.arange(len(rows))
        p = np.maximum(full[at, grades + 1] - full[at, grades], 1e-9)
        slope = full * (1 - full)
        high, low = slope[at, grades + 1] / p * row_weight, slope[at, grades] / p * row_weight
        by_score = high - low  # derivative of the loss by the score
        by_threshold = np.zeros(GRADES)
        inner = grades < GRADES
        np.add.at(by_threshold, grades[inner], -high[inner])
        np.add.at(by_threshold, grades[grades > 0] - 1, low[grades > 0])
        slope_w = np.bincount(flat, by_score[owner], n_features)
        seen += slope_w**2
        step = rate / np.sqrt(seen + 1e-12)  # steps by each feature's own slopes, so that rare ones learn as well
        w = w - step * slope_w
        w = np.sign(w) * np.maximum(np.abs(w) - step * penalty, 0)
        gaps -= rate * np.array([by_threshold[i + 1 :].sum() for i in range(GRADES - 1)]) * np.exp(gaps)
        base -= rate * by_threshold.sum()
    return w, base + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, least_support: int = 5, least_odds: float = 2.5) -> Model:
    """``labels`` has doc_id and ``toxic`` (0 or 1)."""
    marked = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int"))
    picked = F.broadcast(hash_sample(marked, "toxic", sample))  # about 2 * sample ids
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(picked, "doc_id").dropDuplicates(["doc_id", "toxic"])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [[f for w in set(WORDS.findall(t.lower())) for f in features(w)] for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(found, pa.list_(pa.string()))], names=["toxic", "found"])

    spelled = cut_lineage(map_arrow(rows.select("toxic", "text"), spell, "toxic int, found array<string>"))
    totals = {r["toxic"]: r["count"] for r in spelled.groupBy("toxic").count().collect()}
    if not totals.get(1):
        return Model({}, np.full(GRADES, 50.0) + np.arange(GRADES))
    each = spelled.select("toxic", F.explode(F.array_distinct("found")).alias("f")).groupBy("f")
    counts = each.agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("all")).where(F.col("bad") >= least_support)
    odds = F.log((F.col("bad") + 0.5) / (totals[1] + 1)) - F.log((F.col("all") - F.col("bad") + 0.5) / (totals.get(0, 0) + 1))
    chosen = counts.select("f", odds.alias("odds"), "bad").where(F.col("odds") >= least_odds)
    chosen = chosen.orderBy((F.col("odds") * F.log1p("bad")).desc(), "f").limit(FEATURES).collect()
    number = {r["f"]: i for i, r in enumerate(chosen)}
    kept = spelled.select("toxic", F.filter("found", lambda f: f.isin(list(number)) if number else F.lit(False)).alias("found")).toArrow()
    xs = [np.array([number[f] for f in fs], np.int64) for fs in kept["found"].to_pylist()]
    toxic = kept["toxic"].to_numpy()
    words = np.array([len({f for f in fs if f[0] == "="} or fs[:1]) for fs in kept["found"].to_pylist()])
    order = np.lexsort((words, toxic))
    grades = np.where(toxic == 1, 1 + np.searchsorted(GRADE_STEPS, words, side="right"), 0)
    weights, thresholds = fit([xs[i] for i in order], grades[order], len(number))
    return Model({f: float(weights[i]) for f, i in number.items() if weights[i]}, thresholds)


def severity(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """doc_id, ``score`` (probability of any severity), ``severity`` (expected grade), ``grade`` (likeliest), ``predicted``."""
    sent = docs.sparkSession.sparkContext.broadcast(tuple(model))  # at most FEATURES weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, thresholds = sent.value
        known: dict[str, float] = {}
        for batch in sliced(batches):
            score = np.zeros(batch.num_rows)
            for i, text in enumerate(texts_of(batch)):
                words = set(WORDS.findall(text.lower()))
                if len(known) > CACHE:
                    known = {}
                for w in words.difference(known):
                    known[w] = sum(weights.get(f, 0.0) for f in features(w))
                score[i] = sum(sorted(filter(None, map(known.__getitem__, words))))
            p = grade_probabilities(score, thresholds)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(1 - p[:, 0]), pa.array(p @ np.arange(GRADES + 1.0)),
                    pa.array(p.argmax(1).astype(np.int32)), pa.array((1 - p[:, 0] >= least).astype(np.int32)),
                ],
                names=["doc_id", "score", "severity", "grade", "predicted"],
            )

    kind = docs.select("doc_id").schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return map_arrow(rows, run, f"doc_id {kind}, score double, severity double, grade int, predicted int")
