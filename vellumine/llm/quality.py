"""Quality classifier: a sparse ensemble of rules over text statistics.

1. Statistics of a document are Spark columns (lengths, shares of marks, capitals and digits, different words and lines).
2. Shallow trees are grown on labelled rows with the library's random forest; every path from a root to a node is a
   conjunctive rule ``statistic <= x and statistic > y ...``.
3. A lasso logistic regression over the rules' 0/1 values leaves few of them with a weight.
4. The kept rules are compiled to one Spark column: the logistic of the bias and the weights of the rules that hold.

The texts are read once: statistics are narrow and go to the checkpoint folder, for training and for scoring. Training
takes about ``sample`` labelled rows (by hash of the id), so its cost doesn't grow with the data.

Defined cases: a null text has the statistics of the empty one and gets a score like any text; rows of ``labels`` that are
null are left out, and rows that repeat an id and label count once; without both labels in training every score is
the share of label 1, or 0.5 without any.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine.functions.text import let
from vellumine.llm.common import GAP, count_words, hash_sample, id_bucket
from vellumine.session import cut_lineage

SAMPLE = 20_000
SEED = 11


class Rules(NamedTuple):
    conditions: list[tuple[tuple[str, str, float], ...]]
    weights: list[float]
    bias: float

    def score(self, at: Callable[[str], Column] = F.col) -> Column:
        """Probability of label 1; ``at`` gives a statistic by its name."""
        total = F.lit(self.bias)
        for rule, weight in zip(self.conditions, self.weights):
            total = total + F.when(holds(rule, at), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def holds(rule: tuple[tuple[str, str, float], ...], at: Callable[[str], Column] = F.col) -> Column:
    test = F.lit(True)
    for name, sign, bound in rule:
        test = test & (at(name) <= bound if sign == "<=" else at(name) > bound)
    return test


def statistics(text: Column) -> dict[str, Column]:
    """Named statistics of a text; null counts as empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    chars = F.greatest(F.length(text), F.lit(1)).cast("double")
    words = F.greatest(count_words(text), F.lit(1)).cast("double")
    lines = F.split(text, "\n")
    tokens = F.split(text, f"[{GAP}]+")

    def share(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern)) / chars

    return {
        "s_length": F.log1p(F.length(text).cast("double")),
        "s_word_length": chars / words,
        "s_line_length": chars / F.size(lines),
        "s_symbols": share(r"[#*$%&|<>~^=_{}@+\[\]\\]"),
        "s_stops": share(r"[.,;:]"),
        "s_shouts": share(r"[!?]"),
        "s_capitals": share(r"\p{Lu}"),
        "s_digits": share(r"[0-9]"),
        "s_different_words": F.size(F.array_distinct(tokens)) / words,
        "s_different_lines": F.size(F.array_distinct(lines)) / F.size(lines),
    }


def paths(tree: str, names: list[str]) -> list[tuple[tuple[str, str, float], ...]]:
    """Conditions on the way to every node but the root, from a tree's description."""
    found, stack = [], []
    for line in tree.splitlines():
        m = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if m:
            depth = len(m[1])
            stack = [s for s in stack if s[0] < depth] + [(depth, (names[int(m[2])], m[3], float(m[4])))]
            found.append(simplify([s[1] for s in stack]))
    return found


def simplify(conditions: list[tuple[str, str, float]]) -> tuple[tuple[str, str, float], ...]:
    """The tightest bound of each statistic and side."""
    best: dict[tuple[str, str], float] = {}
    for name, sign, bound in conditions:
        known = best.get((name, sign))
        best[name, sign] = bound if known is None else (min if sign == "<=" else max)(known, bound)
    return tuple(sorted((n, s, b) for (n, s), b in best.items()))


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics, written once to the checkpoint folder."""
    return cut_lineage(docs.select("doc_id", *[c.alias(n) for n, c in statistics(F.col("text")).items()]))


def learn(
    stats: DataFrame, labels: DataFrame, trees: int = 10, depth: int = 3, penalty: float = 0.001, sample: int = SAMPLE
) -> Rules:
    """Rules from the statistics of the rows that ``labels`` (doc_id, label) marks."""
    names = [c for c in stats.columns if c.startswith("s_")]
    marked = labels.where(F.col("label").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col("label").cast("double"))
    marked = marked.withColumn("_all", F.lit(0))
    ids = F.broadcast(hash_sample(marked, "_all", sample).select("doc_id"))  # about ``sample`` ids
    picked = F.broadcast(marked.join(ids, "doc_id", "left_semi").select("doc_id", "label").distinct())
    rows = stats.join(picked, "doc_id").dropDuplicates(["doc_id", "label"]).orderBy(F.xxhash64("doc_id"), "doc_id", "label")
    rows = rows.coalesce(8)  # about ``sample`` narrow rows, read again by every step of the training
    rows = cut_lineage(rows.select("label", array_to_vector(F.array(*names)).alias("features"), *names))
    classes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(classes) < 2:
        return Rules([], [], 0.0 if not classes else 40.0 if 1.0 in classes else -40.0)
    forest = RandomForestClassifier(
        numTrees=trees, maxDepth=depth, seed=SEED, featureSubsetStrategy="onethird", minInstancesPerNode=5, labelCol="label"
    ).fit(rows)
    rules = list(dict.fromkeys(r for t in forest.trees for r in paths(t.toDebugString, names)))
    if not rules:
        return Rules([], [], 0.0)
    values = rows.select("label", array_to_vector(F.array(*[holds(r).cast("double") for r in rules])).alias("features"))
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=100, labelCol="label").fit(values)
    kept = [(r, float(w)) for r, w in zip(rules, lasso.coefficients.toArray()) if w]
    return Rules([r for r, _ in kept], [w for _, w in kept], float(lasso.intercept))


def score_quality(docs: DataFrame, labels: DataFrame, least: float = 0.3, folds: int = 5, **settings) -> DataFrame:
    """doc_id, ``held_out`` (crc32 of the id as text is 0 modulo ``folds``), ``score``, ``predicted`` (score >= least).

    ``labels`` has doc_id and ``quality``; only labels of rows that are not held out are read.
    """
    held_out = F.coalesce(id_bucket(F.col("doc_id"), folds) == 0, F.lit(False))
    stats = with_statistics(docs)
    seen = labels.where(~held_out).select("doc_id", F.col("quality").alias("label"))
    model = learn(stats, seen, **settings)
    scored = stats.select("doc_id", held_out.alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= least).cast("int"))


def good_documents(docs: DataFrame, labels: DataFrame, least: float = 0.3, **settings) -> DataFrame:
    """Documents that the classifier doesn't reject, with the input's columns.

    The model is fitted as in ``score_quality``; the texts are scored where they stand, so none is shuffled.
    """
    held_out = F.coalesce(id_bucket(F.col("doc_id"), 5) == 0, F.lit(False))
    seen = labels.where(~held_out & F.col("quality").isNotNull()).select("doc_id", F.col("quality").alias("label"))
    model = learn(with_statistics(docs), seen, **settings)
    # The statistics are bound once per row: as plain columns the optimizer would copy them into every rule of the filter.
    stats = F.struct(*[c.alias(n) for n, c in statistics(F.col("text")).items()])
    return docs.where(let(stats, lambda s: model.score(lambda n: s[n])) >= least)
