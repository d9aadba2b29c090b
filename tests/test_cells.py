"""Search and threshold joins over cells lose nothing and read few vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellumine.operators import knn as N
from vellumine.operators.cells import CellIndex, coded

FOLDER = "/root/testdata/sf0.1"


def table(spark, vectors, name="vec_id", first=0):
    return spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(vectors)], f"{name} int, embedding array<double>").repartition(3)


def test_codes_are_near():
    v = np.random.default_rng(1).normal(size=(50, 64))
    codes, step, error = coded(np.vstack([v, np.zeros(64)]))
    assert error[-1] == 0 and (error[:-1] > 0).all() and (error < 0.02 * np.linalg.norm(np.vstack([v, np.ones(64)]), axis=1)).all()


def test_tables_read_few_vectors(spark):
    e = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    index, n, m = CellIndex(e), e.count(), asked.count()
    assert index.candidates(asked, 10).count() <= 0.1 * n * m
    hits, exact = index.search(asked, 10).collect(), N.knn(e, asked, 10).collect()
    assert {(r["query_id"], r["id"], r["rank"]) for r in hits} == {(r["query_id"], r["id"], r["rank"]) for r in exact}
    every = e.select(F.col("vec_id").alias("query_id"), "embedding")
    assert index.candidates(every, 5, "dot", least=0.3, exclude_self=True).count() <= 0.1 * n * n


@pytest.mark.parametrize("metric,least", [("l2", None), ("l2", 0.9), ("dot", None), ("dot", 1.5)])
def test_clusters_ties_and_repeats(spark, metric, least):
    """Tight clusters, copies of one vector, zero vectors, a null and another width; hits are those of a full scan."""
    rng = np.random.default_rng(2)
    made = np.vstack([c + 0.1 * rng.normal(size=(60, 6)) for c in rng.normal(size=(8, 6)) * 3] + [np.ones((150, 6)), np.zeros((3, 6))])
    corpus = table(spark, made).unionByName(spark.createDataFrame([(9000, None), (9001, [1.0, 2.0])], "vec_id int, embedding array<double>"))
    asked = table(spark, made[::7], "query_id")
    index = CellIndex(corpus, cells=9, block_rows=32)
    found = [tuple(r) for r in index.search(asked, 6, metric, least=least, exclude_self=True).collect()]
    want = [tuple(r) for r in N.knn(table(spark, made), asked, 6, metric, exclude_self=True).collect()]
    want = [r for r in want if least is None or (r[2] <= least if metric == "l2" else r[2] >= least)]
    assert sorted((q, i, r) for q, i, _, r in found) == sorted((q, i, r) for q, i, _, r in want)


def test_far_blocks_are_skipped(spark):
    rng = np.random.default_rng(3)
    made = np.vstack([np.eye(12)[c] * 100 + rng.normal(size=(100, 12)) for c in range(12)])
    index = CellIndex(table(spark, made), cells=12)
    read = index.candidates(table(spark, made[:100:9], "query_id"), 5).select("id").distinct().collect()
    assert max(r["id"] for r in read) < 100


def test_empty(spark):
    none = spark.createDataFrame([], "vec_id int, embedding array<double>")
    some = table(spark, np.ones((3, 4)), "query_id")
    assert CellIndex(none).search(some, 2).count() == 0
    assert CellIndex(table(spark, np.ones((3, 4)))).search(some.where("false"), 2).count() == 0
