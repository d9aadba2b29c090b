"""Blocks of queries and rows meet in a grid where neither side may be broadcast."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellumine.operators import context as O
from vellumine.operators import knn as N


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def rows(spark, n, seed, width=8, name="vec_id"):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(i, rng.normal(size=width).tolist()) for i in range(n)], f"{name} int, embedding array<double>").repartition(4)


def test_pairs_are_spread(spark, no_broadcast):
    c = N._packed(rows(spark, 512, 1).select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), 8, "c")
    q = N._packed(rows(spark, 512, 2).select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), 8, "q")
    met = N.met_blocks(c, q)
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert "_width" not in plan.split("Join", 1)[1].split("\n", 1)[0]
    seen = met.select(F.spark_partition_id().alias("p"), F.get("c_ids", F.lit(0)).alias("c"), F.get("q_ids", F.lit(0)).alias("q")).collect()
    assert len(seen) == len({(r["c"], r["q"]) for r in seen}) == c.count() * q.count()
    parts = {}
    for r in seen:
        parts[r["p"]] = parts.get(r["p"], 0) + 1
    assert max(parts.values()) < 0.5 * len(seen)


@pytest.mark.parametrize("metric", ["l2", "dot"])
def test_same_hits_in_the_grid(spark, metric):
    corpus, asked = rows(spark, 300, 3), rows(spark, 90, 4, name="query_id")
    wide = rows(spark, 20, 5, width=5).withColumn("vec_id", F.col("vec_id") + 1000)  # another width never meets the queries
    all_rows = corpus.unionByName(wide)
    want = sorted(map(tuple, N.knn(all_rows, asked, 5, metric).collect()))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = sorted(map(tuple, N.knn(all_rows, asked, 5, metric, block_rows=16).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert [(a, b, d) for a, b, _, d in got] == [(a, b, d) for a, b, _, d in want] and len(got) == 450
    assert np.allclose([r[2] for r in got], [r[2] for r in want])


def test_ids_of_text(spark):
    prompts = spark.createDataFrame([("c1_chunk_1", "参考信息：\nOne. Two.\n问题：x")], "query_id string, prompt string")
    assert [(r["query_id"], r["answer"]) for r in O.generate(prompts).collect()] == [("c1_chunk_1", "One")]
    named = rows(spark, 40, 6).withColumn("vec_id", F.format_string("v%03d", "vec_id"))
    asked = named.select(F.col("vec_id").alias("query_id"), "embedding")
    hits = N.LshIndex(named, tables=2).search(asked, 1)
    assert all(r["query_id"] == r["id"] for r in hits.collect())
