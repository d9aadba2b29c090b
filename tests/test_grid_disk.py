"""A grid of blocks writes each side once, whatever its cells."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellumine.operators import knn as N


@pytest.mark.parametrize("n_queries,columns", [(512, 8), (16, 4)])
def test_sides_are_written_once(spark, n_queries, columns):
    rng = np.random.default_rng(5)

    def packed(n, prefix):
        rows = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(n)], "id int, v array<double>").repartition(4)
        return N._packed(rows, 8, prefix)

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        met = N.met_blocks(packed(512, "c"), packed(n_queries, "q"))
        seen = met.select(F.spark_partition_id().alias("p"), F.get("c_ids", F.lit(0)).alias("c"), F.get("q_ids", F.lit(0)).alias("q")).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "explode" not in plan  # no side is copied before it is dealt out
    assert len({(r["c"], r["q"]) for r in seen}) == len(seen) == 64 * (64 if n_queries == 512 else 4)  # 4 partitions of 4 make 4 blocks
    assert met.rdd.getNumPartitions() == 8 and len({r["p"] for r in seen}) == 8
    # A query's best rows are written by each row of the grid: no more rows than the queries leave tasks.
    assert all(len({r["p"] for r in seen if r["q"] == q}) <= 8 // columns for q in {r["q"] for r in seen})
