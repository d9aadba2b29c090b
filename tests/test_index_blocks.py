"""IVF and LSH score their candidates in blocks: hits equal those of the cells' and buckets' definition, no pair becomes a row."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellumine.operators import knn as N


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(300, 8)).astype(np.float32)
    v[150:] = v[150] + rng.normal(size=(150, 8)) * 0.01  # half of the rows crowd one cell and bucket
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>").cache()


def best(allowed, rows, asked, k):
    vectors = {r["vec_id"]: np.array(r["embedding"], float) for r in rows.collect()}
    out = set()
    for q in asked:
        ranked = sorted((round(float(np.linalg.norm(vectors[q] - vectors[i])), 5), i) for i in allowed[q])
        out |= {(q, round(d, 3)) for d, _ in ranked[:k]}
    return out


def shown(found):
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString().split("Window")[-1].replace("_cell", "")
    return {(r["query_id"], round(r["score"], 3)) for r in found.collect()}


def test_lsh(rows):
    index = N.LshIndex(rows, bucket=0.5, tables=3)
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    hashes = {r["id"]: r["hashes"] for r in index.table.collect()}
    ids = [r["query_id"] for r in asked.collect()]
    allowed = {q: [i for i, h in hashes.items() if any(a == b for a, b in zip(h, hashes[q]))] for q in ids}
    assert shown(index.search(asked, 4)) == best(allowed, rows, ids, 4)


def test_ivf(rows):
    index = N.IvfIndex(rows)
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    cells = {r["id"]: r["cell"] for r in index.table.collect()}
    wanted = {r["query_id"]: np.array(r["embedding"], float) for r in asked.collect()}
    near = {q: set(np.argsort(np.linalg.norm(index.centers - v, axis=1), kind="stable")[:3].tolist()) for q, v in wanted.items()}
    allowed = {q: [i for i, c in cells.items() if c in near[q]] for q in wanted}
    assert shown(index.search(asked, 4, nprobe=3)) == best(allowed, rows, list(wanted), 4)
