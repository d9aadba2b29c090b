"""Search in blocks: a product in single precision leaves out pairs, and loses none."""

import numpy as np
import pytest

from vellumine.operators import knn as N


def table(spark, vectors, name):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], f"{name} int, embedding array<double>").repartition(2)


def made(scale):
    """Clusters, near copies that differ in the last digits of single precision, copies and zero vectors."""
    rng = np.random.default_rng(5)
    some = np.repeat(rng.normal(size=(40, 12)), 12, axis=0) + rng.normal(size=(480, 12)) * np.tile([0.3, 1e-3, 1e-6, 0], 120)[:, None]
    return scale * np.vstack([some, np.zeros((4, 12))])


@pytest.mark.parametrize("scale", [1.0, 30.0, 1e16])
@pytest.mark.parametrize("metric", ["l2", "dot", "cosine"])
def test_same_hits_as_one_product(spark, metric, scale):
    v = made(scale)
    found = N.knn(table(spark, v, "vec_id"), table(spark, v, "query_id"), 5, metric, exclude_self=True, block_rows=32).collect()
    scores = np.array([N._pair_scores(v, np.broadcast_to(q, v.shape), metric) for q in v])
    way = 1.0 if metric == "l2" else -1.0
    np.fill_diagonal(scores, way * np.inf)
    ids, keys = np.arange(len(v)), np.round(scores, N.ORDER_DIGITS) * way
    want = {(q, int(i)) for q in range(len(v)) for i in np.lexsort((ids, keys[q]))[:5]}
    got = {(r["query_id"], r["id"]) for r in found}
    if scale == 1.0:
        assert got == want
    # Where digits beyond the double's end decide, hits may differ, but not their scores.
    room = 1e-6 * max(1.0, scale**2)
    best = {q: np.sort(keys[q])[:5] for q in range(len(v))}
    for r in found:
        assert abs(way * scores[r["query_id"], r["id"]] - best[r["query_id"]][r["rank"] - 1]) <= room


def test_few_pairs_pass():
    rng = np.random.default_rng(6)
    v = rng.normal(size=(2000, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    reach = np.sort(v @ v[:1000].T, axis=0)[-6]
    query, row = N._better(v[1000:], v[:1000], "dot", reach)
    wanted = v[:1000] @ v[1000:].T >= reach[:, None]
    assert set(zip(*np.nonzero(wanted))) <= set(zip(query, row)) and len(query) <= 1.01 * wanted.sum() + 10
