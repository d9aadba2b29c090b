"""The pipeline's near-duplicate stage takes SimHash links as candidates and checks them exactly."""

import numpy as np
from pyspark.sql import functions as F

from vellumine.llm import similar, simhash


def test_simhash_links_are_candidates(spark):
    rng = np.random.default_rng(3)
    long = [f"w{x}" for x in rng.integers(0, 5000, 3000)]
    rows = [(0, " ".join(long)), (1, " ".join(long[:-1] + ["other"])), (2, " ".join(f"x{x}" for x in rng.integers(0, 5000, 3000))), (3, None), (4, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    prints = {i: simhash.fingerprint(t or "", 3) for i, t in rows}
    assert (prints[0] ^ prints[1]).bit_count() <= similar.RADIUS
    # Bands that no two texts share: only SimHash is left to name candidates.
    known = similar.sketches(docs, 5).withColumn("bands", F.array("node")).cache()
    node = {r["doc_id"]: r["node"] for r in known.collect()}
    found = {(r["u"], r["v"]) for r in similar.links(docs, known, 5, 0.8).collect()}
    assert found == {(max(node[a], node[b]), min(node[a], node[b])) for a, b in ((0, 1), (3, 4))}
    assert {r["doc_id"] for r in similar.first_of_each(docs).collect()} == {0, 2, 3}
