"""Hot-group helpers against brute force: one key holds a third of the rows."""

import random
from itertools import groupby

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellumine.operators import knn as N
from vellumine.operators import logbook as L
from vellumine.operators import metrics as M
from vellumine.operators import scale


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(5)
    rows = [(i, 0 if i % 3 == 0 else rng.randrange(1, 9), rng.randrange(0, 40_000), rng.choice("abc")) for i in range(3000)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, sec long, event_type string")
    return rows, df.withColumn("ts", (F.timestamp_seconds(F.col("sec") + 1704067200)).cast("timestamp_ntz")).cache()


def test_sliced_row_number_and_lag(skewed):
    rows, df = skewed
    out = scale.sliced_row_number(df, ["user_id"], F.floor(F.col("sec") / 1000), [F.col("sec"), F.col("event_id")], "n")
    mine = {r["event_id"]: r["n"] for r in out.collect()}
    lag = scale.sliced_lag(df, ["user_id"], F.floor(F.col("sec") / 1000), ["sec", "event_id"], ["event_type"])
    prev = {r["event_id"]: r["prev_event_type"] for r in lag.collect()}
    for _, group in groupby(sorted(rows, key=lambda r: (r[1], r[2], r[0])), key=lambda r: r[1]):
        before = None
        for n, r in enumerate(group, 1):
            assert mine[r[0]] == n and prev[r[0]] == before
            before = r[3]


def test_rate_limit_and_token_buckets(skewed):
    rows, df = skewed
    calls = {r["event_id"]: r["calls"] for r in L.rate_limit(df, 600, 5, slices=31).collect()}
    allowed = {r["event_id"]: r["allowed"] for r in L.token_buckets(df, 60, 2).collect()}
    for _, group in groupby(sorted(rows, key=lambda r: (r[1], r[2], r[0])), key=lambda r: r[1]):
        group = list(group)
        secs = np.array([r[2] for r in group])
        start, used = None, 0
        for r in group:
            assert calls[r[0]] == int(((secs >= r[2] - 600) & (secs <= r[2])).sum())
            if start is None or r[2] - start >= 60:
                start, used = r[2], 0
            used += 1
            assert allowed[r[0]] == (used <= 2)


def test_transitions(skewed):
    rows, df = skewed
    changed = {r["event_id"] for r in L.state_transitions(df, slices=47).collect()}
    for _, group in groupby(sorted(rows, key=lambda r: (r[1], r[2], r[0])), key=lambda r: r[1]):
        before = None
        for r in group:
            assert (r[0] in changed) == (r[3] != before)
            before = r[3]


@pytest.fixture(scope="module")
def burst(spark):
    """A third of all rows in one second of one user, half of these at one instant; and rows that are equal in all columns."""
    rng = random.Random(8)
    rows = [(i, 0, 1_000_000 + (rng.randrange(1000) * 1000 if i % 2 else 0), rng.choice("abc")) for i in range(4000)]
    rows += [(10_000 + i, rng.randrange(1, 9), rng.randrange(0, 4_000_000_000), rng.choice("abc")) for i in range(7000)]
    rows += [(99_999, 3, 77, "a")] * 1000 + [(5, None, 1, "b"), (6, None, 2, "b")]
    df = spark.createDataFrame(rows, "event_id long, user_id long, us long, event_type string").repartition(6)
    return rows, df.withColumn("ts", F.timestamp_micros(F.col("us") + 1704067200000000).cast("timestamp_ntz")).cache()


@pytest.mark.parametrize("order", [["user_id", "us", "event_id"], ["user_id"]])
def test_slices_of_a_burst_are_bounded(burst, order):
    rows, df = burst
    sizes = [r["count"] for r in scale.ordered_slices(df, order[:1], order[1:], 24).groupBy("_slice").count().collect()]
    assert sum(sizes) == len(rows) and len(sizes) == 24 and max(sizes) < 3 * len(rows) / 24


def test_burst_rates_and_sessions(burst):
    rows, df = burst
    calls = sorted(((r["user_id"] is None, r["user_id"]), r["event_id"], r["calls"]) for r in L.rate_limit(df, 1, 5, slices=24).collect())
    want, sess, hits = [], [], 0
    for user, group in groupby(sorted(rows, key=lambda r: ((r[1] is None, r[1]), r[2], r[0])), key=lambda r: r[1]):
        group = list(group)
        us = np.array([r[2] for r in group])
        n = np.searchsorted(us, us, "right") - np.searchsorted(us, us - 1_000_000, "left")
        want += [((user is None, user), r[0], int(c)) for r, c in zip(group, n)]
        gaps = np.diff(us)
        sess += [(user, int(k)) for k in np.diff(np.r_[0, np.flatnonzero(gaps >= 2_000_000) + 1, len(us)])]
        hits += int((gaps < 2_000_000).sum())
    assert calls == sorted(want)
    key = lambda x: (x[0] is None, x)
    assert sorted(((r["user_id"], r["events"]) for r in L.sessions(df, 2, slices=24).collect()), key=key) == sorted(sess, key=key)
    assert L.reuse_statistics(df, "user_id", 2, slices=24).first()["hits"] == hits


def test_small_groups_need_no_slices(burst, monkeypatch):
    """Results do not depend on whether groups fit in a task."""
    _, df = burst
    assert "_slice" not in scale.ordered_slices(df, ["user_id"], ["us"]).columns
    whole = [sorted(map(repr, f(df).collect())) for f in (lambda d: L.rate_limit(d, 1, 5).select("event_id", "calls"), lambda d: L.sessions(d, 2))]
    monkeypatch.setattr(scale, "GROUP_ROWS", 500)
    monkeypatch.setattr(L, "GROUP_ROWS", 500)
    assert "_slice" in scale.ordered_slices(df, ["user_id"], ["us"]).columns
    assert whole == [sorted(map(repr, f(df).collect())) for f in (lambda d: L.rate_limit(d, 1, 5).select("event_id", "calls"), lambda d: L.sessions(d, 2))]


def test_sessions(skewed):
    rows, df = skewed
    mine = sorted((r["user_id"], r["events"]) for r in L.sessions(df, 60, slices=60).collect())
    want = []
    for user, group in groupby(sorted(rows, key=lambda r: (r[1], r[2])), key=lambda r: r[1]):
        last, n = None, 0
        for r in group:
            if last is not None and r[2] - last >= 60:
                want.append((user, n))
                n = 0
            last, n = r[2], n + 1
        want.append((user, n))
    assert mine == sorted(want)


@pytest.mark.parametrize("values", [[1.0] * 500 + [2.0, 3.0], list(range(1000)), [0.0] * 10 + [1e9], [-1e12, *range(900)], [-1e9, *([7.0] * 50), 1e15], [5.0], [-3.0, -1.0, 0.0, 7.5]])
def test_exact_quantiles(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = {r["prob"]: r["quantile"] for r in scale.exact_quantiles(df, "v", [0.0, 0.5, 0.95, 1.0]).collect()}
    for p, q in got.items():
        assert q == pytest.approx(float(np.quantile(values, p)))
    assert len(got) == 4


def test_knn_in_several_passes(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    queries = df.select(F.col("vec_id").alias("query_id"), "embedding")
    hits = N.knn(df, queries, 3, "l2", exclude_self=True, block_rows=16).collect()
    assert len(hits) == 180
    for r in hits:
        order = np.argsort(np.linalg.norm(vectors - vectors[r["query_id"]], axis=1))
        assert r["id"] == order[r["rank"]]


def test_rouge_l(spark):
    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            prev = 0
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    rng = random.Random(1)
    pairs = [("".join(rng.choices("abcd", k=rng.randrange(1, 90))), "".join(rng.choices("abcd", k=rng.randrange(1, 90)))) for _ in range(40)]
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", M.rouge_l("a", "b").alias("s")).collect():
        assert r["s"] == pytest.approx(lcs(r["a"], r["b"]) / len(r["a"]))


def test_approximate_recall(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    q = e.groupBy(F.col("label").alias("query_id")).agg(F.min_by("embedding", "vec_id").alias("embedding"))
    exact = N.knn(e, q, 10, "l2")
    assert N.recall(N.IvfIndex(e).search(q, 10, nprobe=64), exact).first()["recall"] > 0.7
    assert N.recall(N.LshIndex(e).search(q, 10), exact).first()["recall"] > 0.5
