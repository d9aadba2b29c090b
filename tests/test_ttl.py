"""The store with a time to live: stream and batch agree over micro-batches, with expiries and late rows."""

import random

from pyspark.sql import functions as F

from vellumine.operators import logbook as L
from vellumine.streaming import ttl
from vellumine.workload import load

SCHEMA = "event_id long, user_id long, ts timestamp_ntz"


def as_table(spark, rows):
    df = spark.createDataFrame(rows, "event_id long, user_id long, sec double")
    return df.select("event_id", "user_id", F.timestamp_micros((F.col("sec") * 1_000_000).cast("bigint") + 1_704_067_200_000_000).cast("timestamp_ntz").alias("ts"))


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(4)
    batches, n = [], 0
    for b in range(5):
        rows = []
        for _ in range(60):
            user = 0 if rng.random() < 0.4 else rng.randrange(1, 6)
            rows.append((n, user, b * 3000 + rng.choice([rng.randrange(3000), rng.randrange(0, 3000, 500)])))
            n += 1
        batches.append([(i, u, float(s)) for i, u, s in rows])
    late = [(9001, 0, 10.0), (9002, 3, 20.0)]  # far behind the watermark when they come
    last = [(9999, 77, 100_000.0)]  # moves the watermark past everything
    for k, rows in enumerate([*batches[:4], late, batches[4], last, [(10_000, 78, 200_000.0)]]):
        as_table(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    files = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    out = ttl.store_events(files, "user_id", 600, lateness="50 minutes")
    q = out.writeStream.format("memory").queryName("store").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/state").start()
    q.awaitTermination()
    found = {tuple(r) for r in spark.table("store").collect()}
    kept = [r for b in batches for r in b]
    want = {tuple(r) for r in ttl.batch_events(as_table(spark, [*kept, *last]), "user_id", 600, slices=5).collect()}
    users = {u for _, u, _ in kept}
    ends = {r for r in found - want if r[3] == "expired"}  # a stream that goes on also tells the last entries' expiry
    assert {r[0] for r in ends} == users | {77} or {r[0] for r in ends} == users
    assert {r for r in found - ends if r[0] != 77} == {r for r in want if r[0] != 77}
    assert sum(r[3] == "expired" for r in want) > 5 and not any(r[2] in (9001, 9002) for r in found)
    stats = L.reuse_statistics(as_table(spark, kept), "user_id", 600).first()
    assert sum(r[3] == "hit" for r in found) == stats["hits"]


def test_query_registered():
    assert "store_events" in load()[0]
