"""Event logs: queries, transitions, health, request re-use, rate rules in batch form.

One user, entity or key may hold a third of all events, within one second too, so per-key time logic works inside slices of
equal row count and carries only what crosses a slice border.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumine import settings as S
from vellumine.operators.scale import GROUP_ROWS, largest_group, ordered_slices, previous, running_sum, sliced_lag, small_table
from vellumine.session import cut_lineage


def log_filter(equals: Mapping[str, object] | None = None, start: str | None = None, end: str | None = None, ts: str = "ts") -> Column:
    """Equality filters and an inclusive time range; all reach the Parquet scan."""
    out = F.lit(True)
    for name, value in (equals or {}).items():
        out = out & (F.col(name) == F.lit(value))
    if start is not None:
        out = out & (F.col(ts) >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        out = out & (F.col(ts) <= F.lit(end).cast("timestamp_ntz"))
    return out


def log_page(logs: DataFrame, test: Column, offset: int = 0, limit: int = 100, ts: str = "ts", key: str = "event_id") -> DataFrame:
    """One page, newest first."""
    return logs.where(test).orderBy(F.col(ts).desc(), F.col(key).desc()).offset(offset).limit(limit)


def log_count(logs: DataFrame, test: Column) -> DataFrame:
    return logs.where(test).agg(F.count(F.lit(1)).alias("matching"))


def export_rows(logs: DataFrame, test: Column, details: str = "props") -> DataFrame:
    """Rows of a time range with details as JSON text, ready for a JSON or CSV sink."""
    kind = logs.schema[details].dataType.simpleString()
    return logs.where(test).withColumn(details, F.col(details) if kind == "string" else F.to_json(details))


def micros(ts: str = "ts") -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def state_transitions(logs: DataFrame, entity: str = "user_id", state: str = "event_type", ts: str = "ts", key: str = "event_id", slices: int | None = None) -> DataFrame:
    """Rows where the entity's state differs from its previous one."""
    lagged = previous(ordered_slices(logs, [entity], [ts, key], slices), [entity], [ts, key], [state]).drop("_slice")
    return lagged.where(F.col(f"prev_{state}").isNull() | (F.col(f"prev_{state}") != F.col(state)))


def latest_metrics(samples: DataFrame, metric: str = "metric", value: str = "value", ts: str = "ts", key: str = "event_id") -> DataFrame:
    return samples.groupBy(metric).agg(F.max_by(value, F.struct(ts, key)).alias("latest"))


def threshold_alerts(samples: DataFrame, limits: Mapping[str, float] = S.ALERT_LIMITS, metric: str = "metric", value: str = "value") -> DataFrame:
    """Samples over the limit of their metric."""
    table = small_table(samples.sparkSession, list(limits.items()), f"{metric} string, threshold double")
    return samples.join(table, metric).where(F.col(value) > F.col("threshold"))


def health_status(latest: DataFrame, limits: Mapping[str, float] = S.ALERT_LIMITS, critical: Sequence[str] = ("disk",), metric: str = "metric") -> DataFrame:
    """One row: healthy, degraded or critical, and the metrics over their limits."""
    over = threshold_alerts(latest, limits, metric, "latest")
    is_critical = F.col(metric).isin(*critical)
    # At most one row per limit reaches this aggregate.
    out = over.agg(F.count(F.lit(1)).alias("n"), F.count_if(is_critical).alias("c"), F.array_sort(F.collect_set(metric)).alias("issues"))
    return out.select(F.when(F.col("c") > 0, "critical").when(F.col("n") > 0, "degraded").otherwise("healthy").alias("status"), "issues")


def recent_samples(samples: DataFrame, minutes: int, ts: str = "ts") -> DataFrame:
    """Samples of the last ``minutes`` before the newest one; the bound is a scalar, so it is pushed to the scan."""
    newest = samples.agg(F.max(ts)).first()[0]
    return samples.where(F.col(ts) >= F.lit(newest).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(minutes)} MINUTES"))


# --- request re-use -------------------------------------------------------------------------


def request_key(query: Column, size: int = 16, prefix: str = "retrieval:", **parts: Column) -> Column:
    """Digest of a normalised request: the same for equal queries up to case and outer spaces."""
    body = F.to_json(F.struct(*[p.alias(n) for n, p in sorted(parts.items())], F.lower(F.trim(query)).alias("query")))
    return F.concat(F.lit(prefix), F.substring(F.sha2(body, 256), 1, size))


def reuse_statistics(
    requests: DataFrame, key: str, ttl: int = 1800, ts: str = "ts", tie: str = "event_id", tokens: str | None = None, slices: int | None = None
) -> DataFrame:
    """Hits, misses, hit rate and tokens saved: a request within ``ttl`` seconds of the previous
    one with its key is a hit. Totals come from partial sums."""
    keep = requests.select(key, micros(ts).alias("_t"), tie, *([tokens] if tokens else []))
    lagged = previous(ordered_slices(keep, [key], ["_t", tie], slices), [key], ["_t", tie], ["_t"])
    gap = F.col("_t") - F.col("prev__t")
    hit = F.coalesce(gap < ttl * 1_000_000, F.lit(False))
    total = F.count(F.lit(1))
    saved = [F.sum(F.when(hit, F.col(tokens)).otherwise(0)).alias("tokens_saved")] if tokens else []
    return lagged.agg(F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses"), (F.count_if(hit) / total).alias("hit_rate"), *saved)


def expiry_counts(items: DataFrame, created: str, ttl: int, at: Column) -> DataFrame:
    """Active and expired items at a moment."""
    expires = F.col(created) + F.expr(f"INTERVAL {int(ttl)} SECONDS")
    return items.agg(F.count_if(expires >= at).alias("active"), F.count_if(expires < at).alias("expired"))


# --- rates and sessions ---------------------------------------------------------------------


def rate_limit(
    events: DataFrame, period: int, max_calls: int, key: str = "user_id", ts: str = "ts", tie: str = "event_id", slices: int | None = None
) -> DataFrame:
    """Adds ``calls`` within the last ``period`` seconds and ``limited`` when over ``max_calls``.

    Keys that fit in a task are counted by a window. Else calls at one instant are counted first. Each instant then stands in the order twice, as itself and as a probe where its
    period begins; the difference of their running sums is the number of calls. Nothing is copied into other slices, so a
    burst inside one period costs no more than other rows.
    """
    timed = events.withColumn("_t", micros(ts))
    if slices is None and largest_group(timed, [key]) <= GROUP_ROWS:
        frame = Window.partitionBy(key).orderBy("_t").rangeBetween(-period * 1_000_000, 0)
        return timed.withColumn("calls", F.count(F.lit(1)).over(frame)).withColumn("limited", F.col("calls") > max_calls).drop("_t")
    counts = timed.groupBy(key, "_t").agg(F.count(F.lit(1)).alias("_n"))
    at = lambda t, kind, n: F.struct(t.alias("_at"), F.lit(kind).alias("_kind"), n.alias("_m"))
    ends = F.array(at(F.col("_t"), 1, F.col("_n")), at(F.col("_t") - period * 1_000_000, 0, F.lit(0).cast("bigint")))
    placed = counts.select(key, "_t", F.explode(ends).alias("_e")).select(key, "_t", "_e.*")
    summed = running_sum(ordered_slices(placed, [key], ["_at", "_kind"], slices), [key], ["_at", "_kind"], F.col("_m"), "_c")
    upto = lambda kind: F.max(F.when(F.col("_kind") == kind, F.col("_c")))
    calls = summed.groupBy(F.col(key).alias("_key"), F.col("_t").alias("_moment")).agg((upto(1) - upto(0)).alias("calls"))
    met = timed.join(calls, F.col(key).eqNullSafe(F.col("_key")) & F.col("_t").eqNullSafe(F.col("_moment")))
    return met.withColumn("limited", F.col("calls") > max_calls).drop("_t", "_key", "_moment")


def lockouts(events: DataFrame, failure: Column, attempts: int = 5, period: int = 900, key: str = "user_id", **names) -> DataFrame:
    """Failures that reach ``attempts`` within ``period`` seconds of the same account."""
    return rate_limit(events.where(failure), period, attempts - 1, key, **names).where("limited")


def tumbling_buckets(events: DataFrame, seconds: int = 60, burst: int = 10, key: str = "user_id", ts: str = "ts") -> DataFrame:
    """Calls per key and fixed bucket, and how many exceed the burst."""
    out = events.groupBy(key, F.window(ts, f"{seconds} seconds").alias("w")).agg(F.count(F.lit(1)).alias("calls"))
    return out.select(key, F.col("w.start").alias("bucket"), "calls", F.greatest(F.col("calls") - burst, F.lit(0)).alias("rejected"))


def token_buckets(events: DataFrame, seconds: int = 60, burst: int = 10, key: str = "user_id", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """(key, tie, bucket_start, allowed): a bucket of ``burst`` calls opens at the first request and the
    next one at the first request after it ended.

    Bucket starts chain through time. Instead of walking a key's events in one task, every
    moment gets a pointer to the first moment a bucket later; the chain from each quiet gap is
    then marked by pointer doubling, in as many joins as the logarithm of its length.
    """
    span = seconds * 1_000_000
    width = max(3600 * 1_000_000, 2 * span)
    rows = events.select(key, tie, F.unix_micros(F.col(ts).cast("timestamp")).alias("_t"))
    times = rows.select(key, "_t").distinct()
    slice_of = F.floor(F.col("_t") / F.lit(width))

    def with_context(df: DataFrame, test: Column, shift: int) -> DataFrame:
        cut = df.withColumn("_slice", slice_of)
        copied = cut.where(test).withColumn("_slice", F.col("_slice") + shift)
        return cut.withColumn("_real", F.lit(1)).unionByName(copied.withColumn("_real", F.lit(0)))

    # A pointer past the copied rows would cross a quiet gap, where a chain starts anyway.
    ahead = Window.partitionBy(key, "_slice").orderBy("_t").rangeBetween(span, Window.unboundedFollowing)
    early = F.pmod(F.col("_t"), F.lit(width)) < 2 * span
    jumps = with_context(times, early, -1).withColumn("_next", F.min("_t").over(ahead)).where("_real = 1 AND _next IS NOT NULL")
    jumps = cut_lineage(jumps.select(key, "_t", "_next"))
    lagged = sliced_lag(times.withColumn("_at", F.col("_t")), [key], slice_of, ["_t"], ["_at"])
    starts = cut_lineage(lagged.where(F.coalesce(F.col("_t") - F.col("prev__at") >= span, F.lit(True))).select(key, "_t"))
    known = starts.count()
    while True:
        reached = starts.join(jumps, [key, "_t"]).select(key, F.col("_next").alias("_t"))
        starts = cut_lineage(starts.unionByName(reached).distinct())
        found = starts.count()
        if found == known:
            break
        known = found
        hop = jumps.select(key, F.col("_t").alias("_next"), F.col("_next").alias("_far"))
        jumps = cut_lineage(jumps.join(hop, [key, "_next"]).select(key, "_t", F.col("_far").alias("_next")))
    # A call lies less than one bucket after its start, so the copied tail of a slice suffices.
    late = F.pmod(F.col("_t"), F.lit(width)) >= width - span
    marks = with_context(starts, late, 1).select(key, "_slice", "_t", F.col("_t").alias("_start"), F.lit(0).alias("_real"))
    calls = rows.withColumn("_slice", slice_of).withColumn("_real", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    upto = Window.partitionBy(key, "_slice").orderBy("_t", "_real").rowsBetween(Window.unboundedPreceding, 0)
    placed = calls.withColumn("_start", F.last("_start", ignorenulls=True).over(upto)).where("_real = 1")
    used = F.row_number().over(Window.partitionBy(key, "_start").orderBy("_t", tie))
    return placed.select(key, tie, F.timestamp_micros("_start").cast("timestamp_ntz").alias("bucket_start"), (used <= burst).alias("allowed"))


def sessions(events: DataFrame, gap: int = 1800, key: str = "user_id", ts: str = "ts", slices: int | None = None) -> DataFrame:
    """(key, start, end, events): activity separated by at least ``gap`` quiet seconds.

    A session begins where the event before is too far, and its number is a running sum of beginnings, so neither a key of
    many sessions nor a session of many events meets in one task.
    """
    span = gap * 1_000_000
    cut = ordered_slices(events.select(key, micros(ts).alias("_t")).withColumn("_at", F.col("_t")), [key], ["_t"], slices)
    fresh = F.coalesce(F.col("_t") - F.col("prev__at") >= span, F.lit(True))
    numbered = running_sum(previous(cut, [key], ["_t"], ["_at"]), [key], ["_t"], fresh.cast("bigint"), "_s")
    out = numbered.groupBy(key, "_s").agg(F.min("_t").alias("_a"), F.max("_t").alias("_b"), F.count(F.lit(1)).alias("events"))
    at = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    return out.select(key, at("_a").alias("start"), (at("_b") + F.expr(f"INTERVAL {int(gap)} SECONDS")).alias("end"), "events")


def sliding_metrics(samples: DataFrame, size: str = "1 hour", slide: str = "30 minutes", metric: str = "event_type", value: str = "value", ts: str = "ts") -> DataFrame:
    """Rolling mean, max and count per metric and window."""
    out = samples.groupBy(metric, F.window(ts, size, slide).alias("w")).agg(
        F.avg(value).alias("mean"), F.max(value).alias("max"), F.count(F.lit(1)).alias("samples")
    )
    return out.select(metric, F.col("w.start").alias("window_start"), "mean", "max", "samples")
