"""Streaming forms of the log rules. Watermarks bound state: a key's state goes when its last event is too old to matter."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vellumine import settings as S
from vellumine.operators.scale import small_table


def _watermarked(events: DataFrame, ts: str, lateness: str) -> DataFrame:
    """Watermarks need an instant; times without a zone are read in the session's."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)


def tumbling_limits(events: DataFrame, seconds: int = 60, burst: int = 10, key: str = "user_id", ts: str = "ts", lateness: str = "10 minutes") -> DataFrame:
    """Calls per key and fixed bucket over the burst."""
    out = _watermarked(events, ts, lateness).groupBy(key, F.window(ts, f"{seconds} seconds").alias("w")).agg(F.count(F.lit(1)).alias("calls"))
    return out.select(key, F.col("w.start").cast("timestamp_ntz").alias("bucket"), "calls", F.greatest(F.col("calls") - burst, F.lit(0)).alias("rejected"))


def metric_windows(events: DataFrame, size: str = "24 hours", slide: str = "12 hours", metric: str = "event_type", value: str = "value", ts: str = "ts", lateness: str = "1 hour") -> DataFrame:
    out = _watermarked(events, ts, lateness).groupBy(metric, F.window(ts, size, slide).alias("w")).agg(
        F.avg(value).alias("mean"), F.max(value).alias("max"), F.count(F.lit(1)).alias("samples")
    )
    return out.select(metric, F.col("w.start").cast("timestamp_ntz").alias("window_start"), "mean", "max", "samples")


def alerts(events: DataFrame, limits: Mapping[str, float] = S.ALERT_LIMITS, metric: str = "event_type", value: str = "value") -> DataFrame:
    """Samples over their limit: a stream joined to a literal table."""
    table = small_table(events.sparkSession, list(limits.items()), f"{metric} string, threshold double")
    return events.join(table, metric).where(F.col(value) > F.col("threshold"))


def sessions(events: DataFrame, gap: str = "30 minutes", key: str = "user_id", ts: str = "ts", lateness: str = "1 hour") -> DataFrame:
    out = _watermarked(events, ts, lateness).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return out.select(key, F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), "events")


def _keyed_log(events: DataFrame, key: str, ts: str, tie: str, lateness: str) -> DataFrame:
    t = F.unix_micros(F.col(ts))
    return _watermarked(events, ts, lateness).select(F.col(key).alias("key"), F.col(tie).alias("id"), F.col(ts).alias("at"), t.alias("t"))


def _stateful(
    log: DataFrame, span: int, out: str, held: str, step: Callable[[np.ndarray, tuple | None], tuple[dict, tuple]]
) -> DataFrame:
    """Runs ``step(times in order, state)`` for each key and micro-batch; gives (key, id) and the step's columns.

    Events of a key meet in time order within a micro-batch. State goes once the watermark has passed the key's last event by
    ``span``, when it can no longer matter.
    """
    kinds = {f.name: f.dataType.simpleString() for f in log.schema.fields}

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        frames = [b for b in batches if len(b)]
        if not frames:
            return
        new = pd.concat(frames).sort_values(["t", "id"])
        columns, kept = step(new["t"].to_numpy(), tuple(state.get) if state.exists else None)
        state.update(kept)
        state.setTimeoutTimestamp(max((int(new["t"].iloc[-1]) + span) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": [k[0]] * len(new), "id": new["id"].to_numpy(), **columns})

    return log.groupBy("key").applyInPandasWithState(
        run, f"key {kinds['key']}, id {kinds['id']}, {out}", held, "append", GroupStateTimeout.EventTimeTimeout
    )


def rate_limits(
    events: DataFrame, period: int, max_calls: int, key: str = "user_id", ts: str = "ts", tie: str = "event_id", lateness: str = "10 minutes"
) -> DataFrame:
    """(key, id, calls, limited): sliding log per key. State keeps only the last ``period`` of calls."""
    span = period * 1_000_000

    def step(times: np.ndarray, state: tuple | None) -> tuple[dict, tuple]:
        before = np.array(state[0] if state else [], np.int64)
        every = np.sort(np.concatenate([before, times]))
        # Equal times count as they come: an event sees those placed before it and itself.
        place = np.searchsorted(every, times, "left") + np.arange(len(times)) - np.searchsorted(times, times, "left") + 1
        place += np.searchsorted(before, times, "right") - np.searchsorted(before, times, "left")
        calls = place - np.searchsorted(every, times - span, "left")
        held = every[np.searchsorted(every, times[-1] - span, "left") :]
        return {"calls": calls, "limited": calls > max_calls}, (held.tolist(),)

    return _stateful(_keyed_log(events, key, ts, tie, lateness), span, "calls bigint, limited boolean", "held array<bigint>", step)


def lockouts(events: DataFrame, failure: Column, attempts: int = 5, period: int = 900, **names) -> DataFrame:
    return rate_limits(events.where(failure), period, attempts - 1, **names).where("limited")


def token_buckets(
    events: DataFrame, seconds: int = 60, burst: int = 10, key: str = "user_id", ts: str = "ts", tie: str = "event_id", lateness: str = "10 minutes"
) -> DataFrame:
    """(key, id, allowed): bucket opened by a key's first request; state is its start and use."""
    span = seconds * 1_000_000

    def step(times: np.ndarray, state: tuple | None) -> tuple[dict, tuple]:
        start, used = state or (None, 0)
        allowed = np.zeros(len(times), bool)
        at = 0
        while at < len(times):  # one turn per bucket
            if start is None or times[at] - start >= span:
                start, used = int(times[at]), 0
            end = int(np.searchsorted(times, start + span, "left"))
            allowed[at : at + max(0, burst - used)] = True
            allowed[end:] = False
            used += end - at
            at = end
        return {"allowed": allowed}, (start, used)

    return _stateful(_keyed_log(events, key, ts, tie, lateness), span, "allowed boolean", "start bigint, used bigint", step)


def reuse_hits(requests: DataFrame, key: str, ttl: int = 1800, ts: str = "ts", tie: str = "event_id", lateness: str = "10 minutes") -> DataFrame:
    """(key, id, hit): a request within ``ttl`` of the previous one with its key. One timestamp of state per key."""
    span = ttl * 1_000_000

    def step(times: np.ndarray, state: tuple | None) -> tuple[dict, tuple]:
        before = np.concatenate([[state[0] if state else times[0] - span], times[:-1]])
        return {"hit": times - before < span}, (int(times[-1]),)

    return _stateful(_keyed_log(requests, key, ts, tie, lateness), span, "hit boolean", "last bigint", step)
