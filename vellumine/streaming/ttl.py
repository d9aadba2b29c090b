"""A store of requests with a time to live, as state with event-time timers.

Each key holds the requests that the watermark hasn't passed yet, the moment of the last one that it has, and a timer. Requests
are answered in event-time order once the watermark says that no earlier one can come, so the stream gives what the batch form
gives, whatever micro-batches they came in. When nothing has asked for a key for its time to live, the entry expires and its
state goes. Rows later than the watermark are dropped by Spark before they reach the state.

Needs ``session.ROCKS_DB`` as state store.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vellumine.operators.logbook import micros
from vellumine.operators.scale import ordered_slices, previous

#: Rows that go to the state at once.
CHUNK = 512
EVENTS = "key {0}, at timestamp, id {1}, event string"


class _Store(StatefulProcessor):
    def __init__(self, ttl_ms: int, id_type: str):
        self.ttl, self.id_type = ttl_ms, id_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"t bigint, id {self.id_type}")
        self.last = handle.getValueState("last", "t bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first = None
        while part := [(r["t"], r["id"]) for r in islice(rows, CHUNK)]:
            first = min(part)[0] if first is None else min(first, min(part)[0])
            self.waiting.appendList(part)
        if first is not None:
            self.handle.registerTimer(first // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        ready, later = [], []
        for t, i in self.waiting.get() if self.waiting.exists() else ():
            (ready if t < passed else later).append((t, i))
        last = self.last.get()[0] if self.last.exists() else None
        out = []
        for t, i in sorted(ready):
            if last is not None and t - last >= self.ttl * 1000:
                out.append(self._row(key, last + self.ttl * 1000, None, "expired"))
                last = None
            out.append(self._row(key, t, i, "miss" if last is None else "hit"))
            last = t
        if ready:
            self.waiting.put(later) if later else self.waiting.clear()
        if last is not None and passed - last > self.ttl * 1000 and not (later and min(later)[0] - last < self.ttl * 1000):
            out.append(self._row(key, last + self.ttl * 1000, None, "expired"))
            last = None
        if last is None:
            self.last.clear()
        else:
            self.last.update((last,))
            self.handle.registerTimer(last // 1000 + self.ttl + 1)
        if later:
            self.handle.registerTimer(min(later)[0] // 1000 + 1)
        return iter(out)

    def _row(self, key, t: int, i, event: str) -> Row:
        return Row(key=key[0], t=t, id=i, event=event)

    def close(self) -> None:
        pass


def store_events(requests: DataFrame, key: str, ttl: int = 1800, ts: str = "ts", tie: str = "event_id", lateness: str = "10 minutes") -> DataFrame:
    """(key, at, id, event) of a stream: ``hit`` or ``miss`` for each request, and ``expired`` for each entry that nothing
    renewed for ``ttl`` seconds, with the moment of its expiry."""
    marked = requests.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)
    log = marked.select(F.col(key).alias("key"), F.col(ts).alias("at"), F.unix_micros(F.col(ts)).alias("t"), F.col(tie).alias("id"))
    kinds = {f.name: f.dataType.simpleString() for f in log.schema.fields}
    made = log.groupBy("key").transformWithState(
        statefulProcessor=_Store(ttl * 1000, kinds["id"]), outputStructType=f"key {kinds['key']}, t bigint, id {kinds['id']}, event string",
        outputMode="Append", timeMode="EventTime",
    )
    return made.select("key", F.timestamp_micros("t").cast("timestamp_ntz").alias("at"), "id", "event")


def batch_events(requests: DataFrame, key: str, ttl: int = 1800, ts: str = "ts", tie: str = "event_id", slices: int | None = None) -> DataFrame:
    """The same rows from a table; entries that are live at its end have not expired."""
    span = ttl * 1_000_000
    rows = requests.select(F.col(key).alias("key"), micros(ts).alias("_t"), F.col(tie).alias("id"))
    rows = previous(ordered_slices(rows, ["key"], ["_t", "id"], slices), ["key"], ["_t", "id"], ["_t"])
    hit = F.coalesce(F.col("_t") - F.col("prev__t") < span, F.lit(False))
    asked = rows.select("key", F.col("_t").alias("t"), "id", F.when(hit, "hit").otherwise("miss").alias("event"))
    gone = rows.where(F.col("_t") - F.col("prev__t") >= span).select(
        "key", (F.col("prev__t") + span).alias("t"), F.lit(None).cast(asked.schema["id"].dataType).alias("id"), F.lit("expired").alias("event")
    )
    return asked.unionByName(gone).select("key", F.timestamp_micros("t").cast("timestamp_ntz").alias("at"), "id", "event")
