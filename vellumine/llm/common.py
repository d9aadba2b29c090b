"""Helpers shared by the operators of this subpackage.

Input conventions, unless an operator's docstring says more: a null text counts as the empty text, other columns of the
input may be null or missing, and columns that an operator doesn't name are ignored (so clashing extra columns do no
harm); repeated rows are separate rows; an empty table gives an empty result with the full schema.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Characters between words, and a run of others.
GAP = r"\x20\x09-\x0D"
WORD = rf"[^{GAP}]+"
#: Rows of one Arrow batch that a Python loop holds as objects.
SLICE_ROWS = 256
#: Rows of one batch that the JVM and a Python worker exchange.
BATCH_ROWS = 1024


def worker_state(name: str, build: Callable[[], Any]) -> Any:
    """Object kept for the life of one Python worker, across its tasks (tokenizers and their dictionaries)."""
    store = sys.modules.setdefault("_vellumine_worker", types.ModuleType("_vellumine_worker"))
    if not hasattr(store, name):
        setattr(store, name, build())
    return getattr(store, name)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, so that Python objects of few documents live at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return ["" if t is None else t for t in batch.column(name).to_pylist()]


def count_words(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def id_bucket(doc_id: Column, buckets: int) -> Column:
    """crc32 of the id as text, modulo ``buckets``; a null id is in bucket null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % buckets


def hash_sample(ids: DataFrame, group: str, sample: int) -> DataFrame:
    """Of the different (doc_id, group) pairs about ``sample`` of each group, chosen by a hash of the id; all pairs of a
    smaller group. Groups (labels, languages) are few: their sizes are broadcast. No task holds a group."""
    once = ids.select("doc_id", group).distinct()
    sizes = once.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    return once.join(F.broadcast(sizes), group).where(place * F.col("_n") < sample).select("doc_id", group)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` in batches of at most ``BATCH_ROWS`` rows (a session setting), as rows here are whole texts."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df.mapInArrow(fn, schema)
