"""Document fingerprints: quartile bucket digests.

Three byte triplets of every four-byte window are hashed to ``BUCKETS`` counts. The digest codes each bucket by the quartile
its count falls in (two bits), after a header with the length on a logarithmic scale and the ratios of the quartiles.
The difference of two digests is bounded: per bucket the distance of the codes (three counts as six), plus the header's
distances, each with a ceiling. Likeness is one minus the difference's share of its bound. Fewer than four bytes make no
window: all counts are zero, and the header alone tells such texts apart.

Neighbours: documents are range-partitioned by id and sorted; a task meets each document's next one as it reads on. What a
task can't see, the first document after its last, is joined from one row per partition. Texts are shuffled once.

Defined cases: a null text is empty; null ids come first; rows that repeat an id are in order of their text; in a table
of one document the next document is itself; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from vellumine.llm.common import map_arrow, sliced
from vellumine.session import cut_lineage

BUCKETS = 512
#: Offsets of the two bytes that stand with the newest one in a triplet.
PAIRS = ((1, 2), (1, 3), (2, 3))
WINDOW = 4
SPAN = 1 << 20
LENGTH_STEP = 1.1
LENGTH_MOST, RATIO_MOST = 24, 8
CODE_COST = np.array([0, 1, 2, 6])


def tables() -> np.ndarray:
    """For each place in a triplet, a fixed number for each byte."""
    x = np.arange(1, 3 * 256 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(48)).astype(np.uint16).reshape(3, 256)


TABLES = tables()


def bucket_counts(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    counts = np.zeros(BUCKETS, np.int64)
    for start in range(0, max(0, len(raw) - WINDOW + 1), SPAN):
        part = raw[start : start + SPAN + WINDOW - 1]
        top = WINDOW - 1
        n = len(part) - top
        newest, near, far = (t[part] for t in TABLES)
        for k, (i, j) in enumerate(PAIRS):
            mixed = newest[top:] ^ near[top - i : top - i + n] ^ far[top - j : top - j + n] ^ np.uint16(k * 0x1F35 & 0xFFFF)
            counts += np.bincount(mixed & np.uint16(BUCKETS - 1), minlength=BUCKETS)
    return counts


def fingerprint(text: str) -> str:
    """Header (length, two ratios; four hex digits) and two bits per bucket, in hex."""
    data = text.encode("utf-8")
    counts = bucket_counts(data)
    q1, q2, q3 = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]].tolist()
    length = min(255, round(math.log(len(data) + 1, LENGTH_STEP)))
    ratios = [16 * q // (q3 + 1) for q in (q1, q2)]
    codes = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    packed = (codes[0::4] << 6 | codes[1::4] << 4 | codes[2::4] << 2 | codes[3::4]).astype(np.uint8)
    return bytes([length, ratios[0] << 4 | ratios[1]]).hex() + packed.tobytes().hex()


def unpack(digest: str) -> tuple[int, int, int, np.ndarray]:
    raw = bytes.fromhex(digest)
    packed = np.frombuffer(raw, np.uint8, offset=2)
    return raw[0], raw[1] >> 4, raw[1] & 15, np.stack([packed >> s & 3 for s in (6, 4, 2, 0)], 1).ravel().astype(np.int8)


def likeness(a: str, b: str) -> float:
    """One minus the bounded difference's share of its bound: 1 for equal digests, 0 for the greatest difference."""
    (la, pa_, qa, ca), (lb, pb, qb, cb) = unpack(a), unpack(b)
    difference = int(CODE_COST[np.abs(ca - cb)].sum()) + min(LENGTH_MOST, abs(la - lb))
    difference += min(RATIO_MOST, abs(pa_ - pb)) + min(RATIO_MOST, abs(qa - qb))
    return 1 - difference / (int(CODE_COST[3]) * BUCKETS + LENGTH_MOST + 2 * RATIO_MOST)


def edited(text: str, after: str) -> str:
    """The text, its last half replaced by as many characters of the start of the next one."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def digests(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    kind = docs.select("doc_id").schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keys = [F.col("doc_id").asc_nulls_first(), F.col("_hash")]
    rows = rows.withColumn("_hash", F.xxhash64("text"))
    ranged = rows.repartitionByRange(partitions, *keys) if partitions else rows.repartitionByRange(*keys)
    ordered = ranged.sortWithinPartitions(*keys, "text").select("doc_id", "text", F.spark_partition_id().alias("part"))
    shown = ["n_chars long", "edited_sha256 string", "fingerprint string", "edited_fingerprint string", "near_edited double", "near_next double"]
    names = [s.split()[0] for s in shown]

    def result(text: str, own: str, after: str, other: str) -> tuple:
        new = edited(text, after)
        own_new = fingerprint(new)
        digest = hashlib.sha256(new.encode("utf-8")).hexdigest()
        return len(text), digest, own, own_new, likeness(own, own_new), likeness(own, other)

    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def made(parts: list, ids: list, id_type: pa.DataType, values: list[tuple], texts: list | None, roles: list | None) -> pa.RecordBatch:
        arrays = [pa.array(ids, id_type), *[pa.array([v[i] for v in values], t) for i, t in enumerate(types)]]
        extra = [] if texts is None else [pa.array(parts, pa.int32()), pa.array(roles, pa.int32()), pa.array(texts, pa.string())]
        return pa.RecordBatch.from_arrays(arrays + extra, names=["doc_id", *names] + ([] if texts is None else ["part", "role", "text"]))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Results of all documents but a partition's last; its first (role 1) and last (role 2) document as they are."""
        last, part, blank = None, 0, (None,) * 6
        for batch in sliced(batches, 64):
            part, id_type = batch.column("part")[0].as_py(), batch.schema.field("doc_id").type
            ids, values = [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                own = fingerprint(text)
                if last is None:
                    yield made([part], [doc_id], id_type, [blank], [text], [1])
                else:
                    ids.append(last[0])
                    values.append(result(last[1], last[2], text, own))
                last = (doc_id, text, own)
            yield made([part] * len(ids), ids, id_type, values, [None] * len(ids), [0] * len(ids))
        if last is not None:
            yield made([part], [last[0]], id_type, [blank], [last[1]], [2])

    walked = cut_lineage(map_arrow(ordered, walk, f"doc_id {kind}, {', '.join(shown)}, part int, role int, text string"))
    order = Window.orderBy("part")  # one row per partition, without the texts
    parts = walked.where("role = 1").select("part")
    following = parts.select(
        F.col("part"), F.coalesce(F.lead("part").over(order), F.min("part").over(order.rowsBetween(Window.unboundedPreceding, 0))).alias("_next")
    )
    heads = walked.where("role = 1").select(F.col("part").alias("_next"), F.col("text").alias("after"))
    ends = walked.where("role = 2").select("doc_id", "text", "part").join(following, "part").join(heads, "_next")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 64):
            pairs = zip(batch.column("text").to_pylist(), batch.column("after").to_pylist())
            values = [result(t, fingerprint(t), a, fingerprint(a)) for t, a in pairs]
            yield made([], batch.column("doc_id").to_pylist(), batch.schema.field("doc_id").type, values, None, None)

    last_rows = map_arrow(ends.select("doc_id", "text", "after"), finish, f"doc_id {kind}, {', '.join(shown)}")
    return walked.where("role = 0").select("doc_id", *names).unionByName(last_rows)
