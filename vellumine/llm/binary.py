"""Token ids as binary shards with Elias-Fano coded document boundaries.

A shard holds the ids of consecutive documents, one array without gaps, and the positions at which documents end. The
positions are an Elias-Fano sequence: the low ``l = floor(log2(ids / documents))`` bits of each are packed, the high parts
are a bit array with one set bit per document, so a boundary costs about ``2 + l`` bits and no table of 64-bit offsets
exists. ``select(i)`` finds the i-th set bit from a directory that holds the place of every ``SAMPLE``-th one.

File format (little-endian), one ``payload`` per shard, in a Parquet table (part, first, n_ids, doc_ids, payload) which Spark
writes, so that a retried task or a lost executor leaves whole files and any store that Spark writes to will do:

    magic ``EFT1`` | bytes per id (2 or 4) u8 | low bits l u8 | reserved u16 | documents u64 | ids u64
    | bytes of high bits u64 | high bits | directory u32 per SAMPLE documents | low bits | ids

Order: documents are range-partitioned by id and sorted; a partition's documents fill shards of about ``shard_ids`` ids.
``first`` counts the ids before a shard in its partition; one row per partition is summed to place them in the whole.

Defined cases: a null or empty text is its end id alone; null document ids come first; rows that repeat an id follow each
other by text; an empty table gives an empty table of shards.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from vellumine.llm.bpe import encoder
from vellumine.llm.common import map_arrow, sliced, texts_of

MAGIC = b"EFT1"
SAMPLE = 256
#: Words that a worker's dictionary holds before it starts a new one (about 200 bytes each, twice).
WORDS = 700_000
HEAD = "<4sBBHQQQ"


class EliasFano:
    """Non-decreasing numbers ``ends`` with a given last value; ``select(i)`` gives the i-th."""

    def __init__(self, n: int, low_bits: int, high: np.ndarray, directory: np.ndarray, low: np.ndarray):
        self.n, self.low_bits, self.high, self.directory, self.low = n, low_bits, high, directory, low

    @classmethod
    def build(cls, ends: np.ndarray) -> EliasFano:
        ends = np.asarray(ends, np.uint64)
        n, last = len(ends), int(ends[-1]) if len(ends) else 0
        low_bits = max(0, (last // n).bit_length() - 1) if n else 0
        ones = (ends >> np.uint64(low_bits)) + np.arange(n, dtype=np.uint64)
        high = np.zeros((int(ones[-1]) // 8 + 1) if n else 0, np.uint8)
        np.bitwise_or.at(high, (ones >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (ones & np.uint64(7)).astype(np.uint8)))
        bits = (ends[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        return cls(n, low_bits, high, ones[::SAMPLE].astype(np.uint32), low)

    def select(self, i: int) -> int:
        """The i-th number, from the directory's nearest place before it."""
        at = int(self.directory[i // SAMPLE])
        rest = i % SAMPLE
        byte, skip = at // 8, at % 8
        window = int(self.high[byte]) >> skip << skip
        while (here := window.bit_count()) <= rest:
            rest -= here
            byte += 1
            window = int(self.high[byte])
        for _ in range(rest):
            window &= window - 1
        place = byte * 8 + (window & -window).bit_length() - 1
        start, value = i * self.low_bits, 0
        if self.low_bits:
            first, stop = start // 8, (start + self.low_bits + 7) // 8
            value = int.from_bytes(self.low[first:stop].tobytes(), "little") >> start % 8 & (1 << self.low_bits) - 1
        return place - i << self.low_bits | value

    def all(self) -> np.ndarray:
        """All numbers in order."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        value = np.zeros(self.n, np.int64)
        if self.low_bits:
            bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
            value = bits.astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))
        return (ones - np.arange(self.n) << self.low_bits) | value


def pack(documents: list[bytes]) -> bytes:
    """A shard's payload from each document's ids (little-endian unsigned 32-bit)."""
    sizes = np.array([len(d) // 4 for d in documents], np.uint64)
    ends = EliasFano.build(np.cumsum(sizes))
    ids = np.frombuffer(b"".join(documents), "<u4")
    wide = 4 if len(ids) and int(ids.max()) >= 1 << 16 else 2
    head = struct.pack(HEAD, MAGIC, wide, ends.low_bits, 0, ends.n, len(ids), len(ends.high))
    return b"".join([head, ends.high.tobytes(), ends.directory.astype("<u4").tobytes(), ends.low.tobytes(), ids.astype(f"<u{wide}").tobytes()])


class Shard:
    """Reads a payload; ``document(i)`` gives the ids of one document through two selects."""

    def __init__(self, payload: bytes):
        magic, wide, low_bits, _, n, total, high_bytes = struct.unpack_from(HEAD, payload)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = struct.calcsize(HEAD)
        high = np.frombuffer(payload, np.uint8, high_bytes, at)
        at += high_bytes
        marks = -(-n // SAMPLE)
        directory = np.frombuffer(payload, "<u4", marks, at)
        at += 4 * marks
        low_bytes = -(-n * low_bits // 8)
        low = np.frombuffer(payload, np.uint8, low_bytes, at)
        self.ends = EliasFano(n, low_bits, high, directory, low)
        self.ids = np.frombuffer(payload, f"<u{wide}", total, at + low_bytes)

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]


def write_shards(docs: DataFrame, path: str, folder: str, end_id: int = 0, shard_ids: int = 1 << 20, partitions: int | None = None) -> None:
    """Encodes every text, appends ``end_id`` and writes shards in ascending id order to ``folder``."""
    kind = docs.select("doc_id").schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keys = [F.col("doc_id").asc_nulls_first(), F.col("_hash")]
    rows = rows.withColumn("_hash", F.xxhash64("text"))
    ranged = rows.repartitionByRange(partitions, *keys) if partitions else rows.repartitionByRange(*keys)
    ordered = ranged.sortWithinPartitions(*keys).select("doc_id", "text", F.spark_partition_id().alias("part"))
    last = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, "words", WORDS)
        ids, documents, held, before = [], [], 0, 0

        def shard(part: int) -> pa.RecordBatch:
            made = {
                "part": pa.array([part], pa.int32()), "first": pa.array([before], pa.int64()),
                "n_ids": pa.array([held // 4], pa.int64()), "doc_ids": pa.array([ids], pa.list_(id_type)),
                "payload": pa.array([pack(documents)], pa.binary()),
            }
            return pa.RecordBatch.from_arrays([*made.values()], names=[*made])

        part, id_type = 0, None
        for batch in sliced(batches):
            id_type = batch.schema.field("doc_id").type
            part = batch.column("part")[0].as_py()
            for doc_id, coded in zip(batch.column("doc_id").to_pylist(), e.encode(texts_of(batch))):
                ids.append(doc_id)
                documents.append(coded + last)
                held += len(documents[-1])
                if held >= 4 * shard_ids:
                    yield shard(part)
                    ids, documents, held, before = [], [], 0, before + held // 4
        if documents:
            yield shard(part)

    shards = map_arrow(ordered, run, f"part int, first long, n_ids long, doc_ids array<{kind}>, payload binary")
    shards.write.mode("overwrite").option("compression", "uncompressed").parquet(folder)


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Per document of the shards: doc_id, ``start`` (ids of all documents before it), n_tokens, and CRC-32 of its ids."""
    shards = spark.read.parquet(folder)
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))  # one row per partition of the writer
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("part").alias("_p"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("_before"))
    rows = shards.join(F.broadcast(parts), F.col("part") == F.col("_p")).withColumn("start", F.col("_before") + F.col("first"))
    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            shard = Shard(batch.column("payload")[0].as_py())
            base, end, rows = batch.column("start")[0].as_py(), 0, []
            for i in range(shard.ends.n):
                start, end = end, shard.ends.select(i)
                rows.append((base + start, end - start, zlib.crc32(shard.ids[start:end].astype("<u4"))))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_ids").flatten(), *[pa.array([r[k] for r in rows], pa.int64()) for k in range(3)]],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return map_arrow(rows.select("doc_ids", "payload", "start"), run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")
