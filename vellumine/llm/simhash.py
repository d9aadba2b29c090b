"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints: a text is lower-cased (A-Z), its words ``[^\\x20\\x09-\\x0D]+`` form shingles (fewer words than a shingle: the
whole sequence), each shingle's XXH64 votes for 64 bits; a bit is set if more than half the votes set it.

Links: fingerprints that differ in at most ``radius`` bits. Each bit position carries a vector of ``radius + 1`` bits;
table ``v`` (every non-zero vector) keeps the positions whose vector has odd product with ``v``. ``radius`` differing
positions never span the whole space, so some ``v`` is even on all of them and that table keeps none of them: every pair
within the radius agrees on the kept bits of some table. Each table keeps about half of the bits.

Only different fingerprints are looked at (copies are one row), and only keys met by two of them. A bucket of up to
``bucket_rows`` fingerprints is one row whose spanning links come from one matrix of bit counts, so no pairs become rows.
A larger bucket is covered again on the bits that its key has not fixed, until it fits; as its members differ only in bits
that are left, ``2 ** bits left`` bounds its size, so this ends. Nothing is capped.

Components: alternating large-star and small-star steps over the links, each written to the shared checkpoint folder.

Defined cases: a null text or one without words has fingerprint zero and links like any other; rows that repeat an id are
nodes of their own text; null ids take part but never name a component, unless no other id is there (then null).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumine.llm.common import map_arrow, sliced, texts_of
from vellumine.session import cut_lineage

BITS = 64
SEED = 42
BUCKET_ROWS = 1024
#: Shingles whose bits are counted at once.
VOTES = 65_536
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str, words_per_shingle: int) -> int:
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()  # bytes split at \x20 \x09-\x0D only
    if not words:
        return 0
    n = max(1, len(words) - words_per_shingle + 1)
    if len(words) < words_per_shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(words_per_shingle))))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles), np.uint64, n)
    votes = np.zeros(BITS, np.int64)
    for at in range(0, n, VOTES):
        part = hashes[at : at + VOTES].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * votes > n).tolist())


def with_fingerprint(docs: DataFrame, words_per_shingle: int = 3) -> DataFrame:
    """doc_id and the signed 64-bit ``fp``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            prints = [fingerprint(t, words_per_shingle) for t in texts_of(batch)]
            signed = np.array(prints, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(signed)], names=["doc_id", "fp"])

    kind = docs.select("doc_id").schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", F.col("text").cast("string").alias("text")), run, f"doc_id {kind}, fp long")


def covering_masks(free: int, radius: int) -> list[int]:
    """Masks over the set bits of ``free``: the bits that each table keeps."""
    places = [i for i in range(BITS) if free >> i & 1]
    turn = sorted(range(1, 2 ** (radius + 1)), key=lambda x: (x.bit_count(), x))  # unit vectors first: no mask is empty
    vectors = [turn[k % len(turn)] for k in range(len(places))]
    masks = []
    for v in range(1, 2 ** (radius + 1)):
        masks.append(sum(1 << p for p, x in zip(places, vectors) if (x & v).bit_count() % 2))
    return masks


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def spanning_links(prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (larger, smaller) that join the fingerprints within the radius as all their pairs would."""
    prints = np.unique(prints)
    left = np.ones(len(prints), bool)
    high, low = [], []
    for root in range(len(prints)):
        if not left[root]:
            continue
        left[root] = False
        front = [root]
        while front:
            at = front.pop()
            rest = np.flatnonzero(left)
            near = rest[np.bitwise_count((prints[rest] ^ prints[at]).view(np.uint64)) <= radius]
            left[near] = False
            front.extend(near.tolist())
            high += [max(prints[at], prints[x]) for x in near]
            low += [min(prints[at], prints[x]) for x in near]
    return np.array(high, np.int64), np.array(low, np.int64)


def links(prints: DataFrame, radius: int = 3, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Distinct links (u > v) that connect all fingerprints ``fp`` (distinct) within the radius."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for members in batch.column("fps"):
                high, low = spanning_links(members.values.to_numpy(zero_copy_only=False).astype(np.int64), radius)
                yield pa.RecordBatch.from_arrays([pa.array(high), pa.array(low)], names=["u", "v"])

    tables = F.array(*[F.struct(F.lit(i).alias("t"), F.lit(signed(m)).alias("m")) for i, m in enumerate(covering_masks(2**BITS - 1, radius))])
    bucket_rows = max(bucket_rows, 2**radius)
    keyed = prints.select("fp", F.explode(tables).alias("t")).select(
        "fp", F.col("t.t").cast("long").alias("path"), F.col("t.m").alias("mask"), F.col("fp").bitwiseAND(F.col("t.m")).alias("key")
    )
    found = None
    while True:
        keys = ["path", "mask", "key"]
        sizes = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        met = cut_lineage(keyed.join(sizes, keys))
        fits = met.where(F.col("n") <= bucket_rows).groupBy(*keys).agg(F.collect_list("fp").alias("fps"))
        step = map_arrow(fits.select("fps"), run, "u long, v long")
        found = step if found is None else found.unionByName(step)
        crowded = met.where(F.col("n") > bucket_rows)
        masks = [r["mask"] for r in crowded.select("mask").distinct().collect()]  # one value per table
        if not masks:
            return cut_lineage(found.distinct())
        next_tables = F.create_map(
            *[
                x
                for m in masks
                for x in (
                    F.lit(m),
                    F.array(*[F.struct(F.lit(i).alias("t"), F.lit(signed(k | (m & (2**64 - 1)))).alias("m")) for i, k in enumerate(covering_masks(~m & (2**64 - 1), radius))]),
                )
            ]
        )
        keyed = crowded.select("fp", "path", F.explode(next_tables[F.col("mask")]).alias("t")).select(
            "fp", ((F.col("path") + 1) * 2 ** (radius + 1) + F.col("t.t")).alias("path"), F.col("t.m").alias("mask"),
            F.col("fp").bitwiseAND(F.col("t.m")).alias("key"),
        )


def components(edges: DataFrame) -> DataFrame:
    """Nodes of the links with ``root``, the smallest node that they reach."""
    star = edges.select("u", "v")
    before = None
    while True:
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = cut_lineage(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        state = star.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return star.select(F.col("u").alias("fp"), F.col("v").alias("root")).unionByName(
        star.select(F.col("v").alias("fp"), F.col("v").alias("root")).distinct()
    )


def near_duplicates(docs: DataFrame, words_per_shingle: int = 3, radius: int = 3, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per document: doc_id, ``fingerprint`` (16 hex digits), ``component_id`` (smallest doc_id of its component)."""
    prints = cut_lineage(with_fingerprint(docs, words_per_shingle))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = cut_lineage(components(links(nodes.select("fp"), radius, bucket_rows)))
    classes = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    named = cut_lineage(classes.join(ids, "root").select("fp", "component_id"))
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return prints.join(named, "fp").select("doc_id", shown, "component_id")


def first_of_each(docs: DataFrame, **settings) -> DataFrame:
    """The document of each component that names it, with the input's columns; documents with a null id stay."""
    kept = near_duplicates(docs, **settings).where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    ids = docs.join(kept, "doc_id", "left_semi")
    return ids.unionByName(docs.where(F.col("doc_id").isNull())).select(*docs.columns)
