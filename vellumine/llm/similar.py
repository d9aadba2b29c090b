"""Near copies by Jaccard similarity of word shingles.

Shingles: a text is lower-cased (A-Z), its words ``[^\\x20\\x09-\\x0D]+`` form shingles of ``words_per_shingle`` (fewer words:
the whole sequence); a text is the set of their 64-bit hashes. Two texts are near copies if the Jaccard similarity of their
sets is ``least`` or more.

Candidates, first: texts whose SimHash fingerprints (``simhash``, as the operator of that name makes and links them) differ in at
most ``RADIUS`` bits. Many pairs of this similarity differ in more bits, so further candidates are found by ``BANDS`` bands of ``BAND_ROWS`` least hashes each. Texts that share a band are candidates; at similarity 0.8 a
pair shares none with a probability of (1 - 0.8 ** 4) ** 32 = 5e-8, and less above. Each member of a band is linked to the
band's smallest, so a crowded band makes no pairs. Candidate components only say which texts are compared.

Comparison: inside a candidate component, texts whose sets differ in size by more than a factor 1.26 can't reach 0.8, so a
component falls into overlapping windows of two size classes. A window is one row with its texts; one of more than
``CHUNK_ROWS`` texts or ``CHUNK_BYTES`` is dealt into chunks, and every pair of chunks is one row. In a row, exact similarities
give spanning links. Nothing is capped and no pairs become rows. Components of these links are the near copies.

Defined cases: a null text is the empty text; texts without words are copies of each other; rows that repeat an id are
nodes of their own text, told apart by their 64-bit hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine.llm.common import map_arrow, sliced, texts_of
from vellumine.llm.simhash import LOWER, SEED, components, fingerprint
from vellumine.llm.simhash import links as simhash_links
from vellumine.session import cut_lineage

BANDS = 32
BAND_ROWS = 4
#: Words of a shingle, and differing bits, of the SimHash candidates.
SIMHASH_WORDS, RADIUS = 3, 3
#: Hashes that meet all least-hash functions at once.
BLOCK = 2048
#: Texts and bytes of one chunk of a window.
CHUNK_ROWS = 256
CHUNK_BYTES = 1 << 20
PRIME = np.uint64(0x9E3779B185EBCA87)


def shingles(text: str, words_per_shingle: int) -> np.ndarray:
    """Distinct hashes of the text's shingles, in order; never empty."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()  # bytes split at \x20 \x09-\x0D only
    digest = xxhash.xxh64_intdigest
    if len(words) < words_per_shingle:
        return np.array([digest(b" ".join(words), SEED)], np.uint64)
    each = np.fromiter((digest(w, SEED) for w in words), np.uint64, len(words))
    n = len(words) - words_per_shingle + 1
    out = np.zeros(n, np.uint64)
    for i in range(words_per_shingle):
        out = (out ^ (out >> np.uint64(31))) * PRIME + each[i : i + n]
    out = (out ^ (out >> np.uint64(32))) * PRIME
    return np.unique(out ^ (out >> np.uint64(29)))


def factors() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    n = BANDS * BAND_ROWS
    return rng.integers(0, 2**63, (n, 1), np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, (n, 1), np.uint64)


def band_keys(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One signed 64-bit key per band; the band's number is part of it."""
    least = np.full(len(a), 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), BLOCK):
        np.minimum(least, (hashes[at : at + BLOCK] * a + b).min(1), out=least)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for part in least.reshape(BANDS, BAND_ROWS).T:
        keys = (keys ^ (keys >> np.uint64(31))) * PRIME + part
    return (keys ^ (keys >> np.uint64(32))).view(np.int64)


def node_of(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def sketches(docs: DataFrame, words_per_shingle: int) -> DataFrame:
    """doc_id, node, ``n`` distinct shingles, ``bytes`` of the text, its SimHash ``fp`` and its ``bands``."""
    kind = docs.select("doc_id").schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = factors()
        for batch in sliced(batches):
            sizes, keys, prints = [], [], []
            for text in texts_of(batch):
                hashes = shingles(text, words_per_shingle)
                sizes.append(len(hashes))
                keys.append(band_keys(hashes, a, b))
                prints.append(fingerprint(text, SIMHASH_WORDS))
            flat = pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64))
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("node"), pa.array(sizes, pa.int64()), batch.column("bytes"), pa.array(np.array(prints, np.uint64).view(np.int64)), bands],
                names=["doc_id", "node", "n", "bytes", "fp", "bands"],
            )

    text = F.col("text").cast("string")
    rows = docs.select("doc_id", node_of(F.col("text")).alias("node"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"), text.alias("text"))
    return map_arrow(rows, run, f"doc_id {kind}, node long, n long, bytes long, fp long, bands array<long>")


def spanning_links(nodes: list[int], sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links (larger, smaller) that join the texts of ``least`` similarity or more as all their pairs would."""
    sizes = np.array([len(s) for s in sets])
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    words, ids = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(words), np.int64)
    left = np.ones(len(sets), bool)
    out = []
    for root in range(len(sets)):
        if not left[root]:
            continue
        left[root] = False
        front = [root]
        while front and left.any():
            at = front.pop()
            own = ids[starts[at] : starts[at] + sizes[at]]
            mark[own] = 1
            both = np.add.reduceat(mark[ids], starts)
            mark[own] = 0
            near = np.flatnonzero(left & (both >= least * (sizes + sizes[at] - both)))
            left[near] = False
            front.extend(near.tolist())
            out += [(max(nodes[at], nodes[x]), min(nodes[at], nodes[x])) for x in near.tolist()]
    return out


def simhash_candidates(nodes: DataFrame) -> DataFrame:
    """Links (u > v) that connect the nodes whose fingerprints ``fp`` lie within the radius: each node to the smallest node of its
    fingerprint, and those along the links of the SimHash operator."""
    heads = cut_lineage(nodes.groupBy("fp").agg(F.min("node").alias("head")))
    same = nodes.select("node", "fp").join(heads, "fp").where("node > head").select(F.col("node").alias("u"), F.col("head").alias("v"))
    near = simhash_links(heads.select("fp"), RADIUS)
    named = lambda end, out: heads.select(F.col("fp").alias(end), F.col("head").alias(out))
    met = near.join(named("u", "a"), "u").join(named("v", "b"), "v").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    return same.unionByName(met)


def links(docs: DataFrame, known: DataFrame, words_per_shingle: int, least: float) -> DataFrame:
    """Distinct links (u > v) that connect all texts of ``least`` similarity or more; ``known`` are the texts' sketches."""
    nodes = known.groupBy("node").agg(F.any_value("n").alias("n"), F.any_value("bytes").alias("bytes"), F.any_value("fp").alias("fp"), F.any_value("bands").alias("bands"))
    keyed = nodes.select("node", F.explode("bands").alias("key"))
    heads = keyed.groupBy("key").agg(F.min("node").alias("v"), F.max("node").alias("last")).where("v < last").select("key", "v")
    shared = keyed.join(heads, "key").where("node > v").select(F.col("node").alias("u"), "v")
    met = cut_lineage(simhash_candidates(nodes).unionByName(shared).distinct())
    groups = components(met).select(F.col("fp").alias("node"), F.col("root").alias("group"))
    step = math.log(1.01 / least)
    size_class = F.floor(F.log("n") / step)
    placed = cut_lineage(
        nodes.select("node", "n", "bytes").join(groups, "node")
        .select("node", "bytes", "group", F.explode(F.array(size_class - 1, size_class)).alias("window"))
    )
    windows = placed.groupBy("group", "window").agg(F.count(F.lit(1)).alias("rows"), F.sum("bytes").alias("held")).where("rows > 1")
    windows = windows.select("group", "window", F.greatest(F.ceil(F.col("rows") / CHUNK_ROWS), F.ceil(F.col("held") / CHUNK_BYTES), F.lit(1)).cast("int").alias("chunks"))
    own = F.pmod(F.xxhash64("node", "window"), F.col("chunks").cast("long")).cast("int")
    dealt = (
        placed.join(windows, ["group", "window"])
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("node", "group", "window", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    )
    wanted = placed.select("node").distinct()
    texts = docs.select(node_of(F.col("text")).alias("node"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.join(wanted, "node", "left_semi").groupBy("node").agg(F.any_value("text").alias("text"))
    held = dealt.join(texts, "node").groupBy("group", "window", "i", "j").agg(F.collect_list("node").alias("nodes"), F.collect_list("text").alias("texts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for names, words in zip(batch.column("nodes"), batch.column("texts")):
                sets = [shingles(t, words_per_shingle) for t in words.as_py()]
                found = np.array(spanning_links(names.as_py(), sets, least), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["u", "v"])

    return cut_lineage(map_arrow(held.select("nodes", "texts"), run, "u long, v long").distinct())


def near_copies(docs: DataFrame, words_per_shingle: int = 5, least: float = 0.8) -> DataFrame:
    """One row per document: doc_id, ``node`` of its text, ``root`` of its component."""
    known = cut_lineage(sketches(docs, words_per_shingle))
    roots = components(links(docs, known, words_per_shingle, least)).select(F.col("fp").alias("node"), "root")
    return known.select("doc_id", "node").join(roots, "node", "left").select("doc_id", "node", F.coalesce("root", "node").alias("root"))


def first_of_each(docs: DataFrame, words_per_shingle: int = 5, least: float = 0.8) -> DataFrame:
    """The document with the smallest id of each component, with the input's columns; documents with a null id stay."""
    found = cut_lineage(near_copies(docs, words_per_shingle, least))
    kept = found.groupBy("root").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct()
    ids = docs.join(kept, "doc_id", "left_semi")
    return ids.unionByName(docs.where(F.col("doc_id").isNull())).select(*docs.columns)
