"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

1. Every source has a target: its weight's share of ``share`` times all words, at most ``max_repeats`` times its own
   words, the excess reshared by weight until no target is above (a water level, found from one row per source).
2. A source's documents are dealt to shards by a hash of id and text and laid end to end; every ``block`` words are one block
   (a shard's last block may be shorter). Blocks are numbers, never rows.
3. Sainte-Lague gives all blocks of the mix to sources by highest quotients ``votes / (2 k + 1)``; then each source's
   blocks to its shards in the same way. A shard's quota never exceeds ``max_repeats`` times its blocks.
4. In a shard of ``n`` blocks with quota ``q``, every block is taken ``q // n`` times and ``q % n`` blocks once more:
   those whose place under a seeded affine permutation of ``0..n-1`` is below ``q % n``. The same seed gives the same mix.

Scale: words are counted in one scan into a table of (id, source, words); windows run inside shards, whose number grows
with the source's documents, so a source with a third of all rows is many shards. A shard has ``SHARD_ROWS`` documents up to
2 ** 20 of a source; beyond, shards and documents of a shard both grow as their number's square root, without a ceiling, as
one task deals blocks to all shards of a source. The driver holds one row per source (at most ``MAX_SOURCES``, else an error).

Defined cases: null and empty texts have size 0 and are taken 0 times; a null source is a source of its own, last in
order; rows that repeat an id are separate documents; an empty table or one without words takes nothing.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from vellumine.llm.common import WORD, count_words
from vellumine.session import cut_lineage

MAX_SOURCES = 100_000
SHARD_ROWS = 256


def shards_of(documents: int) -> int:
    """Both branches give 4 096 at 2 ** 20 documents."""
    return math.ceil(documents / SHARD_ROWS) if documents <= 1 << 20 else math.ceil(4 * math.sqrt(documents))


def water_level(sizes: Sequence[float], weights: Sequence[float], total: float, cap: float) -> list[float]:
    """``min(cap * size, level * weight)`` with the level at which the targets add up to ``total``."""
    caps = [cap * s for s in sizes]
    targets = [0.0] * len(caps)
    left, weight = float(total), float(sum(weights))
    order = sorted(range(len(caps)), key=lambda i: caps[i] / weights[i])
    for at, i in enumerate(order):
        if left * weights[i] / weight <= caps[i]:
            for j in order[at:]:
                targets[j] = left * weights[j] / weight
            break
        targets[i] = caps[i]
        left -= caps[i]
        weight -= weights[i]
    return targets


def sainte_lague(votes: Sequence[float], seats: int, caps: Sequence[int]) -> list[int]:
    """Seats by highest quotients ``v / (2 k + 1)``, at most ``caps`` each; ties go to the earlier party.

    Quotients above a divisor are counted at once; only the last ones are dealt one by one.
    """
    v, c = np.asarray(votes, float), np.asarray(caps, np.int64)
    seats = int(min(seats, c[v > 0].sum()))
    if seats <= 0:
        return [0] * len(v)

    def at(divisor: float) -> np.ndarray:  # seats whose quotient v / (2 k + 1) is at least the divisor
        return np.minimum(c, np.floor((v / divisor + 1) / 2)).astype(np.int64)

    low, high = 0.0, 2 * float(v.max())
    for _ in range(200):
        middle = (low + high) / 2
        if middle in (low, high):
            break
        low, high = (middle, high) if at(middle).sum() > seats else (low, middle)
    given = at(high)
    queue = [(-v[i] / (2 * given[i] + 1), i) for i in range(len(v)) if v[i] > 0 and given[i] < c[i]]
    heapq.heapify(queue)
    for _ in range(seats - int(given.sum())):
        _, i = heapq.heappop(queue)
        given[i] += 1
        if given[i] < c[i]:
            heapq.heappush(queue, (-v[i] / (2 * given[i] + 1), i))
    return [int(x) for x in given]


def source_targets(sources: DataFrame, weights: Sequence[float], share: float, cap: float) -> list[tuple]:
    """Driver-side table (source, words, target, documents) from one row per source."""
    rows = sources.orderBy(F.col("source").asc_nulls_last()).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sizes = [r["words"] for r in rows]
    targets = water_level(sizes, [weights[i % len(weights)] for i in range(len(rows))], share * sum(sizes), cap)
    return [(r["source"], r["words"], float(t), r["docs"]) for r, t in zip(rows, targets)]


def mix_plan(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, max_repeats: int = 2, block: int = 16, seed: int = 42
) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, and the mix: ``_start`` (its first word in its shard),
    ``_passes`` (times every block is taken), ``_extra`` (blocks taken once more), ``_blocks``, ``_a``, ``_b``."""
    spark = docs.sparkSession
    sized = docs.select(
        F.col("doc_id"), F.col("source").cast("string").alias("source"), count_words(F.col("text")).alias("size"),
        F.xxhash64("doc_id", "text").alias("_row"),
    )
    sized = cut_lineage(sized)
    table = source_targets(
        sized.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("docs")), weights, share, max_repeats
    )
    schema = "source string, source_size long, target double, _shards int"
    known = spark.createDataFrame([(s, w, t, shards_of(n)) for s, w, t, n in table], schema)
    dealt = sized.join(F.broadcast(known), sized["source"].eqNullSafe(known["source"])).drop(known["source"])
    dealt = dealt.withColumn("_shard", F.pmod(F.xxhash64(F.lit(seed), "_row"), "_shards").cast("int"))
    shards = dealt.groupBy("source", "_shard").agg(F.sum("size").alias("words")).withColumn(
        "blocks", F.ceil(F.col("words") / block).cast("long")
    )
    shards = cut_lineage(shards)
    blocks = {r["source"]: r["blocks"] for r in shards.groupBy("source").agg(F.sum("blocks").alias("blocks")).collect()}
    votes = [t * blocks[s] / w if w else 0.0 for s, w, t, _ in table]
    seats = sainte_lague(votes, round(sum(votes)), [max_repeats * blocks[s] for s, *_ in table])
    quotas = spark.createDataFrame([(s, q) for (s, *_), q in zip(table, seats)], "source string, quota long")
    asked = shards.join(F.broadcast(quotas), shards["source"].eqNullSafe(quotas["source"])).drop(quotas["source"])

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_shard")
        n = pdf["blocks"].tolist()
        given = sainte_lague(n, int(pdf["quota"].iloc[0]) if len(pdf) else 0, [max_repeats * x for x in n])
        rows = []
        for source, shard, size, quota in zip(pdf["source"], pdf["_shard"], n, given):
            rng = np.random.default_rng([seed, int(shard), *(source.encode() if isinstance(source, str) else b"")])
            shift, step = (int(rng.integers(size)), int(rng.integers(size))) if size else (0, 0)
            while size and math.gcd(step, size) != 1:
                step = (step + 1) % size if size > 1 else 1
            rows.append((source, shard, size, quota // size if size else 0, quota % size if size else 0, step, shift))
        return pd.DataFrame(rows, columns=["source", "_shard", "_blocks", "_passes", "_extra", "_a", "_b"])

    drawn = asked.groupBy("source").applyInPandas(
        deal, "source string, _shard int, _blocks long, _passes long, _extra long, _a long, _b long"
    )
    order = Window.partitionBy("source", "_shard").orderBy("doc_id", "_row", "size")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("_start", F.coalesce(F.sum("size").over(before), F.lit(0)))
    drawn = drawn.withColumnRenamed("source", "_source").withColumnRenamed("_shard", "_s")
    out = placed.join(drawn, placed["source"].eqNullSafe(drawn["_source"]) & (placed["_shard"] == drawn["_s"]))
    return out.select("doc_id", "_row", "source", "size", "source_size", "target", *["_start", "_blocks", "_passes", "_extra", "_a", "_b"], F.lit(block).alias("_block"))


def chosen(position: Column) -> Column:
    """Whether the block that holds a word of the shard is among the extra ones."""
    number = F.floor(position / F.col("_block")).cast("long")
    return F.pmod(F.col("_a") * number + F.col("_b"), F.col("_blocks")) < F.col("_extra")


def taken_words() -> Column:
    """Words taken of a document: whole passes, and its overlap with each extra block."""
    first = F.floor(F.col("_start") / F.col("_block")).cast("long")
    last = F.floor((F.col("_start") + F.col("size") - 1) / F.col("_block")).cast("long")
    end = F.col("_start") + F.col("size")

    def overlap(total: Column, number: Column) -> Column:
        low = F.greatest(number * F.col("_block"), F.col("_start"))
        high = F.least((number + 1) * F.col("_block"), end)
        return total + F.when(chosen(number * F.col("_block")), high - low).otherwise(0)

    extra = F.when(
        (F.col("size") > 0) & (F.col("_extra") > 0), F.aggregate(F.sequence(first, last), F.lit(0).cast("long"), overlap)
    ).otherwise(0)
    return F.col("_passes") * F.col("size") + extra


def mix_sources(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, source, size, source_size, target and ``taken``, the words of the document in the mix, repeats counted."""
    return mix_plan(docs, **settings).select(
        "doc_id", "source", "size", "source_size", "target", taken_words().cast("long").alias("taken")
    )


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The mix as documents with the input's columns: the text is repeated for each whole pass, followed by the words of
    its extra blocks, passes apart by one newline; documents of which nothing is taken go. ``n_chars`` follows the text."""
    plan = mix_plan(docs, **settings).withColumnRenamed("doc_id", "_id").drop("source", "source_size", "target")
    plan = plan.dropDuplicates(["_id", "_row"])  # equal rows share one plan row each; the join below gives all of them
    rows = docs.withColumn("_key", F.xxhash64("doc_id", "text"))
    both = rows.join(plan, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_row")))
    words = F.regexp_extract_all(F.col("text"), F.lit(f"({WORD})"), 1)
    extra = F.array_join(F.filter(words, lambda _, i: chosen(F.col("_start") + i)), " ")
    parts = F.concat(
        F.array_repeat(F.col("text"), F.col("_passes").cast("int")),
        F.when(F.col("_extra") > 0, F.filter(F.array(extra), lambda t: t != "")).otherwise(F.array().cast("array<string>")),
    )
    mixed = both.where(F.col("size") > 0).withColumn("_parts", parts).where(F.size("_parts") > 0)
    mixed = mixed.withColumn("text", F.array_join("_parts", "\n"))
    if "n_chars" in docs.columns:
        mixed = mixed.withColumn("n_chars", F.length("text").cast("long"))
    return mixed.select(*docs.columns)
