"""Answer checks (claims, support, citations, topic) and the retrieval quality gate."""

from __future__ import annotations

from collections.abc import Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumine import settings as S
from vellumine.functions import tokens as K
from vellumine.functions.text import char_class, let, strip

CITATION = "\\[(\\d+(?:[-,\\s]*\\d+)*)\\]"
SUPPORT_THRESHOLD = 0.6


# --- claims ---------------------------------------------------------------------------------


def claims(answer: Column, marks: str = S.SENTENCE_MARKS, min_chars: int = 10) -> Column:
    """Sentences longer than ``min_chars`` that do not start with a citation."""
    sentences = F.transform(F.split(answer, f"[{char_class(marks)}]+"), strip)
    return F.filter(sentences, lambda s: (F.length(s) > min_chars) & ~s.rlike("^\\[\\d+\\]"))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-block character similarity of the pair."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)])


def edit_similarity(a: Column, b: Column) -> Column:
    """JVM-side alternative: 1 - edit distance / longer length."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, 1 - F.levenshtein(a, b) / longest).otherwise(0.0)


def claim_support(
    answers: DataFrame, keys: Sequence[str], *, answer: str = "answer", chunks: str = "chunks",
    marks: str = S.SENTENCE_MARKS, threshold: float = SUPPORT_THRESHOLD, stop: Sequence[str] = S.CHECK_STOP_WORDS,
    characters: str = "edit",
) -> DataFrame:
    """One row per claim with its best supporting context chunk.

    ``chunks`` is the answer's own short context list (at most its top-k), carried in the row, so
    a claim meets only its own context. ``characters`` picks ``edit`` (JVM) or ``sequence``.
    """
    # Keywords of a chunk are made once per answer, before claims multiply its rows; those of a claim once per claim.
    words = lambda t: F.array_distinct(K.check_keywords(t, stop))
    shown = F.transform(F.transform(chunks, lambda c: F.coalesce(c, F.lit(""))), lambda c: F.struct(c.alias("text"), words(c).alias("words")))
    rows = answers.select(*keys, claims(F.col(answer), marks).alias("_claims"), F.when(F.size(chunks) > 0, shown).alias("_chunks"))
    rows = rows.select(*keys, F.posexplode("_claims").alias("claim_no", "claim"), "_chunks")
    rows = rows.select(*keys, "claim_no", "claim", words(F.col("claim")).alias("_words"), F.coalesce("_chunks", F.array(F.struct(F.lit("").alias("text"), F.array().cast("array<string>").alias("words")))).alias("_chunks"))
    if characters == "edit":
        best = rows.select(*keys, "claim_no", _best_chunk(F.col("claim"), F.col("_words"), F.col("_chunks")).alias("_b")).select(
            *keys, "claim_no", F.col("_b.score").alias("similarity"), F.col("_b.at").alias("_at")
        )
    else:
        pairs = rows.select(*keys, "claim_no", "claim", "_words", F.posexplode("_chunks").alias("chunk_no", "_c"))
        score = sequence_ratio(F.col("claim"), F.col("_c.text")) * 0.4 + K.jaccard(F.col("_words"), F.col("_c.words")) * 0.6
        best = pairs.withColumn("score", score).groupBy(*keys, "claim_no").agg(
            F.max("score").alias("similarity"), F.max_by("chunk_no", F.struct("score", -F.col("chunk_no"))).alias("_at")
        )
    return best.select(
        *keys, "claim_no", "similarity", (F.col("similarity") >= threshold).alias("found"),
        F.when(F.col("similarity") > 0, F.concat(F.lit("片段"), F.col("_at") + 1)).alias("source"),
    )


def _best_chunk(claim: Column, words: Column, chunks: Column) -> Column:
    """struct(score, at) of the first best chunk. The edit distance is taken only where the other part of the score and the
    lengths (which bound it) leave room above the best so far."""

    def step(acc: Column, c: Column, i: Column) -> Column:
        longest, shortest = F.greatest(F.length(claim), F.length(c["text"])), F.least(F.length(claim), F.length(c["text"]))
        room = F.when(longest > 0, shortest / longest).otherwise(0.0) * 0.4

        def judged(rest: Column) -> Column:
            full = let(edit_similarity(claim, c["text"]) * 0.4 + rest, lambda x: F.when(x > acc["score"], F.struct(x.alias("score"), i.alias("at"))).otherwise(acc))
            return F.when(room + rest + 1e-9 > acc["score"], full).otherwise(acc)

        return let(K.jaccard(words, c["words"]) * 0.6, judged)

    start = F.struct(F.lit(-1.0).alias("score"), F.lit(0).alias("at"))
    placed = F.transform(chunks, lambda c, i: F.struct(c.alias("c"), i.alias("i")))
    return F.aggregate(placed, start, lambda acc, p: step(acc, p["c"], p["i"]))


def answer_validity(support: DataFrame, keys: Sequence[str], threshold: float = SUPPORT_THRESHOLD) -> DataFrame:
    """Share of supported claims, validity and hallucination flag per answer."""
    out = support.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("claims"), F.count_if("found").alias("supported"),
        F.bool_or(F.col("similarity") < threshold).alias("hallucination"),
    )
    return out.withColumn("confidence", F.col("supported") / F.col("claims")).withColumn("is_valid", F.col("confidence") >= threshold)


def citation_check(answer: Column, n_chunks: Column) -> Column:
    """struct(total, valid, invalid) of the citations ``[1]``, ``[2,3]``, ``[1-3]`` in an answer."""

    def numbers(c: Column) -> Column:
        bare = F.replace(c, F.lit(" "), F.lit(""))
        ends = F.split(bare, "-")
        low, high = F.get(ends, F.lit(0)).try_cast("bigint"), F.get(ends, F.lit(1)).try_cast("bigint")
        whole = (F.size(ends) == 2) & (low <= high)
        inside = F.greatest(F.least(high, n_chunks.cast("bigint")) - F.greatest(low, F.lit(1)) + 1, F.lit(0))
        listed = F.filter(F.transform(F.split(bare, ","), lambda x: x.try_cast("bigint")), lambda x: x.isNotNull())
        valid = F.size(F.filter(listed, lambda x: x.between(1, n_chunks))).cast("bigint")
        ranged = F.contains(bare, F.lit("-"))
        # A range is counted by its bounds, so its length costs nothing.
        return F.struct(
            F.when(ranged, F.when(whole, inside).otherwise(0)).otherwise(valid).alias("valid"),
            F.when(ranged, F.when(whole, high - low + 1).otherwise(0)).otherwise(F.size(listed)).cast("bigint").alias("cited"),
        )

    def count(found: Column) -> Column:
        zero = F.struct(F.lit(0).cast("bigint").alias("valid"), F.lit(0).cast("bigint").alias("cited"))
        sums = F.aggregate(
            F.transform(found, numbers), zero,
            lambda acc, x: F.struct((acc["valid"] + x["valid"]).alias("valid"), (acc["cited"] + x["cited"]).alias("cited")),
        )
        return let(
            sums,
            lambda x: F.struct(F.size(found).alias("total"), x["valid"].alias("valid"), (x["cited"] - x["valid"]).alias("invalid")),
        )

    return let(F.regexp_extract_all(answer, F.lit(CITATION), 1), count)


def is_off_topic(answer: Column, query: Column, context: Column, stop: Sequence[str] = S.CHECK_STOP_WORDS) -> Column:
    a, q, c = (K.check_keywords(t, stop) for t in (answer, query, context))
    return (F.size(q) > 0) & (K.overlap_share(q, a) < 0.1) & (K.overlap_share(a, c) < 0.2)


# --- quality gate ---------------------------------------------------------------------------


#: Hits of a query whose content the gate reads.
GATE_CONTENTS = 10


def gate_rows(hits: DataFrame, *, stop: Sequence[str] = S.GATE_STOP_WORDS, temporal: Column | None = None, dated: Column | None = None, keep: Sequence[Column | str] = ()) -> DataFrame:
    """What the gate needs of each hit, without its text; ``keep`` are further columns."""
    words = lambda c: F.array_distinct(K.word_keywords(F.col(c), stop))
    asked, shown = words("query"), words("content")
    return hits.select(
        "query_id", "rank", "score", "source",
        F.size(asked).alias("_asked"), F.size(shown).alias("_shown"),
        F.size(F.array_intersect(asked, shown)).alias("_shared"),
        (F.lit(0.5) if dated is None else F.when(dated, 0.8).otherwise(0.5)).alias("_recency"),
        (F.lit(False) if temporal is None else temporal).alias("_temporal"), *keep,
    )


def gate_scores(hits: DataFrame, *, stop: Sequence[str] = S.GATE_STOP_WORDS, temporal: Column | None = None, dated: Column | None = None, normalise: str = "count") -> DataFrame:
    """Five quality scores, overall and tier per query.

    ``hits`` has query_id, rank, score, source, content and query. Source diversity divides the
    entropy by the number of sources, or by its log with ``normalise="log2"``.
    """
    return scored_rows(gate_rows(hits, stop=stop, temporal=temporal, dated=dated), normalise)


def scored_rows(rows: DataFrame, normalise: str = "count") -> DataFrame:
    """``gate_scores`` of ``gate_rows``; hits after ``GATE_CONTENTS`` only count by score and source."""
    top10, top5 = F.col("rank") <= GATE_CONTENTS, F.col("rank") <= 5
    cover = F.avg(F.when(top10 & (F.col("_shown") > 0) & (F.col("_asked") > 0), F.col("_shared") / F.col("_asked")))
    base = rows.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("_asked").alias("_asked"), cover.alias("_cover"),
        F.avg(F.when(top10, (F.col("score") > 0.5).cast("double"))).alias("_high"), F.avg(F.when(top10, F.col("score"))).alias("_mean"),
        F.avg("_recency").alias("_recency"), F.bool_or("_temporal").alias("_temporal"), F.var_pop(F.when(top5, F.col("score"))).alias("_variance"),
    )
    per_source = rows.groupBy("query_id", "source").agg(F.count(F.lit(1)).alias("c"))
    # sum(-p log p) from per-source counts: log n - sum(c log c) / n.
    entropy = per_source.groupBy("query_id").agg(
        F.sum("c").alias("_n"), F.count(F.lit(1)).alias("_sources"), F.sum(F.col("c") * F.log2("c")).alias("_clogc")
    )
    h = F.log2("_n") - F.col("_clogc") / F.col("_n")
    scale = F.col("_sources") if normalise == "count" else F.greatest(F.log2("_sources"), F.lit(1e-12))
    recency = F.when(F.col("_temporal"), F.least(F.col("_recency") * 1.2, F.lit(1.0))).otherwise(F.col("_recency"))
    scored = base.join(entropy, "query_id").select(
        "query_id", "n",
        F.when(F.col("_asked") == 0, 0.5).otherwise(F.least(F.coalesce("_cover", F.lit(0.0)) * 2, F.lit(1.0))).alias("relevance"),
        F.when(F.col("n") < 2, 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), h / scale + 0.5))).alias("diversity"),
        (F.col("_high") * 0.6 + F.col("_mean") * 0.4).alias("confidence"),
        recency.alias("recency"),
        F.when(F.col("n") < 2, 0.8).when(F.col("_variance") < 0.01, 0.9).when(F.col("_variance") < 0.05, 0.7).otherwise(0.5).alias("consistency"),
    )
    overall = sum((F.col(name) * w for name, w in S.GATE_WEIGHTS.items()), F.lit(0.0))
    return scored.withColumn("overall", overall)


def gate_tier(overall: Column, threshold: float = 0.6) -> Column:
    return F.when(overall >= 0.8, "high").when(overall >= threshold, "medium").otherwise("low")


def repair_feedback(n: Column, relevance: Column, diversity: Column, recency: Column) -> Column:
    """struct(action, issues, strategy) for a query whose results are weak."""
    issues = F.array_compact(
        F.array(
            F.when(relevance < 0.3, "relevance_coverage_low"), F.when(diversity < 0.3, "diversity_low"),
            F.when(recency < 0.3, "recency_low"), F.when(n == 0, "no_results"),
        )
    )
    strategy = (
        F.when(n == 0, "expand_query").when(relevance < 0.3, "synonym_expansion").when(diversity < 0.3, "diversity_rerank").otherwise("broaden_filters")
    )
    return F.struct(
        F.when((n == 0) | (F.size(issues) >= 3), "clarify").otherwise("retry").alias("action"), issues.alias("issues"), strategy.alias("strategy")
    )
