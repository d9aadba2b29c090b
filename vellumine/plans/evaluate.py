"""Offline evaluation: a retrieval callback over cases, per-case metrics, reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine.functions.text import let
from vellumine.operators import metrics as M
from vellumine.session import cut_lineage

CASE_METRICS = ["precision_at_1", "precision_at_3", "precision_at_5", "recall_at_5", "f1_at_5", "mrr", "ndcg_at_5", "hit_rate", "topic_coverage"]


#: Words of the run that an item and a text must share before the text is searched for the item.
RUN = 3


def containing(items: DataFrame, texts: DataFrame, item: str = "query", text: str = "text", item_id: str = "query_id", key: str = "doc_id") -> DataFrame:
    """(item_id, key) of all texts that contain the whole item.

    An item's inner words (all but its first and last) stand whole in any text that holds it, between the same white space.
    A run of up to ``RUN`` of them is an equi-join key; the text itself then decides. Items of two words or fewer have no inner
    word and are searched for in every text. Null and empty items are in no text. Only keys travel with the runs, whose making
    is linear in a text's words; a text is met again by its key.
    """
    words = lambda c: F.filter(F.split(F.col(c), "\\s+"), lambda w: w != "")
    asked = items.select(F.col(item_id), F.col(item).alias("_item")).where(F.length("_item") > 0).withColumn("_w", words("_item"))
    inner = F.slice("_w", F.lit(2), F.least(F.lit(RUN), F.greatest(F.size("_w") - 2, F.lit(0))))
    asked = asked.select(item_id, "_item", F.array_join(inner, " ").alias("_run"), F.size(inner).alias("_n"))
    sizes = {r["_n"] for r in asked.select("_n").distinct().collect()}  # RUN + 1 of them at most
    held = texts.select(F.col(key), F.col(text).alias("_text")).where("_text IS NOT NULL")

    def runs(ws: Column) -> Column:
        """Runs of the items' lengths, each made of the shorter run before it and one more word; a slice for each would copy all words."""
        every, run = [], ws
        for n in range(1, max(sizes) + 1):
            if n > 1:
                # the last places have no such word: null there
                run = F.zip_with(run, F.slice(ws, n, F.greatest(F.size(ws), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
            if n in sizes:
                every.append(run)
        return F.array_distinct(F.concat(*every))

    found = held.join(asked.where("_n = 0"), F.contains("_text", "_item")).select(item_id, key)
    if sizes - {0}:
        met = held.select(F.col(key).alias("_key"), F.explode_outer(let(words("_text"), runs)).alias("_run")).where("_run IS NOT NULL")
        met = met.join(asked.where("_n > 0"), "_run").select("_key", item_id, "_item")
        holds = F.col("_key").eqNullSafe(F.col(key)) & F.contains("_text", "_item")
        found = found.unionByName(met.join(held, holds).select(item_id, key))
    return found.distinct()


def evaluate_cases(cases: DataFrame, retrieve: Callable[[DataFrame], DataFrame], truth: DataFrame, contents: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row of metrics per case.

    ``cases`` has query_id, query, category, difficulty, expected_keywords and expected_topics;
    ``retrieve`` maps it to hits (query_id, key, score, rank); ``contents`` gives each key's text.
    """
    hits = cut_lineage(retrieve(cases))
    ranks = M.rank_metrics(hits, truth, cases, mrr_cap=5, key=key)
    top5 = contents.join(hits.where("rank <= 5"), key)
    text = top5.groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda r: r["content"]), " ").alias("_text")
    )
    rows = cases.join(ranks, "query_id").join(text, "query_id", "left")
    body = F.coalesce("_text", F.lit(""))
    p, r = F.col("precision_at_5"), F.col("recall_at_5")
    return rows.select(
        "query_id", "category", "difficulty", "precision_at_1", "precision_at_3", "precision_at_5", "recall_at_5",
        F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1_at_5"), "mrr", F.col("ndcg_graded").alias("ndcg_at_5"),
        M.keyword_hits(F.col("expected_keywords"), body)["hit_rate"].alias("hit_rate"),
        M.topic_coverage(F.col("expected_topics"), body)["coverage_rate"].alias("topic_coverage"),
    )


def evaluation_report(per_case: DataFrame) -> DataFrame:
    return M.grouped_report(per_case, CASE_METRICS, ["topic_coverage"])


def variant_deltas(baseline: DataFrame, variant: DataFrame) -> DataFrame:
    """Baseline against variant, per mean metric."""
    side = lambda df: df.agg(*[F.avg(m).alias(m) for m in CASE_METRICS]).unpivot([], CASE_METRICS, "metric", "value")
    return M.ab_table(side(baseline), side(variant))
