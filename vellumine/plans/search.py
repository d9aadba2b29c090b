"""Hybrid search over many queries."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine import settings as S
from vellumine.functions import rules as R
from vellumine.functions import tokens as K
from vellumine.functions import vectors as V
from vellumine.operators import knn as N
from vellumine.operators import retrieval as RT
from vellumine.operators import rewriting as W
from vellumine.session import cut_lineage


def stand_in(text: Column) -> Column:
    return V.hashed_text_vector(text)


def hybrid_search(
    chunks: DataFrame, queries: DataFrame, *, key: str = "doc_id", text: str = "text", encode: Callable[[Column], Column] = stand_in,
    stop: Sequence[str] = S.SEARCH_STOP_WORDS, intents=S.INTENT_RULES, synonyms=S.SYNONYMS, expand: bool = True,
    scorer: Callable[[Column, Column], Column] | None = None, threshold: float = S.INTENT_THRESHOLD, max_k: int = 15,
) -> DataFrame:
    """(query_id, key, score, rank) of the best chunks of every query.

    Intent sets each query's k; variants search by vector, the original also by BM25 and by its
    keywords' vector; lists are fused, optionally reranked, cut at the threshold and at k. Only
    ids and scores travel; texts are joined back to the short list.
    """
    asked = queries.select("query_id", "query").withColumn("intent", R.query_intent(F.col("query"), intents)["intent"])
    asked = cut_lineage(asked.withColumn("k", R.intent_top_k(F.col("intent"))))
    variants = W.expand_query(F.col("query"), F.col("intent"), synonyms, stop) if expand else F.array("query")
    rows = asked.select("query_id", F.posexplode(variants).alias("variant_no", "variant"))
    rows = cut_lineage(rows.withColumn("variant_id", F.concat_ws("#", F.col("query_id").cast("string"), F.col("variant_no").cast("string"))))
    vectors = cut_lineage(chunks.select(key, encode(F.col(text)).alias("embedding")))
    by_vector = N.knn(
        vectors, rows.select("variant_id", encode(F.col("variant")).alias("embedding")), 2 * max_k, "cosine", corpus_id=key, query_id="variant_id"
    ).withColumnRenamed("id", key)
    vector_list = cut_lineage(RT.variant_hits(by_vector, rows, key))
    terms = asked.select("query_id", K.core_keywords(F.col("query"), stop).alias("terms"))
    keyword_list = RT.bm25(chunks, terms, 2 * max_k, key=key, text=text, stop=stop)
    by_terms = N.knn(
        vectors, terms.select("query_id", encode(F.array_join("terms", " ")).alias("embedding")), 2 * max_k, "cosine", corpus_id=key
    ).where("score > 0").withColumnRenamed("id", key)
    keywords = RT.fuse_keyword_lists(keyword_list, by_terms, key)
    fused = cut_lineage(RT.fuse_weighted(vector_list, keywords, 2 * max_k, key=key))
    limits = asked.select("query_id", "k")
    if scorer is not None:
        texts = chunks.select(key, F.col(text).alias("content")).join(fused, key)
        ranked = RT.model_rerank(texts.join(asked.select("query_id", "query"), "query_id"), scorer, 2 * max_k, key=key)
        fused = ranked.select("query_id", key, F.col("rerank_score").alias("score"))
    kept = fused.where(F.col("score") >= threshold).join(limits, "query_id")
    return RT.threshold_top_k(kept, threshold, F.col("k"), key).select("query_id", key, "score", "rank")
