"""Retrieval queries: benchmark items ask, documents answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumine.functions import tokens as K
from vellumine.functions.models import pair_scorer
from vellumine.operators import chunking as C
from vellumine.operators import context as O
from vellumine.operators import knn as N
from vellumine.operators import retrieval as RT
from vellumine.session import cut_lineage
from vellumine.workload.registry import lit, lits, query, rounded, table
from vellumine.workload.tokens import STOP, docs, sql_first_distinct, sql_search_tokens
from vellumine.workload.vectors import sql_text_vectors, text_vectors

TOP = 10


def questions(spark, sf):
    b = table(spark, sf, "benchmark")
    return b.select(F.col("item_id").alias("query_id"), "text", K.core_keywords(F.col("text"), STOP).alias("terms"))


def bm25_hits(spark, sf, k=TOP):
    return RT.bm25(docs(spark, sf), questions(spark, sf), k, stop=STOP)


_TERMS = sql_first_distinct("benchmark", "item_id", sql_search_tokens("text"), 5)
BM25_CTE = f"""
  toks AS (SELECT doc_id, {sql_search_tokens('text')} AS ts FROM documents),
  lens AS (SELECT doc_id, len(ts) AS dl FROM toks WHERE len(ts) > 0),
  tot AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lens),
  tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS term FROM toks) GROUP BY ALL),
  idf0 AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM tf, tot GROUP BY term, n),
  idf AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM idf0) ELSE idf END AS idf FROM idf0),
  qt AS (SELECT item_id AS query_id, unnest(kws) AS term FROM ({_TERMS})),
  bm25_all AS (SELECT query_id, doc_id, sum(idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score
    FROM qt JOIN idf USING (term) JOIN tf USING (term) JOIN lens USING (doc_id), tot GROUP BY query_id, doc_id),
  bm25 AS (SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank
    FROM bm25_all WHERE score > 0) WHERE rank <= {TOP})"""


def _big(df):
    return df.withColumn("rank", F.col("rank").cast("bigint"))


@query("bm25_topk", f"WITH {BM25_CTE} SELECT query_id, doc_id, rank, round(score, 5) AS score FROM bm25")
def _bm25(spark, sf):
    return _big(bm25_hits(spark, sf)).select("query_id", "doc_id", "rank", rounded("score", 5).alias("score"))


def vector_hits(spark, sf, k=TOP, by="text"):
    q = questions(spark, sf)
    if by == "terms":
        q = q.withColumn("text", F.array_join("terms", " "))
    corpus = text_vectors(docs(spark, sf), "doc_id", "text")
    hits = N.knn(corpus, text_vectors(q, "query_id", "text"), k, "cosine", corpus_id="doc_id")
    return hits.where("score > 0").withColumnRenamed("id", "doc_id")


VEC_CTE = f"""
  dv AS ({sql_text_vectors('documents', 'doc_id', 'text')}),
  qv AS (SELECT item_id AS query_id, v FROM ({sql_text_vectors('benchmark', 'item_id', 'text')})),
  vec AS (SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank
    FROM (SELECT query_id, doc_id, list_inner_product(dv.v, qv.v) AS score FROM dv, qv)) WHERE rank <= {TOP} AND score > 0)"""


@query("vector_search", f"WITH {VEC_CTE} SELECT query_id, doc_id, rank, round(score, 5) AS score FROM vec")
def _vector(spark, sf):
    return _big(vector_hits(spark, sf)).select("query_id", "doc_id", "rank", rounded("score", 5).alias("score"))


KWV_CTE = f"""
  dv AS ({sql_text_vectors('documents', 'doc_id', 'text')}),
  kw AS (SELECT item_id, array_to_string(kws, ' ') AS text FROM ({_TERMS})),
  qv AS (SELECT item_id AS query_id, v FROM ({sql_text_vectors('kw', 'item_id', 'text')})),
  vec AS (SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank
    FROM (SELECT query_id, doc_id, list_inner_product(dv.v, qv.v) AS score FROM dv, qv)) WHERE rank <= {TOP} AND score > 0)"""


@query("keyword_vector_search", f"WITH {KWV_CTE} SELECT query_id, doc_id, rank, round(score, 5) AS score FROM vec")
def _keyword_vector(spark, sf):
    return _big(vector_hits(spark, sf, by="terms")).select("query_id", "doc_id", "rank", rounded("score", 5).alias("score"))


# --- fusion -----------------------------------------------------------------------------------


def both(spark, sf):
    """The two hit lists, each at most TOP rows per query, computed once."""
    return cut_lineage(vector_hits(spark, sf)), cut_lineage(bm25_hits(spark, sf))


BOTH = f"WITH {BM25_CTE}, {VEC_CTE}"


@query("fuse_keyword_lists", f"{BOTH} SELECT query_id, doc_id, round(max(score), 5) AS score FROM (SELECT * FROM bm25 UNION ALL SELECT * FROM vec) GROUP BY ALL")
def _fuse_max(spark, sf):
    vec, kw = both(spark, sf)
    return RT.fuse_keyword_lists(kw, vec).select("query_id", "doc_id", rounded("score", 5).alias("score"))


FUSED = """SELECT query_id, doc_id, coalesce(v.score * 0.6::DOUBLE, 0) + coalesce(b.score * 0.4::DOUBLE, 0) AS score
           FROM vec v FULL JOIN bm25 b USING (query_id, doc_id)"""


def sql_ranked(inner: str, k: str, where: str = "true") -> str:
    return f"""SELECT query_id, doc_id, score, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM ({inner}) WHERE {where}) WHERE rank <= {k}"""


@query("hybrid_fusion", f"{BOTH} SELECT query_id, doc_id, rank, round(score, 5) AS score FROM ({sql_ranked(FUSED, '10')})")
def _hybrid(spark, sf):
    vec, kw = both(spark, sf)
    return _big(RT.fuse_weighted(vec, kw, 10)).select("query_id", "doc_id", "rank", rounded("score", 5).alias("score"))


_MINMAX = """SELECT query_id, doc_id, coalesce(v.score * 0.6::DOUBLE, 0) + coalesce(b.s * 0.4::DOUBLE, 0) AS score FROM vec v FULL JOIN (
    SELECT query_id, doc_id, CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1.0 END AS s FROM (
      SELECT *, min(score) OVER (PARTITION BY query_id) AS lo, max(score) OVER (PARTITION BY query_id) AS hi FROM bm25)) b USING (query_id, doc_id)"""


@query("hybrid_fusion_minmax", f"{BOTH} SELECT query_id, doc_id, rank, round(score, 5) AS score FROM ({sql_ranked(_MINMAX, '10')})")
def _hybrid_minmax(spark, sf):
    vec, kw = both(spark, sf)
    return _big(RT.fuse_weighted(vec, kw, 10, normalise="minmax")).select("query_id", "doc_id", "rank", rounded("score", 5).alias("score"))


@query("threshold_topk", f"{BOTH} SELECT query_id, doc_id, rank, round(score, 5) AS score FROM ({sql_ranked(FUSED, '5', 'score >= 2.0')})")
def _threshold(spark, sf):
    vec, kw = both(spark, sf)
    fused = RT.fuse_weighted(vec, kw, 10)
    return _big(RT.threshold_top_k(fused, 2.0, 5)).select("query_id", "doc_id", "rank", rounded("score", 5).alias("score"))


@query(
    "multi_way",
    f"""{BOTH} SELECT query_id, doc_id, arg_max(source, (score, source)) AS source, round(max(score), 5) AS score FROM (
        SELECT query_id, doc_id, score, 'vector' AS source FROM vec UNION ALL SELECT query_id, doc_id, score * 0.9::DOUBLE, 'hyde' FROM bm25) GROUP BY query_id, doc_id""",
)
def _multi(spark, sf):
    vec, kw = both(spark, sf)
    return RT.multi_way([("vector", vec, 1.0), ("hyde", kw, 0.9)]).select("query_id", "doc_id", "source", rounded("score", 5).alias("score"))


@query(
    "variant_hits",
    f"""WITH {BM25_CTE} SELECT query_id // 2 AS query_id, doc_id, round(max(score * CASE WHEN query_id % 2 = 0 THEN 1.0 ELSE 0.7 END::DOUBLE), 5) AS score
        FROM bm25 GROUP BY 1, 2""",
)
def _variants(spark, sf):
    # Pairs of items act as a query and its variant.
    q = questions(spark, sf).select(
        F.col("query_id").alias("variant_id"), F.floor(F.col("query_id") / 2).alias("query_id"), (F.col("query_id") % 2).alias("variant_no")
    )
    return RT.variant_hits(bm25_hits(spark, sf), q).select("query_id", "doc_id", rounded("score", 5).alias("score"))


def with_texts(spark, sf, hits):
    """Content and query text joined back to a short hit list."""
    d = table(spark, sf, "documents").select("doc_id", F.col("text").alias("content"))
    q = questions(spark, sf).select("query_id", F.col("text").alias("query"), "terms")
    return d.join(hits, "doc_id").join(q, "query_id")


@query(
    "blank_hits",
    """SELECT conv_id, turn, coalesce(name, 'Unknown') AS document_name FROM (
         SELECT conv_id, turn, CASE WHEN role <> 'system' THEN role END AS name, CASE WHEN turn % 3 = 0 THEN '  ' ELSE text END AS content FROM conversations)
       WHERE trim(content) <> ''""",
)
def _blank(spark, sf):
    c = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.when(F.col("role") != "system", F.col("role")).alias("document_name"),
        F.when(F.col("turn") % 3 == 0, "  ").otherwise(F.col("text")).alias("content"),
    )
    return RT.drop_blank_hits(c).select("conv_id", "turn", "document_name")


_BONUS_LODGING = (["the", "la"], ["with", "from", "por"], 0.05, 0.15)
_BONUS_LEVELS = [(["tion"], ["est", "nd"], 0.03, 0.1), (["que"], ["ada", "cion"], 0.03, 0.1)]
_BONUS_CITIES = [["heha", "esti"], ["mente", "ado"]]


def _sql_any(col, words):
    return "(" + " OR ".join(f"contains({col}, {lit(w)})" for w in words) + ")"


def _sql_count(col, words, step, cap):
    return f"least(({' + '.join(f'contains({col}, {lit(w)})::INT' for w in words)}) * {step}::DOUBLE, {cap}::DOUBLE)"


_RULE = f"""score * 0.4::DOUBLE + len(list_filter(kws, lambda k: contains(lower(content), lower(k)))) / len(kws) * 0.3::DOUBLE
   + CASE WHEN {_sql_any('query', _BONUS_LODGING[0])} THEN {_sql_count('content', *_BONUS_LODGING[1:])} ELSE 0 END
   + CASE {' '.join(f"WHEN {_sql_any('query', a)} AND {_sql_any('content', w)} THEN {_sql_count('content', w, s, c)}" for a, w, s, c in _BONUS_LEVELS)} ELSE 0 END
   + CASE WHEN {' OR '.join(f"({_sql_any('query', c)} AND {_sql_any('content', c)})" for c in _BONUS_CITIES)} THEN 0.05 ELSE 0 END"""


@query(
    "rule_rerank",
    f"""WITH {VEC_CTE}, kw AS ({_TERMS}) SELECT query_id, doc_id, new_rank, round(s, 5) AS rerank_score FROM (
          SELECT query_id, doc_id, s, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, rank, doc_id) AS new_rank FROM (
            SELECT vec.query_id, vec.doc_id, rank, {_RULE} AS s FROM vec
            JOIN (SELECT doc_id, text AS content FROM documents) d USING (doc_id)
            JOIN (SELECT item_id AS query_id, text AS query FROM benchmark) q USING (query_id)
            JOIN (SELECT item_id AS query_id, kws FROM kw) k USING (query_id)))""",
)
def _rules(spark, sf):
    hits = with_texts(spark, sf, cut_lineage(vector_hits(spark, sf)))
    score = RT.rule_score(
        F.col("score"), F.col("query"), F.col("content"), F.col("terms"), lodging=_BONUS_LODGING, levels=_BONUS_LEVELS, cities=_BONUS_CITIES
    )
    return RT.rule_rerank(hits, score, TOP).select(
        "query_id", "doc_id", F.col("new_rank").cast("bigint").alias("new_rank"), rounded("rerank_score", 5).alias("rerank_score")
    )


_SCORER = """len(list_filter(kws, lambda k: contains(left(content, 1000), k))) / len(kws)"""


def _keyword_share():
    """Stand-in model of the scorer hook: the share of the query's keywords that a content holds."""
    return lambda queries, contents: [
        sum(t in c for t in q.split("\n")) / len(q.split("\n")) if q else float("nan") for q, c in zip(queries, contents)
    ]


@query(
    "model_rerank",
    f"""WITH {VEC_CTE}, kw AS ({_TERMS}), scored AS (
          SELECT vec.query_id, vec.doc_id, rank, {_SCORER} AS s FROM vec
          JOIN (SELECT doc_id, text AS content FROM documents) d USING (doc_id)
          JOIN (SELECT item_id AS query_id, kws FROM kw) k USING (query_id)),
        r AS (SELECT *, s >= 0.6 AS selected, row_number() OVER (PARTITION BY query_id
            ORDER BY CASE WHEN s >= 0.6 THEN 0 ELSE 1 END, CASE WHEN s >= 0.6 THEN -round(s, 9) END, rank, doc_id) AS new_rank FROM scored)
        SELECT query_id, doc_id, new_rank, selected FROM r WHERE (selected AND new_rank <= 5) OR new_rank <= 5""",
)
def _model(spark, sf):
    hits = with_texts(spark, sf, cut_lineage(vector_hits(spark, sf)))
    asked = hits.withColumn("query", F.array_join("terms", "\n"))  # the stand-in scores keywords
    return RT.model_rerank(asked, pair_scorer(_keyword_share), 5, threshold=0.6).select(
        "query_id", "doc_id", F.col("new_rank").cast("bigint").alias("new_rank"), "selected"
    )


@query("no_rerank", f"WITH {BM25_CTE} SELECT query_id, doc_id, rank AS new_rank, 0.0::DOUBLE AS rerank_score FROM bm25")
def _none(spark, sf):
    return RT.no_rerank(bm25_hits(spark, sf)).select("query_id", "doc_id", F.col("new_rank").cast("bigint").alias("new_rank"), "rerank_score")


@query(
    "dynamic_k",
    f"""WITH {BM25_CTE}, t AS (SELECT query_id, CASE WHEN max(score) > 8 THEN 'high' WHEN max(score) > 5 THEN 'medium' ELSE 'low' END AS tier FROM bm25 GROUP BY 1)
        SELECT query_id, doc_id, rank, tier FROM bm25 JOIN t USING (query_id) WHERE rank <= CASE tier WHEN 'high' THEN 5 ELSE 10 END""",
)
def _dynamic(spark, sf):
    hits = cut_lineage(bm25_hits(spark, sf))
    best = F.max("score")
    tiers = hits.groupBy("query_id").agg(F.when(best > 8, "high").when(best > 5, "medium").otherwise("low").alias("tier"))
    return _big(RT.dynamic_k(hits, tiers)).select("query_id", "doc_id", "rank", "tier")


@query("chunks_with_content", "SELECT conv_id, turn FROM conversations WHERE role <> 'system' AND text IS NOT NULL")
def _all_chunks(spark, sf):
    return table(spark, sf, "conversations").where("role <> 'system' AND text IS NOT NULL").select("conv_id", "turn")


# --- chunks -----------------------------------------------------------------------------------


def fixed_chunks(spark, sf):
    """(chunk_id, doc_id, content): fixed windows with ids of text, as ingest writes them."""
    windows = docs(spark, sf).select("doc_id", F.posexplode(C.fixed_windows(F.col("text"))).alias("num", "w"))
    name = F.concat(F.col("doc_id").cast("string"), F.lit("_chunk_"), (F.floor(F.col("w.start") / 450) + 1).cast("string"))
    return windows.select(name.alias("chunk_id"), "doc_id", F.col("w.text").alias("content"))


CHUNK_CTE = f"""
  ch AS (SELECT doc_id || '_chunk_' || (s // 450 + 1) AS chunk_id, doc_id, content FROM (
    SELECT doc_id, s, substr(text, s + 1, 500) AS content FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 450)) AS s FROM documents))
    WHERE regexp_replace(content, '\\s+', '', 'g') <> ''),
  cv AS ({sql_text_vectors('ch', 'chunk_id', 'content')}),
  qv AS (SELECT item_id AS query_id, v FROM ({sql_text_vectors('benchmark', 'item_id', 'text')})),
  found AS (SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, chunk_id) AS rank
    FROM (SELECT query_id, chunk_id, list_inner_product(cv.v, qv.v) AS score FROM cv, qv)) WHERE rank <= {TOP} AND score > 0)"""


def chunk_hits(spark, sf):
    chunks = text_vectors(fixed_chunks(spark, sf), "chunk_id", "content")
    hits = N.knn(chunks, text_vectors(questions(spark, sf), "query_id", "text"), TOP, "cosine", corpus_id="chunk_id")
    return hits.where("score > 0").withColumnRenamed("id", "chunk_id")


@query("chunk_search", f"WITH {CHUNK_CTE} SELECT query_id, chunk_id, rank, round(score, 5) AS score FROM found")
def _chunk_search(spark, sf):
    return _big(chunk_hits(spark, sf)).select("query_id", "chunk_id", "rank", rounded("score", 5).alias("score"))


@query(
    "chunk_context",
    f"""WITH {CHUNK_CTE}, s AS (SELECT query_id, rank, '【参考文档' || rank || '】' || chr(10) || content || chr(10) AS seg FROM found JOIN ch USING (chunk_id)),
        c AS (SELECT *, sum(length(seg)) OVER (PARTITION BY query_id ORDER BY rank) AS total FROM s)
        SELECT query_id, count(*) FILTER (WHERE total <= 4000) AS used, string_agg(seg, chr(10) ORDER BY rank) FILTER (WHERE total <= 4000) AS context FROM c GROUP BY query_id""",
)
def _chunk_context(spark, sf):
    """Document, chunk, vector, hit, context: the whole way for every benchmark item."""
    return O.prefix_context(fixed_chunks(spark, sf).join(chunk_hits(spark, sf), "chunk_id"), 4000)
