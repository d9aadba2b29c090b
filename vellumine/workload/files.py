"""Ingest and whole-plan queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumine import settings as S
from vellumine.operators import knn as N
from vellumine.plans import evaluate as E
from vellumine.plans import ingest as P
from vellumine.plans import search as Q
from vellumine.sources import sinks
from vellumine.workload.chunks import fixed_chunks, sql_windows
from vellumine.workload.cleaning import sql_preset, sql_strip
from vellumine.workload.labels import CATEGORIES, sql_category
from vellumine.workload.registry import query, rounded, table
from vellumine.workload.retrieval import _TERMS, BM25_CTE, CHUNK_CTE, TOP, VEC_CTE
from vellumine.workload.retrieval import fixed_chunks as content_chunks
from vellumine.workload.rewriting import sql_expanded
from vellumine.workload.tokens import STOP, docs, sql_search_tokens
from vellumine.workload.vectors import sql_text_vectors


_CLEANED = sql_preset("minimal", "documents", "doc_id", "text")


@query(
    "ingest_documents",
    f"""WITH cleaned AS ({_CLEANED}), labelled AS ({sql_category('cleaned', "''", 'cleaned', 'doc_id', 'cleaned')}),
        pieces AS (SELECT category, substr(cleaned, s + 1, 500) AS piece FROM (SELECT category, cleaned, unnest(range(0, greatest(length(cleaned), 1), 450)) AS s FROM labelled))
        SELECT category, count(*) AS chunks, sum(length({sql_strip('piece')}))::BIGINT AS chars FROM pieces WHERE {sql_strip('piece')} <> '' GROUP BY category""",
)
def _ingest(spark, sf):
    chunks = P.ingest(docs(spark, sf), keyword_table=CATEGORIES)
    return chunks.groupBy("category").agg(F.count(F.lit(1)).alias("chunks"), F.sum("length").cast("bigint").alias("chars"))


@query(
    "markdown_sink",
    f"""WITH p AS (SELECT doc_id, {sql_strip('piece')} AS piece, row_number() OVER (PARTITION BY doc_id ORDER BY start) AS num FROM ({sql_windows(500, 50)}))
        SELECT doc_id, string_agg(CASE num WHEN 1 THEN '## ' ELSE '' END || piece, chr(10) || chr(10) ORDER BY num) AS markdown FROM p GROUP BY doc_id""",
)
def _markdown(spark, sf):
    chunks = fixed_chunks(spark, sf).withColumn("type", F.when(F.col("num") == 1, "title").otherwise("text"))
    return sinks.markdown_documents(chunks)


def _queries(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


_SYNONYMS = {"the": ["that"]}


def _sql_hybrid(source: str, key: str, text: str, before: str = "") -> str:
    """The whole search over rows of ``source``: variants and keywords by vector, BM25, fusion, threshold and k."""
    bm25 = BM25_CTE.replace("FROM documents", f"FROM {source}").replace("doc_id", key).replace(f"rank <= {TOP})", "rank <= 30)")
    bm25 = bm25.replace(sql_search_tokens("text") + f" AS ts FROM {source}", sql_search_tokens(text) + f" AS ts FROM {source}")
    best = lambda q, v, out: f"""{out} AS (SELECT * FROM (SELECT {q}, {key}, list_inner_product({v}.v, sv.v) AS score,
        row_number() OVER (PARTITION BY {q} ORDER BY round(list_inner_product({v}.v, sv.v), 6) DESC, {key}) AS rank FROM {v}, sv) WHERE rank <= 30)"""  # noqa: E731
    return f"""WITH {before}{bm25},
        sv AS ({sql_text_vectors(source, key, text)}),
        variants AS (SELECT query_id || '#' || variant_no AS vid, query_id, variant_no, variant FROM ({sql_expanded(_SYNONYMS)})),
        pv AS ({sql_text_vectors('variants', 'vid', 'variant')}), {best('vid', 'pv', 'near')},
        vec AS (SELECT query_id, {key}, max(score * CASE WHEN variant_no = 0 THEN 1.0 ELSE 0.7 END::DOUBLE) AS score FROM near JOIN variants USING (vid) GROUP BY ALL),
        kwt AS (SELECT item_id AS query_id, array_to_string(kws, ' ') AS text FROM ({_TERMS})),
        kv AS ({sql_text_vectors('kwt', 'query_id', 'text')}), {best('query_id', 'kv', 'knear')},
        kw AS (SELECT query_id, {key}, max(score) AS score FROM (SELECT query_id, {key}, score FROM bm25 UNION ALL SELECT query_id, {key}, score FROM knear WHERE score > 0) GROUP BY ALL),
        fused AS (SELECT query_id, {key}, coalesce(v.score * 0.6::DOUBLE, 0) + coalesce(k.score * 0.4::DOUBLE, 0) AS score FROM vec v FULL JOIN kw k USING (query_id, {key})),
        top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, {key}) AS rank FROM fused)
        SELECT query_id, {key}, round(score, 5) AS score, rank FROM top WHERE score >= {S.INTENT_THRESHOLD}::DOUBLE AND rank <= {S.INTENT_TOP_K['other']}"""


@query("hybrid_search", _sql_hybrid("documents", "doc_id", "text"))
def _hybrid(spark, sf):
    hits = Q.hybrid_search(docs(spark, sf), _queries(spark, sf), stop=STOP, synonyms=_SYNONYMS)
    return hits.withColumn("score", rounded("score", 5)).withColumn("rank", F.col("rank").cast("bigint"))


@query("hybrid_chunk_search", _sql_hybrid("ch", "chunk_id", "content", CHUNK_CTE.split("  cv AS")[0].strip()))
def _hybrid_chunks(spark, sf):
    """The same over fixed chunks, whose ids are text."""
    hits = Q.hybrid_search(content_chunks(spark, sf), _queries(spark, sf), key="chunk_id", text="content", stop=STOP, synonyms=_SYNONYMS)
    return hits.withColumn("score", rounded("score", 5)).withColumn("rank", F.col("rank").cast("bigint"))


def _cases(spark, sf):
    """Benchmark items as cases; a document that holds an item's whole text is relevant."""
    cases = _queries(spark, sf).select(
        "query_id", "query", F.when(F.col("query_id") % 2 == 0, "even").otherwise("odd").alias("category"),
        F.when(F.length("query") > 150, "hard").otherwise("easy").alias("difficulty"),
        F.array_distinct(F.split("query", " ")).alias("expected_keywords"),
        F.array_distinct(F.filter(F.split("query", " "), lambda w: F.length(w) > 6)).alias("expected_topics"),
    )
    contents = docs(spark, sf).select("doc_id", F.col("text").alias("content"))

    def retrieve(c):
        vectors = contents.select("doc_id", Q.stand_in(F.col("content")).alias("embedding"))
        q = c.select("query_id", Q.stand_in(F.col("query")).alias("embedding"))
        return N.knn(vectors, q, TOP, "cosine", corpus_id="doc_id").withColumnRenamed("id", "doc_id")

    return E.evaluate_cases(cases, retrieve, E.containing(_queries(spark, sf), docs(spark, sf)), contents)


_TRUTH = "truth AS (SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
_TOP5 = " + ".join(f"1 / log2({i + 1})" for i in range(1, 6))
_SHARE = "CASE WHEN len({0}) > 0 THEN len(list_filter({0}, lambda w: contains({1}, {2}))) / len({0}) ELSE 0 END"
CASES = f"""{VEC_CTE}, {_TRUTH}, b AS (SELECT item_id AS query_id, text, list_distinct(string_split(text, ' ')) AS kws,
    list_distinct(list_filter(string_split(text, ' '), lambda w: length(w) > 6)) AS topics FROM benchmark),
  n AS (SELECT query_id, count(*) AS n FROM truth GROUP BY query_id),
  j AS (SELECT vec.query_id, rank, (t.doc_id IS NOT NULL)::INT AS rel, d.text FROM vec JOIN documents d USING (doc_id) LEFT JOIN truth t USING (query_id, doc_id)),
  g AS (SELECT query_id, count(*) FILTER (WHERE rel = 1 AND rank <= 1) AS r1, count(*) FILTER (WHERE rel = 1 AND rank <= 3) AS r3, count(*) FILTER (WHERE rel = 1 AND rank <= 5) AS r5,
    coalesce(1.0::DOUBLE / min(rank) FILTER (WHERE rel = 1 AND rank <= 5), 0) AS mrr, sum(CASE WHEN rank <= 5 THEN (2 ** rel - 1) / log2(rank + 1) ELSE 0 END) / ({_TOP5}) AS ndcg,
    coalesce(string_agg(text, ' ' ORDER BY rank) FILTER (WHERE rank <= 5), '') AS body FROM j GROUP BY query_id),
  m AS (SELECT b.query_id, CASE WHEN b.query_id % 2 = 0 THEN 'even' ELSE 'odd' END AS category, CASE WHEN length(b.text) > 150 THEN 'hard' ELSE 'easy' END AS difficulty,
    r1::DOUBLE AS precision_at_1, r3 / 3 AS precision_at_3, r5 / 5 AS precision_at_5, CASE WHEN coalesce(n.n, 0) > 0 THEN r5 / n.n ELSE 0 END AS recall_at_5, mrr, ndcg AS ndcg_at_5,
    {_SHARE.format('kws', 'body', 'w')} AS hit_rate, {_SHARE.format('topics', 'lower(body)', 'lower(w)')} AS topic_coverage FROM b JOIN g USING (query_id) LEFT JOIN n USING (query_id)),
  cases AS (SELECT *, CASE WHEN precision_at_5 + recall_at_5 > 0 THEN 2 * precision_at_5 * recall_at_5 / (precision_at_5 + recall_at_5) ELSE 0 END AS f1_at_5 FROM m)"""


@query("case_truth", f"WITH {_TRUTH} SELECT query_id, doc_id FROM truth")
def _truth(spark, sf):
    return E.containing(_queries(spark, sf), docs(spark, sf))


@query("case_metrics", f"WITH {CASES} SELECT query_id, category, difficulty, {', '.join(f'round({m}, 5) AS {m}' for m in E.CASE_METRICS)} FROM cases")
def _metrics(spark, sf):
    return _cases(spark, sf).select("query_id", "category", "difficulty", *[rounded(m, 5).alias(m) for m in E.CASE_METRICS])


_MEANS = ", ".join(
    f"round(coalesce(avg({f'CASE WHEN {m} > 0 THEN {m} END' if m == 'topic_coverage' else m}), 0), 3) AS avg_{m}" for m in E.CASE_METRICS
)


@query(
    "evaluate_cases",
    f"""WITH {CASES} SELECT CASE WHEN grouping(difficulty) = 0 THEN 'difficulty' WHEN grouping(category) = 0 THEN 'category' ELSE 'all' END AS slice,
          coalesce(difficulty, category, 'all') AS label, count(*) AS cases, {_MEANS} FROM cases GROUP BY GROUPING SETS ((), (difficulty), (category))""",
)
def _evaluate(spark, sf):
    return E.evaluation_report(_cases(spark, sf))
