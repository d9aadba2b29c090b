"""Answer-check and quality-gate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumine.operators import validation as A
from vellumine.session import spread
from vellumine.workload.cleaning import sql_strip
from vellumine.workload.metrics import FOUND, PAIRS, answer_pairs, content_hits
from vellumine.workload.registry import lit, query, rounded, table
from vellumine.workload.tokens import STOP, sql_check_keywords, sql_words

MARKS = ".!?\n"
_CLAIMS = f"list_filter(list_transform(regexp_split_to_array({{}}, '[.!?\n]+'), lambda x: {sql_strip('x')}), lambda s: length(s) > 10 AND NOT regexp_matches(s, '^\\[\\d+\\]'))"


@query("claims", f"SELECT doc_id, len(c) AS claims, coalesce(list_sum(list_transform(c, lambda x: length(x))), 0)::BIGINT AS chars FROM (SELECT doc_id, {_CLAIMS.replace('{}', 'text')} AS c FROM documents)")
def _claims(spark, sf):
    d = spread(table(spark, sf, "documents").select("doc_id", "text")).withColumn("c", A.claims(F.col("text"), MARKS))
    total = F.aggregate("c", F.lit(0).cast("bigint"), lambda acc, x: acc + F.length(x))
    return d.select("doc_id", F.size("c").cast("bigint").alias("claims"), total.alias("chars"))


def _support(spark, sf, characters="edit"):
    """Claims of assistant turns against the two halves of the user turn before."""
    # Non-ASCII letters become "_" on both sides: the SQL engine measures edit distance in bytes.
    fold = lambda c: F.regexp_replace(c, "[^\\x00-\\x7F]", "_")
    half = F.ceil(F.length("query") / 2).cast("int")
    p = answer_pairs(spark, sf).withColumn("query", fold("query")).withColumn("answer", fold("answer"))
    p = p.withColumn("chunks", F.array(F.left("query", half), F.substr("query", half + 1)))
    return A.claim_support(p, ["conv_id", "turn"], marks=MARKS, threshold=0.2, stop=STOP, characters=characters)


_JACCARD = """CASE WHEN len(cw) > 0 AND len(kw) > 0 THEN len(list_intersect(cw, kw)) / len(list_distinct(list_concat(cw, kw))) ELSE 0 END"""
SUPPORT = f"""{PAIRS}, fold AS (SELECT conv_id, turn, regexp_replace(answer, '[^\\x00-\\x7F]', '_', 'g') AS answer, regexp_replace(query, '[^\\x00-\\x7F]', '_', 'g') AS query FROM pairs),
  c AS (SELECT conv_id, turn, query, unnest(cs) AS claim, generate_subscripts(cs, 1) - 1 AS claim_no FROM (SELECT *, {_CLAIMS.replace('{}', 'answer')} AS cs FROM fold)),
  k AS (SELECT *, unnest([left(query, ceil(length(query) / 2)::BIGINT), substr(query, ceil(length(query) / 2)::BIGINT + 1)]) AS chunk, unnest([0, 1]) AS chunk_no FROM c),
  w AS (SELECT *, list_distinct({sql_check_keywords('claim')}) AS cw, list_distinct({sql_check_keywords('chunk')}) AS kw,
    1 - levenshtein(claim, chunk) / greatest(length(claim), length(chunk)) AS ed FROM k),
  s AS (SELECT conv_id, turn, claim_no, chunk_no, ed * 0.4::DOUBLE + {_JACCARD} * 0.6::DOUBLE AS score FROM w),
  b AS (SELECT conv_id, turn, claim_no, max(score) AS similarity FROM s GROUP BY ALL)"""


@query("claim_support", f"WITH {SUPPORT} SELECT conv_id, turn, claim_no, round(similarity, 5) AS similarity, similarity >= 0.2 AS found FROM b")
def _claim_support(spark, sf):
    s = _support(spark, sf)
    return s.select("conv_id", "turn", "claim_no", rounded("similarity", 5).alias("similarity"), "found")


@query("claim_support_sequence")
def _claim_support_sequence(spark, sf):
    return _support(spark, sf, "sequence").select("conv_id", "turn", "claim_no", rounded("similarity", 5).alias("similarity"), "found", "source")


@query(
    "answer_validity",
    f"""WITH {SUPPORT} SELECT conv_id, turn, count(*) AS claims, count(*) FILTER (WHERE similarity >= 0.2) AS supported, bool_or(similarity < 0.2) AS hallucination,
          round(count(*) FILTER (WHERE similarity >= 0.2) / count(*), 5) AS confidence, count(*) FILTER (WHERE similarity >= 0.2) / count(*) >= 0.2 AS is_valid FROM b GROUP BY conv_id, turn""",
)
def _validity(spark, sf):
    v = A.answer_validity(_support(spark, sf), ["conv_id", "turn"], 0.2)
    return v.withColumn("confidence", rounded("confidence", 5))


_CITED = "replace(replace(replace(text, '. ', ' [' || (doc_id % 6) || '] '), ', ', ' [1-3] '), '\n', ' [2, 9] [3-' || (30000 + doc_id) || ']')"
_CITE = lit(A.CITATION)


@query(
    "citations_check",
    f"""WITH d AS (SELECT doc_id, regexp_extract_all({_CITED}, {_CITE}, 1) AS found FROM documents),
        u AS (SELECT doc_id, unnest(found) AS c FROM d),
        n AS (SELECT doc_id, CASE WHEN contains(c, '-') THEN split_part(c, '-', 1)::BIGINT END AS low, split_part(c, '-', 2) AS high,
            list_transform(string_split(c, ','), lambda x: TRY_CAST(trim(x) AS BIGINT)) AS listed FROM u),
        k AS (SELECT doc_id, CASE WHEN low IS NULL THEN len(listed) ELSE high::BIGINT - low + 1 END AS cited,
            CASE WHEN low IS NULL THEN len(list_filter(listed, lambda x: x BETWEEN 1 AND 4)) ELSE greatest(least(high::BIGINT, 4) - greatest(low, 1) + 1, 0) END AS valid FROM n),
        t AS (SELECT doc_id, sum(cited) AS cited, sum(valid) AS valid FROM k GROUP BY doc_id)
        SELECT d.doc_id, len(found) AS total, coalesce(valid, 0)::BIGINT AS valid, coalesce(cited - valid, 0)::BIGINT AS invalid
        FROM d LEFT JOIN t USING (doc_id)""",
)
def _citations(spark, sf):
    t = F.replace("text", F.lit(". "), F.concat(F.lit(" ["), (F.col("doc_id") % 6).cast("string"), F.lit("] ")))
    t = F.replace(F.replace(t, F.lit(", "), F.lit(" [1-3] ")), F.lit("\n"), F.concat(F.lit(" [2, 9] [3-"), (F.col("doc_id") + 30_000).cast("string"), F.lit("]")))
    d = spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", A.citation_check(t, F.lit(4)).alias("c"))
    return d.select("doc_id", *[F.col(f"c.{x}").cast("bigint").alias(x) for x in ("total", "valid", "invalid")])


def _share(a, b):
    return f"CASE WHEN len({a}) > 0 THEN len(list_distinct(list_filter({a}, lambda w: list_contains({b}, w)))) / len(list_distinct({a})) ELSE 0 END"


@query(
    "off_topic",
    f"""WITH {PAIRS}, w AS (SELECT conv_id, turn, {sql_check_keywords('answer')} AS a, {sql_check_keywords('query')} AS q FROM pairs)
        SELECT conv_id, turn, len(q) > 0 AND {_share('q', 'a')} < 0.1 AND {_share('a', 'q')} < 0.2 AS off_topic FROM w""",
)
def _off_topic(spark, sf):
    p = answer_pairs(spark, sf)
    return p.select("conv_id", "turn", A.is_off_topic(F.col("answer"), F.col("query"), F.col("query"), STOP).alias("off_topic"))


def gate_hits(spark, sf):
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    hits = content_hits(spark, sf).join(asked, "query_id")
    return hits.withColumn("source", F.when(F.col("rank") % 3 == 0, "keyword").otherwise("vector"))


def gate(spark, sf):
    return A.gate_scores(gate_hits(spark, sf), stop=STOP, temporal=F.col("query_id") % 2 == 0, dated=F.col("rank") <= 5)


GATE = f"""{FOUND}, r AS (SELECT h.query_id, rank, score, CASE WHEN rank % 3 = 0 THEN 'keyword' ELSE 'vector' END AS source,
    list_distinct({sql_words('b.text')}) AS aw, list_distinct({sql_words('d.text')}) AS cw
    FROM h JOIN documents d ON d.doc_id = h.id JOIN benchmark b ON b.item_id = h.query_id),
  base AS (SELECT query_id, count(*) AS n, avg(CASE WHEN len(cw) > 0 THEN len(list_intersect(aw, cw)) / len(aw) END) AS cover,
    avg((score > 0.5)::INT) * 0.6::DOUBLE + avg(score) * 0.4::DOUBLE AS confidence, avg(CASE WHEN rank <= 5 THEN 0.8 ELSE 0.5 END::DOUBLE) AS rec,
    var_pop(CASE WHEN rank <= 5 THEN score END) AS v FROM r GROUP BY query_id),
  ent AS (SELECT query_id, -sum(p * log2(p)) / count(*) AS e FROM (SELECT query_id, count(*) / sum(count(*)) OVER (PARTITION BY query_id) AS p FROM r GROUP BY query_id, source) GROUP BY query_id),
  g AS (SELECT query_id, n, least(cover * 2, 1.0::DOUBLE) AS relevance, CASE WHEN n < 2 THEN 0.5 ELSE greatest(0, least(1, e + 0.5::DOUBLE)) END AS diversity, confidence,
    CASE WHEN query_id % 2 = 0 THEN least(rec * 1.2::DOUBLE, 1.0) ELSE rec END AS recency,
    CASE WHEN n < 2 THEN 0.8 WHEN v < 0.01 THEN 0.9 WHEN v < 0.05 THEN 0.7 ELSE 0.5 END::DOUBLE AS consistency FROM base JOIN ent USING (query_id)),
  o AS (SELECT *, relevance * 0.35::DOUBLE + diversity * 0.2::DOUBLE + confidence * 0.25::DOUBLE + recency * 0.1::DOUBLE + consistency * 0.1::DOUBLE AS overall FROM g)"""


@query(
    "quality_gate",
    f"""WITH {GATE} SELECT query_id, n, round(relevance, 5) AS relevance, round(diversity, 5) AS diversity, round(confidence, 5) AS confidence, round(recency, 5) AS recency,
          consistency, round(overall, 5) AS overall, CASE WHEN overall >= 0.8 THEN 'high' WHEN overall >= 0.6 THEN 'medium' ELSE 'low' END AS tier FROM o""",
)
def _gate(spark, sf):
    g = gate(spark, sf).withColumn("tier", A.gate_tier(F.col("overall")))
    return g.select("query_id", "n", *[rounded(c, 5).alias(c) for c in ("relevance", "diversity", "confidence", "recency", "overall")], "consistency", "tier")


@query(
    "repair_feedback",
    f"""WITH {GATE} SELECT query_id, concat_ws(',', CASE WHEN relevance < 0.3 THEN 'relevance_coverage_low' END, CASE WHEN diversity < 0.3 THEN 'diversity_low' END,
          CASE WHEN recency < 0.3 THEN 'recency_low' END) AS issues, 'retry' AS action,
          CASE WHEN relevance < 0.3 THEN 'synonym_expansion' WHEN diversity < 0.3 THEN 'diversity_rerank' ELSE 'broaden_filters' END AS strategy FROM o""",
)
def _repair(spark, sf):
    f = A.repair_feedback(F.col("n"), F.col("relevance"), F.col("diversity"), F.col("recency"))
    return gate(spark, sf).withColumn("f", f).select("query_id", F.array_join("f.issues", ",").alias("issues"), "f.action", "f.strategy")


