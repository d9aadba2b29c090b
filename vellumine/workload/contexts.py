"""Context, prompt and end-to-end queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumine import settings as S
from vellumine.functions import rules as R
from vellumine.operators import context as O
from vellumine.session import spread
from vellumine.workload.checks import gate_hits
from vellumine.workload.labels import INJECTIONS, sql_sanitized
from vellumine.workload.metrics import FOUND
from vellumine.workload.registry import lit, query, table
from vellumine.workload.tokens import sql_budget

R_ = f"{FOUND}, r AS (SELECT h.query_id, rank, score, h.id, d.text AS content, b.text AS query, d.source AS name FROM h JOIN documents d ON d.doc_id = h.id JOIN benchmark b ON b.item_id = h.query_id)"


@query(
    "context_prefix",
    f"""WITH {R_}, s AS (SELECT query_id, rank, '【参考文档' || rank || '】' || chr(10) || content || chr(10) AS seg FROM r),
        c AS (SELECT *, sum(length(seg)) OVER (PARTITION BY query_id ORDER BY rank) AS total FROM s)
        SELECT query_id, count(*) FILTER (WHERE total <= 4000) AS used, coalesce(string_agg(seg, chr(10) ORDER BY rank) FILTER (WHERE total <= 4000),
          left(max(seg) FILTER (WHERE rank = 1), 3950) || '...（已截断）' || chr(10)) AS context FROM c GROUP BY query_id""",
)
def _prefix(spark, sf):
    return O.prefix_context(gate_hits(spark, sf), 4000)


@query(
    "token_budget",
    f"""WITH {R_}, tk AS (SELECT query_id, rank, {sql_budget('content')} AS tokens, 4096 - 1150 - {sql_budget('query')} AS budget FROM r),
        c AS (SELECT *, sum(tokens + 20) OVER (PARTITION BY query_id ORDER BY rank) AS total FROM tk)
        SELECT query_id, rank, tokens, (budget - total + tokens + 20)::BIGINT AS remaining, CASE WHEN total <= budget THEN 'whole'
          WHEN budget - total + tokens + 20 > 100 THEN 'cut' ELSE 'none' END AS selected FROM c""",
)
def _budget(spark, sf):
    b = O.token_budget(gate_hits(spark, sf))
    return b.select("query_id", F.col("rank").cast("bigint").alias("rank"), "tokens", F.col("remaining").cast("bigint").alias("remaining"), "selected")


@query("token_budget_text")
def _budget_text(spark, sf):
    b = O.token_budget(gate_hits(spark, sf), window=2048)
    return b.where("selected <> 'none'").select("query_id", "rank", "selected", "selected_content")


@query("truncate_tokens")
def _truncate(spark, sf):
    d = spread(table(spark, sf, "documents").select("doc_id", "text"))
    return d.select("doc_id", O.truncate_to_tokens(F.col("text"), F.lit(120)).alias("content"))


@query("window_check", f"SELECT doc_id, {sql_budget('text')} + 500 <= 1024 AS is_valid, {sql_budget('text')} + 500 AS total_needed, 1024 - {sql_budget('text')} - 500 AS remaining FROM documents")
def _window(spark, sf):
    d = spread(table(spark, sf, "documents").select("doc_id", "text"))
    return d.withColumn("c", O.window_check(F.col("text"), 1024)).select("doc_id", "c.*")


def _sql_fill(template: str, *args: str) -> str:
    parts = template.split("%s")
    out = lit(parts[0])
    for arg, part in zip(args, parts[1:]):
        out += f" || {arg} || {lit(part)}"
    return out


@query(
    "generation_prompt",
    f"""WITH {R_}, c AS (SELECT query_id, string_agg('[' || rank || '] ' || left(content, 500), chr(10) || chr(10) ORDER BY rank) AS ctx, any_value(query) AS q FROM r WHERE rank <= 5 GROUP BY query_id)
        SELECT query_id, CASE WHEN query_id % 3 = 0 THEN {_sql_fill(O.COMPARE_PROMPT, 'ctx', 'q')} WHEN query_id % 3 = 1 THEN {_sql_fill(O.TEMPORAL_PROMPT, 'ctx', 'q')}
          ELSE {_sql_fill(O.STANDARD_PROMPT, 'ctx', 'q')} END AS prompt FROM c""",
)
def _prompt(spark, sf):
    i = F.col("query_id") % 3
    tags = F.when(i == 0, F.array(F.lit("Comparative"))).when(i == 1, F.array(F.lit("Temporal"))).otherwise(F.array().cast("array<string>"))
    return O.generation_prompt(gate_hits(spark, sf).withColumn("tags", tags), tags="tags")


_ESC = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#039;')"


@query(
    "safe_prompt",
    f"""WITH {R_}, c AS (SELECT query_id, string_agg('[' || rank || '] ' || {_ESC.format(f"CASE WHEN regexp_matches(content, {lit(R.injection_pattern(INJECTIONS))}) THEN {lit(S.INJECTION_CHUNK_MARK)} ELSE content END")}, chr(10) ORDER BY rank) AS ctx,
          any_value(query) AS q FROM r WHERE rank <= 5 GROUP BY query_id)
        SELECT query_id, {_sql_fill(O.SAFE_PROMPT, 'ctx', _ESC.format(sql_sanitized('q').replace('[filtered]', S.INJECTION_QUERY_MARK)), "''")} AS prompt FROM c""",
)
def _safe(spark, sf):
    return O.safe_prompt(gate_hits(spark, sf), patterns=INJECTIONS)


@query(
    "citation_list",
    f"""WITH {R_} SELECT query_id, string_agg(rank || ':' || id || ':' || left(content, 100) || '...', '|' ORDER BY rank) AS citations FROM r WHERE rank <= 5 GROUP BY query_id""",
)
def _citations(spark, sf):
    c = O.citations(gate_hits(spark, sf))
    line = F.transform("citations", lambda x: F.concat_ws(":", x["rank"].cast("string"), x["doc_id"].cast("string"), x["preview"]))
    return c.select("query_id", F.array_join(line, "|").alias("citations"))


@query("reference_footer", f"WITH {R_} SELECT query_id, string_agg('[' || rank || '] ' || name, chr(10) ORDER BY rank) AS footer FROM r WHERE rank <= 5 GROUP BY query_id")
def _footer(spark, sf):
    names = table(spark, sf, "documents").select("doc_id", F.col("source").alias("document_name"))
    return O.reference_footer(gate_hits(spark, sf).drop("source").join(names, "doc_id"))


@query(
    "sub_answer_prompt",
    f"""WITH p AS (SELECT a.conv_id, a.turn, u.text AS q, a.text AS a FROM conversations a JOIN conversations u ON u.conv_id = a.conv_id AND u.turn + 1 = a.turn
          WHERE a.role = 'assistant' AND u.role = 'user'), g AS (SELECT conv_id, string_agg('Q: ' || q || chr(10) || 'A: ' || a, chr(10) ORDER BY turn) AS qa FROM p GROUP BY conv_id)
        SELECT conv_id, {_sql_fill(O.SUB_ANSWER_PROMPT, 'qa')} AS prompt FROM g""",
)
def _sub(spark, sf):
    from vellumine.workload.metrics import answer_pairs

    return O.sub_answer_prompt(answer_pairs(spark, sf), ["conv_id"], "turn", "query", "answer")


@query("generate_answers")
def _generate(spark, sf):
    return O.generate(O.generation_prompt(gate_hits(spark, sf))).drop("generation_ms")


