"""The enhanced answer plan over the user turns of conversations, up to the last prompt."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellumine.operators import context as O
from vellumine.plans import enhanced as P
from vellumine.workload.cleaning import sql_strip
from vellumine.workload.labels import _ROUTE_CASE, _SCENE, sql_scene_tags
from vellumine.workload.registry import lit, query, table
from vellumine.workload.rewriting import _VS_RE, sql_filled, sql_first_replaced, sql_guess
from vellumine.workload.tokens import STOP, docs, sql_words
from vellumine.workload.vectors import sql_text_vectors

AMBIGUOUS = {"thereof": ["that of"], "eine": ["una"]}
REFERENCES = ["that", "der"]
RULES = dict(
    scene=_SCENE, ambiguous=AMBIGUOUS, references=REFERENCES, entity_stop=STOP, marks=".!?\n", connectors=[" and ", " und "], back=["that", "der"],
)
CLARIFY_BELOW = 0.52


def asked(spark, sf):
    """User turns; every fifth conversation compares what its commas list."""
    users = table(spark, sf, "conversations").where("role = 'user'")
    text = F.when(F.col("conv_id") % 5 == 0, F.replace("text", F.lit(", "), F.lit(" vs "))).otherwise(F.col("text"))
    return users.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "conv_id", "turn", text.alias("query"))


def digest_answer(prompt: Column) -> Column:
    """Stand-in for a model: an answer that depends on the whole prompt, so that later prompts attest earlier ones."""
    return F.left(F.md5(prompt.cast("binary")), F.lit(8))


_SPLIT = f"list_filter(list_transform(regexp_split_to_array(main, '[.!?\n]'), lambda x: {sql_strip('x')}), lambda x: x <> '')"
_PARTS = f"CASE WHEN len(s) = 1 THEN list_filter(list_transform(regexp_split_to_array(main, ' and | und '), lambda x: {sql_strip('x')}), lambda x: x <> '') ELSE s END"
_READ = [f"CASE WHEN contains(lower(main), {lit(w)}) THEN {sql_guess('regexp_replace(main, ' + lit('(?i)' + w) + ', ' + lit(m[0]) + chr(44) + lit('g') + ')')} END" for w, m in AMBIGUOUS.items()]
PLAN = f"""asked AS (SELECT conv_id * 1000 + turn AS query_id, conv_id, turn, role, CASE WHEN conv_id % 5 = 0 THEN replace(text, ', ', ' vs ') ELSE text END AS text
    FROM conversations WHERE role = 'user'),
  tagged AS (SELECT t.*, text, {_ROUTE_CASE} AS route FROM ({sql_scene_tags().replace('FROM conversations', 'FROM asked')}) t JOIN asked USING (conv_id, turn)),
  placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations),
  said AS (SELECT u.conv_id, u.turn, a.turn AS ts, unnest(list_slice({sql_words('a.text')}, 1, 5)) AS name FROM placed u JOIN placed a
    ON a.conv_id = u.conv_id AND u.role = 'user' AND a.role = 'assistant' AND a.place BETWEEN u.place - 6 AND u.place - 1),
  best AS (SELECT conv_id, turn, max(ROW(0.7::DOUBLE + CASE WHEN length(name) > 2 AND contains(text, name) THEN 0.2::DOUBLE ELSE 0 END, ts, name))[3] AS name
    FROM said JOIN asked USING (conv_id, turn) GROUP BY ALL),
  resolved AS (SELECT conv_id * 1000 + turn AS query_id, turn, tags, route, text, CASE WHEN contains(tags, 'HistoryRef') AND name IS NOT NULL
    THEN {sql_first_replaced('text', REFERENCES, 'name')} ELSE text END AS main FROM tagged LEFT JOIN best USING (conv_id, turn)),
  parted AS (SELECT *, CASE WHEN contains(tags, 'MultiQuestion') THEN {_PARTS} ELSE [] END AS parts, contains(tags, 'Comparative') AND regexp_matches(main, {lit(_VS_RE)}) AS versus,
    regexp_extract(main, {lit(_VS_RE)}, 1) AS a, regexp_extract(main, {lit(_VS_RE)}, 2) AS b,
    CASE WHEN NOT contains(tags, 'Ambiguous') THEN [] WHEN {' OR '.join(f'contains(lower(main), {lit(w)})' for w in AMBIGUOUS)}
      THEN list_filter([{', '.join(_READ)}], lambda x: x IS NOT NULL) ELSE [{sql_guess('main')}] END AS guesses
    FROM (SELECT *, {_SPLIT} AS s FROM resolved)),
  one AS (SELECT query_id, unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS i FROM parted),
  dep AS (SELECT *, i > 0 AND (contains(part, 'that') OR contains(part, 'der')) AS dependent FROM one),
  lv AS (SELECT query_id, i, part, dependent, 0::BIGINT AS stage, 0::BIGINT AS best FROM dep WHERE i = 0
    UNION ALL SELECT d.query_id, d.i, d.part, d.dependent, CASE WHEN d.dependent THEN lv.best + 1 ELSE 0 END, greatest(lv.best, CASE WHEN d.dependent THEN lv.best + 1 ELSE 0 END)
    FROM lv JOIN dep d ON d.query_id = lv.query_id AND d.i = lv.i + 1),
  subs AS (SELECT query_id, i AS no, 'sub_' || i AS id, part AS text, stage, CASE WHEN dependent THEN 0 ELSE i END AS low, i AS high,
      CASE WHEN dependent THEN array_to_string(list_transform(range(i), lambda j: 'sub_' || j), ',') ELSE '' END AS deps FROM lv
    UNION ALL SELECT query_id, len(parts), 'comp_0', a || '的相关信息', 0, 0, 0, '' FROM parted WHERE versus
    UNION ALL SELECT query_id, len(parts) + 1, 'comp_1', b || '的相关信息', 0, 0, 0, '' FROM parted WHERE versus
    UNION ALL SELECT query_id, len(parts) + 2, 'comp_analysis', '对比分析' || a || '和' || b || '的异同', 1, len(parts), len(parts) + 2, 'comp_0,comp_1' FROM parted WHERE versus)"""


@query(
    "enhanced_plan",
    f"""WITH RECURSIVE {PLAN},
        listed AS (SELECT query_id, string_agg(concat_ws('|', id, stage, deps, text), ' ; ' ORDER BY no) AS subs FROM subs GROUP BY query_id)
        SELECT query_id, route, main AS main_query, coalesce(subs, '') AS subs, array_to_string(guesses, ' ; ') AS hypotheses, concat_ws(',',
          CASE WHEN contains(tags, 'HistoryRef') AND main <> text THEN 'coreference_resolution' END,
          CASE WHEN contains(tags, 'Ambiguous') THEN CASE WHEN len(guesses) > 1 THEN 'hyde_multi' ELSE 'hyde_single' END END,
          CASE WHEN contains(tags, 'MultiQuestion') THEN 'query_decomposition' END, CASE WHEN contains(tags, 'Temporal') THEN 'temporal_injection' END,
          CASE WHEN versus THEN 'comparative_expansion' END) AS enhancements FROM parted LEFT JOIN listed USING (query_id)""",
)
def _plan(spark, sf):
    plan = P.enhance(asked(spark, sf), table(spark, sf, "conversations"), **RULES)
    shown = F.transform("subs", lambda s: F.concat_ws("|", s["id"], s["stage"].cast("string"), F.array_join(s["dependencies"], ","), s["text"]))
    return plan.select(
        "query_id", "route", "main_query", F.array_join(shown, " ; ").alias("subs"),
        F.array_join(F.transform("hypotheses", lambda h: h["text"]), " ; ").alias("hypotheses"), F.array_join("enhancements", ",").alias("enhancements"),
    )


_SUB_PROMPT = sql_filled(P.SUB_PROMPT, "text", "coalesce(context, '')")
#: Hits as the plan ranks them, the gate's tier, and the answers of sub-queries, one after another.
SEARCHED = f"""{PLAN}, probes AS (
    SELECT query_id, 'vector' AS kind, main AS text FROM parted WHERE route <> 'direct_generation'
    UNION ALL SELECT query_id, 'sub', s.text FROM subs s JOIN parted USING (query_id) WHERE route <> 'direct_generation'
    UNION ALL SELECT query_id, 'hyde', unnest(guesses) FROM parted WHERE route <> 'direct_generation'),
  texts AS (SELECT DISTINCT text, md5(text) AS probe FROM probes),
  pv AS ({sql_text_vectors('texts', 'probe', 'text')}), dv AS ({sql_text_vectors('documents', 'doc_id', 'text')}),
  near AS (SELECT * FROM (SELECT probe, doc_id, list_inner_product(pv.v, dv.v) AS score,
      row_number() OVER (PARTITION BY probe ORDER BY round(list_inner_product(pv.v, dv.v), 6) DESC, doc_id) AS rank FROM pv, dv) WHERE rank <= 30),
  met AS (SELECT DISTINCT query_id, kind, doc_id, score * CASE kind WHEN 'hyde' THEN 0.9::DOUBLE ELSE 1.0 END AS score
    FROM probes p JOIN near ON near.probe = md5(p.text) WHERE kind <> 'hyde' OR rank <= 10),
  top AS (SELECT query_id, doc_id, max(ROW(score, kind)) AS m FROM met GROUP BY ALL),
  ranked AS (SELECT query_id, doc_id, m[1] AS score, m[2] AS source, row_number() OVER (PARTITION BY query_id ORDER BY round(m[1], 9) DESC, doc_id) AS rank FROM top),
  shown AS (SELECT r.*, d.text AS content, q.main, q.tags, list_distinct({sql_words('q.main')}) AS aw, list_distinct({sql_words('d.text')}) AS cw
    FROM ranked r JOIN documents d USING (doc_id) JOIN parted q USING (query_id) WHERE rank <= 50),
  base AS (SELECT query_id, count(*) AS n, max(len(aw)) AS words, coalesce(avg(CASE WHEN rank <= 10 AND len(cw) > 0 AND len(aw) > 0 THEN len(list_intersect(aw, cw)) / len(aw) END), 0) AS cover,
    avg(CASE WHEN rank <= 10 THEN (score > 0.5)::INT::DOUBLE END) * 0.6::DOUBLE + avg(CASE WHEN rank <= 10 THEN score END) * 0.4::DOUBLE AS confidence,
    CASE WHEN bool_or(contains(tags, 'Temporal')) THEN 0.6::DOUBLE ELSE 0.5 END AS recency, var_pop(CASE WHEN rank <= 5 THEN score END) AS v FROM shown GROUP BY query_id),
  ent AS (SELECT query_id, -sum(p * log2(p)) / count(*) AS e FROM (SELECT query_id, count(*) / sum(count(*)) OVER (PARTITION BY query_id) AS p FROM shown GROUP BY query_id, source) GROUP BY query_id),
  g AS (SELECT query_id, n, CASE WHEN words = 0 THEN 0.5::DOUBLE ELSE least(cover * 2, 1.0::DOUBLE) END AS relevance, CASE WHEN n < 2 THEN 0.5 ELSE greatest(0, least(1, e + 0.5::DOUBLE)) END AS diversity,
    confidence, recency, CASE WHEN n < 2 THEN 0.8 WHEN v < 0.01 THEN 0.9 WHEN v < 0.05 THEN 0.7 ELSE 0.5 END::DOUBLE AS consistency FROM base JOIN ent USING (query_id)),
  judged AS (SELECT *, relevance * 0.35::DOUBLE + diversity * 0.2::DOUBLE + confidence * 0.25::DOUBLE + recency * 0.1::DOUBLE + consistency * 0.1::DOUBLE AS overall FROM g),
  tiers AS (SELECT query_id, CASE WHEN overall >= 0.8 THEN 'high' WHEN overall >= 0.6 THEN 'medium' ELSE 'low' END AS tier, overall < {CLARIFY_BELOW} AS unsure,
    concat_ws(chr(10), CASE WHEN relevance < 0.3 THEN '- relevance_coverage_low' END, CASE WHEN diversity < 0.3 THEN '- diversity_low' END) AS issues FROM judged),
  contexts AS (SELECT query_id, string_agg(left(content, {P.SUB_CHARS}), chr(10) ORDER BY rank) AS context FROM shown WHERE rank <= {P.SUB_HITS} GROUP BY query_id),
  lines AS (SELECT query_id, -1::BIGINT AS no, []::VARCHAR[] AS qa FROM parted WHERE contains(tags, 'MultiQuestion')
    UNION ALL SELECT query_id, s.no, list_append(qa, 'Q: ' || text || chr(10) || 'A: ' || left(md5({_SUB_PROMPT} || CASE WHEN high > low
      THEN {sql_filled(P.KNOWN_ANSWERS, "array_to_string(list_slice(qa, low + 1, high), chr(10))")} ELSE '' END), 8))
    FROM lines JOIN subs s USING (query_id) LEFT JOIN contexts USING (query_id) WHERE s.no = lines.no + 1),
  merged AS (SELECT query_id, {sql_filled(O.SUB_ANSWER_PROMPT, 'array_to_string(arg_max(qa, no), chr(10))')} AS prompt FROM lines GROUP BY query_id HAVING max(no) >= 0),
  plain AS (SELECT query_id, string_agg('[' || rank || '] ' || left(content, 500), chr(10) || chr(10) ORDER BY rank) AS c FROM shown WHERE rank <= 5 GROUP BY query_id)"""


@query(
    "enhanced_answers",
    f"""WITH RECURSIVE {SEARCHED}
        SELECT query_id, CASE WHEN unsure THEN 'clarify' ELSE route END AS route, tier, CASE WHEN route = 'direct_generation' THEN {sql_filled(P.DIRECT_PROMPT, 'q.text')}
          WHEN unsure THEN {sql_filled(P.CLARIFY_PROMPT, 'main', 'issues')} WHEN merged.prompt IS NOT NULL THEN merged.prompt
          WHEN contains(tags, 'Comparative') THEN {sql_filled(O.COMPARE_PROMPT, 'c', 'main')} WHEN contains(tags, 'Temporal') THEN {sql_filled(O.TEMPORAL_PROMPT, 'c', 'main')}
          ELSE {sql_filled(O.STANDARD_PROMPT, 'c', 'main')} END AS prompt
        FROM parted q LEFT JOIN tiers USING (query_id) LEFT JOIN merged USING (query_id) LEFT JOIN plain USING (query_id)""",
)
def _answers(spark, sf):
    found = P.enhanced_answers(
        docs(spark, sf), asked(spark, sf), answer=digest_answer, messages=table(spark, sf, "conversations"), stop=STOP, clarify_below=CLARIFY_BELOW, **RULES
    )
    return found.select("query_id", "route", "tier", "prompt")


@query(
    "session_updates",
    """SELECT conv_id, turn + d AS turn, CASE d WHEN 0 THEN 'user' ELSE 'assistant' END AS role, CASE d WHEN 0 THEN t ELSE left(md5(t), 8) END AS text FROM (
         SELECT *, unnest([0, 1]) AS d FROM (SELECT conv_id, turn, CASE WHEN conv_id % 5 = 0 THEN replace(text, ', ', ' vs ') ELSE text END AS t FROM conversations WHERE role = 'user'))""",
)
def _updates(spark, sf):
    users = asked(spark, sf)
    return P.session_updates(users, users.select("query_id", digest_answer(F.col("query")).alias("answer")))
