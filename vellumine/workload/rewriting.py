"""Query-rewriting queries over benchmark items and user turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumine import settings as S
from vellumine.functions import tokens as K
from vellumine.operators import rewriting as W
from vellumine.workload.cleaning import sql_strip
from vellumine.workload.labels import sql_scene_tags, tagged_users
from vellumine.workload.metrics import PAIRS, answer_pairs
from vellumine.workload.registry import lit, query, table
from vellumine.workload.tokens import STOP, sql_first_distinct, sql_search_tokens, sql_words

SYN = {"the": ["that", "this"], "and": ["with"], "que": ["como"]}


def items(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def sql_expanded(syn: dict[str, list[str]]) -> str:
    """SELECT query_id, variant_no, variant of every benchmark item."""
    swaps = [(w, o) for w, others in syn.items() for o in others]
    swapped = " UNION ALL ".join(
        f"SELECT item_id, {100 + n} AS pos, replace(text, {lit(w)}, {lit(o)}) AS v FROM benchmark WHERE contains(text, {lit(w)})" for n, (w, o) in enumerate(swaps)
    )
    return f"""WITH kw AS ({sql_first_distinct('benchmark', 'item_id', sql_search_tokens('text'), 10)}),
        ks AS (SELECT item_id, unnest(kws) AS k, generate_subscripts(kws, 1) AS i FROM kw WHERE len(kws) > 1),
        v AS (SELECT item_id, 0 AS pos, text AS v FROM benchmark
          UNION ALL SELECT item_id, 2 * i, k || ' ' || trim(replace(text, k, ''), ' ') FROM ks JOIN benchmark USING (item_id) WHERE length(k) > 2
          UNION ALL SELECT item_id, 2 * i + 1, trim(replace(text, k, ''), ' ') || ' ' || k FROM ks JOIN benchmark USING (item_id) WHERE length(k) > 2
          UNION ALL {swapped}),
        d AS (SELECT item_id, v, min(pos) AS pos FROM v GROUP BY ALL)
        SELECT item_id AS query_id, row_number() OVER (PARTITION BY item_id ORDER BY pos) - 1 AS variant_no, v AS variant FROM d
        QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY pos) <= 8"""


@query("expand_query", sql_expanded(SYN))
def _expand(spark, sf):
    rows = W.variant_rows(items(spark, sf), W.expand_query(F.col("text"), None, SYN, STOP))
    return rows.withColumn("variant_no", F.col("variant_no").cast("bigint"))


_LODGING = (["the", "la"], ["hotel", "inn"])
_LEVELS = [(["tion"], ["tion", "staff"]), (["que"], ["chief"])]
_CITIES = [(["heha"], ["north"]), (["er"], ["south", "er"])]


@query(
    "enrich_query",
    """SELECT item_id AS query_id, text || coalesce(' ' || nullif(array_to_string(list_filter(list_concat(
          CASE WHEN contains(text, 'the') OR contains(text, 'la') THEN ['hotel', 'inn'] ELSE [] END,
          CASE WHEN contains(text, 'tion') THEN ['tion', 'staff'] WHEN contains(text, 'que') THEN ['chief'] ELSE [] END,
          CASE WHEN contains(text, 'heha') THEN ['north'] WHEN contains(text, 'er') THEN ['south', 'er'] ELSE [] END),
          lambda t: NOT contains(text, t)), ' '), ''), '') AS enriched FROM benchmark""",
)
def _enrich(spark, sf):
    return items(spark, sf).select("query_id", W.enrich_query(F.col("text"), None, _LODGING, _LEVELS, _CITIES).alias("enriched"))


@query(
    "query_with_context",
    f"""WITH {PAIRS}, p AS (SELECT conv_id * 1000 + turn AS id, conv_id, turn, query, answer FROM pairs),
        qk AS ({sql_first_distinct('p', 'id', sql_search_tokens('query'), 10)}),
        ck AS ({sql_first_distinct('p', 'id', sql_search_tokens('answer'), 10)}),
        x AS (SELECT p.*, list_slice(list_filter(coalesce(ck.kws, []), lambda w: NOT list_contains(coalesce(qk.kws, []), w)), 1, 5) AS extra FROM p LEFT JOIN qk USING (id) LEFT JOIN ck USING (id)),
        e AS (SELECT conv_id, turn, CASE WHEN len(extra) > 0 THEN query || ' | ' || array_to_string(extra, ' ') ELSE query END AS t FROM x)
        SELECT conv_id, turn, CASE WHEN length(t) > 500 THEN left(t, 500) || '...' ELSE t END AS enhanced FROM e""",
)
def _with_context(spark, sf):
    p = answer_pairs(spark, sf)
    return p.select("conv_id", "turn", W.with_context(F.col("query"), F.col("answer"), STOP, bridge=" | ").alias("enhanced"))


_CONN, _BACK = [" and ", " und "], ["that", "der"]
_SPLIT = f"list_filter(list_transform(regexp_split_to_array(text, '[.!?\n]'), lambda x: {sql_strip('x')}), lambda x: x <> '')"
DECOMPOSED = f"""ss AS (SELECT conv_id, turn, text, {_SPLIT} AS s FROM conversations WHERE role = 'user'),
  ps AS (SELECT conv_id, turn, CASE WHEN len(s) = 1 THEN list_filter(list_transform(regexp_split_to_array(text, ' and | und '), lambda x: {sql_strip('x')}), lambda x: x <> '') ELSE s END AS p FROM ss),
  sub AS (SELECT conv_id, turn, unnest(p) AS part, generate_subscripts(p, 1) - 1 AS i FROM ps),
  dep AS (SELECT *, i > 0 AND (contains(part, 'that') OR contains(part, 'der')) AS dependent FROM sub)"""


def _decomposed(spark, sf):
    users = table(spark, sf, "conversations").where("role = 'user'")
    return users.select("conv_id", "turn", W.decompose(F.col("text"), ".!?\n", _CONN, _BACK).alias("subs"))


@query(
    "decompose_query",
    f"""WITH {DECOMPOSED} SELECT conv_id, turn, 'sub_' || i AS id, part AS text,
          CASE WHEN dependent THEN array_to_string(list_transform(range(i), lambda j: 'sub_' || j), ',') ELSE '' END AS dependencies FROM dep""",
)
def _decompose(spark, sf):
    return _decomposed(spark, sf).select("conv_id", "turn", F.explode("subs").alias("s")).select(
        "conv_id", "turn", "s.id", "s.text", F.array_join("s.dependencies", ",").alias("dependencies")
    )


@query(
    "subquery_stages",
    f"""WITH RECURSIVE {DECOMPOSED}, lv AS (
          SELECT conv_id, turn, i, CASE WHEN dependent THEN 1 ELSE 0 END::BIGINT AS stage, CASE WHEN dependent THEN 1 ELSE 0 END::BIGINT AS best FROM dep WHERE i = 0
          UNION ALL SELECT d.conv_id, d.turn, d.i, CASE WHEN d.dependent THEN lv.best + 1 ELSE 0 END, greatest(lv.best, CASE WHEN d.dependent THEN lv.best + 1 ELSE 0 END)
          FROM lv JOIN dep d ON d.conv_id = lv.conv_id AND d.turn = lv.turn AND d.i = lv.i + 1)
        SELECT conv_id, turn, i AS sub, stage FROM lv""",
)
def _stages(spark, sf):
    d = _decomposed(spark, sf).select("conv_id", "turn", F.posexplode(W.stages(F.col("subs"))).alias("sub", "stage"))
    return d.select("conv_id", "turn", F.col("sub").cast("bigint").alias("sub"), F.col("stage").cast("bigint").alias("stage"))


_VS = "replace(text, ', ', ' vs ')"
_VS_RE = "(?i)([\\p{L}\\p{N}_]+)\\s*vs\\s*([\\p{L}\\p{N}_]+)"


@query(
    "comparative_subqueries",
    f"""WITH q AS (SELECT item_id, regexp_extract({_VS}, {lit(_VS_RE)}, 1) AS a, regexp_extract({_VS}, {lit(_VS_RE)}, 2) AS b FROM benchmark WHERE regexp_matches({_VS}, {lit(_VS_RE)}))
        SELECT item_id AS query_id, 'comp_0' AS id, a || '的相关信息' AS text FROM q UNION ALL SELECT item_id, 'comp_1', b || '的相关信息' FROM q
        UNION ALL SELECT item_id, 'comp_analysis', '对比分析' || a || '和' || b || '的异同' FROM q""",
)
def _compare(spark, sf):
    q = items(spark, sf).withColumn("text", F.replace("text", F.lit(", "), F.lit(" vs ")))
    return q.select("query_id", F.explode(W.comparative_subqueries(F.col("text"))).alias("s")).select("query_id", "s.id", "s.text")


@query("is_contextual", "SELECT conv_id, turn, contains(text, 'the') OR contains(text, 'das') OR length(text) < 60 AS contextual FROM conversations WHERE role = 'user'")
def _contextual(spark, sf):
    users = table(spark, sf, "conversations").where("role = 'user'")
    return users.select("conv_id", "turn", W.is_contextual(F.col("text"), ["the", "das"], 60).alias("contextual"))


@query(
    "accumulate_profile",
    """WITH f AS (SELECT conv_id, 'k' || (length(text) % 3) AS k, text AS v, turn FROM conversations WHERE role = 'user'),
       l AS (SELECT conv_id, k, arg_max(v, turn) AS v FROM f GROUP BY ALL) SELECT conv_id, string_agg(k || '=' || v, ';' ORDER BY k) AS profile FROM l GROUP BY conv_id""",
)
def _profile(spark, sf):
    facts = table(spark, sf, "conversations").where("role = 'user'").select(
        "conv_id", F.concat(F.lit("k"), (F.length("text") % 3).cast("string")).alias("k"), F.col("text").alias("v"), "turn"
    )
    p = W.accumulate_profile(facts, "conv_id", "k", "v", "turn")
    line = F.transform(F.array_sort(F.map_entries("profile")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return p.select("conv_id", F.array_join(line, ";").alias("profile"))


def sql_filled(template: str, *values: str) -> str:
    """SQL of a %s template."""
    parts = template.split("%s")
    return " || ".join([lit(parts[0]), *[f"{v} || {lit(p)}" for v, p in zip(values, parts[1:])]])


def sql_guess(q: str) -> str:
    """SQL of the hypothesis text of a query."""
    pick = f"('0x' || substr(md5({q}), 1, 8))::BIGINT % {len(S.HYPOTHESIS_TEMPLATES)}"
    body = "CASE " + pick + " " + " ".join(f"WHEN {i} THEN {sql_filled(t.replace('{q}', '%s'), q)}" for i, t in enumerate(S.HYPOTHESIS_TEMPLATES)) + " END"
    words = f"list_slice({sql_words(q, S.REWRITE_STOP_WORDS, False)}, 1, 5)"
    return f"({body} || CASE WHEN len({words}) > 0 THEN ' ' || array_to_string({words}, ', ') || '等关键信息。' ELSE '' END)"


def sql_first_replaced(text: str, words: list[str], new: str) -> str:
    """SQL that replaces the first occurrence of each word."""
    for w in words:
        text = f"regexp_replace({text}, {lit(w + '个?')}, {new})"
    return text


_READINGS = {"the": "that one", "la": "una"}
_READ = ", ".join(
    f"CASE WHEN contains(lower(text), {lit(w)}) THEN {{'t': {sql_guess('regexp_replace(text, ' + lit('(?i)' + w) + ', ' + lit(m) + chr(44) + lit('g') + ')')}, 'e': {lit(m)}, 'c': 0.7::DOUBLE}} END"
    for w, m in _READINGS.items()
)


@query(
    "hypotheses",
    f"""WITH h AS (SELECT item_id, list_filter([{_READ}], lambda x: x IS NOT NULL) AS found, {{'t': {sql_guess('text')}, 'e': NULL::VARCHAR, 'c': 0.8::DOUBLE}} AS plain FROM benchmark),
        u AS (SELECT item_id, unnest(CASE WHEN len(found) > 0 THEN found ELSE [plain] END) AS x FROM h)
        SELECT item_id AS query_id, x.t AS text, x.e AS entity, x.c AS confidence FROM u""",
)
def _hypotheses(spark, sf):
    return items(spark, sf).select("query_id", F.explode(W.hypotheses(F.col("text"), {"the": ["that one"], "la": ["una"]})).alias("h")).select(
        "query_id", "h.text", "h.entity", "h.confidence"
    )


_NAMED = """max(ROW(0.7::DOUBLE + CASE WHEN length(name) > 2 AND contains(query, name) THEN 0.2::DOUBLE ELSE 0 END, name))[2]"""


@query(
    "resolve_references",
    f"""WITH {PAIRS}, said AS (SELECT conv_id, turn, query, unnest(list_slice({sql_words('answer')}, 1, 5)) AS name FROM pairs),
        best AS (SELECT conv_id, turn, {_NAMED} AS name FROM said GROUP BY ALL)
        SELECT conv_id, turn, CASE WHEN name IS NULL THEN query ELSE {sql_first_replaced('query', ['the', 'der', 'la'], 'name')} END AS resolved
        FROM pairs LEFT JOIN best USING (conv_id, turn)""",
)
def _resolve(spark, sf):
    p = answer_pairs(spark, sf)
    entity = F.transform(
        K.word_keywords(F.col("answer"), STOP, limit=5),
        lambda w: F.struct(w.alias("name"), F.lit(0.7).alias("confidence"), F.format_string("%05d", F.col("turn")).alias("timestamp")),
    )
    return p.select("conv_id", "turn", W.resolve_references(F.col("query"), entity, ["the", "der", "la"]).alias("resolved"))


@query(
    "query_enhancements",
    f"""WITH t AS (SELECT t.*, text FROM ({sql_scene_tags()}) t JOIN conversations USING (conv_id, turn))
        SELECT conv_id, turn, concat_ws(',', CASE WHEN contains(tags, 'HistoryRef') AND turn > 0 THEN 'coreference_resolution' END,
          CASE WHEN contains(tags, 'Ambiguous') THEN CASE WHEN {' + '.join(f"contains(lower(text), {lit(w)})::INT" for w in S.AMBIGUOUS_WORDS)} BETWEEN 2 AND 3 THEN 'hyde_multi' ELSE 'hyde_single' END END,
          CASE WHEN contains(tags, 'MultiQuestion') THEN 'query_decomposition' END, CASE WHEN contains(tags, 'Temporal') THEN 'temporal_injection' END,
          CASE WHEN contains(tags, 'Comparative') AND regexp_matches(text, {lit(_VS_RE)}) THEN 'comparative_expansion' END) AS enhancements FROM t""",
)
def _enhancements(spark, sf):
    u = tagged_users(spark, sf)
    h, c = W.hypotheses(F.col("text")), W.comparative_subqueries(F.col("text"))
    names = W.enhancements(F.col("s.tags"), F.size(h), F.col("turn") > 0, F.size(c))
    return u.select("conv_id", "turn", F.array_join(names, ",").alias("enhancements"))
