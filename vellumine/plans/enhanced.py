"""The enhanced answer plan: history, rewriting, dependent sub-queries, retrieval, gate, prompts, answers.

Every step covers all queries at once. Sub-queries that depend on others are answered in stages: the answers of a stage are
columns of the next stage's prompts, and a compound question ends in a merge prompt. A stage is one join and one checkpoint, and
there are as many as the longest chain of dependencies, not as queries. Equal probe texts are searched once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine import settings as S
from vellumine.functions import rules as R
from vellumine.functions import tokens as K
from vellumine.functions import vectors as V
from vellumine.operators import context as O
from vellumine.operators import knn as N
from vellumine.operators import retrieval as RT
from vellumine.operators import rewriting as W
from vellumine.operators import validation as A
from vellumine.operators.scale import sliced_row_number, top_k
from vellumine.session import cut_lineage

# Prompt texts, and the characters of a hit that a sub-query's prompt shows.
DIRECT_PROMPT = "你是一个友好的AI助手。请回答用户的问题：\n用户：%s\n请给出友好、简洁的回答。"
SUB_PROMPT = "基于参考信息回答：%s\n\n参考：%s"
KNOWN_ANSWERS = "\n\n已知：\n%s"
CLARIFY_PROMPT = (
    '用户的问题是："%s"\n这个问题不够明确，可能的原因包括：\n%s\n请生成一个友好的澄清请求，询问用户更具体的信息。要求：\n'
    "1. 礼貌友好\n2. 指出可能的不明确之处\n3. 给出2-3个具体的选项或建议"
)
SUB_HITS, SUB_CHARS = 3, 300
#: Hits, and characters of each, that prompts and citations show at most.
SHOWN_HITS, SHOWN_CHARS = 5, 500
#: Messages of a slice in which a conversation is numbered.
TURN_SLICE = 4096
#: Probe kind: weight of its hits and how many count.
WAYS = {"vector": (1.0, 30), "sub": (1.0, 30), "hyde": (0.9, 10)}


def session_context(asked: DataFrame, messages: DataFrame, stop: Sequence[str] = S.DIALOGUE_STOP_WORDS, recent: int = 6, per_turn: int = 5) -> DataFrame:
    """(query_id, has_history, entities): what the conversation holds before the query.

    ``asked`` has query_id, conv_id and turn; a query that is no message of the table follows all of them. Entities are
    keywords of the assistant's messages among the last ``recent``. A message meets only the ``recent`` places after it, so
    a long conversation makes no pairs.
    """
    placed = sliced_row_number(
        messages.select("conv_id", "turn", "role", "text"), ["conv_id"], F.floor(F.col("turn") / TURN_SLICE).cast("bigint"),
        [F.col("turn"), F.col("role"), F.col("text")], "place",
    )
    at = placed.groupBy("conv_id", "turn").agg(F.min("place").alias("_place"))
    size = placed.groupBy("conv_id").agg(F.max("place").alias("_size"))
    known = asked.select("query_id", "conv_id", "turn").join(at, ["conv_id", "turn"], "left").join(size, "conv_id", "left")
    known = known.select("query_id", "conv_id", F.coalesce(F.col("_place") - 1, F.col("_size"), F.lit(0)).alias("base"))
    said = placed.where("role = 'assistant'").select(
        "conv_id", "turn", F.explode(K.word_keywords(F.col("text"), stop, limit=per_turn)).alias("name"), "place"
    )
    near = said.select("conv_id", "turn", "name", F.explode(F.sequence(F.col("place"), F.col("place") + recent - 1)).alias("base"))
    entity = F.struct("name", F.lit(0.7).alias("confidence"), F.col("turn").alias("timestamp"))
    found = known.join(near, ["conv_id", "base"]).groupBy("query_id").agg(F.collect_list(entity).alias("entities"))
    return known.select("query_id", (F.col("base") > 0).alias("has_history")).join(found, "query_id", "left")


def enhance(
    queries: DataFrame, messages: DataFrame | None = None, *, scene: dict | None = None, ambiguous=S.AMBIGUOUS_WORDS,
    references: Sequence[str] = S.COREFERENCE_WORDS, entity_stop: Sequence[str] = S.DIALOGUE_STOP_WORDS,
    marks: str = S.SENTENCE_MARKS, connectors: Sequence[str] = S.SPLIT_CONNECTORS, back: Sequence[str] = S.BACK_REFERENCES,
) -> DataFrame:
    """query_id, query, tags, route, main_query, hypotheses, subs and enhancements of every query.

    ``subs`` is array<struct<id, text, dependencies, stage>>: decomposed parts, then comparison queries. With ``messages``
    the queries have conv_id and turn, and references are resolved from the conversation before them.
    """
    if messages is None:
        known = queries.withColumn("has_history", F.lit(False)).withColumn("entities", F.lit(None).cast("array<struct<name:string,confidence:double,timestamp:int>>"))
    else:
        known = queries.join(session_context(queries, messages, entity_stop), "query_id", "left").fillna(False, ["has_history"])
    has = lambda tag: F.array_contains("tags", tag)
    none = lambda c: F.slice(c, 1, 0)  # noqa: E731  an empty array of the same type
    rows = known.select("query_id", "query", "entities", R.scene_tags(F.col("query"), F.col("has_history"), **(scene or {}))["tags"].alias("tags"))
    resolved = F.when(has("HistoryRef") & (F.size("entities") > 0), W.resolve_references(F.col("query"), F.col("entities"), references))
    rows = rows.select("query_id", "query", "tags", F.coalesce(resolved, F.col("query")).alias("main_query"))
    guesses, parts, sides = W.hypotheses(F.col("main_query"), ambiguous), W.decompose(F.col("main_query"), marks, connectors, back), W.comparative_subqueries(F.col("main_query"))
    rows = rows.select(
        "*", R.route(F.col("tags")).alias("route"), F.when(has("Ambiguous"), guesses).otherwise(none(guesses)).alias("hypotheses"),
        F.when(has("MultiQuestion"), parts).otherwise(none(parts)).alias("parts"), F.when(has("Comparative"), sides).otherwise(none(sides)).alias("sides"),
    )
    staged = lambda s, n: F.struct(s["id"].alias("id"), s["text"].alias("text"), s["dependencies"].alias("dependencies"), n.alias("stage"))
    subs = F.concat(
        F.zip_with("parts", W.stages(F.col("parts")), staged),
        F.transform("sides", lambda s: staged(s, F.when(F.size(s["dependencies"]) > 0, 1).otherwise(0))),
    )
    names = W.enhancements(F.col("tags"), F.size("hypotheses"), F.col("main_query") != F.col("query"), F.size("sides"))
    return rows.select("query_id", "query", "tags", "route", "main_query", "hypotheses", subs.alias("subs"), names.alias("enhancements"))


def staged_answers(subs: DataFrame, contexts: DataFrame, answer: Callable[[Column], Column]) -> DataFrame:
    """(query_id, no, id, text, stage, prompt, answer) of every sub-query.

    ``subs`` has query_id, no, id, text, dependencies and stage; ``contexts`` (query_id, context). A stage's prompts hold
    the answers that its queries depend on; one checkpoint a stage. ``answer`` maps a prompt Column to an answer Column: an
    expression, or a pandas UDF around a model.
    """
    rows = subs.join(contexts, "query_id", "left")
    last = subs.agg(F.max("stage")).first()[0]
    done = None
    for stage in range(0 if last is None else last + 1):
        now = rows.where(F.col("stage") == stage)
        if done is None:
            now = now.withColumn("known", F.lit(None).cast("array<string>"))
        else:
            asked = now.select("query_id", "no", F.explode("dependencies").alias("id"))
            line = F.struct("n", F.concat(F.lit("Q: "), F.col("text"), F.lit("\nA: "), F.col("answer")).alias("line"))
            told = asked.join(done.select("query_id", "id", F.col("no").alias("n"), "text", "answer"), ["query_id", "id"])
            told = told.groupBy("query_id", "no").agg(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]).alias("known"))
            now = now.join(told, ["query_id", "no"], "left")
        prompt = F.concat(
            F.format_string(SUB_PROMPT, "text", F.coalesce("context", F.lit(""))),
            F.when(F.size("known") > 0, F.format_string(KNOWN_ANSWERS, F.array_join("known", "\n"))).otherwise(F.lit("")),
        )
        made = now.select("query_id", "no", "id", "text", "stage", prompt.alias("prompt"))
        made = cut_lineage(made.withColumn("answer", answer(F.col("prompt"))))
        done = made if done is None else done.unionByName(made)
    if done is None:
        return rows.select("query_id", "no", "id", "text", "stage", F.lit(None).cast("string").alias("prompt"), F.lit(None).cast("string").alias("answer"))
    return done


def retrieve(chunks: DataFrame, plan: DataFrame, key: str, text: str, encode: Callable[[Column], Column]) -> DataFrame:
    """(query_id, key, score, source, rank): best hit per chunk over the main query, sub-queries and hypotheses."""
    probe = lambda kind, t: F.struct(F.lit(kind).alias("kind"), t.alias("text"))
    probes = plan.select(
        "query_id",
        F.explode(
            F.concat(
                F.array(probe("vector", F.col("main_query"))), F.transform("subs", lambda s: probe("sub", s["text"])),
                F.transform("hypotheses", lambda h: probe("hyde", h["text"])),
            )
        ).alias("p"),
    ).select("query_id", "p.kind", F.sha2("p.text", 256).alias("probe_id"), "p.text")
    once = probes.groupBy("probe_id").agg(F.any_value("text").alias("text")).select("probe_id", encode(F.col("text")).alias("embedding"))
    vectors = chunks.select(key, encode(F.col(text)).alias("embedding"))
    hits = N.knn(vectors, once, max(n for _, n in WAYS.values()), "cosine", corpus_id=key, query_id="probe_id")
    hits = hits.withColumnRenamed("query_id", "probe_id").withColumnRenamed("id", key)
    met = hits.join(probes.select("query_id", "kind", "probe_id").distinct(), "probe_id")
    weight, most = (F.create_map(*[F.lit(x) for k, v in WAYS.items() for x in (k, v[i])])[F.col("kind")] for i in (0, 1))
    best = RT.best_per_chunk(
        met.where(F.col("rank") <= most).select("query_id", key, (F.col("score") * weight).alias("score"), F.col("kind").alias("source")), key, "source"
    )
    return top_k(best, ["query_id"], [F.round("score", 9).desc(), F.col(key)], RT.RERANK_CANDIDATES)


def enhanced_answers(
    chunks: DataFrame, queries: DataFrame, *, answer: Callable[[Column], Column], messages: DataFrame | None = None, key: str = "doc_id",
    text: str = "text", encode: Callable[[Column], Column] = V.hashed_text_vector, stop: Sequence[str] = S.GATE_STOP_WORDS,
    clarify_below: float = 0.0, **rules,
) -> DataFrame:
    """query_id, route, tier, main_query, enhancements, prompt, answer and citations of every query.

    Small talk is answered at once. Others are enhanced (``enhance``, which takes ``rules``) and retrieved; weak results
    (no hits, three issues, or an overall score below ``clarify_below``) ask for clarification; compound questions are
    answered part by part and merged; the rest get the prompt that their tags ask for.
    """
    plan = cut_lineage(enhance(queries, messages, **rules))
    searched = plan.where("route <> 'direct_generation'")
    hits = cut_lineage(retrieve(chunks, searched, key, text, encode))
    asked = searched.select("query_id", F.col("main_query").alias("query"), "tags")
    # Only the first hits' texts are read, and only their heads go on: prompts and citations show no more.
    read = hits.where(F.col("rank") <= A.GATE_CONTENTS).join(asked, "query_id")
    read = chunks.select(key, F.col(text).alias("content")).join(read, key)
    head = F.when(F.col("rank") <= SHOWN_HITS, F.left("content", F.lit(SHOWN_CHARS))).alias("content")
    seen = cut_lineage(A.gate_rows(read, stop=stop, temporal=F.array_contains("tags", "Temporal"), keep=[key, head]))
    later = hits.where(F.col("rank") > A.GATE_CONTENTS).select(
        "query_id", "rank", "score", "source", *[F.lit(0).alias(c) for c in ("_asked", "_shown", "_shared")], F.lit(0.5).alias("_recency"), F.lit(False).alias("_temporal"),
    )
    gate = A.scored_rows(seen.drop(key, "content").unionByName(later))
    shown = seen.where(F.col("rank") <= SHOWN_HITS).select("query_id", key, "rank", "score", "source", "content").join(asked, "query_id")
    verdict = A.repair_feedback(F.col("n"), F.col("relevance"), F.col("diversity"), F.col("recency"))
    gate = gate.select("query_id", "overall", A.gate_tier(F.col("overall")).alias("tier"), verdict.alias("_f"))
    unsure = (F.col("tier") == "low") & ((F.col("_f.action") == "clarify") | (F.col("overall") < clarify_below))
    tiers = asked.select("query_id").join(gate, "query_id", "left").select(
        "query_id", F.coalesce("tier", F.lit("low")).alias("tier"), F.coalesce(unsure, F.lit(True)).alias("unsure"),
        F.coalesce(F.col("_f.issues"), F.array(F.lit("no_results"))).alias("issues"),
    )
    judged = cut_lineage(searched.join(tiers, "query_id").select("query_id", "main_query", "tags", "subs", "tier", "unsure", "issues"))
    sure = judged.where("NOT unsure")
    compound = F.array_contains("tags", "MultiQuestion") & (F.size("subs") > 0)
    subs = sure.where(compound).select("query_id", F.posexplode("subs").alias("no", "s")).select("query_id", "no", "s.id", "s.text", "s.dependencies", "s.stage")
    first = shown.where(F.col("rank") <= SUB_HITS).select("query_id", F.struct("rank", F.left("content", F.lit(SUB_CHARS)).alias("text")).alias("p"))
    contexts = first.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["text"]), "\n").alias("context"))
    merged = O.sub_answer_prompt(staged_answers(subs, contexts, answer), ["query_id"], "no", "text", "answer")
    chosen = RT.dynamic_k(shown.join(sure.where(~compound).select("query_id"), "query_id", "left_semi"), judged)
    direct = plan.where("route = 'direct_generation'").select("query_id", F.format_string(DIRECT_PROMPT, "query").alias("prompt"))
    issues = F.array_join(F.transform("issues", lambda x: F.concat(F.lit("- "), x)), "\n")
    clarify = judged.where("unsure").select("query_id", F.format_string(CLARIFY_PROMPT, "main_query", issues).alias("prompt"))
    prompts = O.generation_prompt(chosen, tags="tags").unionByName(merged).unionByName(direct).unionByName(clarify)
    refs = O.citations(shown.join(sure.select("query_id"), "query_id", "left_semi"), key)
    out = plan.join(judged.select("query_id", "tier", "unsure"), "query_id", "left").join(prompts, "query_id", "left").join(refs, "query_id", "left")
    return out.select(
        "query_id", F.when(F.col("unsure"), "clarify").otherwise(F.col("route")).alias("route"), "tier", "main_query", "enhancements", "prompt",
        answer(F.col("prompt")).alias("answer"), "citations",
    )


def session_updates(queries: DataFrame, answers: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): each answered query and its answer as the next messages of its conversation."""
    rows = queries.select("query_id", "conv_id", "turn", "query").join(answers.select("query_id", "answer"), "query_id")
    said = F.array(
        F.struct(F.col("turn"), F.lit("user").alias("role"), F.col("query").alias("text")),
        F.struct((F.col("turn") + 1).alias("turn"), F.lit("assistant").alias("role"), F.col("answer").alias("text")),
    )
    return rows.select("conv_id", F.explode(said).alias("m")).select("conv_id", "m.turn", "m.role", "m.text")
