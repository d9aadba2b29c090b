"""Context selection, prompts and generation for many queries at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumine import settings as S
from vellumine.functions import rules as R
from vellumine.functions import tokens as K
from vellumine.functions.text import escape_html, let

# Prompt texts.
STANDARD_PROMPT = "基于以下参考信息回答问题：\n参考信息：\n%s\n问题：%s\n请基于以上参考信息回答问题。如果参考信息不足以回答问题，请说明。\n回答时请标注引用来源（如[^1^]）。"
COMPARE_PROMPT = "基于以下参考信息进行对比分析：\n参考信息：\n%s\n对比问题：%s\n请以表格或结构化方式呈现对比结果，明确指出各方面的异同。"
TEMPORAL_PROMPT = "基于以下最新参考信息回答问题：\n参考信息：\n%s\n问题：%s\n请注意信息的时效性，优先使用最新的参考信息。如果参考信息的时间不明确，请说明。"
IDENTITY_SECTION = "\n【重要】用户身份信息: %s\n注意：以下回答必须针对该用户的身份信息，只提供与其身份相关的具体内容，不要提及其他无关类别。\n"
PERSONAL_PROMPT = (
    "请根据以下参考文档回答问题。%s\n参考文档:\n%s\n问题: %s\n回答要求: \n1. 请根据上述【用户身份信息】提供精准、个性化的回答\n"
    "2. 如果文档包含多个类别/级别的信息，只回答与用户身份相关的内容\n3. 不要提供与用户身份无关的其他类别信息\n"
    "4. 回答开头应明确提及用户身份，如：作为普通员工、作为高管"
)
SAFE_PROMPT = "基于以下参考信息回答问题。如果参考信息不足以回答，请明确说明。\n参考信息：\n%s\n用户问题：%s\n%s请提供准确、简洁的回答，并在引用处标注[数字]。"
SUB_ANSWER_PROMPT = "综合以下各部分的回答，给出完整的答案：\n%s\n请确保回答逻辑连贯，过渡自然。"
NO_CONTEXT = "没有找到相关文档。"
CUT_MARK = "...（已截断）\n"


def _ordered(pieces: Column, sep: str) -> Column:
    """Join (rank, text) structs in rank order. A query has at most its top-k pieces."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(pieces)), lambda p: p["text"]), sep)


def prefix_context(hits: DataFrame, limit: int = 4000, content: str = "content") -> DataFrame:
    """(query_id, used, context): labelled segments in rank order until the first overflow.

    Selection stops at the first segment that does not fit, so it is a running sum; when even
    the first is too long it is cut.
    """
    segment = F.concat(F.lit("【参考文档"), F.col("rank").cast("string"), F.lit("】\n"), F.col(content), F.lit("\n"))
    rows = hits.select("query_id", "rank", segment.alias("text"))
    upto = Window.partitionBy("query_id").orderBy("rank")
    rows = rows.withColumn("_total", F.sum(F.length("text")).over(upto))
    fits = F.col("_total") <= limit
    first = F.min_by("text", "rank")
    out = rows.groupBy("query_id").agg(
        F.count_if(fits).alias("used"),
        _ordered(F.when(fits, F.struct("rank", "text")), "\n").alias("_joined"),
        F.concat(F.left(first, F.lit(limit - 50)), F.lit(CUT_MARK)).alias("_cut"),
    )
    return out.select("query_id", "used", F.when(F.col("used") > 0, F.col("_joined")).otherwise(F.col("_cut")).alias("context"))


def context_window(model: str) -> int:
    """Token window of a model: exact name, then part of the name, then the default."""
    if model in S.CONTEXT_WINDOWS:
        return S.CONTEXT_WINDOWS[model]
    return next((v for k, v in S.CONTEXT_WINDOWS.items() if k.lower() in model.lower()), S.DEFAULT_WINDOW)


def truncate_to_tokens(text: Column, budget: Column) -> Column:
    """Longest prefix within ``budget`` tokens, cut at a separator if that keeps over 70 %.

    The estimate grows with the prefix, so its length has a closed form when there are no
    ideographs; otherwise characters are walked once with their running weight.
    """
    room = (budget + 1) / F.lit(1.1)
    plain = F.least(F.length(text), F.ceil(room * 4).cast("int") - 1)

    def walk(t: Column) -> Column:
        weights = F.transform(F.split(t, ""), lambda c: F.when(c.rlike(f"[{S.CJK_BASIC}]"), 1.0).otherwise(0.25))
        step = lambda acc, w: F.struct(
            (acc["sum"] + w).alias("sum"),
            (acc["n"] + F.when(F.floor((acc["sum"] + w) * F.lit(1.1)) <= budget, 1).otherwise(0)).alias("n"),
        )
        return F.aggregate(weights, F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n")), step, lambda acc: acc["n"])

    size = F.when(text.rlike(f"[{S.CJK_BASIC}]"), walk(text)).otherwise(F.greatest(plain, F.lit(0)))

    def snap(cut: Column) -> Column:
        out = F.lit(None).cast("string")
        for sep in reversed(["\n\n", "。", "；", "！", "？", "\n"]):
            at = F.length(cut) - F.length(F.substring_index(cut, sep, -1)) - len(sep)
            fits = F.contains(cut, F.lit(sep)) & (at > F.length(cut) * 0.7)
            out = F.when(fits, F.left(cut, at + len(sep))).otherwise(out)
        return F.coalesce(out, cut)

    return let(F.left(text, size), snap)


def token_budget(hits: DataFrame, query: str = "query", content: str = "content", window: int = S.DEFAULT_WINDOW, identity: str | None = None) -> DataFrame:
    """Hits that fit the token budget, in rank order; the first that does not is cut if over 100 tokens remain.

    Adds tokens, remaining and selected_content; ``selected`` is whole, cut or none.
    """
    used = K.estimate_tokens_budget(F.col(query))
    if identity:
        used = used + F.coalesce(K.estimate_tokens_budget(F.col(identity)), F.lit(0))
    rows = hits.withColumn("tokens", K.estimate_tokens_budget(F.col(content))).withColumn("budget", window - S.RESERVED_TOKENS - used)
    upto = Window.partitionBy("query_id").orderBy("rank")
    cost = F.col("tokens") + S.CHUNK_LABEL_TOKENS
    rows = rows.withColumn("_sum", F.sum(cost).over(upto)).withColumn("remaining", F.col("budget") - (F.col("_sum") - cost))
    fits = F.col("_sum") <= F.col("budget")
    # Costs are positive, so the overflow row is the one whose predecessors all fit.
    boundary = ~fits & (F.col("remaining") >= 0)
    state = F.when(fits, "whole").when(boundary & (F.col("remaining") > 100), "cut").otherwise("none")
    text = F.when(F.col("selected") == "whole", F.col(content)).when(
        F.col("selected") == "cut", F.concat(truncate_to_tokens(F.col(content), F.col("remaining") - 30), F.lit("...(已截断)"))
    )
    return rows.withColumn("selected", state).withColumn("selected_content", text).drop("_sum")


def window_check(prompt: Column, window: int = S.DEFAULT_WINDOW, output: int = S.OUTPUT_TOKENS) -> Column:
    needed = K.estimate_tokens_budget(prompt) + output
    return F.struct((needed <= window).alias("is_valid"), needed.alias("total_needed"), (F.lit(window) - needed).alias("remaining"))


def generation_prompt(hits: DataFrame, query: str = "query", content: str = "content", tags: str | None = None, top: int = 5, size: int = 500) -> DataFrame:
    """(query_id, prompt): top hits of ``size`` characters in the template their tags ask for."""
    piece = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.left(F.col(content), F.lit(size)))
    group = hits.where(F.col("rank") <= top).select("query_id", "rank", piece.alias("text"), F.col(query).alias("_q"), *([F.col(tags).alias("_tags")] if tags else []))
    grouped = group.groupBy("query_id").agg(
        _ordered(F.struct("rank", "text"), "\n\n").alias("_c"), F.any_value("_q").alias("_q"), *([F.any_value("_tags").alias("_tags")] if tags else [])
    )
    fill = lambda t: F.format_string(t, F.col("_c"), F.col("_q"))
    prompt = fill(STANDARD_PROMPT)
    if tags:
        has = lambda tag: F.array_contains("_tags", tag)
        prompt = F.when(has("Comparative"), fill(COMPARE_PROMPT)).when(has("Temporal"), fill(TEMPORAL_PROMPT)).otherwise(prompt)
    return grouped.select("query_id", prompt.alias("prompt"))


def personal_prompt(query: Column, context: Column, profile: Column) -> Column:
    """Prompt with an identity section from a profile map, when it is not empty."""
    entries = F.array_sort(F.map_entries(profile))
    identity = F.array_join(F.transform(entries, lambda e: F.concat_ws(": ", e["key"], e["value"])), "; ")
    section = F.when(F.coalesce(F.size(profile), F.lit(0)) > 0, F.format_string(IDENTITY_SECTION, identity)).otherwise("")
    return F.format_string(PERSONAL_PROMPT, section, context, query)


def safe_prompt(hits: DataFrame, query: str = "query", content: str = "content", patterns: Sequence[str] = S.INJECTION_PATTERNS, top: int = 5, identity: str | None = None) -> DataFrame:
    """Prompt with dangerous chunks replaced, the query sanitised and all text escaped."""
    body = F.when(R.is_injection(F.col(content), patterns), S.INJECTION_CHUNK_MARK).otherwise(F.col(content))
    piece = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), escape_html(body))
    extra = [F.col(identity).alias("_identity")] if identity else []
    rows = hits.where(F.col("rank") <= top).select("query_id", "rank", piece.alias("text"), F.col(query).alias("_q"), *extra)
    grouped = rows.groupBy("query_id").agg(
        _ordered(F.struct("rank", "text"), "\n").alias("_c"), F.any_value("_q").alias("_q"), *([F.any_value("_identity").alias("_identity")] if identity else [])
    )
    note = F.when(F.coalesce(F.col("_identity"), F.lit("")) != "", F.concat(F.lit("用户身份信息："), escape_html(F.col("_identity")), F.lit("\n"))).otherwise("") if identity else F.lit("")
    return grouped.select("query_id", F.format_string(SAFE_PROMPT, F.col("_c"), escape_html(R.sanitize_query(F.col("_q"), patterns)), note).alias("prompt"))


def citations(hits: DataFrame, key: str = "doc_id", content: str = "content", top: int = 5) -> DataFrame:
    """(query_id, citations): id, document, source and a 100-character preview of each cited hit."""
    cited = F.struct("rank", F.col(key).alias("doc_id"), "source", F.concat(F.left(F.col(content), F.lit(100)), F.lit("...")).alias("preview"))
    return hits.where(F.col("rank") <= top).groupBy("query_id").agg(F.array_sort(F.collect_list(cited)).alias("citations"))


def reference_footer(hits: DataFrame, name: str = "document_name", top: int = 5) -> DataFrame:
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col(name))
    rows = hits.where(F.col("rank") <= top).select("query_id", "rank", line.alias("text"))
    return rows.groupBy("query_id").agg(_ordered(F.struct("rank", "text"), "\n").alias("footer"))


def sub_answer_prompt(parts: DataFrame, group: Sequence[str], order: str, question: str = "question", answer: str = "answer") -> DataFrame:
    """Questions and answers of one compound query as a single prompt."""
    text = F.concat(F.lit("Q: "), F.col(question), F.lit("\nA: "), F.col(answer))
    rows = parts.select(*group, F.col(order).alias("rank"), text.alias("text"))
    return rows.groupBy(*group).agg(F.format_string(SUB_ANSWER_PROMPT, _ordered(F.struct("rank", "text"), "\n")).alias("prompt"))


def first_sentence(prompts: list[str]) -> list[str]:
    """Stand-in generator: the first context sentence."""
    out = []
    for p in prompts:
        context = p.split("参考信息：\n", 1)[-1].split("\n问题", 1)[0]
        out.append(context.split("。")[0].split(". ")[0])
    return out


def generate(prompts: DataFrame, model: Callable[[list[str]], list[str]] = first_sentence, key: str = "query_id", prompt: str = "prompt") -> DataFrame:
    """(key, answer, prompt_tokens, answer_tokens, generation_ms): batched calls of any model."""
    import time

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            start = time.perf_counter()
            answers = model(batch["prompt"].tolist())
            took = (time.perf_counter() - start) * 1000 / max(len(batch), 1)
            yield pd.DataFrame({"key": batch["key"], "prompt": batch["prompt"], "answer": answers, "generation_ms": took})

    rows = prompts.select(F.col(key).alias("key"), F.col(prompt).alias("prompt"))
    kind = rows.schema["key"].dataType.simpleString()
    made = rows.mapInPandas(run, f"key {kind}, prompt string, answer string, generation_ms double")
    return made.select(
        F.col("key").alias(key), "answer", K.estimate_tokens_budget(F.col("prompt")).alias("prompt_tokens"),
        K.estimate_tokens_budget(F.col("answer")).alias("answer_tokens"), "generation_ms",
    )

