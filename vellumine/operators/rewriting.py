"""Query rewriting: expansion, enrichment, references, decomposition, profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine import settings as S
from vellumine.functions import rules as R
from vellumine.functions import tokens as K
from vellumine.functions.text import char_class, let, strip

_NONE = "array<string>"


def expand_query(query: Column, intent: Column | None = None, synonyms: Mapping[str, Sequence[str]] = S.SYNONYMS, stop: Sequence[str] = S.SEARCH_STOP_WORDS, limit: int = 8) -> Column:
    """Distinct query variants in a fixed order, the original first: intent templates, keywords
    moved to the front or back, synonyms."""
    none = F.array().cast(_NONE)
    bare = F.replace(query, F.lit("?"), F.lit(""))
    variants = [F.array(query)]
    if intent is not None:
        cat = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
        how, fix = F.replace(bare, F.lit("如何"), F.lit("")), F.replace(bare, F.lit("如何解决"), F.lit(""))
        templates = {
            "faq": [cat("如何", how), cat(bare, "的方法"), cat(bare, "的步骤"), cat(bare, "怎么做")],
            "info": [cat("关于", query, "的详细信息"), cat(query, "的定义"), cat(query, "的特点")],
            "troubleshooting": [cat("解决", fix), cat(fix, "的问题"), cat(fix, "的解决方案")],
        }
        variants += [F.when(intent == name, F.array(*ts)).otherwise(none) for name, ts in templates.items()]

    def moved(ks: Column) -> Column:
        def one(k: Column) -> Column:
            rest = F.trim(F.replace(query, k, F.lit("")))
            return F.array(F.concat_ws(" ", k, rest), F.concat_ws(" ", rest, k))

        return F.when(F.size(ks) > 1, F.flatten(F.transform(F.filter(ks, lambda k: F.length(k) > 2), one))).otherwise(none)

    variants.append(let(K.keywords(query, stop), moved))
    for word, others in synonyms.items():
        swapped = F.array(*[F.replace(query, F.lit(word), F.lit(o)) for o in others])
        variants.append(F.when(F.contains(query, F.lit(word)), swapped).otherwise(none))
    return F.slice(F.array_distinct(F.concat(*variants)), 1, limit)


def variant_rows(queries: DataFrame, variants: Column, key: str = "query_id") -> DataFrame:
    return queries.select(key, F.posexplode(variants).alias("variant_no", "variant"))


def enrich_query(
    query: Column, topics: Column | None = None, lodging=S.ENRICH_LODGING, levels=S.ENRICH_LEVELS, cities=S.ENRICH_CITIES, topic_terms: Mapping[str, Sequence[str]] = S.ENRICH_TOPICS
) -> Column:
    """Append the mapped domain terms that the query does not yet contain, in table order."""
    none = F.array().cast(_NONE)
    lits = lambda ws: F.array(*[F.lit(w) for w in ws])

    def first(rules) -> Column:
        out = None
        for words, terms in rules:
            test = R.any_of(query, words)
            out = F.when(test, lits(terms)) if out is None else out.when(test, lits(terms))
        return out.otherwise(none)

    found = [first([lodging]), first(levels), first(cities)]
    if topics is not None:
        found += [F.when(F.array_contains(topics, t), lits(terms)).otherwise(none) for t, terms in topic_terms.items()]
    terms = F.filter(F.array_distinct(F.concat(*found)), lambda t: ~F.contains(query, t))
    return F.array_join(F.concat(F.array(query), terms), " ")


def with_context(query: Column, context: Column, stop: Sequence[str] = S.SEARCH_STOP_WORDS, limit: int = 500, bridge: str = "，考虑之前的对话内容：") -> Column:
    """Append up to five context keywords that the query lacks; capped at ``limit`` characters."""
    extra = F.slice(F.array_except(K.keywords(context, stop), K.keywords(query, stop)), 1, 5)
    full = let(extra, lambda ws: F.when(F.size(ws) > 0, F.concat(query, F.lit(bridge), F.array_join(ws, " "))).otherwise(query))
    return let(full, lambda q: F.when(F.length(q) > limit, F.concat(F.left(q, F.lit(limit)), F.lit("..."))).otherwise(q))


def resolve_references(query: Column, entities: Column, words: Sequence[str] = S.COREFERENCE_WORDS) -> Column:
    """Replace the first occurrence of each reference word by the best session entity.

    ``entities`` is array<struct<name, confidence, timestamp>>. An entity scores its confidence
    plus 0.2 for each of its longer words in the query; it must exceed 0.5, ties go to the
    most recent.
    """

    def scored(q: Column) -> Column:
        def one(e: Column) -> Column:
            parts = F.filter(F.split(e["name"], " "), lambda p: (F.length(p) > 2) & F.contains(q, p))
            return F.struct(
                (e["confidence"] + F.when(F.length(e["name"]) > 2, F.size(parts) * 0.2).otherwise(0.0)).alias("score"),
                e["timestamp"].alias("timestamp"), e["name"].alias("name"),
            )

        ranked = F.reverse(F.array_sort(F.transform(entities, one)))
        return F.get(F.filter(ranked, lambda e: e["score"] > 0.5), F.lit(0))["name"]

    def replace_all(best: Column) -> Column:
        def swap(acc: Column, w: Column) -> Column:
            at = F.call_function("instr", acc, w)
            tail = F.substr(acc, at + F.length(w))
            after = F.when(F.startswith(tail, F.lit("个")), F.substr(tail, F.lit(2))).otherwise(tail)
            return F.when(at > 0, F.concat(F.left(acc, at - 1), best, after)).otherwise(acc)

        done = F.aggregate(F.array(*[F.lit(w) for w in words]), query, swap)
        return F.when(best.isNull(), query).otherwise(done)

    return let(scored(query), replace_all)


def ambiguous_entities(query: Column, table: Mapping[str, Sequence[str]] = S.AMBIGUOUS_WORDS) -> Column:
    """array<struct<entity, meaning>>: ambiguous words found, each with its likeliest reading."""
    lowered = F.lower(query)
    rows = [F.when(F.contains(lowered, F.lit(e)), F.struct(F.lit(e).alias("entity"), F.lit(m[0]).alias("meaning"))) for e, m in table.items()]
    return F.array_compact(F.array(*rows))


def hypotheses(query: Column, table: Mapping[str, Sequence[str]] = S.AMBIGUOUS_WORDS, limit: int = 3) -> Column:
    """array<struct<text, entity, confidence>>: template documents for each reading, or one for the query.

    The template is chosen by a digest of the query, so a rerun gives the same text.
    """

    def text(q: Column) -> Column:
        pick = F.conv(F.substring(F.md5(q.cast("binary")), 1, 8), 16, 10).cast("bigint") % len(S.HYPOTHESIS_TEMPLATES)
        body = None
        for i, t in enumerate(S.HYPOTHESIS_TEMPLATES):
            filled = F.concat(F.lit(t.split("{q}")[0]), q, F.lit(t.split("{q}")[1]))
            body = F.when(pick == i, filled) if body is None else body.when(pick == i, filled)
        words = K.word_keywords(q, S.REWRITE_STOP_WORDS, lower=False, limit=5)
        return let(words, lambda ws: F.when(F.size(ws) > 0, F.concat(body, F.lit(" "), F.array_join(ws, ", "), F.lit("等关键信息。"))).otherwise(body))

    row = lambda t, e, c: F.struct(t.alias("text"), e.cast("string").alias("entity"), F.lit(c).alias("confidence"))

    def build(found: Column) -> Column:
        each = F.transform(found, lambda x: row(text(F.regexp_replace(query, F.concat(F.lit("(?i)\\Q"), x["entity"], F.lit("\\E")), x["meaning"])), x["meaning"], 0.7))
        return F.when(F.size(found).between(1, limit), each).otherwise(F.array(row(text(query), F.lit(None), 0.8)))

    return let(ambiguous_entities(query, table), build)


def decompose(query: Column, marks: str = S.SENTENCE_MARKS, connectors: Sequence[str] = S.SPLIT_CONNECTORS, back: Sequence[str] = S.BACK_REFERENCES) -> Column:
    """array<struct<id, text, dependencies>>: sentences, or connector parts of a single sentence.

    A part with a back-reference depends on all parts before it.
    """
    bare = lambda parts: F.filter(F.transform(parts, strip), lambda s: s != "")
    joined = "|".join("\\Q" + c + "\\E" for c in connectors)

    def parts_of(sentences: Column) -> Column:
        return F.when(F.size(sentences) == 1, bare(F.split(query, joined))).otherwise(sentences)

    def one(p: Column, i: Column) -> Column:
        name = lambda j: F.concat(F.lit("sub_"), j.cast("string"))
        deps = F.when((i > 0) & R.any_of(p, back), F.transform(F.sequence(F.lit(0), F.greatest(i - 1, F.lit(0))), name)).otherwise(F.array().cast(_NONE))
        return F.struct(name(i).alias("id"), p.alias("text"), deps.alias("dependencies"))

    return F.transform(let(bare(F.split(query, f"[{char_class(marks)}]")), parts_of), one)


def stages(subqueries: Column) -> Column:
    """Stage number of each sub-query (longest dependency chain), in order.

    Dependencies point backwards, so one ordered pass settles every level.
    """
    number = lambda d: F.substring_index(d, "_", -1).cast("int")

    def step(done: Column, s: Column) -> Column:
        levels = F.transform(s["dependencies"], lambda d: F.get(done, number(d)))
        return F.array_append(done, F.when(F.size(levels) > 0, F.array_max(levels) + 1).otherwise(0))

    return F.aggregate(subqueries, F.array().cast("array<int>"), step)


def comparative_subqueries(query: Column) -> Column:
    """Two information queries and a dependent analysis, or an empty array."""
    row = lambda i, t, d: F.struct(F.lit(i).alias("id"), t.alias("text"), d.cast(_NONE).alias("dependencies"))

    def build(sides: Column) -> Column:
        a, b = F.get(sides, F.lit(0)), F.get(sides, F.lit(1))
        info = F.lit("的相关信息")
        rows = F.array(
            row("comp_0", F.concat(a, info), F.array()),
            row("comp_1", F.concat(b, info), F.array()),
            row("comp_analysis", F.concat(F.lit("对比分析"), a, F.lit("和"), b, F.lit("的异同")), F.array(F.lit("comp_0"), F.lit("comp_1"))),
        )
        return F.when(F.size(sides) >= 2, rows).otherwise(F.filter(rows, lambda r: F.lit(False)))

    return let(R.comparative_entities(query), build)


def enhancements(tags: Column, n_hypotheses: Column, resolved: Column, n_compare: Column) -> Column:
    """Names of the enhancements applied to a query, by its tags."""
    has = lambda t: F.array_contains(tags, t)
    return F.array_compact(
        F.array(
            F.when(has("HistoryRef") & resolved, "coreference_resolution"),
            F.when(has("Ambiguous"), F.when(n_hypotheses > 1, "hyde_multi").otherwise("hyde_single")),
            F.when(has("MultiQuestion"), "query_decomposition"),
            F.when(has("Temporal"), "temporal_injection"),
            F.when(has("Comparative") & (n_compare > 0), "comparative_expansion"),
        )
    )


def is_contextual(query: Column, words: Sequence[str] = S.CONTEXT_WORDS, min_chars: int = 10, model: Column | None = None) -> Column:
    """Whether the query leans on its dialogue: a reference word, a very short text, or a model's verdict."""
    rule = R.any_of(query, words) | (F.length(query) < min_chars)
    return rule if model is None else rule | F.coalesce(model, F.lit(False))


def parse_context_info(output: Column) -> Column:
    """struct(topic, entities, identity, summary) from labelled lines of a model's output."""
    field = lambda names: strip(F.regexp_extract(output, f"(?m)^\\s*(?:{names})\\s*[:：]\\s*(.*)$", 1))
    listed = F.filter(F.transform(F.split(field("关键实体|实体|entities"), "[,，、]"), strip), lambda x: (x != "") & (x != "无"))
    pairs = F.filter(F.split(field("身份信息|用户身份|身份|identity"), "[,，;；]"), lambda x: x.rlike("[=＝:：]"))
    entry = lambda p: F.struct(strip(F.regexp_extract(p, "^([^=＝:：]+)", 1)).alias("key"), strip(F.regexp_extract(p, "[=＝:：](.*)$", 1)).alias("value"))
    return F.struct(
        field("主题|话题|topic").alias("topic"), listed.alias("entities"),
        F.map_from_entries(F.transform(pairs, entry)).alias("identity"), field("摘要|总结|summary").alias("summary"),
    )


def accumulate_profile(facts: DataFrame, group: str, key: str, value: str, order: str) -> DataFrame:
    """(group, profile): the latest value of every key. An aggregate per (group, key) keeps one row
    each before the map is built, so a long dialogue is never collected."""
    latest = facts.groupBy(group, key).agg(F.max_by(value, order).alias(value))
    return latest.groupBy(group).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value)))).alias("profile"))

