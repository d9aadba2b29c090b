"""Rule-based labels: categories, intents, scenes, safety. All are column expressions over
parameter tables, so one pass over the text scores every rule without a join."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellumine import settings as S
from vellumine.functions.text import let, strip


def occurrences(text: Column, word: str) -> Column:
    """Non-overlapping occurrences of a literal; replace-and-measure beats a regex."""
    return (F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / F.lit(len(word))


def any_of(text: Column, words: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def first_label(text: Column, table: Mapping[str, Sequence[str]], default: str | None = None) -> Column:
    """Label of the first entry with an occurring word."""
    out = None
    for label, words in table.items():
        out = F.when(any_of(text, words), label) if out is None else out.when(any_of(text, words), label)
    return out.otherwise(F.lit(default))


def all_labels(text: Column, table: Mapping[str, Sequence[str]]) -> Column:
    """Comma-joined labels of every entry with an occurring word."""
    return F.concat_ws(",", *[F.when(any_of(text, words), F.lit(label)) for label, words in table.items()])


# --- document categories ------------------------------------------------------------------


def category_scores(
    content: Column,
    title: Column | None = None,
    keyword_table: Mapping[str, Sequence[tuple[str, int]]] | None = None,
    title_table: Mapping[str, Sequence[str]] = S.CATEGORY_TITLES,
) -> list[tuple[str, Column]]:
    if keyword_table is None:
        keyword_table = S.CATEGORY_KEYWORDS
    lowered = F.lower(content)
    scores = []
    for category, words in keyword_table.items():
        parts = [F.least(occurrences(lowered, w.lower()), F.lit(3.0)) * weight for w, weight in words]
        if title is not None:
            parts += [F.when(title.rlike("(?i)" + p), 5.0).otherwise(0.0) for p in title_table.get(category, [])]
        scores.append((category, reduce(lambda a, b: a + b, parts)))
    return scores


def document_category(content: Column, title: Column | None = None, **tables) -> Column:
    """struct(category, confidence, score); ties go to the category declared first."""
    scores = category_scores(content, title, **tables)
    named = F.array(*[F.struct(F.lit(c).alias("category"), s.alias("score")) for c, s in scores])
    start = F.struct(F.lit("unknown").alias("category"), F.lit(-1.0).alias("score"), F.lit(0.0).alias("total"))

    def step(acc: Column, x: Column) -> Column:
        better = x["score"] > acc["score"]
        return F.struct(
            F.when(better, x["category"]).otherwise(acc["category"]).alias("category"),
            F.greatest(x["score"], acc["score"]).alias("score"),
            (acc["total"] + x["score"]).alias("total"),
        )

    def finish(acc: Column) -> Column:
        share = F.least(acc["score"] / F.greatest(acc["total"] * 0.5, F.lit(1.0)), F.lit(1.0))
        return F.struct(
            F.when(acc["score"] < 3, "unknown").otherwise(acc["category"]).alias("category"),
            F.when(acc["total"] > 0, share).otherwise(0.0).alias("confidence"),
            acc["score"].alias("score"),
        )

    return F.aggregate(named, start, step, finish)


def filename_category(filename: Column, table: Mapping[str, Sequence[str]] = S.CATEGORY_FILENAMES) -> Column:
    return first_label(F.lower(filename), table, "unknown")


def combined_category(content: Column, title: Column, filename: Column, name_table=S.CATEGORY_FILENAMES, **tables) -> Column:
    """Content first; a confidence under 0.5 defers to a known filename category."""
    by_name = filename_category(filename, name_table)
    return let(
        document_category(content, title, **tables),
        lambda found: F.when((found["confidence"] < 0.5) & (by_name != "unknown"), by_name).otherwise(found["category"]),
    )


def is_policy(content: Column, patterns: Sequence[str] = S.POLICY_PATTERNS, at_least: int = 3) -> Column:
    return reduce(lambda a, b: a + b, [content.rlike(p).cast("int") for p in patterns]) >= at_least


def layout_file_type(text: Column, rules: Mapping[str, Mapping]) -> Column:
    """File type of a laid-out document: matched weight over possible weight, per-type threshold.

    ``rules`` maps a type to {"keywords": [...], "patterns": [...], "threshold": x}; keywords
    weigh 0.1 and patterns 0.3. The highest score over its threshold wins, else ``general``.
    """
    lowered = F.lower(text)
    best = F.struct(F.lit("general").alias("file_type"), F.lit(0.0).alias("score"))
    for name, rule in rules.items():
        words, patterns = rule.get("keywords", []), rule.get("patterns", [])
        possible = 0.1 * len(words) + 0.3 * len(patterns)
        parts = [F.contains(lowered, F.lit(w.lower())).cast("double") * 0.1 for w in words]
        parts += [text.rlike(p).cast("double") * 0.3 for p in patterns]
        score = reduce(lambda a, b: a + b, parts) / possible
        mine = F.struct(F.lit(name).alias("file_type"), score.alias("score"))
        best = F.when((score >= rule.get("threshold", 0.5)) & (score > best["score"]), mine).otherwise(best)
    return best


def level_tags(text: Column, table=S.LEVEL_WORDS) -> Column:
    return all_labels(text, table)


def expense_tags(text: Column, table=S.EXPENSE_WORDS) -> Column:
    return all_labels(text, table)


# --- queries ------------------------------------------------------------------------------


def query_intent(query: Column, rules=S.INTENT_RULES, default=S.INTENT_DEFAULT, bare: Callable[[Column], Column] | None = None) -> Column:
    """struct(intent, confidence) of the first rule that matches. ``bare`` prepares the text: by default lower case without
    white space at both ends."""
    text = bare(query) if bare else strip(F.lower(query))
    pick = lambda name, conf: F.struct(F.lit(name).alias("intent"), F.lit(float(conf)).alias("confidence"))
    out = None
    for name, conf, patterns in rules:
        test = text.rlike("|".join(f"(?:{p})" for p in patterns))
        out = F.when(test, pick(name, conf)) if out is None else out.when(test, pick(name, conf))
    return out.otherwise(pick(*default))


def intent_top_k(intent: Column, table: Mapping[str, int] = S.INTENT_TOP_K) -> Column:
    pairs = F.create_map(*[F.lit(x) for item in table.items() for x in item])
    return F.coalesce(pairs[intent], F.lit(table["other"]))


def dialogue_intent(query: Column, rules=S.DIALOGUE_INTENTS) -> Column:
    """struct(intent, confidence): the last rule that matches wins, question by default."""
    out = F.lit(None)
    for name, words in rules:
        out = F.when(any_of(query, words), F.lit(name)).otherwise(out)
    return F.struct(
        F.coalesce(out, F.lit("question")).alias("intent"),
        F.when(out.isNotNull(), 0.8).otherwise(0.5).alias("confidence"),
    )


def scene_tags(
    query: Column,
    has_history: Column | bool = False,
    *,
    history: str = S.SCENE_HISTORY,
    compare: str = S.SCENE_COMPARE,
    temporal: str = S.SCENE_TEMPORAL,
    small_talk: str = S.SCENE_SMALL_TALK,
    question_words: Sequence[str] = S.SCENE_QUESTION_WORDS,
    connectors: Sequence[str] = S.SCENE_CONNECTORS,
    intent_words: Sequence[str] = S.SCENE_INTENT_WORDS,
    ambiguous: Sequence[str] = tuple(S.AMBIGUOUS_WORDS),
    sentence_marks: str = S.SENTENCE_MARKS,
) -> Column:
    """struct(tags, confidence): scene labels of a query and a map of their confidences."""
    has_history = F.lit(has_history) if isinstance(has_history, bool) else has_history
    total = lambda parts: reduce(lambda a, b: a + b, parts)
    lowered, bare = F.lower(query), strip(query)

    back_refs = F.regexp_count(query, F.lit("(?i)" + history))
    history_conf = F.when(has_history & (back_refs > 0), F.least(0.6 + back_refs * 0.1, F.lit(0.95)))

    readings = total([F.contains(lowered, F.lit(w)).cast("int") for w in ambiguous])
    signals = total([F.contains(query, F.lit(w)).cast("int") for w in intent_words])
    ambiguous_conf = F.when(readings > 0, F.least(0.5 + readings * 0.15, F.lit(0.9))).when(signals > 2, 0.6)

    asked = total([occurrences(query, w) for w in question_words])
    linked = total([F.contains(query, F.lit(w)).cast("int") for w in connectors])
    sentences = F.size(F.filter(F.split(query, f"[{sentence_marks}]"), lambda s: strip(s) != ""))
    multi_conf = (
        F.when((asked >= 2) & (sentences >= 2), 0.8)
        .when((linked > 0) & (asked >= 1), 0.6)
        .when(sentences >= 3, 0.5)
    )

    talk_conf = F.when((bare == "") | bare.rlike("(?i)" + small_talk), 0.95).when(F.length(bare) < 5, 0.7)

    dated = F.regexp_count(query, F.lit("(?i)" + temporal))
    temporal_conf = F.when(dated > 0, F.least(0.5 + dated * 0.1, F.lit(0.95)))

    sides = comparative_entities(query)
    compare_conf = F.when(
        query.rlike("(?i)" + compare), F.least(0.6 + F.size(sides) * 0.1, F.lit(0.9))
    )

    scored = [
        ("HistoryRef", history_conf),
        ("Ambiguous", ambiguous_conf),
        ("MultiQuestion", multi_conf),
        ("NonRetrieval", talk_conf),
        ("Temporal", temporal_conf),
        ("Comparative", compare_conf),
    ]
    entries = F.array_compact(
        F.array(
            *[
                F.when(c.isNotNull(), F.struct(F.lit(n).alias("key"), F.round(c.cast("double"), 6).alias("value")))
                for n, c in scored
            ]
        )
    )
    return F.struct(
        F.transform(entries, lambda e: e["key"]).alias("tags"),
        F.map_from_entries(entries).alias("confidence"),
    )


def comparative_entities(query: Column) -> Column:
    """The two sides of a comparison, or an empty array."""
    word = "([\\p{L}\\p{N}_]+)"
    found = [
        f"(?i){word}[和与跟].*?{word}.*?[区别差异不同对比]",
        f"(?i){word}\\s*vs\\s*{word}",
    ]
    out = F.array().cast("array<string>")
    for pattern in reversed(found):
        pair = F.array(F.regexp_extract(query, pattern, 1), F.regexp_extract(query, pattern, 2))
        out = F.when(query.rlike(pattern), pair).otherwise(out)
    return out


def route(tags: Column) -> Column:
    out = None
    for tag, name in S.ROUTES:
        test = F.array_contains(tags, tag)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(S.ROUTE_DEFAULT)


# --- safety -------------------------------------------------------------------------------


def injection_pattern(patterns: Sequence[str] = S.INJECTION_PATTERNS) -> str:
    return "(?i)" + "|".join(f"(?:{p})" for p in patterns)


def is_injection(text: Column, patterns: Sequence[str] = S.INJECTION_PATTERNS) -> Column:
    return text.rlike(injection_pattern(patterns))


def sanitize_query(query: Column, patterns: Sequence[str] = S.INJECTION_PATTERNS, mark: str = S.INJECTION_QUERY_MARK) -> Column:
    for pattern in patterns:
        query = F.regexp_replace(query, "(?i)" + pattern, mark)
    return query


def prompt_safety(prompt: Column, patterns: Sequence[str] = S.INJECTION_PATTERNS, limit: int = S.PROMPT_MAX_CHARS) -> Column:
    issues = F.array_compact(
        F.array(
            F.when(is_injection(prompt, patterns), "包含潜在危险内容"),
            F.when(F.length(prompt) > limit, "Prompt过长"),
            F.when(prompt.rlike("<\\|.*?\\|>"), "包含特殊token"),
        )
    )
    return F.struct((F.size(issues) == 0).alias("is_safe"), issues.alias("issues"), F.length(prompt).alias("length"))


def admission_error(query: Column, words: Sequence[str] = S.SENSITIVE_WORDS, limit: int = S.REQUEST_MAX_CHARS) -> Column:
    """Reason to refuse a request, or null."""
    return F.when(F.length(query) > limit, f"Query too long (max {limit} chars)").when(
        any_of(F.lower(query), words), "Query contains sensitive words"
    )


def mask_value(value: Column, visible: int = 4) -> Column:
    size = F.length(value)
    ends = F.lit(visible)
    return F.when(size <= 2 * visible, F.repeat(F.lit("*"), size)).otherwise(
        F.concat(F.left(value, ends), F.repeat(F.lit("*"), size - 2 * visible), F.right(value, ends))
    )


def mask_secrets(text: Column, patterns: Sequence[str] = S.SECRET_PATTERNS) -> Column:
    """Mask the captured value of every secret-shaped match, keeping four characters each side.

    The star count varies, so the distinct matches are folded over the text.
    """

    def mask_matches(acc: Column, pattern: Column) -> Column:
        value = lambda m: F.call_function("regexp_extract", m, pattern, F.lit(1))
        return F.aggregate(
            F.array_distinct(F.regexp_extract_all(acc, pattern, 0)),
            acc,
            lambda done, m: F.replace(done, m, F.replace(m, value(m), mask_value(value(m)))),
        )

    return F.aggregate(
        F.array(*[F.lit(p) for p in patterns]),
        text,
        lambda acc, p: F.when(F.rlike(acc, p), mask_matches(acc, p)).otherwise(acc),
    )


def redact_map(data: Column, keys: Sequence[str] = S.SECRET_KEYS) -> Column:
    """Mask the values of a string map whose key names a secret."""
    return F.transform_values(data, lambda k, v: F.when(any_of(F.lower(k), keys), mask_value(v)).otherwise(v))


HIDDEN = "******"


def redact_json(text: Column, keys: Sequence[str] = S.SECRET_KEYS, depth: int = 8) -> Column:
    """JSON text in which values under secret keys are hidden, at any place of nested objects and arrays.

    A secret text is masked, a secret object is searched on, any other secret value becomes ``HIDDEN``; below ``depth`` levels
    all objects and arrays do. Keys come out in alphabetical order. Text that isn't JSON gets the masks of ``mask_secrets``.
    """
    kind = lambda v: F.substring_index(F.schema_of_variant(v), "<", 1)
    quoted = lambda c: F.to_json(c.cast("variant"))
    pair = lambda k, v: F.struct(k.cast("string").alias("k"), v.alias("v"))

    def walk(v: Column, levels: int) -> Column:
        nested = kind(v).isin("OBJECT", "ARRAY")
        if not levels:
            return F.when(nested, quoted(F.lit(HIDDEN))).otherwise(F.to_json(v))

        def piece(e: Column) -> Column:
            secret = F.coalesce(any_of(F.lower(e["k"]), keys), F.lit(False))
            shown = F.when(~secret | (kind(e["v"]) == "OBJECT"), walk(e["v"], levels - 1)).when(
                kind(e["v"]) == "STRING", quoted(mask_value(e["v"].cast("string")))
            )
            return F.concat(F.coalesce(F.concat(quoted(e["k"]), F.lit(":")), F.lit("")), F.coalesce(shown, quoted(F.lit(HIDDEN))))

        fields = F.transform(F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")), lambda e: pair(e["key"], e["value"]))
        items = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: pair(F.lit(None), x))
        inner = F.array_join(F.transform(F.coalesce(fields, items), piece), ",")
        ends = lambda a, b: F.when(kind(v) == "OBJECT", a).otherwise(b)
        return F.when(nested, F.concat(ends("{", "["), inner, ends("}", "]"))).otherwise(F.to_json(v))

    def build(v: Column) -> Column:
        return F.when(v.isNotNull(), walk(v, depth))

    return F.coalesce(let(F.try_parse_json(text), build), mask_secrets(text))


# --- expense entities and titles ------------------------------------------------------------

# Slots of an expense question, prefixes and replacements of its short title.
RANK_WORDS = {
    "总监": ["总监", "director", "chief"],
    "经理": ["经理", "manager", "主管"],
    "员工": ["员工", "职员", "staff", "我"],
}
EXPENSE_SLOT_WORDS = {
    "差旅费": ["差旅", "出差", "机票", "酒店", "住宿", "火车", "交通"],
    "招待费": ["招待", "宴请", "客户", "吃饭", "礼品"],
    "通讯费": ["通讯", "电话", "手机", "话费", "流量"],
    "报销额度": ["报销", "报多少", "额度", "标准", "限额", "能报"],
}
INTENTION_WORDS = {
    "查询标准": ["多少", "标准", "额度", "限额", "能报", "可以报", "怎么算"],
    "申请流程": ["怎么申请", "流程", "审批", "需要谁批", "找谁"],
    "材料要求": ["需要什么", "材料", "发票", "单据", "凭证"],
    "违规处理": ["违规", "处罚", "罚款", "假发票"],
}
TITLE_PREFIXES = ["标题：", "摘要：", "输出：", "结果：", "Title:", "Summary:", "→", "- ", "1.", "1、"]
TITLE_WRAPPERS = "\"'「」[]【】()（）"
TITLE_TERMS = {
    "飞机": "差旅", "酒店": "住宿", "吃饭": "招待", "电话费": "通讯费",
    "能报多少": "标准", "怎么申请": "申请流程", "需要什么": "材料清单",
}
TITLE_BREAKS = "，。、；：！？ ,.;:!?"


def expense_slots(text: Column) -> Column:
    return F.struct(
        first_label(text, RANK_WORDS).alias("rank"),
        first_label(text, EXPENSE_SLOT_WORDS).alias("expense_type"),
        first_label(text, INTENTION_WORDS).alias("intention"),
    )


def smart_truncate(text: Column, limit: int = 15) -> Column:
    """Shorten to ``limit``, backing up to a mark in the second half, then to a script change."""
    marks = "".join("\\" + c if c in ".?" else c for c in TITLE_BREAKS)
    # A mark at position i keeps the i characters before it, limit//2 < i <= limit.
    at_mark = f"(?s)^(.{{{limit // 2 + 1},{limit}}})[{marks}]"
    # Greedy: the latest ideograph-to-letter boundary, at least three characters in.
    at_script = f"(?s)^(.{{2,{limit - 1}}}[{S.CJK_BASIC}])(?=[a-zA-Z])"
    return let(
        text,
        lambda t: F.when(F.length(t) <= limit, t)
        .when(t.rlike(at_mark), F.regexp_extract(t, at_mark, 1))
        .when(t.rlike(at_script), F.regexp_extract(t, at_script, 1))
        .otherwise(F.left(t, F.lit(limit))),
    )


def short_title(raw: Column, original: Column) -> Column:
    """Conversation title: prefixes and quotes off, missing slots added, terms unified, 15 characters."""
    wrappers = "".join("\\" + c if c in "[]()" else c for c in TITLE_WRAPPERS)
    terms = F.array(
        *[F.struct(F.lit(o).alias("old"), F.lit(n).alias("new")) for o, n in TITLE_TERMS.items()]
    )

    def drop_prefix(title: Column, prefix: Column) -> Column:
        rest = strip(F.substr(title, F.length(prefix) + 1))
        return F.when(F.startswith(title, prefix), rest).otherwise(title)

    def unify(title: Column, term: Column) -> Column:
        swapped = F.replace(title, term["old"], term["new"])
        fits = F.contains(title, term["old"]) & ~F.contains(title, term["new"]) & (F.length(swapped) <= 15)
        return F.when(fits, swapped).otherwise(title)

    def build(slots: Column) -> Column:
        rank, kind = slots["rank"], slots["expense_type"]
        bare = F.regexp_replace(
            F.aggregate(F.array(*[F.lit(p) for p in TITLE_PREFIXES]), strip(raw), drop_prefix),
            f"^[{wrappers}]+|[{wrappers}]+$",
            "",
        )
        add_rank = lambda t: F.when(
            rank.isNotNull() & ~F.contains(t, rank) & (F.length(t) < 12), F.concat(rank, t)
        ).otherwise(t)
        add_kind = lambda t: F.when(
            kind.isNotNull() & ~F.contains(t, kind) & (F.length(t) < 12) & ~t.rlike("标准|额度"),
            F.concat(t, F.lit("标准")),
        ).otherwise(t)
        full = smart_truncate(F.aggregate(terms, let(let(bare, add_rank), add_kind), unify), 12)
        fallback = F.when(rank.isNull() & kind.isNull(), F.lit("报销标准咨询")).otherwise(
            F.concat_ws("", rank, kind, F.lit("咨询"))
        )
        weak = lambda t: (F.length(t) < 4) | t.isin("新对话", "财务报销")
        return let(full, lambda t: F.left(F.when(weak(t), fallback).otherwise(t), F.lit(15)))

    return let(expense_slots(original), build)


# --- department documents -------------------------------------------------------------------

# Assessment documents of departments.
DEPARTMENT_TYPES = {
    "财务型": ["财务部", "岗位业绩考核指标", "优", "良", "中", "差"],
    "HR型": ["人力资源部", "薪酬", "KPI", "权重"],
    "生产型": ["生产部", "计分制", "质量奖", "现场奖"],
    "销售型": ["销售部", "业绩任务", "提成", "开发客户"],
    "研发型": ["研发部", "项目考核", "EVT", "DVT", "MP"],
    "行政型": ["行政部", "支持服务", "满意度"],
}
DEPARTMENTS = {
    "财务部": "财务", "人力资源部": "人力资源", "生产部": "生产",
    "销售部": "销售", "研发部": "研发", "行政部": "行政",
}
DEPARTMENT_POSITIONS = {
    "财务": ["会计核算", "出纳", "财务分析", "财务主管", "财务经理"],
    "人力资源": ["招聘专员", "培训专员", "薪酬专员", "HRBP", "人力资源主管", "人力资源经理"],
    "生产": ["操作工", "班组长", "车间主任", "质检员", "设备维护员"],
    "销售": ["销售代表", "高级销售", "销售主管", "区域经理", "销售总监"],
    "研发": ["初级工程师", "中级工程师", "高级工程师", "技术专家", "项目经理", "研发总监"],
    "行政": ["前台", "行政专员", "后勤管理员", "行政主管", "行政经理"],
}
POSITION_LEVELS = {
    "初级": ["初级", "助理", "专员", "操作工", "前台", "代表"],
    "中级": ["中级", "高级专员", "资深"],
    "高级": ["高级", "工程师", "分析师", "专家"],
    "主管": ["主管", "组长", "主任", "班长"],
    "经理": ["经理", "总监", "VP"],
}
ASSESSMENT_TYPES = {
    "项目": ["evt", "dvt", "pvt", "mp", "项目考核", "项目阶段"],
    "业绩": ["业绩", "kpi", "销售额"],
    "态度": ["态度", "满意度", "360度"],
    "行为": ["行为", "协作", "配合"],
    "能力": ["能力", "胜任力", "专业技能"],
}
FREQUENCIES = {
    "项目周期": ["项目周期", "项目阶段", "项目节点", "evt", "dvt"],
    "月度": ["月度", "每月", "月考核"],
    "季度": ["季度", "每季度", "季考核"],
    "半年": ["半年"],
    "年度": ["年度", "每年", "年考核"],
}


def department_type(content: Column, filename: Column, types=DEPARTMENT_TYPES, departments=DEPARTMENTS) -> Column:
    """struct(doc_type, confidence, department): share of the type's keywords seen in text or name."""
    text, name = F.lower(content), F.lower(filename)
    best = F.struct(F.lit(None).cast("string").alias("doc_type"), F.lit(-1.0).alias("confidence"))
    for label, words in types.items():
        seen = [
            (F.contains(text, F.lit(w.lower())) | F.contains(name, F.lit(w.lower()))).cast("double") for w in words
        ]
        share = reduce(lambda a, b: a + b, seen) / len(words)
        mine = F.struct(F.lit(label).alias("doc_type"), share.alias("confidence"))
        best = F.when(share > best["confidence"], mine).otherwise(best)
    department = None
    for word, label in departments.items():
        test = F.contains(content, F.lit(word)) | F.contains(filename, F.lit(word))
        department = F.when(test, label) if department is None else department.when(test, label)
    return F.struct(best["doc_type"].alias("doc_type"), best["confidence"].alias("confidence"),
                    department.otherwise("未知").alias("department"))


def position_level(name: Column) -> Column:
    return first_label(name, POSITION_LEVELS, "未知")


def positions(content: Column, department: Column) -> Column:
    """array<struct(name, level)>: listed positions of the department, else headings, else a default."""
    table = F.create_map(
        *[x for d, ps in DEPARTMENT_POSITIONS.items() for x in (F.lit(d), F.array(*[F.lit(p) for p in ps]))]
    )
    none = F.array().cast("array<string>")
    listed = F.filter(F.coalesce(table[department], none), lambda p: F.contains(content, p))
    headings = F.regexp_extract_all(
        content, F.lit("[（(][一二三四五六七八九十]+[）)]\\s*([^\\n]+?)(?:岗位|职位)"), 1
    )
    found = F.array_distinct(
        F.filter(
            F.transform(headings, lambda h: strip(F.regexp_replace(h, "[:：].*", ""))),
            lambda h: (h != "") & (F.length(h) < 20),
        )
    )
    names = F.when(F.size(listed) > 0, listed).otherwise(found)
    rows = F.transform(names, lambda n: F.struct(n.alias("name"), position_level(n).alias("level")))
    default = F.array(F.struct(F.lit("通用岗位").alias("name"), F.lit("未知").alias("level")))
    return F.when(F.size(names) > 0, rows).otherwise(default)


def assessment_type(content: Column) -> Column:
    return first_label(F.lower(content), ASSESSMENT_TYPES, "综合")


def assessment_frequency(content: Column) -> Column:
    return first_label(content, FREQUENCIES, "月度")


def grade_scale(content: Column) -> Column:
    return (
        F.when(content.rlike("优.*良.*中.*差"), "优/良/中/差")
        .when(content.rlike("S级.*A级.*B级.*C级.*D级|[SABCD]级"), "S/A/B/C/D")
        .when(content.rlike("[12345]级"), "五级制")
        .otherwise("百分制")
    )


def evaluator(content: Column) -> Column:
    return (
        F.when(F.contains(content, F.lit("360")) & F.contains(content, F.lit("度")), "360度")
        .when(F.contains(content, F.lit("跨部门")), "跨部门")
        .when(F.contains(content, F.lit("部门负责人")), "部门负责人")
        .otherwise("直接上级")
    )
