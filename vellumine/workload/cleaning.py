"""Cleaning queries over documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumine import settings as S
from vellumine.functions import text as X
from vellumine.session import spread
from vellumine.workload.registry import lit, query, rounded, table


def _docs(spark, sf):
    return spread(table(spark, sf, "documents").select("doc_id", "text"))


def _pages(spark, sf):
    return spread(table(spark, sf, "pages").select("page_id", "html"))


def _re(col: str, pattern: str, repl: str = "") -> str:
    return f"regexp_replace({col}, {lit(pattern)}, {lit(repl)}, 'g')"


def sql_strip(col: str) -> str:
    return _re(col, f"^[{X.SPACE}]+|[{X.SPACE}]+$")


def sql_unescape(col: str) -> str:
    names = {k: v for k, v in S.NAMED_ENTITIES.items() if k in ("lt", "gt", "quot", "apos", "nbsp", "copy", "middot", "eacute")}
    for name, char in names.items():
        col = f"replace({col}, '&{name};', {lit(char)})"
    col = f"replace({col}, '&#39;', '''')"
    return f"replace({col}, '&amp;', '&')"


def sql_trim_lines(col: str) -> str:
    piece = _re("x", f"^[{X.INLINE}]+|[{X.INLINE}]+$")
    return f"array_to_string(list_transform(string_split({col}, chr(10)), lambda x: {piece}), chr(10))"


def sql_drop_blank(col: str) -> str:
    test = f"regexp_matches(x, {lit('[^' + X.SPACE + ']')})"
    return f"array_to_string(list_filter(string_split({col}, chr(10)), lambda x: {test}), chr(10))"


def sql_dedupe(inner: str, key: str = "id", col: str = "t") -> str:
    """SELECT key, col with repeated lines dropped, from a subquery giving key and col."""
    return f"""
      SELECT {key}, string_agg(line, chr(10) ORDER BY pos) AS {col} FROM (
        SELECT {key}, line, min(pos) AS pos FROM (
          SELECT {key}, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos
          FROM (SELECT {key}, string_split({col}, chr(10)) AS ls FROM ({inner})))
        GROUP BY {key}, line)
      GROUP BY {key}"""


_SQL_STEPS = {
    "remove_html_tags": lambda c: sql_unescape(_re(c, S.TAG_PATTERN)),
    "remove_whitespace": lambda c: _re(_re(c, " +", " "), "\t+", " "),
    "normalize_whitespace": lambda c: _re(c, f"[{S.WIDE_SPACES}]", " "),
    "normalize_quotes": lambda c: f"translate({c}, {lit(S.CURLY_QUOTES)}, {lit(S.STRAIGHT_QUOTES)})",
    "convert_full_to_half": lambda c: f"translate({c}, {lit(S.FULL_WIDTH)}, {lit(S.HALF_WIDTH)})",
    "remove_special_chars": lambda c: _re(c, X.special_pattern("a-zA-Z" + S.CJK_NARROW)),
    "remove_urls": lambda c: _re(c, S.URL_PATTERN),
    "remove_emails": lambda c: _re(c, S.EMAIL_PATTERN),
    "remove_numbers": lambda c: _re(c, "\\p{Nd}+"),
    "remove_chinese_punctuation": lambda c: _re(c, f"[{S.CHINESE_MARKS}]"),
    "remove_english_punctuation": lambda c: _re(c, f"[{X.char_class(S.ENGLISH_MARKS)}]"),
    "trim_lines": sql_trim_lines,
    "remove_empty_lines": sql_drop_blank,
}


def _step(flag, fn, short, source="documents"):
    key, col, read = ("doc_id", "text", _docs) if source == "documents" else ("page_id", "html", _pages)
    if flag == "remove_duplicate_lines":
        sql = sql_dedupe(f"SELECT {key}, {col} AS cleaned FROM {source}", key, "cleaned")
    else:
        sql = f"SELECT {key}, {_SQL_STEPS[flag](col)} AS cleaned FROM {source}"

    @query(f"clean_{short}", sql)
    def run(spark, sf):
        return read(spark, sf).select(key, fn(F.col(col)).alias("cleaned"))


_SHORT = {
    "remove_html_tags": ("html_tags", "pages"),
    "remove_whitespace": ("spaces", "documents"),
    "normalize_whitespace": ("wide_spaces", "documents"),
    "normalize_quotes": ("quotes", "documents"),
    "convert_full_to_half": ("full_width", "documents"),
    "remove_special_chars": ("special_chars", "documents"),
    "remove_urls": ("urls", "pages"),
    "remove_emails": ("emails", "documents"),
    "remove_numbers": ("numbers", "documents"),
    "remove_chinese_punctuation": ("chinese_marks", "documents"),
    "remove_english_punctuation": ("english_marks", "documents"),
    "trim_lines": ("trim_lines", "documents"),
    "remove_empty_lines": ("blank_lines", "documents"),
    "remove_duplicate_lines": ("repeated_lines", "documents"),
}
for _flag, _fn in X.STEPS:
    _step(_flag, _fn, *_SHORT[_flag])


def sql_preset(name: str, source: str, key: str, col: str) -> str:
    cfg = S.CLEANING_PRESETS[name]
    expr = col
    for flag, _ in X.STEPS:
        if getattr(cfg, flag) and flag != "remove_duplicate_lines":
            expr = _SQL_STEPS[flag](expr)
    inner = f"SELECT {key}, {expr} AS cleaned FROM {source}"
    return sql_dedupe(inner, key, "cleaned") if cfg.remove_duplicate_lines else inner


def _preset(name, source):
    key, col, read = ("doc_id", "text", _docs) if source == "documents" else ("page_id", "html", _pages)

    @query(f"clean_preset_{name}", sql_preset(name, source, key, col))
    def run(spark, sf):
        return read(spark, sf).select(key, X.clean(F.col(col), name).alias("cleaned"))


for _name, _source in [("minimal", "documents"), ("aggressive", "pages"), ("text_only", "pages"), ("html_clean", "pages")]:
    _preset(_name, _source)

_RULES = [("[0-9]{3,}", "#"), ("(", "never"), ("(?i)the ", "THE_")]


@query("clean_custom_rules", f"SELECT doc_id, {_re(_re('text', _RULES[0][0], '#'), _RULES[2][0], 'THE_')} AS cleaned FROM documents")
def _custom(spark, sf):
    return _docs(spark, sf).select("doc_id", X.apply_rules(F.col("text"), _RULES).alias("cleaned"))


@query(
    "clean_report",
    f"""SELECT source, sum(length(text))::BIGINT AS original_length, sum(length(cleaned))::BIGINT AS cleaned_length,
          round((sum(length(text)) - sum(length(cleaned))) / sum(length(text)) * 100, 2) AS reduction_pct
        FROM documents JOIN ({sql_preset('aggressive', 'documents', 'doc_id', 'text')}) c USING (doc_id)
        GROUP BY source""",
)
def _report(spark, sf):
    cleaned = spread(table(spark, sf, "documents").select("source", "text")).select(
        "source", F.length("text").alias("a"), F.length(X.clean(F.col("text"), "aggressive")).alias("b")
    )
    return cleaned.groupBy("source").agg(
        F.sum("a").alias("original_length"),
        F.sum("b").alias("cleaned_length"),
        rounded((F.sum("a") - F.sum("b")) / F.sum("a") * 100, 2).alias("reduction_pct"),
    )


def sql_html_text(col: str) -> str:
    c = _re(col, "(?is)<(script|style|nav|head|footer)\\b.*?</(script|style|nav|head|footer)>")
    c = _re(c, "(?s)<!--.*?-->")
    c = _re(c, "(?i)</?(p|div|br|h[1-6]|li|ul|ol|tr|table|article|section|blockquote)\\b[^>]*>", "\n")
    c = sql_unescape(_re(c, S.TAG_PATTERN))
    return sql_drop_blank(sql_trim_lines(_re(_re(c, " +", " "), "\t+", " ")))


@query("html_to_text", f"SELECT page_id, {sql_html_text('html')} AS content FROM pages")
def _html_text(spark, sf):
    return _pages(spark, sf).select("page_id", X.html_to_text(F.col("html")).alias("content"))


_HEADERS, _JUNK = ("lorem ipsum", "click here"), ("That and ", "Of the ")


def _sql_corpus() -> str:
    c = _re(_re(_re("text", S.CONTROL_CHARS), S.ZERO_WIDTH), "[ \t]+", " ")
    c = sql_trim_lines(_re(c, "\n{4,}", "\n\n\n"))
    for p in S.PAGE_FURNITURE:
        c = _re(c, p)
    for phrase in (*_HEADERS, *_JUNK):
        c = f"replace({c}, {lit(phrase)}, '')"
    ends = _re("x", f"^[{X.INLINE}]+|[{X.INLINE}]+$")
    number = lit(f"^[（(]?[0-9]+[）)]?[{X.INLINE}]*$")
    c = (
        f"array_to_string(list_filter(list_transform(string_split({c}, chr(10)), lambda x: {ends}), "
        f"lambda x: length(x) >= 5 OR regexp_matches(x, {number})), chr(10))"
    )
    return sql_strip(_re(c, S.URL_PATTERN))


@query("clean_corpus", f"SELECT doc_id, {_sql_corpus()} AS cleaned FROM documents")
def _corpus(spark, sf):
    return _docs(spark, sf).select("doc_id", X.clean_corpus(F.col("text"), _HEADERS, _JUNK).alias("cleaned"))


def _sql_light() -> str:
    c = _re("text", "\n{3,}", "\n\n")
    for p in S.LIGHT_FURNITURE:
        c = _re(c, p)
    return sql_strip(_re(_re(c, S.CONTROL_CHARS), "[ \t]+", " "))


@query("clean_light", f"SELECT doc_id, {_sql_light()} AS cleaned FROM documents")
def _light(spark, sf):
    return _docs(spark, sf).select("doc_id", X.clean_light(F.col("text")).alias("cleaned"))


@query("squash_spaces", f"SELECT doc_id, {sql_strip(_re('text', '[' + X.SPACE + ']+', ' '))} AS cleaned FROM documents")
def _squash(spark, sf):
    return _docs(spark, sf).select("doc_id", X.squash_spaces(F.col("text")).alias("cleaned"))


_ESCAPED = "replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#039;')"


@query("escape_html", f"SELECT doc_id, {_ESCAPED} AS cleaned FROM documents")
def _escape(spark, sf):
    return _docs(spark, sf).select("doc_id", X.escape_html(F.col("text")).alias("cleaned"))


@query(
    "highlight_keywords",
    f"""SELECT doc_id, regexp_replace({_ESCAPED}, '(' || first || '|' || second || ')',
          '<span class="highlight">\\1</span>', 'g') AS marked
        FROM (SELECT doc_id, text, regexp_extract(text, '[a-z]{{4,}}') AS first,
                regexp_extract(text, '[A-Z][a-z]+') AS second FROM documents)
        WHERE first <> '' AND second <> ''""",
)
def _highlight(spark, sf):
    docs = _docs(spark, sf).withColumn(
        "k", F.array(F.regexp_extract("text", "[a-z]{4,}", 0), F.regexp_extract("text", "[A-Z][a-z]+", 0))
    )
    return docs.where((F.col("k")[0] != "") & (F.col("k")[1] != "")).select(
        "doc_id", X.highlight(F.col("text"), F.col("k")).alias("marked")
    )


@query(
    "size_labels",
    """SELECT doc_id, CASE WHEN b < 1024 THEN printf('%.2f B', b::DOUBLE)
         WHEN b < 1048576 THEN printf('%.2f KB', b / 1024.0::DOUBLE) ELSE printf('%.2f MB', b / 1048576.0::DOUBLE) END AS label
       FROM (SELECT doc_id, octet_length(encode(text)) AS b FROM documents)""",
)
def _sizes(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.size_label(F.octet_length("text")).alias("label"))


@query(
    "compress_text",
    """SELECT doc_id, CASE WHEN length(text) > 2000
         THEN left(text, 1000) || '...（上下文已压缩）...' || right(text, 1000) ELSE text END AS cleaned FROM documents""",
)
def _compress(spark, sf):
    return _docs(spark, sf).select("doc_id", X.compress_middle(F.col("text"), 2000).alias("cleaned"))
