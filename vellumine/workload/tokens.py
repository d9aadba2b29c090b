"""Token estimate and keyword queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumine import settings as S
from vellumine.functions import text as X
from vellumine.functions import tokens as K
from vellumine.session import spread
from vellumine.workload.registry import lit, lits, query, table

# Stop words that fit the driver's text; the defaults are Chinese.
STOP = ["the", "The", "of", "and", "in", "der", "die", "de", "la", "le", "que"]


def docs(spark, sf):
    return spread(table(spark, sf, "documents").select("doc_id", "text"))


_CJK = f"[{S.CJK_BASIC}]"


def sql_estimate(col: str) -> str:
    words = f"regexp_split_to_array({col}, {lit('[' + X.SPACE + ']+')})"
    word = (
        f"CASE WHEN regexp_matches(x, {lit(_CJK)}) THEN regexp_matches(x, '[A-Za-z]') "
        f"ELSE regexp_matches(x, '\\p{{L}}') END"
    )
    return (
        f"trunc(len(regexp_extract_all({col}, {lit(_CJK)})) / 1.5::DOUBLE"
        f" + len(list_filter({words}, lambda x: {word})) * 1.3::DOUBLE"
        f" + len(regexp_extract_all({col}, {lit('[' + X.char_class(S.ESTIMATE_MARKS) + ']')})) * 0.5::DOUBLE)::BIGINT"
    )


@query("token_estimate_words", f"SELECT doc_id, {sql_estimate('text')} AS tokens FROM documents")
def _a(spark, sf):
    return docs(spark, sf).select("doc_id", K.estimate_tokens(F.col("text")).alias("tokens"))


def sql_budget(col: str) -> str:
    cjk = f"len(regexp_extract_all({col}, {lit(_CJK)}))"
    return f"floor(({cjk} + (length({col}) - {cjk}) / 4.0::DOUBLE) * 1.1::DOUBLE)::BIGINT"


@query("token_estimate_budget", f"SELECT doc_id, {sql_budget('text')} AS tokens FROM documents")
def _b(spark, sf):
    return docs(spark, sf).select("doc_id", K.estimate_tokens_budget(F.col("text")).alias("tokens"))


def sql_search_tokens(col: str, stop=STOP) -> str:
    return (
        f"list_filter(regexp_split_to_array({col}, {lit(K.SEARCH_SPLIT)}), "
        f"lambda w: length(w) > 1 AND w NOT IN ({lits(stop)}))"
    )


def sql_first_distinct(source: str, key: str, words: str, limit: int) -> str:
    """SELECT key, kws: first ``limit`` distinct elements of list expression ``words``, in order."""
    return f"""
      SELECT {key}, list(w ORDER BY pos) AS kws FROM (
        SELECT {key}, w, pos, row_number() OVER (PARTITION BY {key} ORDER BY pos) AS rn FROM (
          SELECT {key}, w, min(pos) AS pos FROM (
            SELECT {key}, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos
            FROM (SELECT {key}, {words} AS ws FROM {source}))
          GROUP BY {key}, w))
      WHERE rn <= {limit} GROUP BY {key}"""


@query(
    "search_tokens",
    f"SELECT doc_id, array_to_string({sql_search_tokens('text')}, ' ') AS tokens FROM documents",
)
def _search(spark, sf):
    return docs(spark, sf).select("doc_id", F.array_join(K.search_tokens(F.col("text"), STOP), " ").alias("tokens"))


def _keyword_query(name, limit, fn):
    sql = f"""SELECT doc_id, coalesce(array_to_string(kws, ' '), '') AS keywords
              FROM documents LEFT JOIN ({sql_first_distinct('documents', 'doc_id', sql_search_tokens('text'), limit)}) USING (doc_id)"""

    @query(name, sql)
    def run(spark, sf):
        return docs(spark, sf).select("doc_id", F.array_join(fn(F.col("text"), STOP), " ").alias("keywords"))


_keyword_query("keywords", 10, K.keywords)
_keyword_query("core_keywords", 5, K.core_keywords)

WORDS = "regexp_extract_all({}, '[\\p{{L}}\\p{{N}}_]+')"


def sql_words(col: str, stop=STOP, lower: bool = True) -> str:
    text = f"lower({col})" if lower else col
    return f"list_filter({WORDS.format(text)}, lambda w: length(w) > 1 AND w NOT IN ({lits(stop)}))"


@query("word_keywords", f"SELECT doc_id, array_to_string({sql_words('text')}, ' ') AS keywords FROM documents")
def _words(spark, sf):
    return docs(spark, sf).select("doc_id", F.array_join(K.word_keywords(F.col("text"), STOP), " ").alias("keywords"))


@query(
    "word_keywords_first_ten",
    f"SELECT doc_id, array_to_string(list_slice({sql_words('text', STOP, False)}, 1, 10), ' ') AS keywords FROM documents",
)
def _words10(spark, sf):
    cols = K.word_keywords(F.col("text"), STOP, lower=False, limit=10)
    return docs(spark, sf).select("doc_id", F.array_join(cols, " ").alias("keywords"))


def sql_check_keywords(col: str, stop=STOP) -> str:
    drop = lit("[^\\p{L}\\p{N}_" + X.SPACE + "]")
    return (
        f"list_filter(regexp_split_to_array(regexp_replace({col}, {drop}, '', 'g'), {lit('[' + X.SPACE + ']+')}), "
        f"lambda w: length(w) > 1 AND w NOT IN ({lits(stop)}))"
    )


@query("check_keywords", f"SELECT doc_id, array_to_string({sql_check_keywords('text')}, ' ') AS keywords FROM documents")
def _check(spark, sf):
    return docs(spark, sf).select("doc_id", F.array_join(K.check_keywords(F.col("text"), STOP), " ").alias("keywords"))


_MARKS = "[" + X.char_class(S.DISPLAY_MARKS + "[]") + "]"


@query(
    "display_keywords",
    f"""SELECT doc_id, array_to_string(list_slice(list_filter(string_split(regexp_replace(text, {lit(_MARKS)}, '', 'g'), ' '),
          lambda w: length(w) > 1 AND regexp_matches(w, {lit('[^' + X.SPACE + ']')}) AND w NOT IN ({lits(STOP)})), 1, 5), ' ') AS keywords
        FROM documents""",
)
def _display(spark, sf):
    return docs(spark, sf).select("doc_id", F.array_join(K.display_keywords(F.col("text"), STOP), " ").alias("keywords"))


@query(
    "occurring_keywords",
    """SELECT conv_id, turn, array_to_string(list_filter(['the', 'en', 'der', 'que', 'ion', 'ing', 'Er'],
         lambda w: contains(text, w)), ',') AS matched FROM conversations""",
)
def _occurring(spark, sf):
    words = F.array(*[F.lit(w) for w in ["the", "en", "der", "que", "ion", "ing", "Er"]])
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", F.array_join(K.occurring_keywords(words, F.col("text")), ",").alias("matched")
    )
