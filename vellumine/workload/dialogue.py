"""Conversation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumine.operators import dialogue as D
from vellumine.workload.registry import query, table
from vellumine.workload.tokens import STOP, sql_words


def messages(spark, sf):
    return table(spark, sf, "conversations")


_RANKED = "(SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age FROM conversations)"


@query("last_turns", f"SELECT conv_id, turn, role FROM {_RANKED} WHERE age <= 3")
def _last(spark, sf):
    return D.last_turns(messages(spark, sf), 3).select("conv_id", "turn", "role")


_LABEL = "CASE role WHEN 'user' THEN '用户' WHEN 'assistant' THEN '助手' ELSE role END"


@query(
    "transcript",
    f"SELECT conv_id, string_agg({_LABEL} || '：' || text, chr(10) ORDER BY turn) || chr(10) || '用户：next?' AS transcript FROM {_RANKED} WHERE age <= 5 GROUP BY conv_id",
)
def _transcript(spark, sf):
    return D.transcripts(messages(spark, sf), 5, query="next?")


@query(
    "conversation_summary",
    "SELECT conv_id, '对话包含 ' || count(*) || ' 条消息，主题涉及: ' || left(arg_min(text, turn), 100) || '... ' || left(arg_max(text, turn), 100) || '...' AS summary FROM conversations GROUP BY conv_id",
)
def _summary(spark, sf):
    return D.summaries(messages(spark, sf)).select("conv_id", "summary")


@query(
    "session_entities",
    f"""SELECT conv_id, turn, pos, name FROM (SELECT conv_id, turn, unnest(ws) AS name, generate_subscripts(ws, 1) - 1 AS pos FROM (
          SELECT conv_id, turn, list_slice({sql_words('text')}, 1, 5) AS ws FROM {_RANKED} WHERE age <= 6 AND role = 'assistant'))""",
)
def _entities(spark, sf):
    return D.session_entities(messages(spark, sf), STOP).select("conv_id", "turn", "pos", "name")


@query(
    "session_features",
    f"""SELECT conv_id, true AS has_history, any_value(n) // 2 AS turn_count, string_agg(left(text, 100), ' ' ORDER BY turn) AS history_summary
        FROM {_RANKED} JOIN (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) USING (conv_id) WHERE age <= 2 GROUP BY conv_id""",
)
def _features(spark, sf):
    return D.session_features(messages(spark, sf))


def heads(spark, sf):
    """Conversation headers: every conversation id up to the largest, some without user messages."""
    return messages(spark, sf).select("conv_id").distinct()


@query("conversation_list", "SELECT c.conv_id, count(m.conv_id) AS messages FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN (SELECT * FROM conversations WHERE role = 'system') m ON m.conv_id = c.conv_id GROUP BY 1")
def _list(spark, sf):
    return D.conversation_list(heads(spark, sf), messages(spark, sf).where("role = 'system'"))


@query("nonempty_conversations", "SELECT DISTINCT conv_id FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations WHERE role = 'system')")
def _nonempty(spark, sf):
    return D.drop_empty(heads(spark, sf), messages(spark, sf).where("role = 'system'"))
