"""Conversation tables: recent turns, transcripts, summaries, session features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumine import settings as S
from vellumine.functions import tokens as K
from vellumine.operators.scale import top_k

# Turns kept, and turns read back.
KEPT_TURNS = 20
READ_TURNS = 10
SPEAKERS = {"user": "用户", "assistant": "助手"}


def last_turns(messages: DataFrame, n: int = KEPT_TURNS, key: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Last ``n`` messages per conversation; the rank becomes a limit before the shuffle."""
    return top_k(messages, [key], [F.col(turn).desc()], n, "age")


def transcripts(messages: DataFrame, n: int = READ_TURNS, speakers=SPEAKERS, sep: str = "：", query: str | None = None) -> DataFrame:
    """(conv_id, transcript) of the last ``n`` turns with speaker labels, then the current query.

    Only the kept turns are collected, so a conversation of any length yields a bounded text.
    """
    label = F.col("role")
    for role, name in speakers.items():
        label = F.when(F.col("role") == role, name).otherwise(label)
    rows = last_turns(messages, n).select("conv_id", F.struct("turn", F.concat(label, F.lit(sep), "text").alias("line")).alias("m"))
    out = rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("m")), lambda m: m["line"]), "\n").alias("transcript"))
    if query is None:
        return out
    return out.withColumn("transcript", F.concat("transcript", F.lit(f"\n{speakers['user']}{sep}"), F.lit(query)))


def summaries(messages: DataFrame) -> DataFrame:
    """Message count, start of the first and of the last message per conversation."""
    cut = F.left("text", F.lit(100))
    out = messages.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("messages"), F.min_by(cut, "turn").alias("first_text"), F.max_by(cut, "turn").alias("last_text")
    )
    return out.withColumn("summary", F.format_string("对话包含 %d 条消息，主题涉及: %s... %s...", "messages", "first_text", "last_text"))


def session_entities(messages: DataFrame, stop: Sequence[str] = S.DIALOGUE_STOP_WORDS, recent: int = 6, per_turn: int = 5) -> DataFrame:
    """Keywords of the assistant turns among the last ``recent`` messages, newest first."""
    rows = last_turns(messages, recent).where("role = 'assistant'")
    words = K.word_keywords(F.col("text"), stop, limit=per_turn)
    return rows.select("conv_id", "turn", F.posexplode(words).alias("pos", "name")).withColumn("confidence", F.lit(0.7))


def session_features(messages: DataFrame) -> DataFrame:
    """has_history, turn_count and the text of the last two messages per conversation."""
    n = messages.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    tail = last_turns(messages, 2).groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.left("text", F.lit(100)).alias("t")))), lambda m: m["t"]), " ").alias("history_summary")
    )
    return n.join(tail, "conv_id").select("conv_id", (F.col("n") > 0).alias("has_history"), F.floor(F.col("n") / 2).alias("turn_count"), "history_summary")


def conversation_list(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    n = messages.groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages"))
    return conversations.join(n, "conv_id", "left").fillna(0, ["messages"])


def drop_empty(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    return conversations.join(messages.select("conv_id"), "conv_id", "left_semi")
