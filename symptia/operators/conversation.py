"""Conversations as long tables (conv_id, turn, role, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symptia.functions import fixed_values as fv
from symptia.functions import text
from symptia.operators.ordering import preceding, running_totals
from symptia.session import broadcast_if_small

TURN_BUCKET = 256


def history_frames(turns: DataFrame, n: int = fv.HISTORY_TURNS) -> DataFrame:
    """Each user turn with up to ``n`` user turns before it, oldest first,
    joined by newlines."""
    users = turns.filter(F.col("role") == "user").withColumn("_bucket", F.floor(F.col("turn") / TURN_BUCKET))
    numbered = running_totals(users, ["conv_id"], "_bucket", ["turn"], {"_idx": F.lit(1)})
    framed = preceding(numbered, ["conv_id"], "_idx", n, "text", "_texts")
    return framed.withColumn("context_text", F.array_join("_texts", "\n")).drop("_bucket", "_idx", "_texts")


def conversation_list(turns: DataFrame, created: str, chars: int = fv.TITLE_CHARS) -> DataFrame:
    """One row per conversation, newest first; the title is the start of its
    first message."""
    heads = turns.groupBy("conv_id").agg(
        F.min_by(text.truncate("text", chars), "turn").alias("title"),
        F.min(created).alias("created"), F.count("*").alias("n_messages"),
    )
    return heads.orderBy(F.col("created").desc(), "conv_id")


def usable_history(turns: DataFrame, limit: int = fv.MAX_HISTORY_TURNS) -> DataFrame:
    """The last ``limit`` finished, non-error, non-blank turns."""
    usable = turns.filter(~F.col("is_streaming") & ~F.col("is_error") & ~text.is_blank("text"))
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    return usable.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= limit).drop("_r")


def delete_conversations(turns: DataFrame, ids: DataFrame) -> DataFrame:
    return turns.join(broadcast_if_small(ids), "conv_id", "left_anti")


def is_vague(symptoms: Column, message: Column) -> Column:
    return (F.size(symptoms) == 0) & (F.size(text.words(message)) < 2)


def request_problem(message: Column, history: Column | None = None, preference: Column | None = None,
                    response_script: Column | None = None) -> Column:
    """Why a request is not acceptable, NULL when it is."""
    problem = F.when(F.coalesce(F.length(message), F.lit(0)) < 1, "message is empty").when(
        F.length(message) > fv.MAX_MESSAGE_CHARS, "message is too long")
    if history is not None:
        problem = problem.when(F.size(history) > fv.MAX_HISTORY_TURNS, "history is too long").when(
            F.exists(history, lambda t: ~t["role"].isin("user", "assistant")), "history role is unknown").when(
            F.exists(history, lambda t: F.length(t["content"]) < 1), "history turn is empty")
    if preference is not None:
        problem = problem.when(~preference.isin("arabic", "english", "auto"), "language preference is unknown")
    if response_script is not None:
        problem = problem.when(~response_script.isin("arabic", "franco"), "response script is unknown")
    return problem


def split_requests(requests: DataFrame, problem: Column) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected with a reason)."""
    marked = requests.withColumn("reason", problem)
    return marked.filter(F.col("reason").isNull()).drop("reason"), marked.filter(F.col("reason").isNotNull())
