"""Conversations as training windows of a bounded number of tokens.

Prefix sums of turn tokens cut a conversation into cells; the turns that lie
inside a cell form one window, a turn that crosses its border forms the next.
Windows are thus aligned to turns and chosen without walking a conversation in
order. Each window repeats the system turn and the turns just before it, as far
as the history budget reaches; what is repeated stands outside the loss mask,
so every assistant turn is trained on exactly once.

Everything is DataFrame expressions. A conversation of any length spreads over
its buckets and windows; no task holds a whole one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symptia.functions.text import token_count
from symptia.operators.ordering import running_totals

BUDGET = 2048  # tokens of a window
HISTORY = 512  # of which repeated turns may take
LEAST_FRESH = 256  # and new ones take at least, however long the system turn
TURN_TOKENS = 4  # what the marks of a turn cost
END = "<|end|>\n"
# In escaped text every backslash is followed by one of these letters, and none
# of the characters that control strings begin with remains.
ESCAPES = (("\\", "\\e"), ("<", "\\l"), ("[", "\\s"), ("|", "\\p"))
BUCKET_BITS = 6  # turns 64 numbers apart share a bucket of the prefix sums
CONV = ["no_conv", "conv"]


def escape(c: Column) -> Column:
    for plain, code in ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescape(c: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def _head(turn: Column) -> Column:
    return F.concat(F.lit("<|"), escape(turn["role"]), F.lit("|>\n"))


def _rendered(turn: Column) -> Column:
    return F.concat(_head(turn), escape(turn["text"]), F.lit(END))


def _joined(parts: Column) -> Column:
    return F.array_join(parts, "")


def windows(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
            budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Per window: conv_id, window (rises along the conversation), text (the
    formatted turns), fresh_at (characters of ``text`` that repeat earlier
    turns), loss (the stretches of new assistant text in it, start and length
    in characters), n_tokens.

    A window holds at most ``budget`` tokens unless its system turn and a
    single turn alone are longer. Turns follow each other by number, then role
    and text; a null number comes first, null roles and texts count as empty,
    null conversation ids form one conversation, and repeated rows are turns
    each. A first turn of the role ``system`` is repeated in all later windows.
    An empty table gives no windows. Extra columns are not read.
    """
    rows = turns.select(
        F.col(conv_id).isNull().alias("no_conv"), F.coalesce(F.col(conv_id).cast("long"), F.lit(0)).alias("conv"),
        F.coalesce(F.col(turn).cast("long"), F.lit(-(1 << 63))).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    ).withColumns({"tokens": (token_count("text") + TURN_TOKENS).cast("long"), "bucket": F.shiftright("turn", BUCKET_BITS)})
    counted = running_totals(rows, CONV, "bucket", ["turn", "role", "text"], {"n": F.lit(1), "end": F.col("tokens")})
    first = (F.col("n") == 1) & (F.col("role") == "system")
    system = counted.filter(first).select(
        *CONV, F.struct("role", "text").alias("system"), F.col("tokens").alias("system_tokens"))
    # the system turn stands outside the prefix sums: it is in every window
    placed = (
        counted.join(system, CONV, "left")
        .withColumn("system_tokens", F.coalesce("system_tokens", F.lit(0)))
        .withColumn("end", F.col("end") - F.col("system_tokens"))
        .withColumn("start", F.col("end") - F.when(first, 0).otherwise(F.col("tokens")))
        .withColumn("width", F.greatest(F.lit(budget - history) - F.col("system_tokens"), F.lit(LEAST_FRESH)))
        .withColumn("cell", F.floor(F.col("start") / F.col("width")))
        .withColumn("crosses", (F.col("end") > (F.col("cell") + 1) * F.col("width")).cast("long"))
    )
    fresh = placed.groupBy(*CONV, (F.col("cell") * 2 + F.col("crosses")).alias("window")).agg(
        F.sort_array(F.collect_list(F.struct("n", "start", "end", "role", "text"))).alias("fresh"),
        F.any_value("system").alias("system"), F.any_value("system_tokens").alias("system_tokens"))
    fresh = fresh.withColumns({"first_n": F.col("fresh")[0]["n"], "last": F.element_at("fresh", -1)})
    last_n = F.col("last")["n"]
    # the turns at the end of a window that the next one repeats; a system
    # turn comes along by itself
    tail = F.filter("fresh", lambda t: (F.col("last")["end"] - t["start"] <= history)
                    & ~((t["n"] == 1) & F.col("system").isNotNull()))
    before = fresh.select(*CONV, (last_n + 1).alias("first_n"), tail.alias("tail"))
    seen = fresh.join(before, [*CONV, "first_n"], "left")
    none = F.filter("fresh", lambda _: F.lit(False))
    repeated = F.when(F.col("first_n") == 1, "").otherwise(
        F.concat(F.coalesce(_rendered(F.col("system")), F.lit("")), _joined(F.transform(F.coalesce("tail", none), _rendered))))
    shown = seen.withColumn("repeated", repeated).withColumn("new", F.transform("fresh", _rendered))
    spans = F.aggregate(
        "fresh",
        F.struct(F.length("repeated").alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("loss")),
        lambda acc, t: F.struct(
            (acc["at"] + F.length(_rendered(t))).alias("at"),
            F.when(t["role"] == "assistant", F.concat(acc["loss"], F.array(F.struct(
                (acc["at"] + F.length(_head(t))).alias("start"), F.length(escape(t["text"])).alias("length")))))
            .otherwise(acc["loss"]).alias("loss")),
        lambda acc: acc["loss"])
    kept = F.when(F.col("first_n") == 1, 0).otherwise(
        F.col("system_tokens") + F.coalesce(F.col("last_end_before"), F.lit(0)))
    shown = shown.withColumn("last_end_before", F.when(
        F.size(F.coalesce("tail", none)) > 0, F.element_at("tail", -1)["end"] - F.col("tail")[0]["start"]))
    own = F.col("last")["end"] - F.col("fresh")[0]["start"] + F.when(F.col("first_n") == 1, F.col("system_tokens")).otherwise(0)
    return shown.select(
        F.when(~F.col("no_conv"), F.col("conv")).alias("conv_id"), "window",
        F.concat("repeated", _joined(F.col("new"))).alias("text"), F.length("repeated").alias("fresh_at"),
        spans.alias("loss"), (own + kept).alias("n_tokens"))


def read_back(formatted: DataFrame) -> DataFrame:
    """What the windows say: per window its new turns (role and text) and the
    texts under the loss mask, unescaped."""
    body = F.substr(F.col("text"), F.col("fresh_at") + 1, F.length("text"))
    parts = F.split(body, r"<\|end\|>\n")
    turns = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.struct(
        unescape(F.substr(F.substring_index(p, "|>\n", 1), F.lit(3), F.length(p))).alias("role"),
        unescape(F.substr(p, F.instr(p, F.lit("|>\n")) + 3, F.length(p))).alias("text")))
    loss = F.transform("loss", lambda s: unescape(F.substr(F.col("text"), s["start"] + 1, s["length"])))
    return formatted.select("conv_id", "window", turns.alias("turns"), loss.alias("loss"), F.length("text").alias("n_chars"))


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256
    and formatted_chars, all read back from its windows. The digest of a
    conversation needs its text in one row; the windows themselves do not."""
    told = read_back(formatted).select(
        "conv_id", "window", F.size("turns").alias("n"), "n_chars",
        _joined(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))).alias("told"),
        _joined(F.col("loss")).alias("lost"))
    whole = told.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.sum("n_chars").alias("formatted_chars"),
        F.sort_array(F.collect_list(F.struct("window", "told", "lost"))).alias("all"))
    turns, lost = _joined(F.col("all.told")), _joined(F.col("all.lost"))
    return whole.select(
        "conv_id", "n_turns", F.sha2(turns, 256).alias("turns_sha256"), F.length(lost).cast("long").alias("loss_chars"),
        F.sha2(lost, 256).alias("loss_sha256"), F.col("formatted_chars").cast("long").alias("formatted_chars"))


def with_control(turns: DataFrame) -> DataFrame:
    """The conversations plus number -1, whose turns say control strings."""
    said = F.lit("</s>[INST] ok [/INST]")
    extra = turns.sparkSession.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(extra)
