"""Sliding-window admission and repeat suppression per key.

A request is admitted when fewer than ``limit`` admitted requests lie within
the last ``seconds``; refused requests do not count. The decision depends on
the ones before it, so it is a fold, not a window frame. Two steps keep a hot
key from ending up whole in one task:

* the time line of a key is cut into slices. Where at most ``limit`` requests
  fall into the two windows before a slice begins, every one of those was
  admitted whatever came earlier, so the slice can start on its own from them;
* inside an independent stretch the rows arrive sorted and are folded as they
  stream by, holding ``limit`` time stamps and nothing else.

With a limit of one, stretches of many rows are divided as well, however busy the key: what
a slice hands on is the last admitted time, and the slice as a whole maps the
times it may be handed to those it may hand on (a jump table). Tables of
neighbouring slices are joined pairwise, up to the whole stretch and down again
to every slice, so a stretch of n slices takes 2 log2(n) joins and no task sees
more than a slice. A table with one outcome ends its stretch.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symptia.functions import fixed_values as fv
from symptia.functions.rows import join_on
from symptia.session import materialise

MIN_SLICE_SECONDS = 3600
# Rows of a stretch that one task may fold; beyond it a limit of one is divided.
BUSY_ROWS = 1_000_000
# The time handed on by a slice whose last admission blocks nothing after it.
FREE = -(1 << 62)


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def step(window: deque, now: int, limit: int, micros: int) -> tuple[bool, int]:
    """One decision on a window of admitted times: (allowed, retry seconds).
    Entries strictly older than the window leave it first."""
    while window and now - window[0] > micros:
        window.popleft()
    if len(window) >= limit:
        return False, (micros - (now - window[0])) // 1_000_000 + 1
    window.append(now)
    return True, 0


def admit(requests: DataFrame, key: str, ts: str, id_col: str, limit: int = fv.ADMIT_MAX,
          seconds: int = fv.ADMIT_SECONDS) -> DataFrame:
    """Adds ``admitted`` and ``retry_after``; order is ``ts``, then ``id_col``.

    Requests with a NULL key share one. A request without a time belongs to no
    window: both columns are NULL, and it does not count for others.
    """
    timed = requests.filter(F.col(ts).isNotNull())
    untimed = requests.filter(F.col(ts).isNull()).withColumns(
        {"admitted": F.lit(None).cast("boolean"), "retry_after": F.lit(None).cast("bigint")})
    return _admit(timed, key, ts, id_col, limit, seconds).unionByName(untimed)


def _admit(requests: DataFrame, key: str, ts: str, id_col: str, limit: int, seconds: int) -> DataFrame:
    micros = seconds * 1_000_000
    slice_micros = max(MIN_SLICE_SECONDS * 1_000_000, 4 * micros)
    rows = requests.withColumn("_t", _micros(F.col(ts))).withColumn("_slice", F.floor(F.col("_t") / slice_micros))
    tail = (F.col("_t") - F.col("_slice") * slice_micros) >= slice_micros - 2 * micros

    slices = rows.groupBy(key, "_slice").agg(
        F.count_if(tail).alias("_tail"), F.max("_t").alias("_last"), F.count("*").alias("_rows"))
    along = Window.partitionBy(key).orderBy("_slice")
    previous = F.lag("_slice").over(along)
    begins = previous.isNull() | (previous < F.col("_slice") - 1) | (F.lag("_tail").over(along) <= limit)
    stretches = slices.withColumns({"_begins": begins, "_before": F.lag("_last").over(along)}).select(
        key, "_slice", "_before", "_rows",
        F.last(F.when(F.col("_begins"), F.col("_slice")), ignorenulls=True).over(along).alias("_stretch"),
    )
    if limit == 1:
        carried = _carried(rows, stretches, key, micros, slice_micros)
        placed = join_on(rows.withColumn("_seed", F.lit(False)), carried, [key, "_slice"])
        return _folded(placed, requests, key, "_part", id_col, limit, micros)

    # a row seeds the next slice when that slice begins a stretch and the row
    # is still inside the window at its start
    placed = _with_seeds(rows, micros, slice_micros)
    joined = join_on(placed, stretches.drop("_before", "_rows"), [key, "_slice"]).filter(
        ~F.col("_seed") | (F.col("_stretch") == F.col("_slice"))
    )
    return _folded(joined.withColumn("_carry", F.lit(FREE)), requests, key, "_stretch", id_col, limit, micros)


def _with_seeds(rows: DataFrame, micros: int, slice_micros: int) -> DataFrame:
    """Rows in the last window of a slice once more in the next, as ``_seed``."""
    own = F.struct(F.col("_slice").alias("s"), F.lit(False).alias("seed"))
    again = F.struct((F.col("_slice") + 1).alias("s"), F.lit(True).alias("seed"))
    late = (F.col("_t") - F.col("_slice") * slice_micros) >= slice_micros - micros
    placed = rows.withColumn("_s", F.explode(F.when(late, F.array(own, again)).otherwise(F.array(own))))
    return placed.withColumn("_slice", F.col("_s.s")).withColumn("_seed", F.col("_s.seed")).drop("_s")


def _folded(placed: DataFrame, requests: DataFrame, key: str, part: str, id_col: str, limit: int, micros: int) -> DataFrame:
    """The fold over sorted parts of a key. A part starts from ``_carry``, an
    admitted time, and from its seeds."""
    ordered = placed.repartition(key, part).sortWithinPartitions(key, part, "_t", id_col)
    out = [*requests.columns, "_seed", "admitted", "retry_after"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema.fields)
    schema += ", _seed boolean, admitted boolean, retry_after bigint"

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, window = None, deque()
        for pdf in batches:
            admitted, retry = [], []
            for k, s, t, seed, carry in zip(pdf[key], pdf[part], pdf["_t"], pdf["_seed"], pdf["_carry"]):
                k = None if pd.isna(k) else k
                if (k, s) != current:
                    current, window = (k, s), deque([carry])
                if seed:
                    window.append(t)
                    ok, after = True, 0
                else:
                    ok, after = step(window, t, limit, micros)
                admitted.append(ok)
                retry.append(after)
            yield pdf.assign(admitted=admitted, retry_after=retry)[out]

    return ordered.mapInPandas(fold, schema).filter(~F.col("_seed")).drop("_seed")


# ------------------------------------------------- jump tables (limit of one)
def _jump_tables(nodes: DataFrame, key: str, micros: int, slice_micros: int) -> DataFrame:
    """(key, _slice, _x, _y): for every slice the time handed on (``_y``) for
    each it may be handed (``_x``), from its distinct times with seeds. A task
    holds the distinct times of a slice."""
    key_type = nodes.schema[key].dataType.simpleString()
    apart = slice_micros + 3 * micros  # between slices on one axis, so that no jump reaches the next

    def tables(pdf: pd.DataFrame, begins: np.ndarray) -> pd.DataFrame:
        group = np.cumsum(begins) - 1
        first = np.flatnonzero(begins)
        past = np.append(first[1:], len(pdf))
        offset = pdf["_slice"].to_numpy() * slice_micros - group * apart
        axis = pdf["_t"].to_numpy() - offset
        seeds = pdf["_seed"].to_numpy()
        last = last_jumps(axis, past[group], micros)
        on = axis[last]
        on = np.where(on < group * apart + slice_micros - micros, FREE, on + offset)
        own = first + np.bincount(group, weights=seeds, minlength=len(first)).astype(np.int64)  # first of its own
        rows = np.append(np.flatnonzero(seeds), own)
        handed = np.append(pdf["_t"].to_numpy()[seeds], np.full(len(own), FREE))
        return pdf[[key, "_slice"]].iloc[rows].assign(_x=handed, _y=on[rows])

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, marks, before = [], [], None
        for pdf in batches:
            if pdf.empty:
                continue
            keys, parts = pdf[key], pdf["_slice"].to_numpy()
            missing, values = keys.isna().to_numpy(), keys.to_numpy()
            same = (parts[1:] == parts[:-1]) & ((values[1:] == values[:-1]) | (missing[1:] & missing[:-1]))
            head = before is None or not (before[0] == parts[0] and (before[1] == values[0] or (before[2] and missing[0])))
            begins = np.append(head, ~same.astype(bool))
            before = (parts[-1], values[-1], missing[-1])
            cut = int(np.flatnonzero(begins)[-1]) if begins.any() else 0
            if begins.any() and (held or cut):
                yield tables(pd.concat([*held, pdf[:cut]]), np.concatenate([*marks, begins[:cut]]))
                held, marks = [], []
            held.append(pdf[cut:])
            marks.append(begins[cut:])
        if held:
            yield tables(pd.concat(held), np.concatenate(marks))

    ordered = nodes.repartition(key, "_slice").sortWithinPartitions(key, "_slice", "_t").select(key, "_slice", "_t", "_seed")
    return ordered.mapInPandas(scan, f"`{key}` {key_type}, _slice bigint, _x bigint, _y bigint")


def last_jumps(times: np.ndarray, past: np.ndarray, micros: int) -> np.ndarray:
    """Place of the last admission from each place on. The next admission after
    a time is the first one more than a window later; ``past`` is where the
    slice of a place ends. Following the steps to their end is pointer doubling."""
    to = np.searchsorted(times, times + micros, side="right")
    last = np.where(to < past, to, np.arange(len(times)))
    while not np.array_equal(last, last[last]):
        last = last[last]
    return last


def _carried(rows: DataFrame, stretches: DataFrame, key: str, micros: int, slice_micros: int) -> DataFrame:
    """(key, _slice, _part, _carry): the rows that are folded together, and the
    last admitted time before them, FREE if it no longer blocks any.

    Between the slices of a stretch there are two rows or more in the last two
    windows, so an admission always reaches the slice after its own.
    """
    start = F.col("_slice") * slice_micros
    whole = Window.partitionBy(key, "_stretch")
    placed = materialise(stretches.select(
        key, "_slice", "_stretch", (F.sum("_rows").over(whole) > BUSY_ROWS).alias("_busy"),
        F.lead("_slice").over(whole.orderBy("_slice")).isNotNull().alias("_inner"),
        # before a stretch every row of the last window was admitted
        F.when(F.col("_before") >= start - micros, F.col("_before")).otherwise(F.lit(FREE)).alias("_carry"),
    ), "slices")
    begun = placed.filter(F.col("_slice") == F.col("_stretch")).select(key, "_stretch", "_carry")
    out = [key, "_slice", "_part", "_carry"]
    quiet = join_on(placed.filter(~F.col("_busy")).select(key, "_slice", "_stretch"), begun, [key, "_stretch"]).withColumnRenamed(
        "_stretch", "_part").select(out)
    busy = placed.filter("_busy")
    if busy.isEmpty():
        return quiet

    inner = busy.filter("_inner").select(key, "_slice")
    nodes = join_on(rows.select(key, "_slice", "_t"), busy.select(key, "_slice"), [key, "_slice"], "left_semi").distinct()
    tables = materialise(_jump_tables(
        join_on(_with_seeds(nodes, micros, slice_micros), inner, [key, "_slice"], "left_semi"), key, micros, slice_micros), "jumps")

    # a slice that hands on the same time whatever it is handed ends a stretch
    constant = tables.groupBy(key, "_slice").agg(F.min("_y").alias("_low"), F.max("_y").alias("_high")).filter(
        F.col("_low") == F.col("_high")).select(key, (F.col("_slice") + 1).alias("_slice"), F.col("_low").alias("_known"))
    first = F.col("_known").isNotNull() | (F.col("_slice") == F.col("_stretch"))
    along = Window.partitionBy(key).orderBy("_slice")
    cut = join_on(busy, constant, [key, "_slice"], "left").select(
        key, "_slice", F.coalesce("_known", "_carry").alias("_carry"),
        F.last(F.when(first, F.col("_slice")), ignorenulls=True).over(along).alias("_stretch"))
    cut = materialise(cut.withColumn("_seg", F.col("_slice") - F.col("_stretch")), "slices")
    longest = int(cut.agg(F.max("_seg")).first()[0])

    level = join_on(tables, cut.drop("_carry"), [key, "_slice"]).select(key, "_stretch", "_seg", "_x", "_y")
    levels = []
    for _ in range(longest.bit_length()):  # up: tables of 1, 2, 4, ... slices
        levels.append(level)
        left = level.filter(F.col("_seg") % 2 == 0).select(
            key, "_stretch", (F.col("_seg") + 1).alias("_seg"), F.col("_x").alias("_from"), F.col("_y").alias("_x"))
        right = level.filter(F.col("_seg") % 2 == 1)
        level = materialise(join_on(left, right, [key, "_stretch", "_seg", "_x"]).select(
            key, "_stretch", F.floor(F.col("_seg") / 2).alias("_seg"), F.col("_from").alias("_x"), "_y"), "jumps")
    known = cut.filter(F.col("_seg") == 0).select(key, "_stretch", "_seg", F.col("_carry").alias("_x"))
    for level in reversed(levels):  # down: from the start of a pair to its middle
        pair = join_on(known.withColumn("_seg", F.col("_seg") * 2), level, [key, "_stretch", "_seg", "_x"], "left")
        both = F.array(F.struct("_seg", "_x"), F.when(F.col("_y").isNotNull(), F.struct(
            (F.col("_seg") + 1).alias("_seg"), F.col("_y").alias("_x"))))
        known = pair.select(key, "_stretch", F.explode(F.array_compact(both)).alias("p")).select(key, "_stretch", "p.*")
    divided = join_on(cut.drop("_carry"), known.withColumnRenamed("_x", "_carry"), [key, "_stretch", "_seg"])
    return quiet.unionByName(divided.select(key, "_slice", F.col("_slice").alias("_part"), "_carry"))


def prompt_key(system: Column, prompt: Column, temperature: Column, max_tokens: Column) -> Column:
    return F.sha2(F.concat_ws("||", system, prompt, temperature.cast("string"), max_tokens.cast("string")), 256)


def suppress_repeats(calls: DataFrame, key: str, ts: str, id_col: str, temperature: str,
                     seconds: int = fv.REPEAT_SECONDS, warmest: float = fv.REPEAT_MAX_TEMPERATURE) -> DataFrame:
    """Adds ``cached``: an equal call was made within ``seconds``, counted from
    the call that filled the entry. Warm calls are never stored, nor are those
    without a temperature or a time; they are answered and not cached.

    It is admission with a limit of one: an admitted call fills the entry.
    """
    stored = F.coalesce(F.col(temperature) <= warmest, F.lit(False))
    cold = admit(calls.filter(stored), key, ts, id_col, 1, seconds)
    warm = calls.filter(~stored)
    return cold.withColumn("cached", ~F.coalesce("admitted", F.lit(True))).drop("admitted", "retry_after").unionByName(
        warm.withColumn("cached", F.lit(False)))
