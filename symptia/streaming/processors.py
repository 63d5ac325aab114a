"""Keyed state machines: sentence buffers, message states, admission.

Each holds little per key and is a few lines of sequential logic; Spark does
the partitioning, the state and its recovery.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from symptia.functions import fixed_values as fv
from symptia.operators.admission import step


class InOrder(StatefulProcessor):
    """Hands the events of a key to :meth:`event` in ``seq`` order, starting
    at ``first``, each once. A row brings any number of events: ``seq`` and
    every field of ``payload`` are arrays with an entry for each.

    State: the next ``seq`` with what the events so far came to, and a map of
    the events ahead of a gap, of which a batch touches only those it closes or
    adds. An event that was handled or already waits is a redelivery and is
    dropped, also after the last one: the mark of an ended key stays. What a
    key holds goes when nothing was written to it for ``keep_ms``, whether its
    last event came or not. Events without a ``seq`` have no place and are
    dropped.
    """

    first = 0
    payload: list[str] = []
    waiting_schema = ""
    state_schema = ""

    def __init__(self, columns: list[str], keep_ms: int) -> None:
        self.columns, self.keep_ms = columns, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getMapState("waiting", "seq bigint", self.waiting_schema, self.keep_ms)
        self.state = handle.getValueState("state", "next_seq bigint, n_waiting bigint, " + self.state_schema, self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        arrived: dict[int, tuple] = {}
        for row in rows:
            for seq, *event in zip(*[row[f] for f in ["seq", *self.payload]]):
                if seq is not None:
                    arrived.setdefault(seq, tuple(event))
        current = self.state.get()  # None for a new key
        seq, n_waiting, state = (current[0], current[1], tuple(current[2:])) if current else (self.first, 0, self.start())
        before, out = seq, []
        while True:
            event = arrived.pop(seq, None)
            if n_waiting and self.waiting.containsKey((seq,)):
                event, n_waiting = tuple(self.waiting.getValue((seq,))), n_waiting - 1
                self.waiting.removeKey((seq,))
            if event is None:
                break
            state, emitted = self.event(state, event)
            out += emitted
            seq += 1
        for ahead, event in arrived.items():
            if ahead > seq and not (n_waiting and self.waiting.containsKey((ahead,))):
                self.waiting.updateValue((ahead,), event)
                n_waiting += 1
        self.state.update((seq, n_waiting, *state))
        out += self.after(state, seq, seq - before)
        named = Row(*self.columns)
        for values in out:
            yield named(*key, *values)

    def start(self) -> tuple:
        raise NotImplementedError

    def event(self, state: tuple, event: tuple) -> tuple[tuple, list[tuple]]:
        raise NotImplementedError

    def after(self, state: tuple, seq: int, handled: int) -> list[tuple]:
        return []

    def close(self) -> None:
        pass


class SentenceBuffer(InOrder):
    """Chunk text is held back to the end of a sentence; the last event of a
    stream flushes the rest. Emits (segment, content)."""

    payload = ["content", "last"]
    waiting_schema = "content string, last boolean"
    state_schema = "held string, segment bigint"

    def start(self) -> tuple:
        return "", 0

    def event(self, state: tuple, event: tuple) -> tuple[tuple, list[tuple]]:
        held, segment = state
        content, last = event
        held += content or ""
        out = []
        ends = [m.end() for m in re.finditer("[" + fv.SENTENCE_END + "]", held)]
        if ends and not last:
            out.append((segment, held[: ends[-1]]))
            held, segment = held[ends[-1] :], segment + 1
        if last and held:
            out.append((segment, held))
            held, segment = "", segment + 1
        return (held, segment), out


class MessageState(InOrder):
    """The state of a message after its events so far, emitted on change."""

    first = -1
    payload = ["type", "content", "triage_level", "message", "force_red"]
    waiting_schema = "type string, content string, triage_level string, message string, force_red boolean"
    state_schema = "content string, triage_level string, is_blocked boolean, is_error boolean, is_finished boolean, n_events bigint"

    def start(self) -> tuple:
        return "", None, False, False, False, 0

    def event(self, state: tuple, event: tuple) -> tuple[tuple, list[tuple]]:
        content, level, blocked, error, finished, n = state
        kind, chunk, new_level, message, force_red = event
        if kind == "chunk":
            content += chunk or ""
        elif kind in ("triage_classified", "complete"):
            level = new_level or "YELLOW"
        elif kind == "blocked":
            content, blocked, level = message or "", True, "RED" if force_red else level
        elif kind == "error":
            content, error = message or "An error occurred.", True
        finished = finished or kind in ("complete", "blocked", "error")
        return (content, level, blocked, error, finished, n + 1), []

    def after(self, state: tuple, seq: int, handled: int) -> list[tuple]:
        return [state] if handled else []


class Admission(StatefulProcessor):
    """Sliding-window admission in event time.

    A request waits until the watermark has passed its time, so requests are
    decided in the order of their times however they arrive. Requests that take
    no part (``counts`` false, or no time) are answered at once and leave no
    trace.

    State: a map of chunks of waiting requests, each in order, and a head with
    the first time and the size of every chunk, the admitted times still in the
    window (at most ``limit``) and the timer that lets all of it go. A batch
    reads the chunks that begin before the watermark and the last one, if that
    has room; all others stay untouched, however many wait.
    """

    chunk = 512

    def __init__(self, limit: int, seconds: int, columns: list[str], id_type: str) -> None:
        self.limit, self.micros, self.columns, self.id_type = limit, seconds * 1_000_000, columns, id_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState(
            "head", "timer bigint, window array<bigint>, chunks array<bigint>, firsts array<bigint>, sizes array<bigint>")
        self.waiting = handle.getMapState("waiting", "chunk bigint", f"times array<bigint>, requests array<{self.id_type}>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out, arrived = [], []
        for pdf in rows:
            for t, i, counts in zip(pdf["at_micros"], pdf["request"], pdf["counts"]):
                if pd.isna(t):
                    out.append((*key, i, None, None))
                elif counts:
                    arrived.append((int(t), i))
                else:
                    out.append((*key, i, True, 0))
        yield self._frame(out + self._decide(key, arrived, timerValues))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._frame(self._decide(key, [], timerValues))

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=self.columns)
        return frame.astype({"admitted": "boolean", "retry_after": "Int64"})

    def _take(self, chunk: int) -> list[tuple]:
        times, requests = self.waiting.getValue((chunk,))
        self.waiting.removeKey((chunk,))
        return list(zip(times, requests))

    def _decide(self, key, arrived: list[tuple], timerValues) -> list[tuple]:
        past = timerValues.getCurrentWatermarkInMs() * 1000
        head = self.head.get() if self.head.exists() else None
        if head is None and not arrived:
            return []
        timer, admitted, *index = head or (None, [], [], [], [])
        chunks, rows = [], arrived
        for chunk, first, size in zip(*index):  # in order of their numbers
            if first < past:
                rows = rows + self._take(chunk)
            else:
                chunks.append((chunk, first, size))
        ready, ahead = _in_order(r for r in rows if r[0] < past), [r for r in rows if r[0] >= past]
        window = deque(admitted)
        out = [(*key, i, *step(window, t, self.limit, self.micros)) for t, i in ready]
        number = max(index[0], default=-1) + 1
        if ahead and chunks and chunks[-1][2] < self.chunk:
            ahead += self._take(chunks.pop()[0])
        ahead = _in_order(ahead)
        for start in range(0, len(ahead), self.chunk):
            part = ahead[start : start + self.chunk]
            self.waiting.updateValue((number,), ([t for t, _ in part], [i for _, i in part]))
            chunks.append((number, part[0][0], len(part)))
            number += 1
        if window and not chunks and past > window[-1] + self.micros:
            window.clear()
        due = min((first for _, first, _ in chunks), default=window[-1] + self.micros if window else None)
        due = None if due is None else due // 1000 + 1
        if due != timer:
            if timer is not None and timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        if due is not None:
            self.head.update((due, list(window), *([list(c) for c in zip(*chunks)] or [[], [], []])))
        elif head is not None:
            self.head.clear()
        return out

    def close(self) -> None:
        pass


def _in_order(requests) -> list[tuple]:
    """By time, then id, as the batch job orders them; a NULL id comes first."""
    return sorted(requests, key=lambda r: (r[0], r[1] is not None, r[1] if r[1] is not None else 0))
