"""Language identification by cross-parsing against suffix automata.

For each language a suffix automaton is built over a bounded sample of labelled
text. A text is parsed against each automaton: the longest stretch that occurs
somewhere in the sample is a phrase, then the next one starts. Text in the
language of the sample needs the fewest phrases; the count is divided by the
length of the text, and the lowest rate wins.

Many texts are parsed in step: their symbols advance one at a time through the
automata of all languages at once. Long texts are cut into blocks of
``BLOCK`` symbols, which costs at most one phrase a block, alike for all
languages; every symbol of a text is parsed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symptia.llm.common import materialise, release, text_values
from symptia.session import broadcast_if_small

#: The labelled sample: documents a language to begin with (more are read until
#: its bytes are reached), bytes a language, and bytes of all languages together
#: up to the number of languages where each has only the least left.
SAMPLE_ROWS = 96
SAMPLE_BYTES = 24_000
TOTAL_BYTES = 480_000
LEAST_BYTES = 7_500
SURE = 40  # characters of a text whose label is taken first
BLOCK = 512
CHUNK_BYTES = 2 << 20
FOLDS = 5
UNDETERMINED = "und"
#: Phrases a symbol above which a text is in no learned language: its longest
#: matches are hardly longer than single characters.
REJECT_RATE = 0.75

GAP = 0  # the symbol of everything between words
_SYMBOLS = np.zeros(256, np.uint8)
_SYMBOLS[ord("a") : ord("z") + 1] = np.arange(1, 27)
_SYMBOLS[128:] = np.arange(27, 155)
N_SYMBOLS = 155


def symbols(text: str) -> np.ndarray:
    """Letters a-z and the bytes of all other letters, with one gap between
    words whatever stands there."""
    found = _SYMBOLS[np.frombuffer(text.lower().encode(), np.uint8)]
    repeated = np.zeros(len(found), bool)
    repeated[1:] = (found[1:] == GAP) & (found[:-1] == GAP)
    return found[~repeated]


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def automaton(sample: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """Edges (state, symbol, state) of the suffix automaton of a sample; state
    0 is the start and no edge leads back to it."""
    edges: list[dict[int, int]] = [{}]
    links, lengths, last = [-1], [0], 0
    for symbol in sample.tolist():
        state = len(edges)
        edges.append({})
        lengths.append(lengths[last] + 1)
        links.append(0)
        p = last
        while p >= 0 and symbol not in edges[p]:
            edges[p][symbol] = state
            p = links[p]
        if p >= 0:
            q = edges[p][symbol]
            if lengths[q] == lengths[p] + 1:
                links[state] = q
            else:
                copy = len(edges)
                edges.append(dict(edges[q]))
                lengths.append(lengths[p] + 1)
                links.append(links[q])
                while p >= 0 and edges[p].get(symbol) == q:
                    edges[p][symbol] = copy
                    p = links[p]
                links[q] = links[state] = copy
        last = state
    rows = [(s, c, t) for s, own in enumerate(edges) for c, t in own.items()]
    return tuple(list(c) for c in zip(*rows)) if rows else ([], [], [])


class Parser:
    """Phrase rates of texts in all learned languages."""

    def __init__(self, model: list[tuple[str, int, bytes, bytes, bytes]]):
        model = sorted(model)
        self.languages = [m[0] for m in model]
        used = np.zeros(N_SYMBOLS, bool)
        for _, _, _, by, _ in model:
            used[np.frombuffer(by, np.uint8)] = True
        self.n_symbols = int(used.sum()) + 1  # the last one stands for all unseen
        self.of = np.where(used, np.cumsum(used) - 1, self.n_symbols - 1).astype(np.int32)
        self.starts = np.cumsum([1, *(m[1] for m in model)])[:-1].astype(np.int32)
        table = np.zeros((1 + sum(m[1] for m in model), self.n_symbols), np.int32)
        for start, (_, _, source, by, target) in zip(self.starts, model):
            s, c, t = np.frombuffer(source, "<i4"), np.frombuffer(by, np.uint8), np.frombuffer(target, "<i4")
            table[s + start, self.of[c]] = t + start
        self.table = table.ravel()

    def rates(self, texts: list[str]) -> np.ndarray:
        """Phrases a symbol, one row per text and one column per language."""
        phrases = np.zeros((len(texts), len(self.languages)))
        sizes = np.zeros(len(texts), np.int64)
        owner, rows = [], []
        held = 0
        for i, text in enumerate(texts):
            own = self.of[symbols(text)]
            sizes[i] = len(own)
            for at in range(0, len(own), BLOCK):
                owner.append(i)
                rows.append(own[at : at + BLOCK])
                held += 1
            if held * BLOCK >= CHUNK_BYTES:
                np.add.at(phrases, owner, self._parse(rows))
                owner, rows, held = [], [], 0
        if rows:
            np.add.at(phrases, owner, self._parse(rows))
        return phrases / np.maximum(sizes, 1)[:, None]

    def _parse(self, blocks: list[np.ndarray]) -> np.ndarray:
        lengths = np.array([len(b) for b in blocks])
        order = np.argsort(-lengths, kind="stable")
        grid = np.zeros((BLOCK, len(blocks)), np.int32)
        for column, i in enumerate(order):
            grid[: lengths[i], column] = blocks[i]
        active = np.searchsorted(-lengths[order], -np.arange(lengths.max()), side="left")
        starts = self.starts[:, None] * self.n_symbols
        state = np.repeat(self.starts[:, None], len(blocks), axis=1)
        count = np.ones(state.shape, np.int32)
        for step, n in enumerate(active.tolist()):
            symbol = grid[step, :n]
            ahead = self.table[state[:, :n] * self.n_symbols + symbol]
            ended = ahead == 0
            again = self.table[starts + symbol]
            if step:
                # a symbol the sample does not have is a phrase of its own and
                # leads back to the start, where the next symbol begins one
                count[:, :n] += ended | (state[:, :n] == self.starts[:, None])
            state[:, :n] = np.where(ended, np.where(again == 0, self.starts[:, None], again), ahead)
        out = np.empty((len(blocks), len(self.languages)))
        out[order] = count.T
        return out


def held_out(doc_id, folds: int = FOLDS):
    """Whether a document is kept away from learning; a null id counts as an
    empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds == 0


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> list[tuple]:
    """Automata of all labelled languages of a table, each from texts in the
    order of the hash of their id, round by round until its bytes are reached
    or its texts are used up. Held-out documents, null texts and null labels
    are never learned from, nor are texts without a letter. Without labels the
    model is empty."""
    labelled = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"),
        held_out(doc_id).alias("held_out"),
    ).filter(F.col("text").rlike(r"\p{L}") & F.col("lang").isNotNull() & ~F.col("held_out"))
    labelled = labelled.select("lang", "text", (F.length("text") < SURE).alias("brief"), F.xxhash64("doc_id").alias("a"),
                               F.xxhash64("text").alias("b"))
    names = [r.lang for r in labelled.select("lang").distinct().collect()]
    if not names:
        return []
    size = max(LEAST_BYTES, min(SAMPLE_BYTES, TOTAL_BYTES // len(names)))
    first = Window.partitionBy("lang").orderBy("brief", "a", "b")
    model, rows, short = [], SAMPLE_ROWS, names
    while short:
        own = labelled if len(short) == len(names) else labelled.filter(F.col("lang").isin(short))
        chosen = own.select("lang", "brief", "a", "b").withColumn("n", F.row_number().over(first)).filter(F.col("n") <= rows)
        # a few texts a language: their keys go to the texts, not the reverse
        chosen = materialise(chosen.select("lang", "a", "b", "n"), "chosen")
        sample = own.join(broadcast_if_small(chosen), ["lang", "a", "b"]).select("lang", "brief", "n", F.substring("text", 1, 2 * size).alias("text"))
        built = sample.dropDuplicates(["lang", "n"]).groupBy("lang").applyInPandas(
            builder(size, rows), "lang string, full boolean, states int, source binary, symbol binary, target binary")
        found = built.collect()
        model += [(r.lang, r.states, bytes(r.source), bytes(r.symbol), bytes(r.target)) for r in found if r.full]
        release(chosen)
        short = [r.lang for r in found if not r.full]
        rows *= 4
    return model


def sample_of(texts: list[str], size: int) -> np.ndarray:
    """``size`` symbols of some texts, or all they have: a piece of each in
    turn, then the next piece of each."""
    found = [symbols(t) for t in texts]
    lengths = np.array([len(f) for f in found])
    taken, held, step = np.zeros(len(found), np.int64), 0, max(1, 2 * size // SAMPLE_ROWS)
    while held < size and (taken < lengths).any():
        for i in np.flatnonzero(taken < lengths).tolist():
            more = min(step, lengths[i] - taken[i])
            taken[i] += more
            held += more
            if held >= size:
                break
    return np.concatenate([np.zeros(0, np.uint8), *(np.append(f[:n], GAP).astype(np.uint8) for f, n in zip(found, taken) if n)])


def builder(size: int, rows: int):
    """A function to the automaton of a language from its first ``rows`` texts;
    not ``full`` if its bytes are not reached and it may have more texts."""

    def build(texts: pd.DataFrame) -> pd.DataFrame:
        texts = texts.sort_values("n")
        taken = sample_of(texts["text"][~texts["brief"]].tolist(), size)
        if len(taken) < size:
            taken = np.concatenate([taken, sample_of(texts["text"][texts["brief"]].tolist(), size - len(taken))])
        full = len(taken) >= size or len(texts) < rows
        source, by, target = automaton(taken[:size]) if full else ([], [], [])
        return pd.DataFrame({
            "lang": [texts["lang"].iloc[0]], "full": [full], "states": [max(source + target, default=0) + 1],
            "source": [np.array(source, "<i4").tobytes()], "symbol": [np.array(by, np.uint8).tobytes()],
            "target": [np.array(target, "<i4").tobytes()]})

    return build


def identifier(spark, model: list[tuple]):
    """A column function from a text to the struct (lang_pred, score, rate).

    Null texts and texts without a letter are ``und`` with score 0, as is every
    text when nothing was learned. The score is 1 less the ratio of the best
    rate to the second; with one learned language it is 1. Ties go to the first
    language in order of names. The model is ``TOTAL_BYTES`` of sample or
    ``LEAST_BYTES`` a language, so its broadcast does not grow with the rows.
    """
    shared = spark.sparkContext.broadcast(model)

    def identify(texts: pa.Array) -> pa.Array:
        parser = Parser(shared.value) if shared.value else None
        values = text_values(texts)
        spoken = [i for i, t in enumerate(values) if parser and has_letter(t)]
        lang, score, rate = [UNDETERMINED] * len(values), [0.0] * len(values), [None] * len(values)
        if spoken:
            rates = parser.rates([values[i] for i in spoken])
            best = rates.argmin(axis=1)
            ordered = np.sort(rates, axis=1)
            sure = 1 - ordered[:, 0] / ordered[:, 1] if rates.shape[1] > 1 else np.ones(len(spoken))
            for i, b, s, r in zip(spoken, best.tolist(), sure.tolist(), ordered[:, 0].tolist()):
                lang[i], score[i], rate[i] = parser.languages[b], s, r
        return pa.StructArray.from_arrays(
            [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rate, pa.float64())],
            ["lang_pred", "score", "rate"])

    return F.arrow_udf(identify, "lang_pred string, score double, rate double")


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score and rate of every row. Only the text
    decides; labels, sources and ids are used for learning alone."""
    found = identifier(docs.sparkSession, train(docs, doc_id, text, lang))
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(doc_id).alias("held_out"),
                      found(F.col(text).cast("string")).alias("found"))
    return own.select("doc_id", "held_out", "found.*")


def keep_spoken(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows in a learned language, with the columns they came with. Texts
    that are ``und`` or need more than ``REJECT_RATE`` phrases a symbol go. If
    nothing could be learned, all rows with a letter stay."""
    model = train(docs, doc_id, text, lang)
    if not model:
        return docs.filter(F.col(text).rlike(r"\p{L}"))
    found = identifier(docs.sparkSession, model)
    rows = docs.select(F.struct("*").alias("row"), found(F.col(text).cast("string")).alias("found"))
    return rows.filter(F.col("found.rate") <= REJECT_RATE).select("row.*")
