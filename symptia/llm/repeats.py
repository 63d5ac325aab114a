"""Repeated passages, found with longest-previous-factor arrays.

A position of a text is repeated when the ``LENGTH`` bytes from there start
somewhere else too. In suffix order the previous and the next smaller position
give the longest earlier match, so a position whose longest previous factor
reaches ``LENGTH`` is a later copy, and the same with larger positions tells a
copy that comes again. Suffixes are ordered by their first ``LENGTH`` bytes, as
the threshold asks no more; a fingerprint only tells which have no equal, and
those are left out of the order.

To sort only what can match, each stretch of ``LENGTH`` bytes elects an anchor:
the ``GRAM``-byte string in it with the smallest hash. Equal stretches elect
equal anchors at equal places.

1. A Bloom filter finds anchors that may occur more than once (the rest can't
   lie in a repeated stretch).
2. For these the surroundings that their stretches can reach are compared by
   hash. Where they are equal as a whole, all stretches in them are repeated;
   that settles the inside of copies without sorting.
3. One copy of each different surrounding of an anchor is fetched, and the
   stretches around the anchor are put in suffix order together.
4. Anchors with very many different surroundings are divided by a longer string
   around them, again and again, until groups are small; at the end a group
   shares one whole stretch.

Only numbers are shuffled in steps 1 and 2. Texts are shuffled to fetch
surroundings (once more if step 4 occurs) and to cut the repeated stretches, and
of them only those that a Bloom filter says to have such; the joins are sorted
ones at every size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symptia.llm.bloom import filter_bits, holds, repeated_bits, seen_bits
from symptia.llm.common import byte_values, documents, materialise, pieces_of, release

LENGTH = 200
GRAM = 73
SPREAD = LENGTH - GRAM  # places an anchor can have in a stretch, less one
#: Different surroundings of an anchor (or of a longer string around it) that
#: are put in order together.
GROUP = 16_384
#: Surroundings that are compared at a time, whole groups of them.
PORTION = 1024
#: Pairs of beginnings whose bytes are compared at a time.
COMPARED = 8192
#: Bytes of surroundings a task holds.
TASK_BYTES = 12 << 20
CHUNK = 1 << 19
BATCH_BYTES = 4 << 20
_POSITION = np.uint64((1 << 21) - 1)

_MULTIPLIER = 0x9E3779B97F4A7C15
_BYTES = np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


class Powers:
    """Powers of the multiplier and of its inverse, as far as were asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) <= n:
            for name, factor in (("up", _MULTIPLIER), ("down", pow(_MULTIPLIER, -1, 1 << 64))):
                values = np.full(n + 1, factor, np.uint64)
                values[0] = 1
                setattr(self, name, np.multiply.accumulate(values))


class Hashes:
    """Polynomial hashes of all stretches of a byte string."""

    def __init__(self, data: np.ndarray, powers: Powers):
        powers.reach(len(data))
        self.powers = powers
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[data] * powers.up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.powers.down[start])

    def grams(self, n: int) -> np.ndarray:
        at = len(self.sums) - n
        return mix((self.sums[n:] - self.sums[:-n]) * self.powers.down[:at])


def segments(texts: list[bytes]) -> Iterator[list[tuple[int, int, int]]]:
    """Stretches' starts (text, from, to) of all texts, in portions of about
    ``CHUNK`` starts."""
    held, size = [], 0
    for i, text in enumerate(texts):
        starts = len(text) - LENGTH + 1
        for a in range(0, max(0, starts), CHUNK):
            b = min(starts, a + CHUNK)
            if held and size + b - a > CHUNK:
                yield held
                held, size = [], 0
            held.append((i, a, b))
            size += b - a + LENGTH
    if held:
        yield held


def anchors(texts: list[bytes], powers: Powers) -> dict[str, np.ndarray]:
    """The anchors of texts: text, pos, gram (hash), around (hash of the
    surroundings and their extent), lo and hi (bytes of them before and after
    the anchor)."""
    out = [np.zeros((0, 6), np.int64)]
    for held in segments(texts):
        parts, local, owner = [], [], []
        at = 0
        for i, a, b in held:
            base = max(0, a - SPREAD)
            part = texts[i][base : b + LENGTH - 1 + SPREAD]
            parts.append(part)
            local.append(np.arange(at + a - base, at + b - base))
            owner.append((i, at - base, b - a, len(texts[i])))
            at += len(part)
        hashes = Hashes(np.frombuffer(b"".join(parts), np.uint8), powers)
        grams = hashes.grams(GRAM)
        least = (grams & ~_POSITION) | np.arange(len(grams), dtype=np.uint64)
        step = 1
        while step <= SPREAD:  # minima over 2, 4, ... 128 grams
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        owners = np.array(owner)
        elected = (least[np.concatenate(local)] & _POSITION).astype(np.int64)
        which = np.repeat(np.arange(len(held)), owners[:, 2])
        first = np.ones(len(elected), bool)
        first[1:] = (elected[1:] != elected[:-1]) | (which[1:] != which[:-1])
        place, which = elected[first], which[first]
        text, shift, size = owners[which, 0], owners[which, 1], owners[which, 3]
        pos = place - shift
        lo, hi = np.minimum(SPREAD, pos), np.minimum(SPREAD, size - pos - GRAM)
        extent = (lo * (SPREAD + 1) + hi).astype(np.uint64) * np.uint64(_MULTIPLIER)
        around = mix(hashes.of(place - lo, place + GRAM + hi) ^ extent)
        out.append(np.column_stack([text, pos, grams[place].view(np.int64), around.view(np.int64), lo, hi]))
    rows = np.concatenate(out)
    if len(rows):
        # neighbouring portions of a long text may elect the same anchor
        order = np.lexsort((rows[:, 1], rows[:, 0]))
        rows = rows[order]
        rows = rows[np.concatenate(([True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)))]
    return dict(zip(("text", "pos", "gram", "around", "lo", "hi"), rows.T))


def bits_of(grams: np.ndarray, bits: int) -> np.ndarray:
    h = np.ascontiguousarray(grams).view(np.uint64)
    mask = np.uint64(bits - 1)
    return np.column_stack([h & mask, (h >> np.uint64(33)) & mask]).astype(np.int64)


PLACES = pa.schema([("doc", pa.int64()), ("h", pa.int64()), ("pos", pa.int32()), ("gram", pa.int64()),
                    ("around", pa.int64()), ("lo", pa.int16()), ("hi", pa.int16())])


def _places(bitmap, bits: int):
    """Places of anchors that may occur more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in pieces_of(batches, BATCH_BYTES):
            if not batch.num_rows:
                continue
            found = anchors(byte_values(batch.column("text")), powers)
            near = np.flatnonzero(holds(bitmap.value, bits_of(found["gram"], bits)))
            text = pa.array(found["text"][near])
            rest = [pa.array(found[f.name][near]).cast(f.type) for f in list(PLACES)[2:]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc").take(text), batch.column("h").take(text), *rest], schema=PLACES)

    return run


# --- surroundings in suffix order --------------------------------------------

AROUND = pa.schema([("doc", pa.int64()), ("h", pa.int64()), ("pos", pa.int32()), ("key", pa.int64()),
                    ("lo", pa.int16()), ("hi", pa.int16()), ("data", pa.binary())])
SPANS = pa.schema([("doc", pa.int64()), ("h", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes around the wanted anchors of each text."""
    for batch in pieces_of(batches, BATCH_BYTES):
        rows = []
        for doc, h, text, wanted in zip(batch.column("doc").to_pylist(), batch.column("h").to_pylist(),
                                        byte_values(batch.column("text")), batch.column("wanted").to_pylist()):
            for w in wanted:
                pos, lo, hi = w["pos"], w["lo"], w["hi"]
                rows.append((doc, h, pos, w["gram"], lo, hi, text[pos - lo : pos + GRAM + hi]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [()] * 7, AROUND)], schema=AROUND)


def shared_beginnings(data: np.ndarray, start: np.ndarray, other: np.ndarray) -> np.ndarray:
    """How many bytes from ``start`` and from ``other`` on are equal, up to
    ``LENGTH``."""
    out = np.empty(len(start), np.int64)
    beginnings = sliding_window_view(data, LENGTH)
    for a in range(0, len(start), COMPARED):
        part = slice(a, a + COMPARED)
        differ = beginnings[start[part]] != beginnings[other[part]]
        out[part] = np.where(differ.any(axis=1), differ.argmax(axis=1), LENGTH)
    return out


def suffix_order(data: np.ndarray, start: np.ndarray, offset: np.ndarray, rank: np.ndarray,
                 prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of suffixes by anchor offset, their first ``LENGTH`` bytes and
    place, and the longest common prefix of each with the one before it (0
    where the offsets differ).

    One suffix of each fingerprint is sorted by its bytes and stands for the
    others; they are compared with it byte by byte, and should different
    beginnings ever share a fingerprint, all are sorted.
    """
    def prefixes(order: np.ndarray) -> np.ndarray:
        lcp = np.zeros(len(order), np.int64)
        lcp[1:] = shared_beginnings(data, start[order[1:]], start[order[:-1]])
        lcp[1:][offset[order[1:]] != offset[order[:-1]]] = 0
        return lcp

    def by_bytes(which: np.ndarray) -> np.ndarray:
        beginnings = sliding_window_view(data, LENGTH)[start[which]].view(f"S{LENGTH}").ravel()
        order = np.argsort(beginnings, kind="stable")
        del beginnings
        order = order[np.argsort(offset[which][order], kind="stable")]
        same = np.zeros(len(which), bool)
        same[1:] = prefixes(which[order])[1:] == LENGTH
        number = np.empty(len(which), np.int64)
        number[order] = np.cumsum(~same)
        return number

    _, first, kind = np.unique(prints, return_index=True, return_inverse=True)
    number = by_bytes(first)[kind]
    order = np.lexsort((rank, number))
    lcp = prefixes(order)
    if (lcp[1:][number[order[1:]] == number[order[:-1]]] < LENGTH).any():
        order = np.lexsort((rank, by_bytes(np.arange(len(start)))))
        lcp = prefixes(order)
    return order, lcp


def _nearest(rank: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """The common prefix of each suffix with the nearest one before it in the
    order whose rank is smaller; 0 where there is none. Suffixes point at their
    neighbours, and pointers jump over what is not smaller."""
    to, length = np.arange(-1, len(rank) - 1), lcp.copy()
    todo = np.arange(len(rank))
    while True:
        todo = todo[to[todo] >= 0]
        todo = todo[rank[to[todo]] >= rank[todo]]
        if not len(todo):
            return np.where(to >= 0, length, 0)
        over = to[todo]
        length[todo], to[todo] = np.minimum(length[todo], length[over]), to[over]


def longest_previous_factors(rank: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For suffixes in order: how many bytes the longest match has that begins
    at a smaller rank. It is the previous or the next smaller one in the order
    that gives it."""
    after = np.append(lcp[1:], 0)[::-1]
    return np.maximum(_nearest(rank, lcp), _nearest(rank[::-1], after)[::-1])


def matched(table: dict[str, np.ndarray], data: list[bytes], powers: Powers, keep_first: bool) -> np.ndarray:
    """Which stretches around anchors are repeated: a row per anchor, a column
    per offset of the anchor in the stretch. All anchors are compared at once;
    stretches that hold the anchor at the same offset and begin alike are
    equal, as the anchor is part of them."""
    lengths = np.array([len(d) for d in data])
    base = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    joined = np.frombuffer(b"".join(data), np.uint8)
    hashes = Hashes(joined, powers)
    place = np.lexsort((table["pos"], table["h"], table["doc"]))
    rank = np.empty(len(place), np.int64)
    same = np.ones(len(place), bool)  # a text that is there twice is fetched twice
    same[1:] = (table["doc"][place[1:]] != table["doc"][place[:-1]]) | (table["h"][place[1:]] != table["h"][place[:-1]]) | (
        table["pos"][place[1:]] != table["pos"][place[:-1]])
    rank[place] = np.cumsum(same)
    out = np.zeros((len(data), SPREAD + 1), bool)
    # equal stretches hold their anchor at the same offset, so a large group is
    # worked off a few offsets at a time
    width = max(1, PORTION * (SPREAD + 1) // max(1, len(data)))
    for low in range(0, SPREAD + 1, width):
        offsets = np.arange(low, min(low + width, SPREAD + 1))
        # the stretch with the anchor at offset d starts d bytes before it
        inside = (offsets <= table["lo"][:, None]) & (LENGTH - offsets <= GRAM + table["hi"][:, None])
        inside &= (offsets >= table["from"][:, None]) & (offsets <= table["to"][:, None])
        row, offset = np.nonzero(inside)
        offset += low
        start = base[row] + table["lo"][row] - offset
        prints = mix(hashes.of(start, start + LENGTH) ^ (offset.astype(np.uint64) + np.uint64(1)) * np.uint64(_MULTIPLIER))
        # what no other stretch has the fingerprint of has no match of this length
        sorted_prints = np.sort(prints)
        twice = sorted_prints[1:][sorted_prints[1:] == sorted_prints[:-1]]
        if not len(twice):
            continue
        near = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, prints), len(twice) - 1)] == prints)
        row, offset, own = row[near], offset[near], rank[row[near]]
        order, lcp = suffix_order(joined, start[near], offset, own, prints[near])
        hit = longest_previous_factors(own[order], lcp) >= LENGTH
        if not keep_first:  # a match may also begin later
            hit |= longest_previous_factors(-own[order], lcp) >= LENGTH
        out[row[order], offset[order]] = hit
    return out


def spans_of(table: dict[str, np.ndarray], hit: np.ndarray) -> pa.RecordBatch:
    """Bytes covered by the repeated stretches: runs of neighbouring offsets."""
    edge = np.diff(np.pad(hit.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, first = np.nonzero(edge == 1)
    _, past = np.nonzero(edge == -1)
    # offset d starts at pos - d, so the largest offset comes first
    start = table["pos"][row] - (past - 1)
    return pa.RecordBatch.from_arrays(
        [pa.array(table["doc"][row]), pa.array(table["h"][row]), pa.array(start.astype(np.int32)),
         pa.array((table["pos"][row] - first + LENGTH).astype(np.int32))], schema=SPANS)


def _table(batch: pa.Table) -> dict[str, np.ndarray]:
    return {n: batch.column(n).to_numpy().astype(np.int64) for n in batch.schema.names if n != "data"}


def _compare(keep_first: bool):
    """Spans of a partition that holds whole groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        whole = pa.Table.from_batches(held)
        table = _table(whole)
        n = len(table["pos"])
        table.setdefault("from", np.zeros(n, np.int64))
        table.setdefault("to", np.full(n, SPREAD))
        powers = Powers()
        data = byte_values(whole.column("data").combine_chunks())
        # a few groups at a time, so that memory does not follow the partition
        order = np.argsort(table["key"], kind="stable")
        keys = table["key"][order]
        cuts = np.concatenate((np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))), [n]))
        at = 0
        while at < len(cuts) - 1:
            past = max(at + 1, int(np.searchsorted(cuts, cuts[at] + PORTION, "right")) - 1)
            rows = order[cuts[at] : cuts[past]]
            part = {name: values[rows] for name, values in table.items()}
            yield spans_of(part, matched(part, [data[i] for i in rows.tolist()], powers, keep_first))
            at = past

    return run


RANGED = pa.schema([*AROUND, ("from", pa.int16()), ("to", pa.int16())])
RANGED_COLUMNS = "doc long, h long, pos int, key long, lo short, hi short, data binary, `from` short, `to` short"


def _divide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Splits the offsets of surroundings in four; the key of a part is the
    string that all its stretches share."""
    powers = Powers()
    for batch in pieces_of(batches, BATCH_BYTES):
        rows = []
        data = byte_values(batch.column("data"))
        for i, row in enumerate(batch.select([n for n in batch.schema.names if n != "data"]).to_pylist()):
            own = Hashes(np.frombuffer(data[i], np.uint8), powers)
            step = max(1, (row["to"] - row["from"] + 1) // 4)
            for a in range(row["from"], row["to"] + 1, step):
                b = min(row["to"], a + step - 1)
                low, high = max(a, SPREAD - row["hi"]), min(b, row["lo"])
                if low > high:
                    continue
                # all stretches with offsets a..b hold what lies between the
                # start of the latest and the end of the earliest
                left, right = row["lo"] - a, row["lo"] + LENGTH - b
                key = own.of(np.array([left]), np.array([right]))
                key = mix(key ^ mix(np.array([a * 256 + b + 1], np.uint64)))
                rows.append((row["doc"], row["h"], row["pos"], int(key.view(np.int64)[0]), row["lo"], row["hi"], data[i], a, b))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [()] * 9, RANGED)], schema=RANGED)


def _crowded_spans(around: DataFrame, keep_first: bool) -> DataFrame:
    """Spans of anchors with more than ``GROUP`` surroundings."""
    found = None
    ranged = around.withColumns({"from": F.lit(0).cast("short"), "to": F.lit(SPREAD).cast("short")})
    while True:
        ranged = materialise(ranged.mapInArrow(_divide, RANGED_COLUMNS), "divided")
        sizes = ranged.groupBy("key").count()
        several = ranged.join(materialise(sizes.filter("count > 1"), "sizes"), "key")
        # a part of one offset shares a whole stretch: it is repeated
        place = F.struct("doc", "h", "pos")
        single = several.filter(F.col("from") == F.col("to"))
        bounds = single.groupBy("key").agg(F.min(place).alias("first"), F.max(place).alias("last"))
        hit = (place != F.col("first")) if keep_first else (F.col("first") != F.col("last"))
        settled = single.join(bounds, "key").filter(hit).select(
            "doc", "h", (F.col("pos") - F.col("from")).cast("int").alias("start"),
            (F.col("pos") - F.col("from") + LENGTH).cast("int").alias("end"))
        wide = several.filter(F.col("from") < F.col("to"))
        small = _in_tasks(wide.filter(F.col("count") <= GROUP).drop("count")).mapInArrow(
            _compare(keep_first), "doc long, h long, start int, end int")
        step = materialise(settled.unionByName(small), "spans")
        found = step if found is None else found.unionByName(step)
        ranged = materialise(wide.filter(F.col("count") > GROUP).drop("count"), "crowded")
        if ranged.isEmpty():
            return found


def _in_tasks(around: DataFrame, rows: int | None = None) -> DataFrame:
    """Groups whole in tasks of a bounded share of all rows."""
    rows = around.count() if rows is None else rows
    least = int(around.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return around.repartition(max(least, rows * (LENGTH + SPREAD) // TASK_BYTES), "key")


# --- documents ---------------------------------------------------------------


def merged_spans(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def cut(text: bytes, spans: list[list[int]]) -> bytes:
    out, done = [], 0
    for start, end in spans:
        out.append(text[done:start])
        done = end
    return b"".join([*out, text[done:]])


def _row_bits(batch: pa.RecordBatch, bits: int) -> np.ndarray:
    doc, h = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for c in (0, 1))
    return bits_of(mix(h ^ mix(doc)), bits)


def _marked(keyed: DataFrame, owners: DataFrame) -> DataFrame:
    """The rows with ``near``: false for most that are not among the written
    ``owners`` (doc, h), by a Bloom filter of these. So texts that have nothing
    to meet are not shuffled."""
    bits = filter_bits(owners.agg(F.approx_count_distinct(F.xxhash64("doc", "h"))).first()[0])
    bitmap = keyed.sparkSession.sparkContext.broadcast(
        seen_bits(owners.select("doc", "h"), bits, lambda batch: _row_bits(batch, bits)))

    def check(doc: pa.Array, h: pa.Array) -> pa.Array:
        return pa.array(holds(bitmap.value, _row_bits(pa.record_batch([doc, h], ["doc", "h"]), bits)))

    return keyed.withColumn("near", F.arrow_udf(check, "boolean")("doc", "h"))


def repeated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_first: bool = True) -> DataFrame:
    """doc_id, text (null as it is), and spans: the byte ranges covered by
    repeated stretches, merged (array of structs start, end; null for none).

    With ``keep_first`` a stretch counts only where an earlier one, by doc_id
    and then position, is equal to it; otherwise wherever an equal one starts
    anywhere else. Texts shorter than ``LENGTH`` bytes have no spans. Rows
    alike in id and text are each other's copies, and of such rows
    ``keep_first`` keeps all. Null ids form one group of their own.
    """
    spark = docs.sparkSession
    named = documents(docs, doc_id, text)
    # rows are told apart by id and text, which every job finds alike
    keyed = named.select(
        F.coalesce("doc_id", F.lit(0)).alias("doc"),
        F.xxhash64("text", F.col("doc_id").isNull()).alias("h"), "doc_id", "text")
    total = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = filter_bits(total // ((SPREAD + 2) // 2))

    def positions(batch: pa.RecordBatch) -> np.ndarray:
        powers = Powers()
        return np.concatenate([np.zeros((0, 2), np.int64), *(
            bits_of(anchors(byte_values(b.column(0)), powers)["gram"], bits) for b in pieces_of(iter([batch]), BATCH_BYTES))])

    bitmap = spark.sparkContext.broadcast(repeated_bits(keyed.select("text"), bits, positions))
    places = materialise(keyed.select("doc", "h", "text").mapInArrow(
        _places(bitmap, bits), "doc long, h long, pos int, gram long, around long, lo short, hi short"), "anchors")
    place = F.struct("doc", "h", "pos")
    alike = materialise(places.groupBy("gram", "around").agg(
        F.min(F.struct("doc", "h", "pos", "lo", "hi")).alias("first"), F.count(F.lit(1)).alias("n")), "surroundings")
    several = alike.filter("n > 1").select("gram", "around", F.col("first").alias("_first"))
    first = F.struct("_first.doc", "_first.h", "_first.pos")
    whole = places.join(several.hint("merge"), ["gram", "around"])
    whole = materialise((whole.filter(place != first) if keep_first else whole).select(
        "doc", "h", (F.col("pos") - F.col("lo")).cast("int").alias("start"),
        (F.col("pos") + GRAM + F.col("hi")).cast("int").alias("end")), "spans")
    release(places)
    kinds = alike.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    wanted = materialise(alike.join(kinds.hint("merge"), "gram").select("gram", "first.*", "kinds"), "wanted")
    release(alike)
    n_wanted, most = wanted.agg(F.count(F.lit(1)), F.max("kinds")).first()
    holders = _marked(keyed, wanted).filter("near").drop("near")

    def around(part: DataFrame) -> DataFrame:
        per_text = part.groupBy("doc", "h").agg(F.collect_list(F.struct("pos", "gram", "lo", "hi")).alias("wanted"))
        return holders.join(per_text.hint("merge"), ["doc", "h"]).select("doc", "h", "doc_id", "text", "wanted").mapInArrow(
            _fetch, "doc long, h long, pos int, key long, lo short, hi short, data binary")

    calm = around(wanted.filter(F.col("kinds") <= GROUP))
    spans = whole.unionByName(
        _in_tasks(calm, n_wanted).mapInArrow(_compare(keep_first), "doc long, h long, start int, end int"))
    if most is not None and most > GROUP:
        hot = materialise(around(wanted.filter(F.col("kinds") > GROUP)), "hot")
        spans = spans.unionByName(_crowded_spans(hot, keep_first))
    spans = materialise(spans, "spans")
    release(whole, wanted)
    marked = _marked(keyed, spans)
    per_text = spans.groupBy("doc", "h").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    hit = marked.filter("near").join(per_text.hint("merge"), ["doc", "h"], "left").select("doc", "h", "doc_id", "text", "spans")
    rest = marked.filter(~F.col("near")).select(
        "doc", "h", "doc_id", "text", F.lit(None).cast("array<struct<start:int,end:int>>").alias("spans"))
    return hit.unionByName(rest)


def _removed(derive, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, BATCH_BYTES):
            rows = []
            for own_id, text, spans in zip(batch.column("doc_id").to_pylist(), byte_values(batch.column("text")),
                                           batch.column("spans").to_pylist()):
                rows.append((own_id, *derive(text, merged_spans([(s["start"], s["end"]) for s in spans or ()]))))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [()] * len(schema), schema)], schema=schema)

    return run


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_first: bool = True) -> DataFrame:
    """Per row: doc_id, kept (the remaining bytes; a cut may fall inside a
    character) and the removed byte ranges."""
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    schema = pa.schema([("doc_id", pa.int64()), ("kept", pa.binary()), ("removed", span)])
    derive = lambda text, spans: (cut(text, spans), [{"start": a, "end": b} for a, b in spans])
    return repeated(docs, doc_id, text, keep_first).mapInArrow(
        _removed(derive, schema), "doc_id long, kept binary, removed array<struct<start:int,end:int>>")


def removal_digests(docs: DataFrame, keep_first: bool = False) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans and kept_sha256."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
                        ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def derive(text: bytes, spans: list[list[int]]):
        return len(text), sum(b - a for a, b in spans), len(spans), hashlib.sha256(cut(text, spans)).hexdigest()

    return repeated(docs, keep_first=keep_first).mapInArrow(
        _removed(derive, schema), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
