"""Near copies: texts that share four fifths of their five-word shingles.

Which texts are compared is settled by a prefix filter, which misses no pair:
of a text with n different shingles at least ceil(0.8 n) are in each near copy,
so its first n - ceil(0.8 n) + 1 shingles in an order that is the same for all
texts and those of the copy have one in common. The order is that of the
hashes, with shingles of very many texts last, so that a passage in very many
texts brings together those only that hold little else.

Shingles that the same texts hold bring together the same texts, so only one of
them is kept, with their number as its weight.

Texts that meet are compared by sketches: bit i is the parity of the number of
shingles that fall on it. Two sketches never differ in more bits than the sets
differ in shingles, so a sketch refuses no near copy, whatever its length. What
passes is decided by the shingles themselves.

Only the components matter. So a first round compares each text with a few that
share most with it. After that, members of a group that are still apart are
looked at in tiles of bounded size. A tile never puts out all its pairs: it
gives the closest ones that would hold its components together, a forest in the
first round and four times as many forests in each later one. The shingles
decide these pairs, components grow, refused pairs are remembered, and the next
round sees only what is still mixed, until no tile has a pair left to try.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symptia.llm import simhash
from symptia.llm.common import byte_values, documents, materialise, pieces_of, release
from symptia.llm.components import Forest, components, edge_batch
from symptia.llm.simhash import BATCH_BYTES, fingerprint, shingle_hashes
from symptia.session import broadcast_if_small, fits

SHINGLE = 5
WIDE = 16  # 64-bit words of a sketch
#: Texts of a shingle above which it comes last in the order, and members of a
#: group above which it is compared in tiles.
GROUP = 1024
#: Texts the first round compares each text with; the second has the others.
FIRST = 2
PART = 16
#: Shingles that may come last in the order; those of the most texts do.
HOT = 1 << 18
#: Forests of a tile in a round, times the round before.
MORE = 4

PRINTS = pa.schema([("row", pa.int64()), ("doc", pa.int64()), ("h", pa.int64()), ("node", pa.int64()), ("fp", pa.int64()),
                    ("n", pa.int32()), ("wide", pa.list_(pa.int64())), ("middle", pa.binary()), ("fine", pa.binary()), ("prefix", pa.list_(pa.int64()))])


def shingle_set(text: bytes) -> np.ndarray:
    """Hashes of the different shingles of a text in ascending order."""
    return np.unique(shingle_hashes(text, SHINGLE).view(">u8").ravel().astype(np.uint64))


def name_of(shingles: np.ndarray) -> int:
    """The node of a text: texts with the same shingles are one."""
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes())).view(np.int64))


def sketch(shingles: np.ndarray) -> np.ndarray:
    spots = (shingles * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(54)
    odd = np.bincount(spots.astype(np.int64), minlength=64 * WIDE) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def fine_sketch(shingles: np.ndarray) -> bytes:
    """A sketch of at least four bits a shingle."""
    size = 1 << max(8, (4 * len(shingles) - 1).bit_length())
    spots = ((shingles * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(24)) & np.uint64(size - 1)
    return np.packbits((np.bincount(spots.astype(np.int64), minlength=size) & 1).astype(np.uint8)).tobytes()


def folded(fine: np.ndarray, size: int) -> np.ndarray:
    """The bytes of a fine sketch as one of at most ``size`` bytes."""
    while len(fine) > size:
        fine = fine[: len(fine) // 2] ^ fine[len(fine) // 2 :]
    return fine


def middle_sketch(fine: bytes, n: int) -> bytes:
    """A sketch of at least one bit a shingle, for texts of so many that the
    one of fixed size hardly tells them apart."""
    return folded(np.frombuffer(fine, np.uint8), 1 << (n - 1).bit_length() - 3).tobytes() if n > 64 * WIDE else b""


def fine_apart(x: bytes, y: bytes) -> int:
    """Bits in which two fine sketches differ, the longer one folded."""
    a, b = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
    return int(np.bitwise_count(a ^ folded(b, len(a))).sum())


def prefix(shingles: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """The shingles of which near copies have one in common, ``hot`` ones
    (sorted) last."""
    n = len(shingles)
    most = n - -(-4 * n // 5) + 1 if n else 0
    if len(hot) and n:
        last = hot[np.minimum(np.searchsorted(hot, shingles), len(hot) - 1)] == shingles
        shingles = np.concatenate([shingles[~last], shingles[last]])
    return shingles[:most]


def outlines(docs: DataFrame, hot: np.ndarray) -> DataFrame:
    """(row, doc, h, node, fp, n, wide, middle, fine, prefix) of every row of a keyed
    table; ``row`` numbers the rows, and ``fp`` is the fingerprint that op7
    gives the text."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, BATCH_BYTES):
            texts = byte_values(batch.column("text"))
            sets = [shingle_set(t) for t in texts]
            fine = [fine_sketch(s) for s in sets]
            marks = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc"), batch.column("h"), pa.array([name_of(s) for s in sets], pa.int64()),
                 pa.array(marks), pa.array([len(s) for s in sets], pa.int32()),
                 pa.array([sketch(s) for s in sets], PRINTS.field("wide").type),
                 pa.array([middle_sketch(f, len(s)) for f, s in zip(fine, sets)], pa.binary()), pa.array(fine, pa.binary()),
                 pa.array([prefix(s, shared.value).view(np.int64) for s in sets], PRINTS.field("prefix").type)], schema=PRINTS)

    return docs.withColumn("row", F.monotonically_increasing_id()).mapInArrow(
        run, "row long, doc long, h long, node long, fp long, n int, wide array<long>, middle binary, fine binary, prefix array<long>")


def one_each(prints: DataFrame) -> DataFrame:
    """Of the written outlines one row of each node. Rows beyond the first are
    few and left out where the outlines are read; only if they are many is the
    rest written."""
    first = prints.groupBy("node").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    more = materialise(prints.select("node", "row").join(first, "node").filter("row > first").select("row"), "copies")
    if fits(more):
        return prints.join(F.broadcast(more), "row", "left_anti")
    return materialise(prints.join(more, "row", "left_anti"), "nodes")


def shingles_of(docs: DataFrame) -> DataFrame:
    """(key), the different shingles of every row of a keyed table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, BATCH_BYTES):
            for text in byte_values(batch.column("text")):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text).view(np.int64))], ["key"])

    return docs.select("text").mapInArrow(run, "key long")


def _verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of texts sorted by the pair (a, b) they stand for, the pairs that share
    four fifths of their shingles. Rows alike in id and text come more than once."""
    pair, sets = None, {}
    for batch in pieces_of(batches, BATCH_BYTES):
        found = []
        for a, b, text in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), byte_values(batch.column("text"))):
            if (a, b) != pair:
                pair, sets = (a, b), {}
            if len(sets) < 2:
                shingles = shingle_set(text)
                node = name_of(shingles)
                if node not in sets:
                    sets[node] = shingles
                    if len(sets) == 2:
                        x, y = sets.values()
                        if 9 * len(np.intersect1d(x, y, assume_unique=True)) >= 4 * (len(x) + len(y)):
                            found.append(pair)
        yield edge_batch(found)


def hot_shingles(docs: DataFrame) -> np.ndarray:
    """Shingles of more than about ``GROUP`` texts, ``HOT`` at most. They are
    counted in one text of ``PART``, chosen by its hash: this settles the order
    of the shingles, and any order misses no pair."""
    some = docs.filter(F.pmod(F.xxhash64("h", F.lit(2)), F.lit(PART)) == 0)
    found = shingles_of(some).groupBy("key").count().filter(F.col("count") > max(1, GROUP // PART))
    found = found.orderBy(F.desc("count"), "key").limit(HOT).select("key").toArrow()
    return np.sort(found.column(0).to_numpy().view(np.uint64))


def _runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Columns of rows sorted by the first of them, in pieces of whole groups,
    with the places where groups begin and the end."""
    held = None
    for batch in batches:
        if batch.num_rows:
            own = [_column(batch.column(name)) for name in names]
            held = own if held is None else [np.concatenate(pair) for pair in zip(held, own)]
            whole = int(np.searchsorted(held[0], held[0][-1]))  # the last group may go on
            if whole:
                yield [c[:whole] for c in held], _cuts(held[0][:whole])
                held = [c[whole:] for c in held]
    if held is not None:
        yield held, _cuts(held[0])


def _column(values: pa.Array) -> np.ndarray:
    if pa.types.is_binary(values.type):
        return np.array([*values.to_pylist(), None], object)[:-1]
    if pa.types.is_list(values.type):
        return values.flatten().to_numpy().reshape(-1, WIDE).view(np.uint64)
    return values.to_numpy()


def _cuts(keys: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of texts of different components that follow each other in a
    group, and the weight of the group."""
    for (key, node, own, weight), _ in _runs(batches, ["key", "node", "own", "weight"]):
        same = (key[1:] == key[:-1]) & (own[1:] != own[:-1])
        a, b = node[:-1][same], node[1:][same]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(weight[:-1][same])], ["a", "b", "weight"])


def close_pairs(node: np.ndarray, own: np.ndarray, n: np.ndarray, wide: np.ndarray, middle: np.ndarray, side: np.ndarray,
                crossed: bool) -> Iterator[tuple[float, int, int, int, int]]:
    """Pairs of a tile in different components whose sketches let them be near
    copies, as (share of bits apart, both nodes, both components); in a
    ``crossed`` tile only pairs of its two sides."""
    order = np.argsort(n, kind="stable")
    node, own, n, wide, middle, side = node[order], own[order], n[order].astype(np.int64), wide[order], middle[order], side[order]
    ends = np.searchsorted(n, 5 * n // 4, side="right")
    for i, end in enumerate(ends.tolist()):
        later = np.flatnonzero((own[i + 1 : end] != own[i]) & (not crossed or side[i + 1 : end] != side[i])) + i + 1
        if len(later):
            apart = np.bitwise_count(wide[later] ^ wide[i]).sum(axis=1, dtype=np.int64)
            close = 9 * apart <= n[i] + n[later]
            for k, d in zip(later[close].tolist(), apart[close].tolist()):
                if middle[i] and 9 * fine_apart(middle[i], middle[k]) > n[i] + n[k]:
                    continue
                yield d / max(1, int(n[i] + n[k])), *sorted((int(node[i]), int(node[k]))), int(own[i]), int(own[k])


def forests(pairs: Iterator[tuple[float, int, int, int, int]], refused: set[tuple[int, int]], most: int) -> list[tuple[int, int]]:
    """The closest pairs not yet refused, as many as make ``most`` forests over
    the components."""
    grown: list[Forest] = []
    chosen = []
    for _, a, b, x, y in sorted(p for p in pairs if (p[1], p[2]) not in refused):
        if not any(forest.join(x, y) for forest in grown):
            if len(grown) == most:
                continue
            grown.append(Forest())
            grown[-1].join(x, y)
        chosen.append((a, b))
    return chosen


TILE = ["tile", "node", "own", "n", "wide", "middle", "side", "crossed"]
#: Rows with this size stand for a refused pair of the tile: node and own.
REFUSED = -1


def _tiles(most: int):
    """(tile, a, b): pairs to try in each tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (tile, node, own, n, wide, middle, side, crossed), cuts in _runs(batches, TILE):
            found = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                here, gone = a + np.flatnonzero(n[a:b] != REFUSED), a + np.flatnonzero(n[a:b] == REFUSED)
                refused = set(zip(node[gone].tolist(), own[gone].tolist()))
                pairs = close_pairs(node[here], own[here], n[here], wide[here], middle[here], side[here], bool(crossed[a]))
                found += [(int(tile[a]), x, y) for x, y in forests(pairs, refused, most)]
            flat = np.array(found, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in flat.T], ["tile", "a", "b"])

    return run


def apart():
    """Bits in which the sketches ``x`` and ``y`` differ."""
    return F.aggregate(F.zip_with("x", "y", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, b: a + b)


def _finely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose fine sketches let them be near copies."""
    for batch in batches:
        sizes = (batch.column("n").to_numpy() + batch.column("m").to_numpy()).tolist()
        apart = [fine_apart(x, y) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())]
        yield batch.select(["a", "b"]).filter(pa.array([9 * d <= size for d, size in zip(apart, sizes)], pa.bool_()))


def near(pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of the written pairs (a, b) those that share four fifths of their
    shingles. ``nodes`` has an outline of each text."""
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sizes = nodes.select("node", "n", "fine").join(broadcast_if_small(ends), "node", "left_semi")
    both = pairs.join(sizes.select(F.col("node").alias("a"), "n", F.col("fine").alias("x")), "a").join(
        sizes.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("fine").alias("y")), "b")
    fine = materialise(both.mapInArrow(_finely, "a long, b long").distinct(), "pairs")
    if fine.isEmpty():
        return fine
    # texts travel, once for each pair that the fine sketches do not refuse:
    # they are smaller than their shingles
    sides = fine.select("a", "b", F.explode(F.array("a", "b")).alias("node"))
    sides = materialise(sides.join(nodes.select("node", "doc", "h"), "node").select("doc", "h", "a", "b"), "sides")
    texts = docs.join(broadcast_if_small(sides), ["doc", "h"]).select("a", "b", "text")
    found = materialise(texts.repartition("a", "b").sortWithinPartitions("a", "b").mapInArrow(_verdicts, "a long, b long"), "near")
    release(sides, fine)
    return found


def distinct_groups(members: DataFrame) -> DataFrame:
    """Of the written groups (key, node, count) that hold the same nodes one
    each, with their number as ``weight``."""
    alike = members.groupBy("key").agg(
        F.first("count").alias("count"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    kept = materialise(alike.groupBy("count", "x", "y").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("weight")).select(
        "key", "weight"), "kept")
    groups = materialise(members.join(broadcast_if_small(kept), "key"), "groups")
    release(members, kept)
    return groups


def first_pairs(members: DataFrame, sketches: DataFrame, roots: DataFrame | None) -> DataFrame:
    """A few pairs (a, b) of each text, with those that share most with it.
    Texts of one root are held together already and make no pair."""
    # a large group is dealt out; what it misses here is left to later rounds
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("count") / GROUP))
    if roots is None:
        first = members.withColumn("own", F.col("node"))
    else:
        first = members.join(roots, "node", "left").withColumn("own", F.coalesce("root", "node"))
    first = first.select(F.xxhash64("key", part).alias("key"), "node", "own", "weight")
    first = first.repartition("key").sortWithinPartitions("key", F.xxhash64("node", "key")).mapInArrow(
        _neighbours, "a long, b long, weight long")
    first = materialise(first.groupBy("a", "b").agg(F.sum("weight").alias("count")), "pairs")
    ends = first.select("a", "b", "count", F.explode(F.array("a", "b")).alias("end"))
    best = Window.partitionBy("end").orderBy(F.desc("count"), "a", "b")
    chosen = ends.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= FIRST).select("a", "b").distinct()
    chosen = chosen.join(sketches.select(F.col("node").alias("a"), F.col("n").alias("n"), F.col("wide").alias("x")), "a").join(
        sketches.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("wide").alias("y")), "b")
    chosen = materialise(chosen.filter(9 * apart() <= F.col("n") + F.col("m")).select("a", "b"), "pairs")
    release(first)
    return chosen


def mixed_tiles(members: DataFrame, roots: DataFrame, sketches: DataFrame, live: DataFrame | None) -> DataFrame:
    """Rows of the groups that still hold several components, dealt to tiles.
    After the first round only the ``live`` tiles, those that offered pairs in
    the last one: components only grow and refused pairs only become more, so a
    tile without a pair never has one again."""
    rows = members.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("own"))
    mixed = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("own").alias("low"), F.max("own").alias("high"))
    mixed = mixed.filter("low <> high").select("key", F.ceil(F.col("size") / GROUP).alias("parts"))
    rows = rows.join(mixed, "key").withColumn("side", F.pmod(F.xxhash64("node", F.lit(1)), "parts"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    rows = rows.select("*", other.alias("other")).select(
        F.xxhash64("key", F.least("side", "other"), F.greatest("side", "other")).alias("tile"),
        "node", "own", "side", (F.col("side") != F.col("other")).cast("int").alias("crossed"))
    if live is not None:
        rows = rows.join(broadcast_if_small(live), "tile", "left_semi")
    return rows.join(sketches, "node").select(TILE)


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """Edges (a, b) between nodes whose fingerprints are the same or at most
    four bits apart, as many as connect them."""
    heads = materialise(prints.groupBy("fp").agg(F.min("node").alias("head")), "heads")
    same = prints.select("fp", "node").join(heads, "fp").select(F.col("head").alias("a"), F.col("node").alias("b"))
    ends = simhash.links(heads.select("fp"))
    apart = ends.join(heads.select(F.col("fp").alias("a"), F.col("head").alias("x")), "a").join(
        heads.select(F.col("fp").alias("b"), F.col("head").alias("y")), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return materialise(same.unionByName(apart).filter("a <> b").distinct(), "links")


def links(docs: DataFrame, prints: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """Edges that hold together the components of near copies, as a written
    table; ``given`` edges are among them."""
    nodes = one_each(prints)
    sketches = nodes.select("node", "n", "wide", "middle")
    keys = nodes.select("node", F.explode("prefix").alias("key"))
    counts = materialise(keys.groupBy("key").count().filter(F.col("count") > 1), "counts")
    members = materialise(keys.join(counts, "key"), "members")
    release(counts)
    members = distinct_groups(members)
    roots = materialise(components(given), "roots") if given is not None else None
    tried = first_pairs(members, sketches, roots)
    joined = near(tried, docs, nodes)
    refused = materialise(tried.join(joined, ["a", "b"], "left_anti").select(F.lit(None).cast("long").alias("tile"), "a", "b"), "refused")
    release(tried)
    if given is not None:
        found, joined = joined, materialise(joined.unionByName(given), "links")
        release(found, given, roots)
    live = None
    for number in count():
        roots = materialise(components(joined), "roots")
        tiles = mixed_tiles(members, roots, sketches, live)
        # a refused pair takes part in every tile that has offered it
        gone = refused.filter("tile IS NOT NULL").select(
            "tile", F.col("a").alias("node"), F.col("b").alias("own"), F.lit(REFUSED).alias("n"),
            F.array_repeat(F.lit(0).cast("long"), WIDE).alias("wide"), F.lit(b"").alias("middle"), F.lit(0).cast("long").alias("side"),
            F.lit(0).alias("crossed"))
        offered = tiles.unionByName(gone).repartition("tile").sortWithinPartitions("tile", F.desc("n")).mapInArrow(
            _tiles(MORE**number), "tile long, a long, b long")
        offered = materialise(offered, "offered")
        release(roots, *([live] if live is not None else []))
        if offered.isEmpty():
            release(offered, refused, members)
            return joined
        live = materialise(offered.select("tile").distinct(), "live")
        fresh = materialise(offered.select("a", "b").distinct().join(
            refused.select("a", "b").distinct(), ["a", "b"], "left_anti"), "pairs")
        found = near(fresh, docs, nodes)
        every = materialise(joined.unionByName(found), "links")
        known = materialise(refused.unionByName(offered.join(found, ["a", "b"], "left_anti")), "refused")
        release(fresh, found, joined, refused, offered)
        joined, refused = every, known


def near_copy_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", fingerprints: bool = False) -> DataFrame:
    """(doc, h, root) of every row: rows with one root are near copies. ``doc``
    is the id (null as 0) and ``h`` tells its text, so that every job finds a
    row alike."""
    docs = keyed(documents(docs, doc_id, text))
    prints = materialise(outlines(docs, hot_shingles(docs)), "outlines")
    joined = links(docs, prints, fingerprint_links(prints) if fingerprints else None)
    roots = materialise(components(joined), "roots")
    groups = materialise(prints.select("doc", "h", "node").join(roots, "node", "left").select(
        "doc", "h", F.coalesce("root", "node").alias("root")), "groups")
    release(prints, joined, roots)
    return groups


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("doc_id", F.lit(0)).alias("doc"), _text_hash("doc_id", "text").alias("h"), "text")


def _text_hash(doc_id: str, text: str):
    return F.xxhash64(F.col(text).cast("string"), F.col(doc_id).isNull())


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", fingerprints: bool = False) -> DataFrame:
    """One row of each group of near copies, the one with the smallest id, with
    the columns it came with. With ``fingerprints`` texts that op7 links are
    near copies, too.

    Null texts count as empty, and all texts without words are copies of each
    other; null ids count as 0. Rows alike in id and text are one, and one of
    them stays. An empty table stays empty.
    """
    groups = near_copy_groups(docs, doc_id, text, fingerprints)
    kept = groups.groupBy("root").agg(F.min(F.struct("doc", "h")).alias("kept"), F.count(F.lit(1)).alias("n"))
    kept = kept.select(F.col("kept.doc").alias("_doc"), F.col("kept.h").alias("_h"))
    again = materialise(groups.groupBy("doc", "h").count().filter("count > 1").select(
        F.col("doc").alias("_doc"), F.col("h").alias("_h")), "again")
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(doc_id).cast("long"), F.lit(0)).alias("_doc"),
                       _text_hash(doc_id, text).alias("_h")).join(kept, ["_doc", "_h"], "left_semi")
    if not again.isEmpty():
        rows = rows.join(again, ["_doc", "_h"], "left_anti").unionByName(
            rows.join(again, ["_doc", "_h"], "left_semi").dropDuplicates(["_doc", "_h"]))
    return rows.select("row.*")
