"""Ranked lexical search over impact vectors in buckets of similar length.

Items are worked off in blocks, each against all documents. One pass over the
texts keeps what a block's terms occur in each document (places in the block's
vocabulary and counts), with the size of the document. Together they give the
weights, and with them every document becomes a vector of integer impacts over
the block's terms; its score for an item is the product with the item's weights.

The vectors are sorted by length over all partitions and cut into buckets. By
Cauchy-Schwarz no document of a bucket scores more than its longest vector times
the item's length: buckets below what the item already has are skipped. Inside a
bucket the heaviest coordinates of the item are added up exactly; what the other
coordinates can still give is at most the product of the two remaining lengths.
Documents below the item's mark go, the survivors are scored in 64-bit integers.

The mark of an item is the score of its tenth document so far. The first bucket
of every sorted partition gives the marks all tasks start with; from there each
raises its own. Bounds are rounded up and equal scores are never pruned, so the
result is the one of a full scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symptia.llm.common import byte_values, documents, materialise, pieces_of, release

TOP = 10
#: Items of a block, and the terms of a block beyond which it gets no more items.
ITEMS, TERMS = 2_000, 500_000
#: Documents of a bucket, and the impacts beyond which it gets no more.
BUCKET, ENTRIES = 4_096, 1_000_000
#: Share of an item's squared length that its heaviest coordinates hold.
HEAVY = 0.7
BATCH_BYTES = 4 << 20
#: Bounds are raised by this share before they are compared.
SLACK = 1e-9
SCALE = 1_000

# A-Z to lower case; all other ASCII but letters and digits to blanks.
_CLEAN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and digits and of all other characters beyond
    ASCII, only A-Z lower-cased."""
    return text.translate(_CLEAN).split()


def blocks(items: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """Items with their different terms, in runs of bounded size."""
    own, held = [], 0
    for row in items.select(F.col(item_id).cast("long").alias("i"), F.col(text).cast("string").alias("t")).toLocalIterator():
        if own and (len(own) == ITEMS or held > TERMS):
            yield own
            own, held = [], 0
        own.append((row.i, sorted(set(terms((row.t or "").encode())))))
        held += len(own[-1][1])
    if own:
        yield own


def _counted(vocabulary):
    """Per document its number of terms, and place and count of those in the
    vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {t: i for i, t in enumerate(vocabulary.value)}.get
        for batch in pieces_of(batches, BATCH_BYTES):
            words = [terms(t) for t in byte_values(batch.column("text"))]
            sizes = np.array([len(w) for w in words], np.int64)
            found = np.array([place(w, -1) for own in words for w in own], np.int64)
            owner = np.repeat(np.arange(len(words)), sizes)
            keys, counts = np.unique((owner << 32 | found)[found >= 0], return_counts=True)
            ends = np.searchsorted(keys >> 32, np.arange(len(words) + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in ((keys & 0xFFFFFFFF).astype(np.int32), counts.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), *lists], ["doc_id", "n", "places", "counts"])

    return run


def _holding(size: int):
    """Documents of a task that hold each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch.column("places").flatten().to_numpy(zero_copy_only=False), minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["place", "df"])

    return run


def impacts(total_documents: int, total_terms: int) -> Column:
    """Integer impacts of the column ``counts`` in documents of ``n`` terms."""
    return F.expr(f"""
        transform(counts, c -> CAST((1000000000L * c) div (
            1000L * c + 8L * (10L + (90L * n * {total_documents}L) div {max(1, total_terms)}L)) AS INT))""")


BUCKETS = ("head boolean, longest double, ids array<long>, squares array<double>, sizes array<int>, places array<int>, "
           "impacts array<int>")


def _bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The vectors of a sorted partition as one row a bucket."""
    schema = pa.schema([
        ("head", pa.bool_()), ("longest", pa.float64()), ("ids", pa.list_(pa.int64())), ("squares", pa.list_(pa.float64())),
        ("sizes", pa.list_(pa.int32())), ("places", pa.list_(pa.int32())), ("impacts", pa.list_(pa.int32()))])
    held: list[pa.RecordBatch] = []
    rows = entries = 0
    head = True

    def bucket() -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        columns = [table["doc_id"], table["squares"], pa.chunked_array([c.value_lengths() for c in table["places"].chunks]),
                   *[pa.chunked_array([c.flatten() for c in table[name].chunks]) for name in ("places", "impacts")]]
        longest = float(np.sqrt(table["squares"][0].as_py()))
        return pa.RecordBatch.from_arrays(
            [pa.array([head]), pa.array([longest])]
            + [pa.array([c.to_numpy(zero_copy_only=False) if c.null_count == 0 else c.to_pylist()], f.type)
               for c, f in zip((c.combine_chunks() for c in columns), list(schema)[2:])], schema=schema)

    for batch in batches:
        while batch.num_rows:
            sizes = np.cumsum(batch.column("places").value_lengths().to_numpy())
            fit = min(BUCKET - rows, int(np.searchsorted(sizes, ENTRIES - entries, side="right")))
            if fit == 0 and not held:
                fit = 1  # one vector longer than a bucket
            cut, batch = batch.slice(0, fit), batch.slice(fit)
            if fit:
                held.append(cut)
                rows, entries = rows + fit, entries + int(sizes[fit - 1])
            if batch.num_rows or rows == BUCKET:
                yield bucket()
                held, rows, entries, head = [], 0, 0, False
    if held:
        yield bucket()


class _Bucket:
    """Documents of similar length, longest first, by term and by document."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        values = {name: batch.column(name)[row].values for name in ("ids", "squares", "sizes", "places", "impacts")}
        self.ids = values.pop("ids")
        squares, sizes, self.places, self.values = (v.to_numpy() for v in values.values())
        self.norms = np.sqrt(squares)
        self.ends = np.append(0, np.cumsum(sizes.astype(np.int64)))
        self.values = self.values.astype(np.int64)
        order = np.argsort(self.places, kind="stable")
        self.terms, starts = np.unique(self.places[order], return_index=True)
        self.starts = np.append(starts, len(order))
        self.owner, self.by_term = np.repeat(np.arange(len(sizes)), sizes)[order], self.values[order]

    def holding(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.terms, term)
        if at == len(self.terms) or self.terms[at] != term:
            return self.owner[:0], self.by_term[:0]
        own = slice(self.starts[at], self.starts[at + 1])
        return self.owner[own], self.by_term[own]

    def survivors(self, item: "_Item", mark: int) -> np.ndarray:
        """Documents that the bounds leave."""
        reach = np.searchsorted(-self.norms, -mark / (item.norm * (1 + SLACK)), side="right")
        part, squares = np.zeros(len(self.norms), np.int64), np.zeros(len(self.norms))
        for term, weight in item.heavy:
            owner, values = self.holding(term)
            part[owner] += weight * values
            squares[owner] += values.astype(np.float64) ** 2
        rest = np.sqrt(np.maximum(self.norms**2 - squares, 0)) * item.rest
        bound = (part + rest) * (1 + SLACK) + 1
        return np.flatnonzero(bound[:reach] >= mark)

    def scores(self, item: "_Item", rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Exact scores of some documents; ``weights`` is room for all terms."""
        sizes = self.ends[rows + 1] - self.ends[rows]
        before = np.cumsum(sizes) - sizes
        at = np.arange(sizes.sum()) + np.repeat(self.ends[rows] - before, sizes)
        weights[item.places] = item.weights
        products = np.append(weights[self.places[at]] * self.values[at], 0)
        weights[item.places] = 0
        return np.where(sizes > 0, np.add.reduceat(products, before) if len(rows) else 0, 0)


class _Item:
    def __init__(self, places: np.ndarray, weights: np.ndarray):
        order = np.argsort(-weights, kind="stable")
        self.places, self.weights = places[order], weights[order]
        squares = self.weights.astype(np.float64) ** 2
        self.norm = float(np.sqrt(squares.sum()))
        heavy = int(np.searchsorted(np.cumsum(squares), HEAVY * squares.sum())) + 1
        self.heavy = list(zip(self.places[:heavy].tolist(), self.weights[:heavy].tolist()))
        self.rest = float(np.sqrt(squares[heavy:].sum())) * (1 + SLACK)


def _best(rows: list[tuple[int, int | None]]) -> list[tuple[int, int | None]]:
    """The highest scores, ties to the smaller id, rows without one last."""
    return sorted(rows, key=lambda r: (-r[0], r[1] is None, r[1] or 0))[:TOP]


def _searched(block, marks, room: int):
    """The best documents of a task for each item of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = [_Item(places, weights) for places, weights in block.value]
        best: list[list] = [[] for _ in items]
        lowest = list(marks.value) if marks else [1] * len(items)
        weights = np.zeros(room, np.int64)
        for batch in batches:
            for row, longest in enumerate(batch.column("longest").to_pylist()):
                bucket = None
                for i, item in enumerate(items):
                    if longest * item.norm * (1 + SLACK) < lowest[i]:
                        continue
                    bucket = bucket or _Bucket(batch, row)
                    rows = bucket.survivors(item, lowest[i])
                    scores = bucket.scores(item, rows, weights)
                    good = np.flatnonzero(scores >= lowest[i])
                    if len(good):
                        ids = bucket.ids.take(pa.array(rows[good])).to_pylist()
                        best[i] = _best(best[i] + list(zip(scores[good].tolist(), ids)))
                        if len(best[i]) == TOP:
                            lowest[i] = max(lowest[i], best[i][-1][0])
        found = [(i, score, doc) for i, own in enumerate(best) for score, doc in own]
        yield pa.RecordBatch.from_pydict(
            {"item": [f[0] for f in found], "score": [f[1] for f in found], "doc_id": [f[2] for f in found]},
            pa.schema([("item", pa.int32()), ("score", pa.int64()), ("doc_id", pa.int64())]))

    return run


FOUND = "item int, score long, doc_id long"


def _ranked(found: DataFrame) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= TOP)


def _search_block(docs: DataFrame, block: list[tuple[int | None, list[bytes]]]) -> DataFrame:
    """item, score, doc_id, rank of one block of items."""
    spark = docs.sparkSession
    vocabulary = sorted({t for _, own in block for t in own})
    place = {t: i for i, t in enumerate(vocabulary)}
    counted = materialise(docs.mapInArrow(
        _counted(spark.sparkContext.broadcast(vocabulary)), "doc_id long, n long, places array<int>, counts array<int>"), "counted")
    total = counted.agg(F.count_if(F.col("n") > 0).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens")).first()
    df = np.zeros(len(vocabulary), np.int64)
    holding = counted.select("places").mapInArrow(_holding(len(vocabulary)), "place int, df long").groupBy("place").agg(F.sum("df").alias("df"))
    for row in holding.collect():  # no more than the block has terms
        df[row.place] = row.df
    weights = np.floor(SCALE * np.log((2 * total.documents + 2) / (2 * df + 1))).astype(np.int64)
    items = []
    for _, own in block:
        places = np.array([place[t] for t in own], np.int64)
        useful = places[(weights[places] > 0) & (df[places] > 0)] if len(places) else places
        items.append((useful, weights[useful]))
    shared = spark.sparkContext.broadcast(items)

    vectors = counted.filter(F.size("places") > 0).select(
        "doc_id", F.monotonically_increasing_id().alias("row"), "places",
        impacts(total.documents, total.tokens).alias("impacts"))
    vectors = vectors.withColumn("squares", F.aggregate(
        "impacts", F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double") * x.cast("double")))
    # the row number divides vectors of one length, such as copies
    by_length = vectors.repartitionByRange(F.desc("squares"), "row").sortWithinPartitions(F.desc("squares"), "row")
    buckets = materialise(by_length.mapInArrow(_bucketed, BUCKETS), "buckets")
    release(counted)
    seeds = buckets.filter("head").mapInArrow(_searched(shared, None, len(vocabulary)), FOUND)
    marks = [1] * len(items)
    for row in _ranked(seeds).filter(F.col("rank") == TOP).select("item", "score").collect():  # one per item
        marks[row.item] = row.score
    # buckets that no item of the block reaches are not even read
    reach = min((m / _Item(*i).norm for m, i in zip(marks, items) if len(i[0])), default=0.0) / (1 + SLACK) ** 2
    found = buckets.filter(F.col("longest") >= reach).mapInArrow(
        _searched(shared, spark.sparkContext.broadcast(marks), len(vocabulary)), FOUND)
    out = materialise(_ranked(found), "ranked")
    release(buckets)
    return out


def search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
           item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the ten best documents of every item.

    Null texts have no terms. Rows with equal ids are documents, or items, of
    their own; among equal scores a null doc_id comes last, a null item_id
    stays null. Items without a term, or whose terms are in no document, have
    no rows, nor has an empty table. Other columns do not matter.
    """
    spark = docs.sparkSession
    own = documents(docs, doc_id, text)
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in blocks(items, item_id, item_text):
        names = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(block)], "item int, item_id long")
        found = _search_block(own, block).join(F.broadcast(names), "item")
        out = out.unionByName(found.select("item_id", "rank", "doc_id", "score"))
    return out
