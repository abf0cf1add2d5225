"""Packing of documents into fixed-size sequences by a linear grouping scheme.

Lengths are at most the capacity, so their histogram is bounded (2048 rows) and the
whole plan is made from it on the driver, whatever the number of documents:

1. Lengths over LARGE of the capacity are sorted and cut into GROUPS groups of equal
   cardinality; each group is rounded up to its longest member (linear grouping).
2. Configurations of those few sizes are optimised together: the linear program of
   the fewest sequences that hold all groups, by column generation (a knapsack finds
   the configuration that the current prices make most worthwhile). It says how often
   each configuration is used.
3. Actual documents replace the rounded sizes: the longest left of each group, and in
   the last place the longest of all documents left that still fits, so that what
   rounding has left free is filled too.
4. All documents left, small ones among them, go by best fit, longest first.

The plan says: of the documents of this length, those ranked lo .. lo+n-1 go to
sequences s .. s+n-1 at this offset. Pieces as long as a sequence need no plan: each
takes a sequence of its own, numbered below zero by the row. The others are ranked
within their length in buckets of about BUCKET_ROWS rows with bucket offsets; buckets
are dealt by the row's number, so neither a length shared by a third of all documents
nor a row repeated as often meets in one task, however large the corpus.

Defined cases. Null text: empty, one token (the closing id). Longer documents than
a sequence are cut into full pieces, the first may be shorter. Repeated rows and
null ids are packed like any others. Very long texts are tokenized whole, one at a time.
Extra columns, whatever their names, are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from calspark.llm.storage import documents, materialize
from calspark.llm.tokens import TOKENIZER, encoder

CAPACITY = 2048
END_ID = 0
#: Sizes after grouping, and the largest length that counts as small, as a share of the capacity.
GROUPS, LARGE = 32, 1 / 3
#: Most rounds of column generation; each leaves a plan that holds all groups.
ROUNDS = 1_000
#: Rows that are ranked together.
BUCKET_ROWS = 50_000
#: A plan of more rows than this is joined by shuffle.
BROADCAST_ROWS = 1_000_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _tokenize(tokenizer: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).ids
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch.column(0), batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                edges = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                for n, (a, b) in enumerate(zip(edges, edges[1:])):
                    for column, value in zip(out, (doc.as_py(), n, a, b - a, zlib.crc32(ids[a:b].tobytes()))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def pieces(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document's ids and the closing id, cut to the capacity."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_tokenize(tokenizer, capacity, end_id), PIECES)


class _Plan:
    """Sequences as ranges of equal fill; every placement splits at most one range."""

    def __init__(self, capacity: int):
        self.capacity, self.next_seq, self.rows = capacity, 0, []
        self.rank: dict[int, int] = {}
        self.open: dict[int, list[tuple[int, int]]] = {}  # room left -> [(first sequence, count)]
        self.rooms = 0  # bit r: some range has room r

    def place(self, length: int, seq: int, n: int, offset: int) -> None:
        lo = self.rank.get(length, 0)
        self.rank[length] = lo + n
        self.rows.append((length, lo, n, seq, offset))

    def put(self, room: int, seq: int, n: int) -> None:
        if room and n:
            self.open.setdefault(room, []).append((seq, n))
            self.rooms |= 1 << room

    def take(self, room: int, most: int) -> tuple[int, int]:
        ranges = self.open[room]
        seq, n = ranges.pop()
        if n > most:
            ranges.append((seq + most, n - most))
            n = most
        if not ranges:
            self.rooms &= ~(1 << room)
        return seq, n

    def new(self, n: int) -> int:
        self.next_seq += n
        return self.next_seq - n

    def best_fit(self, length: int, count: int) -> None:
        while count:
            fits = self.rooms >> length
            if fits:
                room = length + (fits & -fits).bit_length() - 1
                seq, n = self.take(room, count)
            else:
                room = self.capacity
                n = -(-count // (room // length))
                seq = self.new(n)
            self.place(length, seq, n, self.capacity - room)
            self.put(room - length, seq, n)
            count -= n


def _grouped(counts: dict[int, int], groups: int) -> list[list[list[int]]]:
    """Groups of equal cardinality, longest first; each a list of [length, count] with the longest first."""
    total, out, done = sum(counts.values()), [], 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            k = min(done * groups // total, groups - 1)
            n = min(left, -(-(k + 1) * total // groups) - done) if k < groups - 1 else left
            if len(out) <= k or not out:
                out.append([])
            out[-1].append([length, n])
            done, left = done + n, left - n
    return out


def _dearest(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of the greatest worth, by dynamic programming over the room: (worth, times of each size)."""
    worth, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(int(sizes.min()), capacity + 1):
        fits = np.flatnonzero(sizes <= room)
        values = worth[room - sizes[fits]] + prices[fits]
        best = int(values.argmax())
        worth[room] = worth[room - 1]
        if values[best] > worth[room] + 1e-12:
            worth[room], last[room] = values[best], fits[best]
    times, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if last[room] < 0:
            room -= 1
        else:
            times[last[room]] += 1
            room -= int(sizes[last[room]])
    return float(worth[capacity]), times


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[list[int], float]]:
    """(slots, times): how often each configuration is used when the fewest sequences hold ``demand`` items of each size.

    The solution of the linear program, by column generation from one configuration a
    size; ``slots`` names the size of each place. Stopping early leaves a solution that
    only takes more sequences.
    """
    if not sizes:
        return []
    width, need = np.array(sizes), np.array(demand, float)
    basis = np.diag((capacity // width).astype(float))
    amounts = need / basis.diagonal()
    for _ in range(ROUNDS):
        inverse = np.linalg.inv(basis)
        amounts = inverse @ need
        worth, column = _dearest(width, np.maximum(inverse.sum(0), 0), capacity)
        if worth <= 1 + 1e-7:
            break
        step = inverse @ column
        out = np.full(len(sizes), np.inf)
        out[step > 1e-9] = amounts[step > 1e-9] / step[step > 1e-9]
        if not np.isfinite(out).any():
            break
        basis[:, int(out.argmin())] = column
    slots = [[g for g in range(len(sizes)) for _ in range(int(basis[g, j]))] for j in range(len(sizes))]
    return sorted(((c, float(n)) for c, n in zip(slots, amounts) if n > 0), key=lambda x: (-sum(sizes[g] for g in x[0]), x[0]))


class _Stock:
    """Documents left, by length."""

    def __init__(self, histogram: dict[int, int]):
        self.left = dict(histogram)
        self.lengths = sum(1 << k for k in self.left)  # bit k: there are documents of length k

    def longest(self, low: int, high: int, taken: dict[int, int]) -> int:
        """The longest length from low to high that is there beyond ``taken``, or 0."""
        while high >= low and (high := (self.lengths & ((1 << (high + 1)) - 1)).bit_length() - 1) >= low:
            if self.left[high] > taken.get(high, 0):
                return high
            high -= 1
        return 0

    def take(self, length: int, n: int) -> None:
        self.left[length] -= n
        if not self.left[length]:
            self.lengths &= ~(1 << length)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, lo, n, sequence, offset) that place every document of the histogram once."""
    work, stock = _Plan(capacity), _Stock({k: n for k, n in histogram.items() if k and n})
    if full := stock.left.get(capacity):
        work.place(capacity, work.new(full), full, 0)
        stock.take(capacity, full)
    large = {k: n for k, n in stock.left.items() if capacity * LARGE < k and n}
    groups = _grouped(large, min(GROUPS, sum(large.values()))) if large else []
    sizes, lows = [g[0][0] for g in groups], [g[-1][0] for g in groups]
    for slots, amount in configurations(sizes, [sum(n for _, n in g) for g in groups], capacity):
        times = round(amount)
        while times > 0:
            chosen: list[int] = []
            taken: dict[int, int] = {}
            for place, g in enumerate(slots, 1):
                high = sizes[g] if place < len(slots) else capacity - sum(chosen)
                length = stock.longest(lows[g], high, taken)
                if not length:
                    break
                chosen.append(length)
                taken[length] = taken.get(length, 0) + 1
            if len(chosen) < len(slots):
                break  # a group has run out: what is left of the others goes by best fit
            n = min(times, *(stock.left[k] // c for k, c in taken.items()))
            seq, offset = work.new(n), 0
            for k in chosen:
                work.place(k, seq, n, offset)
                offset += k
            for k, c in taken.items():
                stock.take(k, c * n)
            work.put(capacity - offset, seq, n)
            times -= n
    for length in sorted(stock.left, reverse=True):
        work.best_fit(length, stock.left[length])
    return work.rows


def numbered(parts: DataFrame) -> DataFrame:
    """``parts`` with a number of its own for every row; to be written before it is read."""
    return parts.withColumn("row", F.monotonically_increasing_id())


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``parts`` (columns of ``pieces`` and row, written already) with sequence_id and offset."""
    spark = parts.sparkSession
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    full = parts.where(F.col("length") == capacity).select(*columns, (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = parts.where(F.col("length") < capacity)
    # at most ``capacity`` rows
    histogram = {r["length"]: r["n"] for r in rest.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    placed: dict[int, list[tuple]] = {}
    for length, lo, n, seq, offset in plan(histogram, capacity):
        placed.setdefault(length, []).append((lo, lo + n, seq, offset))
    # a length's ranks in as many tiles as it has rows of the plan: each meets few of them
    sizes = [(k, -(-n // BUCKET_ROWS), -(-n // len(placed[k]))) for k, n in histogram.items()]
    tiled = [(k, tile, *row) for k, _, size in sizes for row in placed[k] for tile in range(row[0] // size, (row[1] - 1) // size + 1)]
    # both tables grow with the capacity, not with the documents; the second one's size is checked all the same
    sizes = F.broadcast(spark.createDataFrame(sizes, "length long, buckets long, tile_size long"))
    places = spark.createDataFrame(tiled, "p_length long, p_tile long, lo long, hi long, seq long, offset long")
    places = F.broadcast(places) if len(tiled) <= BROADCAST_ROWS else places
    keyed = rest.join(sizes, "length").withColumn("bucket", F.pmod(F.xxhash64("row"), F.col("buckets")))
    counts = keyed.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "bucket").orderBy("row")
    ranked = keyed.withColumn("nth", F.row_number().over(within)).join(offsets, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("nth") - 1)
    tile = F.floor(F.col("rank") / F.col("tile_size")).cast("long")
    met = ranked.withColumn("tile", tile).join(
        places, (F.col("length") == F.col("p_length")) & (F.col("tile") == F.col("p_tile")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    )
    return full.unionByName(met.select(*columns, (F.col("seq") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset"))


def best_fit_packing(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(materialize(numbered(pieces(docs, tokenizer, capacity, end_id)), "packing"), capacity)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(documents(spark, sf_dir))


QUERIES = {"op9_packing": op9_packing}
ORACLES: dict[str, str] = {}
