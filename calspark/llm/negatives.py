"""Hard negatives by a vector-approximation file.

Components become integers, floor(256 x). Each dimension is cut into CELLS cells at its
quantiles, and a row's approximation is its cell numbers, two to a byte. For an anchor
and a cell the smallest and the largest product are known, so that tables hold a lower and
an upper bound of every part of an inner product; their sums by look-up bound the score.
Only rows whose bounds let them enter what is sought are scored exactly: the first
positives of an anchor, then for each positive the first rows within its window of
scores. What is sought so far raises the threshold: lower bounds of a batch first,
then exact scores. All bounds and scores are whole numbers.

Anchors are read in blocks of about ANCHORS rows, each broadcast to one pass over
the approximations; a pass returns at most ``positives`` rows an anchor and ``negatives``
rows a window from every task, and Spark ranks these.

Defined cases. Rows with a null id, label or vector, or with a null or non-finite
component, take no part. Shorter vectors are filled up with zeros; components beyond
+-2**23 count as that. Every row stands for itself: anchors of one id each give their rows,
other rows of an anchor's id can be its positives, ties by vec_id are broken by
the rest of the row. Extra columns are ignored; an empty table, or one without anchors, gives an
empty result. A negative or zero positive score gives the window that the inequality
says: empty, or zero.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from calspark.llm.storage import materialize

SCALE, MOST = 256, 1 << 23
POSITIVES, NEGATIVES = 5, 10
#: The window of a negative's score in per cent of the positive's.
LOWEST, HIGHEST = 30, 90
CELLS = 16
#: Anchors of a pass over all rows, anchors whose tables and rows whose bounds are held at a time.
ANCHORS, AT_ONCE, ROWS = 4096, 128, 2048
#: The first anchors: those whose vec_id this divides.
EVERY = 100

RESULT = "anchor long, slot int, anchor_id long, positive_id long, positive_score long, score long, vec_id long, number long"


def integers(embeddings: DataFrame, noisy: bool = True) -> DataFrame:
    """(number, vec_id, label, x) of the rows that take part, written. noisy: labels of ids divisible by 7 move on by one."""
    v = F.col("v")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = embeddings.select(
        embeddings["vec_id"].cast("long").alias("vec_id"), embeddings["label"].cast("long").alias("label"), embeddings["embedding"].cast("array<double>").alias("v")
    ).where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & ~bad)
    if noisy:
        rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    x = F.transform(v, lambda c: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(SCALE * F.greatest(F.lit(-2.0 * MOST), F.least(F.lit(2.0 * MOST), c))))).cast("int"))
    return materialize(rows.select(F.monotonically_increasing_id().alias("number"), "vec_id", "label", x.alias("x")), "negatives-integers")


def cells(vectors: DataFrame, width: int) -> np.ndarray:
    """[dimension, CELLS + 1]: the least component of each cell, and at the end one above the largest. At most ``width`` rows reach the driver."""
    fill = F.array_repeat(F.lit(0), F.greatest(F.lit(0), F.lit(width) - F.size("x")))
    each = vectors.select(F.posexplode(F.concat("x", fill)).alias("d", "c"))
    cuts = [k / CELLS for k in range(1, CELLS)]
    found = each.groupBy("d").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.percentile_approx("c", cuts, 2000).alias("cuts")).collect()
    out = np.zeros((width + width % 2, CELLS + 1), np.int64)
    out[:, -1] = 1
    for r in found:
        out[r["d"]] = [r["low"], *r["cuts"], r["high"] + 1]
    return np.maximum.accumulate(out, axis=1)


def _code(edges: np.ndarray):
    """(number, vec_id, label, x) with codes, two cells to a byte, and x filled up to an even width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists, x = batch.column(3), np.zeros((batch.num_rows, len(edges)), np.int32)
            flat, at = lists.flatten().to_numpy(), lists.offsets.to_numpy()
            at = at - at[0]
            sizes = np.diff(at)
            x[np.repeat(np.arange(len(x)), sizes), np.arange(len(flat)) - np.repeat(at[:-1], sizes)] = flat
            cell = np.stack([np.searchsorted(e[1:-1], x[:, d], "right") for d, e in enumerate(edges)], 1).astype(np.uint8)
            codes = cell[:, ::2] * CELLS + cell[:, 1::2]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([r.tobytes() for r in x], pa.binary())], ["number", "vec_id", "label", "codes", "x"])

    return run


def approximations(vectors: DataFrame, edges: np.ndarray) -> DataFrame:
    """(number, vec_id, label, codes, x) of every row, written: the approximations beside the exact vectors."""
    return materialize(vectors.mapInArrow(_code(edges), "number long, vec_id long, label long, codes binary, x binary"), "negatives-codes")


def tables(queries: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[pair of dimensions, byte of codes, query]: least and greatest sum of two products."""
    low, high = edges[:, :-1], np.maximum(edges[:, 1:] - 1, edges[:, :-1])  # an empty cell holds no row
    most = int((np.abs(queries).max(0, initial=0) * np.abs(edges).max(1)).sum())
    kind = np.int32 if most < 1 << 30 else np.int64
    a, b = low[:, :, None] * queries.T[:, None, :], high[:, :, None] * queries.T[:, None, :]
    out = []
    for part in (np.minimum(a, b), np.maximum(a, b)):
        part = part.astype(kind)
        out.append((part[::2, :, None, :] + part[1::2, None, :, :]).reshape(len(edges) // 2, CELLS * CELLS, -1))
    return out[0], out[1]


def bounds(codes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """[row, query]: the sum of the table's entries for the row's cells."""
    total = table[0][codes[:, 0]]
    for k in range(1, len(table)):
        total += table[k][codes[:, k]]
    return total


def first(found: np.ndarray, k: int) -> np.ndarray:
    """Of columns (group, score, vec_id, number): the first k of every group, higher scores and then smaller ids first."""
    found = found[:, np.lexsort((found[3], found[2], -found[1], found[0]))]
    starts = np.flatnonzero(np.concatenate(([True], found[0, 1:] != found[0, :-1]))) if found.shape[1] else np.empty(0, int)
    place = np.arange(found.shape[1]) - np.repeat(starts, np.diff(np.append(starts, found.shape[1])))
    return found[:, place < k]


def _kth(values: np.ndarray, mask: np.ndarray, k: int) -> np.ndarray:
    """Of each column the k-th largest value under the mask, or the least number of all where there are fewer."""
    least = np.iinfo(np.int64).min
    if len(values) < k:
        return np.full(values.shape[1], least)
    return np.partition(np.where(mask, values.astype(np.int64), least), len(values) - k, axis=0)[len(values) - k]


class Search:
    """The best rows so far of some anchors: ``k`` for each of ``slots`` windows of scores, of rows with the anchor's label or of others."""

    def __init__(self, numbers, labels, x, low, high, edges, k: int, same: bool):
        self.numbers, self.labels, self.x, self.low, self.high, self.k, self.same = numbers, labels, x, low, high, k, same
        self.lower, self.upper = tables(x, edges)
        self.found = np.empty((4, 0), np.int64)  # group = anchor x slots + slot
        self.least = low.copy()  # a row below cannot enter

    def add(self, numbers, ids, labels, codes, x) -> None:
        lower, upper = bounds(codes, self.lower), bounds(codes, self.upper)
        fits = (labels[:, None] == self.labels) == self.same
        if self.same:
            fits &= numbers[:, None] != self.numbers
        slots, asked = self.low.shape[1], np.zeros(fits.shape, bool)
        for s in range(slots):
            sure = fits & (lower >= self.low[:, s]) & (upper <= self.high[:, s])
            np.maximum(self.least[:, s], _kth(lower, sure, self.k), out=self.least[:, s])
            asked |= fits & (upper >= self.least[:, s]) & (lower <= self.high[:, s])
        row, anchor = np.nonzero(asked)
        if not len(row):
            return
        score = np.concatenate([(x[row[at : at + 65536]].astype(np.int64) * self.x[anchor[at : at + 65536]]).sum(1) for at in range(0, len(row), 65536)])
        fresh = [self.found]
        for s in range(slots):
            fine = (score >= self.least[anchor, s]) & (score <= self.high[anchor, s])
            fresh.append(np.stack([anchor[fine] * slots + s, score[fine], ids[row[fine]], numbers[row[fine]]]))
        self.found = first(np.concatenate(fresh, axis=1), self.k)
        group, count = np.unique(self.found[0], return_counts=True)
        full = np.isin(self.found[0], group[count == self.k])
        np.minimum.at(worst := np.full(self.least.size, np.iinfo(np.int64).max), self.found[0, full], self.found[1, full])
        worst = worst.reshape(self.least.shape)
        self.least = np.where(worst < np.iinfo(np.int64).max, np.maximum(self.least, worst), self.least)


def _search(sent, k: int, same: bool):
    """Rows of the approximations to the best rows of a task for the broadcast anchors (RESULT)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value
        parts = range(0, len(block["number"]), AT_ONCE)
        cut = lambda name, at: block[name][at : at + AT_ONCE]
        searches = [Search(*[cut(n, at) for n in ("number", "label", "x", "low", "high")], block["edges"], k, same) for at in parts]
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                numbers, ids, labels = (batch.column(n).to_numpy() for n in range(3))
                codes = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(len(numbers), -1)
                x = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.int32).reshape(len(numbers), -1)
                for search in searches:
                    search.add(numbers, ids, labels, codes, x)
        for at, search in zip(parts, searches):
            slots = search.low.shape[1]
            anchor, slot = at + search.found[0] // slots, search.found[0] % slots
            columns = [block["number"][anchor], slot.astype(np.int32), block["id"][anchor], block["positive"][anchor, slot], block["score"][anchor, slot], *search.found[1:]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [f.split()[0] for f in RESULT.split(", ")])

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id", "number"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def hard_negatives(embeddings: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, noisy: bool = True, anchors: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of the anchors, rows whose vec_id ``every`` divides."""
    spark = embeddings.sparkSession
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    vectors = integers(embeddings, noisy)
    width = max(1, vectors.agg(F.max(F.size("x"))).first()[0] or 0)
    edges = cells(vectors, width)
    coded = approximations(vectors, edges)
    chosen = coded.where(F.col("vec_id") % every == 0)
    blocks = math.ceil(chosen.count() / anchors)
    chosen = materialize(chosen.withColumn("block", F.pmod(F.xxhash64("number"), F.lit(max(1, blocks))).cast("int")), "negatives-anchors")
    parts = []
    for n in range(blocks):
        rows = chosen.where(F.col("block") == n).select("number", "vec_id", "label", "x").collect()  # about ``anchors`` rows
        if not rows:
            continue
        numbers, ids, labels = (np.array([r[k] for r in rows], np.int64) for k in range(3))
        x = np.frombuffer(b"".join(bytes(r[3]) for r in rows), np.int32).reshape(len(rows), -1).astype(np.int64)
        far = np.iinfo(np.int64).max
        block = {"number": numbers, "id": ids, "label": labels, "x": x, "edges": edges, "low": np.full((len(rows), 1), -far), "high": np.full((len(rows), 1), far), "positive": ids[:, None], "score": np.zeros((len(rows), 1), np.int64)}
        near = _ranked(coded.mapInArrow(_search(spark.sparkContext.broadcast(block), positives, True), RESULT), positives).select("anchor", "rank", "vec_id", "score").collect()
        place = {m: k for k, m in enumerate(numbers.tolist())}
        block |= {"low": np.full((len(rows), positives), far), "high": np.full((len(rows), positives), -far), "positive": np.zeros((len(rows), positives), np.int64), "score": np.zeros((len(rows), positives), np.int64)}
        for r in near:
            at = place[r["anchor"]], r["rank"] - 1
            block["positive"][at], block["score"][at] = r["vec_id"], r["score"]
            block["low"][at], block["high"][at] = -(-LOWEST * r["score"] // 100), HIGHEST * r["score"] // 100
        found = coded.mapInArrow(_search(spark.sparkContext.broadcast(block), negatives, False), RESULT)
        parts.append(materialize(_ranked(found, negatives).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives"))
    out = spark.createDataFrame([], result)
    for part in parts:
        out = out.unionByName(part)
    return out


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.label = v.label AS same, v.vec_id, CAST(list_inner_product(a.e, v.e) AS BIGINT) AS score
  FROM v AS a, v WHERE a.vec_id % 100 = 0 AND v.vec_id <> a.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score
  FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS n FROM s WHERE same) WHERE n <= 5
), r AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM r WHERE rank <= 10
"""

QUERIES = {"op13_hard_negatives": op13_hard_negatives}
ORACLES = {"op13_hard_negatives": ORACLE}
