"""SimHash near-duplicate groups with pigeonring candidate filtering.

A 64-bit fingerprint per text; fingerprints link at a Hamming distance of at most
``TAU``; groups are the connected components of that graph.

Candidates. The fingerprint is a ring of ``SEGMENTS`` segments. If two
fingerprints differ in at most TAU bits, the pigeonring principle gives a start i
from which every chain of l consecutive segments has at most floor(l*TAU/SEGMENTS)
differing bits: none in segment i, at most 1 in two, 2 in three, 3 in four.
At most two differing bits in segments i+1 and i+2 leave at least two of four
pieces of these untouched, so the index key is (i, segment i, two of the four
pieces): 30 keys of 26 bits for a fingerprint. More pieces of more segments give more
and longer keys by the same principle; the level of LEVELS with the fewest expected
rows and chance meetings is taken, so that a large corpus does not fill its buckets.
No level loses a pair. Pairs that meet in a key are pruned by the chain budgets
before the full Hamming check.

Skew. Equal texts and equal fingerprints collapse to one node before the
search. In a bucket every member is first linked to the bucket's smallest
fingerprint where they are close enough, those links are contracted to
components, and only pairs of different components are joined afterwards. A
bucket of mutually close copies therefore gives a row a member, not all pairs.

Defined cases. Null or blank text: fingerprint zero, linked like any other.
Fewer words than a shingle: the whole sequence is the one shingle. Repeated rows
stay as they are and share a component. Null ids take part but never name a
component unless nothing else does; of documents without one, one of a group stays.
Very long texts are hashed whole, PIECE bytes at a time. Extra columns, whatever their
names, are ignored, and kept where documents are filtered. An empty table gives an
empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from calspark.llm.components import connected_components
from calspark.llm.storage import documents, materialize

TAU = 4
SEGMENTS = 5
SHINGLE_WORDS = 4
SEED = 42
#: Segments after the start that a key draws on, and pieces that they are cut in: 30 keys of 26 bits, 100 of 32, 420 of 39.
LEVELS = ((2, 4), (3, 6), (3, 9))
#: Bytes of a text split at a time and hashes counted at a time: bound memory for very long texts.
PIECE, BLOCK = 1 << 22, 1 << 16
SPACE = re.compile(rb"[ \t-\r]")


def _tokens(text: str, words: int) -> Iterator[list[bytes]]:
    """The words of a text in pieces of about PIECE bytes, each led by the last words - 1 of the piece before."""
    data = text.encode("utf-8").lower()  # bytes: ASCII letters and white space only
    held: list[bytes] = []
    at = 0
    while at < len(data):
        stop = at + PIECE
        gap = SPACE.search(data, stop) if stop < len(data) else None
        stop = gap.start() if gap else len(data)
        held = held[-(words - 1) :] + data[at:stop].split() if words > 1 else data[at:stop].split()
        if held:
            yield held
        at = stop


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of a text, unsigned."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    total, ones, few = 0, np.zeros(64, np.int64), []
    for part in _tokens(text or "", words):
        few = part
        if len(part) < words:
            continue
        joined = b" ".join(part)
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1)
        starts = np.concatenate(([0], ends[:-1])).tolist()
        ends = (ends[words - 1 :] - 1).tolist()
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends)], np.uint64)
        for at in range(0, len(hashes), BLOCK):
            ones += np.unpackbits(hashes[at : at + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        total += len(hashes)
    if not total:
        return digest(b" ".join(few), SEED) if few else 0
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column is the text; its fingerprint takes its place."""
    for batch in batches:
        values = np.fromiter((fingerprint(t.as_py()) for t in batch.columns[-1]), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(values.view(np.int64))], [*batch.schema.names[:-1], "fp"])


def text_key(docs: DataFrame):
    return F.xxhash64(docs["text"].cast("string"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, key, fp) of every row; fp is the fingerprint's bits as a signed long, key a hash of the text."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_key(docs).alias("key"), docs["text"].cast("string").alias("text")).mapInArrow(_fingerprints, "doc_id long, key long, fp long")


def _ring() -> list[tuple[int, int]]:
    """(lowest bit, width) of each segment."""
    edges = [round(64 * k / SEGMENTS) for k in range(SEGMENTS + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _masks(level: int = 0) -> list[tuple[int, int]]:
    """(start segment, mask of the bits that a key holds), in a fixed order, at a level of LEVELS."""
    out, ring = [], _ring()
    after, pieces = LEVELS[level]
    spoilt = (after + 1) * TAU // SEGMENTS  # pieces of the segments after the start that differing bits can touch
    for i in range(SEGMENTS):
        low, width = ring[i]
        exact = ((1 << width) - 1) << low
        bits = [b for k in range(1, after + 1) for b in range(ring[(i + k) % SEGMENTS][0], sum(ring[(i + k) % SEGMENTS]))]
        cuts = [round(k * len(bits) / pieces) for k in range(pieces + 1)]
        masks = [sum(1 << b for b in bits[x:y]) for x, y in zip(cuts, cuts[1:])]
        out += [(i, exact | sum(chosen)) for chosen in combinations(masks, pieces - spoilt)]
    return out


def level_for(count: int) -> int:
    """The level whose index and expected chance meetings of ``count`` fingerprints are fewest."""

    def rows(level: int) -> float:
        masks = _masks(level)
        return sum(1 + count / 2.0 ** m.bit_count() for _, m in masks)

    return min(range(len(LEVELS)), key=rows)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _bits(a, b, mask: int | None = None):
    both = a.bitwiseXOR(b)
    return F.bit_count(both if mask is None else both.bitwiseAND(F.lit(_signed(mask))))


def _chain_ok(a, b, start):
    """The pigeonring test from segment ``start``: every chain stays within its budget."""
    ring, test = _ring(), F.lit(False)
    for i in range(SEGMENTS):
        chain, mask = start == i, 0
        for l in range(1, SEGMENTS):
            low, width = ring[(i + l - 1) % SEGMENTS]
            mask |= ((1 << width) - 1) << low
            chain = chain & (_bits(a, b, mask) <= l * TAU // SEGMENTS)
        test = test | chain
    return test


def buckets(nodes: DataFrame, level: int = 0) -> DataFrame:
    """Rows (start, slot, key, fp, pivot) of the index, only buckets with two members or more."""
    keys = F.array(*[
        F.struct(F.lit(n).alias("slot"), F.lit(i).alias("start"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("key"))
        for n, (i, mask) in enumerate(_masks(level))
    ])
    bucket = Window.partitionBy("slot", "key")
    return (
        nodes.select("fp", F.explode(keys).alias("k")).select("fp", "k.slot", "k.start", "k.key")
        .withColumn("pivot", F.min("fp").over(bucket)).withColumn("members", F.count(F.lit(1)).over(bucket))
        .where("members > 1").drop("members")
    )


def components(fps: DataFrame) -> DataFrame:
    """(fp, label): the component of every distinct fingerprint of ``fps`` that has a neighbour."""
    nodes = fps.select("fp").distinct()
    count = nodes.count()
    level = level_for(count)
    index = materialize(buckets(nodes, level), "simhash-buckets", count * len(_masks(level)))
    members = index.count()
    stars = index.where((F.col("fp") != F.col("pivot")) & _chain_ok(F.col("fp"), F.col("pivot"), F.col("start")) & (_bits(F.col("fp"), F.col("pivot")) <= TAU))
    first = connected_components(stars.select(F.col("fp").alias("a"), F.col("pivot").alias("b")), members)
    labelled = index.select("slot", "start", "key", "fp").join(first.select(F.col("node").alias("fp"), "label"), "fp", "left").select(
        "slot", "start", "key", "fp", F.coalesce("label", "fp").alias("label")
    )
    labelled = materialize(labelled, "simhash-labelled", members)
    a, b = labelled.alias("a"), labelled.alias("b")
    near = (
        (F.col("a.slot") == F.col("b.slot")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.label") < F.col("b.label"))
        & _chain_ok(F.col("a.fp"), F.col("b.fp"), F.col("a.start")) & (_bits(F.col("a.fp"), F.col("b.fp")) <= TAU)
    )
    bridges = a.join(b, near).select(F.col("a.label").alias("a"), F.col("b.label").alias("b")).distinct()
    second = connected_components(bridges)
    both = first.join(second.select(F.col("node").alias("label"), F.col("label").alias("outer")), "label", "left").select("node", F.coalesce("outer", "label").alias("label"))
    return both.unionByName(second.join(first.select("node"), "node", "left_anti")).select(F.col("node").alias("fp"), "label")


def grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((doc_id, key, fp) of every row, (fp, label) of every fingerprint), both written."""
    fps = materialize(fingerprints(docs), "simhash")
    nodes = fps.select("fp").distinct().join(components(fps), "fp", "left").select("fp", F.coalesce("label", "fp").alias("label"))
    return fps, materialize(nodes, "simhash-nodes", fps.count())


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable) of every row."""
    fps, nodes = grouped(docs)
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least")).join(nodes, "fp")
    # written, so that a component of very many fingerprints meets its name in a join that adaptive execution can split
    names = materialize(least.groupBy("label").agg(F.min("least").alias("component_id")), "simhash-names", nodes.count())
    named = nodes.join(names, "label").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_representatives(docs: DataFrame) -> DataFrame:
    """One document of each group: the one of smallest doc_id (rows without one come last), repeated rows of it once."""
    fps, nodes = grouped(docs)
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("key").alias("key"))
    first = fps.groupBy("fp").agg(F.min(order).alias("first")).join(nodes, "fp").groupBy("label").agg(F.min("first").alias("first"))
    # one set of join keys for repeated rows and for the choice of documents: texts are shuffled once, a repeated row once a task.
    # The caller's row travels as one struct, so that no name of its columns can clash.
    keys = ["none", "id", "key"]
    kept = first.select("first.none", F.coalesce("first.id", F.lit(0)).alias("id"), F.col("first.key").alias("key"))
    number = docs["doc_id"].cast("long")
    keyed = docs.select(F.struct("*").alias("row"), number.isNull().alias("none"), F.coalesce(number, F.lit(0)).alias("id"), text_key(docs).alias("key"))
    return keyed.dropDuplicates(keys).join(kept, keys, "left_semi").select("row.*")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


QUERIES = {"op4_simhash": op4_simhash}
ORACLES: dict[str, str] = {}
