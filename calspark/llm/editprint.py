"""Document fingerprints by a randomised edit embedding.

A walker reads a text with shared random bits R[step, character]: at every step it
emits the character under it and moves on when the bit is one. Two walkers over
texts of small edit distance fall into step again soon after every edit, so their
emitted strings differ in few places: edit distance becomes Hamming distance. Only
the number of steps spent on each character matters, so one table of waiting times
replaces the step-by-step walk, and all texts of a chunk walk together.

The fingerprint samples SLOTS places of the emitted string. Slot k takes the step
of smallest shared priority among the steps the walk took, so that texts of
different length mostly choose the same steps, and keeps four bits of a hash of
(step, character): one hex digit. The likeness of two fingerprints is the share of
equal digits.

Banding. BANDS samples of BAND digits each are a fingerprint's index keys. Documents
that share a key are candidates, likeness of LIKENESS or more verifies them, and the
classes are the connected components: of equal fingerprints one node is left, in a
key's bucket every node first meets the smallest one, which gives a row a member, what
that links is contracted, and only nodes of different components meet afterwards.
A pair of likeness 0.8 shares a key with probability 0.97, one of 0.9 with 0.9998.

Edited texts need the next document. Texts are dealt to ranges of about RANGE_BYTES
between keys (doc_id, hash of the text) drawn from the rows with chances in proportion
to their bytes, a range a task, sorted there and read as a stream; a drawn row is the
first of its range and is also sent to the range before. Texts travel compressed,
with their fingerprints, once. Repeated rows of a task travel as one with a count, so
that a row that a third of the table repeats does not fill a range.

Defined cases. Null text: empty. Empty text: SLOTS zeros. Null doc_id sorts first,
equal doc_ids by a hash of the text. With one row the next document is that row itself.
Very long texts are walked whole; CHUNK_CHARS characters, or one text, walk at a time. An
empty table gives an empty result. Extra columns, whatever their names, are ignored.
The class of a document without doc_id has the name of its others, if they have one.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calspark.llm.components import connected_components
from calspark.llm.storage import documents, materialize, partitions

SLOTS, BANDS, BAND = 128, 16, 8
LIKENESS = 0.8
#: Bytes of text of a range, the most ranges, and the rows drawn for each to find where they begin.
RANGE_BYTES, MOST_RANGES, DRAWN = 16 << 20, 20_000, 32
#: Rows that a task remembers to know repeated ones, and copies that a row of the result stands for at most before it is spread.
SEEN, SPREAD = 100_000, 1_000
#: Steps after which the shared random bits repeat, classes of characters, seed.
PERIOD, CLASSES, SEED = 4096, 256, 20_240_901
#: Characters that walk together, and that a task gathers to walk texts of like length together: bound its memory.
CHUNK_CHARS, HELD_CHARS = 3_000_000, 9_000_000
#: Texts that still walk together; fewer walk one by one, which costs less for each character of them.
FEW = 64

SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, bands_edited int, bands_next int"
)
DEALT = "bucket int, peek boolean, known int, id long, h long, copies long, fingerprint string, body binary"


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, vectorised."""
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _waits() -> np.ndarray:
    """[step * CLASSES + class]: steps until the shared bit of that class is one."""
    bits = (_mix(np.arange(PERIOD * CLASSES, dtype=np.uint64) + np.uint64(SEED << 20)) >> np.uint64(63)).astype(bool).reshape(PERIOD, CLASSES)
    waits = np.full((2 * PERIOD + 1, CLASSES), PERIOD, np.int32)
    for step in range(2 * PERIOD - 1, -1, -1):
        waits[step] = np.where(bits[step % PERIOD], 1, np.minimum(waits[step + 1] + 1, PERIOD))
    return waits[:PERIOD].reshape(-1).copy()


@cache
def _waits_listed() -> list[int]:
    return _waits().tolist()


@cache
def _records() -> np.ndarray:
    """[slot, r]: the steps at which the slot's smallest priority so far falls, increasing; the last are out of reach."""
    out = np.full((SLOTS, 64), np.iinfo(np.int64).max, np.int64)
    for slot in range(SLOTS):
        uniform = (_mix(np.arange(128, dtype=np.uint64) + np.uint64((SEED + 7 * slot + 1) << 24)) >> np.uint64(11)).astype(float) / 2.0**53
        step, least = 0, uniform[0] or 0.5
        for r in range(63):
            out[slot, r] = step
            step += 1 + int(np.log(max(uniform[2 * r + 1], 1e-300)) / np.log1p(-min(least, 1 - 1e-12))) if least > 1e-15 else 1 << 50
            least *= uniform[2 * r + 2]
            if step > 1 << 40:
                break
    return out


def fingerprint_all(texts: list[str]) -> list[str]:
    """Fingerprints of many texts; equal texts have equal fingerprints. Texts of like length walk together, as long as the longest of them."""
    out, part, size = [""] * len(texts), [], 0
    for n in sorted(range(len(texts)), key=lambda n: len(texts[n])):
        if part and size + len(texts[n]) > CHUNK_CHARS:
            for k, mark in zip(part, _walked([texts[k] for k in part])):
                out[k] = mark
            part, size = [], 0
        part.append(n)
        size += len(texts[n])
    for k, mark in zip(part, _walked([texts[k] for k in part]) if part else ()):
        out[k] = mark
    return out


def _walked(texts: list[str]) -> list[str]:
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    order = np.argsort(-lengths, kind="stable")
    longest = int(lengths[order[0]])
    active = len(texts) - np.searchsorted(np.sort(lengths), np.arange(longest), side="right")  # texts longer than i
    starts = np.concatenate(([0], np.cumsum(active)))
    classes = np.empty(int(starts[-1]), np.uint8)
    for rank, n in enumerate(order):
        points = np.frombuffer(texts[n].encode("utf-32-le"), np.uint32)
        classes[starts[: len(points)] + rank] = (points * np.uint32(2654435761)) >> np.uint32(24)
    waits, leave = _waits(), np.empty(int(starts[-1]), np.int32 if longest < 1 << 28 else np.int64)
    at = np.zeros(len(texts), leave.dtype)
    shift, mask = CLASSES.bit_length() - 1, PERIOD - 1
    together = int((active >= FEW).sum())
    bounds = starts[: together + 1].tolist()
    for a, b in zip(bounds, bounds[1:]):
        now = at[: b - a]
        index = now & mask
        index <<= shift
        index |= classes[a:b]
        now += waits[index]
        leave[a:b] = now
    if together < longest:  # what the few longest have left, each by itself
        table = _waits_listed()
        for rank in range(int(active[together])):
            places = starts[together : int(lengths[order[rank]])] + rank
            steps = accumulate(classes[places].tobytes(), lambda now, c: now + table[(now & mask) << shift | c], initial=int(at[rank]))
            next(steps)
            leave[places] = np.fromiter(steps, leave.dtype, len(places))
    records, out = _records(), [""] * len(texts)
    digits = np.frombuffer(b"0123456789abcdef", np.uint8)
    for rank, n in enumerate(order):
        length = int(lengths[n])
        if not length:
            out[n] = "0" * SLOTS
            continue
        places = starts[:length] + rank
        steps = records[np.arange(SLOTS), (records < int(leave[places[-1]])).sum(1) - 1]
        read = classes[places[np.searchsorted(leave[places], steps, side="right")]]
        out[n] = digits[(_mix(steps.astype(np.uint64) * np.uint64(CLASSES) + read) >> np.uint64(60)).astype(np.int64)].tobytes().decode()
    return out


def likeness(a: str, b: str) -> float:
    x, y = np.frombuffer(a.encode(), np.uint8), np.frombuffer(b.encode(), np.uint8)
    return float((x == y).mean())


@cache
def band_slots() -> np.ndarray:
    """[band, k]: the slots of each band, drawn by shared priorities."""
    drawn = _mix(np.arange(BANDS * SLOTS, dtype=np.uint64) + np.uint64((SEED + 3) << 20)).reshape(BANDS, SLOTS)
    return np.sort(np.argsort(drawn, axis=1)[:, :BAND], axis=1)


def shared_bands(a: str, b: str) -> int:
    same = np.frombuffer(a.encode(), np.uint8) == np.frombuffer(b.encode(), np.uint8)
    return int(same[band_slots()].all(1).sum())


def edited(text: str, following: str) -> str:
    """The last quarter of the text replaced by as many first characters of the next document."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def _deal(cuts: list[tuple], least: tuple):
    """Rows (known, id, h, text) to rows of DEALT; what a task has seen before is only counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        names = [f.split()[0] for f in DEALT.split(", ")]
        kinds = (pa.int32(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        seen: dict[tuple, int] = {}

        def rows_of(key: tuple, copies: int, mark: str | None, body: bytes | None) -> list[tuple]:
            bucket = bisect_right(cuts, key)
            out = [(bucket, False, *key, copies, mark, body)]
            if body is not None and (key == least or bucket and key == cuts[bucket - 1]):
                out.append((bucket - 1 if bucket else len(cuts), True, *key, 1, mark, body))
            return out

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        def counted() -> list[tuple]:
            out = [x for key, n in seen.items() if n for x in rows_of(key, n, None, None)]
            seen.clear()
            return out

        def flush(fresh: list[tuple[tuple, str]]) -> pa.RecordBatch:
            marks = fingerprint_all([t for _, t in fresh])
            return batch_of([x for (key, t), mark in zip(fresh, marks) for x in rows_of(key, 1, mark, pack(t.encode()))])

        fresh, size = [], 0
        for batch in batches:
            for known, doc, h, text in zip(*batch.columns):
                key = (known.as_py(), doc.as_py(), h.as_py())
                if key in seen:
                    seen[key] += 1
                    continue
                seen[key] = 0
                fresh.append((key, text.as_py()))
                size += len(fresh[-1][1])
                if size >= HELD_CHARS:
                    yield flush(fresh)
                    fresh, size = [], 0
            if len(seen) > SEEN and (rest := counted()):
                yield batch_of(rest)
        if fresh:
            yield flush(fresh)
        if rest := counted():
            yield batch_of(rest)

    return run


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of DEALT, sorted, to rows of SCHEMA with copies; one document is held back for its successor."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    # (doc, text, fingerprint, what follows, its fingerprint, copies)
    todo: list[tuple] = []
    size = 0

    def flush() -> pa.RecordBatch:
        changed = [edited(t, f) for _, t, _, f, _, _ in todo]
        new = fingerprint_all(changed)
        columns = [
            [x[0] for x in todo], [len(x[1]) for x in todo], [hashlib.sha256(t.encode()).hexdigest() for t in changed], [x[2] for x in todo], new,
            [likeness(x[2], p) for x, p in zip(todo, new)], [likeness(x[2], x[4]) for x in todo], [shared_bands(x[2], p) for x, p in zip(todo, new)], [shared_bands(x[2], x[4]) for x in todo], [x[5] for x in todo],
        ]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [*(f.split()[0] for f in SCHEMA.split(", ")), "copies"])

    def pairs(now: list, following: list | None) -> list[tuple]:
        """What a finished group of equal rows gives: all but the last are followed by their own text."""
        bucket, peek, known, doc, _, copies, mark, text = now
        if peek or following is None:
            return []
        out = [(doc if known else None, text, mark, text, mark, n) for n in [SPREAD] * ((copies - 1) // SPREAD) + [(copies - 1) % SPREAD] if n]
        return [*out, (doc if known else None, text, mark, following[7][: len(text) // 4], following[6], 1)]

    now: list | None = None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if now is not None and row[:5] == tuple(now[:5]):
                now[5] += row[5]
                continue
            fresh = [*row[:7], unpack(row[7]).decode()]
            if now is not None:
                found = pairs(now, fresh if fresh[0] == now[0] else None)
                todo += found
                size += len(found) * len(now[7])
            now = fresh
            if size >= HELD_CHARS:
                yield flush()
                todo, size = [], 0
    if todo:
        yield flush()


def _cuts(keys: DataFrame) -> tuple[list[tuple], tuple] | None:
    """(keys at which ranges begin, least key) of rows (known, id, h, size). At most about MOST_RANGES x DRAWN drawn keys reach the driver."""
    x = keys.agg(F.sum("size").alias("bytes"), F.min(F.struct("known", "id", "h")).alias("least")).first()
    if x["bytes"] is None:
        return None
    ranges = min(MOST_RANGES, math.ceil(x["bytes"] / RANGE_BYTES))
    step = x["bytes"] / (ranges * DRAWN)
    chance = F.pmod(F.xxhash64("known", "id", "h", F.lit(SEED)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = keys.withColumn("n", F.floor(F.col("size") / F.lit(step) + chance)).where("n > 0")
    weights = sorted((tuple(r["k"]), r["n"]) for r in drawn.groupBy(F.struct("known", "id", "h").alias("k")).agg(F.sum("n").alias("n")).collect())
    cuts, passed, least = [], 0, tuple(x["least"])
    for key, n in weights:
        if passed // DRAWN < (passed + n) // DRAWN and key != least:
            cuts.append(key)
        passed += n
    return cuts, least


def prints(docs: DataFrame) -> DataFrame | None:
    """Rows of SCHEMA with copies, written; None for an empty table."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    doc = docs["doc_id"].cast("long")
    rows = docs.select(doc.isNotNull().cast("int").alias("known"), F.coalesce(doc, F.lit(0)).alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    keys = materialize(rows.select("known", "id", "h", (F.octet_length("text") + 64).cast("long").alias("size")), "editprint-keys")
    found = _cuts(keys)
    if found is None:
        return None
    cuts, least = found
    dealt = rows.mapInArrow(_deal(cuts, least), DEALT)
    ordered = dealt.repartitionById(len(cuts) + 1, "bucket").sortWithinPartitions("bucket", "peek", "known", "id", "h", F.col("body").isNull())
    return materialize(ordered.mapInArrow(_stream, SCHEMA + ", copies long"), "editprint")


def spread(found: DataFrame) -> DataFrame:
    """Rows of SCHEMA from those with copies: what stands for many rows is dealt out before it is repeated."""
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    many = found.where("copies > 1").repartition(partitions(found.sparkSession)).withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return found.where("copies = 1").select(*names).unionByName(many.select(*names))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Every document's fingerprint beside that of its edited text and its likeness to both neighbours (SCHEMA)."""
    found = prints(docs)
    return spread(found) if found is not None else docs.sparkSession.createDataFrame([], SCHEMA)


def _simple(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, size, start = [], 0, 0
        for n, text in enumerate(batch.column(1)):
            rows.append(text.as_py() or "")
            size += len(rows[-1])
            if size >= HELD_CHARS or n == batch.num_rows - 1:
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(rows)), pa.array(fingerprint_all(rows), pa.string())], ["doc_id", "fingerprint"])
                rows, size, start = [], 0, n + 1


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every row."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_simple, "doc_id long, fingerprint string")


def _digit(slot: int):
    return F.shiftrightunsigned(F.col("bits")[slot // 16], 60 - 4 * (slot % 16)).bitwiseAND(F.lit(15))


def _keys():
    """A key for each band: its number and the digits of its slots."""
    out = []
    for band, slots in enumerate(band_slots().tolist()):
        key = F.lit(band).cast("long")
        for slot in slots:
            key = F.shiftleft(key, 4).bitwiseOR(_digit(slot))
        out.append(key)
    return F.array(*out)


def _like(a: str, b: str):
    """The share of equal digits of two arrays of 8 longs: the digits that do not differ in any bit."""
    differing = F.lit(0)
    for k in range(SLOTS // 16):
        x = F.col(a)[k].bitwiseXOR(F.col(b)[k])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x1111111111111111))
        differing = differing + F.bit_count(x)
    return (F.lit(SLOTS) - differing) / F.lit(float(SLOTS))


def linked_classes(found: DataFrame, least: float = LIKENESS) -> DataFrame:
    """(fingerprint, class_id) of (doc_id, fingerprint): the class is named by its smallest doc_id. A node is a fingerprint, by a number of its own."""
    bits = F.array(*[F.conv(F.substring("fingerprint", 16 * k + 1, 16), 16, -10).cast("long") for k in range(SLOTS // 16)])
    named = materialize(found.groupBy("fingerprint").agg(F.min("doc_id").alias("least")).withColumn("node", F.monotonically_increasing_id()), "editprint-nodes")
    count = named.count()
    nodes = named.select("node", bits.alias("bits"))
    index = nodes.select("node", F.explode(_keys()).alias("key"))
    # partial sums and a join that can be split, not a window: a key may be that of a third of all rows
    pivots = index.groupBy("key").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("members")).where("members > 1").select("key", "pivot")
    index = materialize(index.join(materialize(pivots, "editprint-pivots", BANDS * count // 2), "key"), "editprint-bands")
    members = index.count()
    a, b = nodes.select(F.col("node").alias("a"), F.col("bits").alias("a_bits")), nodes.select(F.col("node").alias("b"), F.col("bits").alias("b_bits"))
    like = _like("a_bits", "b_bits") >= F.lit(least)
    met = index.where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    first = connected_components(met.join(a, "a").join(b, "b").where(like).select("a", "b"), members)
    labelled = index.select("key", "node").join(first, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    labelled = materialize(labelled, "editprint-labelled", members)
    mixed = materialize(labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key"), "editprint-mixed", members)
    open_rows = labelled.join(mixed, "key", "left_semi").join(nodes, "node")
    x, y = open_rows.select("key", F.col("label").alias("a"), F.col("bits").alias("a_bits")), open_rows.select(F.col("key").alias("key2"), F.col("label").alias("b"), F.col("bits").alias("b_bits"))
    second = connected_components(x.join(y, (F.col("key") == F.col("key2")) & (F.col("a") < F.col("b")) & like).select("a", "b").distinct())
    labels = named.select("fingerprint", "least", "node").join(first, "node", "left").select("fingerprint", "least", F.coalesce("label", "node").alias("label"))
    labels = labels.join(second.withColumnRenamed("label", "outer"), F.col("label") == F.col("node"), "left").select("fingerprint", "least", F.coalesce("outer", "label").alias("label"))
    labels = materialize(labels, "editprint-labels", count)
    # written, so that a class of very many fingerprints meets its name in a join that adaptive execution can split
    names = materialize(labels.groupBy("label").agg(F.min("least").alias("class_id")), "editprint-names", count)
    return labels.join(names, "label").select("fingerprint", "class_id")


def op8_edit_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = prints(documents(spark, sf_dir))
    if found is None:
        return spark.createDataFrame([], SCHEMA + ", class_id long")
    classes = materialize(linked_classes(found.select("doc_id", "fingerprint")), "editprint-classes", found.count())
    return spread(found).join(classes, "fingerprint").select(*[f.split()[0] for f in SCHEMA.split(", ")], "class_id")


QUERIES = {"op8_edit_fingerprint": op8_edit_fingerprint}
ORACLES: dict[str, str] = {}
