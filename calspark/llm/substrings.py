"""Substring deduplication by difference-cover anchors.

A window is WINDOW consecutive words of one document; every word that lies in a window
whose words also start anywhere else goes. Windows are judged on the input.

Anchors. COVERS holds, for a period, a set of residues such that for any two positions
there is a shift below the period that takes both of them to residues of the set. Only the
runs of ``window - period + 1`` words at such positions are hashed: two equal windows,
wherever they start, hold an equal anchor at the same shift. Anchors that occur
twice are extended: the windows that hold one are hashed whole, with 96 bits, and
those that occur twice are the ones sought. Of 35 words, 5 of 21 positions are anchors of 15
words.

Meeting. Both steps ask which of a great many hashes occur twice. A task first looks among
about HELD words: what it sees twice there is settled at once, and one mark of the hash is
sent for all of them, so that a hash gives at most one row for each such part of
the corpus however often it occurs, and no key is hot. What is settled travels in the
same exchange under a key of its own document, as one row. Counts over the exchanged
key say which of the others met. No pair is ever formed.

Texts are numbered and shuffled once by that number; both steps and the removal read that one
exchange.

Defined cases. Null, empty and blank texts have no words. Documents shorter than a
window keep all words. Repeated rows are documents of their own, so their windows repeat. Null ids
stay. Very long texts are taken whole, one at a time beyond HELD words. Extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from calspark.llm.storage import documents, partitions

WINDOW = 35
#: Perfect difference sets, by period. Every residue but zero is a difference of two members.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18), 57: (0, 1, 3, 13, 32, 36, 43, 52)}
#: Words that a part holds, and words whose hashes a worker remembers.
HELD, KNOWN = 1_500_000, 1_000_000
#: Odd bases of the two rolling hashes.
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def cover_for(window: int) -> tuple[int, tuple[int, ...]]:
    """The longest period whose anchors are still at least two fifths of a window, and its residues."""
    period = max(p for p in COVERS if window - p + 1 >= max(1, 0.4 * window))
    return period, COVERS[period]


class _Known(dict):
    """Word to 64-bit hash, kept small."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= KNOWN:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word)
        return out


def word_hashes(words: list[bytes], known: _Known) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


def run_hashes(hashes: np.ndarray, starts: np.ndarray, length: int, base: int) -> np.ndarray:
    """64-bit hashes of the runs of ``length`` words at ``starts``: differences of prefix sums, brought to one power."""
    n = len(hashes)
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * _powers(base, n), dtype=np.uint64)))
        back = _powers(pow(base, -1, 1 << 64), n)
        return _mixed((sums[starts + length] - sums[starts]) * back[starts])


def _twice(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(which rows hold a key that another row holds too, the first row of every such key)."""
    order = np.lexsort(keys[::-1])
    same = np.ones(max(0, len(order) - 1), bool)
    for k in keys:
        same &= k[order[1:]] == k[order[:-1]]
    again = np.zeros(len(order), bool)
    again[order[1:]] |= same
    again[order[:-1]] |= same
    new = np.concatenate(([True], ~same)) if len(order) else np.zeros(0, bool)
    return again, order[new & again[order]]


def _sent(numbers: np.ndarray, places: np.ndarray, keys: list[np.ndarray]) -> pa.RecordBatch:
    """Rows (key.., place, number, settled) of a part: single keys, marks of repeated ones (number null), settled places by document.

    What a row shares with the one before it stands together at its end, which the exchange compresses.
    """
    again, marks = _twice(keys)
    single, settled = np.flatnonzero(~again), np.flatnonzero(again)
    settled = settled[np.argsort(numbers[settled], kind="stable")]
    docs, at = np.unique(numbers[settled], return_index=True)
    lists = np.split(places[settled].astype(np.int32), at[1:]) if len(docs) else []
    rows = np.concatenate((single, marks))
    spread = _mixed(docs.astype(np.uint64) + np.uint64(1)).view(np.int64)  # a key of each document's own
    null = np.concatenate((np.zeros(len(single), bool), np.ones(len(marks), bool), np.zeros(len(docs), bool)))
    columns = [pa.array(np.concatenate((k[rows], spread.astype(k.dtype)))) for k in keys]
    columns.append(pa.array(np.concatenate((places[rows], np.zeros(len(docs), np.int64))), pa.int32()))
    columns.append(pa.array(np.concatenate((numbers[rows], docs)), pa.int64(), mask=null))
    columns.append(pa.array([None] * len(rows) + [x.tobytes() for x in lists], pa.binary()))
    return pa.RecordBatch.from_arrays(columns, [*(f"k{n}" for n in range(len(keys))), "place", "number", "settled"])


def _parts(batches: Iterator[pa.RecordBatch], places_of, keys_of) -> Iterator[pa.RecordBatch]:
    """Gathers the places and keys of documents to parts of about HELD words."""
    known, held, size = _Known(), [], 0

    def flush() -> pa.RecordBatch:
        numbers, places, *keys = (np.concatenate(c) for c in zip(*held))
        return _sent(numbers, places, keys)

    for batch in batches:
        for n in range(batch.num_rows):
            words = (batch.column(1)[n].as_py() or "").encode().split()  # bytes: ASCII white space only
            places = places_of(len(words), batch, n)
            if not len(places):
                continue
            held.append((np.full(len(places), batch.column(0)[n].as_py()), places, *keys_of(word_hashes(words, known), places)))
            size += len(words)
            if size >= HELD:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def _anchors(window: int):
    period, residues = cover_for(window)
    length, wanted = window - period + 1, np.isin(np.arange(period), residues)

    def places_of(n: int, batch: pa.RecordBatch, row: int) -> np.ndarray:
        return np.flatnonzero(np.resize(wanted, n - length + 1)) if n >= window else np.empty(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _parts(batches, places_of, lambda hashes, places: [run_hashes(hashes, places, length, BASES[0]).view(np.int64)])

    return run


def _places(lists: list[int] | None, packed: list[bytes] | None) -> np.ndarray:
    return np.concatenate([np.array(lists or [], np.int64), *(np.frombuffer(b, np.int32).astype(np.int64) for b in packed or [])])


def _windows(window: int):
    period, _ = cover_for(window)

    def places_of(n: int, batch: pa.RecordBatch, row: int) -> np.ndarray:
        """The windows that hold one of the row's anchors."""
        anchors = _places(batch.column(3)[row].as_py(), batch.column(4)[row].as_py())
        turns = np.zeros(n + 2, np.int32)
        np.add.at(turns, np.maximum(anchors - period + 1, 0), 1)
        np.add.at(turns, anchors + 1, -1)
        return np.flatnonzero(np.cumsum(turns)[: n - window + 1] > 0)

    def keys_of(hashes: np.ndarray, places: np.ndarray) -> list[np.ndarray]:
        one, two = (run_hashes(hashes, places, window, base) for base in BASES)
        return [one.view(np.int64), (two >> np.uint64(32)).astype(np.uint32).view(np.int32)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _parts(batches, places_of, keys_of)

    return run


def _kept(window: int, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals, removed, kept = [], [], []
            for n in range(batch.num_rows):
                words = (batch.column(1)[n].as_py() or "").encode().split()
                starts = _places(batch.column(3)[n].as_py(), batch.column(4)[n].as_py())
                turns = np.zeros(len(words) + 1, np.int32)
                np.add.at(turns, starts, 1)
                np.add.at(turns, starts + window, -1)
                gone = np.cumsum(turns)[:-1] > 0
                left = words if not gone.any() else [words[k] for k in np.flatnonzero(~gone)]
                text = b" ".join(left)
                totals.append(len(words))
                removed.append(int(gone.sum()))
                kept.append(hashlib.sha256(text).hexdigest() if digest else text.decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["number", "doc_id", "n_words", "n_removed", "kept"])

    return run


def _met(sent: DataFrame, keys: list[str]) -> DataFrame:
    """(number, places, packed): the places of every document whose keys occur more than once."""
    here = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    found = sent.withColumn("n", here).where("number is not null and (n > 1 or settled is not null)")
    return found.groupBy("number").agg(
        F.collect_list(F.when(F.col("settled").isNull(), F.col("place"))).alias("places"), F.collect_list("settled").alias("packed")
    )


def repeated_windows(texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """(number, places, packed) of the documents (number, text, doc_id) that hold a window that starts anywhere else: the starts of these windows.

    All columns of ``texts`` go through every step, so that the steps and the caller share its exchange.
    """
    anchors = _met(texts.mapInArrow(_anchors(window), "k0 long, place int, number long, settled binary"), ["k0"])
    near = texts.join(anchors, "number").select("number", "text", "doc_id", "places", "packed")
    return _met(near.mapInArrow(_windows(window), "k0 long, k1 int, place int, number long, settled binary"), ["k0", "k1"])


def deduplicated(docs: DataFrame, window: int = WINDOW, digest: bool = False) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept (the words that stay, joined by one space, or their SHA-256)."""
    texts = docs.select(F.monotonically_increasing_id().alias("number"), docs["text"].cast("string").alias("text"), docs["doc_id"].cast("long").alias("doc_id"))
    texts = texts.repartition(partitions(docs.sparkSession), "number")
    found = texts.join(repeated_windows(texts, window), "number", "left").select("number", "text", "doc_id", "places", "packed")
    return found.mapInArrow(_kept(window, digest), "number long, doc_id long, n_words long, n_removed long, kept string").drop("number")


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(documents(spark, sf_dir), digest=True).withColumnRenamed("kept", "kept_sha256")


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), starts AS (
  SELECT n, words, unnest(range(1, len(words) - 33)) AS s FROM d WHERE len(words) >= 35
), hashed AS (
  SELECT n, s, sha256(array_to_string(words[s : s + 34], ' ')) AS h FROM starts
), again AS (
  SELECT n, s FROM (SELECT n, s, count(*) OVER (PARTITION BY h) AS c FROM hashed) WHERE c > 1
), gone AS (
  SELECT DISTINCT n, s + k AS place FROM again, range(35) AS r(k)
), w AS (
  SELECT n, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM d
), kept AS (
  SELECT w.n, count(gone.place) AS n_removed, string_agg(word, ' ' ORDER BY w.place) FILTER (WHERE gone.place IS NULL) AS text
  FROM w LEFT JOIN gone ON gone.n = w.n AND gone.place = w.place GROUP BY w.n
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.n = d.n
"""

QUERIES = {"op12_substring_dedup": op12_substring_dedup}
ORACLES = {"op12_substring_dedup": ORACLE}
