"""Benchmark decontamination: rare word seeds, then Smith-Waterman alignment.

1. An alignment of SCORE or more matches at least ``need`` of an item's words. So of the
   rarest (words - need + k) places of the item it matches k or more, within a bounded
   stretch of the text. These places' words are the item's seeds; every stretch of a
   text with k of them gives a window that holds any such alignment whole. Rarity (by
   the benchmark's items) and k only order the work: no alignment is missed.
2. Windows that share too few words with their item to reach SCORE are dropped by that
   bound. Windows of the same item and words are aligned once and the score is joined
   back, so a passage repeated in many documents costs one alignment.
3. Windows are aligned with their items by words (local alignment, linear gaps). The
   score is divided by that of a perfect copy; at SCORE or more the document leaks.

The benchmark is read in blocks of at most BLOCK_BYTES of text, each carried to the
executors whole; every block meets all documents, so a large benchmark costs more
scans, never memory or pairs. Windows are at most linear in the text and the item.

Defined cases. Null or empty texts and items without words match nothing. Repeated
items of one text are scanned once and reported under each item_id. Repeated rows
give one result row for each doc_id and item. Null ids are reported as null. Words are
maximal runs of letters and digits, lower-cased. Very long texts are read whole; a
worker holds the words of SCAN texts. Extra columns, whatever their names, are ignored,
and kept where documents are filtered. Empty tables give an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calspark.llm.storage import documents, materialize

#: Runs of words counted in n_seeds.
SEED_WORDS = 5
#: A stretch needs a seed for every SEED_EVERY words of the item.
SEED_EVERY = 6
MATCH, MISMATCH, GAP = 2, -1, -1
SCORE = 0.5
BLOCK_BYTES = 16 << 20
#: Up to this many leaking texts are taken out by a broadcast of their keys, more by a shuffle of all texts.
BROADCAST_KEYS = 1_000_000
#: Texts scanned and windows aligned at a time.
SCAN = 256
ALIGN = 256

WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def grams_of(words: list[str]) -> set[str]:
    """Every run of SEED_WORDS words, or all words if there are fewer."""
    size = min(SEED_WORDS, len(words))
    return {" ".join(words[i : i + size]) for i in range(len(words) - size + 1)} if size else set()


class Seeds:
    """The seeds of a block of items, for alignments that score ``least`` or more."""

    def __init__(self, items: list[list[str]], least: float):
        spread = Counter(w for words in items for w in set(words))
        self.items = items
        self.counts = [Counter(words) for words in items]
        size = [len(words) for words in items]
        # score = (MATCH * matches - other steps) / (MATCH * size), rounded to 6 digits
        self.need = [min(n, max(1, math.ceil((least - 1e-6) * n))) for n in size]
        self.k = np.array([max(1, min(need, n // SEED_EVERY)) for need, n in zip(self.need, size)], np.int64)
        # matches + other steps, where other steps <= MATCH * (matches - least * size) and matches <= size
        self.span = np.array([max(1, math.ceil(n * (1 + MATCH * (1 - max(0.0, least - 1e-6))))) for n in size], np.int64)
        places: dict[str, list[int]] = {}
        for n, words in enumerate(items):
            ranked = sorted(range(size[n]), key=lambda i: (spread[words[i]], -len(words[i]), words[i]))
            for w in {words[i] for i in ranked[: size[n] - self.need[n] + int(self.k[n])]}:
                places.setdefault(w, []).append(n)
        self.codes = {w: c for c, w in enumerate(places)}
        self.first = np.cumsum([0] + [len(p) for p in places.values()])
        self.posts = np.array([n for p in places.values() for n in p], np.int64)

    def windows(self, texts: list[list[str]]) -> Iterator[tuple[int, int, int, list[str]]]:
        """(text, item, first word, window) of every stretch that may hold an alignment. Windows are at most two spans long."""
        get, at, codes, starts, gap = self.codes.get, [], [], [], int(self.span.max(initial=1)) + 1
        total = 0
        for words in texts:
            starts.append(total)
            for i, w in enumerate(words):
                if (c := get(w)) is not None:
                    at.append(total + i)
                    codes.append(c)
            total += len(words) + gap
        if not at:
            return
        code = np.array(codes, np.int64)
        many = self.first[code + 1] - self.first[code]
        ends = np.cumsum(many)
        item = self.posts[np.repeat(self.first[code] - ends + many, many) + np.arange(ends[-1])]
        place = np.repeat(np.array(at, np.int64), many)
        order = np.argsort(item * total + place)
        item, place = item[order], place[order]
        last = np.arange(len(item)) + self.k[item] - 1
        inside = last < len(item)
        later = np.minimum(last, len(item) - 1)
        hit = np.flatnonzero(inside & (item[later] == item) & (place[later] - place < self.span[item]))
        if not len(hit):
            return
        n, low, high = item[hit], place[later[hit]] - self.span[item[hit]] + 1, place[hit] + self.span[item[hit]]
        text = np.searchsorted(np.array(starts), place[hit], "right") - 1
        fresh = np.ones(len(hit), bool)
        fresh[1:] = (n[1:] != n[:-1]) | (text[1:] != text[:-1]) | (low[1:] > high[:-1])
        head = np.flatnonzero(fresh)
        tail = np.append(head[1:], len(hit)) - 1
        for t, k, lo, hi in zip(text[head].tolist(), n[head].tolist(), low[head].tolist(), high[tail].tolist()):
            words, span, counts, need = texts[t], int(self.span[k]), self.counts[k], self.need[k]
            lo, hi = max(0, lo - starts[t]), min(len(words), hi - starts[t])
            for start in range(lo, max(lo + 1, hi - span), span):  # every stretch of one span lies in one of them
                window = words[start : min(hi, start + 2 * span)]
                if self._shared(window, counts) >= need:
                    yield t, k, start, window

    @staticmethod
    def _shared(window: list[str], counts: Counter) -> int:
        """Words in common, each as often as it is in both: no alignment has more matches."""
        mine = Counter([w for w in window if w in counts])
        return sum(min(c, counts[w]) for w, c in mine.items())


def align(pairs: list[tuple[list[str], list[str]]]) -> list[tuple[float, int]]:
    """(score as a share of a perfect copy, end in the window) of many (item, window) pairs."""
    out: list[tuple[float, int]] = [(0.0, 0)] * len(pairs)
    order = sorted(range(len(pairs)), key=lambda n: (len(pairs[n][0]), len(pairs[n][1])))
    for at in range(0, len(order), ALIGN):
        part = order[at : at + ALIGN]
        codes: dict[str, int] = {}
        rows, width = max(len(pairs[n][0]) for n in part), max(len(pairs[n][1]) for n in part)
        item, window = np.full((len(part), rows), -1, np.int32), np.full((len(part), width), -2, np.int32)
        for k, n in enumerate(part):
            a, b = pairs[n]
            item[k, : len(a)] = [codes.setdefault(w, len(codes)) for w in a]
            window[k, : len(b)] = [codes.setdefault(w, len(codes)) for w in b]
        ramp = -GAP * np.arange(width + 1, dtype=np.int32)
        h = np.zeros((len(part), width + 1), np.int32)
        best, end = np.zeros(len(part), np.int32), np.zeros(len(part), np.int64)
        for i in range(rows):
            new = np.zeros_like(h)
            new[:, 1:] = np.maximum(h[:, :-1] + np.where(window == item[:, i : i + 1], MATCH, MISMATCH), h[:, 1:] + GAP)
            np.maximum(new, 0, out=new)
            h = np.maximum.accumulate(new + ramp, axis=1) - ramp
            h[item[:, i] < 0] = 0
            top = h.argmax(1)
            value = h[np.arange(len(part)), top]
            better = value > best
            best, end = np.where(better, value, best), np.where(better, top, end)
        for k, n in enumerate(part):
            if pairs[n][0]:
                out[n] = (float(best[k]) / (MATCH * len(pairs[n][0])), int(end[k]))
    return out


#: The block of texts and the seeds that a Python worker made last: once a worker and block, not once a task.
_MADE: list = []


def _seeds_of(texts: list[str], least: float) -> Seeds:
    if not _MADE or _MADE[0] is not texts or _MADE[1] != least:
        _MADE[:] = texts, least, Seeds([words_of(t) for t in texts], least)
    return _MADE[2]


def _find(shared, least):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = _seeds_of(shared.value, least)
        for batch in batches:
            docs, keys = batch.column(0), batch.column(1)
            for at in range(0, batch.num_rows, SCAN):
                out: list[list] = [[], [], [], [], []]
                texts = [words_of(t) for t in batch.column(2).slice(at, SCAN).to_pylist()]
                for row, item, start, window in seeds.windows(texts):
                    for column, value in zip(out, (docs[at + row].as_py(), keys[at + row].as_py(), item, start, " ".join(window))):
                        column.append(value)
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["doc_id", "text_key", "item", "start", "window"])

    return run


def _score(shared, least):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = [words_of(t) for t in shared.value]
        for batch in batches:
            pairs = [(items[i.as_py()], (w.as_py() or "").split(" ")) for i, w in zip(*batch.columns)]
            found = align(pairs)
            ends, scores = pa.array([e for _, e in found], pa.int64()), pa.array([round(s, 6) for s, _ in found], pa.float64())
            seeds = pa.array([len(grams_of(a) & grams_of(b)) if s >= least else 0 for (a, b), (s, _) in zip(pairs, found)], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, ends, scores, seeds], ["item", "window", "end", "score", "n_seeds"])

    return run


def _blocks(items: DataFrame) -> Iterator[tuple[list[str], DataFrame]]:
    """Blocks of (item_id, item_text) by the texts' hash: (distinct texts, of a bounded size; all items of the block)."""
    texts = items.where("item_text is not null").select("item_text").distinct()
    size = texts.agg(F.sum(F.length("item_text") * 4)).first()[0] or 0
    count = -(-size // BLOCK_BYTES)
    block = F.pmod(F.xxhash64("item_text"), F.lit(max(1, count)))
    for n in range(count):
        yield [r["item_text"] for r in texts.where(block == n).orderBy("item_text").collect()], items.where(block == n)


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = SCORE) -> DataFrame:
    """doc_id, text_key, item_id, score, end_word, n_seeds: the best alignment of every leaking document and item."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")).alias("text_key"), F.col("text").cast("string").alias("text"))
    items = benchmark.select("item_id", benchmark["text"].cast("string").alias("item_text"))
    kind = dict(benchmark.dtypes)["item_id"]
    out = spark.createDataFrame([], f"doc_id long, text_key long, item_id {kind}, score double, end_word long, n_seeds int")
    for texts, ids in _blocks(items):
        shared = spark.sparkContext.broadcast(texts)
        hits = rows.mapInArrow(_find(shared, least), "doc_id long, text_key long, item int, start long, window string")
        hits = materialize(hits, "leak-windows")
        pairs = hits.select("item", "window").distinct()
        scored = pairs.mapInArrow(_score(shared, least), "item int, window string, end long, score double, n_seeds int").where(F.col("score") >= least)
        scored = hits.join(scored, ["item", "window"]).withColumn("end_word", F.col("start") + F.col("end"))
        best = scored.groupBy("doc_id", "text_key", "item").agg(F.max(F.struct("score", (-F.col("end_word")).alias("back"), "n_seeds")).alias("b"))
        names = spark.createDataFrame(list(enumerate(texts)), "item int, item_text string")
        # the texts of a block are bounded, the items that share them are not: their join is left to the sizes at run time
        named = best.join(F.broadcast(names), "item").join(ids, "item_text")
        out = out.unionByName(named.select("doc_id", "text_key", "item_id", "b.score", (-F.col("b.back")).alias("end_word"), "b.n_seeds"))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = SCORE) -> DataFrame:
    """doc_id, item_id, score, end_word, n_seeds: one row for each leaking document and item."""
    best = F.max(F.struct("score", "end_word", "n_seeds")).alias("b")
    return leaks(docs, benchmark, least).groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.score", "b.end_word", "b.n_seeds")


def keep_clean(docs: DataFrame, benchmark: DataFrame, least: float = SCORE) -> DataFrame:
    """The rows of ``docs`` whose text leaks no item."""
    found = materialize(leaks(docs, benchmark, least).select("text_key").distinct(), "leaking-texts")
    found = F.broadcast(found) if found.count() <= BROADCAST_KEYS else found
    keyed = docs.select(F.struct("*").alias("row"), F.xxhash64(docs["text"].cast("string")).alias("text_key"))
    return keyed.join(found, "text_key", "left_anti").select("row.*")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op3_decontamination": op3_decontamination}
ORACLES: dict[str, str] = {}
