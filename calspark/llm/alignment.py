"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes, and how often.

Space and text are encoded by a byte-level vocabulary (A) and by a piece vocabulary
with byte fallback (B). The cumulative ends of both sides are merged in one pass: where
both end, a group closes; every stretch between neighbouring ends lies in one token of
either side, which links the two. A document's row carries its links as distinct pairs
with multiplicities. Spark counts the documents of every pair, takes the maxima of
either side, and joins count and maxima back to the links.

Skew. Pairs such as comma and comma occur in nearly every document. The HEAVY most frequent
pairs (a bound on rows, checked by a histogram of at most 64 rows) are broadcast and meet the
links where they are; only the others, each in few documents, are shuffled. The maxima of
a side have a row for each of its ids, which the vocabulary bounds.

Defined cases. Null and empty texts, and texts whose tokens do not spell space and text
byte by byte (B writes a space for U+2581), have no tokens: zeros, and '' for the digest
of groups. Strings of special tokens in a text are plain text. Repeated rows each give a
row and each count as a document. Texts are encoded whole. Extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calspark.llm.storage import documents, materialize
from calspark.llm.tokens import PATTERN, resolve

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Most pairs that are broadcast.
HEAVY = 200_000
SCHEMA = "doc_id string, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<int>"


class ByteLevel:
    """Ids of a byte-level vocabulary, all of a text as plain text, and the bytes of each id."""

    def __init__(self, path: str):
        import json

        import tiktoken

        from calspark.llm.tokens import _byte_of_char

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        table, added = _byte_of_char(), {t["content"] for t in spec.get("added_tokens", ())}
        ranks = {bytes(table[c] for c in token): n for token, n in spec["model"]["vocab"].items() if token not in added}
        self.path = path
        self.fast = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, n in ranks.items():
            self.bytes[n] = token
        self.lengths = np.array([len(t) for t in self.bytes], np.int64)

    def ids(self, text: str) -> np.ndarray:
        try:
            return np.array(self.fast.encode_ordinary(text), np.int64)
        except BaseException as raised:  # the native encoder panics on some texts; what it raises is no Exception
            if type(raised).__name__ != "PanicException":
                raise
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(self.path)
        whole.encode_special_tokens = True
        return np.array(whole.encode(text, add_special_tokens=False).ids, np.int64)


class Pieces:
    """Ids of a piece vocabulary, which adds the leading space itself, and the bytes of each id."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(n) for n in range(self.model.vocab_size())]
        self.bytes = [bytes([int(p[3:-1], 16)]) if self.model.is_byte(n) else p.replace("▁", " ").encode() for n, p in enumerate(pieces)]
        self.lengths = np.array([len(t) for t in self.bytes], np.int64)

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text), np.int64)


@cache
def byte_level(tokenizer: str) -> ByteLevel:
    return ByteLevel(resolve(tokenizer))


@cache
def pieces(tokenizer: str) -> Pieces:
    return Pieces(resolve(tokenizer))


@cache
def _written(size: int, closing: str) -> np.ndarray:
    """Decimal ids followed by a comma, then the same followed by what closes their side of a group."""
    return np.array([f"{n}{end}".encode() for end in (",", closing) for n in range(size)], object)


def merge(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(A's token of every link, B's token of every link, ends of groups) of two increasing lists of ends with a common last one."""
    at_a, at_b = np.zeros((2, int(ends_a[-1]) + 1), bool)
    at_a[ends_a] = True
    at_b[ends_b] = True
    cuts = np.flatnonzero(at_a | at_b)
    return (np.cumsum(at_a, dtype=np.int64) - at_a)[cuts], (np.cumsum(at_b, dtype=np.int64) - at_b)[cuts], np.flatnonzero(at_a & at_b)


def groups_of(ids_a: np.ndarray, ends_a: np.ndarray, ids_b: np.ndarray, ends_b: np.ndarray, closed: np.ndarray, sizes: tuple[int, int]) -> bytes:
    """``a1,a2|b1;a3|b2,b3``: the ids of every group, which end at ``closed``."""
    upto_a, upto_b = np.searchsorted(ends_a, closed, "right"), np.searchsorted(ends_b, closed, "right")
    last_a, last_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
    last_a[upto_a - 1] = 1
    last_b[upto_b - 1] = 1
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    out = np.empty(len(ids_a) + len(ids_b), object)
    out[np.arange(len(ids_a)) + np.concatenate(([0], upto_b))[group_a]] = _written(sizes[0], "|")[ids_a + sizes[0] * last_a]
    out[np.arange(len(ids_b)) + upto_a[group_b]] = _written(sizes[1], ";")[ids_b + sizes[1] * last_b]
    return b"".join(out.tolist())[:-1]


def align(text: str | None, a: ByteLevel, b: Pieces) -> tuple[int, int, int, int, bytes, np.ndarray, np.ndarray]:
    """n_a, n_b, n_groups, n_links, the written groups, distinct pairs (A's id << 32 | B's) and how often each is linked."""
    none = 0, 0, 0, 0, b"", np.empty(0, np.int64), np.empty(0, np.int32)
    if not text:
        return none
    ids_a, ids_b, whole = a.ids(" " + text), b.ids(text), (" " + text).encode()
    if b"".join([b.bytes[n] for n in ids_b.tolist()]) != whole or b"".join([a.bytes[n] for n in ids_a.tolist()]) != whole:
        return none
    ends_a, ends_b = np.cumsum(a.lengths[ids_a]), np.cumsum(b.lengths[ids_b])
    link_a, link_b, closed = merge(ends_a, ends_b)
    pairs, times = np.unique(ids_a[link_a] << 32 | ids_b[link_b], return_counts=True)
    written = groups_of(ids_a, ends_a, ids_b, ends_b, closed, (len(a.bytes), len(b.bytes)))
    return len(ids_a), len(ids_b), len(closed), len(link_a), written, pairs, times.astype(np.int32)


#: Rows of an input batch that are turned into a frame of the result at a time.
FRAME = 200


def _aligned(tokenizer_a: str, tokenizer_b: str, digest: bool):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = byte_level(tokenizer_a), pieces(tokenizer_b)
        names = [f.split()[0] for f in SCHEMA.split(", ")]

        def row(doc: str | None, text: str | None) -> tuple:
            n_a, n_b, n_groups, n_links, written, pairs, times = align(text, a, b)
            groups = hashlib.sha256(written).hexdigest() if digest and written else written.decode()
            return doc, n_a, n_b, n_groups, n_links, groups, pairs, times

        for frame in frames:
            for at in range(0, len(frame), FRAME):
                part = frame.iloc[at : at + FRAME]
                yield pd.DataFrame([row(d, t) for d, t in zip(part["doc_id"], part["text"])], columns=names)

    return run


def alignments(docs: DataFrame, a: str = A, b: str = B, digest: bool = False) -> DataFrame:
    """A row a document, written: number, doc_id, n_a, n_b, n_groups, n_links, groups (or their SHA-256), pairs and times."""
    rows = docs.select(docs["doc_id"].cast("long").cast("string").alias("doc_id"), docs["text"].cast("string").alias("text"))
    found = rows.mapInPandas(_aligned(a, b, digest), SCHEMA).withColumn("doc_id", F.col("doc_id").cast("long"))
    return materialize(found.withColumn("number", F.monotonically_increasing_id()), "alignment")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, a, b, count, a_most, b_most), written: documents that hold a pair linked, and the highest count of its A and its B id."""
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("count"))
    counts = materialize(counts.select("pair", F.shiftright("pair", 32).cast("int").alias("a"), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("b"), "count"), "alignment-pairs")
    for side in ("a", "b"):  # a row an id: the vocabulary bounds it
        counts = counts.join(F.broadcast(counts.groupBy(side).agg(F.max("count").alias(f"{side}_most"))), side)
    return materialize(counts.select("pair", "a", "b", "count", "a_most", "b_most"), "alignment-counts")


def _least_heavy(counts: DataFrame, heavy: int) -> int:
    """A power of two such that at most ``heavy`` pairs are in as many documents or more."""
    level = F.floor(F.log2("count")).cast("int")
    seen = {r["level"]: r["n"] for r in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()}
    total, found = 0, max(seen, default=0) + 1
    while found and total + seen.get(found - 1, 0) <= heavy:
        found -= 1
        total += seen.get(found, 0)
    return 1 << found


def scored(aligned: DataFrame, counts: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """(number, n_best, n_best_b, count_sum) of every document with links."""
    links = aligned.select("number", F.inline(F.arrays_zip("pairs", "times"))).withColumnRenamed("pairs", "pair")
    sums = [
        F.sum(F.when(F.col("count") == F.col("a_most"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.when(F.col("count") == F.col("b_most"), F.col("times")).otherwise(0)).alias("n_best_b"),
        F.sum(F.col("times") * F.col("count")).alias("count_sum"),
    ]
    known = counts.select("pair", "count", "a_most", "b_most")
    least = _least_heavy(counts, heavy)
    if least == 1:
        return links.join(F.broadcast(known), "pair").groupBy("number").agg(*sums)
    met = links.join(F.broadcast(known.where(F.col("count") >= least)), "pair", "left")
    rest = F.when(F.col("count").isNull(), F.col("pair"))
    # a row a document for all its heavy pairs, one for each other pair
    met = materialize(met.groupBy("number", rest.alias("pair")).agg(F.sum("times").alias("times"), *sums), "alignment-met")
    light = met.where("pair is not null").select("number", "pair", "times").join(known.where(F.col("count") < least), "pair")
    both = met.where("pair is null").select("number", "n_best", "n_best_b", "count_sum").unionByName(light.groupBy("number").agg(*sums))
    return both.groupBy("number").agg(*[F.sum(c).alias(c) for c in ("n_best", "n_best_b", "count_sum")])


def token_alignment(docs: DataFrame, a: str = A, b: str = B, heavy: int = HEAVY) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best, n_best_b, count_sum, groups_sha256."""
    aligned = alignments(docs, a, b, digest=True)
    found = aligned.drop("pairs", "times").join(scored(aligned, pair_counts(aligned), heavy), "number", "left")
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "n_best_b", "count_sum")], F.col("groups").alias("groups_sha256"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment(documents(spark, sf_dir))


QUERIES = {"op11_alignment": op11_alignment}
ORACLES: dict[str, str] = {}
