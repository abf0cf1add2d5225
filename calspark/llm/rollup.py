"""Token counts as delta-maintained rollups.

Totals by source, language and tokenizer version are sums of signed deltas. A batch of
changes (insert, revise, delete) is turned into deltas against the state of the
documents it touches: minus the old count under the old key, plus the new one under
the new key. Batches are committed once: the document states are written first, the
deltas last, and the marker that the writer leaves behind its last file is the
commit. A batch whose deltas carry the marker is skipped when it comes again; one
that died before is written anew. Totals read committed batches only and never look
at documents again.

Batch numbers say what is newer, whatever the order of arrival: where a document is
known from a later batch, a late batch changes nothing of it. So the totals depend on
the committed batches only, not on when each came.

The store is a folder that driver and executors share::

    state/batch=N    doc_id, tokenizer, source, lang, n_tokens (null: deleted)
    ledger/batch=N   source, lang, tokenizer, d_docs, d_tokens
    base=K/          state (with batch), ledger and covers (batch) of all batches that it covers

A commit reads the state of the documents it touches only: the scan is filtered by
their keys before it is grouped. After every COMPACT_AFTER batches the store is
compacted to one row a document and one a key, so a scan never meets more folders
than that; ``covers``, written last, makes a base valid. One writer at a time.

Defined cases. Changes with a null doc_id or tokenizer are dropped. Of several changes
of one document in a batch the last by seq counts, ties by the larger (op, source,
lang, count). An insert of a known document revises it, a revision of an unknown one
inserts it, a delete of an unknown one does nothing. Null source or language is a key
of its own. Null text counts zero tokens; very long texts are counted whole, one at a
time. Extra columns, whatever their names, are ignored. An empty batch commits empty
deltas; an empty store has no totals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calspark.llm.storage import documents, exists, materialize, new_path, remove
from calspark.llm.tokens import TOKENIZER, encoder

STATE = "doc_id long, tokenizer string, source string, lang string, n_tokens long"
LEDGER = "source string, lang string, tokenizer string, d_docs long, d_tokens long"
COUNTS = "doc_id long, source string, lang string, tokenizer string, n_tokens long, n_distinct long"
KEY = ["doc_id", "tokenizer"]
#: Batches since the last base after which a commit compacts the store.
COMPACT_AFTER = 32

WORDS = r"[^ \t\n\x0B\f\r]+"
#: Tokenizer version -> (count, count of different tokens or null) of a text, as columns. White space is ASCII's.
COUNTERS = {
    "words@1": lambda text: (F.regexp_count(text, F.lit(WORDS)), F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))))),
    "utf8@1": lambda text: (F.octet_length(text), F.lit(None)),
}
#: Tokenizer version -> file of a byte-level vocabulary.
TOKENIZERS = {"byte_bpe_50k@1": TOKENIZER}


def _encoded(files: list[str]):
    """The last column is the text; in its place comes (tokens, different tokens) by each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = [encoder(f) for f in files]
        for batch in batches:
            found = []
            for t in batch.columns[-1]:
                ids = [e.ids(t.as_py()) for e in encoders]
                found.append([{"n_tokens": len(x), "n_distinct": len(np.unique(x))} for x in ids])
            kind = pa.list_(pa.struct([("n_tokens", pa.int64()), ("n_distinct", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, kind)], [*batch.schema.names[:-1], "encoded"])

    return run


def counts(docs: DataFrame, counters: dict | None = None, tokenizers: dict | None = None) -> DataFrame:
    """COUNTS of every document and tokenizer version, in one pass over the texts.

    ``counters``: version -> function of the text column; ``tokenizers``: version -> vocabulary file.
    """
    counters, tokenizers = COUNTERS if counters is None else counters, TOKENIZERS if tokenizers is None else tokenizers
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    pair = lambda n, d: F.struct(n.cast("long").alias("n_tokens"), d.cast("long").alias("n_distinct"))
    counted = F.array(*[pair(*count(text)) for count in counters.values()]) if counters else F.array().cast("array<struct<n_tokens:long,n_distinct:long>>")
    rows = docs.select(*[docs[c].cast(t).alias(c) for c, t in (("doc_id", "long"), ("source", "string"), ("lang", "string"))], counted.alias("counted"), text.alias("text"))
    if tokenizers:
        pairs = "array<struct<n_tokens:long,n_distinct:long>>"
        rows = rows.mapInArrow(_encoded(list(tokenizers.values())), f"doc_id long, source string, lang string, counted {pairs}, encoded {pairs}")
        rows = rows.withColumn("counted", F.concat("counted", "encoded"))
    named = F.arrays_zip(F.array(*[F.lit(v) for v in [*counters, *tokenizers]]).alias("tokenizer"), F.col("counted").alias("c"))
    return rows.select("doc_id", "source", "lang", F.explode(named).alias("z")).select("doc_id", "source", "lang", "z.tokenizer", "z.c.n_tokens", "z.c.n_distinct")


def changes(counted: DataFrame, op: str, seq: int, count: str = "n_tokens") -> DataFrame:
    """A change for every row of ``counted`` whose count is known."""
    return counted.where(F.col(count).isNotNull()).select(F.lit(op).alias("op"), F.lit(seq).alias("seq"), *KEY, "source", "lang", F.col(count).alias("n_tokens"))


class Rollup:
    """A store of token totals in a shared folder."""

    def __init__(self, spark: SparkSession, path: str, compact_after: int = COMPACT_AFTER):
        self.spark, self.path, self.compact_after = spark, path.rstrip("/"), compact_after

    def _folder(self, kind: str, batch: int) -> str:
        return f"{self.path}/{kind}/batch={int(batch)}"

    def _numbered(self, folder: str, prefix: str) -> list[int]:
        """N of the folders prefix=N."""
        if not exists(self.spark, folder):
            return []
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        names = [s.getPath().getName() for s in at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)]
        return sorted(int(x.split("=")[1]) for x in names if x.startswith(f"{prefix}="))

    def committed(self, batch: int) -> bool:
        return exists(self.spark, f"{self._folder('ledger', batch)}/_SUCCESS")

    def batches(self) -> list[int]:
        """Committed batches, from a listing of folders."""
        return [n for n in self._numbered(f"{self.path}/ledger", "batch") if self.committed(n)]

    def _base(self) -> tuple[str | None, set[int]]:
        """The last valid base, and the batches that it covers."""
        for k in reversed(self._numbered(self.path, "base")):
            if exists(self.spark, f"{self.path}/base={k}/covers/_SUCCESS"):
                covers = self.spark.read.schema("batch int").parquet(f"{self.path}/base={k}/covers")
                return f"{self.path}/base={k}", {r["batch"] for r in covers.collect()}  # a number a batch
        return None, set()

    def _read(self, kind: str, schema: str) -> DataFrame:
        """The rows of the base and of the committed batches after it, with their batch."""
        base, covers = self._base()
        paths = [self._folder(kind, n) for n in self.batches() if n not in covers]
        full = schema + ", batch int"
        out = self.spark.read.schema(full).parquet(f"{base}/{kind}") if base else self.spark.createDataFrame([], full)
        return out.unionByName(self.spark.read.schema(full).option("basePath", f"{self.path}/{kind}").parquet(*paths)) if paths else out

    def state(self, keys: DataFrame | None = None) -> DataFrame:
        """The latest row of every document and tokenizer version (of those in ``keys``), deletions included, with its batch."""
        rows = self._read("state", STATE)
        if keys is not None:
            rows = rows.join(keys.select(*KEY), KEY, "left_semi")
        latest = rows.groupBy(*KEY).agg(F.max_by(F.struct("source", "lang", "n_tokens", "batch"), "batch").alias("r"))
        return latest.select(*KEY, "r.*")

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """Apply a batch of changes (op, seq, doc_id, source, lang, tokenizer, n_tokens) once; False if it was committed before."""
        if self.committed(batch):
            return False
        rows = changes.where("doc_id is not null and tokenizer is not null")
        value = F.struct("op", "source", "lang", F.when(F.col("op") != "delete", F.coalesce("n_tokens", F.lit(0))).cast("long").alias("n_tokens"))
        last = rows.groupBy(*KEY).agg(F.max(F.struct("seq", value.alias("v"))).alias("m"))
        last.select(*KEY, "m.v.source", "m.v.lang", "m.v.n_tokens").write.mode("overwrite").parquet(self._folder("state", batch))
        new = self.spark.read.schema(STATE).parquet(self._folder("state", batch))
        old = self.state(new).select(*KEY, F.struct("source", "lang", "n_tokens").alias("old"), F.col("batch").alias("known"))
        met = new.join(old, KEY, "left").where(F.col("known").isNull() | (F.col("known") < batch))
        sides = F.array(F.struct(F.struct("source", "lang", "n_tokens").alias("v"), F.lit(1).alias("sign")), F.struct(F.col("old").alias("v"), F.lit(-1).alias("sign")))
        signed = met.select("tokenizer", F.explode(sides).alias("s")).select("tokenizer", "s.v.*", "s.sign").where("n_tokens is not null")
        deltas = signed.groupBy("source", "lang", "tokenizer").agg(F.sum("sign").alias("d_docs"), F.sum(F.col("sign") * F.col("n_tokens")).alias("d_tokens"))
        deltas.write.mode("overwrite").parquet(self._folder("ledger", batch))
        if len(set(self.batches()) - self._base()[1]) >= self.compact_after:
            self.compact()
        return True

    def compact(self) -> None:
        """Write a base of all committed batches. Nothing is deleted: see ``vacuum``."""
        done = self.batches()
        base = f"{self.path}/base={max([0, *self._numbered(self.path, 'base')]) + 1}"
        self.state().write.parquet(f"{base}/state")
        summed = self._read("ledger", LEDGER).groupBy("source", "lang", "tokenizer").agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens"), F.max("batch").alias("batch"))
        summed.write.parquet(f"{base}/ledger")
        self.spark.createDataFrame([(n,) for n in done], "batch int").write.parquet(f"{base}/covers")

    def vacuum(self) -> None:
        """Delete the states that the last base covers and older bases, when nothing reads them. The ledger stays: its folders say what was committed."""
        base, covers = self._base()
        for n in covers:
            remove(self.spark, self._folder("state", n))
        for k in self._numbered(self.path, "base"):
            if base and f"{self.path}/base={k}" != base:
                remove(self.spark, f"{self.path}/base={k}")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens; keys without documents are left out."""
        rows = self._read("ledger", LEDGER)
        summed = rows.groupBy("source", "lang", "tokenizer").agg(F.sum("d_docs").alias("n_docs"), F.sum("d_tokens").alias("n_tokens"))
        return summed.where("n_docs <> 0 or n_tokens <> 0")


def op5_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are inserted; those of low quality are recounted by different tokens and those labelled toxic deleted.

    Batches come twice, as after a lost acknowledgement, and the second after the third.
    """
    counted = materialize(counts(documents(spark, sf_dir)), "token-counts")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    store = Rollup(spark, new_path(spark, "rollup"))
    gone = counted.join(labels.where("toxic = 1").select("doc_id"), "doc_id", "left_semi")
    low = counted.join(labels.where("quality = 0 and toxic = 0").select("doc_id"), "doc_id", "left_semi")
    first, second, third = changes(counted, "insert", 0), changes(gone, "delete", 0), changes(low, "revise", 0, "n_distinct")
    for batch, rows in ((1, first), (1, first), (3, third), (2, second), (3, third)):
        store.commit(batch, rows)
    return store.totals()


QUERIES = {"op5_token_rollup": op5_token_rollup}
#: A vocabulary's tokens have no SQL; tests/llm holds the query against a replay, and its words and bytes against SQL.
ORACLES: dict[str, str] = {}
