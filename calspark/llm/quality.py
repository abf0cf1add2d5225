"""Quality classifier with hierarchical empirical Bayes over sites.

1. A document classifier is fitted on at most SAMPLE labelled rows (the rows with the
   smallest hash of doc_id; the one bound here, a parameter), of which near copies
   (equal min-hashes of word shingles) stay once: a ridge logistic regression on form
   features for quality, and one on the densities of a learned lexicon for toxicity.
   The lexicon holds the words and word beginnings whose share of toxic sample texts
   is furthest above that of the others.
2. Every document of the corpus is scored. Scores are summed by host and by path
   within the host (for documents: source, and language within it).
3. Global, host and path means form a chain of beta priors: a host's mean is shrunk
   toward the global one, a path's toward its host's, with prior strengths from the
   method of moments over all sites, so that sparse sites lean on their parents. A
   document's own share is taken out before its site is asked.
4. The document's log-odds and the site's log-odds against the global mean add up.
   Documents below THRESHOLD, and toxic ones, are rejected.

Sites are joined by broadcast if their measured size is at most BROADCAST_BYTES, else
by shuffle, where adaptive execution splits a hot site.

Defined cases. Null or blank text: no words; the features of an empty text (zero) are
scored like any other. Null host or path: the site ''. Labels with null, repeated or
conflicting rows: nulls are dropped, the mean label above one half counts. A label
column with one class only: the score is the smoothed share. No labels: every document
gets probability one half from the classifier and is kept. Repeated rows are scored
alike. Very long texts are scored whole, ROWS rows at a time. Extra columns, whatever
their names, pass through untouched where documents are filtered. An empty table gives
an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calspark.llm.storage import documents, materialize

#: Most labelled rows that the classifier is fitted on.
SAMPLE = 20_000
THRESHOLD, TOXIC, SITE_WEIGHT = 0.5, 0.5, 0.5
RIDGE = 1.0
#: A lexicon entry is in this share of the toxic sample, in so many texts, and this much likelier there (log-odds).
LEXICON_SHARE, LEXICON_TEXTS, LEXICON_ODDS, LEXICON_SIZE = 0.02, 3, 1.5, 400
#: Lengths of word beginnings; the shortest also finds candidates in a text.
STEMS = (4, 5, 6, 7)
SHINGLE_WORDS, MIN_HASHES = 5, 3
STRENGTH = (2.0, 1000.0)
BROADCAST_BYTES = 32 << 20
#: Rows scored at a time: bounds a worker's memory.
ROWS = 500

WORD = re.compile(r"[^\W\d_]+")
PLAIN = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*[.,;:!?)\"'»”]*")
FEATURES = 12


def features(text: str) -> list[float]:
    """Form of a text: length, symbols, capitals, repetition of words and lines, tables, digits."""
    words = text.split()
    if not words:
        return [0.0] * FEATURES
    n, size = len(words), len(text)
    different = set(words)
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    plain = sum(len(m) for m in PLAIN.findall(text))
    upper = sum(map(str.isupper, words))
    return [
        math.log1p(n), 1 - plain / max(1, size - text.count(" ") - text.count("\n")), upper / n, text.count("!!") / n, len(different) / n, sum(map(str.__eq__, words, words[1:])) / n,
        1 - len(set(lines)) / max(1, len(lines)), size / n, sum(map(text.count, "#$%&*@^~<>{}\\=")) / n, text.count("|") / n, sum(map(text.count, "0123456789")) / size, len(different) / n**0.7,
    ]


def min_hashes(text: str) -> list[int]:
    """Min-hashes of word shingles; near copies share most."""
    import xxhash

    words = WORD.findall(text.lower())
    grams = {" ".join(words[i : i + SHINGLE_WORDS]) for i in range(max(1, len(words) - SHINGLE_WORDS + 1))}
    return [min(xxhash.xxh64_intdigest(g, seed) >> 1 for g in grams) for seed in range(1, MIN_HASHES + 1)]


@dataclass(frozen=True)
class Logistic:
    """Ridge logistic regression on standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, standard: bool = True) -> Logistic:
        mean, scale = x.mean(0), x.std(0)
        scale = np.where(scale < 1e-9, 1.0, scale) if standard else np.ones_like(scale)
        z = np.empty((len(x), x.shape[1] + 1), x.dtype)
        z[:, 0], z[:, 1:] = 1, (x - mean) / scale
        weights = np.zeros(z.shape[1])
        penalty = ridge * np.eye(len(weights))
        penalty[0, 0] = 1e-3
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ weights, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p) + 1e-9).astype(z.dtype)[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ weights)
            weights = weights + step
            if np.abs(step).max() < 1e-6:
                break
        return Logistic(mean, scale, weights)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.c_[np.ones(len(x)), (x - self.mean) / self.scale] @ self.weights, -30, 30)


def entries(word: str) -> list[str]:
    """A word's lexicon entries: itself and its beginnings."""
    return ["=" + word, *("^" + word[:k] for k in STEMS if len(word) > k)]


def lexicon_counts(text: str, lexicon: dict[str, int], heads: frozenset[str]) -> tuple[dict[int, int], int]:
    """Occurrences of each lexicon entry, and the number of words."""
    words, out = WORD.findall(text.lower()), {}
    least = STEMS[0]
    for w in [w for w in words if w[:least] in heads]:
        for e in entries(w):
            if (k := lexicon.get(e)) is not None:
                out[k] = out.get(k, 0) + 1
    return out, len(words)


def heads_of(lexicon) -> frozenset[str]:
    return frozenset(e[1 : 1 + STEMS[0]] for e in lexicon)


def densities(counts: list[tuple[dict[int, int], int]], size: int) -> np.ndarray:
    x = np.zeros((len(counts), size + 1), np.float32)
    for row, (found, n) in zip(x, counts):
        for k, c in found.items():
            row[k] = math.log1p(200 * c / max(30, n))
        row[-1] = math.log1p(n)
    return x


@dataclass(frozen=True)
class Model:
    quality: Logistic | None
    lexicon: dict[str, int]
    toxic: Logistic | None

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds of good quality and of toxicity."""
        form = np.array([features(t) for t in texts]).reshape(-1, FEATURES)
        good = self.quality.logits(form) if self.quality else np.zeros(len(texts))
        bad = np.full(len(texts), -30.0)
        if self.toxic:
            heads = heads_of(self.lexicon)
            found = [lexicon_counts(t, self.lexicon, heads) for t in texts]
            bad = self.toxic.logits(densities(found, len(self.lexicon))) if texts else bad
        return good, bad


def _sample(docs: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """(text, quality, toxic) of the labelled rows with the smallest hashes of doc_id."""
    truth = labels.where("doc_id is not null").groupBy("doc_id").agg(F.avg("quality").alias("quality"), F.avg("toxic").alias("toxic"))
    chosen = truth.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)  # bounded: the classifier's sample
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), "quality", "toxic")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes = [min_hashes(t.as_py()) for t in batch.column(0)]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, *(pa.array([h[k] for h in hashes], pa.int64()) for k in range(MIN_HASHES))], ["text", "quality", "toxic", *(f"h{k}" for k in range(MIN_HASHES))]
        )


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([features(t.as_py()) for t in batch.column(0)], pa.list_(pa.float64())), batch.column(1)], ["form", "quality"])


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [sorted({e for w in set(WORD.findall(t.as_py().lower())) for e in entries(w)}) for t in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string()))], ["entries"])


def _occurrences(lexicon: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = heads_of(lexicon)
        for batch in batches:
            found = [lexicon_counts(t.as_py(), lexicon, heads) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array([list(c) for c, _ in found], pa.list_(pa.int32())), pa.array([list(c.values()) for c, _ in found], pa.list_(pa.int32())), pa.array([n for _, n in found], pa.int32())],
                ["bad", "entry", "times", "words"],
            )

    return run


OCCURRENCES = "bad boolean, entry array<int>, times array<int>, words int"


def _lexicon(known: DataFrame) -> dict[str, int]:
    """Entry -> column, from (text, bad). The candidates are bounded: each is in LEXICON_SHARE of the toxic sample."""
    total = {r["bad"]: r["count"] for r in known.groupBy("bad").count().collect()}
    if len(total) < 2:
        return {}
    least = max(LEXICON_TEXTS, LEXICON_SHARE * total[True])
    often = known.where("bad").select("text").mapInArrow(_entries, "entries array<string>").select(F.explode("entries").alias("e")).groupBy("e").count().where(F.col("count") >= least)
    candidates = sorted(r["e"] for r in often.select("e").collect())
    seen = known.select("text", "bad").mapInArrow(_occurrences({e: k for k, e in enumerate(candidates)}), OCCURRENCES).select("bad", F.explode("entry").alias("k"))
    ranked = []
    for r in seen.groupBy("k").agg(F.sum(F.col("bad").cast("int")).alias("bad"), F.sum((~F.col("bad")).cast("int")).alias("fine")).collect():
        odds = math.log((r["bad"] + 0.5) / (total[True] + 1)) - math.log((r["fine"] + 0.5) / (total[False] + 1))
        if r["bad"] >= least and odds >= LEXICON_ODDS:
            ranked.append((-odds * min(r["bad"], 30), candidates[r["k"]]))
    return {e: k for k, (_, e) in enumerate(sorted(ranked)[:LEXICON_SIZE])}


def fit(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> Model:
    """The document classifier. What reaches the driver is bounded by ``limit`` rows of numbers and by the lexicon."""
    hashes = [f"h{k}" for k in range(MIN_HASHES)]
    schema = "text string, quality double, toxic double, " + ", ".join(f"{h} long" for h in hashes)
    sample = materialize(_sample(docs, labels, limit).mapInArrow(_hashed, schema), "quality-sample")
    for h in hashes:
        least = sample.groupBy(h).agg(F.min_by(F.struct("text", "quality", "toxic", *hashes), F.struct(F.xxhash64("text"), "quality", "toxic")).alias("r"))
        sample = least.select("r.*")
    unique = materialize(sample.drop(*hashes), "quality-unique")
    rows = unique.where("quality is not null").select("text", "quality").mapInArrow(_forms, "form array<double>, quality double").collect()
    quality = Logistic.fit(np.array([r["form"] for r in rows]), np.array([r["quality"] > 0.5 for r in rows], float)) if rows else None
    known = unique.where("toxic is not null").select("text", (F.col("toxic") > 0.5).alias("bad"))
    lexicon, toxic = _lexicon(known), None
    if lexicon:
        found = known.mapInArrow(_occurrences(lexicon), OCCURRENCES).collect()
        x = densities([(dict(zip(r["entry"], r["times"])), r["words"]) for r in found], len(lexicon))
        toxic = Logistic.fit(x, np.array([r["bad"] for r in found], float), standard=False)
    return Model(quality, lexicon, toxic)


def _scorer(model: Model):
    """Text to its two log-odds, as a column: texts go to Python, numbers come back, the row stays where it is."""

    @F.pandas_udf("good double, bad double")
    def score(texts: pd.Series) -> pd.DataFrame:
        parts = [model.score(["" if t is None else t for t in texts.iloc[at : at + ROWS]]) for at in range(0, len(texts), ROWS)]
        good, bad = (np.concatenate(x) for x in zip(*parts)) if parts else ([], [])
        return pd.DataFrame({"good": good, "bad": bad}, dtype=float)

    return score


def _scored(docs: DataFrame, model: Model, host: str, path: str, whole: bool) -> DataFrame:
    """row, host, path, good, bad of every row. ``row`` is a struct of all columns, so that no name can clash, or of doc_id alone."""
    site = [F.coalesce(docs[c].cast("string"), F.lit("")).alias(name) for c, name in ((host, "host"), (path, "path"))]
    rows = docs.select(F.struct("*" if whole else "doc_id").alias("row"), *site, *([] if whole else [docs["text"].alias("text")]))
    text = F.col("row")["text"] if whole else F.col("text")
    return rows.select("row", "host", "path", _scorer(model)(text.cast("string")).alias("score")).select("row", "host", "path", "score.good", "score.bad")


def _probability(logit):
    return 1.0 / (1.0 + F.exp(-logit))


def _logit(p):
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(q / (1 - q))


def _strength(groups: DataFrame, mean: str) -> float:
    """Prior strength by moments: the mean of p(1-p) against the variance between groups beyond sampling."""
    x = groups.agg(
        F.sum(F.col("n") * F.col(mean) * (1 - F.col(mean))).alias("within"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"),
        F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col(mean), F.lit(2.0))).alias("between"),
    ).first()
    if not x["n"] or x["k"] < 2:
        return STRENGTH[1]
    within = x["within"] / x["n"]
    variance = max(0.0, x["between"] / x["n"] - within * x["k"] / x["n"])
    return min(STRENGTH[1], max(STRENGTH[0], within / variance - 1 if variance > 0 else STRENGTH[1]))


def with_sites(scored: DataFrame) -> DataFrame:
    """``scored`` (row, host, path, good, bad; written already) with p (document), site (shrunk site mean without it), final and toxic."""
    p = _probability(F.col("good"))
    paths = materialize(scored.groupBy("host", "path").agg(F.sum(p).alias("s"), F.count(F.lit(1)).cast("double").alias("n")), "sites")
    total = paths.agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.sum(F.length("host") + F.length("path") + 64).alias("size")).first()
    overall = (total["s"] or 0.0) / (total["n"] or 1.0) if total["n"] else 0.5
    hosts = paths.groupBy("host").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    a = _strength(hosts.withColumn("m", F.lit(overall)), "m")
    hosts = hosts.select("host", F.col("s").alias("hs"), F.col("n").alias("hn"))
    sites = paths.join(hosts, "host").withColumn("m", (F.col("hs") + a * overall) / (F.col("hn") + a))
    b = _strength(sites, "m")
    sites = sites.select("host", "path", "s", "n", "hs", "hn")
    joined = scored.join(F.broadcast(sites) if (total["size"] or 0) <= BROADCAST_BYTES else sites, ["host", "path"])
    host_mean = (F.col("hs") - F.col("p") + a * overall) / (F.col("hn") - 1 + a)
    site = (F.col("s") - F.col("p") + b * host_mean) / (F.col("n") - 1 + b)
    return (
        joined.withColumn("p", p).withColumn("site", site)
        .withColumn("final", _probability(F.col("good") + SITE_WEIGHT * (_logit(F.col("site")) - _logit(F.lit(overall))))).withColumn("toxic", _probability(F.col("bad")))
    )


def _kept():
    return (F.col("final") >= THRESHOLD) & (F.col("toxic") < TOXIC)


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """doc_id, host, path, p_document, p_site, p_quality, p_toxic, keep of every row."""
    scored = materialize(_scored(docs, fit(docs, labels), host, path, False), "quality")
    return with_sites(scored).select(
        "row.doc_id", "host", "path", F.col("p").alias("p_document"), F.col("site").alias("p_site"),
        F.col("final").alias("p_quality"), F.col("toxic").alias("p_toxic"), _kept().alias("keep"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject."""
    scored = materialize(_scored(docs, fit(docs, labels), host, path, True), "quality")
    return with_sites(scored).where(_kept()).select("row.*")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op7_quality": op7_quality}
ORACLES: dict[str, str] = {}
