"""Cell classifier: quantile grids of features, log-odds of grid cells, a logistic regression on them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calspark.functions.columns import gaussian_taps

NODES, SIGMA, EPSILON, C = 100, 2.0, 1e-6, 100.0
KEYS = ("skew", "npix_norm", "compact")


def grid(train: DataFrame, keys=KEYS, nodes: int = NODES) -> DataFrame:
    """key, bin, node, p: the feature's value at equally spaced ranks, and the mean class of the ranks from there to the next node.

    The training set is small (rows of labelled regions); each feature is ranked by a
    window of its own partition.
    """
    long = train.select("roi", "iscell", F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("double").alias("v")) for k in keys])).alias("f")).select("roi", "iscell", "f.key", "f.v")
    w = Window.partitionBy("key").orderBy("v", "roi")
    x = long.withColumn("rank", F.row_number().over(w) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key")))
    # bin of a rank: the last j with floor(j * (n - 1) / (nodes - 1)) <= rank
    at = lambda j: F.floor(j * ((F.col("n") - 1) / float(nodes - 1)))
    first = F.floor(F.col("rank") * float(nodes - 1) / (F.col("n") - 1)).cast("int")
    b = F.when(at(first + 1) <= F.col("rank"), first + 1).when(at(first) > F.col("rank"), first - 1).otherwise(first)
    x = x.withColumn("bin", F.least(b, F.lit(nodes - 1)))
    p = x.where(F.col("bin") < nodes - 1).groupBy("key", "bin").agg(F.min_by("v", "rank").alias("node"), F.avg("iscell").alias("p"))
    last = x.where(F.col("rank") == F.col("n") - 1).select("key", F.lit(nodes - 1).alias("bin"), F.col("v").alias("node"), F.lit(None).cast("double").alias("p"))
    return p.unionByName(last)


def smoothed(cells: DataFrame, nodes: int = NODES, sigma: float = SIGMA) -> DataFrame:
    """The grid with p smoothed over bins (reflected ends); bins without rows take the one before."""
    radius, n = int(4 * sigma + 0.5), nodes - 1
    w = Window.partitionBy("key").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = cells.withColumn("_p", F.collect_list("p").over(w))
    total = None
    for k, weight in gaussian_taps(sigma, radius):
        j = F.pmod(F.col("bin") + k, F.lit(2 * n))
        term = F.lit(weight) * F.get("_p", F.when(j >= n, 2 * n - 1 - j).otherwise(j).cast("int"))
        total = term if total is None else total + term
    return x.withColumn("p", F.when(F.col("p").isNotNull(), total)).drop("_p")


def log_odds(value: Column, nodes: list[float], p: list[float], wrap_lowest: bool = False) -> Column:
    """Log-odds of the grid cell (lo, hi] that holds the value, clipped to the grid; nulls and NaN read the lowest.

    Values at the lowest node read the first cell; with ``wrap_lowest`` the last, as
    older classifiers did.
    """
    v = F.coalesce(F.nanvl(value.cast("double"), F.lit(nodes[0])), F.lit(nodes[0]))
    v = F.least(F.greatest(v, F.lit(nodes[0])), F.lit(nodes[-1]))
    at = F.size(F.filter(F.array(*[F.lit(x) for x in nodes]), lambda g: g < v)) - 1
    at = F.when(at < 0, F.lit(len(p) - 1 if wrap_lowest else 0)).otherwise(F.least(at, F.lit(len(p) - 1)))
    q = F.element_at(F.array(*[F.lit(x) for x in p]), at + 1)
    return F.log(q + EPSILON) - F.log(1 - q + EPSILON)


@dataclass
class Classifier:
    """Grids by key and logistic weights; a few hundred numbers."""

    keys: tuple[str, ...]
    nodes: dict[str, list[float]]
    p: dict[str, list[float]]
    weights: list[float]
    intercept: float

    @staticmethod
    def fit(train: DataFrame, keys=KEYS) -> Classifier:
        rows = smoothed(grid(train, keys)).orderBy("key", "bin").collect()  # NODES rows a key
        nodes = {k: [r["node"] for r in rows if r["key"] == k] for k in keys}
        p = {k: [r["p"] for r in rows if r["key"] == k and r["p"] is not None] for k in keys}
        model = Classifier(tuple(keys), nodes, p, [0.0] * len(keys), 0.0)
        from pyspark.ml.classification import LogisticRegression
        from pyspark.ml.feature import VectorAssembler

        x = model.features(train).withColumn("label", F.col("iscell").cast("double"))
        n = x.count()
        fitted = LogisticRegression(regParam=1.0 / (C * max(n, 1)), standardization=False, maxIter=200, tol=1e-9).fit(VectorAssembler(inputCols=[f"_{k}" for k in keys], outputCol="features").transform(x))
        model.weights, model.intercept = [float(w) for w in fitted.coefficients], float(fitted.intercept)
        return model

    def features(self, stats: DataFrame) -> DataFrame:
        return stats.withColumns({f"_{k}": log_odds(F.col(k), self.nodes[k], self.p[k]) for k in self.keys})

    def predict(self, stats: DataFrame, threshold: float = 0.5) -> DataFrame:
        """roi, prob, iscell."""
        z = F.lit(self.intercept)
        for k, w in zip(self.keys, self.weights):
            z = z + F.lit(w) * F.col(f"_{k}")
        prob = 1.0 / (1.0 + F.exp(-z))
        return self.features(stats).select("roi", prob.alias("prob"), (prob > threshold).alias("iscell"))

    def save(self, spark, path: str) -> None:
        rows = [(k, n, float(v), self.p[k][n] if n < len(self.p[k]) else None, self.weights[i], self.intercept) for i, k in enumerate(self.keys) for n, v in enumerate(self.nodes[k])]
        spark.createDataFrame(rows, "key string, bin int, node double, p double, weight double, intercept double").coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark, path: str, keys=None) -> Classifier:
        rows = spark.read.parquet(path).orderBy("key", "bin").collect()
        found = tuple(dict.fromkeys(r["key"] for r in rows if keys is None or r["key"] in keys))
        return Classifier(
            found, {k: [r["node"] for r in rows if r["key"] == k] for k in found}, {k: [r["p"] for r in rows if r["key"] == k and r["p"] is not None] for k in found},
            [next(r["weight"] for r in rows if r["key"] == k) for k in found], rows[0]["intercept"],
        )


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


def flipped(labels: DataFrame, overrides: DataFrame) -> DataFrame:
    """labels (roi, iscell) with manual decisions (roi, iscell) over them."""
    o = overrides.select("roi", F.col("iscell").alias("_o"))
    return labels.join(o, "roi", "left").withColumn("iscell", F.coalesce("_o", "iscell")).drop("_o")


def training_union(recordings: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Statistics with their labels appended over recordings; rows without a partner are left out."""
    parts = [stats.join(labels.select("roi", "iscell"), "roi").withColumn("recording", F.lit(n)) for n, (stats, labels) in enumerate(recordings)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
