"""Hybrid ground truth: planted regions and neuropil in a recorded movie, with noise of counting.

Random draws are seeded by what they are for (region, plane and frame), so that a task
that runs again draws the same. Regions of one field of view are small and go to
every task; frames stay where they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from calspark.operators.interactive import nearest_ranked

#: Side of the square that a region is drawn in; half axes of round regions, and the second one of every third, long one.
SIDE, ROUND, LONG = 16, (0.75, 2.0), (1.0, 6.0)


def ellipses(spark: SparkSession, n: int, height: int, width: int, seed: int = 0) -> DataFrame:
    """roi, y, x, lam: filled ellipses with ragged edges at random places, weights summing to one; the last third may be long."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        y, x = np.mgrid[:SIDE, :SIDE]
        for pdf in it:
            for roi in pdf["id"].tolist():
                r = np.random.default_rng([seed, roi])
                a, b = r.uniform(*ROUND), r.uniform(*(LONG if roi >= n - n // 3 else ROUND))
                cx, cy, turn = r.uniform(a, SIDE - a), r.uniform(b, SIDE - b), r.uniform(0, 2 * np.pi)
                along, across = (y - cy) * np.cos(turn) + (x - cx) * np.sin(turn), (x - cx) * np.cos(turn) - (y - cy) * np.sin(turn)
                far = np.maximum(0, (along / a) ** 2 + (across / b) ** 2 + r.normal(0, 0.25, (SIDE, SIDE)))
                rows, columns = np.nonzero(far <= 1)
                lam = np.maximum(0.1, 1 - far[rows, columns])
                top, left = r.integers(0, height - SIDE), r.integers(0, width - SIDE)
                yield pd.DataFrame({"roi": roi, "y": (rows + top).astype("int32"), "x": (columns + left).astype("int32"), "lam": lam / lam.sum()})

    return spark.range(n).mapInPandas(run, "roi long, y int, x int, lam double")


def borrowed_activity(centres: DataFrame, truth: DataFrame, traces: DataFrame, mean_rank: float = 5.0, seed: int = 0) -> DataFrame:
    """roi, frame, v: every planted region (roi, y, x) gets the trace of a true one near it (roi, y, x; traces: roi, frame, v).

    Which one is drawn by rank of distance, exponential with the given mean.
    """
    count = truth.count()  # one recording's regions
    u = (F.pmod(F.xxhash64(F.col("roi"), F.lit(seed)), F.lit(1 << 40)) + 1) / F.lit(float(1 << 40))
    wanted = centres.withColumn("rank", F.least(F.floor(-mean_rank * F.log(u)) + 1, F.lit(count)).cast("int"))
    most = wanted.agg(F.max("rank")).first()[0] or 1
    near = nearest_ranked(centres.select(F.col("roi").alias("a"), "y", "x"), truth.select(F.col("roi").alias("b"), "y", "x"), most)
    chosen = near.join(wanted.select(F.col("roi").alias("a"), "rank"), ["a", "rank"]).select("a", F.col("b").alias("roi"))
    return traces.join(chosen, "roi").select(F.col("a").alias("roi"), "frame", "v")


def fourier_basis(height: int, width: int, tiles: int = 7) -> np.ndarray:
    """Products of slow sines and cosines over the field, without the constant one; rows of unit norm."""

    def axis(n: int) -> np.ndarray:
        at = (np.arange(n) + 0.5) / n
        out = np.ones((tiles, n))
        for k in range(1, tiles):
            out[k] = (np.sin if k % 2 else np.cos)(2 * np.pi * at * ((k + 1) // 2))
        return out

    rows, columns = axis(height), axis(width)
    basis = np.stack([np.outer(rows[i], columns[j]).ravel() for i in range(tiles) for j in range(tiles)][1:])
    return basis / np.linalg.norm(basis, axis=1, keepdims=True)


def neuropil_weights(frames: DataFrame, basis: np.ndarray) -> DataFrame:
    """frame, w: the other planes' frames, less their plane's mean value, on the basis; summed over planes."""
    means = frames.groupBy("plane").agg(F.avg(F.aggregate("arr", F.lit(0.0), lambda s, v: s + v) / F.size("arr")).alias("mean"))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            if len(pdf):
                x = np.stack(pdf["arr"].to_numpy()).astype(float) - pdf["mean"].to_numpy()[:, None]
                yield pd.DataFrame({"frame": pdf["frame"], "w": list(x @ basis.T)})

    kind = dict(frames.dtypes)["frame"]
    each = frames.select("plane", "frame", "arr").join(F.broadcast(means), "plane").select("frame", "arr", "mean").mapInPandas(run, f"frame {kind}, w array<double>")
    return each.groupBy("frame").agg(F.array(*[F.sum(F.element_at("w", k + 1)) for k in range(len(basis))]).alias("w"))


def hybrid(frames: DataFrame, height: int, width: int, masks: DataFrame | None = None, activity: DataFrame | None = None, weights: DataFrame | None = None, basis: np.ndarray | None = None, neuropil: float = 0.4, counting: float = 50.0, seed: int = 0) -> DataFrame:
    """plane, frame, arr (int16): a recorded plane's frames with neuropil of that share, planted regions, and Poisson noise in steps of ``counting``.

    masks: roi, y, x, lam; activity: roi, frame, v; weights: frame, w on ``basis``.
    """
    share = neuropil if weights is not None else 0.0
    mean = frames.agg(F.avg(F.aggregate(F.slice("arr", 1, height * width), F.lit(0.0), lambda s, v: s + v) / F.lit(float(height * width)))).first()[0] or 0.0
    planted: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    x = frames.select("plane", "frame", "arr")
    if masks is not None:
        for roi, p in masks.toPandas().groupby("roi"):  # one field of view
            lam = p["lam"].to_numpy()
            planted[roi] = p["y"].to_numpy() * width + p["x"].to_numpy(), lam / lam.sum() * len(lam)
        now = activity.groupBy("frame").agg(F.collect_list(F.struct("roi", "v")).alias("now"))
        x = x.join(now, "frame", "left")
    if weights is not None:
        x = x.join(weights, "frame", "left")

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for r in pdf.itertuples():
                image = np.asarray(r.arr, float) * (1 - share)
                if share:
                    image += share * np.maximum(0, (np.asarray(r.w) @ basis if r.w is not None else 0) + mean)
                if planted and r.now is not None:
                    glow = np.zeros(height * width)
                    for a in r.now:
                        at, lam = planted[a["roi"]]
                        glow[at] += a["v"] * lam
                    image += np.maximum(0, glow) * (1 - share)
                if counting > 0:
                    image = np.random.default_rng([seed, int(r.plane), int(r.frame)]).poisson(np.maximum(0, image) / counting) * counting
                out.append(np.clip(image, 0, 32767).astype("int16"))
            yield pd.DataFrame({"plane": pdf["plane"], "frame": pdf["frame"], "arr": out})

    kinds = dict(frames.dtypes)
    return x.mapInPandas(run, f"plane {kinds['plane']}, frame {kinds['frame']}, arr array<smallint>")


def strongest(traces: DataFrame, least: float) -> DataFrame:
    """The traces (roi, frame, v) whose signal exceeds the noise: one minus half the variance of differences over the variance."""
    step = F.col("v") - F.lag("v").over(Window.partitionBy("roi").orderBy("frame"))
    snr = traces.withColumn("d", step).groupBy("roi").agg((1 - 0.5 * F.try_divide(F.var_pop("d"), F.var_pop("v"))).alias("snr"))
    return traces.join(snr.where(F.col("snr") > least).select("roi"), "roi", "left_semi")
