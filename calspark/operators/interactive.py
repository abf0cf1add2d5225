"""Operators behind interactive views: activity modes, colours, scaled images, merging, sorting, patches."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calspark.functions.columns import rolling
from calspark.operators.extraction import MASK_PIXELS
from calspark.operators.labels import numbered_parts
from calspark.sources.tables import materialize

#: Distances of pixels worked out at a time.
DISTANCES_AT_A_TIME = 500_000
#: Distances of kinds of regions that a task keeps at most.
DISTANCES_HELD = 16_000_000


def activity(traces: DataFrame, mode: str, coefficient: float = 0.7) -> DataFrame:
    """roi, frame, v: raw, surround, corrected or spikes."""
    value = {"raw": F.col("f"), "surround": F.col("fneu"), "corrected": F.col("f") - coefficient * F.col("fneu")}
    if mode == "spikes":
        return traces.select("roi", "frame", F.col("spk").alias("v"))
    if mode not in value:
        raise ValueError(f"unknown activity {mode!r}")
    return traces.select("roi", "frame", value[mode].alias("v"))


def scaled(stats: DataFrame, by: str, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """roi, s: a statistic between two of its quantiles, clipped to [0, 1]; the extremes by default."""
    ends = stats.agg(F.percentile(by, F.array(F.lit(low), F.lit(high))).alias("_e"))
    s = F.try_divide(F.col(by) - F.col("_e")[0], F.col("_e")[1] - F.col("_e")[0])
    return stats.join(F.broadcast(ends)).select("roi", F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0)).alias("s"))


def colour(s: Column) -> Column:
    """struct r, g, b (0 .. 255) of a value in [0, 1]: full saturation, hue from violet down to red."""
    h = (1 - (s / 1.4 + 0.4 / 1.4)) * 6

    def channel(offset: float) -> Column:
        k = F.pmod(F.lit(offset) + h, F.lit(6.0))
        return F.floor(255 * (1 - F.greatest(F.lit(0.0), F.least(k, 4 - k, F.lit(1.0))))).cast("int")

    return F.struct(channel(5.0).alias("r"), channel(3.0).alias("g"), channel(1.0).alias("b"))


def image_scaled(image: DataFrame, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """plane, y, x, v: every plane's image between two of its quantiles, clipped to [0, 1]."""
    ends = image.groupBy("plane").agg(F.percentile("v", F.array(F.lit(low), F.lit(high))).alias("_e"))
    s = F.try_divide(F.col("v") - F.col("_e")[0], F.col("_e")[1] - F.col("_e")[0])
    return image.join(ends, "plane").select("plane", "y", "x", F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0)).alias("v"))


def enhanced_mean(image: DataFrame, radius: int = 3) -> DataFrame:
    """plane, y, x, v: a mean image against its local mean and deviation, scaled to [0, 1].

    The older pipeline's normaliser is an external one; this is its documented intent.
    """
    size = 4 * radius + 1
    h = size // 2
    a = Window.partitionBy("plane", "y").orderBy("x").rowsBetween(-h, h)
    b = Window.partitionBy("plane", "x").orderBy("y").rowsBetween(-h, h)
    x = image.withColumn("_q", F.col("v") * F.col("v")).withColumn("_m", F.avg("v").over(a)).withColumn("_s", F.avg("_q").over(a)).withColumn("_m", F.avg("_m").over(b)).withColumn("_s", F.avg("_s").over(b))
    z = (F.col("v") - F.col("_m")) / (F.sqrt(F.greatest(F.col("_s") - F.col("_m") * F.col("_m"), F.lit(0.0))) + 1e-6)
    return image_scaled(x.select("plane", "y", "x", z.alias("v")))


def segmentation_image(mean: DataFrame, largest: DataFrame, kind: str = "log_ratio") -> DataFrame:
    """plane, y, x, v: what a segmenter looks at: log of largest over mean, mean, or largest."""
    if kind not in ("log_ratio", "mean", "largest"):
        raise ValueError(f"unknown image {kind!r}")
    x = mean.join(largest.withColumnRenamed("v", "_top"), ["plane", "y", "x"])
    floor = F.greatest(F.lit(1e-3), F.col("v"))
    v = {"log_ratio": F.log(F.greatest(F.lit(1e-3), F.col("_top") / floor)), "mean": F.col("v"), "largest": F.col("_top")}[kind]
    return x.select("plane", "y", "x", v.alias("v"))


def segmented(images: DataFrame, segmenter, height: int, width: int) -> DataFrame:
    """plane, y, x, label from ``segmenter``, a function from an image to a label image; a group a plane."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        image = np.zeros((height, width))
        image[pdf["y"], pdf["x"]] = pdf["v"]
        labels = segmenter(image)
        y, x = np.nonzero(labels)
        return pd.DataFrame({"plane": pdf["plane"].iloc[0], "y": y.astype("int32"), "x": x.astype("int32"), "label": labels[y, x].astype("int64")})

    return images.groupBy("plane").applyInPandas(run, f"plane {dict(images.dtypes)['plane']}, y int, x int, label long")


def threshold_segmenter(share: float = 0.9):
    """A plain stand-in for a trained network: four-connected parts above a quantile. ``labels.labelled`` does the same in tiles."""
    return lambda image: numbered_parts(image > np.quantile(image, share))


def patches(image: DataFrame, centres: DataFrame, half: int) -> DataFrame:
    """roi, py, px, v: the 2*half square of an image (y, x, v) around each centre (roi, y, x), zeros outside.

    Pixels are handed to the centres by an equality join on cells of the patch size.
    """
    size = 2 * half
    cell = lambda c: F.floor(c / size)
    c = centres.select("roi", F.col("y").alias("cy"), F.col("x").alias("cx"))
    near = c.select("*", F.explode(F.sequence(cell(F.col("cy") - half), cell(F.col("cy") + half - 1))).alias("by")).select("*", F.explode(F.sequence(cell(F.col("cx") - half), cell(F.col("cx") + half - 1))).alias("bx"))
    p = image.select("y", "x", "v", cell(F.col("y")).alias("by"), cell(F.col("x")).alias("bx"))
    hit = near.join(p, ["by", "bx"]).select("roi", (F.col("y") - F.col("cy") + half).cast("int").alias("py"), (F.col("x") - F.col("cx") + half).cast("int").alias("px"), "v").where((F.col("py") >= 0) & (F.col("py") < size) & (F.col("px") >= 0) & (F.col("px") < size))
    grid = c.select("roi", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("py")).select("roi", "py", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("px"))
    return grid.join(hit, ["roi", "py", "px"], "left").select("roi", "py", "px", F.coalesce("v", F.lit(0.0)).alias("v"))


def circles(regions: DataFrame, points: int = 100) -> DataFrame:
    """roi, k, y, x: whole-number points of a circle of 1.25 radii around each region (roi, y, x, radius)."""
    angle = F.col("k") * (2 * math.pi / (points - 1))
    x = regions.select("roi", "y", "x", "radius", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("k"))
    return x.select("roi", "k", (F.col("radius") * 1.25 * F.cos(angle) + F.col("y")).cast("int").alias("y"), (F.col("radius") * 1.25 * F.sin(angle) + F.col("x")).cast("int").alias("x"))


def pixel_distances(masks: DataFrame, pairs: DataFrame, distinct: bool = False) -> DataFrame:
    """a, b, distance: mean distance between all pixels of two regions, for given pairs (merge candidates).

    Regions of the same pixels but for their place are one kind, and the distance of two kinds follows from how far
    apart they lie: a task looks it up, made once from the differences of their pixels. Kinds and places, a row a region,
    go to every worker and a pair travels as two numbers, without a shuffle if the pairs are said to be
    ``distinct``; no row a pair of pixels is made. Beyond MASK_PIXELS the relational form is used instead.
    """
    pairs = pairs.select("a", "b") if distinct else pairs.select("a", "b").distinct()
    own = masks.select("roi", F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x"))
    shapes = own.groupBy("roi").agg(F.min("y").alias("y0"), F.min("x").alias("x0"), F.collect_list(F.struct("y", "x")).alias("p"))
    shapes = materialize(shapes.select("roi", "y0", "x0", F.array_sort(F.transform("p", lambda p: F.struct((p["y"] - F.col("y0")).alias("y"), (p["x"] - F.col("x0")).alias("x")))).alias("p")), "region-kinds")
    kinds = materialize(shapes.select("p").distinct().withColumn("kind", F.monotonically_increasing_id()), "kinds")
    if shapes.count() + (kinds.agg(F.sum(F.size("p"))).first()[0] or 0) > MASK_PIXELS:
        a, b = own.select(F.col("roi").alias("a"), F.col("y").alias("ya"), F.col("x").alias("xa")), own.select(F.col("roi").alias("b"), F.col("y").alias("yb"), F.col("x").alias("xb"))
        d = F.sqrt(F.pow(F.col("ya") - F.col("yb"), 2) + F.pow(F.col("xa") - F.col("xb"), 2))
        return pairs.join(a, "a").join(b, "b").groupBy("a", "b").agg(F.avg(d).alias("distance"))
    held = shapes.join(kinds, "p").select("roi", "kind", "y0", "x0").toPandas().sort_values("roi")
    pixels = {r["kind"]: np.array(r["p"], float).reshape(-1, 2) for r in kinds.collect()}
    numbers, kind = np.unique(held["kind"], return_inverse=True)
    sent = masks.sparkSession.sparkContext.broadcast((held["roi"].to_numpy(), kind, held["y0"].to_numpy(), held["x0"].to_numpy(), [pixels[k] for k in numbers]))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rois, kind, y, x, pixels = sent.value
        high, across = (int(v.max() - v.min()) if len(v) else 0 for v in (y, x))
        shape = len(pixels), len(pixels), 2 * high + 1, 2 * across + 1
        whole = bool((y == np.floor(y)).all() and (x == np.floor(x)).all()) and math.prod(shape) <= DISTANCES_HELD
        known = np.full(math.prod(shape), np.nan) if whole else None
        for pdf in it:
            if not len(rois):
                continue
            at = [np.minimum(np.searchsorted(rois, pdf[c]), len(rois) - 1) for c in "ab"]
            there = np.flatnonzero((rois[at[0]] == pdf["a"]) & (rois[at[1]] == pdf["b"]))
            i, j = at[0][there], at[1][there]
            dy, dx = y[j] - y[i], x[j] - x[i]
            if known is None:
                mean = _kind_distances(pixels, kind[i], kind[j], dy, dx)
            else:
                place = np.ravel_multi_index((kind[i], kind[j], dy.astype(int) + high, dx.astype(int) + across), shape)
                mean = known[place]
                missing = np.flatnonzero(np.isnan(mean))
                if len(missing):
                    new, first = np.unique(place[missing], return_index=True)
                    k = missing[first]
                    known[new] = _kind_distances(pixels, kind[i[k]], kind[j[k]], dy[k], dx[k])
                    mean = known[place]
            yield pd.DataFrame({"a": rois[i], "b": rois[j], "distance": mean})

    types = dict(pairs.dtypes)
    return pairs.mapInPandas(run, f"a {types['a']}, b {types['b']}, distance double")


def _kind_distances(pixels: list[np.ndarray], a: np.ndarray, b: np.ndarray, dy: np.ndarray, dx: np.ndarray) -> np.ndarray:
    """Mean distances of pixels of kinds a and b, of which b lies dy, dx further."""
    mean = np.empty(len(a))
    code = a.astype(np.int64) * len(pixels) + b
    order = np.argsort(code, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(code[order])) + 1) if len(a) else []:
        p, q = pixels[a[rows[0]]], pixels[b[rows[0]]]
        steps, times = np.unique((q[None] - p[:, None]).reshape(-1, 2), axis=0, return_counts=True)
        most = max(1, DISTANCES_AT_A_TIME // len(steps))
        for part in (rows[c : c + most] for c in range(0, len(rows), most)):
            mean[part] = np.hypot(dy[part, None] + steps[:, 0], dx[part, None] + steps[:, 1]) @ times / times.sum()
    return mean


def merged_traces(traces: DataFrame, groups: DataFrame) -> DataFrame:
    """roi (the group), frame, f, fneu: means of the members of every group (roi, group)."""
    return traces.join(groups, "roi").groupBy(F.col("group").alias("roi"), "frame").agg(F.avg("f").alias("f"), F.avg("fneu").alias("fneu"))


def with_default_labels(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """stats with iscell and prob; regions without a label are cells of probability one."""
    l = labels.select("roi", F.col("iscell").alias("_c"), F.col("prob").alias("_p"))
    return stats.join(l, "roi", "left").withColumn("iscell", F.coalesce("_c", F.lit(True))).withColumn("prob", F.coalesce("_p", F.lit(1.0))).drop("_c", "_p")


def with_values(regions: DataFrame, values: DataFrame, name: str = "value") -> DataFrame:
    """``regions`` (a row a region, with roi) with a vector of the user's, rows (at, v): the at-th value goes to the at-th region by number, from 0."""
    numbered = regions.withColumn("_at", F.row_number().over(Window.orderBy("roi")) - 1)
    if regions.count() != values.count():
        raise ValueError("a vector has as many values as there are regions")
    return numbered.join(values.select(F.col("at").alias("_at"), F.col("v").alias(name)), "_at", "left").drop("_at")


def sorted_activity(binned: DataFrame, neighbours: int = 3) -> DataFrame:
    """roi, rank, bin, v: clipped z-scores smoothed over neighbours in the order of the first component.

    The matrix of one view (regions by bins) is one group.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot(index="roi", columns="bin", values="v").sort_index().fillna(0.0)
        x = m.to_numpy()
        z = np.clip((x - x.mean(1, keepdims=True)) / np.maximum(x.std(1, keepdims=True), 1e-10), -4, 8)
        u = np.linalg.svd(z - z.mean(0), full_matrices=False)[0][:, 0]
        u = u * (1 if u[np.abs(u).argmax()] > 0 else -1)
        order = np.argsort(u, kind="stable")
        z = z[order]
        padded = np.pad(z, ((neighbours, neighbours), (0, 0)), mode="edge")
        smooth = np.stack([padded[k : k + 2 * neighbours + 1].mean(0) for k in range(len(z))])
        roi, bins = m.index.to_numpy()[order], m.columns.to_numpy()
        return pd.DataFrame({"roi": np.repeat(roi, len(bins)), "rank": np.repeat(np.arange(len(roi)), len(bins)), "bin": np.tile(bins, len(roi)), "v": smooth.ravel()})

    kinds = dict(binned.dtypes)
    return binned.select("roi", "bin", "v").groupBy(F.lit(0).alias("_view")).applyInPandas(run, f"roi {kinds['roi']}, rank long, bin {kinds['bin']}, v double")


# ---- benchmark movies


def strided(pixels: DataFrame, step: int = 2) -> DataFrame:
    """Every step-th line and column, renumbered."""
    x = pixels.where((F.col("y") % step == 0) & (F.col("x") % step == 0))
    return x.withColumn("y", F.expr(f"y div {step}").cast("int")).withColumn("x", F.expr(f"x div {step}").cast("int"))


def above_baseline(pixels: DataFrame, window: int) -> DataFrame:
    """v minus the rolling maximum of its rolling minimum in time, by pixel. pixels: plane, y, x, t, v."""
    low = rolling(pixels, ("plane", "y", "x"), "t", "v", window, False, "_low")
    return rolling(low, ("plane", "y", "x"), "t", "_low", window, True, "_high").withColumn("v", F.col("v") - F.col("_high")).drop("_low", "_high")


def projected(pixels: DataFrame, basis: np.ndarray, width: int) -> DataFrame:
    """plane, frame, k, w: every frame on a basis (images as rows); the basis is a small table joined on the pixel."""
    spark = pixels.sparkSession
    rows = [(k, int(i // width), int(i % width), float(b[i])) for k, b in enumerate(basis) for i in range(len(b))]
    table = spark.createDataFrame(rows, "k int, y int, x int, b double")
    return pixels.join(F.broadcast(table) if len(rows) <= 1_000_000 else table, ["y", "x"]).groupBy("plane", "frame", "k").agg(F.sum(F.col("v") * F.col("b")).alias("w"))


def nearest_ranked(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """a, b, rank: the k nearest regions (b, y, x) of every region (a, y, x).

    Regions meet in the nine cells of a grid around them; who has k neighbours within one
    cell's width is done, the others look again in cells twice as wide.
    """
    ends = b.agg(F.count(F.lit(1)).alias("n"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1")).first()
    span = a.agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1")).first()
    none = a.select("a").join(b.select("b"), F.lit(False)).withColumn("rank", F.lit(0))
    if not ends["n"] or span["y0"] is None:
        return none
    whole = float(max(max(ends["y1"], span["y1"]) - min(ends["y0"], span["y0"]), max(ends["x1"], span["x1"]) - min(ends["x0"], span["x0"]))) + 1
    size = max(whole / 2**20, math.sqrt(whole * whole * k / ends["n"]))
    cell = lambda c, n: F.floor(F.col(c) / F.lit(size)) + n
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    left, parts = a.select("a", F.col("y").alias("ya"), F.col("x").alias("xa")), []
    while True:
        there = b.select("b", F.col("y").alias("yb"), F.col("x").alias("xb"), cell("y", 0).alias("cy"), cell("x", 0).alias("cx"))
        near = left.withColumn("s", F.explode(around)).select("a", "ya", "xa", cell("ya", F.col("s.i")).alias("cy"), cell("xa", F.col("s.j")).alias("cx"))
        d = F.pow(F.col("ya") - F.col("yb"), 2) + F.pow(F.col("xa") - F.col("xb"), 2)
        met = near.join(there, ["cy", "cx"]).select("a", "b", d.alias("d"))
        ranked = met.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy("d", "b"))).where(F.col("rank") <= k)
        if size > whole:
            parts.append(ranked.select("a", "b", "rank"))
            break
        done = ranked.where((F.col("rank") == k) & (F.col("d") <= size * size)).select("a")
        parts.append(ranked.join(done, "a", "left_semi").select("a", "b", "rank"))
        left = left.join(done, "a", "left_anti")
        if left.isEmpty():
            break
        size *= 2
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---- frames across files


def located(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """frame, file, local: where a global frame lies. files: rank, file, n_frames. wanted: frame.

    Offsets are a running sum over one row a file; a frame finds its file by the last
    offset at or before it, in one ordered pass.
    """
    w = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    start = files.withColumn("start", F.coalesce(F.sum("n_frames").over(w), F.lit(0)))
    spans = start.where("n_frames > 0").select("file", "start", (F.col("start") + F.col("n_frames")).alias("stop"))
    size = 1000
    cut = spans.select("*", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("stop") - 1) / size))).alias("block"))
    return wanted.withColumn("block", F.floor(F.col("frame") / size)).join(cut, "block").where((F.col("frame") >= F.col("start")) & (F.col("frame") < F.col("stop"))).select("frame", "file", (F.col("frame") - F.col("start")).alias("local"))


def forward_filled(frames: DataFrame) -> DataFrame:
    """plane, frame, arr with frames that failed to decode (null) replaced by the one before. Only frame numbers are ordered; pixels meet them in a join."""
    w = Window.partitionBy("plane").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    keys = frames.select("plane", "frame", F.when(F.col("arr").isNotNull(), F.col("frame")).alias("known"))
    source = keys.select("plane", "frame", F.last("known", True).over(w).alias("source"))
    good = frames.where(F.col("arr").isNotNull()).select("plane", F.col("frame").alias("source"), "arr")
    return source.join(good, ["plane", "source"], "left").select("plane", "frame", "arr")
