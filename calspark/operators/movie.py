"""Movie operators on two representations: frames (an array or a blob a row) and pixels (a row a pixel).

The pixel form is relational: plane, frame, y, x, v. Temporal operators are windows by
pixel, spatial ones windows by frame and line, and projections aggregate with
partial sums. The frame form keeps pixels in an array and is used where no neighbour
in time is needed, so that nothing is exploded or shuffled.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from calspark.functions.columns import filtered, gaussian_taps

PIXEL = ("plane", "y", "x")
#: Sums of frames that a task holds before it hands them on.
HELD_IMAGES = 64


def exploded(frames: DataFrame, width: int = 8) -> DataFrame:
    """plane, frame, y, x, v: a row a pixel of array frames."""
    p = frames.select("plane", "frame", F.posexplode("arr").alias("i", "v"))
    return p.select("plane", "frame", F.expr(f"i div {width}").cast("int").alias("y"), F.expr(f"i % {width}").cast("int").alias("x"), "v")


# ---- scan: demultiplexing, crop, narrowing


def demux(pages: DataFrame, n_planes: int, n_channels: int) -> DataFrame:
    """plane, channel and frame of a page number: time slowest, then plane, then channel. No state between batches or files."""
    return pages.withColumns({
        "plane": F.expr(f"cast((page div {n_channels}) % {n_planes} as int)"), "channel": F.expr(f"cast(page % {n_channels} as int)"), "frame": F.expr(f"page div {n_planes * n_channels}"),
    })


def ping_pong(pages: DataFrame, n_planes: int) -> DataFrame:
    """plane of a page when the planes are visited up and down again."""
    r = F.col("page") % (2 * n_planes)
    return pages.withColumn("plane", F.when(r < n_planes, r).otherwise(2 * n_planes - 1 - r).cast("int"))


def narrowed(values, dtype: str):
    """Storage as int16: unsigned 16-bit and 32-bit input halved toward minus infinity, others clamped."""
    v = F.floor(values / 2) if dtype in ("uint16", "int32") else values
    return F.least(F.greatest(v, F.lit(-32768)), F.lit(32766)).cast("short")


def crop(pixels: DataFrame, y0: int, y1: int, x0: int, x1: int) -> DataFrame:
    kept = pixels.where((F.col("y") >= y0) & (F.col("y") < y1) & (F.col("x") >= x0) & (F.col("x") < x1))
    return kept.withColumn("y", F.col("y") - y0).withColumn("x", F.col("x") - x0)


def crop_frames(frames: DataFrame, width: int, y0: int, y1: int, x0: int, x1: int) -> DataFrame:
    """The same on array frames, without exploding them."""
    rows = F.transform(F.sequence(F.lit(y0), F.lit(y1 - 1)), lambda y: F.slice("arr", y * width + x0 + 1, x1 - x0))
    return frames.withColumn("arr", F.flatten(rows))


# ---- time: binning, high-pass, noise


def ranked(frames: DataFrame) -> DataFrame:
    """t: position of a frame in its plane."""
    return frames.withColumn("t", (F.row_number().over(Window.partitionBy("plane").orderBy("frame")) - 1).cast("long"))


def frame_bins(frames: DataFrame, size: int, batch: int = 500, bins: int = 5000) -> DataFrame:
    """plane, frame, batch, bin of the frames that are binned. frames: plane, frame, bad.

    Batches of ``batch`` frames (at most the good ones); evenly spaced batches if there
    would be more than ``bins`` bins; bad frames leave a batch that is more than half
    good; an incomplete last bin is dropped unless it is the batch's only one.
    """
    w = Window.partitionBy("plane")
    x = ranked(frames).withColumn("n", F.count(F.lit(1)).over(w)).withColumn("good", F.sum((~F.col("bad")).cast("long")).over(w))
    x = x.withColumn("size", F.greatest(F.least("good", F.lit(batch)), F.lit(1))).withColumn("batch", F.expr("t div size"))
    there = F.ceil(F.col("n") / F.col("size"))
    kept = F.least(F.greatest(F.expr(f"{bins} div greatest(size div {size}, 1)"), F.lit(1)), there)
    x = x.withColumn("there", there).withColumn("kept", kept)
    # linspace(0, there - 1, kept) truncated holds batch b
    step = F.when(F.col("kept") > 1, (F.col("there") - 1) / (F.col("kept") - 1)).otherwise(F.lit(0.0))
    near = F.when(step > 0, F.floor(F.col("batch") / step)).otherwise(F.lit(0).cast("long"))
    hits = [(k >= 0) & (k < F.col("kept")) & (F.floor(k * step) == F.col("batch")) for k in (near - 1, near, near + 1)]  # steps are one at least
    inner = hits[0] | hits[1] | hits[2]
    last = (F.col("kept") > 1) & (F.col("batch") == F.col("there") - 1)
    # the last of several is the last batch whatever the step rounds to, and no other batch takes its place
    short = (F.col("kept") > 1) & (F.floor((F.col("kept") - 1) * step) == F.col("batch")) & (F.floor((F.col("kept") - 2) * step) != F.col("batch"))
    x = x.where(last | inner & ~short).withColumn("share", F.avg((~F.col("bad")).cast("double")).over(Window.partitionBy("plane", "batch")))
    x = x.where((F.col("share") <= 0.5) | ~F.col("bad"))
    o = Window.partitionBy("plane", "batch").orderBy("frame")
    x = x.withColumn("k", F.row_number().over(o) - 1).withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("plane", "batch")))
    x = x.withColumn("bin", F.when(F.col("m") > size, F.expr(f"k div {size}")).otherwise(F.lit(0)).cast("long"))
    return x.where((F.col("m") <= size) | (F.col("bin") < F.expr(f"m div {size}"))).select("plane", "frame", "batch", "bin")


def binned(pixels: DataFrame, bins: DataFrame) -> DataFrame:
    """plane, batch, bin, y, x, v: mean of the frames of each bin (``bins`` from frame_bins)."""
    return pixels.join(bins, ["plane", "frame"]).groupBy("plane", "batch", "bin", "y", "x").agg(F.avg("v").alias("v"))


def mean_image(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy(*PIXEL).agg(F.avg("v").alias("v"))


def max_projection(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy(*PIXEL).agg(F.max("v").alias("v"))


def highpass_tumbling(pixels: DataFrame, width: int) -> DataFrame:
    """v minus the mean of its window; windows of ``width`` positions do not overlap. pixels: ..., t."""
    w = Window.partitionBy(*PIXEL, F.expr(f"t div {width}"))
    return pixels.withColumn("v", F.col("v") - F.avg("v").over(w))


def highpass_gaussian(pixels: DataFrame, width: float) -> DataFrame:
    """v minus its Gaussian smoothing in time (reflected ends)."""
    radius = int(4 * width + 0.5)
    return filtered(pixels, PIXEL, "t", "v", gaussian_taps(width, radius), "reflect", "_smooth").withColumn("v", F.col("v") - F.col("_smooth")).drop("_smooth")


def highpass(pixels: DataFrame, width: int) -> DataFrame:
    return highpass_gaussian(pixels, width) if width < 10 else highpass_tumbling(pixels, width)


def noise_std(pixels: DataFrame, batch: int) -> DataFrame:
    """plane, y, x, sd: root of the mean squared first difference over all positions; none is taken across batches."""
    w = Window.partitionBy(*PIXEL, F.expr(f"t div {batch}")).orderBy("t")
    x = pixels.withColumn("d", F.col("v") - F.lag("v").over(w))
    return x.groupBy(*PIXEL).agg(F.greatest(F.sqrt(F.coalesce(F.sum(F.col("d") * F.col("d")), F.lit(0.0)) / F.count(F.lit(1))), F.lit(1e-10)).alias("sd"))


def threshold_reduce(pixels: DataFrame, threshold: float) -> DataFrame:
    return pixels.groupBy(*PIXEL).agg(F.sqrt(F.sum(F.when(F.col("v") > threshold, F.col("v") * F.col("v")).otherwise(0.0))).alias("v"))


def summed_frames(frames: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, arr: number and pixel-wise mean of the array frames of every key.

    Every task adds up what it has before anything is shuffled, so a key costs one
    image a task, and pixels never become rows.
    """

    def add(it):
        totals: dict = {}
        for pdf in it:
            for key, part in pdf.groupby(keys, sort=False):
                s = np.stack(part["arr"].to_numpy()).astype(float).sum(0)
                old = totals.get(key)
                totals[key] = (len(part), s) if old is None else (old[0] + len(part), old[1] + s)
                if len(totals) >= HELD_IMAGES:
                    yield rows(totals)
                    totals = {}
        if totals:
            yield rows(totals)

    def rows(totals: dict) -> pd.DataFrame:
        out = pd.DataFrame(list(totals), columns=keys)
        return out.assign(n=[n for n, _ in totals.values()], arr=[a for _, a in totals.values()])

    def mean(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["n"].sum())
        return pdf.iloc[:1][keys].assign(n=n, arr=[np.stack(pdf["arr"].to_numpy()).sum(0) / n])

    kinds = dict(frames.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", n long, arr array<double>"
    return frames.select(*keys, "arr").mapInPandas(add, schema).groupBy(*keys).applyInPandas(mean, schema)


def binned_frames(frames: DataFrame, bins: DataFrame) -> DataFrame:
    """plane, batch, bin, arr: mean frames of each bin (``bins`` from frame_bins)."""
    return summed_frames(frames.join(bins, ["plane", "frame"]), ["plane", "batch", "bin"]).drop("n")


# ---- space: pooling, box and template filters, maxima, morphology


def downsample2(pixels: DataFrame, height: int, width: int, taper: bool = True) -> DataFrame:
    """Means of 2 x 2 pixels; what is left of an odd edge counts half if tapered."""
    x = pixels.groupBy("plane", "frame", F.expr("y div 2").cast("int").alias("y"), F.expr("x div 2").cast("int").alias("x")).agg(F.avg("v").alias("v"))
    if taper:
        edge = F.when(F.lit(height % 2 == 1) & (F.col("y") == height // 2), 0.5).otherwise(1.0) * F.when(F.lit(width % 2 == 1) & (F.col("x") == width // 2), 0.5).otherwise(1.0)
        x = x.withColumn("v", F.col("v") * edge)
    return x


def _box(size: int) -> tuple[int, int]:
    return -(size // 2), size - size // 2 - 1


def box_mean(pixels: DataFrame, size: int, out: str = "box") -> DataFrame:
    """Mean of the box around a pixel within the image: two one-dimensional windows."""
    low, high = _box(size)
    a = Window.partitionBy("plane", "frame", "y").orderBy("x").rowsBetween(low, high)
    b = Window.partitionBy("plane", "frame", "x").orderBy("y").rowsBetween(low, high)
    return pixels.withColumn("_row", F.avg("v").over(a)).withColumn(out, F.avg("_row").over(b)).drop("_row")


def neuropil_subtracted(pixels: DataFrame, size: int) -> DataFrame:
    return box_mean(pixels, size).withColumn("v", F.col("v") - F.col("box")).drop("box")


def square_filter(pixels: DataFrame, size: int) -> DataFrame:
    """size times the mean over the box with zeros outside."""
    low, high = _box(size)
    a = Window.partitionBy("plane", "frame", "y").orderBy("x").rowsBetween(low, high)
    b = Window.partitionBy("plane", "frame", "x").orderBy("y").rowsBetween(low, high)
    return pixels.withColumn("_row", F.sum("v").over(a)).withColumn("v", F.sum("_row").over(b) / float(size)).drop("_row")


def local_maxima(image: DataFrame, size: int) -> DataFrame:
    """Pixels of an image (plane, y, x, v) that are the largest of the box around them."""
    low, high = _box(size)
    a = Window.partitionBy("plane", "y").orderBy("x").rowsBetween(low, high)
    b = Window.partitionBy("plane", "x").orderBy("y").rowsBetween(low, high)
    return image.withColumn("_row", F.max("v").over(a)).withColumn("_top", F.max("_row").over(b)).where("v = _top").drop("_row", "_top")


def scale_mode(scales: DataFrame, top: int = 50, size: int = 11) -> DataFrame:
    """plane, scale: the most frequent best scale among the highest peaks. scales: plane, y, x, scale, v."""
    best = scales.groupBy(*PIXEL).agg(F.max("v").alias("v"), F.max_by("scale", F.struct("v", -F.col("scale"))).alias("scale"))
    peaks = local_maxima(best, size)
    w = Window.partitionBy("plane").orderBy(F.desc("v"), "y", "x")
    return peaks.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).groupBy("plane").agg(F.mode("scale", True).alias("scale"))


def _disk(radius: float) -> list[tuple[int, int]]:
    r = int(radius)
    return [(a, b) for a in range(-r, r + 1) for b in range(-r, r + 1) if a * a + b * b <= radius * radius]


def morph_open(image: DataFrame, radius: float) -> DataFrame:
    """Minimum, then maximum, over a disk; pixels outside the image do not take part. Neighbours meet by an equality join."""
    steps = F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in _disk(radius)])

    def reduced(x: DataFrame, how) -> DataFrame:
        spread = x.select("plane", "v", (F.explode(steps)).alias("s"), "y", "x").select("plane", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"), "v")
        return spread.groupBy(*PIXEL).agg(how("v").alias("v")).join(x.select(*PIXEL), list(PIXEL), "left_semi")

    return reduced(reduced(image, F.min), F.max)


def correlation_map(pixels: DataFrame, sigma: float, height: int, width: int) -> DataFrame:
    """plane, y, x, v: energy of the smoothed frames over the smoothed energy of the frames (wrapped Gaussian, separable)."""
    radius = int(4 * sigma + 0.5)
    taps = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w).alias("w")) for k, w in gaussian_taps(sigma, radius)])

    def smooth(x: DataFrame, keys: list[str], axis: str, n: int, value: str) -> DataFrame:
        other = "x" if axis == "y" else "y"
        moved = x.select(*keys, other, F.col(axis).alias("_a"), value, F.explode(taps).alias("t"))
        return moved.groupBy(*keys, other, F.pmod(F.col("_a") + F.col("t.k"), F.lit(n)).cast("int").alias(axis)).agg(F.sum(F.col(value) * F.col("t.w")).alias(value))

    frames = smooth(smooth(pixels, ["plane", "frame"], "y", height, "v"), ["plane", "frame"], "x", width, "v")
    above = frames.groupBy(*PIXEL).agg(F.sum(F.col("v") * F.col("v")).alias("above"))
    energy = pixels.groupBy(*PIXEL).agg(F.sum(F.col("v") * F.col("v")).alias("v"))
    below = smooth(smooth(energy, ["plane"], "y", height, "v"), ["plane"], "x", width, "v").withColumnRenamed("v", "below")
    return above.join(below, list(PIXEL)).select(*PIXEL, F.try_divide("above", "below").alias("v"))


# ---- shifts


def rolled(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """Frames rolled by (-yoff, -xoff), circularly. pixels: ..., yoff, xoff."""
    return pixels.withColumn("y", F.pmod(F.col("y") - F.col("yoff"), F.lit(height)).cast("int")).withColumn("x", F.pmod(F.col("x") - F.col("xoff"), F.lit(width)).cast("int"))


def bidirectional_shift(pixels: DataFrame, k: int) -> DataFrame:
    """Odd lines shifted by k pixels; pixels that nothing moves to keep their values."""
    if k == 0:
        return pixels
    w = Window.partitionBy("plane", "frame", "y").orderBy("x")
    moved = F.lag("v", k).over(w) if k > 0 else F.lead("v", -k).over(w)
    return pixels.withColumn("v", F.when(F.col("y") % 2 == 1, F.coalesce(moved, F.col("v"))).otherwise(F.col("v")))


# ---- projections on a basis, blocks


def pca_denoised(frames: DataFrame, height: int, width: int, block: tuple[int, int], share: float) -> DataFrame:
    """plane, frame, arr rebuilt from the leading components of overlapping blocks, blended with tapered weights.

    Frames are cut to blocks where they are; a block's movie is one group; the blocks of
    a frame meet again by a partial sum.
    """
    from calspark.operators.registration import block_grid, taper

    blocks, _, size = block_grid(height, width, block)
    weight = taper(max(size) / 8, *size)
    k = max(1, int(min(size) * share))

    def cut(batches):
        for pdf in batches:
            x = np.stack(pdf["arr"].to_numpy()).reshape(-1, height, width) if len(pdf) else np.zeros((0, height, width))
            for b, (y0, y1, x0, x1) in enumerate(blocks):
                yield pd.DataFrame({"plane": pdf["plane"], "frame": pdf["frame"], "b": b, "arr": list(x[:, y0:y1, x0:x1].reshape(len(x), -1))})

    def rebuild(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["arr"].to_numpy())
        mean = x.mean(0)
        u, s, v = np.linalg.svd(x - mean, full_matrices=False)
        m = min(k, len(s))
        return pd.DataFrame({"plane": pdf["plane"].to_numpy(), "frame": pdf["frame"].to_numpy(), "b": pdf["b"].to_numpy(), "arr": list((u[:, :m] * s[:m]) @ v[:m] + mean)})

    def blend(pdf: pd.DataFrame) -> pd.DataFrame:
        top, below = np.zeros((height, width)), np.zeros((height, width))
        for r in pdf.itertuples():
            y0, y1, x0, x1 = blocks[r.b]
            top[y0:y1, x0:x1] += weight * np.asarray(r.arr).reshape(size)
            below[y0:y1, x0:x1] += weight
        return pd.DataFrame({"plane": [pdf["plane"].iloc[0]], "frame": [pdf["frame"].iloc[0]], "arr": [(top / below).ravel()]})

    kinds = dict(frames.dtypes)
    schema = f"plane {kinds['plane']}, frame {kinds['frame']}, b int, arr array<double>"
    parts = frames.select("plane", "frame", "arr").mapInPandas(cut, schema).groupBy("plane", "b").applyInPandas(rebuild, schema)
    return parts.groupBy("plane", "frame").applyInPandas(blend, f"plane {kinds['plane']}, frame {kinds['frame']}, arr array<double>")


def block_shares(length: int, blocks: int, sigma: float) -> np.ndarray:
    """[position, block]: the share of each block along one axis, blurred by a Gaussian with reflected ends; a position's shares sum to one."""
    edges = np.linspace(0, length, blocks + 1).astype(int)
    sharp = np.zeros((length, blocks))
    for b in range(blocks):
        sharp[edges[b] : edges[b + 1], b] = 1
    if sigma <= 0:
        return sharp
    soft = np.zeros_like(sharp)
    for k, weight in gaussian_taps(sigma, int(4 * sigma + 0.5)):
        at = (np.arange(length) + k) % (2 * length)
        soft += weight * sharp[np.where(at >= length, 2 * length - 1 - at, at)]
    return soft


def bleed_through(image1: DataFrame, image2: DataFrame, height: int, width: int, blocks: int = 3) -> DataFrame:
    """plane, y, x, v: the second channel without its regression on the first, not below zero.

    Slopes are those of blocks x blocks parts of the image, blended at every pixel by
    the parts' smoothed shares in it, so that they do not jump at the borders.
    """
    sigma = float(np.round((height + width) / (2 * blocks) * 0.25))
    spark = image1.sparkSession
    axis = lambda n, at, part, share: spark.createDataFrame([(k, b, float(v)) for k, row in enumerate(block_shares(n, blocks, sigma)) for b, v in enumerate(row) if v > 0], f"{at} int, {part} int, {share} double")
    rows, columns = axis(height, "y", "by", "gy"), axis(width, "x", "bx", "gx")
    edges = lambda n: np.linspace(0, n, blocks + 1).astype(int)[1:-1].tolist()
    part = lambda c, n: sum([(F.col(c) >= e).cast("int") for e in edges(n)], F.lit(0))
    both = image1.withColumnRenamed("v", "v1").join(image2.withColumnRenamed("v", "v2"), list(PIXEL))
    slope = F.try_divide(F.sum(F.col("v1") * F.col("v2")), F.sum(F.col("v1") * F.col("v1")))
    slopes = both.groupBy("plane", part("y", height).alias("by"), part("x", width).alias("bx")).agg(slope.alias("slope"))
    # tables of one image's size at most
    blended = slopes.join(F.broadcast(rows), "by").join(F.broadcast(columns), "bx").groupBy(*PIXEL).agg(F.sum(F.col("slope") * F.col("gy") * F.col("gx")).alias("slope"))
    return both.join(blended, list(PIXEL)).select(*PIXEL, F.greatest(F.lit(0.0), F.col("v2") - F.col("slope") * F.col("v1")).alias("v"))


def weighted_traces(pixels: DataFrame, masks: DataFrame) -> DataFrame:
    """plane, roi, frame, f: weighted sums over masks, by an equality join on the pixel."""
    return pixels.join(masks.select("roi", "y", "x", "lam"), ["y", "x"]).groupBy("plane", "roi", "frame").agg(F.sum(F.col("v") * F.col("lam")).alias("f"))
