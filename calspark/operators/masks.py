"""Mask operators: overlap, weights, pairs, maps, merging, growth and neuropil rings.

A mask table has a row a pixel: roi, y, x, lam. Pairs of masks meet by equality
of the pixel in blocks of regions, so the work follows the number of overlapping pixels, not of pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIXEL = ("y", "x")
#: Pixels of a block of regions, times the number of blocks, and cells of the overlap matrix filled at a time.
PIXELS_A_BLOCK, CELLS_AT_A_TIME = 500_000, 2_000_000


def overlap_flags(masks: DataFrame) -> DataFrame:
    """overlap: the pixel belongs to two regions or more."""
    return masks.withColumn("overlap", F.count(F.lit(1)).over(Window.partitionBy(*PIXEL)) > 1)


def normalised(masks: DataFrame) -> DataFrame:
    """Weights of every region sum to one."""
    return masks.withColumn("lam", F.try_divide("lam", F.sum("lam").over(Window.partitionBy("roi"))))


def cell_masks(masks: DataFrame, allow_overlap: bool = False) -> DataFrame:
    """Masks for extraction: overlapping pixels dropped unless allowed, weights summing to one."""
    kept = masks if allow_overlap else overlap_flags(masks).where(~F.col("overlap")).drop("overlap")
    return normalised(kept)


def overlaps(masks: DataFrame, others: DataFrame | None = None, blocks: tuple[int, int] | None = None) -> DataFrame:
    """a, b, inter, dot, na, nb, sa, sb of every pair with a common pixel: common pixels, sum of products of weights, and of each region its pixels and sum of squared weights.

    Pairs a < b of one set, or of a region of ``masks`` and one of ``others``. Regions are rows
    with all their pixels, dealt to blocks; a task holds one block's pixels and reads another block
    past them, so that a pair is finished where it is made and no row a pixel and pair is shuffled.
    What travels is the masks, once for each block of the other side; there are about
    the root of the pixels over PIXELS_A_BLOCK, so that blocks grow as slowly as copies.
    """
    kind, within = dict(masks.dtypes)["roi"], others is None
    fields = ("pixel", "lam") if "lam" in masks.columns else ("pixel",)

    def deal(m: DataFrame) -> int:
        pixels = m.count()
        return max(1, math.ceil(math.sqrt(pixels / PIXELS_A_BLOCK)), math.ceil(pixels / (32 * PIXELS_A_BLOCK)))

    def held(m: DataFrame, own: str, n: int, other: str, k: int) -> DataFrame:
        pixel = F.shiftleft(F.col("y").cast("long"), 32) + F.col("x")
        x = m.where("roi is not null").select("roi", *([F.coalesce(F.col("lam").cast("double"), F.lit(0.0)).alias("lam")] if "lam" in fields else []), pixel.alias("pixel"))
        square = F.sum(F.col("lam") * F.col("lam")) if "lam" in fields else F.lit(0.0)
        x = x.groupBy("roi").agg(F.count(F.lit(1)).alias("n"), square.alias("s"), F.collect_list(F.struct(*fields)).alias("p"))
        x = x.select("roi", "n", "s", *[F.col(f"p.{c}").alias(c) for c in fields], F.pmod(F.xxhash64("roi"), F.lit(n)).cast("int").alias(own))
        return x.select("*", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias(other), F.lit(own == "block_b").alias("right"))

    na, nb = blocks or ((deal(masks),) * 2 if within else (deal(masks), deal(others)))
    both = held(masks, "block_a", na, "block_b", nb).unionByName(held(masks if within else others, "block_b", nb, "block_a", na))
    if within:
        both = both.where("block_a <= block_b")
    dealt = both.repartition("block_a", "block_b").sortWithinPartitions("block_a", "block_b", "right")

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block: _Block | None = None
        for pdf in it:
            if not len(pdf):
                continue
            keys = pdf[["block_a", "block_b", "right"]].to_numpy(int)
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(pdf)]
            for start, stop in zip(edges, edges[1:]):
                key = tuple(keys[start, :2])
                if block is None or block.key != key:
                    block = _Block(key, within)
                if keys[start, 2]:
                    yield from block.met(pdf.iloc[start:stop])
                else:
                    block.hold(pdf.iloc[start:stop])

    return dealt.mapInPandas(run, f"a {kind}, b {kind}, inter long, dot double, na long, nb long, sa double, sb double")


class _Block:
    """The pixels of a block of regions in order, which regions of another block are read past."""

    def __init__(self, key: tuple[int, int], within: bool) -> None:
        self.key, self.within, self.parts, self.ready = key, within, [], False

    def hold(self, pdf: pd.DataFrame) -> None:
        self.parts.append((pdf["roi"].to_numpy(), pdf["n"].to_numpy(), pdf["s"].to_numpy(), *_flat(pdf)))

    def _order(self) -> None:
        self.ready = True
        if not self.parts:
            return
        parts, self.parts = list(zip(*self.parts)), [()]
        self.roi, self.n, self.s = (np.concatenate(p) for p in parts[:3])
        pixel = np.concatenate(parts[3])
        order = np.argsort(pixel, kind="stable")
        self.row = np.repeat(np.arange(len(self.roi), dtype=np.int32), np.concatenate(parts[5]))[order]
        self.lam = np.concatenate(parts[4])[order] if parts[4][0] is not None else None
        pixel = pixel[order]
        del order
        first = np.flatnonzero(np.concatenate([[True], pixel[1:] != pixel[:-1]]))
        self.pixel, self.start = pixel[first], np.append(first, len(pixel))

    def met(self, pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if not self.ready:
            self._order()
        if not self.parts:
            return
        pixel, lam, size = _flat(pdf)
        place = np.searchsorted(self.pixel, pixel)
        place[place == len(self.pixel)] = 0
        count = np.where(self.pixel[place] == pixel, self.start[place + 1] - self.start[place], 0)
        row = np.repeat(np.arange(len(pdf)), size)
        # as many regions at a time as keep their matrix and their pairs small, one at least
        ends = np.cumsum(size)
        made = np.concatenate([[0], np.cumsum(count)])[np.concatenate([[0], ends])]
        most = max(1, CELLS_AT_A_TIME // len(self.roi))
        i = 0
        while i < len(pdf):
            j = min(i + most, max(i + 1, int(np.searchsorted(made, made[i] + CELLS_AT_A_TIME, "right")) - 1))
            at = slice(ends[i] - size[i], ends[j - 1])
            yield self._pairs(pdf.iloc[i:j], row[at] - i, place[at], count[at], lam[at] if lam is not None else None)
            i = j

    def _pairs(self, pdf: pd.DataFrame, row: np.ndarray, place: np.ndarray, count: np.ndarray, lam: np.ndarray | None) -> pd.DataFrame:
        entry = np.repeat(self.start[place] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        cell = np.repeat(row * len(self.roi), count) + self.row[entry]
        inter = np.bincount(cell, minlength=1)
        found = np.flatnonzero(inter)
        dot = np.bincount(cell, np.repeat(lam, count) * self.lam[entry], 1)[found] if lam is not None else np.zeros(len(found))
        i, j = found % len(self.roi), found // len(self.roi)
        a, b = self.roi[i], pdf["roi"].to_numpy()[j]
        out = pd.DataFrame({"a": a, "b": b, "inter": inter[found], "dot": dot, "na": self.n[i], "nb": pdf["n"].to_numpy()[j], "sa": self.s[i], "sb": pdf["s"].to_numpy()[j]})
        if not self.within:
            return out
        if self.key[0] == self.key[1]:
            return out[a < b]
        swapped = out.rename(columns={"a": "b", "b": "a", "na": "nb", "nb": "na", "sa": "sb", "sb": "sa"})[out.columns]
        return pd.concat([out[a < b], swapped[a > b]])


def _flat(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """(pixels, weights if there are any, pixels of each region)"""
    return np.concatenate(pdf["pixel"].to_numpy()), np.concatenate(pdf["lam"].to_numpy()) if "lam" in pdf else None, pdf["pixel"].map(len).to_numpy()


def _iou() -> Column:
    return F.col("inter") / (F.col("na") + F.col("nb") - F.col("inter"))


def iou_pairs(masks: DataFrame) -> DataFrame:
    """a, b, inter, iou of every pair a < b with a common pixel."""
    return overlaps(masks.select("roi", *PIXEL)).select("a", "b", "inter", _iou().alias("iou"))


def max_iou(masks: DataFrame) -> DataFrame:
    """roi, iou: the largest IoU with any other region; zero if it meets none."""
    pairs = iou_pairs(masks)
    best = pairs.select(F.explode(F.array("a", "b")).alias("roi"), "iou").groupBy("roi").agg(F.max("iou").alias("iou"))
    return masks.select("roi").distinct().join(best, "roi", "left").select("roi", F.coalesce("iou", F.lit(0.0)).alias("iou"))


def cosine_pairs(masks: DataFrame) -> DataFrame:
    """a, b, cosine of weighted masks."""
    return overlaps(masks).select("a", "b", (F.col("dot") / (F.sqrt("sa") * F.sqrt("sb"))).alias("cosine"))


def max_weight_map(masks: DataFrame) -> DataFrame:
    """y, x, lam, roi: the largest weight at each pixel and its first region."""
    return masks.groupBy(*PIXEL).agg(F.max("lam").alias("lam"), F.max_by("roi", F.struct("lam", -F.col("roi"))).alias("roi"))


def top_per_pixel(masks: DataFrame, n: int = 3) -> DataFrame:
    w = Window.partitionBy(*PIXEL).orderBy(F.col("lam").desc(), "roi")
    return masks.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def label_image(masks: DataFrame) -> DataFrame:
    """y, x, roi: the last region that has the pixel for itself."""
    return overlap_flags(masks).where(~F.col("overlap")).groupBy(*PIXEL).agg(F.max("roi").alias("roi"))


def label_masks(labels: DataFrame, weights: DataFrame) -> DataFrame:
    """Masks from a label image (y, x, label; zero is background) and an image of weights (y, x, v)."""
    return labels.where("label > 0").join(weights, list(PIXEL)).select((F.col("label") - 1).alias("roi"), "y", "x", F.col("v").alias("lam"))


def label_centres(labels: DataFrame) -> DataFrame:
    """label, y, x, diameter of every label."""
    from calspark.operators.rois import median_pixel

    size = labels.where("label > 0").groupBy("label").agg((2 * F.sqrt(F.count(F.lit(1)) / F.lit(np.pi))).alias("diameter"))
    centre = median_pixel(labels.where("label > 0").withColumn("ord", F.col("y") * 100_000 + F.col("x")).withColumnRenamed("label", "roi"))
    return centre.withColumnRenamed("roi", "label").join(size, "label")


def union_merged(masks: DataFrame, groups: DataFrame) -> DataFrame:
    """Masks of merged regions. groups: roi, group. Of a pixel of several members the first one's weight wins."""
    return masks.join(groups, "roi").groupBy("group", *PIXEL).agg(F.min_by("lam", "roi").alias("lam")).withColumnRenamed("group", "roi")


def greedy_overlap_filter(masks: DataFrame, most: float) -> DataFrame:
    """plane, roi kept when regions are visited last to first and dropped if more than ``most`` of their pixels are shared.

    The decision on a region depends on those dropped before it, so a plane is
    filtered in one group; planes go in parallel.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        flat = pdf["y"].to_numpy() * (pdf["x"].max() + 1) + pdf["x"].to_numpy()
        count = np.bincount(flat)
        kept = []
        for roi, at in sorted(pdf.groupby("roi").indices.items(), reverse=True):
            pixels = flat[at]
            if (count[pixels] > 1).mean() <= most:
                kept.append(roi)
            else:
                count[pixels] -= 1
        return pd.DataFrame({"plane": pdf["plane"].iloc[0], "roi": sorted(kept)})

    kinds = dict(masks.dtypes)
    return masks.select("plane", "roi", F.col("y").cast("long"), F.col("x").cast("long")).groupBy("plane").applyInPandas(run, f"plane {kinds['plane']}, roi {kinds['roi']}")


def dilated(masks: DataFrame, height: int, width: int, times: int = 1) -> DataFrame:
    """roi, y, x grown by the four neighbours, clipped to the image."""
    out = masks.select("roi", *PIXEL).distinct()
    steps = F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))])
    for _ in range(times):
        moved = out.select("roi", "y", "x", F.explode(steps).alias("s")).select("roi", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"))
        out = moved.where((F.col("y") >= 0) & (F.col("y") < height) & (F.col("x") >= 0) & (F.col("x") < width)).distinct()
    return out


def spread9(masks: DataFrame, height: int, width: int) -> DataFrame:
    """Every pixel hands a third of its weight to the nine pixels around and under it; sums, clipped."""
    steps = F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    moved = masks.select("roi", "y", "x", "lam", F.explode(steps).alias("s")).select("roi", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"), (F.col("lam") / 3.0).alias("lam"))
    return moved.where((F.col("y") >= 0) & (F.col("y") < height) & (F.col("x") >= 0) & (F.col("x") < width)).groupBy("roi", "y", "x").agg(F.sum("lam").alias("lam"))


def connected_component(masks: DataFrame) -> DataFrame:
    """The pixels of every region that are four-connected to its heaviest pixel (the first one on ties).

    A region's pixels are few and together in one group; regions go in parallel.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "x"], kind="stable")
        seed = pdf["lam"].to_numpy().argmax()
        where = {p: n for n, p in enumerate(zip(pdf["y"], pdf["x"]))}
        seen, todo = {int(seed)}, [int(seed)]
        ys, xs = pdf["y"].to_numpy(), pdf["x"].to_numpy()
        while todo:
            n = todo.pop()
            for dy, dx in ((1, 0), (-1, 0), (0, 1), (0, -1)):
                m = where.get((ys[n] + dy, xs[n] + dx))
                if m is not None and m not in seen:
                    seen.add(m)
                    todo.append(m)
        return pdf.iloc[sorted(seen)]

    return masks.select("roi", "y", "x", "lam").groupBy("roi").applyInPandas(run, masks.select("roi", "y", "x", "lam").schema)


def outline(masks: DataFrame) -> DataFrame:
    """Pixels of a region that miss a four-neighbour of the same region."""
    near = masks.select("roi", F.explode(F.array(*[F.struct((F.col("y") + a).alias("y"), (F.col("x") + b).alias("x")) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1))])).alias("p")).select("roi", "p.y", "p.x")
    full = near.groupBy("roi", "y", "x").agg(F.count(F.lit(1)).alias("n")).where("n = 4")
    return masks.select("roi", "y", "x").join(full, ["roi", "y", "x"], "left_anti")


def _taken(cell_pixels: DataFrame, height: int, width: int) -> np.ndarray:
    """The cell pixels of one frame as an image: its bits, packed by one task, are all that reaches the driver."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        image = np.zeros((height, width), bool)
        image[pdf["y"], pdf["x"]] = True
        return pd.DataFrame({"bits": [np.packbits(image).tobytes()]})

    pixels = cell_pixels.select(F.col("y").cast("int"), F.col("x").cast("int")).distinct()
    found = pixels.withColumn("frame", F.lit(0)).groupBy("frame").applyInPandas(pack, "bits binary").collect()  # at most a row
    bits = np.frombuffer(found[0]["bits"], np.uint8) if found else np.zeros(-(-height * width // 8), np.uint8)
    return np.unpackbits(bits, count=height * width).reshape(height, width).astype(bool)


def _grown(shape: np.ndarray, times: int) -> np.ndarray:
    for _ in range(times):
        new = shape.copy()
        new[1:] |= shape[:-1]
        new[:-1] |= shape[1:]
        new[:, 1:] |= shape[:, :-1]
        new[:, :-1] |= shape[:, 1:]
        shape = new
    return shape


#: Most steps that surroundings grow.
STEPS = 100


def neuropil_rings(masks: DataFrame, cell_pixels: DataFrame, height: int, width: int, inner: int = 2, least: int = 350, extend: int = 5, circular: bool = False) -> DataFrame:
    """roi, y, x: the surroundings of every region without cell pixels and without a ring of ``inner`` pixels around it.

    The box around the ring grows by ``extend`` until it holds more than ``least`` free pixels
    beyond those of the ring, at most STEPS times. Free pixels are summed over the frame once, so a box is
    counted by four look-ups, and the number of steps is found by halving. With
    ``circular`` the dilated shape grows, in a cut of the frame that grows with it. The
    frame's bits go to every task; regions go in parallel.
    """
    free = ~_taken(cell_pixels, height, width)
    sums = np.zeros((height + 1, width + 1), np.int64)
    sums[1:, 1:] = free.cumsum(0).cumsum(1)
    sent = masks.sparkSession.sparkContext.broadcast((np.packbits(free), sums))  # one frame

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bits, sums = sent.value
        free = np.unpackbits(bits, count=height * width).reshape(height, width).astype(bool)
        ys, xs = pdf["y"].to_numpy(), pdf["x"].to_numpy()

        def cut(margin: int) -> tuple[slice, slice, np.ndarray]:
            rows = slice(max(0, int(ys.min()) - margin), min(height, int(ys.max()) + margin + 1))
            columns = slice(max(0, int(xs.min()) - margin), min(width, int(xs.max()) + margin + 1))
            shape = np.zeros((rows.stop - rows.start, columns.stop - columns.start), bool)
            shape[ys - rows.start, xs - columns.start] = True
            return rows, columns, _grown(shape, inner)

        rows, columns, ring = cut(inner)
        inside = int((ring & free[rows, columns]).sum())

        def box(k: int) -> tuple[int, int, int, int]:
            return max(0, rows.start - k * extend), min(height, rows.stop + k * extend), max(0, columns.start - k * extend), min(width, columns.stop + k * extend)

        def enough(k: int) -> bool:
            y0, y1, x0, x1 = box(k)
            return sums[y1, x1] - sums[y0, x1] - sums[y1, x0] + sums[y0, x0] - inside > least

        if least < 0:
            area = ring
        elif not circular:
            low, high = 1, STEPS
            while low < high:
                middle = (low + high) // 2
                low, high = (low, middle) if enough(middle) else (middle + 1, high)
            y0, y1, x0, x1 = box(low)
            area = np.ones((y1 - y0, x1 - x0), bool)
            narrow, rows, columns = (rows, columns, ring), slice(y0, y1), slice(x0, x1)
            ring = np.zeros_like(area)
            ring[narrow[0].start - y0 : narrow[0].stop - y0, narrow[1].start - x0 : narrow[1].stop - x0] = narrow[2]
        else:
            for most in (4, 16, STEPS):
                rows, columns, ring = cut(inner + most * extend)
                area, here = ring, free[rows, columns]
                for _ in range(most):
                    area = _grown(area, extend)
                    if (area & here).sum() - inside > least:
                        break
                else:
                    continue
                break
        y, x = np.nonzero(area & free[rows, columns] & ~ring)
        return pd.DataFrame({"roi": pdf["roi"].iloc[0], "y": (y + rows.start).astype("int32"), "x": (x + columns.start).astype("int32")})

    return masks.select("roi", "y", "x").groupBy("roi").applyInPandas(run, f"roi {dict(masks.dtypes)['roi']}, y int, x int")


def cell_pixels(masks: DataFrame, radius: float, percent: float, height: int, width: int) -> DataFrame:
    """y, x: pixels whose largest weight is positive and not below the local percentile of the map."""
    size = int(radius * 5)
    low, high = -(size // 2), size - size // 2 - 1
    peak = masks.groupBy("y", "x").agg(F.max("lam").alias("v"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        image = np.zeros((height, width))
        image[pdf["y"], pdf["x"]] = pdf["v"]
        if percent > 0 and size > 0:
            padded = np.pad(image, ((-low, high), (-low, high)), mode="symmetric")
            view = np.lib.stride_tricks.sliding_window_view(padded, (size, size)).reshape(height, width, -1)
            rank = min(int(size * size * percent / 100.0), size * size - 1)
            keep = (image >= np.partition(view, rank, axis=2)[:, :, rank]) & (image != 0)
        else:
            keep = image > 0
        y, x = np.nonzero(keep)
        return pd.DataFrame({"y": y.astype("int32"), "x": x.astype("int32")})

    return peak.withColumn("plane", F.lit(0)).groupBy("plane").applyInPandas(run, "y int, x int")


def with_drawn(masks: DataFrame, shapes: DataFrame, height: int, width: int) -> DataFrame:
    """roi, y, x, lam of the regions and of ellipses drawn by hand (k, cy, cx, ry, rx), numbered after them in the order of k, with even weights."""
    y = F.explode(F.sequence(F.greatest(F.lit(0), F.ceil(F.col("cy") - F.col("ry"))).cast("int"), F.least(F.lit(height - 1), F.floor(F.col("cy") + F.col("ry"))).cast("int"), F.lit(1)))
    x = F.explode(F.sequence(F.greatest(F.lit(0), F.ceil(F.col("cx") - F.col("rx"))).cast("int"), F.least(F.lit(width - 1), F.floor(F.col("cx") + F.col("rx"))).cast("int"), F.lit(1)))
    seen = shapes.where((F.col("cy") + F.col("ry") >= 0) & (F.col("cy") - F.col("ry") <= height - 1) & (F.col("cx") + F.col("rx") >= 0) & (F.col("cx") - F.col("rx") <= width - 1))
    pixels = seen.select("*", y.alias("y")).select("*", x.alias("x")).where(F.pow((F.col("y") - F.col("cy")) / F.col("ry"), 2) + F.pow((F.col("x") - F.col("cx")) / F.col("rx"), 2) <= 1)
    number = F.row_number().over(Window.orderBy("k"))  # a row a drawn shape
    last = masks.agg(F.coalesce(F.max("roi"), F.lit(-1)).cast("long").alias("last"))
    named = shapes.select("k", number.alias("n")).join(F.broadcast(last)).select("k", (F.col("last") + F.col("n")).alias("roi"))
    even = (1.0 / F.count(F.lit(1)).over(Window.partitionBy("roi"))).alias("lam")
    return masks.select("roi", "y", "x", "lam").unionByName(pixels.join(named, "k").select("roi", "y", "x", even))


def contrast(masks: DataFrame, rings: DataFrame, image: DataFrame) -> DataFrame:
    """roi, inside, outside, prob: weighted mean of a second channel in the region against the mean of its surroundings."""
    inside = normalised(masks).join(image, list(PIXEL)).groupBy("roi").agg(F.sum(F.col("lam") * F.col("v")).alias("inside"))
    outside = rings.join(image, list(PIXEL)).groupBy("roi").agg(F.avg("v").alias("outside"))
    both = inside.join(outside, "roi").withColumn("inside", F.greatest("inside", F.lit(1e-3)))
    return both.withColumn("prob", F.try_divide("inside", F.col("inside") + F.col("outside")))


def iou_between(masks: DataFrame, others: DataFrame) -> DataFrame:
    """roi, iou: the largest IoU of every region with any region of another set; zero if it meets none."""
    best = overlaps(masks.select("roi", *PIXEL), others.select("roi", *PIXEL)).groupBy(F.col("a").alias("roi")).agg(F.max(_iou()).alias("iou"))
    return masks.select("roi").distinct().join(best, "roi", "left").select("roi", F.coalesce("iou", F.lit(0.0)).alias("iou"))
