"""Sparse pursuit over the tiles of a plane at once, with the regions of the search on the whole plane.

Every round each tile takes the peaks of its own core that are certain: within reach
nothing is higher, so no region that the search on the whole plane finds before could
touch them. What other tiles take in the same round lies beyond reach or is still seen as
a higher peak, which waits. Between rounds only regions travel, as weights, active
frames and projections, to the tiles that they touch; a tile's movie is rebuilt from its table and
the regions known so far. Order and number of a region are those of its value.

A task holds one tile with its margin, frames x (tile + 2 margin)^2 values and their
responses. The scale, and with it the thresholds, is taken once from the highest peaks of
all tiles of a plane. A region wider than ``radius`` would touch what its tile does not see: then the search
starts again with twice the radius, until everything is within reach.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from calspark.operators import pursuit
from calspark.operators.pursuit import Block, Region, SparseSettings
from calspark.sources.tables import materialize

#: Tiles begin at multiples of the coarsest map's pixel.
STEP = 2 ** (pursuit.SCALES - 1)
#: Pixels from a coarsest map's pixel to what its value depends on: from its centre, and from its edge.
FROM_CENTRE, FROM_EDGE = 3 * STEP // 2, 2 * STEP - 1
RADIUS = 24
PEAKS = 50


def reach_of(radius: int) -> int:
    """Beyond it two peaks whose regions stay within ``radius`` do not touch."""
    return radius + max(FROM_CENTRE, radius + 1)


def margin_of(radius: int, surround: int) -> int:
    """Pixels around a tile within which all that a certain peak depends on is right."""
    return -(-(reach_of(radius) + FROM_EDGE + surround // 2 + 1) // STEP) * STEP


def tiled(frames: DataFrame, height: int, width: int, tile: int, margin: int) -> DataFrame:
    """frames cut into overlapping tiles: plane, tile_y, tile_x, frame, arr."""
    ys, xs = range(0, height, tile), range(0, width, tile)

    def run(it):
        for pdf in it:
            for r in pdf.itertuples():
                image = np.asarray(r.arr, float).reshape(height, width)
                yield pd.DataFrame([(r.plane, y, x, r.frame, image[max(0, y - margin) : y + tile + margin, max(0, x - margin) : x + tile + margin].ravel()) for y in ys for x in xs], columns=["plane", "tile_y", "tile_x", "frame", "arr"])

    kinds = dict(frames.dtypes)
    return frames.select("plane", "frame", "arr").mapInPandas(run, f"plane {kinds['plane']}, tile_y int, tile_x int, frame {kinds['frame']}, arr array<double>")


def high_passed(x: np.ndarray, frames: int) -> np.ndarray:
    """A movie without the mean of every ``frames`` frames."""
    out = np.empty(x.shape)
    for a in range(0, len(x), frames):
        out[a : a + frames] = x[a : a + frames] - x[a : a + frames].mean(0)
    return out


class _Tile:
    """Where a tile and its margin lie, and its normalised movie."""

    def __init__(self, pdf: pd.DataFrame, height: int, width: int, tile: int, margin: int, highpass: int, surround: int):
        self.plane, self.y, self.x = pdf["plane"].iloc[0], int(pdf["tile_y"].iloc[0]), int(pdf["tile_x"].iloc[0])
        self.top, self.left = max(0, self.y - margin), max(0, self.x - margin)
        h, w = min(height, self.y + tile + margin) - self.top, min(width, self.x + tile + margin) - self.left
        pdf = pdf.sort_values("frame")
        self.work, self.sd = pursuit.normalised(high_passed(np.stack(pdf["arr"].to_numpy()).reshape(-1, h, w), highpass), surround)
        self.core = slice(self.y - self.top, min(height, self.y + tile) - self.top), slice(self.x - self.left, min(width, self.x + tile) - self.left)


REGION = "tile_y int, tile_x int, value double, scale int, y int, x int, top int, left int, height int, width int, lam array<double>, weight array<double>, active array<int>, proj array<double>, wide boolean"
NAMES = ["plane", *(f.split()[0] for f in REGION.split(", "))]


def _scales(tiles: DataFrame, height: int, width: int, tile: int, margin: int, highpass: int, settings: SparseSettings) -> dict:
    """plane -> (scale, frames): the scale is the most frequent one among the highest peaks of a plane."""

    def peaks(pdf: pd.DataFrame) -> pd.DataFrame:
        t = _Tile(pdf, height, width, tile, margin, highpass, settings.highpass_neuropil)
        h, w = t.work.shape[1:]
        stack = np.stack([np.repeat(np.repeat(r.max(0), 2**s, 0), 2**s, 1)[:h, :w] for s, r in enumerate(pursuit.pyramid(t.work))])
        y, x = pursuit.local_peaks(stack.max(0))
        own = (y >= t.core[0].start) & (y < t.core[0].stop) & (x >= t.core[1].start) & (x < t.core[1].stop)
        y, x = y[own], x[own]
        order = np.argsort(-stack.max(0)[y, x], kind="stable")[:PEAKS]
        y, x = y[order], x[order]
        return pd.DataFrame({"plane": t.plane, "frames": len(t.work), "value": np.append(stack.max(0)[y, x], -np.inf), "y": np.append(y + t.top, 0), "x": np.append(x + t.left, 0), "scale": np.append(stack.argmax(0)[y, x], -1)})

    kind = dict(tiles.dtypes)["plane"]
    found = tiles.groupBy("plane", "tile_y", "tile_x").applyInPandas(peaks, f"plane {kind}, frames int, value double, y int, x int, scale int")
    place = F.row_number().over(Window.partitionBy("plane").orderBy(F.desc("value"), "y", "x"))
    out: dict = {}
    for r in found.withColumn("n", place).where(F.col("n") <= PEAKS).select("plane", "frames", "scale").collect():  # PEAKS rows a plane
        out.setdefault(r["plane"], (r["frames"], []))[1].append(r["scale"])
    if settings.spatial_scale > 0:
        return {p: (int(np.clip(settings.spatial_scale, 1, pursuit.SCALES - 1)), n) for p, (n, _) in out.items()}
    return {p: (int(np.bincount([s for s in scales if s >= 0] or [1]).argmax()) or 1, n) for p, (n, scales) in out.items()}


def _spread(regions: DataFrame, height: int, width: int, tile: int, margin: int) -> DataFrame:
    """Regions to every tile that sees some of their box."""

    def seen(start, length, size: int):
        first = F.greatest(F.lit(0), F.floor((F.col(start) - margin) / tile))
        last = F.least(F.lit((size - 1) // tile), F.floor((F.col(start) + F.col(length) - 1 + margin) / tile))
        return F.sequence(first.cast("int"), last.cast("int"))

    out = regions.withColumn("tile_y", F.explode(seen("top", "height", height))).withColumn("tile_x", F.explode(seen("left", "width", width)))
    return out.withColumns({c: (F.col(c) * tile).cast("int") for c in ("tile_y", "tile_x")})


def _round(tiles: DataFrame, known: DataFrame, scales: dict, ended: dict, height: int, width: int, tile: int, radius: int, highpass: int, settings: SparseSettings) -> DataFrame:
    """The regions (REGION) of all peaks that are certain after those known; one without lam marks a peak that ends its plane's search."""
    margin, reach = margin_of(radius, settings.highpass_neuropil), reach_of(radius)

    def step(movie: pd.DataFrame, regions: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(movie):
            t = _Tile(movie, height, width, tile, margin, highpass, settings.highpass_neuropil)
            scale, frames = scales[t.plane]
            threshold, stop = pursuit.thresholds(settings, scale, frames)
            block = Block(t.work, threshold, settings)
            for r in regions.sort_values(["value", "scale", "y", "x"], ascending=[False, True, True, True]).itertuples():
                box = slice(r.top - t.top, r.top - t.top + r.height), slice(r.left - t.left, r.left - t.left + r.width)
                block.remove(Region(r.value, r.scale, r.y, r.x, box, np.asarray(r.lam).reshape(r.height, r.width), np.asarray(r.active), np.asarray(r.proj)))
            stop = max(stop, np.nextafter(ended.get(t.plane, -np.inf), np.inf))
            while places := block.certain(stop, reach, t.core):
                for place in places:
                    found, (y, x) = block.take(*place), block.centre(*place[1:])
                    if found is None:
                        rows.append((t.plane, t.y, t.x, place[0], place[1], y + t.top, x + t.left, 0, 0, 0, 0, None, None, None, None, False))
                        stop = max(stop, np.nextafter(place[0], np.inf))
                        continue
                    h, w = found.lam.shape
                    weight = (found.lam * t.sd[found.box]).ravel()
                    rows.append((t.plane, t.y, t.x, found.value, found.scale, y + t.top, x + t.left, found.box[0].start + t.top, found.box[1].start + t.left, h, w, found.lam.ravel(), weight, found.active, found.proj, found.radius > radius))
        return pd.DataFrame(rows, columns=NAMES)

    keys = ["plane", "tile_y", "tile_x"]
    there = _spread(known, height, width, tile, margin)
    return tiles.groupBy(*keys).cogroup(there.groupBy(*keys)).applyInPandas(step, f"plane {dict(tiles.dtypes)['plane']}, {REGION}")


def parallel_pursuit(frames: DataFrame, height: int, width: int, settings: SparseSettings = SparseSettings(), highpass: int = 100, tile: int = 128, radius: int = RADIUS) -> DataFrame:
    """plane, roi, y, x, lam, scale of every region of every plane. frames: plane, frame (bin), arr."""
    if tile % STEP:
        raise ValueError(f"tiles are multiples of {STEP} pixels")
    kind = dict(frames.dtypes)["plane"]
    while True:
        margin = margin_of(radius, settings.highpass_neuropil)
        whole = reach_of(radius) >= max(height, width)  # then one peak of a plane is certain at a time
        tiles = materialize(tiled(frames, height, width, tile, margin), "tiles")
        scales = _scales(tiles, height, width, tile, margin, highpass, settings)
        known, ended, wide = frames.sparkSession.createDataFrame([], f"plane {kind}, {REGION}"), {}, False
        while True:
            fresh = materialize(_round(tiles, known, scales, ended, height, width, tile, radius, highpass, settings), "regions")
            summary = fresh.agg(F.count(F.lit(1)).alias("n"), F.max("wide").alias("wide")).first()
            wide = wide or bool(summary["wide"])
            if not summary["n"] or wide and not whole:
                break
            for r in fresh.where("lam is null").groupBy("plane").agg(F.max("value").alias("value")).collect():  # a row a plane
                ended[r["plane"]] = max(ended.get(r["plane"], -np.inf), r["value"])
            known = known.unionByName(fresh.where("lam is not null"))
        if not wide or whole:
            break
        radius *= 2
    for plane, value in ended.items():
        known = known.where((F.col("plane") != F.lit(plane)) | (F.col("value") > value))
    place = F.row_number().over(Window.partitionBy("plane").orderBy(F.desc("value"), "scale", "y", "x")) - 1
    numbered = known.withColumn("roi", place.cast("long")).where(F.col("roi") < settings.max_rois)
    pixels = numbered.select("plane", "roi", "top", "left", "width", "scale", F.posexplode("weight").alias("at", "lam")).where("lam > 0")
    return pixels.select("plane", "roi", (F.col("top") + F.expr("at div width")).cast("int").alias("y"), (F.col("left") + F.col("at") % F.col("width")).cast("int").alias("x"), "lam", "scale")
