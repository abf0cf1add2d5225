"""Several planes on one canvas, and the combined tables of a recording."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def canvas(planes: DataFrame) -> DataFrame:
    """planes (plane, height, width) with dy, dx: a near-square grid of equal fields, row by row, in the order of plane."""
    n = planes.agg(F.count(F.lit(1)).alias("n"))
    across = F.ceil(F.sqrt(F.col("height") * F.col("width") * F.col("n")) / F.col("width"))
    x = planes.join(F.broadcast(n)).withColumn("across", across)
    return x.select("plane", "height", "width", (F.floor(F.col("plane") / F.col("across")) * F.col("height")).cast("int").alias("dy"), (F.col("plane") % F.col("across") * F.col("width")).cast("int").alias("dx"))


def mosaic_over_depth(fields: DataFrame, depths: int) -> DataFrame:
    """fields (field, dy, dx, height, width) repeated for every depth, each depth tiled by the whole mosaic's extent: plane, depth, field, dy, dx."""
    extent = fields.agg(F.max(F.col("dy") + F.col("height")).alias("h"), F.max(F.col("dx") + F.col("width")).alias("w"), F.count(F.lit(1)).alias("n"))
    across = F.ceil(F.sqrt(F.col("h") * F.col("w") * F.lit(depths)) / F.col("w"))
    x = fields.join(F.broadcast(extent)).withColumn("across", across).withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(depths - 1))))
    return x.select((F.col("depth") * F.col("n") + F.col("field")).alias("plane"), "depth", "field", (F.col("dy") + F.floor(F.col("depth") / F.col("across")) * F.col("h")).cast("int").alias("dy"), (F.col("dx") + F.col("depth") % F.col("across") * F.col("w")).cast("int").alias("dx"))


def combined_masks(masks: DataFrame, layout: DataFrame) -> DataFrame:
    """masks (plane, roi, y, x, lam) on the canvas; planes without a place (flyback) are left out."""
    return masks.join(layout.select("plane", "dy", "dx"), "plane").select("plane", "roi", (F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x"), "lam")


def combined_images(images: DataFrame, layout: DataFrame) -> DataFrame:
    return images.join(layout.select("plane", "dy", "dx"), "plane").select("plane", (F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x"), "v")


def canvas_size(layout: DataFrame) -> tuple[int, int]:
    """(height, width) of the canvas that holds every plane."""
    r = layout.agg(F.max(F.col("dy") + F.col("height")).alias("h"), F.max(F.col("dx") + F.col("width")).alias("w")).first()
    return int(r["h"]), int(r["w"])


def combined_frames(frames: DataFrame, layout: DataFrame) -> DataFrame:
    """frame, arr: the planes' frames of one number pasted on the canvas, zeros between them; later planes over earlier ones.

    frames: plane, frame, arr. Planes without a place are left out. Frames that a placed
    plane lacks fail: planes of one recording are as long as each other.
    """
    places = {r["plane"]: (r["dy"], r["dx"], r["height"], r["width"]) for r in layout.collect()}  # a row a plane
    height, width = canvas_size(layout)
    kinds = dict(frames.dtypes)
    value = kinds["arr"].removeprefix("array<").removesuffix(">")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) != len(places):
            raise ValueError(f"frame {pdf['frame'].iloc[0]} is there in {len(pdf)} of {len(places)} planes")
        out = np.zeros((height, width), np.asarray(pdf["arr"].iloc[0]).dtype)
        for r in pdf.sort_values("plane").itertuples():
            y, x, h, w = places[r.plane]
            out[y : y + h, x : x + w] = np.asarray(r.arr).reshape(h, w)
        return pd.DataFrame({"frame": [pdf["frame"].iloc[0]], "arr": [out.ravel()]})

    placed = frames.where(F.col("plane").isin(list(places))).select("plane", "frame", "arr")
    return placed.groupBy("frame").applyInPandas(run, f"frame {kinds['frame']}, arr array<{value}>")


def union_planes(parts: dict[int, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [p.withColumn("plane", F.lit(k)) for k, p in sorted(parts.items())])


def plane_configs(n_planes: int, fields: list[list[int]] | None, ignore: list[int], spark) -> DataFrame:
    """plane, field, lines: a row for every plane and field of view, without planes to ignore."""
    rows = [(p, f, lines) for p in range(n_planes) if p not in ignore for f, lines in enumerate(fields or [[]])]
    return spark.createDataFrame(rows, "plane int, field int, lines array<int>")
