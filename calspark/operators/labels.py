"""Label images of planes of any size: parts above a level, labelled in tiles and joined across borders."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from calspark.sources.tables import materialize


def stars(edges: DataFrame) -> DataFrame:
    """(a, b) of every node a that is not the least of its component, b being the least, from edges (a, b).

    Large and small stars in turn: every node hands its larger neighbours, then its smaller
    ones, to the least of them, until nothing changes. A round is two aggregations and two joins.
    """

    def once(x: DataFrame) -> DataFrame:
        both = x.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(x.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        down = large.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
        lowest = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(lowest, "u")
        out = small.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(lowest.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return materialize(out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")

    def mark(x: DataFrame) -> tuple:
        return tuple(x.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = materialize(edges.where("a <> b").select("a", "b").distinct(), "stars")
    before = None
    while (seen := mark(now)) != before:
        now, before = once(now), seen
    return now


def numbered_parts(inside: np.ndarray) -> np.ndarray:
    """Four-connected parts, numbered from 1 in the order of their first pixel."""
    labels, n = np.zeros(inside.shape, np.int64), 0
    for start in zip(*np.nonzero(inside)):
        if labels[start]:
            continue
        n += 1
        todo = [start]
        while todo:
            y, x = todo.pop()
            if 0 <= y < inside.shape[0] and 0 <= x < inside.shape[1] and inside[y, x] and not labels[y, x]:
                labels[y, x] = n
                todo += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
    return labels


def labelled(images: DataFrame, share: float = 0.9, tile: int = 256) -> DataFrame:
    """plane, y, x, label: the four-connected parts of every plane (plane, y, x, v) above a quantile of its pixels.

    A tile is one task's. Labels that touch across a border are edges, their components the
    labels of the plane, numbered from 1 in the order of their first pixel, line by line.
    """
    level = images.groupBy("plane").agg(F.percentile("v", F.lit(share)).alias("level"))
    above = images.join(level, "plane").where("v > level").select("plane", F.col("y").cast("int"), F.col("x").cast("int"))
    above = above.withColumns({"ty": F.expr(f"y div {tile}").cast("int"), "tx": F.expr(f"x div {tile}").cast("int")})

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = pdf["ty"].iloc[0] * tile, pdf["tx"].iloc[0] * tile
        inside = np.zeros((tile, tile), bool)
        inside[pdf["y"] - y0, pdf["x"] - x0] = True
        return pdf.assign(part=numbered_parts(inside)[pdf["y"] - y0, pdf["x"] - x0])

    kind = dict(images.dtypes)["plane"]
    found = above.groupBy("plane", "ty", "tx").applyInPandas(run, f"plane {kind}, y int, x int, ty int, tx int, part long")
    # a part's number: its plane, tile and place there, by its first pixel
    first = F.min(F.struct("y", "x")).over(Window.partitionBy("plane", "ty", "tx", "part"))
    found = materialize(found.withColumn("first", first).select("plane", "y", "x", "ty", "tx", F.concat_ws(":", F.col("plane").cast("string"), F.lpad(F.col("first.y").cast("string"), 10, "0"), F.lpad(F.col("first.x").cast("string"), 10, "0")).alias("node")), "parts")
    edge = lambda dy, dx, at, c: found.where((F.col(at) + 1) % tile == 0).select("plane", (F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x"), F.col("node").alias("a"))
    over = edge(1, 0, "y", "ty").unionByName(edge(0, 1, "x", "tx"))
    touching = over.join(found.select("plane", "y", "x", F.col("node").alias("b")), ["plane", "y", "x"]).select("a", "b")
    roots = stars(touching)
    named = found.join(roots.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").withColumn("root", F.coalesce("root", "node"))
    parts = named.select("plane", "root").distinct()  # a row a part: few beside pixels
    order = F.row_number().over(Window.partitionBy("plane").orderBy("root"))
    return named.join(parts.withColumn("label", order.cast("long")), ["plane", "root"]).select("plane", "y", "x", "label")
