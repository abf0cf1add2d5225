"""Principal components of movies without a movie in one task.

A movie is cut to bands of rows, and every task streams the bands dealt to it: each adds
X X^T, frames by frames, to one matrix a plane, which is sent once a task in blocks of rows;
blocks are summed, and a plane's sum is decomposed. A second narrow pass over the bands
projects them on what was found. What grows with the frames is the matrix, frames^2, which
is why movies are binned or sampled before; the number of pixels only adds bands.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from calspark.sources.tables import materialize

#: Rows of pixels of a band, and frames of a block of the matrix.
ROWS, BLOCK = 16, 128

#: (movie of a band as frames x (rows + 2 halo) x width) to frames x rows x width.
Prepare = Callable[[np.ndarray], np.ndarray]


def centred(movie: np.ndarray) -> np.ndarray:
    return movie - movie.mean(0)


def bands(frames: DataFrame, height: int, width: int, halo: int = 0, rows: int = ROWS) -> DataFrame:
    """plane, band, frame, arr: the rows of every band with ``halo`` rows around it, wrapped at the edges; written."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            if not len(pdf):
                continue
            x = np.stack(pdf["arr"].to_numpy()).reshape(len(pdf), height, width)
            for band, y in enumerate(range(0, height, rows)):
                cut = x[:, np.arange(y - halo, min(height, y + rows) + halo) % height]
                yield pd.DataFrame({"plane": pdf["plane"], "band": np.int32(band), "frame": pdf["frame"], "arr": list(cut.reshape(len(x), -1))})

    kinds = dict(frames.dtypes)
    cut = frames.select("plane", "frame", F.col("arr").cast("array<double>").alias("arr")).mapInPandas(run, f"plane {kinds['plane']}, band int, frame {kinds['frame']}, arr array<double>")
    return materialize(cut, "bands")


def _movies(it: Iterator[pd.DataFrame], width: int, halo: int) -> Iterator[tuple]:
    """(plane, movie with its halo) of every band of a stream sorted by plane, band and frame."""
    held: list[pd.DataFrame] = []

    def movie() -> tuple:
        arr = np.concatenate([np.stack(p["arr"].to_numpy()) for p in held])
        return held[0]["plane"].iloc[0], arr.reshape(len(arr), -1, width)

    for pdf in it:
        if not len(pdf):
            continue
        key = pdf[["plane", "band"]].to_numpy()
        edges = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(pdf)]
        for a, b in zip(edges, edges[1:]):
            part = pdf.iloc[a:b]
            if held and (held[-1]["plane"].iloc[0], held[-1]["band"].iloc[0]) != (part["plane"].iloc[0], part["band"].iloc[0]):
                yield movie()
                held = []
            held.append(part)
    if held:
        yield movie()


def gram(cut: DataFrame, width: int, halo: int, prepare: Prepare) -> DataFrame:
    """plane, i, g: blocks of BLOCK rows, as bytes of doubles, of the sum of X X^T over the bands of every plane."""
    kind = dict(cut.dtypes)["plane"]

    def partial(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict = {}
        for plane, movie in _movies(it, width, halo):
            x = prepare(movie).reshape(len(movie), -1)
            if plane in total:
                total[plane] += x @ x.T
            else:
                total[plane] = x @ x.T
        for plane, g in total.items():
            for i in range(0, len(g), BLOCK):
                yield pd.DataFrame({"plane": [plane], "i": [np.int32(i // BLOCK)], "g": [g[i : i + BLOCK].tobytes()]})

    def summed(pdf: pd.DataFrame) -> pd.DataFrame:
        g = sum(np.frombuffer(b) for b in pdf["g"])
        return pd.DataFrame({"plane": [pdf["plane"].iloc[0]], "i": [pdf["i"].iloc[0]], "g": [g.tobytes()]})

    dealt = cut.repartition("plane", "band").sortWithinPartitions("plane", "band", "frame")
    parts = dealt.mapInPandas(partial, f"plane {kind}, i int, g binary")
    return parts.groupBy("plane", "i").applyInPandas(summed, f"plane {kind}, i int, g binary")


def leading(matrix: DataFrame, k: int) -> DataFrame:
    """plane, pc, value, vector of the k largest eigenvalues of every plane's matrix; a vector's largest entry is positive."""
    kind = dict(matrix.dtypes)["plane"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g = np.concatenate([np.frombuffer(b) for b in pdf.sort_values("i")["g"]])
        n = int(round(np.sqrt(len(g))))
        values, vectors = np.linalg.eigh(g.reshape(n, n))
        rows = []
        for pc in range(min(k, n)):
            v = vectors[:, -1 - pc]
            rows.append((pdf["plane"].iloc[0], pc, values[-1 - pc], v * (1 if v[np.abs(v).argmax()] > 0 else -1)))
        return pd.DataFrame(rows, columns=["plane", "pc", "value", "vector"])

    return matrix.groupBy("plane").applyInPandas(run, f"plane {kind}, pc int, value double, vector array<double>")


def projected(cut: DataFrame, vectors: DataFrame, width: int, prepare: Prepare, use: Callable, schema: str) -> DataFrame:
    """The second pass: ``use(X, vectors, movie)`` gives rows of ``schema`` (names and types beside plane and band) for every band.

    X is frames x pixels of the prepared band, vectors components x frames, movie the band with its halo.
    """
    kind = dict(cut.dtypes)["plane"]
    names = ["plane", "band", *(f.split()[0] for f in schema.split(", "))]

    def run(movie: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if not len(movie) or not len(found):
            return pd.DataFrame([], columns=names)
        arr = np.stack(movie.sort_values("frame")["arr"].to_numpy())
        x = prepare(arr.reshape(len(arr), -1, width)).reshape(len(arr), -1)
        plane, band = movie["plane"].iloc[0], movie["band"].iloc[0]
        rows = use(x, np.stack(found.sort_values("pc")["vector"].to_numpy()), arr.reshape(len(arr), -1, width))
        return pd.DataFrame([(plane, band, *row) for row in rows], columns=names)

    own = cut.select(F.col("plane").alias("plane"), F.col("band").alias("band")).distinct()  # columns of their own beside those of cut
    there = own.join(vectors, "plane")  # frames x components for every band
    keys = ["plane", "band"]
    return cut.groupBy(*keys).cogroup(there.groupBy(*keys)).applyInPandas(run, f"plane {kind}, band int, {schema}")


def assembled(parts: DataFrame, *keys: str) -> DataFrame:
    """The arrays of the bands of every key as one image."""
    ordered = F.array_sort(F.collect_list(F.struct("band", "arr")))
    return parts.groupBy(*keys).agg(F.flatten(F.transform(ordered, lambda s: s["arr"])).alias("arr"))


def spatial_components(frames: DataFrame, height: int, width: int, k: int, prepare: Prepare = centred, halo: int = 0, rows: int = ROWS) -> DataFrame:
    """plane, pc, value, arr: images u^T X of the k leading components of every plane."""
    cut = bands(frames, height, width, halo, rows)
    vectors = materialize(leading(gram(cut, width, halo, prepare), k), "components")
    parts = projected(cut, vectors, width, prepare, lambda x, v, _: enumerate(list(v @ x)), "pc int, arr array<double>")
    return assembled(parts, "plane", "pc").join(vectors.select("plane", "pc", "value"), ["plane", "pc"])


def low_high_frames(frames: DataFrame, height: int, width: int, components: int, n: int, rows: int = ROWS) -> DataFrame:
    """plane, pc, side, arr: mean of the n frames with the lowest and highest weight on each principal component, without the mean of all.

    Planes of more frames than pixels are decomposed by pixels, so that nothing grows with the square of their frames.
    """
    if (frames.groupBy("plane").count().agg(F.max("count")).first()[0] or 0) > height * width:
        return _low_high_by_pixels(frames, height * width, components, n)

    def means(x: np.ndarray, vectors: np.ndarray, _: np.ndarray):
        for pc, v in enumerate(vectors):
            order = np.argsort(v, kind="stable")
            yield pc, "low", x[order[:n]].mean(0)
            yield pc, "high", x[order[-n:]].mean(0)

    cut = bands(frames, height, width, 0, rows)
    vectors = materialize(leading(gram(cut, width, 0, centred), components), "components")
    return assembled(projected(cut, vectors, width, centred, means, "pc int, side string, arr array<double>"), "plane", "pc", "side")


def covariance(frames: DataFrame, pixels: int) -> DataFrame:
    """plane, n, mean, i, g: blocks of rows, as bytes of doubles, of the sum of (x - mean)(x - mean)^T over the frames of every plane.

    A task adds up the frames it has; a plane's sums travel once a task.
    """
    kind = dict(frames.dtypes)["plane"]

    def partial(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict = {}
        for pdf in it:
            for plane, part in pdf.groupby("plane"):
                x = np.stack(part["arr"].to_numpy()).astype(float)
                n, s, g = total.get(plane, (0, 0.0, 0.0))
                total[plane] = n + len(x), s + x.sum(0), g + x.T @ x
        for plane, (n, s, g) in total.items():
            for i in range(0, pixels, BLOCK):
                yield pd.DataFrame({"plane": [plane], "i": [np.int32(i // BLOCK)], "n": [n], "s": [s.tobytes()], "g": [g[i : i + BLOCK].tobytes()]})

    def summed(pdf: pd.DataFrame) -> pd.DataFrame:
        n, s, g = pdf["n"].sum(), sum(np.frombuffer(b) for b in pdf["s"]), sum(np.frombuffer(b) for b in pdf["g"])
        i = pdf["i"].iloc[0]
        g = g.reshape(-1, pixels) - np.outer(s[i * BLOCK : (i + 1) * BLOCK], s) / n
        return pd.DataFrame({"plane": [pdf["plane"].iloc[0]], "n": [n], "mean": [s / n], "i": [i], "g": [g.tobytes()]})

    parts = frames.select("plane", "arr").mapInPandas(partial, f"plane {kind}, i int, n long, s binary, g binary")
    return parts.groupBy("plane", "i").applyInPandas(summed, f"plane {kind}, n long, mean array<double>, i int, g binary")


def _low_high_by_pixels(frames: DataFrame, pixels: int, components: int, n: int) -> DataFrame:
    """The same as from frames by frames: a component's weight on a frame is the frame's product with its image."""
    kinds = dict(frames.dtypes)
    matrix = materialize(covariance(frames, pixels), "covariance")
    count = matrix.where("i = 0").select("plane", "n", "mean")
    images = leading(matrix.select("plane", "i", "g"), components).join(count, "plane").where(F.col("pc") < F.col("n"))
    found: dict = {}
    for r in images.orderBy("plane", "pc").collect():  # a few images a plane
        found.setdefault(r["plane"], (np.array(r["mean"]), []))[1].append(r["vector"])

    def weigh(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for plane, part in pdf.groupby("plane"):
                mean, vectors = found[plane]
                w = (np.stack(part["arr"].to_numpy()) - mean) @ np.array(vectors).T
                yield pd.DataFrame({"plane": plane, "frame": part["frame"].to_numpy(), "w": list(w)})

    w = frames.select("plane", "frame", "arr").mapInPandas(weigh, f"plane {kinds['plane']}, frame {kinds['frame']}, w array<double>")
    w = w.select("plane", "frame", F.posexplode("w").alias("pc", "w"))
    keys = ["plane", "pc"]
    # the largest weight is positive
    sign = w.groupBy(*keys).agg(F.when(F.max_by("w", F.struct(F.abs("w"), -F.col("frame"))) > 0, 1.0).otherwise(-1.0).alias("sign"))
    w = w.join(F.broadcast(sign), keys).select(*keys, "frame", (F.col("w") * F.col("sign")).alias("w"))

    def end(side: str, *order) -> DataFrame:
        return w.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("k") <= n).select(*keys, "frame", F.lit(side).alias("side"))

    chosen = end("low", F.col("w"), F.col("frame")).unionByName(end("high", F.col("w").desc(), F.col("frame").desc()))

    def mean(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        return pd.DataFrame({"plane": [first["plane"]], "pc": [first["pc"]], "side": [first["side"]], "arr": [np.stack(pdf["arr"].to_numpy()).mean(0) - found[first["plane"]][0]]})

    ends = frames.select("plane", "frame", F.col("arr").cast("array<double>").alias("arr")).join(F.broadcast(chosen), ["plane", "frame"])  # 2 n rows a component
    return ends.groupBy(*keys, "side").applyInPandas(mean, f"plane {kinds['plane']}, pc int, side string, arr array<double>")
