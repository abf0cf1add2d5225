"""Flat int16 movies: the engine's own frames as raw bytes, read by byte ranges.

A file holds frames of height x width little-endian int16 and nothing else, so its
number of frames follows from its size. The reader lists files, cuts each into ranges
of whole frames and reads a range a task.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from calspark.functions.strings import natural_key
from calspark.sources import ranges

CLAMP = 32766


def temporary_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir, or a local one in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="calspark-")
    return f"{root.rstrip('/')}/calspark-files/{name}-{uuid.uuid4().hex}"


def to_int16(x: np.ndarray) -> np.ndarray:
    return x if x.dtype == np.int16 else np.clip(x, -32768, CLAMP).astype("<i2")


def write_raw(frames: DataFrame, path: str, height: int, width: int) -> None:
    """plane, frame, arr to a folder of Parquet files with a frame's bytes a row, partitioned by plane.

    Frame blobs in Parquet keep distributed writes atomic and frames splittable;
    ``framesource.write_frames`` writes flat files.
    """

    def pack(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pd.DataFrame({"plane": pdf["plane"], "frame": pdf["frame"], "pix": [to_int16(np.asarray(a)).astype("<i2").tobytes() for a in pdf["arr"]]})

    kinds = dict(frames.dtypes)
    blobs = frames.select("plane", "frame", "arr").mapInPandas(pack, f"plane {kinds['plane']}, frame {kinds['frame']}, pix binary")
    blobs.select("plane", "frame", F.lit(height).alias("Ly"), F.lit(width).alias("Lx"), "pix").write.mode("overwrite").partitionBy("plane").parquet(path)


def read_raw(spark: SparkSession, path: str, height: int, width: int) -> DataFrame:
    """plane, frame, arr of what write_raw wrote."""
    return unpacked(spark.read.parquet(path), height, width)


def unpacked(blobs: DataFrame, height: int, width: int) -> DataFrame:
    """Frames as arrays from their bytes."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pd.DataFrame({"plane": pdf["plane"], "frame": pdf["frame"], "arr": [np.frombuffer(b, "<i2")[: height * width] for b in pdf["pix"]]})

    kinds = dict(blobs.dtypes)
    return blobs.select("plane", "frame", "pix").mapInPandas(run, f"plane {kinds['plane']}, frame {kinds['frame']}, arr array<smallint>")


def read_flat(spark: SparkSession, path: str | list[str], height: int, width: int, pattern: str = "*") -> DataFrame:
    """file, frame, pix of flat files in natural order, a range of frames a task; frame counts on over the files."""
    size = 2 * height * width
    files = ranges.listing(spark, path, pattern).withColumn("n", F.expr(f"length div {size}"))
    first = files.select("path").first()
    if first is None:
        raise FileNotFoundError(f"no files below {path}")
    w = Window.orderBy(natural_key(F.col("path")), "path").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    units = files.select("path", "n", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("start"))

    def cut(pdf: pd.DataFrame, read) -> Iterator[pd.DataFrame]:
        for r in pdf.itertuples():
            step = max(1, (8 << 20) // size)
            for at in range(r.first, r.first + r.count, step):
                n = min(step, r.first + r.count - at)
                block = read(r, at * size, n * size)
                yield pd.DataFrame({"file": r.path, "frame": np.arange(r.start + at, r.start + at + n), "pix": [block[k : k + size] for k in range(0, n * size, size)]})

    def by_range(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for path, part in pdf.groupby("path", sort=False):
                with ranges.open_at(path) as f:
                    yield from cut(part, lambda r, at, n: (f.seek(at), f.read(n))[1])

    def whole(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield from cut(pdf.assign(first=0, count=pdf["n"]), lambda r, at, n: r.content[at : at + n])

    schema = "file string, frame long, pix binary"
    if ranges.reachable(first["path"]):
        return ranges.spans(units, size).mapInPandas(by_range, schema)
    content = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")
    return content.join(units, "path").mapInPandas(whole, schema)


def raw_recording(spark: SparkSession, path: str, geometry: dict, pattern: str = "*.raw") -> DataFrame:
    """plane, channel, frame, pix of a RAW recording. geometry: width, height, planes, channels, flyback (of its XML).

    Channels alternate by page, planes by page of a channel; planes recorded while the
    objective flies back are left out.
    """
    channels, planes = geometry["channels"], geometry["planes"]
    recorded = planes + (geometry["flyback"] if planes > 1 else 0)
    flat = read_flat(spark, path, geometry["height"], geometry["width"], pattern).withColumnRenamed("frame", "page")
    x = flat.select(F.expr(f"cast((page div {channels}) % {recorded} as int)").alias("plane"), F.expr(f"cast(page % {channels} as int)").alias("channel"), F.expr(f"page div {channels * recorded}").alias("frame"), "pix")
    return x.where(F.col("plane") < planes)


def arrays(blobs: DataFrame, height: int, width: int) -> DataFrame:
    """plane, channel, frame, Ly, Lx, arr of blobs (plane, channel, frame, pix)."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pdf.drop(columns="pix").assign(Ly=height, Lx=width, arr=[np.frombuffer(b, "<i2") for b in pdf["pix"]])

    return blobs.select("plane", "channel", "frame", "pix").mapInPandas(run, "plane int, channel int, frame long, Ly int, Lx int, arr array<smallint>")


def sampled_mean(frames: DataFrame, width: int, n: int = 1000) -> DataFrame:
    """plane, y, x, v: mean of at most n equally spaced frames."""
    from calspark.operators.movie import exploded, summed_frames
    from calspark.operators.registration import sample_frames

    return exploded(summed_frames(sample_frames(frames, n), ["plane"]).withColumn("frame", F.lit(0)), width).drop("frame")
