"""Scan functions by format: files of a recording to pages, pages to planes and channels.

Formats whose files only a library opens (HDF5, NWB, ND2, SBX, DCIMG, AVI / MP4) are
read through an opener: a function from a local path to something with a length and
pages by number, called in the tasks. ``register`` adds formats of one's own.
"""

from __future__ import annotations

import importlib.util
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calspark.functions.strings import natural_key
from calspark.operators.movie import demux, ping_pong
from calspark.sources import ranges
from calspark.sources.tiff import PAGES, narrow


@dataclass(frozen=True)
class Pages:
    """Pages of a file: their number, and a function from a number to an image."""

    count: int
    get: Callable[[int], np.ndarray]

    def __len__(self) -> int:
        return self.count

    def __getitem__(self, n: int) -> np.ndarray:
        return self.get(n)


def _stack(data) -> Pages:
    """Anything with a shape and indices whose last two axes are an image."""
    lead = tuple(data.shape[:-2])
    return Pages(int(np.prod(lead)), lambda n: np.asarray(data[np.unravel_index(n, lead)]))


def open_h5(path: str, key: str = "data") -> Pages:
    import h5py

    return _stack(h5py.File(path, "r")[key])


def open_nwb(path: str) -> Pages:
    """The first image series under acquisition."""
    import h5py

    for series in h5py.File(path, "r")["acquisition"].values():
        if "data" in series and series["data"].ndim >= 3:
            return _stack(series["data"])
    raise ValueError(f"{path} has no image series")


def open_nd2(path: str) -> Pages:
    import nd2

    f = nd2.ND2File(path)
    first = f.read_frame(0)
    channels = first.shape[0] if first.ndim == 3 else 1
    return Pages(f.attributes.sequenceCount * channels, lambda n: f.read_frame(n // channels).reshape(channels, *first.shape[-2:])[n % channels])


def open_sbx(path: str) -> Pages:
    from sbxreader import sbx_memmap

    return _stack(sbx_memmap(path))


def open_dcimg(path: str) -> Pages:
    import dcimg

    return _stack(dcimg.DCIMGFile(path))


def open_video(path: str) -> Pages:
    """Frames of a video as grey images; reading on is faster than jumping."""
    import cv2

    video, at = cv2.VideoCapture(path), [0]

    def get(n: int) -> np.ndarray:
        if at[0] != n:
            video.set(cv2.CAP_PROP_POS_FRAMES, n)
        fine, image = video.read()
        at[0] = n + 1
        if not fine:
            raise ValueError(f"{path}: frame {n} cannot be decoded")
        return cv2.cvtColor(image, cv2.COLOR_BGR2GRAY)

    return Pages(int(video.get(cv2.CAP_PROP_FRAME_COUNT)), get)


#: Format -> (file patterns, library or None, opener).
FORMATS: dict[str, tuple[tuple[str, ...], str | None, Callable[[str], Pages]]] = {
    "h5": (("*.h5", "*.hdf5", "*.mesc"), "h5py", open_h5), "nwb": (("*.nwb",), "h5py", open_nwb), "nd2": (("*.nd2",), "nd2", open_nd2),
    "sbx": (("*.sbx",), "sbxreader", open_sbx), "dcimg": (("*.dcimg",), "dcimg", open_dcimg), "movie": (("*.avi", "*.mp4"), "cv2", open_video),
}


def register(name: str, patterns: tuple[str, ...], opener: Callable[[str], Pages], library: str | None = None) -> None:
    """Make a format known: file patterns, and a function from a local path to its pages that tasks can call."""
    FORMATS[name] = (tuple(patterns), library, opener)


def _opened(patterns: tuple[str, ...], opener: Callable[[str], Pages]) -> Callable[[SparkSession, str], DataFrame]:
    def count(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for path in pdf["path"]:
                pages = opener(ranges.local(path))
                yield pd.DataFrame({"path": [path], "n": [len(pages)], "size": [pages[0].nbytes if len(pages) else 1]})

    def take(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for path, part in pdf.groupby("path", sort=False):
                pages = opener(ranges.local(path))
                for r in part.sort_values("first").itertuples():
                    for n in range(r.first, r.first + r.count):
                        image = narrow(np.asarray(pages[n]))
                        yield pd.DataFrame({"file": [path], "page": [n], "Ly": [image.shape[0]], "Lx": [image.shape[1]], "arr": [image.ravel()]})

    def read(spark: SparkSession, path: str | list[str]) -> DataFrame:
        from calspark.sources.raw import temporary_folder

        files = ranges.listing(spark, path, "{" + ",".join(patterns) + "}")
        folder = temporary_folder(spark, "page-counts")  # a row a file
        files.select("path").mapInPandas(count, "path string, n long, size long").write.parquet(folder)
        counts = spark.read.parquet(folder)
        size = counts.agg(F.max("size")).first()[0]
        if size is None:
            raise FileNotFoundError(f"no {' or '.join(patterns)} below {path}")
        return ranges.spans(counts.select("path", "n"), size).mapInPandas(take, PAGES)

    return read


def list_files(spark: SparkSession, paths: list[str], pattern: str, recursive: bool = False) -> DataFrame:
    """folder_rank, path, length of the matching files; natural order is by ``natural_key``."""
    parts = []
    for n, p in enumerate(paths):
        reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
        if recursive:
            reader = reader.option("recursiveFileLookup", "true")
        parts.append(reader.load(p).select(F.lit(n).alias("folder_rank"), "path", "length"))
    if not parts:
        raise FileNotFoundError("no folders were given")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates(["path"])


def numbered(pages: DataFrame, files: DataFrame) -> DataFrame:
    """pages (file, page, ...) with ``global_page``: the position over all files in natural order.

    Offsets come from one row a file, so pages are not sorted globally.
    """
    from pyspark.sql import Window

    per = pages.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    ranked = files.select("folder_rank", F.col("path").alias("file"), natural_key(F.col("path")).alias("_k")).join(per, "file")
    w = Window.orderBy("folder_rank", "_k").rowsBetween(Window.unboundedPreceding, -1)
    start = ranked.withColumn("start", F.coalesce(F.sum("n").over(w), F.lit(0))).select("file", "start")
    return pages.join(start, "file").withColumn("global_page", F.col("start") + F.col("page")).drop("start")


def demultiplexed(pages: DataFrame, n_planes: int, n_channels: int, up_and_down: bool = False, swap: bool = False) -> DataFrame:
    """pages with plane, channel and frame from ``global_page``."""
    x = pages.withColumnRenamed("page", "file_page").withColumnRenamed("global_page", "page")
    if up_and_down:
        x = ping_pong(x.withColumn("channel", (F.col("page") % n_channels).cast("int")).withColumn("page", F.expr(f"page div {n_channels}")), n_planes)
        return x.withColumn("frame", F.expr(f"page div {n_planes}"))
    if swap:
        return x.withColumns({"plane": (F.col("page") % n_planes).cast("int"), "channel": F.expr(f"cast((page div {n_planes}) % {n_channels} as int)"), "frame": F.expr(f"page div {n_planes * n_channels}")})
    return demux(x, n_planes, n_channels)


def reader(name: str) -> Callable[[SparkSession, str], DataFrame]:
    """The page reader of a format: (spark, path or paths) -> file, page, Ly, Lx, arr."""
    if name in ("tif", "tiff"):
        from calspark.sources.tiff import read_pages

        return read_pages
    if name in FORMATS:
        patterns, library, opener = FORMATS[name]
        if library and importlib.util.find_spec(library) is None:
            raise ImportError(f"reading {name} needs the library {library}, which is not installed")
        return _opened(patterns, opener)
    raise ValueError(f"unknown format {name!r}")


def raw_geometry(spark: SparkSession, xml_path: str) -> DataFrame:
    """width, height, planes, channels, flyback, frames of a RAW recording from its XML description."""
    x = spark.read.format("binaryFile").load(xml_path).select(F.col("content").cast("string").alias("xml"))
    at = lambda p: F.expr(f"xpath_int(xml, '{p}')")
    return x.select(
        at("//LSM/@pixelX").alias("width"), at("//LSM/@pixelY").alias("height"), F.greatest(at("//Streaming/@zFastEnable") * at("//ZStage/@steps"), F.lit(1)).alias("planes"),
        F.expr("greatest(size(xpath(xml, '//Wavelength')), 1)").alias("channels"), at("//Streaming/@flybackFrames").alias("flyback"), at("//Streaming/@frames").alias("frames"),
    )


def same_geometry(configs: DataFrame) -> DataFrame:
    """One row if all files agree; raises on use otherwise."""
    n = configs.groupBy(*configs.columns).agg(F.count(F.lit(1)).alias("files"))
    kinds = n.agg(F.count(F.lit(1)).alias("kinds"))
    return n.join(F.broadcast(kinds)).where(F.assert_true(F.col("kinds") == 1, "files of the recording differ in geometry").isNull()).drop("kinds")
