"""Files of a recording to tables of frames by plane and channel.

Pages of all files in natural order are numbered through, dealt to planes and channels
by their number, cut to fields of view, and written as one table a channel; nothing
depends on which task read a page.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from calspark.functions.strings import natural_key
from calspark.operators import movie
from calspark.settings import Recording
from calspark.sources import raw, readers, tiff


@dataclass(frozen=True)
class Converted:
    """frames, frames2 (or None): plane, frame, Ly, Lx, arr. means, means2: plane, y, x, v. shapes: plane -> (height, width)."""

    frames: DataFrame
    frames2: DataFrame | None
    means: DataFrame
    means2: DataFrame | None
    shapes: dict[int, tuple[int, int]]


def sources(record: Recording) -> list[str]:
    """What is read: the files named, else subfolders of the first folder, else the folders."""
    if not record.data_path and not record.file_list:
        raise FileNotFoundError("no folders were given")
    if record.file_list:
        root = f"{record.data_path[0].rstrip('/')}/" if record.data_path else ""
        return [f if "/" in f else root + f for f in record.file_list]
    if record.subfolders:
        return [f"{record.data_path[0].rstrip('/')}/{s}" for s in record.subfolders]
    return list(record.data_path)


def _pages(spark: SparkSession, record: Recording) -> tuple[DataFrame, DataFrame]:
    """(pages, files with their number of pages and the rank of what they were found by)."""
    paths = sources(record)
    path = raw.temporary_folder(spark, "pages")  # decoded once, read twice
    readers.reader("tif" if record.input_format == "ome" else record.input_format)(spark, paths).write.parquet(path)
    pages = spark.read.parquet(path)
    per = pages.groupBy("file").agg(F.count(F.lit(1)).alias("n"))  # a row a file
    rank = F.lit(len(paths))
    for n in reversed(range(len(paths))):
        rank = F.when(F.col("file").contains(paths[n].removeprefix("file:").replace("//", "/")), n).otherwise(rank)
    return pages, per.withColumn("rank", rank)


def placed(spark: SparkSession, record: Recording) -> DataFrame:
    """plane, channel, frame, Ly, Lx, arr of every page."""
    pages, files = _pages(spark, record)
    order = Window.orderBy("rank", natural_key(F.col("file")), "file")
    if record.input_format == "ome":  # a file holds one plane of one channel, planes by the order of files
        named = files.select(F.col("file").alias("path"), F.row_number().over(order).alias("rank"))
        dealt = tiff.bruker_planes(named, record.nplanes, record.bruker_bidirectional)
        inside = Window.partitionBy("channel", "plane").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
        dealt = dealt.join(files.select(F.col("file").alias("path"), "n"), "path").withColumn("start", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        x = pages.join(F.broadcast(dealt.select(F.col("path").alias("file"), "channel", "plane", "start")), "file")
        return x.select("plane", (F.col("channel") - 1).alias("channel"), (F.col("start") + F.col("page")).alias("frame"), "Ly", "Lx", "arr")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    start = files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    x = pages.join(F.broadcast(start), "file").withColumn("global_page", F.col("start") + F.col("page"))  # a row a file
    return readers.demultiplexed(x, record.nplanes, record.nchannels, record.bruker_bidirectional, record.swap_order).select("plane", "channel", "frame", "Ly", "Lx", "arr")


def in_fields(frames: DataFrame, lines: list[list[int]]) -> DataFrame:
    """Frames cut to the lines of every field of view; a plane's fields become planes of their own."""
    fields = F.array(*[F.struct(F.lit(n).alias("field"), F.array(*[F.lit(int(y)) for y in own]).alias("lines")) for n, own in enumerate(lines)])
    x = frames.withColumn("f", F.explode(fields))
    cut = F.flatten(F.transform(F.col("f.lines"), lambda y: F.slice(F.col("arr"), y * F.col("Lx") + 1, F.col("Lx"))))
    return x.select((F.col("plane") * len(lines) + F.col("f.field")).alias("plane"), "channel", "frame", F.size("f.lines").alias("Ly"), "Lx", cut.alias("arr"))


def convert(spark: SparkSession, record: Recording, out: str) -> Converted:
    """Tables of the recording's frames below ``out``; the functional channel is the first table."""
    if record.input_format == "raw":
        folder = record.data_path[0]
        g = readers.same_geometry(readers.raw_geometry(spark, f"{folder}/*.xml")).first().asDict()
        blobs = raw.raw_recording(spark, record.data_path, g)
        x = raw.arrays(blobs, g["height"], g["width"])
    else:
        x = placed(spark, record)
    if record.ignore_flyback:
        x = x.where(~F.col("plane").isin(*record.ignore_flyback))
    if record.lines:
        x = in_fields(x, record.lines)
    x.write.mode("overwrite").partitionBy("channel").parquet(f"{out}/pages")
    x = spark.read.parquet(f"{out}/pages").withColumn("plane", F.col("plane").cast("int"))
    shapes = {r["plane"]: (r["Ly"], r["Lx"]) for r in x.select("plane", "Ly", "Lx").distinct().collect()}  # a row a plane
    first = record.functional_chan - 1 if record.nchannels > 1 else 0
    one, two = x.where(F.col("channel") == first).drop("channel"), x.where(F.col("channel") != first).drop("channel")
    second = None if two.isEmpty() else two
    return Converted(one, second, mean_images(one, shapes), second and mean_images(second, shapes), shapes)


def mean_images(frames: DataFrame, shapes: dict[int, tuple[int, int]]) -> DataFrame:
    """plane, y, x, v: the mean of every plane's frames."""
    sums = movie.summed_frames(frames.select("plane", "frame", "arr"), ["plane"])
    wide = sums.join(F.broadcast(frames.sparkSession.createDataFrame([(p, w) for p, (_, w) in shapes.items()], "plane int, Lx int")), "plane")
    return wide.select("plane", "Lx", F.posexplode("arr").alias("i", "v")).select("plane", F.expr("cast(i div Lx as int)").alias("y"), F.expr("cast(i % Lx as int)").alias("x"), "v")
