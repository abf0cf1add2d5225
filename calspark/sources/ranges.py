"""Random access to files by path, in the worker that needs the bytes.

File systems are those that pyarrow opens by URI (local, S3, GCS, HDFS where its library
is installed). Readers that cut files into ranges ask ``reachable`` first and take
whole files through Spark's own readers where a path is not.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that a task reads.
RANGE_BYTES = 64 << 20


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """(file system, path in it) of a path as Spark gives it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def open_at(path: str) -> pa.NativeFile:
    system, inner = file_system(path)
    return system.open_input_file(inner)


def reachable(path: str) -> bool:
    try:
        open_at(path).close()
    except (OSError, ValueError, NotImplementedError):  # no such scheme here, or no library for it
        return False
    return True


def put(path: str, content: bytes) -> None:
    """Write a file whole: under a name of its own first, then moved, so that a task that runs twice leaves one."""
    system, inner = file_system(path)
    system.create_dir(inner.rpartition("/")[0], recursive=True)
    part = f"{inner}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(part) as out:
        out.write(content)
    system.move(part, inner)


def listing(spark: SparkSession, path: str | list[str], pattern: str = "*", recursive: bool = True) -> DataFrame:
    """path, length of the files below a path, without their contents."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    return reader.load(path).select("path", "length")


def spans(units: DataFrame, size: int) -> DataFrame:
    """path, first, count: ranges of about RANGE_BYTES of units of ``size`` bytes, dealt to a task each. units: path, n."""
    step = max(1, RANGE_BYTES // max(1, size))
    cut = units.where("n > 0").withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(step).cast("long"))))
    cut = cut.withColumn("count", F.least(F.lit(step).cast("long"), F.col("n") - F.col("first"))).drop("n")
    total = units.agg(F.sum(F.ceil(F.col("n") / step))).first()[0] or 1
    return cut.repartition(int(min(total, 1 << 15)), "path", "first")


def local(path: str) -> str:
    """The path that a library opens itself."""
    system, inner = file_system(path)
    if not isinstance(system, fs.LocalFileSystem):
        raise ValueError(f"{path}: its reader opens local or mounted files only")
    return inner
