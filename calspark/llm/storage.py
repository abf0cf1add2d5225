"""Shared-folder storage for intermediate tables.

Intermediate results that are read more than once are written as Parquet below
``spark.checkpoint.dir``, which driver and executors share, so that a lost
executor costs nothing but its running tasks. Where the setting is absent (tests,
a plain local session) a folder is made and set for the session.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="calspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/calspark/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


#: Rows of a file of an intermediate table whose size is known beforehand.
ROWS_A_FILE = 500_000
#: Rows of an Arrow batch while a table is written: bounds the texts that an executor and its Python workers hold at a time.
ARROW_ROWS = 1_000


def materialize(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts the lineage.

    Of a table of at most ``rows`` rows, made by an aggregation or a join, no more files are
    written than hold ROWS_A_FILE each, so that a small table is not many files.
    """
    spark = df.sparkSession
    path, key = new_path(spark, name), "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(ARROW_ROWS, int(before)) if int(before) > 0 else ARROW_ROWS))
    try:
        (df if rows is None else df.coalesce(min(partitions(spark), -(-rows // ROWS_A_FILE) or 1))).write.parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system it is."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
