"""Tables between the steps of one job, in the folder that driver and executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame

from calspark.sources.raw import temporary_folder


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once and reads it back: what is used twice is computed once, and a lost executor costs its running tasks."""
    path = temporary_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
