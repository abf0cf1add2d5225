"""NumPy array files: stacks of frames, one file a plane, read through binaryFile on the executors."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def encode(x: np.ndarray) -> bytes:
    buffer = io.BytesIO()
    np.save(buffer, x, allow_pickle=False)
    return buffer.getvalue()


def write_npy(frames: DataFrame, path: str, height: int, width: int, block: int = 500) -> None:
    """Blocks of frames of a plane as .npy payloads, one row a file: plane, first, content."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        stack = np.stack([np.asarray(a) for a in pdf["arr"]]).reshape(-1, height, width)
        return pd.DataFrame({"plane": [pdf["plane"].iloc[0]], "first": [pdf["frame"].iloc[0]], "frames": [pdf["frame"].tolist()], "content": [encode(stack)]})

    kinds = dict(frames.dtypes)
    keyed = frames.select("plane", "frame", "arr", F.expr(f"frame div {block}").alias("block"))
    keyed.groupBy("plane", "block").applyInPandas(run, f"plane {kinds['plane']}, first long, frames array<long>, content binary").write.mode("overwrite").parquet(path)


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """plane, frame, arr of what write_npy wrote."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for r in pdf.itertuples():
                stack = np.load(io.BytesIO(r.content), allow_pickle=False)
                yield pd.DataFrame({"plane": r.plane, "frame": list(r.frames), "arr": list(stack.reshape(len(stack), -1).astype("<i2"))})

    blobs = spark.read.parquet(path)
    return blobs.mapInPandas(run, f"plane {dict(blobs.dtypes)['plane']}, frame long, arr array<smallint>")


def read_npy_files(spark: SparkSession, path: str) -> DataFrame:
    """file, plane, frame, arr of .npy files of stacks; the plane is the last number of the name, else 0."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for r in pdf.itertuples():
                stack = np.load(io.BytesIO(r.content), allow_pickle=False)
                number = re.findall(r"\d+", r.path.rsplit("/", 1)[-1])
                yield pd.DataFrame({"file": r.path, "plane": int(number[-1]) if number else 0, "frame": np.arange(len(stack)), "arr": list(stack.reshape(len(stack), -1).astype(float))})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(run, "file string, plane int, frame long, arr array<double>")
