"""String helpers for file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def natural_key(name: Column) -> Column:
    """A key whose order is natural: runs of digits compare by value."""
    parts = F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 20, "0")).otherwise(p)), "")


def file_order(files: DataFrame) -> DataFrame:
    """files (path) with folder, rank (natural order within the folder) and first_in_folder."""
    folder = F.regexp_extract("path", r"^(.*/)[^/]*$", 1)
    w = Window.partitionBy("folder").orderBy(natural_key(F.col("path")), "path")
    x = files.select("path").distinct().withColumn("folder", folder)
    return x.withColumn("rank", F.row_number().over(w)).withColumn("first_in_folder", F.col("rank") == 1)


def trimmed_to(path: str, component: str) -> str:
    """A path up to its last folder of that name."""
    parts = path.replace("\\", "/").split("/")
    if component not in parts:
        raise FileNotFoundError(f"{path} has no folder {component}")
    last = len(parts) - 1 - parts[::-1].index(component)
    return "/".join(parts[: last + 1])
