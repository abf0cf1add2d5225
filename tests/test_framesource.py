"""The frame format: what is written is read, filters drop blocks, a failed write leaves the old recording."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from calspark.sources import framesource
from calspark.sources.raw import unpacked


def recording(spark, planes=2, frames=100, size=12, seed=1):
    r = np.random.default_rng(seed)
    data = {(p, t): r.integers(-3000, 3000, size) for p in range(planes) for t in range(frames)}
    rows = [(p, 2 * t if p else t, v.tolist()) for (p, t), v in data.items()]
    return spark.createDataFrame(rows, "plane int, frame long, arr array<int>").repartition(3), {(p, f): v for p, f, v in rows}


def read_back(df):
    return {(r.plane, r.frame): list(r.arr) for r in unpacked(df, 3, 4).collect()}


def test_roundtrip_with_gaps_appended_and_replaced(spark, tmp_path):
    path = str(tmp_path / "rec")
    df, data = recording(spark)
    framesource.write_frames(df, path, 3, 4, block=16)
    assert read_back(framesource.read_frames(spark, path)) == data
    more, extra = recording(spark, planes=1, frames=5, seed=2)
    framesource.write_frames(more.withColumn("plane", F.lit(7)), path, 3, 4, mode="append")
    assert read_back(framesource.read_frames(spark, path)) == data | {(7, f): v for (_, f), v in extra.items()}
    framesource.write_frames(more, path, 3, 4)
    assert read_back(framesource.read_frames(spark, path)) == extra
    assert sum(n.endswith(".bin") for n in os.listdir(path)) == len({b["file"] for b in framesource._manifest(path)})


@pytest.mark.parametrize("condition", ["frame = 37", "plane = 1 and frame >= 40 and frame < 60", "frame in (3, 150)", "plane = 5", "frame > 20 or plane = 1", "frame % 7 = 0 and plane <= 0"])
def test_filters(spark, tmp_path, condition):
    path = str(tmp_path / "rec")
    df, data = recording(spark)
    framesource.write_frames(df, path, 3, 4, tasks=4, block=8)
    want = {(r.plane, r.frame) for r in df.where(condition).collect()}
    assert read_back(framesource.read_frames(spark, path).where(condition)) == {k: v for k, v in data.items() if k in want}


def test_ten_frames_are_a_constant_number_of_ranges(spark, tmp_path):
    for frames in (100, 1000):
        path = str(tmp_path / f"rec{frames}")
        framesource.write_frames(spark.range(frames).select(F.lit(0).alias("plane"), F.col("id").alias("frame"), F.array(*[F.col("id") % 100] * 12).alias("arr")), path, 3, 4, tasks=4, block=8)
        some = framesource.read_frames(spark, path).where("frame >= 40 and frame < 50")
        assert some.count() == 10 and some.rdd.getNumPartitions() <= 2
        blocks = framesource.FrameReader({"path": path})
        list(blocks.pushFilters([framesource.GreaterThanOrEqual(("frame",), 40), framesource.LessThan(("frame",), 50)]))
        assert sum(len(p.blocks) for p in blocks.partitions()) <= 3


def test_counting_reads_no_pixels(spark, tmp_path):
    path = str(tmp_path / "rec")
    df, data = recording(spark)
    framesource.write_frames(df, path, 3, 4)
    for name in os.listdir(path):
        if name.endswith(".bin"):
            os.truncate(os.path.join(path, name), 0)
    assert framesource.read_frames(spark, path, pixels=False).count() == len(data)


def test_a_failed_write_leaves_the_old_recording(spark, tmp_path):
    path = str(tmp_path / "rec")
    df, data = recording(spark)
    framesource.write_frames(df, path, 3, 4)
    before = sorted(os.listdir(path))
    other, _ = recording(spark, seed=5)
    broken = other.withColumn("arr", F.when((F.col("plane") == 1) & (F.col("frame") == 150), F.array(F.lit(1))).otherwise(F.col("arr")))
    with pytest.raises(Exception, match="pixels"):
        framesource.write_frames(broken, path, 3, 4)
    assert read_back(framesource.read_frames(spark, path)) == data and set(before) <= set(os.listdir(path))  # a task that is killed may leave a file that no manifest lists
