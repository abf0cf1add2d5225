"""Streams of frames: registration to a fixed reference, binning with late frames, running means, online spikes.

A recording in progress is a file stream of frame blocks. Registration is stateless;
binning is an event-time window with a watermark; deconvolution keeps each region's
open pools as state.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from calspark.operators import registration

FRAMES = "plane int, frame long, ts timestamp, arr array<double>"
TRACE = "roi long, frame long, v double"


def frame_stream(spark: SparkSession, path: str, files: int = 4) -> DataFrame:
    """New Parquet blocks of frames as they are written."""
    return spark.readStream.schema(FRAMES).option("maxFilesPerTrigger", files).parquet(path)


def registered(frames: DataFrame, reference: np.ndarray, settings: registration.RigidSettings = registration.RigidSettings()) -> DataFrame:
    """plane, frame, ts, arr, yoff, xoff of a stream against one reference."""
    height, width = reference.shape

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kernel = registration.Rigid(reference, settings)
        for pdf in it:
            if len(pdf):
                x = np.stack(pdf["arr"].to_numpy()).reshape(-1, height, width)
                y, z, _ = kernel.shifts(x)
                moved = registration.rolled(x, y, z).reshape(len(x), -1)
                yield pd.DataFrame({"plane": pdf["plane"].to_numpy(), "frame": pdf["frame"].to_numpy(), "ts": pdf["ts"].to_numpy(), "arr": list(moved), "yoff": y.astype("int32"), "xoff": z.astype("int32")})

    return frames.mapInPandas(run, FRAMES + ", yoff int, xoff int")


def windowed_means(traces: DataFrame, width: str, late: str) -> DataFrame:
    """roi, window, v: event-time means of a stream (roi, ts, v); rows later than ``late`` are left out."""
    return traces.withWatermark("ts", late).groupBy("roi", F.window("ts", width)).agg(F.avg("v").alias("v"))


def online_spikes(traces: DataFrame, tau: float = 1.0, fs: float = 10.0, hold: int = 100, idle: str = "30 seconds") -> DataFrame:
    """roi, frame, spk of a stream of traces: a frame's spike is given out ``hold`` frames later, when its pools are settled.

    The state of a region is its open pools, at most ``hold`` frames of them: pools
    that start earlier are closed, which bounds the state. Rows are taken in the order of
    frames: those of one trigger are sorted, and a frame that comes after a later one was
    taken is left out. A region that is silent for ``idle`` (processing time) is
    finished: its last frames are given out and its state goes.
    """
    decay = math.exp(-1.0 / (tau * fs))
    wait = _milliseconds(idle)

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else ([], [], [], [], [-1])
        pools, last, out = [list(p) for p in zip(*held[:4])], int(held[4][0]), []
        if state.hasTimedOut:
            for a, b in zip(pools, pools[1:]):
                out.append((key[0], int(b[2]), b[0] - a[0] * decay ** a[3]))
            state.remove()
        else:
            rows = pd.concat(list(pdfs)).sort_values("frame")
            for frame, v in zip(rows["frame"], rows["v"]):
                if frame <= last:
                    continue
                last = int(frame)
                pools.append([float(v), 1.0, float(frame), 1.0])
                while len(pools) > 1 and pools[-2][0] * decay ** pools[-2][3] > pools[-1][0]:
                    v1, w1, _, l1 = pools.pop()
                    p = pools[-1]
                    g = decay ** p[3]
                    total = p[1] + w1 * g * g
                    p[0], p[1], p[3] = (p[0] * p[1] + v1 * w1 * g) / total, total, p[3] + l1
                while len(pools) > 1 and pools[1][2] <= frame - hold:
                    a, b = pools[0], pools[1]
                    out.append((key[0], int(b[2]), b[0] - a[0] * decay ** a[3]))
                    pools.pop(0)
            state.update((*([p[k] for p in pools] for k in range(4)), [float(last)]))
            state.setTimeoutDuration(wait)
        yield pd.DataFrame(out, columns=["roi", "frame", "spk"]).astype({"roi": "int64", "frame": "int64", "spk": "float64"})

    schema = "v array<double>, w array<double>, t array<double>, l array<double>, last array<double>"
    return traces.groupBy("roi").applyInPandasWithState(run, "roi long, frame long, spk double", schema, "append", GroupStateTimeout.ProcessingTimeTimeout)


def _milliseconds(duration: str) -> int:
    number, unit = duration.split()
    return int(float(number) * {"millisecond": 1, "second": 1_000, "minute": 60_000, "hour": 3_600_000}[unit.rstrip("s")])
