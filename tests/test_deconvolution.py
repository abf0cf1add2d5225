"""Deconvolution by blocks against that of whole traces."""

import math

import numpy as np
import pytest

from calspark.operators import deconvolution, traces

DECAY = math.exp(-0.1)


def trace(r, n, kind):
    if kind == "bursts":
        s = r.exponential(1.0, n) * (r.random(n) < 0.1)
        c = np.zeros(n)
        for t in range(n):
            c[t] = (c[t - 1] * DECAY if t else 0) + s[t]
        return c + r.normal(0, 0.2, n)
    if kind == "falling":  # one pool takes over everything before it
        return np.linspace(50, -50, n)
    return r.normal(0, 1, n)


@pytest.mark.parametrize("block", [1, 7, 64, 1000])
def test_blocks_of_any_size_give_the_spikes_of_the_whole(spark, block):
    r = np.random.default_rng(block)
    data = {k: trace(r, n, kind) for k, (n, kind) in enumerate([(1, "noise"), (2, "noise"), (63, "bursts"), (64, "bursts"), (65, "noise"), (200, "bursts"), (40, "falling")])}
    if block == 1:
        data = {k: v[:9] for k, v in data.items()}
    rows = [(k, 3 * t + k, float(v)) for k, values in data.items() for t, v in enumerate(values)]
    df = spark.createDataFrame(rows, "roi int, frame int, f double").repartition(5)
    got = {(x.roi, x.frame): x.spk for x in deconvolution.deconvolve_blocks(df, "f", block=block).collect()}
    assert len(got) == len(rows)
    for k, values in data.items():
        want = traces.deconvolve_array(values, DECAY)
        assert all(abs(got[k, 3 * t + k] - w) < 1e-9 for t, w in enumerate(want))


def test_pools_merge_in_any_order():
    r = np.random.default_rng(5)
    values = trace(r, 500, "bursts")
    whole = deconvolution.pooled(values, DECAY)
    for cuts in ([100, 250], [1, 2, 3, 499], list(range(10, 500, 10))):
        edges = [0, *cuts, 500]
        out = deconvolution.Pools()
        for a, b in zip(edges, edges[1:]):
            part = deconvolution.pooled(values[a:b], DECAY)
            part.start = [s + a for s in part.start]
            out.extend(part, DECAY)
        assert out.start == whole.start and out.length == whole.length and np.allclose(out.level, whole.level)


def test_empty(spark):
    assert deconvolution.deconvolve_blocks(spark.createDataFrame([], "roi int, frame int, f double"), "f").count() == 0
