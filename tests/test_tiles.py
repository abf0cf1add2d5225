"""Sparse pursuit over tiles against the search on the whole plane."""

import numpy as np
import pandas as pd
import pytest

from calspark.operators import detection, pursuit, tiles


def field(spark, height, width, cells, frames=60, seed=3, planes=1, gap=6, size=2.0):
    """plane, frame, arr: Gaussian regions at random places, some close to one another, that fire in bursts over noise."""
    r = np.random.default_rng(seed)
    spots = np.stack([r.uniform(gap, height - gap, cells), r.uniform(gap, width - gap, cells)], 1)
    strength, start = r.uniform(5, 12, cells), r.integers(20, 60, (planes, cells))

    def run(it):
        y, x = np.mgrid[:height, :width]
        images = [np.exp(-((y - a) ** 2 + (x - b) ** 2) / (2 * size**2)) for a, b in spots]
        for pdf in it:
            rows = []
            for k in pdf["id"]:
                plane, t = divmod(int(k), frames)
                image = np.random.default_rng([seed, int(k)]).normal(0, 0.5, (height, width))
                for n, s in enumerate(images):
                    image += strength[n] * np.exp(-((t + 7 * n) % int(start[plane, n])) / 5.0) * s
                rows.append((plane, t, image.ravel()))
            yield pd.DataFrame(rows, columns=["plane", "frame", "arr"])

    return spark.range(0, planes * frames, 1, 8).mapInPandas(run, "plane int, frame long, arr array<double>")


def regions(df):
    out = {}
    for r in df.collect():
        out.setdefault((r.plane, r.roi), {})[r.y, r.x] = (r.lam, r.scale)
    return out


def same(a, b):
    assert a.keys() == b.keys()
    for k in a:
        assert a[k].keys() == b[k].keys()
        assert all(abs(a[k][p][0] - b[k][p][0]) <= 1e-6 * max(1, abs(a[k][p][0])) and a[k][p][1] == b[k][p][1] for p in a[k])


@pytest.mark.parametrize("height,width,cells,tile,planes,seed", [(176, 144, 30, 64, 1, 3), (69, 133, 14, 48, 2, 4)])
def test_rounds_over_tiles_find_what_one_search_finds(spark, height, width, cells, tile, planes, seed):
    frames = field(spark, height, width, cells, planes=planes, seed=seed)
    s = pursuit.SparseSettings()
    whole = regions(detection.detect(frames, height, width, "sparse", s))
    assert len(whole) >= 0.6 * cells * planes
    same(regions(detection.detect(frames, height, width, "sparse", s, tile=tile)), whole)


def test_most_regions_and_forced_scale(spark):
    frames = field(spark, 96, 128, 20, seed=8)
    s = pursuit.SparseSettings(max_rois=9, spatial_scale=2, active_percentile=90.0)
    whole = regions(detection.detect(frames, 96, 128, "sparse", s))
    assert len(whole) == 9
    same(regions(detection.detect(frames, 96, 128, "sparse", s, tile=64)), whole)


def test_regions_wider_than_the_radius_begin_again(spark, monkeypatch):
    frames = field(spark, 80, 96, 4, seed=9, size=6.0, gap=20)
    s = pursuit.SparseSettings(highpass_neuropil=61)
    whole = regions(detection.detect(frames, 80, 96, "sparse", s))
    assert max(max(y for y, _ in p) - min(y for y, _ in p) for p in whole.values()) > 8
    same(regions(tiles.parallel_pursuit(frames, 80, 96, s, tile=48, radius=6)), whole)


def test_a_certain_peak_is_higher_than_all_within_reach():
    r = np.random.default_rng(1)
    block = pursuit.Block(r.normal(0, 3, (40, 80, 96)), 5.0, pursuit.SparseSettings())
    core = slice(16, 64), slice(32, 80)
    places = block.certain(1.0, 20, core)
    assert places
    for value, s, y, x in places:
        cy, cx = block.centre(s, y, x)
        assert 16 <= cy < 64 and 32 <= cx < 80
        for k, m in enumerate(block.maps):
            for a, b in np.argwhere(m > value):
                rows, columns = np.arange(a << k, (a + 1) << k), np.arange(b << k, (b + 1) << k)
                assert abs(rows - cy).min() > 20 or abs(columns - cx).min() > 20


def test_tiles_begin_at_pixels_of_the_coarsest_map(spark):
    with pytest.raises(ValueError):
        tiles.parallel_pursuit(field(spark, 32, 32, 1), 32, 32, tile=20)
