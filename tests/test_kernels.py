"""NumPy kernels against formulas, brute force and planted truth."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest

from calspark.operators import detection as D
from calspark.operators import evaluate as E
from calspark.operators import movie as V
from calspark.operators import registration as G
from calspark.operators import traces as T


def scene(h=64, w=64, seed=0):
    r = np.random.default_rng(seed)
    return D.smooth(r.normal(0, 1, (h, w)), 2.0) * 1000


@pytest.mark.parametrize("dy,dx", [(0, 0), (3, -2), (-6, 5)])
def test_rigid_shift_is_recovered(dy, dx):
    ref = scene()
    kernel = G.Rigid(ref, G.RigidSettings(max_shift=0.2))
    y, x, c = kernel.shifts(np.roll(ref, (dy, dx), (0, 1))[None])
    assert (y[0], x[0]) == (dy, dx) and c[0] > 0
    assert np.array_equal(G.rolled(np.roll(ref, (dy, dx), (0, 1))[None], y, x)[0], ref)


def test_blobs_and_arrays_register_alike(spark):
    ref = np.round(scene(48, 48, 4))
    moved = [np.roll(ref, (k % 3 - 1, k % 5 - 2), (0, 1)) for k in range(20)]
    arrays = spark.createDataFrame([(0, k, m.ravel().tolist()) for k, m in enumerate(moved)], "plane int, frame long, arr array<double>")
    blobs = spark.createDataFrame([(0, k, bytearray(m.astype("<i2").tobytes())) for k, m in enumerate(moved)], "plane int, frame long, pix binary")
    reference = spark.createDataFrame([(0, ref.ravel().tolist())], "plane int, arr array<double>")
    rigid, blocks = G.RigidSettings(max_shift=0.1), G.BlockSettings(block=(24, 24), max_shift=2)
    a = G.register(arrays, reference, 48, 48, rigid, blocks).toPandas().sort_values("frame")
    b = G.register(blobs, reference, 48, 48, rigid, blocks).toPandas().sort_values("frame")
    assert a["yoff"].tolist() == b["yoff"].tolist() == [k % 3 - 1 for k in range(20)] and a["xoff"].tolist() == b["xoff"].tolist()
    got = np.stack([np.frombuffer(p, "<i2") for p in b["pix"]])
    assert (np.abs(got - np.stack(a["arr"])) <= 1).mean() > 0.98 and np.corrcoef(got.ravel(), np.tile(ref.ravel(), 20))[0, 1] > 0.99
    again = G.apply_offsets(blobs, G.register(blobs, reference, 48, 48, rigid, blocks), 48, 48, blocks).toPandas().sort_values("frame")
    assert np.array_equal(np.stack([np.frombuffer(p, "<i2") for p in again["pix"]]), got)


def test_blocks_recover_local_motion():
    ref = scene(96, 96, 1)
    y, x = np.mgrid[:96, :96]
    moved = G.warp(ref[None], np.where(y < 48, -1.5, 1.0)[None].astype(float), np.zeros((1, 96, 96)))[0]
    b = G.Blocks(ref, G.BlockSettings(block=(32, 32), max_shift=4))
    yoff, xoff, _ = b.shifts(moved[None])
    top = [n for n, k in enumerate(b.blocks) if k[1] <= 36]
    low = [n for n, k in enumerate(b.blocks) if k[0] >= 60]
    assert np.abs(yoff[0][top] - 1.5).max() < 0.5 and np.abs(yoff[0][low] + 1.0).max() < 0.5 and np.abs(xoff).max() < 0.5


def test_warp_by_whole_pixels_is_a_shift():
    f = np.arange(48.0).reshape(1, 6, 8)
    assert np.array_equal(G.warp(f, np.ones((1, 6, 8)), np.zeros((1, 6, 8)))[0, :5], f[0, 1:])


def test_block_grid_covers_and_smoother_is_stochastic():
    blocks, (ny, nx), (by, bx) = G.block_grid(200, 130, (64, 64))
    seen = np.zeros((200, 130), bool)
    for y0, y1, x0, x1 in blocks:
        seen[y0:y1, x0:x1] = True
    assert seen.all() and len(blocks) == ny * nx == math.ceil(1.5 * 200 / 64) * math.ceil(1.5 * 130 / 64)
    assert np.allclose(G.block_smoother(ny, nx).sum(1), 1)


def test_kriging_is_exact_at_its_points():
    k, side = G.upsampler(3, 10)
    grid = np.random.default_rng(0).normal(size=49)
    fine = (grid @ k).reshape(side, side)[::10, ::10]
    assert np.allclose(fine.ravel(), grid, atol=1e-6)


def test_bidirectional_reference_cases(spark):
    rows = [(0, 0, y, x, float(x + 1)) for y in range(5) for x in range(7)]
    df = spark.createDataFrame(rows, "plane int, frame int, y int, x int, v double")
    for k, want in ((2, [1, 2, 1, 2, 3, 4, 5]), (-2, [3, 4, 5, 6, 7, 6, 7])):
        got = V.bidirectional_shift(df, k).toPandas().sort_values(["y", "x"])["v"].to_numpy().reshape(5, 7)
        assert got[1].tolist() == want and got[0].tolist() == list(range(1, 8))


def test_line_shift_on_arrays_equals_the_pixel_form(spark):
    from calspark.operators.movie import exploded

    df = spark.createDataFrame([(p, 0, [float(p * 100 + i) for i in range(35)]) for p in range(3)], "plane int, frame long, arr array<double>")
    phases = spark.createDataFrame([(0, 2), (1, -2), (2, 0)], "plane int, phase int")
    got = exploded(G.lines_shifted(df, phases, 5, 7), 7).toPandas()
    for plane, k in ((0, 2), (1, -2), (2, 0)):
        want = V.bidirectional_shift(exploded(df, 7).where(f"plane = {plane}"), k).toPandas().sort_values(["y", "x"])["v"].tolist()
        assert got[got["plane"] == plane].sort_values(["y", "x"])["v"].tolist() == want


def test_reference_finds_the_common_image():
    base = scene(48, 48, 2)
    r = np.random.default_rng(1)
    frames = np.stack([np.roll(base, (int(r.integers(-3, 4)), int(r.integers(-3, 4))), (0, 1)) + r.normal(0, 20, base.shape) for _ in range(60)])
    _, image = G.seed_reference(frames)
    image = G.refine_reference(frames, image, G.RigidSettings(max_shift=0.2))
    best = max(np.corrcoef(np.roll(base, (a, b), (0, 1)).ravel(), image.ravel())[0, 1] for a in range(-4, 5) for b in range(-4, 5))
    assert best > 0.95


def closed_form(y, g):
    """Max over starts of min over ends of the weighted means."""
    n = len(y)
    m = np.full((n, n), np.nan)
    for a in range(n):
        k = np.arange(n - a)
        m[a, a:] = np.cumsum(y[a:] * g**k) / np.cumsum(g ** (2 * k))
    c = np.array([max(min(m[a, t:]) * g ** (t - a) for a in range(t + 1)) for t in range(n)])
    return np.concatenate([[0], c[1:] - g * c[:-1]])


def test_deconvolution_matches_the_closed_form_and_stays_in_range():
    g = math.exp(-0.1)
    for seed in range(5):
        y = np.random.default_rng(seed).normal(0, 1, 40)
        assert np.allclose(T.deconvolve_array(y, g), closed_form(y, g), atol=1e-9)
    long = T.deconvolve_array(np.random.default_rng(9).normal(0, 1, 30_000), g)
    assert np.isfinite(long).all() and (long >= -1e-12).all() and long[0] == 0


def test_deconvolution_streams_over_batches(spark):
    r = np.random.default_rng(3)
    lengths = [1, 7, 50, 3, 14, 2]
    rows = pd.DataFrame([(k, t, float(v)) for k, n in enumerate(lengths) for t, v in enumerate(r.normal(0, 1, n))], columns=["roi", "frame", "v"])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = T.deconvolve(spark.createDataFrame(rows.sample(frac=1, random_state=0)), "v").toPandas().sort_values(["roi", "frame"])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = np.concatenate([T.deconvolve_array(g["v"].to_numpy(), math.exp(-0.1)) for _, g in rows.groupby("roi")])
    assert np.allclose(got["spk"], want)


def test_deconvolution_finds_planted_spikes():
    g, s = math.exp(-0.1), np.zeros(300)
    s[[30, 100, 180]] = [3, 5, 4]
    c = np.zeros(300)
    for t in range(1, 300):
        c[t] = g * c[t - 1] + s[t]
    assert np.allclose(T.deconvolve_array(c, g), s, atol=1e-9)


def test_sparse_and_component_pursuit_find_planted_regions():
    r = np.random.default_rng(3)
    y, x = np.mgrid[:48, :48]
    centres = [(8, 9), (10, 35), (24, 22), (38, 10), (37, 38)]
    movie = r.normal(0, 0.3, (300, 48, 48))
    for n, (a, b) in enumerate(centres):
        act = np.convolve((r.random(300) < 0.03).astype(float), np.exp(-np.arange(30) / 8))[:300]
        movie += 8 * act[:, None, None] * np.exp(-((y - a) ** 2 + (x - b) ** 2) / 8)
    for found in (D.sparse_pursuit(movie, D.SparseSettings(highpass_neuropil=17)), D.component_pursuit(movie, 6.0)):
        got = [(float((lam * y).sum() / lam.sum()), float((lam * x).sum() / lam.sum())) for lam, _ in found]
        assert all(min(math.hypot(a - c, b - d) for c, d in got) < 2 for a, b in centres)
        assert len(found) <= 8


def test_split_test_separates_two_cells_but_not_one():
    r = np.random.default_rng(0)
    left, right = np.r_[np.ones(10), np.zeros(10)], np.r_[np.zeros(10), np.ones(10)]
    a, b = (r.random(200) < 0.1) * 5.0, (r.random(200) < 0.1) * 5.0
    lam = np.ones(20) / math.sqrt(20)
    two = np.outer(a, left) + np.outer(b, right) + r.normal(0, 0.1, (200, 20))
    one = np.outer(a, left + right) + r.normal(0, 0.1, (200, 20))
    assert D.split_ratio(two, lam, 2.0)[0] > 1.25 > D.split_ratio(one, lam, 2.0)[0]


def test_assignment_is_optimal():
    r = np.random.default_rng(0)
    for n, m in ((3, 3), (3, 5), (5, 3)):
        cost = r.random((n, m))
        got = sum(cost[a, b] for a, b in E.assignment(cost))
        k = min(n, m)
        best = min(sum(cost[a, b] for a, b in zip(p, q)) for p in itertools.combinations(range(n), k) for q in itertools.permutations(range(m), k))
        assert abs(got - best) < 1e-12


def test_binning_keeps_good_frames_only(spark):
    r = np.random.default_rng(42)
    bad = (r.random(1500) < 0.3).tolist()
    frames = spark.createDataFrame([(0, i, b) for i, b in enumerate(bad)], "plane int, frame long, bad boolean")
    assert V.frame_bins(frames, 1).count() == 1500 - sum(bad)
    assert V.frame_bins(frames.withColumn("bad", frames.plane > 0), 1).count() == 1500


def test_evenly_spaced_batches_are_those_of_linspace(spark):
    frames = spark.range(3000).selectExpr("0 plane", "id frame", "false bad")
    for size, batch, bins in ((5, 100, 200), (5, 100, 330), (1, 7, 100), (10, 500, 1), (3, 100, 10_000)):
        there = -(-3000 // batch)
        kept = min(max(bins // max(batch // size, 1), 1), there)
        want = set(np.linspace(0, there - 1, kept).astype(int).tolist())
        assert {r.batch for r in V.frame_bins(frames, size, batch, bins).select("batch").distinct().collect()} == want


def test_sampled_frames_are_those_of_linspace(spark):
    frames = spark.range(1000).selectExpr("cast(id div 429 as int) plane", "id frame")
    for n in (1, 14, 400, 2000):
        got = {(r.plane, r.frame) for r in G.sample_frames(frames, n).collect()}
        assert got == {(p, first + int(k)) for p, first, total in ((0, 0, 429), (1, 429, 429), (2, 858, 142)) for k in np.linspace(0, total - 1, min(n, total)).astype(int)}


def test_denoising_keeps_a_low_rank_movie(spark):
    r = np.random.default_rng(0)
    movie = np.outer(r.normal(size=30), r.normal(size=64)) + np.outer(r.normal(size=30), r.normal(size=64))
    df = spark.createDataFrame(pd.DataFrame({"plane": 0, "frame": range(30), "arr": [m.tolist() for m in movie]}), "plane int, frame long, arr array<double>")
    got = V.pca_denoised(df, 8, 8, (4, 4), 1.0).toPandas().sort_values("frame")
    assert np.allclose(np.stack(got["arr"]), movie, atol=1e-6)


def test_norms_are_by_plane(spark):
    from calspark.operators import rois as S

    sizes = spark.createDataFrame([(p, p * 1_000_000 + n, (10 + n) * (p + 1)) for p in (0, 1) for n in range(150)], "plane int, roi long, npix long")
    got = {x.roi: x.npix_norm for x in S.npix_norm(sizes).collect()}
    for p in (0, 1):  # the first hundred have sizes 10 .. 109
        assert abs(got[p * 1_000_000] - 10 / 59.5) < 1e-9 and abs(got[p * 1_000_000 + 149] - 159 / 59.5) < 1e-9
    alone = {x.roi: x.npix_norm for x in S.npix_norm(sizes.where("plane = 1")).collect()}
    assert len(alone) == 150 and all(abs(v - got[r]) < 1e-9 for r, v in alone.items())


def test_filters_count_places_and_keep_nulls(spark):
    rows = [(1, 10 + 3 * n, 4.0) for n in range(4)] + [(2, n, float(n % 5)) for n in range(40)] + [(3, 0, 1.0), (3, 7, None), (3, 9, 1.0)]
    traces = spark.createDataFrame(rows, "roi int, frame long, f double")
    for boundary in ("replicate", "reflect", "wrap"):
        got = {}
        for x in T.gaussian(traces, "f", 2.0, boundary).orderBy("roi", "frame").collect():
            got.setdefault(x.roi, []).append(x.smooth)
        assert np.allclose(got[1], 4.0) and got[3][1] is None
        values = np.array([n % 5 for n in range(40)], float)
        radius = 6 if boundary == "replicate" else 8
        w = np.exp(-0.5 * (np.arange(-radius, radius + 1) / 2.0) ** 2)
        padded = np.pad(values, radius, mode={"replicate": "edge", "reflect": "symmetric", "wrap": "wrap"}[boundary])
        assert np.allclose(got[2], np.convolve(padded, w / w.sum(), "valid"))


def test_correlations_in_blocks(spark, monkeypatch):
    r = np.random.default_rng(3)
    rows = [(roi, b, float(v)) for roi in range(30) for b, v in enumerate(r.normal(0, 1, 12)) if (roi + b) % 7 and not (roi == 4 and b > 1 or roi == 5 and b < 2)]
    binned = spark.createDataFrame(rows, "roi long, bin long, v double")
    held = {}
    for roi, b, v in rows:
        held.setdefault(roi, {})[b] = v
    want = {}
    for a in held:
        for b in held:
            common = held[a].keys() & held[b].keys()
            if a < b and common:
                ma, mb = np.mean(list(held[a].values())), np.mean(list(held[b].values()))
                want[a, b] = np.mean([(held[a][k] - ma) * (held[b][k] - mb) for k in common]) / (np.std(list(held[a].values())) * np.std(list(held[b].values())) + 1e-3)
    for size in (4, 512):
        monkeypatch.setattr(T, "TRACES_A_BLOCK", size)
        got = {(x.a, x.b): x.r for x in T.corr_matrix(binned).collect()}
        assert got.keys() == want.keys() and (4, 5) not in got and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_nearest_by_cells_against_all_pairs(spark):
    from calspark.operators import interactive as I

    r = np.random.default_rng(5)
    a = [(n, float(y), float(x)) for n, (y, x) in enumerate(r.normal(0, 50, (60, 2)))] + [(99, 4_000.0, -9_000.0), (98, 0.0, 0.0)]
    b = [(n, float(y), float(x)) for n, (y, x) in enumerate(np.round(r.normal(0, 30, (80, 2))))] + [(100, 1e4, 1e4)]
    make = lambda rows, name: spark.createDataFrame(rows, f"{name} long, y double, x double")
    for k in (1, 3, 200):
        got = {(x.a, x.rank): x.b for x in I.nearest_ranked(make(a, "a"), make(b, "b"), k).collect()}
        want = {(n, rank): m for n, y, x in a for rank, (_, m) in enumerate(sorted(((y - v) ** 2 + (x - w) ** 2, m) for m, v, w in b)[:k], 1)}
        assert got == want
    assert I.nearest_ranked(make(a, "a"), make(b, "b").limit(0), 2).count() == 0


def test_missing_and_extra_offsets_raise(spark):
    frames = spark.createDataFrame([(0, k, [float(k)] * 6) for k in range(5)], "plane int, frame long, arr array<double>")
    offsets = spark.createDataFrame([(0, k, 0, 0) for k in range(5)], "plane int, frame long, yoff int, xoff int")
    G.check_offsets(frames, offsets)
    assert G.shifted(frames, offsets, 2, 3).count() == 5
    for wrong in (offsets.where("frame <> 3"), offsets.union(offsets.where("frame = 1")), offsets.union(spark.createDataFrame([(0, 9, 0, 0)], offsets.schema)), offsets.withColumn("yoff", V.F.when(V.F.col("frame") != 2, 0))):
        with pytest.raises(ValueError, match="plane 0: 1 frames"):
            G.check_offsets(frames, wrong)
    with pytest.raises(Exception, match="no offset for frame 3 of plane 0"):
        G.shifted(frames, offsets.where("frame <> 3"), 2, 3).collect()


def test_samples_order_no_pixels(spark):
    frames = spark.createDataFrame([(p, k * 3, [float(k)] * 6) for p in (0, 1) for k in range(50)], "plane int, frame long, arr array<double>")
    got = sorted((x.plane, x.frame) for x in G.sample_frames(frames, 7).collect())
    assert got == [(p, int(k) * 3) for p in (0, 1) for k in np.linspace(0, 49, 7).astype(int)]
    from calspark.sources.raw import sampled_mean

    image = {(x.plane, x.y, x.x): x.v for x in sampled_mean(frames, 3, 7).collect()}
    assert len(image) == 12 and max(y for _, y, _ in image) == 1 and abs(image[0, 1, 2] - np.linspace(0, 49, 7).astype(int).mean()) < 1e-9
    for made in (G.sample_frames(frames, 7), I_forward(frames)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.splitlines() if line.strip(" :+-").startswith("Window")]
        assert windows and all("arr" not in line for line in windows)


def I_forward(frames):
    from calspark.operators import interactive as I

    return I.forward_filled(frames)


def test_blocks_of_bleed_through_blend():
    share = V.block_shares(60, 3, 5.0)
    assert np.allclose(share.sum(1), 1) and abs(share[19, 0] - share[20, 0]) < 0.1 and share[2, 0] > 0.99 and share[30, 1] > 0.9


def test_bleed_through_is_taken_out(spark):
    r = np.random.default_rng(2)
    one = np.abs(r.normal(10, 3, (30, 45)))
    slope = 0.2 + 0.3 * np.linspace(0, 1, 45)
    two = one * slope
    two[12:15, 20:23] += 40
    rows = lambda x: spark.createDataFrame([(0, int(a), int(b), float(x[a, b])) for a in range(30) for b in range(45)], "plane int, y int, x int, v double")
    got = np.zeros((30, 45))
    for x in V.bleed_through(rows(one), rows(two), 30, 45).collect():
        got[x.y, x.x] = x.v
    weights = np.array([[(one[10 * a : 10 * a + 10, 15 * b : 15 * b + 15] * two[10 * a : 10 * a + 10, 15 * b : 15 * b + 15]).sum() / (one[10 * a : 10 * a + 10, 15 * b : 15 * b + 15] ** 2).sum() for b in range(3)] for a in range(3)])
    sigma = float(np.round((30 + 45) / 6 * 0.25))
    gy, gx = V.block_shares(30, 3, sigma), V.block_shares(45, 3, sigma)
    assert np.allclose(got, np.maximum(0, two - one * (gy @ weights @ gx.T))) and got[13, 21] > 30


def test_components_of_bands_give_the_regions_of_the_whole(spark):
    from planted import planted

    frames = planted(spark, planes=2)
    got = {}
    for r in D.component_regions(frames, 40, 40, 6.0, rows=7).collect():
        got.setdefault((r.plane, r.roi), {})[r.y, r.x] = r.lam
    for plane in (0, 1):
        x = np.stack([r.arr for r in frames.where(f"plane = {plane}").orderBy("frame").collect()]).reshape(-1, 40, 40)
        want = D.component_pursuit(D.high_passed(x, 100), 6.0)
        assert len(want) >= 6 and {k[1] for k in got if k[0] == plane} == set(range(len(want)))
        for n, (lam, _) in enumerate(want):
            mine = np.zeros((40, 40))
            for (y, z), v in got[plane, n].items():
                mine[y, z] = v
            assert np.allclose(mine, lam, atol=1e-6)


@pytest.mark.parametrize("frames,height,width,rows,k", [(30, 17, 9, 4, 5), (8, 6, 40, 6, 20), (50, 5, 5, 2, 3)])
def test_components_of_bands_against_lapack(spark, frames, height, width, rows, k):
    from calspark.operators import components

    r = np.random.default_rng(frames)
    x = r.normal(size=(2, frames, height * width)) @ np.diag(np.linspace(3, 1, height * width))
    df = spark.createDataFrame([(p, t, x[p, t].tolist()) for p in (0, 1) for t in range(frames)], "plane int, frame long, arr array<double>").repartition(5)
    got = {(c.plane, c.pc): c for c in components.spatial_components(df, height, width, k, rows=rows).collect()}
    assert len(got) == 2 * min(k, frames)
    for p in (0, 1):
        u, s, v = np.linalg.svd(x[p] - x[p].mean(0), full_matrices=False)
        for pc in range(min(k, frames - 1, height * width)):
            sign = np.sign(u[np.abs(u[:, pc]).argmax(), pc])
            assert np.allclose(got[p, pc].arr, sign * s[pc] * v[pc], atol=1e-6) and abs(got[p, pc].value - s[pc] ** 2) < 1e-6 * s[0] ** 2


@pytest.mark.parametrize("window", [1, 3, 7, 11, 12, 31, 99, 400])
def test_rolling_extrema_of_any_window(spark, window):
    from calspark.functions.columns import rolling

    r = np.random.default_rng(window)
    rows = [(k, int(3 * t + r.integers(0, 3)), None if r.random() < 0.1 else float(r.integers(-50, 50))) for k, n in enumerate([1, 2, 10, 11, 12, 33, 150]) for t in range(n)]
    df = spark.createDataFrame(rows, "roi int, frame int, v double").repartition(3)
    for largest, best in ((False, min), (True, max)):
        got = {(x.roi, x.frame): x.e for x in rolling(df, ("roi",), "frame", "v", window, largest, "e").collect()}
        for k in range(7):
            own = [(f, v) for roi, f, v in rows if roi == k]
            for n, (f, _) in enumerate(own):
                near = [v for _, v in own[max(0, n - window // 2) : n + window // 2 + 1] if v is not None]
                assert got[k, f] == (best(near) if near else None)
