"""MATLAB files, hybrid ground truth, planes on one canvas, stacks."""

import numpy as np
import pytest

from calspark.operators import layout as L
from calspark.operators import registration as G
from calspark.operators import synthetic as Y
from calspark.sources import mat


def test_matlab_round_trip():
    values = {
        "a": np.arange(6, dtype="f4").reshape(2, 3), "n": 3.5, "b": np.array([[True, False]]), "i": np.arange(-4, 4, dtype="i2").reshape(2, 2, 2), "none": None, "text": "grüße", "empty": "",
        "s": {"x": np.array([1, 2], "i4"), "t": "y"}, "list": [{"k": 1.0, "v": np.zeros((0, 0))}, {"k": 2.0, "v": np.ones((1, 2))}], "cell": ["p", np.array([7], "u8")], "no_rows": [],
    }
    got = mat.decode(mat.encode(values))
    assert list(got) == list(values)
    assert np.array_equal(got["a"], values["a"]) and got["a"].dtype == np.float32 and got["n"] == 3.5 and got["b"].dtype == bool and got["b"].tolist() == [[True, False]]
    assert np.array_equal(got["i"], values["i"]) and got["none"].size == 0 and got["text"] == "grüße" and got["empty"] == ""
    assert got["s"][0]["x"].tolist() == [[1, 2]] and got["s"][0]["t"] == "y" and [x["k"].item() for x in got["list"]] == [1, 2] and got["list"][1]["v"].shape == (1, 2)
    assert got["cell"][0] == "p" and got["cell"][1].dtype == np.uint64
    with pytest.raises(TypeError):
        mat.encode({"c": np.array([1j])})


def test_small_elements_and_compression_are_read():
    import struct
    import zlib

    data = mat.encode({"x": np.array([[5.0]])})
    packed = zlib.compress(data[128:])
    assert mat.decode(data[:128] + struct.pack("<II", 15, len(packed)) + packed)["x"] == 5
    # a name of one letter as a small element, as other writers have it
    body = struct.pack("<IIII", 6, 8, 6, 0) + struct.pack("<IIii", 5, 8, 1, 1) + struct.pack("<HH4s", 1, 1, b"x") + struct.pack("<IId", 9, 8, 2.5)
    assert mat.decode(data[:128] + struct.pack("<II", 14, len(body)) + body)["x"] == 2.5


def test_a_file_a_plane(spark, tmp_path):
    masks = spark.createDataFrame([(p, r, y, 2 * y, 0.5) for p in (0, 1) for r in (3, 5) for y in range(r)], "plane int, roi long, y int, x int, lam double")
    traces = spark.createDataFrame([(p, r, t, t + 0.5, 1.0 * r, 0.0) for p in (0, 1) for r in (3, 5) for t in range(4)], "plane int, roi long, frame long, f double, fneu double, spk double")
    stats = spark.createDataFrame([(p, r, r, 0.1 * r) for p in (0, 1) for r in (3, 5)], "plane int, roi long, npix int, skew double")
    labels = spark.createDataFrame([(0, 3, True, 0.9, False, 0.1)], "plane int, roi long, iscell boolean, prob double, redcell boolean, redprob double")
    assert mat.save(str(tmp_path), masks, traces, stats, labels, {"fs": 10.0}) == 2
    got = mat.decode((tmp_path / "plane0" / "Fall.mat").read_bytes())
    assert got["F"].tolist() == [[0.5, 1.5, 2.5, 3.5]] * 2 and got["Fneu"][:, 0].tolist() == [3, 5] and got["iscell"].tolist() == [[1, 0.9], [0, 0]]
    assert [s["npix"].item() for s in got["stat"]] == [3, 5] and got["stat"][1]["xpix"].tolist() == [[0, 2, 4, 6, 8]] and got["ops"][0]["fs"] == 10


def test_planted_regions(spark):
    rows = Y.ellipses(spark, 90, 60, 80, 3).toPandas()
    again = Y.ellipses(spark.newSession(), 90, 60, 80, 3).toPandas()
    assert sorted(map(tuple, rows.to_numpy())) == sorted(map(tuple, again.to_numpy()))
    assert rows["y"].between(0, 59).all() and rows["x"].between(0, 79).all() and np.allclose(rows.groupby("roi")["lam"].sum(), 1)
    spans = rows.groupby("roi")[["y", "x"]].agg(lambda v: v.max() - v.min()).max(axis=1)
    assert spans[spans.index >= 60].mean() > spans[spans.index < 60].mean()


def test_borrowed_activity_comes_from_near_regions(spark):
    centres = spark.createDataFrame([(n, float(n), 0.0) for n in range(200)], "roi long, y double, x double")
    truth = spark.createDataFrame([(n, float(4 * n), 1.0) for n in range(50)], "roi long, y double, x double")
    traces = spark.createDataFrame([(n, t, float(100 * n + t)) for n in range(50) for t in range(2)], "roi long, frame long, v double")
    got = Y.borrowed_activity(centres, truth, traces).where("frame = 1").toPandas()
    source = (got["v"].to_numpy() - 1) / 100
    assert len(got) == 200 and np.median(np.abs(source * 4 - got["roi"])) < 16 and len(set(source)) > 20


def test_hybrid_frames_against_numpy(spark):
    r = np.random.default_rng(1)
    h, w, t = 12, 10, 9
    movie, others = r.uniform(50, 90, (t, h * w)), r.uniform(0, 9, (2, t, h * w))
    basis = Y.fourier_basis(h, w, 3)
    assert basis.shape == (8, h * w) and np.allclose(np.linalg.norm(basis, axis=1), 1) and np.allclose(basis.sum(1), 0, atol=1e-9)
    frames = spark.createDataFrame([(0, k, movie[k].tolist()) for k in range(t)], "plane int, frame long, arr array<double>")
    rest = spark.createDataFrame([(p + 1, k, others[p, k].tolist()) for p in range(2) for k in range(t)], "plane int, frame long, arr array<double>")
    weights = Y.neuropil_weights(rest, basis)
    want = sum((others[p] - others[p].mean()) @ basis.T for p in range(2))
    got = {x.frame: x.w for x in weights.collect()}
    assert np.allclose([got[k] for k in range(t)], want)
    masks = spark.createDataFrame([(1, 2, 3, 0.25), (1, 2, 4, 0.75), (2, 5, 5, 1.0)], "roi long, y int, x int, lam double")
    activity = spark.createDataFrame([(roi, k, float(v)) for roi in (1, 2) for k, v in enumerate(r.normal(10, 30, t))], "roi long, frame long, v double")
    act = {(x.roi, x.frame): x.v for x in activity.collect()}
    made = {x.frame: np.array(x.arr) for x in Y.hybrid(frames, h, w, masks, activity, weights, basis, 0.4, 0.0).collect()}
    for k in range(t):
        glow = np.zeros(h * w)
        for roi, at, lam in ((1, [2 * w + 3, 2 * w + 4], [0.5, 1.5]), (2, [5 * w + 5], [1.0])):
            glow[at] += act[roi, k] * np.array(lam)
        x = movie[k] * 0.6 + 0.4 * np.maximum(0, want[k] @ basis + movie.mean()) + 0.6 * np.maximum(0, glow)
        assert np.array_equal(made[k], np.clip(x, 0, 32767).astype("int16"))
    noisy = [sorted((x.frame, tuple(x.arr)) for x in Y.hybrid(frames, h, w, counting=5.0, seed=s).collect()) for s in (1, 1, 2)]
    assert noisy[0] == noisy[1] != noisy[2] and all(v % 5 == 0 for _, a in noisy[0] for v in a)
    assert abs(np.mean([a for _, a in noisy[0]]) - movie.mean()) < 2


def test_strong_traces_stay(spark):
    r = np.random.default_rng(2)
    slow, noise = np.sin(np.arange(200) / 20), r.normal(0, 1, 200)
    traces = spark.createDataFrame([(k, t, float(v)) for k, x in enumerate((slow, noise)) for t, v in enumerate(x)], "roi long, frame long, v double")
    assert {x.roi for x in Y.strongest(traces, 0.3).select("roi").distinct().collect()} == {0}


def test_planes_meet_on_one_canvas(spark):
    fields = spark.createDataFrame([(p, 4, 5) for p in range(3)], "plane int, height int, width int")
    layout = L.canvas(fields)
    movie = np.arange(3 * 6 * 20).reshape(3, 6, 20).astype("int16")
    frames = spark.createDataFrame([(p, k, movie[p, k].tolist()) for p in range(3) for k in range(6)] + [(9, 0, [1] * 20)], "plane int, frame long, arr array<smallint>")
    height, width = L.canvas_size(layout)
    for x in L.combined_frames(frames, layout).collect():
        want = np.zeros((height, width), int)
        for r in layout.collect():
            want[r.dy : r.dy + 4, r.dx : r.dx + 5] = movie[r.plane, x.frame].reshape(4, 5)
        assert np.array_equal(np.array(x.arr).reshape(height, width), want)
    with pytest.raises(Exception, match="is there in 2 of 3 planes"):
        L.combined_frames(frames.where("not (plane = 1 and frame = 4)"), layout).collect()


def test_frames_find_their_image_of_a_stack(spark):
    from calspark.operators.detection import smooth

    r = np.random.default_rng(3)
    stack = [smooth(r.normal(0, 1, (48, 48)), 2.0) * 1000 for _ in range(4)]
    rows = [(0, k, np.roll(stack[k % 4], (k % 3 - 1, k % 5 - 2), (0, 1)).ravel().tolist()) for k in range(12)]
    frames = spark.createDataFrame(rows, "plane int, frame long, arr array<double>")
    blocks = G.BlockSettings(block=(24, 24), max_shift=2)
    for x in G.register_to_stack(frames, stack, G.RigidSettings(max_shift=0.1), blocks).collect():
        assert (x.z, x.yoff, x.xoff) == (x.frame % 4, x.frame % 3 - 1, x.frame % 5 - 2) and len(x.corrs) == 4 and x.corr == max(x.corrs)
        assert len(x.yoff1) == len(G.block_grid(48, 48, (24, 24))[0]) and max(map(abs, x.yoff1)) < 0.5
    assert all(x.yoff1 is None for x in G.register_to_stack(frames, stack).collect())
