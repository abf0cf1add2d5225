"""Settings, sources, streams, the command line and the whole stage chain."""

import json

import numpy as np
import pandas as pd
import pytest

from calspark import pipeline
from calspark import settings as S
from calspark.functions.strings import file_order, trimmed_to
from calspark.operators import classify as K
from calspark.operators import registration as G
from calspark.operators import traces as T
from planted import planted
from calspark.sources import npy, raw, readers, tiff


def test_overlay_checks_names_and_ranges():
    s = S.overlay(S.Settings(), {"fs": 30.0, "registration": {"nonrigid": False, "block_size": [64, 64]}})
    assert s.fs == 30 and not s.registration.nonrigid and s.registration.block_size == (64, 64) and S.Settings().fs == 10
    with pytest.raises(KeyError):
        S.overlay(S.Settings(), {"no_such": 1})
    with pytest.raises(ValueError):
        S.overlay(S.Settings(), {"registration": {"maxregshift": 2.0}})
    record, old = S.from_flat({"nplanes": 3, "roidetect": False, "neucoeff": 0.5, "tau": 0.7, "unknown": 1})
    assert record.nplanes == 3 and not old.run.do_detection and old.extraction.neuropil_coefficient == 0.5 and old.tau == 0.7
    assert "registration.maxregshift" in S.markdown()


@pytest.mark.parametrize("path,want", [("/a/run/b", "/a/run"), ("/run/a/run/c/d", "/run/a/run"), ("run", "run"), ("/a/b", None)])
def test_path_trimming(path, want):
    if want is None:
        with pytest.raises(FileNotFoundError):
            trimmed_to(path, "run")
    else:
        assert trimmed_to(path, "run") == want


def test_natural_order(spark):
    df = spark.createDataFrame([(f"/d/f{n}.tif",) for n in (10, 2, 1, 2)], "path string")
    assert [r.path for r in file_order(df).orderBy("rank").collect()] == ["/d/f1.tif", "/d/f2.tif", "/d/f10.tif"]


def test_unknown_baseline_is_refused(spark):
    with pytest.raises(ValueError):
        T.preprocess(spark.createDataFrame([(0, 0, 1.0)], "roi int, frame int, f double"), "f", "constant_prctile", 5, 1.0)


def test_tiff_round_trip_and_dtypes(spark, tmp_path):
    stack = np.arange(5 * 6 * 7).reshape(5, 6, 7) - 50
    (tmp_path / "x1.tif").write_bytes(tiff.encode(stack[:3]))
    (tmp_path / "x2.tif").write_bytes(tiff.encode(stack[3:]))
    pages = tiff.read_pages(spark, str(tmp_path))
    files = readers.list_files(spark, [str(tmp_path)], "*.tif")
    x = readers.demultiplexed(readers.numbered(pages, files), 2, 1).toPandas().sort_values("page")
    assert np.array_equal(np.stack(x["arr"]).reshape(5, 6, 7), stack) and x["plane"].tolist() == [0, 1, 0, 1, 0] and x["frame"].tolist() == [0, 0, 1, 1, 2]
    assert tiff.narrow(np.array([65535, 7], "<u2")).tolist() == [32767, 3]
    with pytest.raises(ValueError):
        list(tiff.directories(b"nothing"))


def test_flat_and_npy_files(spark, tmp_path):
    stack = np.arange(4 * 3 * 2).reshape(4, 3, 2).astype("<i2")
    (tmp_path / "a.bin").write_bytes(stack.tobytes())
    flat = raw.read_flat(spark, str(tmp_path / "a.bin"), 3, 2).toPandas().sort_values("frame")
    assert np.array_equal(np.stack([np.frombuffer(b, "<i2") for b in flat["pix"]]).reshape(4, 3, 2), stack)
    np.save(tmp_path / "p_3.npy", stack)
    got = npy.read_npy_files(spark, str(tmp_path)).toPandas().sort_values("frame")
    assert got["plane"].unique().tolist() == [3] and np.array_equal(np.stack(got["arr"]).reshape(4, 3, 2), stack)


def test_missing_reader_says_so():
    with pytest.raises(ImportError, match="h5py"):
        readers.reader("h5")
    with pytest.raises(ValueError):
        readers.reader("xyz")


def test_raw_geometry(spark, tmp_path):
    (tmp_path / "e.xml").write_text('<E><LSM pixelX="64" pixelY="32"/><Streaming zFastEnable="1" flybackFrames="1" frames="90"/><ZStage steps="3"/><Wavelengths><Wavelength/><Wavelength/></Wavelengths></E>')
    r = readers.raw_geometry(spark, str(tmp_path / "e.xml")).first()
    assert (r.width, r.height, r.planes, r.channels, r.flyback, r.frames) == (64, 32, 3, 2, 1, 90)


def test_classifier_saves_and_loads(spark, tmp_path):
    r = np.random.default_rng(0)
    cell = r.random(600) < 0.5
    df = spark.createDataFrame(pd.DataFrame({"roi": range(600), "skew": r.normal(cell * 2.0, 1), "npix_norm": r.normal(1, 0.2, 600), "compact": r.normal(1.5 - cell * 0.4, 0.2), "iscell": cell.astype(int)}))
    model = K.Classifier.fit(df)
    got = model.predict(df).toPandas().sort_values("roi")
    assert (got["iscell"].to_numpy() == cell).mean() > 0.85
    model.save(spark, str(tmp_path / "m"))
    again = K.Classifier.load(spark, str(tmp_path / "m")).predict(df).toPandas().sort_values("roi")
    assert np.allclose(again["prob"], got["prob"])


def test_stage_chain_finds_planted_regions(spark, tmp_path):
    frames = planted(spark, frames=240, planes=2)
    s = S.overlay(S.Settings(), {"fs": 2.0, "diameter": [6, 6], "registration": {"nonrigid": False, "maxregshift": 0.05}, "detection": {"bin_size": 1, "sparse": {"highpass_neuropil": 15}}, "extraction": {"min_neuropil_pixels": 60}, "dcnv_preprocess": {"win_baseline": 30.0, "sig_baseline": 2.0}})
    out = pipeline.run(frames, 40, 40, str(tmp_path / "run"), s)
    stats = out["stats"].toPandas()
    for plane in (0, 1):
        mine = stats[stats["roi"] // 1_000_000 == plane]
        for a, b in [(7, 8), (9, 29), (20, 18), (30, 7), (31, 31), (19, 33)]:
            assert min(abs(m["y"] - a) + abs(m["x"] - b) for m in mine["med"]) <= 5  # noise moves frames by up to two pixels an axis
    spikes = out["spikes"].toPandas()
    assert (spikes["spk"] >= -1e-9).all() and set(spikes["roi"]) == set(stats["roi"])
    two = pipeline.run(frames.where("plane = 0"), 40, 40, str(tmp_path / "two"), S.overlay(s, {"run": {"do_deconvolution": False}, "registration": {"bidiphase": 1}}), frames2=frames.where("plane = 0"))
    red = two["redcell"].toPandas()
    assert two["registered2"].count() == 240 and len(red) == two["stats"].count() and red["redprob"].notna().all()
    again = pipeline.run(frames, 40, 40, str(tmp_path / "run"), S.overlay(s, {"run": {"do_detection": False}}))
    assert again["registered"].count() == 480


def test_streams(spark, tmp_path):
    from calspark.streaming import online

    r = np.random.default_rng(1)
    base = r.normal(0, 50, (16, 16))
    rows = pd.DataFrame({"plane": 0, "frame": range(12), "ts": pd.date_range("2024-01-01", periods=12, freq="s"), "arr": [np.roll(base, (k % 3 - 1, 0), (0, 1)).ravel().tolist() for k in range(12)]})
    rows["plane"] = rows["plane"].astype("int32")
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, online.FRAMES).repartition(2).write.parquet(src)
    q = online.registered(online.frame_stream(spark, src), base, G.RigidSettings(max_shift=0.2, spatial_taper=0.8)).writeStream.format("memory").queryName("reg").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("reg").toPandas().sort_values("frame")
    assert got["yoff"].tolist() == [k % 3 - 1 for k in range(12)]
    v = np.abs(r.normal(0, 1, 80))
    tr = str(tmp_path / "tr")
    spark.createDataFrame(pd.DataFrame({"roi": 5, "frame": range(80), "v": v}), online.TRACE).coalesce(1).write.parquet(tr)
    q = online.online_spikes(spark.readStream.schema(online.TRACE).parquet(tr), hold=20).writeStream.format("memory").queryName("spk").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    spikes = {x.frame: x.spk for x in spark.table("spk").collect()}
    whole = T.deconvolve_array(v, np.exp(-0.1))
    early = [k for k in range(1, 50) if whole[k] > 1e-9]
    assert early and all(abs(spikes.get(k, 0.0) - whole[k]) < 0.3 for k in early)


def test_a_silent_region_gives_out_its_last_frames_and_late_ones_are_left_out(spark, tmp_path):
    import time

    from calspark.streaming import online

    v = np.abs(np.random.default_rng(4).normal(0, 1, 60))
    tr = str(tmp_path / "tr")
    put = lambda frames, values: spark.createDataFrame(pd.DataFrame({"roi": 5, "frame": frames, "v": values}), online.TRACE).coalesce(1).write.mode("append").parquet(tr)
    put(range(60), v)
    def until(idle, done):
        """Triggers until done(); timeouts keep such a stream busy, so it never says that all is processed."""
        stream = online.online_spikes(spark.readStream.schema(online.TRACE).parquet(tr), hold=200, idle=idle)
        q = stream.writeStream.format("memory").queryName("rest").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="300 milliseconds").start()
        end = time.time() + 40
        try:
            while not done(q) and time.time() < end:
                time.sleep(0.3)
        finally:
            q.stop()

    rows = lambda q: sum(p["numInputRows"] for p in q.recentProgress)
    sent = []

    def late(q):
        if rows(q) == 60 and not sent:
            put([3, 7], [99.0, 99.0])
            sent.append(1)
        return rows(q) == 62 and spark.table("rest").count() > 0

    until("5 seconds", late)
    spikes = {x.frame: x.spk for x in spark.table("rest").collect()}
    whole = T.deconvolve_array(v, np.exp(-0.1))
    assert {k for k in spikes if spikes[k] > 1e-9} == {k for k in range(1, 60) if whole[k] > 1e-9} and all(abs(spikes[k] - whole[k]) < 1e-9 for k in spikes)


def test_chain_of_a_plane_without_plane_zero_and_of_planes_that_crop_differently(spark, tmp_path):
    frames = planted(spark, frames=240, planes=2)
    s = S.overlay(S.Settings(), {"fs": 2.0, "diameter": [6, 6], "registration": {"nonrigid": False, "maxregshift": 0.05}, "detection": {"bin_size": 1, "npix_norm_min": 0.1, "sparse": {"highpass_neuropil": 15}}, "extraction": {"min_neuropil_pixels": 60}, "run": {"do_deconvolution": False}})
    alone = pipeline.run(frames.where("plane = 1"), 40, 40, str(tmp_path / "one"), s)["stats"].toPandas()
    assert len(alone) >= 6 and alone["npix_norm"].notna().all() and abs(alone["npix_norm"].median() - 1) < 0.5
    bad = frames.select("plane", "frame").distinct().withColumn("bad", pipeline.F.lit(False))
    ranges = spark.createDataFrame([(0, 0, 40, 0, 40), (1, 3, 38, 12, 40)], "plane int, y0 int, y1 int, x0 int, x1 int")
    found = pipeline.detect(frames.select("plane", "frame", "arr"), bad, ranges, 40, 40, s).toPandas()
    for plane, spots in ((0, [(7, 8), (9, 29), (20, 18), (30, 7), (31, 31), (19, 33)]), (1, [(9, 29), (20, 18), (31, 31), (19, 33)])):
        centres = [(p["y"].mean(), p["x"].mean()) for _, p in found[found["plane"] == plane].groupby("roi")]
        assert all(min(abs(a - y) + abs(b - x) for a, b in centres) <= 3 for y, x in spots)
    assert found[found["plane"] == 0]["x"].min() < 12 <= found[found["plane"] == 1]["x"].min()


def test_user_settings_folders_and_log(tmp_path):
    from calspark.session import log_to

    assert S.user_settings(str(tmp_path / "none.json")) == S.Settings()
    (tmp_path / "s.json").write_text('{"fs": 7.0, "run": {"do_detection": false}}')
    mine = S.user_settings(str(tmp_path / "s.json"))
    assert mine.fs == 7 and not mine.run.do_detection and mine.tau == 1
    assert S.save_folder(S.Recording(data_path=["/a/b/"])) == "/a/b/calspark" and S.save_folder(S.Recording(), "/x", "y") == "/x/y"
    with pytest.raises(ValueError):
        S.save_folder(S.Recording())
    log_to(str(tmp_path / "l")).info("hello")
    log_to()
    assert "hello" in (tmp_path / "l" / "run.log").read_text()


def test_command_line(capsys, tmp_path):
    from calspark.__main__ import main

    assert main(["--print-settings"]) == 0
    assert "nplanes" in capsys.readouterr().out
    (tmp_path / "s.json").write_text(json.dumps({"fs": 5.0}))
    assert S.overlay(S.Settings(), S.load(str(tmp_path / "s.json"))).fs == 5
    with pytest.raises(SystemExit):
        main([])


def test_package_reaches_the_workers(spark):
    from pyspark import SparkFiles

    from calspark.session import ship

    ship(spark)
    ship(spark)

    def where(it):
        import os

        for pdf in it:
            yield pd.DataFrame({"there": [os.path.exists(SparkFiles.get("calspark.zip"))]})

    assert spark.range(1).mapInPandas(where, "there boolean").first().there


def test_command_line_from_files(spark, tmp_path):
    """Two planes interleaved in .tif files, through the whole chain, as the command line does it."""
    from calspark.__main__ import main

    stack = {(r.plane, r.frame): np.array(r.arr).reshape(40, 40) for r in planted(spark, frames=120).collect()}
    pages = np.stack([stack[p, t] * 50 + 200 for t in range(120) for p in (0, 1)])
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "m1.tif").write_bytes(tiff.encode(pages[:100], True))
    (tmp_path / "in" / "m2.tif").write_bytes(tiff.encode(pages[100:]))
    (tmp_path / "what.json").write_text(json.dumps({"nplanes": 2}))
    (tmp_path / "how.json").write_text(json.dumps({"fs": 2.0, "diameter": [6, 6], "registration": {"nonrigid": False, "maxregshift": 0.05}, "detection": {"bin_size": 1, "sparse": {"highpass_neuropil": 15}}, "extraction": {"min_neuropil_pixels": 60}, "run": {"do_deconvolution": False, "do_regmetrics": False}}))
    out = str(tmp_path / "out")
    assert main(["--input", str(tmp_path / "in"), "--recording", str(tmp_path / "what.json"), "--settings", str(tmp_path / "how.json"), "--out", out, "--plane", "1"]) == 0
    stats = spark.read.parquet(out + "/result/stats").toPandas()
    assert len(stats) and (stats["roi"] // 1_000_000 == 1).all()
    assert spark.read.parquet(out + "/registered").count() == 120 and "table stats" in (tmp_path / "out" / "run.log").read_text()
