"""The stage chain of a recording: registration, detection, extraction, deconvolution, classification, z alignment.

Every stage maps tables to tables; all planes go through one plan. Stage results that
later stages read more than once are written below ``folder`` as Parquet partitioned
by plane, which is also what a later run reuses.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calspark.operators import classify, components, deconvolution, detection, extraction, masks, movie, registration, rois, traces
from calspark.settings import Settings


#: Frames from which a trace is deconvolved by blocks.
LONG_TRACE = 1_000_000


@dataclass
class Stages:
    """Where the tables of a run are, by name."""

    spark: SparkSession
    folder: str

    def path(self, name: str) -> str:
        return f"{self.folder.rstrip('/')}/{name}"

    def exists(self, name: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(name) + "/_SUCCESS")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def save(self, name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))


def bin_size(n_frames: int, settings: Settings) -> int:
    return settings.detection.bin_size or int(max(1, n_frames // settings.detection.nbins, round(settings.tau * settings.fs)))


def register(frames: DataFrame, height: int, width: int, settings: Settings, stages: Stages) -> tuple[DataFrame, DataFrame]:
    """(registered frames with offsets, reference images). References are saved before they are used, so that each is computed once."""
    s = settings.registration
    rigid = registration.RigidSettings(s.maxregshift, s.smooth_sigma, s.spatial_taper, s.norm_frames)
    blocks = registration.BlockSettings(tuple(s.block_size), s.maxregshiftNR, s.snr_thresh, 3, s.subpixel, s.smooth_sigma, s.spatial_taper, s.norm_frames) if s.nonrigid else None
    first = stages.save("first_references" if s.two_step_registration else "references", registration.reference_images(frames, height, width, s.nimg_init, rigid))
    done = registration.register(frames, first, height, width, rigid, blocks)
    if not s.two_step_registration:
        return done, first
    mean = stages.save("references", movie.summed_frames(done, ["plane"]).drop("n"))
    return registration.register(frames, mean, height, width, rigid, blocks), mean


def detect(registered: DataFrame, marked: DataFrame, ranges: DataFrame, height: int, width: int, settings: Settings) -> DataFrame:
    """plane, roi, y, x, lam on the whole field. Every plane is cropped to its own range; planes of one range share a plan."""
    d = settings.detection
    shared: dict[tuple, list] = {}
    for r in ranges.orderBy("plane").collect():  # a row a plane
        shared.setdefault((r["y0"], r["y1"], r["x0"], r["x1"]), []).append(r["plane"])
    n = marked.groupBy("plane").count().agg(F.max("count")).first()[0]
    bins = movie.frame_bins(marked.select("plane", "frame", "bad"), bin_size(n, settings), 500, d.nbins)
    sparse = detection.SparseSettings(d.threshold_scaling, d.sparse.highpass_neuropil, d.sparse.max_ROIs, d.sparse.spatial_scale, d.sparse.active_percentile)
    sign = -1.0 if d.inverted_activity else 1.0
    parts = []
    for (y0, y1, x0, x1), planes in shared.items():
        cut = movie.crop_frames(registered.where(F.col("plane").isin(planes)).select("plane", "frame", "arr"), width, y0, y1, x0, x1)
        binned = movie.binned_frames(cut, bins).select("plane", (F.col("batch") * 1_000_000 + F.col("bin")).alias("frame"), F.transform("arr", lambda v: sign * v).alias("arr"))
        if d.denoise:
            binned = movie.pca_denoised(binned, y1 - y0, x1 - x0, tuple(d.block_size), 0.5)
        found = detection.detect(binned, y1 - y0, x1 - x0, d.algorithm, sparse, float(np.mean(settings.diameter)), d.highpass_time, d.tile)
        parts.append(found.select("plane", "roi", (F.col("y") + y0).alias("y"), (F.col("x") + x0).alias("x"), "lam"))
    return reduce(DataFrame.unionByName, parts)


def mean_pixels(frames: DataFrame, width: int) -> DataFrame:
    """plane, y, x, v of the mean frame of every plane."""
    return movie.exploded(movie.summed_frames(frames, ["plane"]).withColumn("frame", F.lit(0)), width).drop("frame")


def keyed(m: DataFrame) -> DataFrame:
    """Masks of all planes as one table: roi becomes plane and number in one. Regions of a plane are numbered from 0, below a million."""
    return m.select("plane", (F.col("plane").cast("long") * 1_000_000 + F.col("roi")).alias("roi"), "y", "x", "lam", (F.col("y") * 100_000 + F.col("x")).alias("ord"))


def statistics(regions: DataFrame, settings: Settings) -> DataFrame:
    dy, dx = settings.diameter
    return rois.roi_stats(regions, dy, dx, settings.detection.soma_crop)


def run(frames: DataFrame, height: int, width: int, folder: str, settings: Settings = Settings(), classifier: classify.Classifier | None = None, zstack: list[np.ndarray] | None = None, frames2: DataFrame | None = None) -> dict[str, DataFrame]:
    """All tables of a run by name. frames: plane, frame, arr; frames2: the same of a second channel.

    Shifts are found in the first channel, or in the second with align_by_chan2, and
    applied to both.
    """
    spark = frames.sparkSession
    stages = Stages(spark, folder)
    out: dict[str, DataFrame] = {}
    s = settings.registration
    if s.do_bidiphase or s.bidiphase:
        phases = registration.bidiphase(frames, height, width) if not s.bidiphase else frames.select("plane").distinct().withColumn("phase", F.lit(s.bidiphase))
        frames = registration.lines_shifted(frames, phases, height, width)
        frames2 = frames2 and registration.lines_shifted(frames2, phases, height, width)
    flag = settings.run.do_registration
    if flag and (flag > 1 or not stages.exists("registered")):
        second = bool(frames2 and s.align_by_chan2)
        done, out["references"] = register(frames2 if second else frames, height, width, settings, stages)
        done = stages.save("registered2" if second else "registered", done)
        if frames2:
            blocks = registration.BlockSettings(tuple(s.block_size)) if s.nonrigid else None
            moved = registration.apply_offsets(frames if second else frames2, done, height, width, blocks)
            registration.check_offsets(frames if second else frames2, done)
            offsets = done.select("plane", "frame", "yoff", "xoff", "corr")
            stages.save("registered" if second else "registered2", moved.join(offsets, ["plane", "frame"]))
            out["registered2"] = stages.read("registered2")
        out["registered"] = stages.read("registered")
    elif stages.exists("registered"):
        out["registered"] = stages.read("registered")
    else:
        out["registered"] = stages.save("registered", frames.select("plane", "frame", "arr").withColumns({"yoff": F.lit(0), "xoff": F.lit(0), "corr": F.lit(1.0)}))
    moved = out["registered"]
    count = moved.groupBy("plane").count().agg(F.min("count")).first()[0]
    window = min((count // 2) * 2 - 1, 101)
    out["offsets"] = stages.save("offsets", registration.bad_frames(moved.select("plane", "frame", "yoff", "xoff", "corr"), height, width, s.th_badframes, s.maxregshift, max(1, window)))
    out["ranges"] = registration.crop_ranges(out["offsets"], height, width)
    out["mean_image"] = mean_pixels(moved, width)
    if settings.run.do_regmetrics and count >= 1500:
        low_high = components.low_high_frames(registration.sample_frames(moved.select("plane", "frame", "arr"), 2000), height, width, 30, 300)
        out["regmetrics"] = registration.component_shifts(low_high, height, width)
    if not settings.run.do_detection:
        return out
    e = settings.extraction
    regions = keyed(stages.save("detected", detect(moved, out["offsets"], out["ranges"], height, width, settings)))
    kept = masks.greedy_overlap_filter(regions, settings.detection.max_overlap)
    regions = stages.save("masks", regions.join(kept.select("roi"), "roi", "left_semi"))
    stats = statistics(regions, settings)
    d = settings.detection
    stats = stages.save("shape", stats.where((F.col("npix_norm") >= d.npix_norm_min) & (F.col("npix_norm") <= d.npix_norm_max)))
    regions = regions.join(stats.select("roi"), "roi", "left_semi")
    if classifier and settings.classification.preclassify > 0:
        good = classifier.predict(stats.withColumn("skew", F.lit(None).cast("double")), settings.classification.preclassify).where("iscell")
        regions, stats = regions.join(good.select("roi"), "roi", "left_semi"), stats.join(good.select("roi"), "roi", "left_semi")
    radius = stats.agg(F.percentile("radius", F.lit(0.5))).first()[0] or 1.0
    parts = []
    for r in regions.select("plane").distinct().orderBy("plane").collect():  # a plane's masks and frames meet in one plan each
        mine = regions.where(F.col("plane") == r["plane"])
        flagged = mine if e.allow_overlap else masks.overlap_flags(mine).where(~F.col("overlap"))
        cells = masks.normalised(flagged)
        taken = masks.cell_pixels(mine, radius, e.lam_percentile, height, width)
        rings = masks.neuropil_rings(mine, taken, height, width, e.inner_neuropil_radius, e.min_neuropil_pixels, 5, e.circular_neuropil) if e.neuropil_extract else mine.select("roi", "y", "x").limit(0)
        parts.append(extraction.extract(moved.where(F.col("plane") == r["plane"]), cells, rings, width))
    if not parts:
        return out | {"masks": regions, "stats": stats}
    t = parts[0]
    for p in parts[1:]:
        t = t.unionByName(p)
    t = traces.neuropil_corrected(stages.save("traces", t), e.neuropil_coefficient)
    t = traces.filtered_by_snr(t, e.snr_threshold)
    out["traces"], out["masks"] = t, regions
    out["stats"] = stats.join(traces.snr(t), "roi").join(traces.skew_std(t), "roi")
    if "registered2" in out:
        image = movie.bleed_through(out["mean_image"], mean_pixels(out["registered2"], width), height, width).withColumnRenamed("plane", "_p")
        ring = masks.dilated(regions.select("roi", "y", "x"), height, width, e.inner_neuropil_radius + 3).join(regions.select("roi", "y", "x"), ["roi", "y", "x"], "left_anti")
        by_plane = lambda m: m.withColumn("_p", F.expr("cast(roi div 1000000 as int)"))
        inside = masks.normalised(regions).transform(by_plane).join(image, ["_p", "y", "x"]).groupBy("roi").agg(F.greatest(F.sum(F.col("lam") * F.col("v")), F.lit(1e-3)).alias("inside"))
        outside = ring.transform(by_plane).join(image, ["_p", "y", "x"]).groupBy("roi").agg(F.avg("v").alias("outside"))
        prob = F.try_divide("inside", F.col("inside") + F.col("outside"))
        out["redcell"] = inside.join(outside, "roi").select("roi", prob.alias("redprob"), (prob > d.chan2_threshold).alias("redcell"))
    if settings.run.do_deconvolution:
        b = settings.dcnv_preprocess
        flat = traces.preprocess(t, "df", b.baseline, int(b.win_baseline * settings.fs), b.sig_baseline, b.prctile_baseline)
        # a trace of very many frames is no single task's
        spikes = deconvolution.deconvolve_blocks if count > LONG_TRACE else traces.deconvolve
        out["spikes"] = spikes(flat, "corrected", settings.tau, settings.fs)
    if classifier:
        out["labels"] = classifier.predict(out["stats"])
    if zstack:
        out["zcorr"] = registration.z_correlation(frames, zstack, registration.RigidSettings(s.maxregshift, s.smooth_sigma, s.spatial_taper, s.norm_frames))
        out["zposition"] = registration.z_position(out["zcorr"])
    return out
