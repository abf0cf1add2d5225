"""Queries on movies and their registration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from calspark.functions.columns import gaussian_taps
from calspark.operators import components as P
from calspark.operators import movie as V
from calspark.operators import registration as G
from calspark.plans import carriers as C
from calspark.plans.mask_queries import _DIL
from calspark.plans.trace_queries import R, _r

PLAIN = G.RigidSettings(max_shift=0.4, norm_frames=False)


def _pages(spark, d):
    return C.table(spark, d, "embeddings").select(F.col("vec_id").alias("page"))


def movie_demux_planes(spark, d):
    return V.demux(_pages(spark, d), 3, 2)


def movie_pingpong_planes(spark, d):
    return V.ping_pong(_pages(spark, d), 4)


def movie_crop(spark, d):
    return V.exploded(V.crop_frames(C.movie(spark, d), 8, 2, 6, 1, 8), 7)


def movie_narrow_int16(spark, d):
    raw = F.round(F.col("v") * 100_000).cast("int")
    return C.pixels(spark, d).select("frame", "y", "x", V.narrowed(raw, "uint16").cast("int").alias("halved"), V.narrowed(raw, "float").cast("int").alias("clamped"))


def _bins(spark, d, bad):
    frames = C.movie(spark, d).select("plane", "frame", bad.alias("bad"))
    return V.binned(C.pixels(spark, d), V.frame_bins(frames, 4, batch=20))


def movie_bin(spark, d):
    return _r(_bins(spark, d, F.lit(False)), "v")


def movie_bin_badframes(spark, d):
    return _r(_bins(spark, d, F.element_at("arr", 1) > 0.05 * (F.col("plane") % 3 - 1)), "v")


def movie_mean_image(spark, d):
    return _r(V.mean_image(C.pixels(spark, d)), "v")


def movie_bin_blocks(spark, d):
    """The same bins on array frames: sums by task, no pixel rows."""
    frames = C.movie(spark, d).select("plane", "frame", (F.element_at("arr", 1) > 0.05 * (F.col("plane") % 3 - 1)).alias("bad"))
    x = V.binned_frames(C.movie(spark, d), V.frame_bins(frames, 4, batch=20))
    pixels = C.exploded(x.withColumn("frame", F.col("batch") * 1000 + F.col("bin")))
    return _r(pixels.select("plane", F.expr("frame div 1000").alias("batch"), (F.col("frame") % 1000).alias("bin"), "y", "x", "v"), "v")


def movie_mean_image_blocks(spark, d):
    return _r(C.exploded(V.summed_frames(C.movie(spark, d), ["plane"]).withColumn("frame", F.lit(0))).drop("frame"), "v")


def movie_max_projection(spark, d):
    return V.max_projection(C.pixels(spark, d))


def _timed(spark, d):
    return V.exploded(C.movie(spark, d)).join(V.ranked(C.movie(spark, d).select("plane", "frame")), ["plane", "frame"])


def movie_highpass_tumbling(spark, d):
    return _r(V.highpass(_timed(spark, d), 12).select("plane", "frame", "y", "x", "v"), "v")


def movie_highpass_gaussian(spark, d):
    return _r(V.highpass(_timed(spark, d), 2).select("plane", "frame", "y", "x", "v"), "v")


def movie_noise_std(spark, d):
    return _r(V.noise_std(_timed(spark, d), 16), "sd")


def movie_downsample2(spark, d):
    return _r(V.downsample2(V.crop(C.pixels(spark, d), 0, 7, 0, 8), 7, 8), "v")


def movie_box_subtract(spark, d):
    return _r(V.neuropil_subtracted(C.pixels(spark, d), 3), "v")


def movie_square_filter(spark, d):
    return _r(V.square_filter(C.pixels(spark, d), 4), "v")


def movie_threshold_reduce(spark, d):
    return _r(V.threshold_reduce(C.pixels(spark, d), 0.15), "v")


def movie_local_maxima(spark, d):
    return V.local_maxima(V.max_projection(C.pixels(spark, d)), 3)


def _scales(spark, d):
    return C.pixels(spark, d).groupBy("plane", (F.col("frame") % 4).cast("int").alias("scale"), "y", "x").agg(F.max("v").alias("v"))


def movie_scale_mode(spark, d):
    return V.scale_mode(_scales(spark, d), 10, 3)


def movie_morph_open(spark, d):
    return V.morph_open(V.max_projection(C.pixels(spark, d)), 1.0)


def correlation_map(spark, d):
    return _r(V.correlation_map(C.pixels(spark, d), 0.8, 8, 8), "v")


def shift_roll(spark, d):
    x = C.pixels(spark, d).withColumn("yoff", (F.col("frame") % 5 - 2).cast("int")).withColumn("xoff", (F.col("frame") % 3 - 1).cast("int"))
    return V.rolled(x, 8, 8).select("frame", "y", "x", "v")


def shift_stored_offsets(spark, d):
    m = C.movie(spark, d)
    off = m.select("plane", "frame", (F.col("frame") % 5 - 2).cast("int").alias("yoff"), (F.col("frame") % 3 - 1).cast("int").alias("xoff"))
    return C.exploded(G.shifted(m, off, 8, 8)).select("frame", "y", "x", "v")


def shift_bidirectional(spark, d):
    p = C.pixels(spark, d)
    return V.bidirectional_shift(p, 2).unionByName(V.bidirectional_shift(p.withColumn("frame", F.col("frame") + 1_000_000), -2)).select("frame", "y", "x", "v")


def _counts(spark, d):
    """Frames in whole thousandths, so that sums are exact."""
    return C.movie(spark, d).withColumn("arr", F.transform("arr", lambda v: F.round(v * 1000)))


def reference_seed(spark, d):
    return G.seed_frames(_counts(spark, d), 8, 8)


def reference_refine(spark, d):
    return C.exploded(G.reference_images(_counts(spark, d), 8, 8).withColumn("frame", F.lit(0))).select("plane", "y", "x", "v")


def _first(m):
    return m.groupBy("plane").agg(F.min_by("arr", "frame").alias("arr"))


def phase_corr_rigid(spark, d):
    m = _counts(spark, d)
    return _r(G.rigid_offsets(m, _first(m), 8, 8, PLAIN, smooth=False, masked=False), "corr")


def phase_corr_masked(spark, d):
    m = _counts(spark, d)
    return _r(G.rigid_offsets(m, _first(m), 8, 8, G.RigidSettings(max_shift=0.4, spatial_taper=0.8)), "corr")


def bidiphase_estimate(spark, d):
    return G.bidiphase(_counts(spark, d), 8, 8, 3)


def _planes(spark, d):
    return C.table(spark, d, "nation").select(F.col("n_nationkey").alias("plane"))


def _gridded(df, height, width, block):
    """``df`` with a row for each block of the grid: b, iy, ix, y0, y1, x0, x1."""
    blocks, (_, nx), _ = G.block_grid(height, width, block)
    each = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("b", "iy", "ix", "y0", "y1", "x0", "x1"), (k, k // nx, k % nx, *box))]) for k, box in enumerate(blocks)])
    return df.withColumn("_g", F.explode(each)).select(*df.columns, "_g.*")


def block_grid(spark, d):
    """The blocks of every plane."""
    return _gridded(_planes(spark, d), 512, 400, (128, 100))


def _block_means(spark, d):
    """plane, b, n, v: the mean of every block of every plane over its pixels and frames, which overlapping blocks share."""
    p = _gridded(C.pixels(spark, d).groupBy("plane", "y", "x").agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("n")), 8, 8, (4, 4))
    inside = (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1")) & (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1"))
    return p.where(inside).groupBy("plane", "b").agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("v"))


def block_assign(spark, d):
    return _r(_block_means(spark, d), "v")


def kernel_smooth(spark, d):
    """The block means of every plane, each replaced by the kernel-weighted mean of all blocks."""
    k = G.block_smoother(3, 3)
    weights = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in k])
    x = _block_means(spark, d).select("plane", "v", F.posexplode(F.element_at(weights, F.col("b") + 1)).alias("b", "w"))
    return _r(x.groupBy("plane", "b").agg(F.sum(F.col("v") * F.col("w")).alias("v")), "v")


def kriging_upsample(spark, d):
    """The first 7 x 7 pixels of every plane's mean image on a grid ten times finer."""
    k, side = G.upsampler(3, 10)
    mean = C.pixels(spark, d).where("y < 7 and x < 7").groupBy("plane", "y", "x").agg(F.avg("v").alias("v"))
    weights = spark.createDataFrame([(i // 7, i % 7, [float(v) for v in k[i]]) for i in range(49)], "y int, x int, w array<double>")
    x = mean.join(F.broadcast(weights), ["y", "x"]).select("plane", "v", F.posexplode("w").alias("fine", "w"))
    return _r(x.groupBy("plane", "fine").agg(F.sum(F.col("v") * F.col("w")).alias("v")), "v")


def _synthetic(spark, d, size=24):
    """Frames of 24 x 24 tiled from the carrier, so that blocks have room."""
    m = _counts(spark, d)
    rows = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda y: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda x: F.element_at("arr", ((y * 5 + x * 3) % 64 + 1).cast("int")) + 3 * F.element_at("arr", ((y.cast("double") * y / 7 + x).cast("int") % 64 + 1)))))
    return m.select("plane", "frame", rows.alias("arr"))


BLOCK = G.BlockSettings(block=(12, 12), max_shift=2, pad=2, spatial_taper=0.6, norm_frames=False)


def nonrigid_shift(spark, d):
    m = _synthetic(spark, d)
    x = G.register(m, _first(m), 24, 24, G.RigidSettings(max_shift=0.1, spatial_taper=1.0, norm_frames=False), BLOCK)
    return x.select("plane", "frame", "yoff", "xoff", F.size("yoff1").alias("n_blocks"), F.round(F.aggregate("yoff1", F.lit(0.0), lambda s, v: s + F.abs(v)), 4).alias("moved"))


def nonrigid_warp(spark, d):
    m = _synthetic(spark, d)
    x = G.register(m, _first(m), 24, 24, G.RigidSettings(max_shift=0.1, spatial_taper=1.0, norm_frames=False), BLOCK)
    return x.select("plane", "frame", F.aggregate("arr", F.lit(0.0), lambda s, v: s + v).alias("total"))


def _z(spark, d):
    """Stand-in correlations: the mean of each row of a frame is a depth."""
    return C.pixels(spark, d).groupBy("plane", "frame", F.col("y").alias("z")).agg(F.avg("v").alias("corr"))


def zstack_argmax(spark, d):
    return G.z_position(_z(spark, d), 1.0)


def zstack_pivot(spark, d):
    return _r(G.z_table(_z(spark, d), 8), *[f"z{k}" for k in range(8)])


def zstack_correlate(spark, d):
    m = _counts(spark, d)
    stack = [np.fromfunction(lambda y, x, k=k: (y * (k + 2) + x * 3) % 11, (8, 8)) for k in range(3)]
    return _r(G.z_correlation(m, stack, G.RigidSettings(max_shift=0.3, spatial_taper=0.8)), "corr")


def crop_bad_frames(spark, d):
    return G.bad_frames(_offsets(spark, d), 40, 40, 0.02, 0.1, 5).select("plane", "frame", "bad")


def crop_range(spark, d):
    return G.crop_ranges(G.bad_frames(_offsets(spark, d), 40, 40, 0.02, 0.1, 5), 40, 40)


def _offsets(spark, d):
    e = C.table(spark, d, "events")
    return e.select(F.expr("cast(user_id % 7 as int)").alias("plane"), F.col("event_id").alias("frame"), (F.floor(F.col("value")) % 5 - 2).cast("int").alias("yoff"), (F.floor(F.col("value") * 10) % 5 - 2).cast("int").alias("xoff"), (0.5 + (F.col("event_id") % 17) / 17.0).alias("corr"))


def pca_low_high(spark, d):
    return P.low_high_frames(C.movie(spark, d), 8, 8, 2, 5, 2).select("plane", "pc", "side", F.round(F.aggregate("arr", F.lit(0.0), lambda s, v: s + v * v), 6).alias("energy"))


def pc_shift_metrics(spark, d):
    x = P.low_high_frames(_synthetic(spark, d), 24, 24, 2, 5)
    return _r(G.component_shifts(x, 24, 24, G.RigidSettings(max_shift=0.25, spatial_taper=1.0, norm_frames=False), BLOCK), "rigid", "mean_block", "max_block", "mean_both", digits=4)


def pca_denoise_blocks(spark, d):
    return _r(C.exploded(V.pca_denoised(C.movie(spark, d), 8, 8, (4, 4), 0.5)), "v")


def bleedthrough_regress(spark, d):
    """Two interleaved channels, demultiplexed by page."""
    p = V.demux(C.pixels(spark, d).withColumn("page", F.col("frame")).withColumn("v", F.abs("v")).withColumnRenamed("plane", "label"), 1, 2).withColumn("plane", F.col("label"))
    return _r(V.bleed_through(V.mean_image(p.where("channel = 0")), V.mean_image(p.where("channel = 1")), 8, 8, 2), "v")


def extract_traces(spark, d):
    from calspark.operators.masks import cell_masks

    return _r(V.weighted_traces(C.pixels(spark, d), cell_masks(C.tile_masks(spark, d, C.SMALL_SIDE))), "f")


def extract_neuropil(spark, d):
    from calspark.operators.extraction import extract
    from calspark.operators.masks import dilated

    t = C.tile_masks(spark, d, C.SMALL_SIDE)
    ring = dilated(t, 8, 8, 1).join(t.select("roi", "y", "x"), ["roi", "y", "x"], "left_anti")
    return extract(C.movie(spark, d), ring.withColumn("lam", F.lit(1.0)).where("false"), ring, 8, lambda x: _r(x, "fneu")).select("plane", "roi", "frame", "fneu")


def extract_traces_blocks(spark, d):
    """The block path: frames stay arrays, masks are one sparse matrix on every worker."""
    from calspark.operators.extraction import extract
    from calspark.operators.masks import cell_masks, dilated

    t = C.tile_masks(spark, d, C.SMALL_SIDE)
    ring = dilated(t, 8, 8, 1).join(t.select("roi", "y", "x"), ["roi", "y", "x"], "left_anti")
    return extract(C.movie(spark, d), cell_masks(t), ring, 8, lambda x: _r(x, "f", "fneu"))


QUERIES = {f.__name__: f for f in (
    movie_demux_planes, movie_pingpong_planes, movie_crop, movie_narrow_int16, movie_bin, movie_bin_badframes, movie_bin_blocks, movie_mean_image, movie_mean_image_blocks, movie_max_projection, movie_highpass_tumbling, movie_highpass_gaussian, movie_noise_std,
    movie_downsample2, movie_box_subtract, movie_square_filter, movie_threshold_reduce, movie_local_maxima, movie_scale_mode, movie_morph_open, correlation_map, shift_roll, shift_stored_offsets, shift_bidirectional,
    reference_seed, reference_refine, phase_corr_rigid, phase_corr_masked, bidiphase_estimate, block_grid, block_assign, kernel_smooth, kriging_upsample, nonrigid_shift, nonrigid_warp, zstack_argmax, zstack_pivot, zstack_correlate,
    crop_bad_frames, crop_range, pca_low_high, pc_shift_metrics, pca_denoise_blocks, bleedthrough_regress, extract_traces, extract_neuropil, extract_traces_blocks,
)}


def _taps(name: str, sigma: float) -> str:
    return f"{name}(k, w) as (values {', '.join(f'({k}, cast({w!r} as double))' for k, w in gaussian_taps(sigma, int(4 * sigma + 0.5)))})"


def _reflect(i: str, n: str) -> str:
    m = f"((({i}) % (2 * {n}) + 2 * {n}) % (2 * {n}))"
    return f"case when {m} >= {n} then 2 * {n} - 1 - {m} else {m} end"


_T = "fr as (select distinct plane, frame from pixels), tt as (select plane, frame, row_number() over (partition by plane order by frame) - 1 t from fr), tp as (select * from pixels join tt using (plane, frame))"


def _binned(bad: str) -> str:
    return f"""with {C.PIXELS}, f0 as (select plane, frame, {bad} bad from pixels group by plane, frame),
f1 as (select *, row_number() over (partition by plane order by frame) - 1 t, count(*) over (partition by plane) n, count(*) filter (not bad) over (partition by plane) good from f0),
f2 as (select *, greatest(least(good, 20), 1) size from f1), f3 as (select *, t // size batch, cast(ceil(n / size) as bigint) there from f2),
f4 as (select *, least(greatest(5000 // greatest(size // 4, 1), 1), there) kept from f3),
f5 as (select * from f4 where batch in (select unnest(list_transform(range(0, kept), lambda k: case when kept > 1 and k = kept - 1 then there - 1 else cast(floor(case when kept > 1 then k * ((there - 1) / (kept - 1)) else 0 end) as bigint) end)))),
f6 as (select *, avg(case when bad then 0 else 1 end) over (partition by plane, batch) share from f5),
f7 as (select plane, frame, batch, row_number() over (partition by plane, batch order by frame) - 1 k, count(*) over (partition by plane, batch) m from f6 where share <= 0.5 or not bad),
f8 as (select plane, frame, batch, case when m > 4 then k // 4 else 0 end bin from f7 where m <= 4 or k // 4 < m // 4)
select plane, batch, bin, y, x, {R('avg(v)')} v from pixels join f8 using (plane, frame) group by plane, batch, bin, y, x"""


_COUNTS = C.PIXELS + ", px as (select plane, frame, y, x, round(v * 1000) v from pixels)"
_MAXP = "mp as (select plane, y, x, max(v) v from pixels group by all)"
_DISK = "(values (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) s(dy, dx)"
_OFF = "off as (select cast(user_id % 7 as int) plane, event_id frame, cast(cast(floor(value) as bigint) % 5 - 2 as int) yoff, cast(cast(floor(value * 10) as bigint) % 5 - 2 as int) xoff, 0.5 + (event_id % 17) / 17.0 corr from events)"


def _median(c: str) -> str:
    return f"list_sort(list_concat(list({c}) over w, list_transform(range(0, 5 - count(*) over w), lambda z: cast(0 as double))))[3]"


_BAD = f"""{_OFF}, o2 as (select *, cast(yoff as double) dyo, cast(xoff as double) dxo, cast(corr as double) dc from off),
o3 as (select *, {_median('dyo')} my, {_median('dxo')} mx, {_median('dc')} mc from o2 window w as (partition by plane order by frame rows between 2 preceding and 2 following)),
o4 as (select *, sqrt(power(yoff - my, 2) + power(xoff - mx, 2)) dd from o3), o5 as (select *, dd / nullif(avg(dd) over (partition by plane), 0) r, greatest(0, coalesce(corr / nullif(mc, 0), 0)) c from o4),
mk as (select plane, frame, yoff, xoff, coalesce(case when c > 0 then r / c > 100 * 0.02 else r > 0 end, false) or abs(yoff) > 0.95 * 0.1 * 40 or abs(xoff) > 0.95 * 0.1 * 40 bad from o5)"""
_MEANS = """bl as (select cast(a.i * 3 + c.i as int) b, a.i * 2 y0, c.i * 2 x0 from range(3) a(i), range(3) c(i)), means as (select plane, b, count(*) n, avg(v) v from pixels join bl on y >= y0 and y < y0 + 4 and x >= x0 and x < x0 + 4 group by 1, 2)"""
_GRID = """ys as (select i iy, cast(floor(i * ((512 - 128) / 5.0)) as int) y0 from range(6) r(i)), xs as (select i ix, cast(floor(i * ((400 - 100) / 5.0)) as int) x0 from range(6) r(i))"""

ORACLES = {
    "movie_demux_planes": "select vec_id page, cast((vec_id // 2) % 3 as int) plane, cast(vec_id % 2 as int) channel, vec_id // 6 frame from embeddings",
    "movie_pingpong_planes": "select vec_id page, cast(case when vec_id % 8 < 4 then vec_id % 8 else 7 - vec_id % 8 end as int) plane from embeddings",
    "movie_crop": f"with {C.PIXELS} select plane, frame, y - 2 y, x - 1 x, v from pixels where y between 2 and 5 and x between 1 and 7",
    "movie_narrow_int16": f"with {C.PIXELS} select frame, y, x, cast(least(greatest(floor(round(v * 100000) / 2), -32768), 32766) as int) halved, cast(least(greatest(round(v * 100000), -32768), 32766) as int) clamped from pixels",
    "movie_bin": _binned("false"),
    "movie_bin_badframes": _binned("max(v) filter (y = 0 and x = 0) > cast(0.05 as double) * (plane % 3 - 1)"),
    "movie_mean_image": f"with {C.PIXELS} select plane, y, x, {R('avg(v)')} v from pixels group by plane, y, x",
    "movie_max_projection": f"with {C.PIXELS} select plane, y, x, max(v) v from pixels group by all",
    "movie_highpass_tumbling": f"with {C.PIXELS}, {_T} select plane, frame, y, x, {R('v - avg(v) over (partition by plane, y, x, t // 12)')} v from tp",
    "movie_highpass_gaussian": f"with {C.PIXELS}, {_T}, {_taps('taps', 2)}, n as (select plane, count(*) n from tt group by plane), w as (select t.plane, t.frame, t.t, {_reflect('t.t + k', 'n')} i, w from tt t join n using (plane), taps), s as (select w.plane, w.t, p.y, p.x, sum(w.w * p.v) s from w join tp p on p.plane = w.plane and p.t = w.i group by all) select plane, frame, y, x, {R('v - s')} v from tp join s using (plane, t, y, x)",
    "movie_noise_std": f"with {C.PIXELS}, {_T}, q as (select plane, y, x, v - lag(v) over (partition by plane, y, x, t // 16 order by t) d from tp) select plane, y, x, {R('greatest(sqrt(sum(d * d) / count(*)), 1e-10)')} sd from q group by plane, y, x",
    "movie_downsample2": f"with {C.PIXELS} select plane, frame, cast(y // 2 as int) y, cast(x // 2 as int) x, {R('avg(v) * case when y // 2 = 3 then 0.5 else 1.0 end')} v from pixels where y < 7 group by plane, frame, y // 2, x // 2",
    "movie_box_subtract": f"with {C.PIXELS} select a.plane, a.frame, a.y, a.x, {R('a.v - avg(b.v)')} v from pixels a join pixels b on a.frame = b.frame and abs(a.y - b.y) <= 1 and abs(a.x - b.x) <= 1 group by a.plane, a.frame, a.y, a.x, a.v",
    "movie_square_filter": f"with {C.PIXELS} select a.plane, a.frame, a.y, a.x, {R('sum(b.v) / 4')} v from pixels a join pixels b on a.frame = b.frame and b.y - a.y between -2 and 1 and b.x - a.x between -2 and 1 group by a.plane, a.frame, a.y, a.x",
    "movie_threshold_reduce": f"with {C.PIXELS} select plane, y, x, {R('sqrt(sum(case when v > cast(0.15 as double) then v * v else 0 end))')} v from pixels group by plane, y, x",
    "movie_local_maxima": f"with {C.PIXELS}, {_MAXP} select * from mp a where v = (select max(v) from mp b where a.plane = b.plane and abs(a.y - b.y) <= 1 and abs(a.x - b.x) <= 1)",
    "movie_scale_mode": f"""with {C.PIXELS}, sc as (select plane, cast(frame % 4 as int) scale, y, x, max(v) v from pixels group by all), be as (select plane, y, x, max(v) v, arg_max(scale, v) scale from sc group by 1, 2, 3),
pk as (select *, row_number() over (partition by plane order by v desc, y, x) rk from be a where v = (select max(v) from be b where a.plane = b.plane and abs(a.y - b.y) <= 1 and abs(a.x - b.x) <= 1)),
ct as (select plane, scale, count(*) n from pk where rk <= 10 group by 1, 2) select plane, arg_max(scale, n * 100 - scale) scale from ct group by plane""",
    "movie_morph_open": f"with {C.PIXELS}, {_MAXP}, er as (select m.plane, m.y + dy y, m.x + dx x, min(v) v from mp m, {_DISK} where m.y + dy between 0 and 7 and m.x + dx between 0 and 7 group by 1, 2, 3) select m.plane, cast(m.y + dy as int) y, cast(m.x + dx as int) x, max(v) v from er m, {_DISK} where m.y + dy between 0 and 7 and m.x + dx between 0 and 7 group by 1, 2, 3",
    "correlation_map": f"""with {C.PIXELS}, {_taps('taps', 0.8)}, s1 as (select plane, frame, ((y + k) % 8 + 8) % 8 y, x, sum(v * w) v from pixels, taps group by 1, 2, 3, 4), s2 as (select plane, frame, y, ((x + k) % 8 + 8) % 8 x, sum(v * w) v from s1, taps group by 1, 2, 3, 4),
ab as (select plane, y, x, sum(v * v) a from s2 group by 1, 2, 3), en as (select plane, y, x, sum(v * v) v from pixels group by 1, 2, 3), e1 as (select plane, ((y + k) % 8 + 8) % 8 y, x, sum(v * w) v from en, taps group by 1, 2, 3), e2 as (select plane, y, ((x + k) % 8 + 8) % 8 x, sum(v * w) b from e1, taps group by 1, 2, 3)
select plane, cast(y as int) y, cast(x as int) x, {R('a / b')} v from ab join e2 using (plane, y, x)""",
    "shift_roll": f"with {C.PIXELS} select frame, cast(((y - (frame % 5 - 2)) % 8 + 8) % 8 as int) y, cast(((x - (frame % 3 - 1)) % 8 + 8) % 8 as int) x, v from pixels",
    "shift_stored_offsets": f"with {C.PIXELS} select frame, cast(((y - (frame % 5 - 2)) % 8 + 8) % 8 as int) y, cast(((x - (frame % 3 - 1)) % 8 + 8) % 8 as int) x, v from pixels",
    "shift_bidirectional": f"with {C.PIXELS} select frame, y, x, case when y % 2 = 1 then coalesce(lag(v, 2) over w, v) else v end v from pixels window w as (partition by frame, y order by x) union all select frame + 1000000, y, x, case when y % 2 = 1 then coalesce(lead(v, 2) over w, v) else v end from pixels window w as (partition by frame, y order by x)",
    "reference_seed": f"""with {_COUNTS}, ce as (select plane, frame, y, x, v - avg(v) over (partition by frame) c from px), nn as (select frame, sqrt(sum(c * c)) n from ce group by frame),
pr as (select a.plane, a.frame f, b.frame g, sum(a.c * b.c) / (max(na.n) * max(nb.n)) r from ce a join ce b on a.plane = b.plane and a.y = b.y and a.x = b.x join nn na on na.frame = a.frame join nn nb on nb.frame = b.frame group by 1, 2, 3),
rk as (select *, row_number() over (partition by f order by r desc) k from pr), sc as (select plane, f, avg(r) s from rk where k between 2 and 20 group by 1, 2) select plane, arg_max(f, s) frame from sc group by plane""",
    "phase_corr_rigid": f"""with {_COUNTS}, uv as (select a.i u, b.i w from range(8) a(i), range(8) b(i)),
ft as (select plane, frame, u, w, sum(v * cos(2 * pi() * (u * y + w * x) / 8)) re, -sum(v * sin(2 * pi() * (u * y + w * x) / 8)) im from px, uv group by 1, 2, 3, 4),
wh as (select plane, frame, u, w, re / (1e-5 + sqrt(re * re + im * im)) re, im / (1e-5 + sqrt(re * re + im * im)) im from ft), rf as (select plane, min(frame) frame from px group by plane), rw as (select plane, u, w, re, im from wh join rf using (plane, frame)),
pq as (select a.plane, a.frame, a.u, a.w, a.re * b.re + a.im * b.im re, a.im * b.re - a.re * b.im im from wh a join rw b using (plane, u, w)),
lg as (select a.i - 3 dy, b.i - 3 dx from range(7) a(i), range(7) b(i)),
cc as (select plane, frame, dy, dx, sum(re * cos(2 * pi() * (u * dy + w * dx) / 8) - im * sin(2 * pi() * (u * dy + w * dx) / 8)) / 64 c from pq, lg group by 1, 2, 3, 4),
bs as (select *, row_number() over (partition by frame order by c desc) k from cc) select plane, frame, cast(dy as int) yoff, cast(dx as int) xoff, {R('c')} corr from bs where k = 1""",
    "bidiphase_estimate": f"""with {_COUNTS}, ft as (select plane, frame, y, w.i w, sum(v * cos(2 * pi() * w.i * x / 8)) re, -sum(v * sin(2 * pi() * w.i * x / 8)) im from px, range(8) w(i) group by 1, 2, 3, 4),
wh as (select plane, frame, y, w, re / (1e-5 + sqrt(re * re + im * im)) re, im / (1e-5 + sqrt(re * re + im * im)) im from ft),
pq as (select a.plane, a.w, sum(a.re * b.re + a.im * b.im) re, sum(a.im * b.re - a.re * b.im) im from wh a join wh b on a.frame = b.frame and a.w = b.w and a.y = b.y + 1 and a.y % 2 = 1 group by 1, 2),
cc as (select plane, l.i - 3 lag, sum(re * cos(2 * pi() * w * (l.i - 3) / 8) - im * sin(2 * pi() * w * (l.i - 3) / 8)) c from pq, range(7) l(i) group by 1, 2) select plane, cast(-arg_max(lag, c) as int) phase from cc group by plane""",
    "block_grid": f"with {_GRID} select n_nationkey plane, cast(iy * 6 + ix as int) b, cast(iy as int) iy, cast(ix as int) ix, y0, y0 + 128 y1, x0, x0 + 100 x1 from ys, xs, nation",
    "block_assign": f"with {C.PIXELS}, {_MEANS} select plane, b, n, {R('v')} v from means",
    "kernel_smooth": f"with {C.PIXELS}, {_MEANS}, k as (select a.i a, b.i b, exp(-(power(a.i // 3 - b.i // 3, 2) + power(a.i % 3 - b.i % 3, 2))) e from range(9) a(i), range(9) b(i)), w as (select a, b, e / sum(e) over (partition by b) w from k) select plane, cast(a as int) b, {R('sum(v * w)')} v from means join w using (b) group by plane, a",
    "zstack_argmax": f"with {C.PIXELS}, z as (select plane, frame, y z, avg(v) c from pixels group by 1, 2, 3), {_taps('taps', 1.0)}, w as (select plane, frame, z, {_reflect('z + k', '8')} i, w from z, taps), s as (select w.plane, w.frame, w.z, round(sum(w.w * q.c), 9) c from w join z q on q.frame = w.frame and q.z = w.i group by 1, 2, 3), r as (select *, row_number() over (partition by frame order by c desc, z) k from s) select plane, frame, z from r where k = 1",
    "zstack_pivot": f"with {C.PIXELS} select plane, frame, {', '.join(R(f'avg(v) filter (y = {k})') + f' z{k}' for k in range(8))} from pixels group by plane, frame",
    "crop_bad_frames": f"with {_BAD} select plane, frame, bad from mk",
    "crop_range": f"with {_BAD}, s as (select plane, avg(case when bad then 1 else 0 end) sh, max(abs(yoff)) filter (not bad) gy, max(abs(xoff)) filter (not bad) gx, max(abs(yoff)) ay, max(abs(xoff)) ax from mk group by plane), t as (select plane, cast(case when sh < 0.5 then gy else ay end as int) a, cast(case when sh < 0.5 then gx else ax end as int) b from s) select plane, a y0, 40 - a y1, b x0, 40 - b x1 from t",
    "bleedthrough_regress": f"""with {C.PIXELS}, a as (select plane, y, x, avg(abs(v)) filter (frame % 2 = 0) v1, avg(abs(v)) filter (frame % 2 = 1) v2 from pixels group by 1, 2, 3), {_taps('taps', 1)},
b as (select plane, y // 4 py, x // 4 px, sum(v1 * v2) / sum(v1 * v1) s from a group by all), ax as (select i.i, cast({_reflect('i.i + k', '8')} // 4 as int) part, sum(w) g from range(8) i(i), taps group by all),
bl as (select plane, q.i y, r.i x, sum(s * q.g * r.g) s from b join ax q on q.part = b.py join ax r on r.part = b.px group by all) select a.plane, a.y, a.x, {R('greatest(0.0, v2 - s * v1)')} v from a join bl using (plane, y, x)""",
    "extract_traces": f"with {C.SMALL_TILES}, {C.PIXELS}, k as (select *, count(*) over (partition by y, x) n from tiles), m as (select roi, y, x, lam / sum(lam) over (partition by roi) lam from k where n = 1) select plane, roi, frame, {R('sum(v * lam)')} f from pixels join m using (y, x) group by plane, roi, frame",
    "extract_neuropil": f"with {C.SMALL_TILES}, {C.PIXELS}, {_DIL.format(a='tiles', b='d1', h=7)}, ring as (select * from d1 where (roi, y, x) not in (select (roi, y, x) from tiles)) select plane, roi, frame, {R('avg(v)')} fneu from pixels join ring using (y, x) group by plane, roi, frame",
}


def _masked(references: str, frames: str, half: int, taper: float, sigma: float) -> str:
    """cc (key, plane, frame, dy, dx, c) of rf (key, y, x, v) and fr (key, plane, frame, y, x, v), by transforms written out."""
    angle = "2 * pi() * (u * y + w * x) / 8"
    return f"""rf as ({references}), fr as ({frames}),
bd as (select key, trunc(quantile_cont(v, 0.01)) lo, trunc(quantile_cont(v, 0.99)) hi from rf group by key), rc as (select key, y, x, least(greatest(v, lo), hi) v from rf join bd using (key)), rm as (select key, avg(v) m from rc group by key),
sg as (select i.i, 1 / (1 + exp((abs(i.i - 3.5) - (3.5 - 2 * {taper})) / {taper})) t, exp(-0.5 * power((i.i - 3.5) / {sigma}, 2)) g from range(8) i(i)), gs as (select i, g / sum(g) over () g from sg),
g1 as (select k.i u, sum(g * cos(2 * pi() * k.i * ((gs.i + 4) % 8) / 8)) re, -sum(g * sin(2 * pi() * k.i * ((gs.i + 4) % 8) / 8)) im from gs, range(8) k(i) group by 1),
g2 as (select a.u, b.u w, a.re * b.re - a.im * b.im g from g1 a, g1 b), uv as (select a.i u, b.i w from range(8) a(i), range(8) b(i)),
cl as (select key, plane, frame, y, x, least(greatest(v, lo), hi) * p.t * q.t + m * (1 - p.t * q.t) v from fr join bd using (key) join rm using (key) join sg p on p.i = y join sg q on q.i = x),
ft as (select key, plane, frame, u, w, sum(v * cos({angle})) re, -sum(v * sin({angle})) im from cl, uv group by 1, 2, 3, 4, 5), fw as (select key, plane, frame, u, w, re / (1e-5 + sqrt(re * re + im * im)) re, im / (1e-5 + sqrt(re * re + im * im)) im from ft),
rt as (select key, u, w, sum(v * cos({angle})) re, -sum(v * sin({angle})) im from rc, uv group by 1, 2, 3), rw as (select key, u, w, g * re / (1e-5 + sqrt(re * re + im * im)) re, g * im / (1e-5 + sqrt(re * re + im * im)) im from rt join g2 using (u, w)),
pq as (select a.key, a.plane, a.frame, a.u, a.w, a.re * b.re + a.im * b.im re, a.im * b.re - a.re * b.im im from fw a join rw b using (key, u, w)), lg as (select a.i - {half} dy, b.i - {half} dx from range({2 * half + 1}) a(i), range({2 * half + 1}) b(i)),
cc as (select key, plane, frame, dy, dx, sum(re * cos(2 * pi() * (u * dy + w * dx) / 8) - im * sin(2 * pi() * (u * dy + w * dx) / 8)) / 64 c from pq, lg group by all)"""


ORACLES["phase_corr_masked"] = f"""with {_COUNTS}, {_masked("select plane key, y, x, arg_min(v, frame) v from px group by 1, 2, 3", "select plane key, plane, frame, y, x, v from px", 3, 0.8, 1.15)},
bs as (select *, row_number() over (partition by frame order by c desc) k from cc) select plane, frame, cast(dy as int) yoff, cast(dx as int) xoff, {R('c')} corr from bs where k = 1"""
_STACK = "select z.i as key, cast(a.i as int) y, cast(b.i as int) x, (a.i * (z.i + 2) + b.i * 3) % 11 v from range(3) z(i), range(8) a(i), range(8) b(i)"
ORACLES["zstack_correlate"] = f"""with {_COUNTS}, {_masked(_STACK, "select z.i as key, plane, frame, y, x, v from px, range(3) z(i)", 2, 0.8, 1.15)}
select plane, frame, cast(key as int) z, {R('max(c)')} corr from cc group by plane, frame, key"""
ORACLES["movie_bin_blocks"] = ORACLES["movie_bin_badframes"]
ORACLES["movie_mean_image_blocks"] = ORACLES["movie_mean_image"]
ORACLES["extract_traces_blocks"] = f"select plane, roi, frame, coalesce(f, 0.0) f, coalesce(fneu, 0.0) fneu from ({ORACLES['extract_traces']}) full join ({ORACLES['extract_neuropil']}) using (plane, roi, frame)"
