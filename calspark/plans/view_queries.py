"""Queries behind interactive views, benchmark movies and frames across files."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from calspark.operators import detection as D
from calspark.operators import interactive as I
from calspark.operators import masks as M
from calspark.operators import movie as V
from calspark.operators import registration as G
from calspark.operators import traces as T
from calspark.operators.labels import labelled
from calspark.plans import carriers as C
from calspark.plans.movie_queries import _COUNTS, BLOCK, _counts, _first, _masked, _reflect, _synthetic, _taps, _timed
from calspark.plans.trace_queries import _BINS, BIN, R, _r, _stats


def activity_corrected(spark, d):
    return I.activity(C.traces(spark, d), "corrected")


def statistic_scaled(spark, d):
    return _r(I.scaled(T.skew_std(C.traces(spark, d), "f"), "std", 0.01, 0.99), "s")


def statistic_colours(spark, d):
    n = C.traces(spark, d).groupBy("roi").agg(F.count(F.lit(1)).cast("double").alias("n"))
    return I.scaled(n, "n").select("roi", I.colour(F.col("s")).alias("c")).select("roi", "c.r", "c.g", "c.b")


def image_scaled(spark, d):
    return _r(I.image_scaled(V.max_projection(C.pixels(spark, d))), "v")


def image_enhanced(spark, d):
    return _r(I.enhanced_mean(V.max_projection(C.pixels(spark, d)), 1), "v", digits=5)


def image_for_segmentation(spark, d):
    p = C.pixels(spark, d).withColumn("v", F.abs("v"))
    return _r(I.segmentation_image(V.mean_image(p), V.max_projection(p)), "v")


def image_segmented(spark, d):
    return I.segmented(V.max_projection(C.pixels(spark, d)), I.threshold_segmenter(0.7), 8, 8)


def image_labelled_tiles(spark, d):
    """The same labels from tiles of 3 x 3, joined across their borders."""
    return labelled(V.max_projection(C.pixels(spark, d)), 0.7, 3)


def label_statistics(spark, d):
    labels = I.segmented(V.max_projection(C.pixels(spark, d)), I.threshold_segmenter(0.7), 8, 8)
    return _r(M.label_centres(labels.select((F.col("plane") * 1000 + F.col("label")).alias("label"), "y", "x")), "diameter")


def image_patches(spark, d):
    image = C.masks(spark, d).groupBy("y", "x").agg(F.sum("lam").alias("v"))
    centres = C.table(spark, d, "supplier").select(F.col("s_suppkey").alias("roi"), (F.col("s_suppkey") * 7 % 40).cast("int").alias("y"), (F.col("s_suppkey") * 11 % 64).cast("int").alias("x"))
    return I.patches(image, centres, 3)


def region_circles(spark, d):
    r = C.table(spark, d, "nation").select(F.col("n_nationkey").alias("roi"), (F.col("n_nationkey") * 13 + 40).alias("y"), (F.col("n_nationkey") * 5 + 60).alias("x"), (2.0 + F.col("n_regionkey") * 1.7).alias("radius"))
    return I.circles(r, 50)


def mask_pixel_distances(spark, d):
    """Regions of suppliers whose nations have the same last digit against one another."""
    s = C.table(spark, d, "supplier").withColumn("digit", F.col("s_nationkey") % 10)
    a, b = s.select(F.col("s_suppkey").alias("a"), "digit").repartition(64, "a"), s.select(F.col("s_suppkey").alias("b"), "digit")  # few rows, many pairs
    once = not s.groupBy("s_suppkey").count().where("count > 1").limit(1).count()
    return _r(I.pixel_distances(C.tile_masks(spark, d), a.join(b, "digit").where("a < b"), once), "distance")


def mask_iou_between(spark, d):
    m = C.masks(spark, d)
    return _r(M.iou_between(m.where("lam > 15"), m.where("lam < 45")), "iou")


def traces_merged(spark, d):
    t = C.traces(spark, d)
    return _r(I.merged_traces(t, t.select("roi").distinct().withColumn("group", F.expr("roi - roi % 3"))), "f", "fneu", digits=5)


def labels_with_defaults(spark, d):
    stats = C.table(spark, d, "documents").select(F.col("doc_id").alias("roi"))
    labels = C.table(spark, d, "labels").select(F.col("doc_id").alias("roi"), (F.col("quality") == 1).alias("iscell"), (F.col("quality") * 0.5).alias("prob"))
    return I.with_default_labels(stats, labels)


def activity_sorted(spark, d):
    return _r(I.sorted_activity(T.bin_mean(C.traces(spark, d), "f", BIN)), "v", digits=4)


def movie_strided(spark, d):
    return I.strided(C.pixels(spark, d))


def movie_above_baseline(spark, d):
    return _r(I.above_baseline(_timed(spark, d), 7).select("plane", "frame", "y", "x", "v"), "v")


def movie_basis_weights(spark, d):
    return _r(I.projected(C.pixels(spark, d), D.neuropil_basis(2, 8, 8), 8), "w")


def nearest_regions(spark, d):
    s = C.table(spark, d, "supplier")
    at = lambda name, a, b: s.select(F.col("s_suppkey").alias(name), (F.col("s_suppkey") * a % 97).alias("y"), (F.col("s_suppkey") * b % 89).alias("x"))
    return I.nearest_ranked(at("a", 31, 17), at("b", 41, 23), 3)


def frames_located(spark, d):
    files = C.table(spark, d, "nation").select(F.col("n_nationkey").alias("rank"), F.col("n_name").alias("file"), (F.col("n_nationkey") * 37 % 11).cast("long").alias("n_frames"))
    return I.located(files, spark.range(130).withColumnRenamed("id", "frame"))


def frames_forward_filled(spark, d):
    m = C.movie(spark, d).withColumn("arr", F.when(F.element_at("arr", 2) > -0.1, F.col("arr")))
    return C.exploded(I.forward_filled(m))


def channel2_registered(spark, d):
    m = _synthetic(spark, d)
    done = G.register(m, _first(m), 24, 24, G.RigidSettings(max_shift=0.1, spatial_taper=1.0, norm_frames=False), BLOCK)
    same = G.apply_offsets(m, done, 24, 24, BLOCK)
    return same.join(done.select("plane", "frame", F.col("arr").alias("first")), ["plane", "frame"]).select("plane", "frame", (F.col("arr") == F.col("first")).alias("same"))


def phase_corr_smoothed(spark, d):
    m = _counts(spark, d)
    return _r(G.rigid_offsets_smoothed(m, _first(m), 8, 8, 1.0, 20, G.RigidSettings(max_shift=0.4, spatial_taper=0.8)), "corr")


def mean_image_upsampled(spark, d):
    m = _synthetic(spark, d)
    done = G.register(m, _first(m), 24, 24, G.RigidSettings(max_shift=0.1, spatial_taper=1.0, norm_frames=False), BLOCK)
    return _r(G.upsampled_mean(m, done, 24, 24, 2, BLOCK), "v", digits=4)


def masks_extended(spark, d):
    """The suppliers' boxes on frames of 40 x 40, all frames as one field of view."""
    boxes = C.tile_masks(spark, d, C.WIDE)
    return D.extended(C.wide_movie(spark, d), boxes, C.WIDE, C.WIDE, 0.05).groupBy("roi").agg(F.count(F.lit(1)).alias("npix"), F.round(F.sum("lam"), 3).alias("weight"))


QUERIES = {f.__name__: f for f in (
    activity_corrected, statistic_scaled, statistic_colours, image_scaled, image_enhanced, image_for_segmentation, image_segmented, image_labelled_tiles, label_statistics, image_patches, region_circles, mask_pixel_distances, mask_iou_between,
    traces_merged, labels_with_defaults, activity_sorted, movie_strided, movie_above_baseline, movie_basis_weights, nearest_regions, frames_located, frames_forward_filled, channel2_registered, phase_corr_smoothed, mean_image_upsampled, masks_extended,
)}

_T = "fr as (select distinct plane, frame from pixels), tt as (select plane, frame, row_number() over (partition by plane order by frame) - 1 t from fr), tp as (select * from pixels join tt using (plane, frame))"
_HUE = "(1 - (s / 1.4 + 0.4 / 1.4)) * 6"


def _channel(offset: float) -> str:
    k = f"(({offset} + h) - 6.0 * floor(({offset} + h) / 6.0))"
    return f"cast(floor(255 * (1 - greatest(0.0, least({k}, 4 - {k}, 1.0)))) as int)"


def _basis() -> str:
    b = D.neuropil_basis(2, 8, 8)
    return ", ".join(f"({k}, {i // 8}, {i % 8}, cast({float(row[i])!r} as double))" for k, row in enumerate(b) for i in range(64))


ORACLES = {
    "activity_corrected": f"with {C.TRACES} select roi, frame, df v from c",
    "statistic_scaled": f"with {C.TRACES}, {_stats('traces', 'f')}, q as (select quantile_cont(std, 0.01) a, quantile_cont(std, 0.99) b from sk) select roi, {R('least(greatest((std - a) / nullif(b - a, 0), 0.0), 1.0)')} s from sk, q",
    "statistic_colours": f"with n as (select user_id roi, cast(count(*) as double) n from events group by 1), q as (select min(n) a, max(n) b from n), z as (select roi, (n - a) / nullif(b - a, 0) s from n, q), h as (select roi, cast(1 - (s / cast(1.4 as double) + cast(0.4 as double) / cast(1.4 as double)) as double) * 6 h from z) select roi, {_channel(5.0)} r, {_channel(3.0)} g, {_channel(1.0)} b from h",
    "image_scaled": f"with {C.PIXELS}, mp as (select plane, y, x, max(v) v from pixels group by all), q as (select plane, quantile_cont(v, 0.01) a, quantile_cont(v, 0.99) b from mp group by plane) select plane, y, x, {R('least(greatest((v - a) / (b - a), 0.0), 1.0)')} v from mp join q using (plane)",
    "image_for_segmentation": f"with {C.PIXELS} select plane, y, x, {R('ln(greatest(1e-3, max(abs(v)) / greatest(1e-3, avg(abs(v)))))')} v from pixels group by plane, y, x",
    "image_patches": f"with {C.MASKS}, im as (select y, x, sum(lam) v from masks group by all), c as (select s_suppkey roi, cast(s_suppkey * 7 % 40 as int) cy, cast(s_suppkey * 11 % 64 as int) cx from supplier) select roi, cast(a.i as int) py, cast(b.i as int) px, coalesce(v, 0) v from c, range(6) a(i), range(6) b(i) left join im on im.y = cy + a.i - 3 and im.x = cx + b.i - 3",
    "region_circles": f"select n_nationkey roi, cast(k.i as int) k, cast(trunc((2.0 + n_regionkey * cast(1.7 as double)) * 1.25 * cos(k.i * {2 * math.pi / 49!r}) + n_nationkey * 13 + 40) as int) y, cast(trunc((2.0 + n_regionkey * cast(1.7 as double)) * 1.25 * sin(k.i * {2 * math.pi / 49!r}) + n_nationkey * 5 + 60) as int) x from nation, range(50) k(i)",
    "mask_pixel_distances": f"with {C.TILES} select p.roi a, q.roi b, {R('avg(sqrt(power(p.y - q.y, 2) + power(p.x - q.x, 2)))')} distance from supplier m join supplier n on m.s_nationkey % 10 = n.s_nationkey % 10 and m.s_suppkey < n.s_suppkey join tiles p on p.roi = m.s_suppkey join tiles q on q.roi = n.s_suppkey group by 1, 2",
    "mask_iou_between": f"with {C.MASKS}, a as (select * from masks where lam > 15), b as (select * from masks where lam < 45), na as (select roi, count(*) n from a group by 1), nb as (select roi, count(*) n from b group by 1), io as (select a.roi r, b.roi s, count(*) n from a join b using (y, x) group by 1, 2) select na.roi, {R('coalesce(max(io.n / (na.n + nb.n - io.n)), 0)')} iou from na left join io on io.r = na.roi left join nb on nb.roi = io.s group by na.roi",
    "traces_merged": f"with {C.TRACES} select roi - roi % 3 roi, frame, {R('avg(f)', 5)} f, {R('avg(fneu)', 5)} fneu from traces group by roi - roi % 3, frame",
    "labels_with_defaults": "select doc_id roi, coalesce(quality = 1, true) iscell, cast(coalesce(quality * 0.5, 1.0) as double) prob from documents left join labels using (doc_id)",
    "movie_strided": f"with {C.PIXELS} select plane, frame, cast(y // 2 as int) y, cast(x // 2 as int) x, v from pixels where y % 2 = 0 and x % 2 = 0",
    "movie_above_baseline": f"with {C.PIXELS}, {_T}, lo as (select *, min(v) over (partition by plane, y, x order by t rows between 3 preceding and 3 following) low from tp) select plane, frame, y, x, {R('v - max(low) over (partition by plane, y, x order by t rows between 3 preceding and 3 following)')} v from lo",
    "movie_basis_weights": f"with {C.PIXELS}, b(k, y, x, b) as (values {_basis()}) select plane, frame, k, {R('sum(v * b)')} w from pixels join b using (y, x) group by plane, frame, k",
    "nearest_regions": "with a as (select s_suppkey a, s_suppkey * 31 % 97 y, s_suppkey * 17 % 89 x from supplier), b as (select s_suppkey b, s_suppkey * 41 % 97 y, s_suppkey * 23 % 89 x from supplier) select a, b, cast(row_number() over (partition by a order by power(a.y - b.y, 2) + power(a.x - b.x, 2), b) as int) rank from a, b qualify rank <= 3",
    "frames_located": "with f as (select n_nationkey r, n_name file, n_nationkey * 37 % 11 n from nation), s as (select *, coalesce(sum(n) over (order by r rows between unbounded preceding and 1 preceding), 0) st from f) select cast(g.i as bigint) frame, file, cast(g.i - st as bigint) local from range(130) g(i) join s on g.i >= st and g.i < st + n",
    "frames_forward_filled": f"with {C.PIXELS}, k as (select plane, frame, max(v) filter (y = 0 and x = 1) > cast(-0.1 as double) ok from pixels group by 1, 2), l as (select plane, frame, last_value(case when ok then frame end ignore nulls) over (partition by plane order by frame rows between unbounded preceding and current row) src from k) select l.plane, l.frame, p.y, p.x, p.v from l join pixels p on p.plane = l.plane and p.frame = l.src",
    "channel2_registered": "select label plane, vec_id frame, true same from embeddings",
}

_LABELS = f"""{C.PIXELS}, mp as (select plane, y, x, max(v) v from pixels group by all), th as (select plane, quantile_cont(v, 0.7) q from mp group by plane), ins as (select plane, y, x, y * 8 + x i from mp join th using (plane) where v > q),
wk(plane, i, y, x) as (select plane, i, y, x from ins union select w.plane, w.i, n.y, n.x from wk w join ins n on n.plane = w.plane and abs(n.y - w.y) + abs(n.x - w.x) = 1),
fi as (select plane, y, x, min(i) i from wk group by 1, 2, 3), lb as (select plane, y, x, dense_rank() over (partition by plane order by i) label from fi)"""
ORACLES["image_segmented"] = f"with recursive {_LABELS} select plane, y, x, label from lb"
ORACLES["image_labelled_tiles"] = ORACLES["image_segmented"]
ORACLES["label_statistics"] = f"""with recursive {_LABELS}, l as (select plane * 1000 + label label, y, x from lb), q as (select label, quantile_cont(y, 0.5) my, quantile_cont(x, 0.5) mx, 2 * sqrt(count(*) / pi()) diameter from l group by 1),
r as (select label, y, x, diameter, row_number() over (partition by label order by power(y - my, 2) + power(x - mx, 2), y, x) k from l join q using (label)) select label, y, x, {R('diameter')} diameter from r where k = 1"""
ORACLES["image_enhanced"] = f"""with {C.PIXELS}, mp as (select plane, y, x, max(v) v from pixels group by all), h as (select plane, y, x, v, avg(v) over w m, avg(v * v) over w s from mp window w as (partition by plane, y order by x rows between 2 preceding and 2 following)),
u as (select plane, y, x, v, avg(m) over w m, avg(s) over w s from h window w as (partition by plane, x order by y rows between 2 preceding and 2 following)), z as (select plane, y, x, (v - m) / (sqrt(greatest(s - m * m, 0)) + 1e-6) v from u),
q as (select plane, quantile_cont(v, 0.01) a, quantile_cont(v, 0.99) b from z group by plane) select plane, y, x, {R('least(greatest((v - a) / (b - a), 0.0), 1.0)', 5)} v from z join q using (plane)"""
ORACLES["phase_corr_smoothed"] = f"""with {_COUNTS}, {_masked("select plane key, y, x, arg_min(v, frame) v from px group by 1, 2, 3", "select plane key, plane, frame, y, x, v from px", 3, 0.8, 1.15)}, {_taps("taps", 1.0)},
fn as (select plane, frame, row_number() over (partition by plane order by frame) - 1 t from (select distinct plane, frame from px)), bt as (select plane, frame, t // 20 b, t % 20 j, count(*) over (partition by plane, t // 20) n from fn),
nx as (select plane, frame, b, {_reflect("j + k", "n")} i, sum(w) w from bt, taps group by all), sm as (select nx.plane, nx.frame, cc.dy, cc.dx, sum(nx.w * cc.c) c from nx join bt s on s.plane = nx.plane and s.b = nx.b and s.j = nx.i join cc on cc.frame = s.frame group by all),
bs as (select *, row_number() over (partition by frame order by c desc) k from sm) select plane, frame, cast(dy as int) yoff, cast(dx as int) xoff, {R('c')} corr from bs where k = 1"""
