"""Queries on detection, classification, layout, evaluation, files and formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from calspark.functions.columns import gaussian_taps
from calspark.functions.strings import file_order
from calspark.operators import classify as K
from calspark.operators import detection as D
from calspark.operators import evaluate as E
from calspark.operators import layout as L
from calspark.operators import masks as M
from calspark.operators import traces as T
from calspark.plans import carriers as C
from calspark.plans.trace_queries import _BINS, BIN, R, _r
from calspark.sources.tables import materialize

NODES = 50


def _summary(masks):
    return masks.groupBy("plane", "roi").agg(F.count(F.lit(1)).alias("npix"), F.round(F.sum(F.col("y") * F.col("lam")) / F.sum("lam"), 3).alias("y"), F.round(F.sum(F.col("x") * F.col("lam")) / F.sum("lam"), 3).alias("x"))


SPARSE = D.SparseSettings(highpass_neuropil=15)


def _sparse(spark, d):
    return D.detect(C.wide_movie(spark, d), C.WIDE, C.WIDE, "sparse", SPARSE)


def _svd(spark, d):
    return D.detect(C.wide_movie(spark, d), C.WIDE, C.WIDE, "components", D.SparseSettings(threshold_scaling=0.6), diameter=6.0)


def detect_sparse(spark, d):
    return _summary(_sparse(spark, d))


def detect_svd(spark, d):
    return _summary(_svd(spark, d))


def split_test(spark, d):
    """A supplier's box on the plane of its number."""
    boxes = C.tile_masks(spark, d, C.WIDE).withColumn("plane", (F.col("roi") % 10).cast("int"))
    return _r(D.split_tests(C.wide_movie(spark, d), boxes, C.WIDE, 2.0), "ratio", digits=4)


def detect_f1(spark, d):
    """Regions of the sparse search against those on components, planes one below the other."""
    movie, below, number = C.wide_movie(spark, d), (F.col("y") + F.col("plane") * C.WIDE).alias("y"), (F.col("plane").cast("long") * 100_000 + F.col("roi")).alias("roi")
    sides = [materialize(search(spark, d), "found") for search in (_sparse, _svd)]
    found, other = (m.select(number, below, "x", "lam") for m in sides)
    traces = (D.region_traces(movie, m, C.WIDE).select(number, F.col("frame").alias("bin"), "v") for m in sides)
    return _r(E.f1(E.matches(found, other, *traces, 0.3, 0.5), found, other), "f1")


def classifier_grid(spark, d):
    return _r(K.grid(C.train(spark, d), nodes=NODES), "node", "p")


def classifier_smooth(spark, d):
    return _r(K.smoothed(K.grid(C.train(spark, d), nodes=NODES), NODES), "node", "p")


def classifier_logodds(spark, d):
    t = C.train(spark, d)
    rows = K.grid(t, ("compact",), NODES).orderBy("bin").collect()
    z = K.log_odds(F.col("compact"), [r["node"] for r in rows], [r["p"] for r in rows if r["p"] is not None])
    return _r(t.select("roi", z.alias("z")), "z")


def classifier_predict(spark, d):
    t = C.train(spark, d)
    p = K.Classifier.fit(t).predict(t)
    return p.join(t.select("roi", F.col("iscell").alias("label")), "roi").groupBy("label", "iscell").agg(F.count(F.lit(1)).alias("n"))


def classifier_override(spark, d):
    t = C.train(spark, d).select("roi", (F.col("iscell") == 1).alias("iscell"))
    return K.flipped(t, C.train(spark, d).where("npix_norm > 0.05").select("roi", (F.col("iscell") != 1).alias("iscell")))


def training_union(spark, d):
    t = C.train(spark, d)
    long, labelled = F.col("skew") > 7.0, F.col("compact") > 0.12
    parts = [(t.where(side).drop("iscell"), t.where(side & labelled).select("roi", "iscell")) for side in (~long, long)]
    return K.training_union(parts).groupBy("recording", "iscell").agg(F.count(F.lit(1)).alias("n"))


def _fields(spark, d):
    n = C.table(spark, d, "nation")
    return n.select(F.col("n_nationkey").alias("plane"), F.lit(300).alias("height"), F.lit(420).alias("width"))


def canvas_layout(spark, d):
    return L.canvas(_fields(spark, d))


def mosaic_layout(spark, d):
    r = C.table(spark, d, "region").select(F.col("r_regionkey").alias("field"), (F.col("r_regionkey") % 2 * 120).alias("dy"), F.expr("r_regionkey div 2 * 90").cast("int").alias("dx"), F.lit(110).alias("height"), F.lit(80).alias("width"))
    return L.mosaic_over_depth(r, 4)


def combine_planes(spark, d):
    masks = C.masks(spark, d).withColumn("plane", (F.col("roi") % 30).cast("int"))
    return L.combined_masks(masks, L.canvas(_fields(spark, d)))


def plane_field_configs(spark, d):
    """A field of view a region, with its nations as lines, on as many planes as there are regions but one."""
    lines = C.table(spark, d, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_nationkey")).alias("lines")).orderBy("n_regionkey").collect()  # a row a region
    return L.plane_configs(len(lines), [r["lines"] for r in lines], [len(lines) - 1], spark).select("plane", "field", F.size("lines").alias("n_lines"))


def f1_match(spark, d):
    m = C.masks(spark, d)
    a, b = m.where("lam > 15").select("roi", "y", "x"), m.where("lam < 45").select("roi", "y", "x")
    t = T.bin_mean(C.traces(spark, d), "f", BIN)
    return _r(E.matches(a, b, t, t, 0.3, 0.5), "iou", "r")


def f1_score(spark, d):
    m = C.masks(spark, d)
    a, b = m.where("lam > 15").select("roi", "y", "x"), m.where("lam < 45").select("roi", "y", "x")
    t = T.bin_mean(C.traces(spark, d), "f", BIN)
    return _r(E.f1(E.matches(a, b, t, t, 0.3, 0.5), a, b), "f1")


def match_one_to_one(spark, d):
    p = M.cosine_pairs(C.masks(spark, d)).withColumn("plane", F.lit(0))
    return _r(E.one_to_one(p.withColumn("cosine", F.round("cosine", 6)), 0.05), "cosine")


def natural_sort_files(spark, d):
    return file_order(C.table(spark, d, "pages").select(F.col("url").alias("path")))


def raw_binary_roundtrip(spark, d):
    """Frames written as blobs by the sink and read back by the source."""
    from calspark.sources.raw import read_raw, temporary_folder, write_raw

    path = temporary_folder(spark, "raw")
    write_raw(_thousandths(spark, d), path, 8, 8)
    return C.exploded(read_raw(spark, path, 8, 8)).select("plane", "frame", "y", "x", F.col("v").cast("int").alias("v"))


def _flat_recording(spark, d):
    from calspark.sources.framesource import read_frames, write_frames
    from calspark.sources.raw import temporary_folder, unpacked

    path = temporary_folder(spark, "recording")
    write_frames(_thousandths(spark, d), path, 8, 8, block=32)
    return lambda **o: read_frames(spark, path, **o), lambda blobs: C.exploded(unpacked(blobs, 8, 8)).select("plane", "frame", "y", "x", F.col("v").cast("int").alias("v"))


def flat_recording_roundtrip(spark, d):
    """Frames written as flat int16 files with a manifest and read back."""
    read, pixels = _flat_recording(spark, d)
    return pixels(read())


def flat_recording_range(spark, d):
    """A range of frames of one plane, whose blocks alone are read."""
    read, pixels = _flat_recording(spark, d)
    return pixels(read().where("plane = 3 and frame >= 100 and frame < 300"))


def flat_recording_frames(spark, d):
    """Frames of every plane, counted without their pixels."""
    read, _ = _flat_recording(spark, d)
    return read(pixels=False).groupBy("plane").agg(F.count(F.lit(1)).alias("frames"), F.min("frame").alias("first"), F.max("frame").alias("last"))


def npy_roundtrip(spark, d):
    from calspark.sources.npy import read_npy, write_npy
    from calspark.sources.raw import temporary_folder

    path = temporary_folder(spark, "npy")
    frames = C.movie(spark, d).withColumn("arr", F.transform("arr", lambda v: F.round(v * 1000).cast("short")))
    write_npy(frames, path, 8, 8)
    return read_npy(spark, path).groupBy("plane").agg(F.count(F.lit(1)).alias("frames"), F.sum(F.aggregate("arr", F.lit(0).cast("long"), lambda s, v: s + v.cast("long"))).alias("total"))


def tiff_roundtrip(spark, d):
    from calspark.sources.raw import temporary_folder
    from calspark.sources.tiff import read_tiff, write_tiff

    path = temporary_folder(spark, "tiff")
    frames = C.movie(spark, d).withColumn("arr", F.transform("arr", lambda v: F.round(v * 1000).cast("short")))
    write_tiff(frames, path, 8, 8)
    return read_tiff(spark, path).groupBy("plane").agg(F.count(F.lit(1)).alias("frames"), F.sum(F.aggregate("arr", F.lit(0).cast("long"), lambda s, v: s + v.cast("long"))).alias("total"))


def _thousandths(spark, d):
    return C.movie(spark, d).withColumn("arr", F.transform("arr", lambda v: F.round(v * 1000).cast("short")))


def _total(frames, *keys):
    return frames.groupBy(*keys).agg(F.count(F.lit(1)).alias("frames"), F.sum(F.aggregate("arr", F.lit(0).cast("long"), lambda s, v: s + v.cast("long"))).alias("total"))


def tiff_files_roundtrip(spark, d):
    """Frames written as compressed .tif files and read back by ranges of pages; a page is known by its file and place."""
    from calspark.sources import ranges
    from calspark.sources.raw import temporary_folder
    from calspark.sources.tiff import read_pages, write_tiff_files

    path = temporary_folder(spark, "tif-files")
    write_tiff_files(_thousandths(spark, d), ranges.file_system(path)[1], 8, 8, 100, True)
    return _total(read_pages(spark, path), F.regexp_extract("file", r"plane(\d+)_\d+\.tif$", 1).cast("int").alias("plane"))


def recording_from_files(spark, d):
    """The movie as pages of .tif files, converted to two planes and two channels."""
    from calspark.settings import Recording
    from calspark.sources import ranges, recording
    from calspark.sources.raw import temporary_folder
    from calspark.sources.tiff import write_tiff_files

    path, out = temporary_folder(spark, "recording"), temporary_folder(spark, "converted")
    write_tiff_files(_thousandths(spark, d).withColumn("plane", F.lit(0)), ranges.file_system(path)[1], 8, 8, 64)
    made = recording.convert(spark, Recording(data_path=[path], nplanes=2, nchannels=2, functional_chan=2), out)
    return _total(made.frames, "plane", F.lit(2).alias("channel")).unionByName(_total(made.frames2, "plane", F.lit(1).alias("channel")))


def movie_on_canvas(spark, d):
    """Planes side by side on one canvas, as far as all of them last; rows of pixels are summed."""
    ranked = T.F.row_number().over(T.Window.partitionBy("plane").orderBy("frame")) - 1
    m = _thousandths(spark, d).withColumn("frame", ranked.cast("long")).where("plane < 6")
    last = m.groupBy("plane").agg(F.max("frame").alias("last")).agg(F.min("last").alias("last"))
    m = m.join(F.broadcast(last)).where(F.col("frame") <= F.col("last"))
    layout = L.canvas(m.select("plane").distinct().select("plane", F.lit(8).alias("height"), F.lit(8).alias("width")))
    _, width = L.canvas_size(layout)
    x = C.exploded(L.combined_frames(m, layout).withColumn("plane", F.lit(0)), width)
    return x.groupBy("frame", "y", F.expr("x div 8").alias("column")).agg(F.sum(F.col("v").cast("long")).alias("total"))


QUERIES = {f.__name__: f for f in (
    detect_sparse, detect_svd, detect_f1, split_test, classifier_grid, classifier_smooth, classifier_logodds, classifier_predict, classifier_override, training_union, canvas_layout, mosaic_layout, combine_planes, plane_field_configs,
    f1_match, f1_score, match_one_to_one, natural_sort_files, raw_binary_roundtrip, flat_recording_roundtrip, flat_recording_range, flat_recording_frames, npy_roundtrip, tiff_roundtrip, tiff_files_roundtrip, recording_from_files, movie_on_canvas,
)}

_GRID = f"""
lng as (select roi, iscell, unnest(['skew', 'npix_norm', 'compact']) key, unnest([skew, npix_norm, compact]) v from train),
rkd as (select *, row_number() over (partition by key order by v, roi) - 1 rk, count(*) over (partition by key) n from lng),
ixs as (select i bin, cast(floor(i * ((n - 1) / {float(NODES - 1)})) as bigint) ix from range({NODES}) r(i), (select max(n) n from rkd)),
iv as (select bin, ix, lead(ix) over (order by bin) nx from ixs),
gd as (select key, cast(bin as int) bin, max(case when rk = ix then v end) node, avg(case when rk < nx then iscell end) p from rkd join iv on rk >= ix and (rk < nx or (nx is null and rk = ix)) group by key, bin)"""
_S = ", ".join(f"({k}, cast({w!r} as double))" for k, w in gaussian_taps(2.0, 8))
_N = NODES - 1
_MATCH = f"""a as (select roi, y, x from masks where lam > 15), b as (select roi, y, x from masks where lam < 45), na as (select roi, count(*) n from a group by 1), nb as (select roi, count(*) n from b group by 1),
io as (select a.roi a, b.roi b, count(*) n from a join b using (y, x) group by 1, 2), iu as (select io.a, io.b, io.n / (na.n + nb.n - io.n) iou from io join na on na.roi = io.a join nb on nb.roi = io.b),
mt as (select iu.a, iu.b, iou, corr(p.v, q.v) r from iu join bins p on p.roi = iu.a join bins q on q.roi = iu.b and p.bin = q.bin where iou > 0.3 group by 1, 2, 3 having corr(p.v, q.v) > 0.5)"""
_SUM16 = "select label plane, count(*) frames, cast(sum(list_sum(list_transform(embedding, lambda v: cast(round(cast(v as double) * 1000) as bigint)))) as bigint) total from embeddings group by label"

ORACLES = {
    "classifier_grid": f"with {C.TRAIN}, {_GRID} select key, bin, {R('node')} node, {R('p')} p from gd",
    "classifier_smooth": f"with {C.TRAIN}, {_GRID}, taps(k, w) as (values {_S}), sm as (select a.key, a.bin, sum(w * b.p) s from gd a, taps, gd b where a.p is not null and b.key = a.key and b.bin = case when ((a.bin + k) % {2 * _N} + {2 * _N}) % {2 * _N} >= {_N} then {2 * _N - 1} - ((a.bin + k) % {2 * _N} + {2 * _N}) % {2 * _N} else ((a.bin + k) % {2 * _N} + {2 * _N}) % {2 * _N} end group by 1, 2) select key, bin, {R('node')} node, {R('s')} p from gd left join sm using (key, bin)",
    "classifier_logodds": f"with {C.TRAIN}, {_GRID}, g as (select bin, node, p from gd where key = 'compact'), z as (select roi, greatest(least(max(train.compact), (select max(node) from g)), (select min(node) from g)) v from train group by roi), b as (select roi, least(greatest((select count(*) from g where g.node < z.v) - 1, 0), {_N - 1}) bin from z) select roi, {R('ln(p + 1e-6) - ln(1 - p + 1e-6)')} z from b join g using (bin)",
    "classifier_override": f"with {C.TRAIN} select roi, case when npix_norm > cast(0.05 as double) then iscell <> 1 else iscell = 1 end iscell from train",
    "training_union": f"with {C.TRAIN} select case when skew > 7 then 1 else 0 end recording, iscell, count(*) n from train where compact > cast(0.12 as double) group by 1, 2",
    "canvas_layout": "with a as (select ceil(sqrt(300 * 420 * count(*)) / 420) c from nation) select n_nationkey plane, 300 as height, 420 as width, cast(floor(n_nationkey / c) * 300 as int) dy, cast(n_nationkey % c * 420 as int) dx from nation, a",
    "mosaic_layout": "with f as (select r_regionkey field, r_regionkey % 2 * 120 dy, cast(r_regionkey // 2 * 90 as int) dx from region), e as (select max(dy + 110) h, max(dx + 80) w, count(*) n from f), a as (select *, ceil(sqrt(h * w * 4) / w) c from e) select z.i * n + field plane, cast(z.i as int) depth, field, cast(dy + floor(z.i / c) * h as int) dy, cast(dx + z.i % c * w as int) dx from f, a, range(4) z(i)",
    "combine_planes": f"with {C.MASKS}, a as (select ceil(sqrt(300 * 420 * count(*)) / 420) c from nation) select cast(roi % 30 as int) plane, roi, cast(y + floor((roi % 30) / c) * 300 as int) y, cast(x + (roi % 30) % c * 420 as int) x, lam from masks, a where roi % 30 in (select n_nationkey from nation)",
    "plane_field_configs": "with f as (select n_regionkey, count(*) n, row_number() over (order by n_regionkey) - 1 field from nation group by 1) select cast(p.i as int) plane, cast(field as int) field, cast(n as int) n_lines from f, range(100) p(i) where p.i < (select count(*) - 1 from f)",
    "f1_match": f"with {C.TRACES}, {_BINS}, {C.MASKS}, {_MATCH} select a, b, {R('iou')} iou, {R('r')} r from mt",
    "f1_score": f"with {C.TRACES}, {_BINS}, {C.MASKS}, {_MATCH}, s as (select count(distinct mt.a) tp, (select count(*) from na) f, (select count(*) from nb) t from mt) select tp, f - tp fp, t - tp fn, {R('tp / (tp + 0.5 * (f - tp + t - tp))')} f1 from s",
    "natural_sort_files": r"""with p as (select distinct url path, regexp_extract(url, '^(.*/)[^/]*$', 1) folder from pages), k as (select *, array_to_string(list_transform(regexp_extract_all(path, '(\d+|\D+)', 1), lambda z: case when regexp_matches(z, '^\d') then lpad(z, 20, '0') else z end), '') nk from p)
select path, folder, cast(row_number() over (partition by folder order by nk, path) as int) rank, row_number() over (partition by folder order by nk, path) = 1 first_in_folder from k""",
    "raw_binary_roundtrip": f"with {C.PIXELS} select plane, frame, y, x, cast(round(v * 1000) as int) v from pixels",
    "flat_recording_roundtrip": f"with {C.PIXELS} select plane, frame, y, x, cast(round(v * 1000) as int) v from pixels",
    "flat_recording_range": f"with {C.PIXELS} select plane, frame, y, x, cast(round(v * 1000) as int) v from pixels where plane = 3 and frame >= 100 and frame < 300",
    "flat_recording_frames": "select label plane, count(*) frames, min(vec_id) as first, max(vec_id) as last from embeddings group by 1",
    "npy_roundtrip": _SUM16,
    "tiff_roundtrip": _SUM16,
    "tiff_files_roundtrip": _SUM16,
    "recording_from_files": "with p as (select row_number() over (order by vec_id) - 1 k, list_sum(list_transform(embedding, lambda v: cast(round(cast(v as double) * 1000) as bigint))) s from embeddings) select cast(k // 2 % 2 as int) plane, cast(k % 2 + 1 as int) channel, count(*) frames, cast(sum(s) as bigint) total from p group by 1, 2",
    "movie_on_canvas": """with t as (select label plane, row_number() over (partition by label order by vec_id) - 1 t, embedding e from embeddings where label < 6), c as (select count(distinct plane) n, ceil(sqrt(8 * 8 * count(distinct plane)) / 8) ac from t),
k as (select min(m) k from (select max(t) m from t group by plane)), p as (select plane, t, i.i // 8 y, cast(round(cast(e[i.i + 1] as double) * 1000) as bigint) v from t, k, range(64) i(i) where t <= k),
q as (select t, cast(floor(plane / ac) * 8 + y as int) y, cast(plane % ac as bigint) col, sum(v) total from p, c group by all), g as (select t.i t, cast(y.i as int) y, x.i col from (select distinct t i from q) t, c, range(cast(8 * ceil(n / ac) as bigint)) y(i), range(cast(ac as bigint)) x(i))
select g.t frame, g.y, g.col as "column", cast(coalesce(total, 0) as bigint) total from g left join q using (t, y, col)""",
}
