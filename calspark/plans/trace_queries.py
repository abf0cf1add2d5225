"""Queries on traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from calspark.functions.columns import gaussian_taps, rounded
from calspark.operators import traces as T
from calspark.operators.deconvolution import deconvolve_blocks
from calspark.plans import carriers as C

WINDOW, SIGMA, BIN = 11, 2.0, 5
SELECTED = (1, 2, 3)


def _corrected(spark, d):
    return T.neuropil_corrected(C.traces(spark, d))


def _r(df, *names, digits=6):
    return df.withColumns({n: rounded(F.col(n), digits) for n in names})


def trace_neuropil_correct(spark, d):
    return _corrected(spark, d).select("roi", "frame", "df")


def trace_snr(spark, d):
    return _r(T.snr(_corrected(spark, d)), "snr")


def trace_skew_std(spark, d):
    return _r(T.skew_std(_corrected(spark, d)), "skew", "std")


def baseline_maximin(spark, d):
    return _r(T.baseline_maximin(_corrected(spark, d), "df", WINDOW, SIGMA).select("roi", "frame", "baseline", "corrected"), "baseline", "corrected")


def baseline_percentile(spark, d):
    return _r(T.baseline_percentile(C.traces(spark, d), "f").select("roi", "frame", "baseline", "corrected"), "baseline", "corrected")


def baseline_constant(spark, d):
    return _r(T.baseline_constant(_corrected(spark, d), "df", SIGMA).select("roi", "frame", "baseline", "corrected"), "baseline", "corrected")


def trace_summary(spark, d):
    x = T.baseline_maximin(_corrected(spark, d), "df", WINDOW, SIGMA)
    return _r(T.snr(x, "corrected").join(T.skew_std(x, "corrected"), "roi"), "snr", "skew", "std")


def trace_gaussian_replicate(spark, d):
    return _r(T.gaussian(C.traces(spark, d), "f", SIGMA, "replicate").select("roi", "frame", "smooth"), "smooth")


def trace_gaussian_reflect(spark, d):
    return _r(T.gaussian(C.traces(spark, d), "f", SIGMA, "reflect").select("roi", "frame", "smooth"), "smooth")


def spikes_deconvolve(spark, d):
    return _r(T.deconvolve(C.traces(spark, d), "f"), "spk", digits=4)


def spikes_deconvolve_blocks(spark, d):
    """The same in blocks of 16 frames, whose pools merge across their borders."""
    return _r(deconvolve_blocks(C.traces(spark, d), "f", block=16), "spk", digits=4)


def _bins(spark, d):
    return T.bin_mean(C.traces(spark, d), "f", BIN)


def trace_bin_mean(spark, d):
    return _r(_bins(spark, d), "v")


def trace_zscore_clip(spark, d):
    return _r(T.zscore_clip(C.traces(spark, d), "f").select("roi", "frame", "z"), "z")


def trace_minmax(spark, d):
    return _r(T.minmax(C.traces(spark, d), "f").select("roi", "frame", "scaled"), "scaled")


def trace_corr_with_selection(spark, d):
    return _r(T.corr_with_selection(_bins(spark, d), list(SELECTED)), "r")


def trace_corr_matrix(spark, d):
    return _r(T.corr_matrix(_bins(spark, d)), "r")


def _positions(spark, d):
    return C.traces(spark, d).groupBy("roi").agg(F.avg("f").alias("y"), F.avg("fneu").alias("x"))


def merge_candidates(spark, d):
    return _r(T.merge_candidates(_bins(spark, d), _positions(spark, d), 0.5, 2.0), "r", "distance")


def merge_groups(spark, d):
    x = T.merge_candidates(_bins(spark, d), _positions(spark, d), 0.5, 2.0).withColumn("r", F.round("r", 6))
    return T.merge_groups(x)


def behaviour_resample_linear(spark, d):
    times = spark.range(-20, 1200).select(F.col("id").alias("frame"), (F.col("id") * 2.3).alias("t"))
    return _r(T.resample_linear(C.behaviour(spark, d), times), "v", digits=3)


def behaviour_corr(spark, d):
    """The behaviour's span is cut into as many parts as a trace of 60 frames has bins."""
    b = C.behaviour(spark, d)
    span = b.agg(F.min("t").alias("t0"), (F.max("t") - F.min("t") + 1).alias("days"))
    series = b.join(F.broadcast(span)).groupBy(F.floor((F.col("t") - F.col("t0")) * 12 / F.col("days")).cast("long").alias("bin")).agg(F.avg("v").alias("m"))
    return _r(T.series_corr(_bins(spark, d), series), "r")


def roi_top_n(spark, d):
    return _r(T.top_n(T.skew_std(C.traces(spark, d), "f").withColumn("std", F.round("std", 6)), "std", 10), "skew", "std")


def roi_bottom_n(spark, d):
    return _r(T.top_n(T.skew_std(C.traces(spark, d), "f").withColumn("std", F.round("std", 6)), "std", 10, False), "skew", "std")


def roi_snr_filter(spark, d):
    return T.filtered_by_snr(_corrected(spark, d), 0.05).groupBy("roi").agg(F.count(F.lit(1)).alias("n_frames"))


def pad_traces(spark, d):
    return T.tail_padded(C.traces(spark, d).select("roi", "frame", "f"), "f")


def union_recordings(spark, d):
    """Traces of two channels appended, tagged by recording, and counted with their key intersection."""
    t = C.traces(spark, d)
    both = t.where("event_type = 'click'").select("roi", "f", F.lit(0).alias("recording")).unionByName(t.where("event_type = 'view'").select("roi", "f", F.lit(1).alias("recording")))
    return _r(both.groupBy("recording", "roi").agg(F.count(F.lit(1)).alias("n"), F.sum("f").alias("total")), "total", digits=3)


def key_intersection(spark, d):
    t = C.traces(spark, d)
    return t.where("event_type = 'click'").select("roi").intersect(t.where("event_type = 'error'").select("roi"))


def trace_robust_colour(spark, d):
    """A statistic scaled between its 2nd and 98th percentile."""
    s = T.skew_std(C.traces(spark, d), "f")
    edge = s.agg(F.percentile("std", F.array(F.lit(0.02), F.lit(0.98))).alias("p"))
    return _r(s.join(F.broadcast(edge)).select("roi", T.spread(F.col("std"), F.col("p")[0], F.col("p")[1]).alias("colour")), "colour")


def trace_rank_colour(spark, d):
    from pyspark.sql import Window

    s = T.skew_std(C.traces(spark, d), "f").withColumn("std", F.round("std", 6))
    n = s.agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("std", "roi")  # one row a region: the statistics of one plane
    return _r(s.withColumn("rank", F.row_number().over(w) - 1).join(F.broadcast(n)).select("roi", (F.col("rank") / F.greatest(F.col("n") - 1, F.lit(1))).alias("colour")), "colour")


QUERIES = {f.__name__: f for f in (
    trace_neuropil_correct, trace_snr, trace_skew_std, baseline_maximin, baseline_percentile, baseline_constant, trace_summary, trace_gaussian_replicate, trace_gaussian_reflect,
    spikes_deconvolve, spikes_deconvolve_blocks, trace_bin_mean, trace_zscore_clip, trace_minmax, trace_corr_with_selection, trace_corr_matrix, merge_candidates, merge_groups, behaviour_resample_linear, behaviour_corr,
    roi_top_n, roi_bottom_n, roi_snr_filter, pad_traces, union_recordings, key_intersection, trace_robust_colour, trace_rank_colour,
)}


def R(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0"


def _values(taps):
    return ", ".join(f"({k}, cast({w!r} as double))" for k, w in taps)


def _smooth(source: str, value: str, index: str, radius: int, name: str) -> str:
    return f"""
taps_{name}(k, w) as (values {_values(gaussian_taps(SIGMA, radius))}),
len_{name} as (select roi, max(frame) + 1 n from {source} group by roi),
want_{name} as (select a.roi, a.frame, {index} i, w from {source} a join len_{name} using (roi), taps_{name}),
{name} as (select g.roi, g.frame, sum(g.w * b.{value}) smooth from want_{name} g join {source} b on b.roi = g.roi and b.frame = g.i group by 1, 2)"""


_CLAMP = "least(greatest(a.frame + k, 0), n - 1)"
_REFLECT = "case when ((a.frame + k) % (2 * n) + 2 * n) % (2 * n) >= n then 2 * n - 1 - ((a.frame + k) % (2 * n) + 2 * n) % (2 * n) else ((a.frame + k) % (2 * n) + 2 * n) % (2 * n) end"
_H = WINDOW // 2
_MAXIMIN = _smooth("c", "df", _CLAMP, round(3 * SIGMA), "sm") + f""",
lo as (select roi, frame, min(smooth) over (partition by roi order by frame rows between {_H} preceding and {_H} following) low from sm),
hi as (select roi, frame, max(low) over (partition by roi order by frame rows between {_H} preceding and {_H} following) baseline from lo),
mm as (select roi, frame, baseline, df - baseline corrected from c join hi using (roi, frame))"""


def _stats(source: str, value: str) -> str:
    return f"""
mu as (select roi, avg({value}) m, stddev_pop({value}) s from {source} group by roi),
sk as (select roi, avg(power({value} - m, 3)) / power(max(s), 3) skew, max(s) std from {source} join mu using (roi) group by roi),
di as (select roi, {value} v, {value} - lag({value}) over (partition by roi order by frame) d from {source}),
sn as (select roi, 1 - 0.5 * var_pop(d) / var_pop(v) snr from di group by roi)"""


_BINS = f"bins as (select roi, frame // {BIN} bin, avg(f) v from traces group by 1, 2 having count(*) = {BIN})"
_MATRIX = """
cen as (select roi, bin, v - avg(v) over (partition by roi) c from bins), sdv as (select roi, sqrt(avg(c * c)) s from cen group by roi),
mat as (select p.roi a, q.roi b, avg(p.c * q.c) / (max(sp.s) * max(sq.s) + 1e-3) r from cen p join cen q on p.bin = q.bin and p.roi < q.roi join sdv sp on sp.roi = p.roi join sdv sq on sq.roi = q.roi group by 1, 2)"""
_CANDIDATES = """
pos as (select roi, avg(f) y, avg(fneu) x from traces group by roi),
cand as (select a, b, r, sqrt(power(p.y - q.y, 2) + power(p.x - q.x, 2)) distance from mat join pos p on p.roi = a join pos q on q.roi = b where r >= 0.5)"""

ORACLES = {
    "trace_neuropil_correct": f"with {C.TRACES} select roi, frame, df from c",
    "trace_snr": f"with {C.TRACES}, {_stats('c', 'df')} select roi, {R('snr')} snr from sn",
    "trace_skew_std": f"with {C.TRACES}, {_stats('c', 'df')} select roi, {R('skew')} skew, {R('std')} std from sk",
    "baseline_maximin": f"with {C.TRACES}, {_MAXIMIN} select roi, frame, {R('baseline')} baseline, {R('corrected')} corrected from mm",
    "baseline_percentile": f"with {C.TRACES}, q as (select roi, quantile_cont(f, 0.08) baseline from traces group by roi) select roi, frame, {R('baseline')} baseline, {R('f - baseline')} corrected from traces join q using (roi)",
    "baseline_constant": f"with {C.TRACES}, {_smooth('c', 'df', _REFLECT, int(4 * SIGMA + 0.5), 'sr')}, q as (select min(smooth) baseline from sr) select roi, frame, {R('baseline')} baseline, {R('df - baseline')} corrected from c, q",
    "trace_summary": f"with {C.TRACES}, {_MAXIMIN}, {_stats('mm', 'corrected')} select roi, {R('snr')} snr, {R('skew')} skew, {R('std')} std from sn join sk using (roi)",
    "trace_gaussian_replicate": f"with {C.TRACES}, {_smooth('traces', 'f', _CLAMP, round(3 * SIGMA), 'sm')} select roi, frame, {R('smooth')} smooth from sm",
    "trace_gaussian_reflect": f"with {C.TRACES}, {_smooth('traces', 'f', _REFLECT, int(4 * SIGMA + 0.5), 'sm')} select roi, frame, {R('smooth')} smooth from sm",
    "spikes_deconvolve": f"""with {C.TRACES},
p as (select x.roi, x.frame a, y.frame b, sum(y.f * exp(-0.1 * (y.frame - x.frame))) over w / sum(exp(-0.2 * (y.frame - x.frame))) over w m from traces x join traces y on x.roi = y.roi and y.frame >= x.frame window w as (partition by x.roi, x.frame order by y.frame)),
u as (select roi, a, b t, min(m) over (partition by roi, a order by b desc) m from p),
q as (select roi, t, max(m * exp(-0.1 * (t - a))) c from u group by 1, 2)
select roi, t frame, case when t = 0 then 0.0 else {R("c - exp(-0.1) * lag(c) over (partition by roi order by t)", 4)} end spk from q""",
    "trace_bin_mean": f"with {C.TRACES}, {_BINS} select roi, bin, {R('v')} v from bins",
    "trace_zscore_clip": f"with {C.TRACES} select roi, frame, {R('least(greatest((f - avg(f) over w) / nullif(stddev_pop(f) over w, 0), -4.0), 8.0)')} z from traces window w as (partition by roi)",
    "trace_minmax": f"with {C.TRACES} select roi, frame, {R('(f - min(f) over w) / nullif(max(f) over w - min(f) over w, 0)')} scaled from traces window w as (partition by roi)",
    "trace_corr_with_selection": f"with {C.TRACES}, {_BINS}, s as (select bin, avg(v) m from bins where roi in {SELECTED} group by bin), r as (select roi, corr(v, m) r from bins join s using (bin) group by roi) select roi, {R(f'case when roi in {SELECTED} then (select avg(r) from r where roi in {SELECTED}) else r end')} r from r",
    "trace_corr_matrix": f"with {C.TRACES}, {_BINS}, {_MATRIX} select a, b, {R('r')} r from mat",
    "merge_candidates": f"with {C.TRACES}, {_BINS}, {_MATRIX}, {_CANDIDATES} select a, b, {R('r')} r, {R('distance')} distance from cand where distance <= 2",
    "behaviour_resample_linear": f"""with {C.BEHAVIOUR}, s as (select * from (select t, v, lead(t) over (order by t) t1, lead(v) over (order by t) v1 from behaviour) where t1 is not null),
q as (select i frame, i * cast(2.3 as double) t from range(-20, 1200) r(i)), z as (select min(t) t0, max(t) t9 from s), k as (select frame, t, least(greatest(t, t0), t9) key from q, z)
select frame, {R("s.v + (k.t - s.t) * (s.v1 - s.v) / (s.t1 - s.t)", 3)} v from k asof join s on k.key >= s.t""",
    "behaviour_corr": f"with {C.TRACES}, {_BINS}, {C.BEHAVIOUR}, z as (select min(t) t0, max(t) - min(t) + 1 nd from behaviour), s as (select cast(floor((t - t0) * 12 / nd) as bigint) bin, avg(v) m from behaviour, z group by 1) select roi, {R('corr(v, m)')} r from bins join s using (bin) group by roi",
    "roi_top_n": f"with {C.TRACES}, {_stats('traces', 'f')} select roi, {R('skew')} skew, {R('std')} std from sk order by round(std, 6) desc, roi limit 10",
    "roi_bottom_n": f"with {C.TRACES}, {_stats('traces', 'f')} select roi, {R('skew')} skew, {R('std')} std from sk order by round(std, 6), roi limit 10",
    "roi_snr_filter": f"with {C.TRACES}, {_stats('c', 'df')} select roi, count(*) n_frames from c where roi in (select roi from sn where snr > 0.05) group by roi",
    "pad_traces": f"with {C.TRACES}, n as (select max(frame) n from traces), g as (select roi, unnest(range(0, n + 1)) frame from (select distinct roi from traces), n) select roi, frame, coalesce(f, 0.0) f from g left join traces using (roi, frame)",
    "union_recordings": f"with {C.TRACES}, u as (select roi, f, 0 recording from traces where event_type = 'click' union all select roi, f, 1 from traces where event_type = 'view') select recording, roi, count(*) n, {R('sum(f)', 3)} total from u group by 1, 2",
    "key_intersection": f"with {C.TRACES} select roi from traces where event_type = 'click' intersect select roi from traces where event_type = 'error'",
    "trace_robust_colour": f"with {C.TRACES}, {_stats('traces', 'f')}, q as (select quantile_cont(std, 0.02) a, quantile_cont(std, 0.98) b from sk) select roi, {R('least(greatest((std - a) / nullif(b - a, 0), 0.0), 1.0)')} colour from sk, q",
    "trace_rank_colour": f"with {C.TRACES}, {_stats('traces', 'f')} select roi, {R('(row_number() over (order by round(std, 6), roi) - 1) / greatest(count(*) over () - 1, 1)')} colour from sk",
    "merge_groups": f"""with recursive {C.TRACES}, {_BINS}, {_MATRIX}, {_CANDIDATES},
od as (select a, b, row_number() over (order by round(r, 6) desc, a, b) n from cand where distance <= 2),
st(n, grp) as (select cast(0 as bigint), cast([] as struct(roi bigint, g bigint)[]) union all
  select o.n, list_concat(grp, list_filter([{{'roi': a, 'g': gg}}, {{'roi': b, 'g': gg}}], lambda e: not list_contains(list_transform(grp, lambda z: z.roi), e.roi)))
  from (select od.*, grp, coalesce(list_filter(grp, lambda z: z.roi = od.a)[1].g, list_filter(grp, lambda z: z.roi = od.b)[1].g, od.a) gg from st join od on od.n = st.n + 1) o),
l as (select unnest(grp) e from (select grp from st order by n desc limit 1)) select e.roi roi, e.g as "group" from l""",
}
ORACLES["spikes_deconvolve_blocks"] = ORACLES["spikes_deconvolve"]
