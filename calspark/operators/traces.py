"""Trace operators: neuropil correction, baselines, filters, statistics, correlation, resampling.

A trace table has a key (``roi``), an ordinal (``frame``, 0 .. n-1 in every trace) and
values. All operators are windows and aggregates by the key, so traces stay whole on
one partition and the shuffle on ``roi`` is shared by consecutive operators.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calspark.functions.columns import filtered, gaussian_taps, odd, rolling
from calspark.operators.deconvolution import pooled, spikes_of
from calspark.sources.tables import materialize


#: Traces and values of a block of the correlation matrix at most, and traces multiplied with a block at a time.
TRACES_A_BLOCK, VALUES_A_BLOCK, LEFT_AT_A_TIME = 2048, 2_000_000, 128


def by_roi() -> Window:
    return Window.partitionBy("roi").orderBy("frame")


def neuropil_corrected(traces: DataFrame, coefficient: float = 0.7) -> DataFrame:
    """df = f - coefficient * fneu."""
    return traces.withColumn("df", F.col("f") - F.lit(coefficient) * F.col("fneu"))


def snr(traces: DataFrame, value: str = "df") -> DataFrame:
    """roi, snr: one minus half the variance of the first difference over the variance."""
    x = traces.withColumn("_d", F.col(value) - F.lag(value).over(by_roi()))
    return x.groupBy("roi").agg((1 - 0.5 * F.try_divide(F.var_pop("_d"), F.var_pop(value))).alias("snr"))


def skew_std(traces: DataFrame, value: str = "df") -> DataFrame:
    return traces.groupBy("roi").agg(F.skewness(value).alias("skew"), F.stddev_pop(value).alias("std"))


def filtered_by_snr(traces: DataFrame, threshold: float, value: str = "df") -> DataFrame:
    """The traces whose SNR exceeds the threshold; all of them if the threshold is not positive."""
    if threshold <= 0:
        return traces
    return traces.join(snr(traces, value).where(F.col("snr") > threshold).select("roi"), "roi", "left_semi")


def gaussian(traces: DataFrame, value: str, sigma: float, boundary: str, radius: int | None = None, out: str = "smooth") -> DataFrame:
    """Gaussian filter along frames under a boundary rule; frames count by their order, whatever their numbers."""
    if radius is None:
        radius = round(3 * sigma) if boundary == "replicate" else int(4 * sigma + 0.5)
    return filtered(traces, ("roi",), "frame", value, gaussian_taps(sigma, radius), boundary, out)


def rolling_min_max(traces: DataFrame, value: str, window: int, out: str = "baseline") -> DataFrame:
    """Rolling minimum, then rolling maximum, over an odd window; truncated edges equal replicated ones. The cost does not follow the window."""
    low = rolling(traces, ("roi",), "frame", value, odd(window), False, "_low")
    return rolling(low, ("roi",), "frame", "_low", odd(window), True, out).drop("_low")


def baseline_maximin(traces: DataFrame, value: str, window: int, sigma: float) -> DataFrame:
    """``corrected`` = value minus the maximin baseline of its smoothed trace."""
    x = rolling_min_max(gaussian(traces, value, sigma, "replicate"), "smooth", window)
    return x.withColumn("corrected", F.col(value) - F.col("baseline")).drop("smooth")


def baseline_percentile(traces: DataFrame, value: str, percent: float = 8.0) -> DataFrame:
    low = F.percentile(value, F.lit(percent / 100)).over(Window.partitionBy("roi"))
    return traces.withColumn("baseline", low).withColumn("corrected", F.col(value) - F.col("baseline"))


def baseline_constant(traces: DataFrame, value: str, sigma: float) -> DataFrame:
    """The least smoothed value over all traces together is subtracted."""
    x = gaussian(traces, value, sigma, "reflect")
    least = x.agg(F.min("smooth").alias("baseline"))  # one row
    return x.join(F.broadcast(least)).withColumn("corrected", F.col(value) - F.col("baseline")).drop("smooth")


def preprocess(traces: DataFrame, value: str, baseline: str, window: int, sigma: float, percent: float = 8.0) -> DataFrame:
    """Baseline subtraction by name: maximin, constant, prctile or none; other names are refused."""
    if baseline == "maximin":
        return baseline_maximin(traces, value, window, sigma)
    if baseline == "constant":
        return baseline_constant(traces, value, sigma)
    if baseline == "prctile":
        return baseline_percentile(traces, value, percent)
    if baseline == "none":
        return traces.withColumn("corrected", F.col(value).cast("double"))
    raise ValueError(f"unknown baseline {baseline!r}")


def deconvolve_array(values: np.ndarray, decay: float) -> np.ndarray:
    """Spikes of one trace: the non-negative-jump fit c[t] = decay * c[t-1] + s[t] of least squares."""
    return spikes_of(pooled(values, decay), len(values), decay)


def deconvolve(traces: DataFrame, value: str, tau: float = 1.0, fs: float = 10.0) -> DataFrame:
    """roi, frame, spk. Traces are dealt by roi, sorted, and read as a stream; only the trace at a batch's end is held over.

    ``deconvolution.deconvolve_blocks`` gives the same for traces too long for one task.
    """
    decay = math.exp(-1.0 / (tau * fs))

    def spikes(pdf: pd.DataFrame) -> pd.DataFrame:
        roi, v = pdf["roi"].to_numpy(), pdf["v"].to_numpy()
        edges = [0, *(np.flatnonzero(roi[1:] != roi[:-1]) + 1).tolist(), len(roi)]
        return pd.DataFrame({"roi": roi, "frame": pdf["frame"].to_numpy(), "spk": np.concatenate([deconvolve_array(v[a:b], decay) for a, b in zip(edges, edges[1:])])})

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in it:
            if not len(pdf):
                continue
            start = int(np.flatnonzero((pdf["roi"] == pdf["roi"].iloc[-1]).to_numpy())[0])
            if start or held and held[-1]["roi"].iloc[-1] != pdf["roi"].iloc[0]:
                done = pd.concat([*held, pdf.iloc[:start]])
                held = []
                if len(done):
                    yield spikes(done)
            held.append(pdf.iloc[start:])
        if held:
            yield spikes(pd.concat(held))

    kind = dict(traces.dtypes)["roi"]
    dealt = traces.select("roi", F.col("frame").cast("long"), F.col(value).cast("double").alias("v")).repartition("roi").sortWithinPartitions("roi", "frame")
    return dealt.mapInPandas(run, f"roi {kind}, frame long, spk double")


def bin_mean(traces: DataFrame, value: str, size: int) -> DataFrame:
    """roi, bin, v: means of ``size`` consecutive frames; an incomplete last bin is dropped."""
    x = traces.groupBy("roi", F.expr(f"frame div {size}").alias("bin")).agg(F.avg(value).alias("v"), F.count(F.lit(1)).alias("_n"))
    return x.where(F.col("_n") == size).drop("_n")


def zscore_clip(traces: DataFrame, value: str, low: float = -4.0, high: float = 8.0) -> DataFrame:
    w = Window.partitionBy("roi")
    z = F.try_divide(F.col(value) - F.avg(value).over(w), F.stddev_pop(value).over(w))
    return traces.withColumn("z", F.least(F.greatest(z, F.lit(low)), F.lit(high)))


def minmax(traces: DataFrame, value: str) -> DataFrame:
    w = Window.partitionBy("roi")
    return traces.withColumn("scaled", F.try_divide(F.col(value) - F.min(value).over(w), F.max(value).over(w) - F.min(value).over(w)))


def _centred(binned: DataFrame) -> DataFrame:
    w = Window.partitionBy("roi")
    c = binned.withColumn("c", F.col("v") - F.avg("v").over(w))
    return c.withColumn("s", F.sqrt(F.avg(F.col("c") * F.col("c")).over(w)))


def corr_with_selection(binned: DataFrame, selected: list[int]) -> DataFrame:
    """roi, r: Pearson correlation with the mean of the selected traces; these get the mean of their r."""
    mean = binned.where(F.col("roi").isin(*selected)).groupBy("bin").agg(F.avg("v").alias("m"))
    r = binned.join(mean, "bin").groupBy("roi").agg(F.corr("v", "m").alias("r"))
    chosen = r.where(F.col("roi").isin(*selected)).agg(F.avg("r").alias("own"))
    return r.join(F.broadcast(chosen)).select("roi", F.when(F.col("roi").isin(*selected), F.col("own")).otherwise(F.col("r")).alias("r"))


def corr_matrix(binned: DataFrame) -> DataFrame:
    """a, b, r of every pair a < b of traces with a common bin.

    A matrix product in blocks: traces are dealt to groups of at most TRACES_A_BLOCK, every
    pair of groups is one product, and no row a pair and bin is ever made.
    """
    return _products(binned, None)


def _products(binned: DataFrame, positions: DataFrame | None, least: float = 0.0, within: float = 0.0) -> DataFrame:
    """a, b, r of every pair; or, with positions, a, b, r, distance of the pairs of at least that correlation and at most that distance.

    What travels is a trace, once for each block of the other side. Blocks with positions are ranges of y,
    and only those that come within the distance of each other meet; a pair is judged where it is made.
    """
    kind = dict(binned.dtypes)["roi"]
    c = _centred(binned).select("roi", "bin", "c", "s")
    held = c.groupBy("roi").agg(F.first("s").alias("s"), F.collect_list(F.struct("bin", "c")).alias("held"))
    count, longest = binned.groupBy("roi").count().agg(F.count(F.lit(1)), F.max("count")).first()
    size = max(1, min(TRACES_A_BLOCK, VALUES_A_BLOCK // (longest or 1)))
    blocks = max(1, -(-count // size))
    if positions is None:
        dealt = held.withColumn("block", F.pmod(F.xxhash64("roi"), F.lit(blocks)).cast("int"))
        others = F.sequence(F.lit(0), F.lit(blocks - 1))
        place = []
    else:
        place = ["y", "x"]
        at = positions.select("roi", *(F.col(n).cast("double").alias(n) for n in place)).where("y is not null and x is not null")
        edges = sorted(set(at.approxQuantile("y", [k / blocks for k in range(1, blocks)], 0.1 / blocks))) if blocks > 1 else []
        dealt = held.join(at, "roi").withColumn("block", F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col("y"))) if edges else F.lit(0))
        # the blocks whose ranges of y come within the distance: low and high ends, half a unit in the last place of rounding apart
        low, high = [-math.inf, *edges], [*edges, math.inf]
        reach = within * (1 + 1e-9) + 1e-9
        met = [[k for k in range(len(low)) if low[max(k, n)] - high[min(k, n)] <= reach] for n in range(len(low))]
        others = F.element_at(F.array(*(F.sequence(F.lit(m[0]), F.lit(m[-1])) for m in met)), F.col("block") + 1)
    dealt = dealt.select(F.explode(others).alias("other"), "block", "roi", "s", *place, F.col("held.bin").alias("bins"), F.col("held.c").alias("c"))
    dealt = dealt.select(F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), *dealt.columns[1:])
    # few bytes, much work: the number of tasks is given, so that they are not coalesced
    dealt = dealt.repartition(min(1000, blocks * (blocks + 1) // 2), "low", "high").sortWithinPartitions("low", "high")

    def product(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        lengths = pdf["bins"].map(len).to_numpy()
        bins, column = np.unique(np.concatenate(pdf["bins"].to_numpy()), return_inverse=True)
        value, known = np.zeros((len(pdf), len(bins))), np.zeros((len(pdf), len(bins)))
        row = np.repeat(np.arange(len(pdf)), lengths)
        value[row, column], known[row, column] = np.concatenate(pdf["c"].to_numpy()), 1
        mine = (pdf["block"] == pdf["low"]).to_numpy()
        same = pdf["low"].iloc[0] == pdf["high"].iloc[0]
        right = np.flatnonzero(mine if same else ~mine)
        roi, s = pdf["roi"].to_numpy(), pdf["s"].to_numpy(float)
        for start in range(0, mine.sum(), LEFT_AT_A_TIME):
            left = np.flatnonzero(mine)[start : start + LEFT_AT_A_TIME]
            common = known[left] @ known[right].T
            i, j = np.nonzero((common > 0) & (roi[left][:, None] < roi[right]) if same else common > 0)
            r = (value[left] @ value[right].T)[i, j] / common[i, j] / (s[left[i]] * s[right[j]] + 1e-3)
            i, j = left[i], right[j]
            out = {"a": np.minimum(roi[i], roi[j]), "b": np.maximum(roi[i], roi[j]), "r": r}
            if place:
                y, x = pdf["y"].to_numpy(float), pdf["x"].to_numpy(float)
                out["distance"] = np.sqrt((y[i] - y[j]) ** 2 + (x[i] - x[j]) ** 2)
                keep = ~(r < least) & (out["distance"] <= within)  # as in SQL, no number exceeds what is not a number
                out = {k: v[keep] for k, v in out.items()}
            yield pd.DataFrame(out)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts: list[pd.DataFrame] = []
        for pdf in it:
            if not len(pdf):
                continue
            key = pdf[["low", "high"]].to_numpy()
            edges = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(pdf)]
            for n, m in zip(edges, edges[1:]):
                if parts and tuple(parts[-1][["low", "high"]].iloc[0]) != tuple(key[n]):
                    yield from product(pd.concat(parts, ignore_index=True))
                    parts = []
                parts.append(pdf.iloc[n:m])
        if parts:
            yield from product(pd.concat(parts, ignore_index=True))

    return dealt.mapInPandas(run, f"a {kind}, b {kind}, r double" + (", distance double" if place else ""))


def merge_candidates(binned: DataFrame, positions: DataFrame, least: float, within: float) -> DataFrame:
    """a, b, r, distance of the pairs of at least that correlation whose centres are at most that far apart. positions: roi, y, x."""
    return _products(binned, positions, least, within)


def merge_groups(candidates: DataFrame) -> DataFrame:
    """roi, group: greedy merging, best correlation first; a candidate joins the group of its partner.

    A region joins by its own best pair alone: its partner is in a group by then, or it is
    its partner's best pair too and begins one. So a task keeps a pair a region, and
    groups are found by following partners, twice as far each round.
    """

    def best(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, new, rows = pd.DataFrame(), [], 0

        def kept() -> pd.DataFrame:
            x = pd.concat([held, *new]) if len(held) else pd.concat(new)
            return x.sort_values(["r", "a", "b"], ascending=[False, True, True]).drop_duplicates("roi")

        for pdf in it:
            new += [pdf.assign(roi=pdf["a"]), pdf.assign(roi=pdf["b"])]
            rows += len(pdf)
            if rows > 200_000:
                held, new, rows = kept(), [], 0
        if new:
            held = kept()
        if len(held):
            yield held

    pairs = candidates.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.col("r").cast("double").alias("r"))
    own = pairs.mapInPandas(best, "a long, b long, r double, roi long").groupBy("roi").agg(F.min(F.struct((-F.col("r")).alias("r"), "a", "b")).alias("pair"))
    own = materialize(own.select("roi", F.col("pair.a").alias("a"), F.col("pair.b").alias("b"), F.when(F.col("roi") == F.col("pair.a"), F.col("pair.b")).otherwise(F.col("pair.a")).alias("up")), "partners")
    theirs = own.select(F.col("roi").alias("up"), F.col("a").alias("pa"), F.col("b").alias("pb"))
    begun = (F.col("a") == F.col("pa")) & (F.col("b") == F.col("pb"))
    state = materialize(own.join(theirs, "up").select("roi", "up", F.when(begun, F.least("a", "b")).alias("group")), "merged")
    while state.where("group is null").limit(1).count():
        above = state.select(F.col("roi").alias("up"), F.col("up").alias("next"), F.col("group").alias("theirs"))
        state = materialize(state.join(above, "up").select("roi", F.col("next").alias("up"), F.coalesce("group", "theirs").alias("group")), "merged")
    return state.select("roi", "group")


def resample_linear(series: DataFrame, times: DataFrame, width: float = 64.0) -> DataFrame:
    """frame, v: the series (t, v) at the times (frame, t) by linear interpolation, extrapolated at both ends.

    The series of one recording (a value a frame or fewer) is ordered once; its
    intervals are cut into buckets of ``width`` so that the times meet them by an
    equality join on the bucket, not by a range join.
    """
    w = Window.orderBy("t")
    segment = series.withColumn("t1", F.lead("t").over(w)).withColumn("v1", F.lead("v").over(w)).where("t1 is not null")
    bounds = segment.agg(F.min("t").alias("first"), F.max("t").alias("last"))
    x = times.join(F.broadcast(bounds)).withColumn("key", F.least(F.greatest("t", "first"), "last")).withColumn("bucket", F.floor(F.col("key") / width))
    covers = F.sequence(F.floor(F.col("t") / width), F.floor(F.col("t1") / width))
    cut = segment.select(F.struct("t", "v", "t1", "v1").alias("seg"), F.explode(covers).alias("bucket"))
    held = x.select("frame", "key", F.col("t").alias("at"), "bucket").join(cut, "bucket").where((F.col("key") >= F.col("seg.t")) & ((F.col("key") < F.col("seg.t1"))))
    v = F.col("seg.v") + (F.col("at") - F.col("seg.t")) * (F.col("seg.v1") - F.col("seg.v")) / (F.col("seg.t1") - F.col("seg.t"))
    return held.select("frame", v.alias("v"))


def series_corr(binned: DataFrame, series: DataFrame) -> DataFrame:
    """roi, r: Pearson correlation of every binned trace with a binned series (bin, m)."""
    return binned.join(series, "bin").groupBy("roi").agg(F.corr("v", "m").alias("r"))


def top_n(stats: DataFrame, by: str, n: int, descending: bool = True) -> DataFrame:
    order = F.col(by).desc() if descending else F.col(by).asc()
    return stats.orderBy(order, F.col("roi").asc()).limit(n)


def tail_padded(traces: DataFrame, value: str) -> DataFrame:
    """Every trace on frames 0 .. longest-1, zeros after its own end."""
    longest = traces.agg((F.max("frame") + 1).alias("n"))
    grid = traces.select("roi").distinct().join(F.broadcast(longest)).select("roi", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("n") - 1).cast("long"))).alias("frame"))
    return grid.join(traces.select("roi", F.col("frame").cast("long"), value), ["roi", "frame"], "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def median_filter(series: DataFrame, value: str, window: int, out: str) -> DataFrame:
    """Median over an odd window with zeros beyond the ends, by plane."""
    h = window // 2
    w = Window.partitionBy("plane").orderBy("frame")
    values = F.collect_list(F.col(value).cast("double")).over(w.rowsBetween(-h, h))
    padded = F.array_sort(F.concat(values, F.array_repeat(F.lit(0.0), F.lit(window) - F.size(values))))
    return series.withColumn(out, F.element_at(padded, h + 1))


def spread(column: Column, low: Column, high: Column) -> Column:
    """Robust scaling to [0, 1]."""
    return F.least(F.greatest(F.try_divide(column - low, high - low), F.lit(0.0)), F.lit(1.0))
