"""Column helpers: rounding for comparison, boundary rules of filters, Gaussian taps."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rounded(column: Column, digits: int = 6) -> Column:
    """Rounded, with negative zero turned into zero."""
    return F.round(column, digits) + F.lit(0.0)


def clamp_index(i: Column, n: Column) -> Column:
    """Edge replicate: indices outside 0 .. n-1 read the nearest edge."""
    return F.least(F.greatest(i, F.lit(0)), n - 1)


def reflect_index(i: Column, n: Column) -> Column:
    """Half-sample reflection (d c b a | a b c d | d c b a), for any distance."""
    j = F.pmod(i, 2 * n)
    return F.when(j >= n, 2 * n - 1 - j).otherwise(j)


def wrap_index(i: Column, n: Column) -> Column:
    return F.pmod(i, n)


BOUNDARIES = {"replicate": clamp_index, "reflect": reflect_index, "wrap": wrap_index}


def gaussian_taps(sigma: float, radius: int) -> list[tuple[int, float]]:
    """(offset, weight) of a unit-sum Gaussian."""
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    total = math.fsum(raw)
    return [(k, w / total) for k, w in zip(range(-radius, radius + 1), raw)]


def odd(n: int) -> int:
    return n if n % 2 else n + 1


def filtered(rows: DataFrame, keys, order: str, value: str, taps: list[tuple[int, float]], boundary: str, out: str) -> DataFrame:
    """``rows`` with ``out``: the series of every key, in its order, under a filter of taps (offset, weight).

    Places are counted, not read from ``order``. Under replication and reflection a row
    holds only what its taps reach; wrapping needs the whole series. A null stays null,
    and so does what it enters.
    """
    reach = max(abs(k) for k, _ in taps)
    by = Window.partitionBy(*keys)
    near = by.orderBy(order).rowsBetween(-reach, reach) if boundary != "wrap" else by.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = rows.withColumns({"_near": F.collect_list(F.struct(F.col(value).cast("double").alias("v"))).over(near), "_at": F.row_number().over(by.orderBy(order)) - 1, "_n": F.count(F.lit(1)).over(by)})
    first = F.greatest(F.col("_at") - reach, F.lit(0)) if boundary != "wrap" else F.lit(0)
    total = None
    for k, w in taps:
        term = F.lit(w) * F.get("_near", (BOUNDARIES[boundary](F.col("_at") + k, F.col("_n")) - first).cast("int"))["v"]
        total = term if total is None else total + term
    return x.withColumn(out, total).drop("_near", "_at", "_n")


#: Widest window whose extremum is taken anew for every row.
SLIDING = 5


def rolling(rows: DataFrame, keys, order: str, value: str, window: int, largest: bool, out: str) -> DataFrame:
    """``rows`` with ``out``: the least or largest value within an odd window around every row, in the order of its key.

    Beyond SLIDING the cost does not follow the window: in blocks as long as the window a row
    knows the extremum from its block's start and that to its block's end, by two growing frames,
    and a window is the end of one block and the start of the next. At the ends windows are cut.
    """
    h, size = window // 2, 2 * (window // 2) + 1
    extremum, of_two = (F.max, F.greatest) if largest else (F.min, F.least)
    by = Window.partitionBy(*keys)
    if size <= SLIDING:
        return rows.withColumn(out, extremum(value).over(by.orderBy(order).rowsBetween(-h, h)))
    x = rows.withColumns({"_at": F.row_number().over(by.orderBy(order)) - 1, "_n": F.count(F.lit(1)).over(by)}).withColumn("_block", F.expr(f"_at div {size}"))
    block = Window.partitionBy(*keys, "_block")
    grown = lambda way: extremum(value).over(block.orderBy(way).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    x = x.withColumn("_from", grown(F.col("_at"))).withColumn("_to", grown(F.desc("_at")))
    x = x.withColumns({"_last": F.max_by("_from", "_at").over(by), "_before": F.lag("_to", h).over(by.orderBy("_at")), "_after": F.lead("_from", h).over(by.orderBy("_at"))})
    same = (F.col("_at") >= h) & (F.expr(f"(_at - {h}) div {size}") == F.expr(f"(_n - 1) div {size}"))
    after = F.when(F.col("_at") + h < F.col("_n"), F.col("_after")).when(~same, F.col("_last"))
    return x.withColumn(out, of_two("_before", after)).drop("_at", "_n", "_block", "_from", "_to", "_last", "_before", "_after")
