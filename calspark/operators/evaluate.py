"""Scores of detected regions against a ground truth."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from calspark.operators.masks import overlaps
from calspark.sources.tables import materialize


def matches(masks: DataFrame, truth: DataFrame, traces: DataFrame, truth_traces: DataFrame, least_iou: float = 0.5, least_r: float = 0.5) -> DataFrame:
    """a, b, iou, r: pairs of a region and a true one whose masks and traces agree.

    masks: roi, y, x. traces: roi, bin, v. Masks meet by pixel, traces only for pairs
    that passed the mask test.
    """
    met = overlaps(masks.select("roi", "y", "x"), truth.select("roi", "y", "x"))
    iou = met.select("a", "b", (F.col("inter") / (F.col("na") + F.col("nb") - F.col("inter"))).alias("iou")).where(F.col("iou") > least_iou)
    ta, tb = traces.select(F.col("roi").alias("a"), "bin", F.col("v").alias("va")), truth_traces.select(F.col("roi").alias("b"), "bin", F.col("v").alias("vb"))
    r = iou.join(ta, "a").join(tb, ["b", "bin"]).groupBy("a", "b", "iou").agg(F.corr("va", "vb").alias("r"))
    return r.where(F.col("r") > least_r)


def f1(matched: DataFrame, n_found: int | DataFrame, n_true: int | DataFrame) -> DataFrame:
    """tp, fp, fn, f1 from matched pairs and the numbers of found and true regions."""
    count = lambda x: x.select("roi").distinct().count() if isinstance(x, DataFrame) else x
    found, true = count(n_found), count(n_true)
    s = matched.agg(F.countDistinct("a").alias("tp"))
    s = s.withColumn("fp", F.lit(found) - F.col("tp")).withColumn("fn", F.lit(true) - F.col("tp"))
    return s.withColumn("f1", F.try_divide(F.col("tp").cast("double"), F.col("tp") + 0.5 * (F.col("fp") + F.col("fn"))))


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """Minimum-cost one-to-one assignment by shortest augmenting paths (rows at most columns)."""
    if cost.shape[0] > cost.shape[1]:
        return [(a, b) for b, a in assignment(cost.T)]
    n, m = cost.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for row in range(1, n + 1):
        match[0], column = row, 0
        least, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while match[column]:
            used[column] = True
            r = match[column]
            reduced = cost[r - 1] - u[r] - v[1:]
            free = ~used[1:]
            better = free & (reduced < least[1:])
            least[1:][better], way[1:][better] = reduced[better], column
            nxt = int(np.where(free, least[1:], np.inf).argmin()) + 1
            delta = least[nxt]
            u[match[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            column = nxt
        while column:
            match[column] = match[way[column]]
            column = way[column]
    return [(int(match[j]) - 1, j - 1) for j in range(1, m + 1) if match[j]]


#: By how much a pair may exceed its prices: rounding of sums.
SLACK = 1e-12


def sparse_assignment(edges: list[list[tuple[int, float]]], columns: int, begun: tuple[list[int], list[float], list[float]] | None = None) -> tuple[list[int], list[float], list[float]]:
    """(column of each row or -1, prices of rows, prices of columns) of the matching of greatest total weight.

    edges: of each row its columns and weights. Rows are added one by one along the cheapest path that ends
    at a free column or sets a row free. Prices prove it: none is negative, those of a pair are its weight at
    least, those of a matched pair just that, and what is free has none. ``begun`` is a result for a part of the
    edges: only rows whose new edges exceed its prices are added again, then the columns that this left free.
    """
    mate, u, v = begun or ([-1] * len(edges), [0.0] * len(edges), [0.0] * columns)
    for i, own in enumerate(edges):
        if mate[i] >= 0 and any(w - u[i] - v[j] > SLACK / 4 for j, w in own):
            mate[i] = -1
    owner = [-1] * columns
    for i, j in enumerate(mate):
        if j >= 0:
            owner[j] = i
    for i, own in enumerate(edges):
        if mate[i] < 0:
            u[i] = max([0.0, *(w - v[j] for j, w in own)])
            if u[i]:
                _settle(i, edges, mate, owner, u, v)
    loose = [j for j in range(columns) if owner[j] < 0 and v[j]]
    if loose:
        back: list[list[tuple[int, float]]] = [[] for _ in range(columns)]
        for i, own in enumerate(edges):
            for j, w in own:
                back[j].append((i, w))
        for j in loose:
            if owner[j] < 0:
                v[j] = max([0.0, *(w - u[i] for i, w in back[j])])
                if v[j]:
                    _settle(j, back, owner, mate, v, u)
    return mate, u, v


def _settle(first: int, edges: list[list[tuple[int, float]]], mate: list[int], owner: list[int], u: list[float], v: list[float]) -> None:
    """Matches a free row, or takes its price away, by the cheapest path; changes the matching and prices."""
    # the way from the new row: nearest rows and columns first, up to the best end known
    at, came, reached, done, heap = {first: 0.0}, {}, {}, {}, []
    end, freed, length = -1, first, u[first]
    row = first
    while True:
        d, price = at[row], u[row]
        for j, w in edges[row]:
            far = d + max(0.0, price + v[j] - w)
            if far < length and far < reached.get(j, math.inf) and j not in done:
                reached[j], came[j] = far, row
                if owner[j] < 0:
                    end, length = j, far
                else:
                    heapq.heappush(heap, (far, j))
        while heap and (heap[0][1] in done or heap[0][0] > reached[heap[0][1]]):
            heapq.heappop(heap)
        if not heap or heap[0][0] >= length:
            break
        far, j = heapq.heappop(heap)
        done[j] = far
        row = owner[j]
        at[row] = far
        if far + u[row] < length:
            end, freed, length = -1, row, far + u[row]
    for i, d in at.items():
        if d < length:
            u[i] -= length - d
    for j, d in done.items():
        if d < length:
            v[j] += length - d
    if end < 0:  # the row set free hands its column on
        end, u[freed] = mate[freed], 0.0
        mate[freed] = -1
        if freed == first:
            return
    while end >= 0:
        i = came[end]
        mate[i], owner[end], end = end, i, mate[i]


def components(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """The least node that each of n nodes is connected to by the edges."""
    label = np.arange(n)
    while True:
        p, q = label[left], label[right]
        apart = p != q
        if not apart.any():
            return label
        left, right, p, q = left[apart], right[apart], p[apart], q[apart]
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while (label[label] != label).any():
            label = label[label]


#: Best pairs of each region that the search begins with, and pairs of each that a round adds at most.
BEST = 12
#: Tasks that the components of a plane's best pairs are dealt to.
DEALT = 64


def one_to_one(pairs: DataFrame, least: float = 0.5) -> DataFrame:
    """plane, a, b, cosine: of the one-to-one matching of a plane's pairs (plane, a, b, cosine) of greatest total, those of at least that value.

    The matching is found on the best pairs of each region, with a price for every region. All pairs are then held
    against the prices; those that exceed them join and the matching goes on from where it was, until there are none,
    which proves it the best of all pairs. Components of the best pairs are matched in tasks of their own. A task holds
    some pairs a region of its components, never a matrix; all pairs stay in a table, which is read in each round.
    """
    kinds = dict(pairs.dtypes)
    plane, a, b = kinds["plane"], kinds["a"], kinds["b"]
    held = materialize(pairs.select("plane", "a", "b", F.col("cosine").cast("double").alias("cosine")).where("cosine > 0"), "pairs")

    def best(x: DataFrame, by: str) -> DataFrame:
        """The first BEST pairs of each region on either side."""
        top = [x.withColumn("n", F.row_number().over(Window.partitionBy("plane", k).orderBy(F.desc(by), other))).where(F.col("n") <= BEST) for k, other in (("a", "b"), ("b", "a"))]
        return top[0].unionByName(top[1]).select("plane", "a", "b", "cosine").distinct()

    def dealt(pdf: pd.DataFrame) -> pd.DataFrame:
        left, i = np.unique(pdf["a"], return_inverse=True)
        right, j = np.unique(pdf["b"], return_inverse=True)
        part = np.unique(components(i, len(left) + j, len(left) + len(right)), return_inverse=True)[1] % DEALT
        sides = [pd.DataFrame({"a": left, "b": None, "part": part[: len(left)]}), pd.DataFrame({"a": None, "b": right, "part": part[len(left) :]})]
        return pd.concat([x.astype(object) for x in sides]).assign(plane=pdf["plane"].iloc[0])[["plane", "a", "b", "part"]]

    def run(pdf: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        left, i = np.unique(pdf["a"], return_inverse=True)
        right, j = np.unique(pdf["b"], return_inverse=True)
        edges: list[list[tuple[int, float]]] = [[] for _ in left]
        for m, n, w in zip(i.tolist(), j.tolist(), pdf["cosine"].tolist()):
            edges[m].append((n, w))
        row, column = ({str(k): n for n, k in enumerate(x.tolist())} for x in (left, right))
        mate, u, v = [-1] * len(left), [0.0] * len(left), [0.0] * len(right)
        for m, n, price in zip(before["a"], before["b"], before["price"].tolist()):
            if m is None:
                v[column[n]] = price
            else:
                u[row[m]], mate[row[m]] = price, -1 if n is None else column[n]
        mate, u, v = sparse_assignment(edges, len(right), (mate, u, v))
        value = [dict(e).get(m) for e, m in zip(edges, mate)]
        rows = pd.DataFrame({"plane": pdf["plane"].iloc[0], "a": left, "b": np.array([right[m] if m >= 0 else None for m in mate], object), "cosine": value, "price": u})
        columns = pd.DataFrame({"plane": pdf["plane"].iloc[0], "a": None, "b": right, "cosine": None, "price": v})
        return pd.concat([rows.astype(object), columns.astype(object)])

    found = f"plane {plane}, a {a}, b {b}, cosine double, price double"
    core, solved = materialize(best(held, "cosine"), "best-pairs"), pairs.sparkSession.createDataFrame([], found)
    while True:
        part = materialize(core.select("plane", "a", "b").groupBy("plane").applyInPandas(dealt, f"plane {plane}, a {a}, b {b}, part int"), "parts")
        of_a, of_b = (F.broadcast(part.where(f"{k} is not null").select("plane", k, "part")) for k in "ab")
        before = solved.where("a is not null").join(of_a, ["plane", "a"]).unionByName(solved.where("a is null").join(of_b, ["plane", "b"]))
        before = before.withColumns({k: F.col(k).cast("string") for k in "ab"}).withColumn("part", F.col("part") + 0)  # numbers beside nulls would become floats
        tasks = [x.groupBy("plane", "part") for x in (core.join(of_a, ["plane", "a"]), before)]
        solved = materialize(tasks[0].cogroup(tasks[1]).applyInPandas(run, found), "prices")
        rows, columns = solved.where("a is not null").select("plane", "a", F.col("price").alias("u")), solved.where("a is null").select("plane", "b", F.col("price").alias("v"))
        over = held.join(F.broadcast(rows), ["plane", "a"]).join(F.broadcast(columns), ["plane", "b"]).withColumn("over", F.col("cosine") - F.col("u") - F.col("v")).where(F.col("over") > SLACK)
        fresh = materialize(best(over, "over"), "more-pairs")
        if fresh.isEmpty():
            return solved.where(F.col("a").isNotNull() & (F.col("cosine") >= least)).select("plane", "a", "b", "cosine")
        core = core.unionByName(fresh)
