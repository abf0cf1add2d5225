"""Non-negative deconvolution of traces of any length, by pools that merge across blocks.

The fit c[t] = decay * c[t-1] + s[t], s >= 0, of least squares is a weighted isotonic
regression of y[t] / decay**t: neighbouring pools that are out of order are merged, in any order,
until none is left. Blocks of a trace are pooled by themselves; then rounds merge what is
out of order where two blocks meet, in alternating pairs of neighbours, until nothing
is: a task holds the pools of two blocks, and of a pair only those at the border change. What a
pool takes over from the next block moves into its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from calspark.sources.tables import materialize

#: Frames of a block.
BLOCK = 8192


@dataclass
class Pools:
    """(level at its start, weight, length, start) of pools in order; levels are relative to their own start, which keeps long traces within range."""

    level: list[float] = field(default_factory=list)
    weight: list[float] = field(default_factory=list)
    length: list[int] = field(default_factory=list)
    start: list[int] = field(default_factory=list)

    def push(self, level: float, weight: float, length: int, start: int, decay: float) -> None:
        """Appends a pool and merges backwards while the last two are out of order."""
        while self.level and self.level[-1] * decay ** self.length[-1] > level:
            v, w, n = self.level.pop(), self.weight.pop(), self.length.pop()
            start = self.start.pop()
            g = decay**n
            total = w + weight * g * g
            level, weight, length = (v * w + level * weight * g) / total, total, n + length
        self.level.append(level)
        self.weight.append(weight)
        self.length.append(length)
        self.start.append(start)

    def extend(self, other: Pools, decay: float) -> None:
        """Appends the pools of what follows."""
        for n, pool in enumerate(zip(other.level, other.weight, other.length, other.start)):
            if n and self.level[-1] * decay ** self.length[-1] <= pool[0]:  # from here on the other's own order holds
                for mine, new in zip((self.level, self.weight, self.length, self.start), (other.level, other.weight, other.length, other.start)):
                    mine += new[n:]
                return
            self.push(*pool, decay)


def pooled(values: np.ndarray, decay: float) -> Pools:
    out = Pools()
    for t, v in enumerate(values):
        out.push(float(v), 1.0, 1, t, decay)
    return out


def spikes_of(pools: Pools, n: int, decay: float) -> np.ndarray:
    """The jump at the start of every pool but the first."""
    spikes = np.zeros(n)
    level, length = np.array(pools.level), np.array(pools.length)
    spikes[pools.start[1:]] = level[1:] - level[:-1] * decay ** length[:-1]
    return spikes


FIELDS = ("level", "weight", "length", "start")
SCHEMA = "block long, level array<double>, weight array<double>, length array<long>, start array<long>"


def _row(key, block: int, pools: Pools) -> tuple:
    return (key, block, *(getattr(pools, f) for f in FIELDS))


def _pools(row) -> Pools:
    return Pools(*(list(getattr(row, f)) for f in FIELDS))


def deconvolve_blocks(traces: DataFrame, value: str, tau: float = 1.0, fs: float = 10.0, block: int = BLOCK) -> DataFrame:
    """roi, frame, spk: the spikes of ``traces.deconvolve``, with no task that holds more than two blocks' pools of a trace.

    Frames count by their order within a trace. Null values are refused by the fit as there.
    """
    decay = math.exp(-1.0 / (tau * fs))
    kind = dict(traces.dtypes)["roi"]
    names = ["roi", "block", *FIELDS]
    order = Window.partitionBy("roi").orderBy("frame")
    placed = traces.select("roi", F.col("frame").cast("long").alias("frame"), F.col(value).cast("double").alias("v"), (F.row_number().over(order) - 1).cast("long").alias("at"))
    placed = materialize(placed.withColumn("block", F.expr(f"at div {block}")), "deconvolution")

    def first(rows: pd.DataFrame) -> list[tuple]:
        pools = pooled(rows["v"].to_numpy(), decay)
        pools.start = (np.array(pools.start) + int(rows["at"].iloc[0])).tolist()
        return [_row(rows["roi"].iloc[0], rows["block"].iloc[0], pools)]

    def merged(pdf: pd.DataFrame) -> list[tuple]:
        rows = list(pdf.itertuples())
        if len(rows) < 2:
            return [_row(r.roi, r.block, _pools(r)) for r in rows]
        left, right = (_pools(r) for r in rows)
        count = len(left.level)
        left.extend(right, decay)
        # the pools that begin in the first block stay there, those that begin in the second in theirs
        own = min(count, int(np.searchsorted(left.start, right.start[0])))
        parts = [Pools(*(getattr(left, f)[s] for f in FIELDS)) for s in (slice(0, own), slice(own, None))]
        return [_row(r.roi, r.block, p) for r, p in zip(rows, parts) if p.level]

    def grouped(use, keys: tuple[str, str]):
        """``use`` on the rows of every pair of keys of a stream in their order: a batch gives a batch, whatever the number of groups."""

        def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: pd.DataFrame | None = None
            for pdf in it:
                if held is not None and len(held):
                    pdf = pd.concat([held, pdf], ignore_index=True)
                k, m = (pdf[c].to_numpy() for c in keys)
                edges = [0, *(np.flatnonzero((k[1:] != k[:-1]) | (m[1:] != m[:-1])) + 1).tolist()] if len(pdf) else [0]
                out = [row for a, b in zip(edges, edges[1:]) for row in use(pdf.iloc[a:b])]
                held = pdf.iloc[edges[-1] :]  # may go on in the next batch
                if out:
                    yield pd.DataFrame(out, columns=names)
            if held is not None and len(held):
                yield pd.DataFrame(use(held), columns=names)

        return run

    schema = f"roi {kind}, {SCHEMA}"
    dealt = placed.repartition("roi", "block").sortWithinPartitions("roi", "block", "at")
    state = materialize(dealt.select("roi", "block", "at", "v").mapInPandas(grouped(first, ("roi", "block")), schema), "pools")
    by = Window.partitionBy("roi").orderBy("block")  # a row a block, without its pools
    turn = 0
    while True:
        ends = state.select("roi", "block", F.element_at("level", 1).alias("low"), (F.element_at("level", -1) * F.pow(F.lit(decay), F.element_at("length", -1))).alias("high"))
        ends = materialize(ends.withColumns({"n": F.row_number().over(by), "open": F.lag("high").over(by) > F.col("low")}), "pool-ends")
        if not ends.where("open").limit(1).count():
            break
        pairs = ends.select("roi", "block", F.floor((F.col("n") + turn) / 2).alias("pair"))
        dealt = state.join(pairs, ["roi", "block"]).repartition("roi", "pair").sortWithinPartitions("roi", "pair", "block")
        state = materialize(dealt.select("roi", "pair", "block", *FIELDS).mapInPandas(grouped(merged, ("roi", "pair")), schema), "pools")
        turn = 1 - turn
    last = state.select("roi", "block", F.element_at("level", -1).alias("level"), F.element_at("length", -1).alias("length"))
    before = last.select("roi", "block", (F.lag("level").over(by) * F.pow(F.lit(decay), F.lag("length").over(by))).alias("before"))
    each = state.join(before, ["roi", "block"]).select("roi", "before", F.posexplode(F.arrays_zip("level", "length", "start")).alias("k", "p"), F.col("level").alias("levels"), F.col("length").alias("lengths"))
    previous = F.when(F.col("k") == 0, F.col("before")).otherwise(F.get("levels", F.col("k") - 1) * F.pow(F.lit(decay), F.get("lengths", F.col("k") - 1)))
    jumps = each.select("roi", F.col("p.start").alias("at"), (F.col("p.level") - previous).alias("spk")).where("spk is not null")
    return placed.select("roi", "frame", "at").join(jumps, ["roi", "at"], "left").select("roi", "frame", F.coalesce("spk", F.lit(0.0)).alias("spk"))
