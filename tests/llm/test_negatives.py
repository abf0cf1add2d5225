"""Hard negatives against scores of all pairs."""

import random

import numpy as np
import pytest

from calspark.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=100, most=5, wanted=10, noisy=True):
    kept = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(c is None or not np.isfinite(c) for c in v):
            continue
        x = [int(np.floor(256 * float(np.float32(c)))) for c in v]
        kept.append((i, (label + 1) % 10 if noisy and i % 7 == 0 else label, x))
    dot = lambda a, b: sum(p * q for p, q in zip(a, b))
    out = []
    for k, (i, label, x) in enumerate(kept):
        if i % every:
            continue
        order = sorted((-dot(x, y), j, same == label) for m, (j, same, y) in enumerate(kept) if m != k)
        for minus, j, _ in [o for o in order if o[2]][:most]:
            fits = [(s, n) for s, n, same in order if not same and 30 * -minus <= 100 * -s <= 90 * -minus]
            out += [(i, j, rank, n, -minus, -s) for rank, (s, n) in enumerate(fits[:wanted], 1)]
    return sorted(out)


def vectors(seed, n, width, spread=1.0, step=7):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, width))
    out = []
    for k in range(n):
        v = centres[k % 12] + spread * r.normal(size=width)
        out.append((k * step % 5000, (v / max(1e-9, np.linalg.norm(v))).astype(np.float32).tolist(), int(k % 12 % 4)))
    return out


def result(df):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


@pytest.mark.parametrize("seed,n,width,spread", [(1, 900, 64, 0.7), (2, 400, 5, 0.2), (3, 300, 1, 1.0), (4, 700, 16, 0.0)])
def test_against_all_pairs(spark, seed, n, width, spread):
    rows = vectors(seed, n, width, spread)
    docs = spark.createDataFrame([(*r, "x", 3) for r in rows], SCHEMA + ", number string, rank int").repartition(4)
    assert result(negatives.hard_negatives(docs)) == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    r = random.Random(5)
    rows = [(100 * k, [r.choice([-1.0, 0.5, 0.25, 0.0]) for _ in range(4)], k % 2) for k in range(12)]
    rows += [(k, [r.choice([-1.0, 0.5, 1.0, 3e4]) for _ in range(r.randint(0, 4))], k % 3) for k in range(1, 60)]
    rows += [(200, None, 1), (300, [0.5, None], 0), (400, [nan, 1.0], 0), (500, [inf], 1), (600, [1.0], None), (None, [1.0], 1)]
    assert result(negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_ties_repeated_ids_and_blocks_of_anchors(spark):
    rows = [(k % 40 * 50, [1.0, 0.0] if k % 3 else [0.6, 0.1], k % 2) for k in range(160)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert result(negatives.hard_negatives(docs, anchors=7)) == result(negatives.hard_negatives(docs)) == brute(rows)


def test_without_anchors_and_empty(spark):
    assert negatives.hard_negatives(spark.createDataFrame([(1, [1.0], 1)], SCHEMA)).count() == 0
    assert negatives.hard_negatives(spark.createDataFrame([], SCHEMA)).count() == 0


def test_bounds_hold_every_score():
    r = np.random.default_rng(6)
    x, q = r.integers(-120, 120, (500, 6)), r.integers(-120, 120, (9, 6))
    edges = np.stack([np.concatenate(([c.min()], np.quantile(c, np.arange(1, 16) / 16).astype(int), [c.max() + 1])) for c in x.T])
    cell = np.stack([np.searchsorted(e[1:-1], x[:, d], "right") for d, e in enumerate(edges)], 1)
    codes = (cell[:, ::2] * 16 + cell[:, 1::2]).astype(np.uint8)
    lower, upper = (negatives.bounds(codes, t) for t in negatives.tables(q, edges))
    assert (lower <= x @ q.T).all() and (x @ q.T <= upper).all() and (upper - lower).mean() < (x @ q.T).std()
