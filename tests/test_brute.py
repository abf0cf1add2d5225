"""Queries of the catalogue that SQL cannot say, each against a plain recomputation of its whole result."""

import math
import os

import numpy as np
import pytest

from calspark.operators import classify as K
from calspark.operators import detection as D
from calspark.operators import pursuit as P
from calspark.operators import registration as G
from calspark.plans import carriers as C
from calspark.plans import catalog
from calspark.plans.movie_queries import BLOCK
from calspark.plans.other_queries import SPARSE, _sparse, _svd

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


def rows(spark, name):
    return catalog.queries()[name](spark, DATA).collect()


@pytest.fixture(scope="module")
def movie(spark):
    out = {}
    for r in C.movie(spark, DATA).orderBy("frame").collect():
        out.setdefault(r.plane, []).append((r.frame, np.array(r.arr)))
    return {p: ([f for f, _ in x], np.stack([a for _, a in x])) for p, x in out.items()}


def test_kriging(spark, movie):
    coarse, fine = [(a, b) for a in range(-3, 4) for b in range(-3, 4)], [(a / 10, b / 10) for a in range(-30, 31) for b in range(-30, 31)]
    k = lambda p, q: math.exp(-((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2) / (2 * 0.85**2))
    weights = np.linalg.inv([[k(p, q) for q in coarse] for p in coarse]) @ np.array([[k(p, q) for q in fine] for p in coarse])
    got = {(r.plane, r.fine): r.v for r in rows(spark, "kriging_upsample")}
    assert len(got) == 61 * 61 * len(movie)
    for plane, (_, x) in movie.items():
        want = x.mean(0).reshape(8, 8)[:7, :7].ravel() @ weights
        assert all(abs(want[j] - got[plane, j]) < 2e-6 for j in range(61 * 61))


def test_components_low_and_high(spark, movie):
    want = {}
    for plane, (_, x) in movie.items():
        x0 = x - x.mean(0)
        u = np.linalg.svd(x0, full_matrices=False)[0]
        for pc in range(min(2, len(x))):
            v = u[:, pc] * np.sign(u[np.abs(u[:, pc]).argmax(), pc])
            order = sorted(range(len(v)), key=lambda n: v[n])
            for side, best in (("low", order[:5]), ("high", order[-5:])):
                want[plane, pc, side] = (x0[best].mean(0) ** 2).sum()
    got = {(r.plane, r.pc, r.side): r.energy for r in rows(spark, "pca_low_high")}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_denoised_blocks(spark, movie):
    want = {}
    axis = lambda n: 1 / (1 + np.exp((np.abs(np.arange(n) - (n - 1) / 2) - ((n - 1) / 2 - 2 * 0.5)) / 0.5))
    weight = np.outer(axis(4), axis(4))
    starts = [int(v) for v in np.linspace(0, 4, 3)]
    for plane, (frames, x) in movie.items():
        x = x.reshape(-1, 8, 8)
        top, below = np.zeros_like(x), np.zeros((8, 8))
        for y in starts:
            for z in starts:
                part = x[:, y : y + 4, z : z + 4].reshape(len(x), -1)
                u, s, v = np.linalg.svd(part - part.mean(0), full_matrices=False)
                s[2:] = 0
                top[:, y : y + 4, z : z + 4] += ((u * s) @ v + part.mean(0)).reshape(-1, 4, 4) * weight
                below[y : y + 4, z : z + 4] += weight
        for f, image in zip(frames, top / below):
            want.update({(plane, f, y, z): image[y, z] for y in range(8) for z in range(8)})
    got = {(r.plane, r.frame, r.y, r.x): r.v for r in rows(spark, "pca_denoise_blocks")}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 2e-6


def test_references(spark, movie):
    """All steps by full transforms, a frame and a lag at a time."""
    h = w = 8
    reach = min(round(0.1 * 8), 4)
    edge = lambda n, s: 1 / (1 + np.exp((np.abs(np.arange(n) - (n - 1) / 2) - ((n - 1) / 2 - 2 * s)) / s))
    mask = np.outer(edge(h, 3.45), edge(w, 3.45))
    bell = np.exp(-0.5 * ((np.arange(8) - 3.5) / 1.15) ** 2)
    bell = np.outer(bell, bell) / np.outer(bell, bell).sum()
    spectrum = np.real(np.fft.fft2(np.fft.ifftshift(bell)))

    def shift(frame, ref):
        low, high = np.trunc(np.percentile(ref, 1)), np.trunc(np.percentile(ref, 99))
        r, f = np.clip(ref, low, high), np.clip(frame, low, high)
        a = np.fft.fft2(f * mask + r.mean() * (1 - mask))
        b = np.conj(np.fft.fft2(r))
        c = np.real(np.fft.ifft2(a / (np.abs(a) + 1e-5) * b / (np.abs(b) + 1e-5) * spectrum))
        return max(((round(c[y, x], 12), -y, -x) for y in range(-reach, reach + 1) for x in range(-reach, reach + 1)))

    got = {(r.plane, r.y, r.x): r.v for r in rows(spark, "reference_refine")}
    for plane, (_, x) in movie.items():
        x = np.round(x * 1000).reshape(-1, h, w)
        flat = x.reshape(len(x), -1) - x.reshape(len(x), -1).mean(1, keepdims=True)
        cc = np.corrcoef(flat) if len(x) > 1 else np.ones((1, 1))
        seed = int(np.argmax([np.sort(row)[::-1][1:20].mean() for row in cc]))
        ref = np.trunc(flat[np.argsort(-cc[seed], kind="stable")[:20]].mean(0)).reshape(h, w)
        work = x
        for i in range(8):
            found = [shift(f, ref) for f in work]
            ys, xs, cs = [-f[1] for f in found], [-f[2] for f in found], np.array([f[0] for f in found])
            work = np.stack([np.roll(f, (-a, -b), (0, 1)) for f, a, b in zip(work, ys, xs)])
            best = np.argsort(-cs, kind="stable")[: max(2, int(len(work) * (1 + i) / 16))]
            ref = np.trunc(np.roll(work[best].mean(0), (round(float(np.mean([ys[k] for k in best]))), round(float(np.mean([xs[k] for k in best])))), (0, 1)))
        assert all(abs(got[plane, y, z] - ref[y, z]) < 1e-6 for y in range(h) for z in range(w)), plane


def test_warped_frames_and_their_upsampled_mean(spark):
    """Bilinear reading and adding up, pixel by pixel, from the shifts that registration reports."""
    from calspark.plans.movie_queries import _first, _synthetic

    m = _synthetic(spark, DATA)
    done = G.register(m, _first(m), 24, 24, G.RigidSettings(max_shift=0.1, spatial_taper=1.0, norm_frames=False), BLOCK).collect()
    blocks, (ny, nx), _ = G.block_grid(24, 24, BLOCK.block)
    centres = [(a + b) // 2 for a, b, _, _ in blocks[::nx]]
    source = {(r.plane, r.frame): np.array(r.arr).reshape(24, 24) for r in m.collect()}

    def field(values, y, x):
        """Between the centres of blocks linearly, beyond them like the nearest; the last centre's own line belongs to it."""
        def place(at):
            span = centres[-1] - centres[0]
            t = min(max(at - centres[0], 0), span - 1) * (len(centres) - 1) / (span - 1)
            low = min(int(t), len(centres) - 2)
            return low, t - low

        (a, fa), (b, fb) = place(y), place(x)
        v = np.asarray(values).reshape(ny, nx)
        return (v[a, b] * (1 - fb) + v[a, b + 1] * fb) * (1 - fa) + (v[a + 1, b] * (1 - fb) + v[a + 1, b + 1] * fb) * fa

    totals = {(r.plane, r.frame): r.total for r in rows(spark, "nonrigid_warp")}
    sums, counts = {}, {}
    for r in done:
        image = np.roll(source[r.plane, r.frame], (-r.yoff, -r.xoff), (0, 1))
        assert totals[r.plane, r.frame] == sum(r.arr)
        for y in range(24):
            for x in range(24):
                fy, fx = field(r.yoff1, y, x), field(r.xoff1, y, x)
                a, b = min(max(y + fy, 0), 23), min(max(x + fx, 0), 23)
                i, j = min(int(a), 22), min(int(b), 22)
                p, q = a - i, b - j
                v = (image[i, j] * (1 - q) + image[i, j + 1] * q) * (1 - p) + (image[i + 1, j] * (1 - q) + image[i + 1, j + 1] * q) * p
                assert r.arr[24 * y + x] == math.trunc(v) or abs(v - round(v)) < 1e-6 and abs(r.arr[24 * y + x] - v) < 1.001
                at = (r.plane, min(max(math.floor(0.5 + (y - fy) * 2 + 1e-12), 0), 47), min(max(math.floor(0.5 + (x - fx) * 2 + 1e-12), 0), 47))
                sums[at], counts[at] = sums.get(at, 0.0) + image[y, x], counts.get(at, 0) + 1
    got = {(r.plane, r.y, r.x): (r.v, r.n) for r in rows(spark, "mean_image_upsampled")}
    same = sum(k in got and got[k][1] == counts[k] and abs(got[k][0] - sums[k] / counts[k]) < 1e-3 for k in counts)
    assert same >= 0.99 * len(counts) and abs(len(got) - len(counts)) <= 0.01 * len(counts)


def test_activity_in_order(spark):
    from calspark.operators import traces as T
    from calspark.plans.trace_queries import BIN

    table = {}
    for r in T.bin_mean(C.traces(spark, DATA), "f", BIN).collect():
        table.setdefault(r.roi, {})[r.bin] = r.v
    rois, bins = sorted(table), sorted({b for t in table.values() for b in t})
    x = np.array([[table[r].get(b, 0.0) for b in bins] for r in rois])
    z = np.clip((x - x.mean(1, keepdims=True)) / np.maximum(x.std(1, keepdims=True), 1e-10), -4, 8)
    centred = z - z.mean(0)
    value, vector = np.linalg.eigh(centred @ centred.T)
    v = vector[:, -1] * np.sign(vector[np.abs(vector[:, -1]).argmax(), -1])
    order = np.argsort(v, kind="stable")
    want = {}
    for rank, k in enumerate(order):
        near = [order[min(max(n, 0), len(order) - 1)] for n in range(rank - 3, rank + 4)]
        want.update({(rois[k], rank, b): z[near, n].mean() for n, b in enumerate(bins)})
    got = {(r.roi, r.rank, r.bin): r.v for r in rows(spark, "activity_sorted")}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-4


def test_one_to_one_matching_is_the_best(spark):
    from calspark.operators import masks as M

    pairs = {(r.a, r.b): round(r.cosine, 6) for r in M.cosine_pairs(C.masks(spark, DATA)).collect()}
    left, right = sorted({a for a, _ in pairs}), sorted({b for _, b in pairs})
    best = {0: 0.0}  # columns taken -> greatest sum
    for a in left:
        step = {}
        for taken, total in best.items():
            for j, b in enumerate(right):
                if not taken >> j & 1:
                    step[taken | 1 << j] = max(step.get(taken | 1 << j, -1), total + pairs.get((a, b), 0.0))
            step[taken] = max(step.get(taken, -1), total)
        best = step
    got = rows(spark, "match_one_to_one")
    assert len({r.a for r in got}) == len({r.b for r in got}) == len(got) and all(abs(pairs[r.a, r.b] - r.cosine) < 1e-9 and r.cosine >= 0.05 for r in got)
    assert abs(sum(r.cosine for r in got) - max(best.values())) <= 0.05 * len(left)


def test_classifier_by_newton_steps(spark):
    """Class shares by quantile, smoothed, then a ridge logistic regression on their log-odds."""
    train = C.train(spark, DATA).toPandas().sort_values("roi")
    keys, nodes = ("skew", "npix_norm", "compact"), K.NODES
    model = K.Classifier.fit(C.train(spark, DATA))
    z = []
    for k in keys:
        order = train.sort_values([k, "roi"])
        v, c, n = order[k].to_numpy(), order["iscell"].to_numpy(), len(order)
        edges = sorted({math.floor(i * ((n - 1) / (nodes - 1))) for i in range(nodes)})  # fewer rows than nodes: some meet
        assert np.allclose(model.nodes[k], v[edges])
        at = np.clip(np.searchsorted(v[edges], train[k].clip(v[edges[0]], v[edges[-1]]), side="left") - 1, 0, len(model.p[k]) - 1)
        p = np.array(model.p[k])[at]
        z.append(np.log(p + 1e-6) - np.log(1 - p + 1e-6))
    x, y = np.column_stack([*z, np.ones(len(train))]), train["iscell"].to_numpy(float)
    weights, ridge = np.zeros(x.shape[1]), np.diag([1.0 / K.C] * 3 + [0.0])
    for _ in range(200):
        p = 1 / (1 + np.exp(-x @ weights))
        weights = weights - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ weights)
    assert np.allclose(weights, [*model.weights, model.intercept], atol=2e-3)
    kept = 1 / (1 + np.exp(-x @ weights)) > 0.5
    want = {(int(a), bool(b)): int(((y == a) & (kept == b)).sum()) for a in (0, 1) for b in (False, True)}
    got = {(r.label, r.iscell): r.n for r in rows(spark, "classifier_predict")}
    assert all(abs(got.get(k, 0) - n) <= 1 for k, n in want.items())


@pytest.fixture(scope="module")
def wide(movie):
    """plane -> (frames, movie of 40 x 40)."""
    k = np.arange(1600)
    square, other = k // 40 // 5 * 8 + k % 40 // 5, (13 * k + k // 40) % 64
    return {p: (f, (x[:, square] + 0.3 * x[:, other]).reshape(-1, 40, 40)) for p, (f, x) in movie.items()}


@pytest.fixture(scope="module")
def boxes(spark):
    out = {}
    for r in C.tile_masks(spark, DATA, C.WIDE).orderBy("roi", "y", "x").collect():
        out.setdefault(r.roi, []).append((r.y, r.x, r.lam))
    return {roi: np.array(v) for roi, v in out.items()}


def greedy(movie, settings):
    """Sparse pursuit with all maps made anew for every region."""
    movie = movie - np.concatenate([np.repeat(movie[a : a + 100].mean(0)[None], len(movie[a : a + 100]), 0) for a in range(0, len(movie), 100)])
    sd = np.maximum(np.sqrt((np.diff(movie, axis=0) ** 2).sum(0) / len(movie)), 1e-10)
    work = P.without_surround(movie / sd, settings.highpass_neuropil)
    scale = P.estimate_scale([r.max(0) for r in P.pyramid(work)], settings.spatial_scale)
    threshold, found = 5 * settings.threshold_scaling * max(1, scale), []
    while True:
        maps = [P.energy(r, threshold) for r in P.pyramid(work)]
        s = int(np.argmax([m.max() for m in maps]))
        if maps[s].max() < threshold * max(1.0, len(movie) / 1200):
            return found
        y, x = np.unravel_index(maps[s].argmax(), maps[s].shape)
        y, x, half = min(y * 2**s + 2**s // 2, 39), min(x * 2**s + 2**s // 2, 39), 3 * 2**s // 2
        inside = np.zeros((40, 40), bool)
        inside[max(0, y - half) : y - half + 3 * 2**s, max(0, x - half) : x - half + 3 * 2**s] = True
        lam = inside / np.sqrt(inside.sum())
        active = work[:, inside] @ lam[inside] > threshold
        for _ in range(3):
            if not active.any():
                return found
            inside, lam = P.grow_region(work, inside, active)
            active = work[:, inside] @ lam[inside] > threshold
        if not active.any():
            return found
        gain, part = P.split_ratio(work[:, inside], lam[inside], threshold)
        if gain > 1.25:
            lam = np.zeros((40, 40))
            lam[inside] = np.where(part > part.max() / 5, part, 0)
            lam /= max(np.linalg.norm(lam), 1e-10)
            active = work.reshape(len(work), -1) @ lam.ravel() > threshold
            if not active.any():
                return found
        proj = work.reshape(len(work), -1) @ lam.ravel()
        work = work - np.where(active, proj, 0)[:, None, None] * lam
        found.append(lam * sd)


def summary(found):
    out = []
    for n, lam in enumerate(found):
        y, x = np.nonzero(lam > 0)
        w = lam[y, x]
        out.append((n, len(y), (y * w).sum() / w.sum(), (x * w).sum() / w.sum()))
    return out


def test_regions_of_the_carrier(spark, wide):
    for name, search in (("detect_sparse", lambda x: greedy(x, SPARSE)), ("detect_svd", lambda x: [lam for lam, _ in D.component_pursuit(D.high_passed(x, 100), 6.0, 0.6)])):
        got = {}
        for r in rows(spark, name):
            got.setdefault(r.plane, []).append((r.roi, r.npix, r.y, r.x))
        want = {p: summary(search(x)) for p, (_, x) in wide.items()}
        want = {p: w for p, w in want.items() if w}
        assert want and got.keys() == want.keys(), name
        for p in want:
            assert np.allclose(sorted(got[p]), want[p], atol=2e-3), (name, p)


def test_split_ratios_of_boxes(spark, wide, boxes):
    want = {}
    for roi, b in boxes.items():
        if roi % 10 in wide:
            x = wide[roi % 10][1][:, b[:, 0].astype(int), b[:, 1].astype(int)]
            want[roi] = P.split_ratio(x, b[:, 2] / np.linalg.norm(b[:, 2]), 2.0)[0]
    got = {r.roi: r.ratio for r in rows(spark, "split_test")}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-4 for k in want)


def test_extended_boxes(spark, wide, boxes):
    order = sorted((f, p, n) for p, (frames, _) in wide.items() for n, f in enumerate(frames))
    x = np.stack([wide[p][1][n] for _, p, n in order])
    got = {r.roi: (r.npix, r.weight) for r in rows(spark, "masks_extended")}
    assert got.keys() == boxes.keys()
    for roi, b in boxes.items():
        ys, xs = b[:, 0].astype(int), b[:, 1].astype(int)
        cut = slice(max(0, ys.min() - 10), ys.max() + 11), slice(max(0, xs.min() - 10), xs.max() + 11)
        part = x[(slice(None), *cut)]
        inside = np.zeros(part.shape[1:], bool)
        inside[ys - cut[0].start, xs - cut[1].start] = True
        mean = part[:, inside].mean(1)
        _, lam = P.grow_region(part - part.mean(0), inside, mean >= np.quantile(mean, 0.95))
        lam = D.connected_part(lam)
        assert got[roi][0] == (lam > 0).sum() and abs(got[roi][1] - lam.sum()) < 2e-3


def test_score_of_two_searches(spark, wide):
    sides = []
    for search in (_sparse, _svd):
        regions = {}
        for r in search(spark, DATA).collect():
            regions.setdefault((r.plane, r.roi), {})[r.y, r.x] = r.lam
        sides.append(regions)

    def trace(key, region):
        ys, xs = (np.array(v) for v in zip(*region))
        w = np.array(list(region.values()))
        return wide[key[0]][1][:, ys, xs] @ (w / w.sum())

    matched = set()
    for k, a in sides[0].items():
        for m, b in sides[1].items():
            both = len(a.keys() & b.keys())
            if k[0] == m[0] and both / (len(a) + len(b) - both) > 0.3 and np.corrcoef(trace(k, a), trace(m, b))[0, 1] > 0.5:
                matched.add(k)
    tp, (score,) = len(matched), rows(spark, "detect_f1")
    assert (score.tp, score.fp, score.fn) == (tp, len(sides[0]) - tp, len(sides[1]) - tp)
    assert abs(score.f1 - tp / (tp + 0.5 * (score.fp + score.fn))) < 1e-6
