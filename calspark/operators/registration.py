"""Motion correction: reference images, rigid and block-wise shifts, warping, crop, z alignment.

Frames are rows with their pixels in an array of doubles or, faster, in a blob of int16;
kernels work on Arrow batches of frames with NumPy, in double precision on arrays and
in single precision on blobs, and what every frame needs (filtered reference, block grid, kernels) is
small and made once on the driver. Frames are never exploded or shuffled here.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EPSILON = 1e-5
#: Frames that a kernel takes at a time, which bounds a task's memory.
FRAMES_AT_A_TIME = 16


@dataclass(frozen=True)
class RigidSettings:
    max_shift: float = 0.1
    sigma: float = 1.15
    spatial_taper: float = 3.45
    norm_frames: bool = True


def taper(sigma: float, height: int, width: int) -> np.ndarray:
    """Product of two sigmoids that fall to zero at the edges."""

    def axis(n: int) -> np.ndarray:
        d = np.abs(np.arange(n) - (n - 1) / 2)
        return 1 / (1 + np.exp((d - ((n - 1) / 2 - 2 * sigma)) / sigma))

    return axis(height)[:, None] * axis(width)[None, :]


def gaussian_spectrum(sigma: float, height: int, width: int) -> np.ndarray:
    """Half-plane spectrum of a unit-sum Gaussian centred at the origin."""

    def axis(n: int) -> np.ndarray:
        return np.exp(-0.5 * ((np.arange(n) - (n - 1) / 2) / sigma) ** 2)

    g = axis(height)[:, None] * axis(width)[None, :]
    # a Gaussian between two pixels of an even axis keeps its real part only, as on the full plane
    return np.real(np.fft.fft2(np.fft.ifftshift(g / g.sum())))[:, : width // 2 + 1]


def whitened(x: np.ndarray) -> np.ndarray:
    """x over its modulus, in place."""
    x /= np.abs(x) + np.asarray(EPSILON, x.real.dtype)
    return x


def reference_spectrum(reference: np.ndarray, sigma: float | None) -> np.ndarray:
    """Whitened conjugate half-plane spectrum of a reference, smoothed unless sigma is None."""
    out = whitened(np.conj(np.fft.rfft2(reference)))
    return out if sigma is None else out * gaussian_spectrum(sigma, *reference.shape[-2:])


def correlation(frames: np.ndarray, spectrum: np.ndarray) -> np.ndarray:
    """Phase correlation maps of a stack of frames; real input needs half of the plane only."""
    x = whitened(np.fft.rfft2(frames))
    x *= spectrum
    return np.fft.irfft2(x, s=frames.shape[-2:])


def centred_window(maps: np.ndarray, half: int) -> np.ndarray:
    """The lags -half .. half of both axes, in order."""
    lags = np.arange(-half, half + 1)
    return maps[..., lags[:, None], lags[None, :]]


def search_half(max_shift: float, height: int, width: int) -> int:
    return int(min(round(max_shift * min(height, width)), min(height, width) // 2))


def clip_bounds(reference: np.ndarray) -> tuple[float, float]:
    """First and 99th percentile, truncated."""
    return float(np.trunc(np.percentile(reference, 1))), float(np.trunc(np.percentile(reference, 99)))


class Rigid:
    """Finds the shift of frames against one reference."""

    def __init__(self, reference: np.ndarray, settings: RigidSettings = RigidSettings(), smooth: bool = True, masked: bool = True):
        self.shape = reference.shape
        self.bounds = clip_bounds(reference) if settings.norm_frames else None
        ref = np.clip(reference, *self.bounds) if self.bounds else reference
        self.mask = taper(settings.spatial_taper, *ref.shape) if masked else np.ones(ref.shape)
        self.offset = ref.mean() * (1 - self.mask)
        self.spectrum = reference_spectrum(ref, settings.sigma if smooth else None)
        self.half = search_half(settings.max_shift, *ref.shape)
        self.single = [a.astype(t) for a, t in ((self.mask, np.float32), (self.offset, np.float32), (self.spectrum, np.complex64))]

    def shifts(self, frames: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(yoff, xoff, correlation); the first maximum in row order counts."""
        x = np.clip(frames, *self.bounds) if self.bounds else frames
        mask, offset, spectrum = self.single if x.dtype == np.float32 else (self.mask, self.offset, self.spectrum)
        window = centred_window(correlation(x * mask + offset, spectrum), self.half)
        flat = window.reshape(len(window), -1)
        best = flat.argmax(1)
        side = 2 * self.half + 1
        return best // side - self.half, best % side - self.half, flat[np.arange(len(flat)), best]


def rolled(frames: np.ndarray, yoff: np.ndarray, xoff: np.ndarray) -> np.ndarray:
    out = np.empty_like(frames)
    for f, o, a, b in zip(frames, out, yoff, xoff):
        h, w = f.shape
        a, b = int(a) % h, int(b) % w
        o[: h - a, : w - b], o[h - a :, : w - b], o[: h - a, w - b :], o[h - a :, w - b :] = f[a:, b:], f[:a, b:], f[a:, :b], f[:a, :b]
    return out


# ---- reference image


def seed_reference(frames: np.ndarray, top: int = 20) -> tuple[int, np.ndarray]:
    """(index, image): the frame best correlated with its next 19, and the mean of its top frames (demeaned, truncated)."""
    flat = frames.reshape(len(frames), -1).astype(float)
    flat = flat - flat.mean(1, keepdims=True)
    norm = np.sqrt((flat * flat).sum(1))
    cc = flat @ flat.T / np.outer(norm, norm)
    ordered = -np.sort(-cc, axis=1)
    seed = int(ordered[:, 1:top].mean(1).argmax())
    nearest = np.argsort(-cc[seed], kind="stable")[:top]
    return seed, np.trunc(flat[nearest].mean(0)).reshape(frames.shape[1:])


def refine_reference(frames: np.ndarray, reference: np.ndarray, settings: RigidSettings = RigidSettings(), rounds: int = 8, last_batch: int | None = None) -> np.ndarray:
    """Align the sample, average a growing share of its best frames, recentre; repeated.

    All frames are ranked by their correlation. With ``last_batch`` only the frames of
    the last batch of that size are, as older pipelines did.
    """
    work = frames.astype(float)
    for i in range(rounds):
        yoff, xoff, cmax = Rigid(reference, settings).shifts(work)
        work = rolled(work, yoff, xoff)
        pool = np.arange(len(work))
        if last_batch:
            pool = pool[(len(work) - 1) // last_batch * last_batch :]
        count = max(2, int(len(work) * (1.0 + i) / (2 * rounds)))
        best = pool[np.argsort(-cmax[pool], kind="stable")[:count]]
        reference = work[best].mean(0)
        back = round(float(yoff[best].mean())), round(float(xoff[best].mean()))
        reference = np.trunc(np.roll(reference, back, (0, 1)))
    return reference


def sample_frames(frames: DataFrame, n: int) -> DataFrame:
    """At most n equally spaced frames of every plane: the indices of linspace. Only plane and frame are ordered; pixels stay where they are."""
    x = frames.select("plane", "frame").withColumn("t", F.row_number().over(Window.partitionBy("plane").orderBy("frame")) - 1)
    total = x.groupBy("plane").agg(F.count(F.lit(1)).alias("total"))
    count = F.least(F.col("total"), F.lit(n))
    step = F.when(count > 1, (F.col("total") - 1) / (count - 1)).otherwise(F.lit(0.0))
    wanted = total.select("plane", "total", count.alias("count"), F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("k"), step.alias("step"))
    at = F.when((F.col("count") > 1) & (F.col("k") == F.col("count") - 1), F.col("total") - 1).otherwise(F.floor(F.col("k") * F.col("step")))
    wanted = wanted.select("plane", at.cast("int").alias("t")).distinct()
    chosen = x.join(wanted, ["plane", "t"], "left_semi").select("plane", "frame")
    return frames.join(F.broadcast(chosen), ["plane", "frame"], "left_semi")  # at most n rows a plane


def reference_images(frames: DataFrame, height: int, width: int, n: int = 400, settings: RigidSettings = RigidSettings(), refine: bool = True) -> DataFrame:
    """plane, arr: the reference of every plane from at most n sampled frames, a group a plane."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        x = np.stack(pdf["arr"].to_numpy()).reshape(-1, height, width)
        _, image = seed_reference(x)
        if refine:
            image = refine_reference(x, image, settings)
        return pd.DataFrame({"plane": [pdf["plane"].iloc[0]], "arr": [image.ravel()]})

    return sample_frames(frames.select("plane", "frame", "arr"), n).groupBy("plane").applyInPandas(run, f"plane {dict(frames.dtypes)['plane']}, arr array<double>")


#: Frames of a block of the matrix of correlations that seeds are found in.
SEED_BLOCK = 4096


def seed_frames(frames: DataFrame, height: int, width: int, n: int | None = None, top: int = 20) -> DataFrame:
    """plane, frame: the seed of every plane's reference, of all its frames, or of n sampled ones.

    A task holds a block of a plane's frames and reads the plane past it, keeping the best
    ``top`` correlations of each; the matrix of frames by frames is never whole anywhere.
    """
    x = frames.select("plane", "frame", "arr") if n is None else sample_frames(frames.select("plane", "frame", "arr"), n)
    most = x.groupBy("plane").count().agg(F.max("count")).first()[0] or 0
    blocks = max(1, -(-most // SEED_BLOCK))
    own = F.pmod(F.xxhash64("frame"), F.lit(blocks)).cast("int")
    dealt = x.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("passes", F.lit(1))
    dealt = dealt.unionByName(x.withColumns({"block": own, "passes": F.lit(0)})).repartition("plane", "block").sortWithinPartitions("plane", "block", "passes", "frame")
    kinds = dict(frames.dtypes)

    def unit(pdf: pd.DataFrame) -> np.ndarray:
        flat = np.stack(pdf["arr"].to_numpy()).astype(float)
        flat -= flat.mean(1, keepdims=True)
        return flat / np.sqrt((flat * flat).sum(1, keepdims=True))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held, best = None, [], None

        def scores() -> pd.DataFrame:
            mean = -np.sort(-best, axis=1)[:, 1:].mean(1) if best.shape[1] > 1 else np.zeros(len(best))
            return pd.DataFrame({"plane": key[0], "frame": np.concatenate([f for f, _ in held]), "score": mean})

        for pdf in it:
            for (plane, block, passes), part in pdf.groupby(["plane", "block", "passes"], sort=True):
                if key != (plane, block):
                    if best is not None:
                        yield scores()
                    key, held, best = (plane, block), [], None
                if not passes:
                    held.append((part["frame"].to_numpy(), unit(part)))
                    continue
                if not held:
                    continue
                left = np.concatenate([u for _, u in held])
                for at in range(0, len(part), SEED_BLOCK // 4):
                    r = left @ unit(part.iloc[at : at + SEED_BLOCK // 4]).T
                    best = r if best is None else np.concatenate([best, r], axis=1)
                    if best.shape[1] > top:
                        best = -np.partition(-best, top - 1, axis=1)[:, :top]
        if best is not None:
            yield scores()

    found = dealt.mapInPandas(run, f"plane {kinds['plane']}, frame {kinds['frame']}, score double")
    return found.groupBy("plane").agg(F.max_by("frame", F.struct("score", -F.col("frame"))).alias("frame"))


# ---- rigid registration of a table of frames


def stacked(batch: pa.RecordBatch, height: int, width: int) -> np.ndarray:
    """The frames of a batch: doubles from ``arr``, single precision from int16 blobs in ``pix``."""
    if "pix" in batch.schema.names:
        blobs = batch.column(batch.schema.names.index("pix"))
        return np.frombuffer(b"".join(blobs.to_pylist()), "<i2").reshape(-1, height, width).astype(np.float32)
    return batch.column(batch.schema.names.index("arr")).flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(-1, height, width)


def _lists(x: np.ndarray) -> pa.Array:
    """Rows of a matrix as lists, without a Python object a value."""
    x = np.ascontiguousarray(x.reshape(len(x), -1), np.float64)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * (x.shape[1] if len(x) else 0)), pa.array(x.ravel()))


def _pixels(x: np.ndarray, as_blobs: bool) -> pa.Array:
    return pa.array([f.astype("<i2").tobytes() for f in x], pa.binary()) if as_blobs else _lists(x)


def _representation(frames: DataFrame) -> str:
    """The column that holds the pixels: blobs if there are any."""
    return "pix" if "pix" in frames.columns else "arr"


def _by_plane(frames: DataFrame, references: DataFrame, make: Callable, run: Callable, schema: str) -> DataFrame:
    """Apply run(kernel of the plane, rows of the plane) to Arrow batches; one kernel a plane is made in every worker."""
    images = {r["plane"]: np.array(r["arr"], float) for r in references.select("plane", "arr").collect()}  # an image a plane

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernels: dict = {}
        for batch in it:
            planes = batch.column(0).to_numpy(zero_copy_only=False)
            for plane in np.unique(planes):
                part = batch.filter(pa.array(planes == plane))
                if plane not in kernels:
                    kernels[plane] = make(images[plane])
                for at in range(0, part.num_rows, FRAMES_AT_A_TIME):
                    yield run(kernels[plane], part.slice(at, FRAMES_AT_A_TIME))

    return frames.mapInArrow(batches, schema)


def rigid_offsets(frames: DataFrame, references: DataFrame, height: int, width: int, settings: RigidSettings = RigidSettings(), smooth: bool = True, masked: bool = True) -> DataFrame:
    """plane, frame, yoff, xoff, corr of every frame against its plane's reference."""

    def run(kernel: Rigid, batch: pa.RecordBatch) -> pa.RecordBatch:
        y, x, c = kernel.shifts(stacked(batch, height, width))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(y.astype(np.int32)), pa.array(x.astype(np.int32)), pa.array(c.astype(float))], ["plane", "frame", "yoff", "xoff", "corr"])

    kinds = dict(frames.dtypes)
    make = lambda image: Rigid(image.reshape(height, width), settings, smooth, masked)
    return _by_plane(frames.select("plane", "frame", _representation(frames)), references, make, run, f"plane {kinds['plane']}, frame {kinds['frame']}, yoff int, xoff int, corr double")


def with_offsets(frames: DataFrame, offsets: DataFrame, names: list[str]) -> DataFrame:
    """frames joined with the columns ``names`` of their offsets; a frame that has none fails the query, so that no frame vanishes."""
    kinds = dict(offsets.dtypes)
    x = frames.join(offsets.select("plane", "frame", *names), ["plane", "frame"], "left")
    missing = F.raise_error(F.concat(F.lit("no offset for frame "), F.col("frame").cast("string"), F.lit(" of plane "), F.col("plane").cast("string")))
    return x.withColumn(names[0], F.coalesce(names[0], missing.cast(kinds[names[0]])))


def check_offsets(frames: DataFrame, offsets: DataFrame) -> None:
    """Raises unless every frame has one offset with a value and every offset a frame. Only keys are read."""
    key = ["plane", "frame"]
    mine = offsets.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("yoff").isNotNull() & F.col("xoff").isNotNull(), 1)).alias("known"))
    both = frames.select(*key).distinct().withColumn("here", F.lit(True)).join(mine, key, "full_outer")
    wrong = both.where(F.col("here").isNull() | F.col("n").isNull() | (F.col("n") != 1) | (F.col("known") != 1)).groupBy("plane").agg(F.count(F.lit(1)).alias("count"), F.min("frame").alias("first")).orderBy("plane").collect()
    if wrong:
        raise ValueError("frames and offsets differ: " + "; ".join(f"plane {r['plane']}: {r['count']} frames, first {r['first']}" for r in wrong))


def shifted(frames: DataFrame, offsets: DataFrame, height: int, width: int) -> DataFrame:
    """plane, frame, arr rolled by stored offsets (of any channel): an equality join, then array slices in the engine."""
    x = with_offsets(frames, offsets, ["yoff", "xoff"])
    y = F.transform(F.sequence(F.lit(0), F.lit(height - 1)), lambda i: F.pmod(i + F.col("yoff"), F.lit(height)))

    def line(i):
        row = F.slice("arr", i * width + 1, width)
        cut = F.pmod(F.col("xoff"), F.lit(width))
        return F.concat(F.slice(row, cut + 1, width), F.slice(row, F.lit(1), cut))

    return x.withColumn("arr", F.flatten(F.transform(y, line))).select("plane", "frame", "arr")


def bidiphase(frames: DataFrame, height: int, width: int, reach: int = 10) -> DataFrame:
    """plane, phase: the offset between odd and even lines. Workers hand back sums of correlation maps only."""
    half = min(reach, width // 2)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for plane, part in pdf.groupby("plane", sort=False):
                x = np.stack(part["arr"].to_numpy()).reshape(-1, height, width)
                odd, even = np.fft.fft(x[:, 1::2], axis=2), np.conj(np.fft.fft(x[:, ::2], axis=2))
                cc = np.real(np.fft.ifft(odd / (np.abs(odd) + EPSILON) * (even / (np.abs(even) + EPSILON))[:, : odd.shape[1]], axis=2)).mean(1).sum(0)
                lags = np.arange(-half, min(half, (width - 1) // 2) + 1)
                yield pd.DataFrame({"plane": plane, "lag": lags.astype("int32"), "cc": cc[lags]})

    sums = frames.select("plane", "arr").mapInPandas(run, f"plane {dict(frames.dtypes)['plane']}, lag int, cc double").groupBy("plane", "lag").agg(F.sum("cc").alias("cc"))
    return sums.groupBy("plane").agg((-F.max_by("lag", F.struct("cc", -F.col("lag")))).alias("phase"))


def lines_shifted(frames: DataFrame, phases: DataFrame, height: int, width: int) -> DataFrame:
    """plane, frame, arr with odd lines moved by their plane's phase (plane, phase); pixels that nothing moves to keep their values."""
    k = F.col("phase")
    right = lambda row: F.concat(F.slice(row, F.lit(1), k), F.slice(row, F.lit(1), F.lit(width) - k))
    left = lambda row: F.concat(F.slice(row, F.lit(1) - k, F.lit(width) + k), F.slice(row, F.lit(width + 1) + k, -k))

    def line(y):
        row = F.slice("arr", y * width + 1, width)
        return F.when((y % 2 == 0) | (k == 0), row).when(k > 0, right(row)).otherwise(left(row))

    x = frames.select("plane", "frame", "arr").join(F.broadcast(phases.select("plane", "phase")), "plane")
    return x.withColumn("arr", F.flatten(F.transform(F.sequence(F.lit(0), F.lit(height - 1)), line))).select("plane", "frame", "arr")


# ---- block-wise registration


def block_count(length: int, block: int) -> tuple[int, int]:
    """(block size, number of blocks)."""
    return (length, 1) if block >= length else (block, math.ceil(1.5 * length / block))


def block_grid(height: int, width: int, block: tuple[int, int]) -> tuple[list[tuple[int, int, int, int]], tuple[int, int], tuple[int, int]]:
    """Blocks (y0, y1, x0, x1) row by row, their counts, their size."""
    (by, ny), (bx, nx) = block_count(height, block[0]), block_count(width, block[1])
    ys, xs = np.linspace(0, height - by, ny).astype(int), np.linspace(0, width - bx, nx).astype(int)
    return [(int(y), int(y) + by, int(x), int(x) + bx) for y in ys for x in xs], (ny, nx), (by, bx)


def grid_table(spark: SparkSession, height: int, width: int, block: tuple[int, int]) -> DataFrame:
    blocks, (_, nx), _ = block_grid(height, width, block)
    return spark.createDataFrame([(n, n // nx, n % nx, *b) for n, b in enumerate(blocks)], "b int, iy int, ix int, y0 int, y1 int, x0 int, x1 int")


def block_smoother(ny: int, nx: int) -> np.ndarray:
    """Row-normalised exp(-distance squared) between blocks of the grid."""
    y, x = np.divmod(np.arange(ny * nx), nx)
    k = np.exp(-((y[:, None] - y) ** 2 + (x[:, None] - x) ** 2).astype(float))
    return k / k.sum(1, keepdims=True)


def upsampler(pad: int, subpixel: int, sigma: float = 0.85) -> tuple[np.ndarray, int]:
    """(matrix, side): kriging from a (2 pad + 1) square patch to steps of 1 / subpixel."""

    def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        ya, xa = [g.ravel() for g in np.meshgrid(a, a, indexing="ij")]
        yb, xb = [g.ravel() for g in np.meshgrid(b, b, indexing="ij")]
        return np.exp(-((ya[:, None] - yb) ** 2 + (xa[:, None] - xb) ** 2) / (2 * sigma**2))

    coarse = np.arange(-pad, pad + 1).astype(float)
    fine = np.linspace(-pad, pad, 2 * pad * subpixel + 1)
    return np.linalg.solve(kernel(coarse, coarse), kernel(coarse, fine)), len(fine)


@dataclass(frozen=True)
class BlockSettings:
    block: tuple[int, int] = (128, 128)
    max_shift: int = 5
    snr: float = 1.2
    pad: int = 3
    subpixel: int = 10
    sigma: float = 1.15
    spatial_taper: float = 3.45
    norm_frames: bool = True


class Blocks:
    """Finds sub-pixel shifts of the blocks of frames."""

    def __init__(self, reference: np.ndarray, settings: BlockSettings = BlockSettings()):
        self.set = settings
        self.bounds = clip_bounds(reference) if settings.norm_frames else None
        ref = np.clip(reference, *self.bounds) if self.bounds else reference
        self.blocks, self.counts, self.size = block_grid(*ref.shape, settings.block)
        cut = np.stack([ref[y0:y1, x0:x1] for y0, y1, x0, x1 in self.blocks])
        self.mask = np.stack([taper(settings.spatial_taper, *self.size)] * len(cut))
        whole = taper(settings.spatial_taper, *ref.shape)
        self.mask = self.mask * np.stack([whole[y0:y1, x0:x1] for y0, y1, x0, x1 in self.blocks])
        self.offset = cut.mean((1, 2))[:, None, None] * (1 - self.mask)
        self.spectrum = np.stack([reference_spectrum(c, settings.sigma) for c in cut])
        self.half = int(min(round(settings.max_shift), min(self.size) // 2 - settings.pad))
        self.single = [a.astype(t) for a, t in ((self.mask, np.float32), (self.offset, np.float32), (self.spectrum, np.complex64))]
        self.smoother = block_smoother(*self.counts)
        self.kriging, self.side = upsampler(settings.pad, settings.subpixel)

    def _snr(self, maps: np.ndarray) -> np.ndarray:
        """Peak over the highest value outside its neighbourhood."""
        p, side = self.set.pad, 2 * self.half + 1
        inner = maps[:, p:-p, p:-p].reshape(len(maps), -1)
        y, x = np.divmod(inner.argmax(1), side)
        k = np.arange(maps.shape[-1])
        near_y, near_x = (k >= y[:, None]) & (k < y[:, None] + 2 * p), (k >= x[:, None]) & (k < x[:, None] + 2 * p)
        rest = np.where(near_y[:, :, None] & near_x[:, None, :], 0, maps)
        return inner.max(1) / np.maximum(1e-10, rest.max((1, 2)))

    def shifts(self, frames: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(yoff, xoff, correlation) by frame and block."""
        x = np.clip(frames, *self.bounds) if self.bounds else frames
        cut = np.stack([x[:, y0:y1, x0:x1] for y0, y1, x0, x1 in self.blocks], 1)
        p, half = self.set.pad, self.half
        mask, offset, spectrum = self.single if cut.dtype == np.float32 else (self.mask, self.offset, self.spectrum)
        maps = centred_window(correlation(cut * mask + offset, spectrum), half + p)
        chosen, done = maps.copy(), np.zeros(maps.shape[:2], bool)
        for power in range(3):
            if power:
                maps = np.einsum("ab,tbyx->tayx", self.smoother, maps)
                chosen[~done] = maps[~done]
            if done.all():
                break
            left = ~done
            done[left] = self._snr(maps[left]) >= self.set.snr
        flat, side = chosen[..., p:-p, p:-p].reshape(*chosen.shape[:2], -1), 2 * half + 1
        ym, xm = np.divmod(flat.argmax(-1), side)
        t, b = np.indices(ym.shape)
        steps = np.arange(2 * p + 1)
        patch = chosen[t[..., None, None], b[..., None, None], ym[..., None, None] + steps[:, None], xm[..., None, None] + steps]
        fine = patch.reshape(*ym.shape, -1) @ self.kriging
        yf, xf = np.divmod(fine.argmax(-1), self.side)
        middle = self.side // 2
        return (yf - middle) / self.set.subpixel + ym - half, (xf - middle) / self.set.subpixel + xm - half, fine.max(-1)


def interpolate_grid(values: np.ndarray, height: int, width: int, blocks: list, counts: tuple[int, int]) -> np.ndarray:
    """Block values (frames, blocks) to pixels: bilinear between block centres, edges replicated."""
    ny, nx = counts
    yc = np.array([int((blocks[i * nx][0] + blocks[i * nx][1]) / 2) for i in range(ny)])
    xc = np.array([int((blocks[i][2] + blocks[i][3]) / 2) for i in range(nx)])

    def positions(centres: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        span = centres[-1] - centres[0]
        at = np.clip(np.arange(n) - centres[0], 0, max(span - 1, 0)) * ((len(centres) - 1) / max(span - 1, 1))
        low = np.minimum(at.astype(int), max(len(centres) - 2, 0))
        return low, (at - low).astype(values.dtype)

    (yl, yf), (xl, xf) = positions(yc, height), positions(xc, width)
    v = values.reshape(-1, ny, nx)
    yh, xh = np.minimum(yl + 1, ny - 1), np.minimum(xl + 1, nx - 1)
    top = v[:, yl][:, :, xl] * (1 - xf) + v[:, yl][:, :, xh] * xf
    low = v[:, yh][:, :, xl] * (1 - xf) + v[:, yh][:, :, xh] * xf
    return top * (1 - yf[:, None]) + low * yf[:, None]


def warp(frames: np.ndarray, yoff: np.ndarray, xoff: np.ndarray) -> np.ndarray:
    """Frames read at (y + yoff, x + xoff) by bilinear interpolation, borders replicated, truncated to whole numbers."""
    t, height, width = frames.shape
    kind = frames.dtype if frames.dtype.kind == "f" else np.dtype(float)
    out = np.empty(frames.shape, kind)
    rows, columns = np.arange(height, dtype=kind)[:, None], np.arange(width, dtype=kind)
    for k in range(t):  # a frame at a time stays in cache
        y, x = np.clip(rows + yoff[k], 0, height - 1), np.clip(columns + xoff[k], 0, width - 1)
        yl, xl = np.minimum(y.astype(np.int32), max(height - 2, 0)), np.minimum(x.astype(np.int32), max(width - 2, 0))
        yf, xf = (y - yl).astype(kind), (x - xl).astype(kind)
        flat, at = frames[k].ravel(), yl * width + xl
        down, right = (width if height > 1 else 0), (1 if width > 1 else 0)
        top = flat[at] * (1 - xf) + flat[at + right] * xf
        low = flat[at + down] * (1 - xf) + flat[at + down + right] * xf
        np.trunc(top * (1 - yf) + low * yf, out=out[k])
    return out


def register(frames: DataFrame, references: DataFrame, height: int, width: int, rigid: RigidSettings = RigidSettings(), blocks: BlockSettings | None = BlockSettings()) -> DataFrame:
    """plane, frame, arr or pix (registered), yoff, xoff, corr, yoff1, xoff1, corr1 of every frame; one narrow stage."""

    def make(image: np.ndarray):
        ref = image.reshape(height, width)
        return Rigid(ref, rigid), Blocks(ref, blocks) if blocks else None

    held = _representation(frames)

    def run(kernels, batch: pa.RecordBatch) -> pa.RecordBatch:
        whole, local = kernels
        x = stacked(batch, height, width)
        yoff, xoff, corr = whole.shifts(x)
        x = rolled(x, yoff, xoff)
        by_block = [pa.nulls(len(x), pa.list_(pa.float64()))] * 3
        if local:
            y1, x1, c1 = local.shifts(x)
            x = warp(x, *(interpolate_grid(v.astype(x.dtype), height, width, local.blocks, local.counts) for v in (y1, x1)))
            by_block = [_lists(v) for v in (y1, x1, c1)]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), _pixels(x, held == "pix"), pa.array(yoff.astype(np.int32)), pa.array(xoff.astype(np.int32)), pa.array(corr.astype(float)), *by_block],
            ["plane", "frame", held, "yoff", "xoff", "corr", "yoff1", "xoff1", "corr1"],
        )

    kinds = dict(frames.dtypes)
    pixels = "pix binary" if held == "pix" else "arr array<double>"
    schema = f"plane {kinds['plane']}, frame {kinds['frame']}, {pixels}, yoff int, xoff int, corr double, yoff1 array<double>, xoff1 array<double>, corr1 array<double>"
    return _by_plane(frames.select("plane", "frame", held), references, make, run, schema)


def apply_offsets(frames: DataFrame, registered: DataFrame, height: int, width: int, blocks: BlockSettings | None = BlockSettings()) -> DataFrame:
    """plane, frame, arr of another channel, moved by the shifts that ``register`` found (yoff, xoff, yoff1, xoff1)."""
    grid, counts, _ = block_grid(height, width, blocks.block) if blocks else ([], (1, 1), None)
    held = _representation(frames)
    x = with_offsets(frames.select("plane", "frame", held), registered, ["yoff", "xoff", "yoff1", "xoff1"]).select("plane", "frame", held, "yoff", "xoff", "yoff1", "xoff1")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for at in range(0, whole.num_rows, FRAMES_AT_A_TIME):
                batch = whole.slice(at, FRAMES_AT_A_TIME)
                moved = rolled(stacked(batch, height, width), batch.column(3).to_numpy(), batch.column(4).to_numpy())
                if blocks and batch.column(5).null_count == 0:
                    fields = (np.array(batch.column(k).to_pylist(), moved.dtype) for k in (5, 6))
                    moved = warp(moved, *(interpolate_grid(v, height, width, grid, counts) for v in fields))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _pixels(moved, held == "pix")], ["plane", "frame", held])

    kinds = dict(frames.dtypes)
    return x.mapInArrow(run, f"plane {kinds['plane']}, frame {kinds['frame']}, {'pix binary' if held == 'pix' else 'arr array<double>'}")


def rigid_offsets_smoothed(frames: DataFrame, references: DataFrame, height: int, width: int, sigma: float, batch: int = 100, settings: RigidSettings = RigidSettings()) -> DataFrame:
    """rigid_offsets with correlation maps smoothed over the frames of a batch (reflected ends); batches are of consecutive frames."""
    from calspark.functions.columns import gaussian_taps

    images = {r["plane"]: np.array(r["arr"], float).reshape(height, width) for r in references.select("plane", "arr").collect()}  # an image a plane
    taps = gaussian_taps(sigma, int(4 * sigma + 0.5))
    numbers = frames.select("plane", "frame").withColumn("_batch", F.expr(f"(row_number() over (partition by plane order by frame) - 1) div {batch}"))
    ordered = frames.select("plane", "frame", "arr").join(numbers, ["plane", "frame"])  # frames are not sorted, their numbers are

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        kernel = Rigid(images[pdf["plane"].iloc[0]], settings)
        x = np.stack(pdf["arr"].to_numpy()).reshape(-1, height, width)
        x = np.clip(x, *kernel.bounds) if kernel.bounds else x
        maps = centred_window(correlation(x * kernel.mask + kernel.offset, kernel.spectrum), kernel.half)
        n = len(maps)
        smooth = np.zeros_like(maps)
        for k, w in taps:
            j = (np.arange(n) + k) % (2 * n)
            smooth += w * maps[np.where(j >= n, 2 * n - 1 - j, j)]
        flat, side = smooth.reshape(n, -1), 2 * kernel.half + 1
        best = flat.argmax(1)
        return pd.DataFrame({"plane": pdf["plane"].to_numpy(), "frame": pdf["frame"].to_numpy(), "yoff": (best // side - kernel.half).astype("int32"), "xoff": (best % side - kernel.half).astype("int32"), "corr": flat[np.arange(n), best]})

    kinds = dict(frames.dtypes)
    return ordered.select("plane", "frame", "arr", "_batch").groupBy("plane", "_batch").applyInPandas(run, f"plane {kinds['plane']}, frame {kinds['frame']}, yoff int, xoff int, corr double")


def upsampled_mean(frames: DataFrame, registered: DataFrame, height: int, width: int, factor: int, blocks: BlockSettings = BlockSettings()) -> DataFrame:
    """plane, y, x, v, n: pixels of rolled frames added up on a grid ``factor`` times finer, at their sub-pixel places.

    Workers hand back sums over their frames; the sums meet in one aggregation.
    """
    grid, counts, _ = block_grid(height, width, blocks.block)
    x = with_offsets(frames.select("plane", "frame", "arr"), registered, ["yoff", "xoff", "yoff1", "xoff1"])

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict = {}
        for pdf in it:
            for r in pdf.itertuples():
                image = rolled(np.asarray(r.arr).reshape(1, height, width), [r.yoff], [r.xoff])[0]
                fields = [interpolate_grid(np.asarray(v, float)[None], height, width, grid, counts)[0] for v in (r.yoff1, r.xoff1)]
                y = np.clip(np.floor(0.5 + (np.arange(height)[:, None] - fields[0]) * factor), 0, height * factor - 1).astype(int)
                z = np.clip(np.floor(0.5 + (np.arange(width) - fields[1]) * factor), 0, width * factor - 1).astype(int)
                at = (y * width * factor + z).ravel()
                s, n = totals.setdefault(r.plane, (np.zeros(height * width * factor * factor), np.zeros(height * width * factor * factor)))
                s += np.bincount(at, image.ravel(), len(s))
                n += np.bincount(at, minlength=len(n))
        for plane, (s, n) in totals.items():
            at = np.nonzero(n)[0]
            yield pd.DataFrame({"plane": plane, "y": (at // (width * factor)).astype("int32"), "x": (at % (width * factor)).astype("int32"), "s": s[at], "n": n[at].astype("int64")})

    sums = x.mapInPandas(run, f"plane {dict(frames.dtypes)['plane']}, y int, x int, s double, n long")
    return sums.groupBy("plane", "y", "x").agg((F.sum("s") / F.sum("n")).alias("v"), F.sum("n").alias("n"))


# ---- crop, z alignment, metrics


def bad_frames(offsets: DataFrame, height: int, width: int, threshold: float, max_shift: float, window: int = 101) -> DataFrame:
    """offsets with bad: shifts that jump against their median, relative to their mean and to the correlation's own jump, or reach the limit.

    A recording's offsets are a few numbers a frame; the medians are windows by plane.
    """
    from calspark.operators.traces import median_filter

    x = offsets
    for c in ("yoff", "xoff", "corr"):
        x = median_filter(x, c, window, f"m_{c}")
    x = x.withColumn("d", F.sqrt(F.pow(F.col("yoff") - F.col("m_yoff"), 2) + F.pow(F.col("xoff") - F.col("m_xoff"), 2)))
    x = x.withColumn("r", F.try_divide(F.col("d"), F.avg("d").over(Window.partitionBy("plane")))).withColumn("c", F.greatest(F.lit(0.0), F.coalesce(F.try_divide(F.col("corr"), F.col("m_corr")), F.lit(0.0))))
    jump = F.when(F.col("c") > 0, F.col("r") / F.col("c") > 100 * threshold).otherwise(F.col("r") > 0)
    far = (F.abs("yoff") > 0.95 * max_shift * height) | (F.abs("xoff") > 0.95 * max_shift * width)
    return x.withColumn("bad", F.coalesce(jump, F.lit(False)) | far).select(*offsets.columns, "bad")


def crop_ranges(marked: DataFrame, height: int, width: int) -> DataFrame:
    """plane, y0, y1, x0, x1: what no good frame was shifted out of; all frames count if half of them or more are bad."""
    share = F.avg(F.col("bad").cast("double"))
    s = marked.groupBy("plane").agg(
        share.alias("share"), F.max(F.when(~F.col("bad"), F.abs("yoff"))).alias("gy"), F.max(F.when(~F.col("bad"), F.abs("xoff"))).alias("gx"), F.max(F.abs("yoff")).alias("ay"), F.max(F.abs("xoff")).alias("ax")
    )
    y = F.ceil(F.when(F.col("share") < 0.5, F.col("gy")).otherwise(F.col("ay"))).cast("int")
    x = F.ceil(F.when(F.col("share") < 0.5, F.col("gx")).otherwise(F.col("ax"))).cast("int")
    return s.select("plane", y.alias("y0"), (height - y).alias("y1"), x.alias("x0"), (width - x).alias("x1"))


def z_correlation(frames: DataFrame, stack: list[np.ndarray], settings: RigidSettings = RigidSettings(), smooth: bool = True, masked: bool = True) -> DataFrame:
    """plane, frame, z, corr: best correlation of every frame with every image of a stack; no frame is moved."""
    height, width = stack[0].shape

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kernels = [Rigid(z, settings, smooth, masked) for z in stack]
        for pdf in it:
            if len(pdf):
                x = np.stack(pdf["arr"].to_numpy()).reshape(-1, height, width)
                for z, kernel in enumerate(kernels):
                    yield pd.DataFrame({"plane": pdf["plane"], "frame": pdf["frame"], "z": np.int32(z), "corr": kernel.shifts(x)[2]})

    kinds = dict(frames.dtypes)
    return frames.select("plane", "frame", "arr").mapInPandas(run, f"plane {kinds['plane']}, frame {kinds['frame']}, z int, corr double")


def register_to_stack(frames: DataFrame, stack: list[np.ndarray], rigid: RigidSettings = RigidSettings(), blocks: BlockSettings | None = None) -> DataFrame:
    """plane, frame, z, yoff, xoff, corr, corrs, yoff1, xoff1, corr1: every frame's best image of a stack and its shifts against that one.

    The image is chosen by the rigid correlation (corrs has those with all images); block
    shifts, where ``blocks`` are given, are found against the chosen image. No frame is moved.
    """
    height, width = stack[0].shape

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = [Rigid(z, rigid) for z in stack]
        local = [Blocks(z, blocks) for z in stack] if blocks else None
        for pdf in it:
            if not len(pdf):
                continue
            x = np.stack(pdf["arr"].to_numpy()).reshape(-1, height, width).astype(float)
            y, z, c = (np.stack(v, 1) for v in zip(*(k.shifts(x) for k in whole)))
            best = c.argmax(1)
            rows = np.arange(len(x))
            out = pdf[["plane", "frame"]].assign(z=best.astype("int32"), yoff=y[rows, best].astype("int32"), xoff=z[rows, best].astype("int32"), corr=c[rows, best], corrs=list(c))
            fields: list[list] = [[None] * len(x) for _ in range(3)]
            for k in np.unique(best) if local else ():
                mine = np.flatnonzero(best == k)
                found = local[k].shifts(rolled(x[mine], y[mine, k], z[mine, k]))
                for field, values in zip(fields, found):
                    for n, v in zip(mine, values):
                        field[n] = v
            yield out.assign(yoff1=fields[0], xoff1=fields[1], corr1=fields[2])

    kinds = dict(frames.dtypes)
    many = "corrs array<double>, yoff1 array<double>, xoff1 array<double>, corr1 array<double>"
    return frames.select("plane", "frame", "arr").mapInPandas(run, f"plane {kinds['plane']}, frame {kinds['frame']}, z int, yoff int, xoff int, corr double, {many}")


def z_position(zcorr: DataFrame, sigma: float = 2.0) -> DataFrame:
    """plane, frame, z: the best plane after a Gaussian over z (reflected ends), the first on ties."""
    from calspark.functions.columns import gaussian_taps, reflect_index

    n = zcorr.agg((F.max("z") + 1).alias("n"))
    taps = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w).alias("w")) for k, w in gaussian_taps(sigma, int(4 * sigma + 0.5))])
    want = zcorr.select("plane", "frame", "z").join(F.broadcast(n)).select("plane", "frame", "z", F.explode(taps).alias("t"), "n")
    want = want.select("plane", "frame", "z", F.col("t.w").alias("w"), reflect_index(F.col("z") + F.col("t.k"), F.col("n")).cast("int").alias("i"))
    smooth = want.join(zcorr.select("plane", "frame", F.col("z").alias("i"), "corr"), ["plane", "frame", "i"]).groupBy("plane", "frame", "z").agg(F.round(F.sum(F.col("w") * F.col("corr")), 9).alias("corr"))
    return smooth.groupBy("plane", "frame").agg(F.max_by("z", F.struct("corr", -F.col("z"))).alias("z"))


def z_table(zcorr: DataFrame, depth: int) -> DataFrame:
    """A column a z: plane, frame, z0, z1, ..."""
    return zcorr.withColumn("z", F.concat(F.lit("z"), F.col("z"))).groupBy("plane", "frame").pivot("z", [f"z{k}" for k in range(depth)]).agg(F.first("corr"))


def component_shifts(low_high: DataFrame, height: int, width: int, rigid: RigidSettings = RigidSettings(max_shift=0.25, norm_frames=False), blocks: BlockSettings = BlockSettings(max_shift=15, snr=1.25, norm_frames=False)) -> DataFrame:
    """plane, pc, rigid, mean_block, max_block, mean_both: how far the high image of a component lies from its low one."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        image = {r.side: np.asarray(r.arr).reshape(height, width) for r in pdf.itertuples()}
        y, x, _ = Rigid(image["low"], rigid).shifts(image["high"][None])
        moved = rolled(image["high"][None], y, x)
        y1, x1, _ = Blocks(image["low"], blocks).shifts(moved)
        d, both = np.hypot(y1, x1), np.hypot(y1 + y[:, None], x1 + x[:, None])
        return pd.DataFrame({"plane": [pdf["plane"].iloc[0]], "pc": [pdf["pc"].iloc[0]], "rigid": [float(np.hypot(y, x)[0])], "mean_block": [d.mean()], "max_block": [d.max()], "mean_both": [both.mean()]})

    return low_high.groupBy("plane", "pc").applyInPandas(run, f"plane {dict(low_high.dtypes)['plane']}, pc int, rigid double, mean_block double, max_block double, mean_both double")
