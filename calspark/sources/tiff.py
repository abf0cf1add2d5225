"""TIFF stacks in plain Python: a reader for classic and big TIFF, and a writer.

A first pass walks the directories of every file and notes where pages lie; a second
reads pages by ranges of bytes, so that one large file is many tasks' work. Strips and
tiles may be plain, LZW, deflate or PackBits, with horizontal differencing. Unsigned
16-bit and 32-bit pages are halved to int16, others cast, as movies are stored. Other
schemes raise, naming the scheme.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calspark.sources import ranges

_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 8: 2, 9: 4, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
_CODE = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
#: Tags that a page is decoded by: size, depth, scheme, strips, samples, predictor, tiles, sample format.
NEEDED = (256, 257, 258, 259, 273, 277, 278, 279, 317, 322, 323, 324, 325, 339)
#: Bytes read at a time while directories are walked.
LOOK = 1 << 16


def reading(source) -> Callable[[int, int], bytes]:
    """(offset, count) -> bytes, of bytes or of an open file; small reads come from a window of the file."""
    if isinstance(source, (bytes, bytearray, memoryview)):
        return lambda at, n: bytes(source[at : at + n])
    held = [0, b""]

    def read(at: int, n: int) -> bytes:
        if not held[0] <= at or at + n > held[0] + len(held[1]):
            source.seek(at)
            held[:] = at, source.read(max(n, LOOK))
        return held[1][at - held[0] : at - held[0] + n]

    return read


def directories(source) -> Iterator[dict[int, tuple]]:
    """Tag -> values of every page of bytes or an open file; -1 holds the byte order."""
    read = reading(source)
    order = {b"II": "<", b"MM": ">"}.get(read(0, 2))
    if order is None:
        raise ValueError("not a TIFF file")
    get = lambda form, at: struct.unpack(order + form, read(at, struct.calcsize(order + form)))
    big = get("H", 2)[0] == 43
    at = get("Q" if big else "I", 8 if big else 4)[0]
    while at:
        count = get("Q" if big else "H", at)[0]
        at += 8 if big else 2
        tags: dict[int, tuple] = {}
        for _ in range(count):
            tag, kind, n = get("HHQ" if big else "HHI", at)
            value_at = at + (12 if big else 8)
            if kind in _CODE:
                if n * _SIZE[kind] > (8 if big else 4):
                    value_at = get("Q" if big else "I", value_at)[0]
                tags[tag] = get(f"{n}{_CODE[kind]}", value_at)
            at += 20 if big else 12
        yield tags | {-1: (order,)}
        at = get("Q" if big else "I", at)[0]


def unlzw(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, most significant bit first, one code wider a code early."""
    out, first = bytearray(), [bytes((k,)) for k in range(256)] + [b"", b""]
    table, width, buffer, held, before = list(first), 9, 0, 0, b""
    for byte in data:
        buffer, held = buffer << 8 | byte, held + 8
        if held < width:
            continue
        held -= width
        code, buffer = buffer >> held, buffer & ((1 << held) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, before = list(first), 9, b""
            continue
        entry = table[code] if code < len(table) else before + before[:1]
        if before:
            table.append(before + entry[:1])
            width = min(12, (len(table) + 1).bit_length())
        out += entry
        before = entry
    return bytes(out)


def unpackbits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            out += data[at + 1 : at + 2] * (257 - n) if n > 128 else b""
            at += 2 if n > 128 else 1
    return bytes(out)


SCHEMES: dict[int, Callable[[bytes], bytes]] = {1: bytes, 5: unlzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: unpackbits}


def page(source, tags: dict[int, tuple]) -> np.ndarray:
    """The pixels of a page."""
    read = reading(source) if not callable(source) else source
    scheme, samples = tags.get(259, (1,))[0], tags.get(277, (1,))[0]
    if scheme not in SCHEMES:
        raise ValueError(f"compressed TIFF (scheme {scheme}) is not supported")
    if samples != 1:
        raise ValueError(f"TIFF pages of {samples} samples a pixel are not supported")
    width, height, bits, kind = tags[256][0], tags[257][0], tags.get(258, (1,))[0], tags.get(339, (1,))[0]
    if bits not in (8, 16, 32, 64):
        raise ValueError(f"TIFF pages of {bits} bits a pixel are not supported")
    dtype = np.dtype(f"{tags[-1][0]}{'uif'[kind - 1]}{bits // 8}")

    def part(at: int, n: int, rows: int, columns: int) -> np.ndarray:
        x = np.frombuffer(SCHEMES[scheme](read(at, n)), dtype, rows * columns).reshape(rows, columns)
        return np.cumsum(x, axis=1, dtype=dtype.newbyteorder("=")) if tags.get(317, (1,))[0] == 2 else x

    if 322 in tags:
        h, w = tags[323][0], tags[322][0]
        across = -(-width // w)
        out = np.zeros((-(-height // h) * h, across * w), dtype.newbyteorder("="))
        for k, (at, n) in enumerate(zip(tags[324], tags[325])):
            out[k // across * h : k // across * h + h, k % across * w : k % across * w + w] = part(at, n, h, w)
        return out[:height, :width]
    rows = min(tags.get(278, (height,))[0], height)
    counts = tags.get(279) or [min(rows, height - k * rows) * width * dtype.itemsize for k in range(len(tags[273]))]
    return np.concatenate([part(at, n, min(rows, height - k * rows), width) for k, (at, n) in enumerate(zip(tags[273], counts))])


def narrow(x: np.ndarray) -> np.ndarray:
    if x.dtype.kind == "u" and x.dtype.itemsize == 2 or x.dtype.kind in "iu" and x.dtype.itemsize == 4:
        x = x // 2
    return x.astype("<i2")


def encode(stack: np.ndarray, compressed: bool = False) -> bytes:
    """A little-endian big TIFF of int16 pages, rounded down; deflated if ``compressed``."""
    pages = np.floor(stack).astype("<i2")
    out, entries = bytearray(struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16)), 10
    size = 8 + entries * 20 + 8
    for n, p in enumerate(pages):
        here, raw = len(out), zlib.compress(p.tobytes()) if compressed else p.tobytes()
        values = [(256, 4, p.shape[1]), (257, 4, p.shape[0]), (258, 3, 16), (259, 3, 8 if compressed else 1), (262, 3, 1), (273, 16, here + size), (277, 3, 1), (278, 4, p.shape[0]), (279, 16, len(raw)), (339, 3, 2)]
        out += struct.pack("<Q", entries)
        for tag, kind, value in values:
            out += struct.pack("<HHQQ", tag, kind, 1, value)
        out += struct.pack("<Q", here + size + len(raw) if n + 1 < len(pages) else 0) + raw
    return bytes(out)


PAGES = "file string, page long, Ly int, Lx int, arr array<smallint>"


def _whole(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in it:
        for r in pdf.itertuples():
            for n, tags in enumerate(directories(r.content)):
                image = page(r.content, tags)
                yield pd.DataFrame({"file": [r.path], "page": [n], "Ly": [image.shape[0]], "Lx": [image.shape[1]], "arr": [narrow(image).ravel()]})


def _index(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in it:
        for path in pdf["path"]:
            with ranges.open_at(path) as f:
                rows = []
                for n, tags in enumerate(directories(f)):
                    size = sum(tags.get(325) or tags.get(279) or [tags[256][0] * tags[257][0] * tags.get(258, (8,))[0] // 8])
                    rows.append((path, n, size, json.dumps({k: v for k, v in tags.items() if k in NEEDED or k == -1})))
            yield pd.DataFrame(rows, columns=["file", "page", "size", "tags"])


def _decode(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in it:
        for path, part in pdf.groupby("file", sort=False):
            with ranges.open_at(path) as f:
                read = reading(f)
                for r in part.itertuples():
                    image = page(read, {int(k): tuple(v) for k, v in json.loads(r.tags).items()})
                    yield pd.DataFrame({"file": [path], "page": [r.page], "Ly": [image.shape[0]], "Lx": [image.shape[1]], "arr": [narrow(image).ravel()]})


def read_pages(spark: SparkSession, path: str | list[str], pattern: str = "*.tif*") -> DataFrame:
    """file, page, Ly, Lx, arr of every page of every TIFF below a path, decoded on the executors, a range of pages a task."""
    from calspark.sources.raw import temporary_folder

    files = ranges.listing(spark, path, pattern)
    first = files.select("path").first()
    if first is None:
        raise FileNotFoundError(f"no TIFF files below {path}")
    if not ranges.reachable(first["path"]):
        whole = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
        return whole.select("path", "content").mapInPandas(_whole, PAGES)
    folder = temporary_folder(spark, "tiff-index")  # where the pages lie; a row a page
    files.select("path").repartition(max(1, min(files.count(), spark.sparkContext.defaultParallelism)), "path").mapInPandas(_index, "file string, page long, size long, tags string").write.parquet(folder)
    index = spark.read.parquet(folder)
    block = F.floor(F.col("page") * F.col("size") / ranges.RANGE_BYTES)
    tasks = index.select("file", block.alias("block")).distinct().count()
    return index.repartition(max(1, tasks), "file", block).mapInPandas(_decode, PAGES)


def write_tiff_files(frames: DataFrame, folder: str, height: int, width: int, block: int = 500, compressed: bool = False) -> int:
    """Blocks of frames as .tif files plane{p}_{first frame}.tif below a folder; returns how many. Tasks that run twice write the same file."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        path = f"{folder.rstrip('/')}/plane{pdf['plane'].iloc[0]}_{int(pdf['block'].iloc[0]) * block:010d}.tif"
        ranges.put(path, encode(np.stack([np.asarray(a) for a in pdf["arr"]]).reshape(-1, height, width), compressed))
        return pd.DataFrame({"path": [path], "frames": [len(pdf)]})

    keyed = frames.select("plane", "frame", "arr", F.expr(f"frame div {block}").alias("block"))
    return keyed.groupBy("plane", "block").applyInPandas(run, "path string, frames long").count()


def bruker_planes(files: DataFrame, n_planes: int, ping_pong: bool = False) -> DataFrame:
    """files (path, rank) with channel (1 for names with Ch1, else 2) and plane by cyclic or up-and-down order within a channel."""
    from pyspark.sql import Window

    x = files.withColumn("channel", F.when(F.instr("path", "Ch1") > 0, 1).otherwise(2))
    k = F.row_number().over(Window.partitionBy("channel").orderBy("rank")) - 1
    r = k % (2 * n_planes)
    plane = F.when(r < n_planes, r).otherwise(2 * n_planes - 1 - r) if ping_pong else k % n_planes
    return x.withColumn("plane", plane.cast("int"))


def write_tiff(frames: DataFrame, path: str, height: int, width: int, block: int = 500) -> None:
    """Blocks of frames as TIFF payloads, one row a file: plane, frames, content."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        return pd.DataFrame({"plane": [pdf["plane"].iloc[0]], "frames": [pdf["frame"].tolist()], "content": [encode(np.stack([np.asarray(a) for a in pdf["arr"]]).reshape(-1, height, width))]})

    keyed = frames.select("plane", "frame", "arr", F.expr(f"frame div {block}").alias("block"))
    keyed.groupBy("plane", "block").applyInPandas(run, f"plane {dict(frames.dtypes)['plane']}, frames array<long>, content binary").write.mode("overwrite").parquet(path)


def read_tiff(spark: SparkSession, path: str) -> DataFrame:
    """plane, frame, arr of what write_tiff wrote."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for r in pdf.itertuples():
                pages = [page(r.content, tags).astype("<i2").ravel() for tags in directories(r.content)]
                yield pd.DataFrame({"plane": r.plane, "frame": list(r.frames), "arr": pages})

    blobs = spark.read.parquet(path)
    return blobs.mapInPandas(run, f"plane {dict(blobs.dtypes)['plane']}, frame long, arr array<smallint>")
