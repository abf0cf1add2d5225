"""MATLAB files (version 5, uncompressed) in plain Python: numbers, text, structs and cells, out and in.

What is written is one recording's result, a few numbers a region and frame; a file is
made in the task of its plane.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calspark.sources import ranges

#: Fixed values of the format: array class and data type of a dtype.
CLASSES = {"f8": (6, 9), "f4": (7, 7), "i1": (8, 1), "u1": (9, 2), "i2": (10, 3), "u2": (11, 4), "i4": (12, 5), "u4": (13, 6), "i8": (14, 12), "u8": (15, 13)}
MATRIX, COMPRESSED, CELL, STRUCT, CHAR = 14, 15, 1, 2, 4


def _element(kind: int, data: bytes) -> bytes:
    return struct.pack("<II", kind, len(data)) + data + b"\0" * (-len(data) % 8)


def _matrix(name: str, value) -> bytes:
    if isinstance(value, dict):
        value = [value]
    if isinstance(value, str):
        head, flags, shape = _element(4, value.encode("utf-16-le")), CHAR, (1 if value else 0, len(value.encode("utf-16-le")) // 2)
    elif isinstance(value, list) and all(isinstance(v, dict) for v in value):  # a row of structs
        keys = list(value[0]) if value else []
        width = max([len(k) for k in keys], default=0) + 1
        if width > 64:
            raise ValueError("field names have at most 63 characters")
        head = _element(5, struct.pack("<i", width)) + _element(1, b"".join(k.encode().ljust(width, b"\0") for k in keys)) + b"".join(_matrix("", v[k]) for v in value for k in keys)
        flags, shape = STRUCT, (1 if value else 0, len(value))
    elif isinstance(value, (list, tuple)):
        head, flags, shape = b"".join(_matrix("", v) for v in value), CELL, (1 if value else 0, len(value))
    else:
        x = np.asarray([] if value is None else value)
        logical = x.dtype == bool
        x = x.astype("u1") if logical else x
        if x.dtype.str[1:] not in CLASSES:
            raise TypeError(f"{name}: {x.dtype} has no place in a MATLAB file")
        x = np.atleast_2d(x) if x.ndim else x.reshape(1, 1)
        flags, kind = CLASSES[x.dtype.str[1:]]
        head, shape = _element(kind, x.astype(x.dtype.newbyteorder("<")).tobytes("F")), x.shape
        flags |= 0x200 if logical else 0
    body = _element(6, struct.pack("<II", flags, 0)) + _element(5, struct.pack(f"<{len(shape)}i", *shape)) + _element(1, name.encode()) + head
    return _element(MATRIX, body)


def encode(values: dict) -> bytes:
    """The bytes of a file of named values: arrays, numbers, text, dicts, lists of dicts (struct arrays), other lists (cells)."""
    return b"MATLAB 5.0 MAT-file".ljust(116, b" ") + b"\0" * 8 + struct.pack("<H2s", 0x0100, b"IM") + b"".join(_matrix(k, v) for k, v in values.items())


def decode(data: bytes) -> dict:
    """The named values of a little-endian file; arrays keep two axes or more."""
    kinds = {kind: np.dtype("<" + name) for name, (_, kind) in CLASSES.items()}

    def element(at: int) -> tuple[int, bytes, int]:
        kind, n = struct.unpack_from("<II", data_of[0], at)
        if kind >> 16:  # small: the data are in the head
            return kind & 0xFFFF, data_of[0][at + 4 : at + 4 + (kind >> 16)], at + 8
        stop = at + 8 + n
        return kind, data_of[0][at + 8 : stop], stop + (-n % 8 if kind != COMPRESSED else 0)

    data_of = [data]

    def matrix(body: bytes) -> tuple[str, object]:
        outer, data_of[0], at, parts = data_of[0], body, 0, []
        while at < len(body):
            kind, raw, at = element(at)
            parts.append((kind, raw))
        data_of[0] = outer
        flags = struct.unpack_from("<I", parts[0][1])[0]
        shape = struct.unpack(f"<{len(parts[1][1]) // 4}i", parts[1][1])
        name, rest, cls = parts[2][1].decode(), parts[3:], flags & 0xFF
        if cls == CHAR:
            return name, rest[0][1].decode("utf-16-le" if rest[0][0] == 4 else "utf-8") if rest else ""
        if cls == CELL:
            return name, [matrix(raw)[1] for _, raw in rest]
        if cls == STRUCT:
            width = struct.unpack("<i", rest[0][1])[0]
            keys = [rest[1][1][k : k + width].split(b"\0")[0].decode() for k in range(0, len(rest[1][1]), width)]
            values = [matrix(raw)[1] for _, raw in rest[2:]]
            return name, [dict(zip(keys, values[k : k + len(keys)])) for k in range(0, len(values), max(1, len(keys)))]
        x = np.frombuffer(rest[0][1], kinds[rest[0][0]]).reshape(shape, order="F")
        return name, x.astype(bool) if flags & 0x200 else x

    out, at = {}, 128
    while at < len(data):
        kind, raw, at = element(at)
        if kind == COMPRESSED:
            raw = zlib.decompress(raw)
            raw = raw[8 : 8 + struct.unpack_from("<I", raw, 4)[0]]
        name, value = matrix(raw)
        out[name] = value
    return out


def save(folder: str, masks: DataFrame, traces: DataFrame, stats: DataFrame, labels: DataFrame, settings: dict) -> int:
    """A file Fall.mat for every plane below plane{p}/: stat, ops, F, Fneu, spks, iscell, redcell; returns how many.

    masks: plane, roi, y, x, lam. traces: plane, roi, frame, f, fneu, spk. stats: plane,
    roi and numbers. labels: plane, roi, iscell, prob, redcell, redprob. A plane's tables meet in one task.
    """
    names = [c for c in stats.columns if c not in ("plane", "roi", "med")]
    pixels = masks.groupBy("plane", "roi").agg(F.sort_array(F.collect_list(F.struct("y", "x", "lam"))).alias("pixels"))
    series = traces.groupBy("plane", "roi").agg(F.sort_array(F.collect_list(F.struct("frame", "f", "fneu", "spk"))).alias("t"))
    numbers = stats.select("plane", "roi", F.array(*[F.col(c).cast("double") for c in names]).alias("numbers"))
    rows = pixels.join(series, ["plane", "roi"]).join(numbers, ["plane", "roi"]).join(labels, ["plane", "roi"], "left")
    rows = rows.select(
        "plane", "roi", "numbers", "iscell", "prob", "redcell", "redprob",
        *[F.col(f"pixels.{c}").alias(c) for c in ("y", "x", "lam")], *[F.col(f"t.{c}").alias(c) for c in ("f", "fneu", "spk")],
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("roi")
        stat = [{"ypix": np.asarray(r.y, "i4"), "xpix": np.asarray(r.x, "i4"), "lam": np.asarray(r.lam, "f8"), **dict(zip(names, np.asarray(r.numbers, float)))} for r in pdf.itertuples()]
        lines = {k: np.stack([np.asarray(v, "f4") for v in pdf[c]]) for k, c in (("F", "f"), ("Fneu", "fneu"), ("spks", "spk"))}
        pair = lambda flag, p: np.stack([pdf[flag].fillna(False).to_numpy(float), pdf[p].fillna(0).to_numpy(float)], 1)
        plane = int(pdf["plane"].iloc[0])
        path = f"{folder.rstrip('/')}/plane{plane}/Fall.mat"
        ranges.put(path, encode({"stat": stat, "ops": settings, **lines, "iscell": pair("iscell", "prob"), "redcell": pair("redcell", "redprob")}))
        return pd.DataFrame({"path": [path]})

    return rows.groupBy("plane").applyInPandas(run, "path string").count()
