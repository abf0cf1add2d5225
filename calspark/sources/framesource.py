"""Frames as a data source: ``spark.read.format("calspark.frames")`` and its writer.

A recording is a folder of flat little-endian int16 files and one manifest. The manifest
has a row for each block of at most BLOCK frames: its file and place in it, its plane, and
its least and greatest frame number. A scan reads the manifest, drops blocks that filters on
plane and frame exclude, and hands out byte ranges, so that ten frames of a long recording
are one small range each, wherever they lie.

Tasks of a write put flat files under names of their own; nobody reads these until the
manifest that lists them replaces the old one in a single move. A write that fails leaves
the old manifest and removes its own files; one that replaces a recording removes the
old files after the move.

Options: path, height, width (write), pixels ("false": frame numbers without a byte of a
frame read), block. Filters reach the source where
``spark.sql.python.filterPushdown.enabled`` is set, which ``register`` does.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)

from calspark.sources import ranges
from calspark.sources.raw import to_int16

FORMAT, MANIFEST = "calspark.frames", "_manifest.parquet"
#: Most frames of a block, and bytes of a range that one task reads.
BLOCK, RANGE_BYTES = 256, 32 << 20
SCHEMA = "plane int, frame long, Ly int, Lx int, pix binary"
#: A block: ``ids`` holds frame numbers only where they are not low, low + 1, ..., high.
BLOCKS = pa.schema([("file", pa.string()), ("at", pa.int64()), ("count", pa.int32()), ("plane", pa.int32()), ("low", pa.int64()), ("high", pa.int64()), ("height", pa.int32()), ("width", pa.int32()), ("ids", pa.list_(pa.int64()))])


def _manifest(path: str) -> list[dict]:
    system, inner = ranges.file_system(path)
    name = f"{inner.rstrip('/')}/{MANIFEST}"
    if system.get_file_info(name).type == fs.FileType.NotFound:
        return []
    with system.open_input_file(name) as f:
        return pq.read_table(f).to_pylist()


def _bounds(filters: list) -> dict[str, tuple[float, float, set | None]]:
    """column -> (least, greatest, allowed values or None) of plane and frame under filters that all hold."""
    out = {c: (-np.inf, np.inf, None) for c in ("plane", "frame")}
    for f in filters:
        name = f.attribute[0]
        low, high, allowed = out[name]
        if isinstance(f, EqualTo):
            low, high = max(low, f.value), min(high, f.value)
        elif isinstance(f, In):
            values = {v for v in f.value if v is not None}
            allowed = values if allowed is None else allowed & values
        elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
            low = max(low, f.value + isinstance(f, GreaterThan))
        else:
            high = min(high, f.value - isinstance(f, LessThan))
        out[name] = low, high, allowed
    return out


@dataclass
class Blocks(InputPartition):
    """Neighbouring blocks of one file."""

    blocks: list[dict]


class FrameReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.pixels, self.filters = options["path"], options.get("pixels", "true").lower() != "false", []

    def pushFilters(self, filters):
        """Comparisons of plane and frame drop blocks; Spark still applies all filters to the frames of the others."""
        for f in filters:
            if isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute in (("plane",), ("frame",)) and f.value is not None:
                self.filters.append(f)
            yield f

    def partitions(self) -> list[Blocks]:
        bounds = _bounds(self.filters)

        def wanted(b: dict) -> bool:
            for name, low, high in (("plane", b["plane"], b["plane"]), ("frame", b["low"], b["high"])):
                least, most, allowed = bounds[name]
                if high < least or low > most or allowed is not None and not any(low <= v <= high for v in allowed):
                    return False
            return True

        out: list[Blocks] = []
        size = 0
        for b in sorted(filter(wanted, _manifest(self.path)), key=lambda b: (b["file"], b["at"])):
            bytes_ = 2 * b["count"] * b["height"] * b["width"]
            if not out or out[-1].blocks[-1]["file"] != b["file"] or size + bytes_ > RANGE_BYTES:
                out.append(Blocks([]))
                size = 0
            out[-1].blocks.append(b)
            size += bytes_
        return out or [Blocks([])]

    def read(self, partition: Blocks) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("plane", pa.int32()), ("frame", pa.int64()), ("Ly", pa.int32()), ("Lx", pa.int32()), ("pix", pa.binary())])
        if not partition.blocks:
            return
        source = ranges.open_at(f"{self.path.rstrip('/')}/{partition.blocks[0]['file']}") if self.pixels else None
        for b in partition.blocks:
            n, size = b["count"], 2 * b["height"] * b["width"]
            ids = b["ids"] if b["ids"] is not None else list(range(b["low"], b["high"] + 1))
            pix: list = [None] * n
            if source is not None:
                source.seek(b["at"] * size)
                content = source.read(n * size)
                pix = [content[k * size : (k + 1) * size] for k in range(n)]
            columns = [[b["plane"]] * n, ids, [b["height"]] * n, [b["width"]] * n, pix]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
        if source is not None:
            source.close()


@dataclass
class Written(WriterCommitMessage):
    blocks: list[dict]


class FrameWriter(DataSourceArrowWriter):
    """Rows (plane, frame, arr) to flat files, one a task."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.block = options["path"], overwrite, int(options.get("block", BLOCK))
        self.height, self.width = int(options["height"]), int(options["width"])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        blocks: list[dict] = []
        system, inner = ranges.file_system(self.path)
        system.create_dir(inner, recursive=True)
        name, at = f"frames-{uuid.uuid4().hex}.bin", 0
        out = system.open_output_stream(f"{inner.rstrip('/')}/{name}")
        try:
            for batch in iterator:
                for plane, frame, arr in zip(*(batch.column(c).to_pylist() for c in ("plane", "frame", "arr"))):
                    image = to_int16(np.asarray(arr)).astype("<i2")
                    if image.size != self.height * self.width:
                        raise ValueError(f"frame {frame} of plane {plane} has {image.size} pixels, not {self.height} x {self.width}")
                    out.write(image.tobytes())
                    last = blocks[-1] if blocks else None
                    if last is None or last["plane"] != plane or last["count"] == self.block:
                        blocks.append({"file": name, "at": at, "count": 0, "plane": plane, "ids": [], "height": self.height, "width": self.width})
                        last = blocks[-1]
                    last["ids"].append(frame)
                    last["count"] += 1
                    at += 1
        except BaseException:
            out.close()
            system.delete_file(f"{inner.rstrip('/')}/{name}")
            raise
        out.close()
        if not at:
            system.delete_file(f"{inner.rstrip('/')}/{name}")
        for b in blocks:
            b["low"], b["high"] = min(b["ids"]), max(b["ids"])
            if b["ids"] == list(range(b["low"], b["high"] + 1)):
                b["ids"] = None
        return Written(blocks)

    def commit(self, messages: list) -> None:
        """The new manifest replaces the old one in one move."""
        fresh = [b for m in messages if m is not None for b in m.blocks]
        old = _manifest(self.path)
        sink = pa.BufferOutputStream()
        pq.write_table(pa.Table.from_pylist(fresh if self.overwrite else old + fresh, BLOCKS), sink)
        ranges.put(f"{self.path.rstrip('/')}/{MANIFEST}", sink.getvalue().to_pybytes())
        if self.overwrite:
            self._delete({b["file"] for b in old})

    def abort(self, messages: list) -> None:
        """What finished tasks wrote goes; the old manifest and its files were never touched."""
        self._delete({b["file"] for m in messages if m is not None for b in m.blocks})

    def _delete(self, names: set[str]) -> None:
        system, inner = ranges.file_system(self.path)
        for name in names:
            if system.get_file_info(f"{inner.rstrip('/')}/{name}").type != fs.FileType.NotFound:
                system.delete_file(f"{inner.rstrip('/')}/{name}")


class FrameSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FrameReader:
        return FrameReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> FrameWriter:
        return FrameWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, with filters handed to it."""
    spark.dataSource.register(FrameSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write_frames(frames: DataFrame, path: str, height: int, width: int, mode: str = "overwrite", tasks: int | None = None, block: int = BLOCK) -> None:
    """plane, frame, arr as a recording, dealt by ranges of plane and frame so that blocks are narrow."""
    spark = frames.sparkSession
    register(spark)
    rows = frames.select(F.col("plane").cast("int").alias("plane"), F.col("frame").cast("long").alias("frame"), F.col("arr").cast("array<double>").alias("arr"))
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(tasks, "plane", "frame").sortWithinPartitions("plane", "frame")
    dealt.write.format(FORMAT).option("height", height).option("width", width).option("block", block).mode(mode).save(path)


def read_frames(spark: SparkSession, path: str, pixels: bool = True) -> DataFrame:
    """plane, frame, Ly, Lx, pix of a recording."""
    register(spark)
    return spark.read.format(FORMAT).option("pixels", str(pixels).lower()).load(path)
