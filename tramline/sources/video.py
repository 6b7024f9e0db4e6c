"""Frames of uncompressed videos (YUV4MPEG2 files) as rows, read side by side.

The source indexes each file by its header and size and makes a partition of each range of frames, which seeks to its first byte; filters on frame_num narrow the
ranges, so that a cap on frames reads only what it asks for. Files lie anywhere Arrow's file systems reach. A file that isn't such a video, or ends within
a frame, is an error that names it.
"""

from __future__ import annotations

import glob
import os
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from ..functions import geometry as G

FRAMES = "path string, frame_num bigint, width int, height int, fps double, colour string, frame binary"
#: What a file begins with, and each frame (fixed values of the format).
MAGIC, MARK = b"YUV4MPEG2", b"FRAME"
#: Samples of chroma for each of luma, by colour space (fixed values of the format).
CHROMA = {"420": 0.5, "422": 1.0, "444": 2.0, "mono": 0.0, "411": 0.5}
#: The longest header that is looked for.
HEADER = 4096


@dataclass
class Index:
    """A file: its header's values, the bytes of a frame's samples, and where frames begin. Frames of one size lie `stride` bytes apart; others are listed."""

    path: str
    width: int
    height: int
    fps: float | None
    colour: str
    samples: int
    count: int
    first: int
    stride: int
    offsets: list[int] | None = None

    def offset(self, frame: int) -> int:
        return self.offsets[frame] if self.offsets is not None else self.first + frame * self.stride


def _open(path: str):
    if "://" in path or path.startswith("file:"):
        system, inner = fs.FileSystem.from_uri(path)
        return system.open_input_file(inner)
    return fs.LocalFileSystem().open_input_file(path)


def index_of(path: str) -> Index:
    """The index of a file, from its header, its size and the marks of its first and last frame; all marks are looked up if those don't fit."""
    with _open(path) as f:
        head = f.read(HEADER)
        end = head.find(b"\n")
        if not head.startswith(MAGIC + b" ") or end < 0:
            raise ValueError(f"{path} is no YUV4MPEG2 file")
        values = {p[:1]: p[1:].decode("ascii", "replace") for p in head[:end].split()[1:]}
        width, height, colour = int(values.get(b"W", 0)), int(values.get(b"H", 0)), values.get(b"C", "420jpeg")
        kind = re.match("mono|4[0-9]{2}", colour)
        if width < 1 or height < 1 or kind is None or kind[0] not in CHROMA:
            raise ValueError(f"{path} has no size or an unknown colour space: {head[:end].decode('ascii', 'replace')}")
        deep = 2 if re.search(r"(?:p|mono)(?:9|1[0-6])$", colour) else 1
        across = {"420": -(-width // 2) * -(-height // 2) * 2, "422": -(-width // 2) * height * 2, "411": -(-width // 4) * height * 2, "444": width * height * 2, "mono": 0}[kind[0]]
        samples = (width * height + across) * deep
        rate = [int(x) for x in values.get(b"F", "0:0").split(":")]
        size, first, stride = f.size(), end + 1, len(MARK) + 1 + samples
        out = Index(path, width, height, rate[0] / rate[1] if len(rate) == 2 and rate[1] else None, colour, samples, (size - first) // stride, first, stride)
        if (size - first) % stride == 0 and all(_mark(f, out.offset(k)) == len(MARK) + 1 for k in {0, out.count - 1} if out.count):
            return out
        out.offsets, at = [], first
        while at < size:
            skip = _mark(f, at)
            if skip == 0:
                raise ValueError(f"{path}: frame {len(out.offsets)} has no mark")
            if at + skip + samples > size:
                raise ValueError(f"{path} ends within frame {len(out.offsets)}")
            out.offsets.append(at)
            at += skip + samples
        out.count = len(out.offsets)
        return out


def _mark(f, at: int) -> int:
    """Bytes of the frame's mark at a place; 0 if there is none."""
    f.seek(at)
    head = f.read(256)
    end = head.find(b"\n")
    return end + 1 if head.startswith(MARK) and end >= 0 and head[len(MARK) : len(MARK) + 1] in (b"\n", b" ") else 0


def files_of(path: str) -> list[str]:
    """The files of a path: itself, those of a folder, or those that a pattern fits (on local file systems)."""
    if "://" in path and not path.startswith("file:"):
        system, inner = fs.FileSystem.from_uri(path)
        scheme = path.split("://")[0]
        info = system.get_file_info(inner)
        if info.type == fs.FileType.Directory:
            return sorted(f"{scheme}://{i.path}" for i in system.get_file_info(fs.FileSelector(inner, recursive=True)) if i.extension == "y4m")
        return [path]
    local = re.sub("^file:(//)?", "", path)
    if os.path.isdir(local):
        return sorted(glob.glob(f"{local}/**/*.y4m", recursive=True))
    found = sorted(glob.glob(local))
    if not found:
        raise ValueError(f"{path}: no such file")
    return found


@dataclass
class Range(InputPartition):
    index: Index
    start: int
    end: int


class FrameReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        if "path" not in options:
            raise ValueError("a video source needs a path")
        self.files, self.bytes = files_of(options["path"]), int(options.get("partitionbytes", 64 << 20))
        self.pixels = options.get("pixels", "true").lower() == "true"
        self.low, self.high, self.paths = 0, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Comparisons of frame_num narrow the ranges that are read, equal paths the files; what is more than that goes back to Spark."""
        for f in filters:
            if not self._pushed(f):
                yield f

    def _pushed(self, f: Filter) -> bool:
        column, value = ".".join(getattr(f, "attribute", ())), getattr(f, "value", None)
        if isinstance(f, IsNotNull):
            return column in ("frame_num", "path")
        if column == "path" and isinstance(f, EqualTo):
            self.files = [p for p in self.files if p == value]
            return True
        if column != "frame_num":
            return False
        if isinstance(f, In) and f.value:
            self._within(min(f.value), max(f.value) + 1)
            return False  # only its bounds are met
        bounds = {EqualTo: (value, 1), GreaterThan: (1, None), GreaterThanOrEqual: (0, None), LessThan: (None, 0), LessThanOrEqual: (None, 1)}.get(type(f))
        if bounds is None:
            return False
        if isinstance(f, EqualTo):
            self._within(value, value + 1)
        else:
            self._within(*(None if b is None else value + b for b in bounds))
        return True

    def _within(self, low: int | None, high: int | None) -> None:
        self.low = max(self.low, low or 0)
        self.high = self.high if high is None else high if self.high is None else min(self.high, high)

    def partitions(self) -> Sequence[InputPartition]:
        out = []
        for path in self.files:
            index = index_of(path)
            end = index.count if self.high is None else min(index.count, max(self.high, 0))
            each = max(1, self.bytes // index.stride) if self.pixels else max(index.count, 1)
            for a in range(self.low, end, each):
                b = min(a + each, end)
                # a task gets the offsets of its own frames alone
                own = Index(**{**index.__dict__, "offsets": index.offsets and {k: index.offsets[k] for k in range(a, b)}})
                out.append(Range(own, a, b))
        return out

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        """Batches of some 8 MB of frames; none where filters have left no range at all."""
        if partition is None:
            return
        index = partition.index
        each = max(1, (8 << 20) // index.stride) if self.pixels else 10_000
        with _open(index.path) as f:
            for a in range(partition.start, partition.end, each):
                b = min(a + each, partition.end)
                yield self._batch(index, range(a, b), [self._frame(f, index, k) for k in range(a, b)] if self.pixels else [None] * (b - a))

    @staticmethod
    def _frame(f, index: Index, frame: int) -> bytes:
        at = index.offset(frame)
        skip = _mark(f, at)
        if skip == 0:
            raise ValueError(f"{index.path}: frame {frame} has no mark")
        f.seek(at + skip)
        data = f.read(index.samples)
        if len(data) < index.samples:
            raise ValueError(f"{index.path} ends within frame {frame}")
        return data

    @staticmethod
    def _batch(index: Index, frames: range, data: list[bytes | None]) -> pa.RecordBatch:
        n = len(frames)
        same = lambda v, t: pa.array([v] * n, t)
        columns = [same(index.path, pa.string()), pa.array(frames, pa.int64()), same(index.width, pa.int32()), same(index.height, pa.int32()), same(index.fps, pa.float64()), same(index.colour, pa.string()), pa.array(data, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in FRAMES.split(", ")])


class FrameSource(DataSource):
    """spark.read.format("y4m").load(path); options: partitionBytes (bytes of a partition), pixels ("false": rows without samples, from the index alone)."""

    @classmethod
    def name(cls) -> str:
        return "y4m"

    def schema(self) -> str:
        return FRAMES

    def reader(self, schema: StructType) -> DataSourceReader:
        return FrameReader(self.options)


def read_frames(spark: SparkSession, path: str, max_frames: int | None = None, **options: object) -> DataFrame:
    """FRAMES rows of the videos at `path` (a file, a folder, a pattern); with `max_frames` only those of the first so many are read."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FrameSource)
    df = spark.read.format("y4m").options(**options).load(path)
    return df if max_frames is None else df.where(F.col("frame_num") < max_frames)


def match_frames(frames: DataFrame, videos: DataFrame) -> DataFrame:
    """Frames with the match_id of their video, from `videos` (match_id, path)."""
    return frames.join(videos, "path")


def match_rows(spark: SparkSession, path: str, videos: DataFrame, default_fps: float = 24.0) -> DataFrame:
    """MATCHES of videos (match_id, path), from their headers and sizes: no samples are read. A missing rate, or one of at most 1, is the default."""
    rows = match_frames(read_frames(spark, path, pixels="false"), videos)
    fps = G.fps_or_default(F.max("fps"), default_fps).alias("fps")
    return rows.groupBy("match_id").agg(fps, F.count(F.lit(1)).alias("total_frames"), F.max("width").alias("frame_w"), F.max("height").alias("frame_h"))


def luma(frame: bytes, width: int, height: int, colour: str = "420jpeg") -> np.ndarray:
    """The brightness of a frame's pixels, [height, width]."""
    deep = "<u2" if re.search(r"(?:p|mono)(?:9|1[0-6])$", colour) else "u1"
    return np.frombuffer(frame, deep, width * height).reshape(height, width)
