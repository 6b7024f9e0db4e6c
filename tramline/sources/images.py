"""Pictures of grids and paths as PNG files: rows of (name, content) encoded in an Arrow map and written by a sink that commits whole files or none.

A coverage grid becomes a picture of its size, its densities as shares of the greatest in 8 bits; a trajectory one of the court's plan, its steps as lines, brighter
where the ball was faster. Colours, legends and court drawings are a viewer's matter. One task encodes one picture at a time.
"""

from __future__ import annotations

import os
import struct
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..schemas import DEFAULT, Params

PICTURE = "name string, content binary"
#: The first bytes of a file, and the filter of a row that stores differences to the row above (fixed values of the format).
SIGNATURE, UP = b"\x89PNG\r\n\x1a\n", 2
#: Seconds between looks at whether a task that is being stopped has written on, and how many looks must find nothing.
PAUSE, LOOKS = 0.3, 3
#: Pixels of a trajectory's picture for a metre.
SCALE = 20


def encode_png(pixels: np.ndarray) -> bytes:
    """An 8-bit grey picture [height, width]; each row is stored as its difference to the one above."""
    above = np.vstack([np.zeros((1, pixels.shape[1]), np.uint8), pixels[:-1]])
    rows = np.column_stack([np.full(len(pixels), UP, np.uint8), pixels - above])

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", pixels.shape[1], pixels.shape[0], 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def grid_pixels(bx: np.ndarray, by: np.ndarray, density: np.ndarray, n: int) -> np.ndarray:
    """The picture of a grid: row `by`, column `bx`; cells that aren't given are empty."""
    out = np.zeros((n, n), np.uint8)
    top = density.max(initial=0.0)
    if top > 0:
        out[by, bx] = np.floor(density / top * 255 + 0.5)
    return out


def path_pixels(x: np.ndarray, y: np.ndarray, speed: np.ndarray, p: Params = DEFAULT) -> np.ndarray:
    """The picture of a path in metres: each step a line of the brightness of its speed, 64 to 255; where lines meet the brightest holds."""
    w, h = round(p.court_width_m * SCALE) + 1, round(p.court_length_m * SCALE) + 1
    out = np.zeros((h, w), np.uint8)
    px, py = (np.clip(np.round(v * SCALE), 0, top - 1).astype(int) for v, top in ((x, w), (y, h)))
    bright = (64 + 191 * np.clip(np.nan_to_num(speed), 0, 1)).astype(np.uint8)
    if len(px):
        out[py[0], px[0]] = 64
    for i in range(1, len(px)):
        steps = max(abs(px[i] - px[i - 1]), abs(py[i] - py[i - 1]), 1)
        along = np.arange(steps + 1) / steps
        at = tuple(np.round(a[i - 1] + (a[i] - a[i - 1]) * along).astype(int) for a in (py, px))
        out[at] = np.maximum(out[at], bright[i])
    return out


def _encoded(rows: DataFrame, draw) -> DataFrame:
    """PICTURE rows, one for each row of (name, lists of numbers); `draw` gives the pixels from the lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                lists = [column[i].values.to_numpy(zero_copy_only=False) for column in batch.columns[1:]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([encode_png(draw(*lists))], pa.binary())], ["name", "content"])

    return rows.mapInArrow(run, PICTURE)


def grid_pictures(heatmap: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """PICTURE rows of smoothed grids (match_id, player_id, bx, by, density): match_<id>/heatmap_p<player>.png. A grid has a bounded number of cells."""
    name = F.concat(F.lit("match_"), F.col("match_id").cast("string"), F.lit("/heatmap_p"), F.col("player_id").cast("string"), F.lit(".png"))
    cells = heatmap.groupBy("match_id", "player_id").agg(F.collect_list(F.struct("bx", "by", "density")).alias("c"))
    return _encoded(cells.select(name.alias("name"), "c.bx", "c.by", "c.density"), lambda bx, by, d: grid_pixels(bx, by, d, p.grid))


def path_pictures(trajectory: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """PICTURE rows of trajectories (match_id, frame_num, x_m, y_m, rel_speed): match_<id>/shot_map.png. A picture needs the path of one match, three numbers a frame."""
    name = F.concat(F.lit("match_"), F.col("match_id").cast("string"), F.lit("/shot_map.png"))
    paths = trajectory.groupBy("match_id").agg(F.array_sort(F.collect_list(F.struct("frame_num", "x_m", "y_m", F.coalesce("rel_speed", F.lit(0.0)).alias("v")))).alias("c"))
    return _encoded(paths.select(name.alias("name"), "c.x_m", "c.y_m", "c.v"), lambda x, y, v: path_pixels(x, y, v, p))


@dataclass
class Written(WriterCommitMessage):
    folder: str
    names: list[str]


class FileWriter(DataSourceArrowWriter):
    """Each task writes below a folder of its own under _new; the commit moves files to their names, an abort leaves none."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.run, self.overwrite = path, f"_new/{uuid.uuid4().hex}", overwrite

    def _system(self) -> tuple[fs.FileSystem, str]:
        if "://" in self.path or self.path.startswith("file:"):
            return fs.FileSystem.from_uri(self.path)
        return fs.LocalFileSystem(), os.path.abspath(self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = self._system()
        folder, names = f"{self.run}/{uuid.uuid4().hex}", []
        for batch in iterator:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not name or name.startswith("/") or ".." in name.split("/"):
                    raise ValueError(f"{name!r} is no name of a file below the path")
                at = f"{root}/{folder}/{name}"
                system.create_dir(at.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(at) as out:
                    out.write(content or b"")
                names.append(name)
        return Written(folder, names)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = self._system()
        every = [(m.folder, n) for m in messages if m for n in m.names]
        names = [n for _, n in every]
        taken = [n for n in names if system.get_file_info(f"{root}/{n}").type != fs.FileType.NotFound]
        if len(set(names)) < len(names) or taken and not self.overwrite:
            self.abort(messages)
            raise ValueError(f"files of one name: {sorted(taken or [n for n in names if names.count(n) > 1])[:3]}")
        for folder, n in every:
            system.create_dir(f"{root}/{n}".rsplit("/", 1)[0], recursive=True)
            system.move(f"{root}/{folder}/{n}", f"{root}/{n}")
        self._clear(system, root)

    def abort(self, messages: list[Written | None]) -> None:
        system, root = self._system()
        calm = 0
        while calm < LOOKS:  # tasks that are being stopped may write on for a moment
            calm = calm + 1 if system.get_file_info(f"{root}/{self.run}").type == fs.FileType.NotFound else 0
            self._clear(system, root)
            time.sleep(PAUSE)

    def _clear(self, system: fs.FileSystem, root: str) -> None:
        if system.get_file_info(f"{root}/{self.run}").type != fs.FileType.NotFound:
            system.delete_dir(f"{root}/{self.run}")
        if system.get_file_info(f"{root}/_new").type != fs.FileType.NotFound and not system.get_file_info(fs.FileSelector(f"{root}/_new")):
            system.delete_dir(f"{root}/_new")


class FileSink(DataSource):
    """df.write.format("named_files").mode("append" or "overwrite").save(path): a file for each row of PICTURE; overwriting replaces files of the same names only."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return PICTURE

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        if schema.fieldNames() != ["name", "content"]:
            raise ValueError(f"files are rows of {PICTURE}, not {schema.simpleString()}")
        return FileWriter(self.options["path"], overwrite)


def write_files(files: DataFrame, path: str, overwrite: bool = False) -> None:
    spark: SparkSession = files.sparkSession
    spark.dataSource.register(FileSink)
    files.select("name", "content").write.format("named_files").mode("overwrite" if overwrite else "append").save(path)
