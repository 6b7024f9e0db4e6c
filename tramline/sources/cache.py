"""Detections kept between runs: a manifest says of which matches, by which detector and up to which frame.

A run adds a generation: rows in a fixed number of buckets by match, written first, then the manifest's rows of the same generation, then one commit file, which is made
in a single step. A generation without its commit is never read, so a half-written one is as none. Wanted matches meet the manifest by an anti-join; only those that
are absent, made by another detector version or too short are detected. Of several generations with a match the latest holds. `compact` merges
them into one, so that neither files nor reads grow with the number of runs.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .files import Files

MANIFEST = "match_id bigint, version string, frames bigint, gen bigint"
#: What a wanted match is to the cache (values of `status`).
CACHED, ABSENT, OUTDATED, SHORT = "cached", "absent", "outdated", "short"


def live(manifest: DataFrame) -> DataFrame:
    """The row of each match that holds: that of its latest generation."""
    last = F.max_by(F.struct("version", "frames"), "gen").alias("m")
    return manifest.groupBy("match_id").agg(last, F.max("gen").alias("gen")).select("match_id", "m.version", "m.frames", "gen")


def plan(wanted: DataFrame, manifest: DataFrame, version: str) -> DataFrame:
    """(match_id, frames, status, gen) of wanted matches (match_id, frames): what the cache has of them. Repeated wishes count once, by the most frames."""
    asked = wanted.groupBy("match_id").agg(F.max("frames").alias("frames"))
    has = live(manifest).select("match_id", "version", F.col("frames").alias("held"), "gen")
    status = F.when(F.col("held").isNull(), ABSENT).when(~F.col("version").eqNullSafe(F.lit(version)), OUTDATED).when(F.col("held") < F.col("frames"), SHORT).otherwise(CACHED)
    return asked.join(has, "match_id", "left").select("match_id", "frames", status.alias("status"), "gen")


class DetectionCache:
    """Detections of one kind (`schema` with match_id and frame_num) by one version of a detector, in a folder."""

    def __init__(self, spark: SparkSession, path: str, schema: str, version: str = "1", buckets: int = 32, most_generations: int = 16):
        self.spark, self.path, self.schema, self.version, self.buckets, self.most = spark, path.rstrip("/"), schema, version, buckets, most_generations
        self.files = Files(spark, self.path)
        columns = [f.simpleString() for f in StructType.fromDDL(schema).fields]
        if not self.files.create_once("layout.json", json.dumps({"columns": columns, "buckets": buckets})):
            layout = json.loads(self.files.read("layout.json"))
            self.buckets = layout["buckets"]
            if layout["columns"] != columns:
                raise ValueError(f"{path} holds {', '.join(layout['columns'])}, not {schema}")

    def generations(self) -> list[int]:
        """Numbers of the generations that are whole, from the last merged one on."""
        numbers = [int(n.split(".")[0]) for n in self.files.names("commits")]
        merged = [n for n in numbers if json.loads(self.files.read(f"commits/{n:012}.json"))["merged"]]
        return [n for n in numbers if n >= max(merged, default=0)]

    def _folder(self, gen: int, kind: str) -> str:
        return self.files.path(f"{kind}/{json.loads(self.files.read(f'commits/{gen:012}.json'))['folder']}")

    def _read(self, kind: str, schema: str) -> DataFrame:
        """Rows of all whole generations with their number; `gen` is no column of the files, as the number is only known at the commit."""
        out = self.spark.createDataFrame([], f"{schema}, gen bigint")
        names = StructType.fromDDL(schema).fieldNames()
        for g in self.generations():
            out = out.unionByName(self.spark.read.schema(schema).parquet(self._folder(g, kind)).select(*names, F.lit(g).cast("bigint").alias("gen")))
        return out

    def _data(self, keys: DataFrame) -> DataFrame:
        """Rows of the matches and generations of `keys`; the buckets of other matches aren't read."""
        of = keys.withColumn("bucket", self._bucket())
        return self._read("data", f"{self.schema}, bucket int").join(of, ["bucket", "match_id", "gen"])

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("match_id"), F.lit(self.buckets)).cast("int")

    def manifest(self) -> DataFrame:
        return self._read("manifest", MANIFEST.rsplit(", ", 1)[0])

    def plan(self, wanted: DataFrame) -> DataFrame:
        return plan(wanted, self.manifest(), self.version)

    def add(self, matches: DataFrame, detections: DataFrame, merge_as: int | None = None) -> int:
        """Store the detections of `matches` (match_id, frames, and version if it isn't this cache's), also of those without any; returns the generation.

        With `merge_as` it stands for all before that number, and only if no other run has taken it.
        """
        folder = uuid.uuid4().hex
        columns = StructType.fromDDL(self.schema).fieldNames()
        rows = detections.join(matches.select("match_id"), "match_id", "left_semi").select(*columns).withColumn("bucket", self._bucket())
        # one task and file for each bucket, ordered so that a match's pages lie together
        rows.repartition(self.buckets, "bucket").sortWithinPartitions("bucket", "match_id", "frame_num").write.partitionBy("bucket").parquet(self.files.path(f"data/{folder}"))
        version = F.col("version") if "version" in matches.columns else F.lit(self.version).alias("version")
        matches.select("match_id", version, F.col("frames").cast("bigint").alias("frames")).write.parquet(self.files.path(f"manifest/{folder}"))
        text = json.dumps({"folder": folder, "merged": merge_as is not None})
        number = merge_as or self._free()
        while not self.files.create_once(f"commits/{number:012}.json", text):
            if merge_as is not None:  # what came in between isn't in it
                return self.compact()
            number += 1
        return number

    def _free(self) -> int:
        return max((int(n.split(".")[0]) for n in self.files.names("commits")), default=0) + 1

    def read(self, wanted: DataFrame) -> DataFrame:
        """Detections of wanted matches (match_id, frames), below their number of frames. Only those of this version: `plan` tells what is missing."""
        keys = self.plan(wanted).where(F.col("status") == CACHED).select("match_id", "gen", F.col("frames").alias("_frames"))
        return self._data(keys).where(F.col("frame_num") < F.col("_frames")).select(*StructType.fromDDL(self.schema).fieldNames())

    def read_or_detect(self, wanted: DataFrame, detect: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Detections of all wanted matches (match_id, frames): `detect` is given those the cache hasn't (match_id, frames), and what it finds is added first."""
        missing = self.plan(wanted).where(F.col("status") != CACHED).select("match_id", "frames")
        if not missing.isEmpty():
            self.add(missing, detect(missing))
            if len(self.generations()) > self.most:
                self.compact()
        return self.read(wanted)

    def compact(self) -> int:
        """Merge all generations into one of what holds; the files of the others stay until `vacuum`, for readers under way."""
        number = self._free()
        held = live(self.manifest())
        return self.add(held, self._data(held.select("match_id", "gen")), merge_as=number)

    def vacuum(self) -> int:
        """Delete what no whole generation needs: those before the last merged one, and half-written ones. Not while a run adds to the cache. Returns how many folders went."""
        kept = {self._folder(g, "data").rsplit("/", 1)[1] for g in self.generations()}
        first = min(self.generations(), default=0)
        gone = 0
        for n in self.files.names("commits"):
            if int(n.split(".")[0]) < first:
                self.files.delete(f"commits/{n}")
        for kind in ("data", "manifest"):
            for folder in self.files.names(kind):
                if folder not in kept:
                    self.files.delete(f"{kind}/{folder}")
                    gone += 1
        return gone
