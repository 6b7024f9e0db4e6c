"""Sources and sinks of tracking tables: Parquet, pluggable detectors, and the analysis document."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import reports
from ..schemas import BALL_CAND, PLAYER_DET
from .cache import DetectionCache

#: Buckets of stored tables.
BUCKETS = 32


def read_table(spark: SparkSession, path: str, schema: str | None = None, max_frames: int | None = None) -> DataFrame:
    """A detection table; the frame cap is a filter, which reaches the Parquet scan."""
    df = (spark.read.schema(schema) if schema else spark.read).parquet(path).drop("bucket")
    return df if max_frames is None else df.where(F.col("frame_num") < max_frames)


def write_table(df: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """A table in a fixed number of buckets by match, a file each, whatever the number of matches; within a file rows are ordered by match, so that one match's pages lie together."""
    order = [c for c in ("match_id", "frame_num") if c in df.columns]
    bucket = F.pmod(F.xxhash64("match_id"), F.lit(buckets)).cast("int").alias("bucket")
    df.select("*", bucket).repartition(buckets, "bucket").sortWithinPartitions("bucket", *order).write.mode("overwrite").partitionBy("bucket").parquet(path)


def write_documents(docs: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Analysis documents as lines of JSON, {"match_id": ..., "document": text}, in a fixed number of buckets by match."""
    bucket = F.pmod(F.xxhash64("match_id"), F.lit(buckets)).cast("int").alias("bucket")
    docs.select("match_id", "document", bucket).repartition(buckets, "bucket").sortWithinPartitions("bucket", "match_id").write.mode("overwrite").partitionBy("bucket").json(path)


def read_documents(spark: SparkSession, path: str, matches: list[int] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Stored analysis documents, read back into columns; of the buckets of `matches` alone if they are given."""
    rows = spark.read.schema("match_id bigint, document string, bucket int").json(path)
    if matches is not None:
        own = F.array(*(F.pmod(F.xxhash64(F.lit(m).cast("bigint")), F.lit(buckets)).cast("int") for m in matches))
        rows = rows.where(F.array_contains(own, F.col("bucket")) & F.col("match_id").isin(matches))
    return reports.parsed(rows.drop("bucket"))


def read_or_detect(spark: SparkSession, path: str | None, schema: str, detect: Callable[..., DataFrame], read: bool = True, max_frames: int | None = None, wanted: DataFrame | None = None, version: str = "1") -> DataFrame:
    """Cached detections at `path`, or those of `detect`, which are then stored there.

    With `wanted` (match_id, frames), a cache that knows its matches (`cache.DetectionCache`): `detect` is given those that are absent, of another detector version or too
    short, and only they are detected. Without, a table of one input, which is stored and read as a whole: `path` must be the input's own.
    A cache whose columns or types aren't those of `schema` is an error, not a reason to detect anew.
    """
    if path is not None and wanted is not None:
        cache = DetectionCache(spark, path, schema, version)
        asked = wanted if max_frames is None else wanted.withColumn("frames", F.least("frames", F.lit(max_frames)))
        if not read:
            cache.add(asked, detect(asked))
        return cache.read_or_detect(asked, detect)
    if path is not None and read:
        found = cached(spark, path)
        if found is not None:
            wanted_types = {f.name: f.dataType for f in StructType.fromDDL(schema).fields}
            if {f.name: f.dataType for f in found.schema.fields if f.name in wanted_types} != wanted_types:
                raise ValueError(f"{path} holds {found.schema.simpleString()}, not {schema}")
            return read_table(spark, path, schema, max_frames)
    dets = detect()
    if path is None:
        return dets if max_frames is None else dets.where(F.col("frame_num") < max_frames)
    write_table(dets.select(*StructType.fromDDL(schema).fieldNames()), path)
    return read_table(spark, path, schema, max_frames)


def cached(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at `path`, if there is one."""
    sc = spark.sparkContext
    place = sc._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(sc._jsc.hadoopConfiguration()).exists(place):
        return None
    return spark.read.parquet(path)


def detect_players(frames: DataFrame, detector: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]) -> DataFrame:
    """Tracks from a stateful detector: `detector()` makes one for each match; it is given the match's frames in order, a batch at a time, and returns
    rows of PLAYER_DET plus class_name. Persons with a track id stay. No task holds all frames of a match.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        match = detect = None
        for batch in batches:
            for m, part in batch.groupby("match_id", sort=False):
                if detect is None or m != match:
                    match, detect = m, detector()
                yield detect(part)

    found = frames.repartition("match_id").sortWithinPartitions("match_id", "frame_num").mapInPandas(run, PLAYER_DET + ", class_name string")
    return found.where((F.col("class_name") == "person") & F.col("track_id").isNotNull()).drop("class_name")


def detect_balls(frames: DataFrame, detect: Callable[[pd.DataFrame], pd.DataFrame], least: float = 0.05) -> DataFrame:
    """Ball candidates from a detector of single frames."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield detect(batch)

    return frames.mapInPandas(run, BALL_CAND).where(F.col("conf") >= least)


def first_frames(frames: DataFrame) -> DataFrame:
    """The frame of each match from which key points are read; the camera does not move."""
    return frames.where(F.col("frame_num") == 0)


def keypoints_from(dets: DataFrame) -> DataFrame:
    """COURT_KEYPOINTS from a key-point detector's answer to the first frame of each match: (match_id, frame_num, boxes array<struct<class_name>>, points array<array<struct<x, y>>>).

    The n-th box goes with the n-th list of points; a box or a list without partner is left out. Classes are numbered as they first appear, points of
    a class run on over its boxes, and points at the origin are none.
    """
    pairs = first_frames(dets).select("match_id", F.posexplode(F.arrays_zip("boxes", "points")).alias("det", "z")).where(F.col("z.boxes").isNotNull() & F.col("z.points").isNotNull())
    named = pairs.select("match_id", "det", F.col("z.boxes.class_name").alias("class_name"), F.col("z.points").alias("points"))
    of_match, of_class = Window.partitionBy("match_id"), Window.partitionBy("match_id", "class_idx").orderBy("det", "k")
    first = named.withColumn("first", F.min("det").over(Window.partitionBy("match_id", "class_name")))
    numbered = first.withColumn("class_idx", (F.dense_rank().over(of_match.orderBy("first")) - 1).cast("int"))
    points = numbered.select("match_id", "class_idx", "class_name", "det", F.posexplode("points").alias("k", "p")).where((F.col("p.x") > 0) | (F.col("p.y") > 0))
    return points.select("match_id", "class_idx", "class_name", (F.row_number().over(of_class) - 1).cast("int").alias("kp_idx"), F.col("p.x").cast("double").alias("x"), F.col("p.y").cast("double").alias("y"))
