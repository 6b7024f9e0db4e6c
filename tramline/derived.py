"""Tracking tables derived from `events`, for the registered queries and tests: matches, frames, detections, and key points of several courts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Court corners of the derived tables, in image pixels.
KEYPOINTS = ((300.0, 200.0), (980.0, 210.0), (1200.0, 690.0), (80.0, 680.0))
FRAME_W, FRAME_H = 1280, 720
LARGE_W, LARGE_H = 1920, 1080
_TL, _TR, _BR, _BL = KEYPOINTS
#: Key points of the derived matches, by match_id modulo their number, as (class_idx, class_name, kp_idx, x, y).
KEYPOINT_CASES = (
    [(0, "court", i, *p) for i, p in enumerate(KEYPOINTS)],
    # the first class has too few points, and a point at the origin is none
    [(0, "net", 0, 640.0, 400.0), (0, "net", 1, 650.0, 410.0), (1, "court", 0, *_BL), (1, "court", 1, *_TR), (1, "court", 2, 0.0, 0.0), (1, "court", 3, *_TL), (1, "court", 4, *_BR)],
    # more than four: the extreme ones
    [(0, "court", 0, 640.0, 400.0), (0, "court", 1, *_BR), (0, "court", 2, *_TR), (0, "court", 3, 600.0, 300.0), (0, "court", 4, *_TL), (0, "court", 5, *_BL)],
    # none: feet
    [],
    # no class alone has four
    [(0, "left", 0, *_TL), (0, "left", 1, *_BL), (1, "right", 0, *_TR), (1, "right", 1, *_BR)],
    # all in a line: feet
    [(0, "court", i, *p) for i, p in enumerate([(100.0, 100.0), (600.0, 350.0), (1100.0, 600.0), (1200.0, 650.0)])],
)


def frames(events: DataFrame, parts: int | None = None) -> DataFrame:
    """(match_id, frame_num, event_id, event_type, value, k): a match for each block of four users, a frame for each event.

    Spark sizes the tasks of a window by what was shuffled for it. With `parts`, matches are dealt to so many tasks instead: for steps that make several rows of a frame and sort them.
    """
    w = Window.partitionBy("match_id").orderBy("ts", "event_id")
    rows = events.select(F.expr("user_id div 4").alias("match_id"), "ts", "event_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))
    if parts is not None:
        rows = rows.repartition(parts, "match_id")
    return rows.withColumn("frame_num", (F.row_number().over(w) - 1).cast("bigint")).select("match_id", "frame_num", "event_id", "event_type", "value", "k")


def ball_track(fr: DataFrame) -> DataFrame:
    """(match_id, frame_num, cx, cy): a ball that swings along the court; errors are missed detections."""
    swing = F.abs((F.col("frame_num") * (7 + F.col("match_id") % 3 * 2)) % 400 - 200)
    seen = F.col("event_type") != "error"
    return fr.select("match_id", "frame_num", F.when(seen, (200 + 7 * F.col("k")).cast("double")).alias("cx"), F.when(seen, (250 + swing).cast("double") + (F.col("event_id") % 5).cast("double") / 2).alias("cy"))


def player_boxes(fr: DataFrame) -> DataFrame:
    """PLAYER_DET: four players in most frames, as boxes of 40 by 90 pixels above their feet."""
    pid = F.explode(F.array(*map(F.lit, range(1, 5)))).alias("track_id")
    t = fr.select("match_id", "frame_num", "event_id", "value", "k", pid).where((F.col("event_id") + F.col("track_id")) % 11 != 0)
    x = F.when(F.col("track_id") % 2 == 1, 300).otherwise(800) + F.col("k") * 2 + F.col("event_id") % 7
    y = F.when(F.col("track_id") <= 2, 260).otherwise(560) + F.floor(F.least(F.col("value"), F.lit(200)) / 4)
    x, y = x.cast("double"), y.cast("double")
    return t.select("match_id", "frame_num", F.col("track_id").cast("bigint").alias("track_id"), (x - 20).alias("x1"), (y - 90).alias("y1"), (x + 20).alias("x2"), y.alias("y2"))


def ball_candidates(fr: DataFrame, every: bool = False) -> DataFrame:
    """BALL_CAND: three candidates in each frame with a ball, some of unlikely size. With `every`, frames without one have a row of nulls."""
    seen, three = F.col("event_type") != "error", F.array(*map(F.lit, range(3)))
    i = (F.explode_outer(F.when(seen, three)) if every else F.explode(three)).alias("cand_idx")
    c = (fr if every else fr.where(seen)).select("match_id", "frame_num", "event_id", "k", i)
    half = (1 + (F.col("k") * 2 + F.col("cand_idx") * 31) % 200).cast("double") / 2
    x, y = (200 + 7 * F.col("k") + 300 * F.col("cand_idx")).cast("double"), (250 + F.col("event_id") % 97 * 4).cast("double")
    return c.select("match_id", "frame_num", "cand_idx", ((F.col("event_id") * 37 + F.col("cand_idx") * 29) % 100 / 100).alias("conf"), (x - half).alias("x1"), (y - half).alias("y1"), (x + half).alias("x2"), (y + half).alias("y2"))


def match_rows(fr: DataFrame, fps: float | None = None) -> DataFrame:
    """MATCHES of the derived tables: two frame sizes, and an unknown rate, 25 or 30 frames a second, unless `fps` is given."""
    n = fr.groupBy("match_id").agg(F.count(F.lit(1)).alias("total_frames"))
    rate = F.when(F.col("match_id") % 3 == 1, 25.0).when(F.col("match_id") % 3 == 2, 30.0) if fps is None else F.lit(fps)
    large = F.col("match_id") % 2 == 1
    width, height = (F.when(large, b).otherwise(a) for a, b in ((FRAME_W, LARGE_W), (FRAME_H, LARGE_H)))
    return n.select("match_id", rate.cast("double").alias("fps"), "total_frames", width.alias("frame_w"), height.alias("frame_h"))


def keypoint_rows(matches: DataFrame) -> DataFrame:
    """COURT_KEYPOINTS of the derived tables: a case of KEYPOINT_CASES for each match."""
    point = lambda r: F.struct(*(F.lit(v).alias(n) for v, n in zip(r, ("class_idx", "class_name", "kp_idx", "x", "y"), strict=True)))
    kind = F.col("match_id") % len(KEYPOINT_CASES)
    points = F.coalesce(*(F.when(kind == i, F.array(*map(point, rows))) for i, rows in enumerate(KEYPOINT_CASES) if rows))
    return matches.select("match_id", F.explode(points).alias("p")).select("match_id", "p.*")


def keypoint_answers(fr: DataFrame) -> DataFrame:
    """A key-point detector's answers for the first two frames of each match: an event for each of its first boxes, with three points, one of them at the origin for some."""
    one = fr.where(F.col("frame_num") < 6).select("match_id", "frame_num", F.struct("frame_num", F.col("event_type").alias("class_name")).alias("b"), F.struct("frame_num", F.array(
        F.struct(F.col("k").cast("double").alias("x"), (F.col("event_id") % 50).cast("double").alias("y")),
        F.struct((F.col("event_id") % 2 * 9).cast("double").alias("x"), F.lit(0.0).alias("y")),
        F.struct((F.col("k") * 2).cast("double").alias("x"), F.lit(7.0).alias("y")),
    ).alias("p")).alias("p"))
    lists = one.groupBy("match_id").agg(F.array_sort(F.collect_list("b")).alias("b"), F.array_sort(F.collect_list("p")).alias("p"))
    boxes, points = F.transform("b", lambda x: F.struct(x["class_name"].alias("class_name"))), F.transform("p", lambda x: x["p"])
    return lists.select("match_id", F.explode(F.array(F.lit(0).cast("bigint"), F.lit(1).cast("bigint"))).alias("frame_num"), boxes.alias("boxes"), F.slice(points, 1, 5).alias("points"))
