"""Highlights: fast smashes, long rallies, and their merged intervals."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..schemas import DEFAULT, Params


def _clip(center_from: Column, center_to: Column, p: Params) -> tuple[Column, Column]:
    return F.greatest(F.lit(0), center_from - p.clip_frames).cast("bigint").alias("start_frame"), F.least(F.col("total_frames") - 1, center_to + p.clip_frames).cast("bigint").alias("end_frame")


def smashes(segs: DataFrame, matches: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Segments at `smash_share` of the match's highest ball speed or more. A missing ball end counts as speed 0."""
    speed = F.coalesce(F.when(F.col("dt") > 0, F.col("px") / F.col("dt")), F.lit(0.0))
    s = segs.withColumn("speed", speed).withColumn("share", F.col("speed") / F.greatest(F.max("speed").over(Window.partitionBy("match_id")), F.lit(1.0)))
    s = s.where(F.col("share") >= p.smash_share).join(matches.select("match_id", "total_frames"), "match_id")
    start, end = _clip(F.col("sf"), F.col("sf"), p)
    label = F.concat(F.lit("Fast Smash — "), F.bround(100 * F.col("share")).cast("int").cast("string"), F.lit("% max speed"))
    return s.select("match_id", F.lit(0).alias("kind"), F.col("seg_idx").alias("ord"), start, end, G.hundredths(F.col("sf") / F.col("fps")).alias("timestamp_seconds"), label.alias("label"))


def rallies(shots: DataFrame, matches: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Runs of `rally_shots` or more shots, closed by a long pause or the last shot.

    A pause inside a run that is still too short does not start it anew, and the closing shot is not counted: a fold over the shots of a match, not a session window.
    """
    m = matches.select("match_id", G.fps_or_default("fps", p.default_fps).alias("fps"), "total_frames")
    per = shots.groupBy("match_id").agg(F.array_sort(F.collect_list("frame_num")).alias("f")).where(F.size("f") >= 2).join(m, "match_id")
    n = F.size("f")
    empty = F.expr("named_struct('st', 0, 'out', cast(array() as array<struct<st:int,i:int>>))")

    def fold(acc: Column, i: Column) -> Column:
        closes = (i - acc["st"] >= p.rally_shots) & ((F.get("f", i) - F.get("f", i - 1) > p.rally_gap_seconds * F.col("fps")) | (i == n - 1))
        grown = F.concat(acc["out"], F.array(F.struct(acc["st"].alias("st"), i.alias("i"))))
        return F.when(closes, F.struct(i.alias("st"), grown.alias("out"))).otherwise(acc)

    runs = per.withColumn("r", F.explode(F.aggregate(F.sequence(F.lit(1), n - 1), empty, fold, lambda acc: acc["out"])))
    first, last, length = F.get("f", F.col("r.st")), F.get("f", F.col("r.i") - 1), F.col("r.i") - F.col("r.st")
    start, end = _clip(first, last, p)
    label = F.concat(F.lit("Long Padel Rally — "), length.cast("string"), F.lit(" shots (inc. wall bounces)"))
    return runs.select("match_id", F.lit(1).alias("kind"), F.col("r.i").cast("bigint").alias("ord"), start, end, G.hundredths(first / F.col("fps")).alias("timestamp_seconds"), label.alias("label"))


def merged(highlights: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Intervals that touch within `merge_frames` become one: the first one's time, the latest end, all labels in order without repeats."""
    w = Window.partitionBy("match_id").orderBy("start_frame", "kind", "ord")
    before = F.max("end_frame").over(w.rowsBetween(Window.unboundedPreceding, -1))
    h = highlights.withColumn("fresh", F.when(before.isNull() | (F.col("start_frame") > before + p.merge_frames), 1).otherwise(0))
    h = h.withColumn("island", F.sum("fresh").over(w))
    out = h.groupBy("match_id", "island").agg(
        F.min("start_frame").alias("start_frame"), F.max("end_frame").alias("end_frame"), F.min_by("timestamp_seconds", F.struct("start_frame", "kind", "ord")).alias("timestamp_seconds"), F.array_join(F.array_sort(F.collect_set("label")), " / ").alias("label")
    )
    return out.drop("island")


def reel(merged_highlights: DataFrame, matches: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(match_id, seq, clip_idx, kind, frame_num): frames of the highlight film in order: for each clip a second of title, then its frames."""
    m = matches.select("match_id", G.fps_or_default("fps", p.default_fps).alias("fps"), "total_frames")
    clips = merged_highlights.join(m, "match_id").withColumn("clip_idx", (F.row_number().over(Window.partitionBy("match_id").orderBy("start_frame")) - 1).cast("bigint"))
    title = F.transform(F.sequence(F.lit(1), F.greatest(F.col("fps").cast("int"), F.lit(1))), lambda i: F.struct(F.lit("title").alias("kind"), F.col("start_frame").alias("frame_num")))
    clip = F.transform(F.sequence(F.greatest("start_frame", F.lit(0)), F.least(F.col("end_frame"), F.col("total_frames") - 1)), lambda f: F.struct(F.lit("clip").alias("kind"), f.cast("bigint").alias("frame_num")))
    flat = clips.select("match_id", "clip_idx", F.posexplode(F.concat(title, clip)).alias("i", "x"))
    seq = F.row_number().over(Window.partitionBy("match_id").orderBy("clip_idx", "i")) - 1
    return flat.select("match_id", seq.cast("bigint").alias("seq"), "clip_idx", "x.kind", "x.frame_num")


class Clips:
    """The highlights of one match from its shots and segments as they come, for a match that isn't over: what `smashes`, `rallies` and `merged` make of them at its end.

    Kept are the frames of its shots, and of its segments those that can still be fast: the highest speed only grows, so that a segment below its share never comes back.
    """

    def __init__(self, p: Params = DEFAULT, kept: dict | None = None):
        self.p = p
        kept = kept or {"shots": [], "fast": [], "top": 0.0}
        self.shots, self.fast, self.top = set(kept["shots"]), {i: (sf, v) for i, sf, v in kept["fast"]}, kept["top"]

    def kept(self) -> dict:
        return {"shots": sorted(self.shots), "fast": [(i, sf, v) for i, (sf, v) in self.fast.items()], "top": self.top}

    def shot(self, frame: int) -> None:
        self.shots.add(frame)

    def segment(self, idx: int, sf: int, dt: float | None, px: float | None) -> None:
        speed = px / dt if px is not None and dt is not None and dt > 0 else 0.0
        self.top = max(self.top, speed)
        self.fast[idx] = (sf, speed)
        self.fast = {i: x for i, x in self.fast.items() if x[1] / max(self.top, 1.0) >= self.p.smash_share}

    def merged(self, fps: float, total_frames: int) -> list[tuple[int, int, float, str]]:
        """(start_frame, end_frame, timestamp_seconds, label) of the match, in order."""
        p, out = self.p, []
        clip = lambda a, b: (max(0, a - p.clip_frames), min(total_frames - 1, b + p.clip_frames))
        seconds = lambda frame: math.floor(frame / fps * 100 + 0.5) / 100
        for idx, (sf, speed) in self.fast.items():
            out.append((clip(sf, sf), 0, idx, seconds(sf), f"Fast Smash — {round(100 * (speed / max(self.top, 1.0)))}% max speed"))
        f, since = sorted(self.shots), 0
        for i in range(1, len(f)):
            if i - since >= p.rally_shots and (f[i] - f[i - 1] > p.rally_gap_seconds * fps or i == len(f) - 1):
                out.append((clip(f[since], f[i - 1]), 1, i, seconds(f[since]), f"Long Padel Rally — {i - since} shots (inc. wall bounces)"))
                since = i
        islands: list[list] = []
        for (start, end), _, _, at, label in sorted(out, key=lambda c: (c[0][0], *c[1:3])):
            if islands and start <= islands[-1][1] + p.merge_frames:
                islands[-1][1] = max(islands[-1][1], end)
                islands[-1][3].add(label)
            else:
                islands.append([start, end, at, {label}])
        return [(a, b, at, " / ".join(sorted(labels))) for a, b, at, labels in islands]
