"""Reports on top of the player summary: teams, head to head, HUD values, the analysis document and jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from . import jobs

METRICS = ("total_shots", "avg_shot_speed", "max_shot_speed", "avg_player_speed", "distance_covered")


def rounded(summary: DataFrame) -> DataFrame:
    return summary.withColumns({c: G.hundredths(c) for c in METRICS[1:]})


def team_totals(summary: DataFrame) -> DataFrame:
    """(match_id, team, ...): players 1 and 2 are team A, 3 and 4 team B; mean speeds and distance as whole numbers."""
    team = F.when(F.col("player_id") <= 2, "A").otherwise("B").alias("team")
    return rounded(summary).groupBy("match_id", team).agg(
        F.sum("total_shots").alias("total_shots"), G.js_round(F.avg("avg_shot_speed")).alias("avg_shot_speed"), F.max("max_shot_speed").alias("max_shot_speed"),
        G.js_round(F.avg("avg_player_speed")).alias("avg_player_speed"), G.js_round(F.sum("distance_covered")).alias("distance_covered"),
    )


def head_to_head(teams: DataFrame) -> DataFrame:
    """(match_id, metric, a, b, pct_a, pct_b, leader): both teams side by side, each metric a row; A leads on ties."""
    values = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in METRICS))).alias("x")
    tall = teams.select("match_id", "team", values).select("match_id", "team", "x.*")
    side = lambda t: F.coalesce(F.max(F.when(F.col("team") == t, F.col("v"))), F.lit(0.0))
    out = tall.groupBy("match_id", "metric").agg(side("A").alias("a"), side("B").alias("b"))
    share = G.js_round(100 * F.col("a") / F.greatest(F.col("a") + F.col("b"), F.lit(1.0)))
    return out.withColumns({"pct_a": share, "pct_b": 100 - share, "leader": F.when(F.col("a") >= F.col("b"), "A").otherwise("B")})


def hud_team_stats(stats: DataFrame) -> DataFrame:
    """(match_id, frame_num, and four measures of each team): means of the team's two players in each frame."""
    keep = {"last_shot_speed": "shot", "last_player_speed": "player", "average_shot_speed": "avg_shot", "average_player_speed": "avg_player"}

    def mean(column: str, low: int) -> Column:
        value = lambda i: F.coalesce(F.max(F.when(F.col("player_id") == i, F.nanvl(column, F.lit(0.0)))), F.lit(0.0))
        return (value(low) + value(low + 1)) / 2

    return stats.groupBy("match_id", "frame_num").agg(*(mean(c, low).alias(f"{name}_{team}") for team, low in (("a", 1), ("b", 3)) for c, name in keep.items()))


def documents(matches: DataFrame, summary: DataFrame, highlights: DataFrame) -> DataFrame:
    """(match_id, document): the analysis of each match as JSON."""
    row = F.struct(*METRICS)
    players = rounded(summary).groupBy("match_id").agg(*(F.max(F.when(F.col("player_id") == i, row)).alias(f"player_{i}") for i in range(1, 5)))
    clips = highlights.groupBy("match_id").agg(F.array_sort(F.collect_list(F.struct("start_frame", "end_frame", "timestamp_seconds", "label"))).alias("highlights"))
    doc = matches.select("match_id", "total_frames", G.fps_or_default("fps").alias("fps")).join(players, "match_id", "left").join(clips, "match_id", "left")
    body = F.struct(*(f"player_{i}" for i in range(1, 5)), F.coalesce("highlights", F.array().cast(highlights_type())).alias("highlights"), "total_frames", "fps")
    return doc.select("match_id", F.to_json(body).alias("document"))


def highlights_type() -> str:
    from ..schemas import HIGHLIGHT

    return f"array<struct<{HIGHLIGHT}>>"


def document_type() -> str:
    player = "struct<total_shots: bigint, avg_shot_speed: double, max_shot_speed: double, avg_player_speed: double, distance_covered: double>"
    return "struct<" + ", ".join(f"player_{i}: {player}" for i in range(1, 5)) + f", highlights: {highlights_type()}, total_frames: bigint, fps: double>"


def parsed(documents: DataFrame, column: str = "document") -> DataFrame:
    """`documents` with its JSON column read back into columns: player_1..4, highlights, total_frames, fps. Text that isn't JSON gives nulls."""
    return documents.withColumn("_doc", F.from_json(column, document_type())).select(*(c for c in documents.columns if c != column), "_doc.*")


def summary_of(documents: DataFrame) -> DataFrame:
    """(match_id, player_id, metrics, total_frames, fps, n_highlights) from parsed documents."""
    players = F.explode(F.array(*(F.struct(F.lit(i).alias("player_id"), f"player_{i}.*") for i in range(1, 5)))).alias("p")
    return documents.select("match_id", "total_frames", "fps", F.size("highlights").alias("n_highlights"), players).select("match_id", "p.*", "total_frames", "fps", "n_highlights")


def job_status(events: DataFrame) -> DataFrame:
    """(job_id, status, stage, progress, result, error, created_at, updated_at): the state of each job from an append-only log of (job_id, seq, ...)."""
    return jobs.state(events)


def job_results(status: DataFrame) -> DataFrame:
    """(job_id, status, result fields): the result is shown only of finished jobs; links point below the job's folder, and there is no film without highlights."""
    done = (F.col("status") == "done") & F.col("result").isNotNull()
    link = lambda name: F.when(done, F.concat(F.lit("/outputs/"), "job_id", F.lit("/"), F.lit(name)))
    has_clips = F.coalesce(F.json_array_length(F.get_json_object("result", "$.highlights")), F.lit(0)) > 0
    return status.select(
        "job_id", "status", F.when(done, F.col("result")).alias("result"), link("video.mp4").alias("video_url"), *(link(f"heatmap_p{i}.png").alias(f"heatmap_p{i}_url") for i in range(1, 5)), F.when(has_clips, link("highlights.mp4")).alias("highlights_video_url"),
        link("shot_map.png").alias("shot_map_url"), F.when(F.col("status") == "error", F.col("error")).alias("error"),
    )
