"""The analysis of matches: detections in, tables out.

Courts (a row for each match), the filled ball, shots, positions, those in frames of shots, and segments are staged once when first asked for; the rest is declared and left
to Spark. What is staged is read by several branches, and has a size that Spark knows: it broadcasts courts and shots while they are small, where the estimate of a chain of windows
and joins would have it deal every position anew. Windows and ordered steps all partition by match_id.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ball, court, density, highlights, players, reports, stats
from ..schemas import DEFAULT, Params
from .staging import Stages, of_session


@dataclass
class Analysis:
    """Every stage's table; each property is a DataFrame that Spark runs when asked."""

    matches: DataFrame
    keypoints: DataFrame
    slots: DataFrame
    ball_dets: DataFrame
    frames: DataFrame
    params: Params = DEFAULT
    #: Where courts, ball, shots, positions and segments are staged: those of the session unless a job owns them.
    stages: Stages | None = None
    #: Whether `ball_dets` has a row for every frame already.
    is_dense: bool = False

    def _staged(self, df: DataFrame) -> DataFrame:
        return (self.stages or of_session(df.sparkSession)).staged(df)

    @cached_property
    def courts(self) -> DataFrame:
        feet = self.slots.select("match_id", F.expr("(x1 + x2) / 2").alias("foot_x"), F.col("y2").alias("foot_y"))
        return self._staged(court.homographies(self.matches, self.keypoints, feet, self.params))

    @cached_property
    def dims(self) -> DataFrame:
        """Matches with the layout of their plan: what all but the projection need of them."""
        return self.courts.drop("h")

    @cached_property
    def ball(self) -> DataFrame:
        track = self.ball_dets if self.is_dense else ball.dense(self.frames, self.ball_dets)
        return self._staged(ball.fill_gaps(track, ["x1", "y1", "x2", "y2"], self.params.gap_limit, self.params.span))

    @cached_property
    def shots(self) -> DataFrame:
        return self._staged(ball.shots(self.ball.withColumn("cy", F.expr("(y1 + y2) / 2")), "cy", self.params, self.params.span))

    @cached_property
    def positions(self) -> DataFrame:
        return self._staged(court.positions(self.courts, self.slots, self.ball))

    @cached_property
    def shot_positions(self) -> DataFrame:
        return self._staged(stats.at_shots(self.positions, self.shots))

    @cached_property
    def segments(self) -> DataFrame:
        return self._staged(stats.segments(self.shots, self.shot_positions, self.dims, self.params))

    @cached_property
    def attribution(self) -> DataFrame:
        return stats.attribution(self.segments, self.shot_positions, self.params)

    @cached_property
    def shot_events(self) -> DataFrame:
        return stats.shot_events(self.attribution, self.shot_positions, self.params)

    @cached_property
    def frame_stats(self) -> DataFrame:
        return stats.frame_stats(self.frames, self.shot_events, self.params)

    @cached_property
    def summary(self) -> DataFrame:
        return stats.summary(self.dims, self.positions, self.shot_events, self.params)

    @cached_property
    def highlight_parts(self) -> DataFrame:
        return highlights.smashes(self.segments, self.dims, self.params).unionByName(highlights.rallies(self.shots, self.dims, self.params))

    @cached_property
    def highlights(self) -> DataFrame:
        return highlights.merged(self.highlight_parts, self.params)

    @cached_property
    def reel(self) -> DataFrame:
        return highlights.reel(self.highlights, self.dims, self.params)

    @cached_property
    def court_positions(self) -> DataFrame:
        return density.court_positions(self.positions, self.dims, self.params)

    @cached_property
    def heatmap(self) -> DataFrame:
        return density.smoothed(density.bins(self.court_positions, self.params), self.params)

    @cached_property
    def trajectory(self) -> DataFrame:
        return density.trajectory(self.positions, self.dims, self.params, self.params.span)

    @cached_property
    def documents(self) -> DataFrame:
        return reports.documents(self.dims, self.summary, self.highlights)


def analyse(matches: DataFrame, keypoints: DataFrame, player_dets: DataFrame, ball_cands: DataFrame, frames: DataFrame | None, params: Params = DEFAULT, stages: Stages | None = None) -> Analysis:
    """From raw detections: the two order-dependent steps (ball choice, slots) run first, a match at a time. Without `frames`, `ball_cands` holds a row of each frame."""
    stages = stages or of_session(player_dets.sparkSession)
    slots = stages.staged(players.assign_slots(player_dets, players.court_bounds(keypoints, params), params))
    balls = stages.staged(ball.select_ball(ball_cands, frames, params))
    return Analysis(matches, keypoints, slots, balls, balls.select("match_id", "frame_num") if frames is None else frames, params, stages, is_dense=True)
