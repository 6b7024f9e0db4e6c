"""Rows are dealt by match as seldom as can be: exchanges in the plans when nothing is broadcast, as with many matches."""

import random

import pytest
from pyspark.sql import functions as F
from tramline import queries
from tramline.operators import ball, court, stats
from tramline.plans import staging
from tramline.plans.match import Analysis
from tramline.schemas import BALL_CAND, BALL_DET, COURT_KEYPOINTS, DEFAULT, MATCHES, PLAYER_SLOT, POSITIONS


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return plan(df).count("Exchange hashpartitioning")


def test_ball_choice_deals_its_rows_once(no_broadcast):
    cands, frames = (no_broadcast.createDataFrame([], s) for s in (BALL_CAND, "match_id bigint, frame_num bigint"))
    assert exchanges(ball.select_ball(cands, frames)) == 1 and exchanges(ball.select_ball(cands)) == 1


def test_steps_deal_positions_once(no_broadcast):
    pos, matches = (no_broadcast.createDataFrame([], s) for s in (POSITIONS, MATCHES))
    assert exchanges(stats.steps(pos, court.with_layout(matches))) == 2  # positions, matches


def test_feet_are_summed_before_they_move(no_broadcast):
    matches, keypoints, feet = (no_broadcast.createDataFrame([], s) for s in (MATCHES, COURT_KEYPOINTS, "match_id bigint, foot_x double, foot_y double"))
    assert "LeftAnti" not in plan(court.homographies(matches, keypoints, feet))


def test_chosen_balls_are_not_joined_to_their_frames_again(no_broadcast):
    matches, keypoints, slots, balls = (no_broadcast.createDataFrame([], s) for s in (MATCHES, COURT_KEYPOINTS, PLAYER_SLOT, BALL_DET))
    with staging.Stages(no_broadcast) as stages:
        a = Analysis(matches, keypoints, slots, balls, balls.select("match_id", "frame_num"), stages=stages, is_dense=True)
        a.summary  # noqa: B018
        assert stages.count == 6  # courts, ball, shots, positions, those at shots, segments: each read from files
        assert "Window" not in plan(a.positions) + plan(a.shot_events)


@pytest.mark.parametrize("seed", range(4))
def test_rows_of_frames_stand_for_frames(spark, seed):
    """A list of frames, or a row of nulls in each frame without candidates, gives the same; candidates of other frames don't count."""
    r = random.Random(seed)
    listed = sorted(r.sample(range(60), 45))
    cands = [(1, f, i, r.choice([None, 0.0, 0.3, 0.5, float("nan"), 0.9]), x := r.uniform(0, 1500), 5.0, x + r.choice([0.5, 20.0, 200.0]), 25.0) for f in listed if r.random() < 0.7 for i in range(r.randint(1, 3))]
    other = [(1, f, 0, 0.95, 9.0, 5.0, 29.0, 25.0) for f in range(60) if f not in listed] + [(2, 0, 0, 0.9, 0.0, 0.0, 9.0, 9.0)]
    frames = spark.createDataFrame([(1, f) for f in listed], "match_id bigint, frame_num bigint")
    none = [(1, f, None, None, None, None, None, None) for f in set(listed) - {c[1] for c in cands}]
    by_list = ball.select_ball(spark.createDataFrame(cands + other, BALL_CAND).repartition(3), frames)
    by_rows = ball.select_ball(spark.createDataFrame(cands + none, BALL_CAND).repartition(3))
    want, anchor = [], ball.Anchor(DEFAULT)
    for f in listed:
        seen = [(c[3], list(c[4:])) for c in cands if c[1] == f and c[3] is not None and not c[3] <= 0 and 1 <= c[6] - c[4] <= 150]
        want.append((1, f, *(anchor.choose(seen) or (None,) * 4)))
    got = [[tuple(x) for x in df.orderBy("frame_num").collect()] for df in (by_list, by_rows)]
    assert got == [want, want]


def test_positions_at_shots(spark):
    pos = spark.createDataFrame([(1, f, e, p, 0, f, 7) for f in range(5) for e, p in (("player", 1), ("player", 2), ("ball", None))], POSITIONS)
    shots = spark.createDataFrame([(1, 0, 1), (1, 1, 3), (2, 0, 2)], "match_id bigint, shot_idx bigint, frame_num bigint")
    got = stats.at_shots(pos, shots)
    assert got.columns == pos.columns and {(r.match_id, r.frame_num): r.n for r in got.groupBy("match_id", "frame_num").agg(F.count(F.lit(1)).alias("n")).collect()} == {(1, 1): 3, (1, 3): 3}


def test_steps_in_order_get_tasks_by_number(spark, sf_dir):
    """However few bytes a frame has: what is sorted is made of it after it was dealt."""
    for query in (queries.ball_select_stateful, queries.player_slots):
        assert "REPARTITION_BY_NUM" in plan(query(spark, sf_dir))
