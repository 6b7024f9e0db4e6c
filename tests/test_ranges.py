"""Windows by ranges of frames give what windows over whole matches give."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tramline.operators import ball, court, density, ranges, stats

WHOLE = None


@pytest.fixture(scope="module")
def track(spark):
    rng = random.Random(41)
    rows = []
    for m in range(6):
        n, f, y, step = rng.randint(1, 900), 0, 300.0, 8.0
        seen = {}
        while f < n:
            if rng.random() < 0.06:
                f += rng.choice([1, 5, 39, 40, 41, 89, 90, 91, 250])  # gaps over whole ranges
                continue
            step = -step if rng.random() < 0.05 else step
            y += step
            seen[f] = (y, y + rng.random())
            f += 1
        rows += [(m, g, *seen.get(g, (None, None))) for g in range(n)]
    return spark.createDataFrame(rows, "match_id long, frame_num long, y1 double, y2 double").repartition(5).cache()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("span", [40, 41, 300])
def test_ball_track_by_ranges(track, span):
    of = lambda s, limit: ball.fill_gaps(track, ["y1", "y2"], limit, s)
    for limit in (2, 90):
        whole = of(WHOLE, limit)
        assert rows(of(span, limit)) == rows(whole)
    filled = of(WHOLE, 90).withColumn("cy", F.expr("(y1 + y2) / 2")).cache()
    assert rows(ball.velocity(filled, span=span)) == rows(ball.velocity(filled, span=WHOLE))
    shots = rows(ball.shots(filled, span=span))
    assert shots == rows(ball.shots(filled, span=WHOLE)) and shots


@pytest.mark.parametrize("span", [1, 7, 100])
def test_steps_and_trajectories_by_ranges(spark, span):
    rng = random.Random(43)
    pos = [(m, f, "player", p, p, rng.randint(1137, 1257), rng.randint(457, 697)) for m in range(3) for f in range(400) for p in range(1, 5) if rng.random() < 0.8]
    pos += [(m, f, "ball", None, None, rng.randint(1137, 1257), rng.randint(457, 697)) for m in range(3) for f in range(400) if rng.random() < 0.3]
    pos = spark.createDataFrame(pos, "match_id long, frame_num long, entity string, player_id int, slot_ord int, mx int, my int").repartition(3).cache()
    matches = court.with_layout(spark.createDataFrame([(m, None, 400, 1280, 720) for m in range(3)], "match_id long, fps double, total_frames long, frame_w int, frame_h int"))
    assert rows(stats.steps(pos, matches, span=span)) == rows(stats.steps(pos, matches, span=WHOLE))
    columns = density.trajectory(pos, matches).columns
    assert rows(density.trajectory(pos, matches, span=span).select(columns)) == rows(density.trajectory(pos, matches, span=WHOLE).select(columns))


def test_a_match_of_a_million_frames(spark):
    """No window sees more than a range, with its carried rows and copies."""
    n = 1_000_000
    far = F.expr("case when id % 97 < 60 or id between 300000 and 400000 then null else 300 + abs(id % 44 - 22) * 9D end")
    track = spark.range(n).select(F.lit(1).cast("bigint").alias("match_id"), F.col("id").alias("frame_num"), far.alias("y1"), far.alias("y2"))
    start = time.perf_counter()
    filled = ball.fill_gaps(track, ["y1", "y2"], span=ranges.SPAN).withColumn("cy", F.expr("(y1 + y2) / 2"))
    assert ball.coverage(filled, "cy").first()["frames"] == n and ball.shots(filled, span=ranges.SPAN).count() > 9_000
    assert time.perf_counter() - start < 120
    most = lambda df: df.groupBy("match_id", ranges.PART).count().agg(F.max("count")).first()[0]
    assert most(ranges.carried(track, F.col("y1"), span=ranges.SPAN)) == ranges.SPAN + 2 and most(ranges.halo(track, 5, 30, ranges.SPAN)) == ranges.SPAN + 35
    plan = ball.fill_gaps(track, ["y1"], span=ranges.SPAN)._jdf.queryExecution().optimizedPlan().toString()
    over = [line for line in plan.splitlines() if "Window" in line and "frame_num" in line]
    assert over and all(ranges.PART in line.rsplit("], [", 1)[0] for line in over)


def test_long_matches_get_ranges(spark):
    of = lambda *n: spark.createDataFrame([(i, x) for i, x in enumerate(n)], "match_id long, total_frames long")
    assert ranges.span_for(of(10, None)) is None and ranges.span_for(of()) is None and ranges.span_for(of(5, ranges.SPAN + 1)) == ranges.SPAN


def test_short_ranges_are_an_error(track):
    with pytest.raises(ValueError, match="shorter"):
        ranges.halo(track, 5, 30, 20)
