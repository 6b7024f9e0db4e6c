"""Shots and identities over streams: those of the batch operators, however the stream is cut, restarted or shuffled."""

import random

import pytest
from pyspark.sql import functions as F

from tests.test_streaming import drained
from tramline import derived as D
from tramline.operators import ball, players
from tramline.schemas import DEFAULT
from tramline.streaming import live


def stream(spark, df, schema, path, cuts, order=None):
    """A stream whose micro-batches are the frames between the cuts, in the rows' own order or shuffled."""
    rows = df.collect()
    bounds = [-1, *cuts, 10**9]
    for a, b in zip(bounds, bounds[1:]):  # noqa: B905
        part = sorted((r for r in rows if a < r.frame_num <= b), key=lambda r: (r.match_id, r.frame_num))
        if order:
            order.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.fixture(scope="module")
def frames(spark, sf_dir):
    return D.frames(spark.read.parquet(f"{sf_dir}/events.parquet")).cache()


@pytest.mark.parametrize("cuts", [[], [0, 1, 7, 90], [100, 101, 250]])
def test_live_shots(spark, frames, tmp_path, cuts):
    dets = D.ball_track(frames).select("match_id", "frame_num", F.col("cx").alias("x1"), F.col("cy").alias("y1"), F.col("cx").alias("x2"), (F.col("cy") + F.col("frame_num") % 3).alias("y2"))
    # nothing is seen at the beginning, for a long time, and at the end of some matches
    dets = dets.withColumns({c: F.when(~F.expr("match_id = 1 and frame_num < 20 or match_id = 2 and frame_num between 60 and 170 or match_id = 3 and frame_num > 190"), F.col(c)) for c in ("x1", "y1", "x2", "y2")})
    matches = D.match_rows(frames)
    filled = ball.fill_gaps(dets, ["x1", "y1", "x2", "y2"])
    want = sorted(tuple(r) for r in ball.shots(filled.withColumn("cy", F.expr("(y1 + y2) / 2"))).collect())
    got = drained(live.shots(stream(spark, live.track_rows(dets, matches), live.TRACK_FRAME, str(tmp_path / "in"), cuts, random.Random(1))), "append", f"shots{len(cuts)}_{sum(cuts)}", tmp_path)
    assert want and sorted((r.match_id, r.shot_idx, r.frame_num) for r in got.collect()) == want and got.where("late").isEmpty()


def test_turns_frame_by_frame(spark):
    """Random tracks with gaps of any length, against the batch operators."""
    rng = random.Random(9)
    rows, want = [], set()
    p = DEFAULT
    for match in range(12):
        n, y, step, out = rng.randint(30, 700), 300.0, 8.0, []
        f = 0
        while f < n:
            if rng.random() < 0.05:
                f += rng.choice([1, 3, 40, 89, 90, 91, 200])
                continue
            if rng.random() < 0.05:
                step = -step
            y += step
            rows.append((match, f, y, y + rng.randint(0, 3)))
            f += 1
        rows += [(match, g, None, None) for g in range(n) if not any(r[0] == match and r[1] == g for r in rows[-n:])]
        turns, own = ball.Turns(n, p), {r[1]: r[2:] for r in rows if r[0] == match}
        for g in range(n):
            if rng.random() < 0.2:
                turns = ball.Turns(n, p, turns.kept())
            box = own[g]
            out += turns.frame(g, None if box[0] is None else box)
            assert len(turns.changes) <= turns.ahead + 1 and len(turns.values) <= p.roll
        want |= {(match, i, g) for i, g in enumerate(out)}
    track = spark.createDataFrame(rows, "match_id bigint, frame_num bigint, y1 double, y2 double")
    filled = ball.fill_gaps(track, ["y1", "y2"])
    assert {tuple(r) for r in ball.shots(filled.withColumn("cy", F.expr("(y1 + y2) / 2"))).collect()} == want and want


@pytest.mark.parametrize("cuts", [[], [0, 1, 2, 80], [130]])
def test_live_slots(spark, frames, tmp_path, cuts):
    dets = D.player_boxes(frames).where("(frame_num + match_id) % 41 > 2 and (frame_num % 60 > 9 or track_id > 2)").withColumn("track_id", F.expr("track_id + 10 * (frame_num div 50)"))
    bounds = players.court_bounds(D.keypoint_rows(D.match_rows(frames)))
    want = sorted(tuple(r) for r in players.assign_slots(dets, bounds).collect())
    rows = live.player_rows(dets, bounds, frames)
    got = drained(live.assign_slots(stream(spark, rows, live.PLAYER_FRAME, str(tmp_path / "in"), cuts, random.Random(2))), "append", f"slots{len(cuts)}_{sum(cuts)}", tmp_path)
    assert want and sorted(tuple(r)[:-1] for r in got.collect()) == want and got.where("late").isEmpty()


def test_restart_from_a_checkpoint(spark, frames, tmp_path):
    dets, bounds = D.player_boxes(frames), players.court_bounds(D.keypoint_rows(D.match_rows(frames)))
    rows = live.player_rows(dets, bounds, frames).cache()
    place, out = str(tmp_path / "in"), str(tmp_path / "out")
    for a, b in ((-1, 50), (50, 120), (120, 10**9)):  # each a run of its own, from the same checkpoint
        rows.where((F.col("frame_num") > a) & (F.col("frame_num") <= b)).coalesce(2).write.mode("append").parquet(place)
        source = spark.readStream.schema(live.PLAYER_FRAME).parquet(place)
        q = live.assign_slots(source).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = spark.read.parquet(out).drop("late")
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in players.assign_slots(dets, bounds).collect())


def test_frames_out_of_order_wait_for_a_delay(spark, tmp_path):
    seen = lambda t, x: [[float(t), x, 50.0, x - 5, 45.0, x + 5, 55.0]]
    parts = [[(1, 0, seen(7, 10.0)), (1, 3, seen(8, 30.0))], [(1, 1, seen(7, 12.0)), (1, 2, None)], [(1, 9, seen(9, 31.0))], [(1, 4, seen(9, 33.0)), (1, 10, seen(9, 31.0))]]
    for part in parts:
        spark.createDataFrame(part, live.PLAYER_FRAME).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(live.PLAYER_FRAME).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = [(r.frame_num, r.player_id, r.late) for r in drained(live.assign_slots(source, delay=3), "append", "delayed", tmp_path).collect()]
    # 3 waits for 1 and 2; 4 comes when 9 has passed it
    assert sorted(got, key=lambda r: (r[0], r[2])) == [(0, 1, False), (1, 1, False), (3, 1, False), (4, None, True), (9, 1, False), (10, 1, False)]


def test_the_state_of_a_match_is_small():
    import json

    turns, order = ball.Turns(10**6), live.InOrder(0)
    for f in range(50_000):
        order.take(f, [1.0])
        for g, _ in order.ready():
            list(turns.frame(g, (float(g % 97), 5.0) if g % 13 and not 1000 < g < 30_000 else None))
    assert len(json.dumps({"turns": turns.kept(), "waiting": order.waiting})) < 2000
