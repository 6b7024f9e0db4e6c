"""Sources, jobs, the entry of a job, and the steps in frame order against plain loops."""

import json
import random
import threading
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.plain_court import corners_of, solve_homography
from tramline import derived as D
from tramline.operators import ball, court, jobs, players, reports
from tramline.plans import staging
from tramline.plans.match import Analysis, analyse
from tramline.plans.process import Inputs, process, run_job
from tramline.schemas import BALL_CAND, DEFAULT, PLAYER_DET
from tramline.sources import tracking as T


@pytest.fixture(scope="module")
def frames(spark, sf_dir):
    return D.frames(spark.read.parquet(f"{sf_dir}/events.parquet")).where("frame_num < 60 and match_id < 2").cache()


def inputs(frames):
    m = D.match_rows(frames)
    return Inputs(m, frames.select("match_id", "frame_num"), D.keypoint_rows(m), D.player_boxes(frames), D.ball_candidates(frames))


def test_long_match_is_filled_in_linear_time(spark):
    track = spark.range(100_000).select(F.lit(1).alias("match_id"), F.col("id").alias("frame_num"), F.when(F.col("id") % 7 < 3, F.col("id").cast("double")).alias("v"))
    start = time.perf_counter()
    got = ball.fill_gaps(track, ["v"]).agg(F.count("v"), F.sum(F.abs(F.col("v") - F.col("frame_num")))).first()
    assert got[0] == 100_000 and got[1] < 10 and time.perf_counter() - start < 10


def test_singular_courts_fall_back():
    line = [(100.0, 100.0), (600.0, 350.0), (1100.0, 600.0), (1200.0, 650.0)]
    dst = [(0, 0), (10, 0), (10, 20), (0, 20)]
    assert corners_of(line) is not None and solve_homography(corners_of(line), dst) is None
    assert solve_homography([(0.0, 0.0)] * 4, dst) is None
    # of equal heights the first in the order of the points counts, not the most extreme one
    points = [(500.0, 300.0), (0.0, 0.0), (900.0, 0.0), (900.0, 600.0), (0.0, 600.0)]
    assert corners_of(points) == [(0.0, 0.0), (900.0, 0.0), (900.0, 600.0), (0.0, 600.0)]


@pytest.mark.parametrize("feet,identity", [([(5.0, 5.0)] * 6, True), ([(float(i), 7.0) for i in range(9)], True), ([(0.0, 0.0), (10.0, 20.0), (3.0, 4.0)], True), ([(0.0, 0.0), (10.0, 20.0), (3.0, 4.0), (1.0, 1.0)], False)])
def test_feet_in_a_line_give_the_identity(spark, feet, identity):
    m = spark.createDataFrame([(0, None, 10, 1280, 720)], "match_id long, fps double, total_frames long, frame_w int, frame_h int")
    f = spark.createDataFrame([(0, x, y) for x, y in feet], "match_id long, foot_x double, foot_y double")
    h = court.homographies(m, spark.createDataFrame([], "match_id long, class_idx int, class_name string, kp_idx int, x double, y double"), f).first().h
    assert (h == [1.0, 0, 0, 0, 1.0, 0, 0, 0, 1.0]) == identity


def plain_slots(frames_of, p=DEFAULT):
    """Slots by a loop over all frames of a match: {frame: {track: (cx, cy)}} to [(frame, slot, order, track)]."""
    track, place, out = {i: None for i in (1, 2, 3, 4)}, {i: None for i in (1, 2, 3, 4)}, []
    for frame in range(max(frames_of, default=-1) + 1):
        seen = dict(frames_of.get(frame, {}))
        got = {}
        for s in (1, 2, 3, 4):
            if track[s] in seen:
                got[s] = track[s]
                place[s] = seen.pop(track[s])
        empty = [s for s in (1, 2, 3, 4) if s not in got]
        if len(empty) == 4 and all(x is None for x in place.values()) and len(seen) >= 4:
            for s, t in zip((1, 2, 3, 4), sorted(seen, key=lambda t: (seen[t][1], seen[t][0], t))):
                got[s] = track[s] = t
                place[s] = seen[t]
        else:
            for s in empty:
                if place[s] is None:
                    if seen:
                        t = min(seen)
                        got[s] = track[s] = t
                        place[s] = seen.pop(t)
                    continue
                best = min(((((x - place[s][0]) ** 2 + (y - place[s][1]) ** 2) ** 0.5, t) for t, (x, y) in sorted(seen.items())), key=lambda z: z[0], default=None)
                if best and best[0] < p.slot_accept:
                    got[s] = track[s] = best[1]
                    place[s] = seen.pop(best[1])
                else:
                    track[s] = None
        out += [(frame, s, k, t) for k, (s, t) in enumerate(got.items())]
    return out


def test_slots_match_a_plain_loop(spark):
    rng = random.Random(31)
    rows, want = [], []
    for match in range(12):
        of, ids = {}, [rng.randint(1, 6) for _ in range(4)]
        at = [(200, 100), (900, 100), (200, 500), (900, 500)]
        for frame in range(80):
            if rng.random() < 0.12:
                continue  # nothing is seen
            for k in range(4):
                if rng.random() < 0.1:
                    ids[k] = rng.randint(1, 40)  # the tracker loses a player
                if rng.random() < 0.05:
                    at[k] = (rng.randint(20, 1000), rng.randint(20, 600))  # inside the court
                if rng.random() < 0.85:
                    of.setdefault(frame, {})[ids[k]] = (at[k][0] + rng.randint(-9, 9), at[k][1] + rng.randint(-9, 9))
        rows += [(match, f, t, x - 5.0, y - 5.0, x + 5.0, y + 5.0) for f, seen in of.items() for t, (x, y) in seen.items()]
        want += [(match, *w) for w in plain_slots(of)]
    dets = spark.createDataFrame(rows, PLAYER_DET).repartition(5)
    bounds = spark.createDataFrame([], "match_id long, min_x double, max_x double, min_y double, max_y double")
    where = {(m, f, x1, y1): t for m, f, t, x1, y1, _, _ in rows}
    got = [(r.match_id, r.frame_num, r.player_id, r.slot_ord, where[r.match_id, r.frame_num, r.x1, r.y1]) for r in players.assign_slots(dets, bounds).collect()]
    assert sorted(got) == sorted(want)


def test_ball_choice_matches_a_plain_loop(spark):
    rng = random.Random(32)
    rows, want = [], {}
    for match in range(8):
        at, misses = None, 0
        for frame in range(60):
            cands = [(rng.choice([0.2, 0.4, 0.4, 0.9]), float(rng.choice([100, 300, 1200, 2500])), float(rng.randint(0, 300))) for _ in range(rng.choice([0, 0, 1, 2, 3]))]
            rows += [(match, frame, i, c, x - 4, y - 4, x + 4, y + 4) for i, (c, x, y) in enumerate(cands)]
            near = [c for c in cands if at is None or ((c[1] - at[0]) ** 2 + (c[2] - at[1]) ** 2) ** 0.5 <= 800]
            pick = max(near, key=lambda c: c[0], default=None)
            if pick:
                at, misses = pick[1:], 0
            else:
                misses += 1
                at = None if misses >= 5 else at
                pick = max(cands, key=lambda c: c[0], default=None)
            want[match, frame] = pick and pick[1] - 4
    frames = spark.range(8 * 60).selectExpr("id div 60 as match_id", "id % 60 as frame_num")
    got = {(r.match_id, r.frame_num): r.x1 for r in ball.select_ball(spark.createDataFrame(rows, BALL_CAND).repartition(4), frames).collect()}
    assert got == want


def test_key_points_from_a_detector(spark):
    rows = [(1, 0, [("a",), ("b",), ("a",), ("c",)], [[(1.0, 2.0), (0.0, 0.0)], [(3.0, 4.0)], [(5.0, 0.0)]]), (1, 1, [("z",)], [[(9.0, 9.0)]]), (2, 0, None, None)]
    dets = spark.createDataFrame(rows, "match_id long, frame_num long, boxes array<struct<class_name: string>>, points array<array<struct<x: double, y: double>>>")
    got = sorted(tuple(r) for r in T.keypoints_from(dets).collect())
    assert got == [(1, 0, "a", 0, 1.0, 2.0), (1, 0, "a", 1, 5.0, 0.0), (1, 1, "b", 0, 3.0, 4.0)]


def test_read_or_detect(spark, frames, tmp_path):
    calls = []

    def detect():
        calls.append(1)
        return D.player_boxes(frames)

    path = str(tmp_path / "dets")
    first = T.read_or_detect(spark, path, PLAYER_DET, detect)
    again = T.read_or_detect(spark, path, PLAYER_DET, detect, max_frames=20)
    assert len(calls) == 1 and first.count() == D.player_boxes(frames).count() and again.agg(F.max("frame_num")).first()[0] == 19
    assert {tuple(r) for r in first.collect()} == {tuple(r) for r in D.player_boxes(frames).select(first.columns).collect()}
    T.read_or_detect(spark, path, PLAYER_DET, detect, read=False)
    assert len(calls) == 2
    with pytest.raises(ValueError, match="not match_id"):
        T.read_or_detect(spark, path, BALL_CAND, detect)
    assert T.read_or_detect(spark, None, PLAYER_DET, detect, max_frames=1).where("frame_num > 0").isEmpty()


def test_detectors(spark, frames):
    def detector():
        before = []

        def detect(part):
            out = part[["match_id", "frame_num"]].copy()
            assert not before or before[-1] < out["frame_num"].iloc[0]
            before.extend(out["frame_num"])
            out["track_id"] = range(len(before) - len(out), len(before))
            return out.assign(x1=0.0, y1=0.0, x2=1.0, y2=1.0, class_name=["person" if f % 2 else "dog" for f in out["frame_num"]])

        return detect

    got = T.detect_players(frames.select("match_id", "frame_num"), detector)
    assert got.where("track_id <> frame_num or frame_num % 2 = 0").isEmpty() and got.count() == 60
    balls = T.detect_balls(frames.select("match_id", "frame_num"), lambda b: b.assign(cand_idx=0, conf=[0.01 * (f % 10) for f in b["frame_num"]], x1=0.0, y1=0.0, x2=1.0, y2=1.0))
    assert balls.where("conf < 0.05").isEmpty() and balls.count() == 60


def test_job_log(spark, tmp_path):
    log = jobs.JobLog(spark, "jobs_of_test", str(tmp_path / "jobs")).create().create()
    log.update("nobody", "processing")
    assert log.get("nobody") is None
    log.insert("a")
    assert {k: log.get("a")[k] for k in ("status", "stage", "progress", "result", "error")} == {"status": "queued", "stage": "Queued", "progress": 0, "result": None, "error": None}
    with pytest.raises(ValueError, match="exists"):
        log.insert("a")
    log.update("a", "processing", "Working", 40)
    log.fail("a", "boom")
    assert (log.get("a")["status"], log.get("a")["progress"], log.get("a")["error"]) == ("error", 40, "boom")
    log.complete("a", {"n": 1})
    got = log.get("a")
    assert (got["status"], got["stage"], got["progress"], json.loads(got["result"]), got["error"]) == ("done", "Done", 100, {"n": 1}, "boom")
    assert log.jobs().count() == 1 and got["created_at"] < got["updated_at"]
    spark.sql("DROP TABLE jobs_of_test")


def test_process(spark, frames, tmp_path):
    told = []
    staging.release(spark)  # what other tests have left
    given = inputs(frames)
    paths = process(given, str(tmp_path / "out"), lambda stage, percent: told.append(percent), max_frames=50)
    assert told == sorted(told) and told[0] == 5 and told[-1] == 100 and staging.release(spark) == 0
    assert spark.read.parquet(paths["frame_stats"]).agg(F.max("frame_num")).first()[0] == 49
    back = T.read_documents(spark, paths["analysis"])
    a = analyse(*(x.where("frame_num < 50") if "frame_num" in x.columns else x for x in (D.match_rows(frames.where("frame_num < 50")), given.keypoints, given.players, given.balls, given.frames)))
    columns = ["match_id", "player_id", *reports.METRICS]
    assert {tuple(r) for r in reports.summary_of(back).select(columns).collect()} == {tuple(r) for r in reports.rounded(a.summary).select(columns).collect()}
    assert isinstance(a, Analysis) and staging.release(spark) > 0


def test_failed_jobs_tell_why(spark, frames, tmp_path):
    log = jobs.JobLog(spark, "jobs_of_runs", str(tmp_path / "jobs")).create()
    log.insert("empty")
    nothing = inputs(frames.where("false"))
    nothing.players = lambda: pytest.fail("detected without frames")
    assert run_job(log, "empty", nothing, str(tmp_path / "out")) is None
    got = log.get("empty")
    assert (got["status"], got["stage"], got["progress"], got["error"]) == ("error", "Error", 5, "Input video contains no readable frames.")
    log.insert("broken")
    bad = inputs(frames)
    bad.balls = lambda: (_ for _ in ()).throw(RuntimeError("no detector"))
    assert run_job(log, "broken", bad, str(tmp_path / "out")) is None and log.get("broken")["error"] == "no detector" and log.get("broken")["progress"] == 20
    spark.sql("DROP TABLE jobs_of_runs")


def test_jobs_side_by_side(spark, frames, tmp_path):
    """Two jobs in threads both finish, a failing one beside them leaves nothing, and none deletes another's stages."""
    place = Path(staging.shared_folder(spark).removeprefix("file:"))
    before = set(place.glob("tramline-*"))
    kept = staging.Stages(spark)
    other = kept.staged(spark.range(7))
    log = jobs.JobLog(spark, "jobs_side_by_side", str(tmp_path / "jobs")).create()
    names = ("one", "two", "broken")
    for name in names:
        log.insert(name)
    done = {}

    def work(name):
        given = inputs(frames.where("match_id = 0"))
        if name == "broken":
            given.matches = given.matches.withColumn("fps", F.expr("if(true, cast(raise_error('no rate') as double), fps)"))
        done[name] = run_job(log, name, given, str(tmp_path / "out"), max_frames=30)

    threads = [threading.Thread(target=work, args=(n,)) for n in names]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert done["broken"] is None and "no rate" in log.get("broken")["error"]
    for name in ("one", "two"):
        assert log.get(name)["status"] == "done" and spark.read.parquet(done[name]["frame_stats"]).count() == 120
    assert other.count() == 7 and set(place.glob("tramline-*")) - before == {Path(kept._folder.removeprefix("file:"))}
    assert kept.release() == 1 and set(place.glob("tramline-*")) == before
    spark.sql("DROP TABLE jobs_side_by_side")
