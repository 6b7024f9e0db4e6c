"""Hand-worked cases of the match-tracking operators."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tramline.functions import geometry as G
from tests.plain_court import corners_of, solve_homography
from tramline.operators import ball, density, highlights, players, reports, stats
from tramline.schemas import DEFAULT


def one(df):
    return df.collect()[0]


def test_layout(spark):
    df = spark.createDataFrame([(1280, 720), (1920, 1080), (640, 360)], "frame_w int, frame_h int").select("frame_w", G.layout().alias("c")).select("frame_w", "c.*")
    got = {r.frame_w: (r.width, r.height, r.pad, r.buffer, r.x0, r.y0, r.x1, r.y1) for r in df.collect()}
    assert got == {1280: (120, 240, 8, 15, 1137, 457, 1257, 697), 1920: (120, 240, 9, 18, 1773, 813, 1893, 1053), 640: (70, 140, 6, 10, 554, 204, 624, 344)}


def test_scalars(spark):
    df = spark.range(1).select(
        G.whole(F.lit(-2.7)).alias("w"), G.fps_or_default(F.lit(1.0)).alias("f1"), G.fps_or_default(F.lit(None).cast("double")).alias("f0"), G.fps_or_default(F.lit(25.0)).alias("f25"),
        G.clock(F.lit(125.9)).alias("clock"), G.px_to_m(F.lit(12.0), F.lit(120)).alias("m"), G.m_to_px(F.lit(1.0), F.lit(120)).alias("px"), G.js_round(F.lit(2.5)).alias("js"),
        G.closest_by_height(F.lit(5.0), F.array(*(F.struct(F.lit(0.0).alias("x"), F.lit(y).alias("y")) for y in (1.0, 6.0, 4.0)))).alias("near"), G.zone(F.lit(20.0)).alias("z"),
    )
    assert one(df).asDict() == {"w": -2, "f1": 24.0, "f0": 24.0, "f25": 25.0, "clock": "2:05", "m": 1.0, "px": 12.0, "js": 3, "near": 1, "z": "BASELINE"}


def test_court_points(spark):
    p = one(spark.createDataFrame([(1280, 720)], "frame_w int, frame_h int").select(G.layout().alias("court")).select(G.court_points().alias("p"))).p
    assert len(p) == 13 and p["NetCenter"].x == 1197 and p["NetCenter"].y == 577 and p["TopCenter"].y == pytest.approx(577 - 6.95 * 12)


def test_gap_fill(spark):
    seen = [None, None, None, 1, None, None, None, None, None, 7, None, None, None, None]
    want = [None, 1, 1, 1, 2, 3, None, 7, 7, 7, 7, 7, None, None]
    df = spark.createDataFrame([(0, i, None if v is None else float(v)) for i, v in enumerate(seen)], "match_id long, frame_num long, v double")
    assert [r.v for r in ball.fill_gaps(df, ["v"], 2).orderBy("frame_num").collect()] == want


def test_no_ball_anywhere(spark):
    df = spark.createDataFrame([(0, i, None) for i in range(5)], "match_id long, frame_num long, cy double")
    assert ball.shots(ball.fill_gaps(df, ["cy"])).count() == 0


def sequential_shots(y, p=DEFAULT):
    n = len(y)
    k = max(p.min_persist, min(p.max_persist, n // p.persist_divisor))
    ahead = int(p.look_ahead * k)
    rolled = [np.mean([v for v in y[max(0, i - 4) : i + 1] if v is not None]) for i in range(n)]
    dy = [None] + [rolled[i] - rolled[i - 1] for i in range(1, n)]
    return [i for i in range(1, n - ahead) if dy[i] * dy[i + 1] < 0 and sum(dy[j] * dy[i] < 0 for j in range(i + 1, i + ahead + 1)) >= k - 1]


@pytest.mark.parametrize("n", [60, 300, 700])
def test_shots(spark, n):
    rng = random.Random(n)
    y, up = [300.0], 1
    for _ in range(n - 1):
        up = -up if rng.random() < 0.06 else up
        y.append(y[-1] + up * rng.choice([3, 5, 8]))
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate(y)], "match_id long, frame_num long, cy double")
    assert [r.frame_num for r in ball.shots(df).orderBy("shot_idx").collect()] == sequential_shots(y)


@pytest.mark.parametrize(
    "shots,want",
    [([0, 10, 20, 30, 40, 50], [(0, 100, 5)]), ([0, 200, 210, 220, 230, 240], [(0, 290, 5)]), ([0, 10, 20, 30, 40, 140, 150], [(0, 100, 5)]), ([0, 10, 20, 30, 40], []), ([7], []), ([], [])],
)
def test_rallies(spark, shots, want):
    s = spark.createDataFrame([(1, i, f) for i, f in enumerate(shots)], "match_id long, shot_idx long, frame_num long")
    m = spark.createDataFrame([(1, 24.0, 1000)], "match_id long, fps double, total_frames long")
    got = [(r.start_frame, r.end_frame, int(r.label.split("— ")[1].split()[0])) for r in highlights.rallies(s, m).collect()]
    assert got == want


@pytest.mark.parametrize("second,want", [((80, 140), [(0, 140)]), ((90, 150), [(0, 150)]), ((91, 150), [(0, 60), (91, 150)])])
def test_merge(spark, second, want):
    rows = [(1, 0, 0, 0, 60, 0.5, "b"), (1, 1, 5, *second, 3.5, "a")]
    h = spark.createDataFrame(rows, "match_id long, kind int, ord long, start_frame long, end_frame long, timestamp_seconds double, label string")
    got = highlights.merged(h).orderBy("start_frame").collect()
    assert [(r.start_frame, r.end_frame) for r in got] == want and got[0].timestamp_seconds == 0.5
    assert len(got) > 1 or got[0].label == "a / b"


def test_ball_choice_follows_anchor(spark):
    cands = [(0, 0, 0, 0.5, 100.0), (0, 1, 0, 0.9, 2000.0), (0, 1, 1, 0.2, 110.0), (0, 2, 0, 0.4, 2000.0), (0, 3, 0, 0.3, 120.0), (0, 3, 1, 0.3, 130.0)]
    c = spark.createDataFrame([(m, f, i, conf, x, 0.0, x + 10, 10.0) for m, f, i, conf, x in cands], "match_id long, frame_num long, cand_idx int, conf double, x1 double, y1 double, x2 double, y2 double")
    frames = spark.createDataFrame([(0, f) for f in range(5)], "match_id long, frame_num long")
    got = {r.frame_num: r.x1 for r in ball.select_ball(c, frames).collect()}
    assert got == {0: 100.0, 1: 110.0, 2: 2000.0, 3: 120.0, 4: None}


def slots_of(spark, dets):
    d = spark.createDataFrame([(0, f, t, x - 10.0, y - 10.0, x + 10.0, y + 10.0) for f, t, x, y in dets], "match_id long, frame_num long, track_id long, x1 double, y1 double, x2 double, y2 double")
    bounds = spark.createDataFrame([], "match_id long, min_x double, max_x double, min_y double, max_y double")
    return {(r.frame_num, r.player_id): (r.x1 + 10, r.slot_ord) for r in players.assign_slots(d, bounds).collect()}


def test_slots(spark):
    first = [(0, 11, 500, 100), (0, 12, 100, 100), (0, 13, 100, 500), (0, 14, 500, 500)]
    got = slots_of(spark, first + [(1, t, x, y) for _, t, x, y in first[1:]] + [(2, 99, 799, 100), (2, 12, 100, 100)] + [(3, 98, 800, 100)])
    assert [got[0, p][0] for p in (1, 2, 3, 4)] == [100, 500, 100, 500]
    assert (1, 2) not in got and got[1, 1] == (100, 0)
    assert got[2, 2] == (799, 1)  # 299 pixels away: accepted
    assert got[3, 2][0] == 800  # one pixel on


def test_slot_too_far(spark):
    first = [(0, 1, 100, 100), (0, 2, 500, 100), (0, 3, 100, 500), (0, 4, 500, 500)]
    assert slots_of(spark, first + [(1, 9, 800, 100)]).keys() == {(0, p) for p in (1, 2, 3, 4)}


def test_homography():
    src = [(300.0, 200.0), (980.0, 210.0), (1200.0, 690.0), (80.0, 680.0)]
    dst = [(1137, 457), (1257, 457), (1257, 697), (1137, 697)]
    h = solve_homography(src, dst)
    for (x, y), (u, v) in zip(src, dst):
        w = h[6] * x + h[7] * y + 1
        assert (h[0] * x + h[1] * y + h[2]) / w == pytest.approx(u) and (h[3] * x + h[4] * y + h[5]) / w == pytest.approx(v)
    assert corners_of([(80.0, 680.0), (980.0, 210.0), (1200.0, 690.0), (300.0, 200.0)]) == src
    assert corners_of([(0.0, 0.0), (399.0, 0.0), (399.0, 300.0), (0.0, 300.0)]) is None


def test_density_matches_numpy(spark):
    rng = np.random.default_rng(1)
    n = rng.integers(0, 3, (100, 100)) * (rng.random((100, 100)) < 0.02)
    rows = [(0, 1, int(i), int(j), int(n[i, j])) for i, j in zip(*np.nonzero(n))]
    got = np.zeros((100, 100))
    for r in density.smoothed(spark.createDataFrame(rows, "match_id long, player_id int, bx int, by int, n long")).collect():
        got[r.bx, r.by] = r.density
    w = np.array(density.kernel())
    v = n.astype(float)
    for axis in (0, 1):
        v = np.apply_along_axis(lambda x: np.convolve(np.pad(x, 20, mode="symmetric"), w, "valid"), axis, v)
    assert np.abs(got - v / (v.max() + 1e-8)).max() < 1e-9


def test_last_cell_is_closed(spark):
    at = spark.createDataFrame([(0, 1, 0, 10.0, 20.0), (0, 1, 1, 0.0, 0.0)], "match_id long, player_id int, frame_num long, x_m double, y_m double")
    assert {(r.bx, r.by) for r in density.bins(at).collect()} == {(99, 99), (0, 0)}
    assert one(density.gate(at)).render_mode == "density"


def test_hitter_ties_take_the_first_slot(spark):
    pos = [(0, 10, "ball", None, None, 100, 100), (0, 20, "ball", None, None, 160, 100), (0, 10, "player", 3, 0, 90, 100), (0, 10, "player", 1, 1, 110, 100)]
    p = spark.createDataFrame(pos, "match_id long, frame_num long, entity string, player_id int, slot_ord int, mx int, my int")
    m = spark.createDataFrame([(0, 24.0, 100, 1280, 720)], "match_id long, fps double, total_frames long, frame_w int, frame_h int").withColumn("court", G.layout())
    shots = spark.createDataFrame([(0, 0, 10), (0, 1, 20)], "match_id long, shot_idx long, frame_num long")
    seg = stats.segments(shots, p, m)
    hit = one(stats.attribution(seg, p))
    assert hit.hitter == 3 and hit.speed == pytest.approx(5 / (10 / 24) * 3.6)
    s = {r.player_id: r for r in stats.summary(m, p, stats.shot_events(stats.attribution(seg, p), p)).collect()}
    assert s[3].total_shots == 1 and s[1].total_shots == 0 and s[3].max_shot_speed == pytest.approx(hit.speed) and len(s) == 4


def test_jobs(spark):
    log = spark.createDataFrame([("a", 1, "queued", "q", 0, None, None), ("a", 2, "done", "d", 100, '{"highlights": [1]}', None), ("b", 1, "error", "x", 5, None, "boom")], "job_id string, seq long, status string, stage string, progress int, result string, error string").withColumn("at", F.lit("2024-01-01").cast("timestamp_ntz"))
    got = {r.job_id: r for r in reports.job_results(reports.job_status(log)).collect()}
    assert got["a"].highlights_video_url == "/outputs/a/highlights.mp4" and got["b"].error == "boom" and got["b"].video_url is None
