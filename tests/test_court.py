"""Corners and maps in columns against plain code."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.plain_court import corners_of, solve_homography
from tramline import derived as D
from tramline.functions import geometry as G
from tramline.operators import court
from tramline.schemas import COURT_KEYPOINTS


def cases():
    rng = random.Random(17)
    grid = [0.0, 100.0, 300.0, 300.0, 640.0, 900.0, 1280.0]
    out = [[(rng.choice(grid), rng.choice(grid)) for _ in range(rng.randint(0, 9))] for _ in range(1500)]
    out += [[(rng.uniform(0, 1280), rng.uniform(0, 720)) for _ in range(rng.randint(4, 12))] for _ in range(1500)]
    three = [(0.0, 0.0), (1000.0, 0.0), (1000.0, 0.0), (500.0, 600.0), (0.0, 0.0)]  # five points of which three are extreme
    return [*out, three, [(0.0, 0.0), (900.0, 0.0), (450.0, 100.0), (450.0, 600.0)], [(100.0, 100.0), (600.0, 350.0), (1100.0, 600.0), (1200.0, 650.0)]]


def real(pts):
    """Points at the origin are none."""
    return [q for q in pts if q[0] > 0 or q[1] > 0]


@pytest.fixture(scope="module")
def solved(spark):
    given = cases()
    k = spark.createDataFrame([(i, 0, "court", n, x, y) for i, pts in enumerate(given) for n, (x, y) in enumerate(pts)], COURT_KEYPOINTS).repartition(3)
    m = court.with_layout(spark.range(len(given)).select(F.col("id").alias("match_id"), F.lit(1280).alias("frame_w"), F.lit(720).alias("frame_h")))
    found = court.projective(court.quads(k).join(m.select("match_id", "court"), "match_id")).where("h is not null")
    return {r.match_id: r.corners for r in court.corners(k).collect()}, {r.match_id: r for r in found.collect()}


def test_corners(solved):
    for i, pts in enumerate(cases()):
        want = corners_of(real(pts))
        assert solved[0].get(i) == (None if want is None else [v for q in want for v in q]), pts


def test_maps(solved):
    none = some = 0
    for i, pts in enumerate(cases()):
        found, r = corners_of(real(pts)), solved[1].get(i)
        if found is None:
            assert r is None
            continue
        dst = [(1137, 457), (1257, 457), (1257, 697), (1137, 697)]
        want = solve_homography(found, dst)
        if want is None and r is not None:  # plain code divides by the last number, which is none where the origin has no image
            assert abs(r.h[8]) < 1e-9 * max(map(abs, r.h)), pts
            want = r.h
        elif want is None:
            none += 1
            continue
        some += 1
        assert r is not None, pts
        h = np.array(r.h).reshape(3, 3)
        points = np.array([*found, tuple(np.mean(found, axis=0))]).T
        at = h @ np.vstack([points, np.ones(5)])
        plain = np.array(want).reshape(3, 3) @ np.vstack([points, np.ones(5)])
        assert np.abs(at[:2] / at[2] - plain[:2] / plain[2]).max() < 1e-3, pts
    assert none > 50 and some > 500


def test_no_python_in_the_plan(spark, sf_dir):
    fr = D.frames(spark.read.parquet(f"{sf_dir}/events.parquet"))
    m = D.match_rows(fr)
    feet = D.player_boxes(fr).select("match_id", F.col("x1").alias("foot_x"), F.col("y2").alias("foot_y"))
    plan = court.homographies(m, D.keypoint_rows(m), feet)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_flat_points(spark):
    df = spark.sql("SELECT map('net', array(struct(1.0D x, 2.0D y)), 'court', array(struct(3.0D x, 4.0D y), struct(5.0D x, 6.0D y))) m, cast(map() as map<string, array<struct<x: double, y: double>>>) e")
    got = df.select(G.flat_points("m").alias("m"), G.flat_points("e").alias("e")).first()
    assert [tuple(q) for q in got.m] == [(1.0, 2.0), (3.0, 4.0), (5.0, 6.0)] and got.e == []
