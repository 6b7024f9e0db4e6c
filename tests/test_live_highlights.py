"""Highlights of live matches: those of the batch operators, told when a match is over."""

import random

import pytest
from pyspark.sql import functions as F

from tests.test_streaming import drained
from tramline import queries
from tramline.operators import highlights
from tramline.schemas import DEFAULT
from tramline.streaming import live


@pytest.fixture(scope="module")
def analysis(spark, sf_dir):
    return queries._analysis(spark, sf_dir)


@pytest.mark.parametrize("parts", [1, 4])
def test_highlights_of_live_matches(spark, analysis, tmp_path, parts):
    rows = live.highlight_rows(analysis.shots, analysis.segments, analysis.matches).collect()
    rng = random.Random(parts)
    by_part = [[] for _ in range(parts)]
    for r in rows:  # any event in any micro-batch, ends in the last
        by_part[parts - 1 if r.kind == "end" else rng.randrange(parts)].append(r)
    by_part.append([r for r in rows if r.match_id == 0][:2])  # after the end
    for part in by_part:
        spark.createDataFrame(part, live.HIGHLIGHT_EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(live.HIGHLIGHT_EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = drained(live.highlights(stream), "append", f"highlights{parts}", tmp_path).cache()
    want = analysis.highlights.select("match_id", "start_frame", "end_frame", "timestamp_seconds", "label")
    assert sorted(tuple(r) for r in got.where("not late").drop("late").collect()) == sorted(tuple(r) for r in want.collect()) and want.count() >= 4
    assert got.where("late").count() == 2 and got.where("late and (end_frame is not null or match_id <> 0)").isEmpty()


def test_clips_against_the_batch_operators(spark):
    rng = random.Random(23)
    shots, segs, matches, want = [], [], [], set()
    for m in range(60):
        fps, n = rng.choice([12.0, 24.0, 30.0]), rng.randint(500, 3000)
        frames = sorted(rng.sample(range(n), rng.randint(0, 40)))
        own = [(m, i, a, b, (b - a) / fps, rng.choice([None, 0.0, rng.uniform(0, 500)]), fps) for i, (a, b) in enumerate(zip(frames, frames[1:]))]  # noqa: B905
        shots += [(m, i, f) for i, f in enumerate(frames)]
        segs += own
        matches.append((m, fps, n))
        clips = highlights.Clips()
        mixed = [*(("shot", f) for f in frames), *(("seg", s) for s in own)]
        rng.shuffle(mixed)
        for kind, x in mixed:
            clips.shot(x) if kind == "shot" else clips.segment(x[1], x[2], x[4], x[5])
            if rng.random() < 0.1:
                clips = highlights.Clips(DEFAULT, clips.kept())
        want |= {(m, *c) for c in clips.merged(fps, n)}
    s = spark.createDataFrame(shots, "match_id bigint, shot_idx bigint, frame_num bigint")
    g = spark.createDataFrame(segs, "match_id bigint, seg_idx bigint, sf bigint, ef bigint, dt double, px double, fps double")
    d = spark.createDataFrame(matches, "match_id bigint, fps double, total_frames bigint")
    merged = highlights.merged(highlights.smashes(g, d).unionByName(highlights.rallies(s, d)))
    assert {tuple(r) for r in merged.select("match_id", "start_frame", "end_frame", "timestamp_seconds", "label").collect()} == want and want


def test_an_idle_match_is_closed_by_its_timer(spark):
    """The step itself, with a state whose time has run out."""
    clips = highlights.Clips()
    for f in range(0, 100, 10):
        clips.shot(f)
    assert clips.merged(24.0, 500) == [(0, 140, 0.0, "Long Padel Rally — 9 shots (inc. wall bounces)")]
    assert highlights.Clips(DEFAULT, clips.kept()).merged(24.0, 500) == clips.merged(24.0, 500)


def test_slow_segments_are_let_go():
    clips = highlights.Clips()
    for i in range(10_000):
        clips.segment(i, i, 1.0, float(i % 100))
    clips.segment(10_001, 7, 1.0, 10**6)
    assert len(clips.fast) == 1 and F is not None
