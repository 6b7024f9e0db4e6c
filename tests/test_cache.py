"""The detection cache: what is detected, what is read, and what a broken run leaves."""

import random

import pytest
from pyspark.sql import functions as F

from tramline import derived as D
from tramline.schemas import BALL_DET, PLAYER_DET
from tramline.sources import cache as C
from tramline.sources import tracking as T

SCHEMA = "match_id bigint, frame_num bigint, x1 double"


def wanted(spark, *rows):
    return spark.createDataFrame(rows, "match_id bigint, frames bigint")


class Detector:
    """Detections of a match and frame that name the version; match 9 has none."""

    def __init__(self, version):
        self.version, self.asked = version, []

    def __call__(self, missing):
        self.asked.append(sorted(tuple(r) for r in missing.collect()))
        frames = missing.where("match_id <> 9").select("match_id", F.explode(F.sequence(F.lit(0), F.col("frames") - 1)).alias("frame_num"))
        return frames.select("match_id", "frame_num", (F.col("match_id") * 1000 + F.col("frame_num") + self.version / 10).alias("x1"))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def expected(version, *matches):
    return sorted((m, f, m * 1000 + f + version / 10) for m, n in matches if m != 9 for f in range(n))


def test_only_missing_matches_are_detected(spark, tmp_path):
    d, cache = Detector(1), C.DetectionCache(spark, str(tmp_path / "c"), SCHEMA, "1", buckets=4)
    assert rows(cache.read_or_detect(wanted(spark, (1, 5)), d)) == expected(1, (1, 5))
    # a second match: the first isn't detected again, and none is lost
    assert rows(cache.read_or_detect(wanted(spark, (1, 5), (2, 3), (9, 4)), d)) == expected(1, (1, 5), (2, 3))
    # a match without any detection is known too; fewer frames are a part of what is there
    assert rows(cache.read_or_detect(wanted(spark, (9, 4), (1, 2)), d)) == expected(1, (1, 2))
    assert d.asked == [[(1, 5)], [(2, 3), (9, 4)]]
    # more frames than are there
    assert rows(cache.read_or_detect(wanted(spark, (1, 7), (1, 6), (2, 3)), d)) == expected(1, (1, 7), (2, 3)) and d.asked[-1] == [(1, 7)]
    assert {r.match_id: r.status for r in cache.plan(wanted(spark, (1, 8), (2, 3), (3, 1))).collect()} == {1: C.SHORT, 2: C.CACHED, 3: C.ABSENT}


def test_a_new_version_detects_anew(spark, tmp_path):
    path, old, new = str(tmp_path / "c"), Detector(1), Detector(2)
    C.DetectionCache(spark, path, SCHEMA, "1").read_or_detect(wanted(spark, (1, 5), (2, 3)), old)
    cache = C.DetectionCache(spark, path, SCHEMA, "2")
    assert {r.status for r in cache.plan(wanted(spark, (1, 5))).collect()} == {C.OUTDATED}
    assert rows(cache.read_or_detect(wanted(spark, (1, 5)), new)) == expected(2, (1, 5)) and new.asked == [[(1, 5)]]
    assert rows(C.DetectionCache(spark, path, SCHEMA, "1").read(wanted(spark, (1, 5), (2, 3)))) == expected(1, (2, 3))


def test_half_written_generations_are_none(spark, tmp_path):
    d, cache = Detector(1), C.DetectionCache(spark, str(tmp_path / "c"), SCHEMA, buckets=2)
    cache.read_or_detect(wanted(spark, (1, 5)), d)

    def dies(missing):
        spark.createDataFrame([(2, 0, 7.0)], SCHEMA).withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(str(tmp_path / "c/data/half"))
        raise RuntimeError("executor lost")

    with pytest.raises(RuntimeError):
        cache.read_or_detect(wanted(spark, (1, 5), (2, 2)), dies)
    assert rows(cache.read_or_detect(wanted(spark, (1, 5), (2, 2)), d)) == expected(1, (1, 5), (2, 2)) and d.asked[-1] == [(2, 2)]
    assert cache.vacuum() == 1 and rows(cache.read(wanted(spark, (1, 5), (2, 2)))) == expected(1, (1, 5), (2, 2))


def test_generations_are_merged(spark, tmp_path):
    d, cache = Detector(1), C.DetectionCache(spark, str(tmp_path / "c"), SCHEMA, buckets=2, most_generations=3)
    for m in range(6):
        cache.read_or_detect(wanted(spark, (m, 3)), d)
    assert len(cache.generations()) <= 3
    every = [(m, 3) for m in range(6)]
    assert rows(cache.read(wanted(spark, *every))) == expected(1, *every)
    cache.vacuum()
    assert rows(cache.read(wanted(spark, *every))) == expected(1, *every) and len(d.asked) == 6
    assert sum(1 for p in (tmp_path / "c").rglob("part-*")) <= 3 * 4


def test_a_merge_never_hides_what_came_in_between(spark, tmp_path):
    cache = C.DetectionCache(spark, str(tmp_path / "c"), SCHEMA, buckets=2)
    d = Detector(1)
    cache.read_or_detect(wanted(spark, (1, 2)), d)
    number, held = cache._free(), C.live(cache.manifest())
    other = C.DetectionCache(spark, str(tmp_path / "c"), SCHEMA)
    other.read_or_detect(wanted(spark, (5, 2)), d)  # another run takes the number
    assert cache.add(held, cache._data(held.select("match_id", "gen")), merge_as=number) == number + 1 and cache.generations() == [number + 1]
    assert rows(cache.read(wanted(spark, (1, 2), (5, 2)))) == expected(1, (1, 2), (5, 2))


def test_other_columns_are_an_error(spark, tmp_path):
    C.DetectionCache(spark, str(tmp_path / "c"), SCHEMA)
    with pytest.raises(ValueError, match="not match_id"):
        C.DetectionCache(spark, str(tmp_path / "c"), BALL_DET)


def test_read_or_detect_knows_its_matches(spark, sf_dir, tmp_path):
    fr = D.frames(spark.read.parquet(f"{sf_dir}/events.parquet")).cache()
    asked = []

    def detect(missing):
        asked.append(sorted(r.match_id for r in missing.collect()))
        return D.player_boxes(fr).join(missing, "match_id", "left_semi")

    ask = lambda *ids: fr.where(F.col("match_id").isin(*ids)).groupBy("match_id").agg(F.count(F.lit(1)).alias("frames"))
    path = str(tmp_path / "players")
    for ids in ((0,), (0, 1), (1, 2)):
        got = T.read_or_detect(spark, path, PLAYER_DET, detect, wanted=ask(*ids))
        assert rows(got) == rows(D.player_boxes(fr).where(F.col("match_id").isin(*ids)).select(got.columns))
    assert asked == [[0], [1], [2]]
    short = T.read_or_detect(spark, path, PLAYER_DET, detect, wanted=ask(2), max_frames=10)
    assert short.agg(F.max("frame_num")).first()[0] == 9 and len(asked) == 3
    T.read_or_detect(spark, path, PLAYER_DET, detect, read=False, wanted=ask(0))
    assert asked[-1] == [0] and len(asked) == 4


def test_plan_against_a_dictionary(spark):
    rng = random.Random(5)
    manifest = [(rng.randrange(30), str(rng.randrange(2)), rng.randrange(1, 9), g) for g in range(60)]
    manifest = list({(m, g): (m, v, n, g) for m, v, n, g in manifest}.values())
    asked = [(rng.randrange(40), rng.randrange(1, 9)) for _ in range(50)]
    most = {}
    for m, n in asked:
        most[m] = max(n, most.get(m, 0))
    last = {}
    for m, v, n, g in sorted(manifest, key=lambda r: r[3]):
        last[m] = (v, n, g)
    want = set()
    for m, n in most.items():
        v, held, g = last.get(m, (None, None, None))
        want.add((m, n, C.ABSENT if v is None else C.OUTDATED if v != "1" else C.SHORT if held < n else C.CACHED, g))
    got = C.plan(spark.createDataFrame(asked, "match_id bigint, frames bigint"), spark.createDataFrame(manifest, C.MANIFEST), "1")
    assert {tuple(r) for r in got.collect()} == want
