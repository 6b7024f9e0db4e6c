"""Frames of videos by byte, by range and with faults."""

import random

import pytest
from pyspark.sql import functions as F

from tramline.schemas import BALL_CAND
from tramline.sources import tracking as T
from tramline.sources import video as V

SIZES = {"420jpeg": 1.5, "422": 2, "444": 3, "mono": 1, "420p10": 3}


def write(path, n, w=16, h=8, colour="420jpeg", rate="25:1", marks=lambda k: b"", seed=1):
    """A video of random samples; returns the samples of each frame."""
    rng = random.Random(seed)
    size = int(w * h * SIZES[colour])
    frames = [rng.randbytes(size) for _ in range(n)]
    head = f"YUV4MPEG2 W{w} H{h}" + (f" F{rate}" if rate else "") + f" Ip A1:1 C{colour}\n"
    path.write_bytes(head.encode() + b"".join(b"FRAME" + marks(k) + b"\n" + f for k, f in enumerate(frames)))
    return frames


@pytest.mark.parametrize("colour", SIZES)
@pytest.mark.parametrize("marks", [lambda k: b"", lambda k: b" Ixyz" if k % 3 == 1 else b""])
def test_round_trip(spark, tmp_path, colour, marks):
    want = write(tmp_path / "a.y4m", 23, colour=colour, marks=marks)
    df = V.read_frames(spark, str(tmp_path / "a.y4m"), partitionBytes=1000)
    assert df.rdd.getNumPartitions() > 2
    rows = df.orderBy("frame_num").collect()
    assert [bytes(r.frame) for r in rows] == want and [r.frame_num for r in rows] == list(range(23))
    assert {(r.width, r.height, r.fps, r.colour) for r in rows} == {(16, 8, 25.0, colour)}
    assert V.luma(bytes(rows[0].frame), 16, 8, colour).shape == (8, 16)


def test_a_cap_reads_only_its_range(spark, tmp_path):
    want = write(tmp_path / "a.y4m", 50)
    # the samples of all later frames are damaged: whoever reads them stops
    data = (tmp_path / "a.y4m").read_bytes()
    head, stride = data.index(b"\n") + 1, 6 + len(want[0])
    broken = bytearray(data)
    for k in range(20, 49):
        broken[head + k * stride : head + k * stride + 5] = b"xxxxx"
    (tmp_path / "a.y4m").write_bytes(bytes(broken))
    df = V.read_frames(spark, str(tmp_path / "a.y4m"), max_frames=20, partitionBytes=500)
    assert [bytes(r.frame) for r in df.orderBy("frame_num").collect()] == want[:20]
    for condition, low, high in (("frame_num >= 3 and frame_num < 7", 3, 7), ("frame_num = 19", 19, 20), ("frame_num > 17 and frame_num <= 18", 18, 19), ("frame_num in (2, 5)", 2, 6), ("frame_num < 0", 0, 0)):
        got = V.read_frames(spark, str(tmp_path / "a.y4m"), partitionBytes=500).where(condition).orderBy("frame_num").collect()
        assert [r.frame_num for r in got] == [k for k in range(low, high) if condition != "frame_num in (2, 5)" or k in (2, 5)]
    with pytest.raises(Exception, match="frame 2[0-9] has no mark"):
        V.read_frames(spark, str(tmp_path / "a.y4m")).count()


def test_filters_narrow_the_ranges(tmp_path):
    write(tmp_path / "a.y4m", 100)
    reader = V.FrameReader({"path": str(tmp_path / "a.y4m"), "partitionbytes": "2000"})
    asked = [V.GreaterThanOrEqual(("frame_num",), 10), V.LessThan(("frame_num",), 31), V.In(("frame_num",), (12, 30)), V.EqualTo(("width",), 16)]
    assert list(reader.pushFilters(asked)) == asked[2:]
    parts = reader.partitions()
    assert parts[0].start == 12 and parts[-1].end == 31 and all(a.end == b.start for a, b in zip(parts, parts[1:]))  # noqa: B905


def test_many_files_and_matches(spark, tmp_path):
    frames = {name: write(tmp_path / name, n, rate=rate, seed=n) for name, n, rate in (("a.y4m", 5, "30:1"), ("b.y4m", 7, "1:1"), ("c.y4m", 0, None))}
    (tmp_path / "note.txt").write_text("no video")
    videos = spark.createDataFrame([(1, str(tmp_path / "a.y4m")), (2, str(tmp_path / "b.y4m")), (3, str(tmp_path / "c.y4m"))], "match_id bigint, path string")
    rows = V.match_rows(spark, str(tmp_path), videos).orderBy("match_id").collect()
    assert [tuple(r) for r in rows] == [(1, 30.0, 5, 16, 8), (2, 24.0, 7, 16, 8)]
    got = V.match_frames(V.read_frames(spark, f"{tmp_path}/*.y4m"), videos).where("match_id = 2").orderBy("frame_num").collect()
    assert [bytes(r.frame) for r in got] == frames["b.y4m"]
    one = V.read_frames(spark, str(tmp_path)).where(F.col("path") == str(tmp_path / "a.y4m"))
    assert one.count() == 5


def test_detectors_read_frames(spark, tmp_path):
    """A detector of the brightest pixel, over the frames of a video."""
    want = write(tmp_path / "a.y4m", 12, colour="mono")
    videos = spark.createDataFrame([(7, str(tmp_path / "a.y4m"))], "match_id bigint, path string")

    def detect(batch):
        at = [int(V.luma(f, w, h).argmax()) for f, w, h in zip(batch["frame"], batch["width"], batch["height"], strict=True)]
        x, y = [a % 16 for a in at], [a // 16 for a in at]
        return batch[["match_id", "frame_num"]].assign(cand_idx=0, conf=1.0, x1=[float(v) for v in x], y1=[float(v) for v in y], x2=[v + 1.0 for v in x], y2=[v + 1.0 for v in y])

    found = T.detect_balls(V.match_frames(V.read_frames(spark, str(tmp_path / "a.y4m")), videos), detect)
    assert [c.split()[0] for c in BALL_CAND.split(", ")] == found.columns
    assert {r.frame_num: int(r.y1 * 16 + r.x1) for r in found.collect()} == {k: f.index(max(f)) for k, f in enumerate(want)}


@pytest.mark.parametrize("data,why", [(b"RIFFxxxx", "no YUV4MPEG2"), (b"YUV4MPEG2 W16\n", "no size"), (b"YUV4MPEG2 W4 H4 C999\n", "unknown colour"), (b"YUV4MPEG2 W4 H4 Cmono\nFRAME\n" + b"a" * 10, "ends within frame 0"), (b"YUV4MPEG2 W4 H4 Cmono\nFRAME\n" + b"a" * 16 + b"FRAMES\n", "frame 1 has no mark")])
def test_bad_files_are_named(spark, tmp_path, data, why):
    (tmp_path / "bad.y4m").write_bytes(data)
    with pytest.raises(ValueError, match=f"bad.y4m.*{why}|bad.y4m {why}"):
        V.index_of(str(tmp_path / "bad.y4m"))
    with pytest.raises(Exception, match="bad.y4m"):
        V.read_frames(spark, str(tmp_path / "bad.y4m")).count()
