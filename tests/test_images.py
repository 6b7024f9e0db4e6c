"""Pictures decode to what they were made of, and a failed write leaves nothing."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tramline import queries
from tramline.sources import images as I


def decode(data):
    """Pixels of an 8-bit grey PNG, by its own rules for each filter."""
    assert data.startswith(b"\x89PNG\r\n\x1a\n")
    at, parts, size = 8, b"", None
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        assert struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] == zlib.crc32(kind + body)
        if kind == b"IHDR":
            w, h, depth, colour, *rest = struct.unpack(">IIBBBBB", body)
            assert (depth, colour, rest) == (8, 0, [0, 0, 0])
            size = h, w
        elif kind == b"IDAT":
            parts += body
        at += 12 + n
    assert kind == b"IEND"
    raw = np.frombuffer(zlib.decompress(parts), np.uint8).reshape(size[0], size[1] + 1)
    out = np.zeros(size, np.uint8)
    for i, row in enumerate(raw):
        assert row[0] in (0, 2)
        out[i] = row[1:] + (out[i - 1] if row[0] == 2 and i else 0)
    return out


def test_png_round_trip():
    rng = np.random.default_rng(3)
    for shape in ((1, 1), (7, 300), (100, 100), (401, 201)):
        pixels = rng.integers(0, 256, shape, dtype=np.uint8)
        assert (decode(I.encode_png(pixels)) == pixels).all()


def test_grids_and_paths(spark, sf_dir, tmp_path):
    a = queries._analysis(spark, sf_dir)
    heat = a.heatmap.cache()
    I.write_files(I.grid_pictures(heat), str(tmp_path / "out"))
    want = {}
    for r in heat.collect():
        want.setdefault((r.match_id, r.player_id), np.zeros((100, 100)))[r.by, r.bx] = r.density
    assert want
    for (m, p), grid in want.items():
        got = decode((tmp_path / f"out/match_{m}/heatmap_p{p}.png").read_bytes())
        assert (got == np.floor(grid / grid.max() * 255 + 0.5).astype(np.uint8)).all() and got.max() == 255
    I.write_files(I.path_pictures(a.trajectory), str(tmp_path / "out"))
    points = a.trajectory.where("match_id = 1").collect()
    path = decode((tmp_path / "out/match_1/shot_map.png").read_bytes())
    assert path.shape == (401, 201) and all(path[round(r.y_m * 20), round(r.x_m * 20)] >= 64 for r in points)
    assert not list((tmp_path / "out").glob("_new*"))


def test_lines_of_a_path():
    got = I.path_pixels(np.array([0.0, 0.2, 0.2]), np.array([0.0, 0.2, 0.0]), np.array([0.0, 1.0, 0.5]))
    want = np.zeros((401, 201), np.uint8)
    want[:5, 4] = 64 + 95
    for i in range(5):
        want[i, i] = 255
    assert (got == want).all()


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    rows = spark.range(20).repartition(4).select(F.concat(F.lit("a/"), F.col("id").cast("string")).alias("name"), F.expr("if(id = 13, cast(raise_error('lost') as binary), cast('x' as binary))").alias("content"))
    out = tmp_path / "out"
    with pytest.raises(Exception, match="lost"):
        I.write_files(rows, str(out))
    assert not out.exists() or not [p for p in out.rglob("*") if p.is_file()]
    good = rows.where("id <> 13")
    I.write_files(good, str(out))
    assert len(list((out / "a").iterdir())) == 19
    with pytest.raises(Exception, match="files of one name"):
        I.write_files(good, str(out))
    I.write_files(good.withColumn("content", F.lit(b"new")), str(out), overwrite=True)
    assert {p.read_bytes() for p in (out / "a").iterdir()} == {b"new"} and not (out / "_new").exists()
    for bad in ("/etc/x", "../x", ""):
        with pytest.raises(Exception, match="no name"):
            I.write_files(spark.createDataFrame([(bad, b"x")], I.PICTURE), str(out))
