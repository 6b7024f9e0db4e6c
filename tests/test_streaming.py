"""Streams end where the batch operators do."""

from pyspark.sql import functions as F

from tramline import derived as D
from tramline.operators import ball, reports
from tramline.schemas import BALL_DET
from tramline.streaming import live


def drained(df, mode, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.processAllAvailable()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_live_ball_follows_the_batch_rule(spark, sf_dir, tmp_path):
    fr = D.frames(spark.read.parquet(f"{sf_dir}/events.parquet"))
    cands, frames = D.ball_candidates(fr), fr.select("match_id", "frame_num")
    rows = live.frame_rows(cands, frames).cache()
    for part in range(3):  # three files in time order
        rows.where((F.col("frame_num") >= part * 90) & (F.col("frame_num") < (part + 1) * 90 if part < 2 else F.lit(True))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(live.FRAME).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {tuple(r) for r in drained(live.select_ball(stream), "append", "live_ball", tmp_path).select(*BALL_COLUMNS).collect()}
    assert got == {tuple(r) for r in ball.select_ball(cands, frames).select(*BALL_COLUMNS).collect()}


def test_late_frames_are_marked(spark, tmp_path):
    rows = [(1, f, [[0.5, 10.0 * f, 0.0, 10.0 * f + 4, 4.0]]) for f in (0, 1, 5)], [(1, f, [[0.5, 10.0 * f, 0.0, 10.0 * f + 4, 4.0], [0.9, 5000.0, 0.0, 5004.0, 4.0]]) for f in (2, 6)]
    for part in rows:
        spark.createDataFrame(part, live.FRAME).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(live.FRAME).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {(r.frame_num, r.x1, r.late) for r in drained(live.select_ball(stream), "append", "late_ball", tmp_path).collect()}
    # frame 2 comes after frame 5: no anchor tells its candidates apart
    assert got == {(0, 0.0, False), (1, 10.0, False), (5, 50.0, False), (2, 5000.0, True), (6, 60.0, False)}


BALL_COLUMNS = [c.split()[0] for c in BALL_DET.split(", ")]


def test_job_board(spark, tmp_path):
    schema = "job_id string, seq bigint, status string, stage string, progress int, result string, error string, at timestamp_ntz"
    events = spark.sql("SELECT concat('j', id % 3) job_id, id seq, if(id > 5, 'done', 'processing') status, 's' stage, int(id) progress, string(null) result, string(null) error, timestamp_ntz'2026-01-01 00:00:00' at FROM range(8)")
    events.repartition(2).write.parquet(str(tmp_path / "jobs"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "jobs"))
    got = drained(live.job_board(stream), "complete", "job_board", tmp_path).orderBy("job_id").collect()
    assert got == reports.job_status(events).orderBy("job_id").collect() and [r.status for r in got] == ["done", "done", "processing"]
