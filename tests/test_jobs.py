"""The job log over many commands, several writers and folds, against a plain dictionary."""

import json
import random
import threading

import pytest

from tramline.operators import jobs
from tramline.sources.files import Files

VALUES = ("status", "stage", "progress", "result", "error")


@pytest.fixture
def log(spark, tmp_path, request):
    table = f"jobs_{request.node.name}"
    yield jobs.JobLog(spark, table, str(tmp_path / "log"), buckets=3, fold_every=50).create()
    spark.sql(f"DROP TABLE IF EXISTS {table}")


def plain(states, c):
    """What a command does to a dictionary of jobs."""
    job, kind = c["job_id"], c["command"]
    if kind == "insert":
        states.setdefault(job, {"status": "queued", "stage": "Queued", "progress": 0, "result": None, "error": None})
    elif job in states:
        s = states[job]
        if kind == "update":
            s |= {"status": c["status"], "stage": c["stage"], "progress": c["progress"]}
        elif kind == "complete":
            s |= {"status": "done", "stage": "Done", "progress": 100, "result": c["result"]}
        else:
            s |= {"status": "error", "stage": "Error", "error": c["error"]}


def files_of(path):
    return [p for p in path.rglob("*") if p.is_file()]


def test_ten_thousand_commands_leave_few_files(spark, log, tmp_path):
    rng = random.Random(7)
    states, commands = {}, []
    for i in range(10_000):
        job = f"j{rng.randrange(400)}" if rng.random() < 0.6 else "hot"
        c = rng.choice([{"command": "insert"}, *({"command": "update", "status": "processing", "stage": f"s{i}", "progress": i % 100},) * 5, {"command": "complete", "result": json.dumps({"n": i})}, {"command": "fail", "error": f"e{i}"}])
        commands.append(log.command(job, **c))
        plain(states, commands[-1])
    for c in commands[:800]:  # one at a time
        log._append(jobs.bucket_of(c["job_id"], log.buckets), [c])
    for a in range(800, 10_000, 100):
        log.append(commands[a : a + 100])
    got = {r.job_id: {k: r[k] for k in VALUES} for r in log.jobs().collect()}
    assert got == states
    # of each bucket two bases at most and the commits of two folds
    assert all(len(log._bases(b)) == 2 and len(log._commits(b)) <= 2 * log.fold_every for b in range(3))
    assert len(files_of(tmp_path / "log")) <= 3 * (2 * 4 + 2 * log.fold_every) + 1
    one = log.get("hot")
    assert {k: one[k] for k in VALUES} == states["hot"] and one["created_at"] <= one["updated_at"]
    log.fold_all()
    assert {r.job_id: {k: r[k] for k in VALUES} for r in log.jobs().collect()} == states
    assert {r.job_id: {k: r[k] for k in VALUES} for r in spark.table(log.table).collect()} == states
    # another reader finds the same log, with the number of buckets it was made with
    other = jobs.JobLog(spark, log.table, log.path, buckets=9).create()
    assert other.buckets == 3 and {k: other.get("hot")[k] for k in VALUES} == states["hot"]


def test_a_look_at_one_job_reads_one_bucket(log):
    for j in "abcdef":
        log.insert(j)
    log.fold_all()
    log.update("a", "processing", "Working", 7)
    own = f"bucket={jobs.bucket_of('a', 3)}/"
    read = log._state([jobs.bucket_of("a", 3)]).inputFiles()
    assert read and all(own in f for f in read)
    assert log.get("a")["progress"] == 7 and log.get("zz") is None


def test_of_two_writers_one_inserts(spark, log):
    logs = [log, *(jobs.JobLog(spark, log.table, log.path).create() for _ in range(3))]
    won, lost = [], []

    def work(k):
        for j in range(3):
            try:
                logs[k].insert(f"job{j}")
                won.append(f"job{j}")
            except ValueError:
                lost.append(f"job{j}")

    threads = [threading.Thread(target=work, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(won) == ["job0", "job1", "job2"] and len(lost) == 9 and log.jobs().count() == 3


def test_updates_of_two_writers_are_all_kept(spark, log):
    a, b = log, jobs.JobLog(spark, log.table, log.path).create()
    a.insert("j")
    for i in range(30):
        (a, b)[i % 2].update("j", "processing", f"s{i}", i)
        assert (b, a)[i % 2]._free(jobs.bucket_of("j", 3)) == i + 2
    assert log.get("j")["stage"] == "s29"


def test_an_unfinished_fold_is_no_base(spark, log):
    log.insert("j")
    log.fold_all()
    (Files(spark, log.path)).create_once("base/_new-half/part.parquet", "broken")
    log.update("j", "processing", "x", 3)
    assert log.get("j")["progress"] == 3 and log.jobs().count() == 1


def test_create_once(spark, tmp_path):
    files = Files(spark, str(tmp_path / "f"))
    assert files.names("none") == [] and files.create_once("a/b.txt", "é") and not files.create_once("a/b.txt", "x")
    assert files.read("a/b.txt") == "é" and files.names("a") == ["b.txt"] and files.rename("a", "c") and files.exists("c/b.txt")
    files.delete("c")
    assert not files.exists("c")
