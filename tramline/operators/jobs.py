"""The job log: commands on jobs, and the state of jobs that follows from them.

A job is inserted once, then updated, completed or failed. Each command leaves what it doesn't speak of as it was: a failure keeps the
progress, an update keeps result and error. Commands on unknown jobs change nothing, nor does a second insert.

The log lies in a folder, in a fixed number of buckets by a hash of the job's id. A bucket has a base, the state of its jobs up to some commit, as Parquet, and the
commits since, a numbered file each, which only one writer can make. Every `fold_every` commits the writer folds them into a new base; the base before
and the commits since that one stay for readers under way, all older ones go. So the number of files is bounded whatever the number of commands,
and a look at one job reads one bucket.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Callable, Iterable
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import JOB_COMMANDS, JOB_STATE
from ..sources.files import Files

INSERT, UPDATE, COMPLETE, FAIL = "insert", "update", "complete", "fail"
VALUES = ("status", "stage", "progress", "result", "error")
#: Commands of one commit are numbered within it.
IN_COMMIT = 20


def latest(column: str, order: str = "seq") -> Column:
    """The last value of a column that isn't null."""
    return F.max_by(column, F.when(F.col(column).isNotNull(), F.col(order))).alias(column)


def state(events: DataFrame) -> DataFrame:
    """(job_id, status, stage, progress, result, error, created_at, updated_at) of each job, from rows of JOB_EVENTS; nulls leave a value as it was."""
    return events.groupBy("job_id").agg(*map(latest, VALUES), F.min("at").alias("created_at"), F.max("at").alias("updated_at"))


def events_of(commands: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """JOB_EVENTS from rows of JOB_COMMANDS: the first insert of a job and what follows it, or, of a job of `known` (job_id), all but inserts."""
    born = commands.where(F.col("command") == INSERT).groupBy("job_id").agg(F.min("seq").alias("born"))
    if known is not None:
        born = born.unionByName(known.select("job_id", F.lit(-1).cast("bigint").alias("born"))).groupBy("job_id").agg(F.min("born").alias("born"))
    real = commands.join(born, "job_id").where((F.col("seq") == F.col("born")) | (F.col("seq") > F.col("born")) & (F.col("command") != INSERT))
    case = lambda **of: F.coalesce(*(F.when(F.col("command") == k, v) for k, v in of.items()))
    # states, stages and progress that commands set (fixed values)
    value = {
        "status": case(insert=F.lit("queued"), update=F.col("status"), complete=F.lit("done"), fail=F.lit("error")),
        "stage": case(insert=F.lit("Queued"), update=F.coalesce("stage", F.lit("")), complete=F.lit("Done"), fail=F.lit("Error")),
        "progress": case(insert=F.lit(0), update=F.coalesce("progress", F.lit(0)), complete=F.lit(100)),
        "result": case(complete=F.col("result")),
        "error": case(fail=F.col("error")),
    }
    return real.select("job_id", "seq", *(v.alias(k) for k, v in value.items()), "at")


def folded(base: DataFrame, commands: DataFrame) -> DataFrame:
    """The state of jobs after `commands`, given their state before (JOB_STATE rows, one a job). Commands count from 0."""
    before = base.select("job_id", F.lit(-1).cast("bigint").alias("seq"), *VALUES, F.explode(F.array("created_at", "updated_at")).alias("at"))
    return state(before.unionByName(events_of(commands, base.select("job_id"))))


def bucket_of(job_id: str, buckets: int) -> int:
    return zlib.crc32(job_id.encode()) % buckets


class JobLog:
    """A job log in a folder; `table` is the session's name for its folded state."""

    def __init__(self, spark: SparkSession, table: str = "jobs", path: str | None = None, buckets: int = 16, fold_every: int = 64):
        self.spark, self.table, self.buckets, self.fold_every = spark, table, buckets, fold_every
        self.path = (path or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{table}_log").rstrip("/")
        self.files = Files(spark, self.path)
        self._next: dict[int, int] = {}

    def create(self) -> JobLog:
        """Make the log if there is none; one that is there keeps its number of buckets."""
        self.files.create_once("layout.json", json.dumps({"buckets": self.buckets}))
        self.buckets = json.loads(self.files.read("layout.json"))["buckets"]
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.table} ({JOB_STATE}, bucket int, upto bigint) USING parquet PARTITIONED BY (bucket, upto) LOCATION '{self.path}/base'")
        return self

    def _commits(self, bucket: int) -> list[int]:
        return [int(n.split(".")[0]) for n in self.files.names(f"commits/bucket={bucket}")]

    def _bases(self, bucket: int) -> list[int]:
        return sorted(int(n.split("=")[1]) for n in self.files.names(f"base/bucket={bucket}"))

    def _free(self, bucket: int) -> int:
        return max([-1, *self._commits(bucket), *self._bases(bucket)[-1:]]) + 1

    def _commit(self, bucket: int, number: int, commands: list[dict]) -> bool:
        """Write commands as commit `number` of a bucket; False if another writer has made it."""
        rows = [{**c, "seq": (number << IN_COMMIT) + i} for i, c in enumerate(commands)]
        if not self.files.create_once(f"commits/bucket={bucket}/{number:018}.json", "\n".join(map(json.dumps, rows)) + "\n"):
            return False
        self._next[bucket] = number + 1
        if (number + 1) % self.fold_every == 0:
            self.fold(bucket)
        return True

    def _append(self, bucket: int, commands: list[dict]) -> None:
        number = self._next[bucket] if bucket in self._next else self._free(bucket)
        while not self._commit(bucket, number, commands):
            number = max(number + 1, self._free(bucket))

    @staticmethod
    def command(job_id: str, command: str, **values: object) -> dict:
        return {"job_id": job_id, "command": command, "at": datetime.now(UTC).replace(tzinfo=None).isoformat(timespec="microseconds"), **values}

    def append(self, commands: Iterable[dict]) -> None:
        """Many commands, from `command`, in one commit for each bucket. An insert of a job that is there changes nothing here."""
        by: dict[int, list[dict]] = {}
        for c in commands:
            by.setdefault(bucket_of(c["job_id"], self.buckets), []).append(c)
        for bucket, rows in by.items():
            for a in range(0, len(rows), 1 << IN_COMMIT):
                self._append(bucket, rows[a : a + (1 << IN_COMMIT)])

    def insert(self, job_id: str) -> None:
        """Make a job known; an error if it is. Of writers that insert one job at a time just one succeeds: it commits under a number before which it has seen no insert."""
        bucket = bucket_of(job_id, self.buckets)
        while True:
            number = self._free(bucket)
            if self.get(job_id) is not None:
                raise ValueError(f"job {job_id} exists")
            if self._commit(bucket, number, [self.command(job_id, INSERT)]):
                return

    def _change(self, job_id: str, command: str, **values: object) -> None:
        self._append(bucket_of(job_id, self.buckets), [self.command(job_id, command, **values)])

    def update(self, job_id: str, status: str, stage: str = "", progress: int = 0) -> None:
        self._change(job_id, UPDATE, status=status, stage=stage, progress=progress)

    def complete(self, job_id: str, result: dict) -> None:
        self._change(job_id, COMPLETE, result=json.dumps(result))

    def fail(self, job_id: str, error: str) -> None:
        self._change(job_id, FAIL, error=error)

    def _state(self, buckets: Iterable[int], only: Column | None = None, upto: int | None = None) -> DataFrame:
        """The state of the jobs of some buckets (those that fit `only`): their newest bases and the commits since."""
        bases, commits = [], []
        for b in buckets:
            base = max(self._bases(b), default=-1)
            bases += [self.files.path(f"base/bucket={b}/upto={base}")] if base >= 0 else []
            commits += [self.files.path(f"commits/bucket={b}/{n:018}.json") for n in self._commits(b) if n > base and (upto is None or n <= upto)]
        reader = lambda schema: self.spark.read.schema(schema)
        base = reader(JOB_STATE).parquet(*bases) if bases else self.spark.createDataFrame([], JOB_STATE)
        commands = reader(JOB_COMMANDS).json(commits) if commits else self.spark.createDataFrame([], JOB_COMMANDS)
        if only is not None:
            base, commands = base.where(only), commands.where(only)
        return folded(base, commands)

    def fold(self, bucket: int) -> None:
        """Make a new base of a bucket from all its commits; of two writers that do so one wins, with the same rows."""
        numbers, bases = self._commits(bucket), self._bases(bucket)
        upto = max(numbers, default=-1)
        if upto <= max(bases, default=-1):
            return
        new = f"base/_new-{uuid.uuid4().hex}"
        self._state([bucket], upto=upto).coalesce(1).write.parquet(self.files.path(new))
        if not self.files.rename(new, f"base/bucket={bucket}/upto={upto}"):
            self.files.delete(new)
            return
        partition = lambda n: f"PARTITION (bucket = {bucket}, upto = {n})"
        named = self.spark.catalog.tableExists(self.table)  # a session that hasn't created it may write too
        if named:
            self.spark.sql(f"ALTER TABLE {self.table} ADD IF NOT EXISTS {partition(upto)}")
        before = max(bases, default=-1)
        for old in bases:
            if named:
                self.spark.sql(f"ALTER TABLE {self.table} DROP IF EXISTS {partition(old)}")
            if old < before:
                self.files.delete(f"base/bucket={bucket}/upto={old}")
        for n in numbers:
            if n <= before:
                self.files.delete(f"commits/bucket={bucket}/{n:018}.json")

    def fold_all(self) -> None:
        for b in range(self.buckets):
            self.fold(b)

    def jobs(self) -> DataFrame:
        return self._state(range(self.buckets))

    def get(self, job_id: str) -> dict | None:
        """The state of one job; only its bucket is read."""
        got = self._state([bucket_of(job_id, self.buckets)], F.col("job_id") == job_id).head()
        return got.asDict() if got else None

    def progress_of(self, job_id: str) -> Callable[[str, int], None]:
        return lambda stage, percent: self.update(job_id, "processing", stage, percent)

