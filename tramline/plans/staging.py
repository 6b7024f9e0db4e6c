"""Stages that several branches of a plan read are computed once, into Parquet in the cluster's shared checkpoint folder.

Later reads keep column pruning and pushed filters, and a lost executor costs no recomputation. A job owns its stages: releasing them leaves those of other jobs of the
session alone. Frames made without a job stage for the session.
"""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

_sessions: dict[str, Stages] = {}
_lock = threading.Lock()


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Only a local session without one (a bare test) gets a folder of its own."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="tramline-stages-")
    sc.setCheckpointDir(own)
    return own


class Stages:
    """The stages of one job, in a folder of their own."""

    def __init__(self, spark: SparkSession):
        self.spark, self.count, self._folder, self._lock = spark, 0, None, threading.Lock()

    def staged(self, df: DataFrame) -> DataFrame:
        with self._lock:  # branches may stage side by side
            if self._folder is None:
                self._folder = f"{shared_folder(self.spark).rstrip('/')}/tramline-{uuid.uuid4().hex}"
            path = f"{self._folder}/{self.count}"
            self.count += 1
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> int:
        """Delete the stages; frames that read them can't be used any more. Returns how many there were."""
        with self._lock:
            folder, count, self._folder, self.count = self._folder, self.count, None, 0
        if folder is not None:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        return count

    def __enter__(self) -> Stages:
        return self

    def __exit__(self, *_: object) -> None:
        self.release()


def of_session(spark: SparkSession) -> Stages:
    """The stages of frames that no job owns."""
    with _lock:
        return _sessions.setdefault(spark.sparkContext.applicationId, Stages(spark))


def staged(df: DataFrame) -> DataFrame:
    return of_session(df.sparkSession).staged(df)


def release(spark: SparkSession) -> int:
    """Delete what was staged for the session, not the stages that jobs own."""
    return of_session(spark).release()
