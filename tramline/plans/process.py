"""One job from detections to stored results: the entry that an upload uses."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from ..operators.jobs import JobLog
from ..operators.ranges import span_for
from ..schemas import DEFAULT, Params
from ..sources import tracking as T
from .match import analyse
from .staging import Stages

#: Stages and the progress at which they begin (fixed values); "stage" names a result table.
READ, PLAYERS, BALL, COURT, STATISTICS, SAVE, DONE = ("Reading video", 5), ("Detecting players", 10), ("Detecting ball", 20), ("Detecting court keypoints", 30), ("Computing statistics", 50), ("Saving analysis", 95), ("Done", 100)
TABLES = {"heatmap": ("Generating heatmaps", 60), "trajectory": ("Generating shot map", 65), "highlights": ("Detecting highlights", 70), "reel": ("Saving highlights reel", 92)}
#: The text of the error that a job without frames ends with (fixed value).
NO_FRAMES = "Input video contains no readable frames."


@dataclass
class Inputs:
    """Tables of one or many matches, each a DataFrame or a function that makes it, so that detectors run when their stage begins."""

    matches: DataFrame
    frames: DataFrame
    keypoints: DataFrame | Callable[[], DataFrame]
    players: DataFrame | Callable[[], DataFrame]
    balls: DataFrame | Callable[[], DataFrame]


def process(inputs: Inputs, out: str, on_progress: Callable[[str, int], None] | None = None, max_frames: int | None = None, p: Params = DEFAULT) -> dict[str, str]:
    """Analyse `inputs` and write the results below `out`; returns the path of each. No frames at all are an error, before anything is detected.

    What the job stages is deleted at its end, also after an error; other jobs of the session may run beside it.
    """
    with Stages(inputs.frames.sparkSession) as stages:
        return _process(inputs, out, stages, on_progress, max_frames, p)


def _process(inputs: Inputs, out: str, stages: Stages, on_progress: Callable[[str, int], None] | None, max_frames: int | None, p: Params) -> dict[str, str]:
    tell = on_progress or (lambda stage, percent: None)
    made = lambda x: x() if callable(x) else x
    tell(*READ)
    capped = lambda df: df if max_frames is None else df.where(df["frame_num"] < max_frames)
    frames = capped(inputs.frames)
    if frames.isEmpty():
        raise ValueError(NO_FRAMES)
    matches = inputs.matches
    if max_frames is not None:
        counted = frames.groupBy("match_id").count().withColumnRenamed("count", "total_frames")
        matches = matches.drop("total_frames").join(counted, "match_id")
    p = replace(p, span=p.span or span_for(matches))
    tell(*PLAYERS)
    players = capped(made(inputs.players))
    tell(*BALL)
    balls = capped(made(inputs.balls))
    tell(*COURT)
    keypoints = stages.staged(made(inputs.keypoints))  # read for bounds and for corners; its detector runs once
    a = analyse(matches, keypoints, players, balls, frames, p, stages)
    tell(*STATISTICS)
    paths = {"frame_stats": f"{out}/frame_stats"}
    a.frame_stats.write.mode("overwrite").parquet(paths["frame_stats"])
    for name, stage in TABLES.items():
        tell(*stage)
        paths[name] = f"{out}/{name}"
        getattr(a, name).write.mode("overwrite").parquet(paths[name])
    tell(*SAVE)
    paths["analysis"] = f"{out}/analysis"
    T.write_documents(a.documents, paths["analysis"])
    tell(*DONE)
    return paths


def run_job(log: JobLog, job_id: str, inputs: Inputs, out: str, max_frames: int | None = None, p: Params = DEFAULT) -> dict[str, str] | None:
    """`process` under a job: progress, the result's paths, or the text of the error are stored in the log. None after an error."""
    try:
        log.update(job_id, "processing", "Starting", 1)
        paths = process(inputs, f"{out}/{job_id}", log.progress_of(job_id), max_frames, p)
    except Exception as error:  # whatever stops a job is told by its log
        log.fail(job_id, str(error))
        return None
    log.complete(job_id, paths)
    return paths
