"""Live matches over streams of frames: the anchored choice of the ball, shots, identities of players, highlights; and the job board.

A stream may be cut into micro-batches anywhere. Each operator takes the frames of a match in order, by the step that the batch operator uses too, and what it says of
a frame is final. Frames may come out of order by up to `delay` frames, for which the later ones wait; one that comes when its turn has passed is marked late and moves nothing.
What a match needs between micro-batches doesn't grow with its length; within one, frames are held that have come before their turn, so that the source's limit on a
micro-batch bounds them, and sorted input holds none. With `idle_minutes`, a match without frames for so long is forgotten; a stream that runs on
should set it. One that ends with its input can't: Spark goes on with batches to look for timeouts.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import geometry as G
from ..operators import players, reports
from ..operators.ball import Anchor, Turns, plausible
from ..operators.highlights import Clips
from ..schemas import BALL_DET, DEFAULT, PLAYER_SLOT, SHOTS, Params

FRAME = "match_id bigint, frame_num bigint, candidates array<array<double>>"
#: A frame of a ball track; total_frames is the declared length of the match, null if unknown.
TRACK_FRAME = "match_id bigint, frame_num bigint, y1 double, y2 double, total_frames bigint"
#: A frame with the players in court, each as (track_id, cx, cy, x1, y1, x2, y2), by track.
PLAYER_FRAME = "match_id bigint, frame_num bigint, seen array<array<double>>"
#: What highlights are made of: a shot, a segment, or the end of a match; a null frame_num, seg_idx, dt or px where the kind has none.
HIGHLIGHT_EVENT = "match_id bigint, kind string, frame_num bigint, seg_idx bigint, dt double, px double, fps double, total_frames bigint"
HIGHLIGHTS = "match_id bigint, start_frame bigint, end_frame bigint, timestamp_seconds double, label string, late boolean"
SHOT, SEGMENT, END = "shot", "segment", "end"
#: Rows that a match gives away at once.
CHUNK = 10_000


class InOrder:
    """Frames of a match in their order; those that come before their turn wait."""

    def __init__(self, delay: int, turn: int = 0, waiting: dict[int, object] | None = None):
        self.delay, self.turn, self.waiting = delay, turn, waiting or {}

    def take(self, frame: int, value: object) -> bool:
        """Keep a frame; False if its turn has passed. Of a repeated frame the last that waits counts."""
        if frame < self.turn:
            return False
        self.waiting[frame] = value
        return True

    def ready(self, passing: bool = False) -> Iterator[tuple[int, object]]:
        """Frames whose turn it is. With `passing`, the turn of frames that haven't come passes when others are `delay` frames further."""
        latest = max(self.waiting, default=-1)
        while self.waiting:
            if self.turn not in self.waiting:
                if not passing or latest - self.turn < self.delay:
                    return
                self.turn = min(self.waiting)
            yield self.turn, self.waiting.pop(self.turn)
            self.turn += 1


class Step:
    """What an operator does with the frames of one match. `kept` is its state as JSON can hold it."""

    def __init__(self, match: object, kept: dict | None):
        self.match = match

    def frame(self, frame: int, value: list) -> Iterable[tuple]:
        raise NotImplementedError

    def late(self, frame: int, value: list) -> Iterable[tuple]:
        raise NotImplementedError

    def kept(self) -> dict:
        raise NotImplementedError


def _plain(value: object) -> object:
    """Cells as numbers and lists; missing ones as None."""
    if value is None or isinstance(value, float) and value != value:
        return None
    return [_plain(v) for v in value] if hasattr(value, "__len__") and not isinstance(value, str) else value.item() if hasattr(value, "item") else value


def in_match_order(stream: DataFrame, columns: list[str], step: Callable[[object, dict | None], Step], schema: str, delay: int, idle_minutes: int | None) -> DataFrame:
    """Rows of `schema` that `step` yields for the frames of each match; it is given `columns` of a frame."""
    names = [c.split()[0] for c in schema.split(", ")]
    floats = {c.split()[0]: "float64" for c in schema.split(", ") if c.endswith(" double")}
    whole = {c.split()[0]: "Int64" if c.endswith("bigint") else "Int32" for c in schema.split(", ") if c.endswith(("bigint", " int"))}

    def table(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=names).astype(floats | whole)

    def run(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        before = json.loads(state.get[0]) if state.exists else None
        order = InOrder(delay, *(before["turn"], {int(f): v for f, v in before["waiting"].items()}) if before else ())
        match, out = step(key[0].item() if hasattr(key[0], "item") else key[0], before and before["own"]), []
        for b in batches:
            for frame, *value in zip(b["frame_num"].tolist(), *(b[c].tolist() for c in columns), strict=True):
                value = [_plain(v) for v in value]
                if not order.take(frame, value):
                    out.extend(match.late(frame, value))
            for frame, value in order.ready():
                out.extend(match.frame(frame, value))
                if len(out) >= CHUNK:
                    yield table(out)
                    out = []
        for frame, value in order.ready(passing=True):
            out.extend(match.frame(frame, value))
        state.update((json.dumps({"turn": order.turn, "waiting": order.waiting, "own": match.kept()}),))
        if idle_minutes:
            state.setTimeoutDuration(idle_minutes * 60_000)
        yield table(out)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_minutes else GroupStateTimeout.NoTimeout
    out = stream.groupBy("match_id").applyInPandasWithState(run, schema, "state string", "append", timeout)
    return out.select(*(F.nanvl(c, F.lit(None).cast("double")).alias(c) if c in floats else F.col(c) for c in names))


def frame_rows(cands: DataFrame, frames: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """FRAME rows, one for each frame, from BALL_CAND: its plausible candidates as (conf, x1, y1, x2, y2), in order of cand_idx."""
    one = F.struct("cand_idx", F.array("conf", "x1", "y1", "x2", "y2").alias("c"))
    per = plausible(cands, p).groupBy("match_id", "frame_num").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["c"]).alias("candidates"))
    return frames.select("match_id", "frame_num").join(per, ["match_id", "frame_num"], "left")


def select_ball(frames: DataFrame, p: Params = DEFAULT, idle_minutes: int | None = None, delay: int = 0) -> DataFrame:
    """BALL_DET plus `late`, of a stream of FRAME rows, by the rule of the batch operator.

    The state is a position and a counter. A late frame takes its most confident candidate, as no anchor tells its candidates apart.
    """

    class Ball(Step):
        def __init__(self, match: object, kept: dict | None):
            super().__init__(match, kept)
            self.anchor = Anchor(p, tuple(kept["at"]) if kept and kept["at"] else None, kept["misses"] if kept else 0)

        def row(self, frame: int, value: list, anchor: Anchor, late: bool) -> list[tuple]:
            box = anchor.choose((conf, box) for conf, *box in value[0] or ())
            return [(self.match, frame, *(box or (None,) * 4), late)]

        def frame(self, frame: int, value: list) -> list[tuple]:
            return self.row(frame, value, self.anchor, False)

        def late(self, frame: int, value: list) -> list[tuple]:
            return self.row(frame, value, Anchor(p), True)

        def kept(self) -> dict:
            return {"at": self.anchor.at, "misses": self.anchor.misses}

    return in_match_order(frames, ["candidates"], Ball, BALL_DET + ", late boolean", delay, idle_minutes)


def track_rows(ball: DataFrame, matches: DataFrame) -> DataFrame:
    """TRACK_FRAME rows from BALL_DET, a row for every frame, and the matches' declared lengths."""
    return ball.join(matches.select("match_id", "total_frames"), "match_id", "left").select("match_id", "frame_num", "y1", "y2", "total_frames")


def shots(track: DataFrame, p: Params = DEFAULT, idle_minutes: int | None = None, delay: int = 0) -> DataFrame:
    """SHOTS plus `late`, of a stream of TRACK_FRAME rows: those of the batch operators, gap filling included.

    A shot is told when the frames that it looks ahead at are known: that is some L frames later, or, where the ball was out of sight, when it is seen again or the
    match has reached its declared length. A match of unknown length is taken for a long one, and its last frames, after the last sight, are never settled. A late
    frame is told by its number, without an index.
    """

    class Shots(Step):
        def __init__(self, match: object, kept: dict | None):
            super().__init__(match, kept)
            self.given, self.count = kept, kept["count"] if kept else 0
            self.turns = Turns(kept["n"], p, kept["turns"]) if kept else None

        def frame(self, frame: int, value: list) -> Iterator[tuple]:
            y1, y2, n = value
            self.turns = self.turns or Turns(n, p)
            for f in self.turns.frame(frame, None if y1 is None else (y1, y2)):
                yield self.match, self.count, f, False
                self.count += 1

        def late(self, frame: int, value: list) -> list[tuple]:
            return [(self.match, None, frame, True)]

        def kept(self) -> dict | None:
            return self.turns and {"n": self.turns.n, "turns": self.turns.kept(), "count": self.count}

    return in_match_order(track, ["y1", "y2", "total_frames"], Shots, SHOTS + ", late boolean", delay, idle_minutes)


def player_rows(dets: DataFrame, bounds: DataFrame, frames: DataFrame) -> DataFrame:
    """PLAYER_FRAME rows, one for each frame, from PLAYER_DET: the players in court, by track."""
    one = F.struct("track_id", F.array(*(F.col(c).cast("double") for c in ("track_id", "cx", "cy", "x1", "y1", "x2", "y2"))).alias("d"))
    per = players.in_court(dets, bounds).groupBy("match_id", "frame_num").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["d"]).alias("seen"))
    return frames.select("match_id", "frame_num").join(per, ["match_id", "frame_num"], "left")


def assign_slots(frames: DataFrame, p: Params = DEFAULT, idle_minutes: int | None = None, delay: int = 0) -> DataFrame:
    """PLAYER_SLOT plus `late`, of a stream of PLAYER_FRAME rows, by the step of the batch operator: the state is four tracks and four places.

    A late frame with players gets one row without a slot, as its identities would depend on frames that were dealt without it.
    """

    class Players(Step):
        def __init__(self, match: object, kept: dict | None):
            super().__init__(match, kept)
            places = [at and tuple(at) for at in kept["places"]] if kept else None
            self.slots = players.Slots(p, kept["tracks"], places, kept["last"]) if kept else players.Slots(p)

        def frame(self, frame: int, value: list) -> Iterator[tuple]:
            if value[0]:
                seen = ((int(t), int(cx), int(cy), box) for t, cx, cy, *box in value[0])
                for k, (slot, box) in enumerate(self.slots.deal(frame, seen).items()):
                    yield self.match, frame, slot, k, *box, False

        def late(self, frame: int, value: list) -> list[tuple]:
            return [(self.match, frame, *(None,) * 6, True)] if value[0] else []

        def kept(self) -> dict:
            return {"tracks": list(self.slots.track.values()), "places": list(self.slots.place.values()), "last": self.slots.last}

    return in_match_order(frames, ["seen"], Players, PLAYER_SLOT + ", late boolean", delay, idle_minutes)


def highlight_rows(shots_: DataFrame, segments: DataFrame, matches: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """HIGHLIGHT_EVENT rows of shots, segments and ends of matches (MATCHES: a match is in it when it is over)."""
    own = matches.select("match_id", G.fps_or_default("fps", p.default_fps).alias("fps"), "total_frames")
    none = lambda t: F.lit(None).cast(t)
    rows = shots_.select("match_id", F.lit(SHOT).alias("kind"), "frame_num", none("bigint").alias("seg_idx"), none("double").alias("dt"), none("double").alias("px"))
    rows = rows.unionByName(segments.select("match_id", F.lit(SEGMENT).alias("kind"), F.col("sf").alias("frame_num"), "seg_idx", "dt", "px"))
    ends = own.select("match_id", F.lit(END).alias("kind"), (F.col("total_frames") - 1).alias("frame_num"), none("bigint").alias("seg_idx"), none("double").alias("dt"), none("double").alias("px"))
    return rows.unionByName(ends).join(own, "match_id")


def highlights(events: DataFrame, p: Params = DEFAULT, idle_minutes: int | None = None) -> DataFrame:
    """HIGHLIGHTS of a stream of HIGHLIGHT_EVENT rows: the merged intervals of a match when it is over, as speeds are shares of its highest one.

    A match is over with its end event, whatever comes in the same micro-batch counting, or, with `idle_minutes`, after so long without one. What comes after is
    marked late, with its frame as start. The state grows with the shots of a match, not its frames, and goes when it is over, but for a mark.
    """
    names = [c.split()[0] for c in HIGHLIGHTS.split(", ")]

    def table(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=names).astype({"timestamp_seconds": "float64", "end_frame": "Int64", "start_frame": "Int64"})

    def run(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = json.loads(state.get[0]) if state.exists else {"over": False, "clips": None, "of": None}
        match = key[0].item() if hasattr(key[0], "item") else key[0]
        told = lambda clips, of: table([(match, *c, False) for c in clips.merged(*of)])
        if state.hasTimedOut:
            state.remove()
            if not kept["over"] and kept["of"]:
                yield told(Clips(p, kept["clips"]), kept["of"])
            return
        clips, late, over = Clips(p, kept["clips"]), [], False
        for b in batches:
            for kind, frame, idx, dt, px, fps, n in zip(*(map(_plain, b[c].tolist()) for c in ("kind", "frame_num", "seg_idx", "dt", "px", "fps", "total_frames")), strict=True):
                if kept["over"]:
                    late.append((match, frame, None, None, None, True))
                elif kind == SHOT:
                    clips.shot(int(frame))
                elif kind == SEGMENT:
                    clips.segment(int(idx), int(frame), dt, px)
                over = over or kind == END
                kept["of"] = (fps, int(n)) if n is not None else kept["of"]
        if over and not kept["over"]:
            yield told(clips, kept["of"])
            kept, clips = {"over": True, "clips": None, "of": None}, Clips(p)
        if late:
            yield table(late)
        state.update((json.dumps(kept | {"clips": None if kept["over"] else clips.kept()}),))
        if idle_minutes:
            state.setTimeoutDuration(idle_minutes * 60_000)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_minutes else GroupStateTimeout.NoTimeout
    out = events.groupBy("match_id").applyInPandasWithState(run, HIGHLIGHTS, "state string", "append", timeout)
    return out.withColumn("timestamp_seconds", F.nanvl("timestamp_seconds", F.lit(None).cast("double")))


def job_board(events: DataFrame) -> DataFrame:
    """The latest state of every job over a stream of job events; write it in update or complete mode."""
    return reports.job_status(events)
