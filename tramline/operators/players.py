"""Players: court box filter, census, fallback court, and the four stable identities."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..schemas import DEFAULT, PLAYER_SLOT, Params
from .sequential import in_order


def court_bounds(keypoints: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(match_id, min_x, max_x, min_y, max_y) of the key points, padded. Points at the origin don't count."""
    real = keypoints.where((F.col("x") > 0) | (F.col("y") > 0))
    return real.groupBy("match_id").agg(
        (F.min("x") - p.court_pad).alias("min_x"), (F.max("x") + p.court_pad).alias("max_x"), (F.min("y") - p.court_pad).alias("min_y"), (F.max("y") + p.court_pad).alias("max_y")
    )


def in_court(dets: DataFrame, bounds: DataFrame) -> DataFrame:
    """Detections whose truncated centre lies in the padded court; matches without key points take 0..10000."""
    cx, cy = G.whole(G.center_x()), G.whole(G.center_y())
    b = dets.join(bounds, "match_id", "left").withColumns({"cx": cx, "cy": cy})
    side = lambda c, low, high: F.col(c).between(F.coalesce(f"min_{low}", F.lit(0.0)), F.coalesce(f"max_{high}", F.lit(10000.0)))
    return b.where(side("cx", "x", "x") & side("cy", "y", "y")).select(*dets.columns, "cx", "cy")


def census(dets: DataFrame) -> DataFrame:
    """(match_id, tracks, detections, track_ids)"""
    return dets.groupBy("match_id").agg(F.countDistinct("track_id").alias("tracks"), F.count(F.lit(1)).alias("detections"), F.array_sort(F.collect_set("track_id")).alias("track_ids"))


def court_from_feet(feet: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(match_id, n, x0, y0, x1, y1): the box of all feet, widened; the fallback where key points are missing. Under four feet it is null."""
    x, y = (F.col(c).cast("double") for c in ("foot_x", "foot_y"))
    box = feet.groupBy("match_id").agg(F.count(F.lit(1)).alias("n"), F.min(x).alias("x0"), F.min(y).alias("y0"), F.max(x).alias("x1"), F.max(y).alias("y1"))
    dx, dy = (F.col("x1") - F.col("x0")) * p.feet_margin, (F.col("y1") - F.col("y0")) * p.feet_margin
    enough = F.col("n") >= 4
    return box.select("match_id", "n", *(F.when(enough, v).alias(c) for c, v in (("x0", F.col("x0") - dx), ("y0", F.col("y0") - dy), ("x1", F.col("x1") + dx), ("y1", F.col("y1") + dy))))


class Slots:
    """The identities of a match, given the frames before: the track and the last place of each slot, and the last frame with a detection in court."""

    def __init__(self, p: Params = DEFAULT, tracks: list[int | None] | None = None, places: list[tuple[int, int] | None] | None = None, last: int | None = None):
        self.p, self.ids, self.last = p, range(1, p.n_players + 1), last
        self.track = dict(zip(self.ids, tracks or [None] * p.n_players, strict=True))
        self.place = dict(zip(self.ids, places or [None] * p.n_players, strict=True))

    def deal(self, frame: int, seen: Iterable[tuple[int, int, int, list[float]]]) -> dict[int, list[float]]:
        """Boxes by slot, in the order in which they were dealt, from (track, cx, cy, box) of a frame, by track."""
        track, place, p = self.track, self.place, self.p
        if self.last is not None and frame > self.last + 1:
            track.update(dict.fromkeys(self.ids))
        self.last = frame
        free = {r[0]: r for r in seen}
        taken: dict[int, list[float]] = {}

        def give(slot: int, tid: int) -> None:
            _, cx, cy, box = free.pop(tid)
            track[slot], place[slot], taken[slot] = tid, (cx, cy), box

        def far(tid: int, x: int, y: int) -> float:
            return ((free[tid][1] - x) ** 2 + (free[tid][2] - y) ** 2) ** 0.5

        for slot in self.ids:
            if track[slot] in free:
                give(slot, track[slot])
        empty = [s for s in self.ids if s not in taken]
        if len(empty) == p.n_players and not any(place.values()) and len(free) >= p.n_players:
            for slot, tid in zip(self.ids, sorted(free, key=lambda t: (free[t][2], free[t][1]))):
                give(slot, tid)
            empty = []
        for slot in empty:
            if place[slot] is None:
                if free:
                    give(slot, min(free))
                continue
            near = min(free, key=lambda t: far(t, *place[slot]), default=None)
            if near is not None and far(near, *place[slot]) < p.slot_accept:
                give(slot, near)
            else:
                track[slot] = None
        return taken


def assign_slots(dets: DataFrame, bounds: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(match_id, frame_num, player_id, slot_ord, box): four identities kept over track losses.

    A slot keeps its track while that is visible; the first four tracks are dealt by (cy, cx); afterwards an empty slot takes the nearest free track within `slot_accept`
    pixels of its last place, and a slot that never had one the free track of least id. A frame without any detection in court loses all tracks, not the places.
    Frames pass in order; the state of a match is four tracks and four places.
    """

    def deal(match: object, rows: Iterator[tuple]) -> Iterator[tuple]:
        slots = Slots(p)
        for frame, seen in groupby(rows, key=itemgetter(0)):
            for k, (slot, box) in enumerate(slots.deal(frame, ((t, cx, cy, box) for _, t, cx, cy, *box in seen)).items()):
                yield (match, frame, slot, k, *box)

    return in_order(in_court(dets, bounds), ["frame_num", "track_id"], ["frame_num", "track_id", "cx", "cy", "x1", "y1", "x2", "y2"], deal, PLAYER_SLOT)
