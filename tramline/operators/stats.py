"""Movement and shot statistics from court-plan positions.

All speeds use the court's width for pixels and metres of both axes, and whole pixels, as the plan holds them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..schemas import DEFAULT, Params
from .ranges import OWN, halo, within


def players(pos: DataFrame) -> DataFrame:
    return pos.where(F.col("entity") == "player").select("match_id", "frame_num", "player_id", "slot_ord", "mx", "my")


def balls(pos: DataFrame) -> DataFrame:
    return pos.where(F.col("entity") == "ball").select("match_id", "frame_num", F.col("mx").alias("bx"), F.col("my").alias("by"))


def _dims(matches: DataFrame, p: Params) -> DataFrame:
    return matches.select("match_id", G.fps_or_default("fps", p.default_fps).alias("fps"), F.col("court.width").alias("court_px"))


def steps(pos: DataFrame, matches: DataFrame, p: Params = DEFAULT, span: int | None = None) -> DataFrame:
    """(match_id, frame_num, player_id, step_m, step_kmh): displacement of players seen in two frames running."""
    w = within("player_id")
    # matches first: what their join deals by match, should it deal, the window takes as it is
    at = halo(players(pos).join(_dims(matches, p), "match_id"), 1, 0, span).withColumns({c + "0": F.lag(c).over(w) for c in ("frame_num", "mx", "my")})
    near = at.where(F.col(OWN) & (F.col("frame_num0") == F.col("frame_num") - 1))
    m = G.px_to_m(G.distance("mx", "my", "mx0", "my0"), "court_px", p.court_width_m)
    return near.withColumn("step_m", m).select("match_id", "frame_num", "player_id", "step_m", G.kmh_per_frame("step_m", "fps").alias("step_kmh"))


def movement(pos: DataFrame, matches: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(match_id, player_id, distance_covered, avg_player_speed, steps), only for players that moved in view."""
    return steps(pos, matches, p, p.span).groupBy("match_id", "player_id").agg(F.sum("step_m").alias("distance_covered"), F.avg("step_kmh").alias("avg_player_speed"), F.count(F.lit(1)).alias("steps"))


def at_shots(pos: DataFrame, shots: DataFrame) -> DataFrame:
    """Positions in the frames of shots, some 1 in 25: all that segments and what they add to the players look at."""
    return pos.join(shots.select("match_id", "frame_num"), ["match_id", "frame_num"], "left_semi").select(*pos.columns)


def segments(shots: DataFrame, pos: DataFrame, matches: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(match_id, seg_idx, sf, ef, dt, px, ball ends): from each shot to the next; the last shot starts none. px is null where the ball is missing at an end."""
    pairs = shots.withColumn("ef", F.lead("frame_num").over(Window.partitionBy("match_id").orderBy("shot_idx"))).where(F.col("ef").isNotNull())
    pairs = pairs.select("match_id", F.col("shot_idx").alias("seg_idx"), F.col("frame_num").alias("sf"), "ef").join(_dims(matches, p), "match_id")
    b = balls(pos)
    start, end = (b.select("match_id", F.col("frame_num").alias(f), F.col("bx").alias("bx" + n), F.col("by").alias("by" + n)) for f, n in (("sf", "0"), ("ef", "1")))
    out = pairs.join(start, ["match_id", "sf"], "left").join(end, ["match_id", "ef"], "left")
    return out.withColumns({"dt": (F.col("ef") - F.col("sf")) / F.col("fps"), "px": G.distance("bx0", "by0", "bx1", "by1")})


def attribution(segs: DataFrame, pos: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Segments with the ball at both ends and a player in view, with hitter (nearest to the ball at the start; the earliest slot of equals) and speed in km/h."""
    at = players(pos).withColumnRenamed("frame_num", "sf")
    good = segs.where(F.col("px").isNotNull() & (F.col("dt") > 0))
    near = good.join(at, ["match_id", "sf"]).groupBy("match_id", "seg_idx", "sf", "ef", "dt", "px", "court_px").agg(
        F.min_by("player_id", F.struct(G.distance("mx", "my", "bx0", "by0"), "slot_ord")).alias("hitter")
    )
    return near.withColumn("speed", G.kmh(G.px_to_m("px", "court_px", p.court_width_m), "dt")).drop("px")


def shot_events(attributed: DataFrame, pos: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(match_id, frame_num, seg_idx, player_id, shots, shot_speed, player_speed): for each segment what it adds to each player. Speeds are null where nothing is added."""
    a, b = (players(pos).select("match_id", F.col("frame_num").alias(f), "player_id", F.col("mx").alias("x" + n), F.col("my").alias("y" + n)) for f, n in (("sf", "0"), ("ef", "1")))
    moved = attributed.join(a, ["match_id", "sf"]).join(b, ["match_id", "ef", "player_id"])
    moved = moved.select("match_id", F.col("sf").alias("frame_num"), "seg_idx", "player_id", F.lit(0).alias("shots"), F.lit(None).cast("double").alias("shot_speed"), G.kmh(G.px_to_m(G.distance("x0", "y0", "x1", "y1"), "court_px", p.court_width_m), "dt").alias("player_speed"))
    hits = attributed.select("match_id", F.col("sf").alias("frame_num"), "seg_idx", F.col("hitter").alias("player_id"), F.lit(1).alias("shots"), F.col("speed").alias("shot_speed"), F.lit(None).cast("double").alias("player_speed"))
    return hits.unionByName(moved).groupBy("match_id", "frame_num", "seg_idx", "player_id").agg(F.sum("shots").alias("shots"), F.max("shot_speed").alias("shot_speed"), F.max("player_speed").alias("player_speed"))


def ends(frames: DataFrame) -> DataFrame:
    """(match_id, first, last): the frames of each match, which are numbered without holes."""
    return frames.groupBy("match_id").agg(F.min("frame_num").alias("first"), F.max("frame_num").alias("last"))


def spans(of: DataFrame, events: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(match_id, player_id, valid_from, valid_to, accumulators): what a player has gathered, from one segment's start to the next one's; without gaps from first to last frame.

    A player's rows are as many as the segments that add to them, with one of zeros before: windows run over those, not over frames.
    """
    ids = F.explode(F.array(*(F.lit(i) for i in range(1, p.n_players + 1)))).alias("player_id")
    none = {"shots": "bigint", "shot_speed": "double", "player_speed": "double"}
    nothing = of.select("match_id", F.col("first").alias("frame_num"), ids, *(F.lit(None).cast(t).alias(c) for c, t in none.items()), F.lit(0).alias("ord"))
    rows = nothing.unionByName(events.select("match_id", "frame_num", "player_id", *none, F.lit(1).alias("ord")))
    order = Window.partitionBy("match_id", "player_id").orderBy("frame_num", "ord")
    running = order.rowsBetween(Window.unboundedPreceding, 0)

    def total(c: str) -> Column:
        return F.coalesce(F.sum(c).over(running), F.lit(0))

    def latest(c: str) -> Column:
        return F.coalesce(F.last(c, ignorenulls=True).over(running), F.lit(0.0))

    out = rows.select(
        "match_id", "player_id", F.col("frame_num").alias("valid_from"), (F.lead("frame_num").over(order) - 1).alias("valid_to"), total("shots").cast("bigint").alias("number_of_shots"), total("shot_speed").cast("double").alias("total_shot_speed"),
        latest("shot_speed").alias("last_shot_speed"), total("player_speed").cast("double").alias("total_player_speed"), latest("player_speed").alias("last_player_speed"),
    )
    out = out.join(of.select("match_id", "last"), "match_id").withColumn("valid_to", F.least(F.coalesce("valid_to", "last"), "last")).drop("last").where(F.col("valid_from") <= F.col("valid_to"))
    return out.withColumns({
        "average_shot_speed": F.coalesce(F.try_divide("total_shot_speed", "number_of_shots"), F.lit(0.0)),
        "average_player_speed": F.col("total_player_speed") / F.greatest("number_of_shots", F.lit(1)),
    })


def every_frame(rows: DataFrame) -> DataFrame:
    """Spans as one row for each of their frames (frame_num in place of valid_from and valid_to)."""
    frame = F.explode(F.sequence("valid_from", "valid_to")).alias("frame_num")
    return rows.select("match_id", frame, *(c for c in rows.columns if c not in ("match_id", "valid_from", "valid_to")))


def frame_stats(frames: DataFrame, events: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Accumulators of every frame and player, carried forward from the segments before it: one row for each (match_id, frame_num, player_id)."""
    return every_frame(spans(ends(frames), events, p))


def summary(matches: DataFrame, pos: DataFrame, events: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(match_id, player_id, total_shots, avg_shot_speed, max_shot_speed, avg_player_speed, distance_covered), players 1..n of every match, unrounded."""
    ids = F.explode(F.array(*(F.lit(i) for i in range(1, p.n_players + 1)))).alias("player_id")
    hits = events.groupBy("match_id", "player_id").agg(F.sum("shots").alias("total_shots"), F.sum("shot_speed").alias("s"), F.max("shot_speed").alias("max_shot_speed"))
    zero = F.lit(0.0)
    out = matches.select("match_id", ids).join(hits, ["match_id", "player_id"], "left").join(movement(pos, matches, p), ["match_id", "player_id"], "left")
    return out.select(
        "match_id", "player_id", F.coalesce("total_shots", F.lit(0)).cast("bigint").alias("total_shots"), F.coalesce(F.try_divide("s", F.nullif("total_shots", F.lit(0))), zero).alias("avg_shot_speed"),
        F.coalesce("max_shot_speed", zero).alias("max_shot_speed"), F.coalesce("avg_player_speed", zero).alias("avg_player_speed"), F.coalesce("distance_covered", zero).alias("distance_covered"),
    )
