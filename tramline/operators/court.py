"""Court geometry of each match: corner choice, homography, projection of players and ball."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..schemas import DEFAULT, Params


def class_points(keypoints: DataFrame) -> DataFrame:
    """(match_id, points): points of the first class that has four or more, else of all classes, in their order. Points at the origin don't count."""
    real = keypoints.where((F.col("x") > 0) | (F.col("y") > 0))
    point = F.struct("class_idx", "kp_idx", "x", "y")
    per = real.groupBy("match_id", "class_idx").agg(F.array_sort(F.collect_list(point)).alias("points"))
    many = F.when(F.size("points") >= 4, F.col("class_idx"))
    out = per.groupBy("match_id").agg(F.min_by("points", many).alias("first"), F.min(many).alias("found"), F.array_sort(F.flatten(F.collect_list("points"))).alias("every"))
    return out.select("match_id", F.when(F.col("found").isNotNull(), F.col("first")).otherwise(F.col("every")).alias("points"))


def quads(keypoints: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(match_id, x0, y0, .. x3, y3, is_court, fits): top left, top right, bottom right and bottom left of the court among the key points; whether they look like one, and
    whether they are a convex quadrilateral besides, which alone has a projective map to a rectangle: three points in a line have none.

    Of more than four points those of least and greatest sum and difference of x and y count, the first of equals, if they are four; else the first four. Under four points
    there is nothing. Each step is a projection of its own, so that no expression holds another many times.
    """
    first = lambda v: F.array_min(F.transform("points", lambda q, i: F.struct(v(q).alias("v"), i.alias("i"))))["i"]
    total, side = (lambda q: q["x"] + q["y"]), (lambda q: q["x"] - q["y"])
    extreme = F.array_distinct(F.array(first(total), first(lambda q: -side(q)), first(lambda q: -total(q)), first(side)))
    # by height, of equal heights in the order of the points
    by_y = F.array_sort(F.transform("points", lambda q, i: F.struct(q["y"].alias("y"), i.alias("i"), q["x"].alias("x"))))
    per = class_points(keypoints).where(F.size("points") >= 4).select("match_id", extreme.alias("extreme"), by_y.alias("by_y"))
    chosen = F.when((F.size("by_y") > 4) & (F.size("extreme") == 4), F.filter("by_y", lambda q: F.array_contains("extreme", q["i"]))).otherwise(F.filter("by_y", lambda q: q["i"] < 4))
    four = per.select("match_id", chosen.alias("q")).select("match_id", *(F.get("q", F.lit(k)).alias(n) for k, n in enumerate("abcd")))
    swap = lambda l, r: F.col(f"{r}.x") < F.col(f"{l}.x")
    left = lambda l, r, v: F.when(swap(l, r), F.col(f"{r}.{v}")).otherwise(F.col(f"{l}.{v}"))
    right = lambda l, r, v: F.when(swap(l, r), F.col(f"{l}.{v}")).otherwise(F.col(f"{r}.{v}"))
    places = (left, "a", "b"), (right, "a", "b"), (right, "c", "d"), (left, "c", "d")
    found = four.select("match_id", F.array(*(of(l, r, v) for of, l, r in places for v in "xy")).alias("c"))
    # an aggregate by the key that the rows are dealt by: it moves nothing, but conditions on the corners aren't pushed below it, where each would hold the choice many times
    out = found.groupBy("match_id").agg(F.any_value("c").alias("c")).select("match_id", *(F.col("c")[i].alias(n) for i, n in enumerate(CORNERS)))
    out = out.withColumn("is_court", (_spread("x") >= p.min_court_w) & (_spread("y") >= p.min_court_h))
    x, y = ([F.col(f"{v}{k}") for k in range(4)] for v in "xy")
    turn = [(x[(k + 1) % 4] - x[k]) * (y[(k + 2) % 4] - y[(k + 1) % 4]) - (y[(k + 1) % 4] - y[k]) * (x[(k + 2) % 4] - x[(k + 1) % 4]) for k in range(4)]
    least = F.lit(1e-9) * _spread("x") * _spread("y")
    return out.withColumn("fits", F.col("is_court") & ((F.least(*turn) > least) | (F.greatest(*turn) < -least)))


CORNERS = [f"{v}{k}" for k in range(4) for v in "xy"]


def _spread(axis: str) -> Column:
    of = [f"{axis}{k}" for k in range(4)]
    return F.greatest(*of) - F.least(*of)


def corners(keypoints: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(match_id, corners): x and y of the four corners in order, null where the key points don't look like a court."""
    found = quads(keypoints, p).where("is_court").select("match_id", F.array(*CORNERS).alias("corners"))
    return class_points(keypoints).select("match_id").join(found, "match_id", "left")


def projective(quad: DataFrame) -> DataFrame:
    """`quad` (rows of `quads` with the rectangle `court`) with `h`, the 9 numbers of the projective map from the corners to the rectangle: the unit square's map to the corners,
    turned round by its adjugate, then stretched. Null where the corners don't fit.
    """
    x, y = ([F.col(f"{v}{k}") for k in range(4)] for v in "xy")
    q = quad
    q = q.withColumns({"ex1": x[1] - x[2], "ex2": x[3] - x[2], "ex3": x[0] - x[1] + x[2] - x[3], "ey1": y[1] - y[2], "ey2": y[3] - y[2], "ey3": y[0] - y[1] + y[2] - y[3]})
    det = "(ex1 * ey2 - ex2 * ey1)"
    q = q.withColumns({"g": F.expr(f"try_divide(ex3 * ey2 - ex2 * ey3, {det})"), "k": F.expr(f"try_divide(ex1 * ey3 - ex3 * ey1, {det})")})
    q = q.withColumns({"a": F.expr("x1 - x0 + g * x1"), "b": F.expr("x3 - x0 + k * x3"), "d": F.expr("y1 - y0 + g * y1"), "e": F.expr("y3 - y0 + k * y3")})
    q = q.withColumns({"w0": F.expr("d * k - e * g"), "w1": F.expr("b * g - a * k"), "w2": F.expr("a * e - b * d")})
    across, down = ("e - y0 * k", "x0 * k - b", "b * y0 - x0 * e"), ("y0 * g - d", "a - x0 * g", "x0 * d - a * y0")
    rows = [f"(court.x1 - court.x0) * ({v}) + court.x0 * w{i}" for i, v in enumerate(across)] + [f"(court.y1 - court.y0) * ({v}) + court.y0 * w{i}" for i, v in enumerate(down)]
    return q.select(*quad.columns, F.when(F.col("fits"), F.array(*map(F.expr, rows), "w0", "w1", "w2")).alias("h"))


def with_layout(matches: DataFrame) -> DataFrame:
    """`matches` with `court`, the layout struct of the plan."""
    return matches.withColumn("court", G.layout())


def homographies(matches: DataFrame, keypoints: DataFrame, feet: DataFrame | None = None, p: Params = DEFAULT) -> DataFrame:
    """`matches` with `court` (layout struct) and `h` (array<double> of 9): one small solve for each match row, in columns.

    Where the key points are missing, don't look like a court or lie in a line, the box of all feet takes their place. Under four feet, or with all feet in a line along
    an axis, the map is the identity. Feet are summed up before they meet the matches, so that none are moved.
    """
    from .players import court_from_feet

    found = quads(keypoints, p)
    m = projective(with_layout(matches).join(found.drop("is_court"), "match_id", "left")).drop(*CORNERS, "fits")
    identity = F.array(*(F.lit(float(i % 4 == 0)) for i in range(9)))
    if feet is None:
        return m.withColumn("h", F.coalesce("h", identity))
    box = court_from_feet(feet, p).select("match_id", F.struct("x0", "y0", "x1", "y1").alias("box"))
    # from box to box: a scale and a shift along each axis
    scale = lambda axis: F.try_divide(F.col(f"court.{axis}1") - F.col(f"court.{axis}0"), F.col(f"box.{axis}1") - F.col(f"box.{axis}0"))
    shift = lambda axis: F.col(f"court.{axis}0") - F.col(f"box.{axis}0") * scale(axis)
    zero, one = F.lit(0.0), F.lit(1.0)
    from_feet = F.array(scale("x"), zero, shift("x"), zero, scale("y"), shift("y"), zero, zero, one)
    usable = scale("x").isNotNull() & scale("y").isNotNull()
    return m.join(box, "match_id", "left").withColumn("h", F.coalesce("h", F.when(usable, from_feet), identity)).drop("box")


def positions(matches: DataFrame, slots: DataFrame, ball: DataFrame) -> DataFrame:
    """(match_id, frame_num, entity, player_id, slot_ord, mx, my): feet of players and centre of the ball on the court plan.

    `matches` carries h and court, one row a match; Spark broadcasts it when it is small.
    """
    m = matches.select("match_id", "h", "court")
    players = slots.select("match_id", "frame_num", F.lit("player").alias("entity"), "player_id", "slot_ord", G.foot_x().alias("px"), G.foot_y().alias("py"))
    balls = ball.where(F.col("x1").isNotNull()).select("match_id", "frame_num", F.lit("ball").alias("entity"), F.lit(None).cast("int").alias("player_id"), F.lit(None).cast("int").alias("slot_ord"), G.whole(G.center_x()).alias("px"), G.whole(G.center_y()).alias("py"))
    at = players.unionByName(balls).join(m, "match_id").withColumn("p", G.project("px", "py", "h", "court"))
    return at.select("match_id", "frame_num", "entity", "player_id", "slot_ord", "p.mx", "p.my")
