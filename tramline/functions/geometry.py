"""Column functions for boxes, distances, court projection and units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

C = Column | str


def _c(x: C) -> Column:
    return F.col(x) if isinstance(x, str) else x


def center_x(x1: C = "x1", x2: C = "x2") -> Column:
    return (_c(x1) + _c(x2)) / 2


def center_y(y1: C = "y1", y2: C = "y2") -> Column:
    return (_c(y1) + _c(y2)) / 2


def whole(x: C) -> Column:
    """Integer part, toward zero."""
    return _c(x).cast("int")


def foot_x(x1: C = "x1", x2: C = "x2") -> Column:
    return whole(center_x(x1, x2))


def foot_y(y2: C = "y2") -> Column:
    return whole(y2)


def foot_point(x1: C = "x1", x2: C = "x2", y2: C = "y2") -> Column:
    """struct(x, y) of the feet; the height keeps its fraction."""
    return F.struct(foot_x(x1, x2).alias("x"), _c(y2).alias("y"))


def height(y1: C = "y1", y2: C = "y2") -> Column:
    return _c(y2) - _c(y1)


def distance(ax: C, ay: C, bx: C, by: C) -> Column:
    dx, dy = _c(ax) - _c(bx), _c(ay) - _c(by)
    return F.sqrt(dx * dx + dy * dy)


def axis_distances(ax: C, ay: C, bx: C, by: C) -> Column:
    return F.struct(F.abs(_c(ax) - _c(bx)).alias("dx"), F.abs(_c(ay) - _c(by)).alias("dy"))


def closest_by_height(y: C, points: C) -> Column:
    """Index of the (x, y) struct in an array whose y is nearest; the first of equals."""
    ranked = F.transform(_c(points), lambda p, i: F.struct(F.abs(_c(y) - p["y"]).alias("d"), i.alias("i")))
    return F.array_min(ranked)["i"]


def flat_points(points_by_class: C) -> Column:
    """All key points of a map class -> array of points, in one array."""
    return F.flatten(F.map_values(_c(points_by_class)))


def px_to_m(px: C, court_px: C, court_m: float = 10.0) -> Column:
    return F.try_divide(_c(px) * court_m, _c(court_px))


def m_to_px(m: C, court_px: C, court_m: float = 10.0) -> Column:
    return _c(m) * _c(court_px) / court_m


def kmh_per_frame(m: C, fps: C) -> Column:
    return _c(m) * _c(fps) * 3.6


def kmh(m: C, seconds: C) -> Column:
    return F.try_divide(_c(m), _c(seconds)) * 3.6


def fps_or_default(fps: C, default: float = 24.0) -> Column:
    return F.when(_c(fps).isNull() | F.isnan(_c(fps)) | (_c(fps) <= 1), F.lit(default)).otherwise(_c(fps))


def hundredths(x: C) -> Column:
    """Rounded to two decimals, halves up."""
    return F.floor(_c(x) * 100 + 0.5) / 100


def js_round(x: C) -> Column:
    return F.floor(_c(x) + 0.5)


def clock(seconds: C) -> Column:
    """m:ss"""
    s = _c(seconds)
    return F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad(F.floor(s % 60).cast("string"), 2, "0"))


def clamp(x: C, low: C | float, high: C | float) -> Column:
    lit = lambda v: v if isinstance(v, Column) else _c(v) if isinstance(v, str) else F.lit(v)
    return F.greatest(lit(low), F.least(lit(high), _c(x)))


def layout(frame_w: C = "frame_w", frame_h: C = "frame_h") -> Column:
    """The mini court on a frame: struct(pad, buffer, width, height, x0, y0, x1, y1), in pixels, anchored bottom right."""
    w, h = _c(frame_w), _c(frame_h)
    scale = clamp(F.least(w / 1280, h / 720), 0.65, 1.2)
    tall = whole(clamp(h * 0.35, 140.0, 240.0))
    wide = whole(tall / 2)
    pad, buffer = whole(F.greatest(F.lit(6.0), 8 * scale)), whole(F.greatest(F.lit(10.0), 15 * scale))
    x1, y1 = w - buffer - pad, h - buffer - pad
    return F.struct(pad.alias("pad"), buffer.alias("buffer"), wide.alias("width"), tall.alias("height"), (x1 - wide).alias("x0"), (y1 - tall).alias("y0"), x1.alias("x1"), y1.alias("y1"))


SERVICE_LINE_M = 6.95
#: Key points of the mini court (fixed values): share of its width, and metres from the net, by which service lines lie, or an end of the court.
COURT_POINTS = {
    "TL": (0.0, "top"), "TR": (1.0, "top"), "BL": (0.0, "bottom"), "BR": (1.0, "bottom"), "NetL": (0.0, 0.0), "NetR": (1.0, 0.0),
    "TopSL_L": (0.0, -SERVICE_LINE_M), "TopSL_R": (1.0, -SERVICE_LINE_M), "BotSL_L": (0.0, SERVICE_LINE_M), "BotSL_R": (1.0, SERVICE_LINE_M),
    "TopCenter": (0.5, -SERVICE_LINE_M), "BotCenter": (0.5, SERVICE_LINE_M), "NetCenter": (0.5, 0.0),
}
#: Lines between them (fixed values).
COURT_LINES = (("TL", "TR"), ("BL", "BR"), ("TL", "BL"), ("TR", "BR"), ("TopSL_L", "TopSL_R"), ("BotSL_L", "BotSL_R"), ("TopCenter", "NetCenter"), ("BotCenter", "NetCenter"))


def court_points(court: C = "court") -> Column:
    """Map from name to struct(x, y) of the court's key points, in pixels."""
    c = _c(court)

    def at(u: float, v: str | float) -> Column:
        y = c["y0"].cast("double") if v == "top" else c["y1"].cast("double") if v == "bottom" else c["y0"] + c["height"] / 2 + m_to_px(F.lit(v), c["width"])
        return F.struct((c["x0"] + c["width"] * u).alias("x"), y.alias("y"))

    return F.create_map(*(x for name, (u, v) in COURT_POINTS.items() for x in (F.lit(name), at(u, v))))


def court_lines(court: C = "court") -> Column:
    """Array of struct(name, ax, ay, bx, by): the lines of the court, in pixels."""
    at = lambda points, name, axis: points[name][axis]
    points = court_points(court)
    return F.array(*(F.struct(F.lit(f"{a}-{b}").alias("name"), at(points, a, "x").alias("ax"), at(points, a, "y").alias("ay"), at(points, b, "x").alias("bx"), at(points, b, "y").alias("by")) for a, b in COURT_LINES))


def project(x: C, y: C, h: C, court: C) -> Column:
    """struct(mx, my): the point on the court plan by homography `h` (9 numbers, row by row), clamped to the court and truncated.

    A null homography leaves the point as it is.
    """
    x, y, h, court = map(_c, (x, y, h, court))
    g = lambda i: F.get(h, i)
    w = g(6) * x + g(7) * y + g(8)
    px, py = F.try_divide(g(0) * x + g(1) * y + g(2), w), F.try_divide(g(3) * x + g(4) * y + g(5), w)
    inside = F.struct(whole(clamp(px, court["x0"], court["x1"])).alias("mx"), whole(clamp(py, court["y0"], court["y1"])).alias("my"))
    return F.when(h.isNull(), F.struct(whole(x).alias("mx"), whole(y).alias("my"))).otherwise(inside)


def court_metres(mx: C, my: C, court: C, width_m: float = 10.0, length_m: float = 20.0) -> Column:
    """struct(x_m, y_m): pixels of the plan to metres, clipped to the court, each axis by its own scale."""
    c = _c(court)
    share = lambda v, a, b: clamp((_c(v) - a) / F.greatest(b - a, F.lit(1)), 0.0, 1.0)
    return F.struct((share(mx, c["x0"], c["x1"]) * width_m).alias("x_m"), (share(my, c["y0"], c["y1"]) * length_m).alias("y_m"))


#: Zones along the court in metres (fixed values); the last one is closed.
ZONES = (
    (0.0, 3.5, "BASELINE"), (3.5, 6.95, "MIDDLE"), (6.95, 8.5, "SMASH"), (8.5, 10.0, "NET"),
    (10.0, 11.5, "NET"), (11.5, 13.05, "SMASH"), (13.05, 16.5, "MIDDLE"), (16.5, 20.0, "BASELINE"),
)


def zone(y_m: C, zones: tuple[tuple[float, float, str], ...] = ZONES) -> Column:
    out = F.lit(None).cast("string")
    for a, b, name in zones:
        out = F.when((_c(y_m) >= a) & (_c(y_m) < b), F.lit(name)).otherwise(out)
    return F.when(_c(y_m) >= zones[-1][1], F.lit(zones[-1][2])).otherwise(out)
