"""Court coverage: grids of time spent, smoothed, and ball trajectories."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..schemas import DEFAULT, Params
from .ranges import AT, carried, plain, within
from .stats import balls, players


def court_positions(pos: DataFrame, matches: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(match_id, player_id, frame_num, x_m, y_m) of players, clipped to the court."""
    at = players(pos).join(matches.select("match_id", "court"), "match_id")
    return at.withColumn("q", G.court_metres("mx", "my", "court", p.court_width_m, p.court_length_m)).select("match_id", "player_id", "frame_num", "q.x_m", "q.y_m")


def bins(at: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(match_id, player_id, bx, by, n): samples in each cell of a grid over the court; the last cell of each axis is closed."""
    cell = lambda c, size: F.least(F.floor(F.col(c) / size * p.grid), F.lit(p.grid - 1)).cast("int")
    return at.groupBy("match_id", "player_id", cell("x_m", p.court_width_m).alias("bx"), cell("y_m", p.court_length_m).alias("by")).agg(F.count(F.lit(1)).alias("n"))


def gate(at: DataFrame, least_spread: float = 0.05) -> DataFrame:
    """(match_id, player_id, n, sigma_x, sigma_y, render_mode): density needs two samples and some spread; else a scatter, or nothing."""
    g = at.groupBy("match_id", "player_id").agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("x_m").alias("sigma_x"), F.stddev_pop("y_m").alias("sigma_y"))
    spread = (F.col("sigma_x") > least_spread) | (F.col("sigma_y") > least_spread)
    return g.withColumn("render_mode", F.when((F.col("n") >= 2) & spread, "density").when(F.col("n") >= 1, "scatter").otherwise("blank"))


def kernel(p: Params = DEFAULT) -> list[float]:
    """Weights of a Gaussian cut off at four sigma, from -radius to radius."""
    sigma = max(2, min(p.sigma, p.grid // 20))
    w = [math.exp(-d * d / (2 * sigma * sigma)) for d in range(-4 * sigma, 4 * sigma + 1)]
    return [x / math.fsum(w) for x in w]


def folded(p: Params = DEFAULT) -> np.ndarray:
    """The kernel as a matrix over the cells of one axis; what falls outside is reflected back in."""
    w, n = kernel(p), p.grid
    out, r = np.zeros((n, n)), len(w) // 2
    for i in range(n):
        for o, x in enumerate(w):
            t = (i + o - r) % (2 * n)
            out[min(t, 2 * n - 1 - t), i] += x
    return out


def smoothed(counts: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(match_id, player_id, bx, by, density): counts smoothed along both axes, as shares of each grid's maximum. Cells that nothing reaches are left out.

    A grid is one row of at most grid x grid cells, whatever the length of the match; both axes are smoothed in one map.
    """
    grids = counts.groupBy("match_id", "player_id").agg(F.collect_list(F.struct("bx", "by", "n")).alias("cells"))
    schema = f"match_id {counts.schema['match_id'].dataType.simpleString()}, player_id int, bx int, by int, density double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = folded(p)
        for batch in batches:
            for i in range(batch.num_rows):
                cells = batch.column(2).slice(i, 1).flatten()
                bx, by, n = (cells.field(k).to_numpy() for k in range(3))
                grid = np.zeros((p.grid, p.grid))
                grid[bx, by] = n
                v = m @ grid @ m.T
                x, y = np.nonzero(v)
                ids = [batch.column(k).take(pa.array(np.full(len(x), i))) for k in range(2)]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(x, pa.int32()), pa.array(y, pa.int32()), pa.array(v[x, y] / (v.max() + 1e-8))], ["match_id", "player_id", "bx", "by", "density"])

    return grids.select("match_id", F.col("player_id").cast("int"), "cells").mapInArrow(run, schema)


def extents(pos: DataFrame) -> DataFrame:
    """(match_id, entity, player_id, n, min_x, max_x, min_y, max_y): raw extents of the plan positions, in pixels."""
    return pos.groupBy("match_id", "entity", "player_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("mx").alias("min_x"), F.max("mx").alias("max_x"), F.min("my").alias("min_y"), F.max("my").alias("max_y")
    )


def position_coverage(frames: DataFrame, pos: DataFrame) -> DataFrame:
    """(match_id, frames, with_players, with_ball): frames of a match, and those with a position of any player, and of the ball."""
    one = pos.groupBy("match_id", "frame_num").agg(F.max((F.col("entity") == "player").cast("int")).alias("p"), F.max((F.col("entity") == "ball").cast("int")).alias("b"))
    every = frames.select("match_id", "frame_num").join(one, ["match_id", "frame_num"], "left")
    return every.groupBy("match_id").agg(F.count(F.lit(1)).alias("frames"), F.coalesce(F.sum("p"), F.lit(0)).alias("with_players"), F.coalesce(F.sum("b"), F.lit(0)).alias("with_ball"))


def trajectory(pos: DataFrame, matches: DataFrame, p: Params = DEFAULT, span: int | None = None) -> DataFrame:
    """(match_id, frame_num, x_m, y_m, zone, step, rel_speed, insufficient_data): ball positions in metres; a step joins positions next to each other in time, passing over missing frames.

    Matches under `min_positions` positions are flagged; no positions are made up.
    """
    at = balls(pos).join(matches.select("match_id", "court"), "match_id")
    at = at.withColumn("q", G.court_metres("bx", "by", "court", p.court_width_m, p.court_length_m)).select("match_id", "frame_num", "q.x_m", "q.y_m")
    rows = carried(at, F.struct("x_m", "y_m"), span=span)
    before = F.last(AT, ignorenulls=True).over(within().rowsBetween(Window.unboundedPreceding, -1))
    t = plain(rows.withColumn("_p", before)).withColumn("step", G.distance("x_m", "y_m", "_p.v.x_m", "_p.v.y_m")).drop("_p")
    whole = t.groupBy("match_id").agg(F.max("step").alias("top"), F.count(F.lit(1)).alias("n"))
    return t.join(whole, "match_id").withColumns({
        "zone": G.zone("y_m"),
        "rel_speed": F.col("step") / F.greatest("top", F.lit(1e-8)),
        "insufficient_data": F.col("n") < p.min_positions,
    }).drop("top", "n")


def zone_occupancy(at: DataFrame) -> DataFrame:
    """(match_id, player_id, zone, frames)"""
    return at.groupBy("match_id", "player_id", G.zone("y_m").alias("zone")).agg(F.count(F.lit(1)).alias("frames"))
