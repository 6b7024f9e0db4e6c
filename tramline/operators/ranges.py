"""Windows in frame order: over whole matches, or, with a `span`, by ranges of so many frames, so that no task holds a match, however long it is.

A window that looks at a few rows on either side gets them as copies (`halo`). One that looks at the last or next value, however far, gets it as a row before and after the
range's own (`carried`): a first pass sums each range up in one row, and a window over those rows, a few for each match, tells what stands before and after it.
Frames of a track are dense: numbered without holes. Both ways give the same rows; ranges cost a second pass over the track, so that they are for matches that are too long for
a task (`span_for`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

#: Frames of a range: a quarter of an hour at 24 a second.
SPAN = 21_600
PART, OWN, AT = "_part", "_own", "_at"


def span_for(matches: DataFrame) -> int | None:
    """SPAN if a match is longer than that, by the matches' declared lengths (a row each); else None."""
    longest = matches.agg(F.max("total_frames")).first()[0]
    return SPAN if longest is not None and longest > SPAN else None


def part_of(span: int | None) -> Column:
    return F.floor(F.col("frame_num") / span).cast("bigint") if span else F.lit(0).cast("bigint")


def within(*keys: str) -> WindowSpec:
    """The window of a range, in frame order."""
    return Window.partitionBy("match_id", *keys, PART).orderBy("frame_num")


def halo(df: DataFrame, back: int, ahead: int, span: int | None = None) -> DataFrame:
    """`df` with its range (PART), and copies of the `back` frames before and the `ahead` frames after each range in it; OWN tells a range's own rows."""
    if not span:
        return df.withColumns({PART: part_of(span), OWN: F.lit(True)})
    if max(back, ahead) > span:
        raise ValueError(f"ranges of {span} frames are shorter than what is looked at")
    at = F.col("frame_num") % span
    parts = F.array(part_of(span), F.when(at >= span - back, part_of(span) + 1), F.when((at < ahead) & (part_of(span) > 0), part_of(span) - 1))
    copies = df.withColumn(PART, F.explode(F.array_compact(parts)))
    return copies.withColumn(OWN, F.col(PART) == part_of(span))


def carried(df: DataFrame, value: Column, keys: tuple[str, ...] = (), span: int | None = None) -> DataFrame:
    """`df` with its range and AT (struct of frame_num as f and `value`, null where `value` is), and in each range two rows more, which aren't its OWN: one before its
    frames with the last value of all ranges before it, one after them with the next value of all ranges after it.
    """
    own = df.withColumns({PART: part_of(span), AT: F.when(value.isNotNull(), F.struct(F.col("frame_num").alias("f"), value.alias("v"))), OWN: F.lit(True)})
    if not span:
        return own
    by = ["match_id", *keys]
    # structs compare by their first field, the frame
    summed = own.groupBy(*by, PART).agg(F.min(AT).alias("first"), F.max(AT).alias("last"))
    order = Window.partitionBy(*by).orderBy(PART)
    backwards = Window.partitionBy(*by).orderBy(F.col(PART).desc())
    before = F.last("last", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.last("first", ignorenulls=True).over(backwards.rowsBetween(Window.unboundedPreceding, -1))
    more = summed.withColumns({"_b": before, "_a": after})
    ends = F.explode(F.array(F.struct((F.col(PART) * span - 1).alias("frame_num"), F.col("_b").alias(AT)), F.struct(((F.col(PART) + 1) * span).alias("frame_num"), F.col("_a").alias(AT)))).alias("e")
    rows = more.select(*by, PART, ends).where(F.col(f"e.{AT}").isNotNull()).select(*by, PART, F.col("e.frame_num"), F.col(f"e.{AT}").alias(AT), F.lit(False).alias(OWN))
    return own.unionByName(rows, allowMissingColumns=True)


def plain(df: DataFrame) -> DataFrame:
    """Only the ranges' own rows, without what was added to them."""
    return df.where(OWN).drop(PART, OWN, AT)
