"""Mixing sources to target weights by hash-threshold histograms.

Sources are ranked by name (code points, null last) and weigh 3, 1, 2, 3, ... They share `budget` times all sizes by
weight; no target exceeds `cap` times its source's size, and what is over is shared again among the others.
A source takes all its rows floor(target / size) times, and once more the rows whose hash is at most a threshold.

The threshold is found without sorting: sizes are summed by (source, hash prefix), the bucket in which the running sum
crosses the rest of the target is the boundary, and only its rows are summed again by longer prefixes. After the last
level the boundary is one hash value, taken if that brings the sum nearer to the target.

A source's threshold is one row of fixed width. Rows meet it by broadcast while there are at most `BROADCAST_SOURCES` sources (a few MB), else by a join in which every
source is dealt to `SALTS` tasks; the results are the same. Texts are never shuffled.

A null text has size 0. A null source is a source of its own. Rows with equal ids have equal hashes and are taken or left together. A source
without words has target 0. Empty tables give empty results. Very long texts are counted whole. Columns of any name pass through `mixed`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, name

BUDGET = 1.5
CAP = 2.0
WEIGHTS = (3, 1, 2)
#: Hex digits of the hash that each level adds; the last level takes the whole hash.
LEVELS = (3, 6, 9, 32)
BROADCAST_SOURCES = 20_000
SALTS = 32


def source_key(source: Column) -> Column:
    """128 bits for a source of any length, null included."""
    return F.md5(F.coalesce(F.concat(F.lit("s"), source), F.lit("")))


def id_hash(id_: Column) -> Column:
    return F.md5(F.coalesce(id_.cast("string"), F.lit("")))


def sized(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(id, source, size) of every row; the text is read once, in the JVM."""
    starts = F.regexp_count(F.coalesce(name(text_col), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    return docs.select(name(id_col).alias("id"), name(source_col).alias("source"), starts.cast("bigint").alias("size"))


def running(rows: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """`rows` with place (from 0, in `order`) and, for each name in `sums`, the sum of a column over the rows before.

    Rows are dealt in ranges and summed within each; the ranges' totals, a row for each partition, tell what stands before a range.
    """
    dealt = checkpointed(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    totals = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("place0"), *(F.sum(c).alias(f"{k}0") for k, c in sums.items()))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("part").alias("of_part"), *(F.coalesce(F.sum(f"{k}0").over(earlier), F.lit(0)).alias(f"{k}0") for k in ("place", *sums)))
    within = Window.partitionBy("part").orderBy(*order)
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    both = dealt.join(F.broadcast(offsets), F.col("part") == F.col("of_part"))
    return both.select(*rows.columns, (F.row_number().over(within) - 1 + F.col("place0")).alias("place"), *((F.coalesce(F.sum(c).over(before), F.lit(0)) + F.col(f"{k}0")).alias(k) for k, c in sums.items()))


def targets(sizes: DataFrame, budget: float = BUDGET, cap: float = CAP) -> DataFrame:
    """(source, source_size, target), one row per source. The level of the capped sharing is found by running sums in the order in which sources reach their caps.

    Sources may be as many as sites: no window runs over all of them in one task.
    """
    by_name = F.col("source").asc_nulls_last()
    ranked = running(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), [by_name], {})
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod("place", F.lit(len(WEIGHTS))) + 1).cast("int"))
    per = ranked.select("source", "source_size", weight.cast("double").alias("weight"), (cap * F.col("source_size")).alias("most")).withColumn("full_at", F.col("most") / F.col("weight"))
    per = checkpointed(running(per, [F.col("full_at").asc(), by_name], {"capped": "most", "passed": "weight"}))
    total, weights = per.agg(F.sum("source_size"), F.sum("weight")).first()
    # the sharing level if just the sources before this one are capped; the first under which this one stays below its cap holds
    level = (F.lit(budget * float(total or 0)) - F.col("capped")) / (F.lit(float(weights or 0)) - F.col("passed"))
    share = per.withColumn("level", level).where(F.col("level") * F.col("weight") <= F.col("most")).agg(F.min_by("level", "place")).first()[0]
    target = F.col("most") if share is None else F.least(F.col("most"), F.lit(share) * F.col("weight"))
    return per.select("source", "source_size", target.alias("target"))


def _met(rows: DataFrame, limits: DataFrame, key: Column, spread: Column, few: bool) -> DataFrame:
    """`rows` with the row of `limits` of their source; `limits` has the column `key_` and names that `rows` doesn't have."""
    if few:
        return rows.join(F.broadcast(limits), key == F.col("key_"))
    salted = limits.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(salted, (key == F.col("key_")) & (F.pmod(F.xxhash64(spread), F.lit(SALTS)) == F.col("salt_")))


def thresholds(sizes: DataFrame, few: bool | None = None) -> tuple[DataFrame, bool]:
    """((key_, source_size_, target_, times_, prefix_, take_) of each source, whether they are few enough to broadcast), from checkpointed (id, source, size)."""
    goal = targets(sizes).withColumn("times", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
    goal = checkpointed(goal.select(source_key(F.col("source")).alias("key_"), F.col("source_size").alias("source_size_"), F.col("target").alias("target_"), F.col("times").alias("times_"), (F.col("target") - F.col("times") * F.col("source_size")).alias("rest_")))
    if few is None:
        few = goal.count() <= BROADCAST_SOURCES
    hashed = sizes.select("source", "size", id_hash(F.col("id")).alias("h"))
    bound = goal.select("key_", F.lit("").alias("prefix_"), F.col("rest_").alias("left_"))
    for n in LEVELS:
        inside = _met(hashed, bound, source_key(F.col("source")), F.col("h"), few).where(F.col("h").startswith(F.col("prefix_")))
        sums = inside.groupBy("key_", F.substring("h", 1, n).alias("b")).agg(F.sum("size").alias("n"), F.max("left_").alias("left_"))
        upto = F.sum("n").over(Window.partitionBy("key_").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        crossing = sums.withColumn("upto", upto).where(F.col("upto") > F.col("left_"))
        first = crossing.groupBy("key_").agg(F.min(F.struct("b", "upto", "n", "left_")).alias("x"))
        bound = first.select("key_", F.col("x.b").alias("prefix_"), (F.col("x.left_") - F.col("x.upto") + F.col("x.n")).alias("left_"), F.col("x.n").alias("n_"))
    # the boundary hash: taken if at least half of it is still wanted
    bound = bound.select(F.col("key_").alias("of_"), "prefix_", (2 * F.col("left_") >= F.col("n_")).alias("take_"))
    return checkpointed(goal.drop("rest_").join(bound, F.col("key_") == F.col("of_"), "left").drop("of_")), few


def _copies(h: Column) -> Column:
    extra = F.when(F.col("prefix_").isNull(), F.lit(False)).otherwise((h < F.col("prefix_")) | (h == F.col("prefix_")) & F.col("take_"))
    return (F.col("times_") + extra.cast("int")).cast("int")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(id, source, size, source_size, target, copies): how often the mix takes each row.

    The sizes are checkpointed (a few dozen bytes a row), so the text is scanned once. Every level is one pre-aggregated sum.
    """
    sizes = checkpointed(sized(docs, id_col, source_col, text_col))
    limits, few = thresholds(sizes)
    out = _met(sizes, limits, source_key(F.col("source")), F.col("id"), few)
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", F.col("source_size_").alias("source_size"), F.col("target_").alias("target"), _copies(id_hash(F.col("id"))).alias("copies"))


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """`docs`, all columns: every row as often as the mix takes it, none to two times. Each row meets the threshold of its source; no text is shuffled for it."""
    limits, few = thresholds(checkpointed(sized(docs, id_col, source_col, text_col)))
    whole = docs.select(F.struct(*map(name, docs.columns)).alias("row_"))  # so that no column of docs meets one of the limits
    of = lambda c: F.col("row_").getField(c)
    met = _met(whole, limits, source_key(of(source_col)), of(id_col), few).withColumn("copies_", _copies(id_hash(of(id_col))))
    return met.where(F.col("copies_") > 0).withColumn("copy_", F.explode(F.sequence(F.lit(1), F.col("copies_")))).select(*(of(c).alias(c) for c in docs.columns))
