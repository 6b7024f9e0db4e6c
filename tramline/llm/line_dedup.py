"""Line dedup by site-relative frequency.

For each host: pages that hold a line / pages of the host. A line whose share exceeds `max_ratio` is boilerplate there and leaves every page of that
host; other hosts keep it. The least that can be boilerplate is a line of `LEAST_PAGES` pages: a line that stands on one page is no boilerplate, however
few pages the host has. So a host of 199 pages or fewer loses what stands on any two of them, one of 1,000 pages what stands on 11.

Pages of a host with the same whole text count as one (by 64 bits of hash), on both sides of the share, so that copies don't turn their own lines into
boilerplate; they lose lines as any page does.

Lines are the `\\n`-separated parts of the text, compared exactly, by 128 bits of hash; a line without a word (only white
space) is never counted or dropped. A page counts once for a line, however often it repeats it. Repeated rows are one page for the share, and each comes
back. A null text has no lines and comes back as the empty string in `kept_text`; a null host is a host of its own. A page may lose all its lines: its
row stays. Empty tables give empty results. Very long pages are split whole, in the memory of one row. Columns of any name pass through; only those
that take the names of the results are replaced.

Only hashes are shuffled for counting. Boilerplate lines are joined back by (host, line), which AQE can split
where one line fills a third of a host, and texts move once, to meet the positions they lose.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free, name

MAX_RATIO = 0.01
LEAST_PAGES = 2
RESULTS = ("kept_text", "n_lines", "n_dropped")
_SPACES = " \t\n\x0b\x0c\r"


def _keys(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("_l1"), F.xxhash64(line, F.lit(1)).alias("_l2")]


def _kept(lines: Column, drop: Column) -> Column:
    """The lines at positions not in `drop` (ascending): the runs between dropped ones, put together.

    `lines` is bound once, as a field of a lambda's variable: an expression named within the lambda of the runs would be evaluated for each run.
    """

    def runs(b: Column) -> Column:
        edge = lambda i: F.get(b["edges"], i)
        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(b["edges"]) - 2), lambda i: F.slice(b["lines"], edge(i) + 2, edge(i + 1) - edge(i) - 1)))

    given = F.array(F.struct(lines.alias("lines"), drop.alias("drop")))
    edged = F.transform(given, lambda b: F.struct(b["lines"].alias("lines"), F.concat(F.array(F.lit(-1)), b["drop"], F.array(F.size(b["lines"]))).alias("edges")))
    return F.element_at(F.transform(edged, runs), 1)


def drop_boilerplate_lines(pages: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", max_ratio: float = MAX_RATIO, results: tuple[str, str, str] = RESULTS) -> DataFrame:
    """`pages` with the kept text, the number of lines and the number of dropped lines (long) added, under the names in `results`; other columns are kept as they are."""
    text = F.coalesce(name(text_col), F.lit(""))
    row = [name(id_col).alias("_id"), name(host_col).alias("_host"), F.xxhash64(text).alias("_t")]
    parted = pages.select(*row, F.split(text, "\n").alias("_parts"))  # the text is hashed and split once for each page, not beside each line
    lines = parted.select("_id", "_host", "_t", F.posexplode("_parts").alias("_pos", "_line")).where(F.translate("_line", _SPACES, "") != "")
    lines = lines.select("_id", "_host", "_t", "_pos", *_keys(F.col("_line")))
    per_page = parted.select("_host", "_t", F.explode("_parts").alias("_line")).where(F.translate("_line", _SPACES, "") != "")
    per_page, counted = per_page.select("_host", "_t", *_keys(F.col("_line"))).distinct(), pages.select(*row[1:]).distinct()
    counts = per_page.groupBy("_host", "_l1", "_l2").agg(F.count(F.lit(1)).alias("_pages")).where(F.col("_pages") >= LEAST_PAGES)
    totals = counted.groupBy(F.col("_host").alias("_of")).agg(F.count(F.lit(1)).alias("_all"))
    boilerplate = counts.join(totals, F.col("_host").eqNullSafe(F.col("_of"))).where(F.col("_pages") > max_ratio * F.col("_all"))
    boilerplate = boilerplate.select(F.col("_host").alias("_bh"), F.col("_l1").alias("_b1"), F.col("_l2").alias("_b2"))
    hits = lines.join(boilerplate, (F.col("_l1") == F.col("_b1")) & (F.col("_l2") == F.col("_b2")) & F.col("_host").eqNullSafe(F.col("_bh")))
    t, did, dh, dt, drop = free(pages.columns, "page_hash", "drop_id", "drop_host", "drop_hash", "drop_lines")
    drops = hits.groupBy("_id", "_host", "_t").agg(F.sort_array(F.collect_set("_pos")).alias(drop))
    drops = drops.select(F.col("_id").alias(did), F.col("_host").alias(dh), F.col("_t").alias(dt), drop)
    joined = pages.withColumn(t, F.xxhash64(text)).join(drops, name(id_col).eqNullSafe(F.col(did)) & name(host_col).eqNullSafe(F.col(dh)) & (F.col(t) == F.col(dt)), "left")
    split = F.split(text, "\n")
    kept = F.when(F.col(drop).isNull(), text).otherwise(F.array_join(_kept(split, F.col(drop)), "\n"))
    added = (kept, F.when(text == "", F.lit(0)).otherwise(F.size(split)).cast("bigint"), F.coalesce(F.size(drop), F.lit(0)).cast("bigint"))
    return joined.withColumns(dict(zip(results, added, strict=True))).drop(t, did, dh, dt, drop)
