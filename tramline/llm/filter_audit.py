"""How five filters act on each other: what each removes in every order in which they can run.

Each document has a pattern: a bit for each filter that it fails. A table of 32 patterns by 120 orders, made once, holds the step at which an order removes a
pattern first, so that no order is ever run. Texts are judged in one Arrow map; equal texts are counted together by a hash of the text, where all but the smallest id
fail the last filter. Rows of the same part, pattern and labels are counted by Spark before anything else; a second Arrow map looks their patterns up in the
table, `np.bincount` adds their counts up by part, order and step, and the partial arrays of the tasks are summed.

Cases: a null or empty text has no words: it fails the word count alone of the first four, and the last if a smaller id has it too. A null id is smaller or greater than none,
so it neither fails the last filter nor makes others fail it; rows of equal id and text don't fail by each other. A null source is the part "". A label
counts if any row of the labels says so, once. An empty table gives no rows. Very long texts are judged by ranges of words. Only id, text, source and
the labels' columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import MAP_BYTES, give_back, name, ranges, utf8, word_lists

FILTERS = "ABCDE"
#: Thresholds of the first three filters: words, percentage of distinct words, percentage of capitals; and the characters of the fourth.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, ODD = 200, 50, 2, b"#$%&*|"
CAPITALS, CONTINUED = bytes(range(65, 91)), bytes(range(0x80, 0xC0))
NEVER = len(FILTERS)
#: Measures that add up over documents.
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
#: Parts that a task holds before it gives its arrays away.
HELD_PARTS = 200


@cache
def orders() -> list[str]:
    return ["".join(o) for o in permutations(FILTERS)]


@cache
def first_failure() -> np.ndarray:
    """[pattern, order]: the step (from 0) at which the order removes the pattern, NEVER if it doesn't."""
    fails = (np.arange(1 << len(FILTERS))[:, None] >> np.arange(len(FILTERS))) & 1
    at = np.array([[FILTERS.index(f) for f in o] for o in orders()])
    by_step = fails[:, at].astype(bool)
    return np.where(by_step.any(axis=2), by_step.argmax(axis=2), NEVER).astype(np.int8)


def pattern_of(text: bytes) -> int:
    """The bits of the first four filters, from UTF-8."""
    n, distinct = 0, set()
    for words in word_lists(text):
        n += len(words)
        distinct.update(words)
    points = len(text) - _count(text, CONTINUED)
    odd = len(text) > 0 and _count(text, ODD) > 0
    return (n < LEAST_WORDS) | (100 * len(distinct) < LEAST_DISTINCT * n) << 1 | (100 * _count(text, CAPITALS) > MOST_CAPITALS * points) << 2 | odd << 3


def _count(text: bytes, of: bytes) -> int:
    return sum(len(part) - len(part.translate(None, of)) for part in (text[a : a + 4 * MAP_BYTES] for a in range(0, len(text), 4 * MAP_BYTES)))


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(doc_id, part, pattern, digest): the bits of the first four filters, and 128 bits of the text's hash. One map."""
    out = StructType([*docs.select(name(id_col).alias("doc_id")).schema.fields, *StructType.fromDDL("part string, pattern int, digest binary").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = utf8(batch.column(2))
            for a, b in ranges(np.diff(offsets).tolist(), 4 * MAP_BYTES):
                texts = (data[offsets[i] : offsets[i + 1]].tobytes() for i in range(a, b))
                found = [(pattern_of(t), hashlib.blake2b(t, digest_size=16).digest()) for t in texts]
                ids, parts = (batch.column(i).slice(a, b - a) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([ids, parts, pa.array([p for p, _ in found], pa.int32()), pa.array([d for _, d in found], pa.binary())], ["doc_id", "part", "pattern", "digest"])
        give_back()

    return docs.select(name(id_col).alias("doc_id"), F.coalesce(name(part_col), F.lit("")).alias("part"), name(text_col).alias("text")).mapInArrow(run, out)


def patterns(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, pattern, good, toxic, n): how many documents of each part and label fail just those filters, the last one included.

    The join with the labels deals the rows by id, and so are repeated rows counted. Copies of a text meet as counts for each part and label, with their smallest id:
    no group grows with the number of copies.
    """
    known = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    no = F.lit(False)
    rows = judged(docs).join(known, "doc_id", "left").withColumns({"good": F.coalesce("good", no), "toxic": F.coalesce("toxic", no)})
    group = ["part", "pattern", "good", "toxic"]
    single = rows.groupBy("doc_id", "digest", *group).agg(F.count(F.lit(1)).alias("c"))
    # the smallest id of a text under each part and label, and how many rows have it
    some = F.col("doc_id").isNotNull()
    texts = single.groupBy("digest", *group).agg(F.sum("c").alias("n"), F.sum(F.when(some, F.col("c")).otherwise(0)).alias("known"), F.min(F.when(some, F.struct(F.col("doc_id").alias("id"), F.col("c").alias("c")))).alias("least"))
    from pyspark.sql import Window

    first = texts.withColumn("id", F.min("least.id").over(Window.partitionBy("digest")))
    copies = F.coalesce(F.col("known") - F.when(F.col("least.id") == F.col("id"), F.col("least.c")).otherwise(0), F.lit(0))
    split = first.select(*group, "n", copies.alias("copies"))
    last = 1 << FILTERS.index("E")
    both = F.explode(F.array(F.struct(F.col("pattern").alias("p"), (F.col("n") - F.col("copies")).alias("k")), F.struct((F.col("pattern") + last).alias("p"), F.col("copies").alias("k")))).alias("x")
    return split.select("part", "good", "toxic", both).where("x.k > 0").groupBy("part", F.col("x.p").alias("pattern"), "good", "toxic").agg(F.sum("x.k").alias("n"))


def accumulate(counts: np.ndarray) -> np.ndarray:
    """[measure, order, step] of one part, from its counts by [label (all, good, toxic), pattern]."""
    table, steps = first_failure(), len(FILTERS)
    n_orders = table.shape[1]
    cell = (np.arange(n_orders) * (steps + 1) + table).ravel()  # pattern by order
    lost = np.stack([np.bincount(cell, np.repeat(c, n_orders), n_orders * (steps + 1)).reshape(n_orders, steps + 1) for c in counts]).astype(np.int64)
    removed, good, toxic = lost[:, :, :steps]
    at = np.array([[FILTERS.index(f) for f in o] for o in orders()])
    bits = (np.arange(table.shape[0])[:, None] >> np.arange(steps)) & 1
    fails, alone = counts[0] @ bits, counts[0][1 << np.arange(steps)]
    share = np.bincount(at.ravel(), removed.ravel(), steps).astype(np.int64)
    kept = counts[0].sum() - np.cumsum(removed, axis=1)
    return np.stack([kept, removed, fails[at] - removed, alone[at], good, toxic, share[at]])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, and MEASURES): 600 rows for each part of `docs`, zeros included."""
    out = StructType.fromDDL(f"part string, filter_order string, step int, {', '.join(m + ' bigint' for m in MEASURES)}")

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            names, code = np.unique(np.array(batch.column(0).to_pylist(), object), return_inverse=True)
            pattern, good, toxic, n = (c.to_numpy(zero_copy_only=False) for c in batch.columns[1:])
            width = 1 << len(FILTERS)
            by = np.stack([np.bincount(code * width + pattern, n * w, len(names) * width).astype(np.int64).reshape(-1, width) for w in (1, good, toxic)], axis=1)
            for part, counts in zip(names, by, strict=True):
                held[part] = held.get(part, 0) + counts
            if len(held) > HELD_PARTS:
                yield _partial(held)
                held = {}
        yield _partial(held)
        give_back()

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, cells = None, 0
        for batch in batches:
            for name_, row in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if part is not None and name_ != part:
                    yield _rows(part, cells)
                    cells = 0
                part, cells = name_, cells + row.values.to_numpy()
        if part is not None:
            yield _rows(part, cells)
        give_back()

    partial = patterns(docs, labels).mapInArrow(look_up, "part string, cells array<bigint>")
    return partial.repartition("part").sortWithinPartitions("part").mapInArrow(add_up, out)


def _partial(held: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(held, pa.string()), pa.array([accumulate(c).ravel() for c in held.values()], pa.list_(pa.int64()))], ["part", "cells"])


def _rows(part: str, cells: np.ndarray) -> pa.RecordBatch:
    names, steps = orders(), len(FILTERS)
    cells = cells.reshape(len(MEASURES), -1)
    keys = [pa.array([part] * cells.shape[1], pa.string()), pa.array([o for o in names for _ in range(steps)], pa.string()), pa.array(np.tile(np.arange(1, steps + 1, dtype=np.int32), len(names)))]
    return pa.RecordBatch.from_arrays([*keys, *map(pa.array, cells)], ["part", "filter_order", "step", *MEASURES])
