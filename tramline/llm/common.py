"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import heapq
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..plans.staging import shared_folder

#: Python handles the texts of one Arrow batch in slices of about this many characters.
SLICE_CHARS = 1_000_000
#: A map over texts turns a column into Python strings by ranges of about this many bytes.
MAP_BYTES = 250_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the folder that the session names in spark.checkpoint.dir, so that a lost executor costs no recomputation.

    Only a local session without one (a bare test) gets a folder of its own; on a cluster a missing setting is an error.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def free(columns: Iterable[str], *names: str) -> list[str]:
    """Names like `names` that none of `columns` has, whatever their case: for columns that an operator adds beside a caller's."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def name(column: str) -> Column:
    """The column of just this name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def ranges(sizes: Iterable[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes sum to about `limit`; a row beyond the limit is a range of its own."""
    start = size = end = 0
    for i, n in enumerate(sizes):
        if size and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
        end = i + 1
    if start < end:
        yield start, end


def slices(texts: list[str], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about `limit` characters each; one very long text is a range of its own."""
    return ranges(map(len, texts), limit)


def text_slices(column: pa.Array, limit: int = MAP_BYTES) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of ranges of a column; only one range at a time becomes Python strings, nulls as empty ones."""
    for a, b in ranges(pc.fill_null(pc.binary_length(column), 0).to_pylist(), limit):
        yield a, [t or "" for t in column.slice(a, b - a).to_pylist()]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a column of texts, nulls as empty ones: views of the Arrow buffers, the first offset 0."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return at - at[0], data[at[0] : at[-1]]


def word_lists(text: bytes, limit: int = 4 * MAP_BYTES) -> Iterator[list[bytes]]:
    """The words of a text, runs of all but ASCII white space, by ranges of about `limit` bytes that end at white space if there is any."""
    at = 0
    while at < len(text):
        end = len(text)
        if end - at > limit:
            end = min((x for x in (text.find(w, at + limit) for w in (b" ", b"\n", b"\t", b"\r", b"\v", b"\f")) if x >= 0), default=end)
        yield text[at:end].split()
        at = end


def merged(ids: array, first: np.ndarray, none: int, rank_of: Callable[[int, int, int], int | None], made: Callable[[int], int]) -> np.ndarray:
    """Ids after merging neighbours, the pair of lowest rank first, of equal ranks the leftmost, until none has a rank.

    `first` has the rank of each place's pair, or `none`; `rank_of(i, j, end)` that of the symbols at places i and j, of which the second ends before `end`; `made(rank)` gives
    the symbol of a merge. The places of each rank pass from left to right, lowest rank first, all in arrays of 32 bits: some 25 bytes for each symbol, whatever
    their number. Where a merge makes a pair of a lower rank, that one goes first.
    """
    n = len(ids)
    places = np.flatnonzero(first < none).astype(np.int32)
    if not len(places):
        return np.frombuffer(ids, np.int32)
    places = places[np.argsort(first[places], kind="stable").astype(np.int32)]
    ranks, begin = np.unique(first[places], return_index=True)
    bounds = dict(zip(ranks.tolist(), zip(begin.tolist(), [*begin[1:].tolist(), len(places)], strict=True), strict=True))
    left, right = array("i", range(-1, n - 1)), array("i", range(1, n + 1))
    later: dict[int, array] = {}
    queue = ranks.tolist()

    def add(i: int, j: int) -> None:
        r = rank_of(i, j, right[j])
        if r is not None:
            if r not in later:
                later[r] = array("i")
                heapq.heappush(queue, r)
            later[r].append(i)

    while queue:
        r = heapq.heappop(queue)
        a, b = bounds.pop(r, (0, 0))
        new = later.pop(r, None)
        here = places[a:b] if new is None else np.sort(np.concatenate([places[a:b], np.frombuffer(new, np.int32)]))
        symbol = made(r)
        view = memoryview(np.ascontiguousarray(here))
        for k, i in enumerate(view):
            j = right[i]
            if ids[i] < 0 or j >= n or rank_of(i, j, right[j]) != r:
                continue
            ids[i], ids[j], right[i] = symbol, -1, right[j]
            if right[i] < n:
                left[right[i]] = i
                add(i, right[i])
            if left[i] >= 0:
                add(left[i], i)
            if queue and queue[0] <= r and k + 1 < len(view):  # what is left waits for the lower rank
                if r not in later:
                    later[r] = array("i")
                    heapq.heappush(queue, r)
                later[r].extend(view[k + 1 :])
                break
    whole = np.frombuffer(ids, np.int32)
    return whole[whole >= 0]


def gathered(source: np.ndarray, starts: np.ndarray, sizes: np.ndarray, chunk: int = MAP_BYTES) -> np.ndarray:
    """The pieces source[start : start + size], one after another; only `chunk` places at a time have an index."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    out, shift = np.empty(total, source.dtype), starts - (ends - sizes)
    for a in range(0, total, chunk):
        b = min(a + chunk, total)
        i, j = int(np.searchsorted(ends, a, "right")), int(np.searchsorted(ends, b, "left")) + 1
        inside = np.minimum(ends[i:j], b) - np.maximum(ends[i:j] - sizes[i:j], a)
        out[a:b] = source[np.repeat(shift[i:j], inside) + np.arange(a, b)]
    return out


def strings(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    """A column of texts from the bytes of all and the place where each begins (and the last ends)."""
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data)))


def give_back() -> None:
    """Python workers outlive their tasks; what a task has freed goes back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def map_texts(docs: DataFrame, make: Callable[[], Callable[[list[str]], dict[str, list]]], schema: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One output row per document: its id and what `make()(texts)` gives for its text.

    `make` runs once in each task, so that models and caches live as long as the task. A null text counts as
    empty. Only the id and the text are read, so other columns of `docs` cannot clash.
    """
    out = StructType([StructField(id_col, docs.schema[id_col].dataType), *StructType.fromDDL(schema).fields])
    names = out.fieldNames()[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for at, texts in text_slices(batch.column(1)):
                got = work(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), *(pa.array(got[n]) if got[n] else pa.nulls(0) for n in names)], [id_col, *names]).cast(target)
        work = None
        give_back()

    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(out)
    return docs.select(name(id_col), name(text_col)).mapInArrow(run, out)
