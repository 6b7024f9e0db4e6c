"""Fill-in-middle transformation of whole texts, cut at line ends.

A text of n lines is cut at two places among 0..n lines, drawn by a hash of its id, into prefix, middle and suffix, and written with
a mark before each part: as prefix, suffix, middle, or as suffix, prefix, middle. All rows of an Arrow batch pass at once, as bytes: a table gives the class of
each byte, a line begins where the byte before ends one or a text begins, cumulative sums that start anew at each text count lines and code points, and one
binary search over them finds the cuts of all rows. Marks, draws and the share of each form are parameters.

Cases: a null text counts as empty. An empty text, and one that holds a mark, stay as they are (form "plain"), so that every output can be turned
back. Ids draw: rows of equal id and text give equal rows, a null id draws as an empty one. Very long texts pass as any other, beside some
15 bytes for each of their bytes. An empty table gives no rows. Only id and text are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import MAP_BYTES, gathered, give_back, name, ranges, strings, utf8

PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Classes of bytes: those that go on with a code point, line ends, and all else.
FIRST, WITHIN, LINE_END = range(3)
CLASSES = np.full(256, FIRST, np.uint8)
CLASSES[0x80:0xC0], CLASSES[0x0A] = WITHIN, LINE_END


@dataclass(frozen=True)
class Form:
    """Marks of prefix, suffix and middle, the percentage of texts that are turned, and of those the percentage written suffix first."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    rate: int = 100
    suffix_first: int = 50
    seed: str = "7"

    @property
    def marks(self) -> tuple[bytes, bytes, bytes]:
        return self.prefix.encode(), self.suffix.encode(), self.middle.encode()


def draws(id_col: str, form: Form) -> list[Column]:
    """Four integers below 2^32 from the hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(form.seed + ":"), F.coalesce(name(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint").alias(f"h{i + 1}") for i in range(4)]


def found(data: np.ndarray, offsets: np.ndarray, mark: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(place, text) of each mark that lies within one text; marks don't overlap themselves."""
    hit = data[: max(len(data) - len(mark) + 1, 0)] == mark[0]
    for i, b in enumerate(mark[1:], 1):
        hit &= data[i : i + len(hit)] == b
    at = np.flatnonzero(hit)
    of = np.searchsorted(offsets, at, "right") - 1
    whole = at + len(mark) <= offsets[of + 1]
    return at[whole], of[whole]


def running(marks: np.ndarray) -> np.ndarray:
    """How many marks stand before each place, and at the end."""
    out = np.zeros(len(marks) + 1, np.int32 if len(marks) < 1 << 31 else np.int64)
    np.cumsum(marks, out=out[1:], dtype=out.dtype)
    return out


class Lines:
    """Where lines and code points of many texts stand."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        kind = CLASSES[data]
        first = offsets[:-1][np.diff(offsets) > 0]
        begins = np.zeros(len(data), bool)
        begins[1:] = kind[:-1] == LINE_END
        begins[first] = True
        self.offsets = offsets
        # the sums run on over the batch; each text counts from what stands at its beginning
        self.lines, self.points = running(begins), running(kind != WITHIN)
        self.before = self.lines[offsets[:-1]]
        self.count = (self.lines[offsets[1:]] - self.before).astype(np.int64)

    def after(self, units: np.ndarray) -> np.ndarray:
        """The byte at which the first `units` lines of each text end."""
        at = np.searchsorted(self.lines, (self.before + units + 1).astype(self.lines.dtype), "left") - 1
        return np.where(units >= self.count, self.offsets[1:], at)

    def chars(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.points[b] - self.points[a]).astype(np.int64)


def turned(data: np.ndarray, offsets: np.ndarray, h: list[np.ndarray], form: Form) -> dict[str, pa.Array]:
    """The columns of a batch of texts, from their bytes and draws."""
    lines, n = Lines(data, offsets), len(offsets) - 1
    plain = (offsets[1:] == offsets[:-1]) | (h[2] % 100 >= form.rate)
    for mark in form.marks:
        plain[found(data, offsets, mark)[1]] = True
    cuts = np.sort(np.stack([h[0] % (lines.count + 1), h[1] % (lines.count + 1)]), axis=0)
    start, (a, b), end = offsets[:-1], (lines.after(c) for c in cuts), offsets[1:]
    first = h[3] % 100 < form.suffix_first
    # the pieces of a row, in order of the output: a mark each, then a part of the text
    p, s, m = (np.full(n, x) for x in len(data) + np.concatenate([[0], np.cumsum([len(x) for x in form.marks])[:-1]]))
    size = {k: np.full(n, len(x)) for k, x in zip("psm", form.marks, strict=True)}
    pick = lambda x, y: np.where(first, x, y)
    starts = np.stack([pick(s, p), pick(b, start), pick(p, s), pick(start, b), m, a], axis=1)
    sizes = np.stack([pick(size["s"], size["p"]), pick(end - b, a - start), pick(size["p"], size["s"]), pick(a - start, end - b), size["m"], b - a], axis=1)
    sizes[plain] = 0
    starts[plain, 1], sizes[plain, 1] = start[plain], (end - start)[plain]
    out = gathered(np.concatenate([data, np.frombuffer(b"".join(form.marks), np.uint8)]), starts.ravel(), sizes.ravel())
    chars = lambda x, y: pa.array(lines.chars(x, y), mask=plain)
    return {
        "n": pa.array(lines.count), "form": pa.array(np.where(plain, PLAIN, pick(SPM, PSM)).tolist(), pa.string()), "prefix_chars": chars(start, a), "middle_chars": chars(a, b),
        "output": strings(np.concatenate([[0], np.cumsum(sizes.sum(axis=1))]), out),
    }


def rebuilt(data: np.ndarray, offsets: np.ndarray, plain: np.ndarray, form: Form) -> pa.Array:
    """The texts from which a batch of outputs was made. An output whose marks aren't one of each, the first at its beginning, is an error."""
    n = len(offsets) - 1
    at = np.zeros((3, n), np.int64)
    for k, mark in enumerate(form.marks):
        where, of = found(data, offsets, mark)
        real = ~plain[of]
        where, of = where[real], of[real]
        if not np.array_equal(of, np.flatnonzero(~plain)):
            raise ValueError(f"an output doesn't hold {mark.decode()} just once")
        at[k, of] = where
    p, s, m = at
    width = [len(x) for x in form.marks]
    end, first = offsets[1:], s < p
    if ((np.minimum(p, s) != offsets[:-1]) | (m < np.maximum(p, s)))[~plain].any():
        raise ValueError("the marks of an output stand in no known order")
    starts = np.stack([p + width[0], m + width[2], s + width[1]], axis=1)
    stops = np.stack([np.where(first, m, s), end, np.where(first, p, m)], axis=1)
    sizes = stops - starts
    starts[plain], sizes[plain] = 0, 0
    starts[plain, 0], sizes[plain, 0] = offsets[:-1][plain], (end - offsets[:-1])[plain]
    return strings(np.concatenate([[0], np.cumsum(sizes.sum(axis=1))]), gathered(data, starts.ravel(), sizes.ravel()))


def transform(docs: DataFrame, form: Form | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output): number of lines, "plain", "psm" or "spm", code points of the parts (null if plain) and the text written anew. One map, no shuffle."""
    form = form or Form()
    out = StructType([StructField(id_col, docs.schema[id_col].dataType), *StructType.fromDDL("n bigint, form string, prefix_chars bigint, middle_chars bigint, output string").fields])
    given = docs.select(name(id_col).alias("id"), name(text_col).alias("text"), *draws(id_col, form))
    return given.mapInArrow(lambda batches: _batches(batches, 1, out, lambda part: turned(*reversed(utf8(part.column(1))), [c.to_numpy() for c in part.columns[2:]], form)), out)


def restore(turned_texts: DataFrame, form: Form | None = None) -> DataFrame:
    """`transform`'s rows with `restored` added: the text, rebuilt from output and form alone."""
    form = form or Form()
    out = StructType([*turned_texts.schema.fields, *StructType.fromDDL("restored string").fields])
    column, kind = (turned_texts.columns.index(c) for c in ("output", "form"))

    def work(part: pa.RecordBatch) -> dict[str, pa.Array]:
        offsets, data = utf8(part.column(column))
        plain = pc.equal(part.column(kind), PLAIN).to_numpy(zero_copy_only=False)
        return {**dict(zip(part.schema.names, part.columns, strict=True)), "restored": rebuilt(data, offsets, plain, form)}

    return turned_texts.mapInArrow(lambda batches: _batches(batches, column, out, work), out)


def _batches(batches: Iterator[pa.RecordBatch], column: int, schema: StructType, work) -> Iterator[pa.RecordBatch]:
    """What `work` gives for ranges of rows of some 4 * MAP_BYTES of text; a column that it doesn't give is the first of the batch."""
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(schema)
    for batch in batches:
        for a, b in ranges(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist(), 4 * MAP_BYTES):
            part = batch.slice(a, b - a)
            got = work(part)
            yield pa.RecordBatch.from_arrays([(got[f.name] if f.name in got else part.column(0)).cast(f.type) for f in target], schema=target)
    give_back()
