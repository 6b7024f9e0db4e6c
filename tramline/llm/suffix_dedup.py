"""Removal of repeated 100-byte strings by sampled suffix names.

A byte goes if some 100-byte string that covers it also starts earlier: in a document of smaller id, or earlier in the same one. The work follows the
scheme of difference-cover suffix sorting: a sample of positions is sorted by a prefix and named, names that tell suffixes apart settle them,
ambiguous ones recurse with longer prefixes, and at last all remaining suffixes are merged by their names and adjacent equal prefixes are compared.

Where the textbook cover is fixed (positions 1 and 2 mod 3), this one is chosen by content: of `window` consecutive prefixes of `gram` bytes the one
of least hash is sampled, with gram + window - 1 = 100. Two equal 100-byte strings therefore hold samples at the same offsets, which is
all that the difference cover is needed for, and the sample is 2 / (window + 1) of the positions in place of 2 / 3. Names are hashes rather than
ranks, since only equality of prefixes counts and ranks would cost a global sort and two joins on each level: 64 bits for the sampled prefix and 64
for the whole run, so that the bytes of a run outside its sample rest on the latter alone. Each level hashes the text anew, and neighbours are
compared by these hashes, not by bytes.

Levels (gram, window): (32, 69), (85, 16), (100, 1). On each, suffixes whose windows share a sample form a run; a row is (name of the sample, name of the
whole run, document, start, end). Rows are dealt by sample name and sorted; the earliest of equal runs stays, later ones are
repeated throughout, and runs whose sample occurs in no other run are settled as unique. What stays of an ambiguous sample goes to the next level.

Each task first settles equal runs among its own rows, so a passage that stands in a third of all documents sends one row a task. A sample
that has many different runs in one task is dealt by run name, and a marker row tells the others that it is ambiguous. State in a task is one row.

Null text is empty. Documents under 100 bytes have nothing to remove. Null ids come before all others. Empty tables give empty results. Ids are integers.

A document is keyed by its id and a hash of its text. Rows of equal key are one document: they don't remove each other's bytes, and what is marked in one is
removed in all. Different texts under one id, or without any, are documents of their own, in the order of their hashes, and no span reaches another text. Where
ids tell texts apart the hash is 0, which costs nothing to shuffle: without null ids it is needed only if some id repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, slices

LENGTH = 100
LEVELS = ((32, 69), (85, 16), (100, 1))
HOT = 32
_ROW = "a bigint, r bigint, doc bigint, h bigint, s int, e int, kind int"
_SPAN = "doc bigint, h bigint, s int, e int, kind int"
OPEN, GONE, MARK, AMBIGUOUS, SPLIT = range(5)
_LEAST = np.iinfo(np.int64).min
_NULL_ID = _LEAST
_TABLES = np.random.default_rng(20240607).integers(1, 1 << 63, (2, 256), dtype=np.uint64) | np.uint64(1)
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_INVERSES = tuple(np.uint64(pow(int(b), -1, 1 << 64)) for b in _BASES)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


class Powers:
    """Powers of both bases and of their inverses modulo 2**64, grown as texts ask."""

    def __init__(self):
        self.up, self.down, self.n = [], [], 0

    def to(self, n: int) -> None:
        if n > self.n:
            self.n = max(n, 2 * self.n, 1 << 16)
            one = np.ones(1, np.uint64)
            self.up = [np.cumprod(np.concatenate([one, np.full(self.n, b)])) for b in _BASES]
            self.down = [np.cumprod(np.concatenate([one, np.full(self.n, b)])) for b in _INVERSES]


class Names:
    """Hashes of any substring of one text, from running sums."""

    def __init__(self, raw: bytes, powers: Powers):
        powers.to(len(raw) + 1)
        b = np.frombuffer(raw, np.uint8)
        self.powers, self.sums = powers, []
        for table, up in zip(_TABLES, powers.up, strict=True):
            sums = np.zeros(len(b) + 1, np.uint64)
            np.cumsum(table[b] * up[: len(b)], out=sums[1:])
            self.sums.append(sums)

    def grams(self, n: int, which: int = 0) -> np.ndarray:
        """Name of raw[i : i + n] for every i."""
        s = self.sums[which]
        return _mixed((s[n:] - s[:-n]) * self.powers.down[which][: len(s) - n] + np.uint64(n))

    def spans(self, start: np.ndarray, end: np.ndarray, which: int = 1) -> np.ndarray:
        s = self.sums[which]
        return _mixed((s[end] - s[start]) * self.powers.down[which][start] + (end - start).astype(np.uint64))


def least_of(h: np.ndarray, width: int) -> np.ndarray:
    """Least of h[i : i + width] for every i."""
    cur, w = h, 1
    while 2 * w <= width:
        cur, w = np.minimum(cur[:-w], cur[w:]), 2 * w
    n = len(h) - width + 1
    return np.minimum(cur[:n], cur[width - w : width - w + n])


def runs_of(raw: bytes, gram: int, window: int, spans: list[tuple[int, int]] | None, powers: Powers) -> tuple[np.ndarray, ...]:
    """(sample name, run name, start, end, ambiguous) of the runs of windows in `spans` of window starts (all if None)."""
    n = len(raw) - LENGTH + 1
    if n <= 0 or spans is not None and not spans:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z.astype(np.uint64), z, z, z.astype(bool)
    names = Names(raw, powers)
    h = names.grams(gram)
    sample = least_of(h, window) if window > 1 else h
    new = np.empty(n, bool)
    new[0], new[1:] = True, (sample[1:] != sample[:-1]) | (gram == LENGTH)  # at full length every window is a run
    if spans is not None:
        inside = np.zeros(n + 1, np.int64)
        for s, e in spans:
            inside[min(s, n)] += 1
            inside[min(e, n)] -= 1
        inside = np.cumsum(inside)[:n] > 0
        new[1:] |= inside[1:] != inside[:-1]
    start = np.flatnonzero(new)
    end = np.append(start[1:], n)
    if spans is not None:
        keep = inside[start]
        start, end = start[keep], end[keep]
    a = sample[start]
    # a sample that occurs twice in the text may repeat inside one run
    ordered = np.sort(h)
    doubled = ordered[1:][ordered[1:] == ordered[:-1]]
    twice = np.isin(a, doubled) if len(doubled) else np.zeros(len(a), bool)
    return a, names.spans(start, end + LENGTH - 1), start, end, twice


def _rows(texts: list[bytes], docs: np.ndarray, hashes: np.ndarray, spans: list | None, gram: int, window: int, powers: Powers) -> dict[str, np.ndarray]:
    """Rows to deal, with equal runs among these texts settled."""
    parts = [runs_of(t, gram, window, None if spans is None else spans[i], powers) for i, t in enumerate(texts)]
    a, r, s, e, twice = (np.concatenate([p[k] for p in parts]) for k in range(5))
    doc, h = (np.repeat(x, [len(p[0]) for p in parts]) for x in (docs, hashes))
    order = np.lexsort((s, h, doc, r, a))
    a, r, s, e, twice, doc, h = (x[order] for x in (a, r, s, e, twice, doc, h))
    first = np.ones(len(a), bool)
    first[1:] = (a[1:] != a[:-1]) | (r[1:] != r[:-1])
    # of equal runs in one place (rows of equal key) none is earlier
    lead = np.maximum.accumulate(np.where(first, np.arange(len(a)), 0))
    later = ~first & ((doc != doc[lead]) | (h != h[lead]) | (s != s[lead]))
    stay = np.flatnonzero(first)
    group = np.cumsum(np.concatenate([[0], (a[stay][1:] != a[stay][:-1]).astype(np.int64)])) if len(stay) else np.zeros(0, np.int64)
    hot = np.bincount(group)[group] >= HOT if len(stay) else np.zeros(0, bool)
    marks = stay[hot & np.concatenate([[True], group[1:] != group[:-1]])] if len(stay) else stay
    gone = np.flatnonzero(later)
    n, k, m = len(stay), len(gone), len(marks)
    signed = lambda x: x.astype(np.uint64).view(np.int64)
    return {
        "a": np.concatenate([signed(a[stay]), np.full(k, _LEAST), signed(a[marks])]),
        "r": np.concatenate([signed(r[stay]), doc[gone], np.full(m, _LEAST)]),
        "doc": np.concatenate([doc[stay], doc[gone], np.full(m, _LEAST)]),
        "h": np.concatenate([h[stay], h[gone], np.zeros(m, np.int64)]),
        "s": np.concatenate([s[stay], s[gone], np.zeros(m, np.int64)]),
        "e": np.concatenate([e[stay], e[gone], np.zeros(m, np.int64)]),
        "kind": np.concatenate([np.where(hot, SPLIT, np.where(twice[stay], AMBIGUOUS, OPEN)), np.full(k, GONE), np.full(m, MARK)]),
    }


def _deal(gram: int, window: int, with_spans: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        powers = Powers()
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(2).to_pylist()]
            docs, hashes = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(2))
            spans = [unpacked(v) for v in batch.column(3).to_pylist()] if with_spans else None
            for i, j in slices(texts):
                got = _rows(texts[i:j], docs[i:j], hashes[i:j], spans[i:j] if spans else None, gram, window, powers)
                types = [pa.int64()] * 4 + [pa.int32()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(got.values(), types, strict=True)], list(got))

    return run


def _settle(last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Compare neighbours in rows sorted by (a, r, doc, h, s): GONE for later equal runs, OPEN for the first of each run of an ambiguous sample.

    The first run of a sample waits until a second run, or the end of the sample, is seen; `last` has no further level.
    """

    def spans(doc, h, s, e, kind):
        return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(h, pa.int64()), pa.array(s, pa.int32()), pa.array(e, pa.int32()), pa.array(np.full(len(doc), kind), pa.int32())], ["doc", "h", "s", "e", "kind"])

    def run(batches):
        at = None  # (a, r, doc, h, s) of the first row of the current run
        pending = None  # the only run so far of the current sample: (doc, h, s, e)
        open_sample = False  # whether the current sample is ambiguous
        for batch in batches:
            a, r, doc, h, s, e, kind = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(7))
            passed = kind == GONE
            if passed.any():
                yield spans(doc[passed], h[passed], s[passed], e[passed], GONE)
                a, r, doc, h, s, e, kind = (x[~passed] for x in (a, r, doc, h, s, e, kind))
            if not len(a):
                continue
            new_a = np.concatenate([[at is None or a[0] != at[0]], a[1:] != a[:-1]])
            new_r = np.concatenate([[new_a[0] or r[0] != at[1]], new_a[1:] | (r[1:] != r[:-1])])
            i = np.maximum.accumulate(np.where(new_r, np.arange(len(a)), -1))
            lead = [x[np.maximum(i, 0)] for x in (doc, h, s)]
            if i[0] < 0:
                lead = [np.where(i < 0, was, x) for was, x in zip(at[2:], lead, strict=True)]
            real = kind != MARK
            later = ~new_r & real & ((doc != lead[0]) | (h != lead[1]) | (s != lead[2]))
            yield spans(doc[later], h[later], s[later], e[later], GONE)
            if not last:
                group = np.cumsum(new_a)  # 0 is the sample carried in
                first = new_r & real
                runs, marked = np.bincount(group, first), np.bincount(group, kind >= MARK) > 0
                if not new_a[0]:
                    runs[0] += 2 if open_sample else (pending is not None)
                ambiguous = marked | (runs > 1)
                if pending is not None and not new_a[0] and ambiguous[0]:
                    yield spans(*([x] for x in pending), OPEN)
                    pending = None
                go = first & ambiguous[group]
                yield spans(doc[go], h[go], s[go], e[go], OPEN)
                g = group[-1]
                if g != 0 or new_a[0]:
                    pending = None
                open_sample = bool(ambiguous[g])
                alone = np.flatnonzero(first & (group == g))
                if not open_sample and len(alone):
                    pending = tuple(x[alone[0]] for x in (doc, h, s, e))
            at = (a[-1], r[-1], *(x[-1] for x in lead))

    return run


def _level(texts: DataFrame, gram: int, window: int, last: bool) -> DataFrame:
    """(doc, h, s, e, kind) of the level, from (doc, h, text) or (doc, h, text, spans)."""
    dealt = texts.mapInArrow(_deal(gram, window, len(texts.columns) == 4), _ROW)
    by = F.when(F.col("kind").isin(SPLIT, GONE), F.xxhash64("a", "r")).otherwise(F.xxhash64("a"))
    return dealt.repartition(by).sortWithinPartitions("a", "r", "doc", "h", "s").mapInArrow(_settle(last), _SPAN)


def _packed(spans: DataFrame) -> DataFrame:
    """(doc, h, spans): the different spans of each text, each as one number: length, then start, since Java hashes a long by the xor of its halves."""
    return spans.groupBy("doc", "h").agg(F.collect_set(F.shiftleft((F.col("e") - F.col("s")).cast("bigint"), 32) + F.col("s")).alias("spans"))


def unpacked(spans: list[int] | None) -> list[tuple[int, int]]:
    return [(x & 0xFFFFFFFF, (x & 0xFFFFFFFF) + (x >> 32)) for x in spans or ()]


def _within(texts: DataFrame, spans: DataFrame) -> DataFrame:
    return texts.join(_packed(spans), ["doc", "h"]).select("doc", "h", "text", "spans")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    ids = docs.select(F.col(id_col).alias("id")).where(F.col("id").isNotNull())
    repeat = not ids.groupBy("id").count().where(F.col("count") > 1).isEmpty()
    doc, text = F.coalesce(F.col(id_col).cast("bigint"), F.lit(_NULL_ID)), F.coalesce(F.col(text_col), F.lit(""))
    h = F.xxhash64(text) if repeat else F.when(F.col(id_col).isNull(), F.xxhash64(text)).otherwise(F.lit(0))
    return docs.select(doc.alias("doc"), h.cast("bigint").alias("h"), text.alias("text"))


def repeated_spans(texts: DataFrame) -> DataFrame:
    """(doc, h, s, e) from (doc, h, text): starts s..e-1 of 100-byte strings of the document that also start earlier.

    The first level, which sees all positions, is checkpointed. The others follow in one plan, in which the texts are shuffled by document once.
    """
    first = checkpointed(_level(texts, *LEVELS[0], last=False))
    gone, level = first.where(F.col("kind") == GONE), first
    for k, (gram, window) in enumerate(LEVELS[1:], 2):
        level = _level(_within(texts, level.where(F.col("kind") == OPEN)), gram, window, last=k == len(LEVELS))
        gone = gone.union(level.where(F.col("kind") == GONE))
    return gone.select("doc", "h", "s", "e")


def covered(n: int, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal byte ranges covered by 100-byte strings that start in `spans`, within n bytes."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        a, b = s, min(e + LENGTH - 1, n)
        if a >= b:
            continue
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept binary), one row per row of `docs`: its UTF-8 bytes without the repeated ones."""
    texts = _texts(docs, id_col, text_col)
    own_id = F.when(F.col("doc") != _NULL_ID, F.col("doc")).cast(docs.schema[id_col].dataType).alias("id")
    both = texts.join(_packed(repeated_spans(texts)), ["doc", "h"], "left").select(own_id, "text", "spans")
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"

    def run(batches):
        for batch in batches:
            texts = [t.encode() for t in batch.column(1).to_pylist()]
            n_removed, n_spans, kept = [], [], []
            for raw, spans in zip(texts, batch.column(2).to_pylist(), strict=True):
                ranges = covered(len(raw), unpacked(spans))
                n_removed.append(sum(b - a for a, b in ranges))
                n_spans.append(len(ranges))
                edges = [0, *(x for ab in ranges for x in ab), len(raw)]
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in ([len(t) for t in texts], n_removed, n_spans)), pa.array(kept, pa.binary())], [id_col, "n_bytes", "n_removed", "n_spans", "kept"])

    return both.mapInArrow(run, schema)


def brute_force(texts: list[tuple[int, bytes]]) -> dict[int, list[tuple[int, int]]]:
    """Covered ranges by a dictionary of all 100-byte strings, for tests."""
    seen: set[bytes] = set()
    out = {}
    for doc, raw in sorted(texts):
        spans = []
        for i in range(len(raw) - LENGTH + 1):
            key = hashlib.md5(raw[i : i + LENGTH]).digest()
            if key in seen:
                spans.append((i, i + 1))
            seen.add(key)
        out[doc] = covered(len(raw), spans)
    return out
