"""Byte-level BPE with vectorised pre-tokenisation.

Code points map to classes (letter, number, white space, other, with the few characters of look-ahead that the split pattern needs
folded in). Each class is a transition function on nine states; functions compose associatively, so the states before all characters of a batch of
texts come from a blocked scan of array operations, and a table of (state, class) says where pieces begin. No regular
expression runs. The pieces, slices of the UTF-8 bytes, go to pair merging behind a bounded cache. The byte offset of every token stays beside its id,
and decoding writes each token's bytes at its offset.

Merging takes the pair whose joined bytes have the lowest rank, leftmost first, until none is in the vocabulary: many short pieces at a
time as arrays, long ones by their places, rank by rank. There are no special tokens. Null or empty text has no tokens, an empty table no rows; equal texts
give equal ids, repeated rows too. Other columns are passed by, whatever their names.

Whole texts are encoded, whatever their length: a long one is cut where a letter or number meets something else, which is the begin of a piece on any
path, so that memory is that of some 100,000 characters. Only one unbroken run of letters, a single piece, is held whole, at some 30 bytes a byte.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from array import array
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from .common import MAP_BYTES, give_back, map_texts, merged, name, ranges

LETTER, NUMBER, OTHER, SPACES, GLUE, LONE, SHORT, LONG, CUT = range(9)
#: Code points of white space (fixed values).
WHITE = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Endings after an apostrophe that are pieces of their own (fixed values).
ONE_LETTER, TWO_LETTERS = "sdmt", ("ll", "ve", "re")
BEGIN, IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_SPACES, AFTER_GLUE, ONE_LEFT, TWO_LEFT = range(8)
N_STATES = 8
SHORT_PIECE = 64
CACHE_PIECES = 200_000
#: Pieces that are merged side by side.
GRID_PIECES = 4_000
#: Characters after which a text is cut, and how many of them are looked at for a place to cut.
CUT_CHARS, LOOK_CHARS = 100_000, 2_000


@cache
def class_table() -> np.ndarray:
    kind = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[list(WHITE)] = SPACES
    return out


@cache
def machine() -> tuple[np.ndarray, np.ndarray]:
    """(next[class, state], begins[class, state]): the state after a character, and whether a piece begins at it."""
    nxt, begins = np.zeros((9, N_STATES), np.uint8), np.zeros((9, N_STATES), bool)
    run = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHER, SPACES: IN_SPACES}
    for c in range(9):
        for s in range(N_STATES):
            if c == CUT:
                to, new = BEGIN, True
            elif s == TWO_LEFT:
                to, new = ONE_LEFT, False
            elif s == ONE_LEFT:
                to, new = BEGIN, False
            elif c == GLUE:
                to, new = AFTER_GLUE, True
            elif c == LONE:
                to, new = BEGIN, True
            elif c in (SHORT, LONG):
                free = s not in (IN_OTHER, AFTER_GLUE)
                to, new = ((ONE_LEFT if c == SHORT else TWO_LEFT) if free else IN_OTHER), free
            else:
                to, new = run[c], s not in (run[c], AFTER_GLUE)
            nxt[c, s], begins[c, s] = to, new
    return nxt, begins


def classes_of(points: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The class of each code point; `cut` marks separators between texts."""
    c = class_table()[points]
    c[cut] = CUT
    space = c == SPACES
    solid_next = np.zeros(len(c), bool)
    solid_next[:-1] = ~space[1:] & (c[1:] != CUT)
    last = space & solid_next
    c[last] = np.where(points[last] == 0x20, GLUE, LONE)
    quote = np.flatnonzero(points == 0x27)
    padded = np.concatenate([points, [0, 0]])
    a, b = padded[quote + 1], padded[quote + 2]
    c[quote[np.isin(a, [ord(x) for x in ONE_LETTER])]] = SHORT
    for x, y in TWO_LETTERS:
        c[quote[(a == ord(x)) & (b == ord(y))]] = LONG
    return c


def states_before(c: np.ndarray, width: int = 64) -> np.ndarray:
    """The state before each character: compose each block's functions, scan the blocks, then replay them side by side."""
    nxt, _ = machine()
    n = len(c)
    if n <= width:
        out, s = np.zeros(n, np.uint8), BEGIN
        for i, k in enumerate(c.tolist()):
            out[i] = s
            s = nxt[k, s]
        return out
    blocks = -(-n // width)
    grid = np.full(blocks * width, CUT, np.uint8)
    grid[:n] = c
    grid = np.ascontiguousarray(grid.reshape(blocks, width).T)
    whole = _compose(grid)
    entry = _scan(whole)
    out = np.empty((width, blocks), np.uint8)
    flat = nxt.ravel()
    for i in range(width):
        out[i] = entry
        entry = flat[grid[i] * np.uint8(N_STATES) + entry]
    return out.T.ravel()[:n]


def _compose(grid: np.ndarray) -> np.ndarray:
    """function[block, state] of each column of classes."""
    flat = machine()[0].ravel()
    f = np.tile(np.arange(N_STATES, dtype=np.uint8), (grid.shape[1], 1))
    for row in grid:
        f = flat[(row * np.uint8(N_STATES))[:, None] + f]
    return f


def _scan(functions: np.ndarray) -> np.ndarray:
    """State before each block, from the start state: an exclusive scan under composition, by doubling."""
    f, step = functions.copy(), 1
    while step < len(f):
        f[step:] = np.take_along_axis(f[step:], f[:-step].astype(np.intp), axis=1)
        step *= 2
    return np.concatenate([[BEGIN], f[:-1, BEGIN]]).astype(np.uint8)


class Tokens:
    """The bytes of every token, end to end: all that decoding needs."""

    def __init__(self, data: bytes):
        self.tokens: dict[int, bytes] = {}
        for line in data.splitlines():
            if line:
                token, rank = line.split()
                self.tokens[int(rank)] = base64.b64decode(token)
        size = max(self.tokens) + 1
        lengths = np.zeros(size, np.int64)
        for r, t in self.tokens.items():
            lengths[r] = len(t)
        self.lengths, self.offsets = lengths, np.concatenate([[0], np.cumsum(lengths)[:-1]])
        self.bytes = np.frombuffer(b"".join(self.tokens.get(r, b"") for r in range(size)), np.uint8)

    def places(self, ids: np.ndarray) -> np.ndarray:
        """Byte offset of each token in the text."""
        n = self.lengths[ids]
        return np.cumsum(n) - n

    def decode(self, ids: np.ndarray, offsets: np.ndarray | None = None, chunk: int = 100_000) -> bytes:
        """The bytes of the tokens, each at its offset; offsets that don't lay the tokens end to end are an error."""
        at = self.places(ids) if offsets is None else offsets.astype(np.int64)
        n = self.lengths[ids]
        total = int(at[-1] + n[-1]) if len(ids) else 0
        if len(at) != len(ids) or len(ids) and (at[0] != 0 or (at[1:] != at[:-1] + n[:-1]).any()):
            raise ValueError("offsets don't fit the tokens")
        out = np.empty(total, np.uint8)
        for a in range(0, len(ids), chunk):
            i, k, to = (x[a : a + chunk] for x in (ids.astype(np.int64), n, at))
            inside = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
            out[np.repeat(to, k) + inside] = self.bytes[np.repeat(self.offsets[i], k) + inside]
        return out.tobytes()


class Vocabulary(Tokens):
    """Ranks, and the pairs of tokens whose joined bytes are a token, in a hash table for array look-up."""

    def __init__(self, data: bytes):
        super().__init__(data)
        self.ranks = {t: r for r, t in self.tokens.items()}
        self.byte_rank = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for t, r in self.ranks.items():
            for i in range(1, len(t)):
                a, b = self.ranks.get(t[:i]), self.ranks.get(t[i:])
                if a is not None and b is not None:
                    pairs[(a << 20) | b] = r
        self.bits = max(4, (len(pairs) * 4 + 4).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64)
        k, v = np.fromiter(pairs, np.int64, len(pairs)), np.fromiter(pairs.values(), np.int64, len(pairs))
        self.probes, at = 0, self._slot(k)
        while len(k):  # each round places one key in every free slot asked for, and moves the others on
            free = self.keys[at] == -1
            slots, first = np.unique(at[free], return_index=True)
            chosen = np.flatnonzero(free)[first]
            self.keys[slots], self.values[slots] = k[chosen], v[chosen]
            rest = np.ones(len(k), bool)
            rest[chosen] = False
            k, v, at = k[rest], v[rest], (at[rest] + 1) & ((1 << self.bits) - 1)
            self.probes += 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the joined bytes of each pair, or 1 << 40."""
        key = (left << 20) | right
        at = self._slot(key)
        out = np.where(self.keys[at] == key, self.values[at], 1 << 40)
        open_ = np.flatnonzero((self.keys[at] != key) & (self.keys[at] != -1))
        at = at[open_]
        while len(open_):
            at = (at + 1) & ((1 << self.bits) - 1)
            got = self.keys[at]
            hit = got == key[open_]
            out[open_[hit]] = self.values[at[hit]]
            more = ~hit & (got != -1)
            open_, at = open_[more], at[more]
        return out

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """Ids, as packed little-endian unsigned 32-bit integers, of short pieces; each round merges one pair in every piece that still has one."""
        out: list[bytes] = [b""] * len(pieces)
        order = sorted(range(len(pieces)), key=lambda i: len(pieces[i]))
        for a in range(0, len(order), GRID_PIECES):
            part = order[a : a + GRID_PIECES]
            for i, ids in zip(part, self._merge_grid([pieces[i] for i in part]), strict=True):
                out[i] = ids
        return out

    def _merge_grid(self, pieces: list[bytes]) -> list[bytes]:
        n = np.array([len(p) for p in pieces])
        width = int(n.max(initial=0))
        grid = np.full((len(pieces), width + 1), -1, np.int64)
        grid[:, :-1][np.arange(width)[None, :] < n[:, None]] = self.byte_rank[np.frombuffer(b"".join(pieces), np.uint8)]
        none = 1 << 40
        rank = np.full((len(pieces), max(width, 1)), none, np.int64)
        has = grid[:, 1:] >= 0
        rank[:, :width][has] = self.joined(grid[:, :-1][has], grid[:, 1:][has])
        live = np.arange(len(pieces))
        while live.size:
            at = rank[live].argmin(axis=1)  # the first of equal ranks
            best = rank[live, at]
            go = best < none
            live, at, best = live[go], at[go], best[go]
            if not live.size:
                break
            g, r = grid[live], rank[live]
            cols = np.arange(width + 1)[None, :]
            # drop the right token of the pair: everything after it moves one place left
            src = np.minimum(cols + (cols > at[:, None]), width)
            g = np.take_along_axis(g, src, axis=1)
            g[:, -1] = -1
            g[np.arange(len(live)), at] = best
            r = np.take_along_axis(r, np.minimum(src[:, :-1], width - 1), axis=1)
            r[:, -1] = none
            for side in (at - 1, at):
                ok = side >= 0
                rows, c = np.flatnonzero(ok), side[ok]
                left, right = g[rows, c], g[rows, c + 1]
                value = np.full(len(rows), none)
                both = right >= 0
                value[both] = self.joined(left[both], right[both])
                r[rows, c] = value
            grid[live], rank[live] = g, r
        packed = grid.astype("<u4")
        counts = (grid >= 0).sum(axis=1).tolist()
        return [packed[i, :k].tobytes() for i, k in enumerate(counts)]

    def merge_long(self, piece: bytes) -> bytes:
        """One piece of any length; a token begins at its place and ends where the next one begins."""
        ranks, none = self.ranks, 1 << 30
        given = self.byte_rank[np.frombuffer(piece, np.uint8)].astype(np.int32)
        first = np.full(len(piece), none, np.int32)
        for a in range(0, len(piece) - 1, 1 << 20):
            b = min(a + (1 << 20), len(piece) - 1)
            first[a:b] = np.minimum(self.joined(given[a:b].astype(np.int64), given[a + 1 : b + 1].astype(np.int64)), none)
        ids = array("i", given.tobytes())
        del given
        return merged(ids, first, none, lambda i, _, end: ranks.get(piece[i:end]), lambda r: r).astype("<u4").tobytes()


def split_pieces(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(UTF-8 of all texts joined, byte at which each piece begins, number of pieces of each text)."""
    joined = "\0".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes + 1) - 1  # of each text, where the separator stands
    cut = np.zeros(len(points), bool)
    cut[ends[:-1]] = True
    c = classes_of(points, cut)
    begins = machine()[1].ravel()[c.astype(np.int64) * N_STATES + states_before(c)] & ~cut
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    width[cut] = 0
    byte_at = np.cumsum(width) - width
    where = np.flatnonzero(begins)
    per_text = np.searchsorted(where, ends) - np.searchsorted(where, ends - sizes)
    return "".join(texts).encode(), byte_at[where], per_text


def cuts(text: str) -> list[str]:
    """`text` in parts of about CUT_CHARS, each but the first beginning where a piece does: at what follows a letter or number and is neither of its kind nor a mark on it."""
    out, at = [], 0
    while len(text) - at > CUT_CHARS:
        place, look = 0, at + CUT_CHARS
        while not place and look < len(text):
            c = class_table()[np.frombuffer(text[look - 1 : look + LOOK_CHARS].encode("utf-32-le"), np.uint32)]
            ends = np.flatnonzero((c[:-1] <= NUMBER) & (c[1:] != c[:-1]))
            place = look + int(ends[0]) if len(ends) else 0
            look += LOOK_CHARS
        if not place:
            break
        out.append(text[at:place])
        at = place
    return [*out, text[at:]]


class Encoder:
    """Encodes texts; keeps the ids of short pieces met in a bounded cache."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.known = vocabulary, {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        parts = [(i, part) for i, t in enumerate(texts) for part in (cuts(t) if len(t) > CUT_CHARS else [t])]
        out: list[list[bytes]] = [[] for _ in texts]
        for a, b in ranges((len(p) for _, p in parts), 2 * CUT_CHARS):
            for (i, _), ids in zip(parts[a:b], self._encode([p for _, p in parts[a:b]]), strict=True):
                out[i].append(ids)
        return [b"".join(x) for x in out]

    def _encode(self, texts: list[str]) -> list[bytes]:
        data, starts, per_text = split_pieces(texts)
        bounds = [*starts.tolist(), len(data)]
        pieces = [data[a:b] for a, b in zip(bounds, bounds[1:])]
        known = self.known
        missing = {p for p in pieces if p not in known}
        if len(known) + len(missing) > CACHE_PIECES:
            known.clear()
            missing = set(pieces)
        todo = sorted(missing)
        short = [p for p in todo if len(p) <= SHORT_PIECE]
        known.update(zip(short, self.vocabulary.merge_many(short), strict=True))
        long = {p: self.vocabulary.merge_long(p) for p in todo if len(p) > SHORT_PIECE}
        known.update(long)
        out, at = [], 0
        for n in per_text.tolist():
            out.append(b"".join(map(known.__getitem__, pieces[at : at + n])))
            at += n
        for p in long:
            del known[p]
        return out


def _vocabulary(spark, path: str):
    """The vocabulary file goes to the executors as a broadcast: its size is that of the vocabulary, whatever the data."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


_built: dict[tuple[type, bytes], Tokens] = {}


def built(kind: type[Tokens], data: bytes) -> Tokens:
    """The tables of a vocabulary, made once in a worker process; a process keeps those of one vocabulary."""
    key = (kind, hashlib.md5(data).digest())
    if key not in _built:
        for other in [k for k in _built if k[1] != key[1]]:
            del _built[other]
        _built[key] = kind(data)
    return _built[key]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids, offsets): ids, and the byte at which each token begins, as packed little-endian unsigned 32-bit integers. One map, no shuffle."""
    shared = _vocabulary(docs.sparkSession, path)

    def make():
        vocabulary = built(Vocabulary, shared.value)
        encoder = Encoder(vocabulary)

        def work(texts: list[str]) -> dict[str, list]:
            ids = encoder.encode(texts)
            offsets = [vocabulary.places(np.frombuffer(x, "<u4")).astype("<u4").tobytes() for x in ids]
            return {"n_tokens": [len(x) // 4 for x in ids], "ids": ids, "offsets": offsets}

        return work

    return map_texts(docs, make, "n_tokens bigint, ids binary, offsets binary", id_col, text_col)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """`encoded` (id, n_tokens, ids, offsets) with decoded (binary) added: each token's bytes at its offset. Offsets that don't fit the tokens stop the job."""
    shared = _vocabulary(encoded.sparkSession, path)
    schema = StructType([encoded.schema[id_col], *StructType.fromDDL("n_tokens bigint, ids binary, offsets binary, decoded binary").fields])

    def run(batches):
        tokens = built(Tokens, shared.value)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(2)), 0).to_pylist()
            for a, b in ranges(sizes, MAP_BYTES):
                part = batch.slice(a, b - a)
                pairs = zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)
                decoded = [tokens.decode(np.frombuffer(x or b"", "<u4"), np.frombuffer(o or b"", "<u4")) for x, o in pairs]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(decoded, pa.binary())], [*part.schema.names, "decoded"])
        give_back()

    return encoded.select(name(id_col), "n_tokens", "ids", "offsets").mapInArrow(run, schema)
