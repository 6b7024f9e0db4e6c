"""BPE with word ends over a lexicon that is a minimal acyclic transducer.

Words are runs of bytes between ASCII white space. No token spans two of them, so the ids of a text are those of its words, one after another. The
frequent words of the whole corpus (`frequent`) are compiled into a transducer: byte arcs carry ids, pushed as far to the front as words with that beginning agree,
and equal suffixes, with equal outputs, are one state. It lies in a file as arrays, with the arcs of all states fitted into one table; tasks map
the file into memory, so that workers of a machine share it, and all words of a batch walk through it side by side, a byte at a time.
A word that it doesn't hold is normalised, split and merged exactly, pair by pair in order of rank, behind a bounded cache; the lexicon makes
encoding faster and never changes its result.

Normalisation is NFC and a lower case of each character; pieces are contractions, runs of letters, single digits and runs of the rest. Libraries differ in the
version of their Unicode tables: a word that isn't composed, or holds a combining mark or a code point unknown here, goes through the tokenizer library's own
normaliser and splitter. The strings of special tokens in a text
are those tokens. Decoding joins the tokens' strings by spaces, as the vocabulary names no decoder.

Cases: null or empty text has no tokens and decodes to an empty text; an empty table gives no rows (and an empty lexicon); equal texts and repeated rows give equal
rows; other columns are passed by. Whole texts are encoded: a long one by blocks of words, a single unbroken word of any length in some 30 bytes for each of its bytes.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..plans.staging import shared_folder
from .bpe import WHITE
from .common import MAP_BYTES, checkpointed, free, gathered, give_back, merged, name, ranges, strings, utf8, word_lists

#: A word is frequent if it is one in so many words of the corpus, and not the only one of its kind: at most so many words are.
FREQUENT = 2_000_000
#: Bytes of the longest word in the lexicon; words of a block that walk together; words that a task counts, and pieces that it holds, before it lets them go.
LONGEST, BLOCK, COUNTED, HELD = 24, 20_000, 200_000, 100_000
#: Symbols up to which a piece is merged by looking through all of it.
SHORT = 40
ASCII_WHITE = np.zeros(256, bool)
ASCII_WHITE[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20]] = True
_white = "".join(map(chr, WHITE))
#: The pieces of a word (fixed values of the vocabulary's splitter), and the line ends that are put between words.
PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{regex.escape(_white)}\p{{L}}\p{{N}}]+|\n")
ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\x09-\x0D\x20a-z0-9]+|\n")


@functools.cache
def settled(c: str) -> bool:
    """Whether a code point is assigned here and no combining mark."""
    return unicodedata.category(c) not in ("Cn", "Mn", "Mc", "Me")


def plain(text: str) -> bool:
    """Whether a text is composed and all its code points are settled, so that every library's tables agree on it."""
    return text.isascii() or unicodedata.is_normalized("NFC", text) and all(map(settled, set(text)))


class Merges:
    """A vocabulary with word ends: exact ids of any word."""

    def __init__(self, data: bytes):
        given = json.loads(data)
        model = given["model"]
        vocab, self.end = model["vocab"], model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in given["added_tokens"]}
        self._find = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.data = data.decode()
        by_id = {i: t for t, i in (vocab | self.special).items()}
        self.tokens = [by_id.get(i, "") for i in range(max(by_id) + 1)]
        # bytes stand as printable characters: those that are, as themselves, and the others from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = dict(zip(plain, plain, strict=True)) | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in plain)}
        self.inner, self.last = ([vocab[chr(shown[b]) + end] for b in range(256)] for end in ("", self.end))
        self.rank, self.made = {}, []
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[vocab[a] << 20 | vocab[b]] = r
            self.made.append(vocab[a + b])
        self.known: dict[str, array] = {}
        self.before: dict[str, array] = {}

    @functools.cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self.data)

    def word(self, word: bytes) -> array:
        """Ids of one word."""
        return self.words([word])[0]

    def words(self, words: list[bytes]) -> tuple[array, list[int]]:
        """(ids of words, one after another, and where those of each end). Words without special tokens whose code points are settled are split all together."""
        joined = b"\n".join(words).decode()
        if plain(joined) and not (self._find and self._find.search(joined)):
            return self._split(joined)
        ids, ends = array("i"), []
        for w in words:
            self._alone(w.decode(), ids)
            ends.append(len(ids))
        return ids, ends

    def _split(self, joined: str) -> tuple[array, list[int]]:
        """`words` of a text of words with a line end after each but the last; pieces that were met of late are looked up."""
        ids, ends = array("i"), []
        known, before = self.known.get, self.before.get
        text = joined.lower() if joined.isascii() else joined.replace("Σ", "σ").lower()  # no other form at the end of a word
        for p in (ASCII_PIECES if joined.isascii() else PIECES).findall(text):
            if p == "\n":
                ends.append(len(ids))
                continue
            got = known(p)
            if got is None:
                got = before(p)
                if got is None:
                    got = self.piece(p.encode())
                if len(p) <= SHORT:
                    self.known[p] = got
            ids.extend(got)
        ends.append(len(ids))
        if len(self.known) > HELD:
            self.before, self.known = self.known, {}
        return ids, ends

    def _alone(self, text: str, out: array) -> None:
        """Ids of one word of any kind."""
        at = 0
        for m in self._find.finditer(text) if self._find else ():
            self._alone_plain(text[at : m.start()], out)
            out.append(self.special[m[0]])
            at = m.end()
        self._alone_plain(text[at:], out)

    def _alone_plain(self, text: str, out: array) -> None:
        if plain(text):
            out.extend(self._split(text)[0])
            return
        bytes_of = {s: b for b, s in enumerate(self.tokens[i] for i in self.inner)}
        for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text)):
            out.extend(self.piece(bytes(map(bytes_of.__getitem__, piece))))

    def piece(self, piece: bytes) -> array:
        """Ids of one piece."""
        symbols = array("i", map(self.inner.__getitem__, piece))
        symbols[-1] = self.last[piece[-1]]
        return self._long(symbols) if len(piece) > SHORT else self._short(symbols)

    def _short(self, ids: array) -> array:
        get, made, none = self.rank.get, self.made, 1 << 30
        ids = ids.tolist()
        ranks = [get(a << 20 | b, none) for a, b in pairwise(ids)]
        while ranks:
            r = min(ranks)
            if r == none:
                break
            i = ranks.index(r)  # the first of equals
            ids[i : i + 2] = [made[r]]
            del ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << 20 | ids[i], none)
            if i < len(ranks):
                ranks[i] = get(ids[i] << 20 | ids[i + 1], none)
        return array("i", ids)

    def _long(self, ids: array) -> array:
        rank, n = self.rank, len(ids)
        keys = np.fromiter(rank, np.int64, len(rank))
        order = np.argsort(keys)
        keys = keys[order]
        first = np.full(n, len(rank), np.int32)
        view = np.frombuffer(ids, np.int32)
        for a in range(0, n - 1, 1 << 20):
            b = min(a + (1 << 20), n - 1)
            pair = view[a:b].astype(np.int64) << 20 | view[a + 1 : b + 1]
            at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
            first[a:b] = np.where(keys[at] == pair, order[at], len(rank))
        return array("i", merged(ids, first, len(rank), lambda i, j, _: rank.get(ids[i] << 20 | ids[j]), self.made.__getitem__).tobytes())


# the lexicon

ARRAYS = ("base", "owner", "target", "arc", "final", "starts", "pool")


def compiled(words: dict[bytes, array]) -> bytes:
    """The minimal transducer from words to their ids, as a file."""
    keys = sorted(words)
    outputs: dict[tuple, int] = {(): 0}
    states: dict[tuple, int] = {}

    def shared(a: tuple, b: tuple) -> tuple:
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))  # noqa: B905
        return a[:n]

    def state(lo: int, hi: int, depth: int) -> tuple[int, tuple]:
        """The state of what follows the first `depth` bytes of words lo..hi, which share them, and the ids on which they all agree."""
        final, arcs, at = None, [], lo
        if len(keys[lo]) == depth:
            final, at = tuple(words[keys[lo]]), lo + 1
        while at < hi:
            byte, end = keys[at][depth], at + 1
            while end < hi and keys[end][depth] == byte:
                end += 1
            target, out = state(at, end, depth + 1)
            arcs.append((byte, out, target))
            at = end
        common = functools.reduce(shared, [out for _, out, _ in arcs] + [final] * (final is not None))
        rest = tuple((b, outputs.setdefault(out[len(common) :], len(outputs)), t) for b, out, t in arcs)
        key = (-1 if final is None else outputs.setdefault(final[len(common) :], len(outputs)), rest)
        return states.setdefault(key, len(states)), common

    top: tuple = (-1, ())
    if keys:
        root, common = state(0, len(keys), 0)
        top = list(states)[root]
        if common:  # ids that all words begin with go on the first arcs
            by = {i: o for o, i in outputs.items()}
            top = (top[0], tuple((b, outputs.setdefault(common + by[o], len(outputs)), t) for b, o, t in top[1]))
    every = [top, *list(states)[:-1]]  # the root, which was the last to be made, is state 0
    base, final = np.zeros(len(every), np.int32), np.array([s[0] for s in every], np.int32)
    used = np.zeros(len(every) * 8 + 1024, bool)
    slots: list[tuple[int, int, int, int]] = []
    arcs_before, at = 0, 0
    for i in sorted(range(len(every)), key=lambda i: -len(every[i][1])):
        arcs = every[i][1]
        if not arcs:
            continue
        own = np.array([a[0] for a in arcs])
        if len(arcs) != arcs_before:  # states of fewer arcs look for holes from the beginning, those of as many go on
            arcs_before, at = len(arcs), 0
        while True:  # the first place where all arcs fit
            tries = np.arange(at, at + 2048)
            if tries[-1] + 256 >= len(used):
                used = np.concatenate([used, np.zeros(len(used) + 4096, bool)])
            fits = np.flatnonzero(~used[tries[:, None] + own].any(axis=1))
            if len(fits):
                break
            at += 2048
        base[i] = at = int(tries[fits[0]])
        used[at + own] = True
        slots += [(int(base[i]) + b, i, t + 1, o) for b, o, t in arcs]
    size = int(base.max()) + 257
    owner, target, arc = np.full(size, -1, np.int32), np.zeros(size, np.int32), np.zeros(size, np.int32)
    if slots:
        place, whose, to, out = np.array(slots, np.int64).T
        owner[place], target[place], arc[place] = whose, to, out
    starts = np.concatenate([[0], np.cumsum([len(o) for o in outputs])]).astype(np.int32)
    pool = np.array([i for o in outputs for i in o], np.int32)
    parts = [base, owner, target, arc, final, starts, pool]
    return np.array([len(p) for p in parts], np.int64).tobytes() + b"".join(p.tobytes() for p in parts)


class Lexicon:
    """A compiled lexicon, mapped from its file."""

    def __init__(self, path: str):
        sizes = np.fromfile(path, np.int64, len(ARRAYS))
        at = sizes.nbytes
        for k, n in zip(ARRAYS, sizes.tolist(), strict=True):
            setattr(self, k, np.memmap(path, np.int32, "r", at, (n,)) if n else np.zeros(0, np.int32))
            at += 4 * n
        self.sizes = np.diff(self.starts)

    def walk(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(held, outputs): whether the lexicon has each word, and by word the number of the output at each byte and at the end."""
        n, width = len(starts), min(int(sizes.max(initial=0)), LONGEST)
        out, state = np.zeros((n, width + 1), np.int32), np.zeros(n, np.int32)
        held = sizes <= LONGEST
        live = np.flatnonzero(held)
        for i in range(width):
            live = live[sizes[live] > i]
            s = state[live]
            slot = self.base[s] + data[starts[live] + i]
            on = self.owner[slot] == s
            held[live[~on]] = False
            live, slot = live[on], slot[on]
            out[live, i], state[live] = self.arc[slot], self.target[slot]
        final = self.final[state]
        held &= final >= 0
        out[held, width] = final[held]
        return held, out


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, sizes) of the words of many texts, and how many words stand before each text."""
    solid = ~ASCII_WHITE[data]
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    first = offsets[:-1][np.diff(offsets) > 0]
    begins[first] = solid[first]
    ends[first[1:] - 1] = solid[first[1:] - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1 - starts, np.searchsorted(starts, offsets)


class Encoder:
    def __init__(self, merges: Merges, lexicon: Lexicon):
        self.merges, self.lexicon = merges, lexicon

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many stand before each)."""
        starts, sizes, before = words_of(data, offsets)
        lexicon, parts, counts = self.lexicon, [], []
        for a in range(0, len(starts), BLOCK):
            s, n = starts[a : a + BLOCK], sizes[a : a + BLOCK]
            held, out = lexicon.walk(data, s, n)
            new = np.flatnonzero(~held)
            first, raw = int(s[0]), data[s[0] : s[-1] + n[-1]].tobytes()
            found, ends = self.merges.words([raw[i : i + k] for i, k in zip((s[new] - first).tolist(), n[new].tolist(), strict=True)]) if len(new) else (array("i"), [])
            # outputs of words that the lexicon doesn't hold are numbered after its own
            own = np.diff(np.array([0, *ends], np.int64))
            size = np.concatenate([lexicon.sizes, own])
            begin = np.concatenate([lexicon.starts[:-1], len(lexicon.pool) + np.cumsum(own) - own])
            out[new] = 0
            out[new, 0] = len(lexicon.sizes) + np.arange(len(new))
            pool = np.concatenate([lexicon.pool, np.frombuffer(found, np.int32)])
            row, at = np.nonzero(out)
            flat = out[row, at]
            counts.append(np.bincount(row, size[flat], len(s)).astype(np.int64))
            parts.append(gathered(pool, begin[flat], size[flat]))
        count = np.concatenate([[0], *counts]).cumsum()
        return np.concatenate([np.zeros(0, np.int32), *parts]), count[before]


def frequent(docs: DataFrame, text_col: str = "text") -> dict[bytes, int]:
    """Words of up to LONGEST bytes that are at least one in FREQUENT words of all texts, with their counts: no more than FREQUENT, whatever the corpus."""
    schema = "word binary, n bigint"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], ["word", "n"])
            seen.clear()
            return out

        for batch in batches:
            offsets, data = utf8(batch.column(0))
            for a, b in zip(offsets, offsets[1:], strict=False):
                for words in word_lists(data[a:b].tobytes()):
                    seen[b""] += len(words)  # the empty word stands for all
                    seen.update(words if max(map(len, words), default=0) <= LONGEST else [w for w in words if len(w) <= LONGEST])
                    if len(seen) > COUNTED:
                        yield rows()
        yield rows()
        give_back()

    counts = docs.select(name(text_col)).mapInArrow(count, schema).groupBy("word").agg(F.sum("n").alias("n"))
    kept = checkpointed(counts.where("n > 1 or word = X''"))
    total = kept.where("word = X''").agg(F.max("n")).first()[0] or 0
    return {bytes(r.word): r.n for r in kept.where((F.col("n") * FREQUENT >= total) & (F.col("n") > 1) & (F.length("word") > 0)).collect()}


def lexicon_file(docs: DataFrame, path: str, text_col: str = "text") -> str:
    """The name under which the session's tasks find the lexicon of `docs` (`SparkFiles`): written to the shared folder once, fetched by each executor."""
    with open(path, "rb") as f:
        merges = Merges(f.read())
    data = compiled({w: merges.word(w) for w in frequent(docs, text_col)})
    return shipped(docs.sparkSession, data)


def shipped(spark: SparkSession, data: bytes) -> str:
    sc = spark.sparkContext
    file = f"lexicon-{hashlib.md5(data).hexdigest()}.bin"
    place = sc._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark).rstrip('/')}/{file}")
    files = place.getFileSystem(sc._jsc.hadoopConfiguration())
    if not files.exists(place):
        half = place.suffix(".new")
        out = files.create(half, True)
        out.write(bytearray(data))
        out.close()
        files.rename(half, place)
    sc.addFile(files.makeQualified(place).toString())
    return file


_held: dict[str, object] = {}


def _kept(key: str, make):
    """What a worker process made once; it keeps two things, a vocabulary and a lexicon."""
    if key not in _held:
        for other in [k for k in _held if k[0] == key[0]]:
            del _held[other]
        _held[key] = make()
    return _held[key]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", lexicon: str | None = None) -> DataFrame:
    """(id, n_tokens, ids): `path` is the tokenizer's file; `lexicon` a name from `lexicon_file`, made of `docs` if none is given."""
    lexicon = lexicon or lexicon_file(docs, path, text_col)
    with open(path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    out = StructType([StructField(id_col, docs.schema[id_col].dataType), *StructType.fromDDL("n_tokens bigint, ids array<int>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = _kept("m" + hashlib.md5(shared.value).hexdigest(), lambda: Merges(shared.value))
        encoder = Encoder(merges, _kept("l" + lexicon, lambda: Lexicon(SparkFiles.get(lexicon))))
        for batch in batches:
            offsets, data = utf8(batch.column(1))
            for a, b in ranges(np.diff(offsets).tolist(), 4 * MAP_BYTES):
                ids, before = encoder.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                lists = pa.ListArray.from_arrays(pa.array(before, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(before)), lists], [id_col, "n_tokens", "ids"])
        give_back()

    return docs.select(name(id_col), name(text_col)).mapInArrow(run, out)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """`encoded` with `decoded` added: the strings of the ids, joined by spaces. Null ids decode to an empty text."""
    with open(path, "rb") as f:
        shared = encoded.sparkSession.sparkContext.broadcast(f.read())
    (added,) = free(encoded.columns, "decoded")
    out = StructType([*encoded.schema.fields, StructField(added, StructType.fromDDL("x string")["x"].dataType)])
    column = encoded.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = _kept("m" + hashlib.md5(shared.value).hexdigest(), lambda: Merges(shared.value))
        tokens = [t.encode() + b" " for t in merges.tokens]
        sizes = np.array([len(t) for t in tokens])
        source, starts = np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(sizes) - sizes
        for batch in batches:
            for a, b in ranges(pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_pylist(), MAP_BYTES):
                part = batch.slice(a, b - a)
                count = pc.fill_null(pc.list_value_length(part.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                ids = part.column(column).flatten().to_numpy(zero_copy_only=False)
                size = sizes[ids]
                ends = np.cumsum(count)
                size[ends[count > 0] - 1] -= 1  # no space after the last
                upto = np.concatenate([[0], np.cumsum(size)])
                text = strings(np.concatenate([[0], upto[ends]]), gathered(source, starts[ids], size))
                yield pa.RecordBatch.from_arrays([*part.columns, text.cast(pa.string())], [*part.schema.names, added])
        give_back()

    return encoded.mapInArrow(run, out)
