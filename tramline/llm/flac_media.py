"""Media columns: lossless FLAC streams of 8-bit mono samples, written and read in numpy, many frames at a time.

`encode` writes a stream with STREAMINFO (MD5 of the samples), one SEEKTABLE point for each frame, and frames of `BLOCK` samples whose
subframe is constant, verbatim, or a fixed linear predictor of order 0 to 4 with Rice-coded residuals. `pcm` reads such streams and those with
quantised linear predictors (LPC, any order, precision and shift) and partitioned or escaped Rice codes; it verifies the CRC-8 of each frame
header, the CRC-16 of each frame and the MD5, and gives PCM blocks with the sample offsets by which a reader can seek; `block_at` reads the one
block that holds a sample. All that `read_back` tells of a stream comes from these blocks.

The encoder doesn't write LPC: text has no spectrum that a quantised predictor would catch beyond the fixed ones.

Frames are written and read by ranges of about a million samples, whatever streams they belong to, so that memory beside payload and
stream is bounded. The frames of a range are decoded in lockstep: step n reads the n-th residual of every frame with array operations, so no loop
runs over samples of one frame. A stream is a value of its own: equal payloads give equal streams, repeated rows too.

Null or empty text is stored as 64 zero bytes. An empty table gives an empty one. Other columns are passed by, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from .common import give_back, map_texts, name, ranges

BLOCK = 1024
RATE = 8000
PAD = 64
MAX_RICE = 14
_CHUNK = 1_000_000
SEGMENT = 512 * BLOCK
_POINT = [("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")]
#: Seek points of one metadata block; longer streams have several.
MAX_POINTS = 900_000


def crc_table(poly: int, bits: int) -> np.ndarray:
    out = np.arange(256, dtype=np.uint32) << np.uint32(bits - 8)
    for _ in range(8):
        high = (out >> np.uint32(bits - 1)) & np.uint32(1)
        out = ((out << np.uint32(1)) ^ (high * np.uint32(poly))) & np.uint32((1 << bits) - 1)
    return out


_CRC8, _CRC16 = crc_table(0x07, 8), crc_table(0x8005, 16)


def crcs(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """CRC of buf[start:end] for every range, byte by byte over all ranges at once, longest first."""
    order = np.argsort(starts - ends, kind="stable")
    at, length = starts[order], (ends - starts)[order]
    crc = np.zeros(len(at), np.uint32)
    # how many ranges are longer than i
    active = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), side="left")
    mask = np.uint32((1 << bits) - 1)
    for i, n in enumerate(active.tolist()):
        c = crc[:n]
        crc[:n] = ((c << np.uint32(8)) & mask) ^ table[(c >> np.uint32(bits - 8)) ^ buf[at[:n] + i]]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def frame_number(n: int) -> bytes:
    """The number in the format's UTF-8-like code of up to 36 bits."""
    if n < 0x80:
        return bytes([n])
    k = next(k for k in range(2, 8) if n < 1 << (5 * k + 1))
    lead = (0xFF << (8 - k)) & 0xFF if k < 7 else 0xFE
    return bytes([lead | (n >> 6 * (k - 1)), *(0x80 | (n >> 6 * j) & 0x3F for j in range(k - 2, -1, -1))])


def frame_header(number: int, size: int) -> bytes:
    """Fixed block size stream, 8-bit mono; the block size stands at the end in 16 bits. CRC-8 not included."""
    return b"\xff\xf8" + bytes([0x70, 0x02]) + frame_number(number) + struct.pack(">H", size - 1)


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every range, one after the other."""
    total = int(lengths.sum())
    return np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(total)


def encode(payloads: list[bytes]) -> list[bytes]:
    """Streams of payloads of a byte or more."""
    parts = [(i, at) for i, p in enumerate(payloads) for at in range(0, len(p), SEGMENT)]
    frames: list[list[bytes]] = [[] for _ in payloads]
    lengths: list[list[np.ndarray]] = [[] for _ in payloads]
    for a, b in ranges((min(SEGMENT, len(payloads[i]) - at) for i, at in parts), _CHUNK):
        part = parts[a:b]
        for (i, _), (data, n) in zip(part, _encode_frames([payloads[i][at : at + SEGMENT] for i, at in part], [at // BLOCK for _, at in part]), strict=True):
            frames[i].append(data)
            lengths[i].append(n)
    return [_stream(p, f, np.concatenate(n)) for p, f, n in zip(payloads, frames, lengths, strict=True)]


def _stream(payload: bytes, frames: list[bytes], lengths: np.ndarray) -> bytes:
    points = np.zeros(len(lengths), dtype=_POINT)
    points["sample"] = np.arange(len(lengths)) * BLOCK
    points["n"] = np.minimum(BLOCK, len(payload) - points["sample"].astype(np.int64))
    points["offset"] = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    info = struct.pack(">HH", BLOCK, BLOCK) + int(lengths.min()).to_bytes(3) + int(lengths.max()).to_bytes(3)
    info += ((RATE << 44) | (0 << 41) | (7 << 36) | len(payload)).to_bytes(8) + hashlib.md5(np.frombuffer(payload, np.uint8) ^ np.uint8(0x80)).digest()
    blocks = [b"\0" + len(info).to_bytes(3) + info]
    for at in range(0, len(points), MAX_POINTS):  # a metadata block has a length of 24 bits
        table = points[at : at + MAX_POINTS].tobytes()
        last = at + MAX_POINTS >= len(points)
        blocks.append((b"\x83" if last else b"\x03") + len(table).to_bytes(3) + table)
    return b"".join([b"fLaC", *blocks, *frames])


def _encode_frames(payloads: list[bytes], first_numbers: list[int]) -> list[tuple[bytes, np.ndarray]]:
    """(frames, length of each) of every payload, whose frames are numbered from its first number on."""
    raw = np.frombuffer(b"".join(payloads), np.uint8)
    x = raw.astype(np.int32) - 128
    sizes = np.array([len(p) for p in payloads])
    frames = [-(-n // BLOCK) for n in sizes.tolist()]
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    place = np.concatenate([np.arange(k) for k in frames])
    stream = np.repeat(np.arange(len(payloads)), frames)
    number = place + np.array(first_numbers)[stream]
    start = first[stream] + place * BLOCK
    size = np.minimum(BLOCK, first[stream] + sizes[stream] - start)
    inside = np.arange(len(x)) - np.repeat(start, size)
    # the predictor whose residuals have the least sum of magnitudes
    residuals, d, cost = [], x, []
    for order in range(5):
        if order:
            d = np.diff(d, prepend=np.int32(0))
        masked = np.where(inside < order, 0, d)
        residuals.append(masked)
        cost.append(np.where(size > order, np.add.reduceat(np.abs(masked), start), 1 << 40))
    best = np.argmin(np.stack(cost), axis=0)
    lo, hi = np.minimum.reduceat(x, start), np.maximum.reduceat(x, start)
    constant = lo == hi
    order_of = np.repeat(best, size)
    r = np.choose(order_of, residuals)
    coded = inside >= order_of
    zz = np.where(r >= 0, 2 * r, -2 * r - 1)
    zz[~coded] = 0
    n_coded = size - best
    # the Rice parameter: the best of three near the logarithm of the mean
    mean = np.add.reduceat(zz, start) / np.maximum(n_coded, 1)
    near = np.clip(np.log2(np.maximum(mean, 1)).astype(np.int64), 1, MAX_RICE - 1)
    tried = []
    for k in (near - 1, near, near + 1):
        tried.append(np.add.reduceat(zz >> np.repeat(k, size).astype(zz.dtype), start) + n_coded * (k + 1))
    pick = np.argmin(np.stack(tried), axis=0)
    rice = near - 1 + pick
    rice_bits = 8 * best + 10 + np.choose(pick, tried)
    verbatim = ~constant & (rice_bits >= 8 * size)
    coded_frame = ~constant & ~verbatim
    body_bits = np.where(constant, 8, np.where(verbatim, 8 * size, rice_bits)) + 8
    heads = [frame_header(n, s) for n, s in zip(number.tolist(), size.tolist(), strict=True)]
    head_len = np.array([len(h) + 1 for h in heads])
    frame_len = head_len + (body_bits + 7) // 8 + 2
    at = np.concatenate([[0], np.cumsum(frame_len)[:-1]])
    bits = np.zeros(int(frame_len.sum()) * 8, np.uint8)
    body = (at + head_len) * 8  # of the subframe
    kind = np.where(constant, 0, np.where(verbatim, 1, 8 + best))
    for j in range(6):
        bits[body + 1 + j] = (kind >> (5 - j)) & 1

    def put(places: np.ndarray, values: np.ndarray, width: int) -> None:
        for j in range(width):
            bits[places + j] = (values >> (width - 1 - j)) & 1

    put(body[constant] + 8, raw[start[constant]] ^ 0x80, 8)
    plain = np.repeat(verbatim, size) | np.repeat(coded_frame, size) & ~coded  # verbatim and warm-up samples
    put((np.repeat(body + 8, size) + 8 * inside)[plain], raw[plain] ^ 0x80, 8)
    after = body + 8 + 8 * best
    put(after[coded_frame] + 6, rice[coded_frame], 4)  # method 0, partition order 0, parameter
    take = np.repeat(coded_frame, size) & coded
    k = np.repeat(rice, size)[take]
    v = zz[take]
    width = (v >> k) + 1 + k
    n_codes = np.where(coded_frame, n_coded, 0)
    ends = np.cumsum(width)
    before = np.concatenate([[0], np.cumsum(n_codes)])[:-1]
    base = np.concatenate([[0], ends])[before]
    code = ends - width + np.repeat(after + 10 - base, n_codes)
    stop = code + (v >> k)
    bits[stop] = 1
    least, end_of = int(k.min(initial=0)), stop + k
    for j in range(int(k.max(initial=0))):
        some = slice(None) if j < least else k > j
        bits[end_of[some] - j] = (v[some] >> j) & 1
    buf = np.packbits(bits)
    head_bytes = np.frombuffer(b"".join(heads), np.uint8)
    buf[_ranges(at, head_len - 1)] = head_bytes
    buf[at + head_len - 1] = crcs(buf, at, at + head_len - 1, _CRC8, 8)
    end = at + frame_len
    check = crcs(buf, at, end - 2, _CRC16, 16)
    buf[end - 2], buf[end - 1] = check >> 8, check & 0xFF
    edges = np.append(at, len(buf))[np.concatenate([[0], np.cumsum(frames)])]
    per = np.split(frame_len, np.cumsum(frames)[:-1])
    return [(buf[p:q].tobytes(), n) for p, q, n in zip(edges[:-1], edges[1:], per, strict=True)]


class Corrupt(ValueError):
    """A stream that doesn't parse or whose checks fail."""


def decode(streams: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(samples as int8, first sample of each PCM block) of every stream."""
    parts: list[list[np.ndarray]] = [[] for _ in streams]
    offsets: list[list[int]] = [[] for _ in streams]
    for i, first, samples in pcm(streams):
        parts[i].append(samples)
        offsets[i].append(first)
    return [(np.concatenate(p), np.array(o, np.int64)) for p, o in zip(parts, offsets, strict=True)]


def pcm(streams: list[bytes]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(stream, sample offset, samples as int8) of every PCM block, by stream and offset. A stream whose samples fail its MD5 raises after its last block."""
    meta = [_metadata(s) for s in streams]
    frames = [(i, k) for i, m in enumerate(meta) for k in range(len(m[2]))]
    done, digest = 0, hashlib.md5()
    for a, b in ranges((int(meta[i][2]["n"][k]) for i, k in frames), _CHUNK):
        part = frames[a:b]
        for (i, k), samples in zip(part, _decode_frames([_frame(streams[i], meta[i], k) for i, k in part], [int(meta[i][2]["n"][k]) for i, k in part]), strict=True):
            total, md5, points, _ = meta[i]
            if int(points["sample"][k]) != done:
                raise Corrupt("a seek point is out of place")
            yield i, done, samples
            digest.update(samples)
            done += len(samples)
            if k + 1 == len(points):
                if done != total or digest.digest() != md5:
                    raise Corrupt("the samples fail the stream's MD5")
                done, digest = 0, hashlib.md5()


def _frame(stream: bytes, meta: tuple[int, bytes, np.ndarray, int], k: int) -> bytes:
    _, _, points, at = meta
    end = at + int(points["offset"][k + 1]) if k + 1 < len(points) else len(stream)
    return stream[at + int(points["offset"][k]) : end]


def block_at(stream: bytes, sample: int) -> tuple[int, np.ndarray]:
    """(sample offset, samples) of the PCM block that holds a sample; only its frame is read."""
    meta = _metadata(stream)
    if not 0 <= sample < meta[0]:
        raise IndexError(sample)
    k = int(np.searchsorted(meta[2]["sample"].astype(np.int64), sample, side="right")) - 1
    (samples,) = _decode_frames([_frame(stream, meta, k)], [int(meta[2]["n"][k])])
    return int(meta[2]["sample"][k]), samples


def _metadata(s: bytes) -> tuple[int, bytes, np.ndarray, int]:
    """(total samples, MD5, seek points, offset of the first frame)."""
    if s[:4] != b"fLaC":
        raise Corrupt("no stream marker")
    at, last, total, md5, tables = 4, False, -1, b"", []
    while not last:
        last, kind, n = bool(s[at] & 0x80), s[at] & 0x7F, int.from_bytes(s[at + 1 : at + 4])
        block = s[at + 4 : at + 4 + n]
        if kind == 0:
            packed = int.from_bytes(block[10:18])
            if (packed >> 36) & 31 != 7 or (packed >> 41) & 7:
                raise Corrupt("not 8-bit mono")
            total, md5 = packed & (1 << 36) - 1, block[18:34]
        elif kind == 3:
            tables.append(np.frombuffer(block, dtype=_POINT))
        at += 4 + n
    if total < 0 or not tables:
        raise Corrupt("no stream information or seek table")
    return total, md5, np.concatenate(tables), at


class _Bits:
    """Reads of one field at the bit position of each frame."""

    def __init__(self, buf: np.ndarray):
        padded = np.concatenate([buf, np.zeros(16, np.uint8)]).astype(np.uint64)
        self.words = np.zeros(len(buf) + 8, np.uint64)  # the 8 bytes from each byte on
        for j in range(8):
            self.words |= padded[j : j + len(self.words)] << np.uint64(56 - 8 * j)

    def window(self, pos: np.ndarray) -> np.ndarray:
        """At least 57 bits from pos on, at the high end."""
        return self.words[pos >> 3] << (pos & 7).astype(np.uint64)

    def read(self, pos: np.ndarray, width: int) -> np.ndarray:
        return (self.window(pos) >> np.uint64(64 - width)).astype(np.int64) if width else np.zeros(len(pos), np.int64)

    def signed(self, pos: np.ndarray, width: int) -> np.ndarray:
        v = self.read(pos, width)
        return v - ((v >> (width - 1)) << width) if width else v


def _unary(bits: _Bits, pos: np.ndarray) -> np.ndarray:
    """Zeros before the next one bit."""
    top = bits.window(pos) >> np.uint64(32)
    zeros = 32 - np.frexp(top.astype(np.float64))[1].astype(np.int64)
    if (more := np.flatnonzero(top == 0)).size:
        total, left = zeros, more
        while left.size:
            if total[left].max() > 1 << 24:
                raise Corrupt("a code without an end")
            top = bits.window(pos[left] + total[left]) >> np.uint64(32)
            total[left] += 32 - np.frexp(top.astype(np.float64))[1].astype(np.int64)
            left = left[top == 0]
    return zeros


_ZEROS = 16 - np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.int64)  # leading zeros of 16 bits


def _plain_rice(bits: _Bits, x: np.ndarray, coded: np.ndarray, running: np.ndarray, pos: np.ndarray, order: np.ndarray) -> None:
    """Residuals of frames with one partition: one read of 57 bits gives quotient and remainder, unless the quotient is 16 or more."""
    at, order = pos[coded], order[coded]
    k = bits.read(at, 4)
    if (k == 15).any():
        return _rice_parts(bits, x, np.isin(np.arange(len(pos)), coded), running, pos, order=_spread(order, coded, len(pos)), part=np.full(len(pos), 1 << 60), wide=np.full(len(pos), 4))
    at = at + 4
    live = np.searchsorted(coded, running)  # of the coded frames, those that run at step n
    warm, words = int(order.max(initial=0)), bits.words
    down = (63 - k).astype(np.uint64)
    out = np.zeros((len(x), len(coded)), np.int64)
    for n, m in enumerate(live.tolist()):
        if not m:
            break
        f = slice(0, m) if n >= warm else np.flatnonzero(order[:m] <= n)
        p = at[f]
        w = words[p >> 3] << (p & 7).astype(np.uint64)
        q = _ZEROS[(w >> np.uint64(48)).astype(np.int64)]
        kf = k[f]
        if q.max(initial=0) < 16:
            low = (w << (q + 1).astype(np.uint64)) >> np.uint64(1) >> down[f]
        else:
            q = _unary(bits, p)
            low = bits.window(p + q + 1) >> np.uint64(1) >> down[f]
        v = (q << kf) | low.astype(np.int64)
        out[n, f] = (v >> 1) ^ -(v & 1)
        at[f] = p + q + 1 + kf
    hit = np.arange(len(x))[:, None] >= order[None, :]
    x[:, coded] = np.where(hit, out, x[:, coded])


def _spread(values: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, values.dtype)
    out[places] = values
    return out


def _rice_parts(bits: _Bits, x: np.ndarray, coded: np.ndarray, running: np.ndarray, pos: np.ndarray, order: np.ndarray, part: np.ndarray, wide: np.ndarray) -> None:
    """Residuals in any number of partitions, with 4- or 5-bit parameters and escapes to plain numbers."""
    pos, n_frames = pos.copy(), len(pos)
    k, escaped, raw_bits = np.zeros(n_frames, np.int64), np.zeros(n_frames, bool), np.zeros(n_frames, np.int64)
    for n in range(len(x)):
        m = int(running[n])
        f = np.flatnonzero(coded[:m] & (order[:m] <= n))
        if not f.size:
            continue
        fresh = f[(order[f] == n) | (n % part[f] == 0)]
        for width in (4, 5):
            g = fresh[wide[fresh] == width]
            k[g] = bits.read(pos[g], width)
            pos[g] += width
            escaped[g] = k[g] == (1 << width) - 1
        g = fresh[escaped[fresh]]
        raw_bits[g] = bits.read(pos[g], 5)
        pos[g] += 5
        for g in f[escaped[f]].tolist():
            x[n, g] = bits.signed(pos[g : g + 1], int(raw_bits[g]))[0]
            pos[g] += raw_bits[g]
        f = f[~escaped[f]]
        p = pos[f]
        q = _unary(bits, p)
        low = (bits.window(p + q + 1) >> np.uint64(1) >> (63 - k[f]).astype(np.uint64)).astype(np.int64)
        v = (q << k[f]) | low
        x[n, f] = (v >> 1) ^ -(v & 1)
        pos[f] = p + q + 1 + k[f]


def _decode_frames(frames: list[bytes], sizes: list[int]) -> list[np.ndarray]:
    """Samples (int8) of each frame."""
    buf = np.frombuffer(b"".join(frames), np.uint8)
    end = np.cumsum([len(f) for f in frames])
    at = end - [len(f) for f in frames]
    size = np.array(sizes, np.int64)
    # frame headers
    if not ((buf[at] == 0xFF) & (buf[at + 1] & 0xFE == 0xF8)).all():
        raise Corrupt("no frame at a seek point")
    code = buf[at + 2] >> 4
    lead = buf[at + 4]
    extra = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC, lead < 0xFE], [0, 1, 2, 3, 4, 5], 6)
    after = at + 5 + extra + np.select([code == 6, code == 7], [1, 2], 0)
    told = np.select([code == 6, code == 7], [buf[after - 1].astype(np.int64) + 1, (buf[after - 2].astype(np.int64) << 8) + buf[after - 1] + 1], np.where(code == 1, 192, np.where(code <= 5, 576 << np.maximum(code.astype(np.int64) - 2, 0), 256 << np.maximum(code.astype(np.int64) - 8, 0))))
    if (told != size).any() or (crcs(buf, at, after, _CRC8, 8) != buf[after]).any():
        raise Corrupt("a frame header fails its check")
    if (crcs(buf, at, end - 2, _CRC16, 16) != (buf[end - 2].astype(np.uint32) << 8) + buf[end - 1]).any():
        raise Corrupt("a frame fails its check")
    # subframes, longest first, so that those still running are a prefix
    bits = _Bits(buf)
    order_by = np.argsort(-size, kind="stable")
    size, pos = size[order_by], (after[order_by] + 1) * 8
    kind = bits.read(pos, 8) >> 1
    if (bits.read(pos, 8) & 1).any():
        raise Corrupt("wasted bits aren't supported")
    pos = pos + 8
    n_frames, longest = len(size), int(size.max(initial=0))
    x = np.zeros((longest, n_frames), np.int64)
    running = np.searchsorted(-size, -np.arange(longest), side="left")
    constant, verbatim, fixed, lpc = kind == 0, kind == 1, (kind >= 8) & (kind <= 12), kind >= 32
    if not (constant | verbatim | fixed | lpc).all():
        raise Corrupt("an unknown subframe")
    order = np.where(fixed, kind - 8, np.where(lpc, kind - 31, 0))
    x[:, constant] = bits.signed(pos[constant], 8)
    for n in range(longest):  # verbatim and warm-up samples
        f = np.flatnonzero((verbatim | (order > n))[: running[n]])
        if not f.size and not verbatim[: running[n]].any():
            break
        x[n, f] = bits.signed(pos[f] + 8 * n, 8)
    pos = pos + 8 * order
    precision, shift = np.zeros(n_frames, np.int64), np.zeros(n_frames, np.int64)
    weights = np.zeros((32, n_frames), np.int64)
    f = np.flatnonzero(lpc)
    precision[f], shift[f] = bits.read(pos[f], 4) + 1, bits.signed(pos[f] + 4, 5)
    pos[f] += 9
    for j in range(int(order[f].max(initial=0))):
        for width in np.unique(precision[f]).tolist():
            g = f[(order[f] > j) & (precision[f] == width)]
            weights[j, g] = bits.signed(pos[g], width)
            pos[g] += width
    rice = np.flatnonzero(fixed | lpc)
    method, parts = bits.read(pos[rice], 2), bits.read(pos[rice] + 2, 4)
    pos[rice] += 6
    if (method > 1).any() or ((size[rice] >> parts) << parts != size[rice]).any():
        raise Corrupt("unknown residual coding")
    wide = np.zeros(n_frames, np.int64)
    wide[rice] = 4 + method
    part = np.full(n_frames, 1 << 60)
    part[rice] = size[rice] >> parts
    simple = bool((parts == 0).all() and (method == 0).all())
    if simple:
        _plain_rice(bits, x, rice, running, pos, order)
    else:
        _rice_parts(bits, x, fixed | lpc, running, pos, order, part, wide)
    # predictors: fixed ones are repeated sums along the block, quantised ones run sample by sample over all frames at once
    for o in range(1, 5):
        f = np.flatnonzero(fixed & (order == o))
        if f.size:
            block = x[:, f]
            for level in range(o, 0, -1):  # the level-th differences of the warm-up samples start the sums
                warm = block[:o].copy() if level == o else warm
                start = np.diff(x[:o, f], n=level - 1, axis=0)[o - level] if level > 1 else x[o - 1, f]
                block[o - 1] = start
                block[o - 1 :] = np.cumsum(block[o - 1 :], axis=0)
            block[:o] = x[:o, f]
            x[:, f] = block
    f = np.flatnonzero(lpc)
    if f.size:
        w, top = weights[:, f], int(order[f].max())
        for n in range(1, longest):
            total = np.zeros(f.size, np.int64)
            for j in range(min(top, n)):
                total += w[j] * x[n - 1 - j, f]
            x[n, f] = np.where(order[f] <= n, x[n, f] + (total >> np.maximum(shift[f], 0)), x[n, f])
    back = np.empty(n_frames, np.int64)
    back[order_by] = np.arange(n_frames)
    columns = x.T[back].astype(np.int8)
    return [row[:n] for row, n in zip(columns, size[back].tolist(), strict=True)]


def payload_of(text: str) -> bytes:
    raw = text.encode()
    return raw + bytes(max(PAD, -(-len(raw) // PAD) * PAD) - len(raw))


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): the whole text, UTF-8, zero-padded to a positive multiple of 64 bytes, as a FLAC stream of byte - 128.

    A null text is empty: 64 zero bytes. One map, no shuffle.
    """

    def make():
        return lambda texts: {"n_bytes": [len(t.encode()) for t in texts], "media": encode([payload_of(t) for t in texts])}

    return map_texts(docs, make, "n_bytes bigint, media binary", id_col, text_col)


class Heard:
    """What is told of a stream, gathered block by block: digest and last bytes of the payload, level, peak, zero crossings and mean step."""

    def __init__(self):
        self.sha, self.tail, self.bytes, self.blocks = hashlib.sha256(), b"", 0, 0
        self.energy = self.peak = self.crossings = self.steps = 0
        self.last: int | None = None

    def add(self, samples: np.ndarray) -> None:
        raw = (samples.view(np.uint8) ^ np.uint8(0x80)).tobytes()
        self.sha.update(raw)
        self.tail = (self.tail + raw)[-PAD:]
        self.bytes += len(raw)
        self.blocks += 1
        x = samples.astype(np.int64)
        self.energy += int((x * x).sum())
        self.peak = max(self.peak, int(np.abs(x).max()))
        if self.last is not None:
            x = np.concatenate([[self.last], x])
        self.crossings += int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
        self.steps += int(np.abs(np.diff(x)).sum())
        self.last = int(x[-1])

    def feature(self) -> str:
        return f"energy={self.energy};peak={self.peak};crossings={self.crossings};steps={self.steps}"


def _batches(frames, make_rows):
    for batch in frames:
        media = batch.column(batch.schema.get_field_index("media"))
        for a, b in ranges(pc.binary_length(media).to_pylist(), _CHUNK):
            yield from make_rows(batch.slice(a, b - a), media.slice(a, b - a).to_pylist())
    give_back()


def read_back(stored: DataFrame) -> DataFrame:
    """`stored` with payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature and n_blocks in place of media, all from the PCM blocks of the stored bytes."""
    others = [c for c in stored.columns if c != "media"]
    added = "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, n_blocks bigint"
    schema = StructType([*(stored.schema[c] for c in others), *StructType.fromDDL(added).fields])

    def run(frames):
        def rows(batch: pa.RecordBatch, media: list[bytes]) -> Iterator[pa.RecordBatch]:
            heard = [Heard() for _ in media]
            for i, _, samples in pcm(media):
                heard[i].add(samples)
            cols = {c: batch.column(batch.schema.get_field_index(c)) for c in others}
            cols |= {
                "payload_bytes": pa.array([h.bytes for h in heard], pa.int64()),
                "payload_sha256": pa.array([h.sha.hexdigest() for h in heard]),
                "tail_crc32": pa.array([zlib.crc32(h.tail) for h in heard], pa.int64()),
                "media_bytes": pa.array([len(m) for m in media], pa.int64()),
                "media_sha256": pa.array([hashlib.sha256(m).hexdigest() for m in media]),
                "feature": pa.array([h.feature() for h in heard]),
                "n_blocks": pa.array([h.blocks for h in heard], pa.int64()),
            }
            yield pa.RecordBatch.from_pydict(cols)

        return _batches(frames, rows)

    return stored.mapInArrow(run, schema)


def pcm_blocks(stored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, sample_offset, pcm): the decoded PCM blocks, one row for each frame, so that a reader seeks by sample offset."""
    schema = StructType([stored.schema[id_col], *StructType.fromDDL("sample_offset bigint, pcm binary").fields])

    def run(frames):
        def rows(batch: pa.RecordBatch, media: list[bytes]) -> Iterator[pa.RecordBatch]:
            ids, blocks = batch.column(batch.schema.get_field_index(id_col)), pcm(media)
            while part := list(islice(blocks, 256)):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array([i for i, _, _ in part])), pa.array([o for _, o, _ in part], pa.int64()), pa.array([s.tobytes() for _, _, s in part], pa.binary())], [id_col, "sample_offset", "pcm"])

        return _batches(frames, rows)

    return stored.select(name(id_col), "media").mapInArrow(run, schema)
