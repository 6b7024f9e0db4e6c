"""Secret scan with structural confirmation.

Pattern kinds (`assign`, `access`, `hex`) are reported as they match. Further kinds are reported only when the
bytes behind the candidate parse:

* `der`: base64 lines or hex digits that decode to one ASN.1 SEQUENCE, whose nested lengths all fit and whose
  leading fields are those of an RSA, EC or PKCS#8 private key; the key wrapped in the last is parsed in turn;
* `openssh`: base64 lines that decode to the OpenSSH key container with consistent length-prefixed fields;
* `jwt`: three dot-separated base64url parts whose first decodes to a JSON object with a string `alg` other than `none`,
  whose second decodes to a JSON object, and whose third, the signature, is not empty.

Base64, standard or URL-safe, is parsed from every place where a key can start, be it in a line or at its start, over
lines of any length, which may be quoted, indented or commented, and end really or by an escape, as in JSON; hex from any digit, over colons and lines. The lengths inside the key say where it ends, so prose in the lines around it doesn't matter. More
base64 in the last line of a DER key is none of it, and such a candidate doesn't count. A token starts where a run of its characters starts.

Only the headers that a candidate names are decoded, some dozens of bytes, and every run of token characters is tried once, so that time
is linear in the text, however long or adverse; memory is a few times the text.

Spans count code points, end exclusive. Null or empty text has no span, an empty table no row. Rows are independent: repeated rows and ties
give repeated results. Other columns are passed by, whatever their names.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable

from pyspark.sql import DataFrame

from .common import map_texts

KINDS = ("assign", "access", "hex", "der", "openssh", "jwt")
N_BASE = 3
_ASSIGN = re.compile(r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: A maximal run of 32 or more is the same match as `[0-9a-f]+` kept when it is that long.
_HEX = re.compile(r"[0-9a-f]{32,}")
#: Base64 of a SEQUENCE header with a length of up to 4 bytes, and of the OpenSSH magic.
_START = re.compile(r"M[A-I]|b3BlbnNzaC1rZXktdjEA")
_BASE64 = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")
_LINE = re.compile(r"[A-Za-z0-9+/_-]+")
#: A line's end, real or as strings of code and JSON write it, with what quotes, comments and indents put before the next line.
_END = r"[ \t]*(?:\r?\n|(?:\\r)?\\n)[ \t>#*|]*"
_BREAK = re.compile(_END)
#: The letters that end an escape.
_ESCAPED = ("\\n", "\\r", "\\t")
_TAIL = re.compile(r"[A-Za-z0-9+/]*")
_PADDING = re.compile(r"={0,2}")
_WRAPPED_PADDING = re.compile(_END + r"={1,2}(?!=)")
#: An EC key of the smallest named curve (112 bits) has 21 bytes.
_LEAST_DER = 21
#: Pairs of hex digits, with colons or line ends between them.
_HEX_ANY = re.compile(rf"[0-9A-Fa-f]{{2}}(?:(?::|:?{_END})?[0-9A-Fa-f]{{2}}){{20,}}[0-9A-Fa-f]?")
_HEX_DIGITS = re.compile(r"[0-9A-Fa-f]+")
#: A SEQUENCE header whose length has its shortest form, then an INTEGER of one byte: how all these keys begin, in digits of any parity.
_HEX_START = re.compile(r"(?=30(?:[0-7].|81..|82....|83.{6}|84.{8})0201)")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")
_INTEGER, _BITS, _OCTETS, _NULL, _OID, _SEQUENCE = 0x02, 0x03, 0x04, 0x05, 0x06, 0x30


#: Bytes n from a place on, as many as there are.
Reader = Callable[[int, int], bytes]
#: More fields than any of the standards gives a key's SEQUENCE (ten for RSA, five for PKCS#8, four for EC); a longer one is none.
MAX_FIELDS = 16


def der_header(read: Reader, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, content start, content end) of the element at `at`, if its length is well formed and fits."""
    head = read(at, min(6, end - at))
    if len(head) < 2:
        return None
    tag, first, body = head[0], head[1], at + 2
    if first < 0x80:
        n = first
    else:
        k = first & 0x7F
        if not 1 <= k <= 4 or 2 + k > len(head) or head[2] == 0:
            return None
        n, body = int.from_bytes(head[2 : 2 + k]), body + k
        if n < 0x80:
            return None  # not the shortest form
    return (tag, body, body + n) if body + n <= end else None


def der_children(read: Reader, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The elements that fill the bytes from `at` to `end` exactly."""
    out = []
    while at < end:
        head = der_header(read, at, end)
        if head is None or len(out) == MAX_FIELDS:
            return None
        out.append(head)
        at = head[2]
    return out


def _key_fields(read: Reader, at: int, end: int, wrapped: bool = False) -> bool:
    """Whether the bytes are one SEQUENCE of an RSA, EC or, unless `wrapped`, PKCS#8 private key."""
    head = der_header(read, at, end)
    if head is None or head[0] != _SEQUENCE or head[2] != end:
        return False
    fields = der_children(read, head[1], head[2])
    if not fields or len(fields) < 2 or fields[0][0] != _INTEGER or fields[0][2] - fields[0][1] != 1:
        return False
    tags = [f[0] for f in fields]
    if len(fields) >= 9 and all(t == _INTEGER for t in tags[:9]):  # version, modulus, exponents, primes
        return True
    if tags[1] == _OCTETS and all(t & 0xE0 == 0xA0 for t in tags[2:]):  # EC: version, key, tagged curve and point
        return all(der_children(read, a, b) is not None for _, a, b in fields[2:])
    if not wrapped and len(fields) >= 3 and tags[1] == _SEQUENCE and tags[2] == _OCTETS:  # PKCS#8: version, algorithm, wrapped key
        algorithm = der_children(read, fields[1][1], fields[1][2])
        if not algorithm or algorithm[0][0] != _OID:
            return False
        inner = der_header(read, fields[2][1], fields[2][2])
        if inner is None or inner[2] != fields[2][2]:
            return False
        # a number (DSA, DH), a string (the 25519 and 448 curves), or a key of its own
        return inner[0] in (_INTEGER, _OCTETS) or _key_fields(read, fields[2][1], fields[2][2], wrapped=True)
    return False


def is_private_key_der(buf: bytes) -> bool:
    return _key_fields(lambda at, n: buf[at : at + n], 0, len(buf))


def openssh_end(read: Reader, size: int) -> int | None:
    """Where the OpenSSH key container at the start of `size` bytes ends, if its fields fit."""
    magic = b"openssh-key-v1\0"
    if read(0, len(magic)) != magic:
        return None
    at = len(magic)

    def number() -> int | None:
        got = read(at, 4)
        return int.from_bytes(got) if len(got) == 4 else None

    for _ in range(3):  # cipher, key derivation, its options
        if (n := number()) is None:
            return None
        at += 4 + n
    keys = number()
    if keys is None or not 1 <= keys <= (size - at) // 4:  # each key has a length of its own
        return None
    at += 4
    for _ in range(keys + 1):  # public keys, then the private section
        if (n := number()) is None:
            return None
        at += 4 + n
    return at if at <= size else None


def is_openssh_key(buf: bytes) -> bool:
    return openssh_end(lambda at, n: buf[at : at + n], len(buf)) is not None


class Run:
    """Base64 characters from `start` on, over line breaks, until something else."""

    def __init__(self, text: str, start: int):
        parts, self.at, self.first, n, at = [], [], [], 0, start  # lines, their places in the text and in `chars`
        while m := _LINE.match(text, at):
            parts.append(m[0])
            self.at.append(at)
            self.first.append(n)
            n, self.end = n + len(m[0]), m.end()
            gap = _BREAK.match(text, self.end)
            if not gap:
                break
            at = gap.end()
        self.chars = "".join(parts).replace("-", "+").replace("_", "/")

    def index(self, place: int) -> int:
        k = bisect_right(self.at, place) - 1
        return self.first[k] + place - self.at[k]

    def after(self, index: int) -> int:
        """Place in the text right after the character before `index`."""
        k = bisect_left(self.first, index) - 1
        return self.at[k] + index - self.first[k]

    def reader(self, start: int) -> Reader:
        """Bytes of what stands from character `start` on; each read decodes just its own groups."""

        def read(at: int, n: int) -> bytes:
            group = at // 3
            raw = self.chars[start + 4 * group : start + 4 * ((at + n + 2) // 3)]
            raw = raw[: len(raw) - (len(raw) % 4 == 1)]
            return base64.b64decode(raw + "=" * (-len(raw) % 4))[at - 3 * group : at - 3 * group + n] if n > 0 else b""

        return read

    def size(self, start: int) -> int:
        return (len(self.chars) - start) * 3 // 4


def _padded(text: str, at: int, n: int) -> int:
    """End of the padding of `n` bytes at `at`, which may stand in a line of its own."""
    end = _PADDING.match(text, at).end()
    missing = -n % 3 - (end - at)
    m = _WRAPPED_PADDING.match(text, end) if missing > 0 else None
    return m.end() if m and m[0].count("=") == missing else end


def base64_keys(text: str) -> list[tuple[int, int, str]]:
    out, run, done = [], None, 0
    for m in _START.finditer(text):
        place = m.start()
        if place < done or place and text[place - 1] in _BASE64 and text[max(place - 2, 0) : place] not in _ESCAPED:
            continue
        if run is None or place >= run.end:
            run = Run(text, place)
        start = run.index(place)
        read, size = run.reader(start), run.size(start)
        if m[0][0] == "M":
            head = der_header(read, 0, size)
            if head is None or head[2] < _LEAST_DER or not _key_fields(read, 0, n := head[2]):
                continue
            kind, end = "der", run.after(start + (4 * n + 2) // 3)
            if text[end : end + 1] in _BASE64:
                continue
        else:
            n = openssh_end(read, size)
            if n is None:
                continue
            kind, end = "openssh", _TAIL.match(text, run.after(start + (4 * n + 2) // 3)).end()
        done = _padded(text, end, n)
        out.append((place, done, kind))
    return out


def hex_keys(text: str) -> list[tuple[int, int, str]]:
    """Keys in hex digits, wherever one begins among them; spans go from a key's first digit to its last."""
    out = []
    for run in _HEX_ANY.finditer(text):
        pieces = [(m.start(), m[0]) for m in _HEX_DIGITS.finditer(text, run.start(), run.end())]
        digits, first = "".join(d for _, d in pieces), [0]
        for _, d in pieces:
            first.append(first[-1] + len(d))
        place = lambda i: pieces[k := bisect_right(first, i) - 1][0] + i - first[k]  # noqa: B023, E731
        done = 0
        for m in _HEX_START.finditer(digits):
            at = m.start()
            if at < done:
                continue
            read = lambda a, n: bytes.fromhex(digits[at + 2 * a : at + 2 * min(a + n, (len(digits) - at) // 2)])  # noqa: B023, E731
            head = der_header(read, 0, (len(digits) - at) // 2)
            if head is None or head[2] < _LEAST_DER or not _key_fields(read, 0, head[2]):
                continue
            done = at + 2 * head[2]
            out.append((place(at), place(done - 1) + 1, "der"))
    return out


def _json_part(part: str) -> object:
    try:
        return json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (ValueError, binascii.Error, RecursionError):
        return None


def is_signed_token(text: str) -> bool:
    head, body, signature = text.split(".")
    got = _json_part(head)
    return bool(signature) and isinstance(got, dict) and isinstance(got.get("alg"), str) and got["alg"].lower() != "none" and isinstance(_json_part(body), dict)


def confirmed(text: str) -> list[tuple[int, int, str]]:
    return base64_keys(text) + hex_keys(text) + [(m.start(), m.end(), "jwt") for m in _JWT.finditer(text) if is_signed_token(m[0])]


def scan(text: str) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind), by start, then kind in the order of KINDS."""
    out = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    out += confirmed(text)
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array<struct<start_pos, end_pos, kind>>), one row per row of `docs`; the text is read whole and never leaves the task.

    A null text has an empty array. No shuffle: the scan is a single map over the input's partitions.
    """

    def make():
        def work(texts: list[str]) -> dict[str, list]:
            return {"spans": [[{"start_pos": a, "end_pos": b, "kind": k} for a, b, k in scan(t)] for t in texts]}

        return work

    return map_texts(docs, make, "spans array<struct<start_pos: bigint, end_pos: bigint, kind: string>>", id_col, text_col)
