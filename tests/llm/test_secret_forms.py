"""Keys in the forms in which files hold them: each is found whole, and adverse texts take linear time."""

import base64
import random
import time

from tramline.llm import secret_scan as S

field = lambda b: len(b).to_bytes(4) + b
size = lambda n: bytes([n]) if n < 128 else b"\x81" + bytes([n]) if n < 256 else b"\x82" + n.to_bytes(2)
tlv = lambda tag, b: bytes([tag]) + size(len(b)) + b


def keys():
    rng = random.Random(61)
    rsa = lambda bits: tlv(0x30, tlv(2, b"\0") + b"".join(tlv(2, b"\1" + rng.randbytes(bits // 8 - 1)) for _ in range(8)))
    algorithm = tlv(0x30, tlv(6, bytes(9)) + tlv(5, b""))
    out = [("der", rsa(512)), ("der", rsa(1024)), ("der", tlv(0x30, tlv(2, b"\0") + algorithm + tlv(4, rsa(768))))]
    out += [("der", tlv(0x30, tlv(2, b"\0") + algorithm + tlv(4, tlv(4, rng.randbytes(n))))) for n in range(32, 96)]  # last lines of every length
    out += [("der", tlv(0x30, tlv(2, b"\1") + tlv(4, rng.randbytes(32)) + tlv(0xA0, tlv(6, bytes(5)))))]
    return out + [("openssh", b"openssh-key-v1\0" + field(b"none") * 2 + field(b"") + (1).to_bytes(4) + field(b"p" * 51) + field(rng.randbytes(n))) for n in (130, 137, 171)]


def wrapped(flat, width, end):
    return end.join(flat[i : i + width] for i in range(0, len(flat), width))


BASE64_FORMS = {
    "json": ("\\n", '"private_key": "-----BEGIN PRIVATE KEY-----\\n', '\\n-----END PRIVATE KEY-----\\n",'),
    "json, windows": ("\\r\\n", '{"k": "', '\\r\\n"}'),
    "tab": ("\n", 'x = "\\t', '"'),
    "quoted mail": ("\n> ", "> -----BEGIN-----\n> ", "\n> -----END-----"),
    "twice quoted": ("\n>> ", ">> ", "\n>> ok"),
    "indented": ("\n    ", "key: |\n    ", "\nnext: 1"),
    "comment": ("\n# ", "# ", "\ncode()"),
    "block comment": ("\n * ", "/*\n * ", "\n */"),
    "plain": ("\n", "key\n", "\nend"),
}


def found(text):
    return [s for s in S.scan(text) if s[2] in ("der", "openssh")]


def test_base64_forms():
    for kind, buf in keys():
        flat = base64.b64encode(buf).decode()
        for form, (end, before, after) in BASE64_FORMS.items():
            for width in (64, 76):
                key = wrapped(flat, width, end)
                assert found(before + key + after) == [(len(before), len(before) + len(key), kind)], (form, width, len(buf))


def test_hex_forms():
    for kind, buf in keys():
        if kind != "der":
            continue
        digits = buf.hex()
        pairs = [digits[i : i + 2] for i in range(0, len(digits), 2)]
        forms = {"lines": wrapped(digits, 64, "\n"), "colons": ":".join(pairs), "colons in lines": ":\n    ".join(":".join(pairs[i : i + 15]) for i in range(0, len(pairs), 15)), "upper": digits.upper(), "escaped": wrapped(digits, 60, "\\n")}
        for form, key in forms.items():
            assert found(f"x {key} y") == [(2, 2 + len(key), "der")], form
        for ahead in ("ff", "f", "0x30", "30820302"):
            text = f"z {ahead}{digits} y"
            assert found(text) == [(2 + len(ahead), 2 + len(ahead) + len(digits), "der")], ahead


def test_what_is_no_key():
    rng = random.Random(62)
    for _ in range(300):
        noise = rng.randbytes(rng.randint(20, 400))
        assert not found(noise.hex()) and not found(":".join(f"{b:02x}" for b in noise)) and not found(base64.b64encode(noise).decode())
    for _, buf in keys()[:3]:
        assert not found(buf[:-5].hex()) and not found(base64.b64encode(b"\x30\x03\x02\x01\x00" + bytes(60)).decode())


def test_adverse_texts_take_linear_time():
    head = "3082ffff020100"
    for unit in (head, "3003020100", "30:82:ff:ff:02:01:00:", "MIIB", "MII\\n", "b3BlbnNzaC1rZXktdjEA", "ab\n", "eyJ."):
        took = []
        for n in (200_000, 800_000):
            text = unit * (n // len(unit))
            start = time.perf_counter()
            S.scan(text)
            took.append(time.perf_counter() - start)
        assert took[1] < 10 and took[1] < 12 * max(took[0], 0.05), (unit, took)
