"""Word BPE against the tokenizers library; the lexicon against its words."""

import hashlib
import random
import unicodedata

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.test_documents import words
from tramline.llm import queries
from tramline.llm import word_bpe as W

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def merges():
    with open(PATH, "rb") as f:
        return W.Merges(f.read())


def texts():
    rng = random.Random(11)
    bits = ["the", "Cat", "'s", "'", "don't", "I'LL", "12", "a1b", " ", "  ", "\n", "\t", " ", " ", "\x1c", "\0", "é", "é", "́", "Σ", "ΟΔΟΣ", "İ", "ß", "日本", "🎉", "<|endoftext|>", "<|startoftext|>", "<|end", "...", "$#", "Ᲊ", "\U000105c0", "한", "한", "\r\n"]
    out = [None, "", " ", "\n\n", "a", "x" * 3000, "ab" * 1500, *("".join(rng.choices(bits, k=rng.randint(1, 25))) for _ in range(800))]
    return out + [words(rng, 300) for _ in range(20)] + ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzé", k=4000)) for _ in range(5)]


def test_every_word_is_the_library_s(merges, library):
    for t in texts():
        got = [i for ws in W.word_lists((t or "").encode()) for w in ws for i in merges.word(w)]
        assert got == library.encode(t or "", add_special_tokens=False).ids, repr(t)


def test_code_points(merges, library):
    """Every code point between letters, and every composition of two."""
    for a in range(0, 0x110000, 0x800):
        chars = [chr(c) for c in range(a, a + 0x800, 7) if not 0xD800 <= c < 0xE000]
        text = " ".join(f"a{c}b {c}{c}" for c in chars)
        assert [i for w in text.encode().split() for i in merges.word(w)] == library.encode(text, add_special_tokens=False).ids, hex(a)
    pairs = [unicodedata.normalize("NFD", chr(c)) for c in range(0x110000) if unicodedata.decomposition(chr(c)) and "<" not in unicodedata.decomposition(chr(c))]
    text = " ".join(pairs)
    assert [i for w in text.encode().split() for i in merges.word(w)] == library.encode(text, add_special_tokens=False).ids


def test_long_and_short_merging_agree(merges):
    rng = random.Random(3)
    for k in range(300):
        piece = bytes(rng.choices(b"aabcdeinrst'-" if k % 2 else range(256), k=rng.randint(1, 200)))
        ids = W.array("i", map(merges.inner.__getitem__, piece))
        ids[-1] = merges.last[piece[-1]]
        assert merges._long(ids[:]) == merges._short(ids[:])


def lexicon(tmp_path, given):
    path = tmp_path / f"{len(given)}.bin"
    path.write_bytes(W.compiled({w: W.array("i", ids) for w, ids in given.items()}))
    return W.Lexicon(str(path))


def walked(lex, asked):
    data, sizes = np.frombuffer(b"".join(asked), np.uint8), np.array([len(w) for w in asked])
    held, out = lex.walk(data, np.cumsum(sizes) - sizes, sizes)
    return {w: [int(i) for o in out[k] for i in lex.pool[lex.starts[o] : lex.starts[o + 1]]] if held[k] else None for k, w in enumerate(asked)}


def test_lexicon_holds_just_its_words(tmp_path):
    rng = random.Random(6)
    given = {bytes(rng.choices(b"abc\xff\0", k=rng.randint(1, 9))): [rng.randrange(5) for _ in range(rng.randint(1, 4))] for _ in range(3000)}
    lex = lexicon(tmp_path, given)
    asked = [*given, *(bytes(rng.choices(b"abc\xff\0", k=rng.randint(1, 40))) for _ in range(5000))]
    assert walked(lex, asked) == {w: given.get(w) for w in asked}
    assert walked(lexicon(tmp_path, {}), [b"a", b"bc"]) == {b"a": None, b"bc": None}
    same = {b"aa": [7, 1], b"ab": [7, 2], b"b": [7]}
    assert walked(lexicon(tmp_path, same), [*same, b"", b"a"]) == {**same, b"": None, b"a": None}


def test_suffixes_are_shared(tmp_path):
    """Words of any beginning with the same rest and one id have their rest in common: as many states as the longest has bytes, with two more."""
    given = {bytes([97 + i]) + b"ation": [i + 10] for i in range(26)}
    assert len(lexicon(tmp_path, given).base) == 7
    # ids stand on arcs as early as words differ
    lex = lexicon(tmp_path, {b"xay": [1, 2], b"xby": [1, 3]})
    assert walked(lex, [b"xay", b"xby", b"xy"]) == {b"xay": [1, 2], b"xby": [1, 3], b"xy": None} and len(lex.base) == 4


@pytest.mark.parametrize("parts", [1, 4])
def test_encode_and_decode(spark, library, parts):
    rows = [(i, t, 1, "x", "y") for i, t in enumerate(texts())]
    rows += [rows[9], rows[9], (None, "a Cat's", 0, None, None), (None, None, 0, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, ids string, decoded string").repartition(parts)
    got = sorted(((r.doc_id, r.n_tokens, r.ids, r.decoded) for r in W.decode(W.encode(docs, PATH), PATH).collect()), key=repr)
    want = []
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), ids, library.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want, key=repr)
    empty = docs.where("false")
    assert W.decode(W.encode(empty, PATH), PATH).collect() == []


def test_frequent_words(spark):
    docs = spark.createDataFrame([("a b a\tc",), ("b\nz " + "w" * 40 + " " + "w" * 40,), (None,), ("",)], "text string")
    assert W.frequent(docs) == {b"a": 2, b"b": 2}


def test_one_long_word_in_bounded_memory(merges):
    import resource

    rng = random.Random(8)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    word = "".join(rng.choices("etaoinshrdlu", k=2_000_000)).encode()
    ids = merges.word(word)
    assert b"".join(merges.tokens[i].encode() for i in ids) == word + b"</w>"
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 150 * 1024


def test_query(spark, sf_dir, library):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = {}
    for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = library.encode(d.text or "", add_special_tokens=False).ids
        want[d.doc_id] = (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op11_word_bpe(spark, sf_dir).collect()} == want
