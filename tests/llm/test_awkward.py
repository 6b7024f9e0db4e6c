"""Operators and pipeline stages on null, empty, tied, repeated, very long and oddly named input, by value; and the rules against plain statements of them."""

import base64
import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as P
from tests.llm.test_documents import classes, der, jwt, rsa_key, words
from tramline.llm import bpe, flac_media, license_scan, line_dedup, minhash_dedup, mixing, quality_rules, secret_scan, suffix_dedup, toxicity

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Columns by the names that operators use themselves.
EXTRA = ["kept_text", "n_lines", "n_dropped", "_t", "_id", "_source", "_copies", "_other", "other", "Page_Hash", "drop_lines", "key_", "prefix_", "times_", "copies_", "row_", "class_id", "a.b", "size", "score"]
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", *EXTRA]


def rows():
    rng = random.Random(14)
    base = [words(rng, 60) for _ in range(10)]
    shared = "a line on many pages"
    texts = [None, "", " ", "\n\n", "a", "x" * 3000, *base, *base[:3], *(b.replace("a", "aa", 1) for b in base[3:6]), "ab " * 300, "🎉 " * 30, "\0nul\0", *(f"{words(rng, 30)}\n{shared}\n{words(rng, 5)}" for _ in range(12))]
    out = [(i, t, "en", [None, "s1", "s2"][i % 3], None if t is None or i % 5 == 0 else len(t)) for i, t in enumerate(texts)]
    return out + [out[8], out[8], (None, base[0], None, None, 3), (None, None, None, "s1", None)]


@pytest.fixture(scope="module")
def docs(spark):
    plain = spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string, n_chars long")
    return plain.selectExpr("*", *[f"concat('{c}', coalesce(string(doc_id), 'null')) AS `{c}`" for c in EXTRA]).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def data(df):
    """Rows as plain tuples; the marks of each row must be its own."""
    assert df.columns == COLUMNS
    got = [tuple(r) for r in df.collect()]
    for r in got:
        assert list(r[5:]) == [c + ("null" if r[0] is None else str(r[0])) for c in EXTRA]
    return Counter(r[:5] for r in got)


def without_boilerplate(table):
    """Rows of (doc_id, text, lang, source, n_chars) without the lines on over 1 % and at least two of the different pages of a host."""
    pages, on = defaultdict(set), defaultdict(set)
    for _, t, _, s, _ in table:
        pages[s].add(t or "")
        for line in (t or "").split("\n"):
            if line.strip(" \t\n\x0b\x0c\r"):
                on[s, line].add(t or "")
    gone = {k for k, v in on.items() if len(v) >= 2 and len(v) > 0.01 * len(pages[k[0]])}
    out = []
    for i, t, lang, s, n in table:
        kept = "\n".join(x for x in (t or "").split("\n") if (s, x) not in gone)
        out.append((i, None if t is None else kept, lang, s, None if n is None else len(kept)))
    return out


def test_stage_toxicity(spark, docs, empty, sf_dir):
    model = toxicity.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = toxicity.scorer(model)
    assert data(P.drop_toxic(spark, docs, sf_dir)) == Counter(r for r in rows() if score([r[1] or ""])[0] < toxicity.THRESHOLD)
    assert data(P.drop_toxic(spark, empty, sf_dir)) == Counter()


def test_stage_line_dedup(spark, docs, empty):
    want = Counter(without_boilerplate(rows()))
    assert data(P.drop_lines(spark, docs, "")) == want and want != Counter(rows())
    assert data(P.drop_lines(spark, empty, "")) == Counter()


def test_stage_near_dedup(spark, docs, empty):
    texts = {i: t or "" for i, t, *_ in rows() if i is not None}
    wordless = {i for i, t in texts.items() if not t.split()}  # alike only if equal
    kept = set(classes({i: t for i, t in texts.items() if i not in wordless}).values())
    kept |= {min(j for j in wordless if texts[j] == texts[i]) for i in wordless}
    assert data(P.drop_near_duplicates(spark, docs, "")) == Counter(r for r in rows() if r[0] is None or r[0] in kept)
    assert data(P.drop_near_duplicates(spark, empty, "")) == Counter()


def test_stage_mixing(spark, docs, empty):
    copies = {(r.doc_id, r.source): r.copies for r in mixing.mix(docs).collect()}
    want = Counter()
    for r in rows():
        want[r] += copies[r[0], r[3]]
    assert data(P.mix_sources(spark, docs, "")) == +want and set(copies.values()) == {0, 1, 2}
    assert data(P.mix_sources(spark, empty, "")) == Counter()


def test_stage_bpe(spark, docs, empty):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist()), r.decoded_sha256) for r in P.tokenize(spark, docs, "").collect())
    assert got == Counter((i, tuple(library.encode_ordinary(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in rows())
    assert P.tokenize(spark, empty, "").count() == 0


def test_operators_by_value(docs):
    """Each row of a map stands for its own text; clashing columns don't matter."""
    table = rows()
    for df, fields in (
        (secret_scan.find_secrets(docs), lambda t: (len(secret_scan.scan(t)),)),
        (quality_rules.apply_rules(docs), lambda t: (len([w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]),)),
        (flac_media.read_back(flac_media.store(docs)).select("doc_id", "payload_sha256", "n_blocks"), lambda t: (hashlib.sha256(flac_media.payload_of(t)).hexdigest(), -(-len(flac_media.payload_of(t)) // flac_media.BLOCK))),
        (license_scan.scan_licenses(docs).select("doc_id", "n_words"), lambda t: (len(re.findall(rb"[0-9a-z\x80-\xff]+", t.encode().lower())),)),
        (mixing.mix(docs).select("doc_id", "size"), lambda t: (len([w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]),)),
    ):
        got = df.withColumn("spans", F.size("spans")) if "spans" in df.columns else df
        cut = Counter(tuple(r)[: 1 + len(fields(""))] for r in got.collect())
        assert cut == Counter((i, *fields(t or "")) for i, t, *_ in table)


def test_repeats_by_value(spark):
    """Op 3 on rows of unique ids with nulls, empty and tied texts."""
    table = {i: (t or "").encode() for i, t, *_ in rows() if i is not None}
    df = spark.createDataFrame([(i, t.decode() or None) for i, t in table.items()], "doc_id long, text string").repartition(3)
    want = suffix_dedup.brute_force(list(table.items()))
    assert {r.doc_id: (r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(df).collect()} == {i: (sum(b - a for a, b in w), len(w)) for i, w in want.items()}


def test_a_text_of_twenty_megabytes(spark):
    rng = random.Random(20)
    vocabulary = [words(rng, 1) for _ in range(20_000)]
    lines = [" ".join(rng.choices(vocabulary, k=40)) for _ in range(110_000)]
    text = "\n".join(lines)
    raw = text.encode()
    assert len(raw) > 20_000_000
    df = spark.createDataFrame([(1, text, "a"), (2, "short", "a")], "doc_id long, text string, source string")
    first = lambda d: {r.doc_id: r for r in d.collect()}[1]
    assert first(secret_scan.find_secrets(df)).spans == []
    q = first(quality_rules.apply_rules(df))
    assert (q.n_words, q.word_chars) == (40 * len(lines), len(text) - 40 * len(lines) + 1)
    m = first(flac_media.read_back(flac_media.store(df)))
    assert m.payload_sha256 == hashlib.sha256(flac_media.payload_of(text)).hexdigest() and m.n_blocks == -(-m.payload_bytes // flac_media.BLOCK)
    x = first(line_dedup.drop_boilerplate_lines(df))
    assert (x.n_lines, x.n_dropped, x.kept_text == text) == (len(lines), 0, True)
    b = first(bpe.decode(bpe.encode(df, PATH), PATH))
    assert bytes(b.decoded) == raw and len(b.ids) == len(b.offsets) == 4 * b.n_tokens
    assert first(license_scan.scan_licenses(df)).n_words >= 40 * len(lines)
    assert first(mixing.mix(df)).size == 40 * len(lines)
    assert {r.doc_id: r.class_id for r in minhash_dedup.near_duplicates(df).collect()} == {1: 1, 2: 2}
    assert 0 <= first(toxicity.score_texts(df, toxicity.Model(np.zeros(1 << toxicity.BUCKET_BITS, np.float32), -1.0))).score <= 1


def test_long_repeats(spark):
    rng = random.Random(21)
    part = "".join(rng.choices("abcdefgh ", k=3_000_000))
    df = spark.createDataFrame([(1, part), (2, "é" * 60 + part[1000:2_500_000] + "end")], "doc_id long, text string")
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(df).collect()}
    assert got[1].n_removed == 0 and bytes(got[2].kept) == ("é" * 60 + "end").encode()[-len(got[2].kept) :] and got[2].n_removed >= 2_499_000


# 1. secrets


def test_tokens_without_signature_or_algorithm():
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    kinds = lambda t: [k for *_, k in secret_scan.scan(t)]
    assert kinds(f"see {jwt()} here") == ["jwt"]
    assert kinds(f"{part({'alg': 'HS256'})}.{part({'sub': 1})}.") == [] and kinds(f"{part({'alg': 'none'})}.{part({'sub': 1})}.c2ln") == []


def test_wrapped_key_is_parsed():
    algorithm = der(0x30, der(6, bytes(7)) + der(5, b""))
    key = lambda inner: base64.b64encode(der(0x30, der(2, b"\0") + algorithm + der(4, inner))).decode()
    found = lambda t: [k for *_, k in secret_scan.scan(t)].count("der")
    assert found(key(rsa_key())) == 1 and found(key(der(4, bytes(32)))) == 1
    assert found(key(der(0x30, b"\2\5abc"))) == 0  # a header that fits around fields that don't
    assert found(key(rsa_key() + b"x")) == 0


def test_adverse_texts_take_linear_time():
    import time

    for unit in ("eyJ", "eyJa.", "b3BlbnNzaC1rZXktdjEA\n", "MIMQAAAA\n", "token   "):
        start = time.perf_counter()
        secret_scan.scan(unit * (1_000_000 // len(unit)))
        assert time.perf_counter() - start < 20


# 4. media


def test_checks_have_published_values():
    nine = np.frombuffer(b"123456789", np.uint8)
    one = lambda table, bits: int(flac_media.crcs(nine, np.array([0]), np.array([9]), table, bits)[0])
    assert (one(flac_media._CRC8, 8), one(flac_media._CRC16, 16)) == (0xF4, 0xFEE8)


def test_blocks_and_features(spark):
    rng = random.Random(4)
    texts = ["", words(rng, 900), "ab" * 4000, "é" * 700]
    stored = flac_media.store(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).cache()
    media = {r.doc_id: bytes(r.media) for r in stored.collect()}
    blocks = defaultdict(dict)
    for r in flac_media.pcm_blocks(stored).collect():
        blocks[r.doc_id][r.sample_offset] = bytes(r.pcm)
    for r in flac_media.read_back(stored).collect():
        payload = flac_media.payload_of(texts[r.doc_id])
        x = [b - 128 for b in payload]
        whole = b"".join(blocks[r.doc_id][o] for o in sorted(blocks[r.doc_id]))
        assert whole == bytes(v & 0xFF for v in x) and list(sorted(blocks[r.doc_id])) == list(range(0, len(payload), flac_media.BLOCK))
        assert r.feature == f"energy={sum(v * v for v in x)};peak={max(map(abs, x))};crossings={sum((a < 0) != (b < 0) for a, b in zip(x, x[1:]))};steps={sum(abs(b - a) for a, b in zip(x, x[1:]))}"
        assert (r.media_bytes, r.media_sha256, r.n_blocks, r.tail_crc32) == (len(media[r.doc_id]), hashlib.sha256(media[r.doc_id]).hexdigest(), len(blocks[r.doc_id]), zlib.crc32(payload[-64:]))
        at = rng.randrange(len(payload))
        offset, samples = flac_media.block_at(media[r.doc_id], at)
        assert samples[at - offset] == x[at]


def test_streams_longer_than_a_segment(monkeypatch):
    rng = random.Random(5)
    payloads = [bytes(rng.choices(range(90, 130), k=64 * rng.randint(1, 300))) for _ in range(6)]
    whole = flac_media.encode(payloads)
    monkeypatch.setattr(flac_media, "SEGMENT", 2 * flac_media.BLOCK)
    monkeypatch.setattr(flac_media, "_CHUNK", 3000)
    monkeypatch.setattr(flac_media, "MAX_POINTS", 3)
    cut = flac_media.encode(payloads)
    assert [len(c) - len(w) for c, w in zip(cut, whole)] == [4 * (-(-len(p) // (3 * flac_media.BLOCK)) - 1) for p in payloads]
    for streams in (whole, cut):
        assert [(s.view(np.uint8) ^ 0x80).tobytes() for s, _ in flac_media.decode(streams)] == payloads


# 6. toxicity


def plain_score(model, text):
    ws = re.findall(r"\w+", text.lower())
    if not ws:
        return 1 / (1 + math.exp(-model.bias))

    def of_word(w):
        padded, found = f"<{w}>", []
        for n in (3, 4, 5):
            for i in range(len(padded) - n + 1):
                h = n
                for ch in padded[i : i + n]:
                    h = (h ^ ord(ch)) * 0x9E3779B97F4A7C15 % 2**64
                    h ^= h >> 29
                found.append(float(model.weights[h >> (64 - toxicity.BUCKET_BITS)]))
        return sum(found) / max(len(found), 1)

    k = max(1, len(ws) // toxicity.WINDOW)
    edges = [i * len(ws) // k for i in range(k + 1)]
    gap = max(sum(of_word(w) for w in set(ws[a:b])) / max(b - a, toxicity.WINDOW) for a, b in zip(edges, edges[1:]))
    return 1 / (1 + math.exp(-(model.bias + gap)))


def test_scores_match_a_plain_scorer():
    rng = random.Random(6)
    model = toxicity.Model(np.random.default_rng(1).normal(0, 20, 1 << toxicity.BUCKET_BITS).astype(np.float32), -0.5)
    texts = ["", "a", "É ß x_1", *(words(rng, rng.randint(1, 150)) for _ in range(40))]
    assert toxicity.scorer(model)(texts) == pytest.approx([plain_score(model, t) for t in texts], abs=1e-6)


def test_training_rows_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_TOXIC", 5)
    monkeypatch.setattr(toxicity, "SAMPLE_CLEAN", 7)
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, toxic: seen.append((texts, toxic)))
    once = [(i, f"text {i}") for i in range(200)] + [(None, "x")]
    docs = spark.createDataFrame(once * 20 + [(3, "another"), (5, "z" * 30_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(200)] * 3 + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    toxicity.fit(docs, labels)
    (texts, toxic), = seen
    assert len(texts) <= 12 and len(set(texts)) == len(texts) and set(toxic) == {0, 1}


# 7. near duplicates


def test_split_groups_give_the_same_classes(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "SPLIT", 3)
    monkeypatch.setattr(minhash_dedup, "TOKEN_ROWS", 4)
    rng = random.Random(17)
    original, other = words(rng, 120), words(rng, 120)
    texts = {}
    for i in range(60):
        w = (original if i % 4 else other).split()
        for _ in range(rng.choice([0, 1, 2, 3])):
            w[rng.randrange(len(w))] = words(rng, 1)
        texts[i] = " ".join(w)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    assert {r.doc_id: r.class_id for r in minhash_dedup.near_duplicates(df).collect()} == classes(texts)


def test_pairs_across_components(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "TOKEN_ROWS", 2)
    rng = random.Random(18)
    table = [(rng.randint(0, 5), i, 100, rng.randint(0, 4), rng.randint(0, 12)) for i in range(80)]
    got = {(r.a, r.b) for r in minhash_dedup._across(spark.createDataFrame(table, "token long, id long, n int, c long, at int")).collect()}
    need = minhash_dedup.needed(100, 100)
    assert got == {(i, j) for t, i, _, c, p in table for u, j, _, d, q in table if i < j and t == u and c != d and max(p, q) <= 100 - need}


# 8. mixing


def test_many_sources_take_the_same(spark):
    rng = random.Random(19)
    table = [(i, words(rng, rng.randint(0, 12)), f"site {i % 37}" if i % 5 else None) for i in range(600)]
    sizes = mixing.checkpointed(mixing.sized(spark.createDataFrame(table, "doc_id long, text string, source string").repartition(5)))
    few, many = ({tuple(r) for r in mixing.thresholds(sizes, few=f)[0].collect()} for f in (True, False))
    assert few == many and len(few) == 38


# 9. licences


def as_pattern(template):
    out = ""
    for token in re.findall(r"\[\[|\]\]|\{\{\d+\}\}|[^\s\[\]{}]+", template):
        out += "(?:" if token == "[[" else ")?" if token == "]]" else f"(?:[^ ]+ ){{0,{token[2:-2]}}}" if token[0] == "{" else re.escape(token) + " "
    return re.compile(r"(?<![^ ])" + out)


def sample_of(rng, template):
    out, keep = [], [True]
    for token in re.findall(r"\[\[|\]\]|\{\{\d+\}\}|[^\s\[\]{}]+", template):
        if token == "[[":
            keep.append(keep[-1] and rng.random() < 0.5)
        elif token == "]]":
            keep.pop()
        elif keep[-1]:
            out += rng.choices(["acme", "inc", "2020", "the"], k=rng.randint(0, int(token[2:-2]))) if token[0] == "{" else [token]
    return out


def test_templates_match_a_plain_matcher():
    rng = random.Random(9)
    every = tuple((label, 0.4, phrase) for phrase, label in license_scan.BASE) + license_scan.TEMPLATES
    automaton = license_scan.compile_templates(every)
    patterns = [as_pattern(t) for *_, t in every]
    whole = 0
    for _ in range(150):
        ws = []
        for _ in range(rng.randint(1, 3)):
            k = rng.randrange(len(every))
            part = sample_of(rng, every[k][2])
            if rng.random() < 0.4:  # a word of the wording differs, is missing or is added
                at = rng.randrange(len(part))
                part[at : at + rng.choice([0, 1])] = rng.choice([[], ["other"], ["or"]])
            ws += [*part, *rng.choices(["the", "this", "license", "copyright"], k=rng.randint(0, 3))]
        text = " ".join(ws) + " "
        starts = [0, *(m.end() for m in re.finditer(" ", text))]
        want = sorted({(i, k) for i, at in enumerate(starts[:-1]) for k, p in enumerate(patterns) if p.match(text, at)})
        assert license_scan.places(automaton, [w.encode() for w in ws]) == want
        whole += sum(every[k][1] == license_scan.WHOLE for _, k in want)
    assert whole > 20


def test_a_changed_clause_is_no_whole_licence(spark):
    text = "MIT License\n\nCopyright (c) 2020 Someone\n\n" + license_scan._MIT.replace("[[including the next paragraph]]", "") + ".\n\n" + license_scan._AS_IS.replace("{{8}}", "THE AUTHORS OR COPYRIGHT HOLDERS")
    ids = ["SPDX-License-Identifier: GPL-3.0-or-later", "// SPDX-License-Identifier: BSD-3-Clause", "licensed under the Creative Commons Attribution 4.0 International License"]
    df = spark.createDataFrame(list(enumerate([text, text.replace("sublicense", "lease"), *ids])), "doc_id long, text string")
    got = license_scan.scan_licenses(df).orderBy("doc_id").collect()
    assert [r.labels for r in got] == ["mit", "mit", "gpl-3.0", "bsd-3-clause", "cc-by"]
    assert got[0].score == 1 and got[1].score < 1
