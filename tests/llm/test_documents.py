"""Every operator on awkward tables, and against plain statements of its rule."""

import base64
import hashlib
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tramline.llm import bpe, flac_media, license_scan, line_dedup, minhash_dedup, mixing, quality_rules, queries, secret_scan, suffix_dedup, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, score string, kept_text string, size string, copies string"
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def words(rng, n):
    return " ".join("".join(rng.choices("abcdeé", k=rng.randint(1, 7))) for _ in range(n))


def awkward():
    rng = random.Random(4)
    base = [words(rng, 60) for _ in range(12)]
    long = "\n".join(words(rng, 40) for _ in range(400))
    texts = [None, "", " ", "\n\n", "a", "x" * 5000, long, long + " end", *base, *base[:4], *(b.replace("a", "aa", 1) for b in base[:6]), "ab " * 400, "🎉 " * 30, "\0nul\0"]
    rows = [(i, t, "en", [None, "s1", "s2", "s3"][i % 4], None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[8], rows[8], (None, base[0], None, None, 3)]
    return [(*r, "x", "y", "z", "1", "2") for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ids(df, n=1):
    return Counter(r[0] for r in df.select("doc_id").collect())


def all_ids():
    return Counter(r[0] for r in awkward())


def test_every_operator_keeps_every_row(docs, empty):
    model = toxicity.Model(np.zeros(1 << toxicity.BUCKET_BITS, np.float32), -1.0)
    for run in (
        secret_scan.find_secrets, quality_rules.apply_rules, suffix_dedup.remove_repeats, flac_media.store, line_dedup.drop_boilerplate_lines, lambda d: toxicity.score_texts(d, model), minhash_dedup.near_duplicates,
        mixing.mix, license_scan.scan_licenses, lambda d: bpe.decode(bpe.encode(d, PATH), PATH),
    ):
        assert ids(run(docs)) == all_ids()
        assert run(empty).count() == 0


# 1. secrets


def base_spans(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def der(tag, body):
    n = len(body)
    return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x82]) + n.to_bytes(2)) + body


def rsa_key():
    rng = random.Random(1)
    return der(0x30, der(2, b"\0") + b"".join(der(2, bytes([1]) + rng.randbytes(63)) for _ in range(8)))


def jwt():
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    return f"{part({'alg': 'HS256', 'typ': 'JWT'})}.{part({'sub': 'é'})}.c2lnbmF0dXJl"


def test_base_secrets_match_the_patterns(spark):
    rng = random.Random(2)
    parts = ["password", "PassWd", "secret", "token", "API_KEY", "apikey", "=", ":", " ", '"', "'", "abcd1234", "short", "AKIA", "ABCDEF012345", "0123456789abcdef", "é", "K", "ſecret", "\n", "ff"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(400)]
    for t in texts:
        assert secret_scan.joined([s for s in secret_scan.scan(t) if s[2] in secret_scan.KINDS[:3]]) == base_spans(t)
    got = {r.doc_id: r.base_sha256 for r in query_over(spark, "op1_secret_scan", texts).collect()}
    assert got == {i: hashlib.sha256(base_spans(t).encode()).hexdigest() for i, t in enumerate(texts)}


def test_confirmed_secrets():
    key = base64.b64encode(rsa_key()).decode()
    assert [s for s in secret_scan.scan(f"é key {key} end") if s[2] == "der"] == [(6, 6 + len(key), "der")]
    assert any(k == "der" for *_, k in secret_scan.scan(rsa_key().hex()))
    cut = base64.b64encode(rsa_key()[:-3]).decode()
    assert not [s for s in secret_scan.scan(cut) if s[2] == "der"]
    assert [s[2] for s in secret_scan.scan(jwt())] == ["jwt"]
    assert not secret_scan.scan("eyJhbGciOjF9.eyJhbGciOjF9.x")
    field = lambda b: len(b).to_bytes(4) + b
    ssh = b"openssh-key-v1\0" + field(b"none") * 2 + field(b"") + (1).to_bytes(4) + field(b"p" * 40) + field(b"k" * 80)
    assert [s[2] for s in secret_scan.scan(base64.b64encode(ssh).decode())] == ["openssh"]


def test_wrapped_keys_in_prose():
    rng = random.Random(6)
    field = lambda b: len(b).to_bytes(4) + b
    size = lambda n: bytes([n]) if n < 128 else b"\x81" + bytes([n]) if n < 256 else b"\x82" + n.to_bytes(2)
    tlv = lambda tag, b: bytes([tag]) + size(len(b)) + b
    algorithm = tlv(0x30, tlv(6, bytes(7)))
    made = [("der", tlv(0x30, tlv(2, b"\0") + algorithm + tlv(4, tlv(4, rng.randbytes(n))))) for n in range(100, 250)]
    made += [("der", tlv(0x30, tlv(2, b"\1") + tlv(4, rng.randbytes(32))))]  # 39 bytes
    made += [("openssh", b"openssh-key-v1\0" + field(b"none") * 2 + field(b"") + (1).to_bytes(4) + field(b"p" * 51) + field(rng.randbytes(n))) for n in range(130, 190)]
    for kind, buf in made:
        for width in (64, 70):
            for encode in (base64.b64encode, base64.urlsafe_b64encode):
                for strip, newline in (("", "\n"), ("=", "\r\n")):
                    flat = encode(buf).decode().rstrip(strip)
                    key = newline.join(flat[i : i + width] for i in range(0, len(flat), width))
                    for before, after in (("here is my key" + newline, newline + "regards"), ("é key: ", " end"), ("-----BEGIN KEY-----" + newline, newline + "-----END KEY-----"), ("", "")):
                        found = [s for s in secret_scan.scan(before + key + after) if s[2] in ("der", "openssh")]
                        assert found == [(len(before), len(before) + len(key), kind)]


# 2. quality


def repeat_words(ws):
    seen = defaultdict(list)
    for i in range(len(ws) - 7):
        seen[tuple(ws[i : i + 8])].append(i)
    return len({j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 8)})


def test_quality_measures(docs):
    by = {}
    for r in quality_rules.apply_rules(docs).collect():
        by[r.doc_id] = r
    for doc_id, text, *_ in awkward():
        if doc_id is None:
            continue
        t, r = text or "", by[doc_id]
        ws = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
        lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), repeat_words(ws))
        assert r.base_failed == (len(ws) < 20 or 100 * r.n_repeat_words > 30 * len(ws)) and not (r.kept and r.base_failed)


# 3. repeated strings


def test_repeats_match_brute_force(spark):
    rng = random.Random(5)
    passages = ["".join(rng.choices("abc ", k=rng.randint(90, 260))) for _ in range(6)]
    piece = lambda: rng.choice(["x" * rng.randint(0, 300), "ab" * rng.randint(0, 150), rng.choice(passages), rng.choice(passages)[rng.randint(0, 50) :], "é" * rng.randint(0, 80), "".join(rng.choices("abcdefgh", k=rng.randint(0, 120)))])
    rows = [(i, "".join(piece() for _ in range(rng.randint(0, 5))) if i % 17 else None) for i in range(250)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    raw = {i: (t or "").encode() for i, t in rows}
    want = suffix_dedup.brute_force(list(raw.items()))
    for r in suffix_dedup.remove_repeats(df).collect():
        keep = np.ones(len(raw[r.doc_id]), bool)
        for a, b in want[r.doc_id]:
            keep[a:b] = False
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(keep), int((~keep).sum()), len(want[r.doc_id]))
        assert bytes(r.kept) == bytes(np.frombuffer(raw[r.doc_id], np.uint8)[keep])


@pytest.mark.parametrize("repeated", [False, True])
def test_repeats_stay_in_their_text(spark, repeated):
    rng = random.Random(8)
    fresh = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    passage, clean, other = fresh(500), fresh(900), fresh(700)
    key = 7 if repeated else None
    rows = [(-5, passage)] if repeated else []
    rows += [(key, passage + fresh(60)), (key, clean), (key, clean), (key, other + passage), (9, fresh(300)), (10, fresh(40) + clean[:200])]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    kept = [bytes(r.kept).decode() for r in got if r.doc_id == key]
    assert kept.count(clean) == 2  # not cut at the places of its neighbours, nor by its own copy
    assert sorted(r.n_removed for r in got if r.doc_id == key) == ([0, 0, 500, 500] if repeated else [0, 0, 0, 500])
    assert [(r.n_removed, r.n_bytes) for r in got if r.doc_id in (9, 10)].count((200, 240)) == 1


# 4. media


def test_flac_round_trip(docs):
    stored = flac_media.store(docs).cache()
    for r in stored.collect():
        (samples, offsets), = flac_media.decode([bytes(r.media)])
        payload = (samples.view(np.uint8) ^ 0x80).tobytes()
        assert len(payload) % 64 == 0 and len(payload) >= max(64, r.n_bytes) and not payload[r.n_bytes :].strip(b"\0") and list(offsets) == list(range(0, len(payload), flac_media.BLOCK))
    back = {r.doc_id: r for r in flac_media.read_back(stored).collect()}
    for doc_id, text, *_ in awkward():
        if doc_id is not None:
            p = flac_media.payload_of(text or "")
            assert (back[doc_id].payload_sha256, back[doc_id].tail_crc32) == (hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    blocks = flac_media.pcm_blocks(stored.where("doc_id = 6")).orderBy("sample_offset").collect()
    assert b"".join(bytes(b.pcm) for b in blocks)[:10] == bytes(x ^ 0x80 for x in flac_media.payload_of(awkward()[6][1])[:10])


def test_flac_kinds_and_checks():
    rng = random.Random(1)
    payloads = [bytes(64), bytes(rng.choices(range(256), k=4096)), bytes(int(128 + 60 * np.sin(i / 9)) for i in range(3200)), bytes((i // 20) % 256 for i in range(6400)), bytes([200] * 1024 + [3] * 64)]
    streams = flac_media.encode(payloads)
    assert [(s.view(np.uint8) ^ 0x80).tobytes() for s, _ in flac_media.decode(streams)] == payloads
    assert len(streams[2]) < 0.5 * len(payloads[2])
    for place in (20, len(streams[2]) - 30, len(streams[2]) - 400):
        bad = bytearray(streams[2])
        bad[place] ^= 1
        with pytest.raises((flac_media.Corrupt, IndexError)):
            flac_media.decode([bytes(bad)])


def test_flac_reads_linear_prediction_and_partitions():
    """A stream written bit by bit: order-2 LPC, two partitions, the second escaped to plain numbers."""
    x = [3, 5, 8, 12, 15, 19, 22, 26, 30, 33, 37, 40, 44, 48, 51, 55]
    coefficients, shift, precision = [7, -3], 2, 5
    residual = [x[n] - ((coefficients[0] * x[n - 1] + coefficients[1] * x[n - 2]) >> shift) for n in range(2, 16)]
    bits = ""
    put = lambda v, n: format(v & ((1 << n) - 1), f"0{n}b")
    bits += "0" + put(32 + 1, 6) + "0" + put(x[0], 8) + put(x[1], 8) + put(precision - 1, 4) + put(shift, 5) + "".join(put(c, precision) for c in coefficients)
    bits += put(0, 2) + put(1, 4) + put(2, 4)
    for r in residual[:6]:
        z = 2 * r if r >= 0 else -2 * r - 1
        bits += "0" * (z >> 2) + "1" + put(z, 2)
    bits += put(15, 4) + put(8, 5) + "".join(put(r, 8) for r in residual[6:])
    bits += "0" * (-len(bits) % 8)
    crc = lambda data, table, n: int(flac_media.crcs(np.frombuffer(data, np.uint8), np.array([0]), np.array([len(data)]), table, n)[0])
    head = flac_media.frame_header(0, 16)
    frame = head + bytes([crc(head, flac_media._CRC8, 8)]) + int(bits, 2).to_bytes(len(bits) // 8)
    frame += crc(frame, flac_media._CRC16, 16).to_bytes(2)
    info = (16).to_bytes(2) * 2 + bytes(6) + ((8000 << 44) | (7 << 36) | 16).to_bytes(8) + hashlib.md5(bytes(x)).digest()
    seek = (0).to_bytes(8) + (0).to_bytes(8) + (16).to_bytes(2)
    stream = b"fLaC\0" + len(info).to_bytes(3) + info + b"\x83" + len(seek).to_bytes(3) + seek + frame
    assert flac_media.decode([stream])[0][0].tolist() == x


# 5. lines


def test_line_dedup(spark):
    shared, rows = "site menu", []
    for i in range(40):
        rows.append((i, f"line {i}\n{shared}\n \nline {i}" if i < 20 or i == 30 else f"line {i}", "a" if i < 30 else None))
    got = {r.doc_id: r for r in line_dedup.drop_boilerplate_lines(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[3].kept_text == "line 3\n \nline 3" and (got[3].n_lines, got[3].n_dropped) == (4, 1)
    assert got[30].kept_text == rows[30][1] and got[25].n_dropped == 0


def test_pipeline_drops_rare_lines_of_large_hosts(spark):
    import corpus_pipeline as P

    share = lambda i: [f"on {k} %" for k in (1, 2, 4) if i % 300 < 3 * k + 1]
    rows = [(i, "\n".join([f"page {i}", *share(i), *(["on three pages"] if i < 3 else [])]), "a") for i in range(300)]
    rows += [(1000 + i, "copied line\nits page", "a") for i in range(20)]
    rows += [(2000 + i, f"own {i}\nsmall", "b") for i in range(4)] + [(3000 + i, f"own {i}\nsmall", None) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.text for r in P.drop_lines(spark, docs, "").collect()}
    assert got[0] == "page 0\non three pages" and [got[i] for i in (3, 5, 12, 13)] == ["page 3", "page 5", "page 12", "page 13"]
    assert got[1000] == got[1019] == "copied line\nits page"  # twenty copies are one page
    assert got[2000] == "own 0" and got[3000] == "own 0"  # on all pages of a host, few as they are


# 6. toxicity


def test_toxicity_learns_subwords():
    rng = random.Random(3)
    speech = lambda n: " ".join("".join(rng.choices(["the", "ing", "on", "er", "and", "st", "re", "ou"], k=rng.randint(1, 4))) for _ in range(n))
    clean = [speech(rng.randint(10, 200)) for _ in range(300)]
    bad = []
    for _ in range(200):
        ws = speech(rng.randint(10, 200)).split()
        for _ in range(1 + len(ws) // 50):
            ws.insert(rng.randrange(len(ws)), rng.choice(["zorgling", "quxmoron", "vilestuff"]))
        bad.append(" ".join(ws))
    score = toxicity.scorer(toxicity.train(clean[:200] + bad[:120], [0] * 200 + [1] * 120))
    s = np.array(score(clean[200:] + bad[120:]))
    assert (s[100:] >= 0.3).mean() >= 0.9 and (s[:100] < 0.3).mean() >= 0.95
    assert score(["the ing vilestufff on"])[0] > score(["the ing thest on"])[0]
    assert all(0 <= x <= 1 for x in score(["", "zorgling", "x" * 100_000]))


def test_toxicity_without_labels(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    assert toxicity.score_texts(docs, model).where("score > 0.01").isEmpty() and ids(toxicity.drop_toxic(docs, model)) == all_ids()


# 7. near duplicates


def classes(texts):
    parent = {i: i for i in texts}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sh = {i: minhash_dedup.shingles_of(t) for i, t in texts.items()}
    for i in texts:
        for j in texts:
            if i < j and (texts[i] == texts[j] or minhash_dedup.distance(sh[i], sh[j]) is not None):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in texts}


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_alignment():
    rng = random.Random(6)
    for _ in range(400):
        a = [rng.randint(0, 6) for _ in range(rng.randint(0, 40))]
        b = [x for x in a if rng.random() < 0.9] if rng.random() < 0.7 else [rng.randint(0, 6) for _ in range(rng.randint(0, 40))]
        full, need = lcs(a, b), minhash_dedup.needed(len(a), len(b))
        d = minhash_dedup.distance(a, b)
        assert d == (len(a) + len(b) - 2 * full if full >= need else None)


def test_near_duplicates_match_all_pairs(spark):
    rng = random.Random(7)
    texts = {}
    for i in range(120):
        kind = rng.random()
        if i < 30 or kind < 0.2:
            texts[i] = words(rng, rng.randint(0, 150))
        else:
            w = texts[rng.randrange(i)].split()
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                if w:
                    w[rng.randrange(len(w))] = words(rng, 1)
            texts[i] = " ".join(w)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    assert {r.doc_id: r.class_id for r in minhash_dedup.near_duplicates(df).collect()} == classes(texts)
    assert {r.doc_id for r in minhash_dedup.keep_first(df).collect()} == set(classes(texts).values())


# 8. mixing


def test_mixing(spark):
    rng = random.Random(8)
    rows = [(i, words(rng, rng.randint(0, 30)), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(900)] + [(1000, "", "void")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, free = {}, set(order)
    while True:
        left = 1.5 * sum(sizes.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            target |= share
            break
        target |= {s: 2 * sizes[s] for s in over}
        free -= over
    taken = Counter()
    for r in got:
        taken[r.source] += r.size * r.copies
        assert 0 <= r.copies <= 2 and r.target == pytest.approx(target[r.source])
    for s in order:
        assert abs(taken[s] - target[s]) <= 30
    again = mixing.mix(spark.createDataFrame(rows[::-1], "doc_id long, text string, source string")).collect()
    assert {(r.doc_id, r.copies) for r in again} == {(r.doc_id, r.copies) for r in got}
    total = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert ids(total) == Counter({r.doc_id: r.copies for r in got if r.copies})


# 9. licences


def test_licenses(spark):
    texts = ["All rights reserved", "the CC-BY cc by", "GNU General Public License, version 3", "general public\nlicense", "Released under the MIT License.", "released under the terms of the mit license", "released under mit license",
             "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0.", "copyright 2020 someone all rights reserved", "cc é by", None]
    got = [r.labels for r in license_scan.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == ["reserved", "cc-by", "gpl,gpl-3.0", "gpl", "mit", "mit", "", "apache-2.0", "cc-by,cc-by-nc", "copyright,reserved", "", ""]


def test_license_base_places(docs):
    rng = random.Random(9)
    for _ in range(200):
        ws = rng.choices([b"cc", b"by", b"general", b"public", b"license", b"all", b"rights", b"reserved", b"x"], k=rng.randint(0, 40))
        a = license_scan.compile_templates(tuple((label, 0.4, p) for p, label in license_scan.BASE))
        want = sorted((i, k) for k, (p, _) in enumerate(license_scan.BASE) for i in range(len(ws)) if ws[i : i + len(p.split())] == p.encode().split())
        assert license_scan.places(a, ws) == want


# 10. byte-level BPE


def test_bpe_matches_the_library(docs):
    raw = open(PATH, "rb").read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    vocabulary = bpe.Vocabulary(raw)
    encoder = bpe.Encoder(vocabulary)
    rng = random.Random(10)
    texts = ["".join(rng.choices(["a", "B", "'", "s", "ll", "re", "ve", "m", " ", "\n", "\t", "　", "1", "½", ".", "!", "é", "日", "🎉", "\r", "\0"], k=rng.randint(0, 30))) for _ in range(1500)]
    texts += [(r[1] or "") for r in awkward()] + ["y" * 20_000, "<|endoftext|>"]
    for text, packed in zip(texts, encoder.encode(texts), strict=True):
        got = np.frombuffer(packed, "<u4")
        assert got.tolist() == library.encode_ordinary(text)
        data, offsets = vocabulary.decode(got), vocabulary.places(got)
        assert data == text.encode() and all(data[o : o + len(vocabulary.tokens[t])] == vocabulary.tokens[t] for o, t in zip(offsets[:50], got[:50].tolist()))


# queries and the pipeline


def query_over(spark, name, texts):
    class Session:
        def __init__(self):
            self.read = self

        def parquet(self, _):
            return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    return queries.QUERIES[name](Session(), "")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    df = queries.QUERIES[name](spark, sf_dir)
    got = sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*sorted(df.columns)).collect())
    cur = con.execute(f"SELECT {', '.join(sorted(df.columns))} FROM ({queries.SQL[name]})")
    assert got == sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in cur.fetchall())


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as P

    raw = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    docs, seen = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in P.STAGES:
        docs = stage(spark, docs, sf_dir).cache()
        seen[name] = docs.collect()
        assert name == "bpe" or docs.columns == columns
    scores = {r.doc_id: r.predicted for r in queries.op6_toxicity(spark, sf_dir).collect()}
    assert {r.doc_id for r in seen["toxicity"]} == {i for i in raw if not scores[i]}
    assert len(seen["line_dedup"]) == len(seen["toxicity"])
    after_lines = {r.doc_id: r.text for r in seen["line_dedup"]}
    assert {r.doc_id for r in seen["near_dedup"]} == set(classes(after_lines).values())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}, special_tokens={})
    assert Counter(r.doc_id for r in seen["bpe"]) == Counter(r.doc_id for r in seen["mixing"])
    for r in seen["bpe"][:60]:
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(after_lines[r.doc_id])
    assert P.run(spark, sf_dir).count() == len(seen["bpe"])
