"""Operators on a single text of 20 MB: by value, in time and in memory."""

import hashlib
import random
import subprocess
import sys
import time
from array import array
from itertools import pairwise
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tramline.llm import common, line_dedup, toxicity


def test_a_long_page_loses_half_its_lines(spark):
    """Every second line stands on another page of the host too."""
    shared = [f"this line number {i} stands on two pages of the host" for i in range(190_000)]
    own = [f"this line number {i} stands on one page of the host" for i in range(190_000)]
    one = "\n".join(x for pair in zip(shared, own, strict=True) for x in pair)
    other = "\n".join(shared)
    assert len(one) > 20_000_000
    df = spark.createDataFrame([(1, one, "h"), (2, other, "h"), (3, "short", "h")], "doc_id long, text string, source string").cache()
    df.count()
    start = time.perf_counter()
    got = {r.doc_id: (r.n, r.d, r.k) for r in line_dedup.drop_boilerplate_lines(df).select("doc_id", F.col("n_lines").alias("n"), F.col("n_dropped").alias("d"), F.sha2("kept_text", 256).alias("k")).collect()}
    took = time.perf_counter() - start
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == {1: (380_000, 190_000, sha("\n".join(own))), 2: (190_000, 190_000, sha("")), 3: (1, 0, sha("short"))}
    assert took < 20, took


def test_a_word_summed_up_by_slices(monkeypatch):
    """A word longer than what is hashed at once weighs what it weighs in one piece, and isn't kept."""
    rng = np.random.default_rng(5)
    weights = rng.normal(0, 1, 1 << toxicity.BUCKET_BITS).astype(np.float32)
    words = ["a", "bc", "".join(rng.choice(list("abcdefé"), 5000)), "xyz" * 700, "end"]
    whole = toxicity.word_weights(words, weights)
    monkeypatch.setattr(toxicity, "LEARN_CHARS", 64)
    assert np.allclose(toxicity.word_weights(words, weights), whole, atol=1e-9)
    for n, text in enumerate(words):
        who, what = toxicity.grams_of([text])
        assert np.isclose(whole[n], weights[what].mean(), atol=1e-5)
    score = toxicity.scorer(toxicity.Model(weights, -1.0))
    first = score([" ".join(words)])
    assert score([" ".join(words)]) == first


def test_merging_by_places_is_merging_by_rank():
    """Random ranks, also such that a merge makes pairs of lower ranks, against a loop over all pairs."""
    rng = random.Random(12)
    for _ in range(300):
        names = list("abc")
        table = {}
        for r in rng.sample(range(60), 25):
            pair = rng.choice(names), rng.choice(names)
            if pair not in table:
                table[pair] = r
                names.append(pair[0] + pair[1] + str(r))
        number = {n: i for i, n in enumerate(names)}
        rank = {(number[x], number[y]): r for (x, y), r in table.items()}
        made = {r: number[x + y + str(r)] for (x, y), r in table.items()}
        given = [rng.randrange(3) for _ in range(rng.randint(1, 40))]
        want = list(given)
        while pairs := [(rank[p], i) for i, p in enumerate(pairwise(want)) if p in rank]:
            r, i = min(pairs)
            want[i : i + 2] = [made[r]]
        ids = array("i", given)
        first = np.array([rank.get(p, 99) for p in pairwise(given)] + [99], np.int32)
        assert common.merged(ids, first, 99, lambda i, j, _: rank.get((ids[i], ids[j])), made.__getitem__).tolist() == want


@pytest.mark.parametrize("kind", ["op6", "op10", "op11"])
def test_one_long_word_in_bounded_memory(kind):
    """A process of its own takes one word of 6 MB: below 60 bytes a byte beside its tables."""
    code = f"""
import resource, sys
import numpy as np, public_tokenizers as P
from tramline.llm import bpe, toxicity, word_bpe
peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
text = bytes(np.random.default_rng(1).choice(np.frombuffer(b"etaoinshrdlu", np.uint8), 6_000_000)).decode()
if {kind!r} == "op6":
    run = toxicity.scorer(toxicity.Model(np.ones(1 << toxicity.BUCKET_BITS, np.float32), 0.0)); work = lambda: run([text])
elif {kind!r} == "op10":
    run = bpe.Encoder(bpe.Vocabulary(open(P.path("byte_bpe_50k.tiktoken"), "rb").read())); work = lambda: run.encode([text])
else:
    run = word_bpe.Merges(open(P.path("word_bpe_49k.json"), "rb").read()); work = lambda: run.word(text.encode())
before = peak(); work(); print((peak() - before) * 1024 / len(text))
"""
    got = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=Path(__file__).resolve().parents[2], timeout=300)
    assert got.returncode == 0, got.stderr
    assert float(got.stdout.split()[-1]) < 60
