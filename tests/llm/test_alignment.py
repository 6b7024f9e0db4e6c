"""Banded alignment against the plain table."""

import random
import time

import pytest

from tramline.llm import minhash_dedup as M


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@pytest.mark.parametrize("narrow", [1, 2, 5, 64])
def test_matches_are_those_of_the_plain_table(monkeypatch, narrow):
    monkeypatch.setattr(M, "NARROW", narrow)
    rng = random.Random(narrow)
    for k in range(1500):
        letters = "ab" if k % 3 == 0 else "abcdefgh" if k % 3 == 1 else [f"w{i}" for i in range(60)]
        a = [rng.choice(letters) for _ in range(rng.randint(0, 60))]
        b = list(a)
        for _ in range(rng.randint(0, 12)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 3)] = [rng.choice(letters) for _ in range(rng.randint(0, 4))]
        if k % 5 == 0:
            b = [rng.choice(letters) for _ in range(rng.randint(0, 60))]
        want = common(a, b)
        for need in {0, want, want + 1, max(want - 1, 0), M.needed(len(a), len(b))}:
            got = M.aligned(a, b, need)
            assert got == want if want >= need else got < need, (a, b, need)


def test_bands_of_everywhere(monkeypatch):
    """Shingles that stand at more than 64 places of the band."""
    rng = random.Random(3)
    for _ in range(30):
        a, b = ([rng.choice("aab") for _ in range(rng.randint(150, 300))] for _ in range(2))
        want = common(a, b)
        assert M.aligned(a, b, 0) == want == M.aligned(a, b, want) and M.aligned(a, b, want + 1) <= want


def test_near_copies_take_linear_time():
    took = []
    for n in (100_000, 400_000):
        a = list(range(n))
        b = [-1, *a[: n // 2], -2, -3, *a[n // 2 + 3 :], -4]
        start = time.perf_counter()
        assert M.aligned(a, b, M.needed(len(a), len(b))) == n - 3
        took.append(time.perf_counter() - start)
    assert took[1] < 10 * max(took[0], 0.02) and took[1] < 5
