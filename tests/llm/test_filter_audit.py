"""The filter audit against running every order, filter by filter."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from tests.llm.test_documents import words
from tramline.llm import filter_audit as A
from tramline.llm import queries


def fails(text, repeated):
    w = re.findall(r"[^ \t-\r]+", text)
    return {
        "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
        "D": re.search(r"[#$%&*|]", text) is not None, "E": repeated,
    }


def plain(docs, labels):
    """Rows of the audit by running every order over (doc_id, text, source)."""
    docs = [(i, t or "", s or "") for i, t, s in docs]
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t] = min(i, least.get(t, i))
    marks = [(s, fails(t, i is not None and least[t] < i), i in labels[0], i in labels[1]) for i, t, s in docs]
    out = {}
    for part in {s for s, *_ in marks}:
        own = [m for m in marks if m[0] == part]
        total = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone, left = [m for m in left if m[1][f]], [m for m in left if not m[1][f]]
                total[f] += len(gone)
                failing = [m for m in own if m[1][f]]
                out[part, order, step] = [len(left), len(gone), len(failing) - len(gone), sum(sum(m[1].values()) == 1 for m in failing), sum(m[2] for m in gone), sum(m[3] for m in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def got(df):
    rows = df.collect()
    out = {(r.part, r.filter_order, r.step): tuple(r[m] for m in A.MEASURES) for r in rows}
    assert len(out) == len(rows)
    return out


def table():
    rng = random.Random(12)
    base = [words(rng, n) for n in (5, 150, 199, 200, 201, 400, 800)]
    texts = [None, "", " \n", *base, base[3], base[3], base[5].upper(), base[5] + " #", base[4] + " A" * 20, "Ab " * 250, "wörter und\x1c " * 300, "x y " * 200]
    rows = [(i, t, [None, "", "a", "b", "a'|"][rng.randrange(5)]) for i, t in enumerate(rng.choices(texts, k=150))]
    return [*rows, rows[4], rows[4], rows[-1], (None, base[3], "a"), (None, base[3], "a"), (None, None, None)]


@pytest.mark.parametrize("parts", [1, 5])
def test_every_order(spark, parts):
    rows = table()
    # further columns with names that the operator uses
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, source string, pattern int, good int, part int").repartition(parts)
    labels = spark.createDataFrame([(i, int(i % 3 == 0), int(i % 7 == 0)) for i in range(0, 120)] + [(3, 0, 1), (3, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    want = plain(rows, ({i for i in range(120) if i % 3 == 0}, {i for i in range(120) if i % 7 == 0} | {3}))
    assert got(A.audit(docs, labels)) == want


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert A.audit(docs, labels).collect() == []
    some = spark.createDataFrame([(1, "a b", "s")], docs.schema)
    assert got(A.audit(some, labels)) == plain([(1, "a b", "s")], (set(), set()))


def test_table_of_first_failures():
    t = A.first_failure()
    assert t.shape == (32, 120) and (t[0] == 5).all() and (t[31] == 0).all()
    for pattern in range(32):
        for k, order in enumerate(A.orders()):
            assert t[pattern, k] == next((i for i, f in enumerate(order) if pattern >> "ABCDE".index(f) & 1), 5)


def test_long_texts_by_ranges():
    text = ("wort " * 50 + "Other é# ") * 40_000
    assert A.pattern_of(text.encode()) == 0b1010 and A.pattern_of(b"x" * 9_000_000) == 1
    assert A.pattern_of((" ".join(map(str, range(400_000)))).encode()) == 0


def test_many_parts_are_held_in_turn(spark, monkeypatch):
    monkeypatch.setattr(A, "HELD_PARTS", 2)
    rows = [(i, "a b", f"s{i % 9}") for i in range(40)]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert got(A.audit(spark.createDataFrame(rows, "doc_id long, text string, source string"), labels)) == plain(rows, (set(), set()))


def test_query(spark, sf_dir):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    marks = {r.doc_id for r in labels if r.quality == 1}, {r.doc_id for r in labels if r.toxic == 1}
    found = got(queries.op12_filter_audit(spark, sf_dir))
    assert found == plain(docs, marks) and len(found) == 600 * len({d[2] or "" for d in docs})
    by = defaultdict(int)
    for (part, order, _), row in found.items():
        by[part, order] += row[1]
    assert all(np.sign(v) >= 0 for v in by.values())
