"""Fill-in-middle against a plain statement of its rule, byte for byte."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tramline.llm import fill_middle as M
from tramline.llm import queries


def plain(doc_id, text):
    text = text or ""
    h = [int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[i : i + 8], 16) for i in range(0, 32, 8)]
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(t in text for t in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 100:
        return n, "plain", None, None, text
    if h[3] % 100 < 50:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts():
    rng = random.Random(5)
    pieces = ["\n", "\n\n", "a", "é", "🎉", " ", "<", "P", ">", "<S", "M>", "\r\n", "line of words", "\0", "日本"]
    return [None, "", "\n", "a", "a\n", "<P>", "x<S>y", "<M", "<", "<P", "P>", *("".join(rng.choices(pieces, k=rng.randint(1, 30))) for _ in range(600)), "🎉é\n" * 5000]


@pytest.mark.parametrize("parts", [1, 4])
def test_rule_and_return(spark, parts):
    rows = [(i, t, "e", "o") for i, t in enumerate(texts())]
    rows += [rows[20], rows[20], (None, "a\nb\nc\n", None, None), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, output string").repartition(parts)
    back = M.restore(M.transform(docs))
    got = sorted((tuple(r) for r in back.collect()), key=repr)
    want = sorted(((i, *plain(i, t), t or "") for i, t, *_ in rows), key=repr)
    assert got == want and {r[2] for r in got} == {"plain", "psm", "spm"}
    assert back.schema.simpleString() == "struct<doc_id:bigint,n:bigint,form:string,prefix_chars:bigint,middle_chars:bigint,output:string,restored:string>"


def test_empty_table_and_other_columns(spark):
    docs = spark.createDataFrame([], "key string, body string, n long, output string")
    assert M.restore(M.transform(docs, id_col="key", text_col="body")).collect() == []
    one = spark.createDataFrame([("k", "a\nb", 3, "q")], docs.schema)
    form = M.Form("[p]", "[suf]", "[m]", seed="x")
    assert M.restore(M.transform(one, form, "key", "body"), form).first().restored == "a\nb"


def test_rate_and_shares(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("a\nb\n").alias("text"))
    form = M.Form(rate=30, suffix_first=0)
    got = {r.form: r["count"] for r in M.transform(docs, form).groupBy("form").count().collect()}
    assert set(got) == {"plain", "psm"} and 80 < got["psm"] < 160
    assert M.restore(M.transform(docs, form), form).where("restored <> 'a\nb\n'").isEmpty()


def test_marks_of_neighbours_are_none():
    offsets, data = np.array([0, 1, 1, 3]), np.frombuffer(b"<P>", np.uint8)
    assert len(M.found(data, offsets, b"<P>")[0]) == 0
    for broken in (b"x<P><S><M>", b"<P><S>", b"<P><S><M><M>", b"<M><P><S>"):
        with pytest.raises(ValueError, match="output"):
            M.rebuilt(np.frombuffer(broken, np.uint8), np.array([0, len(broken)]), np.array([False]), M.Form())


def test_long_text_in_bounded_memory():
    import tracemalloc

    text = "some words é\n" * 1_500_000
    data = np.frombuffer(text.encode(), np.uint8)
    tracemalloc.start()
    h = [np.array([x]) for x in (123_456_789, 987_654_321, 5, 60)]
    got = M.turned(data, np.array([0, len(data)]), h, M.Form())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(data) > 20_000_000 and peak < 16 * len(data) and got["n"][0].as_py() == 1_500_000


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = {d.doc_id: (*(x := plain(d.doc_id, d.text))[:4], sha(x[4]), sha(d.text or "")) for d in docs}
    got = {r.doc_id: (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) for r in queries.op13_fill_middle(spark, sf_dir).collect()}
    assert got == want
