"""Near-duplicate classes by Order MinHash, verified by banded alignment.

Shingles are five words (white space separated), labelled by their occurrence number in the text. Each of `SKETCHES` sketches takes the
`SAMPLED` labelled shingles of least hash and keeps them in text order, so a sketch agrees with the probability that edits
spared those shingles and their order. Texts that agree in a sketch are candidates; a candidate pair is a link if a banded alignment of the two
shingle sequences matches L with L / (n + m - L) >= 0.8. Classes are the connected components of exact copies and links.

A pair at exactly 0.8 is missed by all sketches with a probability of about 4e-5.

Candidates without all pairs: exact copies collapse first; then each member of a bucket is aligned with the bucket's lead only, its most met
member. Members of a bucket that are in different components after that are searched again, without a cap, by exact prefix filtering over all
their shingles, which yields the pairs that can still be links. A large group of near copies links to its lead in the first step and costs as
many alignments as it has texts.

A lead of a large group, and a token of many texts, are dealt to several tasks.

Null text is empty; empty texts are exact copies of one another, and other texts without words are alike only if equal. Texts of under five words have one shingle, all their words. Rows that
share an id fall in one class; rows with a null id have a null class. Repeated rows and ties of the sketch give the same classes in any order of the input. Very long texts
are sketched and aligned whole. Empty tables give empty results; other columns are passed by, whatever their names. Only ids, hashes and the texts of candidates are shuffled.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, free, map_texts, name, text_slices

WORDS = 5
SAMPLED = 3
SKETCHES = 14
SIMILARITY = 0.8
#: Unmatched shingles that the first band allows.
NARROW = 64
#: Pairs of a lead, and rows of a token, that one task takes.
SPLIT, TOKEN_ROWS = 128, 1024
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = (np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) ^ np.uint64(0x2545F4914F6CDD1D)
_WIDE = 100_000


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def labelled_shingles(text: str) -> np.ndarray:
    """Hashes of (shingle, occurrence number), in text order."""
    words = text.encode().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    k = min(WORDS, len(w))
    n = len(w) - k + 1
    x = np.full(n, k, np.uint64)
    for j in range(k):
        x = _mixed(x + w[j : j + n] * _MIX + np.uint64(j))
    order = np.argsort(x, kind="stable")
    group = np.concatenate([[True], x[order][1:] != x[order][:-1]])
    first = np.maximum.accumulate(np.where(group, np.arange(n), 0))
    occurrence = np.empty(n, np.uint64)
    occurrence[order] = (np.arange(n) - first).astype(np.uint64)
    return _mixed(x + occurrence * np.uint64(0xBF58476D1CE4E5B9))


def sketches_of(text: str) -> list[int]:
    """SKETCHES hashes of the sampled shingles in text order; none for a text without words."""
    x = labelled_shingles(text)
    if not len(x):
        return []
    take = min(SAMPLED, len(x))
    out = []
    for a in range(0, SKETCHES, SKETCHES if len(x) < _WIDE else 1):
        seeds = _SEEDS[a : a + SKETCHES] if len(x) < _WIDE else _SEEDS[a : a + 1]
        h = _mixed(x[:, None] ^ seeds[None, :])
        at = np.sort(np.argpartition(h, take - 1, axis=0)[:take], axis=0)
        total = seeds.copy()
        for row in x[at]:
            total = _mixed(total * np.uint64(31) + row)
        out += total.view(np.int64).tolist()
    return out


def shingles_of(text: str) -> list[tuple[bytes, ...]]:
    words = text.encode().split()
    if len(words) <= WORDS:
        return [tuple(words)] if words else []
    return list(zip(*(words[j:] for j in range(WORDS))))


def needed(n: int, m: int) -> int:
    """Matches that make n and m shingles similar: the least L with L / (n + m - L) >= SIMILARITY."""
    least = int(SIMILARITY * (n + m) / (1 + SIMILARITY))
    while least < SIMILARITY * (n + m - least) - 1e-9:
        least += 1
    return least


def aligned(a: list, b: list, need: int) -> int:
    """Matches of the best alignment of a and b, if they are `need` or more; else some number below.

    Narrow bands first: where few shingles stay unmatched the best alignment lies in a band as narrow, and a band in which it fails is doubled, up to the one in which
    `need` matches are possible.
    """
    n, m = len(a), len(b)
    k = 0
    while k < min(n, m) and a[k] == b[k]:
        k += 1
    e = 0
    while e < min(n, m) - k and a[n - 1 - e] == b[m - 1 - e]:
        e += 1
    a, b, n, m, need = a[k : n - e], b[k : m - e], n - k - e, m - k - e, max(need - k - e, 0)
    if not n or not m or need > min(n, m):
        return k + e
    places: dict[object, list[int]] = {}
    for i, x in enumerate(a):
        places.setdefault(x, []).append(i)
    apart = max(NARROW, abs(n - m))
    while True:
        least = max(need, -(-(n + m - apart) // 2))  # matches that leave no more than `apart` unmatched
        got = _banded(places, b, n, m - least, n - least)
        if got >= least or least == need:
            return k + e + got
        apart *= 2


def _banded(places: dict[object, list[int]], b: list, n: int, low: int, high: int) -> int:
    """Matches of the best alignment whose matches lie at most `low` below and `high` above the diagonal.

    Bit-parallel: a bit for each place i of the first list is 0 where the best alignment of its first i + 1 shingles gains a match over that of the first i. Only the bits
    of the band are held: those below it are settled and counted when they leave it, those above haven't been touched.
    """
    width = low + high + 1
    full = (1 << width) - 1
    v, base, count = full, -low, 0  # the lowest bit stands for place `base`
    everywhere: dict[object, int] = {}
    for j, x in enumerate(b):
        p = places.get(x)
        if p is None:
            continue
        lo, hi = bisect_left(p, j - low), bisect_right(p, j + high)
        if lo == hi:
            continue
        gone = j - low - base
        if gone:
            count += min(gone, width) - (v & ((1 << min(gone, width)) - 1)).bit_count()
            v = v >> gone | full ^ full >> gone
            base += gone
        if hi - lo > 64:  # all places of a shingle that is everywhere, as bits of the whole list
            if x not in everywhere:
                everywhere[x] = int.from_bytes(np.packbits(np.bincount(p, minlength=n).astype(bool), bitorder="little").tobytes(), "little")
            hits = (everywhere[x] >> base if base > 0 else everywhere[x] << -base) & full
        else:
            hits = 0
            for i in p[lo:hi]:
                hits |= 1 << i - base
        u = v & hits
        if u:
            v = ((v + u) | (v - u)) & full
    return count + width - v.bit_count()


def distance(a: list, b: list) -> int | None:
    """Unmatched shingles of both, if they are similar; None if not."""
    n, m = len(a), len(b)
    need = needed(n, m)
    if min(n, m) < need or sum((Counter(a) & Counter(b)).values()) < need:
        return None
    got = aligned(a, b, need)
    return n + m - 2 * got if got >= need else None


def _verified(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(a, b), a < b, of those of `pairs` (lead, rep, met) that align; `met` is about how many pairs the lead has.

    The second text joins first, so that a shared first text is moved once for each partition of its pairs. A lead of more than SPLIT pairs is dealt
    to as many tasks as it has SPLITs, its text to each.
    """
    ids = pairs.select(F.explode(F.array("lead", "rep")).alias("_id")).distinct()
    texts = docs.select(name(id_col).alias("_id"), F.coalesce(name(text_col), F.lit("")).alias("_text")).join(ids, "_id", "left_semi")
    of_rep, of_lead = (texts.select(F.col("_id").alias(i), F.col("_text").alias(t)) for i, t in (("rep", "tb"), ("lead", "ta")))
    cold = pairs.where(F.col("met") <= SPLIT).join(of_rep, "rep").join(of_lead, "lead").select("lead", "rep", "ta", "tb")
    hot = pairs.where(F.col("met") > SPLIT).withColumn("part", F.pmod(F.xxhash64("rep"), F.ceil(F.col("met") / SPLIT)))
    if not hot.isEmpty():
        leads = hot.select("lead", "part").distinct().join(of_lead, "lead")
        cold = cold.union(hot.join(of_rep, "rep").join(leads, ["lead", "part"]).select("lead", "rep", "ta", "tb"))

    def run(batches):
        last: tuple[str | None, list] = (None, [])
        for batch in batches:
            keep = []
            ta, tb = batch.column(2), batch.column(3)
            for i in range(batch.num_rows):
                x, y = ta[i].as_py(), tb[i].as_py()
                if x != last[0]:
                    last = (x, shingles_of(x))
                keep.append(distance(last[1], shingles_of(y)) is not None)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["lead", "rep"])

    return cold.mapInArrow(run, cold.select("lead", "rep").schema).select(F.least("lead", "rep").alias("a"), F.greatest("lead", "rep").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, label): the least id of the component of every id in links(a, b), by label propagation with pointer jumping.

    Each round keeps one checkpointed row for each id; rounds grow with the logarithm of the longest chain.
    """
    edges = checkpointed(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct())
    labels = checkpointed(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        best = edges.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        step = labels.join(best, "id").select("id", "label", F.least("label", "near").alias("to"))
        jump = labels.select(F.col("id").alias("to"), F.col("label").alias("beyond"))
        moved = checkpointed(step.join(jump, "to", "left").select("id", F.least("to", F.coalesce("beyond", "to")).alias("label"), (F.least("to", F.coalesce("beyond", "to")) < F.col("label")).alias("changed")))
        labels = moved.select("id", "label")
        if moved.where("changed").isEmpty():
            return labels


def sketched(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, sketch) of every row: what candidate search needs of a text, in one map."""

    def make():
        def work(texts: list[str]) -> dict[str, list]:
            return {"digest": [hashlib.md5(t.encode()).digest() for t in texts], "sketch": [sketches_of(t) for t in texts]}

        return work

    return map_texts(docs, make, "digest binary, sketch array<bigint>", id_col, text_col)


def _plausible(members: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Pairs (a, b) of members (id, c) with different c that could be similar by exact prefix filtering.

    Shingles are ordered from rare to common. Two texts of n and m shingles that share `needed` of them share one among the first
    n - needed + 1 of the one and the first m - needed + 1 of the other. A text whose own edits already fill that prefix has no partner, so the
    pairs of a large group of unlike variants are not formed.
    """

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for i, texts in text_slices(batch.column(1)):
                hashed = [labelled_shingles(t) for t in texts]
                n = np.array([len(x) for x in hashed])
                rows = np.repeat(np.arange(i, i + len(texts)), n)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), pa.array(np.concatenate(hashed).view(np.int64)), pa.array(np.repeat(n, n), pa.int32())], ["id", "token", "n"])

    kind = members.schema["id"].dataType.simpleString()
    texts = docs.select(name(id_col).alias("id"), F.coalesce(name(text_col), F.lit("")).alias("text")).join(members.select("id"), "id", "left_semi")
    tokens = checkpointed(texts.mapInArrow(run, f"id {kind}, token bigint, n int").distinct())
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") > 1)
    known = tokens.join(shared, "token").join(members, "id")
    by_id = Window.partitionBy("id")
    place = F.col("n") - F.count(F.lit(1)).over(by_id) + F.row_number().over(by_id.orderBy("df", "token")) - 1  # tokens of no other text come first
    prefix = known.withColumn("at", place).where(F.col("at") <= F.col("n") * (1 - SIMILARITY) + 1e-9).select("token", "id", "n", "c", "at")
    return _across(prefix)


def _across(prefix: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of rows (token, id, n, c, at) that share a token, lie in different components and could still be similar.

    A token of one component makes no pair. Of the others, rows outside the token's largest component meet the rows of all; so what is joined is at most about
    twice the pairs of different components. A token of many rows is dealt to a task for each TOKEN_ROWS of them.
    """
    sizes = prefix.groupBy("token", "c").agg(F.count(F.lit(1)).alias("k"))
    tokens = sizes.groupBy("token").agg(F.max_by("c", F.struct("k", "c")).alias("major"), F.sum("k").alias("rows"), F.count(F.lit(1)).alias("comps")).where(F.col("comps") > 1)
    shared = prefix.join(tokens, "token").withColumn("parts", F.ceil(F.col("rows") / TOKEN_ROWS).cast("int"))
    x = shared.where(F.col("c") != F.col("major")).select("token", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), *(F.col(c).alias(c + "1") for c in ("id", "n", "c", "at")))
    y = shared.select("token", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), *(F.col(c).alias(c + "2") for c in ("id", "n", "c", "at")))
    need = F.ceil(SIMILARITY * (F.col("n1") + F.col("n2")) / (1 + SIMILARITY) - 1e-9)
    fits = (F.col("c1") != F.col("c2")) & (F.col("at1") <= F.col("n1") - need) & (F.col("at2") <= F.col("n2") - need)
    return x.join(y, ["token", "part"]).where(fits).select(F.least("id1", "id2").alias("a"), F.greatest("id1", "id2").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class_id), one row per row of `docs`: the least id of its class, its own if nothing is like it."""
    rows = checkpointed(sketched(docs, id_col, text_col).withColumnRenamed(id_col, "id"))
    known = rows.where(F.col("id").isNotNull())
    # one row for each distinct text, under its least id
    texts = known.groupBy("digest").agg(F.min("id").alias("rep"), F.first("sketch").alias("sketch"))
    buckets = texts.select("rep", F.posexplode("sketch").alias("k", "v")).select(F.xxhash64("k", "v").alias("bucket"), "rep")
    sizes = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 1)
    members = checkpointed(buckets.join(sizes, "bucket"))
    # the lead of a bucket is the member with the most companions in all its buckets: the likely original of a group of variants
    companions = members.groupBy("rep").agg(F.sum("size").alias("met"))
    leads = members.join(companions, "rep").groupBy("bucket").agg(F.max_by("rep", F.struct(F.col("met"), -F.col("rep"))).alias("lead"))
    placed = members.select("bucket", "rep", "size").join(leads, "bucket")
    met = placed.where(F.col("lead") != F.col("rep")).select("lead", "rep", F.col("size").alias("met"), F.least("lead", "rep").alias("a"), F.greatest("lead", "rep").alias("b"))
    # two texts may lead one another in different buckets: the larger bucket's lead stays
    stars = checkpointed(met.groupBy("a", "b").agg(F.max(F.struct("met", "lead", "rep")).alias("s")).select("a", "b", "s.met", "s.lead", "s.rep"))
    links = checkpointed(_verified(stars.select("lead", "rep", "met"), docs, id_col, text_col))
    labels = components(links)
    # members of a bucket that the stars left in different components
    at = members.select("bucket", "rep").join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("bucket", "rep", F.coalesce("label", "rep").alias("c"))
    split = at.groupBy("bucket").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where(F.col("c0") < F.col("c1")).select("bucket")
    left = checkpointed(at.join(split, "bucket", "left_semi").select(F.col("rep").alias("id"), "c").distinct())
    found = checkpointed(_plausible(left, docs, id_col, text_col).join(stars, ["a", "b"], "left_anti"))
    pairs = found.join(found.groupBy("a").agg(F.count(F.lit(1)).alias("met")), "a").select(F.col("a").alias("lead"), F.col("b").alias("rep"), "met")
    more = checkpointed(_verified(pairs, docs, id_col, text_col))
    if not more.isEmpty():
        labels = components(links.union(more))
    of_text = texts.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("digest", F.coalesce("label", "rep").alias("class_id"))
    out = rows.join(of_text, "digest", "left")
    return out.select(F.col("id").alias(id_col), F.when(F.col("id").isNotNull(), F.col("class_id")).alias("class_id"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs`, all columns, with one document of each class: the one whose id is the class id. Rows with a null id stay."""
    (other,) = free(docs.columns, "other")
    others = near_duplicates(docs, id_col, text_col).where(F.col(id_col) != F.col("class_id")).select(F.col(id_col).alias(other)).distinct()
    return docs.join(others, name(id_col) == F.col(other), "left_anti")
