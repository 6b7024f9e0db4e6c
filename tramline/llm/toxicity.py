"""Toxicity scores from subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its hashed character n-grams, a window of some 32 words is the mean of its distinct words
(a word repeated all over weighs once; a short window is padded with zero vectors), and a two-class softmax reads the window; a text
scores as its most toxic window, so one insult in a long text counts. Misspellings that were never seen share n-grams with
words that were.

Training takes at most `SAMPLE_TOXIC` + `SAMPLE_CLEAN` labelled ids (those of least hash), one text of up to `SAMPLE_CHARS` characters each,
a bound that does not grow with the data, however often an id repeats; longer texts are scored, not learnt from. Labels are learnt only from rows with crc32(id as text) mod 4 other than 2; label, language,
source and id are never inputs of a score. Once trained, each n-gram bucket adds one number to the logit, so scoring broadcasts a table of
2**BUCKET_BITS floats (1 MB) and reads whole texts in a single map.

Null or empty text has no window and gets the score of the bias alone. Without labels of both kinds every score is 0. Equal texts score equally, repeated
rows each get their score, an empty table has none. Very long texts are read whole, window by window. Other columns are passed by, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, map_texts, ranges, text_slices

SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_CHARS = 700, 1000, 20_000
BUCKET_BITS = 18
DIM = 4
GRAMS = (3, 4, 5)
WINDOW = 32
STEPS_ALL, STEPS_MAX, RATE, DECAY = 30, 30, 4.0, 0.002
THRESHOLD = 0.3
TOXIC_SHARE = 0.2
CALM = 4.0
CACHE_WORDS = 200_000
#: Characters that are hashed at once, and of the longest word that is kept.
LEARN_CHARS, KEPT_CHARS = 200_000, 100
_WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class Model:
    """weights[bucket]: what an n-gram adds to the logit of its word."""

    weights: np.ndarray
    bias: float


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _buckets(points: np.ndarray, n: int) -> np.ndarray:
    """Bucket of every run of n code points."""
    h = np.full(len(points) - n + 1, n, np.uint64)
    for j in range(n):
        h = (h ^ points[j : len(points) - n + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)


def grams_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of every character n-gram of `<word>`."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    points = _points("<" + "><".join(words) + ">")
    owner = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
    who, what = [], []
    for n in GRAMS:
        if len(points) < n:
            continue
        h = _buckets(points, n)
        inside = owner[: len(h)] == owner[n - 1 :]
        who.append(owner[: len(h)][inside])
        what.append(h[inside])
    return np.concatenate(who), np.concatenate(what)


def word_weights(words: list[str], weights: np.ndarray) -> list[float]:
    """The mean weight of each word's n-grams, by slices of LEARN_CHARS characters; a longer word is summed up slice by slice."""
    out: list[float] = []
    for a, b in ranges(map(len, words), LEARN_CHARS):
        part = words[a:b]
        if len(part[0]) > LEARN_CHARS:
            marked, total, count = f"<{part[0]}>", 0.0, 0
            for n in GRAMS:
                for i in range(0, len(marked) - n + 1, LEARN_CHARS):
                    h = _buckets(_points(marked[i : i + LEARN_CHARS + n - 1]), n)
                    total, count = total + float(weights[h].sum(dtype=np.float64)), count + len(h)
            out.append(total / count)
            continue
        who, what = grams_of(part)
        out += (np.bincount(who, weights[what], len(part)) / np.maximum(np.bincount(who, minlength=len(part)), 1)).tolist()
    return out


def windows_of(n_words: int) -> np.ndarray:
    """Starts of n_words // WINDOW (at least one) windows of about equal length; none for no words."""
    k = max(1, n_words // WINDOW) if n_words else 0
    return np.arange(k, dtype=np.int64) * n_words // max(k, 1)


def train(texts: list[str], toxic: list[int], seed: int = 7) -> Model:
    """Embeddings and softmax by gradient descent with momentum over the whole sample: first on all windows of a text, then on its most toxic one.

    The gradient of an n-gram is divided by the root of its count, so that it counts by its significance: neither frequent n-grams, whose
    gradients vary by chance, nor those of a single text outweigh the n-grams that many toxic texts share. Steps are scaled by the largest entry.
    """
    table = np.zeros(1 << BUCKET_BITS, np.float32)
    texts, toxic = zip(*((w, y) for w, y in ((words_of(t), y) for t, y in zip(texts, toxic, strict=True)) if w), strict=True) if texts else ((), ())
    y = np.array(toxic, np.float64)
    if len(set(toxic)) < 2:
        return Model(table, -50.0)
    vocab: dict[str, int] = {}
    tokens = np.array([vocab.setdefault(w, len(vocab)) for ws in texts for w in ws])
    sizes = np.array([len(ws) for ws in texts])
    doc_starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    per_doc = [windows_of(n) for n in sizes]
    starts = np.concatenate([a + b for a, b in zip(doc_starts, per_doc, strict=True)])
    doc_of = np.repeat(np.arange(len(sizes)), [len(x) for x in per_doc])
    first = np.concatenate([[0], np.cumsum([len(x) for x in per_doc])[:-1]])
    lengths = np.diff(np.append(starts, len(tokens)))
    bags = np.unique(np.repeat(np.arange(len(starts)), lengths) * len(vocab) + tokens)
    window_of, tokens = bags // len(vocab), bags % len(vocab)
    bag_starts = np.searchsorted(window_of, np.arange(len(starts)))
    sizes_of = np.maximum(lengths, WINDOW)[:, None].astype(np.float32)
    who, what = grams_of(list(vocab))
    order = np.argsort(who, kind="stable")
    who, what = who[order], what[order]
    used, slot = np.unique(what, return_inverse=True)
    counts = np.bincount(who, minlength=len(vocab))
    gram_starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    seen = np.bincount(slot, np.bincount(tokens, minlength=len(vocab))[who], len(used))
    calm = (1 / np.sqrt(seen + CALM))[:, None].astype(np.float32)
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 0.05, (len(used), DIM)).astype(np.float32), rng.normal(0, 1, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)]
    moments = [np.zeros_like(p) for p in params]
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    for step in range(1, STEPS_ALL + STEPS_MAX + 1):
        e, w, b = params
        vectors = np.add.reduceat(e[slot], gram_starts, axis=0) / counts[:, None].astype(np.float32)
        means = np.add.reduceat(vectors[tokens], bag_starts, axis=0) / sizes_of
        logits = means @ w + b
        gap = (logits[:, 1] - logits[:, 0]).astype(np.float64)
        share = np.zeros(len(starts))
        if step <= STEPS_ALL:
            share[:] = 1 / np.bincount(doc_of)[doc_of]
        else:
            top = np.maximum.reduceat(gap, first)
            hit = np.flatnonzero(gap == top[doc_of])
            share[hit[np.unique(doc_of[hit], return_index=True)[1]]] = 1
        pull = share * weight[doc_of] * (1 / (1 + np.exp(-gap)) - y[doc_of])  # d loss / d gap
        g2 = np.stack([-pull, pull], 1).astype(np.float32)
        to_means = g2 @ w.T / sizes_of
        to_tokens = to_means[window_of]
        to_words = np.stack([np.bincount(tokens, to_tokens[:, d], len(vocab)) for d in range(DIM)], 1) / counts[:, None]
        grads = [np.stack([np.bincount(slot, to_words[who, d], len(used)) for d in range(DIM)], 1), means.T @ g2, g2.sum(0)]
        for p, m, g, rate in zip(params, moments, grads, (RATE, 0.1, 0.1), strict=True):
            g = g.astype(np.float32) * (calm if p is e else 1)
            m *= 0.9
            m += 0.1 * g
            p *= 1 - DECAY
            p -= rate * (1 - 0.9 * step / (STEPS_ALL + STEPS_MAX)) * m / (np.abs(m).max() + 1e-12)
    e, w, b = params
    a, c = calibrate(np.maximum.reduceat(gap, first), y)
    table[used] = a * (e @ (w[:, 1] - w[:, 0]))
    return Model(table, float(a * (b[1] - b[0]) + c))


def calibrate(gap: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Scale and shift of the logit by logistic regression with smoothed targets, with toxic texts weighing TOXIC_SHARE of all."""
    n1, n0 = y.sum(), (1 - y).sum()
    goal = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(y == 1, TOXIC_SHARE / n1, (1 - TOXIC_SHARE) / n0)
    spread = gap.std() + 1e-9
    x = np.stack([(gap - gap.mean()) / spread, np.ones_like(gap)])
    p = np.array([1.0, 0.0])
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(p @ x, -30, 30)))
        curve = (x * (weight * q * (1 - q))) @ x.T + 1e-4 * np.eye(2)
        p = p - np.clip(np.linalg.solve(curve, x @ (weight * (q - goal))), -2, 2)
    return float(p[0] / spread), float(p[1] - p[0] * gap.mean() / spread)


def scorer(model: Model) -> Callable[[list[str]], list[float]]:
    """Scores texts; keeps the words met in a bounded cache."""
    known: dict[str, float] = {}

    def learn(words: list[str]) -> None:
        if len(known) + len(words) > CACHE_WORDS:
            known.clear()
        known.update(zip(words, word_weights(words, model.weights), strict=True))

    def score(texts: list[str]) -> list[float]:
        bags = [words_of(t) for t in texts]
        missing = {w for ws in bags for w in ws if w not in known}
        if missing:
            if len(known) + len(missing) > CACHE_WORDS:
                known.clear()
                missing = {w for ws in bags for w in ws}
            learn(list(missing))
        out = []
        for ws in bags:
            gap = model.bias
            if ws:
                edges = [*windows_of(len(ws)).tolist(), len(ws)]
                gap += max(sum(map(known.__getitem__, sorted(set(ws[a:b])))) / max(b - a, WINDOW) for a, b in zip(edges, edges[1:]))
            out.append(1 / (1 + float(np.exp(-np.clip(gap, -50, 50)))))
        for w in missing:  # a few very long words would fill the cache
            if len(w) > KEPT_CHARS:
                known.pop(w, None)
        return out

    return score


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Train on the bounded sample: ids are chosen from the labels alone, then one text of each reaches the driver, the least of those that share an id."""
    known = labels.where(~held_out(F.col(id_col)) & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"))
    ids: dict[object, int] = {}
    for y, most in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN)):
        best = known.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(most)
        ids |= {r["_id"]: r["_y"] for r in best.collect()}
    if not ids:
        return Model(np.zeros(1 << BUCKET_BITS, np.float32), -50.0)
    short = F.when(F.length(text_col) <= SAMPLE_CHARS, F.col(text_col))
    chosen = docs.where(F.col(id_col).isin(*ids)).groupBy(F.col(id_col).alias("_id")).agg(F.min(short).alias("_text")).where(F.col("_text").isNotNull())
    rows = sorted(tuple(r) for r in chosen.limit(SAMPLE_TOXIC + SAMPLE_CLEAN).collect())
    return train([t for _, t in rows], [ids[i] for i, _ in rows])


def score_texts(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score double), one row per row of `docs`, whole texts, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        score = scorer(shared.value)
        return lambda texts: {"score": score(texts)}

    return map_texts(docs, make, "score double", id_col, text_col)


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """`docs`, all columns, without the rows whose score reaches the threshold; no shuffle, texts pass through the map once."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        score = scorer(shared.value)
        for batch in batches:
            keep = [s < threshold for _, texts in text_slices(batch.column(at)) for s in score(texts)]
            yield batch.filter(pa.array(keep, pa.bool_()))
        score = None
        give_back()

    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # whatever the names
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
