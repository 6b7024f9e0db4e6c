"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fill_middle, filter_audit, flac_media, license_scan, line_dedup, minhash_dedup, mixing, quality_rules, secret_scan, suffix_dedup, toxicity, word_bpe
from .common import read


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(read(spark, sf_dir, "documents"))
    base = [k for k in secret_scan.KINDS[: secret_scan.N_BASE]]

    def text(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start_pos"].cast("string"), s["end_pos"].cast("string"))), ",")

    def n(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    based = F.filter("spans", lambda s: s["kind"].isin(*base))
    return found.select("doc_id", *map(n, base), F.sha2(text(based), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.apply_rules(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac_media.read_back(flac_media.store(read(spark, sf_dir, "documents")))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_boilerplate_lines(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = toxicity.score_texts(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(read(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(read(spark, sf_dir, "documents")).drop("places")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    out = bpe.decode(bpe.encode(read(spark, sf_dir, "documents"), path), path)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), F.sha2("offsets", 256).alias("offsets_sha256"))


def op11_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    out = word_bpe.decode(word_bpe.encode(read(spark, sf_dir, "documents"), path), path)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", "n_tokens", F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_middle.restore(fill_middle.transform(read(spark, sf_dir, "documents")))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_quality_rules, op3_suffix_dedup, op4_flac_media, op5_line_dedup, op6_toxicity, op7_minhash_dedup, op8_mixing, op9_license_scan, op10_bpe, op11_word_bpe, op12_filter_audit, op13_fill_middle)}

_STOPS = ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)
SQL = {
    "op2_quality_rules": rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
w AS (SELECT doc_id, x, list_filter(string_split_regex(x, '[\x20\x09-\x0D]+'), lambda s: s <> '') AS ws,
  list_filter(string_split(x, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS ls FROM t),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
d AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM g),
s AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM d WHERE c > 1),
r AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS n FROM s GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(x, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines, len(list_filter(ws, lambda s: lower(s) IN ({_STOPS}))) AS n_stop FROM w LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed"""
    + "".join(f" AND {r.numerator}::DOUBLE / greatest({r.denominator}, 1) BETWEEN {r.low} AND {r.high}" for r in quality_rules.RULES)
    + " AS kept FROM b",
    "op5_line_dedup": rf"""
WITH t AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS x FROM documents),
l AS (SELECT rid, source, md5(x) AS page, unnest(string_split(x, chr(10))) AS line, generate_subscripts(string_split(x, chr(10)), 1) AS pos FROM t),
real AS (SELECT *, regexp_matches(line, '[^\x20\x09-\x0D]') AS worded FROM l),
c AS (SELECT source, line, count(DISTINCT page) AS pages FROM real WHERE worded GROUP BY source, line),
h AS (SELECT source, count(DISTINCT md5(x)) AS pages FROM t GROUP BY source),
b AS (SELECT c.source, c.line FROM c JOIN h ON c.source IS NOT DISTINCT FROM h.source WHERE c.pages >= {line_dedup.LEAST_PAGES} AND c.pages > {line_dedup.MAX_RATIO}::DOUBLE * h.pages),
f AS (SELECT real.*, worded AND b.line IS NOT NULL AS gone FROM real LEFT JOIN b ON real.line = b.line AND real.source IS NOT DISTINCT FROM b.source),
k AS (SELECT rid, count(*) AS n, count(*) FILTER (gone) AS dropped, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept FROM f GROUP BY rid)
SELECT doc_id, CASE WHEN x = '' THEN 0 ELSE n END::BIGINT AS n_lines, dropped::BIGINT AS n_dropped, sha256(kept) AS kept_sha256 FROM t JOIN k USING (rid)""",
    "op8_mixing": r"""
WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(doc_id::VARCHAR) AS h FROM documents),
p AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
q AS (SELECT *, 2.0::DOUBLE * source_size AS most, ([3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT])::DOUBLE AS weight FROM p),
o AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS budget, coalesce(sum(most) OVER before, 0) AS capped, sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS weights
  FROM q WINDOW before AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
u AS (SELECT *, (budget - capped) / weights AS level, row_number() OVER (ORDER BY most / weight, source NULLS LAST) AS n FROM o),
v AS (SELECT *, arg_min(level, n) FILTER (level * weight <= most) OVER () AS share FROM u),
g AS (SELECT source, source_size, least(most, coalesce(share * weight, most)) AS target FROM v),
n AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS times FROM g),
r AS (SELECT s.*, source_size, target, times, target - times * source_size AS rest,
  sum(size) OVER (PARTITION BY s.source ORDER BY h) AS upto, sum(size) OVER (PARTITION BY s.source, h) AS own
  FROM s JOIN n ON s.source IS NOT DISTINCT FROM n.source)
SELECT doc_id, size, source_size, target, (size * (times + CASE WHEN times >= 2 THEN 0 WHEN upto <= rest THEN 1 WHEN upto - own <= rest AND 2 * (rest - (upto - own)) >= own THEN 1 ELSE 0 END))::BIGINT AS taken FROM r""",
    "op12_filter_audit": r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda s: s <> '') AS w FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT part, coalesce(good, false) AS good, coalesce(l.toxic, false) AS toxic,
  [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(x, '[^A-Z]+', '', 'g')) > 2 * length(x), regexp_matches(x, '[#$%&*|]'), coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY x), false)] AS f
  FROM t LEFT JOIN l USING (doc_id)),
c AS (SELECT part, good, toxic, f, count(*) AS n FROM d GROUP BY ALL),
v AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS v, unnest([1, 2, 3, 4, 5]) AS i),
o AS (SELECT a.v || b.v || c.v || d.v || e.v AS filter_order, [a.i, b.i, c.i, d.i, e.i] AS ix FROM v a, v b, v c, v d, v e
  WHERE a.i NOT IN (b.i, c.i, d.i, e.i) AND b.i NOT IN (c.i, d.i, e.i) AND c.i NOT IN (d.i, e.i) AND d.i <> e.i),
s AS (SELECT filter_order, ix, unnest([1, 2, 3, 4, 5]) AS step FROM o),
r AS (SELECT part, filter_order, step, substr(filter_order, step, 1) AS letter, n, good, toxic, f[ix[step]] AS fails, list_bool_or(list_transform(ix[1:step - 1], lambda k: f[k])) IS TRUE AS earlier,
  len(list_filter(f, lambda z: z)) = 1 AS alone FROM c, s),
g AS (SELECT part, filter_order, step, letter, coalesce(sum(n) FILTER (NOT fails AND NOT earlier), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fails AND NOT earlier), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (fails AND earlier), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails AND alone), 0)::BIGINT AS unique_fails,
  coalesce(sum(n) FILTER (fails AND NOT earlier AND good), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (fails AND NOT earlier AND toxic), 0)::BIGINT AS toxic_lost FROM r GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM g""",
    "op13_fill_middle": r"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
h AS (SELECT *, len(u)::BIGINT AS n, ('0x' || s[1:8])::BIGINT AS h1, ('0x' || s[9:16])::BIGINT AS h2, ('0x' || s[17:24])::BIGINT AS h3, ('0x' || s[25:32])::BIGINT AS h4 FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS pre, coalesce(array_to_string(u[a + 1:b], ''), '') AS mid, coalesce(array_to_string(u[b + 1:], ''), '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(x) AS restored_sha256 FROM p""",
}
