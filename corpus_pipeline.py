"""A training corpus from raw documents: toxicity, line dedup, near dedup, mixing and byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on every row its predecessor kept. All but the last return the columns of `docs`, whatever they are;
an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.llm import bpe, line_dedup, minhash_dedup, mixing, toxicity
from tramline.llm.common import checkpointed, free, name, read


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches the threshold go. A null or empty text gets the score of no words; repeated rows go or stay together."""
    model = toxicity.fit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are boilerplate of their source leave the texts; every document stays. A null text or length stays null; columns of any name pass through."""
    kept, *others = free(docs.columns, *line_dedup.RESULTS)
    out = line_dedup.drop_boilerplate_lines(docs, results=(kept, *others))
    columns = {"text": F.when(F.col("text").isNotNull(), F.col(kept))}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(F.col("n_chars").isNotNull(), F.length(kept)).cast(docs.schema["n_chars"].dataType)
    return out.withColumns(columns).select(*map(name, docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, the one of least id. Rows with a null id stay; rows that repeat the least id stay together."""
    return minhash_dedup.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources meet their target weights; a document stands as often as the mix takes it. Null sources are one source; rows of equal id are taken together."""
    return mixing.mixed(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256): ids as packed little-endian unsigned 32-bit integers. A null text has no tokens; each repeated row is encoded."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    out = bpe.decode(bpe.encode(docs, path), path)
    return out.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", tokenize),
]

#: A trained model and hash sketches are not expressible in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = checkpointed(docs)
    return docs
