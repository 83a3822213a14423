"""The corpus pipeline: language identification, exact and near deduplication, mixing, BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a table that is written and read again as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm import bpe, exact_dedup, language_id, mixing, near_copies, work

#: How often the mixture shows a source for each time that it shows the largest, at most.
REPEAT = 2.0


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the identifier, trained on their labels, doesn't reject."""
    model = language_id.learn(docs)
    whole = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"))
    return language_id.predict(whole, model, ["d"]).filter(~F.col("rejected")).select("d.*")


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.deduplicate(docs)


def distinct_contents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: shingles of five words, a similarity of 0.8 or more."""
    return near_copies.deduplicate(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture shows them: each at least once, smaller sources up to ``REPEAT`` times."""
    return mixing.realise(docs, repeat=REPEAT)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document shown, with what decoding them gives back."""
    import public_tokenizers

    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", distinct_texts),
    ("simhash_dedup", distinct_contents),
    ("mixing", mixed),
    ("bpe", encoded),
]

#: Language identification and near copies can't be expressed in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = work.put(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
