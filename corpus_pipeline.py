"""Cleaning, mixing and packing a corpus in five stages.

Each stage takes all rows that the one before kept and its decisions take effect:

1. toxicity: a classifier learned from `labels`; documents that score 0.7 or more go.
2. language id: documents in no language (`und`) or whose best language has a score under 0.3 go.
3. SimHash near-dedup: shingles of five words, similarity 0.8 or more; the smallest doc_id of a group stays.
4. mixing: documents are repeated by Poisson counts so that sources follow their weights.
5. packing: power-of-two pieces of the tokenised documents.

All but the last return the columns of the documents. A stage's output may be written as Parquet and read by the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm import langid, mixing, packing, simhash, toxicity
from readloom.llm.common import remove, scratch, table
from readloom.session import ship

THRESHOLD, SURE_LANGUAGE = 0.7, 0.3


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that score THRESHOLD or more. Null and empty texts have no features and stay; each row is judged alone."""
    ship(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, THRESHOLD).where("__rl_predicted = 0").select(*docs.columns)


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs whose language is told with a score of SURE_LANGUAGE or more. Null texts and those without a letter go; each row is judged alone."""
    ship(spark)
    found = langid.identify(docs, langid.fit(docs))
    return found.where((F.col("__rl_lang") != "und") & (F.col("__rl_score") >= SURE_LANGUAGE)).select(*docs.columns)


def stage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates. Null and empty texts are one group; of repeated rows one stays."""
    ship(spark)
    return simhash.keep_one(docs, k=5, similarity=0.8)


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs repeated towards the mixture's weights, in a global random order.

    A null source is one of its own; rows with equal doc_id and source have the same count.
    """
    ship(spark)
    return mixing.mix_sources(docs, mixing.WEIGHTS, seed=42, any_rate=True, added=("__rl_copy", "__rl_mix_key")).select(*docs.columns)


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document, each row packed alone; a null text is its end id."""
    ship(spark)
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", stage_toxicity),
    ("language_id", stage_language),
    ("simhash_dedup", stage_dedup),
    ("mixing", stage_mixing),
    ("packing", stage_packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents, each stage's output written in the shared folder and read by the next.

    An output is removed when the next is written; the last one stays, as the result reads it.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
