"""The corpus pipeline: documents in, token ids of the mixed and cleaned corpus out.

Every stage takes all that the one before it kept and returns a table of
documents, the last one their encoding.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from jobloom.llm import bpe, classifier, mixing, pii, simhash
from jobloom.llm.common import table
from jobloom.llm.queries import RANKS
from jobloom.runtime import settle


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data, and terms that disclose it, replaced."""
    return pii.sanitised(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix of sources takes them, a row per repeat."""
    return mixing.mixed_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, with token offsets, and whether they decode to its text."""
    out = bpe.encode(docs, RANKS).withColumn("exact", bpe.decoded(F.col("ids"), RANKS) == F.coalesce("text", F.lit("")).cast("binary"))
    return out.select("doc_id", "source", "lang", bpe.id_count(F.col("ids")).alias("n_tokens"), "ids", "offsets", "exact")


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_dedup),
    ("personal data", personal_data),
    ("source mixing", mixture),
    ("byte-level BPE", encoding),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written down before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
