"""The corpus pipeline: stages over ``documents``, each a table for the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lavka.llm import bpe, decontamination, language, secrets, simhash
from lavka.llm.batches import bounded_batches
from lavka.llm.registry import table
from lavka.llm.stored import stored
from lavka.llm.text_queries import word_vocabulary


#: Rows and bytes of a batch of texts. The stages run in the same Python workers, each of which keeps
#: the memory that the largest batch of any stage took.
SMALL = (200, "4m")


def recognised_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose language is not recognised."""
    bounded_batches(spark, *SMALL)
    return language.recognised(docs)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of every near-duplicate class."""
    bounded_batches(spark, *SMALL)
    return simhash.one_of_each_class(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that contain a benchmark item."""
    bounded_batches(spark, *SMALL)
    return decontamination.uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def masked_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts masked, with the new length."""
    masked = secrets.without_secrets(docs, path=F.col("source"))
    return masked.withColumn("n_chars", F.length("text").cast("long"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its token ids, their number and a digest of the text they decode to."""
    bounded_batches(spark, *SMALL)
    path = word_vocabulary()
    coded = docs.withColumn("token_ids", bpe.encode(spark, F.col("text"), path))
    coded = coded.withColumn("n_tokens", F.size("token_ids").cast("long"))
    return coded.withColumn("decoded_sha256", F.sha2(bpe.decode(spark, F.col("token_ids"), path), 256))


STAGES = [
    ("language ID", recognised_languages),
    ("SimHash near-dedup", one_of_near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("secret scans", masked_secrets),
    ("BPE encoding and decoding", token_ids),
]

#: No SQL: random vectors, the forest and BPE have none; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
