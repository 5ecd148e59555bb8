"""Queries that apply the text operators to the whole table of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from lavka.llm import bpe, decontamination, language, licenses, quality, secrets, simhash, toxicity, urls
from lavka.llm.batches import bounded_batches
from lavka.llm.folds import held_out
from lavka.llm.registry import query, table


def word_vocabulary() -> str:
    """Where the public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query()
def op1_bpe(spark, sf_dir):
    """Digests of each document's token ids and of the text they decode to."""
    bounded_batches(spark)
    path = word_vocabulary()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = docs.select("doc_id", bpe.encode(spark, F.col("text"), path).alias("ids"))
    back = coded.withColumn("decoded", bpe.decode(spark, F.col("ids"), path))
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query()
def op2_toxicity(spark, sf_dir):
    """Each document's toxicity by its nearest labelled examples."""
    bounded_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    found = toxicity.toxicity(docs, labels, ~held_out(F.col("doc_id")))
    return found.select(
        "doc_id",
        (~F.col("learned")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "evidence",
    )


@query()
def op3_simhash(spark, sf_dir):
    """Each document's fingerprint and the smallest id of its near-duplicate class."""
    bounded_batches(spark)
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query()
def op4_secrets(spark, sf_dir):
    """Every secret in a document, with the forest's probability."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return secrets.secrets(docs, path=F.col("source")).drop("source")


@query(licenses.oracle())
def op6_licenses(spark, sf_dir):
    """Every licence found in a document, by the sentences that tell it."""
    return licenses.licences(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


@query(decontamination.ORACLE)
def op7_decontamination(spark, sf_dir):
    """Every benchmark item that a document contains."""
    bounded_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination.contaminations(docs, table(spark, sf_dir, "benchmark"))


@query()
def op9_quality(spark, sf_dir):
    """Each document's quality; its site is that of its page, else its source."""
    url = F.col("url")
    path = F.get(F.split(urls.url_path(url), "/"), F.lit(1))
    pages = table(spark, sf_dir, "pages")
    sites = pages.select(F.col("page_id").alias("doc_id"), urls.url_host(url).alias("host"), path.alias("path"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    found = quality.quality(docs, sites, labels, ~held_out(F.col("doc_id")))
    keep = (F.col("score") >= quality.LEAST_SCORE).cast("int").alias("keep")
    return found.select("doc_id", (~F.col("learned")).alias("held_out"), "document", "host_share", "path_share", "score", keep)


@query()
def op10_language(spark, sf_dir):
    """The language of each document by profiles learned from four fifths of them."""
    bounded_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", held_out(F.col("doc_id")))
    profiles = language.language_profiles(docs.filter(~F.col("held_out")), F.col("text"), F.col("lang"))
    found = docs.select("doc_id", "held_out", language.predicted_language(profiles, F.col("text")).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score")
