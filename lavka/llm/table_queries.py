"""Queries that apply operators to the tables of vectors and of pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from lavka.llm import neighbours, urls
from lavka.llm.registry import query, table

#: The rules that hold before any learned verdict.
RULES = [
    urls.Rule("allow", "org", "/"),
    urls.Rule("block", "example.org", "/es/"),
    urls.Rule("block", "example.org", "/en/1"),
    urls.Rule("allow", "com", "/fr/"),
    urls.Rule("block", "com", "/de/"),
]


@query(urls.oracle(RULES))
def op5_urls(spark, sf_dir):
    """Each page's verdict by rule, else by its template's labelled purity."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    return urls.url_verdicts(pages, labels, RULES).drop("purity")


@query()
def op8_hilbert(spark, sf_dir):
    """The nearest vectors of every twentieth one."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.nearest(vectors, F.col("vec_id") % 20 == 0)
