from pyspark.sql import functions as F

from lavka.llm import quality as q
from lavka.llm.queries import QUERIES


def test_held_out_accuracy(spark):
    found = QUERIES["op9_quality"](spark, "/root/testdata/sf0.01").filter("held_out")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = found.join(labels, "doc_id").select("keep", "quality").collect()
    assert sum(r.keep == r.quality for r in rows) / len(rows) > 0.95
    good = [r for r in rows if r.quality == 1]
    assert sum(r.keep for r in good) / len(good) > 0.98


def test_sites_and_odd_rows(spark):
    prose = "Some plain words make a sentence. Another one follows it here."
    docs = [(n, prose, "s0") for n in range(200)] + [(900, None, None), (901, "", "s1"), (None, prose, "s1"), (902, prose * 5000, "s1")]
    docs = spark.createDataFrame([(i, t, s, 1.0) for i, t, s in docs], "doc_id long, text string, source string, size double")
    sites = [(n, "bad.net" if n < 100 else "good.net", "en" if n % 2 else "de") for n in range(200)] + [(5, None, None), (None, "x", "y")]
    sites = spark.createDataFrame(sites, "doc_id long, host string, path string")
    labels = [(n, int(n >= 100 or n % 10 == 0)) for n in range(0, 200, 2)] + [(3, None), (None, 1), (4, 0)]
    labels = spark.createDataFrame(labels, "doc_id long, label int")
    found = {r.doc_id: r for r in q.quality(docs, sites, labels, F.lit(True)).collect()}
    assert len(found) == 204
    assert found[51].score < 0.4 < found[151].score  # equal texts, unlabelled, the site decides
    assert found[1].host_share < 0.5 < found[151].host_share
    assert all(0 <= r.score <= 1 for r in found.values())
    unknown = q.quality(docs, sites, labels.filter("false"), F.lit(True)).collect()
    assert {round(r.document, 6) for r in unknown} == {0.5} and {round(r.score, 6) for r in unknown} == {0.5}
    assert q.quality(docs.filter("false"), sites, labels, F.lit(True)).count() == 0
