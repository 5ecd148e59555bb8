from pyspark.sql import functions as F

from lavka.llm import folds, language

EN = "the house and the garden are near the old river where children play in the sun"
DE = "das haus und der garten liegen nahe an dem alten fluss wo die kinder in der sonne spielen"


def profiles(spark, rows):
    docs = spark.createDataFrame(rows, "text string, lang string")
    return language.language_profiles(docs, F.col("text"), F.col("lang"))


def predicted(spark, learned, texts):
    rows = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, text string")
    found = rows.select("n", language.predicted_language(learned, F.col("text")).alias("f")).select("n", "f.*")
    return [(r.lang_pred, r.score) for r in found.orderBy("n").collect()]


def test_odd_texts(spark):
    learned = profiles(spark, [(EN, "en"), (DE, "de"), (EN, "en"), (None, "xx"), ("123", "yy"), (DE, None)])
    assert {r.lang for r in learned.collect()} == {"en", "de"}
    texts = ["The garden near THE river", "die kinder an dem fluss", None, "", "12 ... 3", "漢字", (EN + ". ") * 40_000]
    found = predicted(spark, learned, texts)
    assert [name for name, _ in found][:5] == ["en", "de", "und", "und", "und"]
    assert found[6][0] == "en" and found[6][1] > 0.9
    assert found[5][1] < 0.2 and all(0 <= score <= 1 for _, score in found)


def test_nothing_learned_and_rejection(spark):
    assert predicted(spark, profiles(spark, []), ["abc", None]) == [("und", 0.0), ("und", 0.0)]
    docs = spark.createDataFrame([(1, EN, "en", 5), (2, DE, "de", 5), (3, None, "en", 5), (4, "42", None, 5)], "doc_id int, text string, lang string, _x int")
    kept = language.recognised(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2]
    unknown = language.recognised(docs.withColumn("lang", F.lit(None).cast("string")))
    assert sorted(r.doc_id for r in unknown.collect()) == [1, 2]
    assert language.recognised(docs.filter("false")).count() == 0


def test_bundles_are_sums_over_places():
    import numpy as np

    whole, has = language.text_vectors(["ab c", None, "7"], 64)
    letters = {c: language.letter_vector(ord(c) if c != " " else 0, 64).astype(int) for c in "abc "}

    def bound(x, y, z):
        return np.roll(letters[x], 2) * np.roll(letters[y], 1) * letters[z]

    assert (whole[0] == bound(" ", "a", "b") + bound("a", "b", " ") + bound(" ", "c", " ")).all()
    assert not whole[1:].any() and has.tolist() == [True, False, False]


def test_short_clean_texts_are_recognised(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    more = [(9001, "Avec.", "fr"), (9002, "A.", None), (9003, "12 34 !", "en"), (9004, None, "en"), (9005, "", "en"), (9006, "字" * 500, None)]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema)).withColumn("_found", F.lit(5)).withColumn("found", F.lit("own"))
    kept = language.recognised(docs)
    assert kept.columns == docs.columns
    rows = {r.doc_id: r for r in kept.collect()}
    assert {9001, 9002} <= set(rows) and not {9003, 9004, 9005} & set(rows)
    assert all(r._found == 5 and r.found == "own" for r in rows.values())


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held", folds.held_out(F.col("doc_id")))
    profiles = language.language_profiles(docs.filter("not held"), F.col("text"), F.col("lang"))
    found = docs.filter("held and lang is not null").select("lang", language.predicted_language(profiles, F.col("text")).alias("p"))
    right = found.filter("p.lang_pred = lang").count()
    assert right >= 0.97 * found.count() > 100
