import math
import re

from pyspark.sql import functions as F

from lavka.llm import secrets

KEYS = re.compile(r'AKIA[0-9A-Z]{16}|password=([0-9a-f]+)|token = "([0-9a-f]{20,})"')


def python_nodes(frame):
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return re.search("Python|Pandas|Arrow", plan)


def test_planted_keys_and_only_they(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    wanted = {(r.doc_id, m[1] or m[2] or m[0]) for r in rows for m in KEYS.finditer(r.text)}
    found = secrets.secrets(docs.select("doc_id", "text", "source"), path=F.col("source"))
    assert not python_nodes(found)
    got = {(r.doc_id, r.secret) for r in found.collect()}
    assert len(wanted) >= 10 and wanted <= got
    assert all(re.search("[0-9]", secret) for _, secret in got - wanted) and len(got - wanted) <= 3


def test_odd_rows(spark):
    prose = " ".join(f"understandability{chr(97 + n % 26)} internationalization remarkable" for n in range(60))
    key = "AKIA" + "Z7Q2" * 4
    texts = [(1, f"the key {key} is here"), (1, f"the key {key} is here"), (2, None), (3, ""), (4, prose), (None, f'password="hunter2secret9" {key}'),
             (5, "x" * 200_000), (6, (prose + " ") * 30 + f"\n{key}")]
    docs = spark.createDataFrame([(i, t, 0.1, "s") for i, t in texts], "doc_id long, text string, digits double, source string")
    found = secrets.secrets(docs, path=F.col("source")).collect()
    assert sorted((r.doc_id or 0, r.secret) for r in found) == sorted(
        [(1, key), (1, key), (0, key), (0, "hunter2secret9"), (6, key)]
    )
    masked = secrets.without_secrets(docs)
    assert masked.columns == docs.columns
    out = {(r.doc_id, r.text) for r in masked.collect()}
    assert masked.count() == len(texts)
    assert {(1, "the key [SECRET] is here"), (2, None), (3, ""), (4, prose), (None, 'password="[SECRET]" [SECRET]')} <= out
    assert not any(key in (text or "") for _, text in out)
    assert secrets.secrets(docs.filter("false")).count() == 0
    assert secrets.without_secrets(docs.filter("false")).count() == 0


def test_model_counts_every_text(spark):
    docs = spark.range(2600).selectExpr("if(id = 7, 'qz', 'ab') AS text").repartition(3)
    logs, dictionary = secrets.word_model(docs.union(spark.createDataFrame([(None,), ("",), ("Word " + "w" * 300 + "v9",)], "text string")), "text")
    pair = lambda a, b: logs[(secrets.LETTERS.index(a) + 1) * secrets.SYMBOLS + secrets.LETTERS.index(b) + 1]
    rest = 0.5 * secrets.SYMBOLS
    assert pair("a", "b") == math.log(2599.5 / (2599 + rest))
    assert pair("q", "z") == math.log(1.5 / (1 + rest))
    assert pair("v", "9") == math.log(1.5 / (1 + rest))
    assert dictionary == ["word"]


def test_forest_learns_from_every_labelled_finding(spark, monkeypatch):
    learnt = []

    class Forest(secrets.RandomForestClassifier):
        def fit(self, rows):
            learnt.append(rows.count())

    monkeypatch.setattr(secrets, "RandomForestClassifier", Forest)
    found = spark.range(9000).selectExpr("cast(id % 2 AS double) AS label", *[f"cast(id % 7 AS double) AS {name}" for name in secrets.FEATURES])
    secrets.trained_forest(found)
    assert learnt == [9000]
