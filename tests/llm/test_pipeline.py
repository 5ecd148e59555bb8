"""The registered queries against their SQL, and the pipeline against plain versions of its stages."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from comparison import open_tables, rows_of
from lavka.llm import decontamination, simhash
from lavka.llm.queries import ORACLE, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_equals_sql(spark, key):
    found = QUERIES[key](spark, SF_DIR)
    answer = open_tables(SF_DIR).execute(ORACLE[key])
    expected = rows_of([d[0] for d in answer.description], answer.fetchall())
    assert rows_of(found.columns, [tuple(r) for r in found.collect()]) == expected


def test_stages(spark, tmp_path):
    source = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    key = "AKIA" + "Q7Z2" * 4
    item = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").first().text
    more = [(9001, None, "en", "s", 0), (9002, "12 34", "en", "s", 5), (9003, "Words around " + item + " here.", "en", None, 9),
            (9004, f"These thing and the other {key} then that ander the inge of reat", None, "s", 9)]
    docs = source.unionByName(spark.createDataFrame(more, source.schema))
    columns = docs.columns
    after = [docs]
    for _, stage in corpus_pipeline.STAGES:
        after.append(stage(spark, after[-1], SF_DIR).persist())
    assert all(frame.columns == columns for frame in after[:-1])
    ids = [{r.doc_id for r in frame.select("doc_id").collect()} for frame in after]
    assert ids[0] - ids[1] == {9001, 9002}
    texts = {r.doc_id: r.text for r in after[1].collect()}
    prints = {i: simhash.text_fingerprint(t) for i, t in texts.items()}
    kept = set()
    label = {i: i for i in prints}
    for _ in range(20):
        for a in sorted(prints):
            near = [b for b in prints if (prints[a] ^ prints[b]).bit_count() <= 3]
            least = min(label[b] for b in near)
            for b in near:
                label[b] = min(label[b], least)
    kept = {i for i in label if label[i] == i}
    assert ids[2] == kept
    items = [decontamination.shingles(r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    hit = {i for i in kept if any(len(s & decontamination.shingles(texts[i])) >= 0.8 * len(s) for s in items)}
    assert 9003 in hit and ids[3] == kept - hit
    assert ids[4] == ids[3] == ids[5]
    assert key not in after[4].filter("doc_id = 9004").first().text
    last = after[5].filter("doc_id = 9004").first()
    assert last.n_tokens == len(last.token_ids) > 0
    assert after[4].filter(F.length("text") != F.col("n_chars")).count() == 0
    empty = docs.filter("false")
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF_DIR)
        assert empty.count() == 0
