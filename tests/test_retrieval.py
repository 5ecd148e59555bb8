"""Ranking against plain brute force, ties, both ways of scoring, recall."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lavka.operators import lexical, ranking, scoring
from lavka.operators.scoring import BestHits, VectorScores
from lavka.plans import views


def vectors_of(rows, name):
    return [(i, [float(x) for x in v]) for i, v in rows], f"{name[0]} long, {name[1]} array<float>"


@pytest.fixture(scope="module")
def vector_tables(spark):
    rng = np.random.default_rng(3)
    corpus = rng.normal(size=(700, 8)).round(2)
    corpus[300:560] = corpus[7]  # more than a third are copies of one vector
    corpus[600] = 0
    queries = np.vstack([corpus[7:8], rng.normal(size=(24, 8)).round(2)])
    ks = [3, 5, 300] + [rng.integers(1, 20) for _ in range(22)]
    c = spark.createDataFrame(*vectors_of(enumerate(corpus), ("id", "embedding")))
    q = spark.createDataFrame(
        [(i, [float(x) for x in v], int(k)) for i, (v, k) in enumerate(zip(queries, ks))],
        "query_id long, qvec array<float>, k long",
    )
    return c.repartition(5), q, corpus.astype(np.float32).astype(float), queries.astype(np.float32).astype(float), ks


def brute(corpus, queries, ks):
    expected = set()
    for qi, (q, k) in enumerate(zip(queries, ks)):
        scored = []
        for i, v in enumerate(corpus):
            if (length := np.linalg.norm(v) * np.linalg.norm(q)) > 0:
                scored.append((-round(float(v @ q / length), 6), i))
        expected |= {(qi, i, r + 1) for r, (_, i) in enumerate(sorted(scored)[:k])}
    return expected


def found(df):
    return {(r.query_id, r.id, r.rank) for r in df.collect()}


def test_topk_equals_brute_force(vector_tables):
    corpus, queries, c, q, ks = vector_tables
    assert found(ranking.vector_topk_batch(queries, corpus, "k")) == brute(c, q, ks)


def test_paired_blocks_give_the_same(vector_tables):
    corpus, queries, c, q, ks = vector_tables
    paired = ranking.vector_topk_batch(queries, corpus, "k", block_queries=6)
    assert found(paired) == brute(c, q, ks)


def operators(frame):
    return [line.split("(")[0].strip(" +-*:") for line in frame._jdf.queryExecution().optimizedPlan().toString().split("\n")]


def test_ten_blocks_are_one_scan(vector_tables, monkeypatch):
    corpus, queries, c, q, ks = vector_tables
    many = ranking.vector_topk_batch(queries, corpus, "k", block_queries=3)
    assert len(list(ranking.query_blocks(ranking._requests(queries, "k"), 3))) == 9
    assert sum(x.startswith("PythonMapInArrow") or x.startswith("MapInArrow") for x in operators(many)) == 1
    assert not any(x.startswith("Union") for x in operators(many))
    assert found(many) == brute(c, q, ks)
    monkeypatch.setattr(ranking, "SCAN_BYTES", 1000)  # blocks of more bytes than may be sent at once
    split = ranking.vector_topk_batch(queries, corpus, "k", block_queries=3)
    assert any(x.startswith("Union") for x in operators(split)) and found(split) == brute(c, q, ks)


def test_many_queries_are_dealt_and_each_searched_once(vector_tables, monkeypatch):
    """Tasks read queries and have the corpus at hand: no list of a query is held by every task of the corpus."""
    corpus, queries, c, q, ks = vector_tables
    monkeypatch.setattr(ranking, "DEALT_HITS", 100)
    monkeypatch.setattr(ranking, "HIT_BYTES", 1000)
    monkeypatch.setattr(ranking, "TASK_HITS", 150)
    scored = ranking.deal_queries(ranking._requests(queries, "k"), corpus, VectorScores, BestHits)
    rows = [(r.query_id, r.id) for r in scored.collect()]
    assert len(rows) == len(set(rows)) == sum(ks)  # before any merging
    assert found(ranking.vector_topk_batch(queries, corpus, "k")) == brute(c, q, ks)
    monkeypatch.setattr(ranking, "BLOCK_BYTES", 5000)
    monkeypatch.setattr(ranking, "SCAN_BYTES", 12_000)  # a corpus that no task holds at once is passed in parts
    split = ranking.vector_topk_batch(queries, corpus, "k")
    assert any(x.startswith("Union") for x in operators(split)) and found(split) == brute(c, q, ks)
    twice = ranking.vector_topk_batch(queries.union(queries), corpus, "k")
    monkeypatch.setattr(ranking, "DEALT_HITS", 10**9)
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, ranking.vector_topk_batch(queries.union(queries), corpus, "k").collect()))


def as_lists(rows):
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, rows)]).astype(np.int32), np.concatenate(rows).astype(np.float32))


@pytest.mark.parametrize("cells, rows, waiting, dense", [(1 << 21, 1 << 13, 1 << 18, 32), (600, 50, 9, 32), (4000, 301, 100, 1), (4000, 301, 100, 10**9)])
def test_best_pairs_by_single_precision_are_exact(monkeypatch, cells, rows, waiting, dense):
    """Vectors a few units of single precision apart, copies, several lengths, vectors without direction."""
    for name, value in (("MAX_CELLS", cells), ("ROWS", rows), ("WAITING", waiting), ("DENSE", dense)):
        monkeypatch.setattr(scoring, name, value)
    rng = np.random.default_rng(11)
    near = np.ones(16) + rng.normal(size=(900, 16)) * 2e-3
    near[200:500] = near[3]
    vectors = [*near, *rng.normal(size=(300, 16)), *rng.normal(size=(40, 5)), np.zeros(16), np.full(16, np.nan), *near[:100]]
    vectors = [np.asarray(v, np.float32) for v in vectors]
    ids = rng.permutation(len(vectors))
    asked = [*(np.float32(v) for v in near[:20]), np.float32(near[3]), *(np.float32(v) for v in rng.normal(size=(9, 5))), np.zeros(16, np.float32)]
    ks = np.array([1 + i * i for i in range(len(asked))])
    expected = set()
    for n, (q, k) in enumerate(zip(asked, ks)):
        q = q.astype(float)
        scored = [(-round(float(v.astype(float) @ q) / np.linalg.norm(v.astype(float)) / np.linalg.norm(q), 6), i) for v, i in zip(vectors, ids) if len(v) == len(q) and v.any() and q.any() and not np.isnan(v).any()]
        expected |= {(n, i, -s) for s, i in sorted(scored)[:k]}
    queries = pa.table({"query_id": np.arange(len(asked)), "qvec": as_lists(asked), "k": ks})
    corpus = pa.table({"id": ids, "embedding": as_lists(vectors)})
    schema = pa.schema([("query_id", pa.int64()), *scoring.BestHits.columns.items()])

    class Sent:
        def __init__(self, table):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as stream:
                stream.write_table(table)
            self.value = sink.getvalue().to_pybytes()

    ways = (
        scoring.score_blocks([Sent(queries)], iter(corpus.to_batches(max_chunksize=333)), VectorScores, BestHits, schema),
        scoring.score_queries([Sent(corpus.slice(0, 500)), Sent(corpus.slice(500))], iter(queries.to_batches(max_chunksize=17)), VectorScores, BestHits, schema),
    )
    for way in ways:
        hits = [(r["query_id"], r["id"], r["score"]) for batch in way for r in batch.to_pylist()]
        assert len(hits) == len(expected)
        assert {h[:2] for h in hits} == {e[:2] for e in expected} and np.allclose([h[2] for h in sorted(hits)], [e[2] for e in sorted(expected)], atol=1e-9)


def test_stats_count_every_pair(vector_tables):
    corpus, queries, c, q, _ = vector_tables
    for bounds in ({}, {"block_queries": 6}):
        rows = ranking.query_corpus_join(queries, corpus, **bounds).collect()
        assert [r.compared for r in rows] == [699] * 25
        for r in rows:
            scores = [v @ q[r.query_id] / np.linalg.norm(v) / np.linalg.norm(q[r.query_id]) for v in c if v.any()]
            assert math.isclose(r.best_score, max(scores), abs_tol=1e-6)
            assert math.isclose(r.mean_score, np.mean(scores), abs_tol=2e-6)


def test_mean_over_vectors_of_several_lengths(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [3.0, 4.0]), (4, [0.0, 0.0]), (5, None), (6, [1.0, 2.0, 2.0]), (7, [float("nan"), 1.0])]
    corpus = spark.createDataFrame(rows, "id long, embedding array<float>")
    asked = [(1, [1.0, 0.0]), (2, [0.0, 0.0, 1.0]), (3, [1.0] * 5), (4, None), (5, [0.0, 0.0])]
    queries = spark.createDataFrame(asked, "query_id long, qvec array<float>")
    found = {r.query_id: (r.compared, r.mean_score, r.best_score) for r in ranking.query_corpus_join(queries, corpus).collect()}
    assert found == {1: (3, round(1.6 / 3, 6), 1.0), 2: (1, 0.666667, 0.666667)}


def test_many_small_batches(spark, vector_tables):
    corpus, queries, c, q, ks = vector_tables
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        assert found(ranking.vector_topk_batch(queries, corpus, "k")) == brute(c, q, ks)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def words(text):
    return [w for w in "".join(ch if ch.isalnum() else " " for ch in text.lower()).split()]


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(5)
    vocabulary = ["the"] * 30 + ["of"] * 10 + [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(5, 60)))) for i in range(200)]
    docs += [(i, docs[3][1]) for i in range(200, 300)]  # a third are copies
    queries = [(i, " ".join(rng.choice(vocabulary) for _ in range(6)) + (" unseen" if i % 3 == 0 else "")) for i in range(20)]
    chunks = spark.createDataFrame(docs, "chunk_id long, content string").repartition(4)
    return chunks, spark.createDataFrame(queries, "query_id long, text string"), docs, queries


def brute_text(docs, queries, kind, k):
    bags = {i: Counter(words(t)) for i, t in docs}
    df = Counter(w for bag in bags.values() for w in bag)
    n, mean = len(bags), sum(sum(b.values()) for b in bags.values()) / len(bags)
    expected = {}
    for qi, text in queries:
        asked = {w: c for w, c in Counter(words(text)).items() if w in df}
        weight = {w: (1 + math.log(c)) * math.log(1 + n / df[w]) for w, c in asked.items()}
        length = math.sqrt(sum(x * x for x in weight.values()))
        scored = []
        for i, bag in bags.items():
            if not any(w in bag for w in asked):
                continue
            if kind == "bm25":
                size = sum(bag.values())
                s = sum(c * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * bag[w] * 2.2 / (bag[w] + 1.2 * (0.25 + 0.75 * size / mean))
                        for w, c in asked.items() if w in bag)
            else:
                norm = math.sqrt(sum((1 + math.log(c)) ** 2 for c in bag.values()))
                s = sum(weight[w] / length * (1 + math.log(bag[w])) / norm for w in asked if w in bag)
            scored.append((-round(s, 6), i))
        expected[qi] = [i for _, i in sorted(scored)[:k]]
    return expected


@pytest.mark.parametrize("options", [{}, {"block": 16}])
@pytest.mark.parametrize("kind", ["bm25", "tfidf"])
def test_text_ranking_equals_brute_force(texts, kind, options):
    chunks, queries, docs, plain = texts
    search = lexical.lexical_bm25 if kind == "bm25" else lexical.text_near_search
    parts = {"part": 5} if options else {}  # several groups of queries for a block
    rows = search(queries, lexical.text_index(chunks, **options), 12, **parts).orderBy("query_id", "rank").collect()
    got = {}
    for r in rows:
        got.setdefault(r.query_id, []).append(r.id)
    assert got == brute_text(docs, plain, kind, 12)


def test_chunks_cover_the_text(spark):
    texts = ["", "a", "😀" * 799, "b" * 800, "c" * 801, "".join(chr(97 + i % 26) for i in range(3333)), "x\ny" * 700, "z" * 1400]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    chunks = {}
    for r in lexical.static_chunking(docs).orderBy("chunk_id").collect():
        chunks.setdefault(r.doc_id, []).append(r.content)
        assert r.chunk_id == r.doc_id * 2**20 + r.chunk_no
    for i, text in enumerate(texts):
        starts = range(0, max(1, len(text) - 200), 600) if text else []
        assert chunks.get(i, []) == [text[s : s + 800] for s in starts]


def test_fusion_of_one_sided_hits(spark):
    hit = "query_id long, id long, rank int"
    left, right = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], hit), spark.createDataFrame([(1, 11, 1), (1, 12, 2)], hit)
    fused = {r.id: r.score for r in lexical.rrf_fusion(left, right).collect()}
    assert fused == {10: round(1 / 61, 9), 11: round(1 / 61 + 1 / 62, 9), 12: round(1 / 62, 9)}
    assert [r.id for r in lexical.hybrid_top5(lexical.rrf_fusion(left, right), 2).orderBy("rank").collect()] == [11, 10]
