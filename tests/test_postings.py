"""Stored postings: bounds that hold, folders and blocks that are not read, ranks beyond any list."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lavka.operators import lexical, postings


def plan(frame):
    return frame._jdf.queryExecution().explainString(frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.fixture(scope="module")
def corpus(spark):
    """Topics of their own words, so that most blocks hold nothing of a query's topic."""
    rng = random.Random(12)
    rows = []
    for n in range(1200):
        topic = n // 60
        words = [f"t{topic}w{rng.randrange(30)}" for _ in range(rng.randrange(4, 30))] + ["the"] * rng.randrange(6)
        rows.append((n, " ".join(words)))
    rows += [(n, rows[5][1]) for n in range(1200, 1500)]  # a fifth are copies of one
    rows += [(1500, ""), (1501, None), (1502, "?! ..."), (1503, "word " * 20_000)]
    chunks = spark.createDataFrame(rows, "chunk_id long, content string").coalesce(1)
    queries = [(n, " ".join(f"t{n}w{rng.randrange(30)}" for _ in range(5)) + " the") for n in range(20)]
    queries += [(100, "unseen words only"), (101, ""), (102, None), (103, "the"), (104, "t0w1 t0w1 t0w1 the t19w3")]
    return spark.createDataFrame(queries, "query_id long, text string"), chunks, rows, queries


def ranked(rows, queries):
    """All chunks that share a term, per query and kind in order, from a plain recount."""
    split = lambda text: [w for w in re.split(r"[^a-z0-9]+", (text or "").lower()) if w]
    bags = {i: Counter(split(t)) for i, t in rows}
    df = Counter(w for bag in bags.values() for w in bag)
    n, mean = len(bags), sum(sum(b.values()) for b in bags.values()) / len(bags)
    lists = {}
    for q, text in queries:
        asked = {w: c for w, c in Counter(split(text)).items() if w in df}
        raw = {w: (1 + math.log(c)) * math.log(1 + n / df[w]) for w, c in asked.items()}
        length = math.sqrt(sum(x * x for x in raw.values()))
        bm25, tfidf = [], []
        for i, bag in bags.items():
            shared = [w for w in asked if w in bag]
            if shared:
                size, norm = sum(bag.values()), math.sqrt(sum((1 + math.log(c)) ** 2 for c in bag.values()))
                a = sum(asked[w] * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * bag[w] * 2.2 / (bag[w] + 1.2 * (0.25 + 0.75 * size / mean)) for w in shared)
                bm25.append((-round(a, 6), i))
                tfidf.append((-round(sum(raw[w] / length * (1 + math.log(bag[w])) / norm for w in shared), 6), i))
        lists[q] = [[i for _, i in sorted(x)] for x in (bm25, tfidf)]
    return lists


def listed(frame):
    found = {}
    for r in frame.orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.id)
    return found


def test_lists_are_exact_and_most_blocks_stay_unread(spark, corpus, tmp_path):
    queries, chunks, rows, plain = corpus
    index = lexical.text_index(chunks, str(tmp_path / "index"), block=32, buckets=8)
    lists = ranked(rows, plain)
    for at, search in enumerate((lexical.lexical_bm25, lexical.text_near_search)):
        assert listed(search(queries, index, 7)) == {q: x[at][:7] for q, x in lists.items() if x[at]}
    search = lexical._search(queries.filter("query_id < 20"), index, ("bm25",))
    pairs, scored = search.bounds.count(), 0
    original = postings.over_blocks

    def counted(found, wanted, run, schema):
        nonlocal scored
        scored += wanted.count()
        return original(found, wanted, run, schema)

    postings.over_blocks = counted
    try:
        postings.best_chunks(search, 7).count()
    finally:
        postings.over_blocks = original
    assert scored < pairs / 3, (scored, pairs)


def test_a_search_reads_its_terms_folders_only(spark, corpus, tmp_path):
    queries, chunks, *_ = corpus
    index = lexical.text_index(chunks, str(tmp_path / "index"), block=64, buckets=8)
    one = queries.filter("query_id = 103")
    search = lexical._search(one, index, ("bm25",))
    text = plan(search.terms)
    (pruned,) = set(re.findall(r"PartitionFilters: \[(.*?)\]", text)) - {""}
    own = spark.range(1).select(postings.bucket(F.lit("the"), 8)).first()[0]
    assert f"(bucket#" in pruned and f"= {own})" in pruned, pruned
    assert "content" not in text and "Generate" not in plan(postings.best_chunks(search, 3))
    assert (tmp_path / "index" / f"bucket={own}").exists()


def test_bounds_hold(spark, corpus):
    queries, chunks, *_ = corpus
    index = lexical.text_index(chunks, block=32)
    search = lexical._search(queries, index, postings.KINDS)
    hits = postings.best_chunks(search, 2000)
    blocks = index.blocks.select("block", F.explode("ids").alias("id"))
    held = hits.join(blocks, "id").join(search.bounds, ["query_id", "block"])
    assert held.count() == hits.count() > 5000
    for kind in postings.KINDS:
        assert held.filter(F.col(kind) > F.col(f"bound_{kind}") + 1e-6).count() == 0


@pytest.mark.parametrize("k", [1, 5, 40])
def test_fusion_has_no_list_length(spark, corpus, k):
    queries, chunks, rows, plain = corpus
    index = lexical.text_index(chunks, block=32)
    found = {}
    for r in lexical.hybrid_search(queries, index, k).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.id, r.lexical_rank, r.vector_rank, r.score))
    expected, beyond = {}, 0
    for q, (bm25, tfidf) in ranked(rows, plain).items():
        rank = [{i: n for n, i in enumerate(x, 1)} for x in (bm25, tfidf)]
        fused = sorted((-round(sum(1 / (60 + r[i]) for r in rank if i in r), 9), i) for i in set(bm25) | set(tfidf))
        if fused:
            expected[q] = [(i, rank[0].get(i), rank[1].get(i), -s) for s, i in fused[:k]]
            beyond += sum(max(a or 0, b or 0) > lexical.fusion_depth(k) for _, a, b, _ in expected[q])
    assert found == expected


def test_lists_that_disagree(spark):
    """Best in one list, behind rank 50 in the other: the exact rank is reported and counted."""
    rng = random.Random(3)
    rows = []
    for n in range(300):
        # Long chunks with many keys lead by BM25 of a small b; short ones by cosine.
        own = ["key"] * (1 + n // 20) + [f"x{rng.randrange(50)}" for _ in range(n // 3)]
        rows.append((n, " ".join(own)))
    chunks = spark.createDataFrame(rows, "chunk_id long, content string")
    queries = [(1, "key x1 x2"), (2, "key")]
    index = lexical.text_index(chunks, block=16)
    lists = ranked(rows, queries)
    frame = spark.createDataFrame(queries, "query_id long, text string")
    left, right = lexical.fusion_lists(frame, index, 5)
    for at, got in enumerate((left, right)):
        for r in got.collect():
            assert lists[r.query_id][at][r.rank - 1] == r.id
    ranks = {(r.query_id, r.id): (r.lexical_rank, r.vector_rank) for r in lexical.hybrid_rank_join(left, right).collect()}
    for q, (bm25, tfidf) in lists.items():
        wanted = set(bm25[:70]) | set(tfidf[:70])
        assert {i for own, i in ranks if own == q} == wanted
        assert any(max(ranks[(q, i)]) > 70 for i in wanted)


def fused_of(bm25, tfidf, k, depth):
    share = {}
    for ids in (bm25[:depth], tfidf[:depth]):
        for n, i in enumerate(ids, 1):
            share[i] = share.get(i, 0) + 1 / (60 + n)
    return sorted(share, key=lambda i: (-round(share[i], 9), i))[:k]


def test_rank_51_decides(spark):
    """Where the lists disagree, those cut at fifty fuse to other chunks than whole ones."""
    rng, rows, few = random.Random(3), [], [f"x{m}" for m in range(6)]
    for n in range(1500):
        own = ["key"] * rng.choice([0, 1, 1, 2, 30]) + rng.choices(few, k=rng.choice([0, 1, 2, 6]))
        own += [f"y{m}" for m in rng.sample(range(2000), rng.choice([0, 3, 40, 150]))]
        rows.append((n, " ".join(own)))
    queries = []
    for n in range(40):
        asked = ["key"] * rng.choice([0, 1, 8]) + rng.choices(few, k=rng.choice([1, 2, 4]))
        queries.append((n, " ".join(asked + [f"y{rng.randrange(2000)}"] * rng.choice([0, 1]))))
    lists = ranked(rows, queries)
    whole = {q: fused_of(*x, 5, 1500) for q, x in lists.items()}
    cut = {q: fused_of(*x, 5, 50) for q, x in lists.items()}
    assert any(whole[q] != cut[q] for q in whole)
    chunks = spark.createDataFrame(rows, "chunk_id long, content string")
    frame = spark.createDataFrame(queries, "query_id long, text string")
    assert listed(lexical.hybrid_search(frame, lexical.text_index(chunks, block=32), 5)) == whole


def test_no_chunks_and_no_queries(spark, corpus):
    queries, chunks, *_ = corpus
    none = lexical.text_index(chunks.filter("false"))
    assert lexical.hybrid_search(queries, none).count() == 0
    assert lexical.lexical_bm25(queries.filter("false"), lexical.text_index(chunks)).count() == 0


def test_index_of_asked_terms_ranks_as_the_whole_one(spark, corpus):
    queries, chunks, *_ = corpus
    terms = queries.select(F.explode(lexical.tokens(F.col("text"))).alias("term"))
    whole, asked = lexical.text_index(chunks, block=64), lexical.text_index(chunks, block=64, terms=terms)
    assert asked.terms.select("term").distinct().subtract(terms).count() == 0
    assert 0 < asked.terms.count() < whole.terms.count() and asked.blocks.count() == whole.blocks.count()
    assert sorted(map(tuple, lexical.hybrid_search(queries, asked, 5).collect())) == sorted(map(tuple, lexical.hybrid_search(queries, whole, 5).collect()))
