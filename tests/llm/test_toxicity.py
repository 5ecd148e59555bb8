import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lavka.llm import toxicity as t


@pytest.mark.parametrize("block", [16, 64, 512])
def test_block_max_search_is_exact(monkeypatch, block):
    monkeypatch.setattr(t, "BLOCK", block)
    rng = np.random.default_rng(3)
    terms = 40

    def vector():
        number = np.sort(rng.choice(terms, rng.integers(1, 6), replace=False))
        weight = rng.choice([1.0, 2.0, 3.0], len(number))
        return t.Query(number, weight / np.linalg.norm(weight))

    vectors = [vector() for _ in range(700)]
    ids, labels = list(range(1000, 1700)), rng.integers(0, 2, 700).tolist()
    index = t.BlockMaxIndex(vectors, ids, labels, terms)
    dense = np.zeros((700, terms))
    for row, v in enumerate(vectors):
        dense[row, v.terms] = v.weights
    for case in range(200):
        query = vector()
        whole = np.zeros(terms)
        whole[query.terms] = query.weights
        similar = np.round(np.minimum(dense @ whole, 1), 12)
        without = 1000 + case if case % 2 else None
        if without is not None:
            similar[case] = 0
        order = sorted(range(700), key=lambda n: (-similar[n], ids[n]))[: t.NEAREST]
        found, near = index.nearest(query, without)
        expected = [ids[n] for n in order if similar[n] > 0]
        assert np.allclose(near, [similar[n] for n in order if similar[n] > 0], atol=1e-11)
        assert sorted(index.ids[found].tolist()) == sorted(expected) or np.isclose(near[-1], similar[order[-1]])


def test_odd_rows(spark):
    calm = [f"a calm text about garden number{n} and house{n % 7}" for n in range(60)]
    rude = [f"you awful zog and grumpf number{n}" if n % 2 else f"grumpf zog said house{n % 7}" for n in range(40)]
    rows = [(n, text) for n, text in enumerate(calm + rude)]
    more = [(200, "what a zog grumpf"), (201, "garden house"), (202, None), (203, ""), (200, "what a zog grumpf"), (None, "zog " * 50_000)]
    docs = spark.createDataFrame([(i, x, 1.0) for i, x in rows + more], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(n, int(n >= 60)) for n in range(100)] + [(5, None), (None, 1), (7, 0)], "doc_id long, label int")
    found = t.toxicity(docs, labels, F.col("doc_id") < 200).collect()
    assert len(found) == len(rows + more) and all(0 <= r.score <= 1 for r in found)
    score = {r.doc_id: r.score for r in found}
    assert score[200] > 0.8 and score[None] > 0.8
    assert score[201] < 0.3 and score[202] == score[203] < 0.5
    assert next(r for r in found if r.doc_id == 200).evidence[0].label == 1
    none = t.toxicity(docs, labels.filter("false"), F.lit(True)).collect()
    assert {r.score for r in none} == {0.0}
    assert t.toxicity(docs.filter("false"), labels, F.lit(True)).count() == 0


def test_copies_of_examples_with_rare_words_find_them(spark):
    texts = [f"alpha{n} beta{n} gamma{n % 3}" for n in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts + texts)) + [(100 + n, x) for n, x in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(n, int(n % 12 < 4)) for n in range(24)], "doc_id long, label int")
    found = {r.doc_id: r for r in t.toxicity(docs, labels, F.col("doc_id") < 100).collect()}
    for n in range(12):
        first = found[100 + n].evidence[0]
        assert (first.doc_id, first.label) == (n, int(n < 4)) and first.similarity > 0.999999
    assert min(found[100 + n].score for n in range(4)) > max(found[100 + n].score for n in range(4, 12))


@pytest.mark.parametrize("common", [0.0, 0.2, 2.0])
def test_common_words_change_no_similarity(monkeypatch, common):
    monkeypatch.setattr(t, "COMMON", common)
    monkeypatch.setattr(t, "BLOCK", 8)
    rng = np.random.default_rng(5)
    dense = rng.random((50, 30)) * (rng.random((50, 30)) < np.linspace(0.05, 0.9, 30))
    dense[:, 29] += 0.1
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    vectors = [t.Query(np.flatnonzero(row), row[row > 0]) for row in dense]
    index = t.BlockMaxIndex(vectors, list(range(50)), [n % 2 for n in range(50)], 30)
    for n, vector in enumerate(vectors):
        _, near = index.nearest(vector, n)
        expected = np.sort(np.delete(dense @ dense[n], n))[::-1][: t.NEAREST]
        assert np.allclose(near, expected)


def plain_cosines(rows, labels, learn):
    """Per document its cosine with each example, over all words, from a plain recount."""
    bags = [Counter(t.words_of(text)) for _, text in rows]
    examples = {i: bag for (i, _), bag in zip(rows, bags) if i in labels and learn(i)}
    df, n = Counter(w for bag in bags for w in bag), len(rows)
    total, toxic = len(examples), sum(labels[i] for i in examples)
    vocabulary = {w for bag in examples.values() for w in bag}
    weight = {w: 1 + math.log((1 + n) / (1 + df[w])) for w in df}
    for w in vocabulary:
        seen = sum(w in bag for bag in examples.values())
        bad = sum(labels[i] for i, bag in examples.items() if w in bag)
        cells = ((bad, seen, toxic), (seen - bad, seen, total - toxic), (toxic - bad, total - seen, toxic), (total - seen - toxic + bad, total - seen, total - toxic))
        g = sum(2 * x * math.log(x * total / (row * column)) for x, row, column in cells if x > 0)
        weight[w] *= 1 + max(g, 0) / t.TELLING_G
    vector = lambda bag: {w: (1 + math.log(c)) * weight[w] for w, c in bag.items()}
    length = lambda v: math.sqrt(sum(x * x for x in v.values()))
    found = []
    for bag in bags:
        own = vector(bag)
        near = []
        for i, other in examples.items():
            theirs = vector(other)
            product = sum(x * theirs.get(w, 0) for w, x in own.items())
            if product > 0:
                near.append((product / length(own) / length(theirs), i))
        found.append(near)
    return found


def test_evidence_equals_a_plain_recount(spark):
    rng = random.Random(9)
    words = [f"w{n}" for n in range(80)] + ["zog", "grumpf"]
    rows = [(n, " ".join(rng.choices(words, k=rng.randrange(1, 25)) + ["zog"] * (n % 5 == 0))) for n in range(120)]
    rows += [(n, " ".join(rng.choices(words, k=5) + [f"unseen{n % 140}x{m}" for m in range(n % 9)])) for n in range(120, 180)]
    rows += [(500, "zog"), (501, "zog " + " ".join(f"new{n}" for n in range(2000)))]
    labels = {n: int(n % 5 == 0) for n in range(0, 120, 2)}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    frame = spark.createDataFrame(list(labels.items()), "doc_id long, label int")
    found = {r.doc_id: r for r in t.toxicity(docs, frame, F.col("doc_id") < 110).collect()}
    for (doc_id, _), near in zip(rows, plain_cosines(rows, labels, lambda i: i < 110)):
        best = sorted(near, key=lambda x: (-round(x[0], 10), x[1]))[: t.SHOWN]
        shown = [(round(e.similarity, 9), e.label) for e in found[doc_id].evidence]
        assert [s for s, _ in shown] == pytest.approx([s for s, _ in best], abs=1e-9)
        assert {e.doc_id for e in found[doc_id].evidence} <= {i for s, i in near if s >= best[-1][0] - 1e-9}
    alone, among = found[500], found[501]
    assert among.evidence[0].similarity < alone.evidence[0].similarity / 10 and among.score < alone.score


def test_blocks_of_other_words_are_skipped(monkeypatch):
    monkeypatch.setattr(t, "BLOCK", 32)
    rng = np.random.default_rng(7)
    vectors, ids = [], []
    for topic in range(8):
        for _ in range(128):
            terms = np.sort(rng.choice(40, 12, replace=False)) + 40 * topic
            weight = rng.random(12) + 0.1
            vectors.append(t.Query(terms, weight / np.linalg.norm(weight)))
            ids.append(len(ids))
    index = t.BlockMaxIndex(vectors, ids, [0] * len(ids), 320)
    assert index.blocks == 32
    for vector in vectors:
        index.nearest(vector)
    assert index.scored / len(vectors) < index.blocks / 2


def test_index_grows_with_postings_not_with_words_times_blocks(monkeypatch):
    monkeypatch.setattr(t, "BLOCK", 8)
    vectors = [t.Query(np.arange(20) + 20 * n, np.full(20, 20**-0.5)) for n in range(512)]
    tracemalloc.start()
    index = t.BlockMaxIndex(vectors, list(range(512)), [n % 2 for n in range(512)], 20 * 512)
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert index.blocks == 64 and most < 200 * 20 * 512  # bytes for each posting
    for n in (0, 7, 511):
        found, similar = index.nearest(vectors[n])
        assert index.ids[found].tolist() == [n] and similar == pytest.approx([1.0])


@pytest.mark.parametrize("remembered", [300_000, 5, 0])
def test_words_are_counted_as_one_by_one(monkeypatch, remembered):
    monkeypatch.setattr(t, "REMEMBERED", remembered)
    words = ["a", "b", "ß", "straße"]
    counter = t.WordCounter({w: n for n, w in enumerate(words)})
    texts = [None, "", "A a-b, c c_1 c", "STRASSE straße\u00a0B\x1cb x", " \n ", "no one", "…", "a" * 50_000 + " a", "ΣΑΣ σας"]
    rows = [row for start in (0, 4, 2, 0) for row in counter.counted(pa.array(texts[start : start + 5])).to_pylist()]
    texts = [text for start in (0, 4, 2, 0) for text in texts[start : start + 5]]
    for text, row in zip(texts, rows):
        bag = Counter(t.words_of(text))
        found = dict(zip([words[n] for n in row["term"]], row["count"])) | dict(zip(row["other"], row["times"]))
        assert found == bag and row["term"] == sorted(row["term"]) and not set(row["other"]) & set(words)
