import numpy as np
from pyspark.sql import functions as F

from lavka.llm import neighbours as nb


def test_curve_visits_every_cell_once_and_never_jumps():
    for bits, axes in ((3, 2), (2, 3), (2, 4)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij"), -1).reshape(-1, axes)
        keys = nb.hilbert_keys(cells, bits)
        assert sorted(keys.tolist()) == list(range(len(cells)))
        walk = cells[np.argsort(keys)]
        assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def best(vectors, query, own, size):
    scored = [(float(np.dot(query, v)), i) for i, v in vectors if i != own]
    return sorted(scored, key=lambda x: (-x[0], x[1]))[:size]


def test_odd_rows_and_ties(spark):
    rng = np.random.default_rng(4)
    plain = [(n, rng.normal(size=6).tolist()) for n in range(1, 41)]
    copies = [(n, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]) for n in range(60, 100)]
    good = plain + copies + [(20_000, rng.normal(size=6).tolist())]
    odd = [(200, None), (None, [1.0] * 6), (220, [0.0] * 6), (240, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (260, [float("nan")] * 6),
           (280, [float("inf")] + [1.0] * 5), (300, []), (320, [1.0, 2.0])]
    vectors = spark.createDataFrame([(i, v, 0.5) for i, v in good + odd], "vec_id long, embedding array<double>, score double")
    found = {}
    for r in nb.nearest(vectors, F.col("vec_id") % 20 == 0).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(found) == {20, 40, 60, 80, 20_000}
    hits = 0
    for query, rows in found.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, len(rows) + 1)) and len(rows) == 20
        by_id = dict(good)
        assert all(abs(score - np.dot(by_id[query], by_id[v])) < 1e-9 for _, v, score in rows)
        assert [(-s, v) for _, v, s in rows] == sorted((-s, v) for _, v, s in rows)
        expected = best([(i, np.array(v)) for i, v in good], np.array(by_id[query]), query, 20)
        hits += len({v for _, v, _ in rows} & {v for _, v in expected})
    assert hits >= 0.9 * 20 * len(found)
    assert nb.nearest(vectors.filter("false"), F.col("vec_id") % 20 == 0).count() == 0
    few = vectors.filter("vec_id in (20, 21, 22)")
    assert nb.nearest(few, F.col("vec_id") % 20 == 0).count() == 2


def test_recall_on_the_table(spark):
    from lavka.llm.queries import QUERIES

    rows = QUERIES["op8_hilbert"](spark, "/root/testdata/sf0.01").collect()
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    vectors = [(r.vec_id, np.array(r.embedding, float)) for r in table]
    got = {}
    for r in rows:
        got.setdefault(r.query_id, set()).add(r.vec_id)
    recall = [len(got[i] & {v for _, v in best(vectors, q, i, 20)}) / 20 for i, q in vectors if i % 20 == 0]
    assert np.mean(recall) >= 0.9 and len(recall) == 25
