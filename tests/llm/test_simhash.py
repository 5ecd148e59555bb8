import random

import numpy as np
from pyspark.sql import functions as F

from lavka.llm import simhash
from lavka.llm.components import component_roots


def brute_classes(prints):
    """The smallest index of each fingerprint's class, comparing all pairs."""
    values = np.array(prints, np.uint64)
    label = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for n in range(len(prints)):
            near = np.flatnonzero(np.bitwise_count(values ^ values[n]) <= simhash.RADIUS)
            least = min(label[m] for m in near)
            changed |= any(label[m] != least for m in near)
            for m in near:
                label[m] = min(label[m], least)
    return label


def test_links_connect_what_brute_force_connects(spark):
    rng = random.Random(11)
    prints = set()
    for _ in range(30):  # chains of up to 12 steps of 1 to 4 flips
        value = rng.getrandbits(64)
        for _ in range(12):
            prints.add(value)
            for bit in rng.sample(range(64), rng.choice([1, 2, 3, 3, 4])):
                value ^= 1 << bit
    prints |= {0, 1, 7, 15, (1 << 64) - 1, (1 << 63), (1 << 64) - 8}
    prints = sorted(prints)
    nodes = spark.createDataFrame([(simhash.signed(p),) for p in prints], "fp long")
    likely = simhash.neighbours_likely(nodes)
    links = simhash.ball_links(likely).collect()
    mask = (1 << 64) - 1
    assert all(1 <= ((r.a ^ r.b) & mask).bit_count() <= 3 for r in links)
    roots = {r.node: r.root for r in component_roots(spark.createDataFrame(links, "a long, b long")).collect()}
    expected = brute_classes(prints)
    found = [roots.get(simhash.signed(p), simhash.signed(p)) for p in prints]
    pairs = {(a, b) for a, b in zip(expected, found)}
    assert len(pairs) == len(set(expected)) == len(set(found))


def test_odd_rows(spark):
    base = " ".join(f"word{n}" for n in range(400))
    texts = [
        (4, base), (2, base.upper()), (9, base + " tail"), (5, "quite other words stand here in a row"),
        (None, base), (None, "alone one two three"), (None, "alone one two three"), (7, None), (8, ""), (6, " \n"),
        (5, "quite other words stand here in a row"), (30, "two words"), (31, "TWO\twords"), (40, base * 50),
    ]
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, fp string")
    found = simhash.near_duplicates(docs).collect()
    assert len(found) == len(texts)
    by_id = {(r.doc_id, r.component_id) for r in found}
    assert {(4, 2), (2, 2), (9, 2), (None, 2), (None, None), (7, 6), (8, 6), (6, 6), (5, 5), (30, 30), (31, 30), (40, 2)} <= by_id
    assert {r.fingerprint for r in found if r.doc_id in (6, 7, 8)} == {"0" * 16}
    kept = simhash.one_of_each_class(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == [
        (False, 2), (False, 5), (False, 6), (False, 30), (True, None)
    ]
    empty = docs.filter("false")
    assert simhash.near_duplicates(empty).count() == 0 and simhash.one_of_each_class(empty).count() == 0


def test_a_repeated_id_keeps_a_row_in_each_class(spark):
    a, b = " ".join(f"alpha{n}" for n in range(60)), " ".join(f"beta{n * 7}" for n in range(60))
    rows = [(2, a, 6, "p"), (2, b, 5, "q"), (3, a, 4, "r"), (2, a, 3, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _n int, _fp string")
    kept = simhash.one_of_each_class(docs).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(2, a), (2, b)]
    assert {tuple(r) for r in kept} <= set(rows)
    clash = spark.createDataFrame([(1, a, 9, 8, 7), (2, a, 6, 5, 4)], "doc_id long, text string, fp int, root int, component_id int")
    assert [tuple(r) for r in simhash.one_of_each_class(clash).collect()] == [(1, a, 9, 8, 7)]


def test_components_of_a_long_chain_and_a_hub(spark):
    rng = random.Random(1)
    order = rng.sample(range(300), 300)
    links = [(a, b) for a, b in zip(order, order[1:])] + [(1000, n) for n in range(1001, 1400)] + [(5000, 5000), (None, 3)]
    roots = {r.node: r.root for r in component_roots(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {roots[n] for n in order} == {0}
    assert {roots[n] for n in range(1000, 1400)} == {1000}
    assert 5000 not in roots
    assert component_roots(spark.createDataFrame([], "a long, b long")).count() == 0
