"""The manifest against a plain recount of its levels, for trees of many sizes."""

import random
from hashlib import sha256
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from lavka.llm import dataset_queries, merkle
from lavka.llm.registry import QUERIES


def digest(text):
    return sha256(text.encode()).hexdigest()


def levels_of(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([digest("".join(last[n : n + 2])) for n in range(0, len(last), 2)])
    return levels


def siblings_of(levels, place):
    found = []
    for level in levels[:-1]:
        other = place ^ 1
        found.append((level[other] if other < len(level) else None, place & 1))
        place >>= 1
    return found


def brute(rows):
    """Per tree and place: leaf, subroot, root and siblings, from (tree, key, leaf)."""
    trees = {}
    for tree, key, leaf in rows:
        trees.setdefault(tree, []).append((key is not None, key or 0, leaf))
    names = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    below = {t: levels_of([leaf for *_, leaf in sorted(trees[t])]) for t in names}
    above = levels_of([below[t][-1][0] for t in names])
    return sorted(
        (leaf, below[t][-1][0], above[-1][0], siblings_of(below[t], place) + siblings_of(above, n))
        for n, t in enumerate(names)
        for place, leaf in enumerate(below[t][0])
    )


def manifest_of(spark, rows, slab=10):
    frame = spark.createDataFrame([(*r, "x") for r in rows], "tree string, key long, leaf string, digest string").repartition(3)
    return merkle.manifest(frame, F.col("tree"), F.col("key"), F.col("leaf"), slab)


@pytest.mark.parametrize("slab", [2, 10])
def test_equals_a_plain_recount(spark, slab):
    rng = random.Random(3)
    sizes = {"a": 1, "b": 2, None: 3, "ü": 5, "": 8, "z": 33, "hot": 300}
    rows = [(t, rng.randrange(1000), digest(f"{t}{n}")) for t, size in sizes.items() for n in range(size)]
    rows += [("z", None, digest("no key")), ("hot", 7, digest("same")), ("hot", 7, digest("same")), ("hot", 7, digest("same"))]
    found = manifest_of(spark, rows, slab)
    folded = merkle.folded_root(F.col("leaf"), F.col("siblings"), F.col("sides"))
    got = []
    for r in found.select("row", "leaf", "subroot", "root", "siblings", "sides", folded.alias("folded")).collect():
        assert r.folded == r.root and r.row.leaf == r.leaf and r.row.digest == "x"
        steps = [(s, r.sides >> n & 1) for n, s in enumerate(r.siblings)]
        got.append((r.leaf, r.subroot, r.root, steps))
    expected = brute(rows)
    assert [(a, b, c, [s for s, _ in d]) for a, b, c, d in sorted(got, key=repr)] == [
        (a, b, c, [s for s, _ in d]) for a, b, c, d in sorted(expected, key=repr)
    ]
    for (*_, mine), (*_, plain) in zip(sorted(got, key=repr), sorted(expected, key=repr)):
        assert [side for s, side in mine if s] == [side for s, side in plain if s]


def test_one_leaf_and_none(spark):
    (only,) = manifest_of(spark, [(None, 1, digest("x"))]).collect()
    assert (only.root, only.subroot, only.siblings, only.sides) == (digest("x"), digest("x"), [], 0)
    assert manifest_of(spark, []).count() == 0


def test_query_of_odd_rows(spark, tmp_path):
    rows = [(7, None, None, None, None), (0, "s", "en", 3, "añb"), (0, "s", "en", 3, "añb"), (None, "s", "de", 1, ""), (-5, "s", None, 2, "y" * 300_000)]
    docs = spark.createDataFrame([(*r, "extra") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["op11_merkle"](spark, str(tmp_path)).collect()

    def field(x):
        return "-" if x is None else f"{len(str(x).encode())}:{x}"

    leaves = {digest("".join(map(field, r))) for r in rows}
    assert {r.leaf for r in found} == leaves and len(found) == len(rows) and len({r.root for r in found}) == 1
    for r in found:
        tampered = r.doc_id is not None and crc32(str(r.doc_id).encode()) % dataset_queries.TAMPERED == 0 and r.doc_id != 7
        assert r.verified == (not tampered)
