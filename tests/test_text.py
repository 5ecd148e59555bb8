"""Text, number and list rules beyond what the given tables reach."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lavka.functions import text as fn
from lavka.operators import goods


def one(spark, value, expression, kind="string"):
    row = spark.createDataFrame([(value,)], f"c {kind}").select(expression(F.col("c")).alias("r")).first()
    return row.r


@pytest.mark.parametrize(
    "value, shown",
    [(1200.0, "1200.0"), (12345678.5, "12345678.5"), (1e7, "10000000.0"), (0.0005, "0.0005"), (1e16, "1e+16"),
     (1.5e-7, "1.5e-07"), (None, "nan"), (float("inf"), "inf"), (-2.5, "-2.5")],
)
def test_number_text(spark, value, shown):
    assert one(spark, value, fn.fn_number_to_text, "double") == shown


@given(st.lists(st.floats(allow_nan=False, allow_infinity=False), min_size=20, max_size=60))
@settings(max_examples=5, deadline=None)
def test_number_text_like_str(spark, values):
    rows = spark.createDataFrame([(v,) for v in values], "c double").select("c", fn.fn_number_to_text(F.col("c")).alias("s"))
    for row in rows.collect():
        assert float(row.s) == row.c
        if row.c == 0 or 1e-4 <= abs(row.c) < 1e16:
            assert row.s == str(row.c)


@pytest.mark.parametrize(
    "value, n, cut",
    [("abc", 3, "abc"), ("abcd", 3, "abc … [truncated]"), ("", 3, ""), (None, 3, ""), ("😀😀😀", 3, "😀😀😀"), ("😀😀😀😀", 3, "😀😀😀 … [truncated]")],
)
def test_clamp(spark, value, n, cut):
    assert one(spark, value, lambda c: fn.clamp_text(c, n)) == cut


@pytest.mark.parametrize(
    "content, price",
    [("x. Цена за единицу в рублях: 1200.5", 1200), ("Цена за единицу в рублях: 1 200 300 руб", 1200300),
     ("Цена за единицу в рублях: 1 200", 1200), ("Цена за единицу в рублях: нет", None), ("Цена: 5", None),
     ("Цена за единицу в рублях:7 Цена за единицу в рублях: 9", 7)],
)
def test_chunk_price(spark, content, price):
    assert one(spark, content, goods.price_in_chunk) == price


def test_strip_takes_any_whitespace(spark):
    assert one(spark, " \t a b \n", fn.fn_strip) == "a b"


def plain_ids(items):
    """The rule for id lists said once more in plain Python."""
    kept = []
    for item in items:
        try:
            number = int(float(item))
        except (ValueError, OverflowError):
            continue
        if number not in kept:
            kept.append(number)
    return kept


ids = st.one_of(
    st.integers(-(10**6), 10**6).map(str),
    st.floats(-1e6, 1e6).map(lambda x: f"{x:.3f}"),
    st.sampled_from(["nan", "inf", "-inf", "ID 12", "", " 7 ", "1e3", ".5", "5.", "+3", "--3", "12 3"]),
)


@given(st.lists(st.lists(ids, max_size=8), min_size=30, max_size=60))
@settings(max_examples=4, deadline=None)
def test_sanitize_ids(spark, requests):
    rows = spark.createDataFrame([(r,) for r in requests], "ids array<string>")
    for row in rows.select("ids", fn.sanitize_ids(F.col("ids")).alias("clean")).collect():
        assert row.clean == plain_ids(row.ids)


def test_price_band_like_list_slices(spark):
    """All numbers of hits up to 39, padded limits up to 59, all flags."""
    grid = spark.range(40).withColumnRenamed("id", "n").filter("n > 0")
    hits = (
        grid.withColumn("search_limit", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(59).cast("bigint"))))
        .withColumn("flag", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3), F.lit(4))))
        .withColumn("query_id", F.col("n") * 1000 + F.col("search_limit") * 10 + F.col("flag"))
        .withColumn("rank", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))))
        .withColumn("price", F.col("rank") % 7)
    )
    kept = goods.price_band(hits).groupBy("n", "search_limit", "flag").agg(F.sort_array(F.collect_list(F.struct("price_pos", "price", "rank"))).alias("k"))
    found = {(r.n, r.search_limit, r.flag): [(x.price, x.rank) for x in r.k] for r in kept.collect()}
    for n in range(1, 40):
        prices = sorted((i % 7, i) for i in range(1, n + 1))
        for limit in range(1, 60):
            half = limit // 2
            cuts = {1: prices[0:15], 2: prices[half - 7 : half + 7], 3: prices[limit - 15 : limit - 1], 4: []}
            for flag, cut in cuts.items():
                assert found.get((n, limit, flag), []) == cut, (n, limit, flag)


def test_price_band_found_takes_the_dearest(spark):
    rows = [(1, 3, i, i) for i in range(1, 21)] + [(2, 2, i, i) for i in range(1, 6)] + [(3, 3, 1, 5)]
    hits = spark.createDataFrame(rows, "query_id long, flag long, rank long, price long")
    found = goods.price_band_found(hits).groupBy("query_id").agg(F.sort_array(F.collect_list("price")).alias("p")).collect()
    assert {r.query_id: r.p for r in found} == {1: list(range(6, 21)), 2: [1, 2, 3, 4, 5], 3: [5]}


def test_abs_url(spark):
    cases = {
        ("https://a.b/c/d?x=1#f", "e/f"): "https://a.b/c/e/f",
        ("https://a.b", "e"): "https://a.b/e",
        ("https://a.b/c/d", "//x.y/z"): "https://x.y/z",
        ("https://a.b/c/d?x=1", "?y=2"): "https://a.b/c/d?y=2",
        ("https://a.b/c/d?x=1#f", "#g"): "https://a.b/c/d?x=1#g",
        ("https://a.b/c/d", "ftp://q"): "ftp://q",
    }
    rows = spark.createDataFrame([(*pair, url) for pair, url in cases.items()], "base string, href string, url string")
    for row in rows.withColumn("got", fn.fn_abs_url(F.col("base"), F.col("href"))).collect():
        assert row.got == row.url


def test_code_trim(spark):
    assert one(spark, "Артикул:    X1", fn.product_code_trim) == "X1"
    assert one(spark, "short", fn.product_code_trim) == "short"
    assert one(spark, "short", lambda c: fn.product_code_trim(c, keep_short=False)) == ""


def test_path_title_without_third_level(spark):
    from lavka.operators.catalogue import catalogue_path_title

    rows = spark.createDataFrame([("A", "B", None, "T"), ("A", "B", "C", "T")], "cat string, sub string, subsub string, title string")
    titles = {r.path_title for r in catalogue_path_title(rows).collect()}
    assert titles == {"Путь в каталоге: A, B. T", "Путь в каталоге: A, B, C. T"}
