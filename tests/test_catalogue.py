"""Golden pages, menus and outlines."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from lavka.operators import catalogue as ops
from lavka.sources import sinks, tables

PRODUCT = """<html><body><script>var t = "<p>no</p>";</script>
<h1 class="catalog-detail__title"> Печь <b>Гефест</b></h1><h1 class="catalog-detail__title">second</h1>
<div class="catalog-detail__code">Артикул:    К-1</div><div class="catalog-detail__price wide">wrong</div>
<div class="catalog-detail__price"> 12 000 <span> руб. </span></div>
<p>outside</p>
<div data-tab="description"><p> one &amp; two <br> three</p><p>  </p><div><p>last<!-- c --> part</p></div>
<table><tr><td>head</td></tr><tr><td> Вес: </td><td> 5 кг </td></tr><tr><td>a</td><td>b</td><td>c</td></tr>
<tr><td>Цвет::</td><td>red</td></tr><tr><td>Вес</td><td>6 <i>кг</i></td></tr></table></div><p>after</p></body></html>"""

UNCLOSED = '<div data-tab="description"><p>a<p>b</p><b>c</div><p>d</p>'


def pages(spark, *htmls):
    rows = [(i, f"https://s.t/{i}", html) for i, html in enumerate(htmls)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_product_page(spark):
    record = ops.product_records(pages(spark, PRODUCT)).first()
    assert record.title == " Печь Гефест"
    assert record.code == "Артикул:    К-1"
    assert record.price == "12 000руб."
    assert record.description == "one & twothree\nlastpart"
    assert record.characteristics == {"Вес": "6кг", "Цвет": "red"}
    assert record.error is None
    pairs = ops.product_characteristics(pages(spark, PRODUCT))
    assert ops.characteristics_map(pairs).first().characteristics == {"Вес": "6кг", "Цвет": "red"}


def test_missing_parts_and_unclosed_paragraphs(spark):
    records = {r.url: r for r in ops.product_records(pages(spark, "", UNCLOSED, None)).collect()}
    empty, unclosed, failed = (records[f"https://s.t/{i}"] for i in range(3))
    assert (empty.title, empty.code, empty.price, empty.description, empty.characteristics) == ("", "", "", "", {})
    # an unclosed paragraph holds the text of those within it
    assert unclosed.description == "abc\nb"
    assert failed.error.startswith("TypeError")


def test_failed_page_becomes_an_error_row(spark):
    details = ops.product_records(pages(spark, PRODUCT, None))
    links = spark.createDataFrame(
        [(f"https://s.t/{i}", "Путь в каталоге: A, B") for i in range(3)], "good_url string, path_text string"
    )
    rows = {r.good_url[-1]: r for r in ops.goods_detail_join(links, details).collect()}
    assert rows["0"].title == "Путь в каталоге: A, B.  Печь Гефест" and rows["0"].code == "К-1"
    for at in ("1", "2"):
        assert rows[at].title == f"Путь в каталоге: A, B. ERROR: https://s.t/{at}"
        assert (rows[at].code, rows[at].price, rows[at].characteristics) == ("", "", {})
    assert rows["1"].description.startswith("TypeError") and rows["2"].description.startswith("NotFound")


MENU = """<ul><li><a class="sidebar-menu__link " href="/a">A</a><ul class="sidebar-submenu">
<li><a class="sidebar-submenu__link " href="/a/x">X</a><ul class="sidebar-submenu">
<li><a class="sidebar-submenu__link " href="/a/x/1">One</a></li><li><a class="sidebar-submenu__link " href="/a/x/1">One</a></li></ul></li>
<li><a class="sidebar-submenu__link " href="">none</a></li><li><a class="sidebar-submenu__link " href="/a/y">Y</a></li></ul></li>
<li><a class="sidebar-menu__link " href="/b">B</a></li></ul><a class="offer__title big" href="g?1">G</a><a href="/q">Q</a>"""


def test_menu(spark):
    page = pages(spark, MENU)
    below = {(r.ancestor_path, r.href, r.text, r.depth) for r in ops.submenu_links(page).collect()}
    assert below == {("/a", "/a/x", "X", 1), ("/a", "/a/x/1", "One", 2), ("/a/x", "/a/x/1", "One", 1), ("/a", "/a/y", "Y", 1)}
    assert [(r.href, r.text) for r in ops.menu_links(page).collect()] == [("/a", "A"), ("/b", "B")]
    assert [r.href for r in ops.listing_links(page).collect()] == ["https://s.t/g?1"]


def test_fallback(spark):
    parents = spark.createDataFrame([("/a", "A"), ("/b", "B")], "path string, name string")
    children = spark.createDataFrame([("/a", "/a/x", "")], "ancestor_path string, href string, text string")
    rows = {(r.path, r.href, r.text) for r in ops.self_fallback_join(parents, children).collect()}
    assert rows == {("/a", "/a/x", "A"), ("/b", "/b", "B")}


def test_rollup_of_all_depths_counts_third_level_twice(spark):
    goods = spark.createDataFrame([("A", "x", "1")] * 3 + [("A", "y", None)] * 2, "cat string, sub string, subsub string")
    strict = {(r.cat, r.sub, r.subsub): r.n for r in ops.goods_rollup(goods).collect()}
    assert strict == {(None, None, None): 5, ("A", None, None): 5, ("A", "x", None): 3, ("A", "y", None): 2, ("A", "x", "1"): 3}
    loose = {(r.cat, r.sub, r.subsub): r.n for r in ops.goods_rollup(goods, depth_one_only=False).collect()}
    assert loose[("A", None, None)] == 8 and loose[("A", "1", None)] == 3


OUTLINE = """cat Печи 30
___ subcat Сталь 24
___ ___ subsubcat Малые 20
___ subcat Медь  0s
cat Каменки(это печи) 10 (без прочего)
___ subcat Чугун 10
___ subcat Ограждения, фланцы 24 (не являются каменками)

cat Окна 7
"""


def test_outline(spark, tmp_path):
    (tmp_path / "outline.txt").write_text(OUTLINE, encoding="utf-8")
    lines = tables.scan_outline(spark, str(tmp_path / "outline.txt"))
    parsed = [(r.level, r.name, r.declared_count, r.note) for r in lines.orderBy("line_no").collect()]
    assert parsed == [
        (1, "Печи", 30, ""),
        (2, "Сталь", 24, ""),
        (3, "Малые", 20, ""),
        (2, "Медь", 0, ""),
        (1, "Каменки", 10, "(это печи) (без прочего)"),
        (2, "Чугун", 10, ""),
        (2, "Ограждения, фланцы", 24, "(не являются каменками)"),
        (1, "Окна", 7, ""),
    ]
    placed = {r.name: (r.cat, r["sub"]) for r in ops.outline_parent(lines).collect()}
    assert placed["Малые"] == ("Печи", "Сталь") and placed["Чугун"] == ("Каменки", "Чугун") and placed["Окна"] == ("Окна", None)
    sums = {r.cat: (r.declared, r.subcat_sum, r.difference) for r in ops.outline_reconcile(lines).collect()}
    assert sums == {"Печи": (30, 24, 6), "Каменки": (10, 34, -24), "Окна": (7, None, None)}


def test_sheet_from_csv(spark, tmp_path):
    sheet = 'Report,,,,,\n,,,,,\nA,B,Name,D,Unit,Price\n1,x,"Печь, малая",y,шт,1200.5\n2,x,Дверь,y,шт,нет\n'
    (tmp_path / "sheet.csv").write_text(sheet, encoding="utf-8")
    rows = tables.scan_goods_sheet(spark, str(tmp_path / "sheet.csv")).collect()
    assert sorted(map(tuple, rows), reverse=True) == [("Печь, малая", "шт", 1200.5), ("Дверь", "шт", None)]


def test_sheet_headers_go_by_place(spark, tmp_path):
    head = "Report,,,,,\n,,,,,\nA,B,Name,D,Unit,Price\n"
    body = '1,x,"Two\nlines ""q""",y,pc,5\n,,,,,\nA,B,Name,D,Unit,Price\n2,x,Door,y,pc,7\n'
    for number in range(3):
        (tmp_path / f"{number}.csv").write_text(head + body, encoding="utf-8")
    rows = tables.scan_goods_sheet(spark, str(tmp_path) + "/*.csv").collect()
    own = [('Two\nlines "q"', "pc", 5.0), (None, None, None), ("Name", "Unit", None), ("Door", "pc", 7.0)]
    assert sorted(map(tuple, rows), key=repr) == sorted(own * 3, key=repr)


def small_splits(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)


def whole_splits(spark):
    for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.unset(name)


@pytest.mark.parametrize("size", [61, 400, 1 << 20])
def test_sheet_in_many_splits(spark, tmp_path, size):
    """Cells with line breaks, quotes and commas, some longer than several splits, against a plain reader."""
    rng = random.Random(size)
    pieces = ["a", "б", ",", '"', "\n", "\n\n", " ", "x" * 9, "0", '""', "\r\n"]
    expected, folder = [], tmp_path / "sheets"
    folder.mkdir()
    for number, end in enumerate(("\n", "\r\n", "\n")):
        rows = [["head\nof", "sheet", '"', "", "", ""], ["", "", "", "", "", "second"], ["A", "B", "Name", "D", "Unit", "Price"]]
        for n in range(60):
            name = "".join(rng.choice(pieces) for _ in range(rng.choice([0, 2, 5, 60])))
            rows.append([f"{n}", "".join(rng.choice(pieces) for _ in range(4)), f"n{name}z", "\n" * rng.randrange(3), "шт", f"{n}.5"])
        text = io.StringIO()
        csv.writer(text, lineterminator=end, quoting=csv.QUOTE_MINIMAL if number else csv.QUOTE_ALL).writerows(rows)
        body = text.getvalue() + (end + "  " + end if number < 2 else "")
        (folder / f"{number}.csv").write_bytes(body.encode())
        expected += [(r[2], r[4], float(r[5])) for r in rows[3:]]
    small_splits(spark, size)
    try:
        found = tables.scan_goods_sheet(spark, str(folder))
        assert sorted(tuple(r) for r in found.collect()) == sorted(expected)
        if size == 61:
            splits = tables.csv_records(spark, str(folder)).select("file", "start").distinct().count()
            assert spark.read.text(str(folder)).rdd.getNumPartitions() > 200 and splits > 50
    finally:
        whole_splits(spark)


def test_outline_indented_and_quoted(spark, tmp_path):
    (tmp_path / "outline.txt").write_text('    cat Ovens 30\n    "___ subcat Steel 24"\n  "___ ___ subsubcat Small 20",\n  any other line\n')
    lines = tables.scan_outline(spark, str(tmp_path / "outline.txt"))
    parsed = [(r.level, r.name, r.declared_count) for r in lines.orderBy("line_no").collect()]
    assert parsed == [(1, "Ovens", 30), (2, "Steel", 24), (3, "Small", 20), (None, "", None)]
    assert [r.line_no for r in tables.unparsed_lines(lines).collect()] == [4]


def test_links_as_a_parser_sees_them(spark):
    html = """<a href=/x>X</a><a href="/y">Y<a href='/z'>Z</a><script>"<a href='/no'>"</script>
    <A title="a>b" HREF = "/caf&eacute;?a=1&amp;b=2">caf&eacute; &#38; &#x263A;</A><abbr href="/n">n</abbr><a name=q>no</a><a href="/last">end"""
    rows = spark.createDataFrame([(1, "http://h.org/a/b", html)], "page_id long, url string, html string")
    found = [(r.href, r.text.strip()) for r in ops.page_links(rows).orderBy("pos").collect()]
    assert found == [
        ("/x", "X"), ("/y", "Y"), ("/z", "Z"), ("/caf\u00e9?a=1&b=2", "caf\u00e9 & \u263a"), ("", "no"), ("/last", "end")
    ]


def test_addresses_equal_urljoin(spark):
    from urllib.parse import urljoin

    from lavka.functions.text import fn_abs_url

    bases = ["http://h.org/a/b/c.html", "http://h.org", "https://h.org/a/?q=1#f", "http://h.org/a/b/"]
    links = ["./x", "../up", "x/../y", " x ", "../../../top", "/a/./b/../c", "x/.", "x/..", "//o.net/p/../q", "?b=1", "#c", "", "mailto:a@b", "x?y=../z", "..", "."]
    rows = spark.createDataFrame([(b, h) for b in bases for h in links], "base string, href string")
    found = {(r.base, r.href): r.url for r in rows.select("base", "href", fn_abs_url(F.col("base"), F.col("href")).alias("url")).collect()}
    for (base, href), url in found.items():
        assert url == urljoin(base, href.strip()), (base, href)


def test_csv_sink_writes_maps_as_json(spark, tmp_path):
    rows = spark.createDataFrame([("t", {"a": "1"})], "title string, characteristics map<string,string>")
    sinks.sink_goods_table(rows, str(tmp_path / "out"), "csv")
    read = spark.read.option("header", True).option("escape", "\\").csv(str(tmp_path / "out")).first()
    assert (read.title, read.characteristics) == ("t", '{"a":"1"}')


def test_harvest_union_keeps_repeats(spark):
    a = spark.createDataFrame([(1, "x")], "id int, sub string")
    b = spark.createDataFrame([(1,)], "id int")
    assert sorted(map(tuple, ops.harvest_union(a, b, b).collect()), key=str) == [(1, "x"), (1, None), (1, None)]
    assert ops.url_union_all(a.select(F.col("id")), b).count() == 2
