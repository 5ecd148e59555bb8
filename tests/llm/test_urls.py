from pyspark.sql import functions as F

from lavka.llm import urls
from lavka.llm.table_queries import RULES


def test_parts_and_rules(spark):
    given = [
        (1, "https://A.Example.ORG/en/1?x#y", "a.example.org", "/en/1", "example.org/en/1", "block"),
        (2, "https://example.org/es/://z", "example.org", "/es/://z", "example.org/es/", "block"),
        (3, "http://x.org", "x.org", "", None, "allow"),
        (4, "http://x.org?q=/a", "x.org", "", None, "allow"),
        (5, "http://notcom/de/1", "notcom", "/de/1", None, "allow"),
        (6, "http://b.com/de/1#/", "b.com", "/de/1", "com/de/", "block"),
        (7, "http://b.com/fr/1", "b.com", "/fr/1", "com/fr/", "allow"),
        (8, None, "", "", None, "allow"),
        (9, "no scheme/org/", "", "", None, "allow"),
        (10, "", "", "", None, "allow"),
        (None, "ftp://q.org/", "q.org", "/", "org/", "allow"),
        (None, "ftp://q.org/", "q.org", "/", "org/", "allow"),
        (12, "http://long.net/" + "seg/" * 40_000, "long.net", "/" + "seg/" * 40_000, None, "allow"),
    ]
    pages = spark.createDataFrame([(g[0], g[1], "x") for g in given], "page_id long, url string, verdict string")
    none = spark.createDataFrame([(99, 1), (None, 0), (1, None)], "page_id long, good int")
    found = urls.url_verdicts(pages, none, RULES).collect()
    assert sorted((r.page_id or 0, r.host, r.path, r.rule or "", r.verdict) for r in found) == sorted(
        (g[0] or 0, g[2], g[3], g[4] or "", g[5]) for g in given
    )
    assert urls.url_verdicts(pages.filter("false"), none, RULES).count() == 0


def test_impure_branch_is_kept_apart_and_blocked(spark):
    pages = [(n, f"http://h.net/good/{n}") for n in range(100)]
    pages += [(n, f"http://h.net/bad/{n}.html") for n in range(100, 200)]
    pages += [(n, f"http://h.net/fine/{n}") for n in range(200, 300)] + [(400, "http://h.net/bad/77.html"), (401, "http://h.net/rare/7")]
    labels = [(n, int(not 100 <= n < 200)) for n in range(300)]
    found = urls.url_verdicts(
        spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, good int"), []
    )
    by_id = {r.page_id: (r.template, r.verdict) for r in found.collect()}
    assert by_id[400] == ("/bad/*", "block") and by_id[0][1] == by_id[401][1] == "allow"
    assert by_id[0][0] != by_id[401][0]  # the branch better than its neighbours stays apart, the rare one merges


def test_generalised_paths(spark):
    rows = spark.createDataFrame([("/a/12/b9.html",), ("",), ("//",), ("/1/2/3/4/5/6",)], "path string")
    assert [r[0] for r in rows.select(urls.generalised(F.col("path"))).collect()] == ["a/#/b#.html", "", "", "#/#/#/#/**"]
