"""URL filters: rules by host and path, else the purity of a path template.

Templates are the branches of a tree per host. Runs of digits in a segment are
generalised first. From the root on, a segment becomes a wildcard if its branch
has few labelled pages or if its share of good ones does not differ from that
of all branches beside it (two-sided test of proportions), so that similar
branches merge and their subtrees are pooled. Segments beyond ``DEPTH`` are one
wildcard for the rest. A template is rejected if its share of good labels, drawn
towards that of its host, which is drawn towards that of all pages, is too low.

Pages are counted by host and generalised path before anything is joined. All of it
is DataFrame operations.

A null address, or one without ``://``, has empty host and path; it has the
template of that host, which is none of the rules'. Pages without a label
teach nothing, repeated pages count each.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lavka.llm.stored import stored

DEPTH = 4
#: Branches of fewer labelled pages always merge.
LEAST_LABELLED = 30
#: Standard errors from which on a branch differs from those beside it.
DIFFERS = 2.58
#: Pages that the level above counts for in a smoothed share.
WEIGHT = 10.0
LEAST_PURITY = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty where there is none."""
    start = F.instr(url, "://")
    return F.when(start > 0, F.substring(url, start + 3, F.length(url))).otherwise("")


def url_host(url: Column) -> Column:
    return F.translate(F.regexp_extract(after_scheme(url), "^[^/?#]*", 0), UPPER, LOWER)


def url_path(url: Column) -> Column:
    rest = F.regexp_replace(after_scheme(url), "^[^/?#]*", "")
    return F.regexp_extract(rest, "^[^?#]*", 0)


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """A struct ``rule``, ``verdict`` of the longest rule that fits, else null."""
    found = []
    for rule in sorted(rules, key=lambda r: (-len(r.host + r.path), r.host + r.path)):
        own = (host == rule.host) | F.endswith(host, F.lit("." + rule.host))
        fits = own & F.startswith(path, F.lit(rule.path))
        found.append(F.when(fits, F.struct(F.lit(rule.host + rule.path).alias("rule"), F.lit(rule.verdict).alias("verdict"))))
    return F.coalesce(*found) if found else F.lit(None).cast("struct<rule: string, verdict: string>")


def generalised(path: Column) -> Column:
    """The path's segments with digits replaced, those beyond the depth as one."""
    parts = F.filter(F.split(F.regexp_replace(path, "[0-9]+", "#"), "/"), lambda s: s != "")
    kept = F.slice(parts, 1, DEPTH)
    return F.concat(F.array_join(kept, "/"), F.when(F.size(parts) > DEPTH, "/**").otherwise(""))


def template_tree(counts: DataFrame) -> DataFrame:
    """``host``, ``shape``, ``template`` with labelled pages ``n`` and good ones ``k``."""
    tree = counts.withColumn("template", F.lit(""))
    for level in range(DEPTH + 1):
        segment = F.get(F.split("shape", "/"), F.lit(level))
        tree = stored(tree.withColumn("segment", F.when(F.col("shape") == "", None).otherwise(segment)), "tree")
        inside = tree.filter("segment IS NOT NULL")
        branches = inside.groupBy("host", "template", "segment").agg(F.sum("n").alias("bn"), F.sum("k").alias("bk"))
        branches = stored(branches, "branches")
        parents = branches.groupBy("host", "template").agg(F.sum("bn").alias("pn"), F.sum("bk").alias("pk"))
        share = (F.col("pk") + 1.0) / (F.col("pn") + 2.0)
        apart = F.abs(F.col("bk") - F.col("bn") * share)
        error = F.sqrt(F.col("bn") * share * (1.0 - share))
        own = (F.col("bn") >= LEAST_LABELLED) & (apart >= DIFFERS * error)
        named = branches.join(parents, ["host", "template"])
        named = named.select("host", "template", "segment", F.when(own, F.col("segment")).otherwise("*").alias("name"))
        tree = tree.join(named, ["host", "template", "segment"], "left")
        longer = F.when(F.col("name").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), "name"))
        tree = tree.select("host", "shape", "n", "k", longer.alias("template"))
    return tree


def url_verdicts(pages: DataFrame, labels: DataFrame, rules: list[Rule]) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict``, ``template``, ``purity`` of all pages.

    ``pages`` has ``page_id`` and ``url``, ``labels`` has ``page_id`` and ``good``, 0 or 1,
    of repeated ones the larger.
    """
    url = F.col("url")
    pages = pages.select("page_id", url_host(url).alias("host"), url_path(url).alias("path"))
    pages = stored(pages.withColumn("shape", generalised(F.col("path"))), "pages")
    known = labels.select("page_id", "good").dropna().groupBy("page_id").agg(F.max("good").alias("good"))
    seen = pages.select("page_id", "host", "shape").join(known, "page_id", "left")
    counts = seen.groupBy("host", "shape").agg(
        F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).cast("long").alias("k")
    )
    tree = stored(template_tree(counts), "templates")
    total, good = tree.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("k"), F.lit(0))).first()
    overall = (good + 1.0) / (total + 2.0)
    hosts = tree.groupBy("host").agg(((F.sum("k") + WEIGHT * overall) / (F.sum("n") + WEIGHT)).alias("site"))
    templates = tree.groupBy("host", "template").agg(F.sum("n").alias("tn"), F.sum("k").alias("tk"))
    purity = (F.col("tk") + WEIGHT * F.col("site")) / (F.col("tn") + WEIGHT)
    judged = templates.join(hosts, "host").select("host", "template", purity.alias("purity"))
    shapes = tree.select("host", "shape", "template").join(judged, ["host", "template"])
    shapes = stored(shapes, "shapes")
    found = pages.join(shapes, ["host", "shape"])
    rule = fitting_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("purity") < LEAST_PURITY, "block").otherwise("allow")
    return found.withColumn("fit", rule).select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"),
        F.coalesce("fit.verdict", own).alias("verdict"), "template", "purity",
    )


def oracle(rules: list[Rule]) -> str:
    """The same verdicts as one SQL statement over ``pages`` and ``labels``."""
    ordered = sorted(rules, key=lambda r: (-len(r.host + r.path), r.host + r.path))
    fits = [
        f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')" for r in ordered
    ]
    rule = " ".join(f"WHEN {fit} THEN '{r.host}{r.path}'" for fit, r in zip(fits, ordered))
    verdict = " ".join(f"WHEN {fit} THEN '{r.verdict}'" for fit, r in zip(fits, ordered))
    levels = []
    for level in range(DEPTH + 1):
        levels.append(f"""
s{level} AS (SELECT *, CASE WHEN shape = '' THEN NULL ELSE list_extract(string_split(shape, '/'), {level + 1}) END AS segment FROM t{level}),
b{level} AS (SELECT host, template, segment, sum(n) AS bn, sum(k) AS bk FROM s{level} WHERE segment IS NOT NULL GROUP BY ALL),
p{level} AS (SELECT host, template, (sum(bk) + 1.0::DOUBLE) / (sum(bn) + 2.0::DOUBLE) AS share FROM b{level} GROUP BY ALL),
n{level} AS (SELECT b.host, b.template, b.segment, CASE WHEN bn >= {LEAST_LABELLED}
   AND abs(bk - bn * share) >= {DIFFERS}::DOUBLE * sqrt(bn * share * (1.0::DOUBLE - share)) THEN b.segment ELSE '*' END AS name
   FROM b{level} b JOIN p{level} p ON b.host = p.host AND b.template = p.template),
t{level + 1} AS (SELECT s.host, s.shape, s.n, s.k, CASE WHEN name IS NULL THEN s.template ELSE s.template || '/' || name END AS template
   FROM s{level} s LEFT JOIN n{level} n ON s.host = n.host AND s.template = n.template AND s.segment = n.segment)""")
    return rf"""
WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM a),
g AS (SELECT page_id, translate(raw, '{UPPER}', '{LOWER}') AS host,
             regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
w AS (SELECT *, list_filter(string_split(regexp_replace(path, '[0-9]+', '#', 'g'), '/'), lambda s: s <> '') AS parts FROM g),
page AS (SELECT page_id, host, path, array_to_string(parts[1:{DEPTH}], '/') || CASE WHEN len(parts) > {DEPTH} THEN '/**' ELSE '' END AS shape FROM w),
known AS (SELECT doc_id AS page_id, max(quality) AS good FROM labels WHERE quality IS NOT NULL GROUP BY 1),
t0 AS (SELECT host, shape, count(good) AS n, coalesce(sum(good), 0) AS k, '' AS template FROM page LEFT JOIN known USING (page_id) GROUP BY 1, 2),
{",".join(levels)},
tree AS (SELECT * FROM t{DEPTH + 1}),
overall AS (SELECT (coalesce(sum(k), 0) + 1.0::DOUBLE) / (coalesce(sum(n), 0) + 2.0::DOUBLE) AS share FROM tree),
site AS (SELECT host, (sum(k) + {WEIGHT}::DOUBLE * any_value(share)) / (sum(n) + {WEIGHT}::DOUBLE) AS site FROM tree, overall GROUP BY host),
judged AS (SELECT tree.host, template, (sum(k) + {WEIGHT}::DOUBLE * any_value(site)) / (sum(n) + {WEIGHT}::DOUBLE) AS purity
   FROM tree JOIN site ON tree.host = site.host GROUP BY ALL)
SELECT page_id, page.host, path, CASE {rule} END AS rule,
   CASE {verdict} WHEN purity < {LEAST_PURITY} THEN 'block' ELSE 'allow' END AS verdict, tree.template
FROM page JOIN tree ON page.host = tree.host AND page.shape = tree.shape
JOIN judged ON tree.host = judged.host AND tree.template = judged.template
""".replace("(host =", "(page.host =").replace("ends_with(host", "ends_with(page.host")
