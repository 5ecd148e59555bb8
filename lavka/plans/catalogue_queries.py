"""Queries of the harvest: page extraction, category tree, counts, outlines."""

from __future__ import annotations

from pyspark.sql import functions as F

from lavka.functions.text import fn_json_map
from lavka.operators import catalogue as ops
from lavka.plans import views
from lavka.plans.registry import query
from lavka.plans.source_queries import harvest, stored_outline
from lavka.plans.views import table

# Where the given pages keep what stands for product fields.
PAGE_SELECTORS = {"title": ("title", None, None), "code": ("h1", None, None), "price": (None, "class", "ad")}


# Page extraction


def _plain(field: str) -> str:
    return f"regexp_replace(regexp_replace({field}, '&quot;?', '\"', 'g'), '&amp;?', '&', 'g')"


TITLE, HEADING, AD = (f"regexp_extract(html, '<{tag}>([^<]*)</', 1)" for tag in ("title", "h1", 'div class="ad"'))


@query(f"SELECT page_id, {_plain(TITLE)} AS title, {_plain(HEADING)} AS code, trim({_plain(AD)}) AS price FROM pages")
def product_fields(spark, sf_dir):
    return ops.product_fields(table(spark, sf_dir, "pages", heavy=True), PAGE_SELECTORS)


@query(
    """SELECT good_id AS page_id, coalesce(array_to_string(list_filter(list_transform(string_split(description, chr(10)),
    lambda x: trim(x)), lambda x: x <> ''), chr(10)), '') AS description FROM goods WHERE sub <> 'Brand#13'""",
    "goods",
)
def product_description(spark, sf_dir):
    return ops.paragraph_join(ops.product_description(views.product_pages(spark, sf_dir)))


@query(
    """SELECT good_id AS page_id, 0 AS pos, 'Бренд' AS key, title AS value FROM goods
    WHERE description IS NOT NULL AND sub <> 'Brand#13' UNION ALL
    SELECT good_id, 1, 'Размер', subsub FROM goods WHERE description IS NOT NULL AND sub <> 'Brand#13' UNION ALL
    SELECT good_id, 2, 'Бренд', code FROM goods WHERE description IS NOT NULL AND sub <> 'Brand#13'""",
    "goods",
)
def product_characteristics(spark, sf_dir):
    return ops.product_characteristics(views.product_pages(spark, sf_dir))


@query(
    """SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS INTEGER) AS pos, href FROM (
    SELECT page_id, regexp_extract(url, '^([a-z]+://[^/]+)', 1) || href AS href, min(pos) AS pos
    FROM page_links JOIN pages USING (page_id) GROUP BY 1, 2)""",
    "page_links",
)
def listing_links(spark, sf_dir):
    return ops.listing_links(table(spark, sf_dir, "pages"), link_class=None)


@query(
    """SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS INTEGER) AS pos, href, text FROM (
    SELECT page_id, href, text, min(pos) AS pos FROM page_links GROUP BY page_id, href, text)""",
    "page_links",
)
def menu_links(spark, sf_dir):
    return ops.menu_links(table(spark, sf_dir, "pages"), link_class=None, within="nav")


@query(
    """SELECT DISTINCT cat_path AS ancestor_path, sub_path AS href, sub AS text, 1 AS depth FROM placed
    UNION ALL SELECT DISTINCT cat_path, subsub_path, subsub, 2 FROM placed
    UNION ALL SELECT DISTINCT sub_path, subsub_path, subsub, 1 FROM placed""",
    "placed",
)
def submenu_links(spark, sf_dir):
    return ops.submenu_links(views.menu_pages(spark, sf_dir)).select("ancestor_path", "href", "text", "depth")


def listed_links(spark, sf_dir):
    """Links of the pages, those with a text ending in a stop without address."""
    links = views.page_links(spark, sf_dir)
    return links.withColumn("href", F.when(~F.col("text").rlike("[.]$"), F.col("href")))


@query("SELECT page_id, pos, href, text FROM page_links WHERE text NOT LIKE '%.'", "page_links")
def nonempty_links(spark, sf_dir):
    return ops.nonempty_links(listed_links(spark, sf_dir))


@query("SELECT page_id, href, text, min(pos) AS pos FROM page_links GROUP BY page_id, href, text", "page_links")
def distinct_links(spark, sf_dir):
    return ops.distinct_links(views.page_links(spark, sf_dir))


@query("SELECT page_id, href, min(pos) AS pos FROM page_links GROUP BY page_id, href", "page_links")
def distinct_goods_urls(spark, sf_dir):
    return ops.distinct_goods_urls(views.page_links(spark, sf_dir))


@query("SELECT page_id, pos, href, text FROM page_links WHERE href NOT IN ('/de', '/the', '/in')", "page_links")
def skip_list_filter(spark, sf_dir):
    return ops.skip_list_filter(views.page_links(spark, sf_dir), ["/de", "/the", "/in"])


@query("SELECT page_id, pos, href, text, href = '/the' AS deep FROM page_links", "page_links")
def deep_category_route(spark, sf_dir):
    return ops.deep_category_route(views.page_links(spark, sf_dir), ["/the"])


@query(
    """SELECT good_id AS page_id, '{"Бренд":"' || code || '","Тип":"' || unit || '","Размер":"' || subsub || '"}' AS characteristics
    FROM shelf""",
    "shelf",
)
def characteristics_map(spark, sf_dir):
    cells = (("Бренд", "title"), ("Тип", "unit"), ("Размер", "subsub"), ("Бренд", "code"))
    pairs = F.array(*[F.struct(F.lit(key).alias("key"), F.col(column).alias("value")) for key, column in cells])
    rows = views.shelf(spark, sf_dir).select(F.col("good_id").alias("page_id"), F.posexplode(pairs).alias("pos", "pair"))
    maps = ops.characteristics_map(rows.select("page_id", "pos", "pair.key", "pair.value"))
    return maps.select("page_id", fn_json_map(F.col("characteristics")).alias("characteristics"))


@query(
    """SELECT doc_id AS page_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: x <> ''), chr(10)) AS description
    FROM documents"""
)
def paragraph_join(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return ops.paragraph_join(docs.select(F.col("doc_id").alias("page_id"), F.split("text", "\n").alias("paragraphs")))


# Category tree


@query(
    "SELECT path, name, href, text, depth, pos FROM cats JOIN category_links ON ancestor_path = path", "cats", "category_links"
)
def category_subcategory_join(spark, sf_dir):
    return ops.category_subcategory_join(views.cats(spark, sf_dir), views.category_links(spark, sf_dir))


SUBS = """SELECT s.href, s.text, l.href AS sub_href, l.text AS sub_text, l.pos FROM (SELECT href, text FROM cats
    JOIN category_links ON ancestor_path = path WHERE depth = 1) s JOIN category_links l ON l.ancestor_path = s.href"""


@query(SUBS, "cats", "category_links")
def subsubcategory_join(spark, sf_dir):
    links = views.category_links(spark, sf_dir)
    subs = ops.category_subcategory_join(views.cats(spark, sf_dir), links, depth_one_only=True)
    return ops.subsubcategory_join(subs, links)


@query(
    """SELECT path, name, coalesce(href, path) AS href, coalesce(nullif(text, ''), name) AS text
    FROM cats LEFT JOIN category_links ON ancestor_path = path""",
    "cats",
    "category_links",
)
def self_fallback_join(spark, sf_dir):
    return ops.self_fallback_join(views.cats(spark, sf_dir), views.category_links(spark, sf_dir))


@query("SELECT leaf_url, cat, sub, subsub, good_url FROM listing", "listing")
def category_goods_join(spark, sf_dir):
    return ops.category_goods_join(
        views.leaves(spark, sf_dir), views.listing(spark, sf_dir).select("leaf_url", "good_url")
    )


@query(
    """SELECT good_url, 'Путь в каталоге: ' || p.cat || ', ' || p.sub || ', ' || p.subsub
    || CASE WHEN gone THEN '. ERROR: ' || good_url ELSE '. ' || title END AS title,
    CASE WHEN gone THEN '' ELSE code END AS code, CASE WHEN gone THEN '' ELSE CAST(price AS VARCHAR) || 'руб.' END AS price,
    CASE WHEN gone THEN 'NotFound: no stored page' ELSE coalesce(array_to_string(list_filter(list_transform(
    string_split(description, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10)), '') END AS description,
    CASE WHEN gone OR description IS NULL THEN '{}' ELSE '{"Бренд":"' || code || '","Размер":"' || p.subsub || '"}' END AS characteristics
    FROM (SELECT *, sub = 'Brand#13' AS gone FROM placed) p JOIN goods g ON g.good_id = p.good_id""",
    "placed",
    "goods",
)
def goods_detail_join(spark, sf_dir):
    return harvest(spark, sf_dir).withColumn("characteristics", fn_json_map(F.col("characteristics")))


# Counts


@query(
    """SELECT l.leaf_url, l.cat, l.sub, l.subsub, count(g.good_url) AS n FROM leaves l
    LEFT JOIN listing g ON g.leaf_url = l.leaf_url GROUP BY l.leaf_url, l.cat, l.sub, l.subsub""",
    "leaves",
)
def goods_per_leaf(spark, sf_dir):
    return ops.goods_per_leaf(views.leaves(spark, sf_dir), views.listing(spark, sf_dir).select("leaf_url", "good_url"))


@query(
    """SELECT NULL AS cat, NULL AS sub, NULL AS subsub, count(*) AS n, 0 AS level FROM shelf
    UNION ALL SELECT cat, NULL, NULL, count(*), 1 FROM shelf GROUP BY cat
    UNION ALL SELECT cat, sub, NULL, count(*), 2 FROM shelf GROUP BY cat, sub
    UNION ALL SELECT cat, sub, subsub, count(*), 3 FROM shelf GROUP BY cat, sub, subsub""",
    "shelf",
)
def goods_rollup(spark, sf_dir):
    return ops.goods_rollup(views.shelf(spark, sf_dir))


@query("SELECT count(*) AS total FROM listing", "listing")
def goods_total(spark, sf_dir):
    return ops.goods_total(views.listing(spark, sf_dir))


@query(
    """SELECT good_id, cat, sub, CASE WHEN cat = 'SMALL' THEN subsub END AS subsub FROM shelf""",
    "shelf",
)
def harvest_union(spark, sf_dir):
    """The category with a third level and the others, appended to one table."""
    goods = views.shelf(spark, sf_dir)
    deep = goods.filter("cat = 'SMALL'").select("good_id", "cat", "sub", "subsub")
    return ops.harvest_union(deep, goods.filter("cat <> 'SMALL'").select("good_id", "cat", "sub"))


@query(
    """SELECT page_id, pos, href FROM page_links UNION ALL SELECT page_id, 0, url FROM pages""",
    "page_links",
)
def url_union_all(spark, sf_dir):
    own = table(spark, sf_dir, "pages").select("page_id", F.lit(0).alias("pos"), F.col("url").alias("href"))
    return ops.url_union_all(views.page_links(spark, sf_dir).select("page_id", "pos", "href"), own)


# Outlines

PARENTS = """SELECT doc, line_no, level, name, declared_count, cat_line, max(CASE WHEN level = 1 THEN name END)
    OVER (PARTITION BY doc, cat_line) AS cat, CASE WHEN level >= 2 THEN substr(sub_key, 9) END AS sub FROM (
    SELECT *, max(CASE level WHEN 2 THEN lpad(CAST(line_no AS VARCHAR), 8, '0') || name WHEN 1 THEN lpad(CAST(line_no AS VARCHAR), 8, '0') END)
    OVER (PARTITION BY doc ORDER BY line_no) AS sub_key,
    max(CASE WHEN level = 1 THEN line_no END) OVER (PARTITION BY doc ORDER BY line_no) AS cat_line FROM outline)"""


@query(PARENTS, "outline")
def outline_parent(spark, sf_dir):
    lines = stored_outline(spark, sf_dir).select("doc", "line_no", "level", "name", "declared_count")
    return ops.outline_parent(lines)


@query(
    f"""SELECT doc, cat_line, cat, max(CASE WHEN level = 1 THEN declared_count END) AS declared,
    CAST(sum(CASE WHEN level = 2 THEN declared_count END) AS BIGINT) AS subcat_sum,
    CAST(max(CASE WHEN level = 1 THEN declared_count END) - sum(CASE WHEN level = 2 THEN declared_count END) AS BIGINT) AS difference
    FROM ({PARENTS}) GROUP BY doc, cat_line, cat""",
    "outline",
)
def outline_reconcile(spark, sf_dir):
    return ops.outline_reconcile(stored_outline(spark, sf_dir))


@query(
    """SELECT cat, sub, subsub, declared_count FROM (SELECT l.leaf_url, l.cat, l.sub, l.subsub, count(g.good_url) AS declared_count
    FROM leaves l LEFT JOIN listing g ON g.leaf_url = l.leaf_url GROUP BY l.leaf_url, l.cat, l.sub, l.subsub) WHERE declared_count > 0""",
    "leaves",
)
def nonempty_category(spark, sf_dir):
    volumes = goods_per_leaf(spark, sf_dir).withColumnRenamed("n", "declared_count")
    return ops.nonempty_category(volumes).select("cat", "sub", "subsub", "declared_count")


@query(
    """SELECT p_partkey AS request_id, p_type AS cat, n AS search_limit FROM part
    JOIN (SELECT p_type AS cat, count(*) AS n FROM part GROUP BY p_type) ON cat = p_type"""
)
def category_volume_join(spark, sf_dir):
    """Every part asks for a price overview of its own category."""
    part = table(spark, sf_dir, "part")
    volumes = part.groupBy(F.col("p_type").alias("cat")).agg(F.count("*").alias("declared_count"))
    requests = part.select(F.col("p_partkey").alias("request_id"), F.col("p_type").alias("cat"))
    return ops.category_volume_join(requests, volumes)
