"""Harvest of stored pages: links, category tree, product records, counts."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lavka.functions import html_pass
from lavka.functions.links import addresses, anchors
from lavka.functions.text import (
    PATH_LABEL,
    fn_abs_url,
    fn_join_newline,
    null_to_text,
    product_code_trim,
)
from lavka.operators.skew import spread_join

# Where a product page keeps its parts, (tag, attribute, value).
PRODUCT_SELECTORS = {
    "title": (None, "class", "catalog-detail__title"),
    "code": (None, "class", "catalog-detail__code"),
    "price": (None, "class", "catalog-detail__price"),
    "description": (None, "data-tab", "description"),
}
OFFER_CLASS = "offer__title"
MENU_CLASS, SUBMENU_LIST_CLASS, SUBMENU_CLASS = "sidebar-menu__link", "sidebar-submenu", "sidebar-submenu__link"

_PRODUCT_PARTS = {
    "title": "string",
    "code": "string",
    "price": "string",
    "paragraphs": "array<string>",
    "pairs": "array<struct<key:string,value:string>>",
}
_MENU_SCHEMA = "page_id long, ancestor_path string, href string, text string, depth int, pos int"


# Page extraction


def page_products(
    pages: DataFrame,
    selectors: dict = PRODUCT_SELECTORS,
    key: str = "page_id",
    parts: tuple[str, ...] = tuple(_PRODUCT_PARTS),
    last_pairs: bool = False,
) -> DataFrame:
    """The wanted product parts of a page in one pass, no others leave the walk;
    a failing page is an error row."""
    kept = pages.select(key, "html")
    listed = "".join(f", {name} {_PRODUCT_PARTS[name]}" for name in parts)
    schema = f"{key} {kept.schema[key].dataType.simpleString()}{listed}, error string"
    walk = partial(html_pass.read_products, selectors=selectors, parts=parts, last_pairs=last_pairs)
    return kept.mapInPandas(walk, schema)


def product_fields(pages: DataFrame, selectors: dict = PRODUCT_SELECTORS) -> DataFrame:
    parts = ("title", "code", "price")
    return page_products(pages, selectors, parts=parts).select("page_id", *parts)


def product_description(pages: DataFrame, selectors: dict = PRODUCT_SELECTORS) -> DataFrame:
    return page_products(pages, selectors, parts=("paragraphs",)).select("page_id", "paragraphs")


def product_characteristics(pages: DataFrame, selectors: dict = PRODUCT_SELECTORS) -> DataFrame:
    """One row per two-cell table row, in document order."""
    found = page_products(pages, selectors, parts=("pairs",)).select("page_id", F.posexplode("pairs").alias("pos", "pair"))
    return found.select("page_id", "pos", "pair.key", "pair.value")


def last_value_map(pairs: Column) -> Column:
    """array<struct<key, value>> to a map in the order keys first appear, the
    last value of a key winning. Works on one row, so nothing is shuffled."""
    keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    last = lambda key: F.element_at(F.filter(pairs, lambda p: p["key"] == key), -1)["value"]
    return F.map_from_arrays(keys, F.transform(keys, last))


def characteristics_map(pairs: DataFrame) -> DataFrame:
    """(page_id, pos, key, value) to one map per page: the last of equal keys
    wins. Repeats are folded inside each task first, so what meets per page is
    bounded by its distinct keys."""
    last = pairs.groupBy("page_id", "key").agg(F.max_by("value", "pos").alias("value"), F.min("pos").alias("pos"))
    entries = F.array_sort(F.collect_list(F.struct("pos", "key", "value")))
    ordered = F.transform(entries, lambda e: F.struct(e["key"], e["value"]))
    return last.groupBy("page_id").agg(F.map_from_entries(ordered).alias("characteristics"))


def paragraph_join(rows: DataFrame) -> DataFrame:
    """Non-empty paragraph texts, one per line."""
    filled = F.filter("paragraphs", lambda p: p != "")
    return rows.select("page_id", fn_join_newline(filled).alias("description"))


def product_records(pages: DataFrame, selectors: dict = PRODUCT_SELECTORS) -> DataFrame:
    """(url, html) to (url, title, code, price, description, characteristics, error)."""
    return page_products(pages, selectors, key="url", last_pairs=True).select(
        "url",
        "title",
        "code",
        "price",
        fn_join_newline(F.filter("paragraphs", lambda p: p != "")).alias("description"),
        F.map_from_entries("pairs").alias("characteristics"),
        "error",
    )


def nonempty_links(links: DataFrame) -> DataFrame:
    return links.filter(F.col("href") != "")


def distinct_links(links: DataFrame) -> DataFrame:
    """Each (href, text) of a page once, at its first position."""
    return links.groupBy("page_id", "href", "text").agg(F.min("pos").alias("pos"))


def distinct_goods_urls(links: DataFrame) -> DataFrame:
    """Each href of a listing once, at its first position."""
    return links.groupBy("page_id", "href").agg(F.min("pos").alias("pos"))


def page_links(pages: DataFrame, link_class: str | None = None, within: str | None = None) -> DataFrame:
    """(page_id, pos, href, text) of every link, repeats kept."""
    found = F.posexplode(anchors(F.col("html"), link_class, within)).alias("pos", "link")
    return pages.select("page_id", found).select("page_id", "pos", "link.href", "link.text")


def listing_links(pages: DataFrame, link_class: str | None = OFFER_CLASS) -> DataFrame:
    """Product links of listing pages, absolute, each once in document order.
    Repeats are dropped inside the page's own row: no shuffle."""
    found = F.array_distinct(F.filter(addresses(F.col("html"), link_class), lambda href: href != ""))
    urls = F.array_distinct(F.transform(found, lambda href: fn_abs_url(F.col("url"), href)))
    return pages.select("page_id", F.posexplode(urls).alias("pos", "href"))


def menu_links(pages: DataFrame, link_class: str | None = MENU_CLASS, within: str | None = None) -> DataFrame:
    """Category links of the site menu, each (href, text) once in document order."""
    found = F.filter(anchors(F.col("html"), link_class, within), lambda a: a["href"] != "")
    listed = pages.select("page_id", F.posexplode(F.array_distinct(found)).alias("pos", "link"))
    return listed.select("page_id", "pos", "link.href", "link.text")


def submenu_links(
    pages: DataFrame,
    menu_class: str = MENU_CLASS,
    list_class: str = SUBMENU_LIST_CLASS,
    link_class: str = SUBMENU_CLASS,
) -> DataFrame:
    """Links at any depth below each menu entry, one row per owner and link."""
    walk = partial(html_pass.read_menus, menu_class=menu_class, list_class=list_class, link_class=link_class)
    return pages.select("page_id", "html").mapInPandas(walk, _MENU_SCHEMA)


# Category tree


def skip_list_filter(links: DataFrame, urls: list[str]) -> DataFrame:
    return links.filter(~F.col("href").isin(urls))


def deep_category_route(links: DataFrame, urls: list[str]) -> DataFrame:
    """Mark the subcategories that have a third level of their own."""
    return links.withColumn("deep", F.col("href").isin(urls))


def category_subcategory_join(cats: DataFrame, links: DataFrame, depth_one_only: bool = False) -> DataFrame:
    """(path, name) of categories with all links below their menu entry, third
    level included unless ``depth_one_only``."""
    below = links.filter("depth = 1") if depth_one_only else links
    return cats.join(below.withColumnRenamed("ancestor_path", "path"), "path")


def subsubcategory_join(subs: DataFrame, links: DataFrame) -> DataFrame:
    """Subcategory links (href, text) with the links below their own entry."""
    below = links.select(
        F.col("ancestor_path").alias("href"), F.col("href").alias("sub_href"), F.col("text").alias("sub_text"), "pos"
    )
    return subs.select("href", "text").join(below, "href")


def self_fallback_join(parents: DataFrame, children: DataFrame) -> DataFrame:
    """(path, name) with its children; an entry without any stands for itself
    and a child without a name takes the parent's."""
    below = children.select(F.col("ancestor_path").alias("path"), "href", "text")
    return parents.join(below, "path", "left_outer").select(
        "path",
        "name",
        F.coalesce("href", "path").alias("href"),
        F.coalesce(F.nullif("text", F.lit("")), "name").alias("text"),
    )


def category_goods_join(leaves: DataFrame, listing: DataFrame) -> DataFrame:
    """Leaf categories (leaf_url, ...) with their product links (leaf_url,
    good_url). A leaf holding most of the goods is split by AQE."""
    return leaves.join(listing, "leaf_url")


def catalogue_path_title(rows: DataFrame) -> DataFrame:
    """``Путь в каталоге: cat, sub[, subsub]. title`` as path_title."""
    return rows.withColumn(
        "path_title", F.concat(path_text("cat", "sub", "subsub"), F.lit(". "), null_to_text(F.col("title")))
    )


def path_text(*levels: str) -> Column:
    """The path of the levels that are present."""
    return F.concat(F.lit(PATH_LABEL), F.concat_ws(", ", *levels))


def goods_detail_join(goods_links: DataFrame, details: DataFrame) -> DataFrame:
    """Product links (good_url, path_text) with the extracted pages; a page that
    is missing or failed leaves an error row and the others go on."""
    found = goods_links.join(details.withColumnRenamed("url", "good_url"), "good_url", "left_outer")
    reason = F.when(F.col("title").isNull(), F.lit("NotFound: no stored page")).otherwise(F.col("error"))
    failed = reason.isNotNull()
    empty_map = F.create_map().cast("map<string,string>")

    def kept(value: Column, otherwise: Column = F.lit("")) -> Column:
        return F.when(failed, otherwise).otherwise(value)

    return found.select(
        "good_url",
        F.concat(
            "path_text", kept(F.concat(F.lit(". "), "title"), F.concat(F.lit(". ERROR: "), "good_url"))
        ).alias("title"),
        kept(product_code_trim(F.col("code"))).alias("code"),
        kept(F.col("price")).alias("price"),
        kept(F.col("description"), reason).alias("description"),
        kept(F.col("characteristics"), empty_map).alias("characteristics"),
    )


def harvest_union(*frames: DataFrame) -> DataFrame:
    """One table of all harvested parts; a level a part lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def url_union_all(*frames: DataFrame) -> DataFrame:
    """All link lists in one, repeats kept."""
    return reduce(DataFrame.union, frames)


# Counts


def goods_per_leaf(leaves: DataFrame, listing: DataFrame) -> DataFrame:
    """Number of product links per leaf category, 0 for an empty one. Counted
    before the join, so no leaf is ever gathered."""
    counts = listing.groupBy("leaf_url").agg(F.count("*").alias("n"))
    return leaves.join(counts, "leaf_url", "left_outer").withColumn("n", F.coalesce("n", F.lit(0)))


def goods_rollup(goods: DataFrame, depth_one_only: bool = True) -> DataFrame:
    """Counts of (cat, sub, subsub) added up per level; level 0 is the total.

    Rows are counted per leaf first and only the counts are expanded. With
    ``depth_one_only`` off, third-level entries also stand directly under their
    category, as a menu read at any depth lists them, and so count twice there.
    """
    counts = goods.groupBy("cat", "sub", "subsub").agg(F.count("*").alias("n"))
    if not depth_one_only:
        again = counts.filter("subsub is not null").select(
            "cat", F.col("subsub").alias("sub"), F.lit(None).cast("string").alias("subsub"), "n"
        )
        counts = counts.unionByName(again)
    level = F.lit(3) - F.bit_count(F.grouping_id())
    return (
        counts.rollup("cat", "sub", "subsub")
        .agg(F.sum("n").alias("n"), level.cast("int").alias("level"))
        .filter("level < 3 or subsub is not null")
    )


def goods_total(links: DataFrame) -> DataFrame:
    return links.agg(F.count("*").alias("total"))


# Outline texts


def outline_parent(lines: DataFrame) -> DataFrame:
    """Give each outline line (doc, line_no, level, name, ...) its category and,
    below it, its subcategory. A document is one text read whole, which bounds
    the group."""
    upto = Window.partitionBy("doc").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)

    def current(level: int) -> Column:
        return F.last(F.when(F.col("level") == level, F.struct("line_no", "name")), ignorenulls=True).over(upto)

    cat, sub = F.col("cat_at"), F.col("sub_at")
    own = (F.col("level") >= 2) & (sub["line_no"] > cat["line_no"])
    return lines.withColumns({"cat_at": current(1), "sub_at": current(2)}).select(
        *lines.columns,
        cat["line_no"].alias("cat_line"),
        cat["name"].alias("cat"),
        F.when(own, sub["name"]).alias("sub"),
    )


def outline_reconcile(outline: DataFrame) -> DataFrame:
    """Declared count of each category against the sum of its direct
    subcategories; a category without any is compared with nothing."""
    count = F.col("declared_count")
    return (
        outline_parent(outline)
        .groupBy("doc", "cat_line")
        .agg(
            F.max(F.when(F.col("level") == 1, F.col("name"))).alias("cat"),
            F.max(F.when(F.col("level") == 1, count)).alias("declared"),
            F.sum(F.when(F.col("level") == 2, count)).alias("subcat_sum"),
        )
        .withColumn("difference", F.col("declared") - F.col("subcat_sum"))
    )


def nonempty_category(volumes: DataFrame) -> DataFrame:
    """Categories whose declared volume is above zero."""
    return volumes.filter(F.col("declared_count") > 0)


def category_volume_join(requests: DataFrame, outline: DataFrame) -> DataFrame:
    """Price requests on a category get its volume as their search limit. A
    category of many requests is dealt over several tasks."""
    volumes = outline.select("cat", F.col("declared_count").alias("search_limit"))
    return spread_join(requests, volumes, "cat")
