"""The whole harvest: from menu pages over listings to product rows and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lavka.functions.text import fn_abs_url
from lavka.operators import catalogue


def absolute(links: DataFrame, pages: DataFrame, *columns: str) -> DataFrame:
    """Links of pages with these columns resolved against their page's address."""
    placed = links.join(pages.select("page_id", "url"), "page_id")
    return placed.withColumns({c: fn_abs_url(F.col("url"), F.col(c)) for c in columns}).drop("url")


def harvest_leaves(menus: DataFrame, skip: list[str], deep: list[str], depth_one_only: bool = False) -> DataFrame:
    """(cat, sub, subsub, leaf_url) of the leaf categories of stored menu pages.

    A category without links below stands for itself, a link without a name has its
    owner's. Addresses in ``skip`` go, those in ``deep`` are replaced by the entries
    below them; both are absolute, as are the leaves.
    """
    below = absolute(catalogue.submenu_links(menus), menus, "ancestor_path", "href")
    below = below.groupBy("ancestor_path", "href", "text").agg(F.min("depth").alias("depth"))
    heads = absolute(catalogue.menu_links(menus), menus, "href")
    heads = heads.groupBy(F.col("href").alias("path")).agg(F.min_by("text", "pos").alias("name"))
    reach = below.filter("depth = 1") if depth_one_only else below
    entries = catalogue.skip_list_filter(catalogue.self_fallback_join(heads, reach), skip)
    routed = catalogue.deep_category_route(entries, deep)
    plain = routed.filter("not deep").select(
        F.col("name").alias("cat"), F.col("text").alias("sub"), F.lit(None).cast("string").alias("subsub"), F.col("href").alias("leaf_url")
    )
    owners = routed.filter("deep").select(F.col("href").alias("path"), F.col("text").alias("name"))
    third = catalogue.self_fallback_join(owners.distinct(), below.filter("depth = 1"))
    third = third.select(F.col("path").alias("href"), F.col("href").alias("leaf_url"), F.col("text").alias("subsub"))
    nested = routed.filter("deep").join(third, "href")
    return catalogue.harvest_union(plain, nested.select(F.col("name").alias("cat"), F.col("text").alias("sub"), "subsub", "leaf_url"))


def harvested_links(leaves: DataFrame, listings: DataFrame) -> DataFrame:
    """(cat, sub, subsub, leaf_url, good_url) of the goods that leaves' stored pages list."""
    listed = catalogue.listing_links(listings).join(listings.select("page_id", F.col("url").alias("leaf_url")), "page_id")
    return catalogue.category_goods_join(leaves, listed.select("leaf_url", F.col("href").alias("good_url")))


def harvest(
    menus: DataFrame, listings: DataFrame, products: DataFrame, skip: list[str], deep: list[str], depth_one_only: bool = False
) -> DataFrame:
    """The product rows of a catalogue of stored pages, each (page_id, url, html), in one lazy plan.

    A product page that is missing or fails leaves an error row. Counts of the same
    links by category are ``goods_rollup`` of ``harvested_links``.
    """
    links = harvested_links(harvest_leaves(menus, skip, deep, depth_one_only), listings)
    named = links.select("good_url", catalogue.path_text("cat", "sub", "subsub").alias("path_text"))
    return catalogue.goods_detail_join(named, catalogue.product_records(products))
