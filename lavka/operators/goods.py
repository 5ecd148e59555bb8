"""Goods chunks, descriptions and price bands."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from lavka.functions.text import (
    CODE_LABEL,
    ID_PREFIX,
    PRICE_LABEL,
    RUB_LABEL,
    UNIT_LABEL,
    clamp_text,
    fn_floor_div,
    fn_head,
    fn_join_space,
    fn_number_to_text,
    fn_regex_first,
    fn_slice,
    fn_strip,
    null_to_text,
)
from lavka.operators.skew import spread_join
from lavka.session import stored

# How much of a description a request of one id, or of more, gets.
ONE_ID_LENGTH, MANY_IDS_LENGTH = 1400, 800
# Items in the cheap and dear bands, half of the middle band.
BAND, HALF_BAND = 15, 7

LOOKUP_FOLDERS = 31  # folders of goods stored for look-ups; more of them leave less to read for few ids
NAMED_IDS = 1000  # ids that are handed to the files by name
SENT_BYTES = 8 << 20  # stored size of goods that are sent to every task of the requests
SIFTED_IDS = 4_000_000  # ids whose hashes are sent to every task of the goods,
BITS_PER_ID = 16  # so many bits for each; of 16 goods that nobody asks for about one passes
PAGE_BITS = 1 << 15  # bits of one bitmap, as Spark's functions lay them out


def chunk_text(name: Column, unit: Column, price: Column) -> Column:
    """Null where the name or the unit is missing."""
    return F.concat(
        name, F.lit(". " + UNIT_LABEL), unit, F.lit(". " + PRICE_LABEL + " "), fn_number_to_text(price)
    )


def goods_chunk_text(goods: DataFrame) -> DataFrame:
    """(name, unit, price, ...) with the searchable text of each good as content."""
    return goods.withColumn("content", chunk_text(F.col("name"), F.col("unit"), F.col("price")))


def goods_chunk_with_id(goods: DataFrame, with_characteristics: bool = True, *kept: str) -> DataFrame:
    """(good_id, title, unit, price, characteristics, ...) to (id, content, the columns to be kept), the text
    starting ``ID <n> ``."""
    name = F.col("title")
    if with_characteristics:
        name = F.concat(name, F.lit(". "), null_to_text(F.col("characteristics")))
    text = chunk_text(name, F.col("unit"), F.col("price"))
    return goods.select(
        F.col("good_id").alias("id"), F.concat(F.lit(ID_PREFIX), F.col("good_id"), F.lit(" "), text).alias("content"), *kept
    )


def chunk_id_extract(chunks: DataFrame) -> DataFrame:
    found = fn_regex_first(F.col("content"), rf"^{ID_PREFIX}(\d+)").try_cast("bigint")
    return chunks.withColumn("chunk_good_id", found)


def price_in_chunk(content: Column, label: str = PRICE_LABEL) -> Column:
    """The whole roubles behind the label; digit groups may be split by any
    kind of space, a fraction is dropped."""
    digits = fn_regex_first(content, rf"(?U)\Q{label}\E\s*(\d[\d\s]*)")
    return F.regexp_replace(digits, r"(?U)\s", "").try_cast("bigint")


def chunk_price_extract(chunks: DataFrame, label: str = PRICE_LABEL) -> DataFrame:
    return chunks.withColumn("price", price_in_chunk(F.col("content"), label))


def priced_chunks_only(chunks: DataFrame) -> DataFrame:
    return chunks.filter(F.col("price").isNotNull())


# Price bands


def sort_by_price(hits: DataFrame, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Place of each priced hit of a query by price, equal prices keeping their
    rank order, and the number of hits. A query has at most as many hits as its
    search limit asked for."""
    by_query = Window.partitionBy(*keys)
    return hits.withColumns(
        {
            "price_pos": (F.row_number().over(by_query.orderBy("price", "rank")) - 1).cast("bigint"),
            "n_hits": F.count("*").over(by_query),
        }
    )


def price_band(
    hits: DataFrame, flag: str = "flag", search_limit: str = "search_limit", keys: tuple[str, ...] = ("query_id",)
) -> DataFrame:
    """Slice of the price-sorted hits: flag 1 the cheapest, 2 the middle, 3 the
    dearest; the slice is taken by the padded search limit, not by the number
    found, with list-slice rules for bounds below zero. Other flags give nothing."""
    limit = F.col(search_limit)
    bounds = _bounds(F.col(flag), limit, limit - 1)
    return sort_by_price(hits, keys).filter(fn_slice(F.col("price_pos"), F.col("n_hits"), *bounds))


def price_band_found(hits: DataFrame, flag: str = "flag", keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The same bands taken by the number of hits found: the first 15, the 14
    around the middle, the last 15, as far as there are that many."""
    n, pos = F.col("n_hits"), F.col("price_pos")
    start, end = _bounds(F.col(flag), n, n)
    return sort_by_price(hits, keys).filter((pos >= F.greatest(F.lit(0), start)) & (pos < end))


def _bounds(flag: Column, length: Column, dear_end: Column) -> tuple[Column, Column]:
    """Start and end of the band in a list of the given length."""
    half = fn_floor_div(length, F.lit(2))
    start = F.when(flag == 1, F.lit(0)).when(flag == 2, half - HALF_BAND).when(flag == 3, length - BAND)
    end = F.when(flag == 1, F.lit(BAND)).when(flag == 2, half + HALF_BAND).when(flag == 3, dear_end)
    return start, end


# Descriptions


def good_by_id(goods: DataFrame, good_id: int) -> DataFrame:
    return goods.filter(F.col("good_id") == good_id)


def clamp_by_request_size(rows: DataFrame, one: int = ONE_ID_LENGTH, many: int = MANY_IDS_LENGTH) -> DataFrame:
    """Shorten ``description`` by the number of ids in its request (``n_ids``)."""
    length = F.when(F.col("n_ids") == 1, one).otherwise(many)
    return rows.withColumn("description", clamp_text(F.col("description"), length))


def description_text() -> Column:
    """Title, code, price, characteristics and description in one text."""
    return fn_strip(
        fn_join_space(
            null_to_text(F.col("title")),
            F.concat(F.lit(CODE_LABEL), null_to_text(F.col("code")), F.lit(".")),
            F.concat(F.lit(RUB_LABEL), null_to_text(F.col("price")), F.lit(".")),
            F.col("characteristics"),
            F.col("description"),
        )
    )


def _priced_as_text(goods: DataFrame) -> DataFrame:
    """A numeric price written out as plain decimal text."""
    if goods.schema["price"].dataType.typeName() in ("double", "float"):
        price = F.when(F.col("price").isNotNull(), fn_number_to_text(F.col("price")))
        return goods.withColumn("price", price)
    return goods


def goods_description_text(goods: DataFrame) -> DataFrame:
    return _priced_as_text(goods).select("good_id", description_text().alias("text"))


class GoodsLookup(NamedTuple):
    """Goods stored for look-ups: one row per id, in folders by a hash of it."""

    goods: DataFrame
    folders: int


def _folder(good_id: Column, folders: int) -> Column:
    return F.pmod(F.xxhash64(good_id), F.lit(folders)).cast("int")


def write_goods_lookup(goods: DataFrame, path: str, folders: int = LOOKUP_FOLDERS) -> None:
    """Store one row for each id below ``path``, of several that which sorts first. Files are sorted by id and
    hold a Bloom filter of their ids, so a look-up of few ids reads few folders, and of those few row groups."""
    rows = _priced_as_text(goods).select("good_id", F.struct("title", "code", "price", "characteristics", "description").alias("row"))
    rows = rows.groupBy("good_id").agg(F.min("row").alias("row")).select("good_id", "row.*")
    rows = rows.withColumn("folder", _folder(F.col("good_id"), folders)).hint("rebalance", F.col("folder"))
    writer = rows.sortWithinPartitions("folder", "good_id").write.partitionBy("folder")
    writer = writer.option("parquet.bloom.filter.enabled#good_id", "true")
    writer.option("parquet.bloom.filter.adaptive.enabled", "true").parquet(path)


def open_goods_lookup(spark: SparkSession, path: str, folders: int = LOOKUP_FOLDERS) -> GoodsLookup:
    return GoodsLookup(spark.read.parquet(path), folders)


def goods_of_ids(ids: DataFrame, goods: GoodsLookup) -> DataFrame:
    """The stored goods whose ``good_id`` is among ``ids``. Only folders that hold one of them are
    listed; where the ids are few enough to be named, the files' own filters skip most of the rest."""
    folder = _folder(F.col("good_id"), goods.folders)
    wanted = ids.groupBy(folder.alias("folder")).agg(F.min("good_id").alias("low"), F.max("good_id").alias("high")).collect()  # one row per folder
    named = [r.good_id for r in ids.limit(NAMED_IDS + 1).collect()]
    rows = goods.goods.filter(F.col("folder").isin([r.folder for r in wanted]))
    if len(named) <= NAMED_IDS:
        return rows.filter(F.col("good_id").isin(named)).drop("folder")
    within = F.col("good_id").between(min(r.low for r in wanted), max(r.high for r in wanted))
    return rows.filter(within).join(ids, "good_id", "left_semi").drop("folder")


def sifted(goods: DataFrame, ids: DataFrame) -> DataFrame:
    """Goods without most of those whose ``good_id`` is not among ``ids``, by a bit for each hash of an id. As it is
    a condition on the id alone, Spark applies it to every table that the goods are joined from by their id, so
    texts nobody asks for are dropped where they are read. Too many ids to be sent leave the goods as they are."""
    count = ids.count()
    if not count or count > SIFTED_IDS or goods.schema["good_id"].dataType != LongType() or ids.schema["good_id"].dataType != LongType():
        return goods
    pages = -(-count * BITS_PER_ID // PAGE_BITS)
    at = F.pmod(F.xxhash64("good_id"), F.lit(pages * PAGE_BITS))
    bit = at.bitwiseAND(F.lit(PAGE_BITS - 1))
    held = ids.groupBy(F.shiftright(at, 15).cast("int").alias("page")).agg(F.bitmap_construct_agg(bit).alias("bits"))
    by_page = F.map_from_entries(F.collect_list(F.struct("page", "bits")))
    known = held.agg(F.transform(F.sequence(F.lit(0), F.lit(pages - 1)), lambda page: by_page[page]).alias("known")).scalar()
    byte = F.substring(F.get(known, F.shiftright(at, 15).cast("int")), (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))
    return goods.filter(F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), bit.bitwiseAND(F.lit(7)).cast("int")) == 1)


def descriptions_by_ids(requests: DataFrame, goods: DataFrame | GoodsLookup) -> DataFrame:
    """(request_id, ids array<bigint>) to one row per id in the given order; an
    unknown id keeps its place with an empty text.

    The size of a request comes from its array, so no group is formed. Goods
    nobody asks for are left behind, at best unread (see ``write_goods_lookup``), and no more of a description
    than decides its shortening goes on. What is asked for is written once, so its size is known: goods of a
    proven small size go to the requests, which stay where they are; else both are shuffled by id, an id that
    a large share of all requests asks for being dealt over several tasks. Of an id stored more than once the
    row that sorts first is taken.
    """
    asked = requests.select("request_id", F.size("ids").alias("n_ids"), F.posexplode("ids").alias("pos", "good_id"))
    ids = stored(asked.select("good_id").filter("good_id is not null").distinct(), "asked-ids")
    found = goods_of_ids(ids, goods) if isinstance(goods, GoodsLookup) else sifted(goods, ids).join(ids, "good_id", "left_semi")
    needed = _priced_as_text(found).select(
        "good_id",
        "title",
        "code",
        "price",
        "characteristics",
        fn_head(F.col("description"), ONE_ID_LENGTH + 1).alias("description"),
        F.lit(True).alias("known"),
    )
    if not isinstance(goods, GoodsLookup):
        row = F.struct(*[c for c in needed.columns if c != "good_id"])
        needed = needed.groupBy("good_id").agg(F.min(row).alias("row")).select("good_id", "row.*")
    needed = stored(needed, "asked-goods")
    size = needed._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if size <= SENT_BYTES:
        joined = asked.join(F.broadcast(needed), "good_id", "left_outer")
    else:
        joined = spread_join(asked, needed, "good_id", "left_outer")
    return clamp_by_request_size(joined).select(
        "request_id",
        "pos",
        "good_id",
        F.when(F.col("known"), description_text()).otherwise("").alias("description"),
    )
