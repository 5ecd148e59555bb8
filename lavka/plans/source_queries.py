"""Queries of scans, sinks, loading and text rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from lavka.functions import text as fn
from lavka.operators import catalogue, goods as ops, harvest as harvesting, ingest, tools
from lavka.plans import views
from lavka.plans.registry import query
from lavka.plans.views import table
from lavka.session import shared_folder
from lavka.sources import sinks, tables
from lavka.streaming.ingest import ingest_stream as start_ingest, loaded_rows

# Scans and sinks


def parquet_sheet(spark, sf_dir):
    return tables.scan_goods_sheet(spark, f"{sf_dir}/part.parquet", positions=(1, 3, 5))


@query("SELECT replace(p_name, ' ', chr(10)) AS name, p_type AS unit, p_retailprice AS price FROM part")
def scan_goods_sheet(spark, sf_dir):
    """A CSV export whose cells hold line breaks, commas and quotes."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    number = quoted(F.concat(F.lit('No "'), F.col("p_partkey").cast("string"), F.lit('",\n\n"')))
    name = quoted(F.replace("p_name", F.lit(" "), F.lit("\n")))
    cells = [number, F.lit(""), name, F.col("p_brand"), quoted(F.col("p_type")), F.col("p_retailprice").cast("string")]
    path = shared_folder(spark, "goods-sheet")
    table(spark, sf_dir, "part").select(F.concat_ws(",", *cells)).write.text(path)
    return tables.scan_goods_sheet(spark, path, header_lines=0)


@query("SELECT good_id, title, code, price, characteristics, description FROM goods", "goods")
def scan_about_goods(spark, sf_dir):
    path = shared_folder(spark, "about-goods")
    views.goods(spark, sf_dir).write.parquet(path)
    return tables.scan_about_goods(spark, path)


#: Stored vectors are compared number by number, one row each.
READ_BACK = "SELECT id, content, unnest(range(len(embedding))) AS place, CAST(unnest(embedding) AS DOUBLE) AS number FROM {}"


def read_back(found):
    rows = found.select("id", "content", F.posexplode("embedding").alias("place", "number"))
    return rows.select("id", "content", F.col("place").cast("long"), F.col("number").cast("double"))


@query("SELECT page_id, url, html FROM pages")
def scan_pages(spark, sf_dir):
    return tables.scan_pages(spark, f"{sf_dir}/pages.parquet")


@query(READ_BACK.format("collection"), "collection")
def scan_collection(spark, sf_dir):
    root = shared_folder(spark, "collections")
    sinks.sink_collection(views.collection(spark, sf_dir), tools.FULL_COLLECTION, root)
    found = tables.scan_collection(spark, tools.FULL_COLLECTION, root)
    return read_back(found)


def stored_outline(spark, sf_dir):
    path = shared_folder(spark, "outline")
    views.outline(spark, sf_dir).repartition("doc").write.partitionBy("doc").text(path)
    return tables.scan_outline(spark, path)


@query("SELECT doc, line_no, line, level, name, declared_count, note FROM outline", "outline")
def scan_outline(spark, sf_dir):
    return stored_outline(spark, sf_dir)


#: Every category skips one of its subcategories and goes a level deeper in another.
CATEGORIES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
SKIPPED = [f"{views.SHOP}/catalog/{cat}/Brand-21/" for cat in CATEGORIES]
DEEP = [f"{views.SHOP}/catalog/{cat}/Brand-{n}/" for cat in CATEGORIES for n in (11, 13, 22)]


def whole_harvest(spark, sf_dir):
    menus = views.menu_pages(spark, sf_dir).withColumn("url", F.lit(views.SHOP + "/"))
    products = views.product_pages(spark, sf_dir)
    return harvesting.harvest(menus, views.listing_pages(spark, sf_dir), products, SKIPPED, DEEP, depth_one_only=True)


@query(
    """SELECT 'Путь в каталоге: ' || p.cat || ', ' || p.sub || CASE WHEN p.sub IN ('Brand#11', 'Brand#13', 'Brand#22') THEN ', ' || p.subsub ELSE '' END
    || CASE WHEN gone THEN '. ERROR: ' || good_url ELSE '. ' || title END AS title,
    CASE WHEN gone THEN '' ELSE code END AS code, CASE WHEN gone THEN '' ELSE CAST(price AS VARCHAR) || 'руб.' END AS price,
    CASE WHEN gone THEN 'NotFound: no stored page' ELSE coalesce(array_to_string(list_filter(list_transform(
    string_split(description, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10)), '') END AS description,
    CASE WHEN gone OR description IS NULL THEN '{}' ELSE '{"Бренд":"' || code || '","Размер":"' || p.subsub || '"}' END AS characteristics
    FROM (SELECT *, sub = 'Brand#13' AS gone FROM placed WHERE sub <> 'Brand#21') p JOIN goods g ON g.good_id = p.good_id""",
    "placed",
    "goods",
)
def sink_goods_table(spark, sf_dir):
    path = shared_folder(spark, "harvest")
    sinks.sink_goods_table(whole_harvest(spark, sf_dir), path)
    found = spark.read.parquet(path).select("title", "code", "price", "description", "characteristics")
    return found.withColumn("characteristics", fn.fn_json_map(F.col("characteristics")))


@query(READ_BACK.format("brief_collection"), "brief_collection")
def sink_collection(spark, sf_dir):
    root = shared_folder(spark, "collections")
    sinks.sink_collection(views.brief_collection(spark, sf_dir), tools.BRIEF_COLLECTION, root)
    return read_back(spark.read.parquet(f"{root}/{tools.BRIEF_COLLECTION}"))


@query(
    """SELECT pos, name, unit, price FROM (SELECT *, floor(pos / 30) AS batch,
    sum(CASE WHEN name IS NULL OR unit IS NULL THEN 1 ELSE 0 END) OVER (ORDER BY floor(pos / 30)
    RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM defects)
    WHERE coalesce(before, 0) <= 5 AND name IS NOT NULL AND unit IS NOT NULL""",
    "defects",
)
def ingest_error_budget(spark, sf_dir):
    return ingest.ingest_error_budget(views.defects(spark, sf_dir), missing())


@query(
    """SELECT count(*) AS failed, min(pos) AS first_pos, arg_min(name, pos) AS first_name, arg_min(unit, pos) AS first_unit,
    arg_min(price, pos) AS first_price FROM (SELECT pos, coalesce(name, '-') AS name, coalesce(unit, '-') AS unit, price FROM
    (SELECT *, sum(CASE WHEN name IS NULL OR unit IS NULL THEN 1 ELSE 0 END) OVER (ORDER BY floor(pos / 30)
    RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM defects)
    WHERE (name IS NULL OR unit IS NULL) AND coalesce(before, 0) <= 5)""",
    "defects",
)
def failed_rows_report(spark, sf_dir):
    report = ingest.failed_rows_report(views.defects(spark, sf_dir), missing())
    return report.fillna("-", ["first_name", "first_unit"])


def missing():
    return F.col("name").isNull() | F.col("unit").isNull()


@query(
    """SELECT pos, content, CASE WHEN coalesce(before, 0) > 5 THEN 'not_loaded' WHEN content IS NULL THEN 'bad' ELSE 'accepted' END AS state
    FROM (SELECT *, sum(CASE WHEN content IS NULL THEN 1 ELSE 0 END) OVER (ORDER BY floor(pos / 30)
    RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (SELECT pos, name || '. Единица (измерения) хранения остатков: '
    || unit || '. Цена за единицу в рублях: ' || CAST(price AS VARCHAR) AS content FROM defects))""",
    "defects",
)
def ingest_stream(spark, sf_dir):
    """Three portions by position, the second one sent twice."""
    arrived, out = shared_folder(spark, "goods-arrived"), shared_folder(spark, "goods-stream")
    rows = views.defects(spark, sf_dir)
    stream = spark.readStream.schema(rows.schema).parquet(f"{arrived}/*")
    size = rows.agg(F.max("pos")).scalar()
    for number, third in enumerate((0, 1, 1, 2)):
        portion = rows.filter(F.least(F.floor(3 * F.col("pos") / F.greatest(size, F.lit(1))), F.lit(2)) == third)
        portion.write.parquet(f"{arrived}/{number}")
        start_ingest(stream, out, f"{out}/progress").awaitTermination()
    return loaded_rows(spark, out).drop("source")


# Text rules over goods

CHUNK = "p_name || '. Единица (измерения) хранения остатков: ' || p_type || '. Цена за единицу в рублях: '"


@query(f"SELECT p_name AS name, p_type AS unit, p_retailprice AS price, {CHUNK} || CAST(p_retailprice AS VARCHAR) AS content FROM part")
def goods_chunk_text(spark, sf_dir):
    return ops.goods_chunk_text(parquet_sheet(spark, sf_dir))


WITH_ID = """SELECT good_id AS id, 'ID ' || CAST(good_id AS VARCHAR) || ' ' || title || form
    || '. Единица (измерения) хранения остатков: ' || unit || '. Цена за единицу в рублях: ' || CAST(price AS VARCHAR) AS content
    FROM (SELECT *, '. ' || characteristics AS form FROM shelf UNION ALL SELECT *, '' FROM shelf)"""


@query(WITH_ID, "shelf")
def goods_chunk_with_id(spark, sf_dir):
    goods = views.shelf(spark, sf_dir)
    return ops.goods_chunk_with_id(goods).union(ops.goods_chunk_with_id(goods, with_characteristics=False))


@query("SELECT p_partkey AS id, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_partkey END AS chunk_good_id FROM part")
def chunk_id_extract(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    mark = F.when(F.col("p_size") % 5 == 0, "Good ").otherwise("ID ")
    content = F.concat(mark, F.col("p_partkey"), F.lit(" "), "p_name", F.lit(" ID 5"))
    chunks = part.select(F.col("p_partkey").alias("id"), content.alias("content"))
    return ops.chunk_id_extract(chunks).select("id", "chunk_good_id")


# Chunks whose price is plain, spaced, or absent, by size.
PRICES = """SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN NULL
    WHEN 1 THEN CAST(floor(p_retailprice) AS BIGINT) ELSE 12345000 + p_size END AS price FROM part"""


def priced_texts(spark, sf_dir):
    size = F.col("p_size") % 4
    price = (
        F.when(size == 0, F.lit("нет"))
        .when(size == 1, fn.fn_number_to_text(F.col("p_retailprice")))
        .otherwise(F.concat(F.lit("12 345 "), F.lpad(F.col("p_size").cast("string"), 3, "0"), F.lit(" руб.")))
    )
    content = F.concat("p_name", F.lit(". " + fn.PRICE_LABEL + "  "), price)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), content.alias("content"))


@query(PRICES)
def chunk_price_extract(spark, sf_dir):
    return ops.chunk_price_extract(priced_texts(spark, sf_dir)).select("id", "price")


@query(f"SELECT * FROM ({PRICES}) WHERE price IS NOT NULL")
def priced_chunks_only(spark, sf_dir):
    return ops.priced_chunks_only(ops.chunk_price_extract(priced_texts(spark, sf_dir))).select("id", "price")


@query("SELECT good_id, rtrim(head || body, ' ' || chr(10)) AS text FROM described", "described")
def goods_description_text(spark, sf_dir):
    return ops.goods_description_text(views.goods(spark, sf_dir))


def clamped(c, n):
    return f"CASE WHEN {c} IS NULL THEN '' WHEN length({c}) <= {n} THEN {c} ELSE substr({c}, 1, {n}) || ' … [truncated]' END"


@query(f"SELECT doc_id, {clamped('text', 1400)} AS text FROM documents")
def clamp_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fn.clamp_text(F.col("text"), 1400).alias("text"))


SIZED = f"CASE WHEN n_ids = 1 THEN {clamped('description', 1400)} ELSE {clamped('description', 800)} END"


@query(
    f"SELECT request_id, c.good_id, n_ids, {SIZED} AS description FROM clean_ids c JOIN goods g ON g.good_id = c.good_id",
    "clean_ids",
    "goods",
)
def clamp_by_request_size(spark, sf_dir):
    ids = fn.sanitize_ids(F.col("ids"))
    asked = views.id_requests(spark, sf_dir).select("request_id", ids.alias("ids"))
    rows = asked.select("request_id", F.size("ids").cast("bigint").alias("n_ids"), F.explode("ids").alias("good_id"))
    found = rows.join(views.goods(spark, sf_dir).select("good_id", "description"), "good_id")
    return ops.clamp_by_request_size(found)


@query("SELECT good_id, coalesce(description, '') AS description, CAST(price AS VARCHAR) AS price FROM goods", "goods")
def null_to_text(spark, sf_dir):
    return views.goods(spark, sf_dir).select(
        "good_id",
        fn.null_to_text(F.col("description")).alias("description"),
        fn.null_to_text(F.col("price")).alias("price"),
    )


@query(
    """SELECT page_id, substr(url, 13) AS code, CASE WHEN length(part) >= 12 THEN substr(part, 13) ELSE part END AS short,
    substr(part, 13) AS short_old FROM (SELECT page_id, url, regexp_extract(html, '<a href="([^"]*)">', 1) AS part FROM pages)"""
)
def product_code_trim(spark, sf_dir):
    first = F.regexp_extract("html", '<a href="([^"]*)">', 1)
    return table(spark, sf_dir, "pages").select(
        "page_id",
        fn.product_code_trim(F.col("url")).alias("code"),
        fn.product_code_trim(first).alias("short"),
        fn.product_code_trim(first, keep_short=False).alias("short_old"),
    )


@query(
    """SELECT good_id, 'Путь в каталоге: ' || cat || ', ' || sub || CASE WHEN sub = 'Brand#2' THEN ', ' || subsub ELSE '' END
    || '. ' || title AS path_title FROM shelf""",
    "shelf",
)
def catalogue_path_title(spark, sf_dir):
    rows = views.shelf(spark, sf_dir).withColumn("subsub", F.when(F.col("sub") == "Brand#2", F.col("subsub")))
    return catalogue.catalogue_path_title(rows).select("good_id", "path_title")


@query("SELECT good_id, title, code, price, characteristics, description FROM goods WHERE good_id = 7", "goods")
def good_by_id(spark, sf_dir):
    return ops.good_by_id(scan_about_goods(spark, sf_dir), 7)


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+([^?#]*)', 1) AS path FROM pages")
def url_site_path(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", fn.url_site_path(F.col("url")).alias("path"))


# Scalar functions


@query("SELECT p_partkey, p_name || ' / ' || p_brand AS value FROM part")
def fn_concat(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey", fn.fn_concat(F.col("p_name"), F.lit(" / "), F.col("p_brand")).alias("value")
    )


@query("SELECT good_id, title || ' ' || coalesce(description, '') || ' ' || unit AS value FROM goods", "goods")
def fn_join_space(spark, sf_dir):
    value = fn.fn_join_space(F.col("title"), F.col("description"), F.col("unit"))
    return views.goods(spark, sf_dir).select("good_id", value.alias("value"))


@query("SELECT doc_id, replace(text, ' ', chr(10)) AS value FROM documents")
def fn_join_newline(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fn.fn_join_newline(F.split("text", " ")).alias("value"))


@query("SELECT p_partkey, CAST(p_retailprice AS VARCHAR) AS value, CAST(p_retailprice * 25000 AS VARCHAR) AS large FROM part")
def fn_number_to_text(spark, sf_dir):
    price = F.col("p_retailprice")
    return table(spark, sf_dir, "part").select(
        "p_partkey", fn.fn_number_to_text(price).alias("value"), fn.fn_number_to_text(price * 25000).alias("large")
    )


@query(r"SELECT doc_id, nullif(regexp_extract(text, '(\d+)', 1), '') AS value FROM documents")
def fn_regex_first(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fn.fn_regex_first(F.col("text"), r"(\d+)").alias("value"))


@query("SELECT doc_id, replace(text, ' ', '') AS value FROM documents")
def fn_remove_spaces(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fn.fn_remove_spaces(F.col("text")).alias("value"))


@query("SELECT doc_id, trim(text, ' ' || chr(10)) AS value FROM documents")
def fn_strip(spark, sf_dir):
    padded = F.concat(F.lit(" \n "), "text", F.lit("\n  "))
    return table(spark, sf_dir, "documents").select("doc_id", fn.fn_strip(padded).alias("value"))


@query("SELECT p_partkey, p_name AS value FROM part")
def fn_rstrip_colon(spark, sf_dir):
    marked = F.concat("p_name", F.repeat(F.lit(":"), F.col("p_size") % 4))
    return table(spark, sf_dir, "part").select("p_partkey", fn.fn_rstrip_colon(marked).alias("value"))


@query("SELECT doc_id, substr(text, 21) AS value, substr(text, 1, 12) AS head FROM documents")
def fn_prefix_cut(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", fn.fn_prefix_cut(F.col("text"), 20).alias("value"), fn.fn_head(F.col("text"), 12).alias("head")
    )


@query("SELECT doc_id, CAST(length(text) AS INTEGER) AS value, CAST(len(string_split(text, ' ')) AS INTEGER) AS items FROM documents")
def fn_length(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        fn.fn_length(F.col("text")).alias("value"),
        fn.fn_length(F.split("text", " "), of_list=True).alias("items"),
    )


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL ELSE CAST(substr(p_brand, 7) AS BIGINT) END AS value FROM part")
def fn_to_int(spark, sf_dir):
    number = F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).otherwise(F.substring("p_brand", 7, 9))
    return table(spark, sf_dir, "part").select("p_partkey", fn.fn_to_int(number).alias("value"))


@query(
    """SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN NULL WHEN 1 THEN CAST(-trunc(p_retailprice) AS BIGINT)
    ELSE p_partkey END AS value FROM part"""
)
def fn_to_int_via_float(spark, sf_dir):
    size = F.col("p_size")
    given = (
        F.when(size % 6 == 0, F.lit("nan"))
        .when(size % 3 == 0, F.lit("12 шт"))
        .when(size % 3 == 1, (-F.col("p_retailprice")).cast("string"))
        .otherwise(F.concat(F.lit(" "), F.col("p_partkey"), F.lit(".75 ")))
    )
    return table(spark, sf_dir, "part").select("p_partkey", fn.fn_to_int_via_float(given).alias("value"))


@query(
    """SELECT request_id, CAST(row_number() OVER (PARTITION BY request_id ORDER BY spot) - 1 AS INTEGER) AS pos, value FROM (
    SELECT request_id, value, min(spot) AS spot FROM (SELECT request_id, unnest(ids) AS value, unnest(range(len(ids))) AS spot
    FROM id_requests) GROUP BY request_id, value)""",
    "id_requests",
)
def fn_unique_in_order(spark, sf_dir):
    unique = fn.fn_unique_in_order(F.col("ids"))
    return views.id_requests(spark, sf_dir).select("request_id", F.posexplode(unique).alias("pos", "value"))


@query("SELECT p_partkey, CAST(floor((p_size - 25) / 7.0) AS BIGINT) AS value FROM part")
def fn_floor_div(spark, sf_dir):
    value = fn.fn_floor_div(F.col("p_size").cast("bigint") - 25, F.lit(7).cast("bigint"))
    return table(spark, sf_dir, "part").select("p_partkey", value.alias("value"))


@query("SELECT page_id, pos, href FROM page_links JOIN (SELECT page_id, count(*) AS n FROM page_links GROUP BY page_id) c USING (page_id) WHERE pos >= greatest(0, n - 4) AND pos < least(5, n)", "page_links")
def fn_slice(spark, sf_dir):
    """Links [-4:5] of each page."""
    links = catalogue.anchors(F.col("html"))
    pages = table(spark, sf_dir, "pages").select("page_id", F.size(links).alias("n"), F.posexplode(links).alias("pos", "link"))
    kept = pages.filter(fn.fn_slice(F.col("pos"), F.col("n"), F.lit(-4), F.lit(5)))
    return kept.select("page_id", "pos", "link.href")


ABSOLUTE = r"regexp_extract(url, '^([a-z]+://[^/]+)', 1)"


@query(
    f"""SELECT page_id, pos, {ABSOLUTE} || href AS rooted, {ABSOLUTE} || regexp_extract(url, '^[a-z]+://[^/]+(/?[^?#]*/|)', 1)
    || substr(href, 2) AS relative, regexp_extract(url, '^([a-z]+:)', 1) || '/' || href AS same_scheme,
    'mailto:' || text AS other, regexp_extract(url, '^([^#]*)', 1) || '#a' AS fragment,
    regexp_extract(url, '^([^?#]*)', 1) || '?b=1' AS query FROM page_links JOIN pages USING (page_id)""",
    "page_links",
)
def fn_abs_url(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    links = catalogue.page_links(pages).join(pages.select("page_id", "url"), "page_id")
    url, href = F.col("url"), F.col("href")
    return links.select(
        "page_id",
        "pos",
        fn.fn_abs_url(url, href).alias("rooted"),
        fn.fn_abs_url(url, fn.fn_prefix_cut(href, 1)).alias("relative"),
        fn.fn_abs_url(url, F.concat(F.lit("/"), href)).alias("same_scheme"),
        fn.fn_abs_url(url, F.concat(F.lit("mailto:"), "text")).alias("other"),
        fn.fn_abs_url(url, F.lit("#a")).alias("fragment"),
        fn.fn_abs_url(url, F.lit("?b=1")).alias("query"),
    )


@query("""SELECT p_partkey, '{"name":"' || p_name || '","unit":"' || p_type || '","size":' || CAST(p_size AS VARCHAR) || '}' AS value FROM part""")
def fn_to_json(spark, sf_dir):
    row = F.struct(F.col("p_name").alias("name"), F.col("p_type").alias("unit"), F.col("p_size").alias("size"))
    return table(spark, sf_dir, "part").select("p_partkey", fn.fn_to_json(row).alias("value"))


@query("SELECT conv_id, round, call_idx, array_to_string(ids, '|') AS ids, vec_query, database_name, CAST(flag AS VARCHAR) AS flag, CAST(search_limit AS VARCHAR) AS search_limit FROM tool_calls", "tool_calls")
def fn_args_from_json(spark, sf_dir):
    read = views.tool_calls(spark, sf_dir).withColumn("a", fn.fn_args_from_json(F.col("args"), tools.ARGS))
    ids = F.when(F.col("args") != '{"ids":[1,', F.array_join("a.ids", "|"))
    return read.select(
        "conv_id", "round", "call_idx", ids.alias("ids"), "a.vec_query", "a.database_name", "a.flag", "a.search_limit"
    )


@query("""SELECT p_partkey, '{"Тип":"' || p_type || '","Размер":"' || CAST(p_size AS VARCHAR) || '"}' AS value FROM part""")
def fn_json_map(spark, sf_dir):
    pairs = F.create_map(F.lit("Тип"), F.col("p_type"), F.lit("Размер"), F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", fn.fn_json_map(pairs).alias("value"))


def harvest(spark, sf_dir):
    """The harvest from leaf categories to product rows."""
    listed = catalogue.category_goods_join(
        views.leaves(spark, sf_dir), views.listing(spark, sf_dir).select("leaf_url", "good_url")
    )
    links = listed.select("good_url", catalogue.path_text("cat", "sub", "subsub").alias("path_text"))
    return catalogue.goods_detail_join(links, catalogue.product_records(views.product_pages(spark, sf_dir)))
