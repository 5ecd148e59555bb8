"""Views over the given tables that stand for the catalogue's inputs.

Each view exists twice: as DataFrame code and as SQL text of equal meaning,
which the comparison queries put in front of their own statement.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lavka.functions.text import fn_concat, fn_number_to_text
from lavka.operators import catalogue, goods as goods_ops
from lavka.sources.tables import spread_small
from lavka.operators.tools import BRIEF_COLLECTION, DESC_TOOL, FULL_COLLECTION, PRICE_TOOL, SEARCH_TOOL

SQL: dict[str, tuple[tuple[str, ...], str]] = {}


def sql(statement: str, *views: str) -> str:
    """The statement with the views it names, and those they build on, in front."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in SQL[name][0]:
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for view in views:
        add(view)
    return "WITH " + ",\n".join(f"{name} AS ({SQL[name][1]})" for name in ordered) + "\n" + statement


def view(text: str, *needs: str):
    def register(make):
        SQL[make.__name__] = (needs, text)
        return make

    return register


# Schemas of the given tables, so that opening one reads no file.
SCHEMAS = {
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "pages": "page_id long, url string, html string",
    "benchmark": "item_id long, text string",
    "conversations": "conv_id long, turn long, role string, text string",
}


def table(spark: SparkSession, sf_dir: str, name: str, heavy: bool = False) -> DataFrame:
    """A given table; one that heavy work per row follows is dealt out evenly
    where it has few splits."""
    rows = spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")
    return spread_small(rows) if heavy else rows


def text(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def json_text(c: Column) -> Column:
    """A text as a JSON string."""
    listed = F.to_json(F.array(c))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


@view(
    """SELECT p_partkey AS good_id, p_name AS title, p_brand AS code, p_type AS unit, p_retailprice AS price,
    p_type AS cat, p_brand AS sub, CAST(p_size AS VARCHAR) AS subsub,
    'Размер: ' || CAST(p_size AS VARCHAR) AS characteristics FROM part"""
)
def shelf(spark, sf_dir, heavy=False):
    """Goods without their descriptions."""
    return table(spark, sf_dir, "part", heavy).select(
        F.col("p_partkey").alias("good_id"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("code"),
        F.col("p_type").alias("unit"),
        F.col("p_retailprice").alias("price"),
        F.col("p_type").alias("cat"),
        F.col("p_brand").alias("sub"),
        text("p_size").alias("subsub"),
        F.concat(F.lit("Размер: "), text("p_size")).alias("characteristics"),
    )


@view("SELECT shelf.*, text AS description FROM shelf LEFT JOIN documents ON doc_id = good_id", "shelf")
def goods(spark, sf_dir, heavy=False):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("good_id"), F.col("text").alias("description"))
    return shelf(spark, sf_dir, heavy).join(docs, "good_id", "left_outer")


@view(
    """SELECT good_id AS id, 'ID ' || CAST(good_id AS VARCHAR) || ' ' || title || '. ' || characteristics
    || '. Единица (измерения) хранения остатков: ' || unit || '. Цена за единицу в рублях: '
    || CAST(price AS VARCHAR) AS content, embedding FROM shelf JOIN embeddings ON vec_id = good_id""",
    "shelf",
)
def collection(spark, sf_dir, with_characteristics=True):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("good_id"), "embedding")
    rows = shelf(spark, sf_dir).join(vectors, "good_id")  # before any text is made
    return goods_ops.goods_chunk_with_id(rows, with_characteristics, "embedding")


@view(
    """SELECT good_id AS id, 'ID ' || CAST(good_id AS VARCHAR) || ' ' || title
    || '. Единица (измерения) хранения остатков: ' || unit || '. Цена за единицу в рублях: '
    || CAST(price AS VARCHAR) AS content, embedding FROM shelf JOIN embeddings ON vec_id = good_id""",
    "shelf",
)
def brief_collection(spark, sf_dir):
    return collection(spark, sf_dir, with_characteristics=False)


@view(
    """SELECT item_id AS query_id, embedding AS qvec, CAST(item_id % 3 + 1 AS BIGINT) AS flag,
    CAST(CASE item_id % 4 WHEN 0 THEN 10 WHEN 1 THEN 50 WHEN 2 THEN 126 ELSE 5 END AS BIGINT) AS search_limit
    FROM benchmark JOIN embeddings ON vec_id = item_id"""
)
def queries(spark, sf_dir):
    """Every benchmark item is a query; the embedding of its number stands for its vector."""
    items, vectors = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "embeddings")
    turn = F.col("item_id") % 4
    limit = F.when(turn == 0, 10).when(turn == 1, 50).when(turn == 2, 126).otherwise(5)
    return items.join(vectors, items.item_id == vectors.vec_id).select(
        F.col("item_id").alias("query_id"),
        F.col("embedding").alias("qvec"),
        (F.col("item_id") % 3 + 1).alias("flag"),
        limit.cast("bigint").alias("search_limit"),
    )


@view(
    """SELECT p_partkey AS request_id, CASE p_partkey % 7
    WHEN 0 THEN [k] WHEN 1 THEN [k, k1] WHEN 2 THEN [k, k, k1] WHEN 3 THEN [k, '9' || k || '00000000']
    WHEN 4 THEN [k || '.9', 'ID ' || k, 'nan', k1, k] WHEN 5 THEN ['inf', 'none'] ELSE [k1, k] END AS ids
    FROM (SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS k, CAST(p_partkey + 3 AS VARCHAR) AS k1 FROM part)"""
)
def id_requests(spark, sf_dir):
    """One request per part: a single id, pairs, repeats, unknown ids, texts that are no ids."""
    k, k1 = text("p_partkey"), text(F.col("p_partkey") + 3)
    forms = [
        [k],
        [k, k1],
        [k, k, k1],
        [k, F.concat(F.lit("9"), k, F.lit("00000000"))],
        [F.concat(k, F.lit(".9")), F.concat(F.lit("ID "), k), F.lit("nan"), k1, k],
        [F.lit("inf"), F.lit("none")],
        [k1, k],
    ]
    ids = F.array(*forms[-1])
    for number, form in enumerate(forms[:-1]):
        ids = F.when(F.col("p_partkey") % 7 == number, F.array(*form)).otherwise(ids)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("request_id"), ids.alias("ids"))


# SQL for sanitised id lists: one row per distinct id at its first place.
SQL["clean_ids"] = (
    ("id_requests",),
    """SELECT request_id, good_id, row_number() OVER (PARTITION BY request_id ORDER BY spot) - 1 AS pos,
    count(*) OVER (PARTITION BY request_id) AS n_ids FROM (
    SELECT request_id, good_id, min(spot) AS spot FROM (
    SELECT request_id, CAST(trunc(CAST(one AS DOUBLE)) AS BIGINT) AS good_id, spot FROM (
    SELECT request_id, unnest(ids) AS one, unnest(range(len(ids))) AS spot FROM id_requests)
    WHERE regexp_full_match(one, '[0-9]+([.][0-9]+)?')) GROUP BY request_id, good_id)""",
)

SQL["described"] = (
    ("goods",),
    """SELECT good_id, title || ' Артикул: ' || code || '. Цена в рублях: ' || CAST(price AS VARCHAR) || '. '
    || characteristics || ' ' AS head, coalesce(description, '') AS body FROM goods""",
)


# Pages and links


@view(
    r"""SELECT page_id, CAST(spot AS INTEGER) AS pos, regexp_extract(frag, 'href="([^"]*)"', 1) AS href,
    replace(regexp_extract(frag, '>(.*)</a>', 1), '&amp;', '&') AS text FROM (
    SELECT page_id, unnest(f) AS frag, unnest(range(len(f))) AS spot FROM (
    SELECT page_id, regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>') AS f FROM pages))"""
)
def page_links(spark, sf_dir):
    return catalogue.page_links(table(spark, sf_dir, "pages"))


@view(
    """SELECT good_id, cat, sub, subsub, '/catalog/' || cat || '/' AS cat_path,
    '/catalog/' || cat || '/' || replace(sub, '#', '-') || '/' AS sub_path,
    '/catalog/' || cat || '/' || replace(sub, '#', '-') || '/' || subsub || '/' AS subsub_path,
    'https://shop.example/goods/' || CAST(good_id AS VARCHAR) || '/' AS good_url FROM shelf""",
    "shelf",
)
def placed(spark, sf_dir):
    """Each good with the paths of its three levels and its own address."""
    cat_path = F.concat(F.lit("/catalog/"), "cat", F.lit("/"))
    sub_path = F.concat(cat_path, F.replace("sub", F.lit("#"), F.lit("-")), F.lit("/"))
    return shelf(spark, sf_dir).select(
        "good_id",
        "cat",
        "sub",
        "subsub",
        cat_path.alias("cat_path"),
        sub_path.alias("sub_path"),
        F.concat(sub_path, "subsub", F.lit("/")).alias("subsub_path"),
        F.concat(F.lit("https://shop.example/goods/"), text("good_id"), F.lit("/")).alias("good_url"),
    )


@view("SELECT DISTINCT cat_path AS path, cat AS name FROM placed", "placed")
def cats(spark, sf_dir):
    return placed(spark, sf_dir).select(F.col("cat_path").alias("path"), F.col("cat").alias("name")).distinct()


@view(
    """SELECT ancestor_path, href, text, depth, min(pos) AS pos FROM (
    SELECT cat_path AS ancestor_path, sub_path AS href, CASE WHEN sub = 'Brand#1' THEN '' ELSE sub END AS text,
    1 AS depth, CAST(1000 * CAST(substr(sub, 7) AS INTEGER) AS INTEGER) AS pos FROM placed WHERE cat <> 'ECONOMY'
    UNION ALL SELECT cat_path, subsub_path, subsub, 2, CAST(1000 * CAST(substr(sub, 7) AS INTEGER) + CAST(subsub AS INTEGER) AS INTEGER)
    FROM placed WHERE cat <> 'ECONOMY'
    UNION ALL SELECT sub_path, subsub_path, subsub, 1, CAST(subsub AS INTEGER) FROM placed WHERE cat <> 'ECONOMY')
    GROUP BY ancestor_path, href, text, depth""",
    "placed",
)
def category_links(spark, sf_dir):
    """One row per menu entry and link below it. One category has nothing below
    it and one subcategory has no name."""
    rows = placed(spark, sf_dir).filter("cat <> 'ECONOMY'")
    brand = F.substring("sub", 7, 9).cast("int")
    size = F.col("subsub").cast("int")

    def level(ancestor: str, href: str, name: Column, depth: int, pos: Column) -> DataFrame:
        return rows.select(
            F.col(ancestor).alias("ancestor_path"),
            F.col(href).alias("href"),
            name.alias("text"),
            F.lit(depth).alias("depth"),
            pos.alias("pos"),
        )

    below = (
        level("cat_path", "sub_path", F.when(F.col("sub") == "Brand#1", "").otherwise(F.col("sub")), 1, brand * 1000)
        .union(level("cat_path", "subsub_path", F.col("subsub"), 2, brand * 1000 + size))
        .union(level("sub_path", "subsub_path", F.col("subsub"), 1, size))
    )
    return below.groupBy("ancestor_path", "href", "text", "depth").agg(F.min("pos").alias("pos"))


@view("SELECT subsub_path AS leaf_url, good_url, good_id, cat, sub, subsub FROM placed", "placed")
def listing(spark, sf_dir):
    """Which leaf category lists which good."""
    return placed(spark, sf_dir).select(
        F.col("subsub_path").alias("leaf_url"), "good_url", "good_id", "cat", "sub", "subsub"
    )


@view(
    """SELECT DISTINCT leaf_url, cat, sub, subsub FROM listing
    UNION ALL SELECT DISTINCT '/catalog/' || cat || '/none/', cat, 'none', CAST(NULL AS VARCHAR) FROM listing""",
    "listing",
)
def leaves(spark, sf_dir):
    """All leaf categories, with one empty leaf per category."""
    rows = listing(spark, sf_dir)
    empty = rows.select(
        F.concat(F.lit("/catalog/"), "cat", F.lit("/none/")).alias("leaf_url"),
        "cat",
        F.lit("none").alias("sub"),
        F.lit(None).cast("string").alias("subsub"),
    )
    return rows.select("leaf_url", "cat", "sub", "subsub").distinct().union(empty.distinct())


def product_pages(spark, sf_dir):
    """A stored product page per good; those of one brand have none, and a good
    without a description has a page without the description block."""

    def escaped(c: Column) -> Column:
        for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            c = F.replace(c, F.lit(sign), F.lit(name))
        return c

    def row(*cells: Column) -> Column:
        return F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td> "), c, F.lit("</td>")) for c in cells], F.lit("</tr>"))

    paragraphs = F.transform(
        F.split("description", "\n"), lambda p: F.concat(F.lit("<p> "), escaped(p), F.lit("</p>\n"))
    )
    block = fn_concat(
        F.lit('<div data-tab="description" class="tab"><div>'),
        F.array_join(paragraphs, ""),
        F.lit("<p> </p></div><table>"),
        row(F.lit("Свойства")),
        row(F.lit("Бренд:"), F.col("title")),
        row(F.lit("Тип: "), F.col("unit"), F.lit("x")),
        row(F.lit("Размер::"), F.col("subsub")),
        row(F.lit("Бренд"), F.concat(F.lit("<b>"), F.col("code"), F.lit("</b>"))),
        F.lit("</table></div>"),
    )
    html = F.concat(
        F.lit("<html><head><script>var p='<p>no</p>';</script></head><body><h1 class='catalog-detail__title'>"),
        F.col("title"),
        F.lit("</h1><div class='catalog-detail__code'>Артикул:    "),
        F.col("code"),
        F.lit("</div><span class='catalog-detail__price'> "),
        fn_number_to_text(F.col("price")),
        F.lit(" <i>руб.</i></span><br>"),
        F.coalesce(block, F.lit("")),
        F.lit("<p>footer</p></body></html>"),
    )
    url = F.concat(F.lit("https://shop.example/goods/"), text("good_id"), F.lit("/"))
    pages = goods(spark, sf_dir, heavy=True).filter("sub <> 'Brand#13'")
    return pages.select(F.col("good_id").alias("page_id"), url.alias("url"), html.alias("html"))


SHOP = "https://shop.example"


def menu_pages(spark, sf_dir):
    """One stored page per category holding its nested menu; the lists grow with
    the number of categories, never with the goods in them."""

    def link(css: str, href: str, name: str) -> Column:
        return F.concat(F.lit(f'<a class="{css} " href="'), href, F.lit('">'), name, F.lit("</a>"))

    def nested(items: str) -> Column:
        return F.concat(F.lit('<ul class="sidebar-submenu">'), F.array_join(F.array_sort(items), ""), F.lit("</ul>"))

    third = placed(spark, sf_dir).select("cat", "cat_path", "sub", "sub_path", "subsub", "subsub_path").distinct()
    item = F.concat(F.lit("<li>"), link("sidebar-submenu__link", "subsub_path", "subsub"), F.lit("</li>"))
    subs = third.groupBy("cat", "cat_path", "sub", "sub_path").agg(F.collect_list(item).alias("items"))
    sub = F.concat(F.lit("<li>"), link("sidebar-submenu__link", "sub_path", "sub"), nested("items"), F.lit("</li>"))
    menu = subs.groupBy("cat", "cat_path").agg(F.collect_list(sub).alias("subs"))
    html = F.concat(F.lit("<nav><ul><li>"), link("sidebar-menu__link", "cat_path", "cat"), nested("subs"), F.lit("</li></ul>"))
    return menu.select(F.xxhash64("cat").alias("page_id"), html.alias("html"))


def listing_pages(spark, sf_dir):
    """A stored page per second and third level, listing its goods, some of them twice."""
    goods_at = placed(spark, sf_dir)
    link = F.concat(F.lit('<a class="offer__title" href="'), "good_url", F.lit('">good</a>'))
    pages = None
    for path in ("sub_path", "subsub_path"):
        items = goods_at.groupBy(F.col(path).alias("path")).agg(F.array_join(F.array_sort(F.collect_list(link)), " ").alias("items"))
        pages = items if pages is None else pages.union(items)
    html = F.concat(F.lit("<html><body>"), "items", F.lit("<a href='/x'>x</a>"), "items", F.lit("</body></html>"))
    return pages.select(F.xxhash64("path").alias("page_id"), F.concat(F.lit(SHOP), "path").alias("url"), html.alias("html"))


# Outline texts

SQL["outline_parts"] = (
    ("shelf",),
    """SELECT CAST(subsub AS BIGINT) AS doc, cat, sub, string_split(title, ' ')[1] AS colour, count(*) AS n
    FROM shelf GROUP BY 1, 2, 3, 4""",
)


@view(
    """SELECT doc, CAST(row_number() OVER (PARTITION BY doc ORDER BY cat, sub, colour) AS INTEGER) AS line_no,
    CASE level WHEN 1 THEN 'cat ' || cat WHEN 2 THEN '___ subcat ' || sub ELSE '___ ___ subsubcat ' || colour END
    || ' ' || CAST(n AS VARCHAR) AS line, CAST(level AS INTEGER) AS level,
    CASE level WHEN 1 THEN cat WHEN 2 THEN sub ELSE colour END AS name, n AS declared_count, '' AS note FROM (
    SELECT doc, cat, '' AS sub, '' AS colour, CAST(sum(n) AS BIGINT) AS n, 1 AS level FROM outline_parts GROUP BY doc, cat
    UNION ALL SELECT doc, cat, sub, '', CAST(sum(n) AS BIGINT) + CASE WHEN sub = 'Brand#2' THEN 1 ELSE 0 END, 2
    FROM outline_parts GROUP BY doc, cat, sub
    UNION ALL SELECT doc, cat, sub, colour, n, 3 FROM outline_parts)""",
    "outline_parts",
)
def outline(spark, sf_dir):
    """An outline document per size: category, brand, colour. One brand's count
    is off by one, so that the sums do not all agree."""
    parts = (
        shelf(spark, sf_dir)
        .withColumn("doc", F.col("subsub").cast("bigint"))
        .withColumn("colour", F.substring_index("title", " ", 1))
        .groupBy("doc", "cat", "sub", "colour")
        .agg(F.count("*").alias("n"))
    )
    off = F.sum("n") + F.when(F.col("sub") == "Brand#2", 1).otherwise(0)
    line = lambda mark, name: F.concat(F.lit(mark), name, F.lit(" "), F.col("n"))
    columns = ("doc", "cat", F.lit("").alias("sub"), F.lit("").alias("colour"))
    lines = (
        parts.groupBy("doc", "cat").agg(F.sum("n").alias("n")).select(*columns, line("cat ", "cat").alias("line"))
        .union(
            parts.groupBy("doc", "cat", "sub").agg(off.alias("n"))
            .select("doc", "cat", "sub", F.lit(""), line("___ subcat ", "sub"))
        )
        .union(parts.select("doc", "cat", "sub", "colour", line("___ ___ subsubcat ", "colour")))
    )
    whole = F.array_sort(F.collect_list(F.struct("cat", "sub", "colour", "line")))  # one document's lines
    return lines.groupBy("doc").agg(F.array_join(F.transform(whole, lambda x: x["line"]), "\n").alias("value"))


# Tool calls


@view(
    f"""SELECT conv_id, CAST(2 * turn + r AS INTEGER) AS round, CAST(c AS INTEGER) AS call_idx,
    CASE WHEN m IN (0, 1, 7, 8) THEN '{DESC_TOOL}' WHEN m IN (2, 3) THEN '{SEARCH_TOOL}'
    WHEN m IN (4, 5, 6) THEN '{PRICE_TOOL}' ELSE 'WebSearch' END AS name, m,
    CASE m WHEN 0 THEN [CAST(conv_id AS VARCHAR), CAST(conv_id + 7 AS VARCHAR)]
    WHEN 1 THEN [CAST(conv_id AS VARCHAR) || '.9', 'ID 12', CAST(conv_id AS VARCHAR), 'nan']
    WHEN 7 THEN ['none'] ELSE NULL END AS ids,
    CASE WHEN m BETWEEN 2 AND 6 THEN vec_query END AS vec_query,
    CASE m WHEN 2 THEN '{FULL_COLLECTION}' WHEN 3 THEN '{BRIEF_COLLECTION}' END AS database_name,
    CAST(CASE m WHEN 4 THEN 1 WHEN 5 THEN 2 + conv_id % 2 WHEN 6 THEN 9 END AS BIGINT) AS flag,
    CAST(CASE m WHEN 2 THEN 10 WHEN 3 THEN CASE WHEN conv_id % 4 = 0 THEN NULL ELSE 15 END
    WHEN 4 THEN 50 WHEN 5 THEN 126 WHEN 6 THEN 10 END AS BIGINT) AS search_limit
    FROM (SELECT a.conv_id, a.turn, r, c, coalesce(u.text, '') AS vec_query,
    (a.conv_id * 3 + a.turn * 5 + r * 2 + c) % 10 AS m
    FROM conversations a JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) v(r, c)
    ON c = 0 OR (a.conv_id + a.turn + r) % 3 = 0
    LEFT JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1
    WHERE a.role = 'assistant')"""
)
def tool_calls(spark, sf_dir):
    """Two rounds per assistant turn, some with a second call. The user's text
    before the turn is the query; arguments take every valid and invalid form."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("vec_query"))
    answers = turns.filter("role = 'assistant'").select("conv_id", "turn")
    second = (F.col("conv_id") + F.col("turn") + F.col("r")) % 3 == 0
    calls = (
        answers.join(asked, ["conv_id", "turn"], "left_outer")
        .withColumn("r", F.explode(F.array(F.lit(0), F.lit(1))))
        .withColumn("c", F.explode(F.when(second, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
        .withColumn("m", (F.col("conv_id") * 3 + F.col("turn") * 5 + F.col("r") * 2 + F.col("c")) % 10)
    )
    m, conv = F.col("m"), text("conv_id")
    query = F.concat(F.lit('{"vec_query":'), json_text(F.coalesce("vec_query", F.lit(""))))

    def args(*parts: Column | str) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    def search(name: str, limit: str) -> Column:
        return args(query, f',"database_name":"{name}"{limit}' + "}")

    def band(flag: Column | str, limit: int) -> Column:
        return args(query, ',"flag":', flag, f',"search_limit":{limit}' + "}")

    forms = {
        0: args('{"ids":[', conv, ",", text(F.col("conv_id") + 7), "]}"),
        1: args('{"ids":["', conv, '.9","ID 12",', conv, ',"nan"]}'),
        2: search(FULL_COLLECTION, ',"search_limit":10'),
        3: F.when(F.col("conv_id") % 4 == 0, search(BRIEF_COLLECTION, "")).otherwise(
            search(BRIEF_COLLECTION, ',"search_limit":"15"')
        ),
        4: band("1", 50),
        5: band(text(F.col("conv_id") % 2 + 2), 126),
        6: band("9", 10),
        7: F.lit('{"ids":["none"]}'),
        8: F.lit('{"ids":[1,'),
        9: F.lit("{}"),
    }
    name, given = F.lit("WebSearch"), F.lit("{}")
    for tool, numbers in {DESC_TOOL: (0, 1, 7, 8), SEARCH_TOOL: (2, 3), PRICE_TOOL: (4, 5, 6)}.items():
        name = F.when(m.isin(*numbers), tool).otherwise(name)
    for number, form in forms.items():
        given = F.when(m == number, form).otherwise(given)
    return calls.select(
        "conv_id",
        (F.col("turn") * 2 + F.col("r")).cast("int").alias("round"),
        F.col("c").alias("call_idx"),
        name.alias("name"),
        given.alias("args"),
    )


@view(
    """SELECT q.vec_query, e.embedding AS qvec FROM (
    SELECT text AS vec_query, min(conv_id) AS vec_id FROM conversations WHERE role = 'user' GROUP BY text) q
    JOIN embeddings e ON e.vec_id = q.vec_id"""
)
def query_vectors(spark, sf_dir):
    """A vector for each text a user wrote: the embedding numbered like the first
    conversation it occurs in."""
    asked = table(spark, sf_dir, "conversations").filter("role = 'user'")
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("qvec"))
    first = asked.groupBy(F.col("text").alias("vec_query")).agg(F.min("conv_id").alias("vec_id"))
    return first.join(vectors, "vec_id").select("vec_query", "qvec")


@view(
    """SELECT p_partkey AS pos, CASE WHEN p_partkey % 331 = 7 THEN NULL ELSE p_name END AS name,
    CASE WHEN p_partkey % 997 = 500 THEN NULL ELSE p_type END AS unit, p_retailprice AS price FROM part"""
)
def defects(spark, sf_dir):
    """Parts with a missing name or unit here and there."""
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        key.alias("pos"),
        F.when(key % 331 != 7, F.col("p_name")).alias("name"),
        F.when(key % 997 != 500, F.col("p_type")).alias("unit"),
        F.col("p_retailprice").alias("price"),
    )


# Chunks of long texts

SQL["chunks"] = (
    (),
    """SELECT doc_id * 1048576 + spot AS chunk_id, doc_id, CAST(spot AS INTEGER) AS chunk_no,
    substr(text, CAST(spot * 600 + 1 AS BIGINT), 800) AS content FROM (SELECT doc_id, text,
    unnest(range(CAST(1 + (greatest(1, length(text) - 200) - 1) // 600 AS BIGINT))) AS spot FROM documents WHERE length(text) > 0)""",
)
SQL["chunk_terms"] = (
    ("chunks",),
    r"""SELECT id, term, count(*) AS tf FROM (SELECT chunk_id AS id,
    unnest(string_split_regex(lower(content), '[^\p{L}\p{N}]+')) AS term FROM chunks) WHERE term <> '' GROUP BY id, term""",
)
SQL["query_terms"] = (
    (),
    r"""SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id,
    unnest(string_split_regex(lower(text), '[^\p{L}\p{N}]+')) AS term FROM benchmark) WHERE term <> '' GROUP BY query_id, term""",
)
SQL["chunk_sizes"] = (("chunk_terms",), "SELECT id, sum(tf) AS size, sqrt(sum((1 + ln(tf)) * (1 + ln(tf)))) AS norm FROM chunk_terms GROUP BY id")
SQL["corpus_size"] = (("chunks", "chunk_sizes"), "SELECT (SELECT count(*) FROM chunks) AS n, (SELECT sum(size) FROM chunk_sizes) / (SELECT count(*) FROM chunks) AS mean_size")
SQL["term_df"] = (("chunk_terms",), "SELECT term, count(*) AS df FROM chunk_terms GROUP BY term")
SQL["bm25_ranked"] = (
    ("chunk_terms", "query_terms", "chunk_sizes", "corpus_size", "term_df"),
    """SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank
    FROM (SELECT query_id, c.id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2
    / (tf + 1.2 * (0.25 + 0.75 * size / mean_size))), 6) AS score
    FROM query_terms q JOIN chunk_terms c ON q.term = c.term JOIN term_df d ON d.term = q.term
    JOIN chunk_sizes s ON s.id = c.id, corpus_size GROUP BY query_id, c.id)""",
)
SQL["tfidf_ranked"] = (
    ("chunk_terms", "query_terms", "chunk_sizes", "corpus_size", "term_df"),
    """SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank
    FROM (SELECT query_id, c.id, round(sum(w / length * (1 + ln(tf)) / norm), 6) AS score
    FROM (SELECT query_id, term, w, sqrt(sum(w * w) OVER (PARTITION BY query_id)) AS length FROM (
    SELECT query_id, q.term, (1 + ln(qtf)) * ln(1 + n / df) AS w
    FROM query_terms q JOIN term_df d ON d.term = q.term, corpus_size)) q
    JOIN chunk_terms c ON q.term = c.term JOIN chunk_sizes s ON s.id = c.id GROUP BY query_id, c.id)""",
)
SQL["fused"] = (
    ("bm25_ranked", "tfidf_ranked"),
    """SELECT coalesce(l.query_id, v.query_id) AS query_id, coalesce(l.id, v.id) AS id, l.rank AS lexical_rank, v.rank AS vector_rank,
    round(coalesce(1.0 / (60 + l.rank), 0) + coalesce(1.0 / (60 + v.rank), 0), 9) AS score
    FROM bm25_ranked l FULL OUTER JOIN tfidf_ranked v ON l.query_id = v.query_id AND l.id = v.id""",
)


def text_queries(spark, sf_dir):
    """Benchmark passages as text queries."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


# Hits and their prices, for the band queries

SQL["scored"] = (
    ("queries", "brief_collection"),
    """SELECT query_id, flag, search_limit, id, content,
    round(list_cosine_similarity(CAST(qvec AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS score
    FROM queries, brief_collection""",
)
SQL["ranked"] = (
    ("scored",),
    "SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM scored",
)
SQL["padded_hits"] = (
    ("ranked",),
    r"""SELECT query_id, flag, search_limit + 3 AS search_limit, id, rank,
    CAST(regexp_extract(content, 'Цена за единицу в рублях: (\d+)', 1) AS BIGINT) AS price
    FROM ranked WHERE rank <= search_limit + 3""",
)
SQL["priced"] = (
    ("padded_hits",),
    """SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY price, rank) - 1 AS price_pos,
    count(*) OVER (PARTITION BY query_id) AS n_hits FROM padded_hits""",
)
