"""Reading: goods sheets, product tables, stored pages, collections, outlines."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lavka.functions.text import fn_strip
from lavka.session import stored

SHEET_SCHEMA = "name string, unit string, price double"
ABOUT_GOODS = ("good_id", "title", "code", "price", "characteristics", "description")

OUTLINE_LINE = r"^((?:___\s+)*)(cat|subcat|subsubcat)\s+(.*?)\s*(?:(\([^()]*\))\s*)?\s(\d+)\w*\s*(\(.*\))?\s*$"
#: What may stand around an outline line: white space, a quote, a comma behind it.
OUTLINE_WRAPPING = r"""^\s*["']?\s*|\s*["']?\s*,?\s*$"""


FEW_SPLITS = 64


def spread_small(scan: DataFrame) -> DataFrame:
    """A plain scan with fewer splits than the cluster has cores, dealt out over
    them. Only a scan of few splits, some gigabytes at most, is ever moved; a
    large one is already spread and left alone."""
    tasks = min(scan.sparkSession.sparkContext.defaultParallelism, FEW_SPLITS)
    return scan.repartition(tasks) if scan.rdd.getNumPartitions() < tasks else scan


LINES = "file string, start bigint, nth bigint, inside boolean, outer bigint, inner bigint, line string"


def numbered_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of each split with their number, whether an odd number of quotes precedes them in the split,
    and the records begun so far if the split starts outside a quoted cell and if inside one."""
    split, nth, odd, begun = None, 0, 0, [0, 0]
    for batch in batches:
        names, starts, quotes = (batch.column(x).to_pylist() for x in ("file", "start", "quotes"))
        columns = [[], [], [], []]
        for place, count in zip(zip(names, starts), quotes):
            if place != split:
                split, nth, odd, begun = place, 0, 0, [0, 0]
            begun[odd] += 1
            for column, value in zip(columns, (nth, odd == 1, *begun)):
                column.append(value)
            nth, odd = nth + 1, (odd + count) & 1
        yield pa.RecordBatch.from_arrays(
            [batch.column("file"), batch.column("start"), *map(pa.array, columns), batch.column("line")],
            names=["file", "start", "nth", "inside", "outer", "inner", "line"],
        )


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, record, text): the records of CSV files in pieces of any size, line breaks in
    quoted cells included. ``start`` and ``record`` order the records of a file; blank lines are none.

    Files are read as lines, so each split is a task of its own. A split knows how many quotes it
    holds; the sum over the splits before it, one number each, tells whether it starts inside
    a quoted cell. A line begins a record unless it lies inside one; lines before a split's first
    record belong to the last one of an earlier split. Only lines of records of several lines are shuffled.
    """
    read = spark.read.option("lineSep", "\n").text(path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    lines = read.select(*place, quotes.alias("quotes"), F.col("value").alias("line"))
    lines = lines.mapInArrow(numbered_lines, LINES)

    sums = read.select(*place, quotes.alias("quotes")).groupBy("file", "start").agg(F.sum("quotes").alias("quotes"))
    before = Window.partitionBy("file").orderBy("start")  # the splits of one file
    odd = F.coalesce(F.sum("quotes").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2 == 1
    splits = stored(sums.select("file", "start", odd.alias("open")), "csv-splits")
    lines = lines.join(splits, ["file", "start"])
    begins = F.col("inside") == F.col("open")
    record = F.when(F.col("open"), F.col("inner")).otherwise(F.col("outer"))
    lines = lines.select("file", "start", "nth", begins.alias("begins"), record.alias("record"), "line")

    # The record that each split's first lines belong to: the last one begun before.
    begun = lines.groupBy("file", "start").agg(F.max("record").alias("begun"))
    own = F.when(F.col("begun") > 0, F.struct("start", "begun"))
    earlier = F.last(own, ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, -1))
    begun = stored(begun.select("file", "start", earlier.alias("earlier")), "csv-records")
    lines = lines.join(begun, ["file", "start"]).withColumn("at", F.col("start"))
    carried = (F.col("record") == 0) & F.col("earlier").isNotNull()
    lines = lines.withColumn("start", F.when(carried, F.col("earlier.start")).otherwise(F.col("start")))
    lines = lines.withColumn("record", F.when(carried, F.col("earlier.begun")).otherwise(F.col("record")))

    # A record of one line is one whose quotes are even; any other is put together.
    even = (F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))) % 2 == 0
    single = lines.filter(F.col("begins") & even).select("file", "start", "record", F.col("line").alias("text"))
    parts = lines.filter(~(F.col("begins") & even)).groupBy("file", "start", "record")
    whole = parts.agg(F.array_sort(F.collect_list(F.struct("at", "nth", "line"))).alias("l"))
    whole = whole.select("file", "start", "record", F.array_join("l.line", "\n").alias("text"))
    records = single.unionByName(whole).withColumn("text", F.regexp_replace("text", "\r$", ""))
    return records.filter(F.trim("text") != "")


def scan_goods_sheet(
    spark: SparkSession,
    path: str,
    schema: str = SHEET_SCHEMA,
    positions: tuple[int, ...] = (2, 4, 5),
    header_lines: int = 3,
    width: int = 6,
) -> DataFrame:
    """A goods sheet with its columns taken by position.

    A parquet export needs no header lines. A CSV export may have line breaks inside quoted cells
    (see ``csv_records``; quotes stand around cells and doubled in them, nowhere else). The first rows of each
    file are dropped by their place, equal rows further on stay. Wholly blank lines are no rows.
    """
    names = [field.split()[0] for field in schema.split(",")]
    types = [field.split()[1] for field in schema.split(",")]
    if path.endswith(".parquet"):
        rows = spark.read.parquet(path)
        cells = [F.col(rows.columns[at]) for at in positions]
    else:
        records = csv_records(spark, path)
        if header_lines:
            order = Window.partitionBy("file").orderBy("start", "record")
            head = records.select("file", "start", "record").withColumn("place", F.row_number().over(order))
            head = stored(head.filter(F.col("place") <= header_lines).drop("place"), "csv-head")
            records = records.join(head, ["file", "start", "record"], "left_anti")
        cell_schema = ", ".join(f"c{at} string" for at in range(width))
        rows = records.select(F.from_csv("text", F.lit(cell_schema), {"escape": '"', "lineSep": "\n"}).alias("row")).select("row.*")
        cells = [F.col(f"c{at}") for at in positions]
    return rows.select(*[c.try_cast(kind).alias(name) for c, kind, name in zip(cells, types, names)])


def scan_about_goods(spark: SparkSession, source: str | dict | DataFrame) -> DataFrame:
    """The product table from parquet, a DataFrame, or JDBC options (which may
    carry partitionColumn, lowerBound, upperBound, numPartitions)."""
    if isinstance(source, DataFrame):
        table = source
    elif isinstance(source, dict):
        table = spark.read.format("jdbc").options(**source).load()
    else:
        table = spark.read.parquet(source)
    return table.select(*ABOUT_GOODS)


def scan_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("page_id", "url", "html")


def scan_collection(spark: SparkSession, name: str, root: str | None = None) -> DataFrame:
    """A named collection: one folder below the root (the shared folder by default)."""
    root = root or spark.conf.get("spark.checkpoint.dir")
    return spark.read.parquet(f"{root}/{name}").select("id", "content", "embedding")


def parse_outline(lines: DataFrame) -> DataFrame:
    """(doc, line_no, line) with level, name, declared count and bracketed note.
    Lines may be indented and quoted. What is no outline line has level null;
    ``unparsed_lines`` lists those."""
    line = F.regexp_replace("line", OUTLINE_WRAPPING, "")
    note = [F.regexp_extract(line, OUTLINE_LINE, group) for group in (4, 6)]
    return lines.select(
        "doc",
        "line_no",
        "line",
        F.when(line.rlike(OUTLINE_LINE), F.size(F.split(F.regexp_extract(line, OUTLINE_LINE, 1), "___")))
        .cast("int")
        .alias("level"),
        fn_strip(F.regexp_extract(line, OUTLINE_LINE, 3)).alias("name"),
        F.regexp_extract(line, OUTLINE_LINE, 5).try_cast("bigint").alias("declared_count"),
        fn_strip(F.concat_ws(" ", *note)).alias("note"),
    )


def unparsed_lines(outline: DataFrame) -> DataFrame:
    """The lines of a parsed outline that no rule reads."""
    return outline.filter("level IS NULL").select("doc", "line_no", "line")


def scan_outline(spark: SparkSession, path: str) -> DataFrame:
    """Outline texts, one file per document, as numbered lines. A document is
    read whole, so the line order does not depend on how files are split."""
    files = spark.read.text(path, wholetext=True)
    doc = F.col("doc") if "doc" in files.columns else F.xxhash64(F.col("_metadata.file_path"))
    numbered = files.select(doc.cast("bigint").alias("doc"), F.posexplode(F.split("value", "\r?\n")).alias("at", "line"))
    filled = numbered.filter(fn_strip(F.col("line")) != "")
    return parse_outline(filled.select("doc", (F.col("at") + 1).cast("int").alias("line_no"), "line"))
