"""Logs of tool calls: rules between calls and set-wise execution.

A call log has (conv_id, round, call_idx, name, args); args is JSON text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lavka.functions.text import fn_args_from_json, sanitize_ids, search_pad
from lavka.operators.goods import chunk_price_extract, descriptions_by_ids, price_band, priced_chunks_only
from lavka.operators.lexical import hybrid_search
from lavka.operators.ranking import vector_topk_batch
from lavka.session import shared_folder, stored
from lavka.sources.tables import spread_small

# Tool names with their short forms, search presets, round limit, messages.
DESC_TOOL, SEARCH_TOOL, PRICE_TOOL = "GetDescriptionsByIds", "GoodsVectorSearch", "FindCheapExpensiveMiddleGoods"
SHORT_NAMES = {DESC_TOOL: "DESC", SEARCH_TOOL: "GVS", PRICE_TOOL: "PRICE"}
FULL_COLLECTION, BRIEF_COLLECTION = "GoodsListWithID", "GoodsListWithIDWithoutCharacteristics"
PRESETS = ((FULL_COLLECTION, 10), (BRIEF_COLLECTION, 15))
MAX_ROUNDS = 4
TOO_MANY = "TOO_MANY_TOOL_ROUNDS"
NO_IDS = "ids пусты/некорректны"
UNKNOWN_TOOL = "TypeError(\"'NoneType' object is not callable\")"

ARGS = "ids array<string>, vec_query string, database_name string, flag string, search_limit string"
CALL = ("conv_id", "round", "call_idx")
CALLS_PER_TASK = 10_000  # calls whose results, some kilobytes each, one task brings together


# Rules between the calls of a thread


def one_tool_per_round(calls: DataFrame) -> DataFrame:
    """Only the first call of each round; later ones fall away inside each task."""
    rest = [c for c in calls.columns if c not in ("conv_id", "round")]
    first = calls.groupBy("conv_id", "round").agg(F.min_by(F.struct(*rest), "call_idx").alias("first"))
    return first.select("conv_id", "round", *[F.col(f"first.{c}") for c in rest])


def tool_round_limit(calls: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(conv_id, rounds, status) of each thread; more rounds than allowed give
    the status of a loop."""
    rounds = calls.groupBy("conv_id", "round").count().groupBy("conv_id").agg(F.count("*").alias("rounds"))
    return rounds.withColumn("status", F.when(F.col("rounds") > max_rounds, TOO_MANY).otherwise("OK"))


def within_round_limit(calls: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """Calls of the first rounds of each thread. Only distinct rounds are ranked,
    each task keeping the few lowest, so a thread of any length costs one small
    group."""
    order = Window.partitionBy("conv_id").orderBy("round")
    rounds = calls.select("conv_id", "round").distinct().withColumn("nth", F.row_number().over(order))
    last = rounds.filter(F.col("nth") <= max_rounds).groupBy("conv_id").agg(F.max("round").alias("last_round"))
    return calls.join(last, "conv_id").filter(F.col("round") <= F.col("last_round")).drop("last_round")


def executed_calls(calls: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """The calls that are run: first of their round, within the round limit."""
    return one_tool_per_round(within_round_limit(calls, max_rounds))


def tools_used_so_far(calls: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """For each executed call the list of tools called up to it, as passed along
    with its result. Unknown tools add nothing. A thread's group holds at most
    ``max_rounds`` rows."""
    short = F.lit(None).cast("string")
    for name, form in SHORT_NAMES.items():
        short = F.when(F.col("name") == name, F.lit(f"name ({form}), ")).otherwise(short)
    upto = Window.partitionBy("conv_id").orderBy("round").rowsBetween(Window.unboundedPreceding, 0)
    used = F.array_join(F.collect_list(short).over(upto), "")
    return executed_calls(calls, max_rounds).select(*CALL, "name", used.alias("must_not_call"))


def repeat_tool_audit(calls: DataFrame) -> DataFrame:
    """Threads that call one tool more than once."""
    return calls.groupBy("conv_id", "name").agg(F.count("*").alias("times")).filter("times > 1")


def parsed_calls(calls: DataFrame) -> DataFrame:
    """Calls with their arguments as typed columns; what cannot be read is null."""
    whole = r"^\s*[+-]?\d+(\.0+)?\s*$"

    def number(name: str) -> Column:
        text = F.col(f"a.{name}")
        return F.when(text.rlike(whole), F.regexp_replace(text, r"\.0+\s*$", "").try_cast("bigint")).alias(name)

    def text(name: str) -> Column:
        """A text only if the JSON has one, not a number or other value."""
        quoted = F.col("args").rlike(rf'"{name}"\s*:\s*"')
        return F.when(quoted, F.col(f"a.{name}")).alias(name)

    return calls.withColumn("a", fn_args_from_json(F.col("args"), ARGS)).select(
        *calls.columns, "a.ids", text("vec_query"), text("database_name"), number("flag"), number("search_limit")
    )


def search_preset_check(calls: DataFrame, presets: tuple = PRESETS) -> DataFrame:
    """Search calls whose collection and limit are one of the presets."""
    allowed = calls.sparkSession.createDataFrame(presets, "database_name string, search_limit long")
    asked = parsed_calls(calls).filter(F.col("name") == SEARCH_TOOL)
    return asked.join(F.broadcast(allowed), ["database_name", "search_limit"], "left_semi")  # as many rows as presets


# Set-wise execution, one (conv_id, round, call_idx, result columns) row per call


def tool_get_descriptions(calls: DataFrame, goods: DataFrame) -> DataFrame:
    """(CALL, ids) to status, message and descriptions in the order of the ids."""
    clean = calls.select(*CALL, sanitize_ids(F.coalesce("ids", F.array().cast("array<string>"))).alias("ids"))
    asked = clean.filter(F.size("ids") > 0).select(F.struct(*CALL).alias("request_id"), "ids")
    listed = F.array_sort(F.collect_list(F.struct("pos", "description")))  # one call's own id list
    texts = (
        descriptions_by_ids(asked, goods)
        .groupBy("request_id")
        .agg(F.transform(listed, lambda d: d["description"]).alias("descriptions"))
        .select("request_id.*", F.lit("OK").alias("status"), F.lit(None).cast("string").alias("message"), "descriptions")
    )
    refused = clean.filter(F.size("ids") == 0).select(
        *CALL,
        F.lit("INVALID_ARGS").alias("status"),
        F.lit(NO_IDS).alias("message"),
        F.lit(None).cast("array<string>").alias("descriptions"),
    )
    return texts.unionByName(refused)


def _numbered(collections: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Each collection written once, with the price its content names and with ``shelf`` and ``row`` telling
    all rows apart, also those of one id, so that hits can go without their texts."""
    shelves = {}
    for shelf, (name, rows) in enumerate(collections.items()):
        own = rows.select(F.lit(shelf).alias("shelf"), F.monotonically_increasing_id().alias("row"), "id", "content", "embedding")
        shelves[name] = stored(chunk_price_extract(own), "collection")
    return shelves


def _by_text(calls: DataFrame, query_vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls with ``query_id``, the number of their text, in its place, and the vectors of these numbers. Texts are
    compared and moved here only, once for all collections."""
    texts = calls.select("vec_query").filter("vec_query is not null").distinct()
    texts = stored(texts.withColumn("query_id", F.monotonically_increasing_id()), "texts")
    vectors = stored(texts.join(query_vectors, "vec_query").select("query_id", "qvec"), "text-vectors")
    return stored(calls.join(texts, "vec_query").drop("vec_query"), "text-calls"), vectors


def _hits(calls: DataFrame, collection: DataFrame, vectors: DataFrame, *kept: str) -> DataFrame:
    """(CALL, query_id, k, flag, ...) to one row per hit: CALL, k, flag, the columns to be kept, rank, price,
    shelf and row, for a numbered collection. A text that many calls ask for is searched once, at the largest k; only the
    numbers of texts and of rows go along with the hits."""
    queries = calls.groupBy("query_id").agg(F.max("k").alias("k")).join(vectors, "query_id").select("query_id", "qvec", "k")
    hits = vector_topk_batch(queries, spread_small(collection.select("id", "embedding")), "k")
    found = hits.join(collection.select("id", "shelf", "row", "price"), "id").select("query_id", "rank", "shelf", "row", "price")
    found = stored(found, "hits")
    return calls.select(*CALL, "k", "flag", *kept, "query_id").join(found, "query_id").filter("rank <= k").drop("query_id")


def _search(calls: DataFrame, collection: DataFrame, query_vectors: DataFrame, *kept: str) -> DataFrame:
    """(CALL, vec_query, k, flag, ...) to one row per hit, see ``_hits``."""
    numbered, vectors = _by_text(calls.select(*CALL, "vec_query", "k", "flag", *kept), query_vectors)
    return _hits(numbered, collection, vectors, *kept)


def _by_call(rows: DataFrame, tasks: int) -> DataFrame:
    """Rows laid out by their call. Lists of goods shrink to a tenth when they are written, so the
    number of tasks follows from the number of calls instead of from the size of what is shuffled."""
    return rows.repartition(tasks, *CALL)


def _tasks(calls: DataFrame) -> int:
    return -(-calls.count() // CALLS_PER_TASK) or 1


def tool_vector_search(calls: DataFrame, collections: dict[str, DataFrame], query_vectors: DataFrame) -> DataFrame:
    """(CALL, vec_query, database_name, search_limit) to goods, best first. An
    unknown collection is left to the caller (see ``tool_call_batch``)."""
    asked, shelves = calls.withColumn("k", F.col("search_limit")), _numbered(collections)
    asked = asked.filter(F.col("database_name").isin(list(shelves))).select(*CALL, "vec_query", "database_name", "k", "flag")
    numbered, vectors = _by_text(asked, query_vectors)
    found = [_hits(numbered.filter(F.col("database_name") == name), rows, vectors) for name, rows in shelves.items()]
    return _with_goods(calls, _best_first(reduce(DataFrame.unionByName, found), shelves, _tasks(calls)))


def tool_price_band(calls: DataFrame, collection: DataFrame, query_vectors: DataFrame) -> DataFrame:
    """(CALL, vec_query, flag, search_limit) to the goods of the price band with
    their prices, cheapest first."""
    asked, shelves = calls.withColumn("k", search_pad(F.col("search_limit"))), _numbered({BRIEF_COLLECTION: collection})
    hits = _search(asked, shelves[BRIEF_COLLECTION], query_vectors)
    return _with_goods(calls, _cheapest_first(hits, shelves, _tasks(calls)))


def _texts(hits: DataFrame, shelves: dict[str, DataFrame]) -> DataFrame:
    """The contents of those hits that are listed at last."""
    contents = [rows.select("shelf", "row", "content") for rows in shelves.values()]
    return hits.join(reduce(DataFrame.unionByName, contents), ["shelf", "row"])


def _best_first(hits: DataFrame, shelves: dict[str, DataFrame], tasks: int) -> DataFrame:
    return _listed(_texts(hits.select(*CALL, "rank", "shelf", "row"), shelves), F.struct("rank", "content"), tasks)


def _cheapest_first(hits: DataFrame, shelves: dict[str, DataFrame], tasks: int) -> DataFrame:
    band = price_band(_by_call(priced_chunks_only(hits), tasks), search_limit="k", keys=CALL)
    band = _texts(band.select(*CALL, "price_pos", "price", "shelf", "row"), shelves)
    return _listed(band, F.struct("price_pos", "content", "price"), tasks)


def _listed(hits: DataFrame, item: Column, tasks: int) -> DataFrame:
    """One row per call with its hits in order; a call asked for as many as its
    own limit, which bounds the list."""
    return _by_call(hits, tasks).groupBy(*CALL).agg(F.array_sort(F.collect_list(item)).alias("goods"))


def _with_goods(calls: DataFrame, goods: DataFrame) -> DataFrame:
    """Every call, those without hits having null goods."""
    return calls.select(*CALL).join(goods, list(CALL), "left_outer")


def tool_search_text(calls: DataFrame, docs: DataFrame, k: int = 5, **options) -> DataFrame:
    """(CALL, text) to at most k chunks of the general texts by hybrid search."""
    queries = calls.select(F.xxhash64(*CALL).alias("query_id"), "text", *CALL)
    hits = hybrid_search(queries.select("query_id", "text"), docs, k, **options)
    return hits.join(queries.drop("text"), "query_id").select(*CALL, "rank", F.col("id").alias("chunk_id"), "score")


def _pair_list(goods: Column) -> Column:
    """``[[content, price], ...]`` as JSON text."""
    pair = lambda g: F.concat(F.rtrim(F.to_json(F.array(g["content"])), F.lit("]")), F.lit(","), g["price"], F.lit("]"))
    return F.concat(F.lit("["), F.array_join(F.transform(goods, pair), ","), F.lit("]"))


def checked_calls(calls: DataFrame, collections: list[str]) -> DataFrame:
    """Parsed calls with ``problem``, the error text of a call that cannot run."""
    name = F.col("name")
    given = {tool: F.lit(True) for tool in SHORT_NAMES}
    needed = {
        DESC_TOOL: ("ids",),
        SEARCH_TOOL: ("vec_query", "database_name", "search_limit"),
        PRICE_TOOL: ("vec_query", "flag", "search_limit"),
    }
    for tool, columns in needed.items():
        for column in columns:
            given[tool] = given[tool] & F.col(column).isNotNull()
    problem = F.when(name.isNull() | ~name.isin(*SHORT_NAMES), F.lit(UNKNOWN_TOOL))
    for tool, complete in given.items():
        problem = problem.when((name == tool) & ~complete, F.lit(f"ValidationError({tool})"))
    unknown = (name == SEARCH_TOOL) & ~F.col("database_name").isin(collections)
    return parsed_calls(calls).withColumn("problem", problem.when(unknown, F.lit("UnknownCollection()")))


def tool_call_batch(
    calls: DataFrame, goods: DataFrame, collections: dict[str, DataFrame], query_vectors: DataFrame
) -> DataFrame:
    """Run a log of calls: (CALL, name, content) with one JSON result per call.
    Bad arguments, unknown tools and unknown collections become error results.

    The checked log is written to the shared folder once, as every kind of call
    reads it. Searches and price bands on one collection share its scan.
    """
    path = shared_folder(calls.sparkSession, "calls")
    checked_calls(calls, list(collections)).write.parquet(path)
    checked = calls.sparkSession.read.parquet(path)
    good, name, tasks = checked.filter("problem is null"), F.col("name"), _tasks(checked)

    banded = name == PRICE_TOOL
    asked = good.filter(name.isin(SEARCH_TOOL, PRICE_TOOL)).select(
        *CALL,
        "name",
        "vec_query",
        "flag",
        banded.alias("banded"),
        F.when(banded, BRIEF_COLLECTION).otherwise(F.col("database_name")).alias("database_name"),
        F.when(banded, search_pad(F.col("search_limit"))).otherwise(F.col("search_limit")).alias("k"),
    )
    shelves = _numbered(collections)
    numbered, vectors = _by_text(asked.drop("name"), query_vectors)
    hits = reduce(
        DataFrame.unionByName,
        [_hits(numbered.filter(F.col("database_name") == c), rows, vectors, "banded") for c, rows in shelves.items()],
    )
    searched = _best_first(hits.filter("not banded"), shelves, tasks).select(
        *CALL, F.to_json(F.transform("goods", lambda g: g["content"])).alias("list")
    )
    banded_goods = _cheapest_first(hits.filter("banded"), shelves, tasks).select(
        *CALL, _pair_list(F.col("goods")).alias("list")
    )
    nothing = F.when(banded & ~F.col("flag").isin(1, 2, 3), "null").otherwise("[]")
    listed = _by_call(searched.unionByName(banded_goods), tasks)
    found = _by_call(asked.select(*CALL, "name", "flag"), tasks).join(listed, list(CALL), "left_outer").select(
        *CALL, "name", F.concat(F.lit('{"goods":'), F.coalesce("list", nothing), F.lit("}")).alias("content")
    )
    described = tool_get_descriptions(good.filter(name == DESC_TOOL), goods).select(
        *CALL, F.lit(DESC_TOOL).alias("name"), F.to_json(F.struct("status", "message", "descriptions")).alias("content")
    )
    failed = checked.filter("problem is not null").select(
        *CALL, "name", F.to_json(F.struct(F.col("problem").alias("error"))).alias("content")
    )
    return found.unionByName(described).unionByName(failed)


def tool_loop_batch(
    calls: DataFrame, goods: DataFrame, collections: dict[str, DataFrame], query_vectors: DataFrame
) -> DataFrame:
    """Run a log as the loop does: of every round the first call, of every thread
    the first rounds. Each result carries the call's id and the tools used up to it;
    a thread of more rounds has one row more, with the status for content.
    """
    used = stored(tools_used_so_far(calls).drop("name"), "tools-used")
    ran, tasks = tool_call_batch(executed_calls(calls), goods, collections, query_vectors), _tasks(used)
    results = _by_call(ran, tasks).join(_by_call(used, tasks), list(CALL)).select(
        *CALL, "name", F.concat_ws("-", *CALL).alias("tool_call_id"), "must_not_call", "content"
    )
    over = tool_round_limit(calls).filter(F.col("status") == TOO_MANY)
    none = [F.lit(None).cast(results.schema[c].dataType).alias(c) for c in results.columns[1:-1]]
    return results.unionByName(over.select("conv_id", *none, F.col("status").alias("content")))
