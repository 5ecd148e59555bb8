"""Tool-call logs, loading with an error budget, streaming, plans."""

import json

import pytest
from pyspark.sql import functions as F

from lavka.operators import goods as goods_ops
from lavka.operators import ann, ingest, ranking, tools
from lavka.operators.skew import spread_join
from lavka.plans import views
from lavka.streaming.ingest import ingest_stream, load_batch, loaded_rows

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.fixture(scope="module")
def shop(spark):
    goods = spark.createDataFrame(
        [(i, f"g{i}", f"c{i}", str(100 - i), "ch", "d" * 2000 if i == 1 else None) for i in range(30)],
        "good_id long, title string, code string, price string, characteristics string, description string",
    )
    chunks = spark.createDataFrame(
        [(i, f"ID {i} g{i}. Цена за единицу в рублях: {100 - i}.0", [1.0, i / 10]) for i in range(30)],
        "id long, content string, embedding array<float>",
    )
    vectors = spark.createDataFrame([("q", [1.0, 0.0])], "vec_query string, qvec array<float>")
    return goods, {tools.FULL_COLLECTION: chunks, tools.BRIEF_COLLECTION: chunks}, vectors


def run(spark, shop, *calls):
    log = spark.createDataFrame(
        [(1, i, 0, name, args if isinstance(args, str) else json.dumps(args)) for i, (name, args) in enumerate(calls)],
        "conv_id long, round int, call_idx int, name string, args string",
    )
    rows = tools.tool_call_batch(log, *shop).orderBy("round").collect()
    assert len(rows) == len(calls)
    return [json.loads(r.content) for r in rows]


def test_calls_of_every_kind(spark, shop):
    search = {"vec_query": "q", "database_name": tools.FULL_COLLECTION, "search_limit": 3}
    results = run(
        spark,
        shop,
        (tools.DESC_TOOL, {"ids": [2.0, "2", "x", 99]}),
        (tools.DESC_TOOL, {"ids": ["1"]}),
        (tools.DESC_TOOL, {"ids": [1, 2, "nan"]}),
        (tools.DESC_TOOL, {"ids": ["nan"]}),
        (tools.DESC_TOOL, {"ids": []}),
        (tools.SEARCH_TOOL, search),
        (tools.SEARCH_TOOL, {**search, "vec_query": "never seen"}),
        (tools.PRICE_TOOL, {"vec_query": "q", "flag": 1, "search_limit": 4}),
        (tools.PRICE_TOOL, {"vec_query": "q", "flag": 7, "search_limit": 4}),
        (tools.PRICE_TOOL, {"vec_query": "q", "flag": 3, "search_limit": 90}),
    )
    assert results[0] == {"status": "OK", "descriptions": ["g2 Артикул: c2. Цена в рублях: 98. ch", ""]}
    assert results[1]["descriptions"][0].endswith("ch " + "d" * 1400 + " … [truncated]")
    assert results[2]["descriptions"][0].endswith("ch " + "d" * 800 + " … [truncated]")
    assert results[3] == results[4] == {"status": "INVALID_ARGS", "message": "ids пусты/некорректны"}
    assert [g.split()[1] for g in results[5]["goods"]] == ["0", "1", "2"]
    assert results[6] == {"goods": []}
    assert [price for _, price in results[7]["goods"]] == [94, 95, 96, 97, 98, 99, 100]
    assert results[8] == {"goods": None} and results[9] == {"goods": []}


def test_bad_calls_become_errors(spark, shop):
    results = run(
        spark,
        shop,
        ("Nothing", {}),
        (tools.DESC_TOOL, '{"ids":[1,'),
        (tools.DESC_TOOL, {"ids": "1"}),
        (tools.SEARCH_TOOL, {"vec_query": "q", "database_name": tools.FULL_COLLECTION}),
        (tools.SEARCH_TOOL, {"vec_query": "q", "database_name": "Other", "search_limit": 1}),
        (tools.PRICE_TOOL, {"vec_query": "q", "flag": "two", "search_limit": 1}),
    )
    assert all(list(r) == ["error"] for r in results)
    assert results[0]["error"] == tools.UNKNOWN_TOOL


def log_of(spark, *rows):
    return spark.createDataFrame([(*r, "{}") for r in rows], "conv_id long, round int, call_idx int, name string, args string")


def test_rules_between_calls(spark):
    rows = [(1, r, c, tools.DESC_TOOL if r % 2 else tools.PRICE_TOOL) for r in range(1, 8) for c in (1, 0)]
    log = log_of(spark, *rows, (2, 5, 3, "Other"))
    assert {(r.conv_id, r.rounds, r.status) for r in tools.tool_round_limit(log).collect()} == {(1, 7, tools.TOO_MANY), (2, 1, "OK")}
    assert {(r.conv_id, r.round, r.call_idx) for r in tools.executed_calls(log).collect()} == {(1, r, 0) for r in range(1, 5)} | {(2, 5, 3)}
    used = {(r.conv_id, r.round): r.must_not_call for r in tools.tools_used_so_far(log).collect()}
    assert used[(1, 1)] == "name (DESC), " and used[(1, 3)] == "name (DESC), name (PRICE), name (DESC), " and used[(2, 5)] == ""
    assert {(r.conv_id, r.name, r.times) for r in tools.repeat_tool_audit(log).collect()} == {(1, tools.DESC_TOOL, 8), (1, tools.PRICE_TOOL, 6)}


def plain_budget(bad, size, most):
    kept, errors = [], 0
    for start in range(0, len(bad), size):
        if errors > most:
            break
        kept += [i for i in range(start, min(start + size, len(bad))) if not bad[i]]
        errors += sum(bad[start : start + size])
    return kept


@pytest.mark.parametrize("bad_at", [[], [0, 1, 2, 3, 4], [0, 1, 2, 3, 4, 5], [29, 30, 31, 59, 60, 61, 62], list(range(0, 100, 7)), list(range(100))])
def test_error_budget(spark, bad_at):
    bad = [i in bad_at for i in range(100)]
    df = spark.createDataFrame([(i, None if b else "x") for i, b in enumerate(bad)], "pos long, name string").repartition(3)
    kept = sorted(r.pos for r in ingest.ingest_error_budget(df, F.col("name").isNull()).collect())
    assert kept == plain_budget(bad, 30, 5)
    report = ingest.failed_rows_report(df, F.col("name").isNull()).first()
    states = ingest.loading_state(df, F.col("name").isNull()).groupBy("state").count().collect()
    counts = {r["state"]: r["count"] for r in states}
    loaded_bad = [i for i in bad_at if i // 30 <= (sorted(bad_at)[5] // 30 if len(bad_at) > 5 else 10)]
    assert report.failed == len(loaded_bad) == counts.get("bad", 0) and report.first_pos == (min(bad_at) if bad_at else None)
    assert sum(counts.values()) == 100 and counts.get("accepted", 0) == len(kept)


def streamed(spark, folder, sheet, portions, corrections=None):
    """The rows loaded after each portion has arrived, in its turn."""
    out, progress = str(folder / "out"), str(folder / "progress")
    sheet.filter("false").write.parquet(str(folder / "again" / "none"))
    results = []
    for number, portion in enumerate(portions):
        portion.write.parquet(str(folder / "in" / str(number)))
        if corrections is not None and number in corrections:
            corrections[number].write.parquet(str(folder / "again" / str(number)))
        stream, again = (spark.readStream.schema(sheet.schema).parquet(str(folder / x / "*")) for x in ("in", "again"))
        ingest_stream(stream, out, progress, again if corrections is not None else None).awaitTermination()
        results.append({tuple(r) for r in loaded_rows(spark, out).collect()})
    return results


def test_portions_equal_one_batch(spark, tmp_path):
    """The budget runs on over portions whose borders lie inside loading batches; repeated ones change nothing."""
    sheet = views.defects(spark, SF).select("pos", F.when(F.col("pos") % 19 > 0, F.col("name")).alias("name"), "unit", "price")
    thirds = [sheet.filter("pos < 50"), sheet.filter("pos between 50 and 98"), sheet.filter("pos > 98")]
    whole = {("", *tuple(r)) for r in load_batch(sheet).collect()}
    assert {r[3] for r in whole} == {"accepted", "bad", "not_loaded"}
    found = streamed(spark, tmp_path / "a", sheet, [thirds[0], thirds[0], thirds[1], thirds[2], thirds[1], sheet])
    assert found[0] == found[1] and found[3] == found[4] == found[5] == whole
    (once,) = streamed(spark, tmp_path / "b", sheet, [sheet])
    assert once == whole


def test_rejected_rows_come_back(spark, tmp_path):
    kind = "source string, pos long, name string, unit string, price double"
    rows = [("x", n, None if n < 8 else f"x{n}", "pc", 1.0) for n in range(70)] + [("y", n, f"y{n}" if n else None, "pc", 2.0) for n in range(40)]
    rows += [(None, 3, "plain", "pc", 3.0), ("y", None, "no place", "pc", 3.0), ("y", 5, "double", "pc", 3.0)]
    sheet = spark.createDataFrame(rows, kind)
    mended = [("x", 2, "mended", "pc", 1.0), ("x", 65, "x65", "pc", 9.0), ("x", 20, "was accepted", "pc", 1.0), ("x", 900, "unknown", "pc", 1.0),
              ("y", 0, None, "pc", 1.0), ("y", 5, "was accepted", "pc", 1.0)]
    later = [("y", n, f"y{n}", "pc", 2.0) for n in range(40, 50)] + [("x", n, f"x{n}", "pc", 1.0) for n in range(70, 80)]
    portions = [sheet, spark.createDataFrame(later, kind), sheet]
    found = streamed(spark, tmp_path, sheet, portions, {1: spark.createDataFrame(mended, kind), 2: spark.createDataFrame(mended, kind)})
    first, second, third = ({(r[0], r[1]): (r[2], r[3]) for r in x} for x in found)
    assert len(first) == 111 == len(found[0]) and second == third
    assert [first["x", n][1] for n in (0, 7, 8, 29, 30, 69)] == ["bad", "bad", "accepted", "accepted", "not_loaded", "not_loaded"]
    assert first["y", 0][1] == "bad" and first["y", 39][1] == first["", 3][1] == "accepted"
    assert second["x", 2][1] == second["x", 65][1] == "accepted" and second["x", 2][0].startswith("mended")
    assert second["x", 20] == first["x", 20] and second["y", 5] == first["y", 5] and ("x", 900) not in second
    assert second["y", 0][1] == "bad" and second["y", 45][1] == "accepted" and second["x", 75][1] == "not_loaded"


def test_numbers_are_no_texts(spark):
    log = [(1, 1, n, tools.SEARCH_TOOL, a) for n, a in enumerate(['{"vec_query": 12, "database_name": "x"}', '{"vec_query" : "12"}'])]
    calls = spark.createDataFrame(log, "conv_id long, round int, call_idx int, name string, args string")
    assert [(r.vec_query, r.database_name) for r in tools.parsed_calls(calls).orderBy("call_idx").collect()] == [(None, "x"), ("12", None)]


def test_loop_runs_first_calls_of_four_rounds(spark):
    from lavka.plans import retrieval_queries as rq

    log = [("c", r, i, "WebSearch" if r == 2 else tools.DESC_TOOL, '{"ids": ["1"]}') for r in range(1, 7) for i in range(2)]
    calls = spark.createDataFrame(log, "conv_id string, round int, call_idx int, name string, args string")
    calls = calls.withColumn("conv_id", F.lit(77).cast("long"))
    loop = tools.tool_loop_batch(calls, views.goods(spark, SF), rq.collections(spark, SF), views.query_vectors(spark, SF))
    rows = sorted(map(tuple, loop.collect()), key=lambda r: (r[1] is None, r[1]))
    assert [r[1:5] for r in rows[:-1]] == [
        (n, 0, "WebSearch" if n == 2 else tools.DESC_TOOL, f"77-{n}-0") for n in range(1, 5)
    ]
    assert [r[5].count("DESC") for r in rows[:-1]] == [1, 1, 2, 3] and rows[-1] == (77, None, None, None, None, None, tools.TOO_MANY)


# Plans


def test_blocks_of_queries_are_scans_without_a_corpus_shuffle(spark):
    chunks = views.table(spark, SF, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    hits = ranking.vector_topk_batch(views.queries(spark, SF), chunks, 10, block_queries=3)
    text = plan(hits)
    assert text.count("MapInArrow") > 1 and "CoGroup" not in text
    below = [line for line in text.splitlines() if "Exchange" in line and "embedding" in line]
    assert not below
    one = ranking.vector_topk_batch(views.queries(spark, SF), chunks, 10)
    assert sorted(map(tuple, hits.collect())) == sorted(map(tuple, one.collect()))


def test_vectors_of_other_lengths_never_score(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [1.0]), (4, None)], "id long, embedding array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0, 1.0]), (3, [1.0] * 4)], "query_id long, qvec array<double>")
    found = {(r.query_id, r.id) for r in ranking.vector_topk_batch(queries, corpus, 5).collect()}
    assert found == {(1, 1), (2, 2)}


def test_hot_key_is_dealt_over_parts(spark):
    many = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).alias("k"))
    few = spark.createDataFrame([(7, "hot"), (0, "cold"), (7, "twice"), (None, "none")], "k long, name string")
    joined = spread_join(many, few, "k", rows_per_part=100)
    assert joined.columns == ["k", "id", "name"]
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, many.join(few, "k").collect()))
    left = spread_join(many, few, "k", "left_outer", rows_per_part=100)
    assert left.count() == many.join(few, "k", "left_outer").count()


def scan_metric(frame, name):
    """A metric of the only file scan of a frame, after running it."""
    query = frame._jdf.queryExecution()
    query.executedPlan().executeCollect()
    plan = query.executedPlan()
    plan = plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    leaves = plan.collectLeaves()
    assert leaves.size() == 1
    return leaves.apply(0).metrics().get(name).get().value()


def test_lookup_reads_few_files(spark, tmp_path):
    n = 20_000
    goods = spark.range(n).selectExpr(
        "id AS good_id", "concat('t', id) AS title", "'c' AS code", "id / 2 AS price", "'ch' AS characteristics", "repeat('d', 50) AS description"
    )
    goods = goods.unionByName(goods.filter("good_id % 1000 = 7").withColumn("title", F.lit("a first one")))
    goods_ops.write_goods_lookup(goods, str(tmp_path / "lookup"))
    lookup = goods_ops.open_goods_lookup(spark, str(tmp_path / "lookup"))
    assert lookup.goods.count() == n
    files = len(list((tmp_path / "lookup").glob("*/*.parquet")))
    one = spark.createDataFrame([(7,), (99_999,)], "good_id long")
    found = goods_ops.goods_of_ids(one, lookup)
    assert [r.title for r in found.collect()] == ["a first one"]
    assert files >= 31 and scan_metric(found, "numFiles") <= 2
    many = spark.range(0, n, 5).withColumnRenamed("id", "good_id")
    assert goods_ops.goods_of_ids(many, lookup).count() == n // 5


@pytest.mark.parametrize("sent", [8 << 20, 0])
def test_descriptions_by_either_way(spark, tmp_path, monkeypatch, sent):
    monkeypatch.setattr(goods_ops, "SENT_BYTES", sent)
    requests = [(1, [3]), (2, [3, 5, 99]), (3, []), (4, None), (5, [5, 5])] + [(n, [7, n % 11]) for n in range(10, 60)]
    asked = spark.createDataFrame(requests, "request_id long, ids array<long>")
    row = lambda n, title, price: (n, title, f"c{n}", price, None, "long " * 400)
    goods = [row(n, f"t{n}", n / 4) for n in range(10)] + [row(7, "a", 9.5), row(7, "a", 10.5)]
    frame = spark.createDataFrame(goods, "good_id long, title string, code string, price double, characteristics string, description string")
    goods_ops.write_goods_lookup(frame, str(tmp_path / "lookup"))
    lookup = goods_ops.open_goods_lookup(spark, str(tmp_path / "lookup"))
    plain = sorted(map(tuple, goods_ops.descriptions_by_ids(asked, frame).collect()))
    assert sorted(map(tuple, goods_ops.descriptions_by_ids(asked, lookup).collect())) == plain
    assert len(plain) == 1 + 3 + 2 + 100 and [r for r in plain if r[2] == 99] == [(2, 2, 99, "")]
    assert {r[3][:9] for r in plain if r[2] == 7} == {"a Артикул"}
    final = goods_ops.descriptions_by_ids(asked, lookup)
    if sent:
        assert "Exchange hashpartitioning" not in plan(final)  # requests stay where they are


@pytest.mark.parametrize("bits", [16, 600])  # one page of bits and several
def test_goods_are_sifted_before_their_join(spark, monkeypatch, bits):
    """Texts nobody asks for are dropped at their own table; every good that is asked for stays."""
    monkeypatch.setattr(goods_ops, "BITS_PER_ID", bits)
    shelf = spark.range(20_000).selectExpr("if(id = 5, null, id) AS good_id", "concat('t', id) AS title")
    texts = spark.range(0, 30_000, 2).selectExpr("id AS good_id", "repeat('d', 50) AS description")
    goods = shelf.join(texts, "good_id", "left_outer")
    ids = spark.createDataFrame([(i * i,) for i in range(130)] + [(-7,), (1 << 62,)], "good_id long")
    few = goods_ops.sifted(goods, ids)
    assert few.count() < 2000
    asked = few.join(ids, "good_id", "left_semi")
    assert sorted(map(tuple, asked.collect())) == sorted(map(tuple, goods.join(ids, "good_id", "left_semi").collect()))
    optimized = few._jdf.queryExecution().optimizedPlan().toString()
    assert len([line for line in optimized.splitlines() if "Filter" in line and "getbit" in line]) == 2
    assert goods_ops.sifted(goods.limit(9), ids.filter("good_id > 9 and good_id < 12")).count() == 9  # no id, nothing to tell


def test_equal_rows_of_a_hot_key_part(spark, tmp_path):
    """300,000 equal requests: every part of the join holds its share of them and no more."""
    many = spark.range(300_000).select(F.lit("same").alias("cat"), F.lit(1).alias("request_id"))
    many = many.unionByName(spark.createDataFrame([("rare", 2), (None, 3)], "cat string, request_id int"))
    few = spark.createDataFrame([("same", 5), ("rare", 6), ("none", 7)], "cat string, search_limit int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", 64)
    try:
        joined = spread_join(many, few, "cat", rows_per_part=10_000)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id().alias("task")).count().collect()]
        assert sum(sizes) == 300_001 and max(sizes) <= 6 * 10_000, sorted(sizes)  # a task may get some parts by chance
        assert len([n for n in sizes if n >= 10_000]) >= 15
    finally:
        for name in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled"):
            spark.conf.unset(name)
        spark.conf.set("spark.sql.shuffle.partitions", 8)


def test_thousands_of_centres_plan_at_once(spark):
    import time

    rows = views.table(spark, SF, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    centres = [[float((i * j) % 7 + 1) for i in range(64)] for j in range(4096)]
    start = time.perf_counter()
    rows.select(ann.nearest_centre(F.col("embedding"), centres).bucket).explain()
    assert time.perf_counter() - start < 10


def test_topk_moves_no_corpus_row(spark):
    chunks = views.table(spark, SF, "embeddings").select(F.col("vec_id").alias("id"), F.lit("x").alias("content"), "embedding")
    hits = ranking.with_content(ranking.vector_topk_batch(views.queries(spark, SF), chunks, 10), chunks)
    text = plan(hits)
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text and "Cartesian" not in text and "NestedLoop" not in text


def test_one_query_is_a_sort_with_limit(spark):
    chunks = views.table(spark, SF, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    text = plan(ranking.vector_topk([0.1] * 64, chunks))
    assert "TakeOrderedAndProject" in text and "Python" not in text


def test_round_limit_cuts_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(tools.within_round_limit(views.tool_calls(spark, SF)))


def test_lookup_is_pushed_to_the_scan(spark, tmp_path):
    views.goods(spark, SF).write.parquet(str(tmp_path / "goods"))
    text = plan(goods_ops.good_by_id(spark.read.parquet(str(tmp_path / "goods")), 7).select("title"))
    assert "EqualTo(good_id,7)" in text and "ReadSchema: struct<good_id:bigint,title:string>" in text


def test_hits_go_without_texts(spark, shop):
    from lavka.operators.tools import _numbered, _search

    _, collections, vectors = shop
    calls = spark.createDataFrame([(1, r, 0, "q", 1, 4 + r, "{}") for r in range(3)], "conv_id long, round int, call_idx int, vec_query string, flag int, k long, args string")
    shelves = _numbered(collections)
    found = _search(calls, shelves[tools.BRIEF_COLLECTION], vectors)
    assert {f.name for f in found.schema.fields if f.dataType.simpleString() not in ("bigint", "int")} == set()
    assert found.groupBy("round").count().orderBy("round").collect() == [(0, 4), (1, 5), (2, 6)]


def test_results_are_spread_by_the_number_of_calls(spark, shop, monkeypatch):
    monkeypatch.setattr(tools, "CALLS_PER_TASK", 5)
    args = json.dumps({"vec_query": "q", "flag": 1, "search_limit": 40})
    log = [(c, 1, 0, tools.PRICE_TOOL, args) for c in range(31)]
    calls = spark.createDataFrame(log, "conv_id long, round int, call_idx int, name string, args string")
    loop = tools.tool_loop_batch(calls, *shop)
    rows = {r.conv_id: json.loads(r.content)["goods"] for r in loop.collect()}
    assert sorted(rows) == list(range(31)) and all(len(g) == 15 and g == rows[0] for g in rows.values())
    assert "conv_id#" in plan(loop) and ", 7), REPARTITION_BY_NUM" in plan(loop)


def test_a_page_of_positions_is_read_and_written_once(spark):
    from pyspark.sql import Row

    from lavka.streaming.ingest import FirstSeen

    class State:
        held, reads, writes = None, 0, 0

        def getValueState(self, *_):
            return self

        def get(self):
            self.reads += 1
            return self.held

        def update(self, value):
            self.writes += 1
            self.held = value

    state, seen = State(), FirstSeen()
    seen.init(state)

    def portion(*rows):
        rows = [Row(source="s", pos=p, content=c, corrected=k) for p, c, k in rows]
        return [(r.pos, r.content) for r in seen.handleInputRows(("s", 0), iter(rows), None)]

    assert portion(*[(p, "a", False) for p in range(1000)], (5, "b", False)) == [(p, "b" if p == 5 else "a") for p in range(1000)]
    assert (state.reads, state.writes) == (1, 1)
    assert portion((5, "c", False), (1 << 40, None, False), (6, "d", True), (-7, "e", True)) == [(6, "d"), (1 << 40, None)]
    assert portion((1 << 40, "f", True), (3, "g", False)) == [(1 << 40, "f")]
    assert (state.reads, state.writes) == (3, 2)
