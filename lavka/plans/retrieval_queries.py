"""Queries of ranking, price bands, descriptions and tool-call logs."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from lavka.functions import text as fn
from lavka.functions.vectors import cosine_score as cosine
from lavka.operators import ann, goods as ops, lexical, ranking, tools
from lavka.plans import views
from lavka.plans.registry import query
from lavka.plans.views import table
from lavka.session import shared_folder

# A fixed query vector.
QUERY_VECTOR = [round(math.cos(i * i), 4) for i in range(64)]


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings", heavy=True).select(F.col("vec_id").alias("id"), "embedding")


# Vector ranking


@query(
    """SELECT a.vec_id AS id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"""
)
def cosine_score(spark, sf_dir):
    """Each vector against the one numbered next."""
    own = vectors(spark, sf_dir)
    after = own.select((F.col("id") - 1).alias("id"), F.col("embedding").alias("other"))
    return own.join(after, "id").select("id", cosine(F.col("embedding"), F.col("other")).alias("score"))


@query(
    """SELECT query_id, count(*) AS compared, round(avg(score), 6) AS mean_score, round(max(score), 6) AS best_score FROM (
    SELECT query_id, list_cosine_similarity(CAST(qvec AS DOUBLE[]), CAST(embedding AS DOUBLE[])) AS score
    FROM queries, embeddings) GROUP BY query_id""",
    "queries",
)
def query_corpus_join(spark, sf_dir):
    return ranking.query_corpus_join(views.queries(spark, sf_dir), vectors(spark, sf_dir))


@query(
    f"""SELECT vec_id AS id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST({QUERY_VECTOR} AS DOUBLE[])), 6) AS score
    FROM embeddings ORDER BY score DESC, id LIMIT 10"""
)
def vector_topk(spark, sf_dir):
    return ranking.vector_topk(QUERY_VECTOR, vectors(spark, sf_dir), 10)


@query("SELECT query_id, id, score, rank FROM ranked WHERE rank <= search_limit", "ranked")
def vector_topk_batch(spark, sf_dir):
    return ranking.vector_topk_batch(views.queries(spark, sf_dir), views.brief_collection(spark, sf_dir), "search_limit")


@query(
    """SELECT query_id, id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank
    FROM (SELECT query_id, vec_id AS id, round(list_cosine_similarity(CAST(qvec AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS score
    FROM queries, embeddings)) WHERE rank <= 10""",
    "queries",
)
def hit_rank(spark, sf_dir):
    """Places within the ten nearest vectors of each query."""
    hits = ranking.vector_topk_batch(views.queries(spark, sf_dir), vectors(spark, sf_dir), 10)
    return ranking.hit_rank(hits.drop("rank"))


@query(
    """SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM (
    SELECT query_id, vec_id AS id, round(list_cosine_similarity(CAST(qvec AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS score
    FROM queries, embeddings) QUALIFY rank <= 10""",
    "queries",
)
def ann_search(spark, sf_dir):
    """Laid out by the mean vector of each label, searched until no bucket can change the result."""
    rows = table(spark, sf_dir, "embeddings", heavy=True)
    cells = rows.select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("place", "x"))
    means = cells.groupBy("label", "place").agg(F.avg("x").alias("x")).groupBy("label")
    listed = means.agg(F.array_sort(F.collect_list(F.struct("place", "x"))).alias("c")).orderBy("label")
    centres = [row.x for row in listed.select("c.x").collect()]  # one vector per label
    path = shared_folder(spark, "ann")
    ann.write_ann_layout(vectors(spark, sf_dir), path, centres)
    return ann.ann_search(views.queries(spark, sf_dir), ann.open_ann_layout(spark, path), 10)


# Text ranking


@query("SELECT chunk_id, doc_id, chunk_no, content FROM chunks", "chunks")
def static_chunking(spark, sf_dir):
    return lexical.static_chunking(table(spark, sf_dir, "documents", heavy=True))


@query("SELECT query_id, id, score, rank FROM bm25_ranked WHERE rank <= 50", "bm25_ranked")
def lexical_bm25(spark, sf_dir):
    """The 50 best chunks of each query."""
    return lexical.lexical_bm25(views.text_queries(spark, sf_dir), static_chunking(spark, sf_dir), 50)


@query("SELECT query_id, id, score, rank FROM tfidf_ranked WHERE rank <= 50", "tfidf_ranked")
def text_near_search(spark, sf_dir):
    """The 50 nearest chunks of each query."""
    return lexical.text_near_search(views.text_queries(spark, sf_dir), static_chunking(spark, sf_dir), 50)


def both_lists(spark, sf_dir):
    """The chunks that can be among the five best, with their ranks among all chunks."""
    return lexical.fusion_lists(views.text_queries(spark, sf_dir), static_chunking(spark, sf_dir), 5)


# Without any list length: every chunk of the fused lists that five others do not surely precede.
CANDIDATES = "FROM fused WHERE lexical_rank <= 70 OR vector_rank <= 70"


@query(f"SELECT query_id, id, lexical_rank, vector_rank {CANDIDATES}", "fused")
def hybrid_rank_join(spark, sf_dir):
    return lexical.hybrid_rank_join(*both_lists(spark, sf_dir))


@query(f"SELECT query_id, id, lexical_rank, vector_rank, score {CANDIDATES}", "fused")
def rrf_fusion(spark, sf_dir):
    return lexical.rrf_fusion(*both_lists(spark, sf_dir))


TOP5 = """SELECT query_id, id, lexical_rank, vector_rank, score, rank FROM (SELECT *,
    CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM fused) WHERE rank <= 5"""


@query(TOP5, "fused")
def hybrid_top5(spark, sf_dir):
    return lexical.hybrid_top5(rrf_fusion(spark, sf_dir))


@query(TOP5, "fused")
def hybrid_search(spark, sf_dir):
    return lexical.hybrid_search(views.text_queries(spark, sf_dir), table(spark, sf_dir, "documents", heavy=True))


# Price bands


def padded_hits(spark, sf_dir):
    """The nearest goods of each query, limit + 3 of them, with their prices."""
    queries = views.queries(spark, sf_dir).withColumn("search_limit", fn.search_pad(F.col("search_limit")))
    chunks = views.brief_collection(spark, sf_dir)
    hits = ranking.with_content(ranking.vector_topk_batch(queries, chunks, "search_limit"), chunks)
    priced = ops.priced_chunks_only(ops.chunk_price_extract(hits))
    return priced.join(queries.select("query_id", "flag", "search_limit"), "query_id")


@query("SELECT query_id, id, rank, price, price_pos FROM priced", "priced")
def sort_by_price(spark, sf_dir):
    return ops.sort_by_price(padded_hits(spark, sf_dir)).select("query_id", "id", "rank", "price", "price_pos")


def _cut(x: str) -> str:
    return f"CASE WHEN {x} < 0 THEN greatest(0, {x} + n_hits) ELSE least({x}, n_hits) END"


BAND = f"""SELECT query_id, flag, id, rank, price, price_pos FROM (SELECT *,
    CASE flag WHEN 1 THEN 0 WHEN 2 THEN search_limit // 2 - 7 WHEN 3 THEN search_limit - 15 END AS a,
    CASE flag WHEN 1 THEN 15 WHEN 2 THEN search_limit // 2 + 7 WHEN 3 THEN search_limit - 1 END AS b FROM priced)
    WHERE price_pos >= {_cut('a')} AND price_pos < {_cut('b')}"""
BAND_COLUMNS = ("query_id", "flag", "id", "rank", "price", "price_pos")


@query(BAND, "priced")
def price_band(spark, sf_dir):
    return ops.price_band(padded_hits(spark, sf_dir)).select(*BAND_COLUMNS)


@query(
    """SELECT query_id, flag, id, rank, price, price_pos FROM priced WHERE CASE flag WHEN 1 THEN price_pos < 15
    WHEN 2 THEN price_pos >= n_hits // 2 - 7 AND price_pos < n_hits // 2 + 7 ELSE price_pos >= n_hits - 15 END""",
    "priced",
)
def price_band_found(spark, sf_dir):
    return ops.price_band_found(padded_hits(spark, sf_dir)).select(*BAND_COLUMNS)


@query("SELECT query_id, search_limit + 3 AS padded, search_limit + search_limit // 100 * 5 AS padded_old FROM queries", "queries")
def search_pad(spark, sf_dir):
    limit = F.col("search_limit")
    return views.queries(spark, sf_dir).select(
        "query_id", fn.search_pad(limit).alias("padded"), fn.search_pad(limit, "per_hundred").alias("padded_old")
    )


# Descriptions


def clean_requests(spark, sf_dir):
    return views.id_requests(spark, sf_dir).select("request_id", fn.sanitize_ids(F.col("ids")).alias("ids"))


@query("SELECT request_id, CAST(pos AS INTEGER) AS pos, good_id FROM clean_ids", "clean_ids")
def sanitize_ids(spark, sf_dir):
    return clean_requests(spark, sf_dir).select("request_id", F.posexplode("ids").alias("pos", "good_id"))


@query(
    """SELECT request_id, CAST(spot AS INTEGER) AS pos, one AS id FROM (SELECT request_id, unnest(ids) AS one,
    unnest(range(len(ids))) AS spot FROM id_requests) WHERE spot < 2""",
    "id_requests",
)
def request_id_cap(spark, sf_dir):
    kept = fn.request_id_cap(F.col("ids"))
    return views.id_requests(spark, sf_dir).select("request_id", F.posexplode(kept).alias("pos", "id"))


def _cut_body(n: int) -> str:
    return f"CASE WHEN length(body) <= {n} THEN body ELSE substr(body, 1, {n}) || ' … [truncated]' END"


SHORT = f"coalesce(rtrim(head || CASE WHEN n_ids = 1 THEN {_cut_body(1400)} ELSE {_cut_body(800)} END, ' ' || chr(10)), '')"


DESCRIBED = f"""SELECT request_id, CAST(pos AS INTEGER) AS pos, c.good_id, {SHORT} AS description FROM clean_ids c
    LEFT JOIN described d ON d.good_id = c.good_id"""


@query(DESCRIBED, "clean_ids", "described")
def descriptions_by_ids(spark, sf_dir):
    return ops.descriptions_by_ids(clean_requests(spark, sf_dir), views.goods(spark, sf_dir))


@query(DESCRIBED, "clean_ids", "described")
def descriptions_from_lookup(spark, sf_dir):
    """The same from goods stored for look-ups."""
    path = shared_folder(spark, "goods-lookup")
    ops.write_goods_lookup(views.goods(spark, sf_dir), path)
    return ops.descriptions_by_ids(clean_requests(spark, sf_dir), ops.open_goods_lookup(spark, path))


# Tool-call logs


def calls(spark, sf_dir):
    return views.tool_calls(spark, sf_dir)


views.SQL["first_calls"] = (
    ("tool_calls",),
    "SELECT * FROM (SELECT *, min(call_idx) OVER (PARTITION BY conv_id, round) AS first_idx FROM tool_calls) WHERE call_idx = first_idx",
)
views.SQL["executed"] = (
    ("first_calls",),
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY round) AS nth FROM first_calls) WHERE nth <= 4",
)


@query("SELECT conv_id, round, call_idx, name FROM first_calls", "first_calls")
def one_tool_per_round(spark, sf_dir):
    return tools.one_tool_per_round(calls(spark, sf_dir)).select("conv_id", "round", "call_idx", "name")


@query(
    """SELECT conv_id, count(DISTINCT round) AS rounds, CASE WHEN count(DISTINCT round) > 4 THEN 'TOO_MANY_TOOL_ROUNDS' ELSE 'OK' END AS status
    FROM tool_calls GROUP BY conv_id""",
    "tool_calls",
)
def tool_round_limit(spark, sf_dir):
    return tools.tool_round_limit(calls(spark, sf_dir))


USED = """SELECT e.conv_id, e.round, e.call_idx, e.name, coalesce(string_agg(CASE u.name WHEN 'GetDescriptionsByIds' THEN 'name (DESC), '
    WHEN 'GoodsVectorSearch' THEN 'name (GVS), ' WHEN 'FindCheapExpensiveMiddleGoods' THEN 'name (PRICE), ' END, '' ORDER BY u.round), '') AS must_not_call
    FROM executed e JOIN executed u ON u.conv_id = e.conv_id AND u.round <= e.round GROUP BY e.conv_id, e.round, e.call_idx, e.name"""


@query(
    USED,
    "executed",
)
def tools_used_so_far(spark, sf_dir):
    return tools.tools_used_so_far(calls(spark, sf_dir))


@query("SELECT conv_id, name, count(*) AS times FROM tool_calls GROUP BY conv_id, name HAVING count(*) > 1", "tool_calls")
def repeat_tool_audit(spark, sf_dir):
    return tools.repeat_tool_audit(calls(spark, sf_dir))


@query(
    """SELECT conv_id, round, call_idx, database_name, search_limit FROM tool_calls WHERE name = 'GoodsVectorSearch'
    AND (database_name = 'GoodsListWithID' AND search_limit = 10 OR database_name = 'GoodsListWithIDWithoutCharacteristics' AND search_limit = 15)""",
    "tool_calls",
)
def search_preset_check(spark, sf_dir):
    checked = tools.search_preset_check(calls(spark, sf_dir))
    return checked.select("conv_id", "round", "call_idx", "database_name", "search_limit")


KEY = "conv_id, round, call_idx"
views.SQL["call_ids"] = (
    ("tool_calls",),
    f"""SELECT {KEY}, good_id, min(spot) AS spot, count(*) OVER (PARTITION BY {KEY}) AS n_ids FROM (
    SELECT {KEY}, CAST(trunc(CAST(one AS DOUBLE)) AS BIGINT) AS good_id, spot FROM (
    SELECT {KEY}, unnest(ids) AS one, unnest(range(len(ids))) AS spot FROM tool_calls WHERE name = 'GetDescriptionsByIds' AND ids IS NOT NULL)
    WHERE regexp_full_match(one, '[0-9]+([.][0-9]+)?')) GROUP BY {KEY}, good_id""",
)
views.SQL["call_texts"] = (
    ("call_ids", "described"),
    f"""SELECT {KEY}, list({SHORT} ORDER BY spot) AS descriptions FROM call_ids c LEFT JOIN described d ON d.good_id = c.good_id GROUP BY {KEY}""",
)
views.SQL["desc_results"] = (
    ("call_texts",),
    f"""SELECT c.conv_id, c.round, c.call_idx, CASE WHEN t.conv_id IS NULL THEN 'INVALID_ARGS' ELSE 'OK' END AS status,
    CASE WHEN t.conv_id IS NULL THEN 'ids пусты/некорректны' END AS message, t.descriptions
    FROM tool_calls c LEFT JOIN call_texts t USING ({KEY}) WHERE c.name = 'GetDescriptionsByIds' AND c.ids IS NOT NULL""",
)


def described(spark, sf_dir):
    parsed = tools.parsed_calls(calls(spark, sf_dir)).filter(f"name = '{tools.DESC_TOOL}' and ids is not null")
    return tools.tool_get_descriptions(parsed, views.goods(spark, sf_dir))


@query(
    f"SELECT {KEY}, status, message, array_to_string(descriptions, '|') AS descriptions FROM desc_results", "desc_results"
)
def tool_get_descriptions(spark, sf_dir):
    return described(spark, sf_dir).withColumn("descriptions", F.array_join("descriptions", "|"))


def _call_hits(name: str, condition: str, limit: str, collection: str) -> tuple[tuple[str, ...], str]:
    return (
        ("tool_calls", "query_vectors", collection),
        f"""SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY {KEY} ORDER BY score DESC, id) AS INTEGER) AS rank FROM (
        SELECT {KEY}, flag, {limit} AS lim, id, content,
        round(list_cosine_similarity(CAST(qvec AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS score
        FROM tool_calls JOIN query_vectors USING (vec_query), {collection}
        WHERE name = '{name}' AND {condition})) WHERE rank <= lim""",
    )


for _name, _collection, _base in (
    ("full_hits", tools.FULL_COLLECTION, "collection"),
    ("brief_hits", tools.BRIEF_COLLECTION, "brief_collection"),
):
    views.SQL[_name] = _call_hits(tools.SEARCH_TOOL, f"database_name = '{_collection}'", "search_limit", _base)
views.SQL["band_hits"] = _call_hits(tools.PRICE_TOOL, "search_limit IS NOT NULL", "search_limit + 3", "brief_collection")
views.SQL["search_results"] = (
    ("full_hits", "brief_hits"),
    f"""SELECT {KEY}, list(content ORDER BY rank) AS goods FROM (SELECT * FROM full_hits UNION ALL SELECT * FROM brief_hits) GROUP BY {KEY}""",
)
views.SQL["call_bands"] = (
    ("band_hits",),
    f"""SELECT {KEY}, content, price, price_pos FROM (SELECT *,
    CASE flag WHEN 1 THEN 0 WHEN 2 THEN lim // 2 - 7 WHEN 3 THEN lim - 15 END AS a,
    CASE flag WHEN 1 THEN 15 WHEN 2 THEN lim // 2 + 7 WHEN 3 THEN lim - 1 END AS b FROM (
    SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY price, rank) - 1 AS price_pos, count(*) OVER (PARTITION BY {KEY}) AS n_hits
    FROM (SELECT *, CAST(regexp_extract(content, 'рублях: ([0-9]+)', 1) AS BIGINT) AS price FROM band_hits)))
    WHERE price_pos >= {_cut('a')} AND price_pos < {_cut('b')}""",
)
views.SQL["band_results"] = (
    ("call_bands",),
    f"""SELECT {KEY}, list(content ORDER BY price_pos) AS goods, list(price ORDER BY price_pos) AS prices FROM call_bands GROUP BY {KEY}""",
)


def collections(spark, sf_dir):
    return {
        tools.FULL_COLLECTION: views.collection(spark, sf_dir),
        tools.BRIEF_COLLECTION: views.brief_collection(spark, sf_dir),
    }


@query(
    f"""SELECT {KEY}, array_to_string(goods, '|') AS goods FROM tool_calls LEFT JOIN search_results USING ({KEY})
    WHERE name = 'GoodsVectorSearch' AND search_limit IS NOT NULL""",
    "search_results",
)
def tool_vector_search(spark, sf_dir):
    asked = tools.parsed_calls(calls(spark, sf_dir)).filter(f"name = '{tools.SEARCH_TOOL}' and search_limit is not null")
    found = tools.tool_vector_search(asked, collections(spark, sf_dir), views.query_vectors(spark, sf_dir))
    return found.withColumn("goods", F.array_join("goods.content", "|"))


@query(
    f"""SELECT {KEY}, array_to_string(goods, '|') AS goods, array_to_string(list_transform(prices, lambda x: CAST(x AS VARCHAR)), '|') AS prices
    FROM tool_calls LEFT JOIN band_results USING ({KEY}) WHERE name = 'FindCheapExpensiveMiddleGoods'""",
    "band_results",
)
def tool_price_band(spark, sf_dir):
    asked = tools.parsed_calls(calls(spark, sf_dir)).filter(f"name = '{tools.PRICE_TOOL}'")
    found = tools.tool_price_band(asked, views.brief_collection(spark, sf_dir), views.query_vectors(spark, sf_dir))
    return found.select(
        *tools.CALL,
        F.array_join("goods.content", "|").alias("goods"),
        F.array_join(F.col("goods.price").cast("array<string>"), "|").alias("prices"),
    )


@query(
    f"SELECT query_id AS conv_id, 1 AS round, 0 AS call_idx, rank, id AS chunk_id, score FROM ({TOP5})", "fused"
)
def tool_search_text(spark, sf_dir):
    asked = views.text_queries(spark, sf_dir).select(
        F.col("query_id").alias("conv_id"), F.lit(1).alias("round"), F.lit(0).alias("call_idx"), "text"
    )
    return tools.tool_search_text(asked, table(spark, sf_dir, "documents", heavy=True))


RESULTS = f"""SELECT {KEY}, name, CASE
    WHEN name = 'WebSearch' THEN '{{"error":"TypeError(\\"''NoneType'' object is not callable\\")"}}'
    WHEN name = 'GetDescriptionsByIds' AND ids IS NULL THEN '{{"error":"ValidationError(GetDescriptionsByIds)"}}'
    WHEN name = 'GoodsVectorSearch' AND search_limit IS NULL THEN '{{"error":"ValidationError(GoodsVectorSearch)"}}'
    WHEN status = 'OK' THEN '{{"status":"OK","descriptions":[' || array_to_string(list_transform(descriptions, lambda x: CAST(to_json(x) AS VARCHAR)), ',') || ']}}'
    WHEN status IS NOT NULL THEN '{{"status":"INVALID_ARGS","message":"' || message || '"}}'
    WHEN name = 'GoodsVectorSearch' THEN '{{"goods":[' || coalesce(array_to_string(list_transform(s.goods, lambda x: CAST(to_json(x) AS VARCHAR)), ','), '') || ']}}'
    WHEN flag = 9 THEN '{{"goods":null}}'
    ELSE '{{"goods":[' || coalesce(p.pairs, '') || ']}}' END AS content
    FROM tool_calls LEFT JOIN desc_results USING ({KEY}) LEFT JOIN search_results s USING ({KEY})
    LEFT JOIN (SELECT {KEY}, string_agg('[' || CAST(to_json(content) AS VARCHAR) || ',' || CAST(price AS VARCHAR) || ']', ',' ORDER BY price_pos) AS pairs
    FROM call_bands GROUP BY {KEY}) p USING ({KEY})"""


@query(
    RESULTS,
    "desc_results",
    "search_results",
    "call_bands",
)
def tool_call_batch(spark, sf_dir):
    return tools.tool_call_batch(
        calls(spark, sf_dir), views.goods(spark, sf_dir), collections(spark, sf_dir), views.query_vectors(spark, sf_dir)
    )


@query(
    f"""SELECT {KEY}, name, conv_id || '-' || round || '-' || call_idx AS tool_call_id, must_not_call, content
    FROM ({RESULTS}) JOIN ({USED}) USING ({KEY}, name)
    UNION ALL SELECT conv_id, NULL, NULL, NULL, NULL, NULL, '{tools.TOO_MANY}'
    FROM (SELECT conv_id, count(DISTINCT round) AS rounds FROM tool_calls GROUP BY conv_id) WHERE rounds > 4""",
    "desc_results",
    "search_results",
    "call_bands",
    "executed",
)
def tool_loop_batch(spark, sf_dir):
    return tools.tool_loop_batch(
        calls(spark, sf_dir), views.goods(spark, sf_dir), collections(spark, sf_dir), views.query_vectors(spark, sf_dir)
    )
