"""Keyword search over stored postings, a block of chunks at a time.

The index is written once, in one pass over the chunks: neighbouring chunks form
a block, and every term of a block has one row with the places and counts of its
chunks, beside bounds of what any of them can add to a score. Rows are
laid out by a bucket of their term. A search reads the folders of its own
terms' buckets, at first only the columns of the bounds; no text is read again.

The sum of a query's bounds in a block is a score that no chunk of the block
exceeds. The blocks of the highest bounds are scored first; of the others only
those are read whose bound reaches the k-th best score found. So the result is that of
scoring everything, ties included.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from functools import partial, reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lavka.operators.ranking import k_best
from lavka.operators.scoring import best_cells
from lavka.session import shared_folder, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BUCKETS = 31  # folders of terms; more of them leave less to read where few terms are asked for
BLOCK = 2048  # chunks of a block
QUERY_PART = 1024  # queries scored in one group with a block
FIRST_BLOCKS = 2  # blocks scored before the others are weighed
SLACK = 1e-6  # scores are rounded to six digits, bounds are not
MAX_CELLS = 4_000_000  # products at a time: 32 MB
DENSE_SHARE = 16  # a term with products in one of so many cells is frequent,
DENSE_TERMS = 256  # and so many frequent terms are multiplied at a time

KINDS = ("bm25", "tfidf")

SCHEMA = pa.schema(
    {
        "term": pa.string(),  # empty in the row of the block itself
        "block": pa.int64(),
        "places": pa.list_(pa.int32()),  # a term's chunks by their place in the block
        "counts": pa.list_(pa.int32()),
        "ids": pa.list_(pa.int64()),  # of the block: its chunks, their sizes and lengths
        "sizes": pa.list_(pa.int32()),
        "lengths": pa.list_(pa.float64()),
        "held": pa.int64(),  # chunks in the row
        "total": pa.int64(),  # tokens in the row
        "most": pa.int32(),  # largest count, least size and largest share of a chunk's length
        "least": pa.int32(),
        "top": pa.float64(),
    }
)
_SPARK_TYPES = {pa.string(): "string", pa.int64(): "bigint", pa.int32(): "int", pa.float64(): "double"}


def _ddl(schema: pa.Schema) -> str:
    def kind(t: pa.DataType) -> str:
        return f"array<{kind(t.value_type)}>" if pa.types.is_list(t) else _SPARK_TYPES[t]

    return ", ".join(f"{field.name} {kind(field.type)}" for field in schema)


class Postings(NamedTuple):
    """An opened index: the rows of terms, the rows of blocks, and the number of buckets."""

    terms: DataFrame
    blocks: DataFrame
    buckets: int


class Measure(NamedTuple):
    """What turns counts into weights: the mean size of all chunks and the parameters of BM25."""

    mean_size: float
    k1: float
    b: float


# Writing


def rows_of_block(part: pa.RecordBatch, block: int) -> Iterator[pa.RecordBatch]:
    """The row of a block and those of its terms."""
    tokens, chunks = part.column("tokens"), part.num_rows
    sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = pc.dictionary_encode(tokens.flatten())
    cells = coded.indices.to_numpy().astype(np.int64) * chunks + np.repeat(np.arange(chunks), sizes)
    cells, counts = np.unique(cells, return_counts=True)  # by term, then by place
    term, place = np.divmod(cells, chunks)
    weight = 1 + np.log(counts)
    length = np.sqrt(np.bincount(place, weight * weight, chunks))

    def batch(rows: int, **columns) -> pa.RecordBatch:
        columns |= {"block": np.full(rows, block)}
        arrays = [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in SCHEMA]
        return pa.RecordBatch.from_arrays(arrays, schema=SCHEMA)

    yield batch(
        1, term=[""], ids=[part.column("id").to_numpy()], sizes=[sizes], lengths=[length], held=[chunks], total=[int(sizes.sum())]
    )
    if len(cells):
        first = np.flatnonzero(np.diff(term, prepend=-1))
        ends = pa.array(np.append(first, len(cells)), pa.int32())
        yield batch(
            len(first),
            term=coded.dictionary,
            places=pa.ListArray.from_arrays(ends, pa.array(place, pa.int32())),
            counts=pa.ListArray.from_arrays(ends, pa.array(counts, pa.int32())),
            held=np.diff(ends),
            total=np.add.reduceat(counts, first),
            most=np.maximum.reduceat(counts, first),
            least=np.minimum.reduceat(sizes[place], first),
            top=np.maximum.reduceat(weight / length[place], first),
        )


def block_rows(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks are numbered within their task, so a repeated task gives the same numbers."""
    number = TaskContext.get().partitionId() << 33
    for batch in batches:
        for start in range(0, batch.num_rows, size):
            yield from rows_of_block(batch.slice(start, size), number)
            number += 1


def bucket(term: Column, buckets: int) -> Column:
    """The folder of a term; blocks have their own."""
    return F.when(term == "", -1).otherwise(F.pmod(F.xxhash64(term), F.lit(buckets))).cast("int")


def write_postings(
    tokenised: DataFrame, path: str, buckets: int = BUCKETS, block: int = BLOCK, terms: DataFrame | None = None
) -> None:
    """Write the index of (id, tokens). A chunk's postings are never moved one by one: what is
    shuffled is one row for each term of a block, and a term of all chunks is as many rows as blocks.

    ``terms`` (term) are those that will be asked for: rows of others are left out before anything is
    shuffled, while sizes and lengths of chunks are those of all their terms.
    """
    rows = tokenised.select("id", "tokens").mapInArrow(partial(block_rows, block), _ddl(SCHEMA))
    if terms is not None:
        own_row = terms.sparkSession.range(1).select(F.lit("").alias("term"))  # that of a block
        rows = rows.join(terms.select("term").union(own_row), "term", "left_semi").select(SCHEMA.names)
    rows = rows.withColumn("bucket", bucket(F.col("term"), buckets)).hint("rebalance", F.col("bucket"))
    rows.sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").parquet(path)


def open_postings(spark: SparkSession, path: str, buckets: int = BUCKETS) -> Postings:
    rows = spark.read.schema(f"{_ddl(SCHEMA)}, bucket int").parquet(path)
    return Postings(rows.filter("bucket >= 0"), rows.filter("bucket = -1"), buckets)


def indexed(tokenised: DataFrame, **options) -> Postings:
    """An index in the shared folder, for a corpus that is searched once."""
    path = shared_folder(tokenised.sparkSession, "postings")
    write_postings(tokenised, path, **options)
    return open_postings(tokenised.sparkSession, path, options.get("buckets", BUCKETS))


# Weights and bounds


class Search(NamedTuple):
    """The queries with their weights, and the bounds of every block that holds one of their terms."""

    weights: DataFrame  # query_id, terms, and an array of weights for each kind
    bounds: DataFrame  # query_id, block, and a bound for each kind
    terms: DataFrame  # the postings of the asked terms
    blocks: DataFrame
    measure: Measure
    kinds: tuple[str, ...]
    parts: int


def prepared(queries: DataFrame, postings: Postings, kinds: tuple[str, ...], k1: float, b: float, part: int = QUERY_PART) -> Search:
    """(query_id, tokens) with idf-weighted counts. Terms that no chunk holds take no part."""
    asked = queries.select("query_id", F.explode("tokens").alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    asked = stored(asked, "asked")
    own = asked.select("term").distinct()
    wanted = [r[0] for r in own.select(bucket(F.col("term"), postings.buckets)).distinct().collect()]  # at most as many as folders
    terms = postings.terms.filter(F.col("bucket").isin(wanted)).join(own, "term", "left_semi")
    meta = stored(terms.select("term", "block", "held", "most", "least", "top"), "bounds-of-terms")
    chunks, tokens = postings.blocks.agg(F.coalesce(F.sum("held"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    measure = Measure(tokens / max(chunks, 1) or 1.0, k1, b)

    n, df, times = F.lit(chunks), F.col("df"), F.col("times")
    raw = {
        "bm25": times * F.log(1 + (n - df + 0.5) / (df + 0.5)),
        "tfidf": (1 + F.log(times)) * F.log(1 + n / df),
    }
    held = meta.groupBy("term").agg(F.sum("held").alias("df"))
    listed = asked.join(held, "term").select("query_id", F.struct("term", *[raw[x].alias(x) for x in kinds]).alias("t"))
    listed = listed.groupBy("query_id").agg(F.array_sort(F.collect_list("t")).alias("t"))  # one query's text
    unit = F.sqrt(F.aggregate("t.tfidf", F.lit(0.0), lambda done, w: done + w * w)) if "tfidf" in kinds else None
    lists = {"bm25": F.col("t.bm25"), "tfidf": F.transform("t.tfidf", lambda w: w / unit)}
    weights = stored(listed.select("query_id", F.col("t.term").alias("terms"), *[lists[x].alias(x) for x in kinds]), "weights")

    most, least = F.col("most"), F.col("least")
    reach = {
        "bm25": F.sum(F.col("w.bm25") * most * (k1 + 1) / (most + k1 * (1 - b + b * least / measure.mean_size))),
        # No chunk's share of these terms is longer than one.
        "tfidf": F.least(F.sum(F.col("w.tfidf") * F.col("top")), F.sqrt(F.sum(F.col("w.tfidf") * F.col("w.tfidf")))),
    }
    each = weights.select("query_id", F.explode(F.arrays_zip("terms", *kinds)).alias("w"))
    found = each.join(meta, F.col("w.terms") == F.col("term")).groupBy("query_id", "block")
    bounds = stored(found.agg(*[reach[x].alias(f"bound_{x}") for x in kinds]), "bounds")
    parts = -(-weights.count() // part) or 1
    return Search(weights, bounds, terms, postings.blocks, measure, kinds, parts)


# Scoring


def products(scores: np.ndarray, place: np.ndarray, term: np.ndarray, weight: np.ndarray, query: np.ndarray, asked: np.ndarray, own: np.ndarray) -> None:
    """Add to the cells (place, query) the products of weights over shared terms.

    Terms whose products would fill a good part of the cells go through a matrix product, some of them at
    a time; the products of all others are listed, some at a time.
    """
    chunks, queries = scores.shape
    terms = int(term.max(initial=-1)) + 1
    held = np.bincount(asked, minlength=terms)
    often = np.bincount(term, minlength=terms) * held * DENSE_SHARE >= chunks * queries
    spot = np.where(often, np.cumsum(often) - 1, -1)
    for start in range(0, int(often.sum()), DENSE_TERMS):
        own_terms, asked_terms = spot[term] - start, spot[asked] - start
        here, there = ((x >= 0) & (x < DENSE_TERMS) for x in (own_terms, asked_terms))
        left, right = np.zeros((chunks, DENSE_TERMS)), np.zeros((DENSE_TERMS, queries))
        left[place[here], own_terms[here]] = weight[here]
        right[asked_terms[there], query[there]] = own[there]
        scores += left @ right
    rare, others = ~often[term], ~often[asked]
    place, term, weight = place[rare], term[rare], weight[rare]
    query, asked, own = query[others], asked[others], own[others]
    order = np.argsort(asked, kind="stable")
    query, own = query[order], own[order]
    held = np.bincount(asked, minlength=terms)
    first = np.cumsum(held) - held
    upto = np.cumsum(held[term])
    flat, start = scores.reshape(-1), 0
    while start < len(term):
        base = upto[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(upto, base + MAX_CELLS, "right")))
        times = held[term[start:end]]
        within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        at = np.repeat(first[term[start:end]], times) + within
        cell = np.repeat(place[start:end], times) * queries + query[at]
        flat += np.bincount(cell, np.repeat(weight[start:end], times) * own[at], len(flat))
        start = end


def block_scores(rows: pa.Table, asked: pa.Table, kinds: tuple[str, ...], measure: Measure) -> tuple[np.ndarray, dict]:
    """The ids of a block's chunks, and per kind a matrix of chunks by queries, rounded; nan
    where no term is shared."""
    own = rows.filter(pc.equal(rows["term"], ""))
    ids, sizes, lengths = (np.asarray(own[name].combine_chunks().flatten()) for name in ("ids", "sizes", "lengths"))
    rows = rows.filter(pc.not_equal(rows["term"], ""))
    places, counts = rows["places"].combine_chunks(), rows["counts"].combine_chunks()
    term = np.repeat(np.arange(len(rows)), np.asarray(pc.list_value_length(places)))
    place, counts = np.asarray(places.flatten()), np.asarray(counts.flatten())
    listed = asked["terms"].combine_chunks()
    query = np.repeat(np.arange(len(asked)), np.asarray(pc.list_value_length(listed)))
    known = pc.index_in(listed.flatten(), value_set=rows["term"].combine_chunks())
    here = np.asarray(pc.is_valid(known))
    known = np.asarray(pc.fill_null(known, 0))[here]
    found = {}
    for kind in kinds:
        if kind == "bm25":
            weight = counts * (measure.k1 + 1) / (counts + measure.k1 * (1 - measure.b + measure.b * sizes[place] / measure.mean_size))
        else:
            weight = (1 + np.log(counts)) / lengths[place]
        scores = np.zeros((len(ids), len(asked)))
        products(scores, place, term, weight, query[here], known, np.asarray(asked[kind].combine_chunks().flatten())[here])
        found[kind] = np.where(scores > 0, np.round(scores, 6), np.nan)
    return ids, found


def best_of_block(kinds: tuple[str, ...], measure: Measure, k: int, rows: pa.Table, asked: pa.Table) -> pa.Table:
    """The k best chunks of a block by each kind that reach the query's floor, with their scores by all kinds."""
    columns = {name: [] for name in ("query_id", "kind", "id", *kinds)}
    if len(asked):
        ids, scores = block_scores(rows, asked, kinds, measure)
        for kind, matrix in scores.items():
            floors = np.asarray(asked[f"floor_{kind}"].combine_chunks().fill_null(0.0))
            query, row = best_cells(matrix, ids, np.full(len(asked), k), floors)
            found = {x: pa.array(scores[x][row, query]) for x in kinds}
            found |= {"query_id": asked["query_id"].combine_chunks().take(pa.array(query)), "id": pa.array(ids[row])}
            found["kind"] = pa.array([kind] * len(row), pa.string())
            for name, values in found.items():
                columns[name].append(values)
    kind = {"query_id": asked["query_id"].type, "kind": pa.string(), "id": pa.int64()}
    return pa.table({name: pa.chunked_array(parts, kind.get(name, pa.float64())) for name, parts in columns.items()})


def better_of_block(kinds: tuple[str, ...], measure: Measure, rows: pa.Table, asked: pa.Table) -> pa.Table:
    """Per query, kind and waiting hit how many chunks of a block rank before it."""
    found = {"query_id": [], "kind": [], "id": [], "better": []}
    if len(asked):
        ids, scores = block_scores(rows, asked, kinds, measure)
        for kind in kinds:
            for at, (query, waiting) in enumerate(zip(asked["query_id"].to_pylist(), asked[f"waiting_{kind}"].to_pylist())):
                if waiting:
                    column = scores[kind][:, at][:, None]
                    own, score = np.array([w["id"] for w in waiting]), np.array([w["score"] for w in waiting])
                    better = (column > score) | ((column == score) & (ids[:, None] < own))
                    found["query_id"] += [query] * len(own)
                    found["kind"] += [kind] * len(own)
                    found["id"] += own.tolist()
                    found["better"] += better.sum(axis=0).tolist()
    kind = {"query_id": asked["query_id"].type, "kind": pa.string(), "id": pa.int64(), "better": pa.int64()}
    return pa.table({name: pa.array(values, kind[name]) for name, values in found.items()})


def over_blocks(search: Search, pairs: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """Bring every block that is asked for together with its queries, some at a time.

    ``pairs`` has ``query_id``, ``block`` and whatever ``run`` needs of a query beside its weights.
    """
    wanted = pairs.select("block").distinct()
    columns = ["term", "block", "places", "counts", "ids", "sizes", "lengths"]
    rows = search.terms.select(columns).unionByName(search.blocks.select(columns)).join(wanted, "block", "left_semi")
    every = F.sequence(F.lit(0), F.lit(search.parts - 1))
    rows = rows.withColumn("part", F.explode(every) if search.parts > 1 else F.lit(0))
    asking = pairs.join(search.weights, "query_id")
    asking = asking.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(search.parts)).cast("int"))
    return rows.groupBy("block", "part").cogroup(asking.groupBy("block", "part")).applyInArrow(lambda own, theirs: run(own, theirs), schema)


def _key(search: Search) -> str:
    return f"query_id {search.weights.schema['query_id'].dataType.simpleString()}"


def best_chunks(search: Search, k: int) -> DataFrame:
    """(query_id, kind, id, a score for each kind, rank): the k best of each kind, exactly."""
    kinds = search.kinds
    scores = ", ".join(f"{kind} double" for kind in kinds)
    run = partial(best_of_block, kinds, search.measure, k)
    schema = f"{_key(search)}, kind string, id bigint, {scores}"

    def first(kind: str) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc(f"bound_{kind}"), "block")
        return search.bounds.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= FIRST_BLOCKS).select("query_id", "block")

    floors = [f"floor_{kind}" for kind in kinds]
    started = reduce(DataFrame.union, [first(kind) for kind in kinds]).distinct()
    unknown = [F.lit(None).cast("double").alias(name) for name in floors]
    early = stored(over_blocks(search, started.select("*", *unknown), run, schema), "first-hits")
    own = F.coalesce(*[F.when(F.col("kind") == kind, F.col(kind)) for kind in kinds])
    early = early.withColumn("score", own).withColumn("k", F.lit(k))
    last = k_best(early, ("query_id", "kind"), k).filter("rank = k")
    floor = last.groupBy("query_id").agg(*[F.max(F.when(F.col("kind") == kind, F.col("score"))).alias(f"floor_{kind}") for kind in kinds])
    may_reach = F.lit(False)
    for kind in kinds:
        may_reach = may_reach | F.col(f"floor_{kind}").isNull() | (F.col(f"bound_{kind}") >= F.col(f"floor_{kind}") - SLACK)
    left = search.bounds.join(started, ["query_id", "block"], "left_anti").join(floor, "query_id", "left").filter(may_reach)
    late = over_blocks(search, left.select("query_id", "block", *floors), run, schema).withColumn("score", own).withColumn("k", F.lit(k))
    return k_best(early.unionByName(late), ("query_id", "kind"), k).drop("k")


def exact_ranks(search: Search, hits: DataFrame) -> DataFrame:
    """(query_id, kind, id, rank) of all chunks that are among the hits of any kind, by every kind.

    A chunk that only one kind has found waits in the others: one pass counts the chunks that rank before
    it. Blocks that no waiting chunk is reached by are not read.
    """
    kinds = search.kinds
    known = hits.select("query_id", "kind", "id", "rank")
    chunks = hits.groupBy("query_id", "id").agg(
        *[F.max(kind).alias(kind) for kind in kinds], F.collect_set("kind").alias("found")
    )
    chunks = stored(chunks, "candidates")
    lists, least = [], []
    for kind in kinds:
        waits = ~F.array_contains("found", kind)
        lists.append(F.collect_list(F.when(waits, F.struct(F.col(kind).alias("score"), "id"))).alias(f"waiting_{kind}"))
        least.append(F.min(F.when(waits, F.col(kind))).alias(f"least_{kind}"))
    waiting = stored(chunks.groupBy("query_id").agg(*lists, *least), "waiting")
    reached = F.lit(False)
    for kind in kinds:
        reached = reached | F.coalesce(F.col(f"bound_{kind}") >= F.col(f"least_{kind}") - SLACK, F.lit(False))
    pairs = search.bounds.join(waiting, "query_id").filter(reached).select("query_id", "block", *[f"waiting_{x}" for x in kinds])
    run = partial(better_of_block, kinds, search.measure)
    counted = over_blocks(search, pairs, run, f"{_key(search)}, kind string, id bigint, better bigint")
    ranks = counted.groupBy("query_id", "kind", "id").agg((F.sum("better") + 1).cast("int").alias("rank"))
    return known.unionByName(ranks)
