"""Nearest vectors from a stored layout by centre, with bounds that say when to stop.

Every vector lies in the bucket of its nearest centre, and a bucket's vectors, sorted by
their angle to the centre, are packed into blocks. Beside the layout stands how far
from the centre a bucket reaches. For a query at angle q to a centre, no vector
at angles between a and b to it can be nearer than q - b or a - q, whichever is
positive. Buckets are visited by falling bound, in rounds of growing number; after
each round a query goes on only with buckets, and in them with blocks, that may hold a
vector as near as the k-th best so far. Run to the end, the result is exact.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lavka.operators.ranking import k_best
from lavka.operators.scoring import best_cells, dense
from lavka.session import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK = 2048  # vectors of a block
QUERY_PART = 4096  # queries scored in one group with a block
SLACK = 2e-6  # scores are rounded to six digits, angles are not
SCHEMA = "bucket bigint, block bigint, low double, high double, ids array<bigint>, vectors array<float>"


class Layout(NamedTuple):
    """An opened layout: its blocks, their ranges of cosines to the centre, and per bucket the centre's
    direction and the least cosine to it."""

    blocks: DataFrame
    edges: DataFrame
    buckets: list[int]
    units: np.ndarray
    reach: np.ndarray


def ann_centres(corpus: DataFrame, count: int, seed: int = 7) -> list[list[float]]:
    """Centres of the corpus by k-means on the directions of its vectors."""
    rows = corpus.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = KMeans(k=count, seed=seed, distanceMeasure="cosine").fit(rows)
    return [centre.tolist() for centre in model.clusterCenters()]


def unit_rows(centres: list[list[float]]) -> np.ndarray:
    units = np.array(centres, np.float64)
    return units / np.linalg.norm(units, axis=1, keepdims=True)


def nearest_centre(vector: Column, centres: list[list[float]]) -> Column:
    """Number and cosine of the centre closest in direction, ties by number; one matrix product per
    batch, for thousands of centres too. Null for vectors of another length and those without direction."""
    units = unit_rows(centres)

    @F.arrow_udf("bucket bigint, near double")
    def closest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            near = dense(batch, units.shape[1]) @ units.T
            unknown = np.isnan(near).any(axis=1)
            number = np.argmax(np.nan_to_num(np.round(near, 6), nan=-2.0), axis=1)
            found = [pa.array(number, mask=unknown), pa.array(near[np.arange(len(near)), number], mask=unknown)]
            yield pa.StructArray.from_arrays(found, ["bucket", "near"], mask=pa.array(unknown))

    return closest(vector)


def packed(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one bucket after the other as blocks, numbered within the task."""
    number = TaskContext.get().partitionId() << 33
    for batch in batches:
        bucket = batch.column("bucket").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
        for first, last in zip(edges, edges[1:]):
            for start in range(first, last, size):
                part = batch.slice(start, min(size, last - start))
                near = part.column("near").to_numpy()
                yield pa.RecordBatch.from_pydict(
                    {
                        "bucket": [int(bucket[start])],
                        "block": [number],
                        "low": [float(near.min())],
                        "high": [float(near.max())],
                        "ids": pa.array([part.column("id").to_numpy()], pa.list_(pa.int64())),
                        "vectors": pa.array([part.column("embedding").flatten().to_numpy()], pa.list_(pa.float32())),
                    }
                )
                number += 1


def write_ann_layout(corpus: DataFrame, path: str, centres: list[list[float]], block: int = BLOCK) -> None:
    """Lay out (id, embedding) by nearest centre below ``path``: ``blocks``, a folder for each bucket,
    and ``buckets``. A bucket of many rows is split over tasks and files. Vectors that no
    cosine is defined for can never be found and are left out."""
    placed = corpus.select("id", "embedding", nearest_centre(F.col("embedding"), centres).alias("at"))
    placed = placed.select("id", "embedding", "at.bucket", "at.near").filter("bucket is not null")
    sorted_rows = placed.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", F.desc("near"), "id")
    sorted_rows.mapInArrow(partial(packed, block), SCHEMA).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/blocks")
    spark = corpus.sparkSession
    known = spark.createDataFrame(list(enumerate(centres)), "bucket bigint, centre array<double>")
    held = spark.read.schema(SCHEMA).parquet(f"{path}/blocks").groupBy("bucket").agg(F.min("low").alias("reach"))
    known.join(held, "bucket").write.mode("overwrite").parquet(f"{path}/buckets")


def open_ann_layout(spark: SparkSession, path: str) -> Layout:
    """The centres, of which there are some thousands at most, go to the driver."""
    rows = spark.read.parquet(f"{path}/buckets").orderBy("bucket").collect()
    blocks = spark.read.schema(SCHEMA)
    units = unit_rows([r.centre for r in rows]) if rows else np.empty((0, 1))
    edges = blocks.parquet(f"{path}/blocks").select("bucket", "block", "low", "high")
    return Layout(blocks.parquet(f"{path}/blocks"), edges, [r.bucket for r in rows], units, np.array([r.reach for r in rows]))


def bucket_bounds(vector: Column, layout: Layout) -> Column:
    """Per bucket the greatest cosine that any of its vectors can have, and the query's angle to the centre."""
    buckets, units = np.array(layout.buckets, np.int64), layout.units
    reach = np.arccos(np.clip(layout.reach, -1, 1))

    @F.arrow_udf("array<struct<bucket:bigint,bound:double,angle:double>>")
    def bounds(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            near = dense(batch, units.shape[1]) @ units.T
            known = ~np.isnan(near).any(axis=1)
            angle = np.arccos(np.clip(near[known], -1, 1))
            cells = [np.tile(buckets, len(angle)), np.cos(np.maximum(angle - reach, 0)).ravel(), angle.ravel()]
            cells = pa.StructArray.from_arrays([pa.array(c) for c in cells], ["bucket", "bound", "angle"])
            ends = np.concatenate(([0], np.cumsum(known * len(buckets))))
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), cells)

    return bounds(vector)


def nearest_of_block(rows: pa.Table, asked: pa.Table) -> pa.Table:
    """Per query the k nearest vectors of a block that reach its floor."""
    schema = pa.schema([asked.schema.field("query_id"), ("id", pa.int64()), ("score", pa.float64()), ("k", pa.int64())])
    if not len(asked) or not len(rows):
        return schema.empty_table()
    ids = np.asarray(rows["ids"].combine_chunks().flatten())
    flat = np.asarray(rows["vectors"].combine_chunks().flatten(), np.float64).reshape(len(ids), -1)
    flat /= np.linalg.norm(flat, axis=1, keepdims=True)
    scores = np.round(flat @ dense(asked["qvec"], flat.shape[1]).T, 6)
    k = np.asarray(asked["k"])
    floors = np.asarray(asked["floor"].combine_chunks().fill_null(-2.0))
    query, row = best_cells(scores, ids, k, floors)
    found = {"query_id": asked["query_id"].take(pa.array(query)), "id": ids[row], "score": scores[row, query], "k": k[query]}
    return pa.table(found, schema=schema)


def ann_search(queries: DataFrame, layout: Layout, k: int | str = 10, rounds: int | None = None) -> DataFrame:
    """(query_id, qvec) to (query_id, id, score, rank) of the k nearest vectors.

    Round n visits the 2^n buckets of highest bound that are left, those nearest to the
    query first where bounds are equal. Without ``rounds`` the search goes on until no bucket can change
    the result; with it, after so many, a query whose buckets are not exhausted may miss some.
    """
    spark, wanted = queries.sparkSession, F.lit(k) if isinstance(k, int) else F.col(k)
    asked = queries.select("query_id", "qvec", wanted.cast("bigint").alias("k")).filter("k > 0 and qvec is not null")
    asked = stored(asked, "ann-queries")
    summary = asked.agg(F.count("*"), F.max("k")).first()
    parts, largest = -(-summary[0] // QUERY_PART) or 1, summary[1] or 0
    key = asked.schema["query_id"].dataType.simpleString()
    each = asked.select("query_id", F.explode(bucket_bounds(F.col("qvec"), layout)).alias("at")).select("query_id", "at.*")
    order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "angle", "bucket")  # as many rows as centres
    pairs = stored(each.withColumn("nth", F.row_number().over(order)), "ann-buckets")
    hits = spark.createDataFrame([], f"query_id {key}, id bigint, score double, k bigint")
    floor = asked.select("query_id", F.lit(None).cast("double").alias("floor"))
    done, step = 0, 0
    while done < len(layout.buckets) and (rounds is None or step < rounds):
        upto = done + (1 << step)
        left = pairs.filter((F.col("nth") > done) & (F.col("nth") <= upto)).join(floor, "query_id")
        left = left.filter(F.col("floor").isNull() | (F.col("bound") >= F.col("floor") - SLACK)).select("query_id", "bucket", "angle", "floor")
        numbers = [r.bucket for r in left.select("bucket").distinct().collect()]  # at most as many as centres
        if numbers:
            found = visited(layout, numbers, left, asked, parts, f"query_id {key}, id bigint, score double, k bigint")
            hits = stored(k_best(hits.unionByName(found), largest=largest).drop("rank"), "ann-hits")
            last = k_best(hits, largest=largest).filter("rank = k").select("query_id", F.col("score").alias("floor"))
            floor = asked.select("query_id").join(last, "query_id", "left")
        done, step = upto, step + 1
    return k_best(hits, largest=largest).drop("k")


def visited(layout: Layout, numbers: list[int], left: DataFrame, asked: DataFrame, parts: int, schema: str) -> DataFrame:
    """The hits of the blocks that the pairs of query and bucket can have some in."""
    blocks = layout.blocks.filter(F.col("bucket").isin(numbers))  # folders are pruned before the scan
    low, high = F.acos(F.least("high", F.lit(1.0))), F.acos(F.greatest("low", F.lit(-1.0)))
    beyond = F.greatest(F.col("angle") - high, low - F.col("angle"), F.lit(0.0))
    pairs = left.join(layout.edges.filter(F.col("bucket").isin(numbers)), "bucket")
    pairs = pairs.filter(F.col("floor").isNull() | (F.cos(beyond) >= F.col("floor") - SLACK)).select("query_id", "block", "floor")
    asking = pairs.join(asked, "query_id").withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int"))
    rows = blocks.select("block", "ids", "vectors").join(pairs.select("block").distinct(), "block", "left_semi")
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))) if parts > 1 else F.lit(0))
    return rows.groupBy("block", "part").cogroup(asking.groupBy("block", "part")).applyInArrow(lambda own, theirs: nearest_of_block(own, theirs), schema)
