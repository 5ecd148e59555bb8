"""Approximate nearest neighbours by inner product on shifted Hilbert curves.

Vectors get one more coordinate, so that all have the length of the longest;
then the nearest by angle is the one of largest inner product. Every curve
projects them to four random directions, shifts the coordinates and orders them
along a Hilbert curve. The order is cut into key ranges of about equal size; a
query looks at the range of its own key and its neighbours, on every curve.
Whatever it meets is scored on the original vectors in double precision, and
the best of all curves are merged.

Directions, scales and cuts are fitted on ``SAMPLED`` rows at most, by a seeded
draw; every row is indexed. Ranges are a fixed share of all rows: vectors without any
structure, whose neighbours lie in all directions, need such a share for the
recall, and the work is then that of the pairs compared.

A range of many rows, such as one of equal vectors, is split by a hash of the
id, and so are its queries: a task compares at most ``BLOCK_ROWS`` vectors with
``BLOCK_QUERIES`` queries, up to the evenness of the hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lavka.llm.sampling import sample_of_rows
from lavka.llm.stored import stored

CURVES = 24
DIRECTIONS = 4
BITS = 10
RANGES = 32
#: Rows that a range has at least, so that few rows are few ranges.
LEAST_IN_RANGE = 64
#: Ranges on either side of the query's own that it looks at.
REACH = 1
NEAREST = 20
SAMPLED = 16_384
SEED = 8
BLOCK_ROWS = 4096
BLOCK_QUERIES = 1024


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of points with integer coordinates of ``bits`` bits."""
    point = cells.astype(np.int64).T.copy()
    for level in range(bits - 1, 0, -1):  # from coarse to fine: undo each cell's turn
        corner, below = 1 << level, (1 << level) - 1
        for axis in range(len(point)):
            upper = (point[axis] & corner) != 0
            swap = np.where(upper, 0, (point[0] ^ point[axis]) & below)
            point[0] ^= np.where(upper, below, swap)
            point[axis] ^= swap
    for axis in range(1, len(point)):  # Gray code
        point[axis] ^= point[axis - 1]
    flip = np.zeros(point.shape[1], np.int64)
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(point[-1] >> level & 1, (1 << level) - 1, 0)
    point ^= flip
    key = np.zeros(point.shape[1], np.int64)
    for level in range(bits - 1, -1, -1):
        for axis in point:
            key = key << 1 | (axis >> level & 1)
    return key


class Curves:
    """Projections, scales and cuts, fitted on a sample of vectors."""

    def __init__(self, sample: np.ndarray, longest: float, count: int):
        random = np.random.default_rng(SEED)
        size = sample.shape[1] + 1
        self.longest = longest
        columns = [np.linalg.qr(random.normal(size=(size, size)))[0] for _ in range(-(-CURVES * DIRECTIONS // size))]
        self.directions = np.concatenate(columns, 1)[:, : CURVES * DIRECTIONS]
        self.shifts = random.random((CURVES, DIRECTIONS))
        seen = self.lifted(sample) @ self.directions
        self.scales = np.quantile(seen, np.linspace(0, 1, 129), axis=0)
        keys = self.keys(seen)
        shares = np.linspace(0, 1, min(RANGES, max(count // LEAST_IN_RANGE, 1)) + 1)[1:-1]
        self.cuts = [np.unique(np.quantile(k, shares, method="lower")) for k in keys]

    def lifted(self, vectors: np.ndarray) -> np.ndarray:
        short = 1 - ((vectors / self.longest) ** 2).sum(1, keepdims=True)
        return np.concatenate((vectors / self.longest, np.sqrt(np.maximum(short, 0))), 1)

    def keys(self, projected: np.ndarray) -> list[np.ndarray]:
        found = []
        for curve in range(CURVES):
            cells = np.empty((len(projected), DIRECTIONS), np.int64)
            for n in range(DIRECTIONS):
                column = curve * DIRECTIONS + n
                share = np.interp(projected[:, column], self.scales[:, column], np.linspace(0, 1, 129))
                cells[:, n] = np.minimum((share + self.shifts[curve, n]) / 2 * (1 << BITS), (1 << BITS) - 1)
            found.append(hilbert_keys(cells, BITS))
        return found

    def ranges(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        """The number of the range on each curve, a row per vector."""
        if query:
            unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
            lifted = np.concatenate((unit, np.zeros((len(unit), 1))), 1)
        else:
            lifted = self.lifted(vectors)
        keys = self.keys(lifted @ self.directions)
        return np.stack([np.searchsorted(c, k, "right") for c, k in zip(self.cuts, keys)], 1)


def matrix(column: pa.Array, size: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.astype(np.float64).reshape(len(column), size)


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> tuple[DataFrame, int]:
    """``vec_id``, ``vector`` of the rows that take part, and their length.

    Left out are null ids and vectors, empty and zero ones, those that hold a null, NaN
    or infinite number, and those of another length than most.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    rows = rows.filter(F.col("vec_id").isNotNull() & finite & F.exists("vector", lambda x: x != 0))
    sizes = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").first()
    size = sizes["size"] if sizes else 1
    return rows.filter(F.size("vector") == size), size


def nearest(vectors: DataFrame, asks: Column, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of the nearest found of each query.

    The rows where ``asks`` holds are the queries, all rows with another id the candidates.
    Ties go to the smaller id. A repeated id counts once, with its largest score.
    """
    rows, size = usable(vectors, vec_id, embedding)
    rows = stored(rows, "vectors")
    spark = rows.sparkSession
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    longest, count = rows.agg(F.max(length), F.count("*")).first()
    sample = sample_of_rows(rows.select("vector"), SAMPLED).collect()
    if not sample:
        sample = [([0.0] * size,)]
    curves = Curves(np.array([r[0] for r in sample], np.float64), longest or 1.0, count)
    curves = spark.sparkContext.broadcast(curves)

    def ranges(query: bool) -> Column:
        @F.arrow_udf("array<int>")
        def numbers(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                found = curves.value.ranges(matrix(batch, size), query).astype(np.int32)
                yield pa.ListArray.from_arrays(np.arange(0, found.size + 1, CURVES, dtype=np.int32), found.ravel())

        return numbers("vector")

    placed = rows.select("vec_id", "vector", F.posexplode(ranges(False)).alias("curve", "range"))
    asked = rows.filter(asks).select("vec_id", "vector", F.posexplode(ranges(True)).alias("curve", "own"))
    last = F.element_at(F.lit([len(c) for c in curves.value.cuts]), F.col("curve") + 1)
    low = F.greatest(F.least(F.col("own") - REACH, last - 2 * REACH), F.lit(0))
    near = F.sequence(low, F.least(low + 2 * REACH, last))
    asked = asked.withColumn("range", F.explode(near)).drop("own")

    # One row for each of CURVES x RANGES cells: how many parts its vectors and queries have.
    cell = ["curve", "range"]
    held = placed.groupBy(cell).agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("parts"))
    asking = asked.groupBy(cell).agg(F.ceil(F.count("*") / BLOCK_QUERIES).alias("shares"))
    cells = F.broadcast(stored(held.join(asking, cell), "cells"))
    salt = F.xxhash64("vec_id")
    part, share = F.pmod(salt, F.col("parts")), F.pmod(salt, F.col("shares"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = placed.join(cells, cell).select(*cell, part.alias("part"), every("shares").alias("share"), "vec_id", "vector")
    right = asked.join(cells, cell).select(*cell, share.alias("share"), every("parts").alias("part"), "vec_id", "vector")
    block = [*cell, "part", "share"]
    right = right.toDF(*[f"{name}_asked" for name in right.columns])
    met = (
        left.groupBy(block)
        .cogroup(right.groupBy([f"{name}_asked" for name in block]))
        .applyInArrow(
            lambda candidates, queries: best_of_block(candidates, queries, size),
            "query_id long, vec_id long, score double",
        )
    )
    distinct = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = distinct.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= NEAREST)
    return ranked.select("query_id", "rank", "vec_id", "score")


def best_of_block(candidates: pa.Table, queries: pa.Table, size: int) -> pa.Table:
    """The nearest of one block's vectors for each of its queries.

    A matrix product finds who can be among them; their scores are summed pair
    by pair, so that equal vectors have equal scores.
    """
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    ids = candidates["vec_id"].to_numpy()
    vectors = matrix(candidates["vector"].combine_chunks(), size) if len(ids) else np.zeros((0, size))
    asking = queries["vec_id_asked"].to_numpy()
    if len(ids) and len(asking):
        wanted = matrix(queries["vector_asked"].combine_chunks(), size)
        for start in range(0, len(asking), 256):
            own, query = asking[start : start + 256], wanted[start : start + 256]
            rough = query @ vectors.T
            rough[own[:, None] == ids[None, :]] = -np.inf
            least = np.partition(rough, -min(NEAREST, len(ids)), axis=1)[:, -min(NEAREST, len(ids))]
            slack = 1e-12 * np.linalg.norm(query, axis=1) * np.linalg.norm(vectors, axis=1).max()
            row, column = np.nonzero((rough >= (least - slack)[:, None]) & (rough > -np.inf))
            score = (query[row] * vectors[column]).sum(1)
            order = np.lexsort((ids[column], -score, row))
            row, column, score = row[order], column[order], score[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            kept = place < NEAREST
            found.append((own[row[kept]], ids[column[kept]], score[kept]))
    parts = [np.concatenate(p) for p in zip(*found)] if found else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
    return pa.table({"query_id": parts[0], "vec_id": parts[1], "score": parts[2]})
