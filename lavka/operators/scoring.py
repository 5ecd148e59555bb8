"""Scoring blocks of a corpus against blocks of queries inside Arrow batches.

Every pair has to be scored, but no pair ever becomes a row: a task keeps the
best k per query and emits only those. It reads its part of the corpus and has
all queries at hand (the corpus is neither shuffled nor sorted, and the shuffle
that follows carries at most tasks x queries x k rows), or it reads its part of
the queries and has the corpus at hand (queries x k rows).

Single precision and a proven bound of its error tell which pairs may be among
the best; only those are scored in double precision, so results are exact.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

QUERY_BLOCK = 2048  # queries scored at once
MAX_CELLS = 1 << 21  # cells of one score matrix: 8 MB
BLOCK_LISTS = 1_000_000  # sum of k of the queries that a task scores at once where it reads queries
DENSE = 32  # one of so many cells in double precision costs as much as all of them in one product
PAIRS = 1 << 14  # pairs scored in double precision at once
ROWS = 1 << 13  # corpus rows laid out at once
WAITING = 1 << 18  # hits that may wait until those no longer among the best are dropped
NO_ID = np.iinfo(np.int64).max


def dense(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """The float lists of a column as unit vectors. A list of another length, a
    null and a vector without length turn into NaN and so never score."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    own = sizes == width
    matrix = np.full((len(column), width), np.nan)
    if own.all():
        flat = column.flatten()
    else:
        flat = column.filter(pa.array(own)).flatten()
    matrix[own] = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    length = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))[:, None]
    return np.divide(matrix, length, out=np.full_like(matrix, np.nan), where=length > 0)


class Vectors:
    """A column's vectors, laid out once for each length that is asked for."""

    def __init__(self, column: pa.ChunkedArray | pa.Array):
        self.column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        self.sizes = pc.fill_null(pc.list_value_length(self.column), 0).to_numpy(zero_copy_only=False)
        self.laid_out = {}

    def of(self, width: int) -> Directions:
        if width not in self.laid_out:
            own = self.sizes == width
            column = self.column if own.all() else self.column.filter(pa.array(own))
            given = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            self.laid_out[width] = Directions(np.flatnonzero(own), given)
        return self.laid_out[width]


class Directions:
    """Vectors of one length by their places: as they are given, and as unit vectors in single precision. Those
    without a direction are left out."""

    def __init__(self, at: np.ndarray, given: np.ndarray):
        matrix = given.astype(np.float64)
        length = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
        unit = np.divide(matrix, length[:, None], out=np.full_like(matrix, np.nan), where=length[:, None] > 0)
        own = ~np.isnan(unit).any(axis=1)
        if own.all():
            self.at, self.given, self.length, self.single = at, given, length, unit.astype(np.float32)
        else:
            self.at, self.given, self.length, self.single = at[own], given[own], length[own], unit[own].astype(np.float32)

    def unit(self, rows: np.ndarray | None = None) -> np.ndarray:
        given, length = (self.given, self.length) if rows is None else (self.given.take(rows, 0), self.length.take(rows))
        return np.divide(given, length[:, None], dtype=np.float64)


def true_cells(cells: np.ndarray) -> np.ndarray:
    """Places of the true cells of a contiguous table, few as a rule, looked for by eights."""
    flat = cells.reshape(-1)
    whole = len(flat) & ~7
    eights = np.flatnonzero(flat[:whole].view(np.uint64) != 0)
    near = (eights[:, None] * 8 + np.arange(8)).reshape(-1)
    return np.concatenate([near[flat[near]], whole + np.flatnonzero(flat[whole:])])


class VectorScores:
    """Cosine of corpus embeddings and query vectors of equal length."""

    def __init__(self, queries: pa.Table | pa.RecordBatch):
        vectors = Vectors(queries.column("qvec"))
        self.widths = {int(width): vectors.of(int(width)) for width in np.unique(vectors.sizes) if width}

    @staticmethod
    def prepared(batch: pa.RecordBatch) -> Vectors:
        """What all blocks of queries need of a batch."""
        return Vectors(batch.column("embedding"))

    def reaching(self, vectors: Vectors, k: np.ndarray, floors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, row and score of all pairs that reach the query's floor; of a query without one yet, of at
        least its k best pairs.

        A sum of n products of unit vectors in single precision is less than (n + 3) / 2^24 off in any order
        of summation, the rounding to 6 digits half a unit; ``slack`` is twice as much.
        """
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        for width, asked in self.widths.items():
            rows, at = vectors.of(width), asked.at
            if not len(at) or not len(rows.at):
                continue
            slack = (width + 8) * 2.0**-23 + 1e-6
            cells, lowest = asked.single @ rows.single.T, floors[at] - slack
            free = np.flatnonzero(np.isneginf(lowest) & (k[at] < len(rows.at)))
            for most in np.unique(k[at[free]]):
                same, cut = free[k[at[free]] == most], len(rows.at) - int(most)
                lowest[same] = np.partition(cells[same], cut, axis=1)[:, cut] - 2 * slack
            flat = true_cells(cells >= lowest.astype(np.float32)[:, None])
            query, row = np.divmod(flat, len(rows.at))
            if len(flat) * DENSE > cells.size:
                score = (asked.unit() @ rows.unit().T).reshape(-1)[flat]
            else:
                score = np.empty(len(flat))
                for start in range(0, len(flat), PAIRS):
                    part = slice(start, start + PAIRS)
                    score[part] = np.einsum("ij,ij->i", asked.unit(query[part]), rows.unit(row[part]))
            found.append((at[query], rows.at[row], np.round(score, 6)))
        return tuple(np.concatenate(values) for values in zip(*found))


def best_cells(scores: np.ndarray, ids: np.ndarray, k: np.ndarray, floors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Query and row numbers of each query's k best rows (score descending, id ascending) that reach its
    floor; ``scores`` has a column for each query, nan where a row takes no part."""
    query, row = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for at in range(scores.shape[1]):
        column, most = scores[:, at], int(k[at])
        hits = np.flatnonzero(column >= floors[at])
        if len(hits) > most:
            hits = hits[column[hits] >= -np.partition(-column[hits], most - 1)[most - 1]]
        hits = hits[np.lexsort((ids[hits], -column[hits]))][:most]
        query.append(np.full(len(hits), at))
        row.append(hits)
    return np.concatenate(query), np.concatenate(row)


def best_first(query: np.ndarray, score: np.ndarray, ident: np.ndarray) -> np.ndarray:
    """The order by query, score (a cosine of 6 digits) descending and id, sorted by one number; equal ones by id."""
    key = (query << 22) - np.rint(score * 1e6).astype(np.int64)
    order = np.argsort(key)
    key = key[order]
    equal = key[1:] == key[:-1]
    tied = np.flatnonzero(np.concatenate([[False], equal]) | np.concatenate([equal, [False]]))
    order[tied] = order[tied][np.lexsort((ident[order[tied]], key[tied]))]
    return order


class BestHits:
    """The k best (score descending, id ascending) per query of all rows added."""

    columns = {"id": pa.int64(), "score": pa.float64(), "k": pa.int64()}

    def __init__(self, k: np.ndarray):
        self.k = k
        self.hits = [(np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))]  # query, score, id; the first ones cut
        self.waiting, self.most = 0, min(int(k.sum()), WAITING)  # hits not cut yet, and how many of them are kept
        # score and id of the last hit held by a query that has its k
        self.floor, self.floor_id = np.full(len(k), -np.inf), np.full(len(k), NO_ID)

    def add(self, ids: np.ndarray, scorer: VectorScores, vectors: Vectors) -> None:
        query, row, score = scorer.reaching(vectors, self.k, self.floor)
        ident, floor = ids[row], self.floor[query]
        better = (score > floor) | ((score == floor) & (ident < self.floor_id[query]))
        self.hits.append((query[better], score[better], ident[better]))
        self.waiting += len(self.hits[-1][0])
        if self.waiting >= self.most:
            self.cut()

    def cut(self) -> None:
        """Drop what is no longer among the best."""
        query, score, ident = (np.concatenate(values) for values in zip(*self.hits))
        order = best_first(query, score, ident)
        query, score, ident = query[order], score[order], ident[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        last = place + 1 == self.k[query]
        self.floor[query[last]], self.floor_id[query[last]] = score[last], ident[last]
        keep = place < self.k[query]
        self.hits, self.waiting = [(query[keep], score[keep], ident[keep])], 0

    def rows(self) -> tuple:
        """Query number per row, and the columns."""
        self.cut()
        query, score, ident = self.hits[0]
        return query, (ident, score, self.k[query])


def hit_rows(block: pa.Table, kept: BestHits, schema: pa.Schema) -> pa.RecordBatch:
    """What a keeper holds behind the queries' own key columns."""
    at, values = kept.rows()
    keys = [block.column(name).combine_chunks().take(pa.array(at)) for name in schema.names[: -len(values)]]
    return pa.RecordBatch.from_arrays([*keys, *map(pa.array, values)], schema=schema)


def received(sent: Broadcast) -> pa.Table:
    return pa.ipc.open_stream(sent.value).read_all()


def score_blocks(
    blocks: list[Broadcast], batches: Iterator[pa.RecordBatch], scorer: Callable, keeper: Callable, schema: pa.Schema
) -> Iterator[pa.RecordBatch]:
    """Run every corpus batch past every block of queries, then emit what the
    keepers hold."""
    held = []
    for sent in blocks:
        queries = received(sent)
        for start in range(0, len(queries), QUERY_BLOCK):
            block = queries.slice(start, QUERY_BLOCK)
            held.append((block, scorer(block), keeper(block["k"].to_numpy())))
    rows = min(ROWS, MAX_CELLS // max([1, *(len(block) for block, _, _ in held)]))
    for batch in batches if held else ():
        for start in range(0, batch.num_rows, rows):
            part = batch.slice(start, rows)
            ids, prepared = part.column("id").to_numpy(), scorer.prepared(part)
            for _, score, kept in held:
                kept.add(ids, score, prepared)
    for block, _, kept in held:
        yield hit_rows(block, kept, schema)


def score_queries(
    blocks: list[Broadcast], batches: Iterator[pa.RecordBatch], scorer: Callable, keeper: Callable, schema: pa.Schema
) -> Iterator[pa.RecordBatch]:
    """Run blocks of a task's queries past the whole corpus, emitting what the keeper holds after each."""
    corpus = [received(sent) for sent in blocks]
    for batch in batches:
        queries, start = pa.Table.from_batches([batch]), 0
        sums = np.cumsum(queries["k"].to_numpy())
        while start < len(queries):
            before = sums[start - 1] if start else 0
            fitting = int(np.searchsorted(sums, before + BLOCK_LISTS, side="right"))
            block = queries.slice(start, min(max(1, fitting - start), QUERY_BLOCK))
            score, kept = scorer(block), keeper(block["k"].to_numpy())
            rows = min(ROWS, MAX_CELLS // len(block))
            for table in corpus:
                for at in range(0, len(table), rows):
                    part = table.slice(at, rows)
                    kept.add(part["id"].combine_chunks().to_numpy(), score, scorer.prepared(part))
            yield hit_rows(block, kept, schema)
            start += len(block)
