"""Toxicity by nearest labelled examples under exact cosine of TF-IDF times G weight.

Labelled texts are a bounded sample, ``MOST_EXAMPLES`` rows of smallest id
hash. Every word of theirs is a term. Document frequencies for the weights are
counted over all documents; words whose share among toxic examples differs beyond
chance (G-test) weigh more. Words of no example add to no product and are no terms,
but they count in a text's length: their document frequencies come from the same documents, and one
sum for each text is joined to its nearest examples, which are the same for any length.

Words of many examples make a dense matrix, whose products with a text are taken
in full. All others lie in an inverted index with the largest weight of every word in
every block of examples. A text's blocks of highest bound are scored first, and of the others
those whose bound reaches the nearest found, all at once: the result
is that of comparing with every example. Near examples vote with weight by
distance, and the votes are calibrated by a logistic curve that is fitted on
votes for each example by the others. A text without any word of the examples
has the share of toxic ones among examples without words, drawn to that of all.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lavka.llm.batches import runs
from lavka.llm.sampling import sample_by_key
from lavka.llm.stored import stored

#: The model is fitted on so many labelled rows at most.
MOST_EXAMPLES = 8192
#: A word of this G weighs twice as much as one of G 0; by chance one word in 100,000 has it.
TELLING_G = 20.0
NEAREST = 15
SHOWN = 3
#: Examples in one block of the index.
BLOCK = 512
#: Words of at least this share of the examples are common ones, those of the dense matrix.
COMMON = 0.05
#: Blocks scored before the others are weighed.
FIRST = 2
#: Texts scored at once.
TOGETHER = 256
#: Words of the examples that the driver and every task can hold; more of them are refused with an error.
MOST_WORDS = 20_000_000
#: Distance at which an example's weight is half of that of an equal text.
SOFTEN = 0.2
REMEMBERED = 200_000

WORD = regex.compile(r"\w+")
WORD_OR_END = regex.compile(r"\w+|\n")


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def distinct_words(text: Column) -> Column:
    @F.arrow_udf("array<string>")
    def distinct(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([sorted(set(words_of(t))) for t in batch.to_pylist()], pa.list_(pa.string()))

    return distinct(text)


def parallel_lists(rows: np.ndarray, count: int, *columns: pa.Array) -> list[pa.Array]:
    """Columns of lists, one list for each of ``count`` rows; ``rows`` ascends."""
    ends = pa.array(np.searchsorted(rows, np.arange(count + 1)), pa.int32())
    return [pa.ListArray.from_arrays(ends, column) for column in columns]


COUNTED = "struct<term: array<int>, count: array<int>, other: array<string>, times: array<int>>"


class WordCounter:
    """Words of a run of texts, counted all at once.

    What a stretch between white space holds is looked up once, the new stretches of a run together, and
    remembered as long as there is room.
    """

    def __init__(self, number: dict[str, int]):
        self.number = number
        self.places: dict[str, int] = {}  # of stretches in the two arrays
        self.held, self.words = array("q", [0]), array("q")  # words up to each stretch's end; their numbers
        self.others: dict[str, int] = {}  # words without a number of the vocabulary, numbered behind it

    def learn(self, stretches: list[str]) -> None:
        known, others, behind = self.number.get, self.others, len(self.number)
        for word in WORD_OR_END.findall("\n".join(stretches).lower() + "\n"):
            if word == "\n":
                self.held.append(len(self.words))
            else:
                number = known(word)
                self.words.append(behind + others.setdefault(word, len(others)) if number is None else number)
        self.places.update(zip(stretches, range(len(self.places), len(self.places) + len(stretches))))

    def forget(self, stretches: list[str], others: int) -> None:
        for stretch in stretches:
            del self.places[stretch]
        del self.held[len(self.places) + 1 :], self.words[self.held[-1] :]
        for word in list(self.others)[others:]:
            del self.others[word]

    def counted(self, texts: pa.Array) -> pa.StructArray:
        stretches = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
        text = np.repeat(np.arange(len(texts)), np.asarray(pc.list_value_length(stretches)))
        coded = stretches.flatten().dictionary_encode()
        values, others = coded.dictionary.to_pylist(), len(self.others)
        new = [stretch for stretch in values if stretch not in self.places]
        self.learn(new)
        place = np.fromiter(map(self.places.__getitem__, values), np.int64, len(values))[coded.indices.to_numpy()]
        ends, words = np.array(self.held), np.array(self.words)
        held = ends[place + 1] - ends[place]
        at = np.arange(held.sum()) + np.repeat(ends[place] - np.cumsum(held) + held, held)
        width = len(self.number) + len(self.others) + 1
        cells, times = np.unique(np.repeat(text, held) * width + words[at], return_counts=True)
        text, word = np.divmod(cells, width)
        own = word < len(self.number)
        names = pa.array(list(self.others), pa.string()).take(pa.array(word[~own] - len(self.number)))
        lists = parallel_lists(text[own], len(texts), pa.array(word[own], pa.int32()), pa.array(times[own], pa.int32()))
        lists += parallel_lists(text[~own], len(texts), names, pa.array(times[~own], pa.int32()))
        if len(self.places) > REMEMBERED:
            self.forget(new, others)
        return pa.StructArray.from_arrays(lists, ["term", "count", "other", "times"])


def term_counts(number: Broadcast, text: Column) -> Column:
    """The words of a text in parallel lists: numbers and counts of the vocabulary's, others and their counts."""

    @F.arrow_udf(COUNTED)
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = WordCounter(number.value)
        for batch in batches:
            yield pa.concat_arrays([counter.counted(run) for run in runs(batch)])

    return counted(text)


def outer_lengths(counted: DataFrame, total: int) -> DataFrame:
    """``row``, ``outer``: the square of the length that words of no example add to a text's vector.

    Such words are told apart by a hash of 64 bits.
    """
    each = counted.select("row", F.explode(F.arrays_zip("other", "times")).alias("w"))
    each = each.select("row", F.xxhash64("w.other").alias("other"), "w.times")
    documents = each.groupBy("other").agg(F.count("*").alias("documents"))
    weight = (1 + F.log("times")) * (1 + F.log((1 + F.lit(total)) / (1 + F.col("documents"))))
    return each.join(documents, "other").groupBy("row").agg(F.sum(weight * weight).alias("outer"))


def learned_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``text``, ``label`` of the sample; of repeated labels the largest counts."""
    known = labels.select("doc_id", "label").dropna().groupBy("doc_id").agg(F.max("label").alias("label"))
    own = docs.select("doc_id").dropna().distinct().join(known, "doc_id")
    chosen = sample_by_key(stored(own, "labelled"), MOST_EXAMPLES, "doc_id")
    texts = docs.join(F.broadcast(chosen), "doc_id")  # at most MOST_EXAMPLES pairs of numbers
    return texts.groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def weighed_words(learned: DataFrame) -> tuple[list[str], np.ndarray]:
    """All words of the examples in alphabetic order, and their G statistic against the label."""
    total, toxic = learned.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    seen = learned.select("label", F.explode(distinct_words(F.col("text"))).alias("word"))
    counts = seen.groupBy("word").agg(F.count("*").alias("n"), F.sum("label").alias("t"))
    table = counts.limit(MOST_WORDS + 1).toArrow().sort_by("word")  # no more rows than the sample has words
    if len(table) > MOST_WORDS:
        raise ValueError(f"the labelled texts hold more than {MOST_WORDS} words")
    n, t = (table[name].to_numpy().astype(np.float64) for name in ("n", "t"))
    g = np.zeros(len(n))
    for seen_, row, column in (
        (t, n, toxic), (n - t, n, total - toxic), (toxic - t, total - n, toxic), (total - n - toxic + t, total - n, total - toxic),
    ):
        some = seen_ > 0
        g[some] += 2 * seen_[some] * np.log(seen_[some] * total / (row[some] * column))
    return table["word"].to_pylist(), np.maximum(g, 0)


@dataclass
class Query:
    terms: np.ndarray
    weights: np.ndarray


def places(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of runs that begin at ``first``, run by run."""
    return np.arange(size.sum()) + np.repeat(first - np.cumsum(size) + size, size)


class BlockMaxIndex:
    """Unit vectors of examples as postings, with the largest weight by block.

    A cell is what a word has in one block. Only cells with postings are kept, so that the index grows with
    the postings and not with words times blocks, and it is filled block by block, without a copy of all.
    """

    def __init__(self, vectors: list[Query], ids: list[int], labels: list[int], terms: int):
        lead = [int(v.terms[v.weights.argmax()]) for v in vectors]
        order = sorted(range(len(vectors)), key=lambda n: (labels[n], lead[n], ids[n]))
        self.scored = 0  # blocks read so far
        self.ids = np.array([ids[n] for n in order], np.int64)
        self.labels = np.array([labels[n] for n in order], np.float64)
        self.blocks = max(-(-len(order) // BLOCK), 1)
        parts = [[vectors[n] for n in order[start : start + BLOCK]] for start in range(0, len(order), BLOCK)]
        seen, cells = np.zeros(terms, np.int32), np.zeros(terms, np.int32)  # examples and blocks with each word
        for part in parts:
            count = np.bincount(np.concatenate([v.terms for v in part]), minlength=terms)
            seen += count
            cells += count > 0
        common = np.flatnonzero(seen / max(len(order), 1) >= COMMON)
        self.column = np.full(terms, -1, np.int32)
        self.column[common] = np.arange(len(common))
        self.dense = np.zeros((len(common), self.blocks * BLOCK))
        seen[common] = cells[common] = 0
        self.cells = np.concatenate(([0], np.cumsum(cells)))  # the first cell of each word
        self.block, self.largest = np.zeros(self.cells[-1], np.int32), np.zeros(self.cells[-1])
        self.start = np.full(self.cells[-1] + 1, seen.sum(), np.int64)  # the first posting of each cell
        self.example, self.weight = np.zeros(self.start[-1], np.int64), np.zeros(self.start[-1])
        cell, free = self.cells[:-1].copy(), np.cumsum(seen) - seen  # of each word, the next to be filled
        for block, part in enumerate(parts):
            term, weight = (np.concatenate([getattr(v, name) for v in part]) for name in ("terms", "weights"))
            example = np.repeat(np.arange(len(part)) + block * BLOCK, [len(v.terms) for v in part])
            often = self.column[term] >= 0
            self.dense[self.column[term[often]], example[often]] = weight[often]
            by_term = np.argsort(np.where(often, terms, term), kind="stable")[: len(term) - often.sum()]
            example, weight = example[by_term], weight[by_term]
            held, first, size = np.unique(term[by_term], return_index=True, return_counts=True)
            if len(held):
                place = places(free[held], size)
                self.example[place], self.weight[place] = example, weight
                self.block[cell[held]], self.start[cell[held]] = block, free[held]
                self.largest[cell[held]] = np.maximum.reduceat(weight, first)
            cell[held] += 1
            free[held] += size

    def common(self, queries: list[Query]) -> np.ndarray:
        """The share that common words have in the similarity, by query and example."""
        wanted = np.zeros((len(queries), len(self.dense)))
        for row, query in zip(wanted, queries):
            column = self.column[query.terms]
            row[column[column >= 0]] = query.weights[column >= 0]
        return wanted @ self.dense

    def nearest(
        self, query: Query, without: int | None = None, common: np.ndarray | None = None
    ) -> tuple[np.ndarray, np.ndarray]:
        """The nearest examples of similarity above 0 and their similarity, by
        falling similarity, ties by id; ``without`` is an id left out."""
        common = self.common([query])[0] if common is None else common
        rare = self.column[query.terms] < 0
        terms, weights = query.terms[rare], query.weights[rare]
        size = self.cells[terms + 1] - self.cells[terms]
        cells, weights = places(self.cells[terms], size), np.repeat(weights, size)
        bound = common.reshape(self.blocks, -1).max(1)
        bound = bound + np.bincount(self.block[cells], weights * self.largest[cells], self.blocks)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        found, similar = self.of_blocks(order[:FIRST], cells, weights, common, without)
        left = order[FIRST:]
        if len(found) == NEAREST:
            left = left[bound[left] >= similar[-1] - 1e-12]
        if len(left):
            more, near = self.of_blocks(left, cells, weights, common, without)
            found, similar = self.best(np.concatenate((found, more)), np.concatenate((similar, near)))
        return found, similar

    def of_blocks(
        self, blocks: np.ndarray, cells: np.ndarray, weights: np.ndarray, common: np.ndarray, without: int | None
    ) -> tuple[np.ndarray, np.ndarray]:
        """The nearest examples of some blocks, from those only of the query's cells, with its weight for each cell."""
        self.scored += len(blocks)
        wanted = np.zeros(self.blocks, bool)
        wanted[blocks] = True
        wanted = wanted[self.block[cells]]
        cells, weights = cells[wanted], weights[wanted]
        size = self.start[cells + 1] - self.start[cells]
        at = places(self.start[cells], size)
        sums = np.bincount(self.example[at], np.repeat(weights, size) * self.weight[at], len(common))
        sums = (sums.reshape(self.blocks, -1)[blocks] + common.reshape(self.blocks, -1)[blocks]).ravel()
        if len(sums) > NEAREST + 1:  # one of them may be left out; the margin is wider than the rounding
            least = -np.partition(-sums, NEAREST)[NEAREST] - 1e-11
            near = np.flatnonzero((sums >= least) & (sums > 0))
        else:
            near = np.flatnonzero(sums > 0)
        found = blocks[near // BLOCK] * BLOCK + near % BLOCK
        similar = np.round(np.minimum(sums[near], 1.0), 12)
        if without is not None:
            other = self.ids[found] != without
            found, similar = found[other], similar[other]
        return self.best(found, similar)

    def best(self, found: np.ndarray, similar: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(found) > NEAREST:
            enough = similar >= -np.partition(-similar, NEAREST - 1)[NEAREST - 1]
            found, similar = found[enough], similar[enough]
        order = np.lexsort((self.ids[found], -similar))[:NEAREST]
        return found[order], similar[order]

    def vote(self, found: np.ndarray, similar: np.ndarray) -> float:
        """The weighted share of toxic ones among the found, drawn a little to a half."""
        weights = SOFTEN / (SOFTEN + 1 - similar)
        return float((weights @ self.labels[found] + 0.05) / (weights.sum() + 0.1))


def logit(share: np.ndarray) -> np.ndarray:
    return np.log(share / (1 - share))


def fitted_curve(votes: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope, at least 0, and shift of the logistic curve from votes to shares."""
    if not len(votes):
        return 1.0, 0.0
    x = np.stack([logit(votes), np.ones(len(votes))], 1)
    target = np.where(labels > 0, (labels.sum() + 1) / (labels.sum() + 2), 1 / ((1 - labels).sum() + 2))
    curve = np.array([1.0, 0.0])
    for _ in range(30):
        share = 1 / (1 + np.exp(-np.clip(x @ curve, -30, 30)))
        slope = x.T @ (share - target) + 0.1 * (curve - [1.0, 0.0])
        bend = (x * (share * (1 - share))[:, None]).T @ x + 0.1 * np.eye(2)
        curve = curve - np.clip(np.linalg.solve(bend, slope), -2, 2)
    return max(float(curve[0]), 0.0), float(curve[1])


class Model:
    """Everything that scoring needs, bounded by the sample and its words."""

    def __init__(self, examples: pa.Table, weight: np.ndarray):
        self.examples, self.weight = examples, weight
        self.slope, self.shift = 1.0, 0.0

    @cached_property
    def index(self) -> BlockMaxIndex:
        """Built by each process for itself, as it is several times as large as the examples."""
        rows = zip(slices(self.examples["term"]), slices(self.examples["count"]))
        vectors = [self.vector(*row)[0] if len(row[0]) else None for row in rows]
        ids, labels = self.examples["doc_id"].to_pylist(), self.examples["label"].to_pylist()
        kept = [n for n, vector in enumerate(vectors) if vector]
        return BlockMaxIndex([vectors[n] for n in kept], [ids[n] for n in kept], [labels[n] for n in kept], len(self.weight))

    @cached_property
    def silent(self) -> float:
        labels = self.examples["label"].to_pylist()
        without = [label for label, terms in zip(labels, slices(self.examples["term"])) if not len(terms)]
        overall = sum(labels) / len(labels) if labels else 0.0
        return (sum(without) + overall) / (len(without) + 1)

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> tuple[Query, float]:
        """The direction and the length of the examples' words in a text."""
        weights = (1 + np.log(counts)) * self.weight[terms]
        length = float(np.linalg.norm(weights))
        return Query(terms, weights / length), length

    def nearest(self, rows: Iterable, without: list | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, float] | None]:
        """The nearest examples of each row of terms and counts by the cosine of the examples'
        words, and the length of these; null where there are none."""
        rows = list(rows)
        for start in range(0, len(rows), TOGETHER):
            part = rows[start : start + TOGETHER]
            vectors = [self.vector(*row) if len(row[0]) else None for row in part]
            common = iter(self.index.common([v[0] for v in vectors if v]))
            for at, vector in enumerate(vectors, start):
                near = vector and (*self.index.nearest(vector[0], without and without[at], next(common)), vector[1])
                yield near if near and len(near[0]) else None

def slices(lists: pa.Array | pa.ChunkedArray) -> Iterator[np.ndarray]:
    """Each row of a column of lists of numbers."""
    for chunk in lists.chunks if isinstance(lists, pa.ChunkedArray) else [lists]:
        values, start = chunk.values.to_numpy(zero_copy_only=False), chunk.offsets.to_numpy()
        for a, b in zip(start[:-1].tolist(), start[1:].tolist()):
            yield values[a:b]


EVIDENCE = "array<struct<doc_id: bigint, similarity: double, label: int>>"
NEAR = pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("label", pa.int32())])


def toxicity(docs: DataFrame, labels: DataFrame, learn: Column) -> DataFrame:
    """``doc_id``, ``learned``, ``score`` and ``evidence`` of every row of ``docs``.

    ``docs`` has ``doc_id`` (integers) and ``text``, ``labels`` has ``doc_id``
    and ``label``, 0 or 1. Only rows where ``learn`` holds may be learned from. Null
    texts count as empty; repeated rows are scored each; rows with null labels or
    ids teach nothing. Without any labelled row all scores are 0.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", F.coalesce(learn, F.lit(False)).alias("learned"))
    learned = stored(learned_rows(docs.filter("learned"), labels), "learned")
    terms, g = weighed_words(learned)
    number = spark.sparkContext.broadcast({term: n for n, term in enumerate(terms)})
    found = term_counts(number, F.col("text")).alias("found")
    counted = docs.select("doc_id", "learned", found).withColumn("row", F.monotonically_increasing_id())
    counted = stored(counted.select("row", "doc_id", "learned", "found.*"), "terms")  # the numbers of rows are fixed with it
    total = counted.count()
    seen = counted.select(F.explode("term").alias("term")).groupBy("term").count().toArrow()  # a row per term
    documents = np.zeros(len(terms))
    documents[seen["term"].to_numpy()] = seen["count"].to_numpy()
    weight = (1 + np.log((1 + total) / (1 + documents))) * (1 + g / TELLING_G)
    own = learned.select("doc_id", F.col("label").cast("int").alias("label"), found)
    examples = stored(own.select("doc_id", "label", "found.term", "found.count"), "examples")
    fitted = Model(examples.toArrow(), weight)
    fixed = spark.sparkContext.broadcast(fitted)

    @F.arrow_udf("double")
    def voted(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for ids, terms_, counts in batches:
            near = fixed.value.nearest(zip(slices(terms_), slices(counts)), ids.to_pylist())
            yield pa.array([n and fixed.value.index.vote(*n[:2]) for n in near], pa.float64())

    dealt = examples.repartition(spark.sparkContext.defaultParallelism, "doc_id")
    votes = dealt.select("doc_id", voted("doc_id", "term", "count").alias("vote"), "label").dropna().toArrow().sort_by("doc_id")
    slope, shift = fitted_curve(votes["vote"].to_numpy(), votes["label"].to_numpy().astype(np.float64))
    kind = pa.struct([("near", pa.list_(NEAR)), ("length", pa.float64())])

    @F.arrow_udf(f"struct<near: {EVIDENCE}, length: double>")
    def searched(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        model = fixed.value
        for terms_, counts in batches:
            sizes, lengths, rows, similar = [], [], [], []
            for found in model.nearest(zip(slices(terms_), slices(counts))):
                sizes.append(len(found[0]) if found else 0)
                lengths.append(found[2] if found else None)
                if found:
                    rows.append(found[0])
                    similar.append(found[1])
            rows = np.concatenate(rows or [np.zeros(0, np.int64)])
            columns = [model.index.ids[rows], np.concatenate(similar or [np.zeros(0)]), model.index.labels[rows].astype(np.int32)]
            near = pa.StructArray.from_arrays([pa.array(c) for c in columns], fields=list(NEAR))
            ends = pa.array(np.cumsum([0, *sizes]), pa.int32())
            yield pa.StructArray.from_arrays([pa.ListArray.from_arrays(ends, near), pa.array(lengths, pa.float64())], fields=list(kind))

    near = counted.select("row", "doc_id", "learned", searched("term", "count").alias("s"))
    near = near.select("row", "doc_id", "learned", "s.near", (F.col("s.length") * F.col("s.length")).alias("inner"))
    near = near.join(outer_lengths(counted, total), "row", "left")
    share = F.sqrt(F.col("inner") / (F.col("inner") + F.coalesce("outer", F.lit(0.0))))
    whole = F.transform(
        "near", lambda n: F.struct(n["doc_id"].alias("doc_id"), F.round(n["similarity"] * share, 12).alias("similarity"), n["label"].alias("label"))
    )
    near = near.select("doc_id", "learned", whole.alias("near"))
    pull = F.transform("near", lambda n: SOFTEN / (SOFTEN + 1 - n["similarity"]))
    toxic = F.transform("near", lambda n: SOFTEN / (SOFTEN + 1 - n["similarity"]) * n["label"])
    total_of = lambda parts: F.aggregate(parts, F.lit(0.0), lambda done, x: done + x)
    vote = (total_of(toxic) + 0.05) / (total_of(pull) + 0.1)
    at = F.lit(slope) * F.log(vote / (1 - vote)) + F.lit(shift)
    score = 1 / (1 + F.exp(-F.greatest(F.least(at, F.lit(30.0)), F.lit(-30.0))))
    score = F.when(F.size("near") > 0, score).otherwise(F.lit(fitted.silent))
    return near.select("doc_id", "learned", score.alias("score"), F.slice("near", 1, SHOWN).alias("evidence"))
