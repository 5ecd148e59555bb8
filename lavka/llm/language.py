"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. The vector of three letters in
a row binds them: the first two are rotated by two places and one, and the
three are multiplied place by place. A text bundles, that is adds, the vectors
of all its letter triples; a language bundles its learned texts, each with
weight one. A text belongs to the language whose bundle has the largest cosine.

Letters and marks of any script count, in lower case; everything else is a
border between words, and borders take part in the triples around them.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lavka.llm.batches import pieces, runs
from lavka.llm.stored import stored

DIMENSIONS = 1024
#: Letters from which on a text's own language scores above chance.
TELLING_LETTERS = 60
SEED = 20
#: Profiles travel with every task; more languages than this are refused.
MOST_LANGUAGES = 1000
#: A task adds up so many languages before it hands on their partial bundles.
HELD_LANGUAGES = 200
PIECE = 1_000_000
ROWS = 128
#: Below so many possible triples they are counted in a table, else sorted.
TABLE = 4_000_000
UNKNOWN = "und"


@cache
def symbol_kinds() -> np.ndarray:
    """For each code point: 2 for a letter, 1 for a mark, 0 for a border."""
    kinds = {"L": 2, "M": 1}
    found = (kinds.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000))
    return np.fromiter(found, np.uint8, 0x110000)


@cache
def letter_vector(code: int, dimensions: int) -> np.ndarray:
    signs = np.random.default_rng([SEED, code]).integers(0, 2, dimensions, dtype=np.int8)
    return signs * 2 - 1


def letter_triples(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct triples of code points, and for each place with a letter or
    mark the number of its text and of its triple; last, which texts have a letter."""
    kinds = symbol_kinds()
    lowered = [t.lower() for t in texts]
    raw = ("\n" + "\n".join(lowered) + "\n").encode("utf-32-le", "surrogatepass")
    codes = np.frombuffer(raw, np.uint32)
    lengths = np.fromiter(map(len, lowered), np.int64, len(lowered)) + 1
    owner = np.repeat(np.arange(len(texts)), lengths)
    kind = kinds[codes]
    spelled = np.zeros(len(texts), bool)
    spelled[owner[kind[1:] == 2]] = True
    at = np.flatnonzero(kind)
    present = np.flatnonzero(np.bincount(codes[at], minlength=1)) if len(at) else np.zeros(0, np.int64)
    number = np.zeros(0x110000, np.int64)
    number[present] = np.arange(1, len(present) + 1)
    size = len(present) + 1
    symbol = np.where(kind > 0, number[codes], 0)
    code = (symbol[at - 1] * size + symbol[at]) * size + symbol[at + 1]
    if size**3 <= TABLE:
        distinct = np.flatnonzero(np.bincount(code, minlength=1)) if len(at) else code
        place = np.zeros(size**3, np.int32)
        place[distinct] = np.arange(len(distinct))
        which = place[code]
    else:
        distinct, which = np.unique(code, return_inverse=True)
    letters = np.concatenate(([0], present))
    parts = [letters[distinct // size**2], letters[distinct // size % size], letters[distinct % size]]
    return np.stack(parts, 1), owner[at - 1], which, spelled


def triple_vectors(triples: np.ndarray, dimensions: int) -> np.ndarray:
    """One bound vector per row of three code points; 0 stands for a border."""
    codes, which = np.unique(triples, return_inverse=True)
    letters = np.zeros((len(codes), dimensions), np.int8)
    for row, code in enumerate(codes.tolist()):
        letters[row] = letter_vector(code, dimensions)
    which = which.reshape(triples.shape)
    bound = np.roll(letters, 2, axis=1)[which[:, 0]]
    bound = bound * np.roll(letters, 1, axis=1)[which[:, 1]]
    return bound * letters[which[:, 2]]


def all_pieces(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Groups of pieces of bounded size, with the number of the text of each."""
    owners: list[int] = []
    parts: list[str] = []
    held = 0
    for number, text in enumerate(texts):
        for part in pieces(text or "", PIECE):
            if held + len(part) > PIECE:
                yield owners, parts
                owners, parts, held = [], [], 0
            owners.append(number)
            parts.append(part)
            held += len(part)
    yield owners, parts


def text_vectors(texts: list[str | None], dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """The bundle of each text, and whether it has a letter."""
    bundles = np.zeros((len(texts), dimensions), np.float32)
    spelled = np.zeros(len(texts), bool)
    for owners, parts in all_pieces(texts):
        triples, owner, which, has = letter_triples(parts)
        spelled[np.array(owners, np.int64)[has]] = True
        if not len(triples):
            continue
        vectors = triple_vectors(triples, dimensions).astype(np.float32)
        edges = np.searchsorted(owner, np.arange(0, len(parts) + ROWS, ROWS))
        for n, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
            rows = min(ROWS, len(parts) - n * ROWS)
            cell = (owner[a:b] - n * ROWS) * len(triples) + which[a:b]
            counts = np.bincount(cell, minlength=rows * len(triples)).astype(np.float32)
            found = counts.reshape(rows, len(triples)) @ vectors
            np.add.at(bundles, owners[n * ROWS : n * ROWS + rows], found)
    return bundles, spelled


def language_profiles(docs: DataFrame, text: Column, lang: Column, dimensions: int = DIMENSIONS) -> DataFrame:
    """One row per language: ``lang``, ``profile``.

    Rows with null language and texts without a letter teach nothing. The
    bundles of a task are added up before they are shuffled, so that a language
    of a third of all rows is one vector per task.
    """

    def bundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for start, texts in offsets(batch.column(0)):
                langs = batch.column(1).slice(start, len(texts)).to_pylist()
                bundles, spelled = text_vectors(texts.to_pylist(), dimensions)
                norms = np.linalg.norm(bundles, axis=1)
                for row in np.flatnonzero(spelled & (norms > 0)):
                    total = held.setdefault(langs[row], np.zeros(dimensions))
                    total += bundles[row] / norms[row]
                if len(held) > HELD_LANGUAGES:
                    yield partial(held)
                    held = {}
        yield partial(held)

    def partial(held: dict[str, np.ndarray]) -> pa.RecordBatch:
        names = pa.array(list(held), pa.string())
        sums = pa.array([v.tolist() for v in held.values()], pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([names, sums], ["lang", "bundle"])

    known = docs.select(text.alias("text"), lang.alias("lang")).dropna()
    parts = known.mapInArrow(bundled, "lang string, bundle array<double>")
    total = Summarizer.sum(array_to_vector("bundle"))
    return parts.groupBy("lang").agg(vector_to_array(total).alias("profile"))


def offsets(column: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    start = 0
    for texts in runs(column):
        yield start, texts
        start += len(texts)


def predicted_language(profiles: DataFrame, text: Column) -> Column:
    """Of each text a struct of ``lang_pred`` and ``score``, the cosine, 0 at least.

    Ties go to the language that sorts first. A null text, one without any
    letter, or no profile at all give ``und`` and 0.
    """
    learned = sorted(map(tuple, profiles.select("lang", "profile").take(MOST_LANGUAGES + 1)))
    if len(learned) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    names = [name for name, _ in learned]
    profile = np.array([vector for _, vector in learned] or np.zeros((0, 1)), np.float64)
    profile /= np.maximum(np.linalg.norm(profile, axis=1, keepdims=True), 1e-300)

    @F.arrow_udf("lang_pred string, score double")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            langs, scores = [], []
            for texts in runs(batch):
                given = texts.to_pylist()
                if not names:
                    langs += [UNKNOWN] * len(given)
                    scores += [0.0] * len(given)
                    continue
                bundles, spelled = text_vectors(given, profile.shape[1])
                norms = np.maximum(np.linalg.norm(bundles, axis=1), 1e-30)
                cosine = (bundles @ profile.T) / norms[:, None]
                best = cosine.argmax(1)
                langs += [names[b] if s else UNKNOWN for b, s in zip(best, spelled)]
                scores += np.where(spelled, np.clip(cosine.max(1), 0, 1), 0.0).tolist()
            yield pa.StructArray.from_arrays(
                [pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"]
            )

    return predict(text)


def recognised(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows whose language is recognised, all columns.

    Rejected are null texts, texts without a letter, and those whose cosine with
    the nearest language is no more than twice what random vectors have. A text of fewer letters than
    ``TELLING_LETTERS`` may score as little as that in its own language, so it stays if it has one. Where
    no language can be learned, only texts without a letter are rejected.
    """
    profiles = stored(language_profiles(docs, F.col(text), F.col(lang)), "profiles")
    letters = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\P{L}+", "")
    if profiles.isEmpty():
        return docs.filter(letters != "")
    own = "found"
    while own in docs.columns:  # a name that no column has
        own += "_"
    found = docs.withColumn(own, predicted_language(profiles, F.col(text)))
    near = F.col(f"{own}.score") > 2 / DIMENSIONS**0.5
    short = (F.col(f"{own}.lang_pred") != UNKNOWN) & F.length(letters).between(1, TELLING_LETTERS - 1)
    return found.filter(near | short).select(docs.columns)
