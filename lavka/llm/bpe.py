"""BPE encoding and decoding with a pair occurrence index.

The distinct words of a batch lie end to end in one array of symbols. An index
maps each adjacent pair to all its positions. The lowest active rank is applied
to all its positions at once, and only the lists of the pairs that this makes
are extended; words never met before are the only ones merged.

Vocabulary files are read where the job runs and travel as one bounded
broadcast; a larger file is refused.
"""

from __future__ import annotations

import heapq
import json
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from lavka.llm.batches import runs

#: A vocabulary file may have so many bytes, as every task holds it.
LARGEST_FILE = 64 << 20
#: So many different words are remembered in a task before it starts anew.
REMEMBERED = 300_000
#: So many lists of ids are decoded at a time.
DECODED = 500
#: So many symbols of new words are indexed together.
INDEXED = 800_000

# What the vocabulary's pre-tokenizer takes for a word.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
#: Python takes these for white space, the vocabulary's normalizer does not.
ODD_SPACE = regex.compile(r"[\x1c-\x1f]")
SPACE = regex.compile(r"\p{White_Space}+")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in printable}
    others = (b for b in range(256) if b not in letters)
    letters |= {b: chr(256 + n) for n, b in enumerate(others)}
    return [letters[b] for b in range(256)]


class Vocabulary:
    """Symbols, ranked merges and special tokens of a ``tokenizers`` BPE file."""

    def __init__(self, content: str):
        read = json.loads(content)
        model = read["model"]
        ids: dict[str, int] = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in read.get("added_tokens", [])}
        by_id = {i: t for t, i in ids.items()} | {i: t for t, i in self.special.items()}
        self.tokens = pa.array([by_id.get(i, "") for i in range(max(by_id, default=-1) + 1)])
        letters = byte_letters()
        self.inner = np.array([ids[c] for c in letters], np.int64)
        self.last = np.array([ids[c + suffix] for c in letters], np.int64)
        pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
        self.left = np.array([ids[a] for a, _ in pairs], np.int64)
        self.right = np.array([ids[b] for _, b in pairs], np.int64)
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int64)
        made = dict(zip(self.merged.tolist(), range(len(pairs))))
        for rank, (a, b) in enumerate(zip(self.left.tolist(), self.right.tolist())):
            if max(made.get(a, -1), made.get(b, -1)) >= rank:
                raise ValueError(f"merge {rank} stands before one that makes its parts")
        keys = self.left << 32 | self.right
        self.rank_of_key = np.argsort(keys, kind="stable")
        self.keys = keys[self.rank_of_key]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, -1 where it never merges."""
        if not len(self.keys):
            return np.full(len(left), -1)
        wanted = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.rank_of_key[at], -1)


def merged_symbols(words: list[str], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words one after another, and how many each word has."""
    coded = [w.encode("utf-8", "replace") for w in words]
    lengths = np.fromiter(map(len, coded), np.int64, len(coded))
    raw = np.frombuffer(b"".join(coded), np.uint8)
    size, ends = len(raw), np.cumsum(lengths) - 1
    symbol = vocabulary.inner[raw]
    symbol[ends] = vocabulary.last[raw[ends]]
    following, previous = np.arange(1, size + 1), np.arange(-1, size - 1)
    following[ends] = -1
    previous[ends - lengths + 1] = -1
    alive = np.ones(size, bool)

    index: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def note(positions: np.ndarray) -> None:
        """Add these left ends of pairs to the index."""
        ranks = vocabulary.ranks(symbol[positions], symbol[following[positions]])
        positions, ranks = positions[ranks >= 0], ranks[ranks >= 0]
        if not len(ranks):
            return
        order = np.argsort(ranks, kind="stable")
        positions, ranks = positions[order], ranks[order]
        cuts = np.flatnonzero(np.diff(ranks)) + 1
        starts = [0, *cuts.tolist()]
        for rank, found in zip(ranks[starts].tolist(), np.split(positions, cuts)):
            if rank in index:
                index[rank].append(found)
            else:
                index[rank] = [found]
                heapq.heappush(active, rank)

    note(np.flatnonzero(following >= 0))
    while active:
        rank = heapq.heappop(active)
        lists = index.pop(rank)
        left, right = vocabulary.left[rank], vocabulary.right[rank]
        at = np.unique(np.concatenate(lists)) if len(lists) > 1 else lists[0]
        at = at[alive[at] & (symbol[at] == left) & (following[at] >= 0)]
        at = at[symbol[following[at]] == right]
        if left == right and len(at) > 1:  # of a run of equal symbols, the left ones pair first
            joined = np.concatenate(([False], following[at[:-1]] == at[1:]))
            number = np.arange(len(at))
            start = np.maximum.accumulate(np.where(joined, 0, number))
            at = at[(number - start) % 2 == 0]
        if not len(at):
            continue
        gone = following[at]
        after = following[gone]
        symbol[at] = vocabulary.merged[rank]
        alive[gone] = False
        following[at] = after
        previous[after[after >= 0]] = at[after >= 0]
        before = previous[at]
        before = before[before >= 0]
        touched = np.concatenate((before, at[after >= 0]))
        note(np.unique(touched))

    kept = np.add.reduceat(alive, ends - lengths + 1, dtype=np.int64) if size else lengths
    return symbol[alive], kept


class Encoder:
    """Ids of texts; remembers the ids of every stretch between white space."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        special = sorted(map(regex.escape, vocabulary.special), key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(special) + ")") if special else None
        self.marks = list(vocabulary.special)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.lists: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.learn_ids([(mark, [number]) for mark, number in self.vocabulary.special.items()])

    def learn_ids(self, entries: list[tuple[str, list[int]]]) -> None:
        for name, _ in entries:
            self.known[name] = len(self.known)
        self.lists.append(np.array([i for _, ids in entries for i in ids], np.int32))
        self.counts.append(np.array([len(ids) for _, ids in entries], np.int64))

    def stretches(self, text: str | None) -> list[str]:
        """The text cut at white space, special tokens apart."""
        if not text:
            return []
        cut = SPACE.split if ODD_SPACE.search(text) else str.split
        if self.special is None or not any(mark in text for mark in self.marks):
            return cut(text)
        found: list[str] = []
        for number, part in enumerate(self.special.split(text)):
            found += [part] if number % 2 else self.plain(cut(part))
        return found

    def plain(self, parts: list[str]) -> list[str]:
        return [p for p in parts if p not in self.vocabulary.special]

    def learn(self, new: list[str]) -> None:
        """Index the words of these stretches and remember their ids."""
        words: dict[str, int] = {}
        parts, sizes = [], []
        for stretch in new:
            composed = unicodedata.normalize("NFC", stretch).replace("\u03a3", "\u03c3").lower()
            found = WORD.findall(composed)
            parts += [words.setdefault(w, len(words)) for w in found]
            sizes.append(len(found))
        ids, kept = merged_symbols(list(words), self.vocabulary) if words else (np.zeros(0), np.zeros(0, np.int64))
        part, size = np.array(parts, np.int64), np.array(sizes, np.int64)
        flat = gathered(ids, kept, part)
        total = np.concatenate(([0], np.cumsum(kept[part] if len(part) else [])))
        ends = np.cumsum(size)
        for stretch in new:
            self.known[stretch] = len(self.known)
        self.lists.append(flat.astype(np.int32))
        self.counts.append((total[ends] - total[ends - size]).astype(np.int64))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and how many each text has."""
        if len(self.known) > REMEMBERED:
            self.forget()
        new: list[str] = []
        held, known = 0, self.known
        lengths = np.zeros(len(texts), np.int64)
        met: set[str] = set()
        for row, text in enumerate(texts):
            found = self.stretches(text)
            lengths[row] = len(found)
            met.update(s for s in found if s not in known)
        for stretch in met:
            new.append(stretch)
            held += len(stretch)
            if held > INDEXED:
                self.learn(new)
                new, held = [], 0
        if new:
            self.learn(new)
        self.lists, self.counts = [np.concatenate(self.lists)], [np.concatenate(self.counts)]
        which = np.fromiter(
            (known[s] for t in texts for s in self.stretches(t)), np.int64, int(lengths.sum())
        )
        sizes = np.concatenate(([0], np.cumsum(self.counts[0][which])))
        ends = np.cumsum(lengths)
        return gathered(self.lists[0], self.counts[0], which), sizes[ends] - sizes[ends - lengths]


def gathered(values: np.ndarray, counts: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The value lists number ``which`` of a flat array of lists, in that order."""
    if not len(which):
        return values[:0]
    starts = np.cumsum(counts) - counts
    size = counts[which]
    ends = np.cumsum(size)
    shift = np.repeat(starts[which] - (ends - size), size)
    return values[np.arange(ends[-1]) + shift]


def shared_vocabulary(spark: SparkSession, path: str):
    """The file's content as a broadcast of checked size."""
    if os.path.getsize(path) > LARGEST_FILE:
        raise ValueError(f"the vocabulary has more than {LARGEST_FILE} bytes")
    with open(path, encoding="utf-8") as file:
        return spark.sparkContext.broadcast(file.read())


def encode(spark: SparkSession, text: Column, path: str) -> Column:
    """The token ids of a text, without special tokens of the model's own.

    A null or empty text, or one of white space only, has no ids. Special
    tokens that stand in a text are single ids, as the file says.
    """
    content = shared_vocabulary(spark, path)

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(Vocabulary(content.value))
        for batch in batches:
            flat, counts = [], []
            for texts in runs(batch):
                found, sizes = encoder.encode(texts.to_pylist())
                flat.append(found.astype(np.int32))
                counts.append(sizes)
            offsets = np.concatenate(([0], np.cumsum(np.concatenate(counts)))).astype(np.int32)
            yield pa.ListArray.from_arrays(offsets, np.concatenate(flat))

    return ids(text)


def decode(spark: SparkSession, ids: Column, path: str) -> Column:
    """The text of token ids: the tokens joined by single spaces.

    The vocabulary has no decoder of its own, so that its tokens keep their
    byte letters and word ends, special tokens included. Null gives null; an
    unknown id gives nothing.
    """
    content = shared_vocabulary(spark, path)

    @F.arrow_udf("string")
    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens = Vocabulary(content.value).tokens
        for batch in batches:
            starts = range(0, max(len(batch), 1), DECODED)
            yield pa.concat_arrays([joined(batch.slice(i, DECODED), tokens) for i in starts])

    def joined(lists: pa.Array, tokens: pa.Array) -> pa.Array:
        values = lists.flatten().cast(pa.int64())
        known = pc.and_(pc.greater_equal(values, 0), pc.less(values, len(tokens)))
        names = tokens.take(pc.if_else(known, values, None))
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
        kept = names.drop_null()
        if len(kept) != len(names):
            seen = np.concatenate(([0], np.cumsum(names.is_valid().to_numpy(zero_copy_only=False))))
            offsets = seen[offsets].astype(np.int32)
        text = pc.binary_join(pa.ListArray.from_arrays(offsets, kept), " ")
        return pc.if_else(lists.is_valid(), text, None)

    return texts(ids)
