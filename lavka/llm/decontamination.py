"""Benchmark items inside documents: size-partitioned MinHash containment search.

Items are partitioned by their number of distinct shingles of five words into
classes up to 1, 2, 4, 8 ... shingles. A document is covered, for each class that has
items, by windows of twice the class's size that overlap by half, so that an
item of the class lies whole in some window and its Jaccard similarity to that
window is bounded below, however long the document is. Windows and items have
MinHash signatures; one equal minimum makes an item a candidate of the
document. The minima of short blocks are joined for longer ones, so that each
shingle is hashed once for all classes.

Candidates are verified on the words themselves: the share of the item's
distinct shingles that occur anywhere in the document.

Words are runs of ASCII letters and digits and of other characters beyond ASCII,
general, Latin-1 and ideographic punctuation excepted, in lower case; in scripts that put no spaces between
words each character is one. An item of fewer than five words is one shingle of all its words, looked up by
its hash among the document's runs of as many words and verified like any other. Items without a word
match nothing; null and empty texts contain nothing. A repeated document or item is reported each
time, an item of any length is searched whole, and other columns take no part.

With 64 minima, an item of the least accepted containment 0.8 is missed with
a probability below 2e-6, a whole copy below 1e-7 (half a window of the
largest size of its class, 0.75**64).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lavka.llm.batches import pieces, runs

SHINGLE = 5
CONTAINED = 0.8
HASHES = 64
#: Items are searched in blocks of about so many items and characters, as every task holds a block.
BLOCK_ITEMS = 2048
BLOCK_CHARACTERS = 8_000_000
PIECE = 500_000
#: So many shingles have their minima taken at a time.
CHUNK = 65_536

PUNCTUATION = regex.compile(r"[\u2000-\u206f\u00a0-\u00bf\u3000-\u3004\u3008-\u3020\uff01-\uff0f\uff1a-\uff20]")
#: Scripts without spaces between words.
UNSPACED = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]"
SINGLE = regex.compile(f"({UNSPACED})")
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
BASE = 0x9E3779B97F4A7C15
SPREAD = np.uint64(0xFF51AFD7ED558CCD)


def powers(base: int, size: int) -> np.ndarray:
    found = np.full(size, base, np.uint64)
    found[0] = 1
    return np.multiply.accumulate(found)


ROOM = PIECE * 4 + 16
UP, DOWN = powers(BASE, ROOM), powers(pow(BASE, -1, 1 << 64), ROOM)
MULTIPLIERS = np.random.default_rng(7).integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def plain(text: str | None) -> str:
    lowered = (text or "").lower()
    if lowered.isascii():
        return lowered
    if PUNCTUATION.search(lowered):
        lowered = PUNCTUATION.sub(" ", lowered)
    return SINGLE.sub(r" \1 ", lowered) if SINGLE.search(lowered) else lowered


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * SPREAD
    return values ^ (values >> np.uint64(29))


def word_hashes(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One hash per word of all parts in order, and how many words each part has."""
    raw = np.frombuffer(b"\n" + b"\n".join(parts) + b"\n", np.uint8)
    inside = WORD_BYTES[raw]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    sums = np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * UP[: len(raw)], dtype=np.uint64)
    hashes = mixed((sums[ends - 1] - sums[starts - 1]) * DOWN[starts])
    limits = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    upto = np.searchsorted(starts, limits)
    return hashes, np.diff(upto, prepend=0)


def text_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of all texts one after another, and how many each has."""
    hashes: list[np.ndarray] = []
    counts = np.zeros(len(texts), np.int64)
    group: list[bytes] = []
    owners: list[int] = []
    held = 0

    def flush() -> None:
        found, sizes = word_hashes(group)
        hashes.append(found)
        np.add.at(counts, owners, sizes)

    for number, text in enumerate(texts):
        for part in pieces(plain(text), PIECE):
            if group and held + len(part) > PIECE:
                flush()
                group, owners, held = [], [], 0
            group.append(part.encode("utf-8", "replace"))
            owners.append(number)
            held += len(part)
    if group:
        flush()
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), counts


def shingle_hashes(words: np.ndarray, counts: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the shingles of all texts, none across two texts, and their counts."""
    sizes = np.maximum(counts - size + 1, 0)
    if len(words) < size:
        return words[:0], sizes
    total = np.zeros(len(words) - size + 1, np.uint64)
    for n in range(size):
        total = total * np.uint64(BASE) + words[n : n + len(total)]
    ends = np.cumsum(counts)
    left = np.repeat(ends, counts)[: len(total)] - np.arange(len(total))
    return mixed(total[left >= size]), sizes


def all_words(text: str) -> list[str]:
    return regex.findall("[0-9a-z\u0080-\U0010ffff]+", plain(text))


def shingles(text: str, size: int = SHINGLE) -> set[tuple[str, ...]]:
    """The distinct shingles themselves, for verification."""
    found = all_words(text)
    return set(zip(*(found[n:] for n in range(size))))


def minima(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """MinHash values of runs of shingles that begin at ``starts``, one row per function."""
    found = np.empty((HASHES, len(starts)), np.uint64)
    chunk = starts // CHUNK
    first = np.flatnonzero(np.diff(chunk, prepend=-1))
    for a, b in zip(first, [*first[1:], len(starts)]):
        end = starts[b] if b < len(starts) else len(hashes)
        part, cuts = hashes[starts[a] : end], starts[a:b] - starts[a]
        for row, multiplier in enumerate(MULTIPLIERS):
            found[row, a:b] = np.minimum.reduceat(part * multiplier, cuts)
    return found


@dataclass
class SizeClass:
    """Items of one size class with their sorted minima for each function."""

    size: int
    values: np.ndarray
    items: np.ndarray
    flags: np.ndarray


class Items:
    """A block of items, prepared for the search."""

    def __init__(self, texts: list[str]):
        self.shingles = [shingles(t) for t in texts]
        words, counts = text_words(texts)
        hashes, sizes = shingle_hashes(words, counts)
        ends = np.cumsum(sizes)
        self.short: dict[int, list[int]] = {}  # items of fewer words than a shingle, by their number of words
        for number, count in enumerate(counts.tolist()):
            if 0 < count < SHINGLE:
                self.short.setdefault(count, []).append(number)
                self.shingles[number] = {tuple(all_words(texts[number]))}
        self.short_hashes = {}
        for size, members in self.short.items():
            own = shingle_hashes(*text_words([texts[m] for m in members]), size)[0]
            order = np.argsort(own, kind="stable")
            self.short_hashes[size] = own[order], np.array(members)[order]
        distinct = [np.unique(hashes[e - s : e]) for s, e in zip(sizes, ends)]
        classes: dict[int, list[int]] = {}
        for number, found in enumerate(distinct):
            if len(found):
                classes.setdefault(1 << (len(found) - 1).bit_length(), []).append(number)
        self.classes = [self.size_class(size, classes[size], distinct) for size in sorted(classes)]
        self.hashes = distinct

    def size_class(self, size: int, members: list[int], distinct: list[np.ndarray]) -> SizeClass:
        lengths = np.array([len(distinct[m]) for m in members])
        values = minima(np.concatenate([distinct[m] for m in members]), np.cumsum(lengths) - lengths)
        order = np.argsort(values, axis=1, kind="stable")
        flags = np.zeros((HASHES, 1 << 16), bool)
        for row in range(HASHES):
            flags[row, short(values[row])] = True
        return SizeClass(size, np.take_along_axis(values, order, 1), np.array(members)[order], flags)

    def candidates(self, hashes: np.ndarray, sizes: np.ndarray) -> set[tuple[int, int]]:
        """Pairs of text and item that share a minimum in a window of the item's class."""
        found: set[tuple[int, int]] = set()
        if not self.classes or not len(hashes):
            return found
        size = self.classes[0].size
        blocks = -(-sizes // size)
        owner = np.repeat(np.arange(len(sizes)), blocks)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        starts = np.repeat(np.cumsum(sizes) - sizes, blocks) + number * size
        lows = minima(hashes, starts)
        for group in self.classes:
            while size < group.size:  # two blocks of a text become one of twice the size
                even = np.flatnonzero(number % 2 == 0)
                lows = np.minimum.reduceat(lows, even, axis=1)
                owner, number, size = owner[even], number[even] // 2, size * 2
            windows = lows.copy()
            same = owner[1:] == owner[:-1]
            np.minimum(windows[:, :-1], lows[:, 1:], out=windows[:, :-1], where=same)
            for row in range(HASHES):
                hit = np.flatnonzero(group.flags[row][short(windows[row])])
                value = windows[row][hit]
                a = np.searchsorted(group.values[row], value, "left")
                b = np.searchsorted(group.values[row], value, "right")
                for at, low, high in zip(hit[b > a], a[b > a], b[b > a]):
                    found.update((int(owner[at]), int(i)) for i in group.items[row][low:high])
        return found

    def short_candidates(self, words: np.ndarray, counts: np.ndarray) -> set[tuple[int, int]]:
        """Pairs of text and item of few words that have the hash of a run of words in common."""
        found: set[tuple[int, int]] = set()
        for size, (wanted, items) in self.short_hashes.items():
            hashes, sizes = shingle_hashes(words, counts, size)
            first = np.searchsorted(wanted, hashes, "left")
            last = np.searchsorted(wanted, hashes, "right")
            owner = np.repeat(np.arange(len(sizes)), sizes)
            hit = last > first
            for text, low, high in {*zip(owner[hit].tolist(), first[hit].tolist(), last[hit].tolist())}:
                found.update((text, int(i)) for i in items[low:high])
        return found

    def contained(self, texts: list[str | None]) -> list[list[tuple[int, float]]]:
        """Of each text the items it contains and their verified containment."""
        found: list[list[tuple[int, float]]] = [[] for _ in texts]
        words, counts = text_words(texts)
        hashes, sizes = shingle_hashes(words, counts)
        ends = np.cumsum(sizes)
        own: tuple[int, np.ndarray, set | None] = (-1, hashes[:0], None)
        for text, item in sorted(self.candidates(hashes, sizes)):
            if own[0] != text:
                own = (text, np.unique(hashes[ends[text] - sizes[text] : ends[text]]), None)
            wanted = self.hashes[item]
            at = np.minimum(np.searchsorted(own[1], wanted), len(own[1]) - 1)
            if (own[1][at] == wanted).mean() < CONTAINED:
                continue
            if own[2] is None:
                own = (*own[:2], shingles(texts[text]))
            share = len(self.shingles[item] & own[2]) / len(self.shingles[item])
            if share >= CONTAINED:
                found[text].append((item, share))
        for text, item in sorted(self.short_candidates(words, counts)):
            (own_words,) = self.shingles[item]
            if own_words in shingles(texts[text], len(own_words)):
                found[text].append((item, 1.0))
        return found


def short(values: np.ndarray) -> np.ndarray:
    return ((values >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.int64)


HITS = "array<struct<item: int, containment: double>>"


def contained_items(texts: list[str], text: Column) -> Column:
    """The items of one block that a text contains, by their numbers in the block."""

    @F.arrow_udf(HITS)
    def hits(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        items = Items(texts)
        kind = pa.list_(pa.struct([("item", pa.int32()), ("containment", pa.float64())]))
        for batch in batches:
            found: list[list[dict]] = []
            for part in runs(batch, 1_000_000):
                for row in items.contained(part.to_pylist()):
                    found.append([{"item": item, "containment": share} for item, share in row])
            yield pa.array(found, kind)

    return hits(text)


def item_blocks(items: DataFrame, item_text: str) -> Iterator[list[str]]:
    """The distinct item texts in blocks of bounded size."""
    texts = items.select(F.col(item_text).alias("item_text")).dropna().distinct()
    count, size = texts.agg(F.count("*"), F.coalesce(F.sum(F.length("item_text")), F.lit(0))).first()
    blocks = max(-(-count // BLOCK_ITEMS), -(-size // BLOCK_CHARACTERS), 1)
    for number in range(blocks):
        block = F.pmod(F.xxhash64("item_text"), F.lit(blocks)) == number
        yield sorted(row[0] for row in texts.filter(block).collect())


def contaminations(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id``, ``item_id``, ``containment`` of every item a document contains.

    ``docs`` has ``doc_id`` and ``text``, ``items`` has ``item_id`` and ``text``.
    Items of one text are searched once and reported each.
    """
    spark = docs.sparkSession
    found = None
    for texts in item_blocks(items, "text"):
        names = spark.createDataFrame(list(enumerate(texts)), "item int, item_text string")
        hits = docs.select("doc_id", F.explode(contained_items(texts, F.col("text"))).alias("hit"))
        part = hits.select("doc_id", "hit.item", "hit.containment").join(names, "item").drop("item")
        found = part if found is None else found.unionByName(part)
    named = items.select("item_id", F.col("text").alias("item_text"))
    return found.join(named, "item_text").select("doc_id", "item_id", "containment")


def uncontaminated(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The documents that contain no item, all columns."""
    for texts in item_blocks(items, "text"):
        docs = docs.filter(F.size(contained_items(texts, F.col(text))) == 0)
    return docs


_WORDS = rf"""regexp_extract_all(regexp_replace(regexp_replace(lower(text),
    '[\x{{2000}}-\x{{206f}}\x{{a0}}-\x{{bf}}\x{{3000}}-\x{{3004}}\x{{3008}}-\x{{3020}}\x{{ff01}}-\x{{ff0f}}\x{{ff1a}}-\x{{ff20}}]', ' ', 'g'), '({UNSPACED})', ' \1 ', 'g'),
    '[0-9a-z\x{{80}}-\x{{10ffff}}]+')"""

ORACLE = rf"""
WITH d AS (SELECT doc_id AS id, row_number() OVER () AS row, {_WORDS} AS w FROM documents),
b AS (SELECT item_id AS id, row_number() OVER () AS row, {_WORDS} AS w FROM benchmark),
sizes AS (SELECT DISTINCT least(len(w), {SHINGLE}) AS k FROM b WHERE len(w) > 0),
ds AS (SELECT DISTINCT id, row, k, array_to_string(w[i:i + k - 1], ' ') AS g
       FROM (SELECT id, row, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes)),
bs AS (SELECT DISTINCT id, row, k, array_to_string(w[i:i + k - 1], ' ') AS g
       FROM (SELECT id, row, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM b JOIN sizes ON k = least(len(w), {SHINGLE}))),
size AS (SELECT row, count(*) AS n FROM bs GROUP BY row),
met AS (SELECT ds.id AS doc_id, ds.row AS doc_row, bs.id AS item_id, bs.row AS item_row, count(*) AS n FROM ds JOIN bs USING (k, g) GROUP BY ALL)
SELECT doc_id, item_id, met.n / size.n AS containment
FROM met JOIN size ON size.row = item_row WHERE met.n / size.n >= {CONTAINED}
"""
