"""Fill-in-the-middle examples, cut between tokens found by memoized chunks.

A text is cut into chunks where a rolling hash of its last bytes meets a mask,
so equal passages are cut into equal chunks wherever they stand. Each distinct
chunk is summed up once: its tokens, its characters, and whether its first and
last byte are letters. A cache holds the sums by the chunk's content; a look-up
compares the content itself, so chunks of equal hash are never mixed up. A run of
letters that crosses a border counts in both chunks, which their border
letters tell, so adding up the chunks gives the text's tokens; the chunk that
holds a cut is found in the running sums, and only that chunk is searched.

Tokens are runs of ASCII letters and any other single character. Work, cache and
memory are a task's own and bounded by a text's length and ``CACHE_BYTES``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The rolling hash spans so many bytes (a power of two); a chunk ends where so many of the
#: hash's bits are zero, on average after 2^``MASK_BITS`` bytes, and after ``LONGEST`` in any case.
SPAN = 16
MASK_BITS = 8
LONGEST = 4096
#: Bytes of chunks that a cache holds; a full one starts anew, which costs time but no result.
CACHE_BYTES = 16 << 20
#: Bytes hashed at a time.
BLOCK = 1 << 20

#: Marks of the three parts, and the shares of the forms.
MARKS = ("<P>", "<S>", "<M>")
PLAIN_FROM = 90
SPM_BELOW = 20

LETTERS = re.compile(rb"[A-Za-z]+")
NOT_COUNTED = bytes(b for b in range(256) if 0x80 <= b < 0xC0 or chr(b).isalpha() and b < 0x80)
INNER = bytes(range(0x80, 0xC0))
IS_LETTER = np.array([b < 0x80 and chr(b).isalpha() for b in range(256)])
BEGINS = np.array([not 0x80 <= b < 0xC0 for b in range(256)])


def byte_hashes() -> np.ndarray:
    """One odd-looking number for each byte, by multiplication with the golden ratio's bits."""
    mixed = np.arange(1, 257, dtype=np.uint32) * np.uint32(2654435769)
    return mixed ^ (mixed >> np.uint32(15))


HASHES = byte_hashes()


def chunk_ends(text: bytes) -> list[int]:
    """Where the chunks of a text end, the last at its end.

    The hash of a place is the sum of the last bytes' numbers, each shifted by its distance;
    it is built by doubling the span, so it takes a few passes whatever the span.
    """
    found = []
    for start in range(0, len(text), BLOCK):
        first = max(0, start - SPAN + 1)
        hashes = HASHES[np.frombuffer(text, np.uint8, min(start + BLOCK, len(text)) - first, first)]
        width = 1
        while width < SPAN:
            hashes[width:] += hashes[:-width] << np.uint32(width)
            width *= 2
        low = (hashes[start - first :] >> np.uint32(SPAN)) & np.uint32((1 << MASK_BITS) - 1)  # bits that all bytes of the span reach
        hits = np.flatnonzero(low == 0)
        found.extend((hits + start + 1).tolist())
    ends, last = [], 0
    for end in [*found, len(text)]:
        ends.extend(range(last + LONGEST, end, LONGEST))
        if end > last:
            ends.append(end)
        last = end
    return ends


class ChunkCache:
    """Sums of chunks, kept by content."""

    def __init__(self, most: int = CACHE_BYTES):
        self.most, self.held, self.sums = most, 0, {}
        self.asked = self.counted = 0

    def sum_of(self, chunk: bytes) -> tuple[int, int, bool, bool]:
        """Tokens and characters that begin in the chunk, and whether it begins and ends with a letter."""
        self.asked += 1
        known = self.sums.get(chunk)
        if known is None:
            self.counted += 1
            others = len(chunk.translate(None, NOT_COUNTED))
            tokens = len(LETTERS.findall(chunk)) + others
            characters = len(chunk.translate(None, INNER))
            known = tokens, characters, bool(IS_LETTER[chunk[0]]), bool(IS_LETTER[chunk[-1]])
            if self.held + len(chunk) > self.most:
                self.sums, self.held = {}, 0
            self.sums[chunk] = known
            self.held += len(chunk)
        return known


class TokenIndex:
    """A text's tokens by chunk."""

    def __init__(self, text: bytes, cache: ChunkCache):
        self.text, self.ends = text, chunk_ends(text)
        self.starts = [0, *self.ends[:-1]] if self.ends else []
        tokens, characters, after_letter = [0], [0], False
        for start, end in zip(self.starts, self.ends):
            own, length, first, last = cache.sum_of(text[start:end])
            tokens.append(tokens[-1] + own - (after_letter and first))
            characters.append(characters[-1] + length)
            after_letter = last
        self.tokens, self.characters = np.array(tokens), characters
        self.n = tokens[-1]

    def characters_before(self, token: int) -> int:
        """How many characters stand before the token of this number; behind the last, all."""
        if token >= self.n:
            return self.characters[-1]
        at = int(np.searchsorted(self.tokens, token, "right")) - 1
        start, end = self.starts[at], self.ends[at]
        codes = np.frombuffer(self.text, np.uint8, end - start, start)
        letter = IS_LETTER[codes]
        before = np.concatenate(([start > 0 and IS_LETTER[self.text[start - 1]]], letter[:-1]))
        begins = BEGINS[codes]
        place = np.flatnonzero(np.where(letter, ~before, begins))[token - self.tokens[at]]
        return self.characters[at] + int(begins[:place].sum())


def token_cuts(text: Column, first: Column, second: Column) -> Column:
    """``n`` (tokens of the text) and the characters before two cuts, ``start`` and ``end``.

    A cut lies behind as many tokens as its number's remainder by n + 1; the lesser comes first. Null is
    an empty text.
    """

    @F.arrow_udf("n bigint, start bigint, end bigint")
    def cuts(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        cache = ChunkCache()
        for texts, a, b in batches:
            found = []
            for text, x, y in zip(texts, a.to_pylist(), b.to_pylist()):
                index = TokenIndex(text.as_py() or b"", cache)
                x, y = sorted((x % (index.n + 1), y % (index.n + 1)))
                found.append((index.n, index.characters_before(x), index.characters_before(y)))
            columns = np.array(found, np.int64).reshape(-1, 3).T
            yield pa.StructArray.from_arrays([pa.array(c) for c in columns], ["n", "start", "end"])

    return cuts(text.cast("binary"), first, second)


def draws(doc_id: Column, seed: int = 1) -> list[Column]:
    """Four numbers of 32 bits from a row's id; null ids draw as an empty text does."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * n + 1, 8), 16, 10).cast("bigint") for n in range(4)]


def fill_in_middle(text: Column, drawn: list[Column]) -> Column:
    """A struct of ``n``, ``form`` (plain, psm or spm), ``prefix``, ``middle``, ``suffix`` (null where plain) and ``output``.

    The first two numbers drawn cut the text, the third tells plain from cut ones and the fourth the
    order of the parts. Empty texts, null ones and those that hold a mark are plain. The same numbers give the same
    cuts, so repeated rows come out alike. A text of any length is cut as a whole; it is passed on as it
    is, so no other column takes part.
    """
    text = F.coalesce(text, F.lit(""))
    marked = F.lit(False)
    for mark in MARKS:
        marked = marked | text.contains(mark)
    plain = (text == "") | marked | (drawn[2] % 100 >= PLAIN_FROM)
    form = F.when(plain, "plain").when(drawn[3] % 100 < SPM_BELOW, "spm").otherwise("psm")
    found = F.struct(text.alias("text"), form.alias("form"), token_cuts(text, drawn[0], drawn[1]).alias("cuts"))

    def shaped(row: Column) -> Column:
        whole, start, end = row["text"], row["cuts"]["start"].cast("int"), row["cuts"]["end"].cast("int")
        parts = {
            "prefix": F.substring(whole, F.lit(1), start),
            "suffix": F.substring(whole, end + 1, F.length(whole)),
            "middle": F.substring(whole, start + 1, end - start),
        }
        cut = row["form"] != "plain"
        marks = dict(zip(parts, map(F.lit, MARKS)))
        order = {"psm": ("prefix", "suffix", "middle"), "spm": ("suffix", "prefix", "middle")}
        joined = {name: F.concat(*[x for part in places for x in (marks[part], parts[part])]) for name, places in order.items()}
        output = F.when(row["form"] == "psm", joined["psm"]).when(row["form"] == "spm", joined["spm"]).otherwise(whole)
        kept = [F.when(cut, parts[name]).alias(name) for name in ("prefix", "middle", "suffix")]
        return F.struct(row["cuts"]["n"].alias("n"), row["form"].alias("form"), *kept, output.alias("output"))

    return F.transform(F.array(found), shaped)[0]  # names the parts once, so that nothing is worked out twice


def restored(output: Column, form: Column) -> Column:
    """The text that an output of this form was made from."""
    parts = F.split(output, "|".join(MARKS), -1)
    part = [F.get(parts, F.lit(n)) for n in range(4)]  # nothing stands before the first mark
    return (
        F.when(form == "psm", F.concat(part[1], part[3], part[2]))
        .when(form == "spm", F.concat(part[2], part[3], part[1]))
        .otherwise(output)
    )
