"""Near duplicates by SimHash fingerprints, found by meet-in-the-middle balls.

Two fingerprints of 64 bits link at three or fewer differing bits. Every
fingerprint emits the variants of itself within half that radius, variants are
shuffled, and fingerprints that meet in one variant are candidates.

Odd radius: by parity. A pair at distance 2 meets in the point between, one
flip from both. A pair at distance 1 or 3 has one fingerprint of even and one
of odd parity; it meets where the even one has one flip and the odd one two or
none. So all emit single flips, and only those of odd parity emit double ones.
In a variant of odd parity any even fingerprint links to all others that meet
there, in a variant of even parity every fingerprint does: one hub and its
verified links replace all pairs of a group, however large it is.

Few fingerprints have any neighbour, so a narrower ball is tried first: of three
parts of the bits, a linked pair differs in at most two bits outside one of
them, hence meets within one flip of the two parts kept. Only fingerprints that
meet another one there emit their whole ball; no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lavka.llm.components import component_roots
from lavka.llm.stored import stored

BITS = 64
RADIUS = 3
SHINGLE = 3
SEED = 42
#: So many shingles are counted at a time.
BLOCK = 65_536
PARTS = (range(0, 21), range(21, 42), range(42, 64))


def text_fingerprint(text: str | None) -> int:
    """The fingerprint of one text, unsigned; zero if it has no word."""
    words = (text or "").encode("utf-8").lower().split()  # splits at ASCII white space only
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    firsts, lasts = starts[: 1 - SHINGLE].tolist(), ends[SHINGLE - 1 :].tolist()
    total, digest = np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(firsts), BLOCK):
        spans = zip(firsts[at : at + BLOCK], lasts[at : at + BLOCK])
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], np.dtype("<u8"))
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    majority = np.packbits(total * 2 > len(firsts), bitorder="little")
    return int(majority.view(np.dtype("<u8"))[0])


def fingerprint(text: Column) -> Column:
    """The fingerprint as a signed long; null and texts without words have zero."""

    @F.arrow_udf("long")
    def prints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = [text_fingerprint(t) for t in batch.to_pylist()]
            yield pa.array(np.array(found, np.uint64).view(np.int64))

    return prints(text)


def hexadecimal(print_: Column) -> Column:
    return F.lower(F.lpad(F.hex(print_), 16, "0"))


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def flip_masks(flips: list[tuple[int, ...]]) -> Column:
    """A constant array with one mask for each group of bits."""
    masks = (" | ".join(f"shiftleft(1L, {bit})" for bit in bits) or "0L" for bits in flips)
    return F.expr(f"array({', '.join(masks)})")


def neighbours_likely(nodes: DataFrame) -> DataFrame:
    """The fingerprints that meet another one outside some part of the bits."""
    kept = []
    for number, part in enumerate(PARTS):
        mask = sum(1 << bit for bit in range(BITS) if bit not in part)
        flips = [(), *((bit,) for bit in range(BITS) if bit not in part)]
        variant = F.explode(flip_masks(flips)).alias("flip")
        masked = F.col("fp").bitwiseAND(F.lit(signed(mask)))
        met = nodes.select("fp", masked.alias("rest"), variant)
        key = F.col("rest").bitwiseXOR(F.col("flip")).alias("variant")
        kept.append(met.select("fp", key, F.lit(number).alias("part")))
    met = kept[0].union(kept[1]).union(kept[2])
    group = Window.partitionBy("part", "variant")
    spread = met.select("fp", F.min("fp").over(group).alias("low"), F.max("fp").over(group).alias("high"))
    return spread.filter("low <> high").select("fp").distinct()


def ball_links(nodes: DataFrame) -> DataFrame:
    """Verified links ``a``, ``b`` that connect all fingerprints within the radius."""
    single = [(), *((bit,) for bit in range(BITS))]
    double = list(combinations(range(BITS), 2))
    odd = F.bit_count("fp") % 2 == 1
    near = nodes.select("fp", F.explode(flip_masks(single)).alias("flip"))
    far = nodes.filter(odd).select("fp", F.explode(flip_masks(double)).alias("flip"))
    met = near.union(far).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("variant"))
    even_point = F.bit_count("variant") % 2 == 0
    may_be_hub = even_point | ~odd | (F.col("fp") == F.col("variant"))
    rank = F.when(may_be_hub, F.struct(F.when(even_point | ~odd, 0).otherwise(1).alias("first"), "fp"))
    hub = F.min(rank).over(Window.partitionBy("variant"))["fp"]
    linked = met.select(F.col("fp").alias("a"), hub.alias("b")).filter("a <> b").distinct()
    return linked.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)


def near_duplicate_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The fingerprint of every row, and the class of every fingerprint.

    First ``doc_id``, ``fp``; second ``fp``, ``root`` (one fingerprint of the
    class) and ``component_id``, the smallest id in the class. Rows without an
    id are linked like others but give no class its name, so that a class of
    such rows only has a null name.
    """
    prints = docs.select(F.col(doc_id).alias("doc_id"), fingerprint(F.col(text)).alias("fp"))
    prints = stored(prints, "fingerprints")
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    likely = stored(neighbours_likely(nodes.select("fp")), "likely")
    roots = component_roots(ball_links(likely))
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    named = stored(named.select("fp", "first", F.coalesce("root", "fp").alias("root")), "roots")
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    smallest = stored(smallest, "smallest")
    return prints, stored(named.join(smallest, "root").select("fp", "root", "component_id"), "classes")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's ``doc_id``, ``fingerprint`` and ``component_id``."""
    prints, classes = near_duplicate_classes(docs, doc_id, text)
    found = prints.join(classes, "fp")
    return found.select("doc_id", hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def one_of_each_class(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class, all columns: that of smallest id, among equal ids that of smallest
    text hash. Of a class without any id one row stays in the same way.

    The row is chosen by class, so an id that stands in several classes keeps a row in each. Rows
    whose id is the only one of its kind are taken by their id; only rows with a repeated id or none need their
    fingerprint again. Rows travel as one struct beside their id, so no column's name can clash; of a
    class each task passes on its own first row only.
    """
    prints, classes = near_duplicate_classes(docs, doc_id, text)
    names = classes.select(F.col("component_id").alias("key")).distinct()
    times = prints.groupBy(F.col("doc_id").alias("key")).agg((F.count("*") > 1).alias("several"))
    same = F.col("key").eqNullSafe(F.col("own"))
    chosen = names.join(times.withColumnRenamed("key", "own"), same).select("key", (F.col("several") | F.col("key").isNull()).alias("several"))
    chosen = stored(chosen, "chosen")
    ids = chosen.filter("not several").select(F.col("key").alias(doc_id)).hint("merge")  # one plan at every size
    single = docs.join(ids, doc_id, "left_semi").select(docs.columns)
    several = stored(chosen.filter("several"), "several")  # written by itself, so that its size is known
    if several.isEmpty():
        return single
    whole = docs.select(F.struct("*").alias("row"), F.col(doc_id).alias("own"))
    others = whole.join(several, same, "left_semi").withColumn("fp", fingerprint(F.col(f"row.`{text}`")))
    placed = others.join(classes, "fp").filter(F.col("own").eqNullSafe(F.col("component_id")))
    order = Window.partitionBy("root").orderBy(F.xxhash64(f"row.`{text}`"), F.col("fp"))
    first = placed.withColumn("nth", F.row_number().over(order)).filter("nth = 1")
    return single.unionByName(first.select("row.*"))
