"""Merkle manifest of a dataset by time-forward processing.

Every row is a leaf; the leaves of a tree stand in the order of their key. A
node's label is its level and its place in the level, so children come before
their parents in the order of labels, which is the order of time. Processing in
that order, a node sends its digest forward to its parent through a priority
queue by label; a node is due once all messages with its label lie in front.

The queue is an external one. Levels are dealt into slabs of ``SLAB`` levels,
and the nodes of a slab that share a parent above it form a block. Messages that
stay inside a block go through a queue in the memory of one task, at most
2^``SLAB`` of them at a time; those due in a later slab are written to the shared
folder and dealt by Spark to the blocks that wait for them. A block is known by
its tree and number, so a tree that holds most of the rows is spread like any
other, and each slab is 2^``SLAB`` times smaller than the one before.

The reversed sweep runs through the same slabs in falling order of labels: a
node receives the siblings on the way from itself to the root, its proof's
suffix, and delivers it to each child with the child's own sibling in front.
"""

from __future__ import annotations

from hashlib import sha256
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lavka.llm.stored import stored

#: Levels that one task climbs at a time.
SLAB = 10


def row_digest(*fields: Column) -> Column:
    """Hexadecimal SHA-256 of the fields' texts, each behind its number of bytes; null is ``-``."""
    texts = [f.cast("string") for f in fields]
    coded = [F.concat(F.octet_length(t).cast("string"), F.lit(":"), t) for t in texts]
    return F.sha2(F.concat(*[F.coalesce(c, F.lit("-")) for c in coded]), 256)


def joined_digest(parts: list[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def numbered(rows: DataFrame) -> DataFrame:
    """The rows (``tree``, ``key``, ``digest``, ``row``) with their ``place`` in
    their tree and the tree's ``size``.

    Rows are sorted by ranges over all trees at once. Only the counts per range
    and tree are added up by tree, and those are at most as many as ranges. Rows
    equal in all of tree, key and digest are told apart by a number written
    beforehand, so that a repeated task sees the same order.
    """
    fixed = stored(rows.withColumn("nth", F.monotonically_increasing_id()), "merkle-rows")
    order = ["tree", "key", "digest", "nth"]
    ranged = fixed.repartitionByRange(*order).sortWithinPartitions(*order).drop("key", "nth")
    ranged = ranged.withColumn("part", F.spark_partition_id()).withColumn("spot", F.monotonically_increasing_id())
    ranged = stored(ranged, "merkle-order")
    runs = ranged.groupBy("part", F.col("tree").alias("own")).agg(F.min("spot").alias("first"), F.count("*").alias("held"))
    tree = Window.partitionBy("own")
    before = F.sum("held").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    shift = (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift")
    runs = stored(runs.select(F.col("part").alias("run"), "own", shift, F.sum("held").over(tree).alias("size")), "merkle-runs")
    placed = ranged.join(runs, (F.col("part") == F.col("run")) & F.col("tree").eqNullSafe(F.col("own")))
    return stored(placed.select("tree", (F.col("spot") + F.col("shift")).alias("place"), "size", "digest", "row"), "merkle-leaves")


def height(size: int) -> int:
    """Levels above the leaves of a tree with so many of them."""
    return (size - 1).bit_length()


def block_levels(digests: list[str], size: int, slab: int) -> list[list[str]]:
    """The digests of a block's nodes by level, sent forward from label to label."""
    top = min(slab, height(size))
    levels = [digests] + [[] for _ in range(top)]
    queue = [(1, at >> 1, at, digest) for at, digest in enumerate(digests)]  # in order, hence a heap
    while queue[0][0] <= top:
        level, number = queue[0][:2]
        children = []
        while queue and queue[0][:2] == (level, number):
            children.append(heappop(queue)[3])
        levels[level].append(joined_digest(children))
        heappush(queue, (level + 1, number >> 1, number, levels[level][-1]))
    return levels


def block_proofs(levels: list[list[str]], suffix: list[str | None]) -> list[list[str | None]]:
    """Per node of the lowest level its siblings up to the root, the lowest first; null
    where a node has none. Delivered in falling order of labels."""
    found = [[]] * len(levels[0])
    queue = [(1 - len(levels), 0, suffix)]
    while queue:
        level, number, siblings = heappop(queue)
        if level == 0:
            found[number] = siblings
            continue
        below = levels[-level - 1]
        for child in (2 * number, 2 * number + 1):
            if child < len(below):
                other = child ^ 1
                own = below[other] if other < len(below) else None
                heappush(queue, (level + 1, child, [own, *siblings]))
    return found


def by_place(nodes: pa.Table) -> pa.Table:
    return nodes.sort_by("place").combine_chunks()


def block_top(nodes: pa.Table, slab: int) -> pa.Table:
    """The one node of the next slab that a block's nodes lead to."""
    nodes = by_place(nodes)
    size = nodes["size"][0].as_py()
    top = block_levels(nodes["digest"].to_pylist(), size, slab)[-1]
    return pa.table(
        {
            "tree": nodes["tree"].slice(0, 1),
            "place": pa.array([nodes["place"][0].as_py() >> slab], pa.int64()),
            "size": pa.array([-(-size >> slab)], pa.int64()),
            "digest": pa.array(top, pa.string()),
        }
    )


def told_nodes(nodes: pa.Table, messages: pa.Table, slab: int) -> pa.Table:
    """The nodes of a block with their siblings up to the root and what all of the tree are told."""
    nodes = by_place(nodes)
    levels = block_levels(nodes["digest"].to_pylist(), nodes["size"][0].as_py(), slab)
    proofs = block_proofs(levels, messages["siblings"][0].as_py())
    told = messages["told"].combine_chunks().take(pa.array([0] * len(nodes), pa.int64()))
    nodes = nodes.drop_columns("block")
    return nodes.append_column("siblings", pa.array(proofs, pa.list_(pa.string()))).append_column("told", told)


def in_blocks(nodes: DataFrame, slab: int):
    return nodes.withColumn("block", F.shiftright("place", slab)).groupBy("tree", "block")


def climbed(leaves: DataFrame, slab: int) -> list[DataFrame]:
    """The nodes at the foot of every slab, at last one node for each tree."""
    slabs = [leaves]
    while len(slabs) == 1 or (slabs[-1].agg(F.max("size")).first()[0] or 0) > 1:
        nodes = slabs[-1].select("tree", "place", "size", "digest")
        top = in_blocks(nodes, slab).applyInArrow(lambda block: block_top(block, slab), "tree string, place bigint, size bigint, digest string")
        slabs.append(stored(top, "merkle-slab"))
    return slabs


def delivered(slabs: list[DataFrame], messages: DataFrame, slab: int) -> DataFrame:
    """The leaves with their ``siblings`` up to the root, and ``told`` as it came with the messages to the tops."""
    told = messages.schema["told"].dataType.simpleString()
    for foot in reversed(slabs[:-1]):
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in foot.schema)
        both = in_blocks(foot, slab).cogroup(messages.groupBy("tree", "block"))
        nodes = both.applyInArrow(lambda own, told_: told_nodes(own, told_, slab), f"{schema}, siblings array<string>, told {told}")
        if foot is not slabs[0]:
            messages = stored(nodes.select("tree", F.col("place").alias("block"), "siblings", "told"), "merkle-suffixes")
    return nodes


def manifest(rows: DataFrame, tree: Column, key: Column, leaf: Column, slab: int = SLAB) -> DataFrame:
    """The Merkle tree over all rows, with every leaf's proof.

    The leaves of one value of ``tree`` ascend by ``key`` (null first) and then by ``leaf``; two
    consecutive nodes, at the end one, become the digest of their joined digests, until one remains, the
    subroot. The subroots, by ``tree`` (null first, by bytes), lead to the root in the same way.

    Returns ``row`` (a struct of all columns of ``rows``, so that no name can clash), ``leaf``, ``subroot``,
    ``root``, ``siblings`` (by level, the lowest first, null where a node stands alone) and ``sides``, whose bit
    n is 1 where the sibling of level n stands before the node. Null trees form a tree of their own; null leaves
    count as empty texts; repeated rows are leaves each; an empty table has no rows and no root.
    """
    picked = rows.select(
        tree.cast("string").alias("tree"), key.alias("key"), F.coalesce(leaf, F.lit("")).alias("digest"), F.struct("*").alias("row")
    )
    slabs = climbed(numbered(picked), slab)
    tops = slabs[-1].select(F.lit("").alias("tree"), F.col("tree").alias("key"), "digest", F.struct("tree").alias("row"))
    upper = climbed(numbered(tops), slab)
    first = F.lit(0).cast("bigint").alias("block")
    none = F.array().cast("array<string>").alias("siblings")
    start = upper[-1].select("tree", first, none, F.struct(F.col("digest").alias("root")).alias("told"))
    subroots = delivered(upper, start, slab)
    told = F.struct(F.col("digest").alias("subroot"), "told.root", F.col("place").alias("above")).alias("told")
    found = delivered(slabs, subroots.select("row.tree", first, "siblings", told), slab)
    levels = F.when(F.col("size") > 1, F.length(F.bin(F.col("size") - 1))).otherwise(0)
    sides = F.col("place") + F.call_function("shiftleft", F.col("told.above"), levels)
    return found.select("row", F.col("digest").alias("leaf"), "told.subroot", "told.root", "siblings", sides.alias("sides"))


def folded_root(leaf: Column, siblings: Column, sides: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    start = F.struct(leaf.alias("digest"), sides.alias("sides"))

    def step(done: Column, sibling: Column) -> Column:
        other = F.coalesce(sibling, F.lit(""))
        own, before = done["digest"], done["sides"].bitwiseAND(F.lit(1)) == 1
        pair = F.when(before, F.concat(other, own)).otherwise(F.concat(own, other))
        return F.struct(F.sha2(pair, 256).alias("digest"), F.shiftright(done["sides"], 1).alias("sides"))

    return F.aggregate(siblings, start, step)["digest"]
