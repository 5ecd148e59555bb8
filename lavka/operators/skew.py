"""Joins on a key of which one value may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lavka.session import stored

ROWS_PER_PART = 100_000


def spread_join(many: DataFrame, few: DataFrame, key: str, how: str = "inner", rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """Join rows of ``many`` with the rows of ``few`` that have the same key, a
    hot key's rows dealt over as many parts as they need.

    Rows are counted per key first, each task adding up its own. A key of more
    rows than ``rows_per_part`` gets parts, its rows in turn, whatever they hold, so that equal rows
    part too; its rows in ``few`` get a copy for each part. The parts are written down before the shuffle, so a
    repeated task deals as the first one did. All other rows are joined as they are.
    """
    counted = many.groupBy(key).agg(F.ceil(F.count("*") / rows_per_part).alias("__parts"))
    hot = stored(counted.filter(F.col(key).isNotNull() & (F.col("__parts") > 1)), "hot-keys")
    if hot.isEmpty():
        return many.join(few, key, how)
    known = F.broadcast(hot)  # at most one row per rows_per_part rows
    turn = F.pmod(F.monotonically_increasing_id(), F.col("__parts")).alias("__part")
    dealt = stored(many.join(known, key).select(*many.columns, turn), "hot-rows")
    every = F.sequence(F.lit(0).cast("bigint"), F.col("__parts") - 1)
    copies = few.join(known, key).withColumn("__part", F.explode(every)).drop("__parts")
    spread = dealt.join(copies, [key, "__part"], how).drop("__part")
    return spread.unionByName(many.join(known, key, "left_anti").join(few, key, how))
