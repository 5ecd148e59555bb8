"""Bounded samples that no single task has to gather from all others' candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows let through in the mean for each row wanted.
SPARE = 1.3
SEED = 1


def sample_by_key(frame: DataFrame, most: int, key: str) -> DataFrame:
    """At most ``most`` rows, those of smallest key hash among about 1.3 times as
    many; for keys that differ. The hash alone decides who comes near."""
    count = frame.count()
    spread = F.pmod(F.xxhash64(key), F.lit(1 << 30))
    near = frame if count <= most else frame.filter(spread < int(SPARE * most / count * (1 << 30)) + 1)
    return near.orderBy(spread, key).limit(most)


def sample_of_rows(frame: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows by a seeded draw, for rows that may repeat."""
    count = frame.count()
    drawn = frame if count <= most else frame.sample(min(1.0, SPARE * most / count), SEED)
    return drawn.limit(most)
