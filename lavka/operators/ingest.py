"""Loading goods with an error budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the loading rule.
BATCH_SIZE, MAX_ERRORS = 30, 5


# What becomes of a row.
ACCEPTED, BAD, NOT_LOADED = "accepted", "bad", "not_loaded"


def loading_state(
    df: DataFrame, is_bad: Column, batch_size: int = BATCH_SIZE, max_errors: int = MAX_ERRORS
) -> DataFrame:
    """All rows with ``state``, when (pos, ...) is loaded in batches by position
    and loading stops once more than ``max_errors`` errors lie in the batches so
    far: accepted, bad in a loaded batch, or behind the stop.

    The batch of bad row number max_errors + 1 is the last one loaded, so its
    position is all that is needed: a sort with limit over the bad rows gives
    it, and no running sum over all batches takes place.
    """
    bad = F.coalesce(is_bad, F.lit(False))
    first = df.filter(bad).select("pos").orderBy("pos").limit(max_errors + 1)
    stop = first.agg(F.when(F.count("*") > max_errors, F.max("pos")).alias("stop")).scalar()
    loaded = F.coalesce(F.floor(F.col("pos") / batch_size) <= F.floor(stop / batch_size), F.lit(True))
    return df.withColumn("state", F.when(~loaded, NOT_LOADED).when(bad, BAD).otherwise(ACCEPTED))


def ingest_error_budget(
    df: DataFrame, is_bad: Column, batch_size: int = BATCH_SIZE, max_errors: int = MAX_ERRORS
) -> DataFrame:
    """The rows accepted; see ``loading_state``."""
    states = loading_state(df, is_bad, batch_size, max_errors)
    return states.filter(F.col("state") == ACCEPTED).drop("state")


def failed_rows_report(
    df: DataFrame, is_bad: Column, batch_size: int = BATCH_SIZE, max_errors: int = MAX_ERRORS
) -> DataFrame:
    """Number of bad rows in the batches loaded and the first of them by position."""
    shown = F.struct(*[c for c in df.columns])
    failed = loading_state(df, is_bad, batch_size, max_errors).filter(F.col("state") == BAD)
    report = failed.agg(F.count("*").alias("failed"), F.min_by(shown, "pos").alias("first"))
    return report.select("failed", *[F.col(f"first.{c}").alias(f"first_{c}") for c in df.columns])
