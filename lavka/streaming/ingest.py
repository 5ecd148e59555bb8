"""Incremental loading of goods that arrive in portions, with state across them."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from lavka.operators.goods import goods_chunk_text
from lavka.operators.ingest import ACCEPTED, BAD, BATCH_SIZE, MAX_ERRORS, NOT_LOADED, loading_state

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Positions of a source that share one state; a source of any size has many.
PAGE = 1024
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ROWS = "source string, pos bigint, content string, corrected boolean"
STATES = "source string, pos bigint, content string, state string"
ERRORS = "source string, positions array<bigint>"


def latest_per_id(batch: DataFrame) -> DataFrame:
    """One row per ``pos`` of a batch; equal ones fold inside each task. Among
    different rows of one position the greatest wins, whatever the row order."""
    row = F.struct(*[c for c in batch.columns if c != "pos"])
    return batch.groupBy("pos").agg(F.max(row).alias("row")).select("pos", "row.*")


def load_batch(batch: DataFrame) -> DataFrame:
    """The batch job on one table: dedupe, build chunks, and say of
    every row whether it is accepted, bad, or behind the stop."""
    chunks = goods_chunk_text(latest_per_id(batch))
    return loading_state(chunks, F.col("content").isNull()).select("pos", "content", "state")


class FirstSeen(StatefulProcessor):
    """Lets a position of a source through once, and corrections of positions that came before.

    The state of a page of positions is one value that holds those that came, so a portion reads and writes
    it once, however many rows it has of the page. Of several rows of one position in a portion the greatest goes on.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "positions binary")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timers) -> Iterator[Row]:
        best = {}
        for row in rows:
            place, rank = (row.pos, row.corrected), (row.content is not None, row.content or "")
            if place not in best or rank > best[place][0]:
                best[place] = rank, row
        held = self.seen.get()
        known = set(np.frombuffer(held[0], np.int64).tolist()) if held else set()
        passed = [row for (pos, _), (_, row) in sorted(best.items()) if row.corrected == (pos in known)]
        new = [row.pos for row in passed if not row.corrected]
        if new:
            self.seen.update((np.array(sorted(known.union(new)), np.int64).tobytes(),))
        for row in passed:
            yield Row(source=row.source, pos=row.pos, content=row.content, corrected=row.corrected)

    def close(self) -> None:
        pass


@contextmanager
def rocks_db(spark: SparkSession):
    """The state store that stateful processors need, set while a stream starts; a stream keeps its own copy."""
    old = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKS_DB)
    try:
        yield
    finally:
        spark.conf.set(STATE_STORE, old)


def arrivals(stream_df: DataFrame, corrected: bool) -> DataFrame:
    """Rows of either input; a stream without ``source`` is one source. Without a position none can be loaded."""
    source = F.col("source") if "source" in stream_df.columns else F.lit("")
    rows = goods_chunk_text(stream_df.withColumn("source", F.coalesce(source, F.lit(""))).filter("pos is not null"))
    return rows.select("source", F.col("pos").cast("bigint").alias("pos"), "content", F.lit(corrected).alias("corrected"))


def load_portion(batch: DataFrame, portion: int, out: str, batch_size: int = BATCH_SIZE, max_errors: int = MAX_ERRORS) -> None:
    """State of every row of a portion, by the budget of its source over all portions so far.

    What goes on from portion to portion is a handful of positions for each source. A corrected row
    is loaded or bad by itself; one of a position that is accepted already changes nothing.
    """
    spark = batch.sparkSession
    batch = batch.persist()
    first, again = batch.filter("not corrected").drop("corrected"), batch.filter("corrected").drop("corrected")
    bad = first.filter("content is null").select("source", "pos")
    if portion:  # the errors of all portions before are with the last one's
        before = spark.read.schema(ERRORS).parquet(f"{out}/errors/portion={portion - 1}")
        bad = bad.unionByName(before.select("source", F.explode("positions").alias("pos")))
    order = Window.partitionBy("source").orderBy("pos")
    kept = bad.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= max_errors + 1)
    errors = kept.groupBy("source").agg(F.array_sort(F.collect_list("pos")).alias("positions"))
    errors.write.mode("overwrite").parquet(f"{out}/errors/portion={portion}")
    errors = spark.read.schema(ERRORS).parquet(f"{out}/errors/portion={portion}")

    stop = F.when(F.size("positions") > max_errors, F.floor(F.element_at("positions", max_errors + 1) / batch_size))
    states = first.join(errors.select("source", stop.alias("stop")), "source", "left")
    loaded = F.coalesce(F.floor(F.col("pos") / batch_size) <= F.col("stop"), F.lit(True))
    state = F.when(~loaded, NOT_LOADED).when(F.col("content").isNull(), BAD).otherwise(ACCEPTED)
    states = states.select("source", "pos", "content", state.alias("state"))
    if portion and not again.isEmpty():
        earlier = spark.read.schema(f"{STATES}, portion int").parquet(f"{out}/rows")
        accepted = earlier.filter((F.col("state") == ACCEPTED) & (F.col("portion") < portion))
        again = again.join(accepted.select("source", "pos"), ["source", "pos"], "left_anti")
        state = F.when(F.col("content").isNull(), BAD).otherwise(ACCEPTED)
        states = states.unionByName(again.select("source", "pos", "content", state.alias("state")))
    states.write.mode("overwrite").parquet(f"{out}/rows/portion={portion}")
    batch.unpersist()


def ingest_stream(stream_df: DataFrame, out: str, checkpoint: str, corrections: DataFrame | None = None) -> StreamingQuery:
    """Load every portion that has arrived and stop.

    Portions of a source come in the order of its positions; the error budget runs on over all of
    them, as it would over one table. A position that comes again changes nothing, whether its portion is repeated
    by the sender or by a restart, which overwrites its own folder. Every row is kept with its
    state below ``out``; those not accepted can come back by ``corrections``, a second stream of the same
    columns. ``loaded_rows`` reads the result.
    """
    rows = arrivals(stream_df, False)
    if corrections is not None:
        rows = rows.unionByName(arrivals(corrections, True))
    rows = rows.withColumn("page", F.floor(F.col("pos") / PAGE))
    spark = stream_df.sparkSession
    with rocks_db(spark):
        seen = rows.groupBy("source", "page").transformWithState(FirstSeen(), ROWS, "Append", "None")
        stream = seen.writeStream.foreachBatch(lambda batch, portion: load_portion(batch, portion, out))
        return stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def loaded_rows(spark: SparkSession, out: str) -> DataFrame:
    """(source, pos, content, state) with one row per position: what it came to at last."""
    rows = spark.read.schema(f"{STATES}, portion int").parquet(f"{out}/rows")
    last = F.max_by(F.struct("content", "state"), "portion").alias("last")
    return rows.groupBy("source", "pos").agg(last).select("source", "pos", "last.content", "last.state")
