"""Tables written to the shared folder and read again, which cuts lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lavka.session import shared_folder


def stored(frame: DataFrame, purpose: str) -> DataFrame:
    spark = frame.sparkSession
    path = shared_folder(spark, purpose)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
