"""Writing harvested tables and collections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lavka.functions.text import fn_json_map


def sink_goods_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """The harvested table; maps are kept in parquet and become JSON text in CSV."""
    if fmt == "csv":
        maps = [f.name for f in df.schema.fields if f.dataType.typeName() == "map"]
        df = df.withColumns({name: fn_json_map(F.col(name)) for name in maps})
        df.write.mode("overwrite").option("header", True).csv(path)
    else:
        df.write.mode("overwrite").parquet(path)


def sink_collection(df: DataFrame, name: str, root: str) -> None:
    """A collection as one folder below the root."""
    df.select("id", "content", "embedding").write.mode("overwrite").parquet(f"{root}/{name}")
