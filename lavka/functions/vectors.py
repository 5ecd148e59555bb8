"""Vector similarity as a Column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def vector_literal(values: list[float]) -> Column:
    return F.expr("array(" + ", ".join(f"{float(x)!r}D" for x in values) + ")")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def cosine_score(a: Column, b: Column, digits: int = 6) -> Column:
    """Cosine similarity, rounded before any ranking so that the order of the
    summation cannot turn ranks; null where a vector has no length."""
    return F.round(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), digits)
