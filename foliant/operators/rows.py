"""Array elements as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def each(df: DataFrame, columns: list, array: Column | str, position: str, item: str) -> DataFrame:
    """One row per element, with its 0-based ``position``; rows without elements disappear.

    For a plain explode Spark derives the filter ``size(array) > 0`` and pushes it down, which
    computes the array twice. The outer form is spared that, and its filter costs nothing.
    """
    rows = df.select(*columns, F.posexplode_outer(array).alias(position, item))
    return rows.where(F.col(position).isNotNull())
