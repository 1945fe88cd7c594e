"""Arrays as rows, evaluated once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exploded(df: DataFrame, *carried: Column | str, **array: Column | str) -> DataFrame:
    """``carried`` and one array, by the name it is given, as a row per element; arrays without null elements.

    Before a plain explode Spark puts a filter by the array's size, which evaluates the array, and all Python functions in it, a
    second time.
    """
    ((name, values),) = array.items()
    return df.select(*carried, F.explode_outer(values).alias(name)).where(F.col(name).isNotNull())
