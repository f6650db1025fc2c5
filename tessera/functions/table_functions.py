"""Table functions and registration of user functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def numbers(spark: SparkSession, n: int) -> DataFrame:
    """0 .. n-1 as a column `number`."""
    return spark.range(n).select(F.col("id").cast("int").alias("number"))


def register_scalar(spark: SparkSession, name: str, f: Callable, returns: str, vectorised: bool = True) -> None:
    """A scalar user function for SQL; vectorised ones get and give pandas series."""
    spark.udf.register(name, F.pandas_udf(f, returns) if vectorised else F.udf(f, returns))


def register_table(spark: SparkSession, name: str, handler: type, returns: str) -> None:
    """A table function: a class whose `eval` yields tuples."""
    spark.udtf.register(name, F.udtf(handler, returnType=returns))
