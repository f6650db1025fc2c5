"""Quantified comparisons as semi and anti joins."""

from __future__ import annotations

import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPERATORS = {"=": operator.eq, "<>": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def where_any(df: DataFrame, left: Column, op: str, inner: DataFrame) -> DataFrame:
    """Rows for which `left op v` is true for some v of the one-column `inner`."""
    values = inner.toDF("__v")
    if op in ("<", "<=", ">", ">="):
        # One row, whatever the size of inner: the easiest value to beat.
        values = values.agg((F.max if op[0] == "<" else F.min)("__v").alias("__v"))
    return df.join(values, OPERATORS[op](left, F.col("__v")), "left_semi")


def where_all(df: DataFrame, left: Column, op: str, inner: DataFrame) -> DataFrame:
    """Rows for which `left op v` is true for every v of `inner`; all, if it is empty."""
    values = inner.toDF("__v")
    if op in ("<", "<=", ">", ">="):
        # The hardest value decides, and a null leaves every row unknown.
        hardest = (F.min if op[0] == "<" else F.max)("__v")
        values = values.agg(F.count("*").alias("__n"), F.count("__v").alias("__m"), hardest.alias("__v")).where("__n > 0")
        failing = (F.col("__n") > F.col("__m")) | ~F.coalesce(OPERATORS[op](left, F.col("__v")), F.lit(False))
    else:
        failing = ~F.coalesce(OPERATORS[op](left, F.col("__v")), F.lit(False))
    return df.join(values, failing, "left_anti")
