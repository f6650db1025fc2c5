"""Loading the parquet tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of `sf_dir`; any path that Spark's readers open will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, names=None) -> None:
    """Register temp views of the tables, so that SQL text can name them."""
    for name in names or TABLES:
        load(spark, sf_dir, name).createOrReplaceTempView(name)
