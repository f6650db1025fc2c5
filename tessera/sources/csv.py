"""COPY between tables and delimited files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def _options(delimiter: str, quote: str, escape: str, header: bool) -> dict[str, str]:
    return {"sep": delimiter, "quote": quote, "escape": escape, "header": str(header).lower(), "nullValue": "null", "timestampFormat": "yyyy-MM-dd HH:mm:ss"}


def copy_from(spark: SparkSession, path: str, schema: T.StructType | str, delimiter: str = ",", quote: str = '"', escape: str = "\\", header: bool = False) -> DataFrame:
    """Rows of the file or folder, strictly of `schema`; one empty field too many at
    a line's end is let pass. A broken line is an error."""
    kinds = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    loose = T.StructType([*kinds.fields, T.StructField("__rest", T.StringType())])
    options = _options(delimiter, quote, escape, header)
    first = spark.read.text(path).limit(2 if header else 1).collect()
    if first and first[-1][0].endswith(delimiter):
        return spark.read.schema(loose).options(**options, enforceSchema="true", mode="FAILFAST").csv(path).drop("__rest")
    return spark.read.schema(kinds).options(**options, mode="FAILFAST").csv(path)


def copy_to(rows: DataFrame, path: str, delimiter: str = ",", quote: str = '"', escape: str = "\\", header: bool = False, single_file: bool = True) -> int:
    """Write `rows` to the one file `path`, null as the text null, and return how many
    they are. `single_file=False` writes the partitions as they are, below `path`."""
    spark = rows.sparkSession
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    aside = f"{path}.parts-{uuid.uuid4().hex}" if single_file else path
    (rows.coalesce(1) if single_file else rows).write.mode("overwrite").options(**_options(delimiter, quote, escape, header)).csv(aside)
    if single_file:
        part = next((s.getPath() for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(aside)) if s.getPath().getName().startswith("part-")), None)
        fs.delete(target, True)
        if part is None:
            fs.create(target).close()
        else:
            fs.rename(part, target)
        fs.delete(jvm.org.apache.hadoop.fs.Path(aside), True)
    # What was written is counted, not made again.
    return spark.read.schema(rows.schema).options(**_options(delimiter, quote, escape, header)).csv(path).count()
