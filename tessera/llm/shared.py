"""Tables that cut lineage, kept in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, as in tests, a local
    folder, if driver and executors are one machine: on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = current.get() if current.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    there = jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(conf).deleteOnExit(there)
    return path


def remove(spark: SparkSession, path: str) -> None:
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    there = jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(conf).delete(there, True)


def store(df: DataFrame, name: str, **options: str) -> DataFrame:
    """`df` written as Parquet to the shared folder and read back: later stages
    start from files that outlive any executor. `.path` holds where it is."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(compression="zstd", **options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.path = path
    return out


#: Rows at once from Parquet, and to a Python worker. By Spark's own 4,096 and 10,000, texts make the executor's heap and buffers grow by hundreds of MB.
BATCHES = {"spark.sql.parquet.columnarReaderBatchSize": 512, "spark.sql.execution.arrow.maxRecordsPerBatch": 1000}


@contextmanager
def short_batches(spark: SparkSession) -> Iterator[None]:
    """What is run within reads its rows in short batches; the session's settings are as before afterwards."""
    before = {k: spark.conf.get(k) for k in BATCHES}
    try:
        for k, rows in BATCHES.items():
            if not 0 < int(before[k]) < rows:
                spark.conf.set(k, rows)
        yield
    finally:
        for k, rows in before.items():
            spark.conf.set(k, rows)


def fresh(df: DataFrame) -> str:
    """A column name that `df` has not."""
    taken, name = {c.lower() for c in df.columns}, "own"
    while name in taken:
        name += "_"
    return name


def slices(batch: pa.RecordBatch, limit: int, *columns: int, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """`batch` in pieces of at most `limit` bytes, a single longer row excepted, in
    the text or binary `columns`, and of at most `rows` rows."""
    size = np.zeros(batch.num_rows, "i8")
    for k in columns:
        size += pc.fill_null(pc.binary_length(batch.column(k)), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(size), 0
    while at < batch.num_rows:
        to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right"))
        to = min(max(to, at + 1), at + rows)
        yield batch.slice(at, to - at)
        at = to


#: What operators remember in a Python worker, which Spark keeps from task to task.
_REMEMBERED: list[dict] = []


def remembered() -> dict:
    """A dictionary that lives as long as the worker, or until another operator needs the memory."""
    _REMEMBERED.append({})
    return _REMEMBERED[-1]


def forget(but: dict | None = None) -> None:
    """Let go of what other operators remembered in this worker than in `but`."""
    freed = [x for x in _REMEMBERED if x is not but and x]
    for x in freed:
        x.clear()
    if freed:
        pa.default_memory_pool().release_unused()


def partitions_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Edges up to which one task finds the components: some 100 MB of its memory.
LOCAL = 1 << 20


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids among the edges, sorted, and the smallest id reachable from each."""
    ids, at = np.unique(np.r_[a, b], return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while True:
        before = label.copy()
        low = np.minimum(label[i], label[j])
        # The roots of both ends hang on the lesser one.
        np.minimum.at(label, before[i], low)
        np.minimum.at(label, before[j], low)
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        while (label[label] != label).any():
            label = label[label]
        if (label == before).all():
            return ids, ids[label]


def connected_components(edges: DataFrame) -> DataFrame:
    """The stored (id, component) for every id in `edges` (a, b), component the
    smallest id reachable, itself included.

    Up to LOCAL edges, one task does it. For more, alternating large-star and
    small-star rounds: every vertex hangs its larger neighbours, then its smaller
    ones, on the smallest vertex that it knows of, until no edge changes. Each
    half is a grouped minimum, which partial aggregation shrinks before the
    shuffle, and an equi-join that adaptive execution may split, so a hub's edges
    never have to meet in one task. The edges of each round are written to the
    shared folder.
    """
    spark = edges.sparkSession
    current = store(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(batches)
        if rows:
            table = pa.Table.from_batches(rows)
            ids, found = roots(*(table.column(k).to_numpy() for k in (0, 1)))
            for at in range(0, len(ids), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + 10_000]), pa.array(found[at : at + 10_000])], names=["id", "component"])

    if current.count() <= LOCAL:
        out = store(current.coalesce(1).mapInArrow(local, "id long, component long"), "components")
        remove(spark, current.path)
        return out
    state = None
    while True:
        mark = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == state or not mark[0]:
            break
        state = tuple(mark)
        # Large star: both directions; neighbours larger than u move to u's minimum.
        both = current.select("u", "v").unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (
            both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        # Small star: the smaller neighbours and u itself move to the minimum.
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(lowest, "u")
        small = (
            joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(lowest.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        following = store(small, "edges")
        remove(spark, current.path)
        current = following
    ends = current.select(F.col("v").alias("id")).distinct()
    out = store(
        current.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(ends.select("id", F.col("id").alias("component"))), "components"
    )
    remove(spark, current.path)
    return out
