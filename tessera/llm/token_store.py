"""Token ids in Parquet list columns, for selective reads of ids and metadata."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import new_path
from tessera.llm.tokens import bases, tokenized


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, encoding: str = "dictionary", row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10, page_rows: int = 2_000, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write `docs` as token files in ascending doc_id order, a range of ids to a file.

    Columns: part, doc_id, local_start, n_tokens, ids. The ids are a list column
    with `encoding` dictionary (16-bit indexes for a vocabulary of 50,000) or
    delta; the metadata columns are delta-encoded. Row groups and pages have the
    sizes given, and Parquet's column and offset indexes let a reader skip the
    pages of other documents. Spark's committer writes the files, so a task that
    is run twice leaves one copy.

    A null or empty text has the end id alone; repeated rows are written each;
    an empty table gives an empty file; other columns are ignored.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"encoding {encoding!r} is neither dictionary nor delta")
    options = {
        "compression": "zstd",
        "parquet.writer.version": "v2",
        "parquet.block.size": str(row_group_bytes),
        "parquet.page.size": str(page_bytes),
        "parquet.page.row.count.limit": str(page_rows),
        "parquet.dictionary.page.size": str(1 << 20),
        "parquet.enable.dictionary#ids.list.element": str(encoding == "dictionary").lower(),
    } | {f"parquet.enable.dictionary#{c}": "false" for c in ("part", "doc_id", "local_start", "n_tokens")}
    tokenized(docs, tokenizer, end_id, True, id_col, text_col).write.options(**options).parquet(path)


def read_tokens(spark: SparkSession, path: str, metadata_only: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the files at `path`; without ids, only the
    metadata pages are read. start: the ids of all documents before it."""
    stored = spark.read.parquet(path)
    before = bases(stored)
    offsets = spark.createDataFrame(list(before.items()), "part int, base long")
    columns = ["doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens"] + ["ids"] * (not metadata_only)
    # One row for each file: bounded by the number of shuffle partitions of the writer.
    return stored.join(F.broadcast(offsets), "part").select(*columns)


def checksums(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of what `read_tokens` gives: the crc32
    of the ids as little-endian unsigned 32-bit integers."""
    schema = pa.schema([(x, pa.int64()) for x in ("doc_id", "start", "n_tokens", "ids_crc32")])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            flat = np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False).astype("<u4"))
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            view, at, found = memoryview(flat), 0, []
            for end in ends.tolist():
                found.append(zlib.crc32(view[at:end]))
                at = end
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(ends, prepend=0).astype("i8")), pa.array(found, pa.int64())], schema=schema)

    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(sums, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write, read back, and return the checksums of what the files hold."""
    spark = docs.sparkSession
    path = new_path(spark, "token-files")
    write_tokens(docs, path, tokenizer, end_id)
    return checksums(read_tokens(spark, path))
