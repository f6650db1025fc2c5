"""Concatenate-and-cut packing of documents into sequences of fixed length."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import new_path, partitions_of, short_batches, store
from tessera.llm.tokens import bases, encoder, pieces_of

SCHEMA = pa.schema(
    [("doc_id", pa.int64())]
    + [(x, pa.int64()) for x in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    + [("is_first", pa.bool_()), ("is_last", pa.bool_()), ("ids", pa.binary())]
)
#: Where a document's ids are: the file, named by its task attempt, the record batch in it and the row in that.
PLACE = ("file", "batch", "row")
#: Documents in a range partition, in the mean at most; their places and lengths, some 10 MB, are sorted by the worker.
RANGE = 200_000
#: Rows and bytes of ids in a batch of pieces.
OUT_ROWS, OUT_BYTES = 2_000, 1 << 20


def write_ids(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored (doc_id, tie, file, batch, row, n_tokens), one row for each
    document; its ids, with `end_id` behind them, are in an Arrow file in `folder`,
    a URI that every executor reaches through pyarrow.fs. tie: a hash of the text.

    The workers write the ids, so neither they nor the texts are shuffled, sorted
    or held in the executor's heap. Only files of successful attempts are in the
    rows, so a task that is run twice or lost leaves no document twice."""
    end = np.array([end_id], "<u4").tobytes()
    held = pa.schema([("ids", pa.binary())])
    kinds = ("doc_id", "tie", *PLACE, "n_tokens")
    schema = pa.schema([(x, pa.int64()) for x in kinds])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        enc, file, count, out = encoder(tokenizer), TaskContext.get().taskAttemptId(), 0, None
        for batch in batches:
            for rows in pieces_of(batch):
                if out is None:
                    fs, root = FileSystem.from_uri(folder)
                    fs.create_dir(root, recursive=True)
                    sink = fs.open_output_stream(f"{root}/{file}.arrow", compression=None)
                    out = pa.ipc.new_file(sink, held, options=pa.ipc.IpcWriteOptions(compression="zstd", use_threads=False))
                found = [enc.encode(text) + end for text in rows.column(2).to_pylist()]
                out.write_batch(pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], schema=held))
                place = (np.full(len(found), file, "i8"), np.full(len(found), count, "i8"), np.arange(len(found)))
                lengths = np.fromiter((len(x) // 4 for x in found), "i8", len(found))
                count += 1
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *map(pa.array, (*place, lengths))], schema=schema)
        if out is not None:
            out.close()
            sink.close()

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    with short_batches(docs.sparkSession):
        return store(rows.mapInArrow(write, ", ".join(f"{x} long" for x in kinds)), "packing-documents")


def ranges(df: DataFrame, *keys: str) -> DataFrame:
    """`df` dealt by ranges of `keys`, which tell all rows apart, so that no range is too large to be sorted by a worker."""
    return df.repartitionByRange(max(partitions_of(df.sparkSession), df.count() // RANGE + 1), *keys)


def ordered(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.RecordBatch]:
    """The rows of a range partition by `keys`, nulls first."""
    if rows := [x for x in batches if x.num_rows]:
        table = pa.Table.from_batches(rows)
        table = table.take(pc.sort_indices(table, [(k, "ascending") for k in keys], null_placement="at_start"))
        yield from table.combine_chunks().to_batches(max_chunksize=10_000)


def in_order(written: DataFrame) -> DataFrame:
    """The stored (part, local_start, doc_id, file, batch, row, n_tokens): documents
    in ascending order of doc_id and tie over and within range partitions, nulls
    first; local_start counts the ids before one in its partition."""
    kinds, keys = ("part", "local_start", "doc_id", *PLACE, "n_tokens"), ("doc_id", "tie", *PLACE)
    schema = pa.schema([(x, pa.int32() if x == "part" else pa.int64()) for x in kinds])

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, part = 0, TaskContext.get().partitionId()
        for rows in ordered(batches, *keys):
            lengths = rows.column("n_tokens").to_numpy()
            ends = np.cumsum(lengths) + before
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ends), part, "i4")), pa.array(ends - lengths), *map(rows.column, kinds[2:])], schema=schema)
            before = int(ends[-1])

    return store(ranges(written, *keys).mapInArrow(start, "part int, " + ", ".join(f"{x} long" for x in kinds[1:])), "packing-order")


def pack(docs: DataFrame, tokenizer: str, sequence_length: int = 2048, end_id: int = 1, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece of a document in a sequence.

    The documents, each with `end_id` behind it, form one stream of ids in
    ascending doc_id order, which is cut every `sequence_length` ids; only the
    last sequence needs padding. Pass one tokenises each document where it lies
    and writes the ids to the shared folder; the documents' lengths alone are put
    in order, which makes offsets within range partitions, and partition totals
    make these global; pass two, dealt by where the ids lie, cuts each document on
    its own at the multiples of `sequence_length` that it crosses. A document of
    any length is cut by one row, and pieces come in no particular order.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset;
    is_first and is_last mark the boundary records of a document; ids are the
    piece's ids as little-endian unsigned 32-bit bytes, if `with_ids`.
    A null or empty text is a document of the end id alone. Repeated rows are
    packed each, those of one id, or of none, in the order of their texts' hashes
    (null ids first); an empty table gives no rows; other columns are ignored.
    """
    folder = new_path(docs.sparkSession, "packing-ids")
    placed = in_order(write_ids(docs, folder, tokenizer, end_id, id_col, text_col))
    before = bases(placed)
    schema = SCHEMA if with_ids else pa.schema(list(SCHEMA)[:-1])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        fs, root = FileSystem.from_uri(folder)
        opened = read = held = None
        out, size = [], 0

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

        for rows in ordered(batches, *PLACE):
            for part, local, doc, file, batch, row, n in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                if file != opened:
                    opened, read, source = file, None, pa.ipc.open_file(fs.open_input_file(f"{root}/{file}.arrow"))
                if batch != read:
                    read, held = batch, source.get_batch(batch).column(0)
                ids, first, at = memoryview(held[row].as_buffer()), before[part] + local, 0
                while at < n:
                    sequence, offset = divmod(first + at, sequence_length)
                    length = min(sequence_length - offset, n - at)
                    piece = ids[4 * at : 4 * (at + length)]
                    out.append((doc, at, length, zlib.crc32(piece), n, sequence, offset, at == 0, at + length == n) + ((bytes(piece),) if with_ids else ()))
                    at += length
                    size += with_ids * 4 * length
                    if len(out) >= OUT_ROWS or size >= OUT_BYTES:
                        yield made()
                        out, size = [], 0
        if out:
            yield made()

    # Dealt by rows, so a file of any size is shared by tasks; where a batch is, both read it.
    kinds = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, is_first boolean, is_last boolean"
    return ranges(placed, *PLACE).mapInArrow(cut, kinds + ", ids binary" * with_ids)


def sequence(pieces: DataFrame, sequence_id: int, sequence_length: int = 2048, pad_id: int = 0) -> np.ndarray:
    """The padded ids of one sequence, from the rows of `pack`."""
    rows = pieces.where(pieces.sequence_id == sequence_id).select("offset", "ids").collect()
    flat = b"".join(bytes(r.ids) for r in sorted(rows, key=lambda r: r.offset))
    out = np.full(sequence_length, pad_id, "<u4")
    out[: len(flat) // 4] = np.frombuffer(flat, "<u4")
    return out
