"""WARC archives and their capture index, merged from sorted runs by a loser tree."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import new_path, partitions_of, store
from tessera.llm.tokens import pieces_of

ENTRY = "urlkey string, captured long, page_id long, digest string, payload_bytes long, record_type string, archive string, offset long, length long"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, captured long, archive string, offset long, sound boolean"
#: Of the years 1 to 9999, in epoch seconds: a record can state no other date.
LEAST_TIME, MOST_TIME = -62135596800, 253402300799
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def schema_of(kinds: str) -> pa.Schema:
    named = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "int": pa.int32()}
    return pa.schema([(n, named[k]) for n, k in (x.split() for x in kinds.split(", "))])


def urlkey(url: str | None) -> str:
    """The host's labels in reverse, then path and query in lower case, as capture
    indexes sort them; a null or broken URL is its own lower-case text."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url.strip().lower()
    labels = host.removeprefix("www.").split(".")
    return f"{','.join(reversed(labels))}{f':{port}' if port else ''}){parts.path or '/'}{f'?{parts.query}' if parts.query else ''}".lower()


def one_line(value: str) -> str:
    """A header value: line breaks and other controls are percent-encoded."""
    return "".join(c if ord(c) >= 32 and ord(c) != 127 else f"%{ord(c):02X}" for c in value)


def record(page_id: int | None, url: str | None, captured: int | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record. A revisit keeps the HTTP header, with the payload's length, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>"]
    if url is not None:
        head.append(f"WARC-Target-URI: {one_line(url)}")
    if captured is not None and LEAST_TIME <= captured <= MOST_TIME:
        head.append(f"WARC-Date: {datetime.fromtimestamp(captured, UTC):%Y-%m-%dT%H:%M:%SZ}")
    head += [f"WARC-Payload-Digest: sha256:{digest}"]
    head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"] * revisit
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers (names in lower case) and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode().split("\r\n")[1:])}, payload


def members(stream, chunk: int = 1 << 20) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each gzip member, with a bounded read ahead."""
    held, at = b"", 0
    while True:
        held = held or stream.read(chunk)
        if not held:
            return
        inflate, parts, length = zlib.decompressobj(31), [], 0
        while not inflate.eof:
            if not held:
                held = stream.read(chunk)
                if not held:
                    raise ValueError(f"archive ends within the record at {at}")
            parts.append(inflate.decompress(held))
            length += len(held) - len(inflate.unused_data)
            held = inflate.unused_data
        yield at, length, b"".join(parts)
        at += length


class LoserTree:
    """k-way merge of sorted iterables: each inner node keeps the loser of its
    match, so that an item costs one comparison a level."""

    def __init__(self, runs: Iterable[Iterable]):
        self.runs = [iter(x) for x in runs]
        self.k = len(self.runs)
        self.heads = [next(x, None) for x in self.runs]
        self.losers = [-1] * max(1, self.k)
        for leaf in range(self.k):
            self._play(leaf)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None if x is None or y is None else x < y or (x == y and a < b)

    def _play(self, leaf: int) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node > 0:
            held = self.losers[node]
            if held < 0:  # while the tree is built: wait here for the other side
                self.losers[node] = winner
                return
            if self._beats(held, winner):
                self.losers[node], winner = winner, held
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator:
        while self.k and (item := self.heads[winner := self.losers[0]]) is not None:
            self.heads[winner] = next(self.runs[winner], None)
            self._play(winner)
            yield item


def with_originals(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """`pages` (page_id, url, captured, payload) with digest and refers_to: among
    equal payloads of `least_bytes` at least, the smallest page_id's is the
    response that the others revisit."""
    rows = pages.withColumn("digest", F.sha2("payload", 256)).withColumn("n_bytes", F.length("payload"))
    # Only payloads that occur twice need their rows looked up.
    first = rows.where(F.col("n_bytes") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").select("digest", "first")
    joined = rows.join(first, "digest", "left")
    return joined.select("page_id", "url", "captured", "payload", "digest", F.when((F.col("page_id") != F.col("first")) & (F.col("n_bytes") >= least_bytes), F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = 64 << 20) -> DataFrame:
    """Write `pages` (as `with_originals` gives them) as gzipped WARC files in
    `folder`, a URI that every executor reaches through pyarrow.fs, and return
    the capture index: each archive's entries are one run, sorted by URL key and
    time, written to the shared folder. A file is named by its task attempt, and
    only those of successful attempts are in the index, so a task that is run
    twice or lost leaves no record twice."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        fs, root = FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        task = TaskContext.get()
        stem, count, out, entries, at = f"{task.partitionId():06d}-{task.taskAttemptId()}", 0, None, [], 0

        def run() -> pa.RecordBatch:
            # Nulls first, as Spark orders them.
            entries.sort(key=lambda e: (e[0], e[1] is not None, e[1] or 0, e[2] is not None, e[2] or 0, e[7]))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*entries, strict=True), schema, strict=True)], schema=schema)

        schema = schema_of(ENTRY)
        for batch in batches:
            for rows in pieces_of(batch, 100):
                for page_id, url, captured, payload, digest, refers_to in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                    if out is None:
                        name = f"{stem}-{count}.warc.gz"
                        out, at, entries = fs.open_output_stream(f"{root}/{name}", compression=None), 0, []
                    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
                    data = packer.compress(record(page_id, url, captured, payload, digest, refers_to)) + packer.flush()
                    out.write(data)
                    entries.append((urlkey(url), captured, page_id, digest, len(payload), "response" if refers_to is None else "revisit", name, at, len(data)))
                    at += len(data)
                    if at >= archive_bytes:
                        out.close()
                        out, count = None, count + 1
                        yield run()
        if out is not None:
            out.close()
            yield run()

    return store(pages.select("page_id", "url", "captured", "payload", "digest", "refers_to").mapInArrow(write, ENTRY), "warc-runs")


#: Entries of the index in a range partition, in the mean.
RANGE = 200_000


def natural_runs(keys: list) -> list[range]:
    """The maximal ascending stretches of `keys`."""
    cuts = [0, *(i for i in range(1, len(keys)) if keys[i] < keys[i - 1]), len(keys)]
    return [range(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if a < b]


def merge_runs(index: DataFrame) -> DataFrame:
    """The entries of all runs in global order of (urlkey, captured, page_id), with
    `position`, each entry's place in it.

    A range partition of some RANGE entries takes its segment of every run; the
    key ends in the archive and offset, so one URL's captures may span
    partitions. A shuffle brings a segment in the run's order: what ascends is a
    run already, nothing is sorted again, and a loser tree merges the runs of a
    partition, however they were cut."""
    key = ("urlkey", "captured", "page_id", "archive", "offset")
    kinds = f"{ENTRY}, part int, place long"

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), schema_of(ENTRY))
        columns = [table.column(c).to_pylist() for c in key]
        # Nulls first, as Spark orders them.
        keys = [(u, t is not None, t or 0, p is not None, p or 0, a, o) for u, t, p, a, o in zip(*columns, strict=True)]
        part, place, order = TaskContext.get().partitionId(), 0, []

        def out() -> Iterator[pa.RecordBatch]:
            n = len(order)
            merged = table.take(pa.array(order)).append_column("part", pa.array(np.full(n, part, "i4"))).append_column("place", pa.array(np.arange(place, place + n)))
            yield from merged.combine_chunks().to_batches()

        for _, i in LoserTree(((keys[i], i) for i in run) for run in natural_runs(keys)):
            order.append(i)
            if len(order) == 10_000:
                yield from out()
                place, order = place + len(order), []
        if order:
            yield from out()

    spark = index.sparkSession
    ranges = max(partitions_of(spark), -(-index.count() // RANGE))
    ordered = store(index.repartitionByRange(ranges, *key).mapInArrow(merge, kinds), "warc-index")
    before, total = [], 0
    for part, n in sorted(ordered.groupBy("part").agg(F.count("*")).collect()):
        before.append((part, total))
        total += n
    offsets = spark.createDataFrame(before, "part int, base long")
    # A row for each range partition.
    return ordered.join(F.broadcast(offsets), "part").withColumn("position", F.col("base") + F.col("place")).drop("part", "place", "base")


def read_archives(spark: SparkSession, index: DataFrame, folder: str) -> DataFrame:
    """Every record of the archives that `index` names, as `READ`. The digest and
    length of a response are those of the payload read; `sound` says that the
    record's headers state the same. A revisit states its original's."""
    schema = schema_of(READ)

    def page(uri: str) -> int | None:
        found = uri.strip("<>").removeprefix("urn:page:")
        return int(found) if found else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        fs, root = FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for offset, _, data in members(stream):
                        warc, http, payload = parse(data)
                        stated, n = warc["warc-payload-digest"].removeprefix("sha256:"), int(http["content-length"])
                        revisit = warc["warc-type"] == "revisit"
                        digest = stated if revisit else hashlib.sha256(payload).hexdigest()
                        captured = int(datetime.fromisoformat(warc["warc-date"]).timestamp()) if "warc-date" in warc else None
                        rows.append((page(warc["warc-record-id"]), n if revisit else len(payload), digest, warc["warc-type"], page(warc["warc-refers-to"]) if revisit else None, warc.get("warc-target-uri"), captured, name, offset, revisit or (digest == stated and n == len(payload))))
                        if len(rows) == 1000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    names = index.select("archive").distinct()
    # A task for each archive: one task deals the names, one for ARCHIVE bytes, out
    # in turn. By a number alone, adaptive execution leaves the tasks as they are.
    return names.coalesce(1).repartition(max(1, names.count())).mapInArrow(read, READ)


def archive_and_read(pages: DataFrame, least_bytes: int = 100, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", time_col: str | None = None, archive_bytes: int = 64 << 20) -> DataFrame:
    """Write a record for each row of `pages`, merge the capture index, read the
    archives back: page_id, payload_bytes, payload_digest, record_type,
    refers_to, url, captured, archive, offset, sound, urlkey, position.

    A null html is an empty payload. Rows without an id are never originals;
    rows that share the smallest id of a payload are responses all. Without
    `time_col` (epoch seconds) captures follow each other by id, a second apart;
    times beyond the years 1 to 9999 stand in the index and not in the record.
    An empty table gives no rows; other columns are ignored.
    """
    spark = pages.sparkSession
    captured = F.col(time_col).cast("long") if time_col else F.lit(1704067200) + F.pmod(F.col(id_col).cast("long"), F.lit(1_000_000_000))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), captured.alias("captured"), F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("payload"))
    folder = new_path(spark, "warc")
    index = write_archives(with_originals(rows, least_bytes), folder, archive_bytes)
    merged = merge_runs(index).select("archive", "offset", "urlkey", "position")
    found = read_archives(spark, index, folder).join(merged, ["archive", "offset"], "left")
    return found.select(*schema_of(READ).names, "urlkey", "position")
