"""Byte-level BPE ids by the tokenizers library, a pre-token at a time.

Byte-level pre-tokenisation cuts a text into runs of letters, of digits, of
other marks and of white space, whose ids do not depend on their neighbours.
For texts of Latin characters one regular expression finds these runs, and the
library's model turns each different one into ids once per worker; any other
text goes through the library whole.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import forget, partitions_of, remembered, slices

#: Characters whose class is beyond doubt, by kind: letters, numbers, others. A text with anything else is left to the library whole.
_KINDS = {k: "".join(c for c in map(chr, range(33, 0x250)) if unicodedata.category(c)[0] in k) for k in ("L", "N", "MPS")}
_LETTERS, _NUMBERS, _OTHERS = (f"[{re.escape(x)}]+" for x in _KINDS.values())
#: Fixed pattern: the pre-tokens of byte-level BPE, for these characters; at the end, one character of any other kind.
PRE_TOKEN = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?{_LETTERS}| ?{_NUMBERS}| ?{_OTHERS}|[ \t\r\n]+(?![^ \t\r\n])|[ \t\r\n]+|(?s:.)")
_PLAIN = frozenset("".join(_KINDS.values()) + " \t\r\n")
CACHE_ENTRIES = 600_000
#: The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_ALPHABET = {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in set(_SHOWN))}


class _Whole(Exception):
    """The text can't be taken by pre-tokens."""


class _Known(dict):
    """pre-token -> its ids as little-endian unsigned 32-bit bytes; full at CACHE_ENTRIES."""

    def __init__(self, model):
        self.model = model

    def __missing__(self, token: str) -> bytes:
        if len(token) == 1 and token not in _PLAIN:
            raise _Whole
        shown = token.encode().decode("latin-1").translate(_ALPHABET)
        found = array("I", [x.id for x in self.model.tokenize(shown)]).tobytes()
        if len(self) < CACHE_ENTRIES and len(token) < 64:
            self[token] = found
        return found


class Encoder:
    """Encodes texts to bytes of unsigned 32-bit ids, as the library would."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        pre, normal = self.tokenizer.pre_tokenizer, self.tokenizer.normalizer
        self.by_token = normal is None and "ByteLevel(add_prefix_space=False" in repr(pre) and "use_regex=True" in repr(pre)
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.known = _Known(self.tokenizer.model)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if self.by_token and not any(x in text for x in self.added):
            try:
                return b"".join(map(self.known.__getitem__, PRE_TOKEN.findall(text)))
            except _Whole:
                pass
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_ENCODERS: dict[str, Encoder] = remembered()


def encoder(path: str) -> Encoder:
    """One per Python worker, which Spark keeps from task to task."""
    forget(_ENCODERS)
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pieces_of(batch: pa.RecordBatch, rows: int = 500, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, bounded by rows and by bytes of text, so that what is made of each stays small."""
    yield from slices(batch, limit, *(k for k, f in enumerate(batch.schema) if f.type in (pa.string(), pa.binary())), rows=rows)


def tokenized(docs: DataFrame, path: str, end_id: int, as_list: bool, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, doc_id, local_start, n_tokens, ids) in ascending doc_id order over
    and within range partitions: ids of the whole text with `end_id` appended,
    as a list or as little-endian unsigned 32-bit bytes; local_start counts the
    ids before it in its partition. Null texts count as empty; rows that share
    an id, or have none, are ordered by their text (null ids first)."""
    end = np.array([end_id], "<u4").tobytes()
    kind = pa.list_(pa.int32()) if as_list else pa.binary()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, before, part = encoder(path), 0, TaskContext.get().partitionId()
        for batch in batches:
            for rows in pieces_of(batch):
                found = [enc.encode(text) + end for text in rows.column(1).to_pylist()]
                lengths = np.fromiter((len(x) // 4 for x in found), "i8", len(found))
                ends = np.cumsum(lengths)
                if as_list:
                    flat = np.frombuffer(b"".join(found), "<i4")
                    ids = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype("i4")), pa.array(flat))
                else:
                    ids = pa.array(found, pa.binary())
                columns = [pa.array(np.full(len(found), part, "i4")), rows.column(0), pa.array(ends - lengths + before), pa.array(lengths), ids]
                before += int(ends[-1])
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    schema = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("ids", kind)])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dealt = rows.repartitionByRange(partitions_of(docs.sparkSession), "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    return dealt.mapInArrow(encode, f"part int, doc_id long, local_start long, n_tokens long, ids {'array<int>' if as_list else 'binary'}")


def bases(stored: DataFrame) -> dict[int, int]:
    """part -> ids in all partitions before it: the second pass of the prefix sum.
    The driver gets one row for each shuffle partition, however many documents."""
    totals = sorted(stored.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    out, before = {}, 0
    for part, n in totals:
        out[part], before = before, before + n
    return out
