"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import forget, fresh
from tessera.llm.tokens import pieces_of

ORDERS = (1, 2, 3, 4)
#: Odd multipliers of the characters of an n-gram.
MULTIPLIERS = np.array([2654435761, 2246822519, 3266489917, 668265263], "u4")
CHUNK = 4096
#: Bytes of text at a time.
PIECE = 1 << 18
BITS = 16
#: Labels that a model takes at most: its matrix has 2^BITS floats for each, 128 MB in all.
LANGUAGES = 512
UNDETERMINED = "und"


def grams(texts: list[str], bins: int) -> tuple[Iterator[np.ndarray], np.ndarray, int]:
    """For each order, the bin of the n-gram at every character of the lower-cased
    texts (`bins` itself where it would run into the next text); and where each
    text starts among the characters."""
    low = [x.lower() for x in texts]
    starts = np.cumsum([0] + [len(x) + 1 for x in low])[:-1]
    data = np.frombuffer(("\0".join(low) + "\0" * max(ORDERS)).encode("utf-32-le"), "<u4")
    n = len(data) - max(ORDERS) + 1
    zero = np.flatnonzero(data == 0)
    left = zero[np.searchsorted(zero, np.arange(n))] - np.arange(n)  # characters before the text ends
    shift = np.uint32(32 - int(bins).bit_length() + 1)

    def of() -> Iterator[np.ndarray]:
        for order in ORDERS:
            h = np.full(n, order * 0x9E3779B1 & 0xFFFFFFFF, "u4")
            for j in range(order):
                h = (h ^ data[j : n + j]) * MULTIPLIERS[j]
                h ^= h >> np.uint32(15)
            found = ((h * np.uint32(2654435769)) >> shift).astype("i4")
            found[left < order] = bins
            yield found

    return of(), starts, n


@dataclass
class Model:
    languages: list[str]
    bins: int
    weights: np.ndarray  # (bins + 1) x languages; the last row is zero
    prior: np.ndarray

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The best language's index and its posterior probability, by text."""
        by_order, starts, n = grams(texts, self.bins)
        total = np.tile(self.prior, (len(texts), 1))
        for found in by_order:
            for k in range(len(self.languages)):
                total[:, k] += np.add.reduceat(self.weights[:, k][found], starts, dtype="f8")
        best = total.argmax(1)
        with np.errstate(under="ignore"):
            share = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
        return best, share


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "lang", alpha: float = 0.05, bits: int = BITS) -> Model | None:
    """Learn from every row of `labelled` that has a text and a label; None
    without such rows. The driver gets 2^bits counts for each label; more than
    LANGUAGES labels are an error."""
    rows = labelled.select(F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    docs = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).take(LANGUAGES + 1)}
    if not docs:
        return None
    if len(docs) > LANGUAGES:
        raise ValueError(f"{label_col} has more than {LANGUAGES} values")
    languages = sorted(docs)
    place = {x: i for i, x in enumerate(languages)}
    bins = 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for part in pieces_of(batch, limit=PIECE):
                langs = np.array([place[x] for x in part.column(1).to_pylist()])
                for k in np.unique(langs).tolist():
                    total = totals.setdefault(k, np.zeros(bins + 1, "i8"))
                    by_order, _, _ = grams(part.column(0).filter(pa.array(langs == k)).to_pylist(), bins)
                    for found in by_order:
                        total += np.bincount(found, minlength=bins + 1)
        for k, total in totals.items():
            for c in range(0, bins, CHUNK):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([c], pa.int32()), pa.array([total[c : min(c + CHUNK, bins)].tobytes()])], names=names)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One row after the other, so that a task holds the sums alone.
        totals: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for k, c, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                x = np.frombuffer(blob.as_py(), "i8")
                totals[k, c] = totals[k, c] + x if (k, c) in totals else x
        for (k, c), x in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([c], pa.int32()), pa.array([x.tobytes()])], names=names)

    names, kinds = ["lang", "chunk", "counts"], "lang int, chunk int, counts binary"
    sums: dict[int, int] = {}
    weights = np.zeros((bins + 1, len(languages)), "f4")
    for k, c, blob in rows.mapInArrow(count, kinds).repartition("lang", "chunk").mapInArrow(add, kinds).collect():
        x = np.frombuffer(blob, "i8")
        weights[c : c + len(x), k] = np.log(x + alpha)
        sums[k] = sums.get(k, 0) + int(x.sum())
    for k in range(len(languages)):
        weights[:bins, k] -= np.log(sums.get(k, 0) + alpha * bins)
    n = np.array([docs[x] for x in languages], float)
    return Model(languages, bins, weights, np.log((n + 1) / (n.sum() + len(n))))


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The `keep` columns, doc_id, lang_pred and score of every row, from whole texts.

    The log-probability matrix is broadcast (LANGUAGES columns at most); each
    batch is scored by gathers and segment sums in numpy. A null text, or one without a
    letter, is `und` with score 0, as is every text if there is no model. score:
    the posterior probability of lang_pred. Of equally likely languages the
    first by name is taken. Repeated rows, and rows without an id, come out each;
    an empty table gives no rows. `keep` must not name doc_id, lang_pred or score;
    other columns are ignored.
    """
    if clash := {"doc_id", "lang_pred", "score"} & {c.lower() for c in keep}:
        raise ValueError(f"keep: {sorted(clash)} are columns of the result")
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        m = sent.value
        for batch in batches:
            for rows in pieces_of(batch, limit=PIECE):
                texts = rows.column(rows.num_columns - 1).to_pylist()
                lang, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
                usable = [i for i, x in enumerate(texts) if x is not None]
                if m is not None and usable:
                    best, share = m.predict([texts[i] for i in usable])
                    for i, b, s in zip(usable, best.tolist(), share.tolist(), strict=True):
                        lang[i], score[i] = m.languages[b], s
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(lang), pa.array(score)], names=[*rows.schema.names[:-1], "lang_pred", "score"])

    # Java's \p{L} decides what a letter is; a text without any reaches Python as null.
    lettered = F.when(F.col(text_col).rlike(r"\p{L}"), F.col(text_col))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *(F.col(c) for c in keep), lettered.alias(fresh(docs)))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(predict, f"{fields}, lang_pred string, score double")


def remainder(id_col: str, by: int) -> Column:
    """crc32(id as text) mod `by`; null for a null id, which is in neither fold."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % by
