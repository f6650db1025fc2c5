"""A corpus pipeline: language ID, Jaccard dedup, secret redaction, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs. All but the last return the
columns of documents.

In every stage, rows come out each where they are repeated, an empty table gives
no rows, and texts of any length are taken whole. A null text, or one without a
letter, goes with the first stage; a null lang, source, n_chars or doc_id is kept
as it is: rows without an id are never taken for copies of others, and are packed
first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import jaccard, language, packing, secrets
from tessera.llm.queries import tokenizer_path
from tessera.llm.shared import store
from tessera.tables import load

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the labelled documents of three of four folds; documents whose
    language can't be told (no text, no letter, or no language with an even
    chance) go."""
    fold = language.remainder("doc_id", 4)
    model = language.fit(docs.where(fold != 2))
    found = language.identify(docs, model, keep=tuple(c for c in COLUMNS if c != "doc_id"))
    return found.where((F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= 0.5)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component at 80 % of five-word shingles stays: that of the smallest id."""
    return jaccard.keep_one(docs, 80, 5).select(*COLUMNS)


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; the secrets found in its text are masked, and n_chars follows."""
    found = secrets.scan(docs, keep=tuple(c for c in COLUMNS if c != "doc_id"))
    text = secrets.redact(F.col("text"), F.col("found"))
    return found.withColumn("text", text).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2,048 tokens, cut from the whole stream of documents."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), 2048, 1, with_ids=False)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("secret_redaction", secret_redaction),
    ("packing", packed),
]

#: Neither naive Bayes over hashed n-grams nor byte-level BPE can be said in SQL:
#: tests/llm/test_pipeline.py holds run() against a chain of brute-force stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other, on the table `documents`."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
