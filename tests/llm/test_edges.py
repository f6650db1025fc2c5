"""Odd inputs and laws of single operators."""

import random
import string
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import embeddings, language, secrets, spotsigs, warc


def test_vectors_beyond_float_range(spark):
    rows = [(1, [1e300, 2e300]), (2, [1e300, 2e300]), (3, [1.0, 2.0]), (4, [1e-60, 2e-60]), (5, [2.0, -1.0]), (5, [2.0, -1.0]), (6, [1.0, 2.0 + 1e-9])]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(1, 4, 1), (2, 4, 1), (3, 4, 1), (4, 4, 1), (5, 0, 5), (5, 0, 5), (6, 4, 1)]


def test_natural_runs():
    assert [list(r) for r in warc.natural_runs([1, 3, 3, 2, 5, 0])] == [[0, 1, 2], [3, 4], [5]]
    assert warc.natural_runs([]) == []


def test_capture_runs_are_merged_across_ranges(spark, monkeypatch):
    monkeypatch.setattr(warc, "RANGE", 40)
    rng = random.Random(6)
    # A hot URL holds a third of all captures.
    rows = [(i, "http://hot.example/" if i % 3 == 0 else f"http://{rng.choice('abc')}.example/{rng.randrange(50)}", "x" * rng.randrange(50), rng.choice([None, -(1 << 60), 0, 7, 1 << 60])) for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, at long").repartition(6)
    got = sorted(warc.archive_and_read(pages, time_col="at", archive_bytes=3000).collect(), key=lambda r: r.position)
    assert [r.position for r in got] == list(range(400)) and all(r.sound for r in got)
    when = {r[0]: r[3] for r in rows}
    keys = [(r.urlkey, when[r.page_id] is not None, when[r.page_id] or 0, r.page_id) for r in got]
    assert keys == sorted(keys)
    # A record states years 1 to 9999 alone.
    assert all(r.captured == (when[r.page_id] if when[r.page_id] in (0, 7) else None) for r in got)
    assert len({r.archive for r in got}) > 8


def test_each_archive_is_a_task(spark):
    pages = spark.createDataFrame([(i, None, "x" * 500) for i in range(300)], "page_id long, url string, html string").repartition(3)
    found = warc.archive_and_read(pages, archive_bytes=1000)
    archives = found.select("archive").distinct().count()
    folder = warc.new_path(spark, "warc")
    index = warc.write_archives(warc.with_originals(pages.selectExpr("page_id", "url", "page_id captured", "cast(html as binary) payload")), folder, 1000)
    read = warc.read_archives(spark, index, folder)
    assert read.rdd.getNumPartitions() == index.select("archive").distinct().count() == archives
    assert read.groupBy(F.spark_partition_id()).agg(F.count_distinct("archive").alias("n")).agg(F.max("n")).first()[0] == 1


def test_spans_by_strides(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice("ab1 é\U0001f642") for _ in range(n)) for n in (0, 1, 5, 300, 3000)] + ["1a" * 2000, "1" * 900]
    found = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", secrets.find(F.col("text"), "1[ab]*").alias("m")).collect()
    import re

    for r in found:
        assert [(m.start, m.match) for m in r.m] == [(m.start(), m[0]) for m in re.finditer("1[ab]*", texts[r.i])]


def test_redaction_by_hand(spark):
    rng = random.Random(4)
    cases = []
    for i in range(40):
        text = "".join(rng.choice("xyz \U0001f642") for _ in range(rng.randrange(0, 900)))
        spans = sorted((a, rng.randrange(3), a + 1 + rng.randrange(6)) for a in (rng.randrange(max(1, len(text) - 7)) for _ in range(rng.randrange(0, 300)))) if len(text) > 8 else []
        cases.append((i, text, spans))
    rows = spark.createDataFrame(cases, "i int, text string, spans array<struct<start:int,kind:int,end:int>>")
    for r in rows.select("i", secrets.redact(F.col("text"), F.col("spans")).alias("out")).collect():
        _, text, spans = cases[r.i]
        out, at = "", 0
        for a, _, b in spans:
            if a >= at:
                out += text[at:a] + "[SECRET]"
            at = max(at, b)
        assert r.out == out + text[at:]


LONG = {"base62": string.digits + string.ascii_letters, "base64": string.digits + string.ascii_letters + "+/", "base64url": string.digits + string.ascii_letters + "-_", "base32": "234567" + string.ascii_uppercase}


def test_recall_of_long_keys(spark):
    """Keys of 24 to 4,000 characters, a quarter of the candidates, among prose in runs of their own."""
    rng = np.random.default_rng(11)
    rows, case = [], {}
    for name, alphabet in LONG.items():
        for n in (24, 64, 300, 1200, 4000):
            for _ in range(20):
                case[len(rows)] = name, n
                rows.append((len(rows), "see " + "".join(rng.choice(list(alphabet), n)) + " there"))
    keys = len(rows)
    words = "under standing inter national character counter revolution house water table people letter number market window garden reading system".split()
    for k in range(1200):
        rows.append((len(rows), "see " + "_-/"[k % 3].join(rng.choice(words, int(rng.integers(4, 12)) if k % 5 else 200)) + " there"))
    got = {r.doc_id: r.n_random for r in secrets.report(secrets.scan(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    hits = Counter(case[i] for i in range(keys) if got[i])
    assert {k: hits[k] / 20 for k in set(case.values()) if hits[k] < 0.9 * 20} == {}
    assert sum(got[i] > 0 for i in range(keys, len(rows))) <= 0.01 * 1200


def test_names_of_the_result_are_not_kept(spark):
    docs = spark.createDataFrame([(1, "a b", 2, 3, 4)], "doc_id long, text string, base int, candidates int, score int")
    assert secrets.scan(docs, keep=("base", "candidates")).columns == ["doc_id", "base", "candidates", "found"]
    for call in (lambda: secrets.scan(docs, keep=("doc_id",)), lambda: language.identify(docs, None, keep=("score",))):
        with pytest.raises(ValueError):
            call()


def test_language_of_characters(spark):
    """Texts of characters that share all their bytes but one another's."""
    train = spark.createDataFrame([(i, x * 40, lang) for i, (x, lang) in enumerate([("中文 ", "zh"), ("日本 ", "ja"), ("\U00010348 ", "got")])], "doc_id long, text string, lang string")
    model = language.fit(train)
    assert model.bins == 1 << language.BITS
    got = language.identify(spark.createDataFrame([(1, "文中"), (2, "本"), (3, "\U00010348\U00010348"), (None, "本日")], "doc_id long, text string"), model).collect()
    assert sorted(((r.doc_id, r.lang_pred) for r in got), key=str) == [(1, "zh"), (2, "ja"), (3, "got"), (None, "ja")]
    many = spark.range(language.LANGUAGES + 1).selectExpr("id doc_id", "'text' text", "cast(id as string) lang")
    with pytest.raises(ValueError):
        language.fit(many)


def test_likeness_is_that_of_multisets(spark):
    """near_edited and near_next against multisets of the signatures' first 32 bits, by hand."""
    rng = random.Random(3)
    words = "the of and house water stone river light paper cloud is to".split()
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 80))) for _ in range(30)] + ["the house water " * 300, "", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in spotsigs.fingerprints(docs).collect()}

    def parts(print_):
        body = print_.split(":")[1]
        return {body[i : i + 8] for i in range(0, len(body), 8)}

    for i in range(len(texts)):
        text, after = texts[i] or "", texts[(i + 1) % len(texts)] or ""
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + after[:quarter]
        mine, own = parts(got[i].fingerprint), parts(got[i].edited_fingerprint)
        other = parts(got[(i + 1) % len(texts)].fingerprint)
        like = lambda a, b: 1.0 if not a and not b else len(a & b) / len(a | b)
        assert got[i].n_chars == len(text)
        assert abs(got[i].near_edited - like(mine, own)) < 1e-12 and abs(got[i].near_next - like(mine, other)) < 1e-12
        # The edited text's fingerprint is that of a document with that text.
        assert edited != text or mine == own
