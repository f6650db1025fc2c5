"""The pipeline's run() against a chain of brute-force stages on a small table."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm.queries import tokenizer_path
from tests.llm.test_jaccard_rounds import shingles
from tests.llm.test_text_operators import ASSIGN

ORDERS = (1, 2, 3, 4)


def fixture():
    rng = random.Random(12)
    make = {"xx": "abcdefg", "yy": "stuvwxyz"}
    rows = []
    for i in range(90):
        lang = rng.choice(["xx", "yy"])
        text = " ".join("".join(rng.choice(make[lang]) for _ in range(rng.randrange(2, 7))) for _ in range(rng.randrange(1, 120)))
        rows.append([i, text, lang if i % 9 else None, "s"])
    for k in range(12):  # copies, near copies, and secrets in them
        rows.append([100 + k, rows[k][1], rows[k][2], "s"])
        words = rows[20 + k][1].split()
        if len(words) > 60:
            words[5] = "abcab"
        rows.append([200 + k, " ".join(words), rows[20 + k][2], "s"])
        rows.append([300 + k, rows[40 + k][1] + " token: abcdef0123456789xyz AKIA" + "QWERTYUIOPASDF12 deadbeefdeadbeef00" + " é\U0001f642", rows[40 + k][2], "s"])
    rows += [[400, None, "xx", "s"], [401, "", "yy", "s"], [402, "123 !?", "xx", "s"], [403, " ".join("bagged" for _ in range(30_000)), "xx", "s"], [404, "dead beef", None, None], [404, "dead beef", None, None]]
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]


def language(rows):
    """Naive Bayes with a counter for each language, no hashing."""

    def grams(text):
        x = text.lower()
        return Counter(x[i : i + k] for k in ORDERS for i in range(len(x) - k + 1))

    train = [(t, lang) for i, t, lang, *_ in rows if t is not None and lang is not None and zlib.crc32(str(i).encode()) % 4 != 2]
    langs = sorted({lang for _, lang in train})
    counts, docs = {x: Counter() for x in langs}, Counter(lang for _, lang in train)
    for t, lang in train:
        counts[lang] += grams(t)
    bins, alpha = 1 << 16, 0.05
    total = {x: sum(counts[x].values()) + alpha * bins for x in langs}
    kept = []
    for r in rows:
        if r[1] is None or not re.search(r"[^\W\d_]", r[1]):
            continue
        found = grams(r[1])
        score = {x: math.log((docs[x] + 1) / (len(train) + len(langs))) + sum(n * math.log((counts[x][g] + alpha) / total[x]) for g, n in found.items()) for x in langs}
        if 1 / sum(math.exp(v - max(score.values())) for v in score.values()) >= 0.5:
            kept.append(r)
    return kept


def one_of_each(rows):
    sets = [shingles(r[1]) for r in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                group[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        least[root(i)] = min(r[0], least.get(root(i), r[0]))
    return [r for i, r in enumerate(rows) if not sets[i] or r[0] == least[root(i)]]


def masked(text):
    spans = [(m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    spans += [(m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [(m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    out, at = "", 0
    for a, b in sorted(spans):
        if a >= at:
            out += text[at:a] + "[SECRET]"
        at = max(at, b)
    return out + text[at:]


def pieces(rows):
    tokenizer, at, out = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")), 0, []
    for r in sorted(rows, key=lambda r: (r[0], r[1])):
        ids = [*tokenizer.encode(r[1], add_special_tokens=False).ids, 1]
        start = 0
        while start < len(ids):
            sequence, offset = divmod(at + start, 2048)
            part = ids[start : start + 2048 - offset]
            out.append((r[0], start, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids), sequence, offset))
            start += len(part)
        at += len(ids)
    return sorted(out)


def write(spark, rows, path):
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, kinds).repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_run_is_the_chain_of_its_stages(spark, tmp_path):
    rows = fixture()
    kept = one_of_each(language(rows))
    assert 60 < len(kept) < len(rows) - 15 and any("AKIA" in r[1] for r in kept)
    want = pieces([(r[0], masked(r[1])) for r in kept])
    got = corpus_pipeline.run(spark, write(spark, rows, tmp_path))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert sorted(map(tuple, got.select(*columns).collect())) == want


def test_stages_keep_the_columns(spark, tmp_path):
    path = write(spark, fixture(), tmp_path)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns
        assert stage(spark, docs.limit(0), path).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), path).count() == 0
