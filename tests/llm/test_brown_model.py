"""The Brown model's laws: a distribution that sums to 1, counts merged in any way."""

import math
import random
import zlib

import numpy as np
import pytest

from tessera.llm import brown


def held(i):
    return zlib.crc32(str(i).encode()) % 7 == 2


@pytest.mark.parametrize("head", [brown.HEAD, 3])
def test_probabilities_sum_to_one(spark, monkeypatch, head):
    """With one class, P(w | v) is P(w): the empty document gives that of the end."""
    monkeypatch.setattr(brown, "HEAD", head)
    rng = random.Random(1)
    words = [f"k{i}" for i in range(60)]
    training = [i for i in range(400) if not held(i)][:80]
    rows = [(i, " ".join(rng.choice(words[: 1 + rng.randrange(60)]) for _ in range(12))) for i in training]
    known = sorted({w for _, t in rows for w in t.split()})
    groups, k = {}, 0
    while len(groups) < brown.GROUPS:  # an unknown word of each group
        word = f"unknown{k:05x}{chr(97 + k % 26)}{chr(0xE0 + k // 26 % 30)}"
        groups.setdefault(brown.group_of(word.encode()), word)
        k += 1
        if k > 200_000:
            break
    # Any two bytes end a word of some group; those that letters don't reach end in others.
    for a in range(33, 127):
        for b in range(33, 127):
            groups.setdefault(brown.group_of(bytes([a, b])), f"Unknown{chr(a)}{chr(b)}".lower())
    asked = [w for g, w in groups.items() if brown.group_of(w.encode()) == g] + known
    ids = [i for i in range(1000, 60_000) if held(i)][: len(asked) + 1]
    probe = list(zip(ids, [*asked, ""], strict=True))
    got = {r.doc_id: r for r in brown.score(spark.createDataFrame(rows + probe, "doc_id long, text string").repartition(5), n_classes=1).collect()}
    end = got[ids[-1]].score
    share = {w: 10 ** (got[i].score - end) for i, w in probe if w}
    total = 10**end + sum(share.values())
    # The unknown word's share of each group that no unknown word was found for.
    count = {w: sum(t.split().count(w) for _, t in rows) for w in known}
    missing = 0
    for g in set(range(brown.GROUPS)) - {g for g, w in groups.items() if brown.group_of(w.encode()) == g}:
        rare = [n for w, n in count.items() if n < brown.LEAST and brown.group_of(w.encode()) == g]
        missing += (sum(rare) + brown.EMISSION) / (sum(rare) + len(rare) + 1)
    clustered = sum(sum(t.split().count(w) for _, t in rows) >= brown.LEAST for w in known)
    members = 1 + brown.GROUPS + clustered
    tokens = sum(len(t.split()) + 1 for _, t in rows)
    assert total + missing / (tokens + brown.EMISSION * members) == pytest.approx(1, abs=1e-9)
    # And by hand.
    for w in known:
        n = sum(t.split().count(w) for _, t in rows)
        if n >= brown.LEAST:
            assert share[w] == pytest.approx((n + brown.EMISSION) / (tokens + brown.EMISSION * members))


def test_counts_are_the_same_however_merged(spark, monkeypatch):
    """Contexts by brute force, from dense and sparse tables, in one level and in two."""
    rng = np.random.default_rng(2)
    monkeypatch.setattr(brown, "BLOCK", 8)
    symbols = [np.append(rng.integers(1, 40, 30), 0).astype("i4") for _ in range(25)]
    classes = rng.integers(0, 3, 40).astype("i4")
    width = 7
    want, pairs = np.zeros((40, width), "i8"), np.zeros((3, 3), "i8")
    for x in symbols:
        before = 0
        for s in x.tolist():
            want[before, classes[s]] += 1
            want[s, 3 + classes[before]] += 1
            want[s, 6] += before == s
            pairs[classes[before], classes[s]] += 1
            before = s
    table = spark.createDataFrame([(bytearray(x.tobytes()),) for x in symbols], "symbols binary").repartition(6)
    for dense, parts in ((40, 100), (8, 100), (16, 2)):
        monkeypatch.setattr(brown, "PARTS", parts)
        stored = brown.contexts(table, classes, 3, dense)
        found = np.zeros((40, width), "i8")
        for r in stored.where("block >= 0").collect():
            at, counts = brown.unpacked(bytes(r.counts))
            found.reshape(-1)[r.block * 8 * width + at] = counts
        assert (found == want).all()
        assert (brown.bigrams(stored, 3) == pairs).all()
    assert (brown.class_bigrams(table, classes, 3) == pairs).all()


def test_packed_counts():
    at, counts = np.array([0, 3, 70_000, 1 << 33]), np.array([1, 255, 256, 1 << 40])
    a, c = brown.unpacked(brown.packed(at, counts))
    assert (a == at).all() and (c == counts).all()
    assert [len(x) for x in brown.unpacked(brown.packed(at[:0], counts[:0]))] == [0, 0]


def test_ties_repeats_and_rows_without_id(spark):
    rows = [(1, "a b a b"), (1, "a b a b"), (None, "a c"), (2, None), (3, ""), (4, "x " * 20_000)]
    got = brown.score(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as fold", "2 as symbols", "3 as word")).collect()
    assert sorted(((r.doc_id, r.n_tokens) for r in got), key=str) == [(1, 5), (1, 5), (2, 1), (3, 1), (4, 20_001), (None, 3)]
    assert len({r.score for r in got if r.doc_id == 1}) == 1
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_sweeps_read_bigrams(spark):
    rng = np.random.default_rng(4)
    texts = [np.append(rng.integers(1, 30, 400), 0).astype("i4") for _ in range(12)]
    table = spark.createDataFrame([(bytearray(x.tobytes()),) for x in texts], "symbols binary").repartition(3)
    bigrams = brown.followed(table)
    found = [brown.unpacked(bytes(r.bigrams)) for r in bigrams.collect()]
    assert sum(int(n.sum()) for _, n in found) == 12 * 401 > 2 * sum(len(at) for at, _ in found)
    classes = rng.integers(0, 3, 40)
    totals = [{r.block: tuple(x.tolist() for x in brown.unpacked(bytes(r.counts))) for r in brown.contexts(t, classes, 3, 2048).collect()} for t in (table, bigrams)]
    assert totals[0] == totals[1] and set(totals[0]) == {-1, 0}
    assert (brown.class_bigrams(bigrams, classes, 3) == brown.class_bigrams(table, classes, 3)).all()


def test_gains_are_those_of_the_likelihood():
    rng = np.random.default_rng(5)
    x = np.r_[rng.integers(0, 8, 3000), 20, 20, 1, 21, 2, 22, 0]
    classes, k = rng.integers(0, 6, 23), 6
    prev = np.r_[0, x[:-1]]

    def counts(classes):
        return np.bincount(classes[prev] * k + classes[x], minlength=k * k).reshape(k, k)

    def likelihood(classes):
        n = counts(classes)
        return brown.xlogx(n).sum() - brown.xlogx(n.sum(1)).sum() - brown.xlogx(n.sum(0)).sum()

    for some in (np.arange(8), np.array([20, 21, 22])):  # most classes met, and few
        after, before = (np.array([np.bincount(classes[b[a == s]], minlength=k) for s in some]) for a, b in ((prev, x), (x, prev)))
        value = brown.gains(counts(classes), classes[some], after, before, np.array([((x == s) & (prev == s)).sum() for s in some]))
        for i, s in enumerate(some.tolist()):
            for c in range(k):
                moved = classes.copy()
                moved[s] = c
                assert value[i, c] - value[i, classes[s]] == pytest.approx(likelihood(moved) - likelihood(classes), abs=1e-6)
