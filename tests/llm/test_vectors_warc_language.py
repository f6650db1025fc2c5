import hashlib
import math
import random

import numpy as np
import pytest

from tessera.llm import embeddings, language, warc
from tessera.llm.queries import QUERIES


def brute_links(rows, threshold):
    ids, units = [], []
    for i, v in rows:
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        u = np.array(v, "f4").astype("f8")
        ids.append(i)
        units.append(u / np.linalg.norm(u))
    links = {i: 0 for i in ids}
    parent = {i: i for i in ids}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if len(units[a]) == len(units[b]) and ids[a] != ids[b] and units[a] @ units[b] >= threshold:
                links[ids[a]] += 1
                links[ids[b]] += 1
                x, y = sorted((top(ids[a]), top(ids[b])))
                parent[y] = x
    return links, {i: top(i) for i in ids}


def test_vectors_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "TILE", 60)
    rng = np.random.default_rng(1)
    rows = []
    for c in range(40):
        centre = rng.normal(size=16)
        for _ in range(1 if c % 3 else 12):
            rows.append((len(rows), [float(x) for x in centre + rng.normal(size=16) * 0.12]))
    hot = rng.normal(size=16)
    rows += [(len(rows) + k, [float(x) for x in hot * (k + 1)]) for k in range(150)]
    n = len(rows)
    rows += [(n, None), (n + 1, []), (n + 2, [0.0] * 16), (n + 3, [float("nan")] + [1.0] * 15), (n + 4, [float("inf")] + [1.0] * 15), (n + 5, [None] + [1.0] * 15), (n + 6, [1.0, 2.0]), (n + 7, [2.0, 4.0]), (None, [1.0, 2.0]), (n + 8, [1e30] * 16), (n + 9, [1e-30] * 16)]
    table = spark.createDataFrame([(*r, 5, "x") for r in rows], "vec_id long, embedding array<float>, n_links int, cell string")
    links, component = brute_links(rows, 0.95)
    got = embeddings.near_duplicates(table, 0.95, per_cell=80).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.n_links == links.get(r.vec_id, 0)
        assert r.component_id == component.get(r.vec_id, r.vec_id)
        assert r.kept == (None if r.vec_id is None else r.vec_id == r.component_id)
    assert embeddings.near_duplicates(table.limit(0)).count() == 0


def pairs_lost(unit, pivots, radius, batch):
    """Pairs within `radius` of which neither vector is dealt to the other's home."""
    parts = [embeddings.places(unit[k : k + batch], pivots, radius) for k in range(0, len(unit), batch)]
    home, near = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    i, j = np.nonzero(np.triu(unit @ unit.T >= 1 - radius**2 / 2, 1))
    met = (home[i] == home[j]) | near[i, home[j]] | near[j, home[i]]
    return len(i), int((~met).sum())


@pytest.mark.parametrize("batch", [200, 3000])
def test_no_pair_is_lost_beside_a_hot_vector(batch):
    rng = np.random.default_rng(5)
    hot = rng.normal(size=32)
    spread = rng.normal(size=(40, 32))[rng.integers(0, 40, 1800)] + rng.normal(size=(1800, 32)) * 0.15
    near = hot + rng.normal(size=(300, 32)) * 0.1
    unit = embeddings._unit(np.concatenate([np.tile(hot, (900, 1)), near, spread])[rng.permutation(3000)].astype("f4"))
    radius = math.sqrt(2 - 2 * 0.95)
    pivots = embeddings.fit_pivots(unit, 60)
    assert len(pivots) > 20
    found, lost = pairs_lost(unit, pivots, radius, batch)
    assert found > 100_000 and lost == 0
    # Pivots that differ by rounding alone.
    twins = np.concatenate([pivots, pivots * (1 + 2e-16), pivots[:1]])
    assert pairs_lost(unit, twins, radius, batch) == (found, 0)


def test_error_bounds_hold():
    rng = np.random.default_rng(2)
    unit = embeddings._unit(rng.normal(size=(300, 24)) + 2 * rng.normal(size=24))
    codes, scale, error = embeddings.quantise(unit)
    near = (codes.astype("f8") @ codes.T.astype("f8")) * scale[:, None] * scale
    bound = error[:, None] + error + 3 * error[:, None] * error
    assert (np.abs(unit @ unit.T - near) <= bound).all()


def test_loser_tree():
    rng = random.Random(3)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted(rng.randrange(20) for _ in range(rng.randrange(9))) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


@pytest.fixture(scope="module")
def pages(spark):
    big = "<p>" + "y" * 200
    rows = [(1, "http://www.A.com/x?B=1", None), (2, None, "short"), (3, "http://b.com:99/", "short"), (4, "not a url", big), (5, "http://[bad", big), (6, "http://b.com/\r\nX: 1", "é" * 50), (7, "u", "é" * 50), (8, "http://b.com/", "z" * 300_000), (None, "http://c.com/", big), (9, "http://c.com/", ""), (4, "http://d.com/", big)]
    return spark.createDataFrame([(*r, 1, "q") for r in rows], "page_id long, url string, html string, offset int, digest string")


def test_warc_round_trip(pages):
    got = warc.archive_and_read(pages, archive_bytes=200).collect()
    source = pages.collect()
    assert len(got) == len(source) and all(r.sound for r in got)
    payload = {r.page_id: (r.html or "").encode() for r in source}
    for r in got:
        assert (r.payload_bytes, r.payload_digest) == (len(payload[r.page_id]), hashlib.sha256(payload[r.page_id]).hexdigest())
        original = {5: 4, 7: 6}.get(r.page_id)
        assert (r.record_type, r.refers_to) == (("revisit", original) if original else ("response", None))
    order = sorted(got, key=lambda r: r.position)
    assert [r.position for r in order] == list(range(len(got)))
    keys = [(r.urlkey, r.captured is not None, r.captured or 0) for r in order]
    assert keys == sorted(keys)
    assert warc.urlkey("http://www.A.com/x?B=1") == "com,a)/x?b=1"
    assert warc.archive_and_read(pages.limit(0)).count() == 0


def test_broken_archive_is_an_error(tmp_path):
    import gzip
    import io

    data = gzip.compress(warc.record(1, "http://a.com/", 0, b"x" * 500, "d", None))
    assert len(list(warc.members(io.BytesIO(data + data), 7))) == 2
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(data[:-9])))
    with pytest.raises(ValueError):
        warc.parse(b"nothing\r\n\r\n")


def test_language(spark):
    rng = random.Random(4)
    make = {"xx": "abcde", "yy": "vwxyz"}
    rows = [(i, " ".join("".join(rng.choice(make[lang]) for _ in range(5)) for _ in range(30)), lang) for i in range(60) for lang in [rng.choice(["xx", "yy"])]]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!"), (4, "abcab cabe"), (5, "zyx" * 40_000), (6, "é"), (4, "abcab cabe")], "doc_id long, text string").selectExpr("*", "'x' as score", "1 as lang_pred")
    got = language.identify(odd, language.fit(train)).collect()
    assert [(r.doc_id, r.lang_pred) for r in sorted(got, key=lambda r: r.doc_id) if r.doc_id != 6] == [(1, "und"), (2, "und"), (3, "und"), (4, "xx"), (4, "xx"), (5, "yy")]
    assert all(0 <= r.score <= 1 for r in got) and all(r.score == 0 for r in got if r.lang_pred == "und")
    assert language.fit(train.selectExpr("doc_id", "text", "cast(null as string) lang")) is None
    assert {r.lang_pred for r in language.identify(odd, None).collect()} == {"und"}
    assert language.identify(odd.limit(0), language.fit(train)).count() == 0


def test_language_on_held_out_documents(spark):
    path = "/root/testdata/sf0.01"
    got = QUERIES["op10_language"](spark, path).join(spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out and lang_pred <> 'und'").collect()
    assert len(got) > 200
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)
