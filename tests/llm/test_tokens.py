import hashlib
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera.llm import packing, piece_bpe, token_store, tokens
from tessera.llm.queries import tokenizer_path

BYTES = tokenizer_path("byte_bpe_50k.json")
PIECES = tokenizer_path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "  ", "\n", " a", "a ", "a  b", "a\n\nb", "a\tb c", "it's we're\nI'll 123 4a", "x<|endoftext|>y", "日本語 text 🙂",
    "café é", "a b", "▁x ▁▁y", "long" * 9000, "word " * 5000, "a\r\nb", "same", "same", "\u0000 nul", "1 22 333\n4444 !!! ?",
    "the&&& ha%%% an,### it's### 'll o'''s a'tt \n x\t\ty  \n\n  z ¼½²x ×÷ª \u00a0b", "b\u00adc", "c \x85 d", "<|endo Ǆ'S 12ab3'd ", "\x1c a", "a \u2003 b",
]


@pytest.fixture(scope="module")
def docs(spark):
    # Extra columns that clash with what the operators make.
    rows = [(i, t, 7, "x", 3) for i, t in enumerate(ODD)] + [(100, "repeated row", 1, "y", 2)] * 3
    return spark.createDataFrame(rows, "doc_id long, text string, start int, ids string, n_tokens int").repartition(3)


def library_ids(texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BYTES)
    return [tok.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_words_encode_as_whole_texts(spark, small):
    texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect()] + [x or "" for x in ODD]
    enc = tokens.Encoder(BYTES)
    assert enc.by_token
    for text, ids in zip(texts, library_ids(texts), strict=True):
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("length", [2048, 7])
def test_packing(spark, docs, length):
    if length == 7:
        docs = docs.where("length(text) < 1000 or text is null")
    rows = packing.pack(docs, BYTES, length, 1).collect()
    source = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda x: (x[0], x[1] or ""))
    stream = [i for ids in library_ids([t for _, t in source]) for i in ids + [1]]
    rows.sort(key=lambda r: (r.sequence_id, r.offset))
    flat = [i for r in rows for i in np.frombuffer(r.ids, "<u4").tolist()]
    assert flat == stream
    at = 0
    for r in rows:
        assert r.sequence_id * length + r.offset == at and 0 < r.length <= length - r.offset
        assert r.ids_crc32 == crc(stream[at : at + r.length])
        assert r.is_first == (r.start == 0) and r.is_last == (r.start + r.length == r.doc_tokens)
        at += r.length


def shuffled_bytes(spark):
    jvm = spark._jvm
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return {s.stageId(): s.shuffleWriteBytes() for s in (stages.apply(k) for k in range(stages.size()))}


def test_packing_shuffles_no_texts(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(i, rng.bytes(10_000).hex()) for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    settings = ("spark.sql.parquet.columnarReaderBatchSize", "spark.sql.execution.arrow.maxRecordsPerBatch")
    seen, before = set(shuffled_bytes(spark)), [spark.conf.get(k) for k in settings]
    assert packing.pack(spark.read.parquet(str(tmp_path / "docs")), BYTES, with_ids=False).agg(F.sum("length")).first()[0] > 200 * 5_000
    # The texts have 4 MB.
    assert sum(n for k, n in shuffled_bytes(spark).items() if k not in seen) < 200_000
    assert [spark.conf.get(k) for k in settings] == before


def test_packing_over_many_files_and_ranges(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANGE", 300)
    rng = np.random.default_rng(6)
    texts = [" ".join(str(x) for x in rng.integers(0, 9999, n)) for n in rng.integers(0, 40, 3000)]
    rows = [(None if i % 500 == 7 else int(i), texts[i]) for i in rng.permutation(3000)] + [(5, texts[5])] * 700
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(packing.pack(docs, BYTES, 64, 1).collect(), key=lambda r: (r.sequence_id, r.offset))
    starts = [r for r in got if r.is_first]
    assert [r.doc_id for r in starts] == sorted((i for i, _ in rows), key=lambda i: -1 if i is None else i)
    stream = b"".join(bytes(r.ids) for r in got)
    assert [r.sequence_id * 64 + r.offset for r in got] == [0, *np.cumsum([r.length for r in got])[:-1]]
    ends = np.cumsum([r.doc_tokens for r in starts])
    found = [(r.doc_id, stream[4 * (e - r.doc_tokens) : 4 * e]) for r, e in zip(starts, ends, strict=True)]
    want = [(i, np.array([*ids, 1], "<u4").tobytes()) for (i, _), ids in zip(rows, library_ids([t for _, t in rows]), strict=True)]
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    assert sorted(found, key=key) == sorted(want, key=key)


def test_sequences_are_padded_at_the_end_only(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    pieces = packing.pack(docs, BYTES, 3, 1)
    assert packing.sequence(pieces, 0, 3).tolist() == library_ids(["a b c"])[0]
    assert packing.sequence(pieces, 1, 3, pad_id=9).tolist() == [1, 1, 9]


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert packing.pack(none, BYTES).count() == 0
    assert piece_bpe.encode_pieces(none, PIECES).count() == 0
    assert token_store.round_trip(none, BYTES).count() == 0


def test_token_files(spark, docs, tmp_path):
    path = str(tmp_path / "tokens")
    token_store.write_tokens(docs, path, BYTES, 0, page_rows=2)
    rows = token_store.checksums(token_store.read_tokens(spark, path)).orderBy("start").collect()
    source = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda x: (x[0], x[1] or ""))
    at = 0
    for r, (doc, _), ids in zip(rows, source, library_ids([t for _, t in source]), strict=True):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc, at, len(ids) + 1, crc(ids + [0]))
        at += r.n_tokens
    read = token_store.read_tokens(spark, path, metadata_only=True)
    assert "ids" not in read.columns and read.count() == len(source)


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_file_format(spark, docs, tmp_path, encoding):
    path = tmp_path / "tokens"
    token_store.write_tokens(docs, str(path), BYTES, 0, encoding)
    seen = 0
    for file in path.glob("*.parquet"):
        meta = pq.ParquetFile(file).metadata
        for g in range(meta.num_row_groups):
            for c in range(meta.num_columns):
                column = meta.row_group(g).column(c)
                assert column.has_offset_index
                wanted = "RLE_DICTIONARY" if encoding == "dictionary" and column.path_in_schema.startswith("ids") else "DELTA_BINARY_PACKED"
                assert wanted in column.encodings, (column.path_in_schema, column.encodings)
                seen += 1
    assert seen
    with pytest.raises(ValueError):
        token_store.write_tokens(docs, str(path), BYTES, 0, "plain")


def check_pieces(rows, texts):
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=PIECES)
    for r in rows:
        ids = sp.encode(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
        assert r.agenda_agrees, texts[r.doc_id]


def test_pieces(spark, docs, small):
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = piece_bpe.encode_pieces(docs, PIECES).collect()
    assert len(rows) == docs.count()
    check_pieces([r for r in rows if "\0" not in (texts[r.doc_id] or "")], texts)
    table = spark.read.parquet(f"{small}/documents.parquet")
    check_pieces(piece_bpe.encode_pieces(table, PIECES).collect(), {r.doc_id: r.text for r in table.collect()})


def test_agenda_alone_matches_the_library():
    from sentencepiece import SentencePieceProcessor

    sp, enc = SentencePieceProcessor(model_file=PIECES), piece_bpe.PieceEncoder(PIECES)
    for text in ["hello world", "  two  spaces ", "naïve café 🙂 日本", "aaaaaaaaaaaaaaaa", "1234567890" * 30, "don't stop", "x" * 3000]:
        assert enc.agenda("▁" + text.replace(" ", "▁")) == sp.encode(text)


def test_columns_are_as_promised(spark, docs):
    assert dict(packing.pack(docs, BYTES, with_ids=False).dtypes)["sequence_id"] == "bigint"
    assert docs.select(F.max("start")).first()[0] == 7
