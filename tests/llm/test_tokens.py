import hashlib
import random
import zlib

import numpy as np
import pytest

from lumagrid.llm.bpe import ByteBpe, decode_documents, encode_documents, halves, tree
from lumagrid.llm.queries import tokenizer_path
from lumagrid.llm.token_files import decode_block, encode_block, frequencies, read_range, read_tokens, symbols, write_tokens

PIECES = ["a", "b", "the", " ", "  ", "\n", "'", "'s", "'re", "1", "23", ".", "!!", "é", "ß", "日本", "語", "😀", "\u00a0", "<|endoftext|>", "<|", "|>", "Zz", "\t", "aaaaaaa", "×"]


@pytest.fixture(scope="module")
def bpe():
    return ByteBpe(tokenizer_path())


def reference(bpe, text):
    return bpe.tokenizer.encode(text, add_special_tokens=False).ids


def test_encoder_and_tree_equal_the_library(bpe):
    rng = random.Random(1)
    for _ in range(400):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 60)))
        data = text.encode()
        ids, _ = bpe.encode(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        assert ids.tolist() == reference(bpe, text)
        assert bpe.decode(ids) == data
        for limit in (8, 32):
            assert tree(bpe, [bpe.encode_one(p) for p in halves(data, limit)]).tolist() == reference(bpe, text)


@pytest.mark.parametrize("text", ["a" * 3000, "日本語" * 800, " " * 2000 + "x", "'" * 900, "0123456789" * 300, "aaab" * 300 + "'re" * 200])
def test_tree_on_unsplit_text(bpe, text):
    assert tree(bpe, [bpe.encode_one(p) for p in halves(text.encode(), 200)]).tolist() == reference(bpe, text)


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, ids string")


def test_documents(spark, bpe):
    long = " ".join(f"word{k}é" for k in range(2000))
    rows = [(1, "hello world", 0, "x"), (2, None, 0, "x"), (3, "", 0, "x"), (4, long, 0, "x"), (4, long, 0, "x"), (None, "a<|endoftext|>b", 0, "x")]
    out = encode_documents(table(spark, rows), tokenizer_path(), long=1000, decode=True).collect()
    got = sorted((r.doc_id or 0, bytes(r.ids), r.decoded) for r in out)
    want = sorted((i or 0, np.array(reference(bpe, t or ""), "<u4").tobytes(), t or "") for i, t, *_ in rows)
    assert got == want
    again = decode_documents(encode_documents(table(spark, rows[:4]), tokenizer_path()), tokenizer_path())
    assert {r.doc_id: r.decoded for r in again.collect()} == {i: t or "" for i, t, *_ in rows[:4]}
    assert encode_documents(table(spark, []), tokenizer_path()).count() == 0


def test_blocks_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 5, 1000, 5000):
        ids = rng.zipf(1.5, n) % 100
        freq = frequencies(np.bincount(ids, minlength=100), 12)
        states, at, words = encode_block(ids, freq, lanes=16, every=8, bits=12)
        s = symbols(freq)
        assert decode_block(n, states, at, words, freq, s, 16, 8, 12).tolist() == ids.tolist()
        if n == 5000:
            assert decode_block(n, states, at, words, freq, s, 16, 8, 12, checkpoint=3, until=5).tolist() == ids[3 * 128 : 5 * 128].tolist()


def test_files(spark, bpe, tmp_path):
    rows = [(k * 7 % 50, f"text number {k} é" if k % 5 else None, 0, "x") for k in range(50)]
    write_tokens(table(spark, rows), str(tmp_path / "f"), tokenizer_path(), block=100)
    got = {r.doc_id: r for r in read_tokens(spark, str(tmp_path / "f")).collect()}
    start = 0
    for i, t, *_ in sorted(rows):
        ids = np.array(reference(bpe, t or "") + [0], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32, bytes(got[i].ids)) == (start, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes())
        start += len(ids)
    write_tokens(table(spark, []), str(tmp_path / "e"), tokenizer_path())
    assert read_tokens(spark, str(tmp_path / "e")).count() == 0


def test_ranges_begin_at_checkpoints(spark, bpe, tmp_path):
    rows = [(k, f"text number {k} with some words é", 0, "x") for k in range(60)]
    write_tokens(table(spark, rows), str(tmp_path / "f"), tokenizer_path(), lanes=8, every=4, block=150)
    whole = np.concatenate([np.frombuffer(r.ids, "<u4") for r in read_tokens(spark, str(tmp_path / "f")).orderBy("start").collect()])
    for a, b in ((0, len(whole)), (5, 6), (100, 333), (len(whole) - 1, len(whole)), (31, 33)):
        got = np.concatenate([np.frombuffer(r.ids, "<u4") for r in read_range(spark, str(tmp_path / "f"), a, b).orderBy("start").collect()])
        assert got.tolist() == whole[a:b].tolist()


def test_rows_of_one_id_and_without_one(spark, bpe, tmp_path):
    rows = [(5, "one two", 0, "x"), (5, "three", 0, "x"), (None, "four", 0, "x"), (None, None, 0, "x"), (5, "one two", 0, "x")]
    write_tokens(table(spark, rows), str(tmp_path / "f"), tokenizer_path())
    got = read_tokens(spark, str(tmp_path / "f")).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, 5, 5, 5] and [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    assert sorted(bytes(r.ids) for r in got) == sorted(np.array(reference(bpe, t or "") + [0], "<u4").tobytes() for _, t, *_ in rows)


def test_a_broken_block_is_noticed(spark, tmp_path):
    write_tokens(table(spark, [(1, "some words to write", 0, "x")]), str(tmp_path / "f"), tokenizer_path())
    from pyspark.sql import functions as F

    bad = spark.read.parquet(str(tmp_path / "f/blocks")).withColumn("crc", F.col("crc") + 1)
    bad.write.parquet(str(tmp_path / "g/blocks"))
    spark.read.parquet(str(tmp_path / "f/frequencies")).write.parquet(str(tmp_path / "g/frequencies"))
    with pytest.raises(Exception, match="checksum"):
        read_tokens(spark, str(tmp_path / "g")).collect()


def test_digests(spark):
    from lumagrid.llm.queries import queries

    r = queries()["op1_bpe_roundtrip"](spark, "/root/testdata/sf0.001")
    docs = {d.doc_id: d.text for d in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert {x.doc_id: x.decoded_sha256 for x in r.collect()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in docs.items()}
