import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lumagrid.llm import packing as P
from lumagrid.llm.queries import op11_exact_complement_packing, tokenizer_path
from lumagrid.llm.shared import table
from lumagrid.llm.word_tokens import word_bpe

SF = "/root/testdata/sf0.001"
PATH = tokenizer_path("word_bpe_49k.json")


def best_fit_decreasing(lengths, size):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits, key=rooms.__getitem__)] -= n
        else:
            rooms.append(size - n)
    return len(rooms)


def laid_out(rows, size):
    """Checks that each sequence is gapless from 0 and not over size; the number of sequences."""
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= size
    return len(by)


def library(docs, size=2048, end=0):
    tokenizer = Tokenizer.from_file(PATH)
    out = []
    for doc, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]
        out += [(doc, k // size, k, len(ids[k : k + size]), zlib.crc32(np.array(ids[k : k + size], "<u4").tobytes())) for k in range(0, len(ids), size)]
    return out


def test_query_equals_library_and_packs_well(spark):
    rows = op11_exact_complement_packing(spark, SF).collect()
    want = library([(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()])
    assert sorted(tuple(r)[:5] for r in rows) == sorted(want)
    n = laid_out(rows, 2048)
    assert -(-sum(w[3] for w in want) // 2048) <= n <= best_fit_decreasing([w[3] for w in want], 2048)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120), st.integers(40, 60))
def test_plan_uses_every_piece_once(lengths, size):
    counts = np.bincount(np.array(lengths, int), minlength=size + 1)
    patterns = P.plan(counts, size)
    used = np.zeros(size + 1, int)
    for copies, content in patterns:
        assert copies > 0 and sum(n * k for n, k in content) <= size
        for n, k in content:
            used[n] += copies * k
    assert (used == counts).all()
    told = P.slots(patterns)
    seen = {}
    for n in np.flatnonzero(counts):
        at = np.arange(counts[n])
        for s, o in zip(*(x.tolist() for x in P.place(np.full(len(at), n), at, told))):
            seen.setdefault(s, []).append((o, int(n)))
    for parts in seen.values():
        ends = np.cumsum([0, *[n for _, n in sorted(parts)]])
        assert [o for o, _ in sorted(parts)] == ends[:-1].tolist() and ends[-1] <= size
    assert len(seen) == sum(c for c, _ in patterns)


def test_complements_fill_exactly():
    counts = np.zeros(2049, int)
    counts[[1500, 548, 1400, 300, 348, 1200, 100, 200]] = 7
    counts[548] += 0
    patterns = P.plan(counts)
    full = [c for c, content in patterns if sum(n * k for n, k in content) == 2048]
    assert sum(full) == 14  # 1500 + 548 and 1400 + 348 + 300
    rest = np.zeros(2049, int)
    rest[[333, 777, 900]] = 1000
    assert sum(c for c, _ in P.plan(rest)) == 1000
    rng = np.random.default_rng(1)
    many = np.bincount(np.minimum(rng.lognormal(6, 1, 20000).astype(int) + 1, 2048), minlength=2049)
    least = -(-int((many * np.arange(2049)).sum()) // 2048)
    assert sum(c for c, _ in P.plan(many)) <= 1.002 * least


def test_edges(spark):
    long = "Wörter and words, 12 " * 9000
    rows = [(1, None, 1, "a"), (None, "one two", 2, "b"), (3, "", 3, "c"), (3, "", 4, "d"), (None, "one two", 5, "e"), (6, long, 6, "f"), (7, "<|endoftext|> T̈x", 7, "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id int, part string")
    got = P.pack(docs, PATH, tokens=True).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(library([r[:2] for r in rows]), key=str)
    laid_out(got, 2048)
    assert P.pack(docs.where("false"), PATH).count() == 0
    joined = P.sequences(P.pack(docs, PATH, size=64, tokens=True)).collect()
    assert all(r.n_tokens <= 64 and len(r.ids) == 4 * r.n_tokens and sum(p.length for p in r.parts) == r.n_tokens for r in joined)
    back = {}
    for r in joined:
        ids = np.frombuffer(r.ids, "<u4")
        for p in r.parts:
            back.setdefault(p.doc_id, {})[p.start, r.sequence_id] = ids[p.offset : p.offset + p.length].tolist()
    assert [i for _, x in sorted(back[6].items()) for i in x] == [*Tokenizer.from_file(PATH).encode(long, add_special_tokens=False).ids, 0]


LETTERS = st.sampled_from(list("abcXYZé'’ .,-_<>|01\n\t ") + ["́", "ß", "É", "日", "İ", "T̈", "'s", "'LL", "½", "×"])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(LETTERS, max_size=30).map("".join), max_size=6))
def test_words_equal_library(texts):
    data = [t.encode() for t in texts]
    ids, n = word_bpe(PATH).encode(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    own = [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] if len(n) else []
    assert own == [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]


def test_other_files_are_encoded_by_the_library():
    path = tokenizer_path()
    data = "Hello  world, don't".encode()
    ids, n = word_bpe(path).encode(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    assert ids.tolist() == Tokenizer.from_file(path).encode(data.decode(), add_special_tokens=False).ids and n.tolist() == [len(ids)]
    assert not len(word_bpe(path).encode(np.zeros(0, np.uint8), np.array([0, 0]))[0])
