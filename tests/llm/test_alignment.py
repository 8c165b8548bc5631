import hashlib
from collections import Counter

import numpy as np
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lumagrid.llm import alignment as A
from lumagrid.llm.bpe import byte_letters
from lumagrid.llm.queries import op12_tokenizer_alignment, tokenizer_path
from lumagrid.llm.shared import table
from lumagrid.llm.word_tokens import sentences

SF = "/root/testdata/sf0.001"
BYTE, PIECE = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


def brute(docs):
    """Rows of (doc, text) as the contract has them, token by token."""
    byte = Tokenizer.from_file(BYTE)
    byte.encode_special_tokens = True
    piece = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    letter = {c: b for b, c in enumerate(byte_letters())}

    def a_bytes(i):
        return bytes(letter[c] for c in byte.id_to_token(i))

    def b_bytes(i):
        p = piece.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if piece.is_byte(i) else p.replace("▁", " ").encode()

    found = []
    for doc, text in docs:
        a = byte.encode(" " + text, add_special_tokens=False).ids if text else []
        b = piece.encode(text) if text else []
        a_to, b_to = (np.cumsum([len(f(i)) for i in ids]).tolist() for f, ids in ((a_bytes, a), (b_bytes, b)))
        if not text or b"".join(map(a_bytes, a)) != (" " + text).encode() or b"".join(map(b_bytes, b)) != (" " + text).encode():
            found.append((doc, [], [], [], []))
            continue
        links, i, j = [], 0, 0
        while i < len(a) and j < len(b):
            links.append((a[i], b[j]))
            end = min(a_to[i], b_to[j])
            i, j = i + (a_to[i] == end), j + (b_to[j] == end)
        groups, at = [], (0, 0)
        for e in sorted(set(a_to) & set(b_to)):
            to = (a_to.index(e) + 1, b_to.index(e) + 1)
            groups.append(",".join(map(str, a[at[0] : to[0]])) + "|" + ",".join(map(str, b[at[1] : to[1]])))
            at = to
        found.append((doc, a, b, groups, links))
    counts = Counter(p for *_, links in found for p in set(links))
    most = {}
    for (a, _), n in counts.items():
        most[a] = max(n, most.get(a, 0))
    return [(doc, len(a), len(b), len(g), len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(";".join(g).encode()).hexdigest() if a else "") for doc, a, b, g, links in found]


ODD = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "two  spaces and ▁ a mark"), (None, "plain words"), (7, "<|endoftext|> <s> é日本 \x00 12"), (8, " lead and trail "), (9, "words " * 3000 + "Ünïcödé"), (10, " "), (11, "x" * 5000)]


def test_query_equals_brute_force(spark):
    want = brute([(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()])
    got = op12_tokenizer_alignment(spark, SF)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_edges_in_many_runs_and_rounds(spark):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in ODD] * 3, "doc_id long, text string, run string, radix int").repartition(5)
    want = sorted(brute(ODD * 3), key=str)
    assert sorted(map(tuple, A.align(docs, BYTE, PIECE).collect()), key=str) == want
    assert sorted(map(tuple, A.align(docs, BYTE, PIECE, links=1, fan=2, answered=2).collect()), key=str) == want
    assert A.align(docs.where("false"), BYTE, PIECE).count() == 0
    assert [tuple(r)[1:] for r in A.align(docs.where("text = ''").limit(1), BYTE, PIECE).collect()] == [(0, 0, 0, 0, 0, 0, "")]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.dictionaries(st.integers(0, 60), st.integers(1, 9), max_size=40), max_size=6), st.integers(1, 9))
def test_merge_adds_up(runs, block):
    lists = [(np.array(sorted(r), np.uint64), np.array([r[k] for k in sorted(r)], np.int64)) for r in runs]
    out = [(int(k), int(n)) for keys, counts in A.merged(lists, block) for k, n in zip(keys, counts)]
    total = Counter()
    for r in runs:
        total.update(r)
    assert out == sorted(total.items())


def test_best_takes_ties():
    keys = np.array([1 << 32 | 5, 1 << 32 | 6, 1 << 32 | 9, 2 << 32 | 1], np.uint64)
    assert A.best(keys, np.array([4, 7, 7, 1])).tolist() == [False, True, True, True]
    assert A.unpacked_keys(A.packed_keys(keys)).tolist() == keys.tolist()


LETTERS = st.sampled_from([*"abcZ é'.,-_<>|01\n\t  ", "́", "日", "<s>", "<0x41>", "…"])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(LETTERS, min_size=1, max_size=30).map("".join), max_size=6))
def test_pieces_equal_library(texts):
    data = [(" " + t).encode() for t in texts]
    ids, n = sentences(PIECE).encode(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    own = [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] if len(n) else []
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    assert own == [model.encode(t) for t in texts]
