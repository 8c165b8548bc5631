"""Byte-level BPE encoding and decoding over documents, with tree concatenation for long texts.

A text longer than a limit is cut into halves of halves, wherever the cut may fall; the pieces are encoded in parallel
and joined again in a tree. At each join a window of tokens on both sides is decoded and encoded anew, and grows until
its tokens agree with the left side before the cut and with the right side after it. Two valid encodings that share
tokens on both sides of a window are a valid encoding of the whole, since BPE is valid when all neighbours are.

The vocabulary is that of a tokenizers file with byte-level BPE; its path is a parameter.

Defined results: null text encodes as the empty text; rows of one id are encoded each on its own; an empty table gives
an empty result; a special token's string in a text is that token, as in the library's default.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumagrid.llm import text as T
from lumagrid.llm.shared import partitions

#: Bytes of text from which on a document is halved.
LONG = 1 << 15
#: Bytes of text that are encoded at once.
SLICE = 1 << 19
#: Distinct words that a worker keeps the tokens of.
KEPT_WORDS = 200_000

_OTHER, _LETTER, _DIGIT, _SPACE, _MARK, _QUOTE = range(6)
_KIND = np.zeros(256, np.uint8)
_KIND[65:91] = _KIND[97:123] = _LETTER
_KIND[48:58] = _DIGIT
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACE
_KIND[[c for c in range(33, 127) if not chr(c).isalnum()]] = _MARK
_KIND[39] = _QUOTE
#: Pairs of kinds between which the library's split pattern always splits, whatever stands around them.
_CUT = np.zeros((6, 6), bool)
for _x, _ys in ((_LETTER, (_DIGIT, _SPACE, _MARK, _QUOTE)), (_DIGIT, (_LETTER, _SPACE, _MARK, _QUOTE)), (_MARK, (_LETTER, _DIGIT, _SPACE)), (_QUOTE, (_DIGIT, _SPACE))):
    _CUT[_x, list(_ys)] = True
_CUT = _CUT.ravel()


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary: printable bytes for themselves, the others from code point 256 on."""
    kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    moved = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(moved)) for b in range(256)]


def _word_encoder(told: dict):
    """An encoder of words that are already split, from a tokenizers file; None where ids do not follow the order of merges.

    Splitting and joining below hold for byte-level BPE with the usual split pattern only, so other files are refused.
    """
    split, model = told.get("pre_tokenizer") or {}, told["model"]
    if told.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or model.get("type") != "BPE" or model.get("dropout") or model.get("ignore_merges"):
        raise ValueError("not a file of byte-level BPE with the usual split pattern and no normalizer")
    import tiktoken

    vocab, to_byte = model["vocab"], {c: b for b, c in enumerate(byte_letters())}
    special = {t["content"] for t in told.get("added_tokens", ())}
    ranks = {bytes(to_byte[c] for c in k): i for k, i in vocab.items() if k not in special}
    merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if merged != sorted(set(merged)) or any(bytes([b]) not in ranks for b in range(256)) or len(ranks) != 256 + len(merged):
        return None
    return tiktoken.Encoding("words", pat_str=r" \p{L}+", mergeable_ranks=ranks, special_tokens={})


class ByteBpe:
    """Encoder and decoder over batches of UTF-8 bytes; ids are as the tokenizers library gives them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            self.words = _word_encoder(json.load(file))
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = {t.content.encode(): i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        to_byte = {c: b for b, c in enumerate(byte_letters())}
        size = self.tokenizer.get_vocab_size(True)
        parts = []
        for i in range(size):
            token = self.tokenizer.id_to_token(i) or ""
            parts.append(token.encode() if token.encode() in self.special else bytes(to_byte[c] for c in token))
        self.bytes = np.frombuffer(b"".join(parts), np.uint8)
        self.length = np.array([len(p) for p in parts], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.length)])[:-1]
        self._forget()

    def _forget(self):
        self.known = np.zeros(0, np.uint64)  # word hashes in order
        self.place = np.zeros(0, np.int64)  # of each in the lists below
        self.pool, self.pool_at, self.pool_n = (np.zeros(0, t) for t in (np.uint32, np.int64, np.int64))

    def _learn(self, hashes: np.ndarray, joined: bytes, starts: np.ndarray, ends: np.ndarray, plain: np.ndarray) -> None:
        """Keep the tokens of new words; plain ones (a space and letters) are encoded in one text, which splits at them."""
        ids, n = np.zeros(0, np.uint32), np.zeros(len(hashes), np.int64)
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        if plain.any():
            data = b"".join([joined[a:b] for a, b in zip(starts[plain].tolist(), ends[plain].tolist())])
            ids = np.array(self.words.encode_ordinary(data.decode()) if self.words else self.tokenizer.encode_batch_fast([data.decode()], add_special_tokens=False)[0].ids, np.uint32)
            edge = np.searchsorted(np.cumsum(self.length[ids]), np.cumsum((ends - starts)[plain])) + 1
            n[plain] = np.diff(edge, prepend=0)
        rest = [joined[a:b].decode("utf-8", "replace") for a, b in zip(starts[~plain].tolist(), ends[~plain].tolist())]
        if rest:
            own = [e.ids for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)]
            n[~plain] = [len(x) for x in own]
            ids = np.concatenate([ids, np.array([i for x in own for i in x], np.uint32)])
        base = len(self.pool_n)
        self.pool_at = np.concatenate([self.pool_at, len(self.pool) + np.cumsum(n[order]) - n[order]])
        self.pool, self.pool_n = np.concatenate([self.pool, ids]), np.concatenate([self.pool_n, n[order]])
        hashes = hashes[order]
        up = np.argsort(hashes)
        at = np.searchsorted(self.known, hashes[up])
        self.known, self.place = np.insert(self.known, at, hashes[up]), np.insert(self.place, at, base + up)

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of a slice one after another, and the number of ids of each row."""
        joined = buf.tobytes()
        if any(s in joined for s in self.special):
            return self._encode_special(joined, off)
        n_rows = len(off) - 1
        if not len(buf):
            return np.zeros(0, np.uint32), np.zeros(n_rows, np.int64)
        kind = _KIND[buf]
        lead = np.flatnonzero(buf[:-1] == 0xC3)
        lead = lead[(buf[lead + 1] & 0xC0 == 0x80) & (buf[lead + 1] != 0x97) & (buf[lead + 1] != 0xB7)]  # Latin letters
        kind[lead] = kind[lead + 1] = _LETTER
        cut = np.zeros(len(buf), bool)
        cut[1:] = _CUT[kind[:-1] * 6 + kind[1:]]
        cut[off[:-1][off[:-1] < len(buf)]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(buf))
        codes, found = pd.factorize(T.hashes(buf, starts, ends))
        if len(self.known) + len(found) > KEPT_WORDS + len(found) // 2:
            self._forget()
        first = np.empty(len(found), np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        on = np.minimum(np.searchsorted(self.known, found), max(0, len(self.known) - 1))
        new = self.known[on] != found if len(self.known) else np.ones(len(found), bool)
        if new.any():
            odd = np.concatenate([[0], np.cumsum(kind != _LETTER)])
            a, b = starts[first[new]], ends[first[new]]
            self._learn(found[new], joined, a, b, (buf[a] == 32) & (b - a > 1) & (odd[b] == odd[np.minimum(a + 1, b)]))
            on = np.searchsorted(self.known, found)
        at = self.place[on][codes]
        pool, pool_at, pool_n = self.pool, self.pool_at, self.pool_n
        n = pool_n[at]
        total = np.concatenate([[0], np.cumsum(n)])
        ids = pool[np.arange(total[-1]) - np.repeat(total[:-1], n) + np.repeat(pool_at[at], n)]
        rows = np.searchsorted(starts, off)
        return ids, total[rows[1:]] - total[rows[:-1]]

    def _encode_special(self, joined: bytes, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        split = re.compile(b"(" + b"|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + b")")
        parts = [split.split(joined[a:b]) for a, b in zip(off[:-1], off[1:])]
        plain = [p for row in parts for p in row[::2]]
        ids, n = self.encode(np.frombuffer(b"".join(plain), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in plain])]).astype(np.int64))
        own, out, counts = iter(np.split(ids, np.cumsum(n)[:-1])), [], []
        for row in parts:
            pieces = [next(own) if k % 2 == 0 else np.array([self.special[p]], np.uint32) for k, p in enumerate(row)]
            out += pieces
            counts.append(sum(map(len, pieces)))
        return np.concatenate(out), np.array(counts, np.int64)

    def encode_one(self, data: bytes) -> np.ndarray:
        if len(data) < 2000:
            return np.array(self.tokenizer.encode(data.decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32)
        return self.encode(np.frombuffer(data, np.uint8), np.array([0, len(data)], np.int64))[0]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for."""
        n = self.length[ids]
        total = np.concatenate([[0], np.cumsum(n)])
        return self.bytes[np.arange(total[-1]) - np.repeat(total[:-1], n) + np.repeat(self.first[ids], n)].tobytes()

    def join(self, left: np.ndarray, right: np.ndarray, window: int = 16) -> np.ndarray:
        """Encoding of two texts one after the other, from the encodings of each."""
        if not len(left) or not len(right):
            return np.concatenate([left, right])
        far = max([16, *(len(s) + 3 for s in self.special)])  # an end of text can change how so many bytes before it are split
        while True:
            a, b = left[max(0, len(left) - window) :], right[:window]
            whole_left, whole_right = len(a) == len(left), len(b) == len(right)
            data = self.decode(np.concatenate([a, b]))
            # the window starts and ends between characters, and not at a quote, which could split otherwise there
            skip = 0
            sizes = np.concatenate([[0], np.cumsum(self.length[a])])
            while not whole_left and skip < len(a) and (data[sizes[skip]] & 0xC0 == 0x80 or data[sizes[skip]] == 39):
                skip += 1
            spare, back = 0, np.concatenate([[0], np.cumsum(self.length[b][::-1])])
            while not whole_right and spare < len(b) and right[len(b) - spare :].size and self.bytes[self.first[right[len(b) - spare]]] & 0xC0 == 0x80:
                spare += 1
            start, cut, end = int(sizes[skip]), int(sizes[-1]), len(data) - int(back[spare])
            if end > cut > start or whole_left and whole_right:
                mid = self.encode_one(data[start:end])
                if whole_left and whole_right:
                    return mid
                at = start + np.concatenate([[0], np.cumsum(self.length[mid])])
                i = 0 if whole_left else self._agree(mid, at, a, sizes, start, cut - far, whole_left)
                tail = cut + np.concatenate([[0], np.cumsum(self.length[b])])
                j = len(mid) if whole_right else self._agree(mid, at, b, tail, cut, end - far, False, last=True)
                if i is not None and j is not None and at[i] <= at[j]:
                    x = 0 if whole_left else len(left) - len(a) + int(np.searchsorted(sizes, at[i]))
                    y = len(right) if whole_right else int(np.searchsorted(tail, at[j]))
                    return np.concatenate([left[:x], mid[i:j], right[y:]])
            window *= 2

    @staticmethod
    def _agree(mid, at, side, marks, low, high, _whole, last=False):
        """Token of the window between two that the side has at the same place: the last such pair for the left side, the first for the right."""
        low_token = 1  # the first token of a window may start within a word
        k = np.searchsorted(marks, at[:-1])
        k = np.minimum(k, len(side) - 1)
        same = (marks[k] == at[:-1]) & (side[k] == mid) & (at[:-1] >= low) & (at[1:] <= high)
        pair = np.flatnonzero(same[:-1] & same[1:])
        pair = pair[pair >= low_token]
        if not len(pair):
            return None
        return int(pair[0] if last else pair[-1]) + 1


@lru_cache(4)
def byte_bpe(path: str) -> ByteBpe:
    """One encoder for each worker and vocabulary."""
    return ByteBpe(path)


def halves(data: bytes, limit: int) -> list[bytes]:
    """A text cut in two and again until no piece is over limit bytes; cuts fall between characters."""
    if len(data) <= limit:
        return [data]
    mid = len(data) // 2
    while mid < len(data) and data[mid] & 0xC0 == 0x80:
        mid += 1
    return [data] if mid >= len(data) else halves(data[:mid], limit) + halves(data[mid:], limit)


def tree(bpe: ByteBpe, pieces: list[np.ndarray]) -> np.ndarray:
    """Join neighbours pairwise until one encoding is left."""
    while len(pieces) > 1:
        pieces = [bpe.join(*pieces[k : k + 2]) if k + 1 < len(pieces) else pieces[k] for k in range(0, len(pieces), 2)]
    return pieces[0]


def _row(path: str, doc, ids: np.ndarray, text_out: bool):
    return pa.RecordBatch.from_pydict({"doc_id": pa.array([doc], pa.int64()), "n_tokens": pa.array([len(ids)], pa.int64()), "ids": pa.array([T.blob(ids.astype("<u4"))], pa.binary())} | ({"decoded": pa.array([byte_bpe(path).decode(ids).decode("utf-8", "replace")], pa.string())} if text_out else {}))


def encode_documents(docs: DataFrame, path: str, doc: str = "doc_id", text: str = "text", long: int = LONG, decode: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and, if asked for, decoded; one row per row of docs."""
    slim = docs.select(F.col(doc).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = "doc_id long, n_tokens long, ids binary" + ", decoded string" * decode

    def whole(batches):
        bpe = byte_bpe(path)
        for batch in batches:
            for rows, buf, off in T.slices(batch, "text", SLICE):
                ids, n = bpe.encode(buf, off)
                at = np.concatenate([[0], np.cumsum(n)])
                data = pa.py_buffer(T.blob(ids.astype("<u4")))
                columns = [rows.column(0), pa.array(n, pa.int64()), pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(T.blob((at * 4).astype(np.int32))), data])]
                if decode:
                    columns.append(pa.array([bpe.decode(ids[a:b]).decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:])], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids", "decoded"][: len(columns)])

    def cut(batches):
        n, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            for row in range(batch.num_rows):
                pieces = halves(batch.column(1)[row].as_py().encode(), long)
                n += 1
                for k, p in enumerate(pieces):
                    yield pa.RecordBatch.from_pydict({"row": pa.array([part << 40 | n], pa.int64()), "piece": pa.array([k], pa.int32()), "doc_id": batch.column(0).slice(row, 1), "data": pa.array([p], pa.binary())})

    def encode_pieces(batches):
        bpe = byte_bpe(path)
        for batch in batches:
            for rows, buf, off in T.slices(batch, "data", SLICE):
                # a special token's string may be cut in two: such pieces are encoded as plain text and the join puts it right
                ids, n = bpe.encode(buf, off)
                parts = [T.blob(x) for x in np.split(ids, np.cumsum(n)[:-1])]
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), rows.column(2), pa.array(parts, pa.binary())], ["row", "piece", "doc_id", "ids"])

    def concatenate(group: pa.Table) -> pa.Table:
        group = group.sort_by("piece")
        pieces = [np.frombuffer(x, np.uint32) for x in group["ids"].to_pylist()]
        return pa.Table.from_batches([_row(path, group["doc_id"][0].as_py(), tree(byte_bpe(path), pieces), decode)])

    size = F.octet_length("text")
    short = slim.where(size <= long).mapInArrow(whole, schema)
    pieces = slim.where(size > long).mapInArrow(cut, "row long, piece int, doc_id long, data binary")
    pieces = pieces.repartition(partitions(docs), "row", "piece").mapInArrow(encode_pieces, "row long, piece int, doc_id long, ids binary")
    return short.unionByName(pieces.groupBy("row").applyInArrow(concatenate, schema))


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """encoded (doc_id, n_tokens, ids) with decoded, the text that the ids stand for."""

    def work(batches):
        bpe = byte_bpe(path)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("ids"))
            yield batch.append_column("decoded", pa.array([bpe.decode(np.frombuffer(x or b"", "<u4")).decode("utf-8", "replace") for x in ids.to_pylist()], pa.string()))

    return encoded.mapInArrow(work, encoded.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ") + ", decoded string")
