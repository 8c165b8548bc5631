"""Encoders of whole texts that keep the tokens of pieces which recur: word BPE with word ends, and pieces of sentencepiece.

A text is cut where no token can reach across, so that each piece is encoded on its own; distinct pieces of a slice are
encoded once, and kept for later slices up to a bound.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pandas as pd

from lumagrid.llm import text as T
from lumagrid.llm.bpe import _CUT, _KIND, _LETTER, _OTHER, _SPACE, KEPT_WORDS, byte_letters

#: The file layout whose texts may be cut between words (fixed values).
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]


class KeptPieces:
    """Tokens of pieces of text, which are known by their 64-bit hashes."""

    def __init__(self, most: int = KEPT_WORDS):
        self.most = most
        self._forget()

    def _forget(self) -> None:
        self.known, self.at, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def tokens(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, encode) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after another and the number of ids of each; encode does so for pieces that are new."""
        codes, found = pd.factorize(T.hashes(buf, starts, ends))
        if len(self.known) + len(found) > self.most + len(found) // 2:
            self._forget()
        on = np.minimum(np.searchsorted(self.known, found), max(0, len(self.known) - 1))
        new = self.known[on] != found if len(self.known) else np.ones(len(found), bool)
        if new.any():
            first = np.empty(len(found), np.int64)
            first[codes[::-1]] = np.arange(len(codes))[::-1]
            ids, n = encode(starts[first[new]], ends[first[new]])
            order = np.argsort(found[new])
            place = np.searchsorted(self.known, found[new][order])
            self.known = np.insert(self.known, place, found[new][order])
            self.at = np.insert(self.at, place, (len(self.pool) + np.cumsum(n) - n)[order])
            self.n = np.insert(self.n, place, n[order])
            self.pool = np.concatenate([self.pool, ids.astype(np.uint32)])
            on = np.searchsorted(self.known, found)
        n, at = self.n[on][codes], self.at[on][codes]
        total = np.cumsum(n)
        return self.pool[np.arange(total[-1] if len(total) else 0) + np.repeat(at - total + n, n)], n


def _joined(lists: list) -> tuple[np.ndarray, np.ndarray]:
    return np.array([i for x in lists for i in x], np.uint32), np.array([len(x) for x in lists], np.int64)


class WordBpe:
    """Ids of any tokenizers file, as the library gives them without special tokens added; files of word BPE with word ends are encoded piece by piece."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        self.special = [t["content"].encode() for t in told.get("added_tokens", ())]
        self.kept, self.ends, self.words = KeptPieces(), None, None
        split, model = told.get("pre_tokenizer") or {}, told["model"]
        steps = split.get("pretokenizers") or [{}]
        self.by_word = (told.get("normalizer") or {}).get("normalizers") == _NORMAL and len(steps) == 2 and steps[0].get("pattern") == {"Regex": _SPLIT} and steps[0].get("invert") and steps[1].get("type") == "ByteLevel" and not steps[1].get("add_prefix_space") and not steps[1].get("use_regex") and not model.get("dropout") and not any(t.get("normalized") or t.get("lstrip") or t.get("rstrip") for t in told.get("added_tokens", ()))
        if self.by_word:
            self._plain_words(model)

    def _plain_words(self, model: dict) -> None:
        """An encoder of lower-case words that end with a zero byte; none where ids do not follow the order of merges."""
        import tiktoken

        end, to_byte = model.get("end_of_word_suffix") or "", {c: b for b, c in enumerate(byte_letters())}
        ranks = {}
        for k, i in model["vocab"].items():
            if k.encode() in self.special:
                continue
            last = bool(end) and k.endswith(end)
            ranks[bytes(to_byte[c] for c in (k.removesuffix(end) if last else k)) + b"\0" * last] = i
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if not end or merged != sorted(set(merged)) or merged and merged[0] < 512 or any(bytes([b]) not in ranks or ranks[bytes([b])] >= 512 for b in range(256)):
            return
        self.words = tiktoken.Encoding("words", pat_str=r"\p{L}+\x00", mergeable_ranks=ranks, special_tokens={})
        self.ends = np.zeros(max(ranks.values()) + 1, bool)
        self.ends[[i for k, i in ranks.items() if len(k) > 1 and k[-1] == 0]] = True

    def _whole(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return _joined([e.ids for e in self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)])

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of a slice one after another, and the number of ids of each row."""
        data = buf.tobytes()
        if not len(buf):
            return np.zeros(0, np.uint32), np.zeros(len(off) - 1, np.int64)
        if not self.by_word or any(s in data for s in self.special):
            parts = [self._whole([data[a:b]]) if not self.by_word or any(s in data[a:b] for s in self.special) else self._by_word(buf[a:b], np.array([0, b - a])) for a, b in zip(off[:-1], off[1:])]
            return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        return self._by_word(buf, off)

    def _by_word(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n_rows = len(off) - 1
        if not len(buf):
            return np.zeros(0, np.uint32), np.zeros(n_rows, np.int64)
        kind, low = _KIND[buf], T.LOWER[buf]
        lead = np.flatnonzero(buf[:-1] == 0xC3)
        trail = buf[lead + 1]
        lead, trail = (x[(trail & 0xC0 == 0x80) & (trail != 0x97) & (trail != 0xB7)] for x in (lead, trail))  # Latin letters
        kind[lead] = kind[lead + 1] = _LETTER
        low[lead[trail < 0x9F] + 1] += 32
        word = kind != _SPACE
        cut = np.ones(len(buf), bool)
        cut[1:] = _CUT[kind[:-1] * 6 + kind[1:]] | ~word[:-1]
        cut[off[:-1][off[:-1] < len(buf)]] = True
        starts = np.flatnonzero(cut & word)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(n_rows, np.int64)
        last = word.copy()
        last[:-1] &= cut[1:] | ~word[1:]
        ends = np.flatnonzero(last) + 1
        odd = kind != _LETTER
        other = kind == _OTHER
        if other.any():  # lower case is not taken beforehand where marks may combine with letters
            mixed = np.add.reduceat(other, starts, dtype=np.int64) > 0
            for a, b in zip(starts[mixed].tolist(), ends[mixed].tolist()):
                low[a:b] = buf[a:b]
        plain_until = np.concatenate([[0], np.cumsum(odd)])
        low_bytes = low.tobytes()

        def new(a, b):
            plain = plain_until[b] == plain_until[a] if self.words else np.zeros(len(a), bool)
            ids, n = np.zeros(0, np.uint32), np.zeros(len(a), np.int64)
            if plain.any():
                ids = np.array(self.words.encode_ordinary("\0".join([low_bytes[x:y].decode() for x, y in zip(a[plain].tolist(), b[plain].tolist())]) + "\0"), np.uint32)
                n[plain] = np.diff(np.flatnonzero(self.ends[ids]) + 1, prepend=0)
            own, n_own = self._whole([low_bytes[x:y] for x, y in zip(a[~plain].tolist(), b[~plain].tolist())]) if not plain.all() else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
            n[~plain] = n_own
            both, total = np.concatenate([ids, own]), np.cumsum(np.concatenate([n[plain], n_own]))
            at = np.empty(len(a), np.int64)
            at[np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])] = total - np.concatenate([n[plain], n_own])
            end = np.cumsum(n)
            return both[np.arange(end[-1]) + np.repeat(at - end + n, n)], n

        ids, n = self.kept.tokens(low, starts, ends, new)
        total = np.concatenate([[0], np.cumsum(n)])
        rows = np.searchsorted(starts, off)
        return ids, total[rows[1:]] - total[rows[:-1]]


class Sentences:
    """Ids of a sentencepiece model of BPE with byte fallback, for texts that begin with the space which the model puts before them."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        told = sentencepiece_model_pb2.ModelProto()
        told.ParseFromString(self.model.serialized_model_proto())
        self.by_word = told.trainer_spec.model_type == 2 and not told.normalizer_spec.precompiled_charsmap and told.normalizer_spec.add_dummy_prefix and not told.normalizer_spec.remove_extra_whitespaces
        parts = [bytes([int(p.piece[3:5], 16)]) if p.type == 6 else b"" if p.type in (2, 3) else p.piece.replace("▁", " ").encode() for p in told.pieces]
        self.bytes = np.frombuffer(b"".join(parts), np.uint8)
        self.length = np.array([len(p) for p in parts], np.int64)
        self.first = np.cumsum(self.length) - self.length
        self.space = self.model.piece_to_id("▁")
        #: Pairs of bytes between which no piece reaches; a byte past ASCII may be any part of a letter.
        self.cut = np.ones((256, 256), bool)
        for p, kind in zip(parts, told.pieces):
            if kind.type in (1, 4):
                self.cut[list(p[:-1]), list(p[1:])] = False
        self.cut[128:] = self.cut[:, 128:] = False
        self.cut[128:, 32] = not any(re.search(rb"[^ ] ", p) for p in parts)
        self.kept = KeptPieces()

    def _text(self, piece: str) -> list[int]:
        return self.model.encode(piece[1:]) if len(piece) > 1 else [self.space]

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, each of which begins with a space, and the number of ids of each row."""
        data = buf.tobytes()
        if not self.by_word:
            return _joined([self._text(data[a:b].decode("utf-8", "replace")) if b > a else [] for a, b in zip(off[:-1], off[1:])])
        cut = np.ones(len(buf), bool)
        cut[1:] = self.cut[buf[:-1], buf[1:]]
        cut[1:] &= buf[1:] == 32  # the model puts a space before each piece, so pieces begin with one
        cut[off[:-1][off[:-1] < len(buf)]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(buf))[: len(starts)]

        def new(a, b):
            one = b - a == 1
            lists = self.model.encode([data[x:y].decode("utf-8", "replace") for x, y in zip((a + 1).tolist(), b.tolist())])
            return _joined([[self.space] if o else x for o, x in zip(one.tolist(), lists)])

        ids, n = self.kept.tokens(buf, starts, ends, new)
        total = np.concatenate([[0], np.cumsum(n)])
        rows = np.searchsorted(starts, off)
        return ids, total[rows[1:]] - total[rows[:-1]]


@lru_cache(4)
def word_bpe(path: str) -> WordBpe:
    """One encoder for each worker and file."""
    return WordBpe(path)


@lru_cache(4)
def sentences(path: str) -> Sentences:
    """One encoder for each worker and model."""
    return Sentences(path)
