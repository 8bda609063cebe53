"""Token ids of many texts: pieces between white space are encoded once and their ids are put together by numpy.

Both vocabularies' pre-tokenizers never join what stands on two sides of white space, but for the one space before a
word (byte-level) and none (word-level); so a text is its pieces' ids one after another. A text with white space outside
ASCII's, or with a special token's marks, is encoded as a whole.

A piece of up to 16 bytes is known by its size, its first and its last eight bytes, which are all of it: two tables of
slots say where it may be kept, and it is found only if all three are equal. Longer pieces are kept by their bytes. So
ids never rest on a hash.
"""

from __future__ import annotations

import os
import re

import numpy as np

from loomspark.llm import bytetext as B

_ODD_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0 ᠎ -‏    ⁠　﻿]|<\\|")
#: 1: ASCII letters and digits; 2: other visible ASCII but the apostrophe, which contractions begin with.
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[33:127] = 2
_KIND[48:58] = _KIND[65:91] = _KIND[97:123] = 1
_KIND[39] = 0
#: The same and 4: white space. A word-level piece ends where two neighbours' classes differ by 3 bits or over.
_CLASS = _KIND | B.SPACE.astype(np.uint8) << 2
#: Byte-level vocabularies' sign for each byte, as UTF-16; a space stays one, to part words.
_SHOWN = np.array([b for b in range(256) if 33 <= b < 127 or 161 <= b < 173 or b >= 174])
_SIGN = np.zeros(256, dtype="<u2")
_SIGN[np.setdiff1d(np.arange(256), _SHOWN)] = 256 + np.arange(256 - len(_SHOWN))
_SIGN[_SHOWN] = _SHOWN
_SIGN[32] = 32
#: Letters below U+0250 that a lower case of one letter and the normal form leave as they are.
LETTERS = "".join(c for c in map(chr, range(0x250)) if c.isalpha() and len(c.lower()) == 1)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: How the two vocabularies mark a word's beginning after a space, and its end.
SPACED, CLOSED = "\u0120", "</w>"
#: Pieces that are kept; then all are let go. Slots of a table: two to the power of.
CACHE_PIECES = 1_000_000
_SLOTS = 21
SHORT = 16
#: Bytes with which white space outside ASCII's blanks, or a special token, may begin.
_MAYBE_ODD = np.zeros(256, dtype=bool)
_MAYBE_ODD[[0x0B, 0x0C, 0x1C, 0x1D, 0x1E, 0x1F, 0x3C, 0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] = True
_encoders: dict[tuple[str, bool], PieceEncoder] = {}


def encoder(path: str, with_space: bool) -> PieceEncoder:
    """One encoder, with the pieces it knows, for all tasks of a worker."""
    if (path, with_space) not in _encoders:
        _encoders[path, with_space] = PieceEncoder(path, with_space)
    return _encoders[path, with_space]


def _signs(words: str) -> str:
    """Words of LETTERS between single spaces, in lower case and in byte-level signs."""
    return _SIGN[np.frombuffer(words.lower().encode(), dtype=np.uint8)].tobytes().decode("utf-16-le")


class PieceEncoder:
    """encode(texts): ids of each text. with_space: a single space belongs to the word after it (byte-level), else white space has no ids."""

    def __init__(self, path: str, with_space: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.with_space = Tokenizer.from_file(path), with_space
        vocabulary = self.tokenizer.get_vocab()
        self.edge = np.zeros(max(vocabulary.values()) + 1, dtype=bool)  # ids that begin (byte-level) or end a word
        self.edge[[k for t, k in vocabulary.items() if (t.startswith(SPACED) if with_space else t.endswith(CLOSED))]] = True
        self.letters = None  # the same model, for words of letters that are already in lower case and in byte-level signs
        if not with_space:
            self.letters = Tokenizer(self.tokenizer.model)
            self.letters.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
            words = [" ".join(LETTERS), LETTERS]
            if [x.ids for x in self.letters.encode_batch_fast([_signs(w) for w in words], add_special_tokens=False)] != [self.whole(w).tolist() for w in words]:
                self.letters = None  # a vocabulary with another normal form
        self._clear()

    def _clear(self) -> None:
        self.n = self.n_ids = 0
        self.head, self.tail = np.zeros(1 << 16, dtype=np.uint64), np.zeros(1 << 16, dtype=np.uint64)
        self.bytes = np.zeros(1 << 16, dtype=np.uint8)
        self.at, self.size = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.int32)
        self.ids = np.zeros(1 << 18, dtype=np.uint32)
        self.slots = np.full((2, 1 << _SLOTS), -1, dtype=np.int32)
        self.long: dict[bytes, int] = {}

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def _pieces(self, buf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not self.with_space:
            kind = _CLASS[buf]
            at = np.append(0, np.flatnonzero((kind[1:] ^ kind[:-1]) >= 3) + 1)  # the last is the last separator or before it
            keep = np.flatnonzero(kind[at[:-1]] != 4)
            return at[keep], at[keep + 1]
        space = B.SPACE[buf]
        space[starts[1:] - 1] = True
        own = np.zeros(len(buf) + 1, dtype=bool)  # where a piece begins
        kind = _KIND[buf]
        own[1:-1] = (kind[1:] ^ kind[:-1]) == 3  # between a letter or digit and a sign, always another token
        own[starts] = True
        own[starts[1:] - 1] = True  # a separator is a piece, dropped below
        s, e = B.runs(~space)
        before = s - 1
        inner = (before >= 0) & ~np.isin(s, starts)
        one = inner & (buf[np.maximum(before, 0)] == 32)
        own[s[~one]] = True
        own[before[inner]] = True  # the last white space of a run: with its word, or a piece of its own
        own[e] = True
        at = np.flatnonzero(own)
        s, e = at[:-1], at[1:]
        keep = ~np.isin(s, starts[1:] - 1)
        return s[keep], e[keep]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's begin."""
        raw = [t.encode() for t in texts]
        buf, starts = B.joined(raw)
        maybe = np.unique(np.searchsorted(starts, np.flatnonzero(_MAYBE_ODD[buf]), side="right") - 1)
        odd = [i for i in maybe.tolist() if _ODD_SPACE.search(texts[i])]
        if odd:
            for i in odd:
                raw[i] = b""
            buf, starts = B.joined(raw)
        s, e = self._pieces(buf, starts)
        piece = self._rows(buf, s, e)
        size = self.size[piece]
        total = np.zeros(len(piece) + 1, dtype=np.int64)
        np.cumsum(size, out=total[1:])
        ids = self.ids[np.repeat(self.at[piece] - total[:-1], size) + np.arange(total[-1])]
        at = total[np.searchsorted(s, starts)]
        if not odd:
            return ids, at
        parts = [ids[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        for i in odd:
            parts[i] = self.whole(texts[i])
        return np.concatenate(parts), np.cumsum([0, *map(len, parts)])

    def _rows(self, buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Where each piece is kept, after the new ones have been encoded."""
        if self.n > CACHE_PIECES:
            self._clear()
        low = buf if self.with_space else _FOLD[buf]  # word-level ids don't depend on case
        raw = low.tobytes()
        words = np.ndarray(len(low), dtype="<u8", buffer=raw + bytes(8), strides=(1,))
        size = (e - s).astype(np.uint64)
        empty = np.uint64(8) * (np.uint64(8) - np.minimum(size, np.uint64(8)))
        head = words[s] << empty >> empty
        tail = np.where(size > 8, words[np.maximum(e - 8, 0)], np.uint64(0))
        key = B.mix((head ^ tail * np.uint64(0x9E3779B97F4A7C15)) + size * np.uint64(0xD1B54A32D192ED03))
        places = (key >> np.uint64(64 - _SLOTS)).astype(np.int64), (key & np.uint64((1 << _SLOTS) - 1)).astype(np.int64)
        is_long = size > SHORT
        row = self._kept(self.slots[0][places[0]], head, tail, size)
        miss = np.flatnonzero((row < 0) & ~is_long)
        row[miss] = self._kept(self.slots[1][places[1][miss]], head[miss], tail[miss], size[miss])
        for k in np.flatnonzero(is_long).tolist():
            row[k] = self.long.get(raw[s[k] : e[k]], -1)
        miss = np.flatnonzero(row < 0)
        if not len(miss):
            return row
        # new pieces, each once: equal ones stand together in an order of all that they are
        short = miss[~is_long[miss]]
        short = short[np.lexsort((size[short], tail[short], head[short]))]
        new = np.ones(len(short), dtype=bool)
        new[1:] = (head[short][1:] != head[short][:-1]) | (tail[short][1:] != tail[short][:-1]) | (size[short][1:] != size[short][:-1])
        first, extra = short[new].tolist(), []
        row[short] = self.n + np.cumsum(new) - 1
        for k in miss[is_long[miss]].tolist():
            word = raw[s[k] : e[k]]
            if word not in self.long:
                self.long[word] = self.n + len(first) + len(extra)
                extra.append(k)
            row[k] = self.long[word]
        first += extra
        lengths, ids = self._encoded([raw[a:b].decode() for a, b in zip(s[first].tolist(), e[first].tolist(), strict=True)])
        self._keep(np.array(first), len(first) - len(extra), lengths, ids, head, tail, size, places)
        return row

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each piece, and the ids.

        Pieces of letters are encoded many at a time, as they may stand in a text, and parted where the vocabulary marks
        a word's edge; where the number of edges isn't that of the pieces, these go one by one like all others.
        """
        own = [w[1:] if w[:1] == " " else "" for w in words] if self.with_space else words
        plain = [k for k, w in enumerate(own) if w.isalpha() and (w.isascii() or max(w) < "\u0250" and "\u0130" not in w)]
        lengths, parts = np.zeros(len(words), dtype=np.int64), {}
        runs = [plain[i : i + 256] for i in range(0, len(plain), 256)]
        joined = [("" if self.with_space else " ").join([words[k] for k in run]) for run in runs]
        encoded = (self.letters or self.tokenizer).encode_batch_fast([*map(_signs, joined)] if self.letters else joined, add_special_tokens=False)
        alone = np.ones(len(words), dtype=bool)
        for run, x in zip(runs, encoded, strict=True):
            ids = np.array(x.ids, dtype=np.uint32)
            at = np.flatnonzero(self.edge[ids])
            edges = np.append(at, len(ids)) if self.with_space else np.append(0, at + 1)
            if len(at) == len(run) and edges[0] == 0 and edges[-1] == len(ids):
                lengths[run], alone[run] = np.diff(edges), False
                parts[run[0]] = ids
        rest = np.flatnonzero(alone)
        got = [x.ids for x in self.tokenizer.encode_batch_fast([words[k] for k in rest], add_special_tokens=False)]
        lengths[rest] = np.fromiter(map(len, got), dtype=np.int64, count=len(got))
        # ids in order of the pieces: those of runs, then the others, each put at its place
        order = np.concatenate([*[np.array(r) for r in runs if r[0] in parts], rest]) if len(words) else rest
        flat = np.concatenate([*[parts[r[0]] for r in runs if r[0] in parts], np.fromiter((i for g in got for i in g), dtype=np.uint32)])
        start = np.cumsum(lengths) - lengths
        out = np.zeros(int(lengths.sum()), dtype=np.uint32)
        size = lengths[order]
        out[np.repeat(start[order] - np.cumsum(size) + size, size) + np.arange(len(out))] = flat
        return lengths, out

    def _kept(self, row: np.ndarray, head: np.ndarray, tail: np.ndarray, size: np.ndarray) -> np.ndarray:
        """row where what is kept there is the piece, else -1."""
        ok = (row >= 0) & (self.head[row] == head) & (self.tail[row] == tail) & (self.bytes[row] == size)
        return np.where(ok, row, -1).astype(np.int64)

    def _keep(self, first: np.ndarray, short: int, lengths: np.ndarray, ids: np.ndarray, head: np.ndarray, tail: np.ndarray, size: np.ndarray, places: tuple[np.ndarray, np.ndarray]) -> None:
        a, z = self.n, self.n + len(first)
        while z > len(self.head):
            for name in ("head", "tail", "bytes", "at", "size"):
                setattr(self, name, np.concatenate([getattr(self, name)] * 2))
        while self.n_ids + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids] * 2)
        self.head[a:z], self.tail[a:z], self.bytes[a:z] = head[first], tail[first], np.minimum(size[first], 255)
        self.at[a:z], self.size[a:z] = self.n_ids + np.cumsum(lengths) - lengths, lengths
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        own, rows = first[:short], np.arange(a, a + short, dtype=np.int32)
        full = self.slots[0][places[0][own]] >= 0
        self.slots[0][places[0][own[~full]]] = rows[~full]
        self.slots[1][places[1][own[full]]] = rows[full]
        self.n, self.n_ids = z, self.n_ids + len(ids)
