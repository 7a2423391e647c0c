"""Whole-text token ids of the lower-casing word BPE, by a cache over word pieces.

The tokenizer's rules never join what white space, a change between letters, digits and signs, or a digit's edge
separates. So the ids of a text are those of its units (runs of letters, single digits, runs of signs), which repeat
far more often than texts do. White-space words that hold anything beyond ASCII and Latin-1 letters, or an apostrophe
or a bar (contractions, special tokens), are units as they stand and go through the tokenizer whole.
"""

from __future__ import annotations

import os

import numpy as np

from . import words

U = np.uint64
CAPACITY = 1_200_000
#: Letters encoded together in one call.
JOIN = 400

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_KIND = np.full(256, 3, np.uint8)  # signs
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = 1
_KIND[0x30:0x3A] = 2
_KIND[0x80:] = 1
_KIND[words._SPACE] = 0
_ODD = np.zeros(256, bool)
_ODD[:0x20] = True
_ODD[0x7F] = _ODD[0x27] = _ODD[0x7C] = True
_ODD[0xC0:] = True
_ODD[0xC3] = False
_ODD[words._SPACE] = False


class Encoder:
    """Ids of texts; one for each worker process and vocabulary file."""

    def __init__(self, path: str, capacity: int = CAPACITY) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.capacity = Tokenizer.from_file(path), capacity
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for s, i in vocabulary.items() if s.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, U)  # hashes of units in order, and the entry of each
        self.entry = np.zeros(0, np.int32)
        self.flat = np.zeros(1 << 16, np.int32)
        self.used = self.count = 0
        self.start = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int32)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The entry of each hash, or -1."""
        if not len(self.keys):
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, self.entry[at], -1).astype(np.int64)

    def _add(self, hashes: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Append entries, and say which; they are found once they are put in order."""
        n, k = self.count, len(hashes)
        while n + k > len(self.start):
            self.start, self.size = np.resize(self.start, 2 * len(self.start)), np.resize(self.size, 2 * len(self.size))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[n : n + k] = self.used + np.cumsum(sizes) - sizes
        self.size[n : n + k] = sizes
        self.used += len(ids)
        self.count += k
        return np.arange(n, n + k)

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([i for x in got for i in x], np.int32), np.array([len(x) for x in got], np.int64)

    def _learn(self, hashes: np.ndarray, spelled: list[str], plain: np.ndarray) -> None:
        """Encode new units, whose hashes are in order: those of letters alone in joined runs, split again at the ids that end a word."""
        added = np.zeros(len(hashes), np.int32)
        p = np.flatnonzero(plain).tolist()
        for s in range(0, len(p), JOIN):
            part = p[s : s + JOIN]
            ids, _ = self._whole([" ".join(spelled[i] for i in part)])
            last = np.flatnonzero(self.ends[ids])
            if len(last) != len(part):
                ids, sizes = self._whole([spelled[i] for i in part])
            else:
                sizes = np.diff(last, prepend=-1)
            added[part] = self._add(hashes[part], ids, sizes)
        rest = np.flatnonzero(~plain).tolist()
        if rest:
            added[rest] = self._add(hashes[rest], *self._whole([spelled[i] for i in rest]))
        at = np.searchsorted(self.keys, hashes)
        self.keys, self.entry = np.insert(self.keys, at, hashes), np.insert(self.entry, at, added)

    def encode(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and where each text's ids begin, plus the end."""
        data, first, last, row, odd = units(data, starts)
        h = words.hash_spans(data, first, last)
        h[odd] ^= U(0x5851F42D4C957F2D)
        uniq, where, back = np.unique(h, return_index=True, return_inverse=True)
        if self.count + len(uniq) > self.capacity:
            self.clear()
        known = self._find(uniq)
        new = np.flatnonzero(known < 0)
        if len(new):
            w = where[new]
            raw = data.tobytes()
            spelled = [raw[s:e].decode() for s, e in zip(first[w].tolist(), last[w].tolist())]
            self._learn(uniq[new], spelled, ~odd[w] & (_KIND[data[first[w]]] == 1))
            known[new] = self._find(uniq[new])
        entry = known[back]
        size = self.size[entry].astype(np.int64)
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.arange(total, dtype=np.int64) + np.repeat(self.start[entry] - (ends - size), size)]
        out = np.zeros(len(starts), np.int64)
        out[1:] = np.cumsum(np.bincount(row, weights=size, minlength=len(starts) - 1)).astype(np.int64)
        return ids, out


def units(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes, lower-cased outside odd words, and of each unit: first byte, byte after the last, row, and whether it is odd."""
    w_first, w_last, w_row = words.word_spans(data, starts)
    if not len(w_first):
        return data, w_first, w_last, w_row, np.zeros(0, bool)
    strange = _ODD[data]
    c3 = np.flatnonzero(data == 0xC3)
    follow = data[np.minimum(c3 + 1, len(data) - 1)]
    strange[c3[(follow == 0x97) | (follow == 0xB7)]] = True
    upto = np.zeros(len(data) + 1, np.int64)
    np.cumsum(strange, out=upto[1:])
    w_odd = upto[w_last] > upto[w_first]
    odd = np.zeros(len(data) + 1, np.int8)
    odd[w_first[w_odd]] = 1
    odd[w_last[w_odd]] -= 1
    odd = np.cumsum(odd[:-1], dtype=np.int8).astype(bool)
    low = _LOWER[data]
    capital = c3[(follow >= 0x80) & (follow <= 0x9E)] + 1
    low[capital] += 0x20
    low = np.where(odd, data, low)
    kind = _KIND[data]
    cut = np.zeros(len(data), bool)
    cut[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    cut &= ~odd & (kind != 0)
    cut[w_first] = True
    first = np.flatnonzero(cut)
    word = np.searchsorted(w_first, first, side="right") - 1
    last = np.empty(len(first), np.int64)
    last[:-1] = first[1:]
    last[-1] = w_last[-1]
    last = np.minimum(last, w_last[word])
    return low, first, last, w_row[word], w_odd[word]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
