"""Ids of a lower-casing word vocabulary (byte-level BPE with word ends), many texts at once.

Texts of ASCII and Latin-1 letters are cut into pre-tokens in numpy, on their bytes;
each distinct pre-token is merged once and found again by its hash.  Other texts go
to the tokenizers library.
"""

from __future__ import annotations

import json

import numpy as np

from gridloom.llm.hashing import span_hashes
from gridloom.llm.merging import RankMerger

#: The public pattern of the word vocabulary (fixed value), which the cutting below follows.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LEAD, _TIMES, _DIVIDE = 0xC3, 0x97, 0xB7  # UTF-8 lead of U+00C0 to U+00FF, of which two are no letters
_SPACE, _LETTER, _DIGIT, _OTHER = 0, 1, 2, 3
_KIND = np.full(256, _OTHER, dtype=np.uint8)
_KIND[[32, 9, 10, 11, 12, 13]] = _SPACE
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = _LETTER
_KIND[48:58] = _DIGIT
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Control characters, and bytes of characters beyond U+00FF or below U+00C0.
_ODD = np.zeros(256, dtype=bool)
_ODD[[*range(9), *range(14, 32), 127, *range(0xC0, 0xC3), *range(0xC4, 0x100)]] = True
_SLOTS = 20


class WordIds:
    def __init__(self, path: str, most: int = 2_000_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        cut = [x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split"]
        if cut != [PATTERN] or [x["type"] for x in spec["normalizer"]["normalizers"]] != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("not a tokenizer of lower-cased words without white space")
        self.merger, self.most = RankMerger(path), most
        self._forget()

    def _forget(self) -> None:
        """An empty table: a slot for each hash prefix, and a pool of ids of at most ``most`` and one batch's."""
        self.held = np.zeros(1 << _SLOTS, dtype=np.uint64)
        self.at, self.size = np.zeros(1 << _SLOTS, dtype=np.int32), np.zeros(1 << _SLOTS, dtype=np.int32)
        self.pool, self.filled = np.zeros(1 << 20, dtype=np.uint32), 0

    def _add(self, flat: np.ndarray) -> int:
        first = self.filled
        while first + len(flat) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros(len(self.pool), dtype=np.uint32)))
        self.pool[first : first + len(flat)] = flat
        self.filled += len(flat)
        return first

    def _spans(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lower-cased bytes and the bounds of all pre-tokens."""
        low, kind = _LOWER[data], _KIND[data]
        after = np.flatnonzero(data[:-1] == _LEAD) + 1
        tail = data[after]
        low[after] = np.where((tail < 0x9F) & (tail != _TIMES), tail + 0x20, tail)
        signs = after[(tail == _TIMES) | (tail == _DIVIDE)]
        kind[signs], kind[signs - 1] = _OTHER, _OTHER
        begin = np.concatenate(([True], (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)))
        begin[offsets[:-1][offsets[:-1] < len(data)]] = True
        begin &= kind != _SPACE
        # An apostrophe alone before certain letters makes one pre-token with them.
        mark = np.flatnonzero((low == 39) & begin)
        if len(mark):
            stop = offsets[np.searchsorted(offsets, mark, side="right")]
            one, two = (np.where(mark + i < stop, low[np.minimum(mark + i, len(low) - 1)], 0) for i in (1, 2))
            short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
            long = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)
            begin[mark[short | long] + 1] = False
            for hit, width in ((mark[short], 2), (mark[long & ~short], 3)):
                rest = hit[hit + width < len(low)] + width
                begin[rest[kind[rest] != _SPACE]] = True
        start = np.flatnonzero(begin)
        end = np.flatnonzero((kind != _SPACE) & np.concatenate((begin[1:] | (kind[1:] == _SPACE), [True]))) + 1
        return low, start, end

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids, one after another, and where each text's begin and end."""
        n = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
        odd = _ODD[data]
        odd[:-1] |= (data[:-1] == 60) & (data[1:] == 124)  # perhaps a special string
        strange = np.unique(np.searchsorted(offsets, np.flatnonzero(odd), side="right") - 1)
        if self.filled > self.most:
            self._forget()
        low, start, end = self._spans(data, offsets)
        owner = np.searchsorted(offsets, start, side="right") - 1
        if len(strange):
            plain = ~np.isin(owner, strange)
            start, end, owner = start[plain], end[plain], owner[plain]
        hashes = span_hashes(low, start, end)
        slot = (hashes >> np.uint64(64 - _SLOTS)).astype(np.int64)
        at, size = self.at[slot].astype(np.int64), self.size[slot].astype(np.int64)
        miss = np.flatnonzero(self.held[slot] != hashes)
        if len(miss):
            _, first, back = np.unique(hashes[miss], return_index=True, return_inverse=True)
            new = miss[first]
            raw = low.tobytes()
            flat, sizes = self.merger.merge([raw[a:b] for a, b in zip(start[new].tolist(), end[new].tolist(), strict=True)])
            places = self._add(flat.astype(np.uint32)) + np.cumsum(sizes) - sizes
            self.held[slot[new]], self.at[slot[new]], self.size[slot[new]] = hashes[new], places, sizes
            at[miss], size[miss] = places[back], sizes[back]
        if len(strange):
            found = [np.array(self.library.encode(bytes(data[offsets[i] : offsets[i + 1]]).decode(), add_special_tokens=False).ids, dtype=np.uint32) for i in strange.tolist()]
            sizes = np.array([len(f) for f in found], dtype=np.int64)
            places = self._add(np.concatenate(found)) + np.cumsum(sizes) - sizes
            order = np.argsort(np.concatenate((owner, strange)), kind="stable")
            owner, at, size = (np.concatenate(x)[order] for x in ((owner, strange), (at, places), (size, sizes)))
        before = np.cumsum(size) - size
        flat = self.pool[np.repeat(at - before, size) + np.arange(int(size.sum()))]
        per_text = np.bincount(owner, weights=size, minlength=n).astype(np.int64)
        return flat, np.concatenate(([0], np.cumsum(per_text)))
