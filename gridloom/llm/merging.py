"""Rank-synchronous merging of byte-pair vocabularies in numpy."""

from __future__ import annotations

import heapq
import json

import numpy as np

_NONE = np.int64(1 << 40)
#: Bytes of a word above which it is merged by itself: a round costs a sequence's whole length, and long ones take many.
LONG = 512
_SLOTS = 18


class PairTable:
    """Number of a known pair of symbols, or -1: a few hashed arrays, each holding what collided before."""

    def __init__(self, keys: np.ndarray):
        self.levels = []
        rest, numbers = keys.astype(np.uint64), np.arange(len(keys), dtype=np.int32)
        rng = np.random.default_rng(7)
        while len(rest):
            factor = np.uint64(int(rng.integers(1, 2**62)) * 2 + 1)
            slot = (rest * factor) >> np.uint64(64 - _SLOTS)
            _, first = np.unique(slot, return_index=True)
            held, place = np.full(1 << _SLOTS, np.uint64(2**64 - 1)), np.zeros(1 << _SLOTS, dtype=np.int32)
            held[slot[first]], place[slot[first]] = rest[first], numbers[first]
            self.levels.append((factor, held, place))
            left = np.ones(len(rest), dtype=bool)
            left[first] = False
            rest, numbers = rest[left], numbers[left]

    def find(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.astype(np.uint64)
        out = np.full(len(keys), -1, dtype=np.int64)
        for factor, held, place in self.levels:
            slot = ((keys * factor) >> np.uint64(64 - _SLOTS)).astype(np.int64)
            out = np.where(held[slot] == keys, place[slot], out)
        return out


class RankMerger:
    """Merges many byte sequences at once by the ranked pairs of a tokenizer.json."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, suffix = spec["model"]["vocab"], spec["model"].get("end_of_word_suffix") or ""
        self.specials = [t["content"] for t in spec["added_tokens"]]
        # The public byte alphabet: printable bytes stand for themselves, the others for code points from 256.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(shown)]
        letter = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.first_ids = np.array([vocab[letter[b]] for b in range(256)], dtype=np.int64)
        self.last_ids = np.array([vocab[letter[b] + suffix] for b in range(256)], dtype=np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        left, right, self.made = (np.array([vocab[x] for x in col], dtype=np.int64) for col in ([p[0] for p in pairs], [p[1] for p in pairs], [a + b for a, b in pairs]))
        self.width = np.int64(max(vocab.values()) + 1)
        self.keys = left * self.width + right
        self.pairs = PairTable(self.keys)  # a pair's number is its rank
        self.known: dict[int, tuple[int, int]] | None = None  # for long words, made when the first one comes

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The surviving symbols of all words, one after another, and how many each has."""
        long = [i for i, w in enumerate(words) if len(w) > LONG]
        if not long:
            return self._merge_together(words)
        flat, counts = self._merge_together([w if len(w) <= LONG else b"" for w in words])
        ends, parts, at = np.cumsum(counts), [], 0
        for i in long:
            own = self._merge_alone(words[i])
            parts += [flat[at : ends[i]], own]
            at, counts[i] = int(ends[i]), len(own)
        return np.concatenate([*parts, flat[at:]]), counts

    def _merge_alone(self, word: bytes) -> np.ndarray:
        """One long word's symbols: its pairs wait in a heap by rank and place, so that a merge only looks at its neighbours."""
        if self.known is None:
            keys = self.keys.tolist()
            self.known = {k: (rank, made) for rank, (k, made) in enumerate(zip(keys, self.made.tolist(), strict=True))}
        known, width = self.known, int(self.width)
        data = np.frombuffer(word, dtype=np.uint8)
        symbols = self.first_ids[data]
        symbols[-1] = self.last_ids[data[-1]]
        symbols, n = symbols.tolist(), len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(found[0], i, key) for i, key in enumerate(a * width + b for a, b in zip(symbols, symbols[1:], strict=False)) if (found := known.get(key))]
        heapq.heapify(heap)
        while heap:
            _, at, key = heapq.heappop(heap)
            right = after[at]
            if right >= n or symbols[at] < 0 or symbols[at] * width + symbols[right] != key:
                continue  # one of the two has been merged since
            symbols[at], symbols[right] = known[key][1], -1
            nearer, further = before[at], after[right]
            after[at] = further
            if further < n:
                before[further] = at
                if found := known.get(new := symbols[at] * width + symbols[further]):
                    heapq.heappush(heap, (found[0], at, new))
            if nearer >= 0 and (found := known.get(new := symbols[nearer] * width + symbols[at])):
                heapq.heappush(heap, (found[0], nearer, new))
        return np.array([s for s in symbols if s >= 0], dtype=np.int64)

    def _merge_together(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same of words of any length, in rounds: each word's pair of lowest rank is merged everywhere in it."""
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        symbols = self.first_ids[data]
        last = np.cumsum(sizes)[sizes > 0] - 1
        symbols[last] = self.last_ids[data[last]]
        live = np.flatnonzero(sizes > 0)
        counts, sizes = np.zeros(len(words), dtype=np.int64), sizes[live]
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(live):
            starts = np.cumsum(sizes) - sizes
            ranks = np.full(len(symbols), _NONE)
            found = self.pairs.find(symbols[:-1] * self.width + symbols[1:])
            ranks[:-1] = np.where(found < 0, _NONE, found)
            ranks[starts[1:] - 1] = _NONE  # a word's last symbol has no partner
            least = np.minimum.reduceat(ranks, starts)
            more = least < _NONE
            counts[live[~more]] = sizes[~more]
            keep = np.repeat(more, sizes)
            done.append((np.repeat(live[~more], sizes[~more]), symbols[~keep]))
            hit = np.flatnonzero((ranks == np.repeat(least, sizes)) & keep)
            if len(hit):
                # Of overlapping occurrences (a run of equal symbols) every second one, from the left.
                place = np.arange(len(hit))
                fresh = np.concatenate(([True], np.diff(hit) != 1))
                hit = hit[(place - np.maximum.accumulate(np.where(fresh, place, 0))) % 2 == 0]
                symbols[hit] = self.made[ranks[hit]]
                keep[hit + 1] = False
                sizes = sizes - np.bincount(np.searchsorted(starts, hit, side="right") - 1, minlength=len(live))
            symbols, sizes, live = symbols[keep], sizes[more], live[more]
        owner = np.concatenate([d[0] for d in done]) if done else np.zeros(0, np.int64)
        flat = np.concatenate([d[1] for d in done]) if done else np.zeros(0, np.int64)
        return flat[np.argsort(owner, kind="stable")], counts
