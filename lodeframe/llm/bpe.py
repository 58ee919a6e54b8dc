"""Token ids of a word-end BPE vocabulary for whole texts, as the tokenizers library gives them.

Texts are split by byte class with numpy into runs of letters, single digits and punctuation, as the
vocabulary's own split pattern does. Distinct runs are merged together, one numpy step for each merge round; a
word that holds anything outside ASCII and Latin-1 letters, an apostrophe or a special token's opening goes to
the library itself. Both paths give the same ids (tests compare them).
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np

from lodeframe.llm.common import mix64

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_UNBASE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = mix64(np.arange(7, 263, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))

# byte classes: 0 white space of the split, 1 letter, 2 digit, 3 punctuation, 4 first byte of a Latin-1 letter
# or sign, 5 anything else (the library takes the word)
_CLASS = np.full(256, 5, dtype=np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
for _b in range(33, 127):
    _CLASS[_b] = 1 if chr(_b).isalpha() else 2 if chr(_b).isdigit() else 3
_CLASS[ord("'")] = 5
_CLASS[0xC3] = 4
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + extra)
            extra += 1
    return [out[b] for b in range(256)]


class WordBpe:
    """One for each Python worker: loads the vocabulary file once."""

    #: Distinct words kept from one batch to the next for the library's path.
    KEPT = 50_000
    #: Bytes of the longest word merged here; merge rounds grow with the square of a run.
    LONGEST = 256
    STRETCH = 4 << 20
    _SPACE = re.compile(rb"[ \n\t]")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        letters = _byte_alphabet()
        self.inner = np.array([vocab[c] for c in letters], dtype=np.int64)
        self.final = np.array([vocab[c + end] for c in letters], dtype=np.int64)
        pairs = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.uint64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.uint64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        # open-addressed table: pair -> (rank, made)
        self.bits = 18
        size = 1 << self.bits
        self.keys = np.full(size, np.uint64((1 << 64) - 1), dtype=np.uint64)
        self.rank = np.full(size, len(pairs), dtype=np.int64)
        self.made = np.zeros(size, dtype=np.int64)
        key = (left << np.uint64(32)) | right
        at, todo = self._slot(key), np.arange(len(key))
        self.probes = 0
        while len(todo):
            self.probes += 1
            slot = at[todo]
            free = np.flatnonzero(self.keys[slot] == np.uint64((1 << 64) - 1))
            _, first = np.unique(slot[free], return_index=True)
            put = todo[free[first]]
            self.keys[at[put]], self.rank[at[put]], self.made[at[put]] = key[put], put, made[put]
            todo = np.setdiff1d(todo, put, assume_unique=True)
            at[todo] = (at[todo] + 1) & (size - 1)
        self.none = len(pairs)
        self.kept: dict[bytes, np.ndarray] = {}

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Slot of each pair, or -1."""
        key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        at = self._slot(key)
        out = np.where(self.keys[at] == key, at, -1)
        open_ = np.flatnonzero((out < 0) & (self.keys[at] != np.uint64((1 << 64) - 1)))
        for _ in range(self.probes):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            found = self.keys[at[open_]]
            out[open_[found == key[open_]]] = at[open_[found == key[open_]]]
            open_ = open_[(found != key[open_]) & (found != np.uint64((1 << 64) - 1))]
        return out

    def merged(self, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some runs of bytes, one after another, and each run's number of ids."""
        total = np.zeros(len(starts), dtype=np.int64)
        place: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        order = np.argsort(lengths, kind="stable")
        low = 0
        while low < len(order):
            width = int(lengths[order[low]])
            high = int(np.searchsorted(lengths[order], width, side="right"))
            for a in range(low, high, max(1, (1 << 20) // max(width, 1))):
                rows = order[a : min(high, a + max(1, (1 << 20) // max(width, 1)))]
                ids, n = self._rounds(raw[starts[rows, None] + np.arange(width)])
                total[rows] = n
                place.append((rows, ids, n))
            low = high
        begin = np.cumsum(total) - total
        out = np.zeros(int(total.sum()), dtype=np.uint32)
        for rows, ids, n in place:
            keep = np.arange(ids.shape[1]) < n[:, None]
            out[(begin[rows, None] + np.arange(ids.shape[1]))[keep]] = ids[keep]
        return out, total

    def _rounds(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy merges of equally long runs: each round merges every row's leftmost pair of least rank."""
        rows, width = raw.shape
        ids = self.inner[raw]
        ids[:, -1] = self.final[raw[:, -1]]
        n = np.full(rows, width)
        if width == 1:
            return ids, n
        slots = self._look(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(rows, width - 1)
        ranks = np.where(slots >= 0, self.rank[slots], self.none)
        live = np.arange(rows)
        while len(live) and width > 1:
            best = ranks[live].argmin(axis=1)
            ok = ranks[live, best] < self.none
            live, best = live[ok], best[ok]
            if not len(live):
                break
            ids[live, best] = self.made[slots[live, best]]
            # close the gap at best + 1
            after = np.arange(width)[None, :] > best[:, None]
            block = ids[live]
            block[:, :-1] = np.where(after[:, :-1], block[:, 1:], block[:, :-1])
            ids[live] = block
            n[live] -= 1
            r, s = ranks[live], slots[live]
            gap = after[:, : width - 1]
            r[:, :-1] = np.where(gap[:, :-1], r[:, 1:], r[:, :-1])
            s[:, :-1] = np.where(gap[:, :-1], s[:, 1:], s[:, :-1])
            r[:, -1], s[:, -1] = self.none, -1
            here = np.arange(len(live))
            count = n[live]
            for at in (best - 1, best):
                valid = (at >= 0) & (at + 1 < count)
                rows_v, at_v = here[valid], at[valid]
                got = self._look(block[rows_v, at_v], block[rows_v, at_v + 1])
                s[rows_v, at_v] = got
                r[rows_v, at_v] = np.where(got >= 0, self.rank[got], self.none)
                gone = (at >= 0) & (at + 1 >= count) & (at < width - 1)
                r[here[gone], at[gone]], s[here[gone], at[gone]] = self.none, -1
            ranks[live], slots[live] = r, s
        return ids, n

    def _by_library(self, words: list[bytes]) -> list[np.ndarray]:
        new = [w for w in dict.fromkeys(words) if w not in self.kept]
        if len(self.kept) + len(new) > self.KEPT:
            self.kept = {}
            new = list(dict.fromkeys(words))
        for low in range(0, len(new), 1000):
            part = new[low : low + 1000]
            for w, e in zip(part, self.library.encode_batch([w.decode() for w in part], add_special_tokens=False), strict=True):
                self.kept[w] = np.array(e.ids, dtype=np.uint32)
        return [self.kept[w] for w in words]

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids (uint32) of each text. A text longer than STRETCH goes through in stretches that end in white space, as
        no id reaches over it."""
        return [self._encode([t])[0] if len(t) <= self.STRETCH else np.concatenate([self._encode([p])[0] for p in self._stretches(t)]) for t in texts] if max(map(len, texts), default=0) > self.STRETCH else self._encode(texts)

    def _stretches(self, text: bytes) -> list[bytes]:
        out, low = [], 0
        while len(text) - low > self.STRETCH:
            found = self._SPACE.search(text, low + self.STRETCH)
            if not found:
                break
            out.append(text[low : found.start()])
            low = found.start()
        return [*out, text[low:]]

    def _encode(self, texts: list[bytes]) -> list[np.ndarray]:
        joined = b"\n".join(texts) + b"\n"
        raw = np.frombuffer(joined, dtype=np.uint8)
        kind = _CLASS[raw].copy()
        low = _LOWER[raw].copy()
        lead = np.flatnonzero(kind == 4)
        tail = lead + 1
        follow = raw[tail]
        letter = (follow >= 0x80) & (follow <= 0xBF) & (follow != 0x97) & (follow != 0xB7)
        kind[lead[letter]] = 1
        kind[tail[letter]] = 1
        kind[lead[~letter]] = 5
        upper = letter & (follow <= 0x9E)
        low[tail[upper]] += 0x20
        for m in re.finditer(rb"<\|", joined):
            kind[m.start()] = 5
        white = kind == 0
        before = np.append(True, white[:-1])
        w_start, w_end = np.flatnonzero(before & ~white), np.flatnonzero(white & ~before)
        strange = (np.add.reduceat((kind == 5).astype(np.int32), w_start) > 0) | (w_end - w_start > self.LONGEST) if len(w_start) else np.zeros(0, bool)
        # runs: a new one at each word start, change of class, and digit
        change = np.append(True, (kind[1:] != kind[:-1]) | (kind[1:] == 2))
        r_start = np.flatnonzero(change & ~white)
        r_word = np.searchsorted(w_start, r_start, side="right") - 1
        r_start, r_word = r_start[~strange[r_word]], r_word[~strange[r_word]]
        nxt = np.flatnonzero(change | white)
        r_end = nxt[np.searchsorted(nxt, r_start, side="right")] if len(r_start) else r_start
        # distinct runs by hash and length
        n = len(raw)
        up = np.full(n + 1, _BASE, dtype=np.uint64)
        up[0] = 1
        up = np.multiply.accumulate(up)
        down = np.full(n + 1, _UNBASE, dtype=np.uint64)
        down[0] = 1
        down = np.multiply.accumulate(down)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE[low] * up[:n], out=sums[1:])
        h = mix64((sums[r_end] - sums[r_start]) * down[r_start])
        _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        ids, count = self.merged(low, r_start[first], (r_end - r_start)[first]) if len(first) else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        begin = np.cumsum(count) - count
        # words for the library join as extra distinct runs
        odd = np.flatnonzero(strange)
        if len(odd):
            extra = self._by_library([joined[w_start[i] : w_end[i]] for i in odd])
            lengths = np.fromiter(map(len, extra), dtype=np.int64, count=len(extra))
            begin = np.append(begin, len(ids) + np.cumsum(lengths) - lengths)
            inverse = np.append(inverse, len(count) + np.arange(len(odd)))
            count = np.append(count, lengths)
            ids = np.concatenate([ids, *extra])
            r_start = np.append(r_start, w_start[odd])
            order = np.argsort(r_start, kind="stable")
            r_start, inverse = r_start[order], inverse[order]
        size = count[inverse]
        past = np.cumsum(size) - size
        flat = ids[np.arange(int(size.sum())) - np.repeat(past, size) + np.repeat(begin[inverse], size)] if len(size) else ids[:0]
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
        cut_at = np.append(0, np.searchsorted(r_start, np.cumsum(lengths)))
        at = np.append(past, len(flat))[cut_at]
        return [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


_LOADED: dict[str, WordBpe] = {}


def word_bpe(path: str) -> WordBpe:
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def ids_crc32(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4"))
