"""Token ids of a word-end BPE vocabulary, equal to the tokenizers library's.

The vocabulary lower-cases, drops white space and merges bytes within words
only, so the ids of a text are those of its words in order. Words of plain
letters, digits and signs are found in a whole Arrow batch at once, looked up
by their bytes in a table of fixed size, and merged side by side in numpy where
they are new; whatever else stands between white space (apostrophes, special
strings, controls, further scripts, words of over 16 bytes) goes to the library
itself. A vocabulary whose normalizer or splitting differs from ``RULES`` is
left to the library altogether.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from . import word_runs

#: What the plain path is right for (fixed values of the vocabulary file).
RULES = {
    "normalizer": ["NFC", "Replace", "Lowercase"],
    "split": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+",
    "end": "</w>",
}
SPACE, LETTER, DIGIT, SIGN, ODD, WHOLE = range(6)
_LATIN = 0xC3  # lead byte of U+00C0 to U+00FF
_NOT_LETTERS = (0x97, 0xB7)  # their multiplication and division signs
_NONE = np.int32(np.iinfo(np.int32).max)
#: Slots of the table of known words, and odd pieces kept, in each worker.
SLOTS, ODD_KEPT = 1 << 21, 1 << 16


def _classes() -> np.ndarray:
    c = np.full(256, ODD, np.uint8)
    c[0x21:0x7F] = SIGN
    c[[0x27, 0x3C]] = ODD  # ' may begin a contraction, < a special string
    c[0x30:0x3A] = DIGIT
    c[0x41:0x5B] = c[0x61:0x7B] = LETTER
    c[[0x20, *range(0x09, 0x0E)]] = SPACE
    return c


def _byte_signs() -> list[str]:
    """The printable character that stands for each byte in such vocabularies:
    itself where it is printable, else the next one from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, n = [], 0
    for b in range(256):
        out.append(chr(b) if b in shown else chr(0x100 + n))
        n += b not in shown
    return out


def plain_rules(spec: dict) -> bool:
    """Whether a vocabulary file splits as ``RULES`` say."""
    normal = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    split = [p.get("pattern", {}).get("Regex") for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
    model = spec["model"]
    return (normal == RULES["normalizer"] and split[:1] == [RULES["split"]] and model.get("type") == "BPE"
            and model.get("end_of_word_suffix") == RULES["end"] and not model.get("dropout")
            and len(model["vocab"]) <= 1 << 16)


class Merges:
    """The merge list as a hash table over pairs of ids."""

    def __init__(self, model: dict):
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        key = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], np.uint64)
        key, first = np.unique(key, return_index=True)  # of a pair listed twice, the first counts
        into = np.array([vocab[a + b] for a, b in pairs], np.int32)[first]
        self.bits = max(8, int(len(key)).bit_length() + 4)
        self.key = np.zeros(1 << self.bits, np.uint64)
        self.rank, self.into = np.full(1 << self.bits, _NONE), np.zeros(1 << self.bits, np.int32)
        todo, step = np.arange(len(key)), 0
        while len(todo):
            slot = self._slot(key[todo], step)
            free = self.rank[slot] == _NONE
            won = np.unique(slot[free], return_index=True)[1]
            put = todo[free][won]
            at = slot[free][won]
            self.key[at], self.rank[at], self.into[at] = key[put], first[put], into[put]
            todo = np.setdiff1d(todo, put)
            step += 1
        self.steps = step
        signs = _byte_signs()
        self.inner = np.array([vocab[s] for s in signs], np.int32)
        self.last = np.array([vocab[s + end] for s in signs], np.int32)

    def _slot(self, key: np.ndarray, step: int) -> np.ndarray:
        h = (key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)
        return ((h + np.uint64(step)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged id) of pairs; a pair that does not merge ranks last."""
        key = a.astype(np.uint64) << np.uint64(16) | b.astype(np.uint64)
        rank, into = np.full(len(key), _NONE), np.zeros(len(key), np.int32)
        todo = np.arange(len(key))
        for step in range(self.steps):
            slot = self._slot(key[todo], step)
            hit = (self.rank[slot] != _NONE) & (self.key[slot] == key[todo])
            rank[todo[hit]], into[todo[hit]] = self.rank[slot[hit]], self.into[slot[hit]]
            todo = todo[~hit & (self.rank[slot] != _NONE)]
            if not len(todo):
                break
        return rank, into

    def tokens(self, words: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, count) of words, a row of KEY bytes each: all words merge side
        by side, each its leftmost pair of lowest rank at a time."""
        n, width = words.shape
        ids, size = self.inner[words], lens.copy()
        ids[np.arange(n), lens - 1] = self.last[words[np.arange(n), lens - 1]]
        cols = np.arange(width)
        live = cols[None, :-1] < (size - 1)[:, None]
        rank, into = np.full((n, width - 1), _NONE), np.zeros((n, width - 1), np.int32)
        rank[live], into[live] = self.find(ids[:, :-1][live], ids[:, 1:][live])
        todo = np.arange(n)
        while len(todo):
            at = rank[todo].argmin(1)
            go = rank[todo, at] != _NONE
            todo, at = todo[go], at[go]
            if not len(todo):
                break
            ids[todo, at] = into[todo, at]
            move = np.minimum(cols[None, :] + (cols[None, :] > at[:, None]), width - 1)
            ids[todo] = np.take_along_axis(ids[todo], move, 1)
            pair = np.minimum(cols[None, :-1] + (cols[None, :-1] >= at[:, None]), width - 2)
            rank[todo], into[todo] = np.take_along_axis(rank[todo], pair, 1), np.take_along_axis(into[todo], pair, 1)
            size[todo] -= 1
            for p in (at - 1, at):  # the pairs at both sides of the merged one
                there = (p >= 0) & (p < size[todo] - 1)
                r, c = todo[there], p[there]
                rank[r, c], into[r, c] = self.find(ids[r, c], ids[r, c + 1])
            rank[todo, size[todo] - 1] = np.where(size[todo] - 1 < width - 1, _NONE, rank[todo, np.minimum(size[todo] - 1, width - 2)]) if width > 1 else _NONE
        return ids, size


class WordTokens:
    """``batch`` gives the ids of every text of an Arrow batch."""

    def __init__(self, spec: str, slots: int = SLOTS):
        self.library = Tokenizer.from_str(spec)
        parsed = json.loads(spec)
        self.merges = Merges(parsed["model"]) if plain_rules(parsed) else None
        self.slots = slots
        self.hi, self.lo = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64)
        self.count, self.ids = np.zeros(slots, np.uint8), np.zeros((slots, word_runs.KEY), np.uint16)
        self.odd: dict[bytes, np.ndarray] = {}
        self.classes = _classes()

    def _library(self, pieces: list[bytes]) -> list[np.ndarray]:
        new = [p for p in dict.fromkeys(pieces) if p not in self.odd]
        got = dict(zip(new, (np.array(e.ids, np.uint32) for e in self.library.encode_batch(
            [p.decode("utf-8", "replace") for p in new], add_special_tokens=False))))
        out = [got[p] if p in got else self.odd[p] for p in pieces]
        if len(self.odd) + len(got) > ODD_KEPT:
            self.odd.clear()
        self.odd.update((p, v) for p, v in got.items() if len(p) <= 64)
        return out

    def _units(self, data: np.ndarray, offs: np.ndarray):
        """Words of one class each, or whole pieces between white space."""
        kind = self.classes[data]
        low = np.where((data >= 0x41) & (data <= 0x5A), data + np.uint8(0x20), data)
        lead = np.flatnonzero(data == _LATIN)
        lead = lead[lead + 1 < len(data)]
        second = data[lead + 1]
        good = ~np.isin(second, _NOT_LETTERS)
        kind[lead[good]] = kind[lead[good] + 1] = LETTER
        upper = good & (second < 0x9F)
        low[lead[upper] + 1] += np.uint8(0x20)
        none = np.zeros(len(data), bool)
        if (kind == ODD).any():
            a, b, _ = word_runs.runs(none, kind != SPACE, offs)
            odds = np.concatenate([[0], np.cumsum(kind == ODD)])
            bad = odds[b] > odds[a]
            cover = np.zeros(len(data) + 1, np.int8)
            cover[a[bad]] += 1
            cover[b[bad]] -= 1
            kind[np.cumsum(cover[:-1], dtype=np.int8) > 0] = WHOLE
        new = kind == DIGIT
        new[1:] |= kind[1:] != kind[:-1]
        a, b, row = word_runs.runs(new, kind != SPACE, offs)
        return low, a, b, row, kind[a] if len(a) else kind[:0]

    def batch(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): the ids of row i are ids[offsets[i]:offsets[i + 1]]."""
        if self.merges is None:
            got = [np.array(e.ids, np.uint32) for e in self.library.encode_batch(column.to_pylist(), add_special_tokens=False)]
            return np.concatenate([*got, np.zeros(0, np.uint32)]), np.concatenate([[0], np.cumsum([len(g) for g in got])]).astype(np.int64)
        data, offs = word_runs.column_bytes(column)
        low, a, b, row, kind = self._units(data, offs)
        lens = b - a
        plain = (kind != WHOLE) & (lens <= word_runs.KEY)
        ids, count = self._words(low, a[plain], lens[plain])
        counts = np.zeros(len(a), np.int64)
        counts[plain] = count
        other = np.flatnonzero(~plain)
        # A long word goes as it stands: the library lower-cases it itself.
        rest = self._library([data[a[i]:b[i]].tobytes() for i in other]) if len(other) else []
        counts[other] = [len(r) for r in rest]
        ends = np.cumsum(counts)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint32)
        flat = ids[np.arange(word_runs.KEY) < count[:, None]]
        if len(other):
            out[np.repeat(plain, counts)] = flat
            for i, r in zip(other, rest):
                out[ends[i] - len(r):ends[i]] = r
        else:
            out[:] = flat
        per = np.zeros(len(column) + 1, np.int64)
        per[1:] = np.cumsum(np.bincount(row, counts, len(column)).astype(np.int64)) if len(a) else 0
        return out, per

    def _words(self, low: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hi, lo = word_runs.packed(low, starts, lens)
        slot = (word_runs.mixed(hi, lo) % np.uint64(self.slots)).astype(np.int64)
        ids, count = self.ids[slot], self.count[slot].astype(np.int64)
        new = np.flatnonzero((self.hi[slot] != hi) | (self.lo[slot] != lo) | (count == 0))
        if len(new):
            at, code = word_runs.distinct(hi[new], lo[new])
            one = new[at]
            found, size = self.merges.tokens(
                np.stack([hi[one], lo[one]], 1).astype(">u8").view(np.uint8).reshape(-1, word_runs.KEY), lens[one])
            found = found.astype(np.uint16)
            ids[new], count[new] = found[code], size[code]
            put = slot[one]  # of words that share a slot the last one stays
            self.hi[put], self.lo[put], self.count[put], self.ids[put] = hi[one], lo[one], size, found
        return ids, count
