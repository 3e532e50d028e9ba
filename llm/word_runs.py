"""Texts of an Arrow batch as one byte array: runs of bytes, and runs as exact
integer keys (numpy; shared by the operators that read every word)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes that a key holds.
KEY = 16
_TOP = np.array([0] + [(1 << 64) - (1 << (64 - 8 * i)) for i in range(1, 9)], np.uint64)


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column without nulls: row i is
    bytes[offsets[i]:offsets[i + 1]]."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    offs = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    found = np.frombuffer(data, np.uint8)[offs[0]:offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return found, offs - offs[0]


def runs(first: np.ndarray, inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of the runs of ``inside`` bytes; a run also ends
    before a byte marked ``first`` and at the end of its row."""
    if not len(inside):
        return (np.zeros(0, np.int64),) * 3
    edge = first.copy()
    edge[offs[:-1][offs[:-1] < len(inside)]] = True
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (edge | ~before))
    stop = np.ones(len(inside), bool)
    stop[:-1] = edge[1:] | ~inside[1:]
    ends = np.flatnonzero(inside & stop) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def packed(data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first ``KEY`` bytes of each run as two big-endian words, zeros after
    the run's end: runs without zero bytes, of at most KEY, equal as their
    keys do, and order as their bytes do."""
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    window = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(KEY, np.uint8)]), 8)
    hi = window[starts].view(">u8")[:, 0].astype(np.uint64) & _TOP[np.minimum(lens, 8)]
    lo = window[starts + np.minimum(lens, 8)].view(">u8")[:, 0].astype(np.uint64) & _TOP[np.clip(lens - 8, 0, 8)]
    return hi, lo


def cut(hi: np.ndarray, lo: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys of the first ``width`` bytes."""
    return hi & _TOP[min(width, 8)], lo & _TOP[min(max(width - 8, 0), 8)]


def unpacked(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """The bytes of keys (numpy drops the zeros at the end)."""
    return np.stack([hi, lo], 1).astype(">u8").view("S16")[:, 0]


def mixed(*words: np.ndarray) -> np.ndarray:
    """A 64-bit hash of rows of words (odd multipliers and shifts)."""
    h = np.zeros(len(words[0]), np.uint64)
    for w in words:
        h = (h ^ w) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(32))


def distinct(*words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of one row of each distinct row, code of every row), exact."""
    _, at, code = np.unique(mixed(*words), return_index=True, return_inverse=True)
    if all((w[at][code] == w).all() for w in words):
        return at, code
    rows = np.stack(words, 1)  # two rows share a hash
    _, at, code = np.unique(rows, axis=0, return_index=True, return_inverse=True)
    return at, code.reshape(-1)
