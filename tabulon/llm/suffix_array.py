"""Suffix sorting in two stages, on whole arrays.

Only the suffixes that are smaller than their successors are sorted directly, by their first DEPTH bytes.  The others
are induced by one scan over the buckets of first bytes: whoever stands next in order hands its predecessor in the
text on to that one's bucket.  Order and common prefixes are exact up to DEPTH bytes, which is all that is asked for.
"""

from __future__ import annotations

import numpy as np

DEPTH = 56


def _words(text: np.ndarray) -> list[np.ndarray]:
    """The big-endian 64-bit words at every position, 0, 8, ... bytes on; zeros follow the end."""
    padded = np.concatenate([text, np.zeros(DEPTH + 8, np.uint8)])
    at = np.lib.stride_tricks.as_strided(padded.view(), (len(text) + DEPTH, 8), (1, 1))
    word = np.ascontiguousarray(at).view(">u8").ravel().astype(np.uint64)
    return [word[k : k + len(text)] for k in range(0, DEPTH, 8)]


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than the suffix that begins one byte later; the end counts as smallest."""
    n = len(text)
    change = np.flatnonzero(text[1:] != text[:-1])
    rises = text[change + 1] > text[change]
    nth = np.searchsorted(change, np.arange(n))  # the next change at or after each position
    return np.append(rises, False)[nth]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Positions of all suffixes in order of their first DEPTH bytes."""
    n = len(text)
    if n == 0:
        return np.empty(0, np.int64)
    small = smaller_than_next(text)
    direct = np.flatnonzero(small)
    words = _words(text)
    direct = direct[np.lexsort([w[direct] for w in reversed(words)])]
    heads = text[direct]
    bounds = np.searchsorted(heads, np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]

    def hand_on(order: np.ndarray, bucket: int) -> np.ndarray:
        """Give the predecessors of `order` to their buckets; those of this very bucket are returned."""
        before = order[order > 0] - 1
        before = before[~small[before]]
        head = text[before]
        for c in np.unique(head[head != bucket]).tolist():
            induced[c].append(before[head == c])
        return before[head == bucket]

    induced[int(text[-1])].append(np.array([n - 1]))
    out = []
    for c in range(256):
        wave = np.concatenate(induced[c]) if induced[c] else np.empty(0, np.int64)
        while len(wave):
            out.append(wave)
            wave = hand_on(wave, c)
        own = direct[bounds[c] : bounds[c + 1]]
        out.append(own)
        hand_on(own, c)
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each suffix shares with the one before it in `order`, up to DEPTH; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    if len(order) < 2:
        return out
    equal = np.arange(1, len(order))
    for word in _words(text):
        differ = word[order[equal]] ^ word[order[equal - 1]]
        same = differ == 0
        bits = np.floor(np.log2(np.maximum(differ, 1).astype(np.float64)))
        # the conversion to a double may round up to the next power of two: step back where it did
        bits = np.where((bits > 0) & ((differ >> np.minimum(bits, 63).astype(np.uint64)) == 0), bits - 1, bits)
        out[equal] += np.where(same, 8, 7 - bits.astype(np.int64) // 8)
        equal = equal[same]
    return out
