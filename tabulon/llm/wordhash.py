"""Words of many texts at once, as 64-bit numbers, straight from Arrow's UTF-8 buffers."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa

def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(1)
def _table() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array without nulls, and where each text begins (one more entry for the end)."""
    if not pa.types.is_string(texts.type):
        texts = texts.cast(pa.string())
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.empty(0, np.uint8)
    return raw, offsets - offsets[0]


_STEP = np.uint64(0x9E3779B97F4A7C15)
EXACT_BYTES = 1_000_000  # so many bytes are compared at once


def of_ranges(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each values[start:end] of disjoint ranges in order: sums of a mix of each value with its place.

    Equal contents have equal numbers.  No contents are known to clash by their structure, but a number proves nothing:
    where equality decides a result, exact_groups() settles it.
    """
    size = ends - starts
    total = int(size.sum())
    shift = starts - (np.cumsum(size) - size)
    at = np.arange(total)
    own = values[at + np.repeat(shift, size)] if total else values[:0]
    within = (at - np.repeat(np.cumsum(size) - size, size)).astype(np.uint64)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(own.astype(np.uint64) * _STEP + mix(within + np.uint64(1))), dtype=np.uint64)])
    to = np.cumsum(size)
    return mix(sums[to] - sums[to - size] + size.astype(np.uint64) * _STEP)


BASE = np.uint64(0x9E3779B97F4A7C55)  # odd, so that it has an inverse among 64-bit numbers
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        x = np.full(max(n, 1 << 21), base, np.uint64)
        x[0] = 1
        have = _powers[int(base)] = np.multiply.accumulate(x)
    return have[:n]


class Polynomial:
    """Prefix sums of a polynomial over bytes, which give any stretch's number at once (Rabin-Karp): that of its contents,
    wherever they stand."""

    def __init__(self, raw: np.ndarray):
        own = byte_values(raw)
        self.prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own * _power(BASE, len(own)), dtype=np.uint64)])
        self.down = _power(INVERSE, len(own) + 1)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.prefix[ends] - self.prefix[starts]) * self.down[starts]


def of_stretches(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each raw[start:end] of ranges in order, some bytes at a time; like of_ranges() a key, not a proof."""
    out = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + 2 * EXACT_BYTES, side="right")))
        a, z = starts[lo:hi] - starts[lo], ends[lo:hi] - starts[lo]
        out[lo:hi] = mix(Polynomial(raw[starts[lo] : ends[hi - 1]]).of(a, z) + (z - a).astype(np.uint64) * _STEP)
        lo = hi
    return out


def of_windows(values: np.ndarray, starts: np.ndarray, width: int, ends: np.ndarray | None = None) -> np.ndarray:
    """A number for each values[start:start + width], or shorter where `ends` comes first."""
    out = np.zeros(len(starts), np.uint64)
    for k in range(width):
        at = starts + k
        if ends is None:
            out = mix(out * _STEP + values[at])
        else:
            there = at < ends
            out = np.where(there, mix(out * _STEP + values[np.where(there, at, 0)]), out) if len(values) else out
    return out


def equal_ranges(values: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Is values[a:a + size] equal to values[b:b + size], for many ranges, some of them at a time."""
    out = np.ones(len(a), bool)
    cut = np.cumsum(size)
    lo = 0
    while lo < len(a):
        hi = max(lo + 1, int(np.searchsorted(cut, (cut[lo - 1] if lo else 0) + EXACT_BYTES, side="right")))
        n = size[lo:hi]
        if hi == lo + 1:
            out[lo] = np.array_equal(values[a[lo] : a[lo] + n[0]], values[b[lo] : b[lo] + n[0]])
        else:
            within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            differ = values[np.repeat(a[lo:hi], n) + within] != values[np.repeat(b[lo:hi], n) + within]
            total = np.concatenate([[0], np.cumsum(differ)])
            to = np.cumsum(n)
            out[lo:hi] = total[to] == total[to - n]
        lo = hi
    return out


def exact_groups(keys: np.ndarray, same) -> np.ndarray:
    """For each item the first item that equals it.  Keys deal out the work; same(i, j), on arrays of items, decides."""
    order = np.argsort(keys, kind="stable")
    fresh = np.ones(len(keys), bool)
    fresh[1:] = keys[order][1:] != keys[order][:-1]
    first = np.empty(len(keys), np.int64)
    first[order] = order[fresh][np.cumsum(fresh) - 1] if len(keys) else order
    todo = np.flatnonzero(first != np.arange(len(keys)))
    while len(todo):
        odd = todo[~same(todo, first[todo])]
        _, at, group = np.unique(first[odd], return_index=True, return_inverse=True)
        first[odd] = odd[at][group]  # what only shares the key makes groups of its own
        todo = odd[first[odd] != odd]
    return first


def exact_ranges(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """exact_groups() of values[start:end]."""
    size = ends - starts

    def same(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = size[i] == size[j]
        at = np.flatnonzero(out)
        out[at] = equal_ranges(values, starts[i[at]], starts[j[at]], size[i[at]])
        return out

    return exact_groups(keys, same)


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True within each text, and how many runs each text has."""
    n = len(inside)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) if n else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate([inside[1:], [False]]) if n else inside
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


@lru_cache(1)
def _plain() -> tuple[np.ndarray, np.ndarray]:
    """Bytes of words (0-9, letters, beyond ASCII), and A-Z lower-cased."""
    word = np.zeros(256, bool)
    word[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    return word, lower


def plain_ranges(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes with A-Z lower-cased, where each word starts and ends, and words per text."""
    word, lower = _plain()
    starts, ends, per_text = runs(word[raw], offsets)
    return lower[raw], starts, ends, per_text


def plain_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word (A-Z lower-cased; between words ASCII without letters and digits), and words per text."""
    plain, starts, ends, per_text = plain_ranges(raw, offsets)
    return of_ranges(plain, starts, ends), per_text


def plain_digests(raw: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """A 128-bit BLAKE2 digest of each text's words, a blank between them; empty without words."""
    word, lower = _plain()
    inside = word[raw]
    first_after = np.zeros(len(raw), bool)
    first_after[1:] = ~inside[1:] & inside[:-1]
    kept = inside | first_after
    out = np.where(inside, lower[raw], 32).astype(np.uint8)[kept]
    cut = np.concatenate([[0], np.cumsum(kept)])[offsets]
    whole = [out[a:z].tobytes().strip() for a, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
    return [hashlib.blake2b(x, digest_size=16).digest() if x else b"" for x in whole]


def byte_values(raw: np.ndarray) -> np.ndarray:
    return _table()[raw]
