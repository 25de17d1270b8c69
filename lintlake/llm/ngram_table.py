"""Interning of n-grams: an open-addressed hash table in numpy arrays, keyed by xxhash64 and checked by bytes."""

from __future__ import annotations

import zlib

import numpy as np
import xxhash

from lintlake.llm.common import U64

# Fixed values of the XXH64 algorithm.
_P1, _P2, _P3, _P4, _P5 = (
    U64(0x9E3779B185EBCA87),
    U64(0xC2B2AE3D27D4EB4F),
    U64(0x165667B19E3779F9),
    U64(0x85EBCA77C2B2AE63),
    U64(0x27D4EB2F165667C5),
)
#: From this length on a key is hashed by the library, one by one.
_LONG = 32


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U64(r)) | (x >> U64(64 - r))


def _words(buf: np.ndarray, kind: str) -> np.ndarray:
    """The little-endian word that begins at each byte; `buf` has seven bytes of padding at least."""
    width = np.dtype(kind).itemsize
    return np.ndarray((len(buf) - width + 1,), kind, buf.data, 0, (1,))


def xxhash64(buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """XXH64 (seed 0) of the spans of `buf`, which ends in eight bytes of padding; short spans go together, by their eights, fours and rest."""
    out = sizes.astype(U64) + _P5
    wide, half = _words(buf, "<u8"), _words(buf, "<u4")
    short = np.flatnonzero(sizes < _LONG)
    h, at, left = out[short], starts[short].copy(), sizes[short].copy()
    for step in (8, 4, 1):
        while len(own := np.flatnonzero(left >= step)):
            here, x = at[own], h[own]
            if step == 8:
                x = _rotl(x ^ (_rotl(wide[here] * _P2, 31) * _P1), 27) * _P1 + _P4
            elif step == 4:
                x = _rotl(x ^ (half[here].astype(U64) * _P1), 23) * _P2 + _P3
            else:
                x = _rotl(x ^ (buf[here].astype(U64) * _P5), 11) * _P1
            h[own] = x
            at[own] += step
            left[own] -= step
    h = (h ^ (h >> U64(33))) * _P2
    h = (h ^ (h >> U64(29))) * _P3
    out[short] = h ^ (h >> U64(32))
    for k in np.flatnonzero(sizes >= _LONG).tolist():
        out[k] = xxhash.xxh64_intdigest(buf[starts[k] : starts[k] + sizes[k]])
    return out


def equal_spans(buf: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the spans of `sizes` bytes at `a` and at `b` hold the same bytes (with seven bytes of padding after the last)."""
    wide = _words(buf, "<u8")
    same = np.ones(len(a), bool)
    own, done = np.flatnonzero(sizes > 0), 0
    while len(own):
        left = np.minimum(sizes[own] - done, 8)
        differ = (wide[a[own] + done] ^ wide[b[own] + done]) << ((8 - left) * 8).astype(U64)
        same[own[differ != 0]] = False
        done += 8
        own = own[(differ == 0) & (sizes[own] > done)]
    return same


class NgramTable:
    """The distinct n-grams of some occurrences: open addressing with linear probing.

    `bucket` and `count` stand in slots; `slot_of` has the slot of each occurrence, so a value by bucket is gathered for
    occurrences by their slots. Two n-grams share a slot only if their bytes agree: equal hashes alone do not.
    """

    def __init__(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, buckets: int) -> None:
        """Intern the spans [start, end) of `buf`, which ends in eight bytes of padding."""
        sizes = ends - starts
        self.slots = 1 << max(4, (2 * len(starts)).bit_length())
        self.first = np.full(self.slots, -1, np.int64)  # the occurrence whose bytes are the key of the slot
        self.slot_of = np.zeros(len(starts), np.int64)
        hashes = xxhash64(buf, starts, sizes)
        todo, at = np.arange(len(starts)), (hashes & U64(self.slots - 1)).astype(np.int64)
        while len(todo):
            free = self.first[at] < 0
            self.first[at[free]] = todo[free]  # of several that want a free slot, the last one written has it
            owner = self.first[at]
            hit = (hashes[owner] == hashes[todo]) & (sizes[owner] == sizes[todo])
            check = np.flatnonzero(hit & (owner != todo))
            hit[check] = equal_spans(buf, starts[owner[check]], starts[todo[check]], sizes[todo[check]])
            self.slot_of[todo[hit]] = at[hit]
            todo, at = todo[~hit], (at[~hit] + 1) & (self.slots - 1)
        self.count = np.bincount(self.slot_of, minlength=self.slots)
        self.used = np.flatnonzero(self.first >= 0)
        self.bucket = np.zeros(self.slots, np.int64)
        raw, own = buf.tobytes(), self.first[self.used]
        self.bucket[self.used] = [zlib.crc32(raw[a:z]) % buckets for a, z in zip(starts[own].tolist(), ends[own].tolist(), strict=True)]

    def bucket_counts(self, buckets: int) -> np.ndarray:
        """Occurrences by bucket."""
        return np.bincount(self.bucket[self.used], weights=self.count[self.used], minlength=buckets).astype(np.int64)

    def gather(self, by_bucket: np.ndarray) -> np.ndarray:
        """For each occurrence the value of its bucket."""
        by_slot = np.zeros(self.slots, by_bucket.dtype)
        by_slot[self.used] = by_bucket[self.bucket[self.used]]
        return by_slot[self.slot_of]
