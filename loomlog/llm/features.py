"""Hashed n-gram counts of whole texts, with numpy."""

from __future__ import annotations

import functools

import numpy as np

#: Odd multipliers of the positions in an n-gram, and of the last mix.
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], dtype=np.uint32)


def ngram_counts(codes: np.ndarray, bits: int, orders: tuple[int, ...]) -> np.ndarray:
    """Counts of the n-grams of ``codes`` (uint32) in 2**bits buckets, all ``orders`` together."""
    out = np.zeros(1 << bits, np.int64)
    for n in orders:
        if len(codes) < n:
            continue
        h = codes[: len(codes) - n + 1] * _MIX[0]
        for k in range(1, n):
            h = h + codes[k : len(codes) - n + 1 + k] * _MIX[k]
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * n)
        out += np.bincount(h >> np.uint32(32 - bits), minlength=1 << bits)
    return out


@functools.cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x10000)])


def letter_codes(text: str) -> np.ndarray | None:
    """Code points of the lower-case text with every run of other characters as one space, a space at either end; None if there is no letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    known = _letters()[np.minimum(codes, 0xFFFF)]
    far = np.flatnonzero(codes > 0xFFFF)
    if len(far):
        known[far] = [chr(c).isalpha() for c in codes[far].tolist()]
    if not known.any():
        return None
    codes = np.concatenate([[np.uint32(32)], np.where(known, codes, np.uint32(32)), [np.uint32(32)]]).astype(np.uint32)
    blank = codes == 32
    return codes[~(blank & np.concatenate([[False], blank[:-1]]))]


def unit(counts: np.ndarray) -> np.ndarray:
    """Square roots of counts, scaled to length 1: what repeats counts less."""
    x = np.sqrt(counts.astype(np.float32))
    return x / max(float(np.sqrt((x * x).sum())), 1e-9)
