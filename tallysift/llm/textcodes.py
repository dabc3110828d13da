"""Batches of texts as flat numpy arrays."""

from __future__ import annotations

import numpy as np


def flat(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another, and the start of each and the end of the last."""
    ends = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=ends[1:])
    return np.frombuffer(b"".join(texts), np.uint8), ends


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit numbers (the SplitMix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: A fixed 64-bit number for each symbol below 256 and an odd base of the rolling hash.
SYMBOL = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BASE = 0xD1342543DE82EF95
UNBASE = pow(BASE, -1, 1 << 64)


#: Powers that are kept: those of a base, up to so many.
KEPT = 1 << 22
_kept: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base ** 2, ... modulo 2 ** 64."""
    if n > KEPT:
        return _powers(base, n)
    if len(_kept.get(base, ())) < n:
        _kept[base] = _powers(base, n)
        _kept[base].setflags(write=False)
    return _kept[base][:n]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    filled = 1
    while filled < n:
        step = np.uint64(pow(base, filled, 1 << 64))
        m = min(filled, n - filled)
        out[filled : filled + m] = out[:m] * step
        filled += m
    return out


def sums(values: np.ndarray) -> np.ndarray:
    """Prefix sums, modulo 2 ** 64, with a leading zero, of values[i] * BASE ** i."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(BASE, len(values)), out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end); equal spans have equal hashes wherever they stand."""
    return mixed((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def runs(inside: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the maximal runs of true; a run stops where its text ends."""
    edge = np.zeros(len(inside) + 1, bool)
    edge[ends] = True
    before = np.concatenate([[False], inside[:-1]]) if len(inside) else inside
    after = np.concatenate([inside[1:], [False]]) if len(inside) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    stops = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, stops, np.searchsorted(ends, starts, side="right") - 1


def word_spans(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes other than 0x20 and 0x09 to 0x0D."""
    return runs(~((raw == 32) | ((raw >= 9) & (raw <= 13))), ends)
