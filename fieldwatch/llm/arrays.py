"""Rolling hashes over bytes and words as numpy arrays."""

from __future__ import annotations

import numpy as np

_RANDOM = np.random.default_rng(20240607)
#: A random odd base, its inverse modulo 2^64, and a random value for each byte.
BASE = np.uint64(int(_RANDOM.integers(2**61, 2**62)) * 2 + 1)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
BYTES = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_POWERS: dict = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base^0 .. base^n modulo 2^64; a worker keeps what it has computed."""
    key = int(base)
    if key not in _POWERS or len(_POWERS[key]) <= n:
        size = max(n + 1, 1 << 20)
        out = np.full(size, base, np.uint64)
        out[0] = 1
        _POWERS[key] = np.cumprod(out, dtype=np.uint64)
    return _POWERS[key][: n + 1]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    return h * np.uint64(0xD6E8FEB86659FD93)


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Running sums of value * base^position, from 0, modulo 2^64."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(BASE, len(values))[:-1], out=out[1:])
    return out


def window_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end], the same wherever the values stand."""
    return mixed((sums[ends] - sums[starts]) * powers(INVERSE, len(sums))[starts])


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array, each followed by a line end; the start of each and the end of all."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=offsets[1:])
    return data, offsets


def words(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = SPACE, values: np.ndarray = BYTES):
    """Start, end and hash of every word, and the first word of each text (plus their number)."""
    inside = ~breaks[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
    starts, ends = edge[::2], edge[1::2]
    hashes = window_hashes(prefix_sums(values[data]), starts, ends)
    return starts, ends, hashes, np.searchsorted(starts, offsets)


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` consecutive values."""
    n, have, out = len(values), 1, values
    while have * 2 <= width:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    extra = width - have
    return np.minimum(out[: n - width + 1], out[extra : extra + n - width + 1]) if n >= width else values[:0]
