"""64-bit hashes of words and of runs of words or bytes, vectorised."""

from __future__ import annotations

import numpy as np
import xxhash

from . import _common as c

_U = np.uint64
#: Words (of 64 bytes at most) whose hashes a worker keeps.
MEMO_WORDS = 200_000


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits (splitmix64)."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    memo = c.kept("words")
    if len(memo) > MEMO_WORDS:
        memo.clear()
    get, digest = memo.get, xxhash.xxh3_64_intdigest
    out = [get(w) or (memo.setdefault(w, digest(w) or 1) if len(w) <= 64 else digest(w) or 1) for w in words]
    return np.array(out, np.uint64)


def multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(20_240_607).integers(0, 2**64, n, np.uint64) | _U(1)


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each run of ``n`` consecutive entries of ``h``: a polynomial of their mixed hashes, finalised.

    Runs are rolled in blocks by prefix sums modulo 2**64, so the cost does not depend on ``n``."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    return mix(roll(h, n))


_BASE = _U(0x9E3779B97F4A7C15 | 1)


def powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    p = np.empty(n, np.uint64)
    p[0] = 1
    done = 1
    while done < n:  # doubling
        take = min(done, n - done)
        step = p[done - 1] * base
        p[done : done + take] = p[:take] * step
        done += take
    return p


#: Powers of the base and of its inverse, up to the longest text so far that has no more words or bytes than this.
KEPT_POWERS = 1 << 20
_POW: list[tuple[np.ndarray, np.ndarray]] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _POW and len(_POW[0][0]) >= n:
        up, down = _POW[0]
    else:
        size = 1 << max(12, (n - 1).bit_length())
        up, down = powers(size), powers(size, _U(pow(int(_BASE), -1, 2**64)))
        if size <= KEPT_POWERS:
            _POW[:] = [(up, down)]
    return up[:n], down[:n]


def roll(h: np.ndarray, n: int) -> np.ndarray:
    """sum of h[i + j] * B**j for j < n, modulo 2**64, for each i."""
    with np.errstate(over="ignore"):
        up, down = _powers(len(h))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * up, dtype=np.uint64)))
        m = len(h) - n + 1
        return (total[n:] - total[:m]) * down[:m]
