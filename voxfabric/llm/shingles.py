"""Hashes of runs of words, computed in numpy inside tasks."""

from __future__ import annotations

import numpy as np

_RANDOM = np.random.default_rng(20240229)
#: A random odd multiplier, its inverse modulo 2**64, and a random number for each byte.
_BASE = np.uint64(_RANDOM.integers(1 << 62, 1 << 63) | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTES = _RANDOM.integers(0, 1 << 63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the multiplier and of its inverse, kept for the worker's next text (16 bytes a byte of the longest)."""
    have = len(_powers[0])
    if have <= n:
        more = max(n + 1, 1 << 16, 2 * have)
        with np.errstate(over="ignore"):
            for i, b in enumerate((_BASE, _INVERSE)):
                steps = np.full(more, b, np.uint64)
                steps[0] = 1
                _powers[i] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every bit of the result depends on every bit of x."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Words:
    """The words of a text (runs of bytes other than ASCII white space) and the hashes of their runs."""

    def __init__(self, text: str | None):
        # bytes.split() parts at \x20 and \x09-\x0D, which is the contracts' white space.
        self.words = (text or "").encode("utf-8", "surrogatepass").split()
        self.n = len(self.words)

    def runs(self, k: int) -> np.ndarray:
        """The 64-bit hash of each run of k words, by the place of its first word; equal runs have equal hashes in all texts."""
        if self.n < k or k < 1:
            return np.zeros(0, np.uint64)
        data = np.frombuffer(b" ".join(self.words), np.uint8)
        power, inverse = _power(len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[data] * power[: len(data)], out=sums[1:])
        blanks = np.flatnonzero(data == 32)
        starts = np.concatenate([[0], blanks + 1])
        ends = np.concatenate([blanks, [len(data)]])
        first, last = starts[: self.n - k + 1], ends[k - 1 :]
        with np.errstate(over="ignore"):
            return mix((sums[last] - sums[first]) * inverse[first])
