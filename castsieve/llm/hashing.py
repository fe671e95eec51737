"""Words of many texts as 64-bit hashes, by array operations on their UTF-8 bytes.

A word is a run of bytes of a given class.  Classes keep all bytes above 0x7F
together, so a character is never cut.  Hashes are polynomial prefix sums over a
fixed random value per byte, followed by a mixing step; equal words have equal
hashes in every process.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# Bytes hashed at once; a longer single word extends its block.
BLOCK_BYTES = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(inside) -> np.ndarray:
    return np.array([bool(inside(b)) for b in range(256)])


# Runs of anything but blank and control white space.
SPACED = byte_class(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
# Digits, lower-case letters (after lower-casing) and everything beyond ASCII.
LETTERS_DIGITS = byte_class(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWERS: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS[:] = [_powers(_BASE, max(n, BLOCK_BYTES + 1)), _powers(_INVERSE, max(n, BLOCK_BYTES + 1))]
    return _POWERS[0], _POWERS[1]


@dataclass
class Words:
    """Words of several texts in order; those of text i are ``first[i]:first[i + 1]``."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    data: np.ndarray

    def text(self, word: int) -> bytes:
        return self.data[self.starts[word] : self.ends[word]].tobytes()


def words(texts: list[str | None], inside: np.ndarray) -> Words:
    """The lower-cased (A-Z only) words of the texts; null has none."""
    encoded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    joined = b"\n".join(encoded) + b"\n"
    data = LOWER[np.frombuffer(joined, dtype=np.uint8)]
    mask = inside[data]
    edges = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0))
    starts, ends = edges[0::2], edges[1::2]
    offsets = np.cumsum([0] + [len(e) + 1 for e in encoded])
    first = np.searchsorted(starts, offsets)
    hashes = np.empty(len(starts), dtype=np.uint64)
    done = 0
    while done < len(starts):
        low = starts[done]
        until = max(done + 1, int(np.searchsorted(ends, low + BLOCK_BYTES, side="right")))
        high = ends[until - 1]
        up, down = _tables(int(high - low) + 1)
        sums = np.zeros(int(high - low) + 1, dtype=np.uint64)
        np.cumsum(_VALUES[data[low:high]] * up[: high - low], out=sums[1:])
        a, b = starts[done:until] - low, ends[done:until] - low
        hashes[done:until] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
        done = until
    return Words(hashes, starts, ends, first, data)


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words; of the whole sequence when it is shorter; none without words."""
    if len(hashes) == 0:
        return hashes
    n = min(n, len(hashes))
    out = np.full(len(hashes) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        out = mix(out * np.uint64(_BASE) + hashes[k : len(hashes) - n + 1 + k])
    return out


def gram_bins(codes: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The hash bin of the n-gram that starts at each place but the last n - 1."""
    size = max(0, len(codes) - n + 1)
    h = np.full(size, n, dtype=np.uint32)
    for k in range(n):
        h = (h ^ codes[k : k + size]) * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
    return (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)
