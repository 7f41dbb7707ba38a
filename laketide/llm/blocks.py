"""Texts of Arrow batches as numpy blocks: word spans and rolling hashes without a Python loop over bytes.

Hashes of spans come from prefix sums: sum of value[i] * P**i modulo 2**64, divided by P**start
(P is odd, so it has an inverse) and mixed. Equal spans have equal hashes; the operators compare
sets or whole spans of such hashes, or check the texts themselves where that matters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_INV = pow(_P, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer: every input bit reaches every output bit."""
    x = np.asarray(x, dtype=U)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=U) * U(0xD1B54A32D192ED03))
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.ones(size, dtype=U)
        np.cumprod(np.full(size - 1, base, dtype=U), out=have[1:])
        _powers[base] = have
    return have[:n]


class Sums:
    """Prefix sums of a value sequence; ``of`` gives the hashes of spans."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.inverse = _power(_INV, n + 1)
        self.sums = np.zeros(n + 1, dtype=U)
        np.cumsum(values * _power(_P, n), out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])


    def each(self, size: int) -> np.ndarray:
        """The hashes of all spans of ``size`` entries."""
        x = (self.sums[size:] - self.sums[:-size]) * self.inverse[: len(self.sums) - size]
        x ^= x >> U(32)
        x *= U(0xD6E8FEB86659FD93)
        x ^= x >> U(32)
        return x


def byte_values(buf: np.ndarray) -> np.ndarray:
    return _BYTE[buf]


class Block:
    """Some texts in one buffer, a blank after each; text i is ``buf[begin[i]:end[i]]``."""

    def __init__(self, first: int, texts: list[bytes]):
        self.first, self.texts = first, texts
        self.buf = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
        size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.begin = np.concatenate(([0], np.cumsum(size + 1)[:-1])) if len(texts) else np.zeros(0, np.int64)
        self.end = self.begin + size

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words, and for each text the number of its first word (one more entry at the end)."""
        inside = np.concatenate(([0], (~_IS_SPACE[self.buf]).view(np.int8), [0]))
        edges = np.flatnonzero(np.diff(inside))
        starts, ends = edges[::2], edges[1::2]
        return starts, ends, np.append(np.searchsorted(starts, self.begin), len(starts))


def text_bytes(column: pa.Array, lower: bool = False) -> list[bytes]:
    """UTF-8 bytes of each text, empty for null; ``lower`` maps A-Z only."""
    values = column.cast(pa.large_binary()).to_pylist()
    return [b"" if v is None else v.lower() if lower else v for v in values]


def slices(batch: pa.RecordBatch, column: int, limit: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of texts in ``column``, so few texts are held as Python objects at a time; a longer text is a slice alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    first, ends = 0, np.cumsum(sizes)
    while first < len(ends):
        done = ends[first - 1] if first else 0
        stop = max(first + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield batch.slice(first, stop - first)
        first = stop


def blocks(texts: list[bytes], limit: int = 1 << 20) -> Iterator[Block]:
    """Blocks of about ``limit`` bytes, so working arrays stay small; a longer text is a block alone."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield Block(first, texts[first:i])
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        yield Block(first, texts[first:])


def word_hashes(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word, and the first word of each text."""
    starts, ends, at = block.words()
    return Sums(byte_values(block.buf)).of(starts, ends), at


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of the ``k`` words from each place on; the last ``k - 1`` places have none."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U)
    got = words[:n].copy()
    for j in range(1, k):
        got = got * U(_P) + words[j : j + n]
    return mix(got)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
