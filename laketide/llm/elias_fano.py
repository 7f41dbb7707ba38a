"""Elias-Fano coded monotone sequences and an n-gram trie over them, as flat bytes that can be memory-mapped."""

from __future__ import annotations

import numpy as np

_ONES = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)
# place of the (r+1)-th set bit of a byte
_SELECT = np.zeros((256, 8), dtype=np.uint8)
for _b in range(256):
    for _r, _p in enumerate([i for i in range(8) if _b >> i & 1]):
        _SELECT[_b, _r] = _p


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values in order. By sorting: numpy's ``unique`` hashes large arrays, which took much longer."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


class EliasFano:
    """A non-decreasing sequence: low bits packed, high bits in unary, found by select over a byte directory."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ranks: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.ranks = n, low_bits, low, high, ranks

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        n, top = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (max(1, top) // max(1, n)).bit_length() - 1)
        v = values.astype(np.int64)
        bits = (v[:, None] >> np.arange(low_bits)) & 1
        low = np.packbits(bits.astype(np.uint8).reshape(-1), bitorder="little")
        where = (v >> low_bits) + np.arange(n)
        unary = np.zeros((int(where[-1]) + 1 if n else 0) + 63 & ~63, dtype=np.uint8)
        unary[where] = 1
        high = np.packbits(unary, bitorder="little")
        ranks = np.concatenate(([0], np.cumsum(_ONES[high], dtype=np.int64)[7::8])).astype(np.uint32)  # set bits before each 8th byte
        return cls(n, low_bits, np.append(low, np.zeros(8, np.uint8)), np.append(high, np.zeros(16, np.uint8)), ranks)

    def __getitem__(self, index: np.ndarray) -> np.ndarray:
        index = np.asarray(index, dtype=np.int64)
        group = np.searchsorted(self.ranks, index, side="right") - 1
        rest = index - self.ranks[group]
        at = group * 8
        for _ in range(7):
            ones = _ONES[self.high[at]]
            ahead = rest >= ones
            rest = rest - np.where(ahead, ones, 0)
            at = at + ahead
        place = at * 8 + _SELECT[self.high[at], np.minimum(rest, 7)]
        out = (place - index) << self.low_bits
        if self.low_bits:
            start = index * self.low_bits
            byte, value = start >> 3, np.zeros(len(index), dtype=np.int64)
            for j in range((self.low_bits + 14) // 8):
                value |= self.low[byte + j].astype(np.int64) << (8 * j)
            out |= (value >> (start & 7)) & ((1 << self.low_bits) - 1)
        return out

    def parts(self) -> tuple[list[int], list[np.ndarray]]:
        return [self.n, self.low_bits, len(self.low), len(self.high), len(self.ranks)], [self.low, self.high, self.ranks.view(np.uint8)]


class Trie:
    """Byte strings of up to ``depth`` bytes. Level j holds, in order, the last byte of every prefix of j bytes.

    ``pointers[j]`` gives where the children of a level's nodes begin on the next level (a monotone
    sequence). Two arrays of 16-bit codes per level are the payload.
    """

    def __init__(self, symbols: list[np.ndarray], codes: list[list[np.ndarray]], pointers: list[EliasFano]):
        self.symbols, self.codes, self.pointers = symbols, codes, pointers

    @classmethod
    def build(cls, strings: np.ndarray, depth: np.ndarray, payload: np.ndarray, context_payload: np.ndarray, levels: int) -> Trie:
        """``strings`` are left-aligned big-endian numbers of ``levels`` bytes with their ``depth``.

        ``payload`` belongs to the node of a string, ``context_payload`` to its parent.
        """
        symbols, codes, pointers, parents = [], [], [], np.zeros(1, dtype=np.uint64)
        context = np.zeros(1, dtype=np.uint16)
        one = depth == 1
        if one.any():
            context[0] = context_payload[one][0]
        nodes = [parents]
        contexts = [context]
        for j in range(1, levels + 1):
            shift = np.uint64(8 * (levels - j))
            level = distinct(strings[depth >= j] >> shift)
            own, below = np.zeros(len(level), dtype=np.uint16), np.zeros(len(level), dtype=np.uint16)
            here, deeper = depth == j, depth == j + 1
            own[np.searchsorted(level, strings[here] >> shift)] = payload[here]
            below[np.searchsorted(level, strings[deeper] >> shift)] = context_payload[deeper]
            begin = np.searchsorted(level >> np.uint64(8), nodes[-1]) if j > 1 else np.zeros(1, dtype=np.int64)
            pointers.append(EliasFano.build(np.append(begin, len(level))))
            symbols.append((level & np.uint64(255)).astype(np.uint8))
            codes.append([own, below])
            nodes.append(level)
            contexts.append(below)
        codes.insert(0, [np.zeros(1, np.uint16), contexts[0]])
        return cls(symbols, codes, pointers)

    def find(self, strings: np.ndarray, depth: int, levels: int) -> tuple[np.ndarray, np.ndarray]:
        """Payloads of strings of ``depth`` bytes and of their parents; 0 where there is no such node."""
        node = np.zeros(len(strings), dtype=np.int64)
        live = np.ones(len(strings), dtype=bool)
        own, parent = np.zeros(len(strings), dtype=np.uint16), np.zeros(len(strings), dtype=np.uint16)
        for j in range(depth):
            symbol = ((strings >> np.uint64(8 * (levels - 1 - j))) & np.uint64(255)).astype(np.uint8)
            if j == depth - 1:
                parent[live] = self.codes[j][1][node[live]]
            lo, hi = self.pointers[j][node[live]], self.pointers[j][node[live] + 1]
            at, end, want, level = lo, hi.copy(), symbol[live], self.symbols[j]
            for _ in range(9):  # successor of the symbol among at most 256 children
                open_ = at < end
                middle = (at + end) >> 1
                less = open_ & (level[np.minimum(middle, len(level) - 1)] < want) if len(level) else open_
                end = np.where(open_ & ~less, middle, end)
                at = np.where(less, middle + 1, at)
            found = (at < hi) & (level[np.minimum(at, len(level) - 1)] == want) if len(level) else np.zeros(len(at), dtype=bool)
            places = np.flatnonzero(live)
            live[places[~found]] = False
            node[places[found]] = at[found]
        own[live] = self.codes[depth][0][node[live]]
        return own, parent

    def tobytes(self) -> bytes:
        head, body = [len(self.symbols)], []
        for pointer in self.pointers:
            numbers, arrays = pointer.parts()
            head += numbers
            body += arrays
        for s in self.symbols:
            head.append(len(s))
            body.append(s)
        for own, below in self.codes:
            head.append(len(own))
            body += [own, below]
        return np.array([len(head), *head], dtype=np.int64).tobytes() + b"".join(a.tobytes() for a in body)

    @classmethod
    def view(cls, raw: np.ndarray) -> Trie:
        """The trie in a buffer of bytes (a memory map); arrays are views of it."""
        size = int(raw[:8].view(np.int64)[0])
        head = raw[8 : 8 + 8 * size].view(np.int64).tolist()
        at, levels = 8 + 8 * size, head[0]

        def take(n: int) -> np.ndarray:
            nonlocal at
            at += n
            return raw[at - n : at]

        pointers, k = [], 1
        for _ in range(levels):
            n, bits, a, b, c = head[k : k + 5]
            k += 5
            low, high = take(a), take(b)
            pointers.append(EliasFano(n, bits, low, high, np.frombuffer(take(4 * c).tobytes(), np.uint32)))
        symbols = [take(head[k + j]) for j in range(levels)]
        k += levels
        codes = [[take(2 * head[k + j]).view(np.uint16), take(2 * head[k + j]).view(np.uint16)] for j in range(levels + 1)]
        return cls(symbols, codes, pointers)
