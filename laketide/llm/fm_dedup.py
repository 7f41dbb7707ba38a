"""Repeated word sequences by an FM-index per shard.

Fragments that may repeat (see ``fragments``) meet in a shard, words as hashes. A shard gets one
FM-index: the Burrows-Wheeler transform of its fragments, kept as a wavelet matrix. The fragments
are then streamed through it. From every word, backward search goes on while the sequence
occurs at least twice in the shard: that is its matching statistic, up to ``LENGTH`` words. The
places that reach ``LENGTH`` end a repeated window.

Defined results: null or empty text has 0 words; fewer than ``LENGTH`` words lose nothing;
repeated rows are copies of each other; null ids are allowed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laketide.llm.common import packed, ship_code
from laketide.llm.fragments import covered, repeated_windows

LENGTH = 35
GRAM = 8


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """All suffixes in order by at least ``depth`` symbols, by prefix doubling."""
    n = len(text)
    rank, done = text.astype(np.int64), 1
    while True:
        ahead = np.full(n, -1, dtype=np.int64)
        ahead[: max(0, n - done)] = rank[done:]
        both = rank * (n + 1 + int(text.max())) + ahead + 1
        order = np.argsort(both)  # suffixes that agree in so many symbols may stand in any order
        new = np.zeros(n, dtype=np.int64)
        both = both[order]
        new[1:] = both[1:] != both[:-1]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(new)
        done *= 2
        if done >= depth or rank[order[-1]] == n - 1:
            return order


class FMIndex:
    """Backward search over a wavelet matrix; many searches advance together."""

    def __init__(self, text: np.ndarray, depth: int):
        symbols = int(text.max(initial=0)) + 1
        order = suffix_order(text, depth)
        level = text[order - 1]
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=symbols))))
        self.bits = max(1, int(symbols - 1).bit_length())
        self.zeros = []
        for bit in reversed(range(self.bits)):
            one = (level >> bit) & 1
            self.zeros.append(np.concatenate(([0], np.cumsum(1 - one))).astype(np.int32))
            level = np.concatenate((level[one == 0], level[one == 1]))
        every = np.arange(symbols)
        (self.base,) = self._walk(every, np.zeros(symbols, dtype=np.int64))

    def _walk(self, symbol: np.ndarray, *places: np.ndarray) -> list[np.ndarray]:
        out = list(places)
        for bit, zeros in zip(reversed(range(self.bits)), self.zeros, strict=True):
            one = (symbol & (1 << bit)).astype(bool)
            for i, at in enumerate(out):
                low = zeros.take(at)
                out[i] = np.where(one, at - low + zeros[-1], low)
        return out

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranges of the patterns with one more symbol in front."""
        shift = self.first[symbol] - self.base[symbol]
        lo, hi = self._walk(symbol, lo, hi)
        return lo + shift, hi + shift


def matching_statistics(text: np.ndarray, begin: np.ndarray, length: int) -> np.ndarray:
    """For each place, how many symbols up to it (``length`` at most, back to ``begin``) occur twice or more."""
    index = FMIndex(text, length + 1)
    reach = np.zeros(len(text), dtype=np.int64)
    live = np.flatnonzero(np.arange(len(text)) >= begin)
    lo, hi = index.first[text[live]], index.first[text[live] + 1]
    for m in range(1, length + 1):
        many = hi - lo > 1
        live, lo, hi = live[many], lo[many], hi[many]
        reach[live] = m
        more = live - m >= begin[live]
        live, lo, hi = live[more], lo[more], hi[more]
        if m == length or not len(live):
            break
        lo, hi = index.extend(text[live - m], lo, hi)
    return reach


def flags_of_shard(pieces: list[bytes], counts: list[int], length: int = LENGTH) -> list[np.ndarray]:
    """For each piece, which of its first ``counts`` windows occur at another place of the shard."""
    words = [np.frombuffer(p, np.uint64) for p in pieces]
    if not sum(map(len, words)):
        return [np.zeros(c, dtype=bool) for c in counts]
    name = np.unique(np.concatenate(words), return_inverse=True)[1] + 2
    size = np.array([len(w) for w in words])
    start = np.concatenate(([0], np.cumsum(size + 1)[:-1]))  # a separator follows each piece
    text = np.ones(int((size + 1).sum()) + 1, dtype=np.int64)
    text[-1] = 0
    begin = np.full(len(text), len(text))
    owner = np.repeat(np.arange(len(words)), size)
    at = start[owner] + np.arange(len(owner)) - np.concatenate(([0], np.cumsum(size)[:-1]))[owner]
    text[at], begin[at] = name, start[owner]
    reach = matching_statistics(text, begin, length)
    return [reach[s + length - 1 : s + length - 1 + c] >= length for s, c in zip(start, counts, strict=True)]


def removed(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, into: str = "repeats", with_text: bool = True, **sizes) -> DataFrame:
    """Every row of ``docs`` with a struct: word counts, the hash of the kept words and, if wanted, those words."""
    ship_code(docs.sparkSession)
    row = docs.select(packed(docs).alias("row")).withColumn("mark", F.xxhash64("row.text"))
    keyed = row.select(F.col("row.doc_id").alias("doc_id"), "mark", F.col("row.text").alias("text"))

    def index(pieces, counts, leads):
        return flags_of_shard(pieces, counts, length)

    spans = repeated_windows(keyed, "word", length, gram, index, **sizes)
    joined = row.join(spans, F.col("row.doc_id").eqNullSafe(spans["doc_id"]) & (row["mark"] == spans["mark"]), "left").select("row", "lo", "hi")

    def cut(text: pd.Series, lo: pd.Series, hi: pd.Series) -> pd.DataFrame:
        rows = []
        for t, a, b in zip(text, lo, hi, strict=True):
            words = [] if t is None else t.encode().split()
            flags = covered(a, b, len(words), length)
            kept = words if flags is None else [w for w, gone in zip(words, flags.tolist(), strict=True) if not gone]
            text = b" ".join(kept)
            rows.append((len(words), len(words) - len(kept), hashlib.sha256(text).hexdigest(), text.decode() if with_text else None))
        return pd.DataFrame(rows, columns=["n_words", "n_removed", "kept_sha256", "kept_text"])

    kind = "n_words long, n_removed long, kept_sha256 string, kept_text string"
    return joined.withColumn(into, F.pandas_udf(cut, kind)(F.col("row.text"), F.col("lo"), F.col("hi"))).select("row.*", into)
