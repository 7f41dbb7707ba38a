"""Repeated byte strings by merging Burrows-Wheeler transforms.

Texts are UTF-8 bytes. Fragments that may repeat (see ``fragments``) meet in a shard. A fragment
is a string of blocks of ``STEP`` bytes, cut both ways from its anchor: equal windows have equal
anchors, so their blocks are cut alike and they share ``LENGTH / STEP - 1`` whole blocks. Each
part of a shard gets its own transform over blocks, sorted alone. The transforms are merged by
refining their interleave: starting from "all of part 0, all of part 1, ...", one stable
distribution by the preceding block brings the interleave from order by j blocks to order by
j + 1 blocks. The round in which two neighbours part is their common prefix in blocks. No merged
suffix array is sorted. Suffixes still together at the end are the repeated intervals; inside
one, the up to ``STEP`` bytes on both sides of the shared blocks tell which windows are equal.

Defined results: null or empty text has 0 bytes and nothing removed; texts shorter than
``LENGTH`` bytes lose nothing; repeated rows are copies of each other; null ids are allowed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laketide.llm.blocks import Sums, byte_values, mix
from laketide.llm.common import packed, ship_code
from laketide.llm.fragments import covered, intervals, repeated_windows

LENGTH = 400
STEP = 40
GRAM = 96
PART = 1 << 12


def transform(symbols: np.ndarray, follow: np.ndarray, rounds: int) -> np.ndarray:
    """The suffixes of one part in order by at least ``rounds`` blocks, by prefix doubling.

    Entry i is the block ``symbols[i]`` and then the suffix ``follow[i]``; an end follows itself
    and has a negative symbol of its own.
    """
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1]
    jump, done = follow, 1
    while True:
        order = np.lexsort((rank[jump], rank))
        first, second = rank[order], rank[jump[order]]
        new = np.zeros(n, dtype=np.int64)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        rank[order] = np.cumsum(new)
        done *= 2
        if done >= rounds or rank[order[-1]] == n - 1:
            return order
        jump = jump[jump]


def merge(before: list[np.ndarray], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave the transforms ``before`` of several parts.

    A transform lists, in suffix order, the symbol before each suffix; negative symbols are
    unique and stand for "nothing before". Gives the merged order as indices into the
    concatenated transforms and, per place, the common prefix with the place above, up to ``rounds``.
    """
    symbol = np.concatenate(before)
    source = np.repeat(np.arange(len(before)), [len(b) for b in before])
    offset = np.concatenate(([0], np.cumsum([len(b) for b in before])[:-1]))
    n = len(symbol)
    interleave = source
    block = np.zeros(n, dtype=np.int64)
    prefix = np.full(n, rounds, dtype=np.int32)
    prefix[:1] = 0
    for j in range(rounds):
        taken = _places(interleave, offset, len(before))
        seen = symbol[taken]
        order = np.argsort(seen, kind="stable")
        sorted_symbol, sorted_block = seen[order], block[order]
        part = np.zeros(n, dtype=bool)
        part[1:] = (sorted_symbol[1:] != sorted_symbol[:-1]) | (sorted_block[1:] != sorted_block[:-1])
        prefix[part & (prefix == rounds)] = j
        following = interleave[order]
        new_block = np.cumsum(part)
        if j and new_block[-1] == block[-1] and np.array_equal(following, interleave) and np.array_equal(new_block, block):
            break
        interleave, block = following, new_block
    return _places(interleave, offset, len(before)), prefix


def _places(interleave: np.ndarray, offset: np.ndarray, parts: int) -> np.ndarray:
    """Which entry of the concatenated transforms stands at each place of the interleave."""
    order = np.argsort(interleave.astype(np.uint16) if parts < 65536 else interleave, kind="stable")
    got = np.empty(len(interleave), dtype=np.int64)
    got[order] = np.arange(len(interleave))
    return got


def flags_of_shard(pieces: list[bytes], counts: list[int], leads: list[int], length: int = LENGTH, step: int = STEP, part: int = PART) -> list[np.ndarray]:
    """For each piece, which of its first ``counts`` windows occur at another place of the shard.

    Blocks are cut from each piece's anchor, ``leads`` bytes from its front, both ways.
    """
    rounds = length // step - 1
    flags = [np.zeros(c, dtype=bool) for c in counts]
    phase = np.array([lead % step for lead in leads], dtype=np.int64)
    bytes_ = np.array([len(p) for p in pieces], dtype=np.int64)
    size = np.maximum(0, (bytes_ - phase) // step)
    if not size.sum():
        return flags
    sums = Sums(byte_values(np.frombuffer(b"".join(pieces), np.uint8)))
    origin = np.concatenate(([0], np.cumsum(bytes_)[:-1]))
    begin = np.concatenate(([0], np.cumsum(size)[:-1]))
    owner = np.repeat(np.arange(len(pieces)), size)
    local = phase[owner] + (np.arange(len(owner)) - begin[owner]) * step
    at = origin[owner] + local
    name = np.unique(sums.of(at, at + step), return_inverse=True)[1]
    group = (begin // part)[owner]
    bounds = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1, [len(group)]))
    last = np.append(owner[1:] != owner[:-1], True)
    first = np.append(True, last[:-1])
    before, suffix = [], []
    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
        n = high - low
        ends = np.flatnonzero(last[low:high])
        m = len(ends)
        # entries: the suffixes of this part, then the empty suffix of each piece, the last piece's first
        follow = np.append(np.arange(1, n + 1), n + np.arange(m))
        follow[ends] = n + m - 1 - np.arange(m)
        marks = -1 - owner[low + ends]
        order = transform(np.append(name[low:high], marks[::-1]), follow, rounds)
        inner = order < n
        here = np.where(inner, order + low, low)
        ahead = np.where(first[here], -1 - owner[here], name[here - 1])
        before.append(np.where(inner, ahead, name[low + ends[::-1][np.maximum(order - n, 0)]]))
        suffix.append(np.where(inner, here, -1))
    order, prefix = merge(before, rounds)
    where = np.concatenate(suffix)[order]
    # repeated intervals of whole blocks, then the bytes on both sides of them
    interval = np.cumsum(prefix < rounds)
    alone = np.bincount(interval, minlength=interval[-1] + 1)[interval] < 2
    where, interval = where[~alone], interval[~alone]
    inside = where >= 0
    where, interval = where[inside], interval[inside].astype(np.uint64)
    left = np.arange(step)
    start = local[where][:, None] - left
    count = np.array(counts, dtype=np.int64)
    good = (start >= 0) & (start < count[owner[where]][:, None])
    row, e = np.nonzero(good)
    begin_at = at[where[row]]
    middle = begin_at + rounds * step
    key = mix(interval[row] * np.uint64(step) + e.astype(np.uint64)) + sums.of(begin_at - e, begin_at) * np.uint64(3) + sums.of(middle, middle + step - e) * np.uint64(5)
    again = np.unique(key, return_inverse=True, return_counts=True)
    for piece, s in zip(owner[where[row]][hit := again[2][again[1]] > 1].tolist(), start[row, e][hit].tolist(), strict=True):
        flags[piece][s] = True
    return flags


def removed(docs: DataFrame, length: int = LENGTH, step: int = STEP, gram: int = GRAM, into: str = "repeats", with_text: bool = True, **sizes) -> DataFrame:
    """Every row of ``docs`` with a struct: byte counts, removed runs, the hash of what remains and, if wanted, that text (a character cut in two is left out)."""
    ship_code(docs.sparkSession)
    if length % step:
        raise ValueError("length must be a multiple of step")
    row = docs.select(packed(docs).alias("row")).withColumn("mark", F.xxhash64("row.text"))
    keyed = row.select(F.col("row.doc_id").alias("doc_id"), "mark", F.col("row.text").alias("text"))

    def index(pieces, counts, leads):
        return flags_of_shard(pieces, counts, leads, length, step)

    spans = repeated_windows(keyed, "byte", length, gram, index, **sizes)
    joined = row.join(spans, F.col("row.doc_id").eqNullSafe(spans["doc_id"]) & (row["mark"] == spans["mark"]), "left").select("row", "lo", "hi")

    def cut(text: pd.Series, lo: pd.Series, hi: pd.Series) -> pd.DataFrame:
        rows = []
        for t, a, b in zip(text, lo, hi, strict=True):
            raw = b"" if t is None else t.encode()
            flags = covered(a, b, len(raw), length)
            kept = raw if flags is None else np.frombuffer(raw, np.uint8)[~flags].tobytes()
            spans = 0 if flags is None else len(intervals(flags)[0])
            rows.append((len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore") if with_text else None))
        return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])

    kind = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"
    return joined.withColumn(into, F.pandas_udf(cut, kind)(F.col("row.text"), F.col("lo"), F.col("hi"))).select("row.*", into)
