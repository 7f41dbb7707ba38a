"""Phrase mining by sampling: proposals of a sample and their negative border, counted in full.

Frequent phrases of 1 to 4 words are mined per language, level by level, from a sample of the
documents with a lowered threshold. The full pass counts every phrase whose first n-1 and last
n-1 words were proposed: those are the proposals and their negative border. Phrases of the border
that reach the threshold are border failures; they join the proposals, and another full pass
counts what they open up, until no failure is left. Every phrase that is frequent in all
documents has then been counted, whatever the sample missed.

Counting works on 64-bit hashes of (language, words), combined in every task before a shuffle.
The proposals are shared as one bit map of fixed size, made by Spark's bitmap aggregate, so its
size does not grow with the corpus: a false hit or a hash collision counts a phrase too many,
never one too few. The last pass therefore takes the phrases that remain as text and counts
those exactly; all results come from these counts.

Defined results: null and empty texts have no words; a null language is ``und``; rows are counted
as often as they occur; other columns are ignored; empty tables give no rows. One text must fit a
task.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laketide.llm.blocks import text_bytes
from laketide.llm.common import block_count, ship_code, stored

LONGEST = 4
SUPPORT = 30
#: The sample: this share of the documents, by a hash of id and text, and the part of the
#: proportional threshold a phrase needs there.
SAMPLE_SHARE = 8
LOWERED = 0.55
#: Bits of the map of proposals.
BITS = 1 << 26
#: Distinct hashes a task combines before it passes them on, and what it handles at once.
COMBINED = 1 << 19
BLOCK_BYTES = 1 << 20
BLOCK_ROWS = 512
#: Bytes of text for each shard of the counts by text.
SHARD_BYTES = 32 << 20

#: 0 in a word, 1 between words, 2 between pieces.
_KINDS = bytes(2 if chr(b) in ".,;:!?\n\x0b\x0c\r" else 1 if chr(b) in " \t" else 0 for b in range(256))
_U = np.uint64


def _step(h: np.ndarray, more: np.ndarray) -> np.ndarray:
    """The hash of a sequence with one more entry."""
    h = (h ^ more) * _U(0x9E3779B97F4A7C15)
    h ^= h >> _U(29)
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(32)
    return h


class Words:
    """The words of some lower-cased texts, their hashes and which of them are neighbours."""

    def __init__(self, texts: list[bytes], langs: list[bytes]):
        self.raw = b"\n".join([*texts, b"\0" * 8])  # the end of a text ends a piece
        size = len(self.raw) - 8
        kind = np.frombuffer(self.raw.translate(_KINDS), dtype=np.uint8)[:size]
        inside = np.concatenate(([False], kind == 0, [False]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end = edges[::2], edges[1::2]
        # words i and i + 1 are neighbours if nothing but blanks is between them
        self.linked = kind[self.end] == 1
        gap = np.append(self.start[1:], self.start[-1:]) - self.end
        at, done = np.flatnonzero(gap > 1), 1
        while len(at):
            self.linked[at] &= kind[self.end[at] + done] == 1
            done += 1
            at = at[gap[at] > done]
        self.linked[-1:] = False
        begin = np.cumsum([0, *[len(t) + 1 for t in texts]])
        per_text = np.diff(np.searchsorted(self.start, begin))
        self.kinds = sorted(set(langs))
        number = {k: i for i, k in enumerate(self.kinds)}
        self.lang = np.repeat(np.array([number[k] for k in langs], dtype=np.int64), per_text)
        self.own = self._hashes(_U(0x243F6A8885A308D3))
        self.seed = np.array([int.from_bytes(hashlib.sha256(k).digest()[:8], "little") for k in self.kinds], dtype=_U)
        self.first = _step(self.own, self.seed[self.lang])

    def _hashes(self, seed: np.uint64) -> np.ndarray:
        """Words by eight bytes at a time; only the longer ones have further steps."""
        eights = np.ndarray(len(self.raw) - 7, dtype="<u8", buffer=self.raw, strides=(1,))
        size = self.end - self.start
        h = size.astype(_U) + seed
        at, done = np.arange(len(size)), 0
        while len(at):
            left = np.minimum(size[at] - done, 8).astype(_U)
            part = eights[self.start[at] + done] << (_U(64) - _U(8) * left)
            h[at] = _step(h[at], part)
            done += 8
            at = at[size[at] > done]
        return h

    def opened(self, known: Proposals | None, longest: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each length the places and hashes of the phrases whose first and last n-1 words are proposed."""
        out = [(np.arange(len(self.first)), self.first)]
        for n in range(2, longest + 1):
            at, h = out[-1]
            if known is None or len(at) < 2:
                out.append((at[:0], h[:0]))
                continue
            inside = known.has(h)
            both = inside[:-1] & inside[1:]
            both &= self.linked[at[:-1]] if n == 2 else at[1:] == at[:-1] + 1
            some = np.flatnonzero(both)
            out.append((at[some], _step(h[some], self.own[at[some] + n - 1])))
        return out


def _bit(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes & _U(bits - 1)).astype(np.int64)


class Proposals:
    """A bit map over phrase hashes."""

    def __init__(self, bits: int, raw: np.ndarray | None = None):
        self.bits = bits
        self.map = np.zeros(bits // 8, dtype=np.uint8) if raw is None else raw

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = _bit(hashes, self.bits)
        return (self.map[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)

    def __or__(self, other: Proposals) -> Proposals:
        return Proposals(self.bits, self.map | other.map)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Proposals) and np.array_equal(self.map, other.map)


def bit_map(hashes: DataFrame, bits: int) -> Proposals:
    """The map of column ``h``: at most ``bits`` bits come to the driver, in slices of Spark's bitmaps."""
    at = F.col("h").bitwiseAND(F.lit(bits - 1).cast("long")) + 1  # Spark's bitmaps start at 1
    slices = hashes.groupBy(F.bitmap_bucket_number(at).alias("slice")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    raw = np.zeros(max(bits // 8, 4096), dtype=np.uint8)
    for row in slices.collect():
        first = (row["slice"] - 1) * 4096
        raw[first : first + 4096] = np.frombuffer(row["bits"], dtype=np.uint8)
    return Proposals(bits, raw)


class Combiner:
    """Sums by hash, passed on when there are many."""

    def __init__(self, limit: int = COMBINED):
        self.limit, self.held, self.size = limit, [], 0

    def _combined(self) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        return keys[first], np.add.reduceat(counts, first)

    def add(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        if len(hashes):
            self.held.append(np.unique(hashes, return_counts=True))
            self.size += len(self.held[-1][0])
        if self.size < 2 * self.limit:
            return None
        self.held = [self._combined()]
        self.size = len(self.held[0][0])
        return self.rest() if self.size >= self.limit else None

    def rest(self) -> tuple[np.ndarray, np.ndarray] | None:
        got = self._combined() if self.held else None
        self.held, self.size = [], 0
        return got


def _blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    """Some lower-cased texts at a time; the columns are ``lang``, never null, and ``text``."""
    for batch in batches:
        for low in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(low, BLOCK_ROWS)
            langs, texts = [x.encode() for x in part.column(0).to_pylist()], text_bytes(part.column(1), lower=True)
            first, size = 0, 0
            for i, text in enumerate(texts):
                if size and size + len(text) > BLOCK_BYTES:
                    yield Words(texts[first:i], langs[first:i])
                    first, size = i, 0
                size += len(text)
            yield Words(texts[first:], langs[first:])


def _counts(docs: DataFrame, levels: list[int], known: Broadcast | None, done: Broadcast | None = None) -> DataFrame:
    """``h``, ``n`` of the phrases that ``known`` opens up and ``done`` does not."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, old = known.value if known else None, done.value if done else None
        combiner = Combiner()

        def out(got):
            yield pa.RecordBatch.from_arrays([pa.array(got[0].view(np.int64)), pa.array(got[1].astype(np.int64))], names=["h", "n"])

        for words in _blocks_of(batches):
            before = words.opened(old, levels[-1]) if old is not None else None
            for n, (at, hashes) in enumerate(words.opened(now, levels[-1]), 1):
                if n not in levels:
                    continue
                if before is not None:
                    hashes = hashes[~np.isin(at, before[n - 1][0], assume_unique=True)]
                if (got := combiner.add(hashes)) is not None:
                    yield from out(got)
        if (got := combiner.rest()) is not None:
            yield from out(got)

    return docs.select("lang", "text").mapInArrow(work, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def _frequent(counted: DataFrame, support: int, bits: int) -> Proposals:
    return bit_map(counted.where(F.col("n") >= support).select("h"), bits)


def proposed(docs: DataFrame, support: int, share: int, bits: int) -> Proposals:
    """Phrases of up to ``LONGEST`` - 1 words that are frequent in a sample, and their parts."""
    context = docs.sparkSession.sparkContext
    sample = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(share)) == 0)
    least = max(1, int(support / share * LOWERED))
    known = None
    for n in range(1, LONGEST):
        shared = context.broadcast(known) if known else None
        new = _frequent(_counts(sample, [n], shared), least, bits)
        known = known | new if known else new
        if shared:
            shared.destroy()
    return known


def frequent(docs: DataFrame, support: int, share: int, bits: int) -> Proposals:
    """A map that holds every phrase of up to ``LONGEST`` words that is frequent in all documents."""
    context = docs.sparkSession.sparkContext
    known, done, found = proposed(docs, support, share, bits), None, Proposals(bits)
    while True:
        shared = context.broadcast(known)
        before = context.broadcast(done) if done else None
        # without ``done`` the pass counts proposals and border, later ones what the failures open
        levels = list(range(1 if done is None else 2, LONGEST + 1))
        found = found | _frequent(_counts(docs, levels, shared, before), support, bits)
        for used in (shared, before):
            if used:
                used.destroy()
        grown = known | found
        if grown == known:
            return found
        known, done = grown, known


class Gathered:
    """Phrases of a task with their counts. The numbers lie in sorted arrays, the text of a phrase is
    cut out once; two hashes from different seeds tell phrases apart."""

    def __init__(self):
        self.hash, self.other, self.count = np.zeros(0, _U), np.zeros(0, _U), np.zeros(0, np.int64)
        self.text = np.zeros(0, dtype=object)
        self.new: list[tuple] = []
        self.waiting = 0

    def __len__(self) -> int:
        return len(self.hash) + self.waiting

    def add(self, hashes: np.ndarray, other: np.ndarray, text_of) -> None:
        """Occurrences; ``text_of`` gives the key of one by its number."""
        order = np.lexsort((other, hashes))
        h, o = hashes[order], other[order]
        first = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (o[1:] != o[:-1]))))
        count = np.diff(np.append(first, len(h)))
        h, o, some = h[first], o[first], order[first]
        at = np.minimum(np.searchsorted(self.hash, h), max(len(self.hash) - 1, 0))
        known = (self.hash[at] == h) & (self.other[at] == o) if len(self.hash) else np.zeros(len(h), dtype=bool)
        self.count[at[known]] += count[known]
        text = np.empty(int((~known).sum()), dtype=object)
        text[:] = [text_of(i) for i in some[~known].tolist()]
        self.new.append((h[~known], o[~known], count[~known], text))
        self.waiting += len(text)
        if self.waiting > max(1 << 16, len(self.hash) // 4):
            self._settle()

    def _settle(self) -> None:
        h, o, count, text = (np.concatenate(x) for x in zip((self.hash, self.other, self.count, self.text), *self.new, strict=True))
        order = np.lexsort((o, h))
        h, o, count = h[order], o[order], count[order]
        first = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (o[1:] != o[:-1])))) if len(h) else np.zeros(0, np.int64)
        self.hash, self.other, self.text = h[first], o[first], text[order[first]]
        self.count = np.add.reduceat(count, first) if len(first) else count
        self.new, self.waiting = [], 0

    def rows(self) -> list[tuple[bytes, int]]:
        self._settle()
        return list(zip(self.text.tolist(), self.count.tolist(), strict=True))


#: Bytes that no UTF-8 text holds: between language and phrase, and between entries of a packed list.
_AFTER_LANG, _AFTER_ENTRY = b"\xff", b"\xfe"


def _packed(entries: list[tuple[bytes, int]], shards: int) -> pa.RecordBatch:
    """Phrases with counts, dealt to shards by their text, one compressed list for each."""
    dealt: dict[int, tuple[list[bytes], list[int]]] = {}
    for text, n in entries:
        texts, counts = dealt.setdefault(zlib.crc32(text) % shards, ([], []))
        texts.append(text)
        counts.append(n)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(list(dealt), pa.int32()),
            pa.array([zlib.compress(_AFTER_ENTRY.join(texts), 1) for texts, _ in dealt.values()], pa.binary()),
            pa.array([zlib.compress(np.array(counts, dtype=np.int64).tobytes(), 1) for _, counts in dealt.values()], pa.binary()),
        ],
        names=["shard", "texts", "counts"],
    )


def _summed(lists: pa.Table) -> pa.Table:
    """The phrases of one shard, each with its sum."""
    total: Counter[bytes] = Counter()
    for texts, counts in zip(lists.column("texts"), lists.column("counts"), strict=True):
        numbers = np.frombuffer(zlib.decompress(counts.as_py()), np.int64).tolist()
        for text, n in zip(zlib.decompress(texts.as_py()).split(_AFTER_ENTRY), numbers, strict=True):
            total[text] += n
    parts = [t.partition(_AFTER_LANG) for t in total]
    phrase = [p if mark else None for _, mark, p in parts]
    return pa.table([pa.array([lang for lang, _, _ in parts], pa.binary()).cast(pa.string()), pa.array(phrase, pa.binary()).cast(pa.string()), pa.array(list(total.values()), pa.int64())], names=["lang", "phrase", "n"])


def _texts(docs: DataFrame, found: Broadcast, longest: int, shards: int) -> DataFrame:
    """``lang``, ``phrase``, ``n`` of the phrases in ``found``, exactly; the null phrase has all words.

    Nearly every task meets nearly every frequent phrase, so tasks send packed lists to shards
    instead of a row for each phrase."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        has, held, totals = found.value.has, Gathered(), Counter()
        for words in _blocks_of(batches):
            other = words._hashes(_U(0x13198A2E03707344))
            totals.update(dict(zip(words.kinds, np.bincount(words.lang, minlength=len(words.kinds)).tolist(), strict=True)))
            for n, (at, hashes) in enumerate(words.opened(found.value, longest), 1):
                inside = has(hashes)
                at, hashes = at[inside], hashes[inside]
                if not len(at):
                    continue
                alone = words.seed[words.lang[at]]
                for j in range(n):
                    alone = _step(alone, other[at + j])

                def text_of(i: int, at=at, n=n, words=words) -> bytes:
                    text = words.raw[words.start[at[i]] : words.end[at[i] + n - 1]]
                    return words.kinds[words.lang[at[i]]] + _AFTER_LANG + (text if n == 1 else b" ".join(text.split()))

                held.add(hashes, alone, text_of)
            if len(held) > 2 * COMBINED:
                yield _packed(held.rows(), shards)
                held = Gathered()
        yield _packed([*held.rows(), *[(k, n) for k, n in totals.items() if n]], shards)

    lists = docs.select("lang", "text").mapInArrow(work, "shard int, texts binary, counts binary")
    return lists.groupBy("shard").applyInArrow(_summed, "lang string, phrase string, n long")


def counted(docs: DataFrame, support: int = SUPPORT, share: int = SAMPLE_SHARE, bits: int = BITS) -> DataFrame:
    """``lang``, ``phrase``, ``n``: every phrase of up to ``LONGEST`` words that occurs ``support`` times in
    its language; in the row without a phrase all words of the language are counted."""
    ship_code(docs.sparkSession)
    docs = docs.select("doc_id", F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    found = docs.sparkSession.sparkContext.broadcast(frequent(docs, support, share, bits))
    shards = block_count(docs, F.octet_length("text"), SHARD_BYTES)
    return stored(_texts(docs, found, LONGEST, shards).where((F.col("n") >= support) | F.col("phrase").isNull()), "phrases")


def _part(first: Column, last: Column) -> Column:
    """Words ``first`` to ``last`` of the array ``words``, counted from 1, as text."""
    return F.array_join(F.slice("words", first, last - first + 1), " ")


def collocations(docs: DataFrame, support: int = SUPPORT, top: int = 2000, share: int = SAMPLE_SHARE, bits: int = BITS) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``: the ``top`` phrases of every language.

    A phrase of 2 to 4 words that occurs ``support`` times is scored at its weakest cut; phrases
    that stand inside a longer one with four fifths of their occurrences are dropped."""
    counts = counted(docs, support, share, bits)
    words = F.split("phrase", " ")
    phrases = counts.where(F.col("phrase").isNotNull())
    longer = phrases.withColumn("words", words).where(F.size("words") >= 2)

    # what stands inside a longer candidate, with the largest count of those
    inner = longer.where(F.size("words") > 2).select(
        "lang",
        "n",
        F.explode(
            F.flatten(
                F.transform(
                    F.sequence(F.lit(2), F.size("words") - 1),
                    lambda k: F.transform(F.sequence(F.lit(1), F.size("words") - k + 1), lambda i: _part(i, i + k - 1)),
                )
            )
        ).alias("phrase"),
    )
    held = inner.groupBy("lang", "phrase").agg(F.max("n").alias("inside"))
    left = longer.join(held, ["lang", "phrase"], "left").where(F.coalesce(F.lit(100) * F.col("inside") < F.lit(80) * F.col("n"), F.lit(True)))

    cuts = left.select("lang", "phrase", F.col("n").alias("a"), F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda k: F.struct(k.alias("k"), _part(F.lit(1), k).alias("first"), _part(k + 1, F.size("words")).alias("rest")))).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut.*")
    known = phrases.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l"))
    cuts = cuts.join(known, ["lang", "first"]).join(known.select("lang", F.col("first").alias("rest"), F.col("l").alias("r")), ["lang", "rest"])
    score = F.expr("CAST(2000000BD * a div (CAST(l AS DECIMAL(20)) + r) AS BIGINT)")
    worst = cuts.select("lang", "phrase", "a", F.struct(score.alias("score"), "k", "l", "r").alias("cut")).groupBy("lang", "phrase", "a").agg(F.min("cut").alias("cut"))

    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    best = worst.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    total = counts.where(F.col("phrase").isNull()).select("lang", "n")
    return best.join(total, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
