"""Language-model scores from an Elias-Fano n-gram trie, beside a word-count baseline.

The model predicts the bytes of a text one by one from up to ``ORDER - 1`` bytes before: words
(A-Z lower-cased) each followed by a blank, then an end mark. Probabilities are interpolated as
by Witten and Bell: a context with T training symbols, D of them different, gives
c / (T + D) + D / (T + D) * (probability after the context without its first byte), and below
the empty context every one of 257 symbols is equally likely. Both numbers are kept as 16-bit
codes of their logarithms, rounded down. A token's probability is the mean of that of its spelling
and of its share in the word counts, so frequent words need not be spelled out. The word counts
reserve a share for all unseen words together; an unseen word gets that share times the probability
of its spelling. So the probabilities of all tokens that can follow a text sum to at most 1.
``base_score``, the baseline beside it, gives each single unseen word the reserved share.

All texts are counted; nothing is pruned. Documents are dealt into blocks of bounded size by a
hash. A block sends its distinct n-grams, with their counts over training documents, and its
distinct words to shards, all successors of a context to one. A shard adds up what it gets
(several levels if there are many blocks), writes its n-grams as a trie of packed levels, maps it
into memory, and answers every block in the order asked: four bytes per n-gram, a count per word.
Blocks then score their documents. So what is shuffled is distinct n-grams per block, not tokens.

Defined results: null and empty texts are the end mark alone. With no training text every
spelled symbol has 1 / 257 and all word counts are 0. Rows are scored one by one; ids may repeat.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laketide.llm.blocks import U, Block, blocks, mix, text_bytes, word_hashes
from laketide.llm.common import block_count, drop_stored, ship_code, stored
from laketide.llm.elias_fano import Trie, distinct

ORDER = 6
#: Bytes of text of a block; there are as many shards as blocks, so it also bounds what a shard merges.
BLOCK_BYTES = 5 << 20
FAN_IN = 256
START, END = 254, 255  # never bytes of UTF-8
END_WORD = U(0)
_DECADES = 9.0
_STEPS = 65534
_VALUE = np.concatenate(([0.0], 10.0 ** (-_DECADES * np.arange(_STEPS + 1) / _STEPS)))  # code 0: none; 1: probability 1


def _code(p: np.ndarray) -> np.ndarray:
    """The 16-bit code of probabilities, on a logarithmic scale, rounded down so that sums stay below 1."""
    out = np.zeros(len(p), dtype=np.uint16)
    some = p > 0
    out[some] = 1 + np.clip(np.ceil(-np.log10(p[some]) * _STEPS / _DECADES), 0, _STEPS).astype(np.uint16)
    return out


def _planes(x: np.ndarray) -> bytes:
    """The number of bytes, then bytes of the same weight together and compressed: sorted numbers shrink well so."""
    raw = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unplanes(sent: bytes, kind) -> np.ndarray:  # noqa: ANN001
    width = np.dtype(kind).itemsize
    raw = pa.decompress(memoryview(sent)[8:], int.from_bytes(sent[:8], "little"), codec="zstd")
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).reshape(-1).view(kind)


SLICE_BYTES = 1 << 19


def _slices(texts: list[bytes], order: int):
    """Numbers of first texts, and the n-grams of about ``SLICE_BYTES`` of a block, so that working arrays stay small."""
    for part in blocks(texts, SLICE_BYTES):
        yield part.first, Grams(part.texts, order)


class Grams:
    """The n-grams and words of some texts."""

    def __init__(self, texts: list[bytes], order: int):
        self.order = order
        words = [t.split() for t in texts]
        pad = bytes([START]) * (order - 1)
        lines = [pad + b" ".join(w) + (b" " if w else b"") + bytes([END]) for w in words]
        buf = np.frombuffer(b"".join(lines), np.uint8).astype(U)
        codes = np.zeros(len(buf) - order + 1, dtype=U)
        for j in range(order):
            codes = (codes << U(8)) | buf[j : len(buf) - order + 1 + j]
        size = np.array([len(x) for x in lines], dtype=np.int64)
        begin = np.concatenate(([0], np.cumsum(size)[:-1]))
        keep = np.zeros(len(codes) + order - 1, dtype=bool)
        for a, n in zip(begin.tolist(), size.tolist(), strict=True):
            keep[a : a + n - order + 1] = True
        self.codes = codes[keep[: len(codes)]]
        self.places = np.concatenate(([0], np.cumsum(size - order + 1)))
        hashes, at = word_hashes(Block(0, texts))
        total = np.diff(at) + 1
        self.word_places = np.concatenate(([0], np.cumsum(total)))
        self.words = np.full(int(total.sum()), END_WORD, dtype=U)
        inner = np.ones(len(self.words), dtype=bool)
        inner[self.word_places[1:] - 1] = False
        self.words[inner] = hashes


def _numbered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and for each entry the place of its value."""
    order = np.argsort(x)
    ordered = x[order]
    first = np.concatenate(([True], ordered[1:] != ordered[:-1])) if len(x) else np.zeros(0, dtype=bool)
    place = np.empty(len(x), dtype=np.int32)
    place[order] = np.cumsum(first, dtype=np.int32) - np.int32(1)
    return ordered[first], place


def _levels(top: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order from the highest down: its distinct n-grams, and for each of the next higher order its place among them."""
    levels = [(top, np.zeros(0, dtype=np.int64))]
    for k in range(order - 1, 0, -1):
        low, place = np.unique(levels[-1][0] & U((1 << (8 * k)) - 1), return_inverse=True)
        levels.append((low, place))
    return levels


def _keys(levels: list[tuple[np.ndarray, np.ndarray]], order: int) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams as (left-aligned bytes << 8 | length) and the hashes of their contexts."""
    keys, contexts = [], []
    for k, (grams, _) in zip(range(order, 0, -1), levels, strict=True):
        keys.append(grams << U(8 * (order - k) + 8) | U(k))
        contexts.append(mix((grams >> U(8)) * U(16) + U(k)))
    return np.concatenate(keys), np.concatenate(contexts)


def _deal(place: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that puts entries by shard, and where each shard begins."""
    shard = (place % U(shards)).astype(np.int64)
    order = np.argsort(shard.astype(np.uint16) if shards < 65536 else shard, kind="stable")
    return order, np.searchsorted(shard[order], np.arange(shards + 1))


def _asked(top: np.ndarray, words: np.ndarray, order: int, shards: int):
    levels = _levels(top, order)
    keys, contexts = _keys(levels, order)
    return levels, keys, _deal(contexts, shards), _deal(words, shards)


def _counts(of: np.ndarray, values: np.ndarray) -> np.ndarray:
    """How often each of the sorted distinct ``of`` is among ``values``."""
    got, n = np.unique(values, return_counts=True)
    out = np.zeros(len(of), dtype=np.int64)
    out[np.searchsorted(of, got)] = n
    return out


SENT = "shard int, block long, grams binary, gram_counts binary, words binary, word_counts binary"


def _emit(order: int, shards: int):
    def work(table: pa.Table) -> pa.Table:
        texts = text_bytes(table.column("text").combine_chunks(), lower=True)
        train = np.array(table.column("train").to_pylist(), dtype=bool)
        grams, listed = [], []
        for first, part in _slices(texts, order):
            use = train[first : first + len(part.places) - 1]
            top, words = distinct(part.codes), distinct(part.words)
            grams.append((top, _counts(top, part.codes[np.repeat(use, np.diff(part.places))])))
            listed.append((words, _counts(words, part.words[np.repeat(use, np.diff(part.word_places))])))
        (top, learned), (words, word_counts) = _add_up(grams), _add_up(listed)
        levels, keys, (gram_order, gram_at), (word_order, word_at) = _asked(top, words, order, shards)
        counts = [learned]
        for low, place in levels[1:]:
            counts.append(np.bincount(place, weights=counts[-1], minlength=len(low)).astype(np.int64))
        gram_counts, word_counts = np.concatenate(counts)[gram_order], word_counts[word_order]
        keys, words = keys[gram_order], words[word_order]
        block = table.column("block")[0].as_py()
        rows = []
        for s in range(shards):
            g, w = slice(gram_at[s], gram_at[s + 1]), slice(word_at[s], word_at[s + 1])
            if g.start < g.stop or w.start < w.stop:
                rows.append((s, block, _planes(keys[g]), _planes(gram_counts[g]), _planes(words[w]), _planes(word_counts[w])))
        kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 4]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["shard", "block", "grams", "gram_counts", "words", "word_counts"])

    return work


def _add_up(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts, exact; sorted once, with few working arrays."""
    keys = np.concatenate([p[0] for p in pairs])
    if not len(keys):
        return keys, np.zeros(0, dtype=np.int64)
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(np.concatenate([p[1] for p in pairs])[order], first)


def _merge_sums(table: pa.Table) -> pa.Table:
    """The sums of a group of blocks, in the form a block sends."""
    g = _add_up([(_unplanes(a, U), _unplanes(b, np.int64)) for a, b in zip(table.column("grams").to_pylist(), table.column("gram_counts").to_pylist(), strict=True)])
    w = _add_up([(_unplanes(a, U), _unplanes(b, np.int64)) for a, b in zip(table.column("words").to_pylist(), table.column("word_counts").to_pylist(), strict=True)])
    cells = [table.column("shard")[0].as_py(), table.column("part")[0].as_py(), *map(_planes, (*g, *w))]
    kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 4]
    return pa.table([pa.array([c], t) for c, t in zip(cells, kinds, strict=True)], names=["shard", "block", "grams", "gram_counts", "words", "word_counts"])


def trie_of(keys: np.ndarray, counts: np.ndarray, order: int) -> bytes:
    """The packed trie of one shard's n-grams with training counts above 0."""
    some = counts > 0
    keys, counts = keys[some], counts[some]
    strings, depth = keys >> U(8), (keys & U(255)).astype(np.int64)
    parent = np.where(depth > 1, strings >> (U(8) * (order - depth + 1).astype(U)), U(0)) * U(16) + depth.astype(U)
    context = np.unique(parent, return_inverse=True)[1]
    total = np.bincount(context, weights=counts)
    kinds = np.bincount(context)
    below = total + kinds
    return Trie.build(strings, depth, _code(counts / below[context]), _code((kinds / below)[context]), order).tobytes()


def _mapped(raw: bytes) -> Trie:
    """The trie in a memory map over an unnamed file of the task, gone with the task."""
    with tempfile.TemporaryFile() as file:
        file.write(raw)
        file.flush()
        return Trie.view(np.memmap(file, dtype=np.uint8, mode="r", shape=(len(raw),)))


MODEL = "shard int, levels binary, words binary, word_counts binary, types long, tokens long"


def _model(order: int):
    def work(table: pa.Table) -> pa.Table:
        merged = _merge_sums(table)
        keys, counts = _unplanes(merged.column("grams")[0].as_py(), U), _unplanes(merged.column("gram_counts")[0].as_py(), np.int64)
        words, n = _unplanes(merged.column("words")[0].as_py(), U), _unplanes(merged.column("word_counts")[0].as_py(), np.int64)
        words, n = words[n > 0], n[n > 0]
        cells = [[table.column("shard")[0].as_py()], [trie_of(keys, counts, order)], [_planes(words)], [_planes(n)], [len(words)], [int(n.sum())]]
        kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
        return pa.table([pa.array(c, t) for c, t in zip(cells, kinds, strict=True)], names=["shard", "levels", "words", "word_counts", "types", "tokens"])

    return work


#: N-grams that a shard looks up at a time: a block's share may be a few, and each search has a price of its own.
ASKED = 1 << 18


def _batches(grams: pa.ChunkedArray) -> list[tuple[int, int]]:
    """Ranges of rows with about ``ASKED`` n-grams, one row at least."""
    at = np.cumsum([0, *[int.from_bytes(g.as_py()[:8], "little") // 8 for g in grams]])
    out, first = [], 0
    for i in range(1, len(at)):
        if i == len(at) - 1 or at[i + 1] - at[first] > ASKED:
            out.append((first, i))
            first = i
    return out


ANSWERS = "shard int, block long, own binary, parent binary, word_counts binary"


def _answer(order: int):
    def work(asked: pa.Table, model: pa.Table) -> pa.Table:
        rows = []
        trie = _mapped(model.column("levels")[0].as_py()) if len(model) else None
        known = _unplanes(model.column("words")[0].as_py(), U) if len(model) else np.zeros(0, U)
        counts = _unplanes(model.column("word_counts")[0].as_py(), np.int64) if len(model) else np.zeros(0, np.int64)
        for first, stop in _batches(asked.column("grams")):
            part = asked.slice(first, stop - first)
            asks = [[_unplanes(part.column(c)[i].as_py(), U) for i in range(len(part))] for c in ("grams", "words")]
            ends = [np.cumsum([len(a) for a in each])[:-1] for each in asks]
            keys, w = map(np.concatenate, asks)
            strings, depth = keys >> U(8), (keys & U(255)).astype(np.uint8)
            own, parent = np.zeros(len(keys), dtype=np.uint16), np.zeros(len(keys), dtype=np.uint16)
            for k in range(1, order + 1):
                mine = np.flatnonzero(depth == k)
                if trie is not None and len(mine):
                    own[mine], parent[mine] = trie.find(strings[mine], k, order)
            n = np.zeros(len(w), dtype=np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, w), len(known) - 1)
                n = np.where(known[at] == w, counts[at], 0)
            answered = zip(np.split(own, ends[0]), np.split(parent, ends[0]), np.split(n, ends[1]), strict=True)
            for shard, block, found in zip(part.column("shard").to_pylist(), part.column("block").to_pylist(), answered, strict=True):
                rows.append((shard, block, *map(_planes, found)))
        kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 3]
        columns = zip(*rows, strict=True) if rows else [[]] * 5
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["shard", "of", "own", "parent", "word_counts"])

    return work


SCORES = "row long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _score(order: int, shards: int, tokens: int, types: int):
    def work(docs: pa.Table, answers: pa.Table) -> pa.Table:
        texts = text_bytes(docs.column("text").combine_chunks(), lower=True)
        # each slice keeps its distinct values and numbers of these, so it is cut and sorted once
        held = [(_numbered(g.codes), _numbered(g.words), g.word_places) for _, g in _slices(texts, order)]
        top, words = distinct(np.concatenate([g[0] for g, _, _ in held])), distinct(np.concatenate([w[0] for _, w, _ in held]))
        levels, _, (gram_order, _), (word_order, _) = _asked(top, words, order, shards)
        answers = answers.sort_by("shard")
        own, parent = np.empty(len(gram_order), np.uint16), np.empty(len(gram_order), np.uint16)
        own[gram_order] = np.concatenate([_unplanes(c, np.uint16) for c in answers.column("own").to_pylist()])
        parent[gram_order] = np.concatenate([_unplanes(c, np.uint16) for c in answers.column("parent").to_pylist()])
        counts = np.empty(len(words), np.int64)
        counts[word_order] = np.concatenate([_unplanes(c, np.int64) for c in answers.column("word_counts").to_pylist()])
        # from the empty context up: an unseen context passes everything on
        ends = np.cumsum([len(g) for g, _ in levels])
        p = np.array([1 / 257])
        for i in range(len(levels) - 1, -1, -1):
            part = slice(ends[i] - len(levels[i][0]), ends[i])
            below = p[levels[i + 1][1]] if i + 1 < len(levels) else p
            p = _VALUE[own[part]] + np.where(parent[part] > 0, _VALUE[parent[part]], 1.0) * below
        bits = np.log10(p)
        out: list[list[np.ndarray]] = [[], [], [], []]
        for (grams, gram_place), (listed, word_place), word_places in held:
            last = grams & U(255)
            ends_word = np.flatnonzero(((last == U(32)) | (last == U(END)))[gram_place])
            spelled = np.add.reduceat(bits[np.searchsorted(top, grams)][gram_place], np.concatenate(([0], ends_word[:-1] + 1)))
            n = counts[np.searchsorted(words, listed)][word_place]
            base = np.log10((n + 0.1) / (tokens + 0.1 * (types + 1)))
            # a token is spelled by the trie or drawn from the word counts, at even odds; all unseen words share what is left there
            drawn = np.where(n > 0, base, base + spelled)
            high, low = np.maximum(spelled, drawn), np.minimum(spelled, drawn)
            token = high + np.log10(0.5 + 0.5 * 10.0 ** np.maximum(low - high, -300.0))
            at = word_places[:-1]
            for o, v in zip(out, (np.diff(word_places), np.add.reduceat((n > 0).astype(np.int64), at), np.add.reduceat(base, at), np.add.reduceat(token, at)), strict=True):
                o.append(v)
        columns = [docs.column("row"), pa.compute.invert(docs.column("train")), *[pa.array(np.concatenate(o)) for o in out]]
        return pa.table(columns, names=["row", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return work


def train_and_score(docs: DataFrame, train: Column, order: int = ORDER, block_bytes: int = BLOCK_BYTES, fan_in: int = FAN_IN) -> DataFrame:
    """Every row of ``docs`` (``row``, ``text``) scored by a model of those where ``train`` holds.

    ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.
    """
    ship_code(docs.sparkSession)
    if not 2 <= order <= 7:
        raise ValueError("an n-gram and its length share eight bytes")
    parts = block_count(docs, F.octet_length("text") + 8, block_bytes)
    dealt = docs.select(
        F.pmod(F.xxhash64("row", "text"), F.lit(parts)).alias("block"), "row", F.coalesce(train, F.lit(False)).alias("train"), F.coalesce("text", F.lit("")).alias("text")
    )
    shards = parts
    sent = stored(dealt.groupBy("block").applyInArrow(_emit(order, shards), SENT), "lm-sent")
    sums = sent
    ways = parts
    while ways > fan_in:
        ways = -(-ways // fan_in)
        part = F.pmod(F.xxhash64("block"), F.lit(ways)).alias("part")
        sums = sums.select("*", part).groupBy("shard", "part").applyInArrow(_merge_sums, SENT)
    model = stored(sums.withColumn("part", F.lit(0).cast("long")).groupBy("shard").applyInArrow(_model(order), MODEL), "lm-model")
    total = model.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n"), F.coalesce(F.sum("types"), F.lit(0)).alias("v")).first()
    known = model.select(F.col("shard").alias("at"), "levels", "words", "word_counts")
    # the counts have been added up: a question is the keys alone
    asked = sent.select("shard", "block", "grams", "words")
    answers = stored(asked.groupBy("shard").cogroup(known.groupBy("at")).applyInArrow(_answer(order), ANSWERS.replace("block", "of")), "lm-answers")
    drop_stored(sent)
    drop_stored(model)
    scored = dealt.groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(_score(order, shards, total["n"], total["v"]), SCORES)
    return scored.select("row", "held_out", "n_tokens", "n_known", F.lit(total["n"]).cast("long").alias("train_tokens"), "base_score", "score")
