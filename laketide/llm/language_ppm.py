"""Language identification by prediction by partial matching.

Every language gets a tree of byte contexts up to ``ORDER`` bytes, counted in Spark as
(language, context, next byte). The statistics are then frozen. The probability of a byte after a
context is c / (T + D) if it was seen there (T counts, D different bytes), else the escape
D / (T + D) times its probability after the context without its first byte, bytes already ruled
out left out of all counts; below the empty context every byte left is equally likely. A text's
code length in a language is the sum of -log2 of these. The shortest code wins, ties go to the
smaller name; the score is 2**-length, normalised over the languages (1 / languages at worst).

The model is fitted on a bounded sample: the ``SAMPLE_ROWS`` documents of each language with the
smallest hashed ids, and of each tree the contexts seen at least ``MIN_COUNT`` times in it; every
language has a tree, however many there are. All texts are then scored whole. Bytes are
lower-cased (A-Z), digits and runs of white space become one blank each.

A tree is sparse: sorted tables of the contexts of each length and of the bytes seen after them.
What follows a context also follows its shorter ends, so exclusion needs only the sums of those
counts, kept with each context. Trees travel in parts of about ``PART_CODES`` entries, one
broadcast a part, and a task holds one part at a time.

Defined results: null text, text without a letter, or no language to learn from gives ``und``
with score 0. The letter test is Unicode's. Ids may repeat or be null.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from laketide.llm.blocks import blocks
from laketide.llm.common import ship_code, stored

ORDER = 3
SAMPLE_ROWS = 400
MIN_COUNT = 2
START = 32
PART_CODES = 1 << 20
BROADCAST_LANGUAGES = 1 << 14

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[65:91] += 32
_CLASS[[9, 10, 11, 12, 13, *range(48, 58)]] = 32


def simplified(buf: np.ndarray) -> np.ndarray:
    """Bytes with A-Z lower-cased, and digits and white space as blanks."""
    return _CLASS[buf]


def sample(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Labelled documents to learn from: ``rows`` of each language."""
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL")
    counts = stored(known.groupBy("lang").agg(F.count("*").alias("c")), "languages")
    # rows that cannot be among the first are left in the scan: about twice as many as needed go on
    cuts = counts.select("lang", F.least(F.lit(1.0), F.lit(2.0 * (rows + 50)) / F.col("c")).alias("cut"))
    if counts.count() <= BROADCAST_LANGUAGES:
        cuts = F.broadcast(cuts)
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40))
    some = known.select("doc_id", "text", "lang", place.alias("place")).join(cuts, "lang").where(F.col("place") < F.col("cut") * (1 << 40))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("place", "doc_id"))
    return some.withColumn("rank", rank).where(F.col("rank") <= rows).select("doc_id", "text", "lang")


def _count_contexts(order: int):
    def work(batches):
        for batch in batches:
            frame = pd.DataFrame({"lang": batch.column(0).to_pylist(), "text": [t.encode() for t in batch.column(1).to_pylist()]})
            for lang, part in frame.groupby("lang"):
                texts = part["text"].tolist()
                for block in blocks(texts, 1 << 20):
                    codes = []
                    for a, b in zip(block.begin, block.end, strict=True):
                        s = np.concatenate((np.full(order, START, np.uint8), simplified(block.buf[a:b]))).astype(np.uint64)
                        code = np.zeros(len(s) - order, dtype=np.uint64)
                        for j in range(order + 1):
                            code = (code << np.uint64(8)) | s[j : len(s) - order + j]
                        codes.append(code)
                    value, n = np.unique(np.concatenate(codes), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(value), pa.string()), pa.array(value.astype(np.int64)), pa.array(n)], names=["lang", "code", "n"])

    return work


class Tree:
    """The frozen statistics of one language: for each length of context, the contexts (T counts, D
    different bytes, and both of the context without its first byte, less the bytes seen here) and
    the bytes after them. Keys are the bytes of the context, for pairs with the next byte at the end."""

    def __init__(self, codes: np.ndarray, n: np.ndarray, order: int, min_count: int):
        self.levels = []
        for k in range(order + 1):
            pairs, at = np.unique(codes & np.uint64((1 << (8 * (k + 1))) - 1), return_inverse=True)
            count = np.bincount(at, n, len(pairs))
            contexts, of = np.unique(pairs >> np.uint64(8), return_inverse=True)
            total, kinds = np.bincount(of, count), np.bincount(of).astype(np.float64)
            often = (total >= min_count) | (k == 0)
            pairs, count, of = pairs[often[of]], count[often[of]], of[often[of]]
            shorter_total = shorter_kinds = np.zeros(len(contexts))
            if k and not len(self.levels[-1][0]):
                break
            if k:
                _, _, _, _, _, below_pairs, below_count = self.levels[-1]
                inside = below_count[np.searchsorted(below_pairs, pairs & np.uint64((1 << (8 * k)) - 1))]
                end = np.searchsorted(self.levels[-1][0], contexts & np.uint64((1 << (8 * (k - 1))) - 1))
                end = np.minimum(end, len(self.levels[-1][0]) - 1)  # rare contexts may lack theirs; they are left out below
                shorter_total = self.levels[-1][1][end] - np.bincount(of, inside, len(contexts))
                shorter_kinds = self.levels[-1][2][end] - kinds
            self.levels.append((contexts[often], total[often], kinds[often], shorter_total[often], shorter_kinds[often], pairs, count))

    def bits(self, codes: np.ndarray) -> np.ndarray:
        """-log2 of the probability of the last byte of each code after the bytes before it."""
        p, escape = np.zeros(len(codes)), np.ones(len(codes))
        open_, longer = np.ones(len(codes), dtype=bool), np.zeros(len(codes), dtype=bool)
        left_total, left_kinds = np.zeros(len(codes)), np.zeros(len(codes))
        for k in range(len(self.levels) - 1, -1, -1):
            contexts, total, kinds, shorter_total, shorter_kinds, pairs, count = self.levels[k]
            if not len(contexts):
                continue
            code = codes & np.uint64((1 << (8 * (k + 1))) - 1)
            at = np.minimum(np.searchsorted(contexts, code >> np.uint64(8)), len(contexts) - 1)
            known = contexts[at] == code >> np.uint64(8)
            place = np.minimum(np.searchsorted(pairs, code), len(pairs) - 1)
            seen = known & open_ & (pairs[place] == code)
            t, d = np.where(longer, left_total, total[at]), np.where(longer, left_kinds, kinds[at])
            p[seen] = escape[seen] * count[place[seen]] / (t[seen] + d[seen])
            open_ &= ~seen
            go = known & open_ & (d > 0)
            escape[go] *= d[go] / (t[go] + d[go])
            left_total, left_kinds = np.where(known, shorter_total[at], left_total), np.where(known, shorter_kinds[at], left_kinds)
            longer |= known
        p[open_] = escape[open_] / max(1.0, 256 - self.levels[0][2].sum())
        return -np.log2(np.maximum(p, 1e-30))


def text_codes(text: np.ndarray, order: int) -> np.ndarray:
    """For each byte of a text, the ``order`` bytes before it and itself as one number."""
    s = np.concatenate((np.full(order, START, np.uint8), simplified(text))).astype(np.uint64)
    code = np.zeros(len(text), dtype=np.uint64)
    for j in range(order + 1):
        code = (code << np.uint64(8)) | s[j : j + len(text)]
    return code


def lengths(texts: list[bytes], trees: list[Tree], order: int) -> np.ndarray:
    """Bits of whole texts (rows) in every tree (columns)."""
    out = np.zeros((len(texts), len(trees)))
    for block in blocks(texts, 1 << 20):
        owner = np.repeat(np.arange(len(block.texts)), block.end - block.begin)
        for a in range(0, len(owner), 1 << 22) if len(block.texts) == 1 else (0,):
            if len(block.texts) == 1:  # a long text in stretches
                lead = min(a, order)
                code = text_codes(block.buf[a - lead : min(len(owner), a + (1 << 22))], order)[lead:]
            else:
                code = np.concatenate([text_codes(block.buf[x:y], order) for x, y in zip(block.begin, block.end, strict=True)])
            codes, at = np.unique(code, return_inverse=True)
            for j, tree in enumerate(trees):
                some = owner[a : a + len(code)]
                out[block.first : block.first + len(block.texts), j] += np.bincount(some, tree.bits(codes)[at], len(block.texts))
    return out


class Model:
    """The trees of all languages, in parts: names in order, and a broadcast of the trees of each part."""

    def __init__(self, order: int, parts: list[tuple[list[str], object]]):
        self.order, self.parts = order, parts


def learn(docs: DataFrame, order: int = ORDER, rows: int = SAMPLE_ROWS, min_count: int = MIN_COUNT, part_codes: int = PART_CODES) -> Model | None:
    """Trees from the rows of ``docs`` (doc_id, text, lang); None if none is labelled."""
    ship_code(docs.sparkSession)
    counted = sample(docs, rows).select("lang", "text").mapInArrow(_count_contexts(order), "lang string, code long, n long")
    counts = stored(counted.groupBy("lang", "code").agg(F.sum("n").alias("n")), "contexts")
    sizes = {r["lang"]: r["c"] for r in counts.groupBy("lang").agg(F.count("*").alias("c")).collect()}  # one row a language
    held: list[list[str]] = []
    size = part_codes
    for lang in sorted(sizes):
        if size + sizes[lang] > part_codes:
            held.append([])
            size = 0
        held[-1].append(lang)
        size += sizes[lang]
    parts = []
    for names in held:
        part = dict(list(counts.where(F.col("lang").between(names[0], names[-1])).toPandas().groupby("lang")))
        trees = [Tree(part[x]["code"].to_numpy().astype(np.uint64), part[x]["n"].to_numpy(), order, min_count) for x in names]
        parts.append((names, docs.sparkSession.sparkContext.broadcast(trees)))
    return Model(order, parts) if parts else None


def judged_texts(texts: list[bytes], parts, order: int) -> tuple[list[str], np.ndarray]:
    """The best language of each text and its score; ``parts`` gives (names, trees) in the order of names.

    The sum of 2**-length is carried from part to part relative to the shortest code so far.
    """
    best, mass = np.full(len(texts), np.inf), np.zeros(len(texts))
    name = np.full(len(texts), "und", dtype=object)
    for names, trees in parts:
        bits = lengths(texts, trees, order)
        least = bits.argmin(axis=1)
        low = bits[np.arange(len(texts)), least]
        shortest = np.minimum(best, low)
        with np.errstate(invalid="ignore"):
            before = np.where(np.isinf(best), 0.0, mass * np.exp2(np.where(np.isinf(best), 0.0, shortest - best)))
        mass = before + np.exp2(shortest[:, None] - bits).sum(axis=1)
        better = low < best
        name[better] = np.array(names, dtype=object)[least[better]]
        best = shortest
    return name.tolist(), 1 / np.maximum(mass, 1.0)


def predict(docs: DataFrame, model: Model | None, pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """Every row of ``docs`` with the predicted language and its score."""
    ship_code(docs.sparkSession)
    if model is None:
        return docs.withColumns({pred: F.lit("und"), score: F.lit(0.0)})

    def work(texts: pd.Series) -> pd.DataFrame:
        names, scores = judged_texts([t.encode() for t in texts], loaded(model.parts), model.order)
        return pd.DataFrame({"l": names, "s": scores})

    letter = F.coalesce(F.rlike("text", F.lit(r"\p{L}")), F.lit(False))
    judged = docs.withColumn("__ppm", F.when(letter, F.pandas_udf(work, "l string, s double")(F.when(letter, F.col("text")).otherwise(""))))
    return judged.withColumns({pred: F.coalesce("__ppm.l", F.lit("und")), score: F.coalesce("__ppm.s", F.lit(0.0))}).drop("__ppm")


def loaded(parts):
    """The parts one after the other. Of several, one is held at a time."""
    for names, shared in parts:
        yield names, shared.value
        if len(parts) > 1 and getattr(shared, "_path", None):  # it can be read again
            del shared._value
