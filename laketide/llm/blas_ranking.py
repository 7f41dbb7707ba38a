"""Ranked lexical search: dense tiles of item term counts times tiles of document impacts.

Terms are maximal runs of letters, digits and non-ASCII characters, A-Z lower-cased. The items
are the query set: they are dealt to blocks of bounded vocabulary, and every block is held
against all documents in two scans, one for the statistics of its terms and one for the scores;
no document is shuffled. Within a block, items form tiles of a few dozen with a compact
vocabulary of their own; a tile of documents is a dense matrix of impacts over that vocabulary,
and one matrix product scores all pairs of the tile.

Impacts are integers below ``max(w) * 10**6``. An item whose term counts could carry a partial
sum to 2**53 is spread over several rows of the tile, so every product is exact in float64, and
the rows are added as 64-bit integers. Ties are kept: a tile passes on every document that
reaches the item's k-th score so far, cut to k by (score descending, doc_id ascending, ids that
are null last); Spark then ranks what the tasks pass on.

Defined results: null and empty texts have no terms and are never returned; rows of documents
are ranked one by one, repeated rows too; rows of one item_id (or of a null one) are one item,
their terms together; items without terms, and empty tables, give no rows; other columns are
ignored. One document, and the distinct terms of one item, must fit a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from laketide.llm.common import ship_code, stored

#: (item, term) entries of a block; its vocabulary is broadcast, so this bounds the broadcast.
BLOCK_ENTRIES = 1 << 18
TILE_ITEMS = 64
TILE_DOCS = 512
TILE_TERMS = 1 << 12
TOP = 10
EXACT = 1 << 53

_KEPT = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8; a byte above 127 is part of a character that belongs to a term."""
    return (text or b"").translate(_KEPT).split()  # of the white space only blanks are left


def item_terms(items: DataFrame) -> DataFrame:
    """``item_id``, ``term``, ``n``: how often the texts of an item hold a term."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist()
            pairs = [(i, t) for i, text in zip(ids, texts, strict=True) for t in terms_of(text)]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in pairs], batch.schema.field(0).type), pa.array([t for _, t in pairs], pa.binary()).cast(pa.string())], names=["item_id", "term"])

    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", "text").mapInArrow(work, f"item_id {kind}, term string").groupBy("item_id", "term").agg(F.count("*").alias("n"))


class Counted:
    """Documents as counts of the terms of a vocabulary: parallel arrays of document, term and count."""

    def __init__(self, texts: list[bytes | None], vocabulary: dict[bytes, int]):
        found, sizes, lengths = [], [], []
        for text in texts:
            terms = terms_of(text)
            known = [i for i in map(vocabulary.get, terms) if i is not None]
            found.append(np.array(known, dtype=np.int64))
            sizes.append(len(known))
            lengths.append(len(terms))
        self.length = np.array(lengths, dtype=np.int64)
        keys = np.repeat(np.arange(len(texts), dtype=np.int64), sizes) * max(len(vocabulary), 1) + (np.concatenate(found) if found else np.zeros(0, np.int64))
        keys, self.tf = np.unique(keys, return_counts=True)
        self.doc, self.term = np.divmod(keys, max(len(vocabulary), 1))


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Slices of batches, small enough for one tile of documents."""
    for batch in batches:
        for start in range(0, batch.num_rows, TILE_DOCS):
            part = batch.slice(start, TILE_DOCS)
            yield part, part.column(column).cast(pa.large_binary()).to_pylist()


def statistics(docs: DataFrame, vocabulary: dict[bytes, int]) -> tuple[int, int, np.ndarray]:
    """N, L and the document frequency of every term of the vocabulary, over all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        df, n, total = np.zeros(len(known), np.int64), 0, 0
        for _, texts in _texts(batches, 0):
            counted = Counted(texts, known)
            df += np.bincount(counted.term, minlength=len(known))
            n += int((counted.length > 0).sum())
            total += int(counted.length.sum())
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([*some.tolist(), -1, -2]), pa.array([*df[some].tolist(), n, total])], names=["term", "n"])

    summed = docs.select("text").mapInArrow(work, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    rows = {r["term"]: r["n"] for r in summed.collect()}  # at most the vocabulary of a block
    df = np.array([rows.get(i, 0) for i in range(len(vocabulary))], dtype=np.int64)
    return rows.get(-1, 0), rows.get(-2, 0), df


class ItemTile:
    """Some items over their own vocabulary; ``owner`` names the item of every row."""

    def __init__(self, items: list[int], entries: list[tuple[np.ndarray, np.ndarray]], limit: int):
        self.items = items
        self.terms = np.unique(np.concatenate([t for t, _ in entries]))
        self.owner, rows = [], []
        for i, (terms, counts) in enumerate(entries):
            at = np.searchsorted(self.terms, terms)
            # term counts as stretches of one line, cut wherever the sum reaches the limit
            ends = np.cumsum(counts)
            for low in range(0, int(ends[-1]), limit):
                part = np.minimum(ends, low + limit) - np.maximum(ends - counts, low)
                row = np.zeros(len(self.terms))
                row[at] = np.maximum(part, 0)
                rows.append(row)
                self.owner.append(i)
        self.counts = np.array(rows)
        self.first = np.flatnonzero(np.diff([-1, *self.owner]))

    def scores(self, impacts: np.ndarray) -> np.ndarray:
        """(items, documents) as int64; ``impacts`` is (terms, documents)."""
        return np.add.reduceat((self.counts @ impacts).astype(np.int64), self.first, axis=0)


def tiles_of(entries: list[tuple[np.ndarray, np.ndarray]], limit: int) -> list[ItemTile]:
    """Items in tiles of at most ``TILE_ITEMS`` items and about ``TILE_TERMS`` entries."""
    tiles, held, size = [], [], 0
    for i, (terms, _) in enumerate(entries):
        if held and (len(held) == TILE_ITEMS or size + len(terms) > TILE_TERMS):
            tiles.append(ItemTile(held, [entries[j] for j in held], limit))
            held, size = [], 0
        held.append(i)
        size += len(terms)
    return [*tiles, ItemTile(held, [entries[j] for j in held], limit)] if held else tiles


class Best:
    """The best documents of every item so far, ties at the k-th place decided by id."""

    def __init__(self, items: int, k: int):
        self.k, self.floor = k, np.ones(items, dtype=np.int64)  # the score to reach
        self.kept: list[list[tuple[int, bool, int]]] = [[] for _ in range(items)]

    def add(self, items: list[int], scores: np.ndarray, ids: list[int | None]) -> None:
        rows, docs = np.nonzero(scores >= self.floor[items][:, None])
        if not len(rows):
            return
        for row in np.unique(rows):
            own = docs[rows == row]
            item = items[row]
            new = self.kept[item] + [(-int(scores[row, d]), ids[d] is None, ids[d] or 0) for d in own]
            new.sort()
            self.kept[item] = new[: self.k]
            if len(new) >= self.k:
                self.floor[item] = -new[self.k - 1][0]


def _block_scores(docs: DataFrame, entries: list[tuple[np.ndarray, np.ndarray]], vocabulary: dict[bytes, int], k: int) -> DataFrame:
    """``at`` (the number of an item), ``doc_id``, ``score``: the best ``k`` of every task."""
    n_docs, total, df = statistics(docs, vocabulary)
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], dtype=np.int64)
    limit = max(1, (EXACT - 1) // (max(int(weight.max()), 1) * 1_000_000))
    shared = docs.sparkSession.sparkContext.broadcast((entries, vocabulary, weight))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, known, w = shared.value
        tiles, best = tiles_of(items, limit), Best(len(items), k)
        columns = [np.full(len(known), -1, dtype=np.int64) for _ in tiles]
        for tile, column in zip(tiles, columns, strict=True):
            column[tile.terms] = np.arange(len(tile.terms))
        for part, texts in _texts(batches, 1):
            ids, counted = part.column(0).to_pylist(), Counted(texts, known)
            m = 100 - 75 + (75 * counted.length * n_docs) // max(total, 1)
            impact = (w[counted.term] * ((1_000_000_000 * counted.tf) // (1000 * counted.tf + 8 * m[counted.doc]))).astype(np.float64)
            for tile, column in zip(tiles, columns, strict=True):
                at = column[counted.term]
                here = at >= 0
                if here.any():
                    dense = np.zeros((len(tile.terms), len(texts)))
                    dense[at[here], counted.doc[here]] = impact[here]
                    best.add(tile.items, tile.scores(dense), ids)
        rows = [(i, None if missing else doc, -score) for i, kept in enumerate(best.kept) for score, missing, doc in kept]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], names=["at", "doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, "at long, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP, block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id``, ``score``: the ``k`` best documents (``doc_id``, ``text``) of
    every item (``item_id``, ``text``) with a score above 0."""
    spark = docs.sparkSession
    ship_code(spark)
    entries = stored(item_terms(items), "ranking-terms")
    blocks = max(1, -(-entries.count() // block_entries))
    dealt = entries.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
    found = None
    for block in range(blocks):
        rows = dealt.where(F.col("block") == block).select("item_id", "term", "n").collect()  # about block_entries
        if not rows:
            continue
        vocabulary = {t.encode(): i for i, t in enumerate(sorted({r["term"] for r in rows}))}
        by_item: dict[object, list[tuple[int, int]]] = {}
        for r in rows:
            by_item.setdefault(r["item_id"], []).append((vocabulary[r["term"].encode()], r["n"]))
        names = list(by_item)
        arrays = [(np.array([t for t, _ in sorted(v)], np.int64), np.array([n for _, n in sorted(v)], np.int64)) for v in by_item.values()]
        scores = _block_scores(docs, arrays, vocabulary, k)
        kind = items.schema["item_id"].dataType.simpleString()
        called = F.broadcast(spark.createDataFrame(list(enumerate(names)), f"at long, item_id {kind}"))  # the items of one block
        part = scores.join(called, "at").select("item_id", "doc_id", "score")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return items.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).where("false")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
