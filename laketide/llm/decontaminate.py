"""Benchmark items inside documents: size-partitioned MinHash containment search, then an exact check.

Items and documents are sets of ``SHINGLE``-word shingles (A-Z lower-cased). The containment of an
item in a document is the share of the item's shingles that the document has.

A whole document is far larger than an item, so their similarity says little. Items are therefore
partitioned by size, class j holding 2**j to 2**(j+1) - 1 shingles, and for every class present a
document is read as windows of 2 * u shingles, u apart, where u is the largest size of the class:
an unbroken copy of an item lies inside one window whole. With containment 0.8 the similarity of item and window is
then at least 0.19, so 64 minima agree nowhere with probability 1e-6; a copy broken into parts is
met by several windows, with as many expected hits.

A document's minima are looked up in a bit field of fixed size over the items' minima, so no
minima are shuffled but those that may hit, however many items there are. Hits join the items by
value and every candidate is verified on full shingle sets.

Defined results: texts below ``SHINGLE`` words have no shingles and match nothing; null texts are
empty; rows with one id count as one, by their best text; so do items.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laketide.llm.blocks import U, Block, blocks, mix, shingles, signed, slices, text_bytes, word_hashes
from laketide.llm.common import packed, ship_code, stored

SHINGLE = 5
PERCENT = 80
MINIMA = 64
FIELD_BITS = 24
#: Bytes of documents that go to Python together, and of those whose arrays are held at a time: two tasks of an
#: executor hold these beside a full heap.
BATCH = 1 << 21
BLOCK = 1 << 18

_MULTIPLY = mix(np.arange(1, MINIMA + 1, dtype=U)) | U(1)
_SALT = mix(np.arange(1000, 1000 + MINIMA, dtype=U))


def _sets(block: Block, k: int) -> list[np.ndarray]:
    words, at = word_hashes(block)
    grams = shingles(words, k)
    return [grams[a : max(a, b - k + 1)] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _keys(minima: np.ndarray, coordinate: int, size_class: int) -> np.ndarray:
    """One number for (class, coordinate, minimum)."""
    return mix(minima + _SALT[coordinate] + mix(np.array([size_class + 7], dtype=U)))


def size_class(n: int) -> int:
    return n.bit_length() - 1


def window_keys(grams: np.ndarray, sizes: np.ndarray, size_classes: list[int], field: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Document numbers and keys of the windows of several documents, those in ``field`` if it is given.

    ``grams`` holds the shingles of all documents one after the other, ``sizes`` of each.
    """
    owners, found = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=U)]
    begin = np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(sizes) else sizes
    cuts = []
    for j in size_classes if len(grams) else ():
        u = (2 << j) - 1
        parts = -(-sizes // u)
        owner = np.repeat(np.arange(len(sizes)), parts)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        follows = np.append(owner[1:] == owner[:-1], False)  # a part and the next are a window
        cuts.append((j, begin[owner] + number * u, follows, np.flatnonzero(follows | (number == 0)), owner))
    for i in range(MINIMA if cuts else 0):
        values = grams * _MULTIPLY[i]
        for j, starts, follows, windows, owner in cuts:
            parts = np.minimum.reduceat(values, starts)
            best = np.where(follows, np.minimum(parts, np.append(parts[1:], U(0))), parts)[windows]
            keys = _keys(best, i, j)
            of = owner[windows]
            if field is not None:
                inside = _in_field(field, keys)
                keys, of = keys[inside], of[inside]
            owners.append(of)
            found.append(keys)
    return np.concatenate(owners), np.concatenate(found)


def _emit_items(k: int):
    def work(batches):
        for batch in batches:
            for block in blocks(text_bytes(batch.column(1), lower=True)):
                sets = [np.unique(s) for s in _sets(block, k)]
                keys = [[int(signed(_keys((s * _MULTIPLY[i]).min(keepdims=True), i, size_class(len(s))))[0]) for i in range(MINIMA)] if len(s) else [] for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(block.first, len(sets)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([size_class(len(s)) if len(s) else -1 for s in sets], pa.int32()),
                        pa.array([signed(s) for s in sets], pa.list_(pa.int64())),
                        pa.array(keys, pa.list_(pa.int64())),
                    ],
                    names=["item_id", "item_shingles", "size_class", "grams", "keys"],
                )

    return work


def _field(df: DataFrame, column: str) -> np.ndarray:
    """A bit for each value of an array column; at most 2**FIELD_BITS places reach the driver."""
    place = F.transform(column, lambda x: F.pmod(x, F.lit(1 << FIELD_BITS)).cast("int"))
    got = df.select(F.explode(place).alias("p")).distinct().toPandas()["p"].to_numpy()
    bits = np.zeros(1 << FIELD_BITS, dtype=bool)
    bits[got] = True
    return np.packbits(bits, bitorder="little")


def _in_field(field: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = keys & U((1 << FIELD_BITS) - 1)
    return (field[(place >> U(3)).astype(np.int64)] >> (place & U(7)).astype(np.uint8)) & 1 == 1


def _emit_hits(k: int, size_classes: list[int], key_field: np.ndarray, gram_field: np.ndarray):
    def work(batches):
        for batch in (part for whole in batches for part in slices(whole, 2, BATCH)):
            ids, marks, all_keys, all_grams = [], [], [], []
            for block in blocks(text_bytes(batch.column(2), lower=True), BLOCK):
                sets = _sets(block, k)
                sizes = np.array([len(s) for s in sets], dtype=np.int64)
                owner, keys = window_keys(np.concatenate(sets), sizes, size_classes, key_field)
                order = np.argsort(owner, kind="stable")
                owner, keys = owner[order], keys[order]
                for i in np.unique(owner).tolist():
                    grams = np.unique(sets[i][_in_field(gram_field, sets[i])])
                    ids.append(batch.column(0)[block.first + i].as_py())
                    marks.append(batch.column(1)[block.first + i].as_py())
                    all_keys.append(signed(np.unique(keys[slice(*np.searchsorted(owner, [i, i + 1]))])))
                    all_grams.append(signed(grams))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(marks, pa.int64()), pa.array(all_keys, pa.list_(pa.int64())), pa.array(all_grams, pa.list_(pa.int64()))],
                names=["doc_id", "mark", "keys", "grams"],
            )

    return work


def matches(docs: DataFrame, items: DataFrame, percent: int = PERCENT, k: int = SHINGLE) -> DataFrame:
    """``doc_id``, ``mark`` (hash of the text), ``item_id``, ``item_shingles`` and ``shared`` of every document that contains an item."""
    ship_code(docs.sparkSession)
    kind = "item_id long, item_shingles long, size_class int, grams array<long>, keys array<long>"
    known = stored(items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(_emit_items(k), kind).where("item_shingles > 0"), "items")
    sizes = [r["size_class"] for r in known.select("size_class").distinct().collect()]  # at most 63
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    work = _emit_hits(k, sorted(sizes), _field(known, "keys"), _field(known, "grams"))
    hits = stored(plain.mapInArrow(work, "doc_id long, mark long, keys array<long>, grams array<long>"), "hits", BATCH)
    # items are told apart by id and shingles: a repeated item counts once
    name = F.xxhash64("item_id", "grams").alias("item")
    lookup = known.select(name, F.explode("keys").alias("key")).distinct()
    candidates = hits.select("doc_id", "mark", F.explode("keys").alias("key")).join(lookup, "key").select("doc_id", "mark", "item").distinct()
    grams = known.select(name, "item_id", "item_shingles", F.explode("grams").alias("gram")).distinct()
    both = (
        hits.select("doc_id", "mark", F.explode("grams").alias("gram"))
        .distinct()
        .join(grams, "gram")
        .groupBy("doc_id", "mark", "item", "item_id", "item_shingles")
        .agg(F.count("*").alias("shared"))
        .where(100 * F.col("shared") >= percent * F.col("item_shingles"))
    )
    c = candidates.select(F.col("doc_id").alias("d"), F.col("mark").alias("m"), F.col("item").alias("i"))
    return both.join(c, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m")) & (F.col("item") == F.col("i")), "left_semi").drop("item")


def pairs(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """One row for each document and item it contains, by the best text of either."""
    best = F.max(F.struct((F.col("shared") / F.col("item_shingles")).alias("containment"), "item_shingles", "shared"))
    return matches(docs, items, **options).groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.item_shingles", "b.shared", "b.containment")


def clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that contain no item, with their columns."""
    hit = matches(docs, items, **options).select(F.col("doc_id").alias("d"), F.col("mark").alias("m")).distinct()
    row = docs.select(packed(docs).alias("row"))
    return row.join(hit, F.col("row.doc_id").cast("long").eqNullSafe(F.col("d")) & (F.xxhash64("row.text") == F.col("m")), "left_anti").select("row.*")
