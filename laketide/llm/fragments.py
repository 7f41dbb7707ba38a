"""Where long strings can repeat: anchors, fragments and their shards. Used by both substring operators.

A window is ``length`` units (bytes or words) of one document. Its anchor is the group of
``gram`` units inside it with the smallest hash (the rightmost of equals). Equal windows have
equal anchors at equal places, so only windows of one anchor need to meet. Neighbouring windows
mostly share their anchor; such a run of windows is one fragment of the text.

* Fragments of an anchor that occurs once are unique and end there; only counts are shuffled.
* Equal fragments are collapsed to one and a count before any text moves; windows of a fragment
  with copies repeat for certain.
* Different fragments of one anchor go to a shard, where an index finds the windows they share.
* An anchor with more than ``HOT`` different fragments is not given to one task: its fragments
  are dealt out window by window, keyed by the hash of the whole window, which again brings
  equal windows together. Nothing is dropped.

Documents are told apart by id and the hash of the text, so null and repeated ids are fine;
a repeated row is a copy.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laketide.llm.blocks import Block, Sums, blocks, byte_values, signed, text_bytes, word_hashes
from laketide.llm.common import block_count, drop_stored, ship_code, stored

HOT = 4096
HIGH, LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)
SHARD_UNITS = 1 << 20

RUNS = "doc_id long, mark long, anchor long, frag long, start int, n int, lead int"
PIECES = "shard long, anchor long, frag long, n int, lead int, hot boolean, piece binary"
FOUND = "anchor long, frag long, lo int, hi int"


def unit_values(block: Block, unit: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sequence to search (bytes, or word hashes) and where each text begins and ends in it."""
    if unit == "byte":
        return byte_values(block.buf), block.begin, block.end
    hashes, at = word_hashes(block)
    return hashes, at[:-1], at[1:]


_reverse = np.zeros(0, dtype=np.uint64)


def _backwards(n: int) -> np.ndarray:
    """Falling numbers, so that the smaller of two keys with equal hashes is the one further right."""
    global _reverse
    if len(_reverse) < n:
        _reverse = LOW - np.arange(max(n, 1 << 16), dtype=np.uint64)
    return _reverse[:n]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` consecutive entries, by doubling."""
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    rest = width - done
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def runs_of(block: Block, unit: str, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Text number, anchor hash, fragment hash, first window, number of windows and distance to the anchor of every run."""
    values, begin, end = unit_values(block, unit)
    none = np.zeros(0, dtype=np.int64)
    if len(values) < length:
        return none, none, none, none, none, none
    sums = Sums(values)
    grams = sums.each(gram)
    keys = (grams & HIGH) | _backwards(len(grams))
    best = sliding_min(keys, length - gram + 1)
    at = np.int64(0xFFFFFFFF) - (best & LOW).view(np.int64)
    text = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(values))))[: len(at)]
    inside = np.arange(length, length + len(at)) <= np.repeat(end, np.diff(np.append(begin, len(values))))[: len(at)]
    change = np.ones(len(at), dtype=bool)
    change[1:] = (at[1:] != at[:-1]) | ~inside[:-1] | (text[1:] != text[:-1])
    first = np.flatnonzero(inside & change)
    if not len(first):
        return none, none, none, none, none, none
    stop = np.ones(len(at), dtype=bool)
    stop[:-1] = change[1:] | ~inside[1:]
    last = np.flatnonzero(inside & stop)
    return text[first], signed(grams[at[first]]), signed(sums.of(first, last + length)), first - begin[text[first]], last - first + 1, at[first] - first


def _emit_runs(unit: str, length: int, gram: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def work(batches):
        for batch in batches:
            ids, marks = batch.column(0), batch.column(1)
            for block in blocks(text_bytes(batch.column(2)), 1 << 17):
                text, anchor, frag, start, n, lead = runs_of(block, unit, length, gram)
                row = pa.array(text + block.first)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(row), marks.take(row), pa.array(anchor), pa.array(frag), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(lead.astype(np.int32))],
                    names=["doc_id", "mark", "anchor", "frag", "start", "n", "lead"],
                )

    return work


def pieces_of(text: bytes, unit: str, start: int, size: int) -> bytes:
    """``size`` units of a text from ``start`` on, words as their hashes."""
    if unit == "byte":
        return text[start : start + size]
    return word_hashes(Block(0, [text]))[0][start : start + size].tobytes()


def _emit_pieces(unit: str, length: int, shards: int):
    width = 1 if unit == "byte" else 8

    def work(batches):
        sent: set[tuple[int | None, int]] = set()  # rows of one id and text would send the same pieces
        for batch in batches:
            keys = list(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True))
            new = []
            for i, key in enumerate(keys):
                if key not in sent:
                    sent.add(key)
                    new.append(i)
            batch = batch.take(pa.array(new, pa.int64()))
            texts = text_bytes(batch.column(0))
            rows = batch.column(1).to_pylist()
            out: dict[str, list] = {k: [] for k in ("shard", "anchor", "frag", "n", "lead", "hot", "piece")}
            held = 0
            for text, wanted in zip(texts, rows, strict=True):
                units = text if unit == "byte" else word_hashes(Block(0, [text]))[0].tobytes()
                for w in wanted:
                    piece = units[w["start"] * width : (w["start"] + w["n"] + length - 1) * width]
                    held += len(piece)
                    for k, v in (("shard", w["anchor"] % shards), ("anchor", w["anchor"]), ("frag", w["frag"]), ("n", w["n"]), ("lead", w["lead"]), ("hot", w["hot"]), ("piece", piece)):
                        out[k].append(v)
                if held > 1 << 23:
                    yield _pieces(out)
                    out, held = {k: [] for k in out}, 0
            yield _pieces(out)

    return work


def _pieces(out: dict[str, list]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))


def _emit_windows(unit: str, length: int):
    """Every window of the hot fragments as (anchor, fragment, place, hash of the whole window)."""

    def work(batches):
        for batch in batches:
            for anchor, frag, n, piece in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                values = byte_values(np.frombuffer(piece, np.uint8)) if unit == "byte" else np.frombuffer(piece, np.uint64)
                at = np.arange(n)
                got = signed(Sums(values).of(at, at + length))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, anchor)), pa.array(np.full(n, frag)), pa.array(at.astype(np.int32)), pa.array(got)], names=["anchor", "frag", "at", "window"])

    return work


def intervals(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of true flags."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return edges[::2], edges[1::2]


def repeated_windows(docs: DataFrame, unit: str, length: int, gram: int, index: Callable, shard_units: int = SHARD_UNITS, hot: int = HOT) -> DataFrame:
    """Per document (``doc_id``, ``mark``) the ranges of window places (arrays ``lo``, ``hi``) whose window starts anywhere else too.

    ``docs`` has ``doc_id``, ``mark`` (hash of the text) and ``text``. ``index(pieces, counts, leads)`` gets the
    fragments of a shard, their numbers of windows and the distances to their anchors and gives a flag array for each fragment.
    """
    ship_code(docs.sparkSession)
    runs = stored(docs.select("doc_id", "mark", "text").mapInArrow(_emit_runs(unit, length, gram), RUNS), "runs")
    anchors = runs.groupBy("anchor").agg(F.count("*").alias("c"), F.min("frag").alias("a"), F.max("frag").alias("b")).where("c > 1")
    # stored first: a join right above the aggregate could not split the rows of a hot anchor
    anchors = stored(anchors.select("anchor", (F.col("a") != F.col("b")).alias("mixed")), "anchors")
    shared = stored(runs.join(anchors, "anchor"), "shared")
    drop_stored(runs)
    drop_stored(anchors)
    frags = shared.groupBy("anchor", "frag").agg(
        F.count("*").alias("copies"), F.first("mixed").alias("mixed"), *[F.first(c).alias(c) for c in ("doc_id", "mark", "start", "n", "lead")]
    )
    frags = stored(frags, "frags")
    counts = frags.where("mixed").groupBy("anchor").agg(F.count("*").alias("k"))
    shards = block_count(frags.where("mixed"), F.col("n") + F.lit(length), shard_units)
    wanted = (
        frags.where("mixed")
        .join(counts.where(F.col("k") > hot), "anchor", "left")
        .groupBy("doc_id", "mark")
        .agg(F.collect_list(F.struct("anchor", "frag", "start", "n", "lead", F.col("k").isNotNull().alias("hot"))).alias("rows"))
    )
    one = docs.select(F.col("doc_id").alias("d"), F.col("mark").alias("m"), "text")
    texts = wanted.join(one, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m")))
    pieces = stored(texts.select("text", "rows", "d", "m").mapInArrow(_emit_pieces(unit, length, shards), PIECES), "pieces")

    def search(table: pa.Table) -> pa.Table:
        rows = zip(*(table.column(c).to_pylist() for c in ("anchor", "frag", "n", "lead", "piece")), strict=True)
        once = {(a, f): (n, lead, p) for a, f, n, lead, p in rows}  # a row repeated in several tasks was sent by each
        n, lead, piece = ([v[i] for v in once.values()] for i in range(3))
        out: tuple[list, list, list, list] = ([], [], [], [])
        for (a, f), flags in zip(once, index(piece, n, lead), strict=True):
            for lo, hi in zip(*intervals(flags), strict=True):
                for column, v in zip(out, (a, f, lo, hi), strict=True):
                    column.append(int(v))
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int32())], names=["anchor", "frag", "lo", "hi"])

    cool = pieces.where("NOT hot").groupBy("shard").applyInArrow(search, FOUND)
    windows = pieces.where("hot").select("anchor", "frag", "n", "piece").mapInArrow(_emit_windows(unit, length), "anchor long, frag long, at int, window long").dropDuplicates(["anchor", "frag", "at"])
    again = windows.groupBy("anchor", "window").agg(F.count("*").alias("c")).where("c > 1").select("anchor", "window")
    warm = windows.join(again, ["anchor", "window"]).select("anchor", "frag", F.col("at").alias("lo"), (F.col("at") + 1).alias("hi"))
    copied = frags.where("copies > 1").select("anchor", "frag", F.lit(0).alias("lo"), F.col("n").alias("hi"))
    found = cool.unionByName(warm).unionByName(copied)
    # rows of one id and text have the same places; taken once, a list is no longer than the text's own windows
    places = shared.select("doc_id", "mark", "anchor", "frag", "start").distinct()
    return (
        places.join(found, ["anchor", "frag"])
        .groupBy("doc_id", "mark")
        .agg(F.collect_list(F.col("start") + F.col("lo")).alias("lo"), F.collect_list(F.col("start") + F.col("hi")).alias("hi"))
    )


def covered(lo, hi, size: int, length: int) -> np.ndarray | None:  # noqa: ANN001
    """Flags of the units that lie in a repeated window; None if there is none."""
    if lo is None or not len(lo):
        return None
    delta = np.zeros(size + 1, dtype=np.int64)
    np.add.at(delta, np.asarray(lo, np.int64), 1)
    np.add.at(delta, np.asarray(hi, np.int64) - 1 + length, -1)
    return np.cumsum(delta)[:size] > 0
