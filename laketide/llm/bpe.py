"""Byte-level BPE: ranked merges folded over the bytes of distinct words, and decoding.

A text is cut by the vocabulary's pattern, every match is encoded alone. Only distinct words are
encoded, once each for the whole corpus, in the task of their shard: the pair of neighbouring pieces
of the smallest rank, leftmost first, is joined until no pair has a rank. The pairs wait in a heap.

``tokenized`` cuts the texts once. It writes blocks: the distinct words of some documents, dealt
to shards by a hash, and each document as numbers of its block's words. A shard gathers the
words of all blocks, encodes each once, and sends every block the ids of its words in the
order it sent them; then its documents get theirs. So words travel once, and only blocks are stored. Blocks are bounded by bytes of text (a longer
text is a block alone), so nothing grows with the corpus but the number of rows. Lists travel
packed and compressed.

Defined results: null and empty texts have no tokens; ids and repeated rows are passed through.
A word of n bytes takes about n log n steps.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laketide.llm.common import block_count, ship_code, stored

BLOCK_BYTES = 32 << 20
#: Words of documents that are packed together.
PACK_WORDS = 1 << 16
LEVEL = 6


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}


def encode(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The token ids of one word."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    n = len(word)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # the pieces beside the one that starts here; after is 0 where none starts
    pairs = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(pairs)
    while pairs:
        _, i, end = heapq.heappop(pairs)
        j = after[i]
        if not j or j >= n or after[j] != end:
            continue  # one of the two was joined with another piece
        after[i], after[j] = end, 0
        if end < n:
            before[end] = i
            if (rank := ranks.get(word[i : after[end]])) is not None:
                heapq.heappush(pairs, (rank, i, after[end]))
        if i and (rank := ranks.get(word[before[i] : end])) is not None:
            heapq.heappush(pairs, (rank, before[i], end))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : after[i]]])
        i = after[i]
    return out


def _pack(x: np.ndarray) -> bytes:
    """Numbers from 0 on, compressed: a byte for each, 255 for larger ones, whose rest follows as planes of equal weight."""
    small = np.minimum(x, 255).astype(np.uint8)
    rest = np.ascontiguousarray(x[x >= 255] - 255, dtype=np.int32).view(np.uint8).reshape(-1, 4)
    return zlib.compress(len(x).to_bytes(4, "little") + small.tobytes() + rest.T.tobytes(), LEVEL)


def _unpack(raw: bytes) -> np.ndarray:
    raw = zlib.decompress(raw)
    n = int.from_bytes(raw[:4], "little")
    out = np.frombuffer(raw, np.uint8, n, 4).astype(np.int32)
    rest = np.frombuffer(raw, np.uint8, -1, 4 + n).reshape(4, -1).T
    out[out == 255] += np.ascontiguousarray(rest).reshape(-1).view(np.int32)
    return out


def _pack_words(words: list[bytes]) -> bytes:
    size = np.fromiter(map(len, words), np.int32, len(words))
    return zlib.compress(len(words).to_bytes(4, "little") + size.tobytes() + b"".join(words), LEVEL)


def _unpack_words(raw: bytes) -> list[bytes]:
    raw = zlib.decompress(raw)
    n = int.from_bytes(raw[:4], "little")
    ends = (np.cumsum(np.frombuffer(raw, np.int32, n, 4)) + 4 + 4 * n).tolist()
    return [raw[i:j] for i, j in zip([4 + 4 * n, *ends[:-1]], ends, strict=True)] if n else []


TOKENIZED = "block long, rows array<long>, sizes binary, refs binary, shard int, words binary, ids binary"


def tokenized(docs: DataFrame, pattern: str, shards: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of ``docs`` (``row``, ``text``): rows of some documents each, their words as numbers of the
    block (frequent words have small ones), and a row for each shard with the block's words. The
    first row of documents has the numbers of these words, shard after shard. Documents are packed together, since a short one alone compresses badly."""

    def work(batches):
        import regex
        from pyspark import TaskContext

        find = regex.compile(pattern).findall
        number = TaskContext.get().partitionId() << 32

        def flush(held):
            nonlocal number
            number += 1
            words: dict[str, int] = {}
            refs = [np.array([words.setdefault(w, len(words)) for w in find(text)], dtype=np.int32) for _, text in held]
            often = np.bincount(np.concatenate(refs), minlength=len(words))
            order = np.argsort(-often, kind="stable")
            rank = np.empty(len(words), dtype=np.int32)
            rank[order] = np.arange(len(words), dtype=np.int32)
            raw = [w.encode() for w in words]
            dealt: list[list[int]] = [[] for _ in range(shards)]
            for i in sorted(range(len(raw)), key=raw.__getitem__):  # words beside like ones compress best
                dealt[zlib.crc32(raw[i]) % shards].append(i)
            some = [s for s, listed in enumerate(dealt) if listed]
            ids = rank[np.array([i for s in some for i in dealt[s]], dtype=np.int64)]
            size = np.fromiter(map(len, refs), np.int64, len(refs))
            packs = np.flatnonzero(np.diff(np.cumsum(size) // PACK_WORDS, prepend=-1)).tolist()  # the first documents of packs
            packs = list(zip(packs, [*packs[1:], len(refs)], strict=True))
            n, m = len(packs), len(some)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([number] * (n + m), pa.int64()),
                    pa.array([[row for row, _ in held[a:b]] for a, b in packs] + [None] * m, pa.list_(pa.int64())),
                    pa.array([_pack(size[a:b]) for a, b in packs] + [None] * m, pa.binary()),
                    pa.array([_pack(rank[np.concatenate(refs[a:b])]) for a, b in packs] + [None] * m, pa.binary()),
                    pa.array([None] * n + some, pa.int32()),
                    pa.array([None] * n + [_pack_words([raw[i] for i in dealt[s]]) for s in some], pa.binary()),
                    pa.array([_pack(ids)] + [None] * (n - 1 + m), pa.binary()),
                ],
                names=["block", "rows", "sizes", "refs", "shard", "words", "ids"],
            )

        held, size = [], 0
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = text or ""
                if held and size + len(text) > block_bytes:
                    yield from flush(held)
                    held, size = [], 0
                held.append((row, text))
                size += len(text)
        if held:
            yield from flush(held)

    return docs.select("row", "text").mapInArrow(work, TOKENIZED)


def _answer(ranks: dict[bytes, int]):
    def work(lists: pa.Table) -> pa.Table:
        """The token ids of every block's words, in the block's order; each word is encoded once."""
        place: dict[bytes, int] = {}
        asked = [np.array([place.setdefault(w, len(place)) for w in _unpack_words(raw)], dtype=np.int32) for raw in lists.column("words").to_pylist()]
        flat, size = array("i"), array("i")
        for word in place:
            ids = encode(word, ranks)
            flat.extend(ids)
            size.append(len(ids))
        del place
        codes, sizes_ = np.frombuffer(flat, np.int32), np.frombuffer(size, np.int32)
        first = np.cumsum(sizes_, dtype=np.int64) - sizes_
        sizes, tokens = [], []
        for at in asked:
            count = sizes_[at]
            sizes.append(_pack(count))
            tokens.append(_pack(codes[np.repeat(first[at] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))]))
        return pa.table([lists.column("block"), lists.column("shard"), pa.array(sizes, pa.binary()), pa.array(tokens, pa.binary())], names=["of", "shard", "sizes", "tokens"])

    return work


def decode(ids: np.ndarray, pieces: list[bytes]) -> bytes:
    """The bytes of a sequence of token ids."""
    return b"".join(map(pieces.__getitem__, ids.tolist()))


def encoded(docs: DataFrame, ranks: dict[bytes, int], pattern: str, block_bytes: int = BLOCK_BYTES, digest: bool = False) -> DataFrame:
    """``row`` and ``ids`` (array<int>) of every row of ``docs`` (``row``, ``text``).

    With ``digest`` instead of ids: their number, the SHA-256 of their decimal list and of the decoded bytes.
    """
    ship_code(docs.sparkSession)
    shards = block_count(docs, F.octet_length("text"), block_bytes)
    blocks = stored(tokenized(docs, pattern, shards, block_bytes), "bpe-blocks")
    lists = blocks.where("shard IS NOT NULL").select("shard", "block", "words")
    found = lists.groupBy("shard").applyInArrow(_answer(ranks), "of long, shard int, sizes binary, tokens binary")
    texts = blocks.where("shard IS NULL").select("block", "rows", "sizes", "refs", "ids")
    pieces = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        names = [str(i) for i in range(len(pieces))]
        right = right.sort_by("shard")
        parts = [[_unpack(x) for x in some.column(c).to_pylist() if x is not None] for some, c in ((left, "ids"), (right, "sizes"), (right, "tokens"))]
        ids_, sizes_, flat = (np.concatenate(p) if p else np.zeros(0, np.int32) for p in parts)
        count = np.zeros(len(ids_), dtype=np.int64)
        first = np.zeros(len(ids_), dtype=np.int64)
        count[ids_], first[ids_] = sizes_, np.cumsum(sizes_) - sizes_
        rows, ids, sizes, shas, backs = [], [], [], [], []

        def each():
            for some, size, refs in zip(*(left.column(c).to_pylist() for c in ("rows", "sizes", "refs")), strict=True):
                rows.extend(some)
                yield from np.split(_unpack(refs), np.cumsum(_unpack(size))[:-1])

        for r in each():
            c = count[r]
            total = int(c.sum())
            at = np.repeat(first[r] - np.concatenate(([0], np.cumsum(c)[:-1])) if len(r) else first[r], c) + np.arange(total)
            tokens = flat[at]
            if digest:
                sizes.append(total)
                shas.append(hashlib.sha256(",".join(map(names.__getitem__, tokens.tolist())).encode()).hexdigest())
                backs.append(hashlib.sha256(decode(tokens, pieces)).hexdigest())
            else:
                ids.append(tokens)
        if digest:
            return pa.table([pa.array(rows, pa.int64()), pa.array(sizes, pa.int64()), pa.array(shas, pa.string()), pa.array(backs, pa.string())], names=["row", "n_tokens", "ids_sha256", "decoded_sha256"])
        return pa.table([pa.array(rows, pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["row", "ids"])

    kind = "row long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "row long, ids array<int>"
    return texts.groupBy("block").cogroup(found.groupBy("of")).applyInArrow(assemble, kind)
