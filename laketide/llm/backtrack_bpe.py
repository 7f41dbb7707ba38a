"""BPE with word ends: a backtracking encoder over Aho-Corasick matches, decoding by an offset table.

The symbols of a word are its bytes, the last one in a form of its own (the word end), so 512
symbols are the letters of ordinary strings here. One pass of the automaton over a word gives
the longest token that starts at each place. The encoder goes from left to right with the
longest token that the pair table lets follow the token before; if none fits it takes the last
token back and goes on with the next shorter one. A word prefix has one valid encoding only, so
a place that failed once is closed for good, and the work is linear in the word's length.

Two tokens are compatible when merging by rank would leave the boundary between them alone. That
is found by undoing the merges of both tokens from the latest on, and kept in a bounded table.
Words met lately are kept with their ids, in two bounded generations. Nothing is shuffled: a text is encoded where it
is read, and a lost task is simply run again.

Defined results: null and empty texts have no tokens; special tokens written in a text are taken
as such, as the library does; all columns and repeated rows pass through. Characters that Python's
Unicode tables do not know yet are normalized and cut by the tokenizers library; the encoding of
the pieces is done here in every case. One text must fit a task.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from laketide.llm.common import ship_code

#: The vocabulary is broadcast; larger files are refused.
MODEL_BYTES = 64 << 20
#: Entries of the pair table and of the words remembered by a worker.
PAIRS = 1 << 20
WORDS = 1 << 19
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACE = "\t-\r \x85\xa0  -     　"


def read_model(path: str) -> dict:
    """The tokenizer file, refused if it is not of the kind this module encodes."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model = spec["model"]
    kinds = [s["type"] for s in (spec["normalizer"] or {}).get("normalizers", [])]
    cuts = [s["type"] for s in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
    plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges", "fuse_unk"))
    if not (model["type"] == "BPE" and plain and model["end_of_word_suffix"] and kinds == ["NFC", "Replace", "Lowercase"] and cuts == ["Split", "ByteLevel"]):
        raise ValueError(f"{path}: not a BPE with word ends over normalized, lower-cased words")
    if spec["pre_tokenizer"]["pretokenizers"][0]["pattern"] != {"Regex": PATTERN} or spec["decoder"] is not None or spec["post_processor"] is not None:
        raise ValueError(f"{path}: other words or another decoder than this module knows")
    return spec


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def _class(kind: str, last: int) -> str:
    """The characters of a general category, up to a last one, as ranges of a regular expression class."""
    out, start = [], None
    for code in range(last + 2):
        inside = code <= last and unicodedata.category(chr(code)).startswith(kind)
        if inside and start is None:
            start = code
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{code - 1:08x}")
            start = None
    return "".join(out)


class Cutter:
    """A text as words (bytes) and special tokens (ids)."""

    def __init__(self, spec: dict):
        self.plain = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+").findall
        self.beyond = re.compile("[\U00010000-\U0010ffff]").search
        # classes of the basic plane are bit maps, larger ones are searched range by range
        self.low, self.high = self._pattern(0xFFFF), self._pattern(sys.maxunicode)
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else lambda text: [text]
        self.spec, self.library = spec, None

    @staticmethod
    def _pattern(last: int):
        letters, numbers = _class("L", last), _class("N", last)
        words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{SPACE}{letters}{numbers}]+")
        return words.findall, re.compile(f"[{_class('Cn', last)}]").search

    def _by_library(self, text: str) -> list[str]:
        from tokenizers import Tokenizer

        if self.library is None:
            model = self.spec["model"] | {"vocab": {}, "merges": []}
            self.library = Tokenizer.from_str(json.dumps(self.spec | {"model": model, "added_tokens": []}))
            self.letters = {c: b for b, c in enumerate(byte_letters())}
        words = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(self.letters[c] for c in w).decode() for w, _ in words]

    def __call__(self, text: str) -> list[str | int]:
        if "<|" in text and len(parts := self.split(text)) > 1:
            return list(chain.from_iterable([self.special[p]] if i % 2 else self.cut(p) for i, p in enumerate(parts)))
        return self.cut(text)

    def cut(self, text: str) -> list[str]:
        if text.isascii():
            return self.plain(text.lower())
        words, unknown = self.high if self.beyond(text) else self.low
        if unknown(text):
            return self._by_library(text)
        # character by character: a final sigma is no special case
        return words(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())


class Encoder(dict):
    """Words to tuples of token ids; a missing word is encoded and, within bounds, remembered."""

    def __init__(self, spec: dict):
        import ahocorasick

        model, end = spec["model"], spec["model"]["end_of_word_suffix"]
        vocab = model["vocab"]
        size = max(vocab.values()) + 1
        self.base = size
        self.symbols: list[str | None] = [None] * size  # a token as a string of symbols
        for b, c in enumerate(byte_letters()):
            self.symbols[vocab[c]], self.symbols[vocab[c + end]] = chr(b), chr(256 + b)
        self.rank: dict[int, int] = {}  # merges by pair
        self.made = [-1] * size  # the rank of the merge that makes a token
        self.halves = [(-1, -1)] * size
        merged = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        for rank, (a, b) in enumerate(merged):
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            if self.symbols[left] is None or self.symbols[right] is None or self.symbols[whole] is not None:
                raise ValueError(f"merge {rank} uses tokens that no earlier merge makes, or makes one twice")
            self.rank[left * size + right] = rank
            self.symbols[whole], self.made[whole], self.halves[whole] = self.symbols[left] + self.symbols[right], rank, (left, right)
        self.pairs: dict[int, bool] = {}
        self.before: dict[str, tuple[int, ...]] = {}  # words remembered before the last change of generations
        # a token that its own bytes are not encoded to can never occur
        known = [t for t, s in enumerate(self.symbols) if s is not None and (self.made[t] < 0 or self.compatible(*self.halves[t], self.made[t]))]
        self.size = [len(s or "") for s in self.symbols]
        self.matches = ahocorasick.Automaton()
        for t in known:
            if self.size[t] > 1:
                self.matches.add_word(self.symbols[t], t)
        self.single = {self.symbols[t]: t for t in known if self.size[t] == 1}
        self.matches.make_automaton()
        ids = {self.symbols[t]: t for t in known}
        self.shorter = [-1] * size  # the longest token that a token starts with
        for t in known:
            s = self.symbols[t]
            self.shorter[t] = next((ids[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in ids), -1)

    def compatible(self, left: int, right: int, limit: int | None = None) -> bool:
        """No merge before ``limit`` joins the end of ``left`` with the start of ``right``."""
        limit = len(self.rank) if limit is None else limit
        while True:
            if self.rank.get(left * self.base + right, limit) < limit:
                return False
            a, b = self.made[left], self.made[right]
            if a < 0 and b < 0:
                return True
            if a > b:  # before this merge the end of the left token stood alone
                limit, left = min(limit, a), self.halves[left][1]
            else:  # of equal pairs the leftmost, which crosses the boundary, would be merged first
                limit, right = min(limit, b + 1), self.halves[right][0]

    def fits(self, left: int, right: int) -> bool:
        pair = left * self.base + right
        known = self.pairs.get(pair)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[pair] = self.compatible(left, right)
        return known

    def encode(self, word: str) -> tuple[int, ...]:
        raw = word.encode().decode("latin-1")
        text = raw[:-1] + chr(ord(raw[-1]) + 256)
        n, size, fits, shorter = len(text), self.size, self.fits, self.shorter
        longest = list(map(self.single.__getitem__, text))
        for last, token in self.matches.iter(text):
            start = last - size[token] + 1
            if size[longest[start]] < size[token]:
                longest[start] = token
        closed = bytearray(n + 1)
        taken: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            while token >= 0 and (closed[at + size[token]] or (taken and not fits(taken[-1], token))):
                token = shorter[token]
            if token >= 0:
                taken.append(token)
                at += size[token]
                token = longest[at] if at < n else -1
            else:
                closed[at] = 1
                back = taken.pop()
                at, token = at - size[back], shorter[back]
        return tuple(taken)

    def __missing__(self, word: str | int) -> tuple[int, ...]:
        if isinstance(word, int):
            return (word,)
        ids = self.before.pop(word, None) or self.encode(word)
        if len(self) >= WORDS:
            self.before = dict(self)
            self.clear()
        if len(word) <= 64:
            self[word] = ids
        return ids


class Decoder:
    """Token ids to text: the library writes the tokens themselves, a blank between them."""

    def __init__(self, spec: dict):
        pieces = {i: t for t, i in spec["model"]["vocab"].items()} | {a["id"]: a["content"] for a in spec["added_tokens"]}
        raw = [(pieces[i] + " ").encode() if i in pieces else b"" for i in range(max(pieces) + 1)]
        self.bytes = np.frombuffer(b"".join(raw), dtype=np.uint8)
        self.offsets = np.concatenate(([0], np.cumsum([len(r) for r in raw])))

    def __call__(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        start, size = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        place = np.arange(int(size.sum())) + np.repeat(start - np.concatenate(([0], np.cumsum(size)[:-1])), size)
        return self.bytes[place].tobytes()[:-1]


class Tokenizer:
    def __init__(self, spec: dict):
        self.cutter, self.encoder, self.decoder = Cutter(spec), Encoder(spec), Decoder(spec)

    def encode(self, text: str | None) -> np.ndarray:
        return np.fromiter(chain.from_iterable(map(self.encoder.__getitem__, self.cutter(text or ""))), dtype=np.uint32)

    def decode(self, ids: np.ndarray) -> bytes:
        return self.decoder(ids.astype(np.int64))


_built: dict[str, Tokenizer] = {}


def _tokenizer(shipped: Broadcast) -> Tokenizer:
    """The tables of a vocabulary, built once in each Python worker."""
    name = hashlib.sha256(shipped.value).hexdigest()
    if name not in _built:
        _built.clear()
        _built[name] = Tokenizer(json.loads(shipped.value))
    return _built[name]


def _ship(spark: SparkSession, spec: dict) -> Broadcast:
    ship_code(spark)
    raw = json.dumps(spec).encode()
    if len(raw) > MODEL_BYTES:
        raise ValueError(f"a vocabulary of {len(raw)} bytes is not broadcast, {MODEL_BYTES} at most")
    return spark.sparkContext.broadcast(raw)


def encoded(docs: DataFrame, spec: dict, text: str = "text", into: str = "ids") -> DataFrame:
    """``docs`` with the token ids of every text, array<int>."""
    shipped = _ship(docs.sparkSession, spec)

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = _tokenizer(shipped)
        for texts in batches:
            yield pd.Series([tokenizer.encode(t).astype(np.int32) for t in texts])

    return docs.withColumn(into, ids(F.col(f"`{text}`")))


def decoded(ids: Column, spec: dict, spark: SparkSession) -> Column:
    """The text of a column of token ids; null for null."""
    shipped = _ship(spark, spec)

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = _tokenizer(shipped)
        for lists in batches:
            yield pd.Series([None if x is None else tokenizer.decode(np.asarray(x)).decode() for x in lists])

    return texts(ids)


def digests(docs: DataFrame, spec: dict, text: str = "text", into: str = "tokens") -> DataFrame:
    """``docs`` with a struct for every text: the number of its tokens and the SHA-256 of the ids
    (little-endian, 32 bits each) and of the text they are decoded to."""
    shipped = _ship(docs.sparkSession, spec)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tokenizer = _tokenizer(shipped)
        for texts in batches:
            rows = []
            for t in texts:
                ids = tokenizer.encode(t)
                rows.append((len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(tokenizer.decode(ids)).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.withColumn(into, both(F.col(f"`{text}`")))
