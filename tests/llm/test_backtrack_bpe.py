"""The backtracking encoder against the tokenizers library."""

import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from laketide.llm import backtrack_bpe as bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def spec():
    return bpe.read_model(PATH)


@pytest.fixture(scope="module")
def own(spec):
    return bpe.Tokenizer(spec)


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_mixed_characters(own):
    rng = random.Random(5)
    bits = ["a", "b", "e", "th", "ing", " ", "'s", "'T", "é", "é", "Σ", "İ", "1", "²", "Ⅷ", "<|endoftext|>", "<|startoftext|>", "<|", "</w>", "\n", "\x85", "\x1c", "\0", "中", "ꟊ", "\U00010d50", "🙂", "ß", "!", "..", "'", "aaa", "՘", "　", "ﬁ", "Å", "한", "�"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 50)))
        ids = own.encode(text)
        assert ids.tolist() == ids_of(text), repr(text)
        assert own.decode(ids).decode() == LIBRARY.decode(ids.tolist(), skip_special_tokens=False)


def test_every_character(own):
    """Every code point between letters, in blocks that mix known and unknown ones."""
    for start in range(0, 0x110000, 4096):
        text = " ".join(f"x{chr(c)}y" for c in range(start, start + 4096) if not 0xD800 <= c < 0xE000)
        assert own.encode(text).tolist() == ids_of(text), hex(start)


def test_long_words(own):
    rng = random.Random(6)
    for word in ["".join(rng.choice("abcdefgh") for _ in range(100_000)), "a" * 300_000, "é!" * 50_000]:
        assert own.encode(word).tolist() == ids_of(word)


def test_few_words_remembered(spec, monkeypatch):
    monkeypatch.setattr(bpe, "WORDS", 3)
    monkeypatch.setattr(bpe, "PAIRS", 5)
    small = bpe.Tokenizer(spec)
    for text in ["the quick brown fox jumps over the lazy dog", "the dog and the fox"] * 3:
        assert small.encode(text).tolist() == ids_of(text)
    assert len(small.encoder) <= 3 and len(small.encoder.pairs) <= 5


def test_tables(spark, docs, empty, spec):
    out = bpe.digests(docs, spec)
    assert out.columns == [*docs.columns, "tokens"]
    for r in out.collect():
        ids = ids_of(r["text"])
        assert r["tokens"]["n_tokens"] == len(ids)
        assert r["tokens"]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["tokens"]["decoded_sha256"] == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = bpe.encoded(docs, spec).withColumn("back", bpe.decoded(F.col("ids"), spec, spark)).collect()
    for r in back:
        assert r["ids"] == ids_of(r["text"]) and r["back"] == LIBRARY.decode(r["ids"], skip_special_tokens=False)
    assert bpe.digests(empty, spec).count() == 0


def test_other_models_refused(tmp_path):
    for name in ("byte_bpe_50k.json",):
        with pytest.raises(ValueError):
            bpe.read_model(public_tokenizers.path(name))
    changed = json.load(open(PATH, encoding="utf-8"))
    changed["model"]["merges"] = [["q", "zz"], *changed["model"]["merges"]]
    with pytest.raises((ValueError, KeyError)):
        bpe.Encoder(changed)
