import random
import time
import zlib

import numpy as np
import public_tokenizers
import tiktoken

from laketide.llm import bpe

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def test_words():
    """Any bytes, equal pairs side by side and a long word, as the public library encodes them."""
    reference = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=RANKS, special_tokens={})
    rng = random.Random(3)
    words = ["a", "aaaaaaa", " the", "é" * 50, "東京🙂" * 9] + ["".join(rng.choice("aabent ing\u00e9\u4e2d") for _ in range(rng.randint(1, 60))) for _ in range(400)]
    for w in words:
        assert bpe.encode(w.encode(), RANKS) == reference.encode_ordinary(w)
    began = time.monotonic()
    bpe.encode(("ab" * 100_000).encode(), RANKS)
    assert time.monotonic() - began < 20  # once the square of its length


def test_only_blocks_are_stored(spark, monkeypatch):
    """What is stored beside the shuffles: the blocks; before, the distinct words and their ids too."""
    labels, plain = [], bpe.stored
    monkeypatch.setattr(bpe, "stored", lambda df, label: labels.append(label) or plain(df, label))
    docs = spark.createDataFrame([(1, "one two two"), (2, None)], "row long, text string")
    got = bpe.encoded(docs, RANKS, public_tokenizers.PATTERN).orderBy("row").collect()
    assert labels == ["bpe-blocks"]
    assert bpe.decode(np.array(got[0].ids), {v: k for k, v in RANKS.items()}) == b"one two two" and got[1].ids == []


def test_short_documents_are_packed_together(spark):
    """Refs of short documents take little more room than those of one long text; before, each was compressed alone."""
    rng = random.Random(4)
    words = [f" w{rng.randint(0, 400)}" for _ in range(20_000)]
    size = lambda texts: sum(len(r.refs) for r in bpe.tokenized(spark.createDataFrame(list(enumerate(texts)), "row long, text string").coalesce(1), public_tokenizers.PATTERN, 1).where("refs IS NOT NULL").collect())
    assert size(["".join(words[i : i + 20]) for i in range(0, 20_000, 20)]) < 1.2 * size(["".join(words)])


def test_packed_numbers():
    rng = np.random.default_rng(1)
    for x in (np.zeros(0, np.int32), np.array([0, 254, 255, 256, 2**31 - 1], np.int32), np.minimum(rng.zipf(1.2, 50_000), 10**6).astype(np.int32)):
        assert np.array_equal(bpe._unpack(bpe._pack(x)), x)
    planes = zlib.compress(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 4).T.tobytes(), 1)
    assert len(bpe._pack(x)) < 0.95 * len(planes)  # the form before
