import hashlib

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from laketide.llm import bpe


@pytest.fixture(scope="module", params=["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"])
def vocabulary(request):
    ranks = bpe.read_ranks(public_tokenizers.path(request.param))
    return ranks, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encode_and_decode(docs, corpus, vocabulary):
    ranks, reference = vocabulary
    odd = [(100, "Ünïcode 東京 🙂🙂   tabs\t\tand\r\n\r\nlines  "), (101, "x" * 500 + "12345 6789"), (102, "<|endoftext|> it's we'll\x00\x7f")]
    rows = docs.select(F.col("doc_id").alias("row"), "text").unionAll(docs.sparkSession.createDataFrame(odd, "row long, text string"))
    ids = bpe.encoded(rows, ranks, public_tokenizers.PATTERN, block_bytes=2000).collect()
    want = [(i, reference.encode_ordinary(t or "")) for i, t in [*corpus, *odd]]
    assert sorted(((r["row"], r["ids"]) for r in ids), key=repr) == sorted(want, key=repr)
    digests = bpe.encoded(rows, ranks, public_tokenizers.PATTERN, digest=True).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    texts = [(i, len(x), sha(",".join(map(str, x)).encode()), sha((t or "").encode())) for (i, t), (_, x) in zip([*corpus, *odd], want, strict=True)]
    assert sorted((tuple(r) for r in digests), key=repr) == sorted(texts, key=repr)


def test_no_rows(empty, vocabulary):
    assert bpe.encoded(empty.select(F.col("doc_id").alias("row"), "text"), vocabulary[0], public_tokenizers.PATTERN).count() == 0
