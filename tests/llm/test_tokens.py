import random

import public_tokenizers
import pytest

from readloom.llm.token_counts import Counter, token_counts
from readloom.llm.tokenizing import ByteBpe

BITS = ["a", "b", " ", "  ", "\n", "\t", "\xa0", "　", "é", "ß", "1", "23", ".", "'s", "'ll", "!?", "<|endoftext|>", "\x1c", "\x85", "漢字", "🙂", "​", "\r\n", "_", "▁", "\0", "<s>", "́"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    return ["", " ", "a" * 100_000, "word " * 20_000] + ["".join(rng.choices(BITS, k=rng.randint(0, 25))) for _ in range(4000)]


def test_byte_bpe_equals_library(texts):
    bpe = ByteBpe(public_tokenizers.path("byte_bpe_50k.json"))
    for t in texts:
        assert bpe.ids(t).tolist() == bpe.library.encode(t, add_special_tokens=False).ids


def test_whole_token_shortcut_equals_library(texts):
    c = Counter(public_tokenizers.path("piece_bpe_32k.model"))
    assert c.split and len(c.whole) > 10_000
    assert c.counts(texts) == [len(x) for x in c.library.encode(texts)]
    assert Counter(public_tokenizers.path("piece_bpe_32k.model"), shortcut=False).counts(texts[:50]) == c.counts(texts[:50])


def test_token_counts(spark):
    rows = [(1, "a b"), (1, "a b"), (2, None), (None, "é"), (3, "word " * 5000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_bytes string")
    out = sorted(map(tuple, token_counts(df, public_tokenizers.path("piece_bpe_32k.model")).collect()), key=repr)
    c = Counter(public_tokenizers.path("piece_bpe_32k.model"))
    want = [(i, len((t or "").encode()), len(c.library.encode(t or "")), len(c.library.encode(t or "")) > 4096) for i, t in rows]
    assert out == sorted(want, key=repr)
    assert token_counts(df.limit(0), public_tokenizers.path("piece_bpe_32k.model")).count() == 0
