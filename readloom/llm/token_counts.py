"""Token counts with a whole-token shortcut, for sentencepiece BPE models.

Offline, once for each worker, the vocabulary is read and two facts are proved: (1) no piece has the space mark after
another character, so no merge crosses the start of a run of space marks and the pre-tokens (a run of space marks and
what follows) can be merged alone; (2) which strings `mark + body` of the vocabulary encode alone as exactly one
token. A pre-token among the latter counts one directly; only the rest is merged by the library, once for each
distinct pre-token (kept up to a bound). If the model normalises texts or (1) fails, whole texts go to the library.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); rows keep their multiplicity; a null doc_id stays
null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import table

MARK = "▁"
#: Distinct pre-tokens whose counts a worker keeps.
KEPT = 300_000


def _fields(message: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protocol buffer's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = message[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(message):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        elif tag & 7 == 2:
            n = varint()
            yield tag >> 3, message[at : at + n]
            at += n
        else:
            n = 8 if tag & 7 == 1 else 4
            yield tag >> 3, message[at : at + n]
            at += n


class Counter:
    """Counts tokens as the sentencepiece model at `path` does."""

    def __init__(self, path: str, shortcut: bool = True):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            normaliser = dict(_fields(next(v for k, v in _fields(f.read()) if k == 3)))  # normalizer_spec of the model
        # precompiled_charsmap empty; dummy prefix on, extra white space kept, spaces escaped
        plain = not normaliser.get(2) and normaliser.get(3, 1) == 1 and normaliser.get(4, 1) == 0 and normaliser.get(5, 1) == 1
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.split = shortcut and plain and not any(MARK in p.lstrip(MARK) for p in pieces)
        self.whole: set[str] = set()
        if self.split:
            bodies = [p[1:] for p in pieces if p[:1] == MARK and p[1:] and MARK not in p[1:]]
            self.whole = {b for b, ids in zip(bodies, self.library.encode(bodies, num_threads=1), strict=True) if len(ids) == 1}
        self.kept: dict[str, int] = {}

    def counts(self, texts: list[str]) -> list[int]:
        if not self.split:
            return [len(x) for x in self.library.encode(texts, num_threads=1)]
        # a body x stands for the pre-token mark + x; an empty body between spaces stretches the run of marks
        odd = [i for i, t in enumerate(texts) if MARK in t or "  " in t or t[:1] == " " or t[-1:] == " " or not t or "\0" in t]
        out = [0] * len(texts)
        if odd:
            for i, ids in zip(odd, self.library.encode([texts[i] for i in odd], num_threads=1), strict=True):
                out[i] = len(ids)
        skip = set(odd)
        if len(self.kept) > KEPT or not self.kept:
            self.kept = dict.fromkeys(self.whole, 1)
        for i, text in enumerate(texts):
            if i not in skip:
                bodies, kept = text.split(" "), self.kept
                if rest := [b for b in set(bodies) if b not in kept]:
                    kept.update(zip(rest, map(len, self.library.encode(rest, num_threads=1)), strict=True))
                out[i] = sum(map(kept.__getitem__, bodies))
        return out


@cache
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every document's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            n = counter(model_path).counts(texts.to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.col("text").cast("string").alias("text"))
    return held.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), 4096)
