"""Packing by power-of-two decomposition.

A document's ids (with an end id) are split into pieces of `size` ids and the binary digits of the rest, longest
first. Each piece is a sequence of its own: its length is a power of two, so there is no padding, no sequence crosses
documents, and sequences of equal length form a bucket (`length`) from which batches are drawn. Only the rows' own
task is needed: no shuffle. Sequence ids are unique: the task's partition in the upper bits, a counter in the lower.

Defined cases: a null text counts as empty and gives one piece with the end id alone; repeated rows are packed each;
a null doc_id stays null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import table
from readloom.llm.tokenizing import byte_bpe

COLUMNS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pieces(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: as many of `size` as fit, then falling powers of two."""
    out = [(at, size) for at in range(0, n - size + 1, size)]
    at = n - n % size
    for bit in range(size.bit_length() - 2, -1, -1):
        if n % size >> bit & 1:
            out.append((at, 1 << bit))
            at += 1 << bit
    return out


def pack(docs: DataFrame, tokenizer_path: str, size: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """One row for each piece; with_ids adds `ids`, an array of the piece's ids."""
    if size < 1 or size & (size - 1):
        raise ValueError("size must be a power of two")
    names = [c.split()[0] for c in COLUMNS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        sequence, bpe, end = (task.partitionId() if task else 0) << 40, byte_bpe(tokenizer_path), np.array([end_id], dtype="<u4")
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                out: list[list] = [[] for _ in names]
                kept = []
                for doc_id, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    ids = np.concatenate([bpe.ids(text or "").astype("<u4"), end])
                    data, n = memoryview(ids).cast("B"), len(ids)
                    for start, length in pieces(n, size):
                        row = (doc_id, start, length, zlib.crc32(data[4 * start : 4 * (start + length)]), n, sequence, 0)
                        sequence += 1
                        for column, value in zip(out, row, strict=True):
                            column.append(value)
                        if with_ids:
                            kept.append(ids[start : start + length].tolist())
                arrays = [pa.array(x, pa.int64()) for x in out]
                yield pa.RecordBatch.from_arrays(arrays + ([pa.array(kept, pa.list_(pa.int64()))] if with_ids else []), names + ["ids"] * with_ids)

    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return held.mapInArrow(run, COLUMNS + (", ids array<long>" if with_ids else ""))


def write_buckets(packed: DataFrame, path: str) -> None:
    """Packed sequences (with ids) as Parquet, one folder for each length."""
    packed.withColumn("bucket", F.col("length")).write.partitionBy("bucket").parquet(path)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
