"""Token-id files: documents' ids, range coded, in ascending doc_id order.

Documents are dealt by ranges of (doc_id, start of the text, a number), so that rows without doc_id or with one doc_id
are split too, and sorted; every task tokenises its range and writes one file of records through Spark's text sink,
whose line end is the record's end mark, so writing is committed and recoverable on any file system. A record holds its
partition and number, the documents (id, length) and a segment of coded ids (blocks reset and checksummed alone). After
PER_FILE records a task begins its next file, so files stay small enough to be read whole, whatever a task's share.
Coding goes id by id, which Python is slow at: TokenCoder.java does it inside the executors' JVM, in the format of
range_coder.py, and both write the same bytes. Reading back decodes whole files, one task each; a document's `start` is
the place in its file plus the ids of all files before, of which there is a row each.

Defined cases: a null text counts as empty (the end id alone); rows with null doc_id come first, repeated doc_ids in
the order of their texts inside a file and of their first 64 letters across files; a text of any length may span many blocks; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom.llm.common import scratch, table, tidy
from readloom.llm.jvm import coder_functions
from readloom.llm.tokenizing import byte_bpe

MAGIC = b"RLTF"
#: Ids of a record (one document may have more): they bound a task's memory.
RECORD = 1 << 21
#: Records of a file: some 40 MB.
PER_FILE = 16


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2) -> None:
    """Writes the ids of every document, each followed by end_id."""
    most = RECORD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, bpe, number = TaskContext.get().partitionId(), byte_bpe(tokenizer_path), 0
        vocabulary = max(bpe.library.get_vocab_size(), end_id + 1)
        end = np.array([end_id], dtype=bpe.type)
        ids: list[np.ndarray] = []
        known: list[tuple[int, int, bool]] = []
        size = 0

        def record() -> pa.RecordBatch:
            nonlocal number
            index = zlib.compress(b"".join(struct.pack("<q?I", d, null, n) for d, n, null in known), 6)
            meta = MAGIC + struct.pack("<QQIQ", part, number, len(known), len(index))
            number += 1
            data = np.concatenate(ids).astype(bpe.type, copy=False).tobytes()
            return pa.RecordBatch.from_arrays([*(pa.array([x], pa.binary()) for x in (meta, index, data)), *(pa.array([x], pa.int32()) for x in (bpe.type.itemsize, vocabulary))], ["meta", "index", "ids", "width", "vocabulary"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(np.concatenate([bpe.ids(text or ""), end]))
                known.append((doc_id or 0, len(ids[-1]), doc_id is None))
                size += len(ids[-1])
                if size >= most:
                    yield record()
                    ids, known, size = [], [], 0
        if known:
            yield record()
        ids, known = [], []
        tidy()

    coder_functions(docs.sparkSession)
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held = held.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.substring("text", 1, 64).asc_nulls_first(), F.rand(7))
    held = held.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    records = held.mapInArrow(run, "meta binary, index binary, ids binary, width int, vocabulary int")
    records.select(F.expr("cast(readloom_encode_record(meta, index, ids, width, vocabulary) AS string) AS value")).write.option("maxRecordsPerFile", PER_FILE).text(path)


def read(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the decoded ids; an error if a file is damaged."""
    coder_functions(spark)
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("content")
    before = F.sum("size").over(Window.orderBy("partition", "first").rowsBetween(Window.unboundedPreceding, -1))  # a row for each file
    sizes = files.select(F.expr("inline(readloom_read_sizes(content))"))
    offsets = sizes.select("partition", "first", F.coalesce(before, F.lit(0)).alias("before"))
    found = files.select(F.expr("inline(readloom_read_documents(content))"))
    return found.join(offsets, ["partition", "first"]).select("doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch(spark, "ids")
    write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read(spark, path)
