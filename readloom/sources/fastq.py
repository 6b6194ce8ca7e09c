"""FASTQ files as DataFrames, read and written by Spark's text source (any file system, splits, codecs)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Names of packed files.
PACKED = "[.](gz|bz2|zst|lz4|snappy|deflate)$"
#: The lines of a record.
FOUR = ("header", "seq", "plus", "qual")


def _no_cr(c: Column) -> Column:
    return F.regexp_replace(c, "\r$", "")


MODES = ("fail", "drop", "permissive")


def read_fastq(spark: SparkSession, path: str, ends: bool = False, mode: str = "fail") -> DataFrame:
    """read_id (from 0), header, seq, qual, byte_offset of every record; with ends also byte_end, where the next begins or the files end.

    Several files count as one, in the order of their paths.

    Records are four lines; the header isn't looked at, the third line must begin with + (else an error), a missing
    last quality line is taken as empty and one final blank line is accepted. A CR before the line's end is dropped.
    Lines may be of any length. Line numbers come from the splits' line counts, so no task reads a whole file.

    mode: a bad record raises an error (fail), is left out (drop), or stays with a null seq and its `reason`, a column
    that is null elsewhere (permissive). Reads keep the numbers of their places; read_rejects() gives what is left out.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    found = _records(spark, path)
    seq = _no_cr(F.col("seq"))
    if mode == "fail":
        seq = F.when(F.col("reason").isNull(), seq).otherwise(F.raise_error(F.concat(F.lit("input data format error in read "), F.col("read_id").cast("string"))))
    elif mode == "drop":
        found = found.where("reason is null")
    else:
        seq = F.when(F.col("reason").isNull(), seq)
    return found.select("read_id", _no_cr(F.col("header")).alias("header"), seq.alias("seq"), _no_cr(F.coalesce("qual", F.lit(""))).alias("qual"), "byte_offset", *["byte_end"] * ends, *["reason"] * (mode == "permissive"))


def read_rejects(spark: SparkSession, path: str) -> DataFrame:
    """read_id, byte_offset, reason, record (its lines) of every bad record: `cut short` without a third line, else `third line`."""
    record = F.concat_ws("\n", "header", "seq", "plus", "qual")
    return _records(spark, path).where("reason is not null").select("read_id", "byte_offset", "reason", record.alias("record"))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of lines in the order of their splits: four neighbouring lines of one split are a row; what a split's end leaves over is a row for each line."""
    held, total, began = None, 0, 0

    def rows(table: pa.Table, last: bool) -> tuple[pa.RecordBatch, pa.Table]:
        n = table.num_rows
        part, first, at, size = (table.column(c).to_numpy() for c in ("part", "first", "at", "size"))
        heads = np.flatnonzero(part == 0)
        # the lines of a record that the batch's end cuts wait for the next batch
        kept = n if last or not len(heads) or heads[-1] <= n - 4 else int(heads[-1])
        heads = heads[heads + 3 < kept]
        heads = heads[first[heads] == first[heads + 3]]
        left = np.ones(kept, dtype=bool)
        for i in range(4):
            left[heads + i] = False
        left = np.flatnonzero(left)
        line, both = table.column("line").combine_chunks(), np.concatenate
        at_, end = both([at[heads], at[left]]), both([at[heads + 3] + size[heads + 3], at[left] + size[left]])
        texts = [line.take(pa.array(both([heads + i, left]), mask=both([np.zeros(len(heads), dtype=bool), part[left] != i]))) for i in range(4)]
        order = pa.array(both([heads, left]))
        whole = both([np.ones(len(heads), dtype=bool), np.zeros(len(left), dtype=bool)])
        offset = pa.array(at_, pa.int64(), mask=both([np.zeros(len(heads), dtype=bool), part[left] != 0]))
        ids, ends = (table.column(c).combine_chunks().take(order) for c in ("read_id", "files_end"))
        return pa.RecordBatch.from_arrays([ids, *texts, offset, pa.array(end, pa.int64()), ends, pa.array(whole)], ["read_id", *FOUR, "byte_offset", "byte_end", "files_end", "whole"]), table.slice(kept)

    for batch in batches:
        if not batch.num_rows:
            continue
        size = batch.column("size").to_numpy(zero_copy_only=False)
        before = total + np.cumsum(size) - size
        total += int(size.sum())
        begun = np.maximum.accumulate(np.where(batch.column("begins").to_numpy(zero_copy_only=False), before, began))
        began = int(begun[-1])
        at = batch.column("bytes_before").to_numpy(zero_copy_only=False) + before - begun
        table = pa.Table.from_batches([batch]).append_column("at", pa.array(at, pa.int64()))
        out, held = rows(table if held is None or not held.num_rows else pa.concat_tables([held, table]), False)
        yield out
    if held is not None and held.num_rows:
        yield rows(held, True)[0]


def _records(spark: SparkSession, path: str) -> DataFrame:
    """The four lines of each record (null where there are no more), its place, and what is wrong with it."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("file_size"), F.monotonically_increasing_id().alias("mid"))
    size = F.octet_length("line") + 1
    blocks = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.sum(size).alias("bytes"), F.min("mid").alias("first"), F.max("file_size").alias("file_size"))
    so_far = lambda c, *by: F.coalesce(F.sum(c).over(Window.partitionBy(*by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.withColumn("lines_before", so_far("n", "file")).withColumn("bytes_before", so_far("bytes", "file"))
    # the last line of a file may have no end; a packed file's size is not that of its text
    size_of = F.when(F.col("file").rlike(PACKED), F.sum("bytes")).otherwise(F.max("file_size"))
    files = blocks.groupBy("file").agg(F.sum("n").alias("file_lines"), size_of.alias("file_bytes"))
    records = F.ceil(F.col("file_lines") / 4)
    before = lambda c: F.coalesce(F.sum(c).over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # noqa: E731  a row for each file
    files = files.select("file", before(records).alias("records_before"), before(F.col("file_bytes")).alias("files_before"), F.sum("file_bytes").over(Window.orderBy("file")).alias("files_end"))
    blocks = blocks.join(files, "file").select("file", "block", "first", "lines_before", (F.col("bytes_before") + F.col("files_before")).alias("bytes_before"), "records_before", "files_end")
    placed = lines.join(F.broadcast(blocks), ["file", "block"]).withColumn("number", F.col("lines_before") + F.col("mid") - F.col("first"))
    placed = placed.select("line", (F.col("mid") == F.col("first")).alias("begins"), "first", (F.col("records_before") + F.floor(F.col("number") / 4)).alias("read_id"), (F.col("number") % 4).alias("part"), "bytes_before", size.cast("long").alias("size"), "files_end")
    found = placed.mapInArrow(_scan, f"read_id long, {', '.join(f'{c} string' for c in FOUR)}, byte_offset long, byte_end long, files_end long, whole boolean")
    # a record that a split's end cuts has its lines in several rows
    apart = found.where("not whole").groupBy("read_id").agg(*[F.max(c).alias(c) for c in (*FOUR, "byte_offset", "byte_end", "files_end")])
    found = found.where("whole").drop("whole").unionByName(apart).withColumn("byte_end", F.least("byte_end", "files_end")).drop("files_end")
    found = found.where(~((_no_cr(F.col("header")) == "") & F.col("seq").isNull()))
    reason = F.when(F.col("plus").isNull(), "cut short").when(~F.col("plus").startswith("+"), "third line")
    return found.withColumn("reason", reason)


def write_fastq(reads: DataFrame, path: str) -> None:
    """Reads (read_id, seq, optional header and qual) as FASTQ, in order of read_id.

    A row with a null seq is no read and isn't written; a null header is made from the read_id, a null qual is one I a letter.
    """
    reads = reads.where("seq is not null")
    header, qual = F.concat(F.lit("@"), F.coalesce(F.col("read_id").cast("string"), F.lit(""))), F.expr("repeat('I', length(seq))")
    header = F.coalesce("header", header) if "header" in reads.columns else header
    qual = F.coalesce("qual", qual) if "qual" in reads.columns else qual
    lines = F.concat_ws("\n", header, F.col("seq"), F.lit("+"), qual)
    reads.select("read_id", lines.alias("value")).orderBy("read_id").select("value").write.text(path)


def offset_index(fastq: DataFrame) -> DataFrame:
    """entry, byte_offset: one entry for each read and a last one with the end of the last read.

    That end is byte_end, if fastq was read with ends; else what the last record has with LF ends and a bare + line.
    """
    size = F.octet_length("header") + F.octet_length("seq") + F.octet_length("qual") + 5
    end = F.col("byte_end") if "byte_end" in fastq.columns else F.col("byte_offset") + size
    last = fastq.agg((F.max("read_id") + 1).alias("entry"), F.max(F.struct("read_id", end.alias("end")))["end"].alias("byte_offset"))
    return fastq.select(F.col("read_id").alias("entry"), "byte_offset").unionByName(last.where("entry is not null"))


def fetch(fastq: DataFrame, ids: DataFrame) -> DataFrame:
    """read_id and record (sequence;quality) of the ids asked for."""
    return ids.select("read_id").join(fastq, "read_id").select("read_id", F.concat_ws(";", "seq", "qual").alias("record"))
