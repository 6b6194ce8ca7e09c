"""Overlaps of arriving reads with the stored index: a stream joined with tables, without state.

Defined cases: null sequences are left out; a read of another length than the stored ones raises an error; without
stored reads nothing overlaps; an empty stream gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.operators.dedup import common_length
from readloom.operators.overlap import _suffixes, partners
from readloom.streaming.dedup import _held


def overlap_stream(reads: DataFrame, unique: DataFrame, min_overlap: int = 14, max_overlaps: int | None = 8) -> DataFrame:
    """a_id, b_id, k: as overlap_pairs, for arriving reads (read_id, seq) against the stored distinct reads."""
    length = common_length(unique)
    held = _held(reads)
    if length is not None:
        held = held.withColumn("seq", F.when(F.length("seq") == length, F.col("seq")).otherwise(F.raise_error(F.lit(f"a read must have {length} letters"))))
    return partners(_suffixes(held, min_overlap), unique, min_overlap, max_overlaps)
