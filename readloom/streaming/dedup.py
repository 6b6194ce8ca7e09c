"""Duplicates while reads arrive. "First" then means first to arrive.

Defined cases: null sequences are left out; without a time column nothing is ever forgotten; rows of one batch count in
the order of (time, read_id).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from readloom.functions.sequence import normalised


def _held(reads: DataFrame) -> DataFrame:
    return reads.where("seq is not null").withColumn("seq", normalised(F.col("seq")))


def _copies(reads: DataFrame, time: str | None, delay: str, keep_ms: int) -> DataFrame:
    """seq, read_id, first_id (null for a first copy) of every read; the state is a row for each distinct sequence."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        first, last = state.get if state.exists else (None, 0)
        found = []
        rows = [row for f in frames for row in zip(f["__at"].tolist(), f["read_id"].tolist(), strict=True)]
        for at, read_id in sorted(rows):
            # by the rows' own times: a state is removed only after the batch that moves the watermark
            new = first is None or (time is not None and at > last + keep_ms)
            found.append((key[0], read_id, None if new else first))
            first, last = read_id if new else first, max(last, at)
        state.update((first, last))
        if time is not None:
            state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + keep_ms)
        yield pd.DataFrame(found, columns=["seq", "read_id", "first_id"]).astype({"first_id": "Int64"})

    held, at = _held(reads), [F.lit(0).cast("long").alias("__at")]
    if time is not None:
        held, at = held.withWatermark(time, delay), [F.unix_millis(time).alias("__at"), F.col(time)]
    timeout = GroupStateTimeout.NoTimeout if time is None else GroupStateTimeout.EventTimeTimeout
    return held.select("read_id", "seq", *at).groupBy("seq").applyInPandasWithState(step, "seq string, read_id long, first_id long", "first long, last long", "append", timeout)


def unique_stream(reads: DataFrame, time: str | None = None, delay: str = "1 hour", keep_ms: int = 3_600_000) -> DataFrame:
    """The first copy of every sequence of a stream (read_id, seq).

    The state is a row for each distinct sequence. With `time`, a timestamp column watermarked by `delay`, a sequence is
    forgotten keep_ms after its last copy, and a copy that comes later counts as a first one.
    """
    if time is None:
        return _held(reads).select("read_id", "seq").dropDuplicates(["seq"])
    return _copies(reads, time, delay, keep_ms).where("first_id is null").select("read_id", "seq")


def duplicate_stream(reads: DataFrame, time: str | None = None, delay: str = "1 hour", keep_ms: int = 3_600_000) -> DataFrame:
    """first_id, dup_id for every later copy; states and forgetting as in unique_stream."""
    return _copies(reads, time, delay, keep_ms).where("first_id is not null").select("first_id", F.col("read_id").alias("dup_id"))
