"""Exact top-k inner products by an impact-ordered, score-at-a-time index.

A vector's components become integers. A block of candidates is indexed as postings (candidate, value), sorted into
segments by descending quantised impact |value| >> SHIFT and by dimension; zero components have none. A batch of
queries goes through the segments run by run: each segment adds query weight x value to the accumulators of its
candidates alone, and the squared weight to a second one. What a candidate still lacks after a run is at most
|the query's part without the dimensions it has had| x |its unprocessed part| (Cauchy-Schwarz on the dimensions that
are left for it; the norms of the unprocessed parts are stored in the index). A query stops only as soon as this proves
that all but a small share of the block can't be among its k best; those that can, ties included, are scored exactly.
Where that isn't proved, all segments are gone through. Nothing is lost: every candidate whose bound reaches the k-th
best proven score is kept. A block none of whose vectors is long enough for the k best of the blocks that its task has
seen is passed over.

Candidates are dealt into blocks of bounded size, each to one task that builds its index once; the queries, a stated
set, stream through it in batches. A query's k best of each block meet in one last top-k of k rows for each block.

Defined cases: vectors that are null or hold null, NaN or infinite components take no part, nor do rows without a
vec_id; an empty vector takes part with score 0; only vectors of equal length meet; repeated vec_ids count once, with
the smallest vector; ties go to the smaller vec_id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.llm.common import table

#: Rows of a block of candidates (fewer if they have more than 64 components) and queries of a batch: they bound memory.
BLOCK, QUERY_BLOCK = 16_384, 128
#: Impacts that differ only in the lowest bits share a level.
SHIFT = 2
#: Shares of the postings that are processed by the end of each run but the last.
RUNS = (1 / 64, 1 / 4, 3 / 8, 1 / 2, 5 / 8, 3 / 4, 7 / 8)
#: A run whose postings fill this share of (candidates x dimensions) is added by one matrix product, others segment by segment.
FULL = 1 / 32
#: A query stops when no more than this share of a block is possible.
FEW = 1 / 16
#: Queries whose best scores a task remembers between its blocks.
KNOWN = 1_000_000
RESULT = "query_id long, vec_id long, score long"


def quantised(embedding: Column) -> Column:
    """floor(256 * x) of every component, x as double; null where the vector can't take part."""
    x = F.transform(embedding, lambda e: e.cast("double"))
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return F.when(embedding.isNotNull() & ~F.coalesce(bad, F.lit(False)), F.transform(x, lambda e: F.floor(e * 256.0)))


class ImpactIndex:
    """Posting segments of one block of candidates, by descending impact and by dimension."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order]
        candidate, dimension = np.nonzero(self.rows)
        value = self.rows[candidate, dimension]
        impact = np.abs(value) >> SHIFT
        self.levels, level = np.unique(-impact, return_inverse=True)
        self.levels = -self.levels
        self.level_sizes = np.bincount(level, minlength=len(self.levels))
        run = np.zeros(len(self.levels), dtype=np.int64)
        for i, (start, end) in enumerate(self.groups()):
            run[start:end] = i
        run = run[level] if len(level) else level
        order = np.lexsort((dimension, run))
        self.candidate, self.value, dimension, run = candidate[order].astype(np.int32), value[order].astype(np.float64), dimension[order], run[order]
        # a segment: (run, dimension, its postings from, to)
        edge = np.flatnonzero(np.diff(run, prepend=-1) | np.diff(dimension, prepend=-1)) if len(run) else np.zeros(0, dtype=np.int64)
        ends = np.append(edge[1:], len(run)) if len(edge) else edge
        self.segments = [(int(run[i]), int(dimension[i]), int(i), int(j)) for i, j in zip(edge, ends, strict=True)]
        self.by_run: dict[int, list[tuple]] = {}
        for segment in self.segments:
            self.by_run.setdefault(segment[0], []).append(segment)
        # well filled runs as matrices of values and of ones
        self.filled: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for r in self.by_run:
            part = run == r
            if part.sum() >= FULL * self.rows.size:
                values = np.zeros(self.rows.shape, dtype=np.float32)
                values[self.candidate[part], dimension[part]] = self.value[part]
                self.filled[r] = values, (values != 0).astype(np.float32)
        # norm of what is unprocessed after each run
        left, self.rest = (self.rows.astype(np.float64) ** 2).sum(axis=1), []
        self.longest = float(np.sqrt(left.max(initial=0))) * (1 + 1e-9) + 1e-6
        for i in range(len(self.groups())):
            part = run == i
            left = left - np.bincount(self.candidate[part], weights=self.value[part] ** 2, minlength=len(left))
            self.rest.append(np.sqrt(np.maximum(left, 0)) * (1 + 1e-9) + 1e-6)
        self.exact = self.rows.astype(np.float64) if self.longest < 1 << 25 else None  # scores below 2 ** 53 are whole numbers
        self.touched = self.proved = self.through = 0  # postings; queries that stopped on proof, and that went through all

    def groups(self) -> list[tuple[int, int]]:
        """Runs of levels [i, j) that are processed at a time."""
        if not len(self.levels):
            return []
        sizes = self.level_sizes.cumsum()
        ends = sorted({int(np.searchsorted(sizes, sizes[-1] * share)) + 1 for share in RUNS} | {len(self.levels)})
        return list(zip([0, *ends[:-1]], ends, strict=True))

    def _scores(self, at: np.ndarray, query: np.ndarray) -> np.ndarray:
        if self.exact is not None and np.abs(query).max(initial=0) < 1 << 25:
            return (self.exact[at] @ query.astype(np.float64)).astype(np.int64)
        return self.rows[at].astype(np.int64) @ query.astype(np.int64)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, least: np.ndarray | None = None) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(query, its at most k best candidates' ids, their scores); least: scores that a query's candidates must reach to matter."""
        found, n = [], len(self.ids)
        weights, norms = queries.astype(np.float64), np.linalg.norm(queries.astype(np.float64), axis=1) * (1 + 1e-9)
        open_ = np.arange(len(queries))
        if least is not None:
            open_ = open_[norms * self.longest >= least]
        # bounds are kept in single precision and widened by what it may be off
        sums, seen = (np.zeros((len(open_), n), dtype=np.float32) for _ in range(2))
        off = (self.rows.shape[1] + 64) * 1.2e-7
        own = np.searchsorted(self.ids, query_ids)
        own = np.where((own < n) & (self.ids[np.minimum(own, n - 1)] == query_ids), own, -1)
        last = max(len(self.groups()) - 1, 0)
        for run in range(last + 1):
            active = weights[open_].astype(np.float32)
            squares = active**2
            if run in self.filled:
                values, ones = self.filled[run]
                sums += active @ values.T
                seen += squares @ ones.T
            for _, d, i, j in self.by_run.get(run, ()):
                self.touched += np.count_nonzero(active[:, d]) * (j - i)
                if run not in self.filled:
                    at = self.candidate[i:j]
                    sums[:, at] += active[:, d, None] * self.value[i:j].astype(np.float32)
                    seen[:, at] += squares[:, d, None]
            rest = (self.rest[run] if self.rest else np.zeros(n)).astype(np.float32) * np.float32(1 + 1e-6)
            slack = np.maximum((norms[open_] ** 2 * (1 + off)).astype(np.float32)[:, None] - seen, 0)
            np.sqrt(slack, out=slack)
            slack *= rest
            slack += (norms[open_] * self.longest * off).astype(np.float32)[:, None] + np.float32(1e-6)
            low = sums - slack
            has = own[open_] >= 0
            low[np.nonzero(has)[0], own[open_][has]] = -np.inf
            # the k-th best proven score; with fewer than k candidates all stay
            theta = np.partition(low, n - k, axis=1)[:, n - k].astype(np.float64) if n > k else np.full(len(open_), -np.inf)
            if least is not None:
                theta = np.maximum(theta, least[open_])
            possible = sums + slack >= theta[:, None]
            possible[np.nonzero(has)[0], own[open_][has]] = False
            few = possible.sum(axis=1) <= max(16 * k, n * FEW)
            done = few | (run == last)
            self.proved += int(few.sum()) if run < last else 0
            self.through += len(open_) if run == last else 0
            for i in np.nonzero(done)[0]:
                at = np.nonzero(possible[i])[0]
                exact = self._scores(at, queries[open_[i]])
                best = np.lexsort((self.ids[at], -exact))[:k]
                found.append((int(query_ids[open_[i]]), self.ids[at][best], exact[best]))
            open_, sums, seen = open_[~done], sums[~done], seen[~done]
            if not len(open_):
                break
        return found


def _search_blocks(k: int, batch_size: int):
    """Rows (block, kind, vec_id, vector) sorted by block with its candidates (kind 0) before the queries (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, rows, queries, index = None, [], [], None
        seen: dict[int, int] = {}  # the k-th best score of queries in the blocks of this task

        def answer() -> pa.RecordBatch:
            nonlocal index
            if index is None:
                index = ImpactIndex(np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows], dtype=np.int64).reshape(len(rows), -1))
                rows.clear()
            ids = np.array([q[0] for q in queries], dtype=np.int64)
            least = np.array([seen.get(q[0], -np.inf) for q in queries], dtype=np.float64)
            found = index.search(ids, np.array([q[1] for q in queries], dtype=np.int64).reshape(len(queries), -1), k, least)
            queries.clear()
            for q, best, scores in found:
                if len(best) == k and len(seen) < KNOWN:
                    seen[q] = max(seen.get(q, int(scores[-1])), int(scores[-1]))
            columns = [np.repeat([q for q, _, _ in found], [len(i) for _, i, _ in found]), np.concatenate([i for _, i, _ in found] or [[]]), np.concatenate([s for _, _, s in found] or [[]])]
            return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["query_id", "vec_id", "score"])

        for batch in batches:
            for key, kind, vec_id, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != block:
                    if queries and (rows or index):
                        yield answer()
                    block, index = key, None
                    rows.clear()
                    queries.clear()
                if kind == 0:
                    rows.append((vec_id, v))
                elif rows or index:
                    queries.append((vec_id, v))
                    if len(queries) == batch_size:
                        yield answer()
        if queries and (rows or index):
            yield answer()

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """The k best candidates (every row but the query's own) of each row that meets is_query, a condition on vec_id.

    Returns query_id, rank (from 1), vec_id, score.
    """
    held = vectors.select("vec_id", quantised(F.col("embedding")).alias("__rl_v")).where("vec_id is not null and __rl_v is not null")
    held = held.groupBy("vec_id").agg(F.min("__rl_v").alias("__rl_v")).withColumn("__rl_dim", F.size("__rl_v"))
    # as many blocks for each length of vectors as its rows need: a row for each length
    sizes = {r[0]: r[1] for r in held.groupBy("__rl_dim").count().collect()}
    blocks = {dim: max(1, math.ceil(n / max(1, BLOCK * 64 // max(dim, 64)))) for dim, n in sizes.items()}
    of_dim = F.lit(1)
    for dim, n in blocks.items():
        of_dim = F.when(F.col("__rl_dim") == dim, F.lit(n)).otherwise(of_dim)
    key = lambda b: F.struct("__rl_dim", b.alias("b"))
    rows = held.select(key(F.pmod(F.xxhash64("vec_id", F.lit("rows")), of_dim).cast("int")).alias("key"), F.lit(0).alias("kind"), "vec_id", "__rl_v")
    queries = held.where(is_query).withColumn("b", F.explode(F.sequence(F.lit(0), of_dim - 1)))
    queries = queries.select(key(F.col("b").cast("int")).alias("key"), F.lit(1).alias("kind"), "vec_id", "__rl_v")
    dealt = rows.unionByName(queries).repartition("key").sortWithinPartitions("key", "kind", "vec_id").select(F.xxhash64("key").alias("key"), "kind", "vec_id", "__rl_v")
    best = dealt.mapInArrow(_search_blocks(k, QUERY_BLOCK), RESULT)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
g AS (SELECT vec_id, min(v) AS v FROM v GROUP BY vec_id),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM g q JOIN g c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
