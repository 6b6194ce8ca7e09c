"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, exact reranking.

A rotation is learned on a bounded sample (`SAMPLE` rows by hash): principal directions first, then the alternation
of sign codes and the orthogonal matrix that fits them best, so that the bits are balanced. Every vector gets a
64-bit code. Codes are cut into m substrings; with m = 4, two codes that differ in at most 7 bits have a substring
that differs in at most one (pigeonhole), so one side looks up its substrings and their one-bit changes, the other
side is stored. Candidates with equal labels are reranked with the original vectors in double precision, so no pair
below the threshold is linked. Pairs beyond the radius are found when a substring still agrees; recall against brute
force is measured in the tests (0.99 and more on near-duplicate groups).

Equal vectors of a label collapse first and are counted by weight, so a hot vector makes no pairs. No bucket is
capped; hot buckets are joined by sort-merge joins that Spark can split.

Defined cases: vectors that are null, empty, zero, or hold null, NaN or infinite components, and rows with null label
or null vec_id, link with nothing; vectors of different lengths are never linked; rows that repeat count as others of
each other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import cut, table, unit
from readloom.llm.components import components

#: Rows that the rotation is learned on, about.
SAMPLE = 20_000
TABLES, WIDTH = 4, 16
BITS = TABLES * WIDTH


def learn_rotation(x: np.ndarray, steps: int = 50, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection to 64 columns) whose signs are balanced binary codes of unit vectors.

    With fewer than 64 dimensions the vectors are first lifted by a random matrix; with 64 rows or fewer nothing is
    learned from them and the projection is a random one.
    """
    rng = np.random.default_rng(seed)
    dim = x.shape[1]
    learned = len(x) > BITS
    mean = x.mean(axis=0) if learned else np.zeros(dim)
    centred = x - mean
    if dim >= BITS and learned:
        _, _, directions = np.linalg.svd(centred.T @ centred)
        base = directions[:BITS].T
    else:
        base = rng.normal(size=(dim, BITS))
    v = centred @ base
    rotation = np.linalg.qr(rng.normal(size=(BITS, BITS)))[0]
    for _ in range(steps if learned else 0):
        codes = np.where(v @ rotation >= 0, 1.0, -1.0)
        u, _, wt = np.linalg.svd(codes.T @ v)
        rotation = (u @ wt).T
    return mean, base @ rotation


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label and __rl_v (doubles, null where the vector can't be linked) of every row."""
    v = F.transform("embedding", lambda e: e.cast("double"))
    bad = F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) | ~F.exists(v, lambda e: e != 0)
    good = F.col("embedding").isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull() & ~F.coalesce(bad, F.lit(True))
    most = F.array_max(F.transform(v, F.abs))
    safe = F.when((most > 1e140) | (most < 1e-140), F.transform(v, lambda e: e / most)).otherwise(v)  # no overflow in squares
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), F.when(good, safe).alias("__rl_v"))


def _unit_rows(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit(rows: DataFrame, sample: int = SAMPLE) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """A rotation for each length of vectors in a sample of about `sample` rows, chosen by the hash of vec_id."""
    n = rows.count()
    chosen = rows.where(unit(7, "vec_id") < float(sample) / max(n, 1)).select("__rl_v").toPandas()["__rl_v"]
    by_length: dict[int, list] = {}
    for v in chosen:
        by_length.setdefault(len(v), []).append(v)
    return {d: learn_rotation(_unit_rows(np.array(x, dtype=np.float64))) for d, x in by_length.items()}


def _codes(models: dict[int, tuple[np.ndarray, np.ndarray]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = dict(models)
        for batch in batches:
            vectors, codes = batch.column("__rl_v"), np.zeros(batch.num_rows, dtype=np.int64)
            lengths = np.diff(vectors.offsets.to_numpy())
            flat, starts = vectors.values.to_numpy(zero_copy_only=False), vectors.offsets.to_numpy()[:-1]
            for d in np.unique(lengths):
                at = np.nonzero(lengths == d)[0]
                x = _unit_rows(flat[starts[at][:, None] + np.arange(d)])
                if d not in known:  # a length that the sample didn't hold
                    known[d] = learn_rotation(np.zeros((0, d)))
                mean, projection = known[d]
                codes[at] = np.packbits((x - mean) @ projection >= 0, axis=1, bitorder="little").view("<i8")[:, 0]
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(codes)], ["rep", "code"])

    return run


def _key(label_hash: Column, i: Column, part: Column) -> Column:
    return F.xxhash64(label_hash, i, part)


def candidates(codes: DataFrame, radius: int = 12) -> DataFrame:
    """Pairs (a, b), each once, of equal labels whose codes share a substring up to one bit and differ in at most radius bits."""
    part = lambda code, i: F.shiftrightunsigned(code, i * WIDTH).bitwiseAND(F.lit((1 << WIDTH) - 1).cast("long"))
    spread = codes.select("rep", "code", "label", "dim", F.explode(F.sequence(F.lit(0), F.lit(TABLES - 1))).alias("t"))
    cut_out = F.expr(f"shiftrightunsigned(code, t * {WIDTH}) & {(1 << WIDTH) - 1}L")
    stored = spread.select(F.col("rep").alias("b"), F.col("code").alias("code_b"), F.col("label").alias("label_b"), F.struct("label", "dim", "t", cut_out.alias("part")).alias("key"))
    flips = spread.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(WIDTH))))
    changed = cut_out.bitwiseXOR(F.expr("CASE WHEN n = 0 THEN 0L ELSE shiftleft(1L, n - 1) END"))
    probes = flips.select(F.col("rep").alias("a"), F.col("code").alias("code_a"), F.struct("label", "dim", "t", changed.alias("part")).alias("key"))
    x = F.col("code_a").bitwiseXOR(F.col("code_b"))
    first = F.lit(True)  # of several tables that find a pair only the first counts
    for i in range(TABLES - 1):
        first = first & ((F.col("key.t") <= i) | (F.bit_count(part(x, i)) > 1))
    s, p = stored.select("b", "code_b", F.col("key").alias("key_b")), probes
    return p.join(s, F.col("key") == F.col("key_b")).where((F.col("a") < F.col("b")) & (F.bit_count(x) <= radius) & first).select("a", "b")


def _similar(threshold: float):
    """Keeps the pairs whose cosine, in double precision, reaches the threshold; norms are those of the whole vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            va, vb = batch.column("va"), batch.column("vb")
            starts = va.offsets.to_numpy()
            products = va.flatten().to_numpy(zero_copy_only=False) * vb.flatten().to_numpy(zero_copy_only=False)
            dots = np.add.reduceat(products, starts[:-1] - starts[0]) if len(products) else np.zeros(0)  # no vector is empty
            near = dots / batch.column("na").to_numpy() / batch.column("nb").to_numpy() >= threshold
            yield pa.RecordBatch.from_arrays([pa.array(batch.column(c).to_numpy()[near]) for c in ("a", "b", "wa", "wb")], ["a", "b", "wa", "wb"])

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, radius: int = 12, sample: int = SAMPLE) -> DataFrame:
    """vec_id, n_links, component_id and kept (vec_id = component_id) of every row."""
    rows = usable(vectors)
    # equal vectors of a label are one: rep is any unique number for them
    good = rows.where("__rl_v is not null")
    groups = good.groupBy("label", "__rl_v").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"))
    norm = F.sqrt(F.aggregate("__rl_v", F.lit(0.0), lambda s, x: s + x * x))
    groups = cut(groups.withColumn("norm", norm).withColumn("rep", F.monotonically_increasing_id()))
    models = fit(groups.select(F.col("least").alias("vec_id"), "__rl_v"), sample)
    coded = groups.select("rep", "__rl_v").mapInArrow(_codes(models), "rep long, code long")
    codes = coded.join(groups.select("rep", "label", F.size("__rl_v").alias("dim")), "rep")
    v = groups.select("rep", "__rl_v", "weight", "norm")
    left, right = v.toDF("a", "va", "wa", "na"), v.toDF("b", "vb", "wb", "nb")
    pairs = candidates(cut(codes), radius).join(left, "a").join(right, "b").select("a", "b", "wa", "wb", "na", "nb", "va", "vb")
    linked = cut(pairs.mapInArrow(_similar(threshold), "a long, b long, wa long, wb long"))
    others = linked.select(F.col("a").alias("rep"), F.col("wb").alias("w")).unionByName(linked.select(F.col("b").alias("rep"), F.col("wa").alias("w")))
    counts = others.groupBy("rep").agg(F.sum("w").alias("others"))
    roots = components(linked.select("a", "b")).withColumnRenamed("node", "rep")
    named = groups.join(roots, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    done = named.join(least, "root").join(counts, "rep", "left").select(
        F.col("label").alias("__rl_label"), F.col("__rl_v").alias("__rl_w"), "component_id", (F.coalesce("others", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    joined = good.join(done, (F.col("label") == F.col("__rl_label")) & (F.col("__rl_v") == F.col("__rl_w"))).select("vec_id", "n_links", "component_id")
    alone = rows.where("__rl_v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = joined.unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND vec_id IS NOT NULL),
n AS (SELECT vec_id, label, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM v),
g AS (SELECT vec_id, label, v, n FROM n WHERE n > 0 AND isfinite(n)),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
      WHERE list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) / a.n / b.n >= 0.98),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
k AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT e.vec_id, coalesce(k.n_links, 0)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON c.a = e.vec_id LEFT JOIN k ON k.a = e.vec_id
"""
