"""Mixing sources to target weights by Poisson replication.

Every document gets a mean repetition rate, rate = weight share x output size / size of its source. A uniform
number from the MD5 of (seed, doc_id) is put through the inverse of the Poisson distribution with
that mean, the document is exploded by the count, and the copies are dealt out and sorted by a second hash, which
is a global shuffle. Only DataFrame functions run on this path.

Defined cases: a null source is a source of its own (`null_weight`); null and empty texts have size 1 so that their
source has a rate; a source without a positive weight is left out on purpose; rows with equal doc_id and source
get the same count; an empty table gives no rows; further columns are carried through untouched, unless they have a
name of the two added columns (`added`).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import cut, table, unit

#: Sources and numbers of their distributions (8 MB) up to which these are broadcast; beyond, they are joined by a shuffle.
BROADCAST_SOURCES, BROADCAST_STEPS = 20_000, 1 << 20
#: A higher mean rate is drawn as a sum of rates up to this one, if `any_rate`, and refused otherwise: the array of the
#: distribution has about as many elements.
MAX_RATE = 10_000.0


def poisson_cdf(rate: Column, steps: Column) -> Column:
    """P(N <= 0), P(N <= 1), ... P(N <= steps) for a Poisson variable, summed from logarithms: no underflow."""
    start = F.struct(F.lit(0.0).alias("log_p"), F.array().cast("array<double>").alias("cdf"), F.lit(0.0).alias("sum"))

    def step(s: Column, k: Column) -> Column:
        log_p = F.when(k == 0, -rate).otherwise(s["log_p"] + F.log(rate) - F.log(k.cast("double")))
        total = s["sum"] + F.exp(log_p)
        return F.struct(log_p.alias("log_p"), F.concat(s["cdf"], F.array(total)).alias("cdf"), total.alias("sum"))

    return F.aggregate(F.sequence(F.lit(0), steps), start, step, lambda s: s["cdf"])


def _from_to(counts: Column) -> Column:
    """An array of (first, n) for an array of counts n: first is the sum of those before."""
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<struct<first:bigint,n:bigint>>").alias("all"))

    def step(s: Column, n: Column) -> Column:
        return F.struct((s["sum"] + n).alias("sum"), F.concat(s["all"], F.array(F.struct(s["sum"].alias("first"), n.alias("n")))).alias("all"))

    return F.aggregate(counts, start, step, lambda s: s["all"])


def source_rates(docs: DataFrame, weights: dict[str, float], default_weight: float, null_weight: float, epochs: float) -> DataFrame:
    """One row for each source: __rl_key, __rl_rate (mean copies of each of its documents)."""
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    sizes = docs.groupBy(key.alias("__rl_key")).agg(F.sum(F.greatest(F.coalesce(F.length("text"), F.lit(0)), F.lit(1)).cast("bigint")).alias("__rl_size"))
    named = F.when(F.col("__rl_key") == "n", F.lit(float(null_weight)))
    for name, weight in sorted(weights.items()):
        named = named.when(F.col("__rl_key") == "s" + name, F.lit(float(weight)))
    sizes = sizes.withColumn("__rl_weight", named.otherwise(F.lit(float(default_weight))))
    sizes = cut(sizes)  # a row for each source
    weight, size = sizes.agg(F.sum("__rl_weight"), F.sum("__rl_size")).first()
    rate = F.col("__rl_weight") / F.lit(float(weight or 1)) * F.lit(float(size or 0) * float(epochs)) / F.col("__rl_size").cast("double")
    return sizes.where("__rl_weight > 0").select("__rl_key", rate.alias("__rl_rate"))


def mix_sources(docs: DataFrame, weights: dict[str, float], default_weight: float = 1.0, null_weight: float = 1.0, epochs: float = 1.0, seed: int = 42, any_rate: bool = False, added: tuple[str, str] = ("copy", "mix_key")) -> DataFrame:
    """docs replicated so that the characters of each source follow its weight, in a global random order.

    weights: a positive number for each named source, `default_weight` for others; epochs: expected size of the
    output as a multiple of the input; any_rate: a mean of more than MAX_RATE copies is drawn, not refused, as the sum of
    equal draws of at most MAX_RATE with a uniform number each, which has the same distribution. Returns the columns of
    docs with `copy` (from 0) and `mix_key` (the hash it is shuffled by; partitions are dealt and sorted by it), or as
    `added` names them. `copy` is a long where a source has a mean of 2 ** 30 or more.
    """
    spark = docs.sparkSession
    rates = source_rates(docs, weights, default_weight, null_weight, epochs)
    rates = rates.withColumn("__rl_draws", F.greatest(F.ceil(F.col("__rl_rate") / MAX_RATE), F.lit(1)).cast("long"))
    mean = F.col("__rl_rate") / F.col("__rl_draws")
    steps = F.ceil(mean + 14 * F.sqrt(mean) + 40).cast("int")  # beyond it P(N > n) is below 2 ** -52
    n, top, numbers = rates.agg(F.count("*"), F.max("__rl_rate"), F.sum(steps)).first()
    top = top or 0.0
    if top > MAX_RATE and not any_rate:
        raise ValueError(f"a source needs more than {MAX_RATE:g} copies of each document")
    small = n <= BROADCAST_SOURCES and (numbers or 0) <= BROADCAST_STEPS
    if small:
        rates = spark.createDataFrame([tuple(r) for r in rates.collect()], "__rl_key string, __rl_rate double, __rl_draws long")
    rates = rates.withColumn("__rl_cdf", poisson_cdf(mean, steps))
    rates = F.broadcast(rates) if small else rates
    held = docs.withColumn("__rl_key", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))).withColumn("__rl_u", unit(seed, "doc_id"))
    below = lambda u: F.size(F.filter("__rl_cdf", lambda c: c <= u))
    out = held.join(rates, "__rl_key")
    if top <= MAX_RATE:
        out = out.withColumn("__rl_n", below(F.col("__rl_u"))).where("__rl_n > 0").withColumn("__rl_copy", F.explode(F.sequence(F.lit(0), F.col("__rl_n") - 1)))
    else:  # a row for each draw, then one for each of its copies; its first number is the sum of the draws before
        further = lambda i: F.when(i == 0, F.col("__rl_u")).otherwise(unit(seed, "doc_id", F.lit("draw"), i))
        counts = F.transform(F.sequence(F.lit(0).cast("long"), F.col("__rl_draws") - 1), lambda i: below(further(i)).cast("long"))
        out = out.withColumn("__rl_draw", F.explode(_from_to(counts))).where("__rl_draw.n > 0")
        copy = F.explode(F.sequence(F.col("__rl_draw.first"), F.col("__rl_draw.first") + F.col("__rl_draw.n") - 1))
        out = out.withColumn("__rl_copy", copy)
        out = out.withColumn("__rl_copy", F.col("__rl_copy").cast("int")) if top < 1 << 30 else out
    key = F.md5(F.concat_ws(":", F.lit(f"order{seed}"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("__rl_copy").cast("string")).cast("binary"))
    out = out.select(*(F.col(c) for c in docs.columns if c not in added), F.col("__rl_copy").alias(added[0]), key.alias(added[1]))
    return out.repartition(added[1]).sortWithinPartitions(added[1])


#: Production mixture: the largest source is held down, curated ones are raised, all others have weight 1.
WEIGHTS = {"src0": 4.0, "src1": 2.0, "src2": 2.0, "src3": 0.5}


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mix_sources(docs.select("doc_id", "text", "lang", "source"), WEIGHTS, seed=42, any_rate=True)


SQL = """
WITH d AS (SELECT doc_id, text, lang, source, coalesce('s' || source, 'n') AS k FROM documents),
z AS (SELECT k, sum(greatest(coalesce(length(text), 0), 1))::BIGINT AS sz FROM d GROUP BY k),
w AS (SELECT k, sz, CASE k WHEN 'n' THEN 1.0::DOUBLE WHEN 'ssrc0' THEN 4.0::DOUBLE WHEN 'ssrc1' THEN 2.0::DOUBLE WHEN 'ssrc2' THEN 2.0::DOUBLE
        WHEN 'ssrc3' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS wt FROM z),
r AS (SELECT k, wt / (sum(wt) OVER ()) * ((sum(sz) OVER ())::DOUBLE * 1.0) / sz::DOUBLE AS rate FROM w),
s AS (SELECT k, rate, j, sum(CASE WHEN j = 0 THEN -rate ELSE ln(rate) - ln(j::DOUBLE) END) OVER (PARTITION BY k ORDER BY j) AS lp
      FROM r, (SELECT unnest(range(0, 400)) AS j)),
c AS (SELECT k, j, sum(exp(lp)) OVER (PARTITION BY k ORDER BY j) AS cdf FROM s),
l AS (SELECT k, list(cdf ORDER BY j) AS cdfs FROM c GROUP BY k),
u AS (SELECT d.*, ('0x' || substr(md5('42:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM d),
n AS (SELECT u.*, len(list_filter(l.cdfs, lambda x: x <= u.u)) AS n FROM u JOIN l ON u.k = l.k),
e AS (SELECT doc_id, text, lang, source, unnest(range(0, n))::INT AS copy FROM n WHERE n > 0)
SELECT doc_id, text, lang, source, copy, md5('order42:' || coalesce(doc_id::VARCHAR, 'null') || ':' || copy::VARCHAR) AS mix_key FROM e
"""
