"""Read sets derived from the tables: a sampled genome (synth) and the letters of the documents (docs)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.sources.tables import table

LENGTH = 37
#: Read ids of a document: a text, of 2 ** 31 letters at most, has fewer windows.
STRIDE = 1 << 26


def genome_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ci, b: 32 letters for each part, in key order (keys are dense from 0)."""
    digest = F.md5(F.col("p_partkey").cast("string").cast("binary"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("ci"), F.translate(digest, "0123456789abcdef", "ACGTACGTACGTACGT").alias("b"))


def reads_synth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read_id, seq: a window of 37 letters for each order; some are copies, some have an N or a substitution."""
    chunks = genome_chunks(spark, sf_dir)
    size = chunks.agg((F.count("*") * 32).alias("g"))
    # a window lies in three neighbouring chunks at most; every chunk goes to the places where it is needed
    spread = chunks.select("b", F.explode(F.array(*[F.struct((F.col("ci") - i).alias("ci"), F.lit(i).alias("i")) for i in range(3)])).alias("x")).select("x.ci", "x.i", "b")
    piece = lambda i: F.coalesce(F.max(F.when(F.col("i") == i, F.col("b"))), F.lit(""))
    triples = spread.groupBy("ci").agg(F.concat(piece(0), piece(1), piece(2)).alias("tri"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("read_id"), F.col("o_custkey").cast("long").alias("c")).join(F.broadcast(size))
    pos = F.when(F.col("read_id") % 10 == 9, (F.col("c") * 7919) % (F.col("g") - 36)).otherwise((F.col("read_id") * 104729) % (F.col("g") - 36))
    # the chunks grow with the input and are taken for smaller than they are: without the hint all of them are broadcast
    placed = orders.select("read_id", pos.alias("pos"), F.floor(pos / 32).alias("ci")).join(triples.hint("merge"), "ci")
    s = placed.select("read_id", F.expr("substring(tri, cast(pos % 32 AS INT) + 1, 37)").alias("s0"), (F.col("read_id") % 37).cast("int").alias("p"))
    swapped = lambda mid: F.concat(F.expr("substring(s0, 1, p)"), mid, F.expr("substring(s0, p + 2)"))
    other = F.translate(F.expr("substring(s0, p + 1, 1)"), "ACGT", "CGTA")
    seq = F.when(F.col("read_id") % 30 == 29, swapped(F.lit("N"))).when(F.col("read_id") % 20 == 19, swapped(other)).otherwise(F.col("s0"))
    return s.select("read_id", seq.alias("seq"))


def reads_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read_id, seq: the letters ACGTN of each whole text, in windows of 37 side by side; the last window ends with the text."""
    letters = F.upper(F.regexp_replace("text", "[^ACGTNacgtn]", ""))
    held = table(spark, sf_dir, "documents").select("doc_id", letters.alias("b")).where(F.length("b") >= LENGTH)
    last = F.ceil(F.length("b") / LENGTH) - 1
    rows = held.select("doc_id", "b", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("i"))
    start = F.least(F.col("i") * LENGTH, F.length("b") - LENGTH)
    return rows.select((F.col("doc_id") * STRIDE + F.col("i")).alias("read_id"), F.substring("b", (start + 1).cast("int"), F.lit(LENGTH)).alias("seq"))


#: The synthetic reads in SQL; their names end with AS reads(read_id, seq).
SYNTH_SQL = """c AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS ci,
  translate(md5(CAST(p_partkey AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT') AS b FROM part),
t AS (SELECT ci, concat(b, lead(b, 1, '') OVER (ORDER BY ci), lead(b, 2, '') OVER (ORDER BY ci)) AS tri FROM c),
n AS (SELECT count(*) * 32 AS g FROM part),
p AS (SELECT o_orderkey AS read_id, CASE WHEN o_orderkey % 10 = 9 THEN (o_custkey * 7919) % (g - 36) ELSE (o_orderkey * 104729) % (g - 36) END AS pos
  FROM orders CROSS JOIN n),
r AS (SELECT read_id, substr(tri, CAST(pos % 32 AS INT) + 1, 37) AS s0 FROM p JOIN t ON t.ci = CAST(floor(pos / 32) AS BIGINT)),
reads AS MATERIALIZED (SELECT CAST(read_id AS BIGINT) AS read_id,
  CASE WHEN read_id % 30 = 29 THEN concat(substr(s0, 1, CAST(read_id % 37 AS INT)), 'N', substr(s0, CAST(read_id % 37 AS INT) + 2))
       WHEN read_id % 20 = 19 THEN concat(substr(s0, 1, CAST(read_id % 37 AS INT)), translate(substr(s0, CAST(read_id % 37 AS INT) + 1, 1), 'ACGT', 'CGTA'), substr(s0, CAST(read_id % 37 AS INT) + 2))
       ELSE s0 END AS seq FROM r)"""

DOCS_SQL = """d AS (SELECT doc_id, upper(regexp_replace(text, '[^ACGTNacgtn]', '', 'g')) AS b FROM documents),
w AS (SELECT doc_id, b, unnest(range(0, CAST(ceil(length(b) / 37.0) AS BIGINT))) AS i FROM d WHERE length(b) >= 37),
reads AS MATERIALIZED (SELECT CAST(doc_id * 67108864 + i AS BIGINT) AS read_id, substr(b, CAST(least(i * 37, length(b) - 37) + 1 AS BIGINT), 37) AS seq FROM w)"""
