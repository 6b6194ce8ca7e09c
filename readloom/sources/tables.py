"""Tables by name, and a folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path below spark.checkpoint.dir; where that is unset and Spark is local (tests), below a new local folder."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='readloom')}"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(where)
    return f"{where.rstrip('/')}/readloom-{what}-{uuid.uuid4().hex}"


#: Spark's setting to remove the shuffle files of a query when it has ended.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaned(spark: SparkSession):
    """What is written inside leaves no shuffle files: they would stay until the driver's memory is collected."""
    before = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEAN) if before is None else spark.conf.set(CLEAN, before)


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint; the shuffle files that led to it are removed."""
    scratch(df.sparkSession, "cut")
    with cleaned(df.sparkSession):
        own = df.select("*")  # a plan of its own: df's may be run again
        return own.checkpoint(eager=True)


def written(df: DataFrame, what: str) -> DataFrame:
    """df from a compressed table in the shared folder; the shuffle files that led to it are removed. forget() removes the table."""
    path = scratch(df.sparkSession, what)
    with cleaned(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._readloom_path = path
    return out


def forget(*held: DataFrame) -> None:
    """Removes tables of written() that nothing reads any more."""
    for df in held:
        spark, path = df.sparkSession, df._readloom_path
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def numbered(df: DataFrame, *order, name: str = "number") -> DataFrame:
    """df with the 0-based place of each row in a total order.

    Rows are dealt by ranges and sorted, so no task sees them all; what goes before a range is a sum over the ranges'
    sizes, one row each.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged = cut(ranged.withColumn("__part", F.spark_partition_id()).withColumn("__mid", F.monotonically_increasing_id()))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("n"), F.min("__mid").alias("__first")).withColumn("__before", before).drop("n")
    return ranged.join(F.broadcast(sizes), "__part").withColumn(name, F.col("__before") + F.col("__mid") - F.col("__first")).drop("__part", "__mid", "__first", "__before")
