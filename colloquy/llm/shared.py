"""What the operators of this subpackage share on the Spark side."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest estimated size of a table that an operator broadcasts; beyond it the join shuffles.
BROADCAST_BYTES = 32 << 20


def work_dir(spark: SparkSession, label: str) -> str:
    """A new folder below spark.checkpoint.dir, which the driver and all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


#: Lets Spark drop the shuffle files of a write once it is done; nothing reads them again.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, path: str) -> DataFrame:
    """`df` written to `path` as Parquet and read again; this cuts the lineage, and its shuffle files go."""
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, label: str) -> DataFrame:
    """`df` in a new folder below the shared one (see `written`)."""
    return written(df, work_dir(df.sparkSession, label))


class Scratch:
    """Tables that one run of an operator stores and drops again, by name."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.base, self.bucketed = spark, work_dir(spark, label), []

    def store(self, df: DataFrame, name: str) -> DataFrame:
        return written(df, f"{self.base}/{name}")

    def buckets(self, df: DataFrame, column: str) -> DataFrame:
        """`df` as a table of the warehouse in buckets of `column`, so that what is joined by it comes to the table and not the table to it."""
        n, name = int(self.spark.conf.get("spark.sql.shuffle.partitions")), f"colloquy_{uuid.uuid4().hex}"
        self.bucketed.append(name)
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.repartition(n, column).write.bucketBy(n, column).saveAsTable(name)
        finally:
            self.spark.conf.set(CLEANUP, before)
        return self.spark.table(name)

    def drop(self, *names: str) -> None:
        """Deletes tables that no later step reads; without a name, all of them."""
        while not names and self.bucketed:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.bucketed.pop()}")
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in [f"{self.base}/{n}" for n in names] or [self.base]:
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(conf).delete(folder, True)


def small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """`df` with a broadcast hint if its known number of rows keeps it under BROADCAST_BYTES."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once a row, however often `body` uses it.

    A column bound by alias may be inlined into every place that uses it, also inside of
    lambdas; the argument of a lambda is evaluated before its body.
    """
    return F.transform(F.array(value), body)[0]


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of `column` over all rows, at least 1."""
    return df.agg(F.sum(F.octet_length(column).cast("long"))).first()[0] or 1


def table(name: str):
    """Reader of one of the given tables: `table("documents")(spark, sf_dir)`."""

    @functools.wraps(table)
    def read(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    return read
