"""Writers. Spark's committers make each write whole or absent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.operators.storage import stored


def json_documents(df: DataFrame, path: str, by: list[str]) -> None:
    df.write.partitionBy(*by).mode("overwrite").json(path)


def json_lines(df: DataFrame, path: str, compress: bool = False) -> None:
    df.write.mode("overwrite").option("compression", "gzip" if compress else "none").option("ignoreNullFields", "false").json(path)


def append_log(df: DataFrame, path: str) -> None:
    """Results appended to a log; a reader sees a batch whole or not at all."""
    df.write.mode("append").json(path)


def csv_table(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    df.select(*(columns or df.columns)).write.mode("overwrite").csv(path, header=True)


def parquet_with_manifest(df: DataFrame, path: str, split: str) -> DataFrame:
    """Writes each split as Parquet and returns (split, rows, files, sha256), the hash over the files' hashes in order."""
    spark = df.sparkSession
    df.write.mode("overwrite").partitionBy(split).parquet(path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path)
    hashed = files.select(F.regexp_extract("path", rf"{split}=([^/]+)", 1).alias(split), "path", F.sha2("content", 256).alias("h"))
    manifest = hashed.groupBy(split).agg(F.count(F.lit(1)).alias("files"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("sha256"))
    rows = spark.read.parquet(path).groupBy(F.col(split).cast("string").alias(split)).agg(F.count(F.lit(1)).alias("rows"))
    return rows.join(manifest, split)


def with_rejects(df: DataFrame, good, path: str, rejects: str) -> None:
    """Rows where `good` holds to `path`; the others to `rejects`, which is only written if there are any.

    The rows are stored with their verdict first, so that `df` is computed once.
    """
    rows = stored(df.withColumn("_good", F.coalesce(good, F.lit(False))), "verdicts")
    rows.where("_good").drop("_good").write.mode("overwrite").json(path)
    bad = rows.where("not _good").drop("_good")
    if not bad.isEmpty():
        bad.write.mode("overwrite").json(rejects)
