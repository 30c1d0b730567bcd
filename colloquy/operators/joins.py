"""Joins of evaluation tables: completeness, resuming, leakage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_by(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_l")).select(*key, "_l.*")


def completed(items: DataFrame, responses: DataFrame, key: str, order: str, must: bool = False) -> DataFrame:
    """Items with their last response; extra responses drop out, and a missing one is marked, or fails the job if it `must` be there."""
    missing = F.col("_found").isNull()
    if must:
        missing = failing(missing, F.concat(F.lit("no response to "), F.coalesce(F.col(key).cast("string"), F.lit("a null key"))))
    return items.join(last_by(responses, [key], order).withColumn("_found", F.lit(True)), key, "left").withColumn("missing", missing).drop("_found")


def failing(bad: Column, said: Column) -> Column:
    """`bad` where it is false; where it holds the job ends with `said`. It stands in a column that is read, so nothing moves ahead of it or drops it."""
    return F.when(bad, F.raise_error(said).cast("boolean")).otherwise(F.lit(False))


def judged(manifest: DataFrame, outputs: DataFrame, valid: Column, key: str = "custom_id") -> DataFrame:
    """Manifest rows with a status: format_failure, judge_failure (no output, an error, or an invalid one) or scored."""
    joined = manifest.join(outputs.withColumn("_found", F.lit(True)), key, "left")
    ok = F.col("_found").isNotNull() & F.col("error").isNull() & (F.col("status_code") == 200) & valid
    return joined.withColumn("status", F.when(F.col("candidate_format_failure"), "format_failure").when(F.coalesce(ok, F.lit(False)), "scored").otherwise("judge_failure")).drop("_found")


def remaining(items: DataFrame, done: DataFrame, key: str, retry_errors: bool = True) -> DataFrame:
    """Items without a finished row; rows with an error count as unfinished if they are retried."""
    finished = done.where("error is null") if retry_errors and "error" in done.columns else done
    return items.join(finished.select(key).distinct(), key, "left_anti")


def frozen_scope(records: DataFrame, scopes: DataFrame, must: bool = False) -> DataFrame:
    """Records with the scope frozen for their source and reference; without one it is null, or the job fails if it `must` be there."""
    keyed = records.withColumn("reference_sha256", F.sha2("reference", 256))
    found = keyed.join(scopes.withColumn("_found", F.lit(True)), ["source_id", "reference_sha256"], "left")
    if must:
        said = F.concat_ws(" ", F.lit("no frozen scope for"), F.col("source_id").cast("string"), F.lit("and reference"), F.col("reference_sha256"))
        scope = F.when(failing(F.col("_found").isNull(), said), F.lit(None)).otherwise(F.col("scope"))
        found = found.withColumn("scope", scope)
    return found.drop("_found")


def leaked(df: DataFrame, split: str, identities: list[Column]) -> DataFrame:
    """Identities that stand in more than one split, with the splits."""
    rows = df.select(split, F.explode(F.array(*[i.cast("string") for i in identities])).alias("identity")).where("identity is not null").distinct()
    return rows.groupBy("identity").agg(F.array_sort(F.collect_set(split)).alias("splits")).where(F.size("splits") > 1)


def in_both(df: DataFrame, split: str, a: str, b: str, identity: Column) -> DataFrame:
    """Identities that split `a` shares with split `b`."""
    of = lambda s: df.where(F.col(split) == s).select(identity.alias("identity"))
    return of(a).intersect(of(b))


def incompatible(before: DataFrame, now: DataFrame, keys: list[str]) -> DataFrame:
    """Configuration keys whose value isn't what an earlier run had."""
    b, n = (x.where(F.col("key").isin(keys)).select("key", F.col("value").alias(name)) for x, name in ((before, "before"), (now, "now")))
    return b.join(n, "key", "full").where(~F.col("before").eqNullSafe(F.col("now")))
