"""Mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.shared import BROADCAST_BYTES, stored

WORD = r"[^\x20\x09-\x0D]+"
#: Copies of each source's row, and parts of each source's documents, where the sources are too many to broadcast.
SALTS = 32


def ranked(df: DataFrame, order: list[Column], rank: str) -> DataFrame:
    """`df` with its rows' 0-based place in `order`, without a task that holds all rows."""
    spread = stored(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranked")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spread.groupBy("_range").count().select("_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return spread.join(F.broadcast(offsets), "_range").withColumn(rank, F.col("_before") + place).drop("_range", "_before")


def fill(sources: DataFrame, goal: float) -> float:
    """The level at which the sum of least(cap, level * weight) over `sources` is `goal`.

    Each round reads one row of sums: what is capped at the level so far is taken off the goal
    and the rest is shared by weight, until no source is above its cap.
    """
    level = 0.0
    while True:
        full = F.col("_cap") <= F.lit(level) * F.col("_weight")
        capped, open_weight = sources.agg(F.sum(F.when(full, F.col("_cap")).otherwise(0.0)), F.sum(F.when(full, 0).otherwise(F.col("_weight")))).first()
        if not open_weight:
            return level
        raised = (goal - capped) / open_weight
        if raised <= level:
            return level
        level = raised


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """`docs` with size, source_size, target, rate and copies: how often the mix takes each document.

    size is the text's number of words `[^\\x20\\x09-\\x0D]+`. The sources, in the order of their
    code points with null last, get `weights`, repeating; by these they share `share` times all
    sizes, but none gets over `most` times its own size, and what is above is shared again. rate
    is target / source_size. A document is taken floor(rate) times, and once more if a number
    from a hash of `seed` and its id is below the fraction; so a rerun takes the same.

    Null text: size 0. Null source: a source of its own, last. A source without words: target
    and rate 0. A null id has one hash like any other. Rows with equal ids share their draw. An
    empty table gives an empty result. Columns of `docs` with a result's name are replaced;
    names that begin with `_` are reserved.
    """
    sized = docs.drop("size", "source_size", "target", "rate", "copies").withColumn("size", F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long"))
    by_source = sized.groupBy(F.col(source_col).alias("_source")).agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_place") % len(weights)).cast("int") + 1)
    sources = ranked(by_source, [F.col("_source").asc_nulls_last()], "_place")
    sources = stored(sources.select("_source", "source_size", weight.cast("double").alias("_weight"), (F.col("source_size") * F.lit(float(most))).alias("_cap")), "sources")
    count, total, chars = sources.agg(F.count(F.lit(1)), F.sum("source_size"), F.max(F.length("_source"))).first()
    level = fill(sources, share * (total or 0)) if count else 0.0
    sources = sources.select("_source", "source_size", F.least(F.col("_cap"), F.lit(level) * F.col("_weight")).alias("target"))
    match = F.col("_source").eqNullSafe(F.col(source_col))
    if count * (64 + 4 * (chars or 0)) <= BROADCAST_BYTES:
        joined = sized.join(F.broadcast(sources), match)
    else:
        parts = sources.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = sized.withColumn("_part", F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("int")).join(parts, match & (F.col("_salt") == F.col("_part"))).drop("_salt", "_part")
    rate = F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0))
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col(id_col).cast("string"))), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))
    copies = F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("long")
    return joined.drop("_source").withColumn("rate", rate).withColumn("copies", copies)


def emitted(mixed: DataFrame) -> DataFrame:
    """The rows of `mix_sources`, each as often as its copies say, with copy from 1."""
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
