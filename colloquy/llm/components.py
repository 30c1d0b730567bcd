"""Connected components of a graph held as a DataFrame of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.shared import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star round on edges (u, v) with v < u; the large one looks at both ends, the small one from the upper end."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    around = both.join(least, "u")
    if large:
        linked = around.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        linked = around.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return linked.where("v < u").distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, u: str, v: str) -> DataFrame:
    """Stored rows (node, root) for each node of `edges`, root the least node of its component.

    Alternating large-star and small-star rounds; each is stored, so lineage stays short and a
    lost executor costs one round. The driver reads a count and a checksum a round.
    """
    edges = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("v < u").distinct()
    edges = stored(edges, "edges")
    mark = _mark(edges)
    while mark[0]:
        edges = stored(_star(_star(edges, True), False), "edges")
        if (now := _mark(edges)) == mark:
            break
        mark = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return stored(edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots), "components")
