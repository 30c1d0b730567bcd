"""Operators on ordered rows: runs, neighbours, running numbers, greedy selection."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.text import rstrip, strip
from colloquy.operators.storage import stored


def runs(df: DataFrame, partition: list[str], order: list[str], same: str) -> DataFrame:
    """`df` with run: the number of the stretch of rows in a row with equal `same`, from 1 in each partition; nulls are alike."""
    w = Window.partitionBy(*partition).orderBy(*order)
    first = F.row_number().over(w) == 1
    change = (first | ~F.col(same).eqNullSafe(F.lag(same).over(w))).cast("int")
    return df.withColumn("_change", change).withColumn("run", F.sum("_change").over(w)).drop("_change")


def merged_runs(utterances: DataFrame, partition: list[str], text: str = "join") -> DataFrame:
    """Utterances of one speaker in a row (by pos) as one: start and id of the first, end of the last, text joined by a blank.

    Slide ids are kept once each in the order they come, nulls apart. `text="strip"` takes
    white space off between the joined texts, `join` leaves them as they are. Call it after any
    filter: a removed row can bring two runs together.
    """
    grouped = runs(utterances, partition, ["pos"], "speaker_id")
    cols = [F.col("pos"), F.col("utterance_id"), F.col("start_sec"), F.col("end_sec"), F.col("text")]
    if "slide_id" in utterances.columns:
        cols.append(F.col("slide_id"))
    rows = grouped.groupBy(*partition, "run").agg(F.first("speaker_id").alias("speaker_id"), F.array_sort(F.collect_list(F.struct(*cols))).alias("_r"))
    texts = F.col("_r.text")
    if text == "strip":
        joined = F.aggregate(F.slice(texts, F.lit(2), F.size(texts)), F.get(texts, F.lit(0)), lambda a, x: F.concat(rstrip(a), F.lit(" "), strip(x)))
    else:
        joined = F.array_join(texts, " ")
    out = rows.select(
        *partition, "run", "speaker_id", F.col("_r")[0]["utterance_id"].alias("utterance_id"), F.col("_r")[0]["start_sec"].alias("start_sec"), F.element_at("_r", -1)["end_sec"].alias("end_sec"), joined.alias("text"),
        *([F.array_distinct(F.filter(F.col("_r.slide_id"), lambda x: x.isNotNull())).alias("slide_ids")] if "slide_id" in utterances.columns else []),
    )
    return out


def previous_text(utterances: DataFrame, partition: list[str]) -> DataFrame:
    """`utterances` with the text before in the same case; look back before any filter, since skipped rows count."""
    return utterances.withColumn("previous", F.lag("text").over(Window.partitionBy(*partition).orderBy("pos")))


def until_next(df: DataFrame, partition: list[str], order: list[str], last: Column) -> DataFrame:
    """`df` with end_sec: the first column of `order` in the next row, and `last` for the last row; the other columns part ties."""
    return df.withColumn("end_sec", F.coalesce(F.lead(order[0]).over(Window.partitionBy(*partition).orderBy(*order)), last))


def turn_numbers(turns: DataFrame, partition: list[str]) -> DataFrame:
    """Turns with text, numbered from 1 by start (null is 0) and place; blank ones drop out and take no number."""
    kept = turns.where(strip(F.coalesce(F.col("text"), F.lit(""))) != "")
    return kept.withColumn("turn_no", F.row_number().over(Window.partitionBy(*partition).orderBy(F.coalesce("start_sec", F.lit(0.0)), "pos")))


def first_best(df: DataFrame, by: list[str], value: str, score: str, pos: str) -> DataFrame:
    """The `value` of most `score` of each group, the first of equals."""
    return df.groupBy(*by).agg(F.max_by(value, F.struct(F.col(score), -F.col(pos))).alias(value), F.max(score).alias(score))


def numbered(df: DataFrame, order: list[str], name: str, ranges: int | None = None) -> DataFrame:
    """`df` with its 0-based place in the global `order`, without a task that holds all rows.

    Rows are dealt by ranges of the order, numbered in each, and moved on by the rows of the
    ranges before, of which there are as many as partitions. The dealt rows are stored below
    `spark.checkpoint.dir`, since a range must hold the same rows both times, and not deleted.
    """
    dealt = df.repartitionByRange(ranges, *order) if ranges else df.repartitionByRange(*order)
    dealt = dealt.withColumn("_range", F.spark_partition_id())
    dealt = stored(dealt, "numbered")
    sizes = dealt.groupBy("_range").count().withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return dealt.join(F.broadcast(sizes.select("_range", "_before")), "_range").withColumn(name, (F.col("_before") + place).cast("long")).drop("_range", "_before")


def round_robin(df: DataFrame, order: list[str], ways: int = 4) -> DataFrame:
    return numbered(df, order, "_n").withColumn("worker", F.pmod("_n", F.lit(ways)).cast("int")).drop("_n")


def chunked(df: DataFrame, partition: list[str], order: list[str], size: int) -> DataFrame:
    return df.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy(*partition).orderBy(*order)) - 1) / size).cast("long"))


def kept_greedily(vectors: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows a scan keeps whose cosine to every row kept before is under `threshold`; zero rows have none."""
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = vectors / np.where(norms == 0, 1, norms)
    kept, chosen = np.zeros(len(unit), bool), np.empty_like(unit)
    n = 0
    for i, v in enumerate(unit):
        if n == 0 or (chosen[:n] @ v).max() < threshold:
            chosen[n], kept[i] = v, True
            n += 1
    return kept


_stored = functools.partial(stored, label="greedy")

#: Rows of a group that one task scans, or filters, at most.
SCAN_ROWS = 1024


def greedy_dedup(crops: DataFrame, partition: str, order: str, vector: str = "embedding", threshold: float = 0.92) -> DataFrame:
    """Rows that a scan of each group in `order` (nulls last) keeps: those unlike all kept before.

    The rows are numbered and cut into blocks. Each round scans the first rows left of every
    group, at most SCAN_ROWS, and then filters all later blocks side by side against the rows
    kept, so that no task holds a group. Rounds follow the rows kept over SCAN_ROWS. What is
    left after a round is stored below `spark.checkpoint.dir`, and is not deleted.
    """
    unit = lambda x: (v := np.array([list(y) for y in x], np.float64)) / np.where((n := np.linalg.norm(v, axis=1, keepdims=True)) == 0, 1, n)

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_n", kind="stable")
        return pdf[kept_greedily(np.array(pdf[vector].tolist(), np.float64), threshold)] if len(pdf) else pdf

    def unlike(rows: pd.DataFrame, kept: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(kept):
            return rows
        return rows[(unit(rows[vector]) @ unit(kept["_kept"].iloc[0]).T).max(axis=1) < threshold]

    numbers = numbered(crops, [F.col(partition), F.col(order).asc_nulls_last()], "_n")
    rest = _stored(numbers.withColumn("_block", F.floor(F.col("_n") / SCAN_ROWS)))
    found = []
    while not rest.isEmpty():
        w = Window.partitionBy("_g").orderBy("_b")
        sizes = rest.groupBy(F.col(partition).alias("_g"), F.col("_block").alias("_b")).count()
        sizes = sizes.withColumn("_now", (F.row_number().over(w) == 1) | (F.sum("count").over(w) <= SCAN_ROWS)).drop("count")
        dealt = rest.join(sizes, rest[partition].eqNullSafe(sizes["_g"]) & (rest["_block"] == sizes["_b"]))
        kept = _stored(dealt.where("_now").select(*rest.columns).groupBy(partition).applyInPandas(scan, rest.schema))
        found.append(kept.select(*crops.columns))
        vectors = kept.groupBy(F.col(partition).alias("_k")).agg(F.collect_list(vector).alias("_kept"))
        sent = sizes.where("not _now").join(vectors, F.col("_g").eqNullSafe(F.col("_k"))).select("_g", "_b", "_kept")
        later = dealt.where("not _now").select(*rest.columns)
        rest = _stored(later.groupBy(partition, "_block").cogroup(sent.groupBy("_g", "_b")).applyInPandas(unlike, rest.schema))
    return functools.reduce(DataFrame.unionByName, found) if found else crops.limit(0)


#: Words with inner apostrophes or hyphens, or single CJK characters (fixed pattern).
REPEAT_TOKEN = r"[A-Za-z0-9]+(?:['’-][A-Za-z0-9]+)?|[\u4e00-\u9fff]"


def tail_tokens(text: str, tail: int) -> list[str]:
    """The last `tail` tokens; of a long text only as much is read as holds them, from white space on, which no token spans."""
    size = 8 * tail
    while size < len(text):
        end = text[-size:]
        gap = re.search(r"\s", end)
        if gap and len(found := re.findall(REPEAT_TOKEN, end[gap.start() :])) >= tail:
            return found[-tail:]
        size *= 2
    return re.findall(REPEAT_TOKEN, text)[-tail:]


def _longest_block_runs(codes: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """For each text the most times in a row that a block of `width` tokens stands, blocks counted from its first token."""
    blocks = np.diff(first) // width
    longest = np.ones(len(blocks), np.int64)
    texts = np.repeat(np.arange(len(blocks)), blocks)
    if not len(texts):
        return longest
    within = np.arange(len(texts)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    at = first[texts] + within * width
    change = within == 0
    # a block continues a run if each of its tokens is the one `width` before
    same = np.zeros(len(codes) + 1, np.int64)
    same[width + 1 :] = codes[width:] == codes[:-width]
    same = np.cumsum(same)
    change |= same[at + width] - same[at] < width
    heads = np.flatnonzero(change)
    np.maximum.at(longest, texts[heads], np.diff(np.append(heads, len(texts))))
    return longest


def _commonest_grams(codes: np.ndarray, first: np.ndarray, gram: int) -> np.ndarray:
    """For each text how often its commonest run of `gram` tokens stands."""
    sizes = np.maximum(np.diff(first) - gram + 1, 0)
    most = np.zeros(len(sizes), np.int64)
    texts = np.repeat(np.arange(len(sizes)), sizes)
    if not len(texts):
        return most
    at = np.arange(len(texts)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + first[texts]
    # numbered anew after each token, so that a number stays below the tokens there are
    numbers = texts
    for k in range(gram):
        _, numbers = np.unique(numbers * len(codes) + codes[at + k], return_inverse=True)
    _, lead, counts = np.unique(numbers, return_index=True, return_counts=True)
    np.maximum.at(most, texts[lead], counts)
    return most


def repetitions(texts: Iterable[str | None], tail: int = 2048, widths: int = 8, gram: int = 4) -> pd.DataFrame:
    """(detected, longest_run of a block, top_count of the commonest gram, top_share of the tail it fills) in each text's last tokens."""
    tokens, sizes = [], []
    for text in texts:
        found = tail_tokens(text or "", tail)
        tokens += found
        sizes.append(len(found))
    # tokens hold ASCII letters and characters without case only, so lower case is the folded one
    codes = pc.utf8_lower(pa.array(tokens, pa.string())).dictionary_encode().indices.to_numpy().astype(np.int64)
    sizes = np.array(sizes, np.int64)
    first = np.append(0, np.cumsum(sizes))
    longest = np.ones(len(sizes), np.int64)
    for width in range(1, widths + 1):
        longest = np.maximum(longest, _longest_block_runs(codes, first, width))
    longest[sizes < 8] = 1
    top = _commonest_grams(codes, first, gram)
    share = np.minimum(1.0, gram * top / np.maximum(sizes, 1))
    return pd.DataFrame({"detected": (longest >= 8) | ((top >= 12) & (share >= 0.15)), "longest_run": longest.astype(np.int32), "top_count": top.astype(np.int32), "top_share": share})


#: Texts whose tokens are worked on together, at most 2,048 each.
TEXTS = 256


def with_repetition(df: DataFrame, text: str) -> DataFrame:
    """`df` with repetition, a struct of what `repetitions` finds in the text."""

    @F.pandas_udf("detected boolean, longest_run int, top_count int, top_share double")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [repetitions(batch.iloc[i : i + TEXTS]) for i in range(0, len(batch), TEXTS)]
            yield pd.concat(parts, ignore_index=True) if parts else repetitions([])

    return df.withColumn("repetition", found(text))


def marker_mask(tokens: Column, start: list[int], end: list[int], valid: Column, preceding: int = 0, fallback: int = 0) -> Column:
    """Mask of the span from the first `start` marker (and `preceding` tokens) to the `end` marker after it.

    Without an end the span goes to the last of `valid` tokens; without a start it is the last
    `fallback` ones.
    """
    at = lambda marker, low: F.get(F.filter(F.sequence(F.lit(1), F.greatest(valid - len(marker) + 1, F.lit(1))), lambda i: (i > low) & (F.slice(tokens, i, len(marker)) == F.array(*map(F.lit, marker)))), F.lit(0))
    first = at(start, F.lit(0))
    last = F.coalesce(at(end, first + len(start) - 1) + len(end) - 1, valid)
    low = F.coalesce(first - preceding, valid - fallback + 1)
    return F.when(F.size(tokens) == 0, F.array().cast("array<boolean>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(tokens)), lambda i: (i >= low) & (i <= F.when(first.isNull(), valid).otherwise(last))))


