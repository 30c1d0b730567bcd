"""Grouped summaries of speakers, judges' scores and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.text import strip
from colloquy.operators.storage import stored


def speaker_profiles(utterances: DataFrame, key: str = "recording") -> DataFrame:
    """One row a speaker: ids and stripped text in order of start, count, total time, first start and the end of the last to start."""
    row = F.struct("start_sec", "pos", "utterance_id", "end_sec", strip(F.coalesce("text", F.lit(""))).alias("text"))
    rows = utterances.groupBy(key, "speaker_id").agg(F.array_sort(F.collect_list(row)).alias("_r"), F.sum(F.col("end_sec") - F.col("start_sec")).alias("_total"))
    return rows.select(
        key, "speaker_id", F.col("_r.utterance_id").alias("utterance_ids"), F.array_join(F.filter("_r.text", lambda x: x != ""), " ").alias("full_text"),
        F.size("_r").alias("utterance_count"), F.round("_total", 3).alias("total_duration_sec"), F.col("_r")[0]["start_sec"].alias("first_start_sec"), F.element_at("_r", -1)["end_sec"].alias("last_end_sec"),
    )


def mean_with_floor(score: str = "score", status: str = "status", floor: float = 1.0) -> Column:
    """Mean over scored rows, with format failures at the floor; judge failures don't count, null if nothing does."""
    return F.avg(F.when(F.col(status) == "format_failure", F.lit(float(floor))).when(F.col(status) == "scored", F.col(score).cast("double")))


def rate(flag: str, status: str = "status") -> Column:
    return F.avg(F.when(F.col(status) == "scored", F.col(flag).cast("double")))


def status_counts(status: str = "status") -> list[Column]:
    is_ = lambda s: F.count_if(F.col(status) == s)
    return [F.count(F.lit(1)).alias("items"), is_("scored").alias("scored"), is_("format_failure").alias("format_failures"), is_("judge_failure").alias("judge_failures")]


def judge_summary(rows: DataFrame, model: str = "model_key") -> DataFrame:
    """Counts, floored mean and flag rates of each model."""
    return rows.groupBy(model).agg(*status_counts(), mean_with_floor().alias("clinical_equivalence"), rate("critical_error").alias("critical_error_rate"), rate("unsupported_claim").alias("unsupported_claim_rate"))


def summary_by_type(rows: DataFrame, model: str = "model_key", kind: str = "qa_type") -> DataFrame:
    """Of scored rows only, without a floor: count, mean and rates of each model and question type."""
    scored = rows.where("status = 'scored'")
    return scored.groupBy(model, F.coalesce(F.col(kind).cast("string"), F.lit("None")).alias(kind)).agg(
        F.count(F.lit(1)).alias("count"), F.avg(F.col("score").cast("double")).alias("clinical_equivalence"), F.avg(F.col("critical_error").cast("double")).alias("critical_error_rate"), F.avg(F.col("unsupported_claim").cast("double")).alias("unsupported_claim_rate")
    )


def decision_means(rows: DataFrame, dimensions: list[str], model: str = "model_key") -> DataFrame:
    """Mean and number of scores of 0 or more in each dimension; failures aren't floored here."""
    scored = rows.where("status = 'scored'")
    aggs = [a for d in dimensions for a in (F.avg(F.when(F.col(d) >= 0, F.col(d).cast("double"))).alias(f"{d}_mean"), F.count(F.when(F.col(d) >= 0, 1)).alias(f"{d}_cases"))]
    return scored.groupBy(model).agg(*aggs)


def metric_mean(metric: str, board: Column) -> Column:
    """Mean in which a missing text counts 0 for board rows and drops out for turn rows."""
    return F.avg(F.when(board, F.coalesce(F.col(metric), F.lit(0.0))).otherwise(F.col(metric)))


def floor_rank(values: Column, fraction: float) -> Column:
    """The sorted value at place floor((n - 1) * fraction), from 0; null for no values."""
    ordered = F.array_sort(F.collect_list(values))
    return F.get(ordered, F.floor((F.size(ordered) - 1) * F.lit(fraction)).cast("int"))


def latency_stats(df: DataFrame, by: str, value: str) -> DataFrame:
    """Count, mean, median, `floor_rank` at 0.95 and maximum of each group, nulls apart; groups of any size, none is collected."""
    v = F.col(value)
    plain = df.groupBy(by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.max(v).alias("max"))
    last = F.col("_n") - 1
    ranks = placed_values(df, by, value, {"_low": F.floor(last / 2), "_high": F.ceil(last / 2), "p95": F.floor(last * F.lit(0.95))})
    median = (F.col("_low").cast("double") + F.col("_high").cast("double")) / 2
    joined = plain.join(ranks.withColumnRenamed(by, "_by"), F.col(by).eqNullSafe(F.col("_by")), "left")
    return joined.select(by, "n", "mean", median.alias("median"), "p95", "max")


def placed_values(df: DataFrame, by: str, value: str, places: dict[str, Column]) -> DataFrame:
    """Of each group, the values at the 0-based `places` of its sorted values, which may use `_n`, their number; nulls don't count.

    Values are counted and the counts dealt by ranges of (group, value). Sums of the ranges say
    in which of them a place lies, and only these are summed up in order, each by itself. The
    dealt counts are stored below `spark.checkpoint.dir`, and not deleted.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(by).alias("_by"), F.col(value).alias("_value")).agg(F.count(F.lit(1)).alias("_c"))
    dealt = counts.repartitionByRange("_by", "_value").withColumn("_range", F.spark_partition_id())
    dealt = stored(dealt, "placed")
    group = Window.partitionBy("_by")
    sums = dealt.groupBy("_by", "_range").agg(F.sum("_c").alias("_sum"))
    sums = sums.withColumn("_n", F.sum("_sum").over(group)).withColumn("_to", F.sum("_sum").over(group.orderBy("_range")))
    sums = sums.select(F.col("_by").alias("_g"), F.col("_range").alias("_r"), (F.col("_to") - F.col("_sum")).alias("_from"), "_to", *(p.alias(f"_at_{k}") for k, p in places.items()))
    asked = sums.where(" OR ".join(f"`_at_{k}` >= _from AND `_at_{k}` < _to" for k in places))
    rows = dealt.join(asked, F.col("_by").eqNullSafe(F.col("_g")) & (F.col("_range") == F.col("_r")))
    rows = rows.withColumn("_upto", F.col("_from") + F.sum("_c").over(Window.partitionBy("_by", "_range").orderBy("_value")))
    inside = lambda k: (F.col(f"_at_{k}") < F.col("_upto")) & (F.col(f"_at_{k}") >= F.col("_upto") - F.col("_c"))
    return rows.groupBy(F.col("_by").alias(by)).agg(*(F.max(F.when(inside(k), F.col("_value"))).alias(k) for k in places))


def floor_rank_distributed(df: DataFrame, by: str, value: str, fraction: float) -> DataFrame:
    """As `floor_rank`, for groups too large to collect: values are counted, and the counts summed up in order."""
    counts = df.where(F.col(value).isNotNull()).groupBy(by, value).count()
    upto = F.sum("count").over(Window.partitionBy(by).orderBy(value))
    total = F.sum("count").over(Window.partitionBy(by))
    placed = counts.withColumn("_upto", upto).withColumn("_at", F.floor((total - 1) * F.lit(fraction)))
    return placed.where(F.col("_upto") > F.col("_at")).groupBy(by).agg(F.min(value).alias("percentile"))


def token_usage(rows: DataFrame, by: str) -> DataFrame:
    """Number and token sums of successful rows; a null count is 0."""
    ok = F.col("error").isNull()
    sums = [F.sum(F.when(ok, F.coalesce(F.col(c), F.lit(0))).otherwise(0)).alias(c) for c in ("prompt_tokens", "completion_tokens")]
    return rows.groupBy(by).agg(F.count_if(ok).alias("successes"), *sums)


def finish_reasons(rows: DataFrame, by: str) -> DataFrame:
    """Successful rows by finish reason; a missing reason is one of its own, null."""
    return rows.where("error is null").groupBy(by, "finish_reason").agg(F.count(F.lit(1)).alias("n"))


def drop_counters(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Total, kept and dropped pairs by case, by recording and over all, and the drops by reason."""
    sets = [[*keys[:i], "drop_reason"] for i in range(len(keys) + 1)]
    reasons = pairs.where("drop_reason is not null").groupingSets(sets, *keys, "drop_reason").count()
    levels = pairs.rollup(*keys).agg(F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("total"), F.count_if(F.col("drop_reason").isNull()).alias("kept"), F.count("drop_reason").alias("dropped"))
    by_reason = reasons.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("drop_reason", "count"))).alias("_m"))
    match = [levels[k].eqNullSafe(by_reason[k]) for k in keys]
    joined = levels.join(by_reason, match, "left")
    return joined.select(*[levels[k] for k in keys], "total", "kept", "dropped", F.array_join(F.transform(F.coalesce("_m", F.array().cast("array<struct<drop_reason:string,count:bigint>>")), lambda x: F.concat_ws("=", x["drop_reason"], x["count"])), ",").alias("dropped_by_reason"))


def assembled(turns: DataFrame, by: list[str], order: list[str], speaker: str, text: str, skip_blank: bool = True) -> DataFrame:
    """`[speaker] text` lines of each group in order; blank texts drop out unless kept."""
    kept = turns.where(strip(F.coalesce(F.col(text), F.lit(""))) != "") if skip_blank else turns
    line = F.concat(F.lit("["), F.col(speaker), F.lit("] "), strip(F.coalesce(F.col(text), F.lit(""))))
    rows = kept.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*order, line.alias("line")))).alias("_l"))
    return rows.select(*by, F.size("_l").alias("n_turns"), F.array_join("_l.line", "\n").alias("transcript"))


def with_aliases(pairs: DataFrame, key: list[str], pos: str, kind: str, source: list[str]) -> DataFrame:
    """Repeated pairs of a key as one: the first row, every source in order, and the kinds as a sorted set."""
    first = F.min_by(F.struct(*[c for c in pairs.columns if c not in key]), pos)
    rows = pairs.groupBy(*key).agg(first.alias("_f"), F.array_sort(F.collect_list(F.struct(pos, *source, kind))).alias("source_aliases"), F.array_sort(F.collect_set(kind)).alias(f"{kind}_candidates"))
    return rows.select(*key, "_f.*", "source_aliases", f"{kind}_candidates")


def group_advantage(rows: DataFrame, by: str, value: str) -> DataFrame:
    """`rows` with advantage: the value less its group's mean; joined back, so one large group is no window."""
    means = rows.groupBy(by).agg(F.avg(value).alias("_mean"))
    return rows.join(means, by).withColumn("advantage", F.col(value) - F.col("_mean")).drop("_mean")


def mask_diagnostics(rows: DataFrame) -> DataFrame:
    """Rates of found starts and ends and of fallbacks, and selected over response tokens; denominators of 1 at least."""
    return rows.agg(F.avg(F.col("start_found").cast("double")).alias("start_rate"), F.avg(F.col("end_found").cast("double")).alias("end_rate"), F.avg(F.col("fallback").cast("double")).alias("fallback_rate"), (F.sum("selected") / F.greatest(F.sum("response"), F.lit(1))).alias("selected_share"))


def union_box(boxes: DataFrame, by: list[str], width: Column, height: Column) -> DataFrame:
    """Box around all boxes (x, y, w, h) of a group, clamped to the frame."""
    grouped = boxes.groupBy(*by).agg(F.min("x").alias("x1"), F.min("y").alias("y1"), F.max(F.col("x") + F.col("w")).alias("x2"), F.max(F.col("y") + F.col("h")).alias("y2"))
    return grouped.select(*by, F.greatest("x1", F.lit(0)).alias("x1"), F.greatest("y1", F.lit(0)).alias("y1"), F.least("x2", width).alias("x2"), F.least("y2", height).alias("y2"))


def distinct_slides(rows: DataFrame, by: str, pos: str, ids: str) -> DataFrame:
    """Slide ids of a group once each, in the order they first come."""
    ordered = F.array_sort(F.collect_list(F.struct(pos, ids)))
    return rows.groupBy(by).agg(F.array_distinct(F.flatten(F.transform(ordered, lambda x: x[ids]))).alias("slide_ids"))
