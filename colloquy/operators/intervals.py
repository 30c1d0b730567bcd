"""Joins of timed utterances with slides and cases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How many mean lengths of a recording's intervals one stretch lasts: on average an interval goes to 1.25 stretches at most.
SPAN = 4.0


def _stretches(key: str, least: float, *sides: DataFrame) -> DataFrame:
    """(key, _w): seconds of a stretch, for each recording of the sides' intervals (start_sec, end_sec); never under `least`."""
    lengths = [s.select(F.col(key), F.greatest(F.col("end_sec") - F.col("start_sec"), F.lit(0.0)).alias("_l")) for s in sides]
    return reduce(DataFrame.unionAll, lengths).groupBy(key).agg(F.greatest(F.lit(float(least)), SPAN * F.avg("_l")).alias("_w"))


def _dealt(rows: DataFrame, key: str, stretches: DataFrame, start: str, end: str) -> DataFrame:
    """`rows` with _w, once for each stretch _b of their recording that they touch."""
    at = lambda t: F.floor(t / F.col("_w"))
    return rows.join(stretches, key).withColumn("_b", F.explode(F.sequence(at(F.col(start)), at(F.greatest(start, end)))))


def overlap_pairs(left: DataFrame, right: DataFrame, key: str, width: float = 600.0) -> DataFrame:
    """Pairs of one recording whose intervals (start_sec, end_sec) share time, with overlap; the right columns as `r_*`.

    Both sides are dealt out by recording and stretch of time, so one long recording is many join
    keys; a pair that meets in several stretches is kept in the first. A stretch is `width` seconds,
    or more where a recording's intervals are longer: rows are copied no more for being long.
    """
    b = right.select(F.col(key), *(F.col(c).alias(f"r_{c}") for c in right.columns if c != key))
    stretches = _stretches(key, width, left, right)
    a, b = _dealt(left, key, stretches, "start_sec", "end_sec"), _dealt(b, key, stretches, "r_start_sec", "r_end_sec").drop("_w")
    share = F.when(F.col("end_sec").isNotNull() & F.col("r_end_sec").isNotNull(), F.least("end_sec", "r_end_sec") - F.greatest("start_sec", "r_start_sec"))
    first = F.floor(F.greatest("start_sec", "r_start_sec") / F.col("_w"))
    return a.join(b, [key, "_b"]).withColumn("overlap", share).where((F.col("overlap") > 0) & (F.col("_b") == first)).drop("_b", "_w")


def align_max_overlap(utterances: DataFrame, slides: DataFrame, key: str = "recording", uid: str = "utterance_id", width: float = 600.0) -> DataFrame:
    """`utterances` with the slide_id of the slide they overlap most; the first slide on ties, null without overlap."""
    pairs = overlap_pairs(utterances.select(key, uid, "start_sec", "end_sec"), slides.select(key, "slide_id", "slide_pos", "start_sec", "end_sec"), key, width)
    best = pairs.groupBy(key, uid).agg(F.max_by("r_slide_id", F.struct("overlap", -F.col("r_slide_pos"))).alias("slide_id"))
    return utterances.join(best, [key, uid], "left")


def within_cases(utterances: DataFrame, cases: DataFrame, key: str = "recording", width: float = 3600.0) -> DataFrame:
    """Utterances with each case that holds them whole, bounds included; overlapping cases give a row each.

    Cases are dealt to all stretches that they touch, utterances to the one they begin in. A stretch
    is `width` seconds, or more where a recording's cases are longer.
    """
    stretches = _stretches(key, width, cases)
    c = cases.select(F.col(key), "case_id", F.col("start_sec").alias("case_start"), F.col("end_sec").alias("case_end"))
    c = _dealt(c, key, stretches, "case_start", "case_end").drop("_w")
    u = utterances.join(stretches, key).withColumn("_b", F.floor(F.col("start_sec") / F.col("_w"))).drop("_w")
    return u.join(c, [key, "_b"]).where((F.col("start_sec") >= F.col("case_start")) & (F.col("end_sec") <= F.col("case_end"))).drop("_b")


def slide_context(slides: DataFrame, utterances: DataFrame, key: str = "recording", back: float = 60.0, width: float = 600.0) -> DataFrame:
    """`slides` with the text of utterances from `back` seconds before the slide until its end, in order; empty if none.

    Both sides are dealt to the stretches of time that they touch; a pair counts in the first they
    share. A stretch is `width` seconds, or more where a recording's intervals are longer.
    """
    s = slides.select(key, "slide_id", F.greatest(F.lit(0.0), F.col("start_sec") - back).alias("_s"), F.col("end_sec").alias("_e"))
    u = utterances.select(key, "pos", "text", F.col("start_sec").alias("_us"), F.col("end_sec").alias("_ue"))
    stretches = _stretches(key, max(width, back), slides, utterances)
    s, u = _dealt(s, key, stretches, "_s", "_e"), _dealt(u, key, stretches, "_us", "_ue").drop("_w")
    near = (F.col("_ue") >= F.col("_s")) & (F.col("_us") <= F.col("_e")) & (F.col("_b") == F.floor(F.greatest("_us", "_s") / F.col("_w")))
    found = s.join(u, [key, "_b"]).where(near).groupBy(key, "slide_id").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("_c"))
    context = found.select(key, "slide_id", F.array_join("_c.text", " ").alias("context"))
    return slides.join(context, [key, "slide_id"], "left").withColumn("context", F.coalesce("context", F.lit("")))


def most_overlapping_speaker(segments: DataFrame, turns: DataFrame, key: str = "recording", uid: str = "utterance_id", width: float = 600.0) -> DataFrame:
    """`segments` with the label whose turns overlap each for the longest time in all; the first label on ties, null without overlap."""
    pairs = overlap_pairs(segments.select(key, uid, "start_sec", "end_sec"), turns.select(key, "label", "start_sec", "end_sec"), key, width)
    summed = pairs.groupBy(key, uid, "r_label").agg(F.sum("overlap").alias("t"))
    best = summed.groupBy(key, uid).agg(F.min_by("r_label", F.struct(-F.col("t"), "r_label")).alias("label"))
    return segments.join(best, [key, uid], "left")


def speaker_segments(turns: DataFrame, key: str = "recording", label: str = "label") -> DataFrame:
    """(key, label, segments in time order) with bounds rounded to 3 digits."""
    one = F.struct(F.round("start_sec", 3).alias("start_sec"), F.round("end_sec", 3).alias("end_sec"))
    return turns.groupBy(key, label).agg(F.array_sort(F.collect_list(one)).alias("segments"))


def with_role(utterances: DataFrame, profiles: DataFrame, valid: list[str] | None = None, key: str = "recording") -> DataFrame:
    """`utterances` with inferred_role by speaker: of repeated profiles the last, `other` if there is none or it isn't valid."""
    last = profiles.groupBy(key, "speaker_id").agg(F.max_by("inferred_role", "pos").alias("_role"))
    role = F.col("_role")
    if valid is not None:
        role = F.when(role.isin(valid), role)
    return utterances.join(last, [key, "speaker_id"], "left").withColumn("inferred_role", F.coalesce(role, F.lit("other"))).drop("_role")


def with_speaker_number(segments: DataFrame, key: str = "recording", unknown: str = "UNKNOWN") -> DataFrame:
    """`segments` with speaker_id `spk_NN` by the order of labels in a recording; the unknown label stays."""
    labels = segments.where(F.col("label") != unknown).select(key, "label").distinct()
    ids = labels.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("label")) - 1)
    return segments.join(ids, [key, "label"], "left").withColumn("speaker_id", F.when(F.col("_n").isNull(), F.col("label")).otherwise(F.format_string("spk_%02d", "_n"))).drop("_n")


def listed_slides(tasks: DataFrame, slides: DataFrame, key: str = "recording") -> DataFrame:
    """Records of each task's slide_ids, in the list's order; unknown ids drop out."""
    wanted = tasks.select(key, "case_id", F.posexplode("slide_ids").alias("_p", "slide_id"))
    found = wanted.join(slides.select(key, "slide_id", "caption"), [key, "slide_id"])
    return found.groupBy(key, "case_id").agg(F.array_sort(F.collect_list(F.struct("_p", "slide_id", "caption"))).alias("_s")).select(
        key, "case_id", F.transform("_s", lambda x: F.struct(x["slide_id"].alias("slide_id"), x["caption"].alias("caption"))).alias("slides")
    )


def frame_grid(cases: DataFrame, fps: float = 0.5) -> DataFrame:
    """Sampling times of each case: from its start, before its end, `fps` a second, rounded to milliseconds."""
    step = 1.0 / max(fps, 1e-6)
    count = F.greatest(F.ceil((F.col("end_sec") - F.col("start_sec")) / step).cast("int"), F.lit(0))
    times = F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.col("start_sec") + i * step)).otherwise(F.array().cast("array<double>"))
    return cases.withColumn("at_sec", F.explode(F.filter(times, lambda t: t < F.col("end_sec")))).withColumn("at_sec", F.round("at_sec", 3))
