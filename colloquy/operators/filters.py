"""Filters, checks and repair decisions over curation and evaluation rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.text import collapse, marker_count, sha256, strip

#: Roles and drop reasons that are valid (fixed values).
VALID_ROLES = ["moderator", "pathologist", "radiologist", "medical oncologist", "radiation oncologist", "surgeon", "molecular pathologist", "genetic counselor", "clinical trial specialist", "nurse navigator", "other"]
DROP_REASONS = ["non_answer", "tangential", "circular", "trivial", "open_ended", "unanswerable", "non_clinical"]
MIN_TEXT = 60


def search_filter(videos: DataFrame, keyword: str, min_minutes: float) -> DataFrame:
    """Videos with an id whose title has the keyword, in any case, and that last longer than the minimum."""
    return videos.where((F.col("id") != "") & F.lower("title").contains(keyword.lower()) & (F.col("duration") > min_minutes * 60))


def case_presentations(verdicts: DataFrame, files: DataFrame) -> DataFrame:
    """Videos judged to be presentations whose file is there, with or without `.mp4`."""
    bare = lambda c: F.regexp_replace(c, r"\.mp4$", "")
    listed = files.select(bare(F.col("file")).alias("_v")).distinct()
    return verdicts.where(F.coalesce("is_case_presentation", F.lit(False))).join(listed, bare(F.col("video")) == F.col("_v"), "left_semi")


def default_verdict(transcripts: DataFrame) -> DataFrame:
    """A fixed negative verdict for blank transcripts, null for those that a classifier must see."""
    blank = strip(F.coalesce("transcript", F.lit(""))) == ""
    return transcripts.withColumn("verdict", F.when(blank, F.struct(F.lit(False).alias("is_case_presentation"), F.lit("high").alias("confidence"), F.lit("empty transcript").alias("reason"))))


def long_enough(df: DataFrame, text: str, least: int = MIN_TEXT) -> DataFrame:
    return df.where(F.length(strip(F.col(text))) >= least)


def normalized_reason(reason: Column) -> Column:
    cleaned = F.lower(strip(F.coalesce(reason, F.lit(""))))
    return F.when(cleaned.isin(DROP_REASONS), cleaned).otherwise("non_answer")


def repaired(pairs: DataFrame, decisions: DataFrame, case: list[str]) -> DataFrame:
    """`pairs` (case, pos) with keep, question, answer and drop_reason after the last valid decision for each.

    A pair without one stays as it is; a blank edit falls back to the original text; a drop
    keeps the original and takes a reason.
    """
    last = decisions.groupBy(*case, F.col("index").alias("pos")).agg(F.max_by(F.struct("verdict", F.col("question").alias("q"), F.col("answer").alias("a"), "drop_reason"), "order").alias("_d"))
    joined = pairs.join(last, [*case, "pos"], "left")
    drop = F.lower(F.coalesce(F.col("_d.verdict"), F.lit("keep"))) == "drop"
    edit = lambda new, old: F.when(~drop & (strip(F.coalesce(new, F.lit(""))) != ""), new).otherwise(F.col(old))
    return joined.withColumns({"keep": ~drop, "question": edit(F.col("_d.q"), "question"), "answer": edit(F.col("_d.a"), "answer"), "drop_reason": F.when(drop, normalized_reason(F.col("_d.drop_reason")))}).drop("_d")


def verified(kept: Column, verdicts: Column) -> Column:
    """Elements of `kept` whose verdict at the same place isn't false; missing verdicts keep."""
    return F.filter(kept, lambda _, i: F.coalesce(F.get(verdicts, i), F.lit(True)))


def marker_mismatch(df: DataFrame, text: str, images: str) -> DataFrame:
    """Rows whose text hasn't as many image markers as there are images."""
    return df.where(marker_count(F.col(text)) != F.coalesce(F.size(images), F.lit(0)))


def required(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """`df`, failing with `message` on the first row where `condition` doesn't hold.

    A row number that is never negative keeps the check where it stands: Spark moves other
    filters below joins and filters before them, to rows that were to drop out first.
    """
    ok = F.coalesce(condition, F.lit(False)) | (F.monotonically_increasing_id() < 0)
    return df.where(F.when(ok, True).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def valid_rows(turns: str, row_id: str, metadata_id: str, system_prompt: str, text_hash: str | None = None, images: str | None = None) -> Column:
    """Exactly one system turn with the frozen prompt and one human turn, equal ids; the human text's hash if one is given, and as many markers as images if these are."""
    count = lambda role: F.size(F.filter(turns, lambda t: t["from"] == role))
    first = F.get(F.filter(turns, lambda t: t["from"] == "system"), F.lit(0))["value"]
    ok = (count("system") == 1) & (count("human") == 1) & (F.col(row_id) == F.col(metadata_id)) & (strip(first) == system_prompt.strip())
    human = F.get(F.filter(turns, lambda t: t["from"] == "human"), F.lit(0))["value"]
    if text_hash:
        ok = ok & (F.col(text_hash).isNull() | (sha256(human) == F.col(text_hash)))
    if images:
        ok = ok & (marker_count(human) == F.coalesce(F.size(images), F.lit(0)))
    return F.coalesce(ok, F.lit(False))


def reference_free(df: DataFrame, keep_reference: bool = False) -> DataFrame:
    """`df` without private, hash and (unless kept) reference columns."""
    gone = [c for c in df.columns if c.startswith("_") or c.endswith("sha256") or (not keep_reference and c.startswith("reference_"))]
    return df.drop(*gone)


def judge_score(body: Column, field: str, low: int = 1) -> Column:
    """An integer score from `low` to 5 in a JSON object; anything else, a boolean or 4.0 too, is null."""
    raw = F.get_json_object(body, f"$.{field}")
    value = F.from_json(body, f"{field} int")[field]
    return F.when(raw.rlike(r"^-?\d+$") & value.between(low, 5), value)


def has_exactly(body: Column, keys: list[str]) -> Column:
    """Whether a JSON object has these keys and no other."""
    found = F.json_object_keys(body)
    return F.coalesce((F.size(found) == len(keys)) & (F.size(F.array_except(found, F.array(*map(F.lit, keys)))) == 0), F.lit(False))


def repeated_ids(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).count().where(F.col("count") > 1)


def bad_ids(outputs: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """(id, reason) of outputs whose id is empty, repeated or not of the batch; null ids are empty."""
    ids = outputs.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).join(batch.select(key).distinct().withColumn("_there", F.lit(True)), key, "left")
    reason = F.when(F.coalesce(F.col(key).cast("string"), F.lit("")) == "", "empty").when(F.col("_n") > 1, "repeated").when(F.col("_there").isNull(), "unknown")
    return ids.select(key, reason.alias("reason")).where("reason is not null")


def subset_by_id(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows that `wanted` names, and a failure if it names one that isn't there."""
    ids = wanted.select(key).distinct()
    there = df.select(key).distinct().withColumn("_there", F.lit(True))
    known = required(ids.join(there, key, "left"), F.col("_there"), "an id of the subset isn't in the table").select(key)
    return df.join(known, key, "left_semi")


def covered_share(box: Column, people: Column) -> Column:
    """Share of a box (x, y, w, h) that people's boxes cover; overlaps count twice, and 1 is the most."""

    def area(p: Column) -> Column:
        w = F.least(box["x"] + box["w"], p["x"] + p["w"]) - F.greatest(box["x"], p["x"])
        h = F.least(box["y"] + box["h"], p["y"] + p["h"]) - F.greatest(box["y"], p["y"])
        return (F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))).cast("double")

    total = F.aggregate(F.transform(people, area), F.lit(0.0), lambda s, x: s + x)
    return F.least(F.lit(1.0), F.coalesce(F.try_divide(total, (box["w"] * box["h"]).cast("double")), F.lit(0.0)))


def clear_of_people(boxes: Column, people: Column, most: float = 0.1) -> Column:
    """Boxes covered up to `most`; if there are none, the one covered least, the first of equals."""
    shares = F.transform(boxes, lambda b, i: F.struct(covered_share(b, people).alias("s"), i.alias("i"), b.alias("b")))
    clear = F.transform(F.filter(shares, lambda x: x["s"] <= most), lambda x: x["b"])
    return F.when(F.size(clear) > 0, clear).when(F.size(boxes) > 0, F.array(F.array_min(shares)["b"])).otherwise(boxes)


def plausible_boxes(boxes: Column, frame_area: Column, least: float = 0.05, most: float = 0.95) -> Column:
    """Boxes of a sensible share of the frame and a slide's aspect ratio."""

    def ok(b: Column) -> Column:
        share = (b["w"] * b["h"]) / frame_area
        return (share >= least) & (share <= most) & F.coalesce(F.try_divide(b["w"].cast("double"), b["h"].cast("double")).between(1.1, 2.6), F.lit(False))

    return F.filter(boxes, ok)


def identity(df: DataFrame, prompt: str, images: str) -> Column:
    """Hash of the collapsed prompt and the images: what makes two training inputs the same."""
    return sha256(F.concat_ws("\u001f", collapse(F.col(prompt)), F.array_join(F.coalesce(F.col(images), F.array().cast("array<string>")), "\u001f")))


def source_identity(*candidates: Column) -> Column:
    """The first candidate that isn't null or empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in candidates])
