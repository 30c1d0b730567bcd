"""Rows with pictures: content parts, checks of whole rows against the files there are, and the slide of a frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.text import canonical_json, sha256, strip

#: What opens and closes the list of slides in a human turn (fixed values).
SLIDE_BLOCK = ("<SLIDE_DESCRIPTIONS>\n", "\n</SLIDE_DESCRIPTIONS>")
MARKER = "<image>"
#: Ways into which the rows of one list of images are dealt where lists meet what they miss.
SALTS = 32


def split_at_markers(text: Column, marker: str = MARKER, block: tuple[str, str] = SLIDE_BLOCK) -> Column:
    """The text cut at its markers: at those in the first whole block if there is one, else at all."""
    opened = F.position(F.lit(block[0]), text, F.lit(1))
    start = opened + len(block[0])
    end = F.position(F.lit(block[1]), text, start)
    found = (opened > 0) & (end > 0)
    inner = F.when(found, F.substring(text, start, end - start)).otherwise(text)
    head = F.when(found, F.substring(text, F.lit(1), start - 1)).otherwise("")
    tail = F.when(found, F.substring(text, end, F.length(text))).otherwise("")
    pieces = F.split(inner, r"\Q" + marker + r"\E", -1)
    last = F.size(pieces) - 1
    return F.transform(pieces, lambda p, i: F.concat(F.when(i == 0, head).otherwise(""), p, F.when(i == last, tail).otherwise("")))


def content_parts(pieces: Column, images: Column) -> Column:
    """Parts (type, text, url): each piece that isn't empty, and after each but the last its image."""
    part = lambda kind, t, u: F.struct(F.lit(kind).alias("type"), t.cast("string").alias("text"), u.cast("string").alias("url"))
    none, last = F.lit(None), F.size(pieces) - 1
    pairs = F.transform(pieces, lambda p, i: F.when(i < last, F.array(part("text", p, none), part("image", none, F.get(images, i)))).otherwise(F.array(part("text", p, none))))
    return F.filter(F.flatten(pairs), lambda p: (p["type"] != "text") | (p["text"] != ""))


def rejoined(parts: Column, marker: str = MARKER) -> Column:
    """The text that parts came from; an image without a url has no marker."""
    return F.array_join(F.transform(parts, lambda p: F.when(p["type"] == "text", p["text"]).otherwise(F.when(p["url"].isNotNull(), F.lit(marker)).otherwise(F.lit("")))), "")


def messages_hash(system: Column, human: Column) -> Column:
    """Hash of the system and the user message in canonical JSON."""
    message = lambda role, content: canonical_json(role=F.lit(role), content=content)
    return sha256(F.concat(F.lit("["), message("system", system), F.lit(","), message("user", human), F.lit("]")))


def missing_images(df: DataFrame, images: str, files: DataFrame, path: str) -> DataFrame:
    """(images, missing): the first two images, in order, that aren't among `files`, for each distinct list that lacks one; null paths are missing."""
    lists = df.select(F.col(images).alias("_list")).where(F.size("_list") > 0).distinct()
    each = lists.select("_list", F.posexplode("_list").alias("_pos", "_path"))
    there = files.select(F.col(path).alias("_path")).where("_path is not null").distinct()
    absent = each.select("_path").distinct().join(there, "_path", "left_anti").withColumnRenamed("_path", "_absent")
    lost = each.join(absent, F.col("_path").eqNullSafe(F.col("_absent"))).select("_list", "_pos")
    firsts = lost.groupBy("_list").agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_n"))
    seconds = lost.join(firsts, "_list").where("_pos > _first").groupBy("_list").agg(F.min("_pos").alias("_second"))
    at = lambda i: F.get("_list", F.col(i))
    named = firsts.join(seconds, "_list", "left").select("_list", F.when(F.col("_second").isNull(), F.array(at("_first"))).otherwise(F.array(at("_first"), at("_second"))).alias("missing"))
    return named.withColumnRenamed("_list", images)


def multimodal_rows(df: DataFrame, files: DataFrame, system_prompt: str, turns: str = "conversations", images: str = "images", declared: str | None = None, path: str = "path") -> DataFrame:
    """`df` with fault, the first rule a row breaks or null, missing (images) and content, the parts of rows without fault.

    Rules, in order: `turns` (a system and a human turn, both with text), `system` (the prompt,
    but for white space around it), `images` (each is among `files`), `hash` (of both messages,
    where the column `declared` isn't null), `markers` (as many as images, counted in the slide
    block if there is one) and `round_trip` (the parts joined give the text).

    A null list of images is an empty one. Rows may repeat. The files met are the distinct paths
    only; lists that lack one meet their rows dealt into SALTS ways by partition, so that a list,
    or none, may be in any share of the rows. Columns of `df` named like a result are replaced.
    """
    df = df.drop("fault", "missing", "content")
    lost = missing_images(df, images, files, path).select(F.col(images).alias("_lost_of"), "missing", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_way"))
    dealt = df.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    rows = dealt.join(lost, (F.col(images) == F.col("_lost_of")) & (F.col("_salt") == F.col("_way")), "left").drop("_lost_of", "_salt", "_way")
    turn = lambda i: F.get(turns, F.lit(i))["value"]
    rows = rows.withColumns({"_system": turn(0), "_human": turn(1), "_images": F.coalesce(images, F.array().cast("array<string>"))})
    rows = rows.withColumn("_pieces", split_at_markers(F.col("_human")))
    rows = rows.withColumn("_parts", content_parts(F.col("_pieces"), F.col("_images")))
    shaped = (F.transform(turns, lambda t: t["from"]) == F.array(F.lit("system"), F.lit("human"))) & F.col("_system").isNotNull() & F.col("_human").isNotNull()
    hashed = F.lit(True) if declared is None else F.col(declared).isNull() | (F.col(declared) == messages_hash(F.col("_system"), F.col("_human")))
    rules = {
        "turns": shaped,
        "system": strip(F.col("_system")) == strip(F.lit(system_prompt)),
        "images": F.col("missing").isNull(),
        "hash": hashed,
        "markers": F.size("_pieces") - 1 == F.size("_images"),
        "round_trip": rejoined(F.col("_parts")) == F.col("_human"),
    }
    fault = F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()))
    return rows.withColumn("fault", fault).withColumn("content", F.when(F.col("fault").isNull(), F.col("_parts"))).drop("_system", "_human", "_images", "_pieces", "_parts")


#: Shares of a frame, aspect ratios and least sharpness of a slide (fixed values).
LEAST_SHARE, MOST_SHARE, NARROWEST, WIDEST, LEAST_SHARPNESS = 0.08, 0.75, 1.1, 2.6, 12.0


def slide_score(box: Column, area: Column, width: Column, height: Column, most: float | None = MOST_SHARE) -> Column:
    """How much a region of `area` pixels in its `box` (x, y, w, h) looks like a slide: share x fill x nearness to the middle.

    0 if the region is too small or its box flat, too narrow or too wide, or if region or box
    fill more than `most` of the frame; `most=None`, for masks, knows no upper bound.
    """
    x, y, w, h = (box[n].cast("double") for n in "xywh")
    frame = width.cast("double") * height
    share, aspect = F.try_divide(area.cast("double"), frame), F.try_divide(w, h)
    fits = (share >= LEAST_SHARE) & aspect.between(NARROWEST, WIDEST)
    if most is not None:
        fits = fits & (share <= most) & (F.try_divide(w * h, frame) <= most)
    across, down = F.try_divide(x + w / 2, width), F.try_divide(y + h / 2, height)
    middle = (1 - F.abs(across - 0.5)) * (1 - F.greatest(down - 0.7, F.lit(0.0)))
    return F.coalesce(F.when(fits, share * F.try_divide(area.cast("double"), w * h) * middle), F.lit(0.0))


def best_slides(regions: DataFrame, frame: list[str], order: str, box: str = "box", area: str = "area", width: str = "width", height: str = "height", sharpness: str = "sharpness", most: float | None = MOST_SHARE) -> DataFrame:
    """(frame, box, score, verdict) for each frame: the region of the highest score, the first in `order` of equals.

    verdict is `slide`; `none`, without a box, if no region scores above 0; or `blurred` if the
    best one's sharpness is known and under LEAST_SHARPNESS, in which case no other region
    takes its place.
    """
    scored = regions.withColumn("_s", slide_score(F.col(box), F.col(area), F.col(width), F.col(height), most))
    best = scored.groupBy(*frame).agg(F.max_by(F.struct(F.col(box).alias("b"), F.col(sharpness).alias("q")), F.struct("_s", -F.col(order))).alias("_b"), F.max("_s").alias("score"))
    verdict = F.when(F.col("score") <= 0, "none").when(F.col("_b.q") < LEAST_SHARPNESS, "blurred").otherwise("slide")
    return best.select(*frame, F.when(F.col("score") > 0, F.col("_b.b")).alias(box), "score", verdict.alias("verdict"))
