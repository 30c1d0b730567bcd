"""Rows for trainers: which records become samples, what is joined to them, and their shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.text import is_blank, marker_count, strip
from colloquy.operators.filters import required

#: Role tags of a trainer by the tags of conversations (fixed values).
TRAINER_ROLES = {"system": "system", "human": "user", "gpt": "assistant"}
MARKER = "<image>"


def filled(text: Column) -> Column:
    return ~is_blank(text)


def discussion_samples(tasks: DataFrame) -> DataFrame:
    """Tasks with a conclusion and with utterances."""
    return tasks.where(filled(F.col("conclusion")) & (F.coalesce(F.size("utterances"), F.lit(0)) > 0))


def question_samples(tasks: DataFrame) -> DataFrame:
    """A row for each of a task's qa_pairs with a question and an answer; `pos` counts the skipped ones too."""
    pairs = tasks.select(*(c for c in tasks.columns if c != "qa_pairs"), F.posexplode("qa_pairs").alias("pos", "_q"))
    return pairs.where(filled(F.col("_q.question")) & filled(F.col("_q.answer"))).select("*", "_q.*").drop("_q")


def turn(role, value: Column) -> Column:
    return F.struct((role if isinstance(role, Column) else F.lit(role)).alias("from"), value.alias("value"))


def mapped_turns(turns: Column, roles: dict[str, str] = TRAINER_ROLES) -> Column:
    """(role, content) for each (from, value), by the trainer's tags; a tag that has none stays."""
    tags = F.create_map(*[F.lit(x) for pair in roles.items() for x in pair])
    return F.transform(turns, lambda t: F.struct(F.coalesce(F.try_element_at(tags, t["from"]), t["from"]).alias("role"), t["value"].alias("content")))


def with_recorded(records: DataFrame, recorded: DataFrame, key: str, field: str = "discussion") -> DataFrame:
    """`records` with their own `field`, else the recorded one, else an empty text."""
    found = recorded.select(key, F.col(field).alias("_recorded"))
    return records.join(found, key, "left").withColumn(field, F.coalesce(F.nullif(F.col(field), F.lit("")), "_recorded", F.lit(""))).drop("_recorded")


def with_images(records: DataFrame, index: DataFrame, task: str, split: str, key: str = "id") -> DataFrame:
    """`records` with the images that the index lists for this task and split; null where it lists none."""
    listed = index.where((F.col("task") == task) & (F.col("split") == split)).select(key, "images")
    return records.drop("images").join(listed, key, "left")


def with_bounds(cases: DataFrame, bounds: DataFrame, keys: list[str]) -> DataFrame:
    """`cases` with case_start_sec and case_end_sec, null where no bounds are known."""
    return cases.join(bounds.select(*keys, F.col("start_sec").alias("case_start_sec"), F.col("end_sec").alias("case_end_sec")), keys, "left")


def with_alignment(tasks: DataFrame, aligned: DataFrame, keys: list[str]) -> DataFrame:
    """`tasks` with aligned_utterances, an empty list where a case has no alignment."""
    joined = tasks.join(aligned.select(*keys, "aligned_utterances"), keys, "left")
    kind = aligned.schema["aligned_utterances"].dataType
    return joined.withColumn("aligned_utterances", F.coalesce("aligned_utterances", F.array().cast(kind)))


def with_slide_images(items: DataFrame, slides: DataFrame, keys: list[str]) -> DataFrame:
    """`items` with their case's images; an item whose case has none fails the job."""
    joined = items.join(slides.select(*keys, "images"), keys, "left")
    return required(joined, F.col("images").isNotNull(), "an item's case has no slide images")


def skip_reason(records: DataFrame, files: DataFrame | None = None, key: str = "id") -> DataFrame:
    """`records` (conclusion, discussion, user_turn, images) with skip_reason, null for those to train on.

    A record needs its conclusion, its discussion, images, as many markers as images, and, if
    `files` (path) are given, every image among them.
    """
    count = F.coalesce(F.size("images"), F.lit(0))
    out = records.withColumn("_missing", F.lit(0).cast("long"))
    if files is not None:
        wanted = records.select(key, F.explode("images").alias("path"))
        missing = wanted.join(files.select("path").distinct(), "path", "left_anti").groupBy(key).agg(F.count(F.lit(1)).alias("_missing"))
        out = records.join(missing, key, "left")
    reason = F.when(is_blank(F.col("conclusion")), "no conclusion").when(is_blank(F.col("discussion")), "no discussion").when(F.coalesce(count, F.lit(0)) <= 0, "no images")
    reason = reason.when(marker_count(F.coalesce("user_turn", F.lit(""))) != count, "marker count").when(F.coalesce("_missing", F.lit(0)) > 0, "missing file")
    return out.withColumn("skip_reason", reason).drop("_missing")


def skipped(records: DataFrame) -> DataFrame:
    """(skip_reason, n) of the records that `skip_reason` marks."""
    return records.where("skip_reason is not null").groupBy("skip_reason").agg(F.count(F.lit(1)).alias("n"))


def sft_rows(records: DataFrame, system_prompt: str, prompt_version: str, condition: str, name: str) -> DataFrame:
    """A conversation of system, human and gpt turns for each record without a skip_reason."""
    answer = F.concat(F.col("discussion"), F.lit("\n<conclusion>"), strip(F.col("conclusion")), F.lit("</conclusion>"))
    turns = F.array(turn("system", F.lit(system_prompt.strip())), turn("human", F.col("user_turn")), turn("gpt", answer))
    return records.where("skip_reason is null").select(
        turns.alias("conversations"), F.lit(prompt_version).alias("prompt_version"), F.lit(condition).alias("condition"), F.lit(name).alias("set"),
        F.col("id").alias("source_id"), "video_uid", "case_id", "images",
    )


def preference_rows(rows: DataFrame, split: str, system_prompt: str, with_reference: bool, source: str, ability: str, system_markers: int = 0) -> DataFrame:
    """Rows for reinforcement learning: `rows` (row, conversations, images, source_id, video_uid, case_id) with the system prompt replaced.

    Fails on the first row that isn't one system and one human turn, that hasn't exactly one
    reference (none for a test split), or whose markers aren't as many as its images.
    """
    of = lambda tag: F.filter("conversations", lambda t: t["from"] == tag)
    prompt, answers = F.filter("conversations", lambda t: t["from"].isin("system", "human")), of("gpt")
    images = F.coalesce("images", F.array().cast("array<string>"))
    checked = required(rows, F.transform(prompt, lambda t: t["from"]) == F.array(F.lit("system"), F.lit("human")), f"{split}: not exactly a system and a human turn")
    checked = required(checked, F.size(answers) == (1 if with_reference else 0), f"{split}: {'not one reference' if with_reference else 'a reference in a test row'}")
    human = F.get(of("human"), F.lit(0))["value"]
    checked = required(checked, marker_count(human) == F.size(images), f"{split}: markers and images differ")
    checked = required(checked, marker_count(F.lit(system_prompt)) == system_markers, f"{split}: markers of the system prompt")
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    extra = {"index": F.col("row"), "split": F.lit(split), "n_images": F.size(images), "case_evidence": human, "source_id": F.col("source_id"), "video_uid": F.col("video_uid"), "case_id": F.col("case_id")}
    return checked.select(
        F.lit(source).alias("data_source"), F.array(message("system", F.lit(system_prompt)), message("user", human)).alias("prompt"), images.alias("images"), F.lit(ability).alias("ability"),
        F.struct(F.lit("rule").alias("style"), F.coalesce(F.get(answers, F.lit(0))["value"], F.lit("")).alias("ground_truth")).alias("reward_model"),
        F.struct(*(v.alias(k) for k, v in extra.items())).alias("extra_info"),
    )


def counted(df: DataFrame, expected: int) -> DataFrame:
    """`df`, or a failure if it hasn't `expected` rows; the count runs as a job of its own."""
    n = df.count()
    if n != expected:
        raise ValueError(f"{n} rows where {expected} are expected")
    return df


def shielded(text: Column, sentinel: str, marker: str = MARKER) -> Column:
    """`text` with each literal marker replaced, so that a processor that counts markers doesn't see it; fails if the sentinel is there already."""
    clear = F.when(text.contains(sentinel), F.raise_error(F.lit("the sentinel stands in the text"))).otherwise(text)
    return F.replace(clear.cast("string"), F.lit(marker), F.lit(sentinel))


def restored(text: Column, sentinel: str, marker: str = MARKER) -> Column:
    return F.replace(text, F.lit(sentinel), F.lit(marker))


def runs_together(*runs: DataFrame) -> DataFrame:
    """All rows of several runs by column name; a column that a run lacks is null there."""
    out = runs[0]
    for run in runs[1:]:
        out = out.unionByName(run, allowMissingColumns=True)
    return out


def first_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first `n` rows in order, a limit that the run asks for; all if `n` is 0."""
    return df.orderBy(*order).limit(n) if n else df


def ordered_rollouts(rollouts: DataFrame) -> DataFrame:
    """`rollouts` (uid `sample_rollout_output`, score, parts map) numbered in the order of the uid's numbers, each part in a column of its own, by name."""
    key = F.transform(F.split("uid", "_"), lambda x: x.try_cast("long"))
    names = sorted(r[0] for r in rollouts.select(F.explode(F.map_keys("parts"))).distinct().collect())
    return rollouts.select("uid", "score", *(F.try_element_at("parts", F.lit(n)).alias(n) for n in names), key.alias("_k")).orderBy("_k", "uid").drop("_k")


def edited_cases(questions: DataFrame, edits: DataFrame, keys: list[str]) -> DataFrame:
    """Questions of the cases whose summary or captions an edit has changed."""
    changed = edits.where((F.lower("summary_verdict") != "keep") | F.exists(F.coalesce("captions", F.array().cast(edits.schema["captions"].dataType)), lambda c: F.lower(c["verdict"]) != "keep"))
    return questions.join(changed.select(*keys).distinct(), keys, "left_semi")


def above_score(frames: DataFrame, least: float, positive: str = "positive", negative: str = "negative") -> DataFrame:
    """Frames whose similarity to the wanted kind exceeds that to the unwanted one by `least` or more, with the score."""
    return frames.withColumn("score", F.col(positive) - F.col(negative)).where(F.col("score") >= least)


def by_kind(rows: DataFrame, kinds: tuple[str, ...] = ("response", "error", "stopped")) -> dict[str, DataFrame]:
    """The rows of each kind, to be written apart; another kind fails."""
    known = required(rows, F.col("kind").isin(*kinds), f"a row's kind is none of {', '.join(kinds)}")
    return {k: known.where(F.col("kind") == k) for k in kinds}


def one_format(rows: DataFrame) -> DataFrame:
    """(n, custom, sharegpt, ok): rows by format (`conversations` or not), and whether all are of one; none isn't."""
    share = F.col("conversations").isNotNull()
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(~share).alias("custom"), F.count_if(share).alias("sharegpt"))
    return counts.withColumn("ok", (F.col("n") > 0) & ((F.col("custom") == 0) | (F.col("sharegpt") == 0)))


def run_counters(rows: DataFrame, selected: int, resumed: int, elapsed_seconds: float, overrun: bool = False) -> DataFrame:
    """One row of a run's counters: rows by status, what is done and left, the rate, and the seconds left at that rate (null at none).

    With more rows done than were selected nothing is left, or less than nothing if `overrun` is to be seen.
    """
    count = lambda c: F.count_if(c)
    done = F.count(F.lit(1))
    statuses = ("parsed", "parsed_after_cleanup", "raw_fallback")
    out = rows.agg(done.alias("completed"), *(count(F.col("status") == s).alias(s) for s in statuses), count(F.col("error").isNotNull()).alias("errors"))
    rate = F.coalesce(F.try_divide(F.col("completed"), F.lit(float(elapsed_seconds))), F.lit(0.0))
    left = F.lit(selected) - F.lit(resumed) - F.col("completed")
    left = left if overrun else F.greatest(F.lit(0), left)
    return out.withColumns({"completed_total": F.col("completed") + resumed, "remaining": left, "per_second": rate}).withColumn("seconds_left", F.try_divide(F.col("remaining"), F.nullif("per_second", F.lit(0.0))))
