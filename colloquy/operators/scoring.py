"""Reward arithmetic over parsed responses and judges' scores, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.text import clamp_linear, strip
from colloquy.operators.sequences import with_repetition

#: Weights, limits and patterns of the scores (fixed values).
DIMENSION_WEIGHTS = {"therapy": 1.00, "surgery": 1.25, "next_action": 1.15, "clinical_trial": 2.00}
ALIGNMENT_WEIGHT, SUPPORT_WEIGHT, DECISIONS_WEIGHT, FORMAT_WEIGHT, INVALID_REWARD = 0.40, 0.35, 0.25, 0.10, -0.20
ANCHOR_ALIGNMENT_WEIGHT, ANCHOR_DECISIONS_WEIGHT = 0.45, 0.55
FORMAT_WEIGHTS = {"blocks": 0.25, "envelope": 0.1875, "turn_syntax": 0.1875, "turn_numbering": 0.1875, "conclusion_sentences": 0.125, "no_outer_whitespace": 0.0625}
OVERLONG_START, OVERLONG_END = 6144, 8192
DISCUSSION = r"(?s)<discussion>\s*(.*?)\s*</discussion>"
CONCLUSION = r"(?s)<conclusion>\s*(.*?)\s*</conclusion>"
REFERENCE_CONCLUSION = r"<conclusion>\s*([^<>]+?)\s*</conclusion>"
ENVELOPE = r"(?s)\A<discussion>\n.*?\n</discussion>\n<conclusion>[^\n]+</conclusion>\z"
TURN = r"\A<turn ([1-9]\d*)> ([^:\n<>]+): (.+)\z"
SENTENCE_END = r"(?<!\bMr)(?<!\bMs)(?<!\bDr)(?<!\b[A-Z])[.!?](?:[\"'”]*)?(?=\s|\z)"


def only_block(text: Column, pattern: str) -> Column:
    """The text of the block if there is exactly one and it isn't blank, else null."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(1))
    return F.when(F.size(found) == 1, F.nullif(strip(found[0]), F.lit("")))


def serialization(df: DataFrame, text: str) -> DataFrame:
    """`df` with discussion, conclusion and format_base_score: a quarter for the weighted parts, three for all of them exact.

    Reported beside the score and no part of it: counts of turns, roles and the conclusion's
    sentences, and whether the discussion has two roles or more and a moderator first.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    out = df.withColumns({"discussion": only_block(t, DISCUSSION), "conclusion": only_block(t, CONCLUSION)})
    lines = F.when(F.col("discussion").isNull(), F.array().cast("array<string>")).otherwise(F.split("discussion", r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]"))
    out = out.withColumn("_lines", lines).withColumn("_turns", F.filter("_lines", lambda x: x.rlike(TURN)))
    numbers = F.transform("_turns", lambda x: F.regexp_extract(x, TURN, 1).try_cast("int"))
    right = F.size(F.filter(F.transform(numbers, lambda n, i: n == i + 1), lambda x: x))
    n = F.regexp_count(strip(F.coalesce("conclusion", F.lit(""))), F.lit(SENTENCE_END))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    parts = {
        "blocks": (F.col("discussion").isNotNull().cast("double") + F.col("conclusion").isNotNull().cast("double")) / 2,
        "envelope": t.rlike(ENVELOPE).cast("double"),
        "turn_syntax": ratio(F.size("_turns"), F.size("_lines")),
        "turn_numbering": ratio(right, F.size("_turns")),
        "conclusion_sentences": F.when(n.between(2, 4), 1.0).when(n.isin(1, 5), 0.5).otherwise(0.0),
        "no_outer_whitespace": ((t != "") & (t == strip(t))).cast("double"),
    }
    out = out.withColumns({f"format_{k}": v for k, v in parts.items()})
    dense = sum((F.col(f"format_{k}") * w for k, w in FORMAT_WEIGHTS.items()), F.lit(0.0))
    roles = F.transform("_turns", lambda x: strip(F.regexp_extract(x, TURN, 2)))
    several, led = F.size(F.array_distinct(roles)) >= 2, F.coalesce(F.lower(F.get(roles, F.lit(0))) == "moderator", F.lit(False))
    out = out.withColumns({
        "format_turn_count": F.size("_turns"),
        "format_role_count": F.size(F.array_distinct(roles)),
        "format_conclusion_sentence_count": n,
        "format_dialogue_roles": several.cast("double"),
        "format_moderator_first": led.cast("double"),
        "format_dialogue_structure": (several.cast("double") + led.cast("double")) / 2,
    })
    exact = F.size("_turns") > 0
    for k in FORMAT_WEIGHTS:
        exact = exact & (F.abs(F.col(f"format_{k}") - 1) < 1e-12)
    out = out.withColumns({"format_dense_score": dense, "format_exact": exact.cast("double")})
    return out.withColumn("format_base_score", 0.25 * F.col("format_dense_score") + 0.75 * F.col("format_exact")).drop("_lines", "_turns")


def overlong_penalty(length: Column, limit: Column) -> Column:
    """Rises from 0 at OVERLONG_START to 1 at OVERLONG_END or the smaller limit; a step if the limit is below the start."""
    end = F.least(F.lit(OVERLONG_END), F.coalesce(limit, F.lit(OVERLONG_END))).cast("double")
    sloped = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(length - OVERLONG_START, end - OVERLONG_START)))
    return F.when(length.isNull(), 0.0).when(end <= OVERLONG_START, (length >= end).cast("double")).otherwise(sloped)


def format_scores(df: DataFrame, text: str, truncated: str = "response_truncated", length: str = "valid_response_length", limit: str = "response_length_limit") -> DataFrame:
    """`df` with the format score; truncation, heavy repetition and missing blocks fail closed with a reason from 1 to 4."""
    out = with_repetition(serialization(df, text), text)
    found, run, share = F.col("repetition.detected"), F.col("repetition.longest_run"), F.col("repetition.top_share")
    severe = found & ((share >= 0.5) | (run >= 128))
    one, other = F.col("discussion").isNotNull(), F.col("conclusion").isNotNull()
    reason = F.when(F.coalesce(F.col(truncated), F.lit(False)), 1).when(severe, 2).when(~one & ~other, 3).when(~one | ~other, 4).otherwise(0)
    repeated = F.when(found, F.greatest(clamp_linear(run, 8.0, 128.0), clamp_linear(share, 0.15, 0.5))).otherwise(0.0)
    out = out.withColumns({"format_failure_reason": reason, "format_repetition_penalty": repeated, "format_overlong_penalty": overlong_penalty(F.col(length), F.col(limit))})
    sound = F.greatest(F.lit(-1.0), F.col("format_base_score") - F.col("format_repetition_penalty") - F.col("format_overlong_penalty"))
    return out.withColumn("format_score", F.when(F.col("format_failure_reason") == 0, sound).when(F.col("format_failure_reason") == 4, -0.75).otherwise(-1.0))


def is_truncated(length: Column, limit: Column, width: Column) -> Column:
    return length >= F.coalesce(limit, width)


def weighted_decisions(score, present) -> tuple[Column, Column]:
    """Weighted mean of the present dimensions' scores over 5, and the sum of weights; 0 if none is present."""
    top = sum((F.when(present(n), w * score(n) / 5.0).otherwise(0.0) for n, w in DIMENSION_WEIGHTS.items()), F.lit(0.0))
    weight = sum((F.when(present(n), w).otherwise(0.0) for n, w in DIMENSION_WEIGHTS.items()), F.lit(0.0))
    return F.coalesce(F.try_divide(top, F.nullif(weight, F.lit(0.0))), F.lit(0.0)), weight


def conclusion_details(df: DataFrame) -> DataFrame:
    """`df` (alignment_score, the dimensions' scores and `scope_*`) with alignment_normalized, decisions_normalized and anchor_score."""
    decisions, weight = weighted_decisions(F.col, lambda n: F.col(f"scope_{n}") != "absent")
    out = df.withColumns({"alignment_normalized": (F.col("alignment_score") - 1) / 4.0, "decisions_normalized": decisions, "_w": weight})
    both = ANCHOR_ALIGNMENT_WEIGHT * F.col("alignment_normalized") + ANCHOR_DECISIONS_WEIGHT * F.col("decisions_normalized")
    return out.withColumn("anchor_score", F.when(F.col("_w") > 0, both).otherwise(F.col("alignment_normalized"))).drop("_w")


def valid_scores(df: DataFrame) -> DataFrame:
    """`df` with scores_valid: alignment 1 to 5 with a rationale, and each decision -1 exactly if its scope is absent, else 0 to 5."""
    ok = F.col("alignment_score").between(1, 5) & (strip(F.coalesce("rationale", F.lit(""))) != "")
    for n in DIMENSION_WEIGHTS:
        absent = F.col(f"scope_{n}") == "absent"
        ok = ok & F.when(absent, F.col(n) == -1).otherwise(F.col(n).between(0, 5))
    return df.withColumn("scores_valid", F.coalesce(ok, F.lit(False)))


def consistency_scores(df: DataFrame) -> DataFrame:
    """`df` with scores corrected by scope, the four normalized parts, the factors and consistency_match; no score fails."""
    absent = {n: F.col(f"scope_{n}") == "absent" for n in DIMENSION_WEIGHTS}
    fixed = {n: F.when(absent[n], -1).otherwise(F.greatest(F.col(n), F.lit(0))) for n in DIMENSION_WEIGHTS}
    count = sum((F.when(absent[n], 0).otherwise(1) for n in DIMENSION_WEIGHTS), F.lit(0))
    total = sum((F.when(absent[n], 0.0).otherwise(fixed[n] / 5.0) for n in DIMENSION_WEIGHTS), F.lit(0.0))
    out = df.withColumns({f"{n}_fixed": fixed[n] for n in DIMENSION_WEIGHTS} | {
        "scope_corrections": sum(((fixed[n] != F.col(n)).cast("int") for n in DIMENSION_WEIGHTS), F.lit(0)),
        "plan": F.coalesce(F.try_divide(total, count), F.lit(0.0)),
        "discussion_part": F.col("discussion_quality") / 5.0,
        "consistency_part": F.col("discussion_conclusion_consistency") / 5.0,
        "grounding_part": F.col("grounding_and_safety") / 5.0,
    })
    raw = 0.45 * F.col("plan") + 0.25 * F.col("discussion_part") + 0.15 * F.col("consistency_part") + 0.15 * F.col("grounding_part")
    safety = F.when(F.col("major_contradiction"), 0.6).otherwise(1.0) * F.when(F.col("unsafe_addition"), 0.3).otherwise(1.0)
    factor = F.when(F.col("discussion_conclusion_consistency") <= 1, 0.7).otherwise(1.0) * safety
    support = F.col("plan") * F.col("consistency_part")
    audit = (0.35 * F.col("plan") + 0.20 * F.col("discussion_part") + 0.30 * support + 0.15 * F.col("grounding_part")) * safety
    return out.withColumns({"safety_multiplier": factor, "consistency_match": raw * factor, "audit_match": audit})


def reward(df: DataFrame) -> DataFrame:
    """`df` with match_score and score; a response that fails its format gets INVALID_REWARD and isn't judged."""
    decisions = F.col("decisions_normalized")
    match = ALIGNMENT_WEIGHT * F.col("alignment_normalized") + SUPPORT_WEIGHT * decisions * F.col("consistency_part") + DECISIONS_WEIGHT * decisions
    out = df.withColumn("judge_called", F.col("format_failure_reason") == 0)
    out = out.withColumn("match_score", F.when(F.col("judge_called"), match).otherwise(INVALID_REWARD))
    return out.withColumn("score", F.col("match_score") + FORMAT_WEIGHT * F.col("format_score"))


def default_details() -> dict[str, Column]:
    """The conclusion's details of a response that isn't judged: zeros, -1 for each decision, and the invalid reward."""
    zeros = {c: F.lit(0.0) for c in ("alignment_score", "alignment_normalized", "applicable_decision_count", "decisions_normalized", "judge_called")}
    return zeros | {f"decision_{n}_score": F.lit(-1.0) for n in DIMENSION_WEIGHTS} | {"match_score": F.lit(INVALID_REWARD)}


def assembled_details(df: DataFrame, judged: str = "judge_called") -> DataFrame:
    """`df` with the details of both rubrics where `judged` holds and scores are there, and the default record elsewhere."""
    rows = conclusion_details(df)
    here = F.coalesce(F.col(judged), F.lit(False)) & F.col("alignment_score").isNotNull()
    count = sum((F.when(F.col(f"scope_{n}") != "absent", 1).otherwise(0) for n in DIMENSION_WEIGHTS), F.lit(0))
    made = {"alignment_score": F.col("alignment_score"), "alignment_normalized": F.col("alignment_normalized"), "applicable_decision_count": count, "decisions_normalized": F.col("decisions_normalized"), "judge_called": F.lit(1.0), "match_score": F.col("anchor_score")}
    made |= {f"decision_{n}_score": F.col(n) for n in DIMENSION_WEIGHTS}
    return rows.select(*(c for c in df.columns if c not in made), *(F.when(here, made[k].cast("double")).otherwise(v).alias(k) for k, v in default_details().items()))
