"""Quality rules: decision lists learned by sequential covering, in DataFrame operations only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.shared import let, stored

WORD = r"[^\x20\x09-\x0D]+"
#: Labelled rows that rules are learned from, at most; by a hash of the id.
SAMPLE_ROWS = 50_000
#: Thresholds tried of each feature.
THRESHOLDS = 24
#: Conditions of a rule, rules of a list, and the least share of bad rows and least number of rows a rule must have on rows it wasn't grown on.
MAX_CONDITIONS, MAX_RULES, LEAST_PRECISION, LEAST_ROWS = 3, 12, 0.8, 5
#: Counts that `statistics` makes.
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_bangs")


def repeated_words(words: Column, window: int = 3) -> Column:
    """Words of an array in windows of `window` words that stand in it twice or more.

    Windows are told apart by a 64-bit hash, within one text.
    """

    def covered(ws: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(0), F.size(ws) - window), lambda i: F.struct(F.xxhash64(*[F.get(ws, i + k) for k in range(window)]).alias("h"), i.alias("i")))
        twice = let(F.sort_array(grams), lambda s: F.transform(F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"])), lambda x: x["i"]))
        gaps = let(F.sort_array(twice), lambda at: F.transform(at, lambda p, k: F.least(F.lit(window), F.coalesce(F.get(at, k + 1) - p, F.lit(window)))))
        return F.when(F.size(ws) >= window, F.aggregate(gaps, F.lit(0), lambda a, x: a + x)).otherwise(0)

    return let(words, covered)


def features() -> dict[str, Column]:
    """Ratios that rules are made of, from the statistics; 0 where a text has no words."""
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return {
        "symbol_ratio": ratio("n_symbols", "word_chars"),
        "upper_ratio": ratio("n_upper", "word_chars"),
        "digit_ratio": ratio("n_digits", "word_chars"),
        "bang_ratio": ratio("n_bangs", "n_words"),
        "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
        "repeat_ratio": ratio("n_repeat_words", "n_words"),
        "word_length": ratio("word_chars", "n_words"),
        "line_length": ratio("n_words", "n_lines"),
        "length": F.col("n_words").cast("double"),
    }


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with the counts that the rules look at; a null text counts as an empty one."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("long")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    pair = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    words = let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).cast("long").alias("again")))
    held = docs.withColumns({"_lines": pair, "_words": words})
    counts = {
        "n_words": F.col("_words.n"),
        "word_chars": F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long"),
        "n_symbols": count("[#*$%&|<>]"),
        "n_dup_lines": F.col("_lines.dup"),
        "n_repeat_words": F.col("_words.again"),
        "n_lines": F.col("_lines.n"),
        "n_upper": count(r"\p{Lu}"),
        "n_digits": count("[0-9]"),
        "n_bangs": (F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))).cast("long"),
    }
    return held.select(*(c for c in docs.columns if c not in counts), *(c.alias(n) for n, c in counts.items()))


@dataclass(frozen=True)
class Condition:
    """A threshold on one feature: above it, or not above it."""

    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = features()[self.feature]
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]

    def column(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column()
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions)) + " -> drop"


def verdict(rules: list[Rule]) -> Column:
    """The rules as one conditional expression: the first that holds drops the text, else it is kept."""
    out = F.lit(True)
    for rule in reversed(rules):
        out = F.when(rule.column(), F.lit(False)).otherwise(out)
    return out


def _histogram(rows: DataFrame, cuts: dict[str, list[float]]) -> dict[str, list[list[int]]]:
    """Good and bad rows of each feature between its thresholds; the driver reads one row a bin."""
    made = features()

    def passed(value: Column, thresholds: list[float]) -> Column:
        return F.size(F.filter(F.array(*[F.lit(t) for t in thresholds]), lambda t: value > t))

    bins = F.array(*[F.struct(F.lit(n).alias("f"), passed(made[n], c).alias("b")) for n, c in cuts.items() if c])
    counted = rows.select(F.explode(bins).alias("x"), "_bad").groupBy("x.f", "x.b").agg(F.count_if(~F.col("_bad")).alias("good"), F.count_if("_bad").alias("bad"))
    out = {n: [[0, 0] for _ in range(len(c) + 1)] for n, c in cuts.items() if c}
    for r in counted.collect():
        out[r["f"]][r["b"]] = [r["good"], r["bad"]]
    return out


def _gain(good: int, bad: int, all_good: int, all_bad: int) -> float:
    """FOIL's information gain of a condition that leaves `good` and `bad` of the rows."""
    if not bad:
        return 0.0
    return bad * (math.log2(bad / (bad + good)) - math.log2(all_bad / (all_bad + all_good)))


def _grow(rows: DataFrame, cuts: dict[str, list[float]]) -> Rule | None:
    conditions: list[Condition] = []
    while len(conditions) < MAX_CONDITIONS:
        left = rows.where(Rule(tuple(conditions)).column())
        best, choice, pure = 0.0, None, False
        for name, bins in _histogram(left, cuts).items():
            all_good, all_bad = sum(b[0] for b in bins), sum(b[1] for b in bins)
            if not all_bad or not all_good:
                pure = True
                break
            good, bad = all_good, all_bad
            for cut, (g, b) in zip(cuts[name], bins):
                good, bad = good - g, bad - b
                for above, x, y in ((True, good, bad), (False, all_good - good, all_bad - bad)):
                    if (now := _gain(x, y, all_good, all_bad)) > best + 1e-9:
                        best, choice = now, Condition(name, above, cut)
        if pure or choice is None:
            break
        conditions.append(choice)
    return Rule(tuple(conditions)) if conditions else None


def _tally(rows: DataFrame, rules: list[Rule]) -> list[tuple[int, int]]:
    aggs = [a for r in rules for a in (F.count_if(r.column() & ~F.col("_bad")), F.count_if(r.column() & F.col("_bad")))]
    row = rows.agg(*aggs).first()
    return [(row[2 * i], row[2 * i + 1]) for i in range(len(rules))]


def learn_rules(labelled: DataFrame, bad: Column, id_col: str = "doc_id") -> list[Rule]:
    """Decision list for texts where `bad` holds, from the statistics of `labelled`.

    Sequential covering: a rule grows on two thirds of the rows by the condition of most
    information gain, is cut back on the last third to the prefix that tells best, and stays
    if it is right there often enough; the rows it covers leave before the next. At most
    SAMPLE_ROWS rows, by a hash of the id, are learned from. Null labels are left out; without
    both kinds of rows the list is empty, which keeps all.
    """
    known = labelled.where(bad.isNotNull()).withColumn("_bad", bad).withColumn("_draw", F.pmod(F.xxhash64(id_col), F.lit(1 << 20)))
    n = known.count()
    share = min(1.0, SAMPLE_ROWS / max(n, 1))
    counts = [c for c in labelled.columns if c in STATISTICS]
    rows = stored(known.where(F.col("_draw") < int(share * (1 << 20)) + 1).select("_bad", "_draw", *counts), "labelled")
    points = [i / (THRESHOLDS + 1) for i in range(1, THRESHOLDS + 1)]
    made = features()
    both = rows.groupBy("_bad").agg(*[F.percentile(c, points).alias(f) for f, c in made.items()]).collect()
    if len(both) < 2:
        return []
    values = {f: sorted({v for r in both for v in r[f]}) for f in made}
    cuts = {f: [(a + b) / 2 for a, b in zip(v, v[1:])] for f, v in values.items()}
    grow, prune = rows.where("_draw % 3 != 0"), rows.where("_draw % 3 = 0")
    rules: list[Rule] = []
    while len(rules) < MAX_RULES:
        rest = ~F.lit(False) if not rules else verdict(rules)
        rule = _grow(grow.where(rest), cuts)
        if rule is None:
            break
        shorter = [Rule(rule.conditions[:k]) for k in range(1, len(rule.conditions) + 1)]
        tallies = _tally(prune.where(rest), shorter)
        worth = [(b - g) / (b + g) if b + g else -1.0 for g, b in tallies]
        k = max(range(len(shorter)), key=lambda i: (worth[i], -i))
        good, hit = tallies[k]
        if good + hit < LEAST_ROWS or hit < LEAST_PRECISION * (good + hit):
            break
        rules.append(shorter[k])
    return rules


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judged(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """`stats` with base_failed (under 50 words, or over half of them in repeated windows) and kept."""
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row (id_col, the statistics, base_failed, kept) for each of `docs`, by rules learned from `labels`.

    The statistics are computed once, stored, joined with the labels to learn, and judged. A
    label of 0 is bad, any other good. Null text: all counts 0, so base_failed. Labels without
    a document, null labels and null ids don't count; without labels only the base rules
    apply. Repeated rows are judged alike; a document with several labels is learned from
    with each. Other columns of both tables are not read. An empty table gives an empty result.
    """
    stats = stored(statistics(docs.select(id_col, text_col), text_col).drop(text_col), "statistics")
    labelled = stats.join(labels.select(id_col, F.col(label_col).alias("_label")), id_col)
    # texts that fail the base rules are dropped anyway
    return judged(stats, learn_rules(labelled.where(~base_failed()), F.col("_label") == 0, id_col))
