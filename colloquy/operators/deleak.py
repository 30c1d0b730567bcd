"""Checks that edited texts only lost words, as column conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.text import bound, tokens

#: Words that turn a statement round; a near copy that lost one is rejected.
NEGATORS = ["no", "not", "never", "none", "without", "cannot"]


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def unchanged(verdict: Column, before: Column, after: Column, removed: Column) -> Column:
    """A clean text is the same byte for byte and lists no removals."""
    return (verdict != "clean") | (before.eqNullSafe(after) & (F.coalesce(F.size(removed), F.lit(0)) == 0))


def removals_verbatim(before: Column, removed: Column) -> Column:
    return F.coalesce(F.forall(removed, lambda s: before.contains(s)), F.lit(True))


def is_subsequence(part: Column, text: Column) -> Column:
    """Whether the words of `part` stand in `text` in their order, others between them or not."""
    found = lambda wanted: F.aggregate(_words(text), F.lit(0), lambda i, w: F.when(F.get(wanted, i) == w, i + 1).otherwise(i)) == F.size(wanted)
    return bound(_words(part), found)


def captions_match(before: Column, after: Column) -> Column:
    """One entry a caption at the same place: kept ones equal, dropped ones empty."""
    same = F.zip_with(before, after, lambda b, a: F.when(a["verdict"] == "keep", b.eqNullSafe(a["final"])).when(a["verdict"] == "drop", F.coalesce(a["final"], F.lit("")) == "").otherwise(True))
    return (F.size(before) == F.size(after)) & F.forall(same, lambda x: F.coalesce(x, F.lit(False)))


def unmatched(inputs: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """Keys that one side lacks or has twice, with the side."""
    i, o = (x.groupBy(key).count().withColumnRenamed("count", n) for x, n in ((inputs, "n_in"), (outputs, "n_out")))
    joined = i.join(o, key, "full").na.fill(0, ["n_in", "n_out"])
    return joined.where((F.col("n_in") != 1) | (F.col("n_out") != 1))


def new_words(before: Column, after: Column, least: int = 4) -> Column:
    """Content words, those of `least` letters or more, that only the edited text has."""
    return F.filter(F.array_except(tokens(after), tokens(before)), lambda w: F.length(w) >= least)


def lost_negator(before: Column, after: Column) -> Column:
    """Whether an edit that keeps nine tenths of the words lost a word that negates."""
    a, b = tokens(before), tokens(after)
    negators = F.array(*map(F.lit, NEGATORS))
    near = F.size(F.array_intersect(a, b)) >= 0.9 * F.size(F.array_distinct(a))
    return near & (F.size(F.array_except(F.array_intersect(a, negators), b)) > 0)


def without_empty_sections(text: Column) -> Column:
    """The text without `## ` headings that another heading or the end follows."""
    return F.regexp_replace(text, r"(?m)^## [^\n]*\n\s*(?=^## |\z)", "")


def repair_holds(before: Column, after: Column) -> Column:
    """A repair is shorter and only leaves words out."""
    return (F.length(after) < F.length(before)) & is_subsequence(after, before)


def outside_vocabulary(edits: DataFrame, key: list[str], case: str, text: str, sources: DataFrame, least: int = 4) -> DataFrame:
    """(key, outside): content words of each edit that no source text of its case has, sorted.

    `sources` has rows (case, text): what a paraphrase may take its words from. Both sides meet as
    distinct words of a case, so a case with many texts or edits isn't one task. Null texts have no
    words; a null case is a case of its own, and one without sources allows no word. Rows that share
    a key are one edit.
    """
    content = lambda t: F.array_distinct(F.filter(tokens(t), lambda w: F.length(w) >= least))
    said = edits.select(*key, F.col(case).alias("_case"), F.explode_outer(content(F.col(text))).alias("_word"))
    known = sources.select(F.col(case).alias("_c"), F.explode(content(F.col("text"))).alias("_w")).distinct().withColumn("_known", F.lit(True))
    met = said.join(known, F.col("_case").eqNullSafe(F.col("_c")) & (F.col("_word") == F.col("_w")), "left")
    return met.groupBy(*key).agg(F.array_sort(F.collect_set(F.when(F.col("_known").isNull(), F.col("_word")))).alias("outside"))


def question_holds(verdict: Column, before: Column, after: Column, reason: Column, outside: Column | None = None) -> Column:
    """A trim is shorter, not empty, ends in a question mark and only leaves words out; a paraphrase differs, ends so and has no word `outside` its case's vocabulary; a drop is empty; both edits and drops give a reason."""
    final, given = F.coalesce(after, F.lit("")), F.coalesce(reason, F.lit("")) != ""
    trim = (F.length(final) < F.length(before)) & (final != "") & final.endswith("?") & is_subsequence(final, before) & given
    paraphrase = (final != before) & final.endswith("?") & given
    if outside is not None:
        paraphrase = paraphrase & (F.coalesce(F.size(outside), F.lit(0)) == 0)
    return F.when(verdict == "keep", after.isNull() | (after == before)).when(verdict == "trim", trim).when(verdict == "paraphrase", paraphrase).when(verdict == "drop", (final == "") & given).otherwise(False)


#: Audit classes; those that are repaired come last (fixed values).
AUDIT_CLASSES, REPAIRED_CLASSES = ["A", "B", "C", "D", "E"], ["C", "D", "E"]


def evidence_holds(found: Column, evidence: Column, edited: Column, record: Column) -> Column:
    """Whether an audit verdict is one of the classes and its evidence is quoted.

    Each `new_text` must stand in the edited text, each `where_supported` that isn't null in the
    record; classes other than A give evidence. Null texts hold no quote.
    """
    quoted = F.forall(evidence, lambda e: F.coalesce(edited.contains(e["new_text"]), F.lit(False)) & (e["where_supported"].isNull() | F.coalesce(record.contains(e["where_supported"]), F.lit(False))))
    return F.coalesce(found.isin(AUDIT_CLASSES), F.lit(False)) & F.coalesce(quoted, F.lit(True)) & F.coalesce((found == "A") | (F.size(evidence) > 0), F.lit(False))


def bottom_by_hash(rows: DataFrame, stratum: str, key: str, sizes: dict, otherwise: int, seed: str = "", spread: int = 256) -> DataFrame:
    """The rows of each stratum with the least hashes of `seed` and key: `sizes[stratum]` of them, or `otherwise`.

    The least of a union are the least of its parts' least, so the sample is the same for any
    partitions and reruns, and a larger sample holds a smaller one. Each stratum is first cut in
    `spread` parts of which no more than the sample goes on, so one with a third of all rows is no
    task of its own. A smaller stratum is taken whole; nulls are one; a null key hashes as empty text.
    Rows that share a key are tied, and which of them a full sample takes is open: keys are to be unique.
    """
    hashed = rows.withColumn("_h", F.sha2(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256))
    hashed = hashed.withColumn("_part", F.pmod(F.xxhash64("_h"), F.lit(spread)))
    wanted = F.lit(otherwise)
    for name, n in sizes.items():
        wanted = F.when(F.col(stratum) == name, n).otherwise(wanted)
    most = max([otherwise, *sizes.values()])
    for by in ([stratum, "_part"], [stratum]):
        hashed = hashed.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("_h"))).where((F.col("_n") <= most) & (F.col("_n") <= wanted)).drop("_n")
    return hashed.drop("_h", "_part")


def audit_sample(verdicts: DataFrame, stratum: str, key: str, sizes: dict, otherwise: int, seed: str = "") -> DataFrame:
    """What an auditor reads, with `kept`: every verdict but keeps, and of the keeps a sample of each stratum. A null verdict is no keep."""
    keep = F.coalesce(F.col("verdict") == "keep", F.lit(False))
    kept = bottom_by_hash(verdicts.where(keep), stratum, key, sizes, otherwise, seed)
    return verdicts.where(~keep).withColumn("kept", F.lit(False)).unionByName(kept.withColumn("kept", F.lit(True)))


def audit_report(verdicts: DataFrame, audited: DataFrame, stratum: str) -> DataFrame:
    """(stratum, keeps, sampled, repaired, rate): keeps in all, those that were audited with a class, and how many of these are to be repaired.

    The rate is of the sampled keeps; null where none was sampled. A null stratum is one of its own.
    """
    keeps = verdicts.groupBy(F.col(stratum).alias("_s")).agg(F.count_if(F.col("verdict") == "keep").alias("keeps"))
    read = audited.where(F.col("kept") & F.col("class").isNotNull()).groupBy(stratum).agg(F.count(F.lit(1)).alias("sampled"), F.count_if(F.col("class").isin(REPAIRED_CLASSES)).alias("repaired"))
    joined = keeps.join(read, F.col("_s").eqNullSafe(F.col(stratum)), "left").na.fill(0, ["sampled", "repaired"])
    return joined.select(F.col("_s").alias(stratum), "keeps", "sampled", "repaired", F.try_divide("repaired", "sampled").alias("rate"))


def audit_rates(samples: DataFrame, stratum: str, found: str, classes: list[str]) -> DataFrame:
    """Share of each audit class in each stratum; rows of another class fail the check column."""
    rows = samples.withColumn("valid", F.col(found).isin(classes))
    return rows.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("valid")).alias("invalid"), *[F.avg((F.col(found) == c).cast("double")).alias(f"rate_{c.lower()}") for c in classes])
