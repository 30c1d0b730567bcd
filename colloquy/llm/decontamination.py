"""Benchmark decontamination with a distributed positional inverted index, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.shared import let, small, stored

#: Words before A-Z are lower-cased: ASCII letters, digits and all characters beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Terms of each window, from the rarest on, whose posting lists are intersected.
TERMS = 2
#: Marks that the keys of candidate texts are mapped to; as many rows are broadcast at most.
MARKS = 1 << 18


def lowered(word: Column) -> Column:
    """A-Z to a-z; other characters stay, also those that `lower` would change."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _tokens(keyed: DataFrame, text_col: str) -> DataFrame:
    """(_key, pos, word) for each word of each text."""
    return keyed.select("_key", F.posexplode(words_of(F.col(text_col))).alias("pos", "word")).withColumn("word", lowered(F.col("word")))


def windows_of(items: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """(item, words) for each window of `window` words of each item; a shorter item is one window."""
    words = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.transform(words_of(F.col(text_col)), lowered).alias("all")).where(F.size("all") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - (window - 1), F.lit(1)))
    return words.withColumn("start", F.explode(starts)).select("item", F.slice("all", F.col("start"), window).alias("words"))


def posting_index(keyed: DataFrame, terms: DataFrame, count: int, text_col: str) -> DataFrame:
    """Stored posting lists (word, _key, pos) of `terms`, over all texts."""
    tokens = _tokens(keyed, text_col)
    return stored(tokens.join(small(terms.select("word"), count, 64), "word"), "postings")


def window_terms(keyed: DataFrame, windows: DataFrame, text_col: str) -> DataFrame:
    """Stored (words, lists) for each window (distinct) all of whose words stand in some text: its TERMS rarest terms as (n, offset, word)."""
    terms = windows.select("words", F.posexplode("words").alias("offset", "word"))
    vocabulary = stored(terms.select("word").distinct(), "vocabulary")
    counted = _tokens(keyed, text_col).join(small(vocabulary, vocabulary.count(), 64), "word").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    counts = stored(counted, "term-counts")
    # a window with a word that no text has doesn't occur; it falls out for want of a rank
    ranked = terms.join(small(counts, counts.count(), 64), "word", "left")
    order = F.array_sort(F.collect_list(F.struct("n", "offset", "word")))
    lists = ranked.groupBy("words").agg(order.alias("lists"), F.count("n").alias("known")).where(F.col("known") == F.size("words"))
    return stored(lists.select("words", F.slice("lists", 1, TERMS).alias("lists")), "window-terms")


def postings_of(keyed: DataFrame, lists: DataFrame, text_col: str) -> DataFrame:
    """Stored posting lists (word, _key, pos) of the windows' chosen terms."""
    chosen = stored(lists.select(F.explode("lists.word").alias("word")).distinct(), "chosen-terms")
    return posting_index(keyed, chosen, chosen.count(), text_col)


def anchored(lists: DataFrame, postings: DataFrame) -> DataFrame:
    """(_key, pos, words, lists) for each place of the rarest term of each window."""
    first = lists.withColumn("word", F.col("lists")[0]["word"])
    return postings.join(small(first, lists.count(), 512), "word").select("_key", "pos", "words", "lists")


def nth_term(k: int) -> Column:
    """The k-th of a window's chosen terms; the first again where it has fewer."""
    return F.coalesce(F.get("lists", F.lit(k)), F.col("lists")[0])


def hits_of(keyed: DataFrame, lists: DataFrame, postings: DataFrame, text_col: str) -> DataFrame:
    """Stored (_key, start, words) for each place where the words of one of the windows stand."""
    found = anchored(lists, postings).withColumn("start", F.col("pos") - F.col("lists")[0]["offset"]).where("start >= 0")
    for k in range(1, TERMS):
        other = postings.select("_key", F.col("word").alias("_word"), F.col("pos").alias("_pos"))
        placed = found.withColumns({"_word": nth_term(k)["word"], "_pos": F.col("start") + nth_term(k)["offset"]})
        found = placed.join(other, ["_key", "_word", "_pos"], "left_semi").drop("_word", "_pos")
    found = stored(found.select("_key", "start", "words").distinct(), "candidates")
    # the remaining terms are compared where they stand in the text; of the other texts nearly none moves
    places = stored(found.groupBy("_key").agg(F.collect_list(F.struct("start", "words")).alias("places")), "places")
    mark = F.pmod(F.xxhash64("_key"), F.lit(MARKS))
    marks = stored(found.select(mark.alias("_mark")).distinct(), "marks")
    texts = keyed.select("_key", text_col, mark.alias("_mark")).join(F.broadcast(marks), "_mark", "left_semi").select("_key", text_col).join(places.hint("shuffle_hash"), "_key")
    holds = let(F.transform(words_of(F.col(text_col)), lowered), lambda words: F.filter(F.col("places"), lambda p: F.slice(words, p["start"] + 1, F.size(p["words"])) == p["words"]))
    kept = texts.select("_key", F.explode(holds).alias("p")).select("_key", "p.start", "p.words")
    return stored(kept.distinct(), "hits")


def near_of(keyed: DataFrame, lists: DataFrame, postings: DataFrame, near: int, text_col: str) -> DataFrame:
    """Stored (_key, words) for each window all of whose words stand, in any order, in some `near` words in a row of a text.

    Such a stretch holds a place of the rarest term with the other chosen terms less than `near`
    words away. Their places are met by stretches, so a frequent term costs its postings and not
    their pairs; what is left is looked for in the texts themselves, with all of its words.
    """
    found = anchored(lists, postings)
    for k in range(1, TERMS):
        other = postings.select("_key", F.col("word").alias("_word"), F.floor(F.col("pos") / near).alias("_stretch"), F.col("pos").alias("_pos"))
        stretch = F.floor(F.col("pos") / near)
        spread = found.withColumns({"_word": nth_term(k)["word"], "_stretch": F.explode(F.array(stretch - 1, stretch, stretch + 1))}).alias("a")
        b = other.alias("b")
        same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("_key", "_word", "_stretch")]
        found = spread.join(b, [*same, F.abs(F.col("a.pos") - F.col("b._pos")) < near], "left_semi").select("_key", "pos", "words", "lists").distinct()
    places = stored(found.groupBy("_key").agg(F.collect_set(F.struct("pos", "words")).alias("places")), "near-places")
    marks = stored(places.select(F.pmod(F.xxhash64("_key"), F.lit(MARKS)).alias("_mark")).distinct(), "near-marks")
    marked = keyed.select("_key", text_col, F.pmod(F.xxhash64("_key"), F.lit(MARKS)).alias("_mark"))
    texts = marked.join(F.broadcast(marks), "_mark", "left_semi").select("_key", text_col).join(places.hint("shuffle_hash"), "_key")

    def holds(words: Column, p: Column) -> Column:
        inside = lambda start, n: F.size(F.array_except(p["words"], F.slice(words, start + 1, n))) == 0
        low = F.greatest(p["pos"] - (near - 1), F.lit(0))
        return inside(low, F.lit(2 * near - 1)) & F.exists(F.sequence(low, p["pos"]), lambda start: inside(start, F.lit(near)))

    held = let(F.transform(words_of(F.col(text_col)), lowered), lambda words: F.filter("places", lambda p: holds(words, p)))
    return stored(texts.select("_key", F.explode(held).alias("p")).select("_key", "p.words").distinct(), "near")


def by_text(found: DataFrame, item_windows: DataFrame, name: str) -> DataFrame:
    """(_key, `name`: sorted ids of the items whose windows are among `found` (_key, words))."""
    named = found.select("_key", "words").distinct().join(item_windows.distinct(), "words").select("_key", "item").distinct()
    return named.groupBy("_key").agg(F.array_sort(F.collect_list("item")).alias(name))


def contamination(docs: DataFrame, items: DataFrame, window: int = 13, percent: int = 5, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", near: int | None = None) -> DataFrame:
    """`docs` with n_words, n_hit, items (sorted item ids as strings) and contaminated.

    A-Z are lower-cased; words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`. A window is `window`
    words in a row of an item; an item of fewer, but not none, is one window. Words of a text
    in any occurrence of a window are hit; a text is contaminated if its hit words are
    `percent` hundredths of its words or more, and any are.

    The texts' words are counted for the terms of the windows; the posting lists (text,
    position) of each window's rarest terms are built over all texts, and intersected after
    each position is moved back by the term's place in the window; what is left is compared
    word by word. No text is cut, and no list is capped.

    With `near`, a column near_items holds the ids of items with a proximity match: all words of one
    of their windows stand, in any order and others between them, in `near` words in a row (`window`
    at least). It comes from the same posting lists, takes no part in the verdict, and holds all of
    items.

    Null or empty text: no words, not contaminated. Null items or ones without words have no
    window; a null item id is written as an empty one. Rows alike in id and text have equal
    results. Empty tables give empty results, or results without hits. Columns of `docs` with a
    result's name are replaced; names that begin with `_` are reserved.
    """
    keyed = docs.withColumn("_key", F.struct(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("hash")))
    item_windows = stored(windows_of(items, window, item_id, item_text), "item-windows")
    texts = keyed.select("_key", text_col).where(F.col(text_col).isNotNull())
    lists = window_terms(texts, item_windows.select("words").distinct(), text_col)
    postings = postings_of(texts, lists, text_col)
    hits = hits_of(texts, lists, postings, text_col)
    spans = hits.select("_key", "start", (F.col("start") + F.size("words")).alias("end"))
    before = F.max("end").over(Window.partitionBy("_key").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.col("end") - F.greatest(F.col("start"), F.coalesce(before, F.lit(0))), F.lit(0))
    n_hit = spans.select("_key", fresh.alias("n")).groupBy("_key").agg(F.sum("n").cast("long").alias("_n_hit"))
    found = n_hit.join(by_text(hits, item_windows, "_items"), "_key")
    if near is not None:
        found = found.join(by_text(near_of(texts, lists, postings, max(near, window), text_col), item_windows, "_near_items"), "_key", "full")
    found = stored(found, "contaminated")
    n_bytes = found.agg(F.sum(sum(F.coalesce(F.size(c), F.lit(0)) * 32 for c in found.columns if c.endswith("_items")) + 128)).first()[0] or 0
    joined = keyed.join(small(found, 1, n_bytes), "_key", "left")
    n_words = F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")
    results = {
        "n_words": n_words,
        "n_hit": F.coalesce("_n_hit", F.lit(0).cast("long")),
        "items": F.coalesce("_items", F.array().cast("array<string>")),
    }
    if near is not None:
        results["near_items"] = F.coalesce("_near_items", F.array().cast("array<string>"))
    out = joined.withColumns(results).withColumn("contaminated", (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words")))
    return out.select(*(c for c in docs.columns if c not in (*results, "contaminated")), *results, "contaminated")
