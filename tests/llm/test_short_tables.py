"""Tables and slices that hold less text than one window."""

import pytest
from colloquy.llm import blocks, substring_dedup, suffix_dedup

LONG = " ".join(f"w{i}" for i in range(60))


@pytest.mark.parametrize("text", [None, "", "a few words"])
def test_a_table_of_one_short_text(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string").coalesce(1)
    words = substring_dedup.dedup_substrings(df).collect()
    assert [(r.kept_text, r.n_words, r.n_removed) for r in words] == [(text or "", len((text or "").split()), 0)]
    strings = suffix_dedup.dedup_strings(df).collect()
    assert [(bytes(r.kept_bytes), r.n_removed, r.n_spans) for r in strings] == [((text or "").encode(), 0, 0)]


def test_short_texts_in_slices_of_their_own(spark):
    big = " ".join(f"x{i}" for i in range(blocks.SLICE_BYTES // 7))
    assert len(big) > blocks.SLICE_BYTES
    df = spark.createDataFrame([(1, big + " " + LONG), (2, "short"), (3, LONG + " " + big), (4, None)], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r for r in substring_dedup.dedup_substrings(df).collect()}
    assert (got[1].n_removed, got[2].kept_text, got[4].kept_text) == (0, "short", "")
    assert got[3].n_removed == got[3].n_words
