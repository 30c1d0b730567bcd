"""Split classes of suffix-array dedup: windows that only several shards together know to repeat."""

from collections import Counter

import pytest
from colloquy.llm import suffix_dedup

COPY = " ".join(f"w{i}" for i in range(30))
TEXTS = {
    "copies": [COPY] * 12,
    "shifted": [COPY] * 6 + [f"{i} {COPY} {i * 7}" for i in range(6)] + ["alone " * 3],
    "across": [f"{'p' * i}{COPY[: 60 + 7 * i]}{'q' * (i + 1)}" for i in range(20)] + ["\0" * 90, "x" + "\0" * 70],
}


def brute(texts):
    seen = Counter(t[i : i + 50] for t in texts for i in range(len(t) - 49))
    gone = [{j for i in range(len(t) - 49) if seen[t[i : i + 50]] > 1 for j in range(i, i + 50)} for t in texts]
    return [(d, "".join(x for j, x in enumerate(t) if j not in g).encode()) for d, (t, g) in enumerate(zip(texts, gone))]


@pytest.mark.parametrize("merge_windows", [500_000, 5])
@pytest.mark.parametrize("name", list(TEXTS))
def test_split_classes(spark, name, merge_windows):
    df = spark.createDataFrame(list(enumerate(TEXTS[name])), "doc_id long, text string").repartition(3)
    settled = suffix_dedup.settled_shards(df, 50, "doc_id", "text", shard_bytes=200, merge_windows=merge_windows)
    assert settled.where("merge is not null").count() > 0  # the class is split here
    if name == "across":  # and a window is found by the merge alone
        merged = settled.where("merge is not null").select("merge", "strings", "keys", "at").groupBy("merge").applyInArrow(suffix_dedup._merge(50), "merge int, block long, keys binary, docs binary, runs binary")
        assert merged.count() > 0
    got = suffix_dedup.dedup_strings(df, window=50, shard_bytes=200, merge_windows=merge_windows).collect()
    assert sorted((r.doc_id, bytes(r.kept_bytes)) for r in got) == brute(TEXTS[name])
