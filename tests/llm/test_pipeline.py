"""The pipeline's stages against brute force over the awkward fixture, and over empty tables."""

import re
from collections import Counter

import corpus_pipeline
import pytest
from colloquy.llm.language_id import learn
from pyspark.sql import functions as F

from test_brute import WORD, brute_components, order
from test_language import predicted

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
BENCH_WORD = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    unlabelled = [(20, "no label here but words enough to tell", None, "b", 4), (21, "w1 w2", "xx", "a", 5)]
    docs.select(COLUMNS).unionByName(spark.createDataFrame(unlabelled, docs.select(COLUMNS).schema)).write.parquet(f"{path}/documents.parquet")
    items = [(1, "W241 w242 w243 w244"), (2, " ".join(f"w{i}" for i in range(300, 330))), (None, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def rows(df):
    return [tuple(r) for r in df.select(COLUMNS).collect()]


def by_hand(spark, folder):
    """Rows after each of the first four stages."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = learn(docs.where(F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 != 1, F.lit(True))))
    told = [(d, t, predicted(model, t), s, n) for d, t, _, s, n in rows(docs)]
    out = [[r for r in told if r[2] != "und"]]
    kept = {d for d, _, root in brute_components([(order(r[0]), r[1]) for r in out[-1]], 5, 80) if d == root}
    out.append([r for r in out[-1] if order(r[0]) in kept])
    first = {}
    for d, t, *_ in sorted(out[-1], key=lambda r: order(r[0])):
        w = WORD.findall(t)
        for i in range(len(w) - 19):
            first[tuple(w[i : i + 20])] = min(first.get(tuple(w[i : i + 20]), (order(d), i)), (order(d), i))
    left = []
    for d, t, lang, s, _ in out[-1]:
        w = WORD.findall(t)
        gone = {j for i in range(len(w) - 19) if first[tuple(w[i : i + 20])] < (order(d), i) for j in range(i, i + 20)}
        t = " ".join(x for i, x in enumerate(w) if i not in gone) if gone else t
        left += [(d, t, lang, s, len(t))] if t or not gone else []
    out.append(left)
    windows = []
    for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect():
        w = BENCH_WORD.findall((r.text or "").translate(LOW))
        windows += [w[i : i + 13] for i in range(max(1, len(w) - 12))] if w else []
    clean = []
    for r in left:
        w = BENCH_WORD.findall(r[1].translate(LOW))
        hit = {j for x in windows for i in range(len(w) - len(x) + 1) if w[i : i + len(x)] == x for j in range(i, i + len(x))}
        clean += [] if hit and 20 * len(hit) >= len(w) else [r]
    out.append(clean)
    return out


def test_stages_and_run(spark, folder):
    want = by_hand(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "substring_dedup", "decontamination", "mixing"]
    before = rows(docs)
    for (name, stage), expected in zip(corpus_pipeline.STAGES, want):
        docs = stage(spark, docs, folder)
        assert sorted(rows(docs), key=str) == sorted(expected, key=str), name
        assert expected != before, name  # every stage changes something here
        docs, before = spark.createDataFrame(docs.collect(), docs.schema), expected
    ran = corpus_pipeline.run(spark, folder)
    copies = Counter(tuple(r)[:5] for r in ran.collect())
    assert set(copies) <= set(want[-1])
    words = Counter()
    for r in want[-1]:
        words[r[3]] += len(WORD.findall(r[1] or ""))
    taken = Counter()
    for r, n in copies.items():
        assert n <= 2 * Counter(want[-1])[r]
        taken[r[3]] += n * len(WORD.findall(r[1] or ""))
    assert all(taken[s] <= 2 * words[s] for s in words)


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_empty_tables(spark, docs, folder, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    got = stage(spark, docs.select(COLUMNS).limit(0), folder)
    assert got.count() == 0 and got.columns[:5] == COLUMNS
