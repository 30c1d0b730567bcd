"""Rules that small tables don't reach: long values, more rows than a run selected, intervals of any length."""

import base64
import random

from colloquy.functions import text as X
from colloquy.operators import intervals as I
from colloquy.operators import training as N
from colloquy.plans import fixtures
from colloquy.plans.registry import ORACLES, QUERIES
from oracle import SF, TABLES, assert_same
from pyspark.sql import functions as F


def folder(tmp_path, **tables):
    """A folder with these tables; views of the others are empty."""
    for name in TABLES:
        frame = tables.get(name)
        if frame is None:
            import pandas as pd

            frame = pd.DataFrame({"none": [0]})
        frame.to_parquet(tmp_path / f"{name}.parquet")
    return str(tmp_path)


def test_data_uris_have_no_line_breaks(spark):
    data = bytes(range(256)) * 3
    uri = spark.createDataFrame([(data,)], "data binary").select(X.data_uri(F.col("data"), F.lit("image/png"))).first()[0]
    assert uri == "data:image/png;base64," + base64.b64encode(data).decode()


def test_content_blocks_of_long_addresses(spark, tmp_path):
    import pandas as pd

    pages = pd.DataFrame({"page_id": range(4), "url": ["https://example.com/" + "a" * n for n in (36, 37, 38, 300)]})
    assert_same(spark, QUERIES["content_blocks"], ORACLES["content_blocks"], folder(tmp_path, pages=pages))


def test_counters_of_a_run_past_its_selection(spark):
    rows = spark.range(7).select(F.lit("parsed").alias("status"), F.lit(None).cast("string").alias("error"))
    r = N.run_counters(rows, 6, 3, 2.0, overrun=True).first()
    assert (r.completed_total, r.remaining, round(r.seconds_left, 6)) == (10, -4, -1.142857)
    assert N.run_counters(rows, 6, 3, 2.0).first().remaining == 0


def test_run_counters_over_more_turns_than_the_run_selected(spark, tmp_path):
    import pandas as pd

    k = pd.Series(range(100_040))
    turns = pd.DataFrame({"conv_id": k // 2, "turn": k % 2, "role": "user", "text": "Yes."})
    assert_same(spark, QUERIES["run_counters"], ORACLES["run_counters"], folder(tmp_path, conversations=turns))


def intervals(spark, n, seed):
    """Utterances, slides and cases of two recordings, some a million million seconds long, some without an end."""
    r = random.Random(seed)

    def some(i):
        start = r.choice([0.0, 100.0, 5e5, 1e12]) + r.randrange(4000) / 4
        return ("r" + str(i % 2), i, start, r.choice([None, start, *(start + x for x in (0.25, 30.0, 900.0, 1e5, 1e12))]))

    u, s = [some(i) for i in range(n)], [some(i) for i in range(n)]
    utterances = spark.createDataFrame([(k, i, i, a, b, f"w{i}") for k, i, a, b in u], "recording string, pos int, utterance_id int, start_sec double, end_sec double, text string")
    slides = spark.createDataFrame([(k, i, i, i % 3, a, b) for k, i, a, b in s], "recording string, slide_id int, slide_pos int, label int, start_sec double, end_sec double")
    whole = lambda rows: [x for x in rows if x[3] is not None]
    return utterances, slides, whole(u), whole(s)


def shared(a, b):
    return min(a[3], b[3]) - max(a[2], b[2]) if a[0] == b[0] else 0


def test_slides_of_any_length_are_aligned(spark):
    utterances, slides, u, s = intervals(spark, 60, 1)
    got = {r.utterance_id: r.slide_id for r in I.align_max_overlap(utterances.where("end_sec is not null"), slides.where("end_sec is not null")).collect()}
    best = {x[1]: max(((shared(x, y), -y[1]) for y in s if shared(x, y) > 0), default=(0, None)) for x in u}
    assert got == {k: None if v[1] is None else -v[1] for k, v in best.items()}
    pairs = I.overlap_pairs(utterances, slides, "recording").select("utterance_id", "r_slide_id").collect()
    assert sorted(map(tuple, pairs)) == sorted((x[1], y[1]) for x in u for y in s if shared(x, y) > 0)


def test_contexts_of_slides_of_any_length(spark):
    utterances, slides, u, s = intervals(spark, 60, 2)
    got = {r.slide_id: r.context for r in I.slide_context(slides, utterances, back=60.0).collect()}
    near = lambda y: [f"w{x[1]}" for x in u if x[0] == y[0] and x[3] >= max(0.0, y[2] - 60) and x[2] <= y[3]]
    assert got == {r.slide_id: "" for r in slides.collect()} | {y[1]: " ".join(near(y)) for y in s}


def test_speakers_of_segments_of_any_length(spark):
    utterances, slides, u, s = intervals(spark, 60, 3)
    got = {r.utterance_id: r.label for r in I.most_overlapping_speaker(utterances, slides).collect()}
    times = {x[1]: {n: sum(shared(x, y) for y in s if y[1] % 3 == n and shared(x, y) > 0) for n in range(3)} for x in u}
    best = {k: max((t, -n) for n, t in v.items()) for k, v in times.items()}
    assert got == {r.utterance_id: None for r in utterances.collect()} | {k: -n if t > 0 else None for k, (t, n) in best.items()}


def test_cases_of_any_length(spark):
    utterances, cases, u, s = intervals(spark, 60, 4)
    got = I.within_cases(utterances, cases.withColumnRenamed("slide_id", "case_id")).select("utterance_id", "case_id").collect()
    assert sorted(map(tuple, got)) == sorted((x[1], y[1]) for x in u for y in s if x[0] == y[0] and x[2] >= y[2] and x[3] <= y[3])


def test_token_alignment_loads_no_second_tokenizer_for_one_side():
    from colloquy.llm.queries import BYTE_BPE, PIECE_BPE, TOKENIZERS
    from colloquy.llm.token_alignment import Tokenizers, aligned_chunks

    tok = Tokenizers(f"{TOKENIZERS}/{BYTE_BPE}", f"{TOKENIZERS}/{PIECE_BPE}")
    assert aligned_chunks(tok, ["one", "two"])["ok"].all() and "a" not in vars(tok)
    assert [tok.a.id_to_token(i) for i in range(tok.a_size)] and tok.a_size == tok.a.get_vocab_size()


def test_a_full_hash_range_takes_little_memory():
    import tracemalloc

    import numpy as np
    import pyarrow as pa
    from colloquy.llm import repeats as R

    n, r = R.RANGE_ANCHORS // 10, np.random.default_rng(1)
    rows = []
    for block in range(10):
        keys, cells, docs = r.integers(0, 2**62, n), r.integers(0, 2**32, n, dtype=np.uint32), np.arange(n, dtype=np.uint32)
        rows.append((0, block, keys.tobytes(), cells.tobytes(), docs.tobytes(), docs.tobytes(), *[b""] * 5))
    names = ["part", "block", "keys", "cells", "docs", "at", "twice", "times", "known", "known_docs", "known_at"]
    group = pa.Table.from_batches(list(R.as_rows(rows, names, [pa.int32(), pa.int64()] + [pa.binary()] * 9)))
    tracemalloc.start()
    R._repeated(group)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120 << 20


def test_scripts_of_one_way_take_no_rows_of_lengths():
    import time

    from colloquy.functions import edits as E

    a = [str(i) for i in range(100_000)]
    b = [w for i, w in enumerate(a) if i % 3 != 2 for w in ([w, "new"] if i % 7 == 3 else [w])]
    began = time.perf_counter()
    assert E.kept_words(a, b) == [(int(w), j) for j, w in enumerate(b) if w != "new"]
    assert time.perf_counter() - began < 1


def test_speaker_overlap_shuffles_events_once_for_a_side(spark):
    s = spark.newSession()
    s.conf.set("spark.sql.adaptive.enabled", "false")
    s.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = QUERIES["speaker_overlap"](s, SF)._jdf.queryExecution().executedPlan().toString()
    # Events for both sides and for the result's left join, both sides by stretch, pairs by label, labels by utterance.
    assert plan.count("- Exchange hashpartitioning") == 7


def test_utterances_of_events_at_one_time_and_without_a_user(spark, tmp_path):
    import pandas as pd

    k = pd.Series(range(400))
    at = pd.Timestamp("2024-01-01") + pd.to_timedelta((k * 7919 % 83) * 41_000_003, unit="us")
    kind = k.map(lambda i: ["view", "click", None, "view", "error"][i * 31 % 5])
    user = (k % 3).where(k % 10 > 0).astype("Int64")
    events = pd.DataFrame({"event_id": k, "ts": at.astype("datetime64[us]"), "user_id": user, "event_type": kind, "value": k / 4, "props": "p" + k.astype(str)})
    sf = folder(tmp_path, events=events)
    assert_same(spark, fixtures.utterances, f"WITH {fixtures.U} SELECT * FROM utt", sf)
    for name in ("speaker_overlap", "align_max_overlap"):
        assert_same(spark, QUERIES[name], ORACLES[name], sf)
