import datetime
import json
import time

import numpy as np
from colloquy.operators import external, sequences
from colloquy.streaming import jobs, progress
from pyspark.sql import functions as F


def put(spark, rows, path):
    spark.createDataFrame(rows, "id string, at timestamp").coalesce(1).write.mode("append").json(path)


def test_resumable_log_does_each_key_once(spark, tmp_path):
    source, log, mark = (str(tmp_path / x) for x in ("in", "log", "mark"))
    seen = []

    def work(items):
        seen.append(items.count())
        return items.withColumn("done", F.lit(True))

    for ids in ("ab", "bc", "abc"):
        put(spark, [(i, None) for i in ids], source)
        jobs.resumable(spark, source, "id string, at timestamp", work, log, mark).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(log).collect()) == ["a", "b", "c"]
    assert seen[:2] == [2, 1] and sum(seen) == 3
    jobs.resumable(spark, source, "id string, at timestamp", work, log, mark).awaitTermination()
    assert sum(seen) == 3, "nothing new, nothing done"


def test_a_batch_that_is_run_again_adds_nothing(spark, tmp_path):
    source, log, mark = (str(tmp_path / x) for x in ("in", "log", "mark"))
    put(spark, [("a", None), ("b", None)], source)
    runs = []

    def work(items):
        runs.append(1)
        return items.withColumn("done", F.lit(len(runs)))

    jobs.resumable(spark, source, "id string, at timestamp", work, log, mark).awaitTermination()
    for f in (tmp_path / "mark" / "commits").iterdir():  # as if the driver had been lost before it took note of the batch
        f.unlink()
    jobs.resumable(spark, source, "id string, at timestamp", work, log, mark).awaitTermination()
    assert len(runs) == 2 and sorted((r.id, r.done) for r in spark.read.parquet(log).collect()) == [("a", 2), ("b", 2)]


def test_failed_rows_come_again_in_a_later_run(spark, tmp_path):
    source, log, mark = (str(tmp_path / x) for x in ("in", "log", "mark"))
    put(spark, [("a", None), ("bad", None)], source)
    work = lambda items: items.withColumn("status", F.when((F.col("id") == "bad") & (F.col("attempt") < 3), "error").otherwise("ok"))
    for _ in range(5):
        jobs.resumable(spark, source, "id string, at timestamp", work, log, mark).awaitTermination()
    assert sorted((r.id, r.attempt, r.status) for r in spark.read.parquet(log).collect()) == [("a", 1, "ok"), ("bad", 1, "error"), ("bad", 2, "error"), ("bad", 3, "ok")]


def test_keys_are_forgotten_after_their_time(spark, tmp_path):
    source, log, mark = (str(tmp_path / x) for x in ("in", "log", "mark"))
    day = lambda d: datetime.datetime(2024, 1, d)
    work = lambda items: items
    for rows in ([("a", day(1))], [("a", day(2))], [("b", day(20))], [("a", day(21))]):
        put(spark, rows, source)
        jobs.resumable(spark, source, "id string, at timestamp", work, log, mark, known_for=("at", "5 days")).awaitTermination()
    assert sorted((r.id, r["at"].day) for r in spark.read.parquet(log).collect()) == [("a", 1), ("a", 21), ("b", 20)]


def test_counters_of_a_batch_equal_the_result(spark, tmp_path):
    def client_maker():
        def client(row):
            if row["id"] % 5 == 0:
                raise ValueError("no")
            time.sleep(0.01)
            return {"answer": row["id"]}

        return client

    counts, path = progress.tally(spark), str(tmp_path / "summary.json")
    df = external.called(spark.range(0, 200, 1, 8), client_maker, "answer long", concurrency=2, tally=counts)
    df, seen = progress.observed(df, "calls", errors=F.col("status") == "error")
    summaries = []
    with progress.Watch(spark, path, counts, selected=200, seconds=0.1) as watch:
        put, watch.summary = watch.summary, lambda final: summaries.append(put(final)) or summaries[-1]
        rows = df.collect()
    final = json.loads((tmp_path / "summary.json").read_text())
    errors = sum(r.status == "error" for r in rows)
    assert (len(rows), errors) == (200, 40) and seen.get == {"rows": 200, "errors": 40}
    assert final["final"] and final["counts"] == {"ok": 160, "error": 40, "attempts": 200} and final["tasks_done"] == final["tasks"] == 8
    assert final["remaining"] == 40 and final["per_second"] > 0 and any(not s["final"] for s in summaries)


def test_counters_of_a_stream_equal_the_result(spark, tmp_path):
    source, log, path = (str(tmp_path / x) for x in ("in", "log", "summary.json"))
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).coalesce(1).write.mode("append").json(source)
    listener = progress.StreamProgress(spark, path, "seen")
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).json(source).observe("seen", *progress.counters(odd=F.col("id") % 2 == 1))
        stream.writeStream.format("parquet").option("path", log).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        for _ in range(100):
            if (tmp_path / "summary.json").exists() and json.loads((tmp_path / "summary.json").read_text())["final"]:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    written = spark.read.parquet(log)
    said = json.loads((tmp_path / "summary.json").read_text())
    assert said == {"final": True, "batches": 3, "counts": {"rows": written.count(), "odd": written.where("id % 2 = 1").count()}}


def test_merged_stream(spark, tmp_path):
    schema = "recording string, pos int, utterance_id string, speaker_id string, start_sec double, end_sec double, text string"
    rows = [("r", i, f"u{i}", s, float(i), i + 1.0, s * 2) for i, s in enumerate("aabba")]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = jobs.merged_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("merged").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.utterance_id, r.text) for r in spark.table("merged").collect()) == [("u0", "aa aa"), ("u2", "bb bb")]


def test_windows_over_event_time(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "event_type", "value")
    assert jobs.windowed_activity(df).agg(F.sum("n")).first()[0] == df.count()


def test_greedy_stream_equals_the_batch_in_any_order_within_the_watermark(spark, tmp_path):
    rng = np.random.default_rng(3)
    schema, start = "recording string, at timestamp, n long, embedding array<float>", datetime.datetime(2024, 1, 1)
    centres = rng.normal(size=(6, 8))
    rows = [(r, start + datetime.timedelta(seconds=i // 2), i, [float(x) for x in centres[rng.integers(6)] + 0.15 * rng.normal(size=8)]) for r in ("r", "s") for i in range(60)]
    rows[7] = (*rows[7][:3], [0.0] * 8)
    want = set()
    for r in ("r", "s"):
        own = [x for x in rows if x[0] == r]
        kept = sequences.kept_greedily(np.array([np.float32(x[3]) for x in own], np.float64), 0.92)
        want |= {(x[0], x[1], x[2]) for x, k in zip(own, kept) if k}
    assert 10 < len(want) < 110
    for turn in range(2):
        source = str(tmp_path / f"in{turn}")
        come = sorted(rows, key=lambda x: x[1] + datetime.timedelta(seconds=float(rng.random() * 8)))
        end = [("end", start + datetime.timedelta(hours=1), 0, [1.0] * 8)]
        for at in range(0, len(come), 30):
            spark.createDataFrame(come[at : at + 30], schema).coalesce(1).write.mode("append").parquet(source)
        spark.createDataFrame(end, schema).coalesce(1).write.mode("append").parquet(source)
        stream = jobs.greedy_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), "recording", "at", "n", late="10 seconds")
        q = stream.writeStream.format("memory").queryName(f"greedy{turn}").option("checkpointLocation", str(tmp_path / f"c{turn}")).trigger(availableNow=True).start()
        q.awaitTermination()
        assert {(r.recording, r["at"], r.n) for r in spark.table(f"greedy{turn}").collect()} == want
