"""Streaming forms: a log that goes on where it stopped, and merged runs of speakers as they arrive."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def resumable(spark: SparkSession, source: str, schema: str, work, log: str, checkpoint: str, key: str = "id", files_at_once: int = 8, most_attempts: int = 3, known_for: tuple[str, str] | None = None) -> StreamingQuery:
    """Runs `work` over new JSON lines below `source` and puts its rows into `log`, each key once.

    Keys that came before are held in the stream's state store, so no batch reads the log, and a
    batch costs what is new in it. With `known_for`, a time column and an interval, a key is forgotten
    once the watermark has passed it by that much; else none is. A batch's rows are a partition of
    `log` that a batch run again writes anew, so what is run again adds nothing.

    Rows that `work` gives the status `error` are written below `source` once more with the next
    number in `attempt`, up to `most_attempts` of them, and a later run finds them there. `schema` and
    the rows of `work` must have the columns of the items; `attempt` is added and counts from 1.
    """
    kept = [c.strip().split(" ")[0] for c in schema.split(",")]

    def batch(items: DataFrame, number: int) -> None:
        path = f"{log}/batch={number}"
        work(items).write.mode("overwrite").parquet(path)
        done = items.sparkSession.read.parquet(path)
        if "status" in done.columns:
            failed = done.where((F.col("status") == "error") & (F.col("attempt") < most_attempts)).select(*kept, (F.col("attempt") + 1).alias("attempt"))
            if not failed.isEmpty():
                failed.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{source}/again-{number}")

    stream = spark.readStream.schema(f"{schema}, attempt int").option("maxFilesPerTrigger", files_at_once).option("recursiveFileLookup", True).json(source)
    stream = stream.withColumn("attempt", F.coalesce("attempt", F.lit(1)))
    if known_for:
        stream = stream.withWatermark(*known_for).dropDuplicatesWithinWatermark([key, "attempt"])
    else:
        stream = stream.dropDuplicates([key, "attempt"])
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


RUN_ROWS = "recording string, speaker_id string, utterance_id string, start_sec double, end_sec double, text string"


def _extend(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Rows of one recording, in order of pos in each batch; a run goes out when another speaker begins, or none."""
    names = ["speaker_id", "utterance_id", "start_sec", "end_sec", "text"]
    run = list(state.get) if state.exists else None
    out = []
    rows = pd.concat(list(pdfs)).sort_values("pos", kind="stable")
    for row in rows[names].itertuples(index=False):
        if run is not None and run[0] == row.speaker_id:
            run[3], run[4] = row.end_sec, f"{run[4]} {row.text}"
            continue
        if run is not None:
            out.append(run)
        run = list(row) if row.speaker_id is not None else None
    if run is not None:
        state.update(tuple(run))
    elif state.exists:
        state.remove()
    if out:
        yield pd.DataFrame([[key[0], *r] for r in out], columns=["recording", *names])


def merged_stream(utterances: DataFrame) -> DataFrame:
    """A stream of merged runs of speakers of each recording; the open run waits for its next row.

    A row without a speaker ends the open run, so a source can close a recording. There is no
    timeout: one would keep a stream that only takes what is there from ever ending.
    """
    state = "speaker_id string, utterance_id string, start_sec double, end_sec double, text string"
    return utterances.groupBy("recording").applyInPandasWithState(_extend, RUN_ROWS, state, "append", GroupStateTimeout.NoTimeout)


def windowed_activity(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows and sums of each kind in windows of event time; what comes later than `late` drops out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def _unlike(threshold: float):
    """Holds a group's rows until the watermark has passed them, then takes them in order of time and number, as the batch form does."""

    def run(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        width, kept, micros, numbers, held = state.get if state.exists else (0, b"", [], [], b"")
        micros, numbers = list(micros), list(numbers)
        rows = [] if state.hasTimedOut else [p for p in pdfs if len(p)]
        vectors = [np.array(p["_vector"].tolist(), np.float64) for p in rows]
        width = width or next((v.shape[1] for v in vectors), 0)
        kept, held = (np.frombuffer(x).reshape(-1, max(width, 1)) for x in (kept, held))
        held = np.concatenate([held, *vectors])
        for p in rows:
            micros += p["_micros"].tolist()
            numbers += p["_number"].tolist()
        order = np.lexsort((numbers, micros))
        passed = [i for i in order if micros[i] < state.getCurrentWatermarkMs() * 1000]
        out, chosen = [], list(kept)
        for i in passed:
            norm = np.linalg.norm(held[i])
            unit = held[i] / (norm or 1)
            if not chosen or (np.array(chosen) @ unit).max() < threshold:
                chosen.append(unit)
                out.append((key[0], micros[i], numbers[i]))
        left = np.setdiff1d(np.arange(len(micros)), passed)
        state.update((width, np.array(chosen, np.float64).tobytes(), [micros[i] for i in left], [numbers[i] for i in left], held[left].tobytes()))
        if len(left):
            state.setTimeoutTimestamp(max(min(micros[i] for i in left) // 1000, state.getCurrentWatermarkMs()) + 1)
        if out:
            yield pd.DataFrame(out, columns=["_group", "_micros", "_number"])

    return run


def greedy_stream(crops: DataFrame, group: str, at: str, number: str, vector: str = "embedding", threshold: float = 0.92, late: str = "1 minute") -> DataFrame:
    """(group, at, number) of the rows of a stream that a scan of each group by time, and number in ties, keeps: those unlike all kept before.

    Rows wait in the group's state until the watermark, `late` behind the latest time seen, has passed
    them, so the result is the batch's whatever order they come in within that; what comes later still
    drops out. A group's state holds the vectors kept and the rows that wait, so it is as large as
    what its recording shows. Vectors of a group have one length; null vectors and times drop out.
    """
    rows = crops.where(F.col(vector).isNotNull() & F.col(at).isNotNull()).withWatermark(at, late)
    rows = rows.select(F.col(group).cast("string").alias("_group"), at, F.unix_micros(at).alias("_micros"), F.col(number).cast("long").alias("_number"), F.col(vector).cast("array<double>").alias("_vector"))
    state = "width int, kept binary, micros array<long>, numbers array<long>, held binary"
    kept = rows.groupBy("_group").applyInPandasWithState(_unlike(threshold), "_group string, _micros long, _number long", state, "append", GroupStateTimeout.EventTimeTimeout)
    return kept.select(F.col("_group").alias(group), F.timestamp_micros("_micros").alias(at), F.col("_number").alias(number))
