"""Counters of work that is still going on: of a batch by tasks and tallies, of a stream by its listener."""

from __future__ import annotations

import json
import threading
import time
import uuid

from pyspark.accumulators import AccumulatorParam
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener


class _Adds(AccumulatorParam):
    def zero(self, value: dict) -> dict:
        return {}

    def addInPlace(self, a: dict, b: dict) -> dict:
        for k, v in b.items():
            a[k] = a.get(k, 0) + v
        return a


def tally(spark: SparkSession):
    """An accumulator of named counts, which tasks add to while a job runs; a task's counts arrive with its end."""
    return spark.sparkContext.accumulator({}, _Adds())


def counters(**of: Column) -> list[Column]:
    """Rows for which each condition holds, and all rows, as metrics to observe."""
    return [F.count(F.lit(1)).alias("rows"), *(F.coalesce(F.count_if(c), F.lit(0)).alias(k) for k, c in of.items())]


def observed(df: DataFrame, name: str, **of: Column) -> tuple[DataFrame, Observation]:
    """`df`, and the counts of its rows once an action has gone through it; nothing is computed twice for them."""
    seen = Observation(name)
    return df.observe(seen, *counters(**of)), seen


def put(spark: SparkSession, path: str, value: dict) -> None:
    """`value` as a JSON file, which readers see whole: it is written beside its place and renamed onto it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    beside = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = system.create(beside, True)
    try:
        out.write(bytearray(json.dumps(value).encode()))
    finally:
        out.close()
    if not system.rename(beside, target):
        system.delete(target, False)
        system.rename(beside, target)


class Watch:
    """Writes a summary to `path` every `seconds` while the jobs inside of it run, and a final one.

    The summary has the tasks done and all tasks known so far, what `counts` has been told, the
    resumed and selected rows given, and of these the rate a second and the seconds still to go, by
    the count named `done`.
    """

    def __init__(self, spark: SparkSession, path: str, counts=None, done: str = "ok", selected: int | None = None, resumed: int = 0, seconds: float = 10.0):
        self.spark, self.path, self.counts, self.done = spark, path, counts, done
        self.selected, self.resumed, self.seconds = selected, resumed, seconds
        self.group, self.ended = f"watch-{uuid.uuid4().hex}", threading.Event()

    def summary(self, final: bool) -> dict:
        tracker = self.spark.sparkContext.statusTracker()
        stages = {s for j in tracker.getJobIdsForGroup(self.group) for s in getattr(tracker.getJobInfo(j), "stageIds", ())}
        known = [i for i in map(tracker.getStageInfo, stages) if i]
        counts, elapsed = dict(self.counts.value) if self.counts else {}, time.monotonic() - self.began
        rate = counts.get(self.done, 0) / elapsed if elapsed else 0.0
        left = max(0, self.selected - self.resumed - counts.get(self.done, 0)) if self.selected is not None else None
        return {
            "final": final, "tasks_done": sum(i.numCompletedTasks for i in known), "tasks": sum(i.numTasks for i in known), "counts": counts, "selected": self.selected, "resumed": self.resumed,
            "elapsed_seconds": elapsed, "per_second": rate, "remaining": left, "remaining_seconds": left / rate if left is not None and rate else None,
        }

    def _run(self) -> None:
        while not self.ended.wait(self.seconds):
            put(self.spark, self.path, self.summary(False))

    def __enter__(self) -> Watch:
        self.began = time.monotonic()
        self.spark.sparkContext.setJobGroup(self.group, f"watched in {self.path}")
        self.thread = threading.Thread(target=self._run, daemon=True)
        self.thread.start()
        return self

    def __exit__(self, *failure) -> None:
        self.ended.set()
        self.thread.join()
        self.spark.sparkContext._jsc.clearJobGroup()
        put(self.spark, self.path, self.summary(True))


class StreamProgress(StreamingQueryListener):
    """Adds up the metrics that a stream observes under `name`, and writes them to `path` after each batch and at the end."""

    def __init__(self, spark: SparkSession, path: str, name: str):
        self.spark, self.path, self.name = spark, path, name
        self.totals: dict[str, int] = {}
        self.batches, self.seen = 0, set()

    def _put(self, final: bool) -> None:
        put(self.spark, self.path, {"final": final, "batches": self.batches, "counts": self.totals})

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row, batch = event.progress.observedMetrics.get(self.name), (event.progress.id, event.progress.batchId)
        if row is None or batch in self.seen:
            return
        self.seen.add(batch)
        self.batches += 1
        for k, v in row.asDict().items():
            self.totals[k] = self.totals.get(k, 0) + v
        self._put(False)

    def onQueryTerminated(self, event) -> None:
        self._put(True)
