"""The boundary to models: speech, vision and language calls are plugged in, never rebuilt.

A client is a function from one row (a dict) to a dict, or from a list of rows to a list of dicts
where calls take several; it is made once a task and called from several threads. What a failed
call does to its row is said by a rule, one for each kind of call.
"""

from __future__ import annotations

import json
import random
import threading
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

Client = Callable[[Any], Any]

#: Rows that go out together, and seconds after which fewer do.
OUT_ROWS, OUT_SECONDS = 256, 2.0
#: Columns that every call adds to the client's.
OUTCOME = "attempts int, status string, error string, latency_seconds double"


class Transient(Exception):
    """A failure that may pass: too many requests, a server's error, a timeout."""


class CallFailed(Exception):
    """A failed call whose rule ends the job."""


class Rule(NamedTuple):
    """What happens to a row whose call failed for good, and how often it is tried before.

    `failure`: `mark` keeps the row without the client's columns, `fill` keeps it with the values of
    `filler`, `skip` leaves it out, so that a later run finds it still to do, and `raise` ends the job.
    Only transient failures are tried again unless `retry_all`; the pause before try n + 1 is
    2 ** (n - 1) seconds, up to a second more by chance, and 30 at most, times `pause`.
    """

    failure: str = "mark"
    filler: dict = {}
    tries: int = 1
    pause: float = 1.0
    retry_all: bool = False

    def seconds(self, tried: int) -> float:
        return self.pause * min(30.0, 2 ** (tried - 1) + random.random())


#: The rule of each kind of call.
RULES = {
    "classify": Rule("skip"),
    "segment": Rule("raise"),
    "roles": Rule("raise"),
    "verify_slides": Rule("fill", {"keep": True}),
    "caption": Rule("fill", {"caption": ""}),
    "summarize": Rule("fill", {"summary": ""}),
    "questions": Rule("skip"),
    "conclude": Rule("skip"),
    "repair": Rule("mark"),
    "generate": Rule("mark", tries=4),
    "generate_with_images": Rule("mark", tries=4, pause=0.0, retry_all=True),
    "judge": Rule("mark", tries=4),
}


class Pace:
    """At most `per_second` calls a second over all threads of a task, retries included; None doesn't limit."""

    def __init__(self, per_second: float | None):
        self.gap, self.free, self.lock = 1 / per_second if per_second else 0.0, 0.0, threading.Lock()

    def wait(self, stop: threading.Event) -> None:
        if not self.gap:
            return
        with self.lock:
            now = time.monotonic()
            self.free = max(self.free, now) + self.gap
            ahead = self.free - self.gap - now
        stop.wait(ahead)


class Outcome(NamedTuple):
    reply: Any
    attempts: int
    error: str | None
    seconds: float


def tried(client: Client, asked: Any, read: Callable[[Any], Any], rule: Rule, pace: Pace, stop: threading.Event) -> Outcome:
    """The client's reply as `read` takes it, after as many tries as the rule allows; a stop ends the pauses and the tries."""
    began, error, n = time.perf_counter(), "stopped before the call", 0
    while n < rule.tries and not stop.is_set():
        n += 1
        pace.wait(stop)
        if stop.is_set():
            break
        try:
            return Outcome(read(client(asked)), n, None, time.perf_counter() - began)
        except Exception as e:
            error = f"{type(e).__name__}: {e}"
            if not (rule.retry_all or isinstance(e, Transient)):
                break
        if n < rule.tries:
            stop.wait(rule.seconds(n))
    return Outcome(None, n, error, time.perf_counter() - began)


def in_flight(items: Iterator, work: Callable[[Any], Any], concurrency: int) -> Iterator[tuple[Any, Any]]:
    """(item, result of `work`) as calls end, in whatever order, with `concurrency` threads.

    Twice as many items are taken from the source at most, so a slow client holds the source back.
    Every item taken comes out. None of them has begun by the time this is closed early but those
    that threads are at; the others are given up with it.
    """
    waiting: dict[Future, Any] = {}
    pool = ThreadPoolExecutor(concurrency)
    try:
        source, more = iter(items), True
        while more or waiting:
            while more and len(waiting) < 2 * concurrency:
                try:
                    item = next(source)
                except StopIteration:
                    more = False
                    break
                waiting[pool.submit(work, item)] = item
            done, _ = wait(waiting, timeout=OUT_SECONDS, return_when=FIRST_COMPLETED)
            if not done:
                yield None, None  # lets the caller send what it holds
            for future in done:
                yield waiting.pop(future), future.result()
    finally:
        pool.shutdown(wait=False, cancel_futures=True)


class Asked(NamedTuple):
    """Rows of one batch that one call is about."""

    batch: pa.RecordBatch
    places: list[int]


def _asked(batches: Iterator[pa.RecordBatch], rows_a_call: int) -> Iterator[Asked]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows_a_call):
            yield Asked(batch, list(range(at, min(at + rows_a_call, batch.num_rows))))


def called(df: DataFrame, make_client: Callable[[], Client], schema: str, rule: Rule = RULES["generate"], concurrency: int = 16, per_second: float | None = None, rows_a_call: int = 1, tally=None) -> DataFrame:
    """`df` with the client's columns, attempts, status (`ok` or `error`), error and latency_seconds.

    Each task keeps `concurrency` calls going, over the borders of Arrow batches, and rows come out
    as their calls end. `per_second` bounds each task's calls, retries included. With `rows_a_call`
    over 1 the client is given a list of rows and must return as many dicts; any other reply is a
    failure of all of them. A reply that doesn't fit `schema` is a failure too. Rows of a failed
    call go as `rule` says. Null values are given to the client as None, and an empty table
    makes no call. A `tally` (see `streaming.progress`) is told of each row that is `ok` or an
    `error`, and of attempts.
    """
    made = T.StructType.fromDDL(schema)
    names, kinds = made.fieldNames(), list(to_arrow_schema(made).types)
    out = T.StructType([*df.schema.fields, *made.fields, *T.StructType.fromDDL(OUTCOME).fields])
    filler = [rule.filler.get(n) for n in names]
    many = rows_a_call > 1

    def read(reply: Any, rows: int) -> list[list]:
        replies = reply if many else [reply]
        if not isinstance(replies, list) or len(replies) != rows or not all(isinstance(r, dict) for r in replies):
            raise ValueError(f"{rows} replies were asked for, not {reply!r:.200}")
        values = [[r.get(n) for n in names] for r in replies]
        for value in values:
            for v, kind in zip(value, kinds):
                pa.scalar(v, kind)
        return values

    def sent(held: list[tuple[Asked, Outcome]]) -> Iterator[pa.RecordBatch]:
        by_batch: dict[int, list[tuple[Asked, Outcome]]] = {}
        for asked, outcome in held:
            by_batch.setdefault(id(asked.batch), []).append((asked, outcome))
        for ended in by_batch.values():
            batch, places, rows = ended[0][0].batch, [], []
            for asked, o in ended:
                if o.error and rule.failure == "skip":
                    continue
                places += asked.places
                rows += [[*v, o.attempts, "error" if o.error else "ok", o.error, o.seconds] for v in o.reply or [filler] * len(asked.places)]
            if rows:
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), [*kinds, pa.int32(), pa.string(), pa.string(), pa.float64()])]
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(places)).columns, *columns], names=out.fieldNames())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client, pace, stop = make_client(), Pace(per_second), threading.Event()

        def work(asked: Asked) -> Outcome:
            rows = asked.batch.take(pa.array(asked.places)).to_pylist()
            return tried(client, rows if many else rows[0], lambda reply: read(reply, len(rows)), rule, pace, stop)

        held, since = [], time.monotonic()
        try:
            for asked, outcome in in_flight(_asked(batches, rows_a_call), work, concurrency):
                if outcome is not None:
                    if outcome.error and rule.failure == "raise":
                        raise CallFailed(outcome.error)
                    held.append((asked, outcome))
                    if tally is not None:
                        tally.add({"error" if outcome.error else "ok": len(asked.places), "attempts": outcome.attempts})
                if held and (len(held) * rows_a_call >= OUT_ROWS or time.monotonic() - since >= OUT_SECONDS):
                    yield from sent(held)
                    held, since = [], time.monotonic()
            yield from sent(held)
        finally:
            stop.set()

    return df.mapInArrow(run, out)


def json_post(url: str, timeout: float = 120.0, headers: dict[str, str] | None = None) -> Callable[[dict], dict]:
    """A function that posts a payload as JSON and returns the reply's object; what may pass is Transient."""

    def post(payload: dict) -> dict:
        request = urllib.request.Request(url, json.dumps(payload).encode(), {"Content-Type": "application/json", **(headers or {})})
        try:
            with urllib.request.urlopen(request, timeout=timeout) as reply:
                return json.loads(reply.read())
        except urllib.error.HTTPError as e:
            said = f"{e.code}: {e.read()[:500].decode(errors='replace')}"
            raise (Transient(said) if e.code in (408, 429) or e.code >= 500 else ValueError(said)) from e
        except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
            raise Transient(str(e)) from e

    return post
