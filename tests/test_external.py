"""Calls in flight: side by side, held back, paced, retried and closed; and what each rule does."""

import http.server
import json
import threading
import time

import pytest
from colloquy.operators import external as E
from pyspark.sql import functions as F



def client_maker():
    """Made in a function, so that it travels to workers by value."""

    def make_client():
        """Answers by the row's text; `late` is a failure that may pass but doesn't, `flaky` passes the second time."""
        seen = {}

        def client(row):
            text = row["text"]
            seen[text] = seen.get(text, 0) + 1
            if text == "bad":
                raise ValueError("no")
            if text == "late" or text == "flaky" and seen[text] == 1:
                raise E.Transient("429")
            return {"label": 7 if text == "wrong kind" else text.upper() if text else None}

        return client

    return make_client


def rows_of(spark, texts, **options):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id int, text string, extra string").coalesce(1)
    return {r.text: r for r in E.called(df, client_maker(), options.pop("schema", "label string"), **options).collect()}


def test_slow_calls_run_side_by_side(spark):
    def slow():
        def client(row):
            time.sleep(0.5)
            return {"done": row["id"] * 2}

        return client

    df = spark.range(64).coalesce(1)
    E.called(df.limit(1), slow, "done long").collect()
    began = time.perf_counter()
    found = E.called(df, slow, "done long", concurrency=32).collect()
    took = time.perf_counter() - began
    assert sorted((r.id, r.done, r.status) for r in found) == [(i, 2 * i, "ok") for i in range(64)]
    assert took < 64 * 0.5 / 8, "64 calls of half a second take about that of two"


def test_rows_come_out_as_calls_end_and_the_source_is_held_back():
    taken, gate = [], threading.Event()

    def source():
        for i in range(100):
            taken.append(i)
            yield i

    def work(i):
        if i == 0:
            gate.wait(10)
        return i

    out = E.in_flight(source(), work, 4)
    first = next(out)
    assert first[0] != 0 and len(taken) == 8
    seen = [first[0]]
    while len(seen) < 99:
        seen.append(next(out)[0])
    assert 0 not in seen and len(taken) == 100
    gate.set()
    rest = [i for i, _ in out if i is not None]
    assert rest == [0] and sorted(seen + rest) == list(range(100))


def test_closing_early_gives_up_what_has_not_begun():
    began = []

    def work(i):
        began.append(i)
        time.sleep(0.05)
        return i

    out = E.in_flight(iter(range(1000)), work, 2)
    got = [next(out)[0] for _ in range(3)]
    out.close()
    time.sleep(0.3)
    assert len(set(got)) == 3 and len(began) <= 3 + 2 * 2


def test_no_row_is_lost_when_the_reader_stops_early(spark):
    df = spark.range(500).select("id", F.lit("a").alias("text")).coalesce(1)
    assert len(E.called(df, client_maker(), "label string", concurrency=4).limit(7).collect()) == 7
    assert E.called(df, client_maker(), "label string", concurrency=4).count() == 500


def test_the_pace_holds_for_retries_too():
    pace, stop, times = E.Pace(50), threading.Event(), []

    def client(row):
        times.append(time.monotonic())
        raise E.Transient("429")

    rule = E.Rule(tries=3, pause=0.0)
    list(E.in_flight(iter(range(10)), lambda i: E.tried(client, i, lambda r: r, rule, pace, stop), 8))
    times.sort()
    assert len(times) == 30 and times[-1] - times[0] >= 29 / 50 * 0.9


@pytest.mark.parametrize("name, rule", [("mark", E.Rule("mark", tries=2, pause=0.01)), ("fill", E.Rule("fill", {"label": "kept"}, 2, 0.01)), ("skip", E.Rule("skip", {}, 2, 0.01))])
def test_rules(spark, name, rule):
    got = {t: (r.label, r.attempts, r.status) for t, r in rows_of(spark, ["a", "bad", "late", "flaky", None], rule=rule).items()}
    want = {"a": ("A", 1, "ok"), "flaky": ("FLAKY", 2, "ok")}
    filler = {"mark": None, "fill": "kept"}.get(name)
    if name != "skip":
        want |= {"bad": (filler, 1, "error"), "late": (filler, 2, "error")}
    assert got == want | {None: (None, 1, "ok")}


def test_a_rule_that_raises_ends_the_job(spark):
    with pytest.raises(Exception, match="CallFailed.*ValueError: no"):
        rows_of(spark, ["a", "bad"], rule=E.RULES["segment"])
    assert rows_of(spark, ["a"], rule=E.RULES["roles"])["a"].label == "A"


def test_a_reply_of_another_kind_is_a_failure(spark):
    r = rows_of(spark, ["wrong kind"], rule=E.RULES["judge"])["wrong kind"]
    assert (r.label, r.status, r.attempts, r.extra) == (None, "error", 1, "x")


def test_retrying_whatever_failed(spark):
    assert rows_of(spark, ["bad"], rule=E.RULES["generate_with_images"])["bad"].attempts == 4


def test_several_rows_a_call_are_kept_unless_each_has_its_verdict(spark):
    def verifier():
        def client(rows):
            if any(r["text"] == "short" for r in rows):
                return [{"keep": False}]
            return [{"keep": r["text"] != "drop"} for r in rows]

        return client

    texts = ["a", "drop", "b", "drop", "short", "drop", "c"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").coalesce(1)
    got = {r.id: (r.keep, r.status) for r in E.called(df, verifier, "keep boolean", E.RULES["verify_slides"], rows_a_call=2).collect()}
    assert got == {0: (True, "ok"), 1: (False, "ok"), 2: (True, "ok"), 3: (False, "ok"), 4: (True, "error"), 5: (True, "error"), 6: (True, "ok")}


def test_pauses_grow_to_half_a_minute():
    assert [int(E.Rule().seconds(n)) for n in (1, 2, 3)] == [1, 2, 4] and E.Rule().seconds(9) == 30.0


def test_an_empty_table_makes_no_call(spark):
    assert rows_of(spark, []) == {}


def test_posting_json():
    codes = iter([429, 400, 200])

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            asked, code = json.loads(self.rfile.read(int(self.headers["Content-Length"]))), next(codes)
            self.send_response(code)
            self.end_headers()
            self.wfile.write(json.dumps({"echo": asked}).encode())

        def log_message(self, *args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    post = E.json_post(f"http://127.0.0.1:{server.server_port}/", timeout=5)
    with pytest.raises(E.Transient, match="429"):
        post({})
    with pytest.raises(ValueError, match="400"):
        post({})
    assert post({"a": 1}) == {"echo": {"a": 1}}
    server.shutdown()
    server.server_close()
    with pytest.raises(E.Transient):
        post({})
