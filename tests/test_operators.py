"""Operators on small fixtures whose outcome follows from the rule."""

import json
import random
import re

import pytest
from colloquy.functions import parsers as P
from colloquy.functions import text as X
from colloquy.operators import aggregates as A
from colloquy.operators import deleak as D
from colloquy.operators import filters as L
from colloquy.operators import intervals as I
from colloquy.operators import joins as K
from colloquy.operators import scoring as R
from colloquy.operators import sequences as Q
from colloquy.sources import readers, sinks
from pyspark.sql import functions as F

UTT = "recording string, pos int, utterance_id string, speaker_id string, start_sec double, end_sec double, text string"


def utterances(spark, rows):
    return spark.createDataFrame([("r", i, f"u{i}", *r) for i, r in enumerate(rows)], UTT)


def test_overlap_takes_the_first_of_equals_and_nothing_on_touch(spark):
    u = utterances(spark, [("a", 0.0, 10.0, ""), ("a", 10.0, 12.0, ""), ("a", 100.0, 101.0, ""), ("a", 0.0, 5000.0, "")])
    s = spark.createDataFrame([("r", "s0", 0, 0.0, 5.0), ("r", "s1", 1, 5.0, 10.0), ("r", "s2", 2, 12.0, 90.0)], "recording string, slide_id string, slide_pos int, start_sec double, end_sec double")
    got = {r.utterance_id: r.slide_id for r in I.align_max_overlap(u, s).collect()}
    assert got == {"u0": "s0", "u1": None, "u2": None, "u3": "s2"}


def test_cases_hold_utterances_whole(spark):
    u = utterances(spark, [("a", 0.0, 10.0, ""), ("a", -1.0, 5.0, ""), ("a", 5.0, 11.0, ""), ("a", 2.0, 3.0, "")])
    c = spark.createDataFrame([("r", "c1", 0.0, 10.0), ("r", "c2", 2.0, 4.0)], "recording string, case_id string, start_sec double, end_sec double")
    assert sorted((r.utterance_id, r.case_id) for r in I.within_cases(u, c).collect()) == [("u0", "c1"), ("u3", "c1"), ("u3", "c2")]


def test_runs_merge_after_a_filter(spark):
    u = utterances(spark, [("a", 0.0, 1.0, "x "), ("a", 1.0, 5.0, " y"), ("b", 2.0, 3.0, "z"), ("a", 3.0, 4.0, "w")])
    assert [(r.speaker_id, r.text, r.end_sec) for r in Q.merged_runs(u, ["recording"]).orderBy("run").collect()] == [("a", "x   y", 5.0), ("b", "z", 3.0), ("a", "w", 4.0)]
    left = Q.merged_runs(u.where("speaker_id = 'a'"), ["recording"], "strip").collect()
    assert [(r.text, r.end_sec) for r in left] == [("x y w", 4.0)]


def test_profile_ends_with_the_last_to_start(spark):
    u = utterances(spark, [("a", 5.0, 6.0, " two "), ("a", 0.0, 90.0, "one")])
    r = A.speaker_profiles(u).first()
    assert (r.full_text, r.first_start_sec, r.last_end_sec, r.utterance_count, r.total_duration_sec) == ("one two", 0.0, 6.0, 2, 91.0)


def test_greedy_dedup_looks_at_kept_rows_only():
    import numpy as np

    a = np.array([[1, 0], [0.8, 0.6], [0.28, 0.96], [1, 0]])
    assert Q.kept_greedily(a, 0.79).tolist() == [True, False, True, False]
    assert Q.kept_greedily(a[:1], 0.5).tolist() == [True]
    assert Q.kept_greedily(np.zeros((0, 2)), 0.5).tolist() == []


def test_floor_rank(spark):
    for n, want in ((1, 1.0), (10, 9.0), (20, 19.0)):
        df = spark.createDataFrame([("g", float(i)) for i in range(1, n + 1)], "g string, x double")
        assert df.agg(A.floor_rank(F.col("x"), 0.95)).first()[0] == want
        assert A.floor_rank_distributed(df, "g", "x", 0.95).first().percentile == want


def test_repairs(spark):
    pairs = spark.createDataFrame([("c", i, f"q{i}", "a") for i in range(4)], "case_id string, pos int, question string, answer string")
    rows = [("c", 0, 0, "keep", "new", " ", None), ("c", 1, 1, "DROP", "x", "x", " Trivial "), ("c", 1, 2, "drop", "x", "x", "odd"), ("c", 9, 3, "drop", "", "", "")]
    d = spark.createDataFrame(rows, "case_id string, index int, order int, verdict string, question string, answer string, drop_reason string")
    got = {r.pos: (r.keep, r.question, r.answer, r.drop_reason) for r in L.repaired(pairs, d, ["case_id"]).collect()}
    assert got == {0: (True, "new", "a", None), 1: (False, "q1", "a", "non_answer"), 2: (True, "q2", "a", None), 3: (True, "q3", "a", None)}


def test_floored_mean(spark):
    df = spark.createDataFrame([("scored", 5), ("scored", 4), ("format_failure", None), ("judge_failure", None)], "status string, score int")
    assert df.agg(A.mean_with_floor()).first()[0] == pytest.approx(10 / 3)
    assert df.where("status = 'judge_failure'").agg(A.mean_with_floor()).first()[0] is None


def test_judge_scores_are_integers(spark):
    df = spark.createDataFrame([('{"s": 4}',), ('{"s": 4.0}',), ('{"s": true}',), ('{"s": 6}',), ('{"s": 1, "t": 2}',)], "b string")
    got = df.select(L.judge_score(F.col("b"), "s").alias("v"), L.has_exactly(F.col("b"), ["s"]).alias("k")).collect()
    assert [r.v for r in got] == [4, None, None, None, 1] and [r.k for r in got] == [True, True, True, True, False]


def parsed_by(spark, parser, rows, names):
    """The parser's structs for rows of strings, in order."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"{n} string" for n in names))
    return [r.p for r in df.select("i", parser(*(F.col(n) for n in names)).alias("p")).orderBy("i").collect()]


def test_answers(spark):
    good = [("parsed", '{"answer": "x"}'), ("parsed", ' {"answer": "a \\n b"} '), ("parsed", '{"answer": "w", "answer": "x"}')]
    good += [("parsed_after_cleanup", t) for t in ('<think>a</think>{"answer": "x"}', '```json\n{"answer": "x"}\n```', 'so {"answer": "x"} then', '{"answer": "x"} then', '```\n{"answer": "x"}')]
    bad = ['{"answer": "x", "y": 1}', '{"answer": 1}', "[]", "", None, "{", '{"answer": "x"}{"answer": "x"}', "{'answer': 'x'}", '{"answer": null}', '"answer"', '{"answer": "x"],"end":true}']
    got = parsed_by(spark, P.parse_qa, [(t,) for _, t in good] + [(t,) for t in bad], ["c"])
    assert [p.status for p in got] == [s for s, _ in good] + ["raw_fallback"] * len(bad)
    assert [p.answer for p in got[: len(good)]] == ["x", "a \n b"] + ["x"] * (len(good) - 2)
    assert all(p.answer is None and p.error for p in got[len(good) :])
    two = ['{"answer": "x", "insufficient_evidence": true}', '{"answer": "x", "insufficient_evidence": 1}', '{"answer": "x"}']
    got = parsed_by(spark, lambda c: P.parse_qa(c, True), [(t,) for t in two], ["c"])
    assert [(p.status, p.insufficient_evidence) for p in got] == [("parsed", True), ("raw_fallback", None), ("raw_fallback", None)]


WAYS = ["parsed", "mode", "final", "extraction", "reasoning", "raw"]


def ways(raw, **k):
    return tuple({**k, "raw": raw}.get(n) for n in WAYS)


def test_answer_ways(spark):
    direct = {"mode": "reasoning_final", "extraction": "missing_explicit_final_boundary"}
    cases = [
        (ways(None, parsed=" a "), ("a", "parsed")), (ways('{"answer": "b"}', parsed=" "), (None, "unrecoverable")),
        (ways('{"answer": "a"}'), ("a", "raw_json")), (ways('```json\n{"answer": "a", "b": 2}\n```'), ("a", "raw_json")), (ways('{"answer": " "}'), (None, "unrecoverable")),
        (ways('{"answer": "a\\n\\u0041'), ("a\nA", "raw_json_wrapper_recovered")), (ways('{"Answer":"a \\ud83d\\ude00 \\q" }'), ("a \U0001f600 \\q", "raw_json_wrapper_recovered")), (ways('{"answer": ""} '), (None, "unrecoverable")),
        (ways("plain"), ("plain", "raw_plain_text")), (ways("```\nplain\n```"), ("plain", "raw_plain_text")),
        (ways('{"other": 1}'), (None, "unrecoverable")), (ways("[1"), (None, "unrecoverable")), (ways('""'), (None, "unrecoverable")), (ways(None), (None, "unrecoverable")), (ways(" \n"), (None, "unrecoverable")),
        (ways(" ", mode="reasoning_final"), (None, "unrecoverable_reasoning_final")), (ways("x", mode="reasoning_final", final='{"answer": "f"}'), ("f", "raw_json")),
        (ways('{"answer": "a"}', **direct), ("a", "direct_final_json_no_reasoning_trace")), (ways('{"answer": "a", "b": 1}', **direct), (None, "unrecoverable_reasoning_final")),
        (ways('{"answer": "a"}', reasoning="r", **direct), (None, "unrecoverable_reasoning_final")),
    ]
    assert [tuple(p) for p in parsed_by(spark, P.parse_answer, [c for c, _ in cases], WAYS)] == [w for _, w in cases]


def test_final_ways(spark):
    cases = [
        (("x", "why"), ("x", "provider_separated_reasoning")), ((" ", "why"), (None, "empty_provider_final_response")),
        (("a\n## Final Answer: b\nc", None), ("b\nc", "markdown_final_answer")), (("# final response: x\n# Final  Answer\n\ny", None), ("y", "markdown_final_response")),
        (("# **final response**\n", None), (None, "empty_markdown_final_response")),
        (("a</think>b</think >c", None), ("c", "closed_think_suffix")), (("a</think> ", None), (None, "empty_think_suffix")),
        (("a[/think]b", None), ("b", "closed_bracket_think_suffix")), (("a[/THINK]", None), (None, "empty_bracket_think_suffix")),
        (("a", None), (None, "missing_explicit_final_boundary")), ((None, None), (None, "missing_explicit_final_boundary")),
    ]
    assert [tuple(p) for p in parsed_by(spark, P.parse_final, [c for c, _ in cases], ["content", "reasoning"])] == [w for _, w in cases]


TURNS = "<discussion>\n<turn 1> **Surgeon**: a\nb\n<turn 2> Nurse: c\n</discussion>\n<conclusion>One. Two.</conclusion>"
TABLE = "| Role | Response |\n|---|---|\n| **A** | x |\nmore\n| B | y |\n**Conclusion:** One. Two."


def test_simulations(spark):
    texts = [
        TURNS, TURNS.replace("turn 2", "turn 3"), TURNS.replace("</discussion>", "").replace("<discussion>", "\U0001f600"), "<turn 1> A: b", TURNS.replace("One. Two.", " "), TURNS.replace("Two.", ""), "<think>z</think>" + TURNS,
        TURNS.replace("Nurse", "Insufficient_Evidence"), TURNS.replace("</conclusion>", ""),
        "<think>z</think>" + TABLE, TABLE.replace("| B |", "| a |"), "```\n" + TABLE + "\n```", TABLE.replace("**Conclusion:**", "## conclusion:"), "before\n" + TABLE, "no table\nConclusion: x", "nothing", None,
    ]
    got = parsed_by(spark, P.parse_simulation, [(t,) for t in texts], ["c"])
    assert [p.status for p in got] == [
        "parsed", "parsed_with_warnings", "parsed_with_warnings", "raw_fallback", "raw_fallback", "parsed_with_warnings", "parsed_after_cleanup", "parsed_with_warnings", "parsed_with_warnings",
        "parsed_after_cleanup", "parsed_with_warnings", "parsed", "parsed", "parsed", "raw_fallback", "raw_fallback", "raw_fallback",
    ]
    assert [tuple(r) for r in got[0].discussion] == [("Surgeon", "a\n\nb"), ("Nurse", "c")]
    assert (got[0].conclusion, got[0].discussion_row_count, got[0].unique_role_count, got[0].conclusion_sentence_count) == ("One. Two.", 2, 2, 2)
    assert [p.warnings for p in (got[i] for i in (1, 2, 3, 4, 5, 7, 8))] == [
        ["turn numbers are not 1..N in order"], ["missing <discussion> tag", "missing </discussion> tag"], ["missing <conclusion> section"], ["missing turns or conclusion text"],
        ["expected a 2-4 sentence conclusion, found approximately 1"], ["disallowed insufficient_evidence role"], ["missing </conclusion> tag"],
    ]
    assert all([tuple(r) for r in got[i].discussion] == [("A", "x |\nmore"), ("B", "y")] and got[i].conclusion == "One. Two." for i in (9, 11, 12, 13))
    assert got[10].warnings == ["duplicate specialist roles"] and (got[10].discussion_row_count, got[10].unique_role_count) == (2, 1)
    assert [p.warnings for p in got[14:]] == [["missing table rows or conclusion text"], ["missing Conclusion section"], ["missing Conclusion section"]]


def test_conclusions(spark):
    direct = {"mode": "reasoning_final", "extraction": "missing_explicit_final_boundary"}
    cases = [
        (ways(TABLE, parsed=" p "), ("p", "parsed")), (ways(TURNS, parsed=" "), ("One. Two.", "raw_markdown_conclusion")),
        (ways("Conclusion: do it."), ("do it.", "conclusion_only_response")), (ways("a <conclusion>do it"), ("do it", "conclusion_xml")), (ways("<conclusion> do it </conclusion> x"), ("do it", "conclusion_xml")),
        (ways("| A | x |\nConclusion: y."), ("y.", "raw_markdown_conclusion")), (ways("| A | x |\nConclusion: y.", **direct), ("y.", "direct_final_markdown_no_reasoning_trace")),
        (ways(" " + TURNS, reasoning="r", **direct), ("One. Two.", "conclusion_xml")), (ways("nothing"), ("", "unavailable")), (ways(None), ("", "unavailable")),
    ]
    assert [tuple(p) for p in parsed_by(spark, P.parse_conclusion, [c for c, _ in cases], WAYS)] == [w for _, w in cases]


def test_judge_output_text(spark):
    schema = "i int, o array<struct<type:string,content:array<struct<type:string,text:string>>>>"
    rows = [(0, [("note", [("output_text", "no")]), ("message", [("refusal", "no"), ("output_text", None), ("output_text", "yes")])]), (1, []), (2, None), (3, [("message", [])])]
    got = spark.createDataFrame(rows, schema).select("i", P.judge_output_text(F.col("o")).alias("t")).orderBy("i").collect()
    assert [r.t for r in got] == ["yes", None, None, None]


def test_webvtt(spark):
    text = "WEBVTT\nKind: captions\n\n1\n00:00 --> 00:01\n hello \nthere\nNOTE x\n"
    assert spark.range(1).select(readers.vtt_text(F.lit(text))).first()[0] == "hello there"


def plain_repetition(tokens, widths=8, gram=4):
    """Block runs by walking on after each run, and grams counted one by one."""
    longest = 1
    for w in range(1, widths + 1) if len(tokens) >= 8 else ():
        at = 0
        while at + 2 * w <= len(tokens):
            times = 1
            while tokens[at + times * w : at + (times + 1) * w] == tokens[at : at + w]:
                times += 1
            longest, at = max(longest, times), at + times * w
    grams = [tuple(tokens[i : i + gram]) for i in range(len(tokens) - gram + 1)]
    top = max((grams.count(g) for g in set(grams)), default=0)
    return longest, top


def test_repetition_against_a_plain_walk():
    draw = random.Random(11)
    lists = [[]]
    for _ in range(400):
        lists.append([])
        while len(lists[-1]) < draw.randrange(1, 60):
            lists[-1] += draw.choices(["a", "b", "Cc", "d-e", "\u4e2d"], k=draw.randrange(1, 4)) * draw.randrange(1, 6)
    for tail in (2048, 20, 3):
        got = Q.repetitions([" ".join(x) for x in lists], tail)
        assert list(zip(got.longest_run, got.top_count)) == [plain_repetition([t.casefold() for t in x[-tail:]]) for x in lists]
    glued, spaced = "x\u4e2dy" * 3000, "word's end " * 9000
    for text in (glued, spaced, spaced + glued, glued + spaced, glued + " " * 90_000, "!" * 50_000 + " a b"):
        whole = re.findall(Q.REPEAT_TOKEN, text)
        assert Q.tail_tokens(text, 2048) == whole[-2048:] and Q.tail_tokens(text, 5) == whole[-5:]


def test_repetition():
    found = [tuple(x) for x in Q.repetitions(["ab cd " * 7 + "end of it all now", "ab cd " * 8, "a b c", None]).itertuples(index=False)]
    assert [x[0] for x in found] == [False, True, False, False]
    assert found[1][1] == 8 and found[2][1:] == (1, 0, 0.0) and found[3][1:] == (1, 0, 0.0)
    assert len(Q.repetitions([])) == 0


def test_marker_mask(spark):
    df = spark.createDataFrame([([1, 7, 8, 2, 3, 9, 4],), ([1, 7, 8, 2],), ([1, 2, 3],)], "t array<int>")
    got = df.select(Q.marker_mask(F.col("t"), [7, 8], [9], F.size("t"), 0, 2)).collect()
    assert [[int(x) for x in r[0]] for r in got] == [[0, 1, 1, 1, 1, 1, 0], [0, 1, 1, 1], [0, 1, 1]]


def test_format_and_reward(spark):
    good = "<discussion>\n<turn 1> Moderator: hello there\n<turn 2> Surgeon: yes\n</discussion>\n<conclusion>One. Two.</conclusion>"
    rows = [(good, False, 100, None), (good, True, 100, None), ("nothing", False, 1, None), ("<conclusion>x.</conclusion>", False, 1, None), (good, False, 7168, None)]
    df = spark.createDataFrame(rows, "t string, response_truncated boolean, valid_response_length int, response_length_limit int")
    got = R.format_scores(df, "t").collect()
    assert [r.format_failure_reason for r in got] == [0, 1, 3, 4, 0]
    assert [round(r.format_score, 4) for r in got] == [1.0, -1.0, -1.0, -0.75, 0.5]


def test_lcs(spark):
    df = spark.createDataFrame([(["a", "b", "c"], ["b", "x", "c"]), (["a"], []), ([], ["a"])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(X.lcs_length(F.col("a"), F.col("b"))).collect()] == [2, 0, 0]


def test_text_forms(spark):
    df = spark.createDataFrame([("  a  b ",)], "t string")
    assert df.select(X.strip(F.col("t")), X.collapse(F.col("t"))).first() == ("a  b", "a b")
    ids = {"https://youtu.be/abc?t=1": "abc", "https://y.com/watch?v=q&x=1": "q", "https://y.com/embed/e/z": "e", "https://y.com/v/w": "w", "https://y.com/x": None}
    urls = spark.createDataFrame([(u,) for u in ids], "u string")
    assert {r.u: r.v for r in urls.select("u", X.video_id(F.col("u")).alias("v")).collect()} == ids
    assert spark.range(1).select(X.title_case(F.lit("o'neil-x"))).first()[0] == "O'Neil-X"
    assert spark.range(1).select(X.remap_prefix(F.lit("/a/b/c"), "/a/b", "/z")).first()[0] == "/z/c"


def test_deleak(spark):
    row = spark.range(1)
    one = lambda c: row.select(c).first()[0]
    assert one(D.is_subsequence(F.lit("a c"), F.lit("a b c"))) and not one(D.is_subsequence(F.lit("c a"), F.lit("a b c")))
    assert one(D.lost_negator(F.lit("it is not a b c d e f g h i j k"), F.lit("it is a b c d e f g h i j k")))
    assert one(D.question_holds(F.lit("trim"), F.lit("Is it now?"), F.lit("Is it?"), F.lit("why"))) is False
    assert one(D.question_holds(F.lit("trim"), F.lit("Is it now ?"), F.lit("Is it ?"), F.lit("why")))
    assert one(D.removals_verbatim(F.lit("abc"), F.array(F.lit("b")))) and not one(D.removals_verbatim(F.lit("abc"), F.array(F.lit("x"))))
    assert one(D.without_empty_sections(F.lit("## A\n\n## B\ntext\n"))) == "## B\ntext\n"


def test_boxes(spark):
    box = "struct<x:int,y:int,w:int,h:int>"
    df = spark.createDataFrame([([(0, 0, 10, 10), (20, 0, 10, 10)], [(0, 0, 10, 5)]), ([(0, 0, 10, 10)], [(0, 0, 10, 10)])], f"b array<{box}>, p array<{box}>")
    got = df.select(L.clear_of_people(F.col("b"), F.col("p"))).collect()
    assert [[x.x for x in r[0]] for r in got] == [[20], [0]]


def test_required_fails_with_its_message(spark):
    df = spark.createDataFrame([(1,), (2,)], "x int")
    assert L.required(df, F.col("x") > 0, "no").count() == 2
    with pytest.raises(Exception, match="too small"):
        L.required(df, F.col("x") > 1, "too small").collect()


def test_leakage_and_resume(spark):
    df = spark.createDataFrame([("a", "train"), ("a", "test"), ("b", "test"), ("c", "train")], "id string, split string")
    assert [(r.identity, r.splits) for r in K.leaked(df, "split", [F.col("id")]).collect()] == [("a", ["test", "train"])]
    done = spark.createDataFrame([("a", None), ("b", "late")], "id string, error string")
    assert {r.id for r in K.remaining(df.select("id").distinct(), done, "id").collect()} == {"b", "c"}
    assert {r.id for r in K.remaining(df.select("id").distinct(), done, "id", False).collect()} == {"c"}


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("a", "train", 1), ("b", "test", 2)], "id string, split string, n int")
    manifest = {r.split: r.rows for r in sinks.parquet_with_manifest(df, str(tmp_path / "p"), "split").collect()}
    assert manifest == {"train": 1, "test": 1}
    sinks.with_rejects(df, F.col("n") < 2, str(tmp_path / "good"), str(tmp_path / "bad"))
    assert spark.read.json(str(tmp_path / "bad")).count() == 1
    (tmp_path / "l.jsonl").write_text(json.dumps({"id": "x"}) + "\n\n" + "broken\n")
    assert readers.json_lines(spark, str(tmp_path / "l.jsonl"), "id string").where("id is not null").count() == 1
    with pytest.raises(Exception, match="bad line"):
        readers.json_lines_strict(spark, str(tmp_path / "l.jsonl"), "id string").collect()
    assert readers.json_lines_or_gzip(spark, str(tmp_path / "l"), "id string").count() >= 1
    with pytest.raises(FileNotFoundError):
        readers.json_lines_or_gzip(spark, str(tmp_path / "none"), "id string")


def test_search_source(spark):
    spark.dataSource.register(readers.VideoSearch)
    assert spark.read.format("video_search").option("keyword", "x").load().count() == 0


def test_latency_stats_are_not_collected(spark):
    rows = [("a", float(i * 7 % 1000)) for i in range(1000)] + [("a", 3.0)] * 501 + [("b", None), ("c", 2.5), (None, 4.0), (None, 1.0), ("d", None), ("d", -1.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    stats = A.latency_stats(df, "k", "v")
    plan = stats._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "median(" not in plan and "percentile" not in plan
    got = {r.k: tuple(r)[1:] for r in stats.collect()}
    want = {}
    for k in {k for k, _ in rows}:
        v = sorted(x for key, x in rows if key == k and x is not None)
        n = len(v)
        want[k] = (n, pytest.approx(sum(v) / n), (v[(n - 1) // 2] + v[n // 2]) / 2, v[int((n - 1) * 0.95)], v[-1]) if n else (0, None, None, None, None)
    assert got == want


@pytest.mark.parametrize("rows_a_task", [7, 1024])
def test_greedy_dedup_scans_blocks_only(spark, monkeypatch, rows_a_task):
    import numpy as np

    monkeypatch.setattr(Q, "SCAN_ROWS", rows_a_task)
    rng = np.random.default_rng(4)
    rows = [(k, int(n), rng.normal(size=3).tolist()) for k, size in (("a", 90), ("b", 3), (None, 40)) for n in rng.permutation(size)]
    rows += [("a", 500 + i, rows[i][2]) for i in range(30)] + [("c", 1, [0.0, 0.0, 0.0]), ("c", 2, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "k string, n long, embedding array<double>").repartition(3)
    calls = []
    scan = Q._stored
    monkeypatch.setattr(Q, "_stored", lambda x: calls.append(1) or scan(x))
    got = sorted(((str(r.k), r.n) for r in Q.greedy_dedup(df, "k", "n", threshold=0.95).collect()))
    want = []
    for k in ("a", "b", "c", None):
        own = sorted((n, v) for key, n, v in rows if key == k)
        keep = Q.kept_greedily(np.array([v for _, v in own]), 0.95)
        want += [(str(k), n) for (n, _), x in zip(own, keep) if x]
    assert got == sorted(want)
    assert len(calls) > 3 if rows_a_task == 7 else len(calls) == 3
    assert Q.greedy_dedup(df.limit(0), "k", "n").count() == 0
