"""Operators on training rows, requests, files and checks, on small tables whose outcome follows from the rule."""

import gzip
import json

import pytest
from colloquy.functions import text as X
from colloquy.operators import aggregates as A
from colloquy.operators import deleak as D
from colloquy.operators import filters as L
from colloquy.operators import joins as K
from colloquy.operators import requests as M
from colloquy.operators import scoring as R
from colloquy.operators import training as N
from colloquy.sources import readers, sinks
from pyspark.sql import functions as F


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_joins_of_records(spark):
    cases = table(spark, [("v", "c1"), ("v", "c2")], "video string, case_id string")
    bounds = table(spark, [("v", "c1", 1.0, 2.0)], "video string, case_id string, start_sec double, end_sec double")
    assert {r.case_id: r.case_end_sec for r in N.with_bounds(cases, bounds, ["video", "case_id"]).collect()} == {"c1": 2.0, "c2": None}
    aligned = table(spark, [("v", "c1", ["u1"])], "video string, case_id string, aligned_utterances array<string>")
    assert {r.case_id: r.aligned_utterances for r in N.with_alignment(cases, aligned, ["video", "case_id"]).collect()} == {"c1": ["u1"], "c2": []}
    slides = table(spark, [("v", "c1", ["a.png"])], "video string, case_id string, images array<string>")
    assert N.with_slide_images(cases.where("case_id = 'c1'"), slides, ["video", "case_id"]).count() == 1
    with pytest.raises(Exception, match="no slide images"):
        N.with_slide_images(cases, slides, ["video", "case_id"]).collect()
    tasks = table(spark, [("c1", ["u"]), (" ", ["u"]), ("c2", []), ("c3", None)], "conclusion string, utterances array<string>")
    assert [r.conclusion for r in N.discussion_samples(tasks).collect()] == ["c1"]


def test_preference_rows_fail_on_bad_rows(spark):
    rows = [(0, [("system", "s"), ("human", "h <image>"), ("gpt", "a")], ["x"], "id", "v", "c")]
    schema = "row int, conversations array<struct<from:string,value:string>>, images array<string>, source_id string, video_uid string, case_id string"
    good = table(spark, rows, schema)
    assert N.preference_rows(good, "train", "p", True, "d", "b").first()["reward_model"]["ground_truth"] == "a"
    for change, split, message in ((good.withColumn("images", F.array()), True, "markers"), (good, False, "reference in a test row"), (good.withColumn("conversations", F.slice("conversations", 2, 2)), True, "system and a human")):
        with pytest.raises(Exception, match=message):
            N.preference_rows(change, "test", "p", split, "d", "b").collect()
    with pytest.raises(ValueError):
        N.counted(good, 2)
    assert N.counted(good, 1).count() == 1


def test_shielding_and_order(spark):
    df = table(spark, [("a <image> b<image>",)], "t string")
    s = N.shielded(F.col("t"), "\u0001")
    assert df.select(s.alias("s"), N.restored(s, "\u0001").alias("r")).first() == ("a \u0001 b\u0001", "a <image> b<image>")
    with pytest.raises(Exception, match="sentinel"):
        df.select(N.shielded(F.col("t"), " b")).collect()
    rolls = table(spark, [("s2_0", 0.1, {"b": 1.0}), ("10_0_1", 0.2, {"a": 2.0}), ("9_1_0", 0.3, {}), ("9_0_2", 0.4, None)], "uid string, score double, parts map<string,double>")
    got = N.ordered_rollouts(rolls)
    assert got.columns == ["uid", "score", "a", "b"] and [r.uid for r in got.where("uid not like 's%'").collect()] == ["9_0_2", "9_1_0", "10_0_1"]
    both = N.runs_together(df, df.withColumn("n", F.lit(1)))
    assert sorted(r.n is None for r in both.collect()) == [False, True]
    assert [r.id for r in N.first_rows(spark.range(9).orderBy(F.desc("id")), 2, "id").collect()] == [0, 1] and N.first_rows(spark.range(9), 0, "id").count() == 9


def test_checks_of_rows(spark):
    frames = table(spark, [(0.5, 0.4), (0.4, 0.5)], "positive double, negative double")
    assert [round(r.score, 3) for r in N.above_score(frames, 0.0).collect()] == [0.1]
    kinds = N.by_kind(table(spark, [("response",), ("error",)], "kind string"))
    assert {k: d.count() for k, d in kinds.items()} == {"response": 1, "error": 1, "stopped": 0}
    with pytest.raises(Exception, match="kind"):
        N.by_kind(table(spark, [("odd",)], "kind string"))["error"].collect()
    mixed = table(spark, [(["x"],), (None,)], "conversations array<string>")
    assert [N.one_format(d).first().ok for d in (mixed, mixed.limit(0), mixed.where("conversations is null"))] == [False, False, True]
    edits = table(spark, [("v", "a", "KEEP", [("keep",)]), ("v", "b", "trim", []), ("v", "c", "keep", [("drop",)]), ("v", "d", "keep", None)], "video string, case_id string, summary_verdict string, captions array<struct<verdict:string>>")
    asked = table(spark, [("v", x) for x in "abcd"], "video string, case_id string")
    assert sorted(r.case_id for r in N.edited_cases(asked, edits, ["video", "case_id"]).collect()) == ["b", "c"]
    turns = "array<struct<from:string,value:string>>"
    rows = [("i", "i", [("system", " p "), ("human", "q <image>")], ["x"]), ("i", "j", [("system", "p"), ("human", "q <image>")], ["x"]), ("i", "i", [("system", "p")], []), ("i", "i", [("system", "other"), ("human", "q <image>")], ["x"]), ("i", "i", None, None)]
    df = table(spark, rows, f"id string, meta string, conversations {turns}, images array<string>").withColumn("h", F.sha2(F.lit("q <image>"), 256))
    assert [r[0] for r in df.select(L.valid_rows("conversations", "id", "meta", "p", "h", "images")).collect()] == [True, False, False, False, False]
    ids = spark.range(4)
    assert L.subset_by_id(ids, spark.range(2), "id").count() == 2
    with pytest.raises(Exception, match="subset"):
        L.subset_by_id(ids, spark.range(9), "id").collect()
    assert [r.id for r in L.repeated_ids(ids.union(spark.range(1)), "id").collect()] == [0]


def test_curation_filters(spark):
    verdicts = table(spark, [("a.mp4", True), ("b", True), ("c", False), ("d", None)], "video string, is_case_presentation boolean")
    assert [r.video for r in L.case_presentations(verdicts, table(spark, [("a",), ("c.mp4",), ("d",)], "file string")).collect()] == ["a.mp4"]
    texts = table(spark, [("x" * 60,), ("  " + "x" * 59 + " ",), (None,)], "t string")
    assert L.long_enough(texts, "t").count() == 1
    blank = L.default_verdict(texts.withColumnRenamed("t", "transcript")).collect()
    assert [r.verdict is None for r in blank] == [True, True, False] and blank[2].verdict.is_case_presentation is False
    kept = table(spark, [(["a", "b", "c"], [True, False])], "k array<string>, v array<boolean>")
    assert kept.select(L.verified(F.col("k"), F.col("v")).alias("x")).first().x == ["a", "c"]
    marks = table(spark, [("<image>", ["a"]), ("<image><image>", ["a"]), ("x", None)], "t string, i array<string>")
    assert [r.t for r in L.marker_mismatch(marks, "t", "i").collect()] == ["<image><image>"]
    wide = table(spark, [(1, 2, 3, 4)], "id int, _private int, a_sha256 int, reference_answer int")
    assert L.reference_free(wide).columns == ["id"] and L.reference_free(wide, True).columns == ["id", "reference_answer"]
    box = "array<struct<x:int,y:int,w:int,h:int>>"
    boxes = table(spark, [([(0, 0, 40, 30), (0, 0, 4, 3), (0, 0, 100, 99), (0, 0, 30, 40)],)], f"b {box}")
    assert [r.w for r in boxes.select(L.plausible_boxes(F.col("b"), F.lit(10_000)).alias("b")).first().b] == [40]
    two = table(spark, [("", "b"), ("a", "b"), (None, None)], "x string, y string")
    assert [r[0] for r in two.select(L.source_identity(F.col("x"), F.col("y"))).collect()] == ["b", "a", None]


def test_scopes_and_runs(spark):
    records = table(spark, [("s", "ref"), ("t", "ref")], "source_id string, reference string")
    scopes = table(spark, [("s", "positive")], "source_id string, scope string").withColumn("reference_sha256", F.sha2(F.lit("ref"), 256))
    assert {r.source_id: r.scope for r in K.frozen_scope(records, scopes).collect()} == {"s": "positive", "t": None}
    before, now = (table(spark, list(x.items()), "key string, value string") for x in ({"a": "1", "b": "2", "c": "3"}, {"a": "1", "b": "5", "z": "9"}))
    assert sorted(r.key for r in K.incompatible(before, now, ["a", "b", "c"]).collect()) == ["b", "c"]
    masks = table(spark, [(True, False, False, 3, 10), (True, True, True, 0, 0)], "start_found boolean, end_found boolean, fallback boolean, selected int, response int")
    assert tuple(A.mask_diagnostics(masks).first()) == (1.0, 0.5, 0.5, 0.3)
    shown = table(spark, [("c", 1, ["b", "a"]), ("c", 0, ["a"]), ("c", 2, ["b"])], "case string, pos int, ids array<string>")
    assert A.distinct_slides(shown, "case", "pos", "ids").first().slide_ids == ["a", "b"]
    assert [r[0] for r in table(spark, [(5, 5, 9), (4, None, 5), (5, None, 5)], "n int, most int, width int").select(R.is_truncated(F.col("n"), F.col("most"), F.col("width"))).collect()] == [True, False, True]
    scores = {f"scope_{n}": F.lit("positive") for n in R.DIMENSION_WEIGHTS} | {n: F.lit(3) for n in R.DIMENSION_WEIGHTS}
    df = table(spark, [(3, "why"), (0, "why"), (3, " ")], "alignment_score int, rationale string").withColumns(scores)
    assert [r.scores_valid for r in R.valid_scores(df).collect()] == [True, False, False]


def test_deleak_rules(spark):
    rows = [("clean", "a b", "a b", []), ("clean", "a b", "a", []), ("clean", "a b", "a b", ["x"]), ("trim", "a b", "a", ["b"])]
    df = table(spark, rows, "v string, b string, a string, r array<string>")
    assert [r[0] for r in df.select(D.unchanged(F.col("v"), F.col("b"), F.col("a"), F.col("r"))).collect()] == [True, False, False, True]
    caps = table(spark, [(["x", "y"], [("keep", "x"), ("drop", "")]), (["x"], [("keep", "z")]), (["x"], []), (["x"], [("edit", "new")])], "b array<string>, a array<struct<verdict:string,final:string>>")
    assert [r[0] for r in caps.select(D.captions_match(F.col("b"), F.col("a"))).collect()] == [True, False, False, True]
    fixes = table(spark, [("a b c", "a c"), ("a b c", "c a"), ("a b", "a b")], "b string, a string")
    assert [r[0] for r in fixes.select(D.repair_holds(F.col("b"), F.col("a"))).collect()] == [True, False, False]
    audit = table(spark, [("s", "LEAK"), ("s", "CLEAN"), ("s", "odd"), ("t", "CLEAN")], "stratum string, found string")
    got = {r.stratum: (r.n, r.invalid, round(r.rate_leak, 3)) for r in D.audit_rates(audit, "stratum", "found", ["LEAK", "CLEAN"]).collect()}
    assert got == {"s": (3, 1, 0.333), "t": (1, 0, 0.0)}


def test_files(spark, tmp_path):
    (tmp_path / "u.csv").write_text("url,n\n http://a ,1\n,2\n")
    assert [r.url for r in readers.csv_urls(spark, str(tmp_path / "u.csv")).collect()] == ["http://a"]
    folder = tmp_path / "rec1"
    folder.mkdir()
    for name in ("task_case_1.json", "task_case_1_rephrased.json", "task_case_1_qc.json"):
        (folder / name).write_text(json.dumps({"a": name}, indent=1))
    docs = readers.json_documents(spark, str(folder / "*.json"), "a string")
    assert {(r.a, r.recording) for r in readers.task_files(docs, False).collect()} == {("task_case_1.json", "rec1")}
    assert [r.a for r in readers.task_files(docs, True).collect()] == ["task_case_1_rephrased.json"]
    (tmp_path / "p.txt").write_text("\n say it \n")
    assert readers.prompt_text(spark, str(tmp_path / "p.txt")) == "say it"
    (tmp_path / "i.png").write_bytes(b"png")
    assert readers.images(spark, str(tmp_path / "i.png")).first().uri == "data:image/png;base64,cG5n"
    (tmp_path / "t.en.vtt").write_text("WEBVTT\n\n00:00 --> 00:01\nhi\n")
    assert tuple(readers.webvtt(spark, str(tmp_path / "*.vtt")).first()) == ("t.en", "hi")
    rec = table(spark, [("r", [(0.12345, 1.0, " a "), (1.0, 2.0, "b")])], "recording string, utterances array<struct<start_sec:double,end_sec:double,text:string>>")
    assert [tuple(r) for r in readers.utterance_table(rec).orderBy("pos").collect()] == [("r", 0, "utt_000001", 0.123, 1.0, "a"), ("r", 1, "utt_000002", 1.0, 2.0, "b")]
    df = table(spark, [("v", 1), ("w", 2)], "video string, n int")
    sinks.json_documents(df, str(tmp_path / "docs"), ["video"])
    assert sorted(r.video for r in spark.read.json(str(tmp_path / "docs")).collect()) == ["v", "w"]
    sinks.csv_table(df, str(tmp_path / "csv"), ["n"])
    assert spark.read.csv(str(tmp_path / "csv"), header=True).columns == ["n"]
    for _ in range(2):
        sinks.append_log(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4
    with gzip.open(tmp_path / "x.jsonl.gz", "wt") as f:
        f.write('{"a": 1}\n')
    assert readers.json_lines_or_gzip(spark, str(tmp_path / "x"), "a int").count() == 1


def test_texts(spark):
    df = table(spark, [("/a/b.c/d.e.txt", "STRASSE", "straße", "<image>x<image>")], "p string, u string, v string, m string")
    row = df.select(X.file_stem(F.col("p")).alias("s"), (X.folded(F.col("u")) == X.folded(F.col("v"))).alias("f"), X.marker_count(F.col("m")).alias("n"), M.rendered("{a}-{x}{u}", a=F.col("u"), u=F.lit(None)).alias("r")).first()
    assert tuple(row) == ("d.e", True, 2, "STRASSE-{x}")
    arrays = table(spark, [(list("abcbdab"), list("bdcaba")), ([], ["a"]), (["a"], None)], "a array<string>, b array<string>")
    assert [r[0] for r in arrays.select(X.lcs_length(F.col("a"), F.col("b"))).collect()] == [4, 0, None]
    pairs = table(spark, [([("q\"1", "a1")],)], "p array<struct<question:string,answer:string>>")
    assert json.loads(pairs.select(M.repair_prompt("fix: ", F.col("p")).alias("t")).first().t.removeprefix("fix: ")) == [{"index": 0, "question": 'q"1', "answer": "a1"}]
    assert "<A>\nx\n</A>\n\n<B>\n\n</B>" == spark.range(1).select(M.sections(a=F.lit("x"), b=F.lit(None))).first()[0]
    schema = json.loads(M.decision_schema({n: "absent" for n in R.DIMENSION_WEIGHTS}, {"ok": {"type": "boolean"}}))
    assert schema["properties"]["surgery"] == {"type": "integer", "enum": [-1]} and schema["required"][-2:] == ["ok", "rationale"]
    with pytest.raises(Exception, match="method or URL"):
        M.chat_payload(table(spark, [('{"method": "GET"}',)], "r string"), "r", "m").collect()
