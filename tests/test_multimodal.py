"""Rows with pictures: parts that give the text back, each rule once, and the slide of a frame against plain Python."""

import hashlib
import json
import random

from pyspark.sql import functions as F

from colloquy.operators import multimodal as W
from colloquy.operators import requests as M
from colloquy.operators import scoring as R

OPEN, CLOSE = W.SLIDE_BLOCK


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def pieces(text):
    """Plain cut: inside the first closed block, else everywhere."""
    a = text.find(OPEN)
    b = text.find(CLOSE, a + len(OPEN)) if a >= 0 else -1
    if b < 0:
        return text.split("<image>")
    head, inner, tail = text[: a + len(OPEN)], text[a + len(OPEN) : b], text[b:]
    cut = inner.split("<image>")
    cut[0] = head + cut[0]
    cut[-1] += tail
    return cut


def test_cut_and_joined(spark):
    draw = random.Random(5)
    tokens = ["<image>", OPEN, CLOSE, "a", " b\n", "<", "é€", "", "\\E", "<image"]
    texts = ["".join(draw.choices(tokens, k=draw.randrange(9))) for _ in range(300)]
    df = frame(spark, [(t, [f"u{i}" for i in range(len(pieces(t)) - 1)]) for t in texts], "t string, i array<string>")
    df = df.withColumn("p", W.split_at_markers(F.col("t"))).withColumn("c", W.content_parts(F.col("p"), F.col("i"))).withColumn("back", W.rejoined(F.col("c")))
    for r in df.collect():
        assert r.p == pieces(r.t)
        assert r.back == r.t
        assert [x.url for x in r.c if x.type == "image"] == r.i
        assert "" not in [x.text for x in r.c]


def test_rules_of_rows(spark):
    human = f"see\n{OPEN}1 <image>{CLOSE} and <image>"
    good = [("system", " p\n"), ("human", human)]
    bare = lambda text: [("system", "p"), ("human", text)]
    digest = hashlib.sha256(json.dumps([{"role": "system", "content": " p\n"}, {"role": "user", "content": human}], sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    rows = [
        ("good", good, ["a"], digest), ("good", good, ["a"], digest), ("undeclared", good, ["a"], None), ("hash", good, ["a"], "0"), ("turns", good[::-1], ["a"], None), ("turns2", good[:1], [], None), ("turns3", None, None, None),
        ("turns4", [("system", "p"), ("human", None)], [], None), ("system", [("system", "q"), good[1]], ["a"], None), ("images", good, ["x"], None), ("images2", bare("<image>" * 4), ["a", "z", None, "y"], None), ("markers", good, ["a", "b"], None),
        ("markers2", good, None, None), ("none", bare("no picture"), None, None), ("empty", bare(""), [], None),
    ]
    df = frame(spark, rows, "id string, conversations array<struct<from:string,value:string>>, images array<string>, h string").withColumn("fault", F.lit("clash"))
    files = frame(spark, [("a",), ("b",), ("b",), (None,)], "path string")
    found = W.multimodal_rows(df, files, "p", declared="h").collect()
    assert len(found) == len(rows)
    by_id = {r.id: r for r in found}
    assert {k: r.fault for k, r in by_id.items()} == {
        "good": None, "undeclared": None, "hash": "hash", "turns": "turns", "turns2": "turns", "turns3": "turns", "turns4": "turns", "system": "system", "images": "images", "images2": "images", "markers": "markers", "markers2": "markers", "none": None, "empty": None,
    }
    assert by_id["images"].missing == ["x"] and by_id["images2"].missing == ["z", None]
    assert [(p.type, p.text, p.url) for p in by_id["good"].content] == [("text", f"see\n{OPEN}1 ", None), ("image", None, "a"), ("text", f"{CLOSE} and <image>", None)]
    assert by_id["empty"].content == [] and by_id["markers"].content is None
    assert W.multimodal_rows(df.limit(0), files, "p", declared="h").collect() == []
    assert {r.fault for r in W.multimodal_rows(df.where("id = 'good'"), files.limit(0), "p").collect()} == {"images"}


def plain_score(x, y, w, h, area, width, height, most):
    if area < 0.08 * width * height or h == 0 or not 1.1 <= w / h <= 2.6:
        return 0.0
    if most is not None and max(area, w * h) > most * width * height:
        return 0.0
    return area / (width * height) * area / (w * h) * (1 - abs((x + w / 2) / width - 0.5)) * (1 - max((y + h / 2) / height - 0.7, 0))


def test_best_slides(spark):
    draw = random.Random(3)
    rows = []
    for i in range(400):
        x, y, w, h = draw.randrange(50), draw.randrange(40), draw.randrange(100), draw.randrange(60)
        rows.append((i % 60, i, (x, y, w, h), draw.randint(0, w * h), 100, 60, draw.choice([None, 3.0, 12.0, 40.0])))
    rows += [(99, 1, (0, 0, 0, 0), 0, 100, 60, None), (98, 2, (20, 10, 50, 30), 1500, 100, 60, 5.0), (98, 1, (20, 10, 50, 30), 1500, 100, 60, 50.0), (97, 1, None, None, 100, 60, None)]
    df = frame(spark, rows, "f int, n int, box struct<x:int,y:int,w:int,h:int>, area int, width int, height int, sharpness double")
    for most in (0.75, None):
        got = {r.f: (r.box and tuple(r.box), round(r.score, 12), r.verdict) for r in W.best_slides(df, ["f"], "n", most=most).collect()}
        want = {}
        for f, n, box, area, width, height, sharp in sorted(rows, key=lambda r: r[:2]):
            score = plain_score(*box, area, width, height, most) if box else 0.0
            if f not in want or score > want[f][1]:
                want[f] = (box, score, sharp)
        want = {f: (b if s > 0 else None, round(s, 12), "none" if s <= 0 else "blurred" if q is not None and q < 12 else "slide") for f, (b, s, q) in want.items()}
        assert got == want
        assert got[98] == ((20, 10, 50, 30), got[98][1], "slide") and got[99][2] == "none"


def test_forms_beside_the_score(spark):
    body = "<discussion>\n<turn 1> Moderator : Hi.\n<turn 3> Surgeon: Yes.\nnoise\n<turn 3> moderator: So.\n</discussion>\n<conclusion>One. Dr. Two said.</conclusion>"
    r = R.serialization(frame(spark, [(1, body), (2, None), (3, "<conclusion>x</conclusion>")], "k int, t string"), "t").orderBy("k").collect()
    names = ("turn_count", "role_count", "conclusion_sentence_count", "dialogue_roles", "moderator_first", "dialogue_structure")
    assert [r[0][f"format_{n}"] for n in names] == [3, 3, 2, 1.0, 1.0, 1.0]
    assert [r[1][f"format_{n}"] for n in names] == [0, 0, 0, 0.0, 0.0, 0.0] and r[2].format_dialogue_structure == 0.0
    assert r[0].format_turn_numbering == 2 / 3 and r[0].format_turn_syntax == 0.75


def test_reward_requests(spark):
    scopes = {n: F.lit("absent" if n == "surgery" else "negative") for n in R.DIMENSION_WEIGHTS}
    texts = (F.lit('d "q"'), F.lit(None).cast("string"))
    row = spark.range(1).select(M.consistency_payload(" judge\n", F.lit("e"), scopes, texts, texts, "m").alias("c"), M.scope_payload("judge", F.lit("r"), F.lit("e"), "m").alias("s")).first()
    c, s = json.loads(row.c), json.loads(row.s)
    schema = c["response_format"]["json_schema"]["schema"]
    assert schema["properties"]["surgery"] == {"type": "integer", "enum": [-1]} and schema["properties"]["therapy"] == {"type": "integer", "minimum": 0, "maximum": 5}
    assert schema["required"] == [*R.DIMENSION_WEIGHTS, *M.consistency_fields(), "rationale"] and set(schema["required"]) == set(schema["properties"])
    assert c["messages"][0] == {"role": "system", "content": "judge"} and '<CANDIDATE_DISCUSSION>\nd "q"\n</CANDIDATE_DISCUSSION>' in c["messages"][1]["content"]
    assert json.loads(c["messages"][1]["content"].split("<SCOPE>\n")[1].split("\n</SCOPE>")[0]) == {n: "absent" if n == "surgery" else "negative" for n in R.DIMENSION_WEIGHTS}
    assert (c["temperature"], c["top_p"], c["seed"], c["max_tokens"], c["chat_template_kwargs"]) == (0.0, 1.0, 0, 768, {"enable_thinking": False})
    assert s["max_tokens"] == 384 and s["messages"][1]["content"] == "<CASE_EVIDENCE>\ne\n</CASE_EVIDENCE>\n\n<REFERENCE_CONCLUSION>\nr\n</REFERENCE_CONCLUSION>"
    assert s["response_format"]["json_schema"]["schema"]["properties"]["therapy"]["enum"] == ["positive", "negative", "absent"]
