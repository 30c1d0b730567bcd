"""Compiled schemas against hand-written outcomes, and against a small checker on generated values."""

import itertools
import json

import pytest
from pyspark.sql import functions as F

from colloquy.functions import schemas as S


def first_broken(spark, rows, schema):
    df = spark.createDataFrame(list(enumerate(rows)), "i int, body string")
    return [r.v for r in df.select("i", S.violation(F.col("body"), schema).alias("v")).orderBy("i").collect()]


def test_each_rule_of_the_rubrics(spark):
    turn = {"clinical_equivalence_score": 3, "critical_error": False, "unsupported_claim": True, "rationale": "x"}
    rows = [turn, turn | {"clinical_equivalence_score": 6}, turn | {"clinical_equivalence_score": 0}, turn | {"clinical_equivalence_score": True}, turn | {"critical_error": 1}, turn | {"more": 1}, {k: v for k, v in turn.items() if k != "rationale"}, turn | {"rationale": None}, [], None]
    texts = [json.dumps(r) for r in rows] + ['{"a":1', "", None, json.dumps(turn) + " x", json.dumps(turn) + "] [", json.dumps(turn) + "} {", json.dumps(turn).replace("3", "3.0")]
    p = "$.clinical_equivalence_score"
    assert first_broken(spark, texts, S.rubric("clinical_equivalence")) == [
        None, f"{p}: maximum", f"{p}: minimum", f"{p}: type", "$.critical_error: type", "$: additionalProperties", "$: required", None, "$: type", "$: type",
        "$: json", "$: json", "$: json", "$: json", "$: json", "$: json", f"{p}: type",
    ]
    four = {n: 1 for n in S.DECISIONS} | {"rationale": 1}
    texts = [json.dumps(four | {"surgery": x}) for x in (-1, -1.0, 5, 0, 6, "1", None)]
    assert first_broken(spark, texts, S.rubric("four_decisions")) == [None] * 3 + ["$.surgery: anyOf"] * 4
    texts = [json.dumps({"conclusion_alignment": x}) for x in ({"score": 5}, {"score": 5, "note": 1}, {}, 5, {"score": 0})]
    p = "$.conclusion_alignment"
    assert first_broken(spark, texts, S.rubric("conclusion_alignment")) == [None, None, f"{p}: required", f"{p}: type", f"{p}.score: minimum"]


def test_rules_that_follow_the_row(spark):
    value = lambda x, **more: json.dumps({"therapy": x, "rationale": "r"} | more)
    rows = [("absent", value(-1)), ("absent", value(0)), ("positive", value(0)), ("positive", value(-1)), ("positive", value(5, rationale="")), ("positive", value(5, rationale="r" * 9)), (None, value(5))]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, scope string, body string")
    out = df.select("i", S.violation(F.col("body"), S.scoped({"therapy": F.col("scope")}, longest=8)).alias("v")).orderBy("i").collect()
    assert [r.v for r in out] == [None, "$.therapy: maximum", None, "$.therapy: minimum", "$.rationale: minLength", "$.rationale: maxLength", None]
    df = spark.createDataFrame([(0, "[1, 2]", "2.0"), (1, "[1, 2]", "3"), (2, '["a"]', '"a"'), (3, None, "1"), (4, "[1]", '"1"')], "i int, among string, body string")
    among = F.from_json("among", "array<string>")
    assert [r.v for r in df.select("i", S.violation(F.col("body"), {"enum": among}).alias("v")).orderBy("i").collect()] == [None, "$: enum", None, "$: enum", None]


def test_lists_and_odd_keys(spark):
    schema = {"type": "object", "properties": {"a.b ']": {"type": "array", "items": {"type": ["integer", "null"]}, "minItems": 1, "maxItems": 3}}}
    texts = [json.dumps({"a.b ']": x}) for x in ([1, None], [], [1, 2, 3, 4], [1, "x"], [1, 2.5], 1)] + ["{}"]
    assert first_broken(spark, texts, schema) == [None, "$.a.b ']: minItems", "$.a.b ']: maxItems", "$.a.b '][]: type", "$.a.b '][]: type", "$.a.b ']: type", None]
    assert first_broken(spark, ['{"a":1,"a":2}', "1 2", "[1],[2]"], {}) == ["$: json"] * 3
    with pytest.raises(ValueError, match="pattern"):
        S.violation(F.col("x"), {"pattern": "a"})


def test_against_a_plain_checker(spark):
    values = [None, True, False, 0, 1, -1, 5, 6, 2.5, "", "a", "abc", [], [1], {}, {"k": 1}]
    of_kind = {"null": lambda x: x is None, "boolean": lambda x: isinstance(x, bool), "integer": lambda x: isinstance(x, int) and not isinstance(x, bool), "number": lambda x: isinstance(x, (int, float)) and not isinstance(x, bool), "string": lambda x: isinstance(x, str), "array": lambda x: isinstance(x, list), "object": lambda x: isinstance(x, dict)}

    def plain(x, schema):
        if "type" in schema and not of_kind[schema["type"]](x):
            return "$: type"
        if "enum" in schema and not any(type(x) is type(e) and x == e for e in schema["enum"]):
            return "$: enum"
        if of_kind["number"](x) and x < schema.get("minimum", x):
            return "$: minimum"
        if isinstance(x, str) and len(x) > schema.get("maxLength", len(x)):
            return "$: maxLength"
        return None

    for kind, extra in itertools.product(of_kind, [{}, {"enum": [1, "a", None, True]}, {"minimum": 1}, {"maxLength": 1}]):
        schema = {"type": kind} | extra
        assert first_broken(spark, [json.dumps(v) for v in values], schema) == [plain(v, schema) for v in values], schema
