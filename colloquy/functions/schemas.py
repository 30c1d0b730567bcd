"""JSON Schemas compiled to one expression that names the first rule a document breaks."""

from __future__ import annotations

from numbers import Real

from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquy.functions.text import bound

#: The keywords that `violation` knows; another one is an error, so that no rule is passed over.
KEYWORDS = {"type", "enum", "minimum", "maximum", "minLength", "maxLength", "properties", "required", "additionalProperties", "items", "minItems", "maxItems", "anyOf"}

#: Kinds as a variant's schema names them, by JSON Schema type.
KINDS = {"object": "^OBJECT<", "array": "^ARRAY<", "string": "^STRING$", "boolean": "^BOOLEAN$", "null": "^VOID$", "integer": "^BIGINT$", "number": r"^(BIGINT|DOUBLE|DECIMAL\(.*)$"}


def violation(body: Column, schema: dict) -> Column:
    """The first rule of `schema` that the JSON text `body` breaks, as `path: rule`; null if all hold.

    A null text, text that isn't one JSON value, and an object with a key twice break `$: json`. An
    integer is a number written without a fraction or exponent that fits 64 bits: `4.0` and `true` are
    none. Numbers of `enum` are equal by value, so -1.0 is -1. Keywords apply to values of their kind
    only, as the standard says; `type` makes the kind a rule. In place of any bound or of `enum` stands a
    Column where the rule depends on the row.
    """
    # A parser stops at a value's end and ignores what follows; no text ends both of these early.
    alone = F.try_parse_json(F.concat(F.lit('{"v":'), body, F.lit("}"))).isNotNull()
    value = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), body, F.lit("]"))), "$[0]", "variant")
    return bound(F.when(alone, value), lambda v: F.when(v.isNull(), "$: json").otherwise(_broken(v, schema, "$")))


def _broken(v: Column, schema: dict, path: str) -> Column:
    if unknown := schema.keys() - KEYWORDS:
        raise ValueError(f"{path}: unknown keywords {sorted(unknown)}")
    kind = F.schema_of_variant(v)
    rules = []

    def rule(name: str, breaks: Column, of: str | None = None) -> None:
        broken = breaks if of is None else kind.rlike(KINDS[of]) & breaks
        rules.append(F.when(broken, f"{path}: {name}"))

    if "type" in schema:
        types = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
        rule("type", ~kind.rlike("|".join(KINDS[t] for t in types)))
    if "enum" in schema:
        rule("enum", ~_among(v, kind, schema["enum"]))
    number = F.try_variant_get(v, "$", "double")
    if "minimum" in schema:
        rule("minimum", number < schema["minimum"], "number")
    if "maximum" in schema:
        rule("maximum", number > schema["maximum"], "number")
    text = F.try_variant_get(v, "$", "string")
    if "minLength" in schema:
        rule("minLength", F.char_length(text) < schema["minLength"], "string")
    if "maxLength" in schema:
        rule("maxLength", F.char_length(text) > schema["maxLength"], "string")
    properties = schema.get("properties", {})
    keys = F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
    names = lambda of: F.array(*map(F.lit, of)).cast("array<string>")
    if schema.get("required"):
        rule("required", F.size(F.array_except(names(schema["required"]), keys)) > 0, "object")
    if schema.get("additionalProperties", True) is False:
        rule("additionalProperties", F.size(F.array_except(keys, names(properties))) > 0, "object")
    for key, below in properties.items():
        inner = F.element_at(F.try_variant_get(v, "$", "map<string,variant>"), F.lit(key))
        rules.append(_member(F.when(kind.rlike(KINDS["object"]), inner), below, f"{path}.{key}"))
    elements = F.try_variant_get(v, "$", "array<variant>")
    if "minItems" in schema:
        rule("minItems", F.size(elements) < schema["minItems"], "array")
    if "maxItems" in schema:
        rule("maxItems", F.size(elements) > schema["maxItems"], "array")
    if "items" in schema:
        found = F.filter(F.transform(elements, lambda x: _broken(x, schema["items"], f"{path}[]")), lambda x: x.isNotNull())
        rules.append(F.when(kind.rlike(KINDS["array"]), F.get(found, F.lit(0))))
    if "anyOf" in schema:
        fits = F.lit(False)
        for other in schema["anyOf"]:
            fits = fits | _broken(v, other, path).isNull()
        rule("anyOf", ~fits)
    return F.coalesce(*rules, F.lit(None).cast("string"))


def _member(value: Column, schema: dict, path: str) -> Column:
    """The rule that a member breaks; null if it isn't there."""
    return bound(value, lambda x: F.when(x.isNotNull(), _broken(x, schema, path)))


def _among(v: Column, kind: Column, values) -> Column:
    """Whether the value is one of `values`: scalars of any kinds, or a column of an array of numbers or strings."""
    number, text = F.try_variant_get(v, "$", "double"), F.try_variant_get(v, "$", "string")
    if isinstance(values, Column):
        as_texts = F.exists(values.cast("array<string>"), lambda x: x == text)
        as_numbers = F.exists(values.cast("array<string>"), lambda x: x.try_cast("double") == number)
        return F.coalesce(F.when(kind.rlike(KINDS["number"]), as_numbers).when(kind == "STRING", as_texts), F.lit(False))
    found = F.lit(False)
    for x in values:
        if x is None:
            same = kind == "VOID"
        elif isinstance(x, bool):
            same = (kind == "BOOLEAN") & (text == str(x).lower())
        elif isinstance(x, Real):
            same = kind.rlike(KINDS["number"]) & (number == float(x))
        else:
            same = (kind == "STRING") & (text == x)
        found = found | F.coalesce(same, F.lit(False))
    return found


#: The four decisions that judges score (fixed values).
DECISIONS = ["therapy", "surgery", "next_action", "clinical_trial"]


def exactly(properties: dict) -> dict:
    """The schema of an object with these keys and no other."""
    return {"type": "object", "properties": properties, "required": list(properties), "additionalProperties": False}


def rubric(name: str) -> dict:
    """The schema of a judge's result by rubric: `conclusion_alignment`, `four_decisions` or `clinical_equivalence`."""
    score = {"type": "integer", "minimum": 1, "maximum": 5}
    if name == "conclusion_alignment":
        return exactly({"conclusion_alignment": {"type": "object", "properties": {"score": score}, "required": ["score"]}})
    if name == "four_decisions":
        return exactly({n: {"anyOf": [{"enum": [-1]}, score]} for n in DECISIONS} | {"rationale": {}})
    if name == "clinical_equivalence":
        return exactly({"clinical_equivalence_score": score, "critical_error": {"type": "boolean"}, "unsupported_claim": {"type": "boolean"}, "rationale": {}})
    raise ValueError(f"no rubric {name}")


def scoped(scope: dict[str, Column], longest: int = 1200, more: dict | None = None) -> dict:
    """The schema of a reward judge's result, given each decision's scope: -1 where it is absent, else 0 to 5.

    `more` are further properties between the decisions and the rationale.
    """
    low = lambda s: F.when(s == "absent", -1).otherwise(0)
    high = lambda s: F.when(s == "absent", -1).otherwise(5)
    decisions = {n: {"type": "integer", "minimum": low(s), "maximum": high(s)} for n, s in scope.items()}
    return exactly(decisions | (more or {}) | {"rationale": {"type": "string", "minLength": 1, "maxLength": longest}})


#: What the consistency judge states beside the decisions (fixed values).
CONSISTENCY = {n: {"type": "integer", "minimum": 0, "maximum": 5} for n in ("discussion_quality", "discussion_conclusion_consistency", "grounding_and_safety")} | {n: {"type": "boolean"} for n in ("major_contradiction", "unsafe_addition")}
