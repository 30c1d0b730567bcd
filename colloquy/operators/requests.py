"""Model requests as columns: templates, content shapes, chat text, and requests in JSON."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.text import strip
from colloquy.operators.filters import required
from colloquy.operators.scoring import DIMENSION_WEIGHTS

# The parts of a case's evidence, and the section names of a judge's request.
SUMMARY_HEAD, SLIDES_HEAD = "CASE SUMMARY:\n", "\n\nSLIDES:\n"
NO_SLIDES = "No slide descriptions are available."


def rendered(template: str, **columns: Column) -> Column:
    """`template` with each {name} filled in; null columns count as empty, other braces stay."""
    pieces = re.split(r"\{(\w+)\}", template)
    parts = [F.coalesce(columns[p].cast("string"), F.lit("")) if i % 2 and p in columns else F.lit("{" + p + "}" if i % 2 else p) for i, p in enumerate(pieces)]
    return F.concat(*parts)


def case_evidence(summary: Column, slides: Column) -> Column:
    return rendered(SUMMARY_HEAD + "{summary}" + SLIDES_HEAD + "{slides}", summary=summary, slides=slides)


def evidence_parts(evidence: Column) -> Column:
    """(case_summary, slides) of a case's evidence; all of it is the summary if it hasn't both heads."""
    text = strip(F.coalesce(evidence, F.lit("")))
    split = F.split(F.substring(text, F.lit(len(SUMMARY_HEAD) + 1), F.length(text)), re.escape(SLIDES_HEAD).replace("\\\n", "\n"), 2)
    headed = text.startswith(SUMMARY_HEAD) & text.contains(SLIDES_HEAD)
    slides = F.when(headed, F.nullif(strip(F.get(split, F.lit(1))), F.lit("")))
    return F.struct(F.when(headed, strip(split[0])).otherwise(text).alias("case_summary"), F.coalesce(slides, F.lit(NO_SLIDES)).alias("slides"))


def sections(**columns: Column) -> Column:
    """Each column in tags of its name, in upper case, a blank line between."""
    return F.concat_ws("\n\n", *(F.concat(F.lit(f"<{k.upper()}>\n"), F.coalesce(v, F.lit("")), F.lit(f"\n</{k.upper()}>")) for k, v in columns.items()))


def provider_blocks(parts: Column) -> Column:
    """Content parts (type, text, url) as blocks (type, text, source): a data URI becomes its media type and payload; order stays."""

    def block(p: Column) -> Column:
        image = p["type"] != "text"
        head, data = F.substring_index(p["url"], ",", 1), F.get(F.split(p["url"], ",", 2), F.lit(1))
        media = F.substring_index(F.regexp_replace(head, "^data:", ""), ";", 1)
        source = F.when(image, F.struct(F.lit("base64").alias("type"), media.alias("media_type"), data.alias("data")))
        return F.struct(F.when(image, "image").otherwise("text").alias("type"), F.when(~image, p["text"]).alias("text"), source.alias("source"))

    return F.transform(parts, block)


def chat_text(df: DataFrame, turns: str, begin: str, user: str, assistant: str, close: str) -> DataFrame:
    """`df` with chat_text: one system and one user turn between a model's tokens, `close` being what opens or ends its thinking; other turns fail."""
    roles = F.transform(turns, lambda t: t["role"])
    checked = required(df, (roles == F.array(F.lit("system"), F.lit("user"))) & F.forall(turns, lambda t: t["content"].isNotNull()), "not exactly a system and a user turn with text")
    content = lambda i: F.col(turns)[i]["content"]
    return checked.withColumn("chat_text", F.concat(F.lit(begin), content(0), F.lit(user), content(1), F.lit(assistant), F.lit(close)))


def decision_schema(scopes: dict[str, str], extra: dict | None = None, most: int = 1200) -> str:
    """JSON Schema of a judge's decisions: -1 only where the scope is absent, else 0 to 5; with a rationale, and `extra` fields before it."""
    fields = {n: {"type": "integer", "enum": [-1]} if scopes[n] == "absent" else {"type": "integer", "minimum": 0, "maximum": 5} for n in DIMENSION_WEIGHTS}
    fields |= (extra or {}) | {"rationale": {"type": "string", "minLength": 1, "maxLength": most}}
    return json.dumps({"type": "object", "properties": fields, "required": list(fields), "additionalProperties": False})


def decision_schema_of(*scopes: Column, extra: dict | None = None, most: int = 1200) -> Column:
    """`decision_schema` of each row, scopes in the order of the dimensions: a lookup among all cases there are."""
    names, cases = list(DIMENSION_WEIGHTS), {}
    for mask in range(1 << len(names)):
        absent = [bool(mask >> i & 1) for i in range(len(names))]
        cases["".join("a" if a else "p" for a in absent)] = decision_schema(dict(zip(names, ("absent" if a else "present" for a in absent))), extra, most)
    key = F.concat(*(F.when(s == "absent", "a").otherwise("p") for s in scopes))
    return F.element_at(F.create_map(*[F.lit(x) for pair in cases.items() for x in pair]), key)


def judge_request(custom_id: Column, system: str, user: Column, name: str, schema: Column, max_tokens: int) -> Column:
    """A batch request in JSON; `schema` is JSON text and goes in as it is."""
    head = F.struct(
        custom_id.alias("custom_id"), F.lit("POST").alias("method"), F.lit("/v1/responses").alias("url"),
        F.struct(
            F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content"))).alias("input"),
            F.lit(max_tokens).alias("max_output_tokens"),
            F.struct(F.struct(F.lit("json_schema").alias("type"), F.lit(name).alias("name"), F.lit(True).alias("strict"), F.parse_json(schema).alias("schema")).alias("format")).alias("text"),
        ).alias("body"),
    )
    return F.to_json(head)


REQUEST = "custom_id string, method string, url string, body struct<input:array<struct<role:string,content:string>>,max_output_tokens:int,text:struct<format:struct<type:string,name:string,strict:boolean,schema:variant>>>"


def chat_payload(df: DataFrame, request: str, model: str, seed: int = 0, temperature: float = 0.0, top_p: float = 1.0) -> DataFrame:
    """`df` with payload: the batch request in the shape of a chat server, decoding fixed; an unexpected method, URL, turn or format fails."""
    parsed = df.withColumn("_r", F.from_json(request, REQUEST))
    form, turns = F.col("_r.body.text.format"), F.col("_r.body.input")
    checked = required(parsed, (F.col("_r.method") == "POST") & (F.col("_r.url") == "/v1/responses"), "unexpected method or URL of a request")
    checked = required(checked, F.transform(turns, lambda t: t["role"]) == F.array(F.lit("system"), F.lit("user")), "a request isn't exactly a system and a user turn")
    checked = required(checked, form["type"] == "json_schema", "a request has no JSON Schema")
    schema = F.struct(form["name"].alias("name"), F.coalesce(form["strict"], F.lit(False)).alias("strict"), form["schema"].alias("schema"))
    payload = F.struct(
        F.lit(model).alias("model"), turns.alias("messages"), F.lit(temperature).alias("temperature"), F.lit(top_p).alias("top_p"), F.lit(seed).alias("seed"),
        F.col("_r.body.max_output_tokens").alias("max_tokens"), F.struct(F.lit("json_schema").alias("type"), schema.alias("json_schema")).alias("response_format"),
    )
    return checked.withColumn("payload", F.to_json(payload)).drop("_r")


SCOPE_LABELS = ["positive", "negative", "absent"]


def scope_schema(most: int = 800) -> str:
    """JSON Schema of a reference's scope: a label for each dimension and a rationale."""
    fields = {n: {"type": "string", "enum": SCOPE_LABELS} for n in DIMENSION_WEIGHTS} | {"rationale": {"type": "string", "minLength": 1, "maxLength": most}}
    return json.dumps({"type": "object", "properties": fields, "required": list(fields), "additionalProperties": False})


def consistency_fields() -> dict:
    """What a judge of a whole response says beside its decisions."""
    marks = {n: {"type": "integer", "minimum": 0, "maximum": 5} for n in ("discussion_quality", "discussion_conclusion_consistency", "grounding_and_safety")}
    return marks | {n: {"type": "boolean"} for n in ("major_contradiction", "unsafe_addition")}


def reward_payload(system: str, user: Column, name: str, schema: Column, model: str, max_tokens: int) -> Column:
    """A chat request in JSON with decoding fixed and thinking off; `schema` is JSON text and goes in as it is."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    form = F.struct(F.lit(name).alias("name"), F.lit(True).alias("strict"), F.parse_json(schema).alias("schema"))
    fields = {
        "model": F.lit(model), "messages": F.array(message("system", F.lit(system.strip())), message("user", user)), "temperature": F.lit(0.0), "top_p": F.lit(1.0), "seed": F.lit(0),
        "max_tokens": F.lit(max_tokens), "chat_template_kwargs": F.struct(F.lit(False).alias("enable_thinking")), "response_format": F.struct(F.lit("json_schema").alias("type"), form.alias("json_schema")),
    }
    return F.to_json(F.struct(*(v.alias(k) for k, v in fields.items())))


def scope_payload(system: str, reference: Column, evidence: Column, model: str, name: str = "reference_scope", max_tokens: int = 384) -> Column:
    """The request that asks which dimensions a reference's conclusion takes a stand on."""
    return reward_payload(system, sections(case_evidence=evidence, reference_conclusion=reference), name, F.lit(scope_schema()), model, max_tokens)


def consistency_payload(system: str, evidence: Column, scopes: dict[str, Column], reference: tuple[Column, Column], candidate: tuple[Column, Column], model: str, name: str = "consistency", max_tokens: int = 768) -> Column:
    """The request that asks whether a candidate's (discussion, conclusion) agrees with itself and the reference's, decisions bound by scope."""
    scope = F.to_json(F.struct(*(c.alias(n) for n, c in scopes.items())))
    user = sections(case_evidence=evidence, scope=scope, reference_discussion=reference[0], reference_conclusion=reference[1], candidate_discussion=candidate[0], candidate_conclusion=candidate[1])
    schema = decision_schema_of(*(scopes[n] for n in DIMENSION_WEIGHTS), extra=consistency_fields(), most=1600)
    return reward_payload(system, user, name, schema, model, max_tokens)


def repair_prompt(head: str, pairs: Column) -> Column:
    """`head` and the pairs (question, answer) as a JSON array with their places."""
    return F.concat(F.lit(head), F.to_json(F.transform(pairs, lambda p, i: F.struct(i.alias("index"), p["question"].alias("question"), p["answer"].alias("answer")))))


def literal_fields(text: Column, schema: str) -> Column:
    """Fields of a dictionary written as a Python literal: quotes of either kind, and True, False and None outside of strings."""
    string = r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\""
    pieces = F.regexp_extract_all(text, F.lit(rf"{string}|[^'\"]+"), F.lit(0))
    plain = lambda p: F.regexp_replace(F.regexp_replace(F.regexp_replace(p, r"\bTrue\b", "true"), r"\bFalse\b", "false"), r"\bNone\b", "null")
    rewritten = F.transform(pieces, lambda p: F.when(p.rlike(r"^['\"]"), p).otherwise(plain(p)))
    return F.from_json(F.array_join(rewritten, ""), schema, {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"})
