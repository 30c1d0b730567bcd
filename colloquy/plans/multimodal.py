"""Registered queries of rows with pictures, of what a response's form reports, and of judges' requests, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.functions import text as X
from colloquy.operators import multimodal as W
from colloquy.operators import requests as M
from colloquy.operators import scoring as R
from colloquy.operators import training as N
from colloquy.plans.fixtures import table
from colloquy.plans.forms import forms_sql
from colloquy.plans.registry import query, responses, turns


@query("""
SELECT c.conv_id, concat('[', string_agg(text, '|' ORDER BY turn), ']') AS parts, count(*) AS n_text FROM conversations c WHERE text <> '' GROUP BY c.conv_id
""")
def interleaved_parts(spark, sf):
    rows = turns(spark, sf).where("text <> ''").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("t"))
    joined = rows.withColumn("joined", F.array_join("t.text", "<image>")).withColumn("urls", F.transform(F.slice("t", 2, F.size("t")), lambda x: x["pos"].cast("string")))
    parts = X.text_parts(W.content_parts(W.split_at_markers(F.col("joined")), F.col("urls")))
    return joined.withColumn("p", parts).select("conv_id", F.concat(F.lit("["), F.array_join("p.text", "|"), F.lit("]")).alias("parts"), F.size("p").cast("long").alias("n_text"))


PROMPT = "Read the slides."
OPEN, CLOSE = W.SLIDE_BLOCK


@query("""
WITH f AS (SELECT DISTINCT url FROM pages WHERE url IS NOT NULL AND page_id % 4 <> 0),
r AS (
  SELECT page_id, url, replace(coalesce(substr(html, 1, 200), ''), '<image>', '') AS x, (page_id + 1) % 5 = 0 AS bad_turns, (page_id + 1) % 7 = 0 AS bad_system, (page_id + 1) % 11 = 0 AS bad_hash,
         CASE WHEN page_id % 3 = 0 THEN 2 ELSE 1 END AS marks, CASE WHEN page_id % 6 = 5 THEN 0 WHEN page_id % 3 = 0 THEN 2 ELSE 1 END AS images
  FROM pages
),
m AS (SELECT r.*, images > 0 AND (r.url IS NULL OR f.url IS NULL) AS gone FROM r LEFT JOIN f ON r.url = f.url),
w AS (SELECT *, CASE WHEN bad_turns THEN 'turns' WHEN bad_system THEN 'system' WHEN gone THEN 'images' WHEN bad_hash THEN 'hash' WHEN marks <> images THEN 'markers' END AS fault FROM m)
SELECT page_id, fault, CASE WHEN gone THEN images::BIGINT END AS n_missing,
       CASE WHEN fault IS NULL THEN CASE WHEN marks = 2 THEN 'text,image,text,image,text' ELSE 'text,image,text' END END AS kinds,
       CASE WHEN fault IS NULL THEN sha256('<image> before' || chr(10) || '<SLIDE_DESCRIPTIONS>' || chr(10) || 'a ') END AS first_sha256
FROM w
""")
def multimodal_rows(spark, sf):
    """Each page as a row of one or two slides; a marker before the slide block is plain text, and turns, prompt, hash, files and counts are wrong by id."""
    k, p = F.col("page_id"), table(spark, sf, "pages")
    files = p.where("page_id % 4 <> 0").select(F.col("url").alias("path"))
    marks = F.when(k % 3 == 0, "a <image> b <image> c").otherwise("a <image> b")
    text = F.replace(F.coalesce(F.substring("html", 1, 200), F.lit("")), F.lit("<image>"), F.lit(""))
    human = F.concat(F.lit("<image> before\n" + OPEN), marks, F.lit(CLOSE), text)
    system = F.when((k + 1) % 7 == 0, "Something else.").otherwise(f" {PROMPT}\n")
    turn_list = F.array(N.turn("system", system), N.turn("human", human))
    n = F.when(k % 6 == 5, 0).when(k % 3 == 0, 2).otherwise(1)
    rows = p.select(
        k, F.when((k + 1) % 5 == 0, F.reverse(turn_list)).otherwise(turn_list).alias("conversations"), F.array_repeat("url", n).alias("images"),
        F.when((k + 1) % 11 == 0, F.lit("0")).when(k % 2 == 0, W.messages_hash(system, human)).alias("messages_sha256"),
    )
    out = W.multimodal_rows(rows, files, PROMPT, declared="messages_sha256")
    # up to two missing images are named, and no row here has more
    return out.select(k, "fault", F.when(F.col("missing").isNotNull(), F.size("missing").cast("long")).alias("n_missing"), F.array_join("content.type", ",").alias("kinds"), F.sha2(F.get("content", F.lit(0))["text"], 256).alias("first_sha256"))


@query("""
WITH b AS (
  SELECT user_id, event_id, (abs(floor(value * 10)::BIGINT) % 70) AS x, (event_id % 30) AS y, (20 + abs(floor(value * 100)::BIGINT) % 60) AS w, (15 + event_id % 25) AS h, CASE WHEN event_id % 8 <> 0 THEN event_id % 40 END AS q FROM events WHERE value IS NOT NULL
),
a AS (SELECT *, w * h * (6 + event_id % 5) // 10 AS area FROM b),
s AS (SELECT *, CASE WHEN area / 6000.0::DOUBLE >= 0.08::DOUBLE AND w / h::DOUBLE BETWEEN 1.1::DOUBLE AND 2.6::DOUBLE AND area / 6000.0::DOUBLE <= 0.75::DOUBLE AND w * h / 6000.0::DOUBLE <= 0.75::DOUBLE
  THEN area / 6000.0::DOUBLE * (area / (w * h)::DOUBLE) * ((1 - abs((x + w / 2.0::DOUBLE) / 100 - 0.5::DOUBLE)) * (1 - greatest((y + h / 2.0::DOUBLE) / 60 - 0.7::DOUBLE, 0))) ELSE 0 END AS score FROM a),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_id) AS i FROM s)
SELECT user_id, CASE WHEN score > 0 THEN event_id END AS region, CASE WHEN score > 0 THEN w END AS w, round(score, 9) AS score, CASE WHEN score <= 0 THEN 'none' WHEN q < 12 THEN 'blurred' ELSE 'slide' END AS verdict FROM n WHERE i = 1
""")
def best_slides(spark, sf):
    """Each event as a region of its user's frame of 100 x 60."""
    k, v = F.col("event_id"), F.col("value")
    box = {"x": F.abs(F.floor(v * 10)) % 70, "y": k % 30, "w": 20 + F.abs(F.floor(v * 100)) % 60, "h": 15 + k % 25, "region": k}
    events = table(spark, sf, "events").where("value is not null").select("user_id", k, F.struct(*(c.cast("long").alias(n) for n, c in box.items())).alias("box"), F.lit(100).alias("width"), F.lit(60).alias("height"), F.when(k % 8 != 0, k % 40).alias("sharpness"))
    events = events.withColumn("area", F.expr("box.w * box.h * (6 + event_id % 5) div 10"))
    return W.best_slides(events, ["user_id"], "event_id").select("user_id", "box.region", "box.w", F.round("score", 9).alias("score"), "verdict")


@query(f"""
WITH {forms_sql("CASE WHEN conv_id % 2 = 0 AND turn = 0 THEN 'Moderator' ELSE role END")}
SELECT conv_id, nt::BIGINT AS turns, nr::BIGINT AS roles, s::BIGINT AS sentences, (nr >= 2)::INT::DOUBLE AS dialogue_roles, led AS moderator_first, ((nr >= 2)::INT + led) / 2 AS dialogue_structure,
       round(syn, 6) AS turn_syntax, round(num, 6) AS turn_numbering, round(dense, 6) AS dense, exact, round(base, 6) AS base FROM forms
""")
def response_forms(spark, sf):
    led = F.when((F.col("conv_id") % 2 == 0) & (F.col("pos") == 0), "Moderator").otherwise(F.col("speaker_id"))
    s = R.serialization(responses(spark, sf, led), "response")
    counts = {"turns": "turn_count", "roles": "role_count", "sentences": "conclusion_sentence_count"}
    whole = {"dialogue_roles": "dialogue_roles", "moderator_first": "moderator_first", "dialogue_structure": "dialogue_structure", "exact": "exact"}
    parts = {"turn_syntax": "turn_syntax", "turn_numbering": "turn_numbering", "dense": "dense_score", "base": "base_score"}
    return s.select("conv_id", *(F.col(f"format_{v}").cast("long").alias(k) for k, v in counts.items()), *(F.col(f"format_{v}").alias(k) for k, v in whole.items()), *(F.round(f"format_{v}", 6).alias(k) for k, v in parts.items()))


SCOPES = "CASE WHEN item_id % {} = 0 THEN 'absent' ELSE 'positive' END"


@query(f"""
WITH b AS (SELECT *, {SCOPES.format(2)} AS t, {SCOPES.format(3)} AS s, chr(10) AS n FROM benchmark WHERE text IS NOT NULL)
SELECT item_id, 'judge-1' AS model, 384 AS scope_tokens, '["positive","negative","absent"]' AS scope_labels,
       '<CASE_EVIDENCE>' || n || 'seen ' || item_id || n || '</CASE_EVIDENCE>' || n || n || '<REFERENCE_CONCLUSION>' || n || text || n || '</REFERENCE_CONCLUSION>' AS scope_user,
       '<CASE_EVIDENCE>' || n || 'seen ' || item_id || n || '</CASE_EVIDENCE>' || n || n || '<SCOPE>' || n || '{{"therapy":"' || t || '","surgery":"' || s || '","next_action":"positive","clinical_trial":"positive"}}' || n || '</SCOPE>' || n || n
       || '<REFERENCE_DISCUSSION>' || n || n || '</REFERENCE_DISCUSSION>' || n || n || '<REFERENCE_CONCLUSION>' || n || text || n || '</REFERENCE_CONCLUSION>' || n || n
       || '<CANDIDATE_DISCUSSION>' || n || 'Re: ' || text || n || '</CANDIDATE_DISCUSSION>' || n || n || '<CANDIDATE_CONCLUSION>' || n || 'so' || n || '</CANDIDATE_CONCLUSION>' AS reward_user,
       768 AS reward_tokens, 'false' AS thinking, CASE WHEN t = 'absent' THEN '[-1]' END AS therapy_enum, CASE WHEN s = 'absent' THEN NULL ELSE 5 END AS surgery_most, 10 AS n_required, 1600 AS rationale_most
FROM b
""")
def reward_payloads(spark, sf):
    """Each benchmark item as the reference of a scope request, and of a reward request whose candidate discussion quotes the item."""
    k = F.col("item_id")
    scopes = {n: F.when(k % m == 0, "absent").otherwise("positive") if m else F.lit("positive") for n, m in zip(R.DIMENSION_WEIGHTS, (2, 3, 0, 0))}
    evidence = F.concat(F.lit("seen "), k.cast("string"))
    items = table(spark, sf, "benchmark").where("text is not null").select("item_id", "text")
    p = items.select(
        "item_id", M.scope_payload("judge", F.col("text"), evidence, "judge-1").alias("scope"),
        M.consistency_payload("judge", evidence, scopes, (F.lit(None).cast("string"), F.col("text")), (F.concat(F.lit("Re: "), "text"), F.lit("so")), "judge-1").alias("reward"),
    )
    field = lambda column, path: F.get_json_object(column, "$." + path)
    schema = "response_format.json_schema.schema."
    return p.select(
        "item_id", field("reward", "model").alias("model"), field("scope", "max_tokens").cast("int").alias("scope_tokens"), field("scope", schema + "properties.surgery.enum").alias("scope_labels"), field("scope", "messages[1].content").alias("scope_user"),
        field("reward", "messages[1].content").alias("reward_user"), field("reward", "max_tokens").cast("int").alias("reward_tokens"), field("reward", "chat_template_kwargs.enable_thinking").alias("thinking"),
        field("reward", schema + "properties.therapy.enum").alias("therapy_enum"), field("reward", schema + "properties.surgery.maximum").cast("int").alias("surgery_most"),
        F.size(F.from_json(field("reward", schema + "required"), "array<string>")).alias("n_required"), field("reward", schema + "properties.rationale.maxLength").cast("int").alias("rationale_most"),
    )
