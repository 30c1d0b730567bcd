"""Registered queries of the smaller filters, checks and joins over curated, evaluated and edited rows, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.functions import edits as E
from colloquy.functions import parsers as P
from colloquy.functions import schemas as V
from colloquy.functions import text as X
from colloquy.operators import aggregates as A
from colloquy.operators import deleak as D
from colloquy.operators import filters as L
from colloquy.operators import intervals as I
from colloquy.operators import joins as K
from colloquy.operators import scoring as R
from colloquy.operators import sequences as Q
from colloquy.operators import training as N
from colloquy.plans import fixtures as fx
from colloquy.plans.fixtures import C, U, table
from colloquy.plans.registry import query, turns
from colloquy.sources.readers import utterance_table

ENDS = r"'^\s+|\s+$', '', 'g'"


@query("SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length(trim(line)) >= 60 GROUP BY doc_id")
def long_lines(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return L.long_enough(lines, "line").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 OR trim(coalesce(text, '')) = '' THEN 'empty transcript' END AS reason FROM documents")
def default_verdicts(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 5 == 0, "  ").otherwise(F.col("text")).alias("transcript"))
    return L.default_verdict(docs).select("doc_id", "verdict.reason")


@query("SELECT doc_id FROM documents WHERE doc_id % 3 <> 0 AND doc_id IN (SELECT doc_id FROM labels GROUP BY doc_id HAVING max(quality) = 1)")
def case_presentations(spark, sf):
    k = F.col("doc_id")
    labels = table(spark, sf, "labels").groupBy("doc_id").agg((F.max("quality") == 1).alias("is_case_presentation"))
    docs = table(spark, sf, "documents").select("doc_id")
    verdicts = docs.join(labels, "doc_id", "left").withColumn("video", F.concat(F.lit("v"), k.cast("string"), F.when(k % 2 == 0, ".mp4").otherwise("")))
    files = docs.where(k % 3 != 0).select(F.concat(F.lit("v"), k.cast("string"), F.when(k % 2 == 1, ".mp4").otherwise("")).alias("file"))
    return L.case_presentations(verdicts, files).select("doc_id")


@query("""
SELECT conv_id, string_agg(turn::VARCHAR, ',' ORDER BY turn) AS kept FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
WHERE i = n - 1 OR i % 3 <> 1 GROUP BY conv_id
""")
def verified_parts(spark, sf):
    lists = turns(spark, sf).groupBy("conv_id").agg(F.array_sort(F.collect_list("pos")).alias("k"))
    verdicts = F.transform(F.slice("k", F.lit(1), F.size("k") - 1), lambda _, i: i % 3 != 1)
    return lists.select("conv_id", F.array_join(L.verified(F.col("k"), verdicts), ",").alias("kept"))


@query("SELECT doc_id FROM documents WHERE text IS NOT NULL AND doc_id % 3 <> doc_id % 2")
def marker_mismatches(spark, sf):
    k = F.col("doc_id")
    docs = table(spark, sf, "documents").select("doc_id", F.concat("text", F.repeat(F.lit("<image>"), (k % 3).cast("int"))).alias("text"), F.array_repeat(F.lit("x"), (k % 2).cast("int")).alias("images"))
    return L.marker_mismatch(docs, "text", "images").select("doc_id")


@query("""
SELECT doc_id, doc_id % 3 <> 0 AND doc_id % 5 <> 0 AND doc_id % 7 <> 0 AS valid FROM documents WHERE text IS NOT NULL
""")
def row_shapes(spark, sf):
    k = F.col("doc_id")
    system, human = N.turn("system", F.lit(" p ")), N.turn("human", F.col("text"))
    docs = table(spark, sf, "documents").where("text is not null").withColumns({
        "turns": F.when(k % 3 == 0, F.array(human)).otherwise(F.array(system, human)),
        "meta": F.when(k % 5 == 0, -1).otherwise(k),
        "h": F.sha2(F.when(k % 7 == 0, "x").otherwise(F.col("text")), 256),
    })
    return docs.select("doc_id", L.valid_rows("turns", "doc_id", "meta", "p", "h").alias("valid"))


@query("SELECT doc_id, source FROM documents")
def reference_free(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", F.col("text").alias("reference_text"), F.sha2("text", 256).alias("text_sha256"), F.col("lang").alias("_lang"))
    return L.reference_free(docs)


@query("SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 5 END AS score, doc_id % 4 <> 0 AS exact_keys FROM documents")
def judge_score_checks(spark, sf):
    k = F.col("doc_id")
    value = F.element_at(F.array(*map(F.lit, ["1", "3", "5", "6", "4.0", "true"])), (k % 6 + 1).cast("int"))
    body = F.concat(F.lit('{"score": '), value, F.lit(', "rationale": "x"'), F.when(k % 4 == 0, ', "more": 1').otherwise(""), F.lit("}"))
    docs = table(spark, sf, "documents").select("doc_id", body.alias("body"))
    return docs.select("doc_id", L.judge_score(F.col("body"), "score").alias("score"), L.has_exactly(F.col("body"), ["score", "rationale"]).alias("exact_keys"))


@query("SELECT conv_id, count(*) AS count FROM conversations GROUP BY conv_id HAVING count(*) > 1")
def repeated_ids(spark, sf):
    return L.repeated_ids(table(spark, sf, "conversations"), "conv_id")


@query("""
WITH b AS (SELECT source AS key, count(*)::VARCHAR AS b FROM documents GROUP BY source), n AS (SELECT source AS key, count(*)::VARCHAR AS n FROM documents WHERE lang <> 'de' GROUP BY source)
SELECT coalesce(b.key, n.key) AS key, b AS before, n AS "now" FROM b FULL JOIN n ON b.key = n.key WHERE coalesce(b.key, n.key) IN ('src0', 'src1', 'src2', 'src99') AND b IS DISTINCT FROM n
""")
def incompatible_runs(spark, sf):
    docs = table(spark, sf, "documents")
    before, now = (d.groupBy(F.col("source").alias("key")).agg(F.count(F.lit(1)).cast("string").alias("value")) for d in (docs, docs.where("lang <> 'de'")))
    return K.incompatible(before, now, ["src0", "src1", "src2", "src99"])


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def id_subset(spark, sf):
    return L.subset_by_id(table(spark, sf, "documents").select("doc_id", "source"), table(spark, sf, "labels"), "doc_id")


@query("SELECT event_id, round(greatest(0, least(x + 20, 45) - greatest(x, 25)) * 5 / 200.0::DOUBLE, 6) AS share FROM (SELECT event_id, floor(value)::INT % 50 AS x FROM events WHERE value IS NOT NULL)")
def covered_boxes(spark, sf):
    def box(x, y, w, h):
        return F.struct(*(F.lit(v).cast("int").alias(n) if not hasattr(v, "cast") else v.alias(n) for v, n in ((x, "x"), (y, "y"), (w, "w"), (h, "h"))))

    events = table(spark, sf, "events").where("value is not null").select("event_id", box(F.floor("value").cast("int") % 50, 0, 20, 10).alias("b"))
    return events.select("event_id", F.round(L.covered_share(F.col("b"), F.array(box(25, 5, 20, 10), box(500, 500, 1, 1))), 6).alias("share"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 <> 0 AND doc_id % 4 <> 0 THEN 'positive' END AS scope FROM documents WHERE text IS NOT NULL")
def frozen_scopes(spark, sf):
    k = F.col("doc_id")
    docs = table(spark, sf, "documents").where("text is not null")
    scopes = docs.where(k % 3 != 0).select(k.alias("source_id"), F.sha2(F.when(k % 4 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("reference_sha256"), F.lit("positive").alias("scope"))
    return K.frozen_scope(docs.select(k.alias("source_id"), F.col("text").alias("reference")), scopes).select(F.col("source_id").alias("doc_id"), "scope")


@query("""
WITH e AS (SELECT conv_id, turn % 3 AS id, turn * 2 AS p FROM conversations UNION ALL SELECT conv_id, turn % 2 + 1, turn * 2 + 1 FROM conversations), f AS (SELECT conv_id, id, min(p) AS p FROM e GROUP BY conv_id, id)
SELECT conv_id, string_agg(id::VARCHAR, ',' ORDER BY p) AS slides FROM f GROUP BY conv_id
""")
def shown_slides(spark, sf):
    rows = turns(spark, sf).select("conv_id", "pos", F.array(F.col("pos") % 3, F.col("pos") % 2 + 1).alias("ids"))
    return A.distinct_slides(rows, "conv_id", "pos", "ids").select("conv_id", F.array_join("slide_ids", ",").alias("slides"))


@query("""
SELECT round(avg((event_id % 5 > 0)::INT), 9) AS start_rate, round(avg((event_id % 2 = 0)::INT), 9) AS end_rate, round(avg((user_id % 3 = 0)::INT), 9) AS fallback_rate, round(sum(event_id % 7) / greatest(sum(event_id % 11), 1), 9) AS selected_share FROM events
""")
def mask_diagnostics(spark, sf):
    k = F.col("event_id")
    rows = table(spark, sf, "events").select((k % 5 > 0).alias("start_found"), (k % 2 == 0).alias("end_found"), (F.col("user_id") % 3 == 0).alias("fallback"), (k % 7).alias("selected"), (k % 11).alias("response"))
    out = A.mask_diagnostics(rows)
    return out.select(*(F.round(c, 9).alias(c) for c in out.columns))


@query(f"""
WITH t AS (SELECT * FROM conversations WHERE role <> 'system' AND text IS NOT NULL), c AS (SELECT *, CASE WHEN role IS DISTINCT FROM lag(role) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS ch FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
r AS (SELECT *, sum(ch) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM c)
SELECT conv_id, run::BIGINT AS run, list_reduce(list(text ORDER BY turn), lambda a, x: regexp_replace(a, '\\s+$', '') || ' ' || regexp_replace(x, {ENDS})) AS text FROM r GROUP BY conv_id, run
""")
def stripped_runs(spark, sf):
    spoken = turns(spark, sf).where("speaker_id <> 'system' and text is not null")
    return Q.merged_runs(spoken, ["conv_id"], "strip").select("conv_id", "run", "text")


@query(r"SELECT page_id, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '^(.+)\.[^.]*$', '\1') AS stem, CASE WHEN starts_with(url, 'https:/') THEN 'file:' || substr(url, 7) ELSE url END AS moved FROM pages")
def path_parts(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.file_stem(F.col("url")).alias("stem"), X.remap_prefix(F.col("url"), "https:", "file:").alias("moved"))


@query("SELECT conv_id, arg_min(text, turn) FILTER (role = 'assistant' AND text <> '') AS answer FROM conversations GROUP BY conv_id")
def judge_texts(spark, sf):
    part = lambda kind: F.struct(F.lit(kind).alias("type"), F.nullif("text", F.lit("")).alias("text"))
    item = F.struct("pos", F.when(F.col("speaker_id") == "assistant", "message").otherwise("note").alias("type"), F.array(part("refusal"), part("output_text")).alias("content"))
    lists = turns(spark, sf).groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("o"))
    output = F.transform("o", lambda x: F.struct(x["type"].alias("type"), x["content"].alias("content")))
    return lists.select("conv_id", output.alias("o")).select("conv_id", P.judge_output_text(F.col("o")).alias("answer"))


@query("SELECT event_id, event_id % 9 >= CASE WHEN event_id % 2 = 0 THEN 5 ELSE 7 END AS truncated FROM events")
def truncation_flags(spark, sf):
    k = F.col("event_id")
    return table(spark, sf, "events").select("event_id", R.is_truncated(k % 9, F.when(k % 2 == 0, 5), F.lit(7)).alias("truncated"))


@query(r"""
SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '[ \t\n\r\f\x0B]+', ' ', 'g'), '^ | $', '', 'g') || chr(31) || 'a' || chr(31) || (doc_id % 3)) AS identity, coalesce(nullif(CASE WHEN doc_id % 2 = 0 THEN '' ELSE source END, ''), nullif(lang, '')) AS origin
FROM documents WHERE text IS NOT NULL
""")
def input_identities(spark, sf):
    k = F.col("doc_id")
    docs = table(spark, sf, "documents").where("text is not null").withColumns({"images": F.array(F.lit("a"), (k % 3).cast("string")), "source": F.when(k % 2 == 0, "").otherwise(F.col("source"))})
    return docs.select("doc_id", L.identity(docs, "text", "images").alias("identity"), L.source_identity(F.col("source"), F.col("lang")).alias("origin"))


@query("SELECT doc_id, doc_id % 7 BETWEEN 1 AND 5 AND doc_id % 4 <> 0 AND doc_id % 5 <> 0 AS scores_valid FROM documents")
def score_validity(spark, sf):
    k = F.col("doc_id")
    scores = {"alignment_score": k % 7, "rationale": F.when(k % 4 == 0, " ").otherwise("x")}
    for i, n in enumerate(R.DIMENSION_WEIGHTS):
        scores[f"scope_{n}"] = F.when((k + i) % 3 == 0, "absent").otherwise("positive")
        scores[n] = F.when((k + i) % 3 == 0, F.when(k % 5 == 0, 0).otherwise(-1)).otherwise((k + i) % 6)
    return R.valid_scores(table(spark, sf, "documents").select("doc_id").withColumns(scores)).select("doc_id", "scores_valid")


@query("""
SELECT doc_id, doc_id % 3 = 0 AS is_same, doc_id % 3 = 1 AND contains(text, ' ') AS is_repair, doc_id % 2 = 0 AS is_verbatim FROM documents WHERE text <> ''
""")
def deleak_edits(spark, sf):
    k, text = F.col("doc_id"), F.col("text")
    after = F.when(k % 3 == 0, text).when(k % 3 == 1, F.regexp_replace(text, "^[^ ]* ", "")).otherwise(F.concat(text, F.lit(" extra")))
    docs = table(spark, sf, "documents").where("text <> ''").withColumns({"after": F.when((k % 3 == 1) & (F.col("text") == after), F.concat(text, F.lit("!"))).otherwise(after), "removed": F.array(F.when(k % 2 == 0, text).otherwise(F.concat(text, F.lit("#"))))})
    empty = F.array().cast("array<string>")
    return docs.select("doc_id", D.unchanged(F.lit("clean"), text, F.col("after"), empty).alias("is_same"), D.repair_holds(text, F.col("after")).alias("is_repair"), D.removals_verbatim(text, F.col("removed")).alias("is_verbatim"))


@query("""
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN doc_id % 8 = 0 WHEN 1 THEN contains(text, ' ') AND doc_id % 3 <> 0 ELSE doc_id % 3 <> 0 END AS holds FROM documents WHERE text <> ''
""")
def deleak_questions(spark, sf):
    k = F.col("doc_id")
    before = F.concat("text", F.lit("?"))
    verdict = F.element_at(F.array(*map(F.lit, ["keep", "trim", "paraphrase", "drop"])), (k % 4 + 1).cast("int"))
    after = F.when(k % 8 == 0, before).when(k % 4 == 0, F.concat(before, F.lit("x"))).when(k % 4 == 1, F.regexp_replace(before, "^[^ ]* ", "")).when(k % 4 == 2, F.concat(F.lit("Is it so: "), before)).otherwise("")
    docs = table(spark, sf, "documents").where("text <> ''").select("doc_id", verdict.alias("v"), before.alias("b"), after.alias("a"), F.when(k % 3 != 0, "why").alias("r"))
    return docs.select("doc_id", D.question_holds(F.col("v"), F.col("b"), F.col("a"), F.col("r")).alias("holds"))


@query("""
SELECT event_type, count(*) AS n, count(*) FILTER (event_id % 3 = 2) AS invalid, round(avg((event_id % 3 = 0)::INT), 9) AS rate_leak, round(avg((event_id % 3 = 1)::INT), 9) AS rate_clean FROM events GROUP BY event_type
""")
def audit_rates(spark, sf):
    found = F.element_at(F.array(*map(F.lit, ["LEAK", "CLEAN", "odd"])), (F.col("event_id") % 3 + 1).cast("int"))
    out = D.audit_rates(table(spark, sf, "events").withColumn("found", found), "event_type", "found", ["LEAK", "CLEAN"])
    return out.withColumns({c: F.round(c, 9) for c in ("rate_leak", "rate_clean")})


@query("SELECT conv_id, turn AS pos FROM conversations WHERE conv_id % 3 <> 0 OR conv_id % 2 = 1")
def edited_cases(spark, sf):
    k = F.col("conv_id")
    c = turns(spark, sf)
    edits = c.select("conv_id").distinct().withColumns({"summary_verdict": F.when(k % 3 == 0, "KEEP").otherwise("trim"), "captions": F.array(F.struct(F.when(k % 2 == 1, "drop").otherwise("Keep").alias("verdict")))})
    return N.edited_cases(c.select("conv_id", "pos"), edits, ["conv_id"])


@query("SELECT event_id, round(value - event_id % 50, 6) AS score FROM events WHERE value - event_id % 50 >= 0")
def scored_frames(spark, sf):
    frames = table(spark, sf, "events").select("event_id", F.col("value").alias("positive"), (F.col("event_id") % 50).alias("negative"))
    return N.above_score(frames, 0.0).select("event_id", F.round("score", 6).alias("score"))


@query(f"WITH {U}, {C} SELECT recording, case_id, CASE WHEN start_sec >= 86400 THEN start_sec END AS case_start_sec, CASE WHEN start_sec >= 86400 THEN end_sec END AS case_end_sec FROM cs")
def case_bounds(spark, sf):
    cases = fx.cases(spark, sf)
    return N.with_bounds(cases.select("recording", "case_id"), cases.where("start_sec >= 86400"), ["recording", "case_id"])


@query(f"WITH {U}, {C}, k AS (SELECT recording, case_id, count(*) AS n FROM utt JOIN cs USING (recording) WHERE utt.start_sec >= cs.start_sec AND utt.end_sec <= cs.end_sec AND speaker_id = 'view' GROUP BY ALL) SELECT recording, case_id, coalesce(n, 0)::BIGINT AS n FROM cs LEFT JOIN k USING (recording, case_id)")
def case_alignments(spark, sf):
    cases = fx.cases(spark, sf)
    held = I.within_cases(fx.utterances(spark, sf).where("speaker_id = 'view'"), cases)
    aligned = held.groupBy("recording", "case_id").agg(F.array_sort(F.collect_list("utterance_id")).alias("aligned_utterances"))
    return N.with_alignment(cases.select("recording", "case_id"), aligned, ["recording", "case_id"]).select("recording", "case_id", F.size("aligned_utterances").cast("long").alias("n"))


@query("SELECT count(*) AS n, count(*) FILTER (doc_id % 2 = 1) AS custom, count(*) FILTER (doc_id % 2 = 0) AS sharegpt, false AS ok FROM documents")
def row_formats(spark, sf):
    return N.one_format(table(spark, sf, "documents").select(F.when(F.col("doc_id") % 2 == 0, F.array("text")).alias("conversations")))


@query(f"SELECT conv_id AS recording, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS pos, printf('utt_%06d', row_number() OVER (PARTITION BY conv_id ORDER BY turn)) AS utterance_id, round(turn + 0.1234::DOUBLE, 3) AS start_sec, turn + 1.0::DOUBLE AS end_sec, regexp_replace(text, {ENDS}) AS text FROM conversations")
def utterance_rows(spark, sf):
    one = F.struct((F.col("pos") + F.lit(0.1234)).alias("start_sec"), "end_sec", "text")
    lists = turns(spark, sf).groupBy(F.col("conv_id").alias("recording")).agg(F.array_sort(F.collect_list(one)).alias("utterances"))
    return utterance_table(lists)


@query("SELECT event_type, CASE event_id % 5 WHEN 0 THEN 'length' WHEN 1 THEN NULL ELSE 'stop' END AS finish_reason, count(*) AS n FROM events WHERE NOT coalesce(value < 1, false) GROUP BY ALL")
def finish_reasons(spark, sf):
    k = F.col("event_id")
    rows = table(spark, sf, "events").select("event_type", F.when(F.col("value") < 1, "failed").alias("error"), F.when(k % 5 == 0, "length").when(k % 5 != 1, "stop").alias("finish_reason"))
    return A.finish_reasons(rows, "event_type")


@query("""
WITH o AS (SELECT CASE WHEN conv_id % 5 = 0 AND turn = 0 THEN '' ELSE (CASE WHEN conv_id % 3 = 0 THEN conv_id * 1000 + turn ELSE conv_id * 1000 END)::VARCHAR END AS id FROM conversations), b AS (SELECT DISTINCT (conv_id * 1000)::VARCHAR AS id FROM conversations),
g AS (SELECT id, CASE WHEN id = '' THEN 'empty' WHEN count(*) > 1 THEN 'repeated' WHEN id NOT IN (SELECT id FROM b) THEN 'unknown' END AS reason FROM o GROUP BY id)
SELECT id, reason FROM g WHERE reason IS NOT NULL
""")
def bad_output_ids(spark, sf):
    c = turns(spark, sf)
    base = F.col("conv_id") * 1000
    outputs = c.select(F.when((F.col("conv_id") % 5 == 0) & (F.col("pos") == 0), "").otherwise(F.when(F.col("conv_id") % 3 == 0, base + F.col("pos")).otherwise(base).cast("string")).alias("id"))
    return L.bad_ids(outputs, c.select(base.cast("string").alias("id")), "id")


@query("""
SELECT doc_id, CASE doc_id % 9 WHEN 1 THEN '$: json' WHEN 2 THEN '$: type' WHEN 3 THEN '$: required' WHEN 4 THEN '$: additionalProperties' WHEN 5 THEN '$.clinical_equivalence_score: maximum'
  WHEN 6 THEN '$.clinical_equivalence_score: minimum' WHEN 7 THEN '$.clinical_equivalence_score: type' WHEN 8 THEN '$.critical_error: type' END AS broken FROM documents
""")
def rubric_checks(spark, sf):
    part = lambda *values: F.element_at(F.array(*map(F.lit, values)), (F.col("doc_id") % 9 + 1).cast("int"))
    score, flag = part("3", "3", "3", "3", "3", "6", "0", "3.0", "3"), part(*["true"] * 8, '"no"')
    tail = part(', "rationale": ', ', "rationale": ', ', "rationale": ', ', "unsupported_claim": true}', ', "more": 1, "rationale": ', *[', "rationale": '] * 4)
    said = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("t")))
    text = F.substring(said, F.lit(6), F.length(said) - 6)
    body = F.concat(F.lit('{"clinical_equivalence_score": '), score, F.lit(', "critical_error": '), flag, F.when(F.col("doc_id") % 9 == 3, "").otherwise(', "unsupported_claim": false'), tail, F.when(F.col("doc_id") % 9 == 3, "").otherwise(F.concat(text, F.lit("}"))))
    body = F.when(F.col("doc_id") % 9 == 1, F.concat(body, F.lit(" {}"))).when(F.col("doc_id") % 9 == 2, F.concat(F.lit("["), body, F.lit("]"))).otherwise(body)
    return table(spark, sf, "documents").select("doc_id", V.violation(body, V.rubric("clinical_equivalence")).alias("broken"))


@query("""
WITH d AS (SELECT doc_id, text, doc_id % 7 - 1 AS s, unnest(['therapy', 'surgery', 'next_action', 'clinical_trial']) AS name, unnest([0, 1, 2, 3]) AS i FROM documents),
b AS (SELECT doc_id, arg_min(CASE WHEN (doc_id + i) % 3 = 0 AND s > -1 THEN '$.' || name || ': maximum' WHEN (doc_id + i) % 3 <> 0 AND s < 0 THEN '$.' || name || ': minimum' END, i) AS broken FROM d GROUP BY doc_id)
SELECT doc_id, CASE WHEN text IS NULL THEN '$: required' WHEN broken IS NOT NULL THEN broken WHEN text = '' THEN '$.rationale: minLength' WHEN length(text) > 1200 THEN '$.rationale: maxLength' END AS broken FROM documents JOIN b USING (doc_id)
""")
def scoped_checks(spark, sf):
    k = F.col("doc_id")
    body = F.to_json(F.struct(*[(k % 7 - 1).alias(n) for n in V.DECISIONS], F.col("text").alias("rationale")))
    scope = {n: F.when((k + i) % 3 == 0, "absent").otherwise("positive") for i, n in enumerate(V.DECISIONS)}
    return table(spark, sf, "documents").select("doc_id", V.violation(body, V.scoped(scope)).alias("broken"))


@query(r"""
WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '')) AS w, generate_subscripts(list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> ''), 1) - 1 AS i FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, i AS p, 'removed' AS kind, i || '.' || w AS words FROM w WHERE i % 3 = 2 UNION ALL
      SELECT doc_id, CASE WHEN i % 3 = 2 THEN i ELSE i + 1 END, 'added', i || '+' || w FROM w WHERE i % 7 = 3),
g AS (SELECT doc_id, count(*) FILTER (kind = 'removed') AS n_removed, count(*) FILTER (kind = 'added') AS n_added, sha256(string_agg(kind || ':' || p || ':' || words, chr(10) ORDER BY p, kind DESC)) AS spans_sha256 FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_added, 0)::BIGINT AS n_added, coalesce(spans_sha256, sha256('')) AS spans_sha256 FROM documents LEFT JOIN g USING (doc_id) WHERE text IS NOT NULL
""")
def deleak_spans(spark, sf):
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    mark = lambda sign: lambda w, i: F.concat(i.cast("string"), F.lit(sign), w)
    docs = table(spark, sf, "documents").where("text is not null").select("doc_id", words.alias("w"))
    left = F.transform("w", lambda w, i: F.concat_ws(" ", F.when(i % 3 != 2, mark(".")(w, i)), F.when(i % 7 == 3, mark("+")(w, i))))
    docs = docs.select("doc_id", F.array_join(F.transform("w", mark(".")), " ").alias("before"), F.array_join(left, "\n").alias("after"))
    found = docs.select("doc_id", E.edit_spans(F.col("before"), F.col("after")).alias("s"))
    n = lambda kind: F.size(F.filter("s", lambda x: x["kind"] == kind)).cast("long")
    text = F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["kind"], x["at"].cast("string"), x["words"])), "\n")
    return found.select("doc_id", n("removed").alias("n_removed"), n("added").alias("n_added"), F.sha2(text, 256).alias("spans_sha256"))


@query("""
WITH s AS (SELECT conv_id, list_distinct(flatten(list(regexp_extract_all(lower(text), '[a-z0-9]+')))) AS known FROM conversations WHERE role = 'user' AND text IS NOT NULL GROUP BY conv_id)
SELECT conv_id, turn AS pos, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')), lambda x: length(x) >= 4 AND NOT list_contains(coalesce(known, []), x))), ' ') AS outside
FROM conversations LEFT JOIN s USING (conv_id) WHERE role = 'assistant'
""")
def deleak_vocabulary(spark, sf):
    c = turns(spark, sf)
    out = D.outside_vocabulary(c.where("speaker_id = 'assistant'"), ["conv_id", "pos"], "conv_id", "text", c.where("speaker_id = 'user'"))
    return out.select("conv_id", "pos", F.array_join("outside", " ").alias("outside"))


VERDICTS = "v AS (SELECT doc_id, lang, CASE WHEN doc_id % 10 = 0 THEN 'drop' WHEN doc_id % 10 < 9 THEN 'keep' END AS verdict FROM documents)"


def _verdicts(spark, sf):
    k = F.col("doc_id")
    return table(spark, sf, "documents").select("doc_id", "lang", F.when(k % 10 == 0, "drop").when(k % 10 < 9, "keep").alias("verdict"))


@query(f"""
WITH {VERDICTS}, r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY sha256('audit:' || doc_id)) AS n FROM v WHERE verdict = 'keep')
SELECT doc_id, lang, false AS kept FROM v WHERE verdict IS DISTINCT FROM 'keep' UNION ALL SELECT doc_id, lang, true FROM r WHERE n <= CASE WHEN lang = 'en' THEN 40 ELSE 15 END
""")
def audit_sample(spark, sf):
    return D.audit_sample(_verdicts(spark, sf), "lang", "doc_id", {"en": 40}, 15, "audit").select("doc_id", "lang", "kept")


@query(f"""
WITH {VERDICTS}, r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY sha256('audit:' || doc_id)) AS n FROM v WHERE verdict = 'keep'), s AS (SELECT * FROM r WHERE n <= CASE WHEN lang = 'en' THEN 40 ELSE 15 END),
a AS (SELECT lang, count(*) AS sampled, count(*) FILTER (doc_id % 5 >= 2) AS repaired FROM s GROUP BY lang)
SELECT v.lang, v.keeps, coalesce(sampled, 0)::BIGINT AS sampled, coalesce(repaired, 0)::BIGINT AS repaired, round(repaired / sampled, 9) AS rate FROM (SELECT lang, count(*) FILTER (verdict = 'keep') AS keeps FROM v GROUP BY lang) v LEFT JOIN a ON v.lang IS NOT DISTINCT FROM a.lang
""")
def audit_report(spark, sf):
    found = F.element_at(F.array(*map(F.lit, D.AUDIT_CLASSES)), (F.col("doc_id") % 5 + 1).cast("int"))
    audited = D.audit_sample(_verdicts(spark, sf), "lang", "doc_id", {"en": 40}, 15, "audit").withColumn("class", found)
    return D.audit_report(_verdicts(spark, sf), audited, "lang").withColumn("rate", F.round("rate", 9))


@query("""
SELECT doc_id, CASE WHEN doc_id % 6 = 5 THEN false WHEN doc_id % 6 = 0 THEN true ELSE doc_id % 4 <> 0 AND contains(text, 'a') AND (doc_id % 3 = 0 OR contains(text, 'e ')) END AS holds FROM documents WHERE text IS NOT NULL
""")
def audit_evidence(spark, sf):
    k = F.col("doc_id")
    found = F.element_at(F.array(*map(F.lit, [*D.AUDIT_CLASSES, "F"])), (k % 6 + 1).cast("int"))
    one = F.struct(F.lit("a").alias("new_text"), F.when(k % 3 != 0, "e ").alias("where_supported"))
    evidence = F.when((k % 6 == 0) | (k % 4 == 0), F.array().cast("array<struct<new_text:string,where_supported:string>>")).otherwise(F.array(one))
    docs = table(spark, sf, "documents").where("text is not null")
    return docs.select("doc_id", D.evidence_holds(found, evidence, F.col("text"), F.col("text")).alias("holds"))
