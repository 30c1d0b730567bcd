"""Meeting tables derived from the given tables: users are recordings, events are utterances, views are slides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(recording, pos, utterance_id, speaker_id, start_sec, end_sec, text): each event until the user's next, ten minutes at most."""
    # The window is by `recording` and carries bare columns: what comes after is dealt by recording too, and equal parts shuffle once.
    named = table(spark, sf_dir, "events").select(F.col("user_id").alias("recording"), F.col("event_id").alias("utterance_id"), F.col("event_type").alias("speaker_id"), "ts", F.col("props").alias("text"), "value")
    w = Window.partitionBy("recording").orderBy("ts", "utterance_id")
    rows = named.select("*", (F.row_number().over(w) - 1).cast("long").alias("pos"), F.lead("ts").over(w).alias("_next"))
    ms = lambda t: F.floor(F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'"), F.col(t)) / 1000)
    most = ms("ts") + 600_000
    end = F.least(F.coalesce(ms("_next"), most), most)
    return rows.select("recording", "pos", "utterance_id", "speaker_id", (ms("ts") / 1000.0).alias("start_sec"), (end / 1000.0).alias("end_sec"), "text", "value")


U = """u AS (
  SELECT user_id AS recording, row_number() OVER w - 1 AS pos, event_id AS utterance_id, event_type AS speaker_id, value, props AS text, ts,
         (epoch_us(ts) - 1704067200000000) // 1000 AS s, lead((epoch_us(ts) - 1704067200000000) // 1000) OVER w AS n
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
),
utt AS (SELECT recording, pos, utterance_id, speaker_id, s / 1000.0::DOUBLE AS start_sec, least(coalesce(n, s + 600000), s + 600000) / 1000.0::DOUBLE AS end_sec, text, value FROM u)"""


def slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(recording, slide_id, slide_pos, start_sec, end_sec): each view until the next, an hour for the last."""
    views = utterances(spark, sf_dir).where("speaker_id = 'view'").select("recording", F.col("utterance_id").alias("slide_id"), F.col("pos").alias("slide_pos"), "start_sec")
    return views.withColumn("end_sec", F.coalesce(F.lead("start_sec").over(Window.partitionBy("recording").orderBy("start_sec", "slide_pos")), F.col("start_sec") + 3600.0))


S = """sl AS (
  SELECT recording, utterance_id AS slide_id, pos AS slide_pos, start_sec,
         coalesce(lead(start_sec) OVER (PARTITION BY recording ORDER BY start_sec, pos), start_sec + 3600.0::DOUBLE) AS end_sec
  FROM utt WHERE speaker_id = 'view'
)"""


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(recording, case_id, start_sec, end_sec): one case for each six hours in which a recording has utterances."""
    n = F.floor(F.col("start_sec") / 21600.0)
    return utterances(spark, sf_dir).select("recording", n.alias("n")).distinct().select("recording", F.format_string("case_%03d", "n").alias("case_id"), (F.col("n") * 21600.0).alias("start_sec"), ((F.col("n") + 1) * 21600.0).alias("end_sec"))


C = """cs AS (
  SELECT recording, printf('case_%03d', n) AS case_id, n * 21600.0::DOUBLE AS start_sec, (n + 1) * 21600.0::DOUBLE AS end_sec
  FROM (SELECT DISTINCT recording, floor(start_sec / 21600.0::DOUBLE)::BIGINT AS n FROM utt)
)"""


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge rows: a document's source is the model, its language the type; no label is a failure of the format, or of the judge for every seventh."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    status = F.when(F.col("quality").isNotNull(), "scored").when(F.col("doc_id") % 7 == 0, "judge_failure").otherwise("format_failure")
    return docs.join(labels, "doc_id", "left").select(
        "doc_id", F.col("source").alias("model_key"), F.col("lang").alias("qa_type"), status.alias("status"), (1 + 4 * F.col("quality")).alias("score"),
        (F.col("toxic") == 1).alias("critical_error"), ((F.col("doc_id") % 3 == 0) & F.col("toxic").isNotNull()).alias("unsupported_claim"),
    )


J = """jr AS (
  SELECT d.doc_id, d.source AS model_key, d.lang AS qa_type,
         CASE WHEN l.quality IS NOT NULL THEN 'scored' WHEN d.doc_id % 7 = 0 THEN 'judge_failure' ELSE 'format_failure' END AS status,
         1 + 4 * l.quality AS score, l.toxic = 1 AS critical_error, (d.doc_id % 3 = 0 AND l.toxic IS NOT NULL) AS unsupported_claim
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id)
)"""
