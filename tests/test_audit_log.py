"""The audit log: what a job appends is there whole or not at all."""

import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from colloquy.sources.audit import AuditWriter, append_audit, audit_records

SCHEMA = "id long, note string"


def notes(spark, n, parts):
    return spark.range(n).repartition(parts).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit('é "\n'), F.col("id"))).alias("note"))


def test_appended_records_come_back(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    assert audit_records(spark, path, SCHEMA).count() == 0
    append_audit(notes(spark, 50, 3), path)
    append_audit(notes(spark, 7, 9), path)
    append_audit(notes(spark, 5, 2).where("false"), path)
    want = sorted(map(str, notes(spark, 50, 1).union(notes(spark, 7, 1)).collect()))
    assert sorted(map(str, audit_records(spark, path, SCHEMA).collect())) == want
    assert len(os.listdir(tmp_path / "log" / "commits")) == 2


def test_failed_jobs_leave_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    append_audit(notes(spark, 5, 2), path)
    before = sorted(os.listdir(tmp_path / "log" / "parts"))
    broken = notes(spark, 40, 4).withColumn("note", F.when(F.col("id") == 17, F.raise_error(F.lit("no"))).otherwise(F.col("note")))
    with pytest.raises(Exception, match="no"):
        append_audit(broken, path)
    assert audit_records(spark, path, SCHEMA).count() == 5
    assert len(os.listdir(tmp_path / "log" / "commits")) == 1
    assert sorted(os.listdir(tmp_path / "log" / "parts")) == before
    with pytest.raises(Exception, match="only appended"):
        notes(spark, 1, 1).select(F.lit("x").alias("record")).write.format("audit_log").mode("overwrite").save(path)


def test_an_aborted_job_leaves_no_parts_of_tasks_it_did_not_hear_of(tmp_path):
    path = f"file://{tmp_path}/log"
    batch = pa.record_batch({"record": ["{}", None]})
    other, job = AuditWriter(path), AuditWriter(path)
    other.commit([other.write(iter([batch]))])
    before = os.listdir(tmp_path / "log" / "parts")
    job.write(iter([batch]))

    def late():
        yield batch
        job.abort([None, None])
        yield batch

    for rows in (late(), iter([batch])):
        with pytest.raises(RuntimeError, match="aborted"):
            job.write(rows)
        assert os.listdir(tmp_path / "log" / "parts") == before


def test_parts_without_a_commit_are_not_read(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    append_audit(notes(spark, 5, 2), path)
    (tmp_path / "log" / "parts" / "lost.jsonl").write_text('{"id": 99, "note": "from a lost executor"}\n')
    (tmp_path / "log" / "commits" / "x.unfinished").write_text('{"part": "lost.jsonl", "records": 1}\n')
    assert sorted(r.id for r in audit_records(spark, path, SCHEMA).collect()) == [0, 1, 2, 3, 4]
