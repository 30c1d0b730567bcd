"""An audit log as a data source: a job's records become visible together, and a failed job or task leaves none."""

from __future__ import annotations

import contextlib
import json
import re
import uuid
from dataclasses import dataclass
from itertools import chain

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage


def _opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or local path, and the path in it."""
    return pafs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))


@dataclass
class Part(WriterCommitMessage):
    """What a task hands to the commit: its part's name and how many records are in it."""

    name: str
    records: int


class AuditLog(DataSource):
    """Sink `audit_log`: appends rows of one string column, a JSON record each, below a folder all executors share.

    Each task writes a part of its own, and removes it if it fails. The commit then writes one small file
    that names the parts of the tasks that counted, so that all of a job's records appear at once; parts no
    commit names (lost executors, speculative tasks) are never read. An aborted job leaves a small file in
    `aborted` and no parts: the abort removes all that bear its id, and its tasks that still run see the file.
    Records of null are left out; a job without records commits nothing.
    """

    @classmethod
    def name(cls) -> str:
        return "audit_log"

    def schema(self) -> str:
        return "record string"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("an audit log is only appended to")
        return AuditWriter(self.options["path"])


class AuditWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path.rstrip("/")
        self.job = uuid.uuid4().hex

    def write(self, iterator) -> Part:
        fs, base = _opened(self.path)
        name = f"{self.job}-{uuid.uuid4().hex}.jsonl"
        lines = (record.as_py().encode() + b"\n" for batch in iterator for record in batch.column(0).drop_null())
        first = next(lines, None)
        if first is None:
            return Part(name, 0)
        fs.create_dir(f"{base}/parts", recursive=True)
        self._check(fs, base)
        records = 0
        try:
            with fs.open_output_stream(f"{base}/parts/{name}") as out:
                for line in chain([first], lines):
                    out.write(line)
                    records += 1
            self._check(fs, base)
        except BaseException:
            _removed(fs, f"{base}/parts/{name}")
            raise
        return Part(name, records)

    def _check(self, fs: pafs.FileSystem, base: str) -> None:
        if fs.get_file_info(f"{base}/aborted/{self.job}").type != pafs.FileType.NotFound:
            raise RuntimeError(f"the job {self.job} was aborted")

    def commit(self, messages: list[Part | None]) -> None:
        parts = [m for m in messages if m is not None and m.records]
        if not parts:
            return
        fs, base = _opened(self.path)
        name = uuid.uuid4().hex
        fs.create_dir(f"{base}/commits", recursive=True)
        # A reader lists names that end in .json: the file gets its own only when it is whole.
        with fs.open_output_stream(f"{base}/commits/{name}.unfinished") as out:
            for m in parts:
                out.write(json.dumps({"part": m.name, "records": m.records}).encode() + b"\n")
        fs.move(f"{base}/commits/{name}.unfinished", f"{base}/commits/{name}.json")

    def abort(self, messages: list[Part | None]) -> None:
        fs, base = _opened(self.path)
        # Tasks whose message never came wrote parts too, and some may still run: first they are told, then all parts go.
        fs.create_dir(f"{base}/aborted", recursive=True)
        fs.open_output_stream(f"{base}/aborted/{self.job}").close()
        for part in fs.get_file_info(pafs.FileSelector(f"{base}/parts", allow_not_found=True)):
            if part.base_name.startswith(f"{self.job}-"):
                _removed(fs, part.path)


def _removed(fs: pafs.FileSystem, path: str) -> None:
    if fs.get_file_info(path).type != pafs.FileType.NotFound:
        with contextlib.suppress(FileNotFoundError):  # a task and its job's abort may both be at it
            fs.delete_file(path)


def append_audit(df: DataFrame, path: str) -> None:
    """The rows of `df` appended to the audit log at `path`, each as one JSON record with its nulls."""
    df.sparkSession.dataSource.register(AuditLog)
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("record")).write.format("audit_log").mode("append").save(path)


def audit_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The committed records at `path`; none if nothing was committed yet."""
    fs, base = _opened(path.rstrip("/"))
    if fs.get_file_info(f"{base}/commits").type == pafs.FileType.NotFound:
        return spark.createDataFrame([], schema)
    names = spark.read.schema("part string").option("pathGlobFilter", "*.json").json(f"{path.rstrip('/')}/commits")
    rows = spark.read.schema(schema).json(f"{path.rstrip('/')}/parts").withColumn("_part", F.col("_metadata.file_name"))
    return rows.join(names, F.col("_part") == F.col("part"), "left_semi").drop("_part")
