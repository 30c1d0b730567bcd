"""Readers. Paths may be globs or lists; all listing and decoding is Spark's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from colloquy.functions.text import data_uri, file_stem, numbered_id, strip


def csv_urls(spark: SparkSession, path: str, column: str = "url") -> DataFrame:
    """The URLs of a CSV file with a header; blank ones drop out."""
    return spark.read.csv(path, header=True).select(strip(F.col(column)).alias(column)).where(F.col(column) != "")


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a file, with the file's path and the recording, which is the folder it lies in."""
    docs = spark.read.schema(schema).option("multiLine", True).json(path)
    where = F.col("_metadata.file_path")
    return docs.select("*", where.alias("path"), F.element_at(F.split(where, "/"), -2).alias("recording"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line, plain or gzip by the name's end; blank lines drop out and bad ones are null."""
    return spark.read.schema(schema).json(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, value) of text files, plain or gzip, lines counted from 1 in each file.

    Large files are read in several splits, side by side: the lines of each are counted first, sums
    over the splits of a file say what line each begins with, and a line's place in its split does the
    rest. Only the counts are shuffled, a row a split.
    """
    place = F.monotonically_increasing_id()
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_start"), "value", place.alias("_at"))
    splits = lines.groupBy("path", "_start").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy("path").orderBy("_start")) - F.col("_n")
    splits = splits.select("path", "_start", (before - F.col("_first")).alias("_shift"))
    return lines.join(splits, ["path", "_start"]).select("path", (F.col("_at") + F.col("_shift") + 1).alias("line"), "value")


def json_lines_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """As `json_lines`, but a line that isn't an object of the schema fails the job and is named, as path:line."""
    lines = numbered_lines(spark, path).where(strip(F.col("value")) != "")
    row = F.from_json("value", f"{schema}, _bad STRING", {"columnNameOfCorruptRecord": "_bad"})
    rows = lines.withColumn("_row", row)
    said = F.concat(F.lit("bad line at "), F.col("path"), F.lit(":"), F.col("line").cast("string"), F.lit(": "), F.col("value"))
    fine = F.when(F.col("_row").isNotNull() & F.col("_row._bad").isNull(), True).otherwise(F.raise_error(said).cast("boolean"))
    return rows.where(fine).select("_row.*").drop("_bad")


def json_lines_or_gzip(spark: SparkSession, stem: str, schema: str) -> DataFrame:
    """`stem`.jsonl if it exists, else `stem`.jsonl.gz, through the file system that Spark uses."""
    for path in (f"{stem}.jsonl", f"{stem}.jsonl.gz"):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            return json_lines(spark, path, schema)
    raise FileNotFoundError(f"neither {stem}.jsonl nor {stem}.jsonl.gz exists")


def task_files(docs: DataFrame, repaired: bool) -> DataFrame:
    """Documents of task files: the repaired ones, or the base ones without any suffix."""
    name = F.element_at(F.split("path", "/"), -1)
    return docs.where(name.rlike(r"^task_case_.*_rephrased\.json$") if repaired else name.rlike(r"^task_case_.*\.json$") & ~name.rlike(r"_(qc|rephrased)\.json$"))


def prompt_text(spark: SparkSession, path: str) -> str:
    """A prompt file's text without white space around it; prompts are small and needed on the driver."""
    return spark.read.text(path, wholetext=True).first()[0].strip()


def webvtt(spark: SparkSession, path: str) -> DataFrame:
    """(video, transcript) of WebVTT files: cue text joined by blanks, in expressions only."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return files.select(file_stem(F.col("path")).alias("video"), vtt_text(F.col("value")).alias("transcript"))


def vtt_text(text):
    """Spoken text of WebVTT: no blank lines, headers, notes, timings or cue numbers; rolling captions stay as they are."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n"), lambda x: strip(x))
    spoken = F.filter(lines, lambda x: (x != "") & ~x.rlike(r"^(WEBVTT|Kind:|Language:|NOTE)") & ~x.contains("-->") & ~x.rlike(r"^\d+$"))
    return F.array_join(spoken, " ")


def utterance_table(transcripts: DataFrame) -> DataFrame:
    """One row an utterance, with its place, an id counted from 1 and stripped text."""
    rows = transcripts.select("recording", F.posexplode("utterances").alias("pos", "u"))
    return rows.select("recording", "pos", numbered_id("utt", F.col("pos") + 1).alias("utterance_id"), F.round("u.start_sec", 3).alias("start_sec"), F.round("u.end_sec", 3).alias("end_sec"), strip(F.col("u.text")).alias("text"))


def images(spark: SparkSession, path: str) -> DataFrame:
    """(path, uri) of image files as data URIs."""
    mime = F.when(F.lower("path").rlike(r"\.jpe?g$"), "image/jpeg").when(F.lower("path").rlike(r"\.webp$"), "image/webp").otherwise("image/png")
    return spark.read.format("binaryFile").load(path).select("path", data_uri(F.col("content"), mime).alias("uri"))


class VideoSearch(DataSource):
    """Batch source `video_search` over pages of a search service.

    Option `client` names a function `module:function(keyword, page)` that yields tuples (id,
    title, duration, url); option `pages` says how many pages there are. Without a client it
    has no rows. Filtering is the engine's (see `search_filter`).
    """

    @classmethod
    def name(cls) -> str:
        return "video_search"

    def schema(self) -> str:
        return "id string, title string, duration double, url string"

    def reader(self, schema) -> DataSourceReader:
        return _SearchReader(self.options)


class _SearchReader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)

    def partitions(self):
        return [InputPartition(i) for i in range(int(self.options.get("pages", "1")))]

    def read(self, partition):
        client = self.options.get("client")
        if not client:
            return
        import importlib

        module, _, function = client.partition(":")
        yield from getattr(importlib.import_module(module), function)(self.options.get("keyword", ""), partition.value)
