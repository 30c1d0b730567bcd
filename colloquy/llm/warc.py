"""WARC archives: writing with revisit records, a merged capture index, and reading back."""

from __future__ import annotations

import base64
import bisect
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.shared import small, stored, work_dir

#: Payloads under this size are always written in full.
LEAST_REVISIT = 1000
#: Captures that one range of the merged index is planned for, and index rows between two marks for its bounds.
RANGE_ROWS = 200_000
MARK_EVERY = 500
#: Bytes of an archive that one reading task is planned for.
CHUNK_BYTES = 8 << 20

INDEX = "urlkey string, timestamp string, page_id long, record_type string, digest string, file string, offset long, length long, run long, mark boolean"


def urlkey(url: str | None) -> str:
    """Sort-friendly form of a URL: host labels reversed, no scheme, `www.`, port, fragment or last slash, lower case."""
    match = re.match(r"(?i)[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::\d*)?([^#]*)", url or "")
    if not match:
        return (url or "").lower()
    host = re.sub(r"^www\d*\.", "", match[1].lower()).rstrip(".")
    return ",".join(reversed(host.split("."))) + ")" + (match[2].lower().rstrip("/") or "/")


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of `uri` and the path in it; Spark's names for S3 are those of its Hadoop clients."""
    return pafs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))


def record_id(page_id: int | None) -> str:
    return f"<urn:capture:{'none' if page_id is None else page_id}>"


def record(page_id, url: str | None, timestamp: str, payload: bytes, hex_digest: str, refers_to=None, is_revisit: bool = False) -> bytes:
    """One WARC/1.1 record with its HTTP header; a revisit has the header only."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if is_revisit else head + payload
    fields = [
        ("WARC-Type", "revisit" if is_revisit else "response"),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", timestamp),
        ("WARC-Target-URI", re.sub(r"[\r\n]", "", url or "")),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(hex_digest)).decode()),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if is_revisit:
        fields[3:3] = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def parsed(raw: bytes) -> dict:
    """Header fields of a record and its payload; a revisit's payload is None."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?im)^content-length: *(\d+)", http)[1])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    number = lambda x: None if x is None or x.endswith(":none>") else int(x[len("<urn:capture:") : -1])
    revisit = fields["WARC-Type"] == "revisit"
    return {
        "page_id": number(fields["WARC-Record-ID"]),
        "url": fields["WARC-Target-URI"],
        "timestamp": fields["WARC-Date"],
        "record_type": fields["WARC-Type"],
        "refers_to": number(fields.get("WARC-Refers-To")),
        "digest": digest,
        "size": size,
        "payload": None if revisit else payload,
    }


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", time_col: str = "fetched") -> DataFrame:
    """Writes a record for each of `pages` into archives below `folder` and returns their index.

    Each task writes one archive, a gzip member a record, and returns the rows of its index as
    one sorted run. Of records with equal payloads of LEAST_REVISIT bytes or more, that with the
    largest id is written in full and the others as revisits of it. A task that is run again
    writes another file, and only the stored index says which files count. `folder` must be
    one that `pyarrow.fs` can open on all executors.
    """
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    sized = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.date_format(time_col, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), payload.alias("payload"), F.sha1(F.encode(payload, "UTF-8")).alias("digest"))
    narrow = sized.where(F.octet_length("payload") >= LEAST_REVISIT).select("page_id", "digest")
    groups = narrow.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "refers_to")
    groups = stored(groups, "payload-groups")
    joined = sized.join(small(groups, groups.count(), 96), "digest", "left")
    revisit = F.col("refers_to").isNotNull() & ~F.col("refers_to").eqNullSafe(F.col("page_id")) & (F.octet_length("payload") >= LEAST_REVISIT)
    rows = joined.select("page_id", "url", "timestamp", "payload", "digest", "refers_to", F.coalesce(revisit, F.lit(False)).alias("revisit"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name = f"{folder}/captures-{context.partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
        system, path = opened(name)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        index, at = [], 0
        with system.open_output_stream(path, compression=None) as out:
            for batch in batches:
                for r in (row for i in range(0, batch.num_rows, 64) for row in batch.slice(i, 64).to_pylist()):
                    raw = record(r["page_id"], r["url"], r["timestamp"] or "", r["payload"].encode(), r["digest"], r["refers_to"], r["revisit"])
                    member = zlib.compressobj(4, zlib.DEFLATED, 31)
                    data = member.compress(raw) + member.flush()
                    out.write(data)
                    index.append((urlkey(r["url"]), r["timestamp"] or "", r["page_id"], "revisit" if r["revisit"] else "response", r["digest"], name, at, len(data)))
                    at += len(data)
        index.sort(key=order_of)
        for i in range(0, len(index), 10_000):
            columns = [list(c) for c in zip(*index[i : i + 10_000])]
            n = len(columns[0])
            columns += [[context.partitionId()] * n, [(i + j) % MARK_EVERY == 0 for j in range(n)]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, KINDS)], names=NAMES)

    return stored(rows.mapInArrow(write, INDEX), "capture-runs")


NAMES = [x.split()[0] for x in INDEX.split(", ")]
KINDS = [{"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[x.split()[1]] for x in INDEX.split(", ")]


def order_of(row: tuple) -> tuple:
    """Order of captures: URL key, time, page (null first), and place in the archives for rows alike."""
    return (row[0], row[1], row[2] is not None, row[2] or 0, row[5], row[6])


class LoserTree:
    """Merges sorted runs: each inner node holds the loser of its match, so a step replays one path."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs = [iter(r) for r in runs]
        self.size = 1 << max(0, (len(runs) - 1).bit_length())
        self.heads = [self._next(i) for i in range(self.size)]
        self.losers = [-1] * self.size
        self.winner = self._play(1)

    def _next(self, i: int):
        """The run's next key and row; (1,) comes after every (0, key)."""
        row = next(self.runs[i], None) if i < len(self.runs) else None
        return ((1,), None) if row is None else ((0, order_of(row)), row)

    def _play(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        a, b = self._play(2 * node), self._play(2 * node + 1)
        if self.heads[b][0] < self.heads[a][0]:
            a, b = b, a
        self.losers[node] = b
        return a

    def __iter__(self) -> Iterator[tuple]:
        while True:
            row = self.heads[self.winner][1]
            if row is None:
                return
            yield row
            best, node = self.winner, (self.winner + self.size) // 2
            self.heads[best] = self._next(best)
            while node:
                if self.heads[self.losers[node]][0] < self.heads[best][0]:
                    best, self.losers[node] = self.losers[node], best
                node //= 2
            self.winner = best


def merged_index(runs: DataFrame) -> DataFrame:
    """All rows of the sorted `runs` in global order: by (range, place), each range merged in one task.

    The bounds of the ranges are drawn from marked rows of all runs and hold the full order, so
    captures of one URL may lie in several ranges. A task gets its slice of each run, still
    sorted, and merges them through a loser tree.
    """
    n, marks = runs.agg(F.count(F.lit(1)), F.count_if("mark")).first()
    ranges = max(1, -(-n // RANGE_ROWS))
    bounds: list[tuple] = []
    if ranges > 1:
        share = min(1.0, 40 * ranges / marks)
        keys = sorted(order_of(tuple(r)) for r in runs.where("mark").where(F.pmod(F.xxhash64("file", "offset"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select(*NAMES[:8]).collect())
        bounds = [keys[i * len(keys) // ranges] for i in range(1, ranges)]
    sent = "range int, slice binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(batch.column(i).to_pylist() for i in range(9))))
            begin = 0
            # a new run begins where the run changes or the order breaks
            for end in [i for i in range(1, len(rows)) if rows[i][8] != rows[i - 1][8] or order_of(rows[i]) < order_of(rows[i - 1])] + [len(rows)]:
                at = begin
                while at < end:
                    r = bisect.bisect_right(bounds, order_of(rows[at]))
                    to = bisect.bisect_left(rows, bounds[r], at, end, key=order_of) if r < len(bounds) else end
                    to = max(to, at + 1)
                    sink = io.BytesIO()
                    with pa.ipc.new_stream(sink, batch.schema) as writer:
                        writer.write_batch(batch.slice(at, to - at))
                    yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([sink.getvalue()], pa.binary())], names=["range", "slice"])
                    at = to
                begin = end

    def merge(group: pa.Table) -> pa.Table:
        number = group.column("range")[0].as_py()
        slices = [pa.ipc.open_stream(x).read_all() for x in group.column("slice").to_pylist()]
        rows = list(LoserTree([list(zip(*(t.column(i).to_pylist() for i in range(8)))) for t in slices]))
        columns = [list(c) for c in zip(*rows)]
        out = [pa.array(c, k) for c, k in zip(columns, KINDS)]
        # captures of one URL key stand together, so they are numbered by where their key begins
        new = np.append(True, np.array([a != b for a, b in zip(columns[0][1:], columns[0])], bool))
        nth = np.arange(len(rows)) - np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0)) + 1
        return pa.Table.from_arrays([pa.array([number] * len(rows), pa.int32()), pa.array(range(len(rows)), pa.int64()), pa.array(nth, pa.int64()), *out], names=["range", "place", "nth", *NAMES[:8]])

    schema = "range int, place long, nth long, " + ", ".join(INDEX.split(", ")[:8])
    return runs.mapInArrow(cut, sent).groupBy("range").applyInArrow(merge, schema)


def histories(index: DataFrame) -> DataFrame:
    """`index` with `capture`: the place of each capture in the history of its URL key, from 1 on.

    Within a range that is `nth`; only a key with which a range begins may have captures in the
    ranges before, and there are no more such keys than ranges.
    """
    going_on = index.where("place = 0 and range > 0").select("urlkey").distinct()
    counts = index.select("urlkey", "range").join(going_on, "urlkey", "left_semi").groupBy("urlkey", "range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("urlkey").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    earlier = counts.select("urlkey", "range", before.alias("_before")).where("_before is not null")
    return index.join(earlier, ["urlkey", "range"], "left").withColumn("capture", F.col("nth") + F.coalesce("_before", F.lit(0))).drop("_before", "nth")


def read_archives(index: DataFrame) -> DataFrame:
    """The records that `index` points to, read from the archives: page_id, url, timestamp, record_type, refers_to, payload_bytes, payload_digest, payload, range, place, capture.

    Size and digest of a response are those of the payload that is read; a revisit has them
    from its headers, and no payload. A response whose payload doesn't match its header fails.
    """
    schema = "page_id long, url string, timestamp string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, range int, place long, capture long"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "int": pa.int32()}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source = None, None
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                rows = []
                for r in batch.slice(a, 64).to_pylist():
                    if r["file"] != name:
                        name = r["file"]
                        system, path = opened(name)
                        source = system.open_input_file(path)
                    found = parsed(zlib.decompress(source.read_at(r["length"], r["offset"]), 31))
                    size, digest = found["size"], found["digest"]
                    if found["payload"] is not None:
                        size, digest = len(found["payload"]), hashlib.sha1(found["payload"]).hexdigest()
                        if (size, digest) != (found["size"], found["digest"]):
                            raise ValueError(f"payload of {found['page_id']} in {name} at {r['offset']} doesn't match its digest")
                    rows.append((found["page_id"], found["url"], found["timestamp"], found["record_type"], found["refers_to"], size, digest, found["payload"], r["range"], r["place"], r["capture"]))
                yield pa.RecordBatch.from_arrays([pa.array(c, kinds[x.split()[1]]) for c, x in zip(zip(*rows), schema.split(", "))], names=names)

    chunk = F.floor(F.col("offset") / CHUNK_BYTES)
    wanted = index.select("file", "offset", "length", "range", "place", "capture")
    return wanted.repartition("file", chunk).sortWithinPartitions("file", "offset").mapInArrow(read, schema)


def archived(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", time_col: str = "fetched") -> DataFrame:
    """Writes `pages` as WARC archives, merges their index, and reads every capture back by it.

    Rows of `read_archives`; (range, place) is the place in the order of all captures, by URL key,
    time and page, and `capture` the place in the history of the URL key. Null payload: an empty one. Null url: an empty key. Null time: an empty date. A
    null id is written as none and read as null, and sorts first. Rows alike are each archived;
    rows that share the largest id of a payload are all responses. Other columns are not read.
    An empty table gives an empty result.
    """
    folder = work_dir(pages.sparkSession, "warc")
    runs = write_archives(pages, folder, id_col, url_col, payload_col, time_col)
    return read_archives(histories(stored(merged_index(runs), "capture-index")))
