"""Count-min prefilter: which windows of a corpus may repeat.

A window (so many words, or bytes) is represented by its anchor, the least hash among the
shorter grams in it. Equal windows have equal anchors, so the count of an anchor is at least
the count of each window around it. Every task counts its anchors by 32-bit prints and ships
the counters that aren't zero, cut by hash range, each with where its anchors stand; for each
range the tasks' counters are added into one table of two rows of cells, and read back. Cells
may be shared, so counts are only ever too large: no repeated window is lost, and a few that do
not repeat pass and fall out in the exact pass that follows.

A very frequent anchor costs a task one counter. The table has a fixed number of cells a range,
and there are as many ranges as the corpus asks for, so the share of false passes stays.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm import blocks as B
from colloquy.llm.blobs import runs
from colloquy.llm.shared import stored

#: Anchors a hash range is planned for, and cells in each of the two rows of its sketch.
RANGE_ANCHORS = 1_000_000
SKETCH_CELLS_LOG2 = 23
#: Anchors (or windows) a task holds before it sends them.
HELD = 750_000

_SENT = "part int, block long, keys binary, cells binary, docs binary, at binary, twice binary, times binary, known binary, known_docs binary, known_at binary"


class Units:
    """Words or bytes of a slice of documents: their codes, and the first unit of each document."""

    def __init__(self, kind: str, column: pa.Array, both: bool = False):
        self.data, self.offsets = B.text_of(column)
        if kind == "words":
            starts, ends, self.first = B.words_of(self.data, self.offsets)
            self.codes = B.word_hashes(self.data, starts, ends)
            self.codes2 = B.word_hashes(self.data, starts, ends, 1) if both else None
        else:
            self.first = self.offsets
            self.codes = B.byte_codes(self.data)
            self.codes2 = B.byte_codes(self.data, 1) if both else None

    def windows(self, window: int, gram: int):
        """Hash of each gram, which windows lie in one document, where anchors are, and the least gram of each window."""
        grams = B.gram_hashes(self.codes, gram)
        valid = B.whole(self.first, window, max(0, len(self.codes) - window + 1))
        at, least = B.anchors(grams, valid, window - gram + 1)
        return grams, valid, at, least

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, at, side="right") - 1


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """`docs` with `_key`, which tells rows apart by id and text; rows alike in both share it."""
    return docs.withColumn("_key", F.xxhash64(F.col(id_col), F.col(text_col)))


def possibly_repeated(keyed_docs: DataFrame, text_col: str, kind: str, window: int, gram: int, total_bytes: int) -> DataFrame:
    """Stored rows (_key, at list of binary uint32, level list of binary uint8) with the anchors of each text that may repeat.

    `at` counts units from the text's start; `level` is log2 of the estimated count.
    """
    per_window = window - gram + 1
    units = total_bytes / (6 if kind == "words" else 1)
    parts = max(1, round(units * 2 / (per_window + 1) / RANGE_ANCHORS + 0.5))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, blocks = [], 0, block_ids()
        for batch in B.as_batch(batches, text_col):
            units = Units(kind, batch.column(text_col))
            grams, _, at, _ = units.windows(window, gram)
            doc = units.doc_of(at)
            held.append((grams[at], doc, at - units.first[doc], batch.column("_key").to_numpy()))
            count += len(at)
            if count >= HELD:
                yield from _cells(held, parts, next(blocks))
                held, count = [], 0
        yield from _cells(held, parts, next(blocks))

    def merge(group: pa.Table) -> pa.Table:
        return _repeated(group)

    sent = keyed_docs.select("_key", text_col).mapInArrow(sketch, _SENT)
    found = sent.groupBy("part").applyInArrow(merge, replied("at", "level"))
    return by_document(found, "at", "level")


def join_held(held: list) -> tuple[list[np.ndarray], np.ndarray]:
    """Columns of all slices one after the other, documents renumbered; and the documents' keys."""
    shift, docs = 0, []
    for x in held:
        docs.append(x[1] + shift)
        shift += len(x[-1])
    columns = [np.concatenate([x[i] for x in held]) if i != 1 else np.concatenate(docs) for i in range(len(held[0]) - 1)]
    return columns, np.concatenate([x[-1] for x in held])


def _cells(held: list, parts: int, block: int) -> Iterator[pa.RecordBatch]:
    if not held:
        return
    (grams, doc, at), keys = join_held(held)
    order = np.argsort(grams)
    grams, doc, at = grams[order], doc[order], at[order]
    new = np.ones(len(grams), bool)
    new[1:] = grams[1:] != grams[:-1]
    heads = np.flatnonzero(new)
    sizes = np.diff(np.append(heads, len(grams)))
    alone = np.repeat(sizes == 1, sizes)
    part = ((grams >> B.U64(32)) % B.U64(parts)).astype(np.int64)
    by_part, size_of = np.argsort(part, kind="stable"), np.repeat(sizes, sizes)
    rows = []
    for p, a, b in runs(part[by_part]):
        own = by_part[a:b]
        single, known = own[alone[own]], own[~alone[own]]
        used, renumbered = np.unique(doc[own], return_inverse=True)
        of = dict(zip(("single", "known"), (renumbered[alone[own]], renumbered[~alone[own]])))
        twice = own[new[own] & ~alone[own]]
        rows.append((p, block, B.packed(keys[used], np.int64), B.packed(grams[single], np.uint32), B.packed(of["single"], np.uint32), B.packed(at[single], np.uint32), B.packed(grams[twice], np.uint32), B.packed(size_of[twice], np.uint32), B.packed(grams[known], np.uint32), B.packed(of["known"], np.uint32), B.packed(at[known], np.uint32)))
    yield from as_rows(rows, ["part", "block", "keys", "cells", "docs", "at", "twice", "times", "known", "known_docs", "known_at"], [pa.int32(), pa.int64()] + [pa.binary()] * 9)


def as_rows(rows: list[tuple], names: list[str], kinds: list[pa.DataType], each: int = 64) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), each):
        columns = zip(*rows[i : i + each])
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def arrays_of(group: pa.Table, name: str, kind) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in group.column(name).to_pylist()]


def block_ids() -> Iterator[int]:
    """Numbers of the blocks of documents that this task sends."""
    return itertools.count(TaskContext.get().partitionId() << 32)


def shifted(keys: list[np.ndarray], *docs: list[np.ndarray]) -> list[np.ndarray]:
    """Document numbers of all requests one after the other, counted over all requests' documents."""
    shifts = np.append(0, np.cumsum([len(k) for k in keys]))[:-1]
    return [np.concatenate([d.astype(np.int64) + s for d, s in zip(x, shifts)]) for x in docs]


def replied(*names: str) -> str:
    return "block long, keys binary, docs binary, " + ", ".join(f"{n} binary" for n in names)


def replies(group: pa.Table, keys: list[np.ndarray], docs: np.ndarray, **columns: np.ndarray) -> pa.Table:
    """One row for each request that has something found: its block, and the documents and values found."""
    order = np.argsort(docs, kind="stable")
    docs = docs[order]
    shifts = np.append(0, np.cumsum([len(k) for k in keys]))
    cuts = np.searchsorted(docs, shifts)
    rows = []
    for i, block in enumerate(group.column("block").to_pylist()):
        own = order[cuts[i] : cuts[i + 1]]
        if len(own):
            used, of = np.unique(docs[cuts[i] : cuts[i + 1]] - shifts[i], return_inverse=True)
            rows.append((block, keys[i][used].tobytes(), of.astype(np.uint32).tobytes(), *(c[own].tobytes() for c in columns.values())))
    kinds = [pa.int64()] + [pa.binary()] * (2 + len(columns))
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["block", "keys", "docs", *columns])


def by_document(found: DataFrame, *names: str) -> DataFrame:
    """Stored rows (_key, list of each of `names`), one for each document that `found` has replies for.

    The replies of a block are gathered first, so that their number follows the documents and
    not documents times hash ranges. Documents may lie in two blocks if a task ran again.
    """
    widths = {"level": 1, "runs": 16}

    def gather(group: pa.Table) -> pa.Table:
        keys = arrays_of(group, "keys", np.int64)
        (docs,) = shifted(keys, arrays_of(group, "docs", np.uint32))
        _, number = np.unique(np.concatenate(keys), return_inverse=True)
        docs = number[docs]
        order = np.argsort(docs, kind="stable")
        heads = np.flatnonzero(np.diff(docs[order], prepend=-1) != 0)
        ends = np.append(heads[1:], len(order))[: len(heads)]
        out = [pa.array(np.unique(np.concatenate(keys))[docs[order][heads]])]
        for name in names:
            width = widths.get(name, 4)
            values = np.frombuffer(b"".join(group.column(name).to_pylist()), np.dtype((np.void, width)))[order]
            out.append(pa.array([values[a:b].tobytes() for a, b in zip(heads, ends)], pa.binary()))
        return pa.Table.from_arrays(out, names=["_key", *names])

    gathered = found.groupBy("block").applyInArrow(gather, "_key long, " + ", ".join(f"{n} binary" for n in names))
    return stored(gathered.groupBy("_key").agg(*(F.collect_list(n).alias(n) for n in names)), "found")


def _repeated(group: pa.Table) -> pa.Table:
    """Anchors of one hash range whose estimated count is 2 or more."""
    keys = arrays_of(group, "keys", np.int64)
    docs, known_docs = shifted(keys, arrays_of(group, "docs", np.uint32), arrays_of(group, "known_docs", np.uint32))
    cells, twice, times = (arrays_of(group, x, np.uint32) for x in ("cells", "twice", "times"))
    known = np.concatenate(arrays_of(group, "known", np.uint32))
    asked = np.concatenate([*cells, known])
    estimate = None
    for factor in (1, 0x9E3779B1):
        row = np.zeros(1 << SKETCH_CELLS_LOG2, np.uint32)
        for prints, counts in [*((c, np.uint32(1)) for c in cells), *zip(twice, times)]:
            np.add.at(row, _cell(prints, factor), counts)
        counts = row[_cell(asked, factor)]
        estimate = counts if estimate is None else np.minimum(estimate, counts)
        del row
    keep = estimate >= 2
    at = np.concatenate(arrays_of(group, "at", np.uint32) + arrays_of(group, "known_at", np.uint32))[keep]
    docs = np.concatenate([docs, known_docs])[keep]
    return replies(group, keys, docs, at=at, level=np.log2(estimate[keep]).astype(np.uint8))


def _cell(prints: np.ndarray, factor: int) -> np.ndarray:
    return (prints * np.uint32(factor)) >> np.uint32(32 - SKETCH_CELLS_LOG2)


def marks_of(column: pa.Array, first: np.ndarray, kind=np.uint32) -> tuple[np.ndarray, np.ndarray]:
    """Units named by a list-of-binary column, counted over the slice; and the row of each."""
    found, docs = [], []
    for i, blobs in enumerate(column.to_pylist()):
        for blob in blobs or ():
            x = np.frombuffer(blob, kind)
            found.append(x.astype(np.int64) + first[i])
            docs.append(len(x))
    return (np.concatenate(found), np.array(docs)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def levels_of(column: pa.Array) -> np.ndarray:
    found = [np.frombuffer(blob, np.uint8) for blobs in column.to_pylist() for blob in blobs or ()]
    return np.concatenate(found) if found else np.zeros(0, np.uint8)


def candidates(units: Units, window: int, gram: int, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows whose anchor is among `marked` grams, each window's least gram, and all grams."""
    grams, valid, _, least = units.windows(window, gram)
    masked = np.full(len(grams), np.iinfo(np.uint64).max, np.uint64)
    masked[marked] = grams[marked]
    hit = B.sliding(masked, window - gram + 1)[: len(valid)] == least
    return np.flatnonzero(hit & valid), least, grams
