"""Substring dedup: a count-min prefilter, then exact grouping of the windows it lets pass."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.llm import blocks as B
from colloquy.llm import repeats as R
from colloquy.llm.blobs import runs
from colloquy.llm.shared import text_bytes

#: Candidate windows a hash range is planned for, if all windows were candidates.
RANGE_WINDOWS = 1_000_000
#: Words in the grams that serve as anchors.
GRAM = 8

_SENT = "part int, block long, ids binary, keys binary, first binary, second binary, docs binary, at binary, known_docs binary, known_at binary"


def repeated_windows(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stored rows (_key, at list of binary uint32): starts of the windows that also start earlier.

    First pass: count-min estimates (see `repeats`). Second pass: the windows estimated repeated
    are grouped by 128 bits of two independent hashes of their word sequence; in each group all
    but the one with the smallest (id, start) are returned. A task settles its own repeats and
    sends one occurrence of each sequence, so a sequence met everywhere costs one entry a task.
    """
    spark, gram = docs.sparkSession, min(GRAM, window)
    total = text_bytes(docs, text_col)
    source = R.keyed(docs.select(id_col, text_col), id_col, text_col)
    anchors = R.possibly_repeated(source, text_col, "words", window, gram, total)
    parts = max(1, round(total / 6 / RANGE_WINDOWS + 0.5))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, blocks = [], 0, R.block_ids()
        for batch in B.as_batch(batches, text_col):
            units = R.Units("words", batch.column(text_col), both=True)
            marked, _ = R.marks_of(batch.column("at"), units.first)
            at, _, _ = R.candidates(units, window, gram, marked)
            first = B.gram_hashes(units.codes, window)[at]
            second = B.gram_hashes(units.codes2, window, 1)[at]
            doc = units.doc_of(at)
            ids = pc.fill_null(batch.column(id_col).cast(pa.int64()), -(2**63)).to_numpy()
            held.append((first, doc, second, at - units.first[doc], ids[doc], batch.column("_key").to_numpy()))
            count += len(at)
            if count >= R.HELD:
                yield from _send(held, parts, next(blocks))
                held, count = [], 0
        yield from _send(held, parts, next(blocks))

    joined = source.join(anchors.select("_key", "at").hint("shuffle_hash"), "_key")
    sent = joined.select(id_col, "_key", text_col, "at").mapInArrow(windows, _SENT)
    return R.by_document(sent.groupBy("part").applyInArrow(_later, R.replied("at")), "at")


def _send(held: list, parts: int, block: int) -> Iterator[pa.RecordBatch]:
    if not held:
        return
    (first, doc, second, at, ids), keys = R.join_held(held)
    order = np.lexsort((at, ids, second, first))
    first, doc, second, at, ids = (x[order] for x in (first, doc, second, at, ids))
    leads = _leads(first, second, ids, at)
    part = ((first >> B.U64(32)) % B.U64(parts)).astype(np.int64)
    by_part = np.argsort(part, kind="stable")
    rows = []
    for p, a, b in runs(part[by_part]):
        own = by_part[a:b]
        used, head, of = np.unique(doc[own], return_index=True, return_inverse=True)
        lead = leads[own]
        rows.append((p, block, B.packed(ids[own][head], np.int64), B.packed(keys[used], np.int64), B.packed(first[own][lead], np.uint64), B.packed(second[own][lead], np.uint64), B.packed(of[lead], np.uint32), B.packed(at[own][lead], np.uint32), B.packed(of[~lead], np.uint32), B.packed(at[own][~lead], np.uint32)))
    yield from R.as_rows(rows, ["part", "block", "ids", "keys", "first", "second", "docs", "at", "known_docs", "known_at"], [pa.int32(), pa.int64()] + [pa.binary()] * 8)


def _leads(first: np.ndarray, second: np.ndarray, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of the sorted windows have no earlier one of the same words; rows alike in id and start are all leads."""
    new = np.ones(len(first), bool)
    new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
    head = np.maximum.accumulate(np.where(new, np.arange(len(first)), 0))
    return (ids == ids[head]) & (at == at[head]) if len(first) else new


def _later(group: pa.Table) -> pa.Table:
    keys, ids = R.arrays_of(group, "keys", np.int64), np.concatenate(R.arrays_of(group, "ids", np.int64))
    docs, known_docs = R.shifted(keys, R.arrays_of(group, "docs", np.uint32), R.arrays_of(group, "known_docs", np.uint32))
    first, second, at, known_at = (np.concatenate(R.arrays_of(group, name, kind)) for name, kind in (("first", np.uint64), ("second", np.uint64), ("at", np.uint32), ("known_at", np.uint32)))
    order = np.lexsort((at, ids[docs], second, first))
    docs, at = docs[order], at[order]
    later = ~_leads(first[order], second[order], ids[docs], at)
    return R.replies(group, keys, np.concatenate([docs[later], known_docs]), at=np.concatenate([at[later], known_at]))


def dedup_substrings(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with kept_text, n_words and n_removed: words in a window that also starts earlier are removed.

    Words are `[^\\x20\\x09-\\x0D]+`; a window is `window` words in a row of one document; earlier
    means a smaller id, or the same document and an earlier start. Windows are judged on the
    input. kept_text joins the kept words by one space.

    Null or empty text: no words, kept_text empty. A null id counts as the smallest. Rows alike
    in id and text count as one document, neither of which is earlier; documents that share an
    id but not the text are ordered by start. Text of any length is taken whole. An empty table
    gives an empty result. Columns of `docs` with a result's name are replaced; `_key` and
    `_at` are reserved.
    """
    found = repeated_windows(docs, window, id_col, text_col).withColumnRenamed("at", "_at")
    joined = R.keyed(docs, id_col, text_col).join(found.hint("shuffle_hash"), "_key", "left")
    extra = [T.StructField("kept_text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())]
    passed = [f for f in docs.schema if f.name not in {x.name for x in extra}]

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.as_batch(batches, text_col):
            kept, n_words, n_removed = [], [], []
            for text, blobs in zip(batch.column(text_col).cast(pa.binary()).to_pylist(), batch.column("_at").to_pylist()):
                words = (text or b"").split()
                n_words.append(len(words))
                if blobs:
                    stay = kept_words(len(words), np.concatenate([np.frombuffer(b, np.uint32) for b in blobs]), window)
                    words = [words[i] for i in np.flatnonzero(stay)]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words))
            made = [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in passed] + made, names=[f.name for f in [*passed, *extra]])

    return joined.mapInArrow(remove, T.StructType([*passed, *extra]))


def kept_words(n: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Which of `n` words no window that begins at one of `starts` covers."""
    steps = np.zeros(n + window + 1, np.int64)
    starts = np.unique(starts)
    steps[starts] += 1
    steps[starts + window] -= 1
    return np.cumsum(steps)[:n] == 0
