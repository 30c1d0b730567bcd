"""Alignment of two tokenizers' tokens over the same bytes, by pointer jumping, with link counts over the whole corpus."""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm import blocks as B
from colloquy.llm.blobs import opened, slim, squeezed
from colloquy.llm.shared import Scratch, small

#: Bytes of text whose chunks share one table; one longer document has its own.
BLOCK_BYTES = 3 << 20
#: Chunks that are encoded and aligned at once, and links of texts that are sorted at once (or one text's).
CHUNKS, LINKS = 8192, 1 << 20
#: Fixed value: how byte-level vocabularies cut text before their merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: U+2581, which stands for a space in pieces.
MARK = "▁"


def byte_alphabet() -> dict[str, int]:
    """The character of each byte in byte-level vocabularies: printable bytes stand for themselves, the others follow from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def in_a_row(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all lists, and how many each has."""
    return np.fromiter(chain.from_iterable(lists), np.int32), np.fromiter(map(len, lists), np.int64, len(lists))


def ranked_encoding(said: dict, entries: list[bytes]):
    """The byte-level BPE of a file with merges found by rank, which is faster; None if ids don't follow the merges."""
    import tiktoken

    known = {e["id"] for e in said["added_tokens"]}
    ids = said["model"]["vocab"]
    merged = [ids.get("".join(m if isinstance(m, list) else m.split(" "))) for m in said["model"]["merges"]]
    if None in merged or any(x >= y for x, y in zip(merged, merged[1:])) or said.get("normalizer") or not (said["pre_tokenizer"] or {}).get("use_regex"):
        return None
    return tiktoken.Encoding("A", pat_str=PATTERN, mergeable_ranks={e: i for i, e in enumerate(entries) if i not in known}, special_tokens={})


class Tokenizers:
    """Both tokenizers with the bytes of their entries: A a byte-level BPE (JSON), B pieces with U+2581 as space."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece

        with open(a_path, encoding="utf-8") as file:
            said = json.load(file)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        alphabet = byte_alphabet()
        known = {i: e for e, i in said["model"]["vocab"].items()} | {e["id"]: e["content"] for e in said["added_tokens"]}
        self.a_size, b_size = max(known, default=-1) + 1, len(self.b)
        entries = (known.get(i, "") for i in range(self.a_size))
        self.a_bytes = [bytes(alphabet[c] for c in e) if all(c in alphabet for c in e) else e.encode() for e in entries]
        pieces = [self.b.id_to_piece(i) for i in range(b_size)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.ranked, self.a_path = ranked_encoding(said, self.a_bytes), a_path
        self.a_lengths = np.array([len(x) for x in self.a_bytes])
        self.b_lengths = np.array([len(x) for x in self.b_bytes])
        names = range(max(self.a_size, b_size))
        self.names = [f"{i}{end}" for i in names for end in ",|;"]
        self.name_lengths = np.array([len(x) for x in self.names])
        #: No piece goes on over a space, so that texts can be cut before single spaces.
        self.splits = not any(MARK in p.lstrip(MARK) for p in pieces)

    @functools.cached_property
    def a(self):
        """The tokenizer of A's file; its tables are the largest thing a worker holds, so they are loaded where it encodes."""
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(self.a_path)
        made.encode_special_tokens = True
        return made

    def encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A of space+chunk for all chunks in a row, their number in each chunk, and the same of B."""
        spaced = [" " + c for c in chunks]
        a = [*map(self.ranked.encode_ordinary, spaced)] if self.ranked else [e.ids for e in self.a.encode_batch(spaced, add_special_tokens=False)]
        return *in_a_row(a), *in_a_row(self.b.encode(chunks, num_threads=1))


@functools.lru_cache(2)
def _tokenizers(a_path: str, b_path: str) -> Tokenizers:
    return Tokenizers(a_path, b_path)


class Chunks(dict):
    """Numbers of the chunks that texts are cut into.

    A text with a space before it is cut before each single space between two characters that
    aren't white space. Both tokenizers end a token there: A's pattern starts one at white space
    after anything else, and no piece of B goes on over a space. So equal chunks have equal
    tokens in all texts, and groups end with chunks. The keys are what stands between single
    spaces; what is empty or ends in white space is no chunk by itself (-1).
    """

    def __init__(self):
        self.texts: list[str] = []
        self.joined: dict[str, int] = {}

    def __missing__(self, piece: str) -> int:
        self[piece] = n = -1 if not piece or piece[-1].isspace() else len(self.texts)
        if n >= 0:
            self.texts.append(piece)
        return n

    def _joined(self, text: str) -> int:
        if text not in self.joined:
            self.joined[text] = len(self.texts)
            self.texts.append(text)
        return self.joined[text]

    def of(self, text: str, splits: bool = True) -> np.ndarray:
        """The chunks of a text that isn't empty, in order."""
        if not splits:
            return np.array([self._joined(text)], np.int32)
        pieces = text.split(" ")
        ids = np.fromiter(map(self.__getitem__, pieces), np.int32, len(pieces))
        ends = np.flatnonzero(ids >= 0)
        if len(ends) == len(ids):
            return ids
        if not len(ends) or ends[-1] != len(ids) - 1:
            ends = np.append(ends, len(ids) - 1)
        if len(ends) > 1 and ends[-1] - ends[-2] == 1 and not pieces[-1]:
            ends = np.delete(ends, -2)  # a space at the end stays with what is before it
        starts = np.append(0, ends[:-1] + 1)
        out = np.where(starts < ends, -1, ids[ends])
        for i in np.flatnonzero(out < 0).tolist():
            out[i] = self._joined(" ".join(pieces[starts[i] : ends[i] + 1]))
        return out


def terminals(a_ends: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    """For each token of A and then of B, given their ends over the same bytes, the token of A that ends its group.

    Every token points to the token of the other side that overlaps it and reaches farthest
    right; a token of A that ends where one of B does points to itself. Successors are doubled
    until none changes, so a group of n tokens takes about log2(n) rounds.
    """
    b_of = np.searchsorted(b_ends, a_ends)
    a_of = np.searchsorted(a_ends, b_ends)
    own = np.arange(len(a_ends))
    to = np.concatenate([np.where(b_ends[b_of] > a_ends, len(a_ends) + b_of, own), a_of])
    while True:
        further = to[to]
        if np.array_equal(further, to):
            return to
        to = further


def spread(counts: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of each of several runs of `counts` positions."""
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(counts.sum())


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values, sorted."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])[: len(values)]]


def totals(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of runs of `counts` values."""
    sums = np.append(0, np.cumsum(values, dtype=np.int64))
    ends = np.cumsum(counts)
    return sums[ends] - sums[ends - counts]


def aligned_chunks(tok: Tokenizers, chunks: list[str]) -> dict:
    """Of each chunk: whether both sides give its bytes, n_a, n_b, n_groups, n_links and the length of its groups as text; and in a row all these texts and all links' id pairs."""
    a, n_a, b, n_b = tok.encode(chunks)
    raw = [(" " + c).encode() for c in chunks]
    size = np.array([len(x) for x in raw], np.int64)
    ok = (totals(tok.a_lengths[a], n_a) == size) & (totals(tok.b_lengths[b], n_b) == size)
    a_sent, b_sent = np.cumsum(n_a), np.cumsum(n_b)
    whole = b"".join(raw)
    if not (ok.all() and b"".join(map(tok.a_bytes.__getitem__, a.tolist())) == whole == b"".join(map(tok.b_bytes.__getitem__, b.tolist()))):
        for i in np.flatnonzero(ok).tolist():
            ids = a[a_sent[i] - n_a[i] : a_sent[i]].tolist(), b[b_sent[i] - n_b[i] : b_sent[i]].tolist()
            ok[i] = all(b"".join(map(t.__getitem__, x)) == raw[i] for t, x in zip((tok.a_bytes, tok.b_bytes), ids))
        a, b = a[np.repeat(ok, n_a)], b[np.repeat(ok, n_b)]
        n_a, n_b, size = (np.where(ok, x, 0) for x in (n_a, n_b, size))
    a_ends, b_ends, chunk_ends = np.cumsum(tok.a_lengths[a]), np.cumsum(tok.b_lengths[b]), np.cumsum(size)
    to = terminals(a_ends, b_ends)
    last = to[: len(a)] == np.arange(len(a))
    order = np.argsort(np.concatenate([to[: len(a)] * 2, to[len(a) :] * 2 + 1]), kind="stable")
    ids, group, side = np.concatenate([a, b])[order], to[order], order >= len(a)
    ends = np.append((group[1:] != group[:-1]) | (side[1:] != side[:-1]), True)[: len(ids)]
    names = (ids.astype(np.int64) * 3 + np.where(ends, np.where(side, 2, 1), 0)).tolist()
    said = "".join(map(tok.names.__getitem__, names)).encode()
    n_said = totals(tok.name_lengths[names], n_a + n_b)
    cuts = distinct(np.concatenate([a_ends, b_ends]))
    pairs = a[np.searchsorted(a_ends, cuts)].astype(np.int64) << 32 | b[np.searchsorted(b_ends, cuts)]
    n_links = np.diff(np.append(0, np.searchsorted(cuts, chunk_ends, side="right")))
    return {"ok": ok, "n_a": n_a, "n_b": n_b, "n_groups": totals(last, n_a), "n_links": n_links, "n_said": n_said, "said": said, "pairs": pairs}


def _texts(column: pa.Array) -> list[str | None]:
    """The texts; None for null, empty and what isn't UTF-8."""

    def read(raw: bytes | None) -> str | None:
        try:
            return raw.decode() if raw else None
        except UnicodeDecodeError:
            return None

    return [read(x) for x in column.cast(pa.binary()).to_pylist()]


def holding(texts: list[np.ndarray], n_links: np.ndarray, first: np.ndarray, which: np.ndarray, n_pairs: int) -> np.ndarray:
    """In how many of some texts, given by their chunks, each pair is linked."""
    wide = max(len(n_links), 1)
    text, chunk = np.divmod(distinct(np.repeat(np.arange(len(texts)), [len(x) for x in texts]) * wide + np.concatenate(texts)), wide)
    held = distinct(np.repeat(text, n_links[chunk]) * max(n_pairs, 1) + which[spread(n_links[chunk], first[chunk])])
    return np.bincount(held % max(n_pairs, 1), minlength=n_pairs)


def _block(tok: Tokenizers, texts: list[str | None]) -> dict[str, np.ndarray]:
    """The arrays of a block: chunks of each text, links of each chunk, the distinct pairs and in how many texts each is linked."""
    known, none = Chunks(), np.zeros(0, np.int32)
    cut = [known.of(t, tok.splits) if t else none for t in texts]
    parts = [aligned_chunks(tok, known.texts[at : at + CHUNKS]) for at in range(0, max(len(known.texts), 1), CHUNKS)]
    found = {k: np.concatenate([p[k] for p in parts]) for k in parts[0] if k != "said"}
    cut = [x if found["ok"][x].all() else none for x in cut]
    n_chunks, chunks = np.array([len(x) for x in cut], np.int64), np.concatenate([none, *cut])
    pairs = distinct(found["pairs"])
    which = np.searchsorted(pairs, found["pairs"])
    n_links = found["n_links"]
    first, docs, at = np.cumsum(n_links) - n_links, np.zeros(len(pairs), np.int64), 0
    ends = np.cumsum([n_links[x].sum() for x in cut])
    while at < len(cut):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + LINKS, side="right")))
        docs += holding(cut[at:to], n_links, first, which, len(pairs))
        at = to
    return {
        "n_chunks": slim(n_chunks), "chunks": slim(chunks), "n_links": slim(n_links), "which": slim(which),
        "a": slim(pairs >> 32), "b": slim(pairs & 0xFFFFFFFF), "docs": slim(docs),
        "n_a": slim(found["n_a"]), "n_b": slim(found["n_b"]), "n_groups": slim(found["n_groups"]),
        "n_said": slim(found["n_said"]), "said": np.frombuffer(b"".join(p["said"] for p in parts), np.uint8),
    }


def _blocks(a_path: str, b_path: str, id_col: str, text_col: str, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, n = _tokenizers(a_path, b_path), TaskContext.get().partitionId() << 32
        for batch in B.as_batch(batches, text_col, block_bytes):
            ids = batch.column(id_col).cast(pa.int64())
            arrays = _block(tok, _texts(batch.column(text_col)))
            arrays |= {"id": ids.fill_null(0).to_numpy(zero_copy_only=False), "no_id": ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8)}
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([squeezed(**arrays)], pa.binary())], names=["block", "arrays"])
            n += 1

    return run


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for n, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x = opened(blob)
            held = x["docs"] > 0
            a, b, docs = (x[k][held] for k in ("a", "b", "docs"))
            for at in range(0, len(a), 1 << 17):
                to = slice(at, at + (1 << 17))
                columns = [pa.array(np.full(len(a[to]), n)), pa.array(a[to].astype(np.int32)), pa.array(b[to].astype(np.int32)), pa.array(docs[to].astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "a", "b", "docs"])


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


def _told(key: tuple, block: pa.Table, replies: pa.Table) -> pa.Table:
    x = opened(block.column("arrays")[0].as_py())
    n_chunks, chunks, n_links, which = (x[k].astype(np.int64) for k in ("n_chunks", "chunks", "n_links", "which"))
    code = x["a"].astype(np.int64) << 32 | x["b"].astype(np.int64)
    at = np.searchsorted(code, replies.column("a").to_numpy().astype(np.int64) << 32 | replies.column("b").to_numpy())
    count, best = np.zeros(len(code), np.int64), np.zeros(len(code), np.int64)
    count[at], best[at] = replies.column("total").to_numpy(), replies.column("best").to_numpy().astype(np.int64)
    of_chunk = {"n_a": x["n_a"], "n_b": x["n_b"], "n_groups": x["n_groups"], "n_links": n_links, "n_best": totals(best[which], n_links), "count_sum": totals(count[which], n_links)}
    said, ends = x["said"].tobytes().decode(), np.cumsum(x["n_said"].astype(np.int64)).tolist()
    texts = [said[s:e] for s, e in zip([0, *ends], ends)]
    sent = np.cumsum(n_chunks)
    groups = ["".join(map(texts.__getitem__, chunks[s:e].tolist()))[:-1] for s, e in zip((sent - n_chunks).tolist(), sent.tolist())]
    columns = {"doc_id": pa.array(x["id"], mask=x["no_id"].astype(bool))}
    columns |= {k: pa.array(totals(v.astype(np.int64)[chunks], n_chunks)) for k, v in of_chunk.items()}
    return pa.table(columns | {"groups": pa.array(groups, pa.string())})


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """How the tokens of two tokenizers cover each text, and how common over all texts the links are that it holds.

    Columns: doc_id, n_a and n_b (tokens), n_groups (between byte offsets at which both sides end
    a token), n_links (pairs of tokens that overlap), n_best (links whose pair of ids is in as many
    texts as any pair of the same A id), count_sum (texts of each link's pair, summed) and groups
    (the ids of both sides, `a,a|b;a|b,b`). A null id stays null, rows alike are texts of their own,
    other columns are not read, and an empty table gives no rows. Texts that are null, empty, not
    UTF-8, or whose bytes one side doesn't give back have no tokens: zeros and ''. A text of any
    length is one document and is held by one task; `groups` must fit a Spark string.

    Pairs are counted by block before they are shuffled, so a pair comes at most once a block,
    however many texts hold it. The best counts have a row for each id of A at most and are broadcast
    while the vocabulary keeps that bounded.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "alignment")
    made = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    blocks = scratch.store(made.mapInArrow(_blocks(a_path, b_path, "doc_id", "text", block_bytes), "block long, arrays binary"), "blocks")
    pairs = blocks.mapInArrow(_pairs, "block long, a int, b int, docs long")
    counted = scratch.store(pairs.select("block", "a", "b", F.sum("docs").over(Window.partitionBy("a", "b")).alias("total")), "counted")
    best = small(counted.groupBy("a").agg(F.max("total").alias("most")), _tokenizers(a_path, b_path).a_size, 64)
    replies = counted.join(best, "a").select("block", "a", "b", "total", (F.col("total") == F.col("most")).alias("best"))
    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_told, RESULT)
