"""Suffix-array dedup: bytes covered by a long string that also starts elsewhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.llm import blocks as B
from colloquy.llm import repeats as R
from colloquy.llm.blobs import runs
from colloquy.llm.shared import stored, text_bytes

#: Bytes in the grams that serve as anchors.
GRAM = 32
#: Bytes of segments that a shard is planned for; a class of segments beyond it is split over several.
SHARD_BYTES = 3 << 20
#: Window starts a segment holds at most; a longer run goes on in the next.
MAX_STARTS = 4096
#: Window representatives that one merge range is planned for.
MERGE_WINDOWS = 500_000

_SENT = "shard long, block long, split int, text binary, lengths binary, weights binary, keys binary, docs binary, at binary, known_docs binary, known_at binary, known_starts binary"
_SETTLED = R.replied("runs") + ", merge int, shard long, strings binary, at binary"


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes of `text` in order.

    Larsson and Sadakane's refinement: suffixes sorted by h bytes fall into groups; only groups
    of more than one are sorted again, by the group of the suffix h bytes on, which doubles h.
    """
    n = len(text)
    one = np.zeros(n + 8, B.U64)
    one[:n] = text
    one[:n] += B.U64(1)  # 0 is the end
    two = one[:-1] * B.U64(257) + one[1:]
    three = two[:-1] * B.U64(257) + one[2:]
    key = (three[:n] * B.U64(257**3) + three[3 : n + 3]) * B.U64(257) + one[6 : n + 6]
    sa = np.argsort(key)
    ordered = key[sa]
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    heads = np.ones(n, bool)
    heads[1:] = ordered[1:] != ordered[:-1]
    rank[sa] = np.maximum.accumulate(np.where(heads, np.arange(n), 0))
    h = 7
    slots = _crowded(heads, np.arange(n))
    while len(slots):
        at = sa[slots]
        key = rank[at] * (n + 1) + rank[np.minimum(at + h, n)] + 1
        order = np.argsort(key)
        key, at = key[order], at[order]
        sa[slots] = at
        heads = np.ones(len(slots), bool)
        heads[1:] = key[1:] != key[:-1]
        rank[at] = slots[np.maximum.accumulate(np.where(heads, np.arange(len(slots)), 0))]
        slots = _crowded(heads, slots)
        h *= 2
    return sa


def _crowded(heads: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Those of `slots` in groups of more than one; `heads` says where groups begin."""
    ends = np.append(heads[1:], True)
    return slots[~(heads & ends)]


def common_prefixes(text: np.ndarray, sa: np.ndarray, lanes: np.ndarray, steps: np.ndarray, cap: int) -> np.ndarray:
    """For each place in `sa`, the bytes its suffix shares with the one before, up to `cap`.

    Kasai's rule, a suffix shares at least one byte less with the one before it than its left
    neighbour in the text did, walked along many stretches of the text at once: lane l covers
    steps[l] suffixes from lanes[l] on, and `sa` holds these suffixes alone. The rule needs
    the right neighbour of the suffix before; where that isn't in `sa`, the count starts anew.
    """
    n = len(text)
    slot = np.zeros(n, np.int64)
    slot[sa] = np.arange(len(sa))
    walked = np.zeros(n + 1, bool)
    walked[sa] = True
    padded = np.zeros(n + cap + 16, np.uint8)
    padded[:n] = text
    eight = np.ndarray(n + cap, "<u8", padded, strides=(1,))
    shared = np.zeros(len(sa), np.int32)
    order = np.argsort(-steps, kind="stable")
    lanes, steps = lanes[order], steps[order]
    h, chained = np.zeros(len(lanes), np.int64), np.zeros(len(lanes), bool)
    for t in range(int(steps[0]) if len(steps) else 0):
        live = int(np.searchsorted(-steps, -t, side="left"))
        i = lanes[:live] + t
        place = slot[i]
        j = sa[np.maximum(place - 1, 0)]
        now = np.where(chained[:live], np.maximum(h[:live] - 1, 0), 0)
        going = np.flatnonzero((place > 0) & (now < cap))
        now[place == 0] = 0
        while len(going):
            a, b = i[going] + now[going], j[going] + now[going]
            inside = np.minimum(n - np.maximum(a, b), 8)
            x = eight[a] ^ eight[b]
            # whole bytes below the lowest bit that differs; all 8 if none does
            found = (np.bitwise_count((x & (~x + B.U64(1))) - B.U64(1)) >> 3).astype(np.int64)
            more = np.minimum(found, np.maximum(inside, 0))
            now[going] += more
            going = going[(more == 8) & (now[going] < cap)]
        now = np.minimum(now, cap)
        h[:live] = now
        chained[:live] = walked[j + 1] & (place > 0)
        shared[place] = now
    return shared


def _segments(window: int, text_col: str, shards: int, shard_bytes: int):
    """Runs of candidate windows with one anchor, as (class, text, number of windows), sent to the class's shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, blocks = [], 0, R.block_ids()
        for batch in B.as_batch(batches, text_col):
            units = R.Units("bytes", batch.column(text_col), both=True)
            marked, _ = R.marks_of(batch.column("at"), units.first)
            at, least, grams = R.candidates(units, window, GRAM, marked)
            if not len(at):
                continue
            doc, anchor = units.doc_of(at), least[at]
            begin = np.ones(len(at), bool)
            begin[1:] = (at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1])
            run_head = np.maximum.accumulate(np.where(begin, np.arange(len(at)), 0))
            begin |= (np.arange(len(at)) - run_head) % MAX_STARTS == 0
            heads = np.flatnonzero(begin)
            starts, counts = at[heads], np.diff(np.append(heads, len(at)))
            ends = starts + counts - 1 + window
            hashes = [B.range_hash(B.sums_of(c, w), starts, ends, w) for w, c in enumerate((units.codes, units.codes2))]
            # the anchor's estimated count says over how many shards its class is split
            marked_grams, level = grams[marked], R.levels_of(batch.column("level"))
            order = np.argsort(marked_grams)
            spots = level[order][np.searchsorted(marked_grams[order], anchor[heads])]
            text = [units.data[a:b].tobytes() for a, b in zip(starts, ends)]
            held.append((anchor[heads], doc[heads], starts - units.first[doc[heads]], counts, spots, *hashes, np.array(text, object), batch.column("_key").to_numpy()))
            size += int((ends - starts).sum())
            if size >= 8 * shard_bytes:
                yield from _send(held, shards, next(blocks), window, shard_bytes)
                held, size = [], 0
        yield from _send(held, shards, next(blocks), window, shard_bytes)

    return run


def _send(held: list, shards: int, block: int, window: int, shard_bytes: int) -> Iterator[pa.RecordBatch]:
    if not held:
        return
    (anchor, doc, at, counts, level, first, second, text), keys = R.join_held(held)
    order = np.lexsort((at, second, first))
    anchor, doc, at, counts, level, first, second, text = (x[order] for x in (anchor, doc, at, counts, level, first, second, text))
    new = np.ones(len(first), bool)
    new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
    heads = np.flatnonzero(new)
    sizes = np.diff(np.append(heads, len(first)))
    alone = np.repeat(sizes == 1, sizes)
    group_level = np.maximum.reduceat(level, heads)
    # a class has an anchor's estimated count of segments, each of a window and the places that share its anchor
    pieces = np.maximum(1, (2.0 ** (group_level.astype(np.float64) + 1) * 1.5 * window / shard_bytes).astype(np.int64))
    shard = (anchor[heads] >> B.U64(20)) % B.U64(shards)
    # pieces of a split class are told apart by the segment's own hash, so equal segments meet
    target = shard.astype(np.int64) + np.where(pieces > 1, 1 + (first[heads] % pieces.astype(B.U64)).astype(np.int64), 0) * shards
    by_target = np.argsort(target, kind="stable")
    cuts = np.flatnonzero(np.append(True, np.diff(target[by_target]) != 0))
    rows = []
    for a, b in zip(cuts, np.append(cuts[1:], len(by_target))):
        groups = by_target[a:b]
        lead = heads[groups]
        members = np.concatenate([np.arange(heads[g], heads[g] + sizes[g]) for g in groups])
        known = members[~alone[members]]
        used, renumbered = np.unique(doc[members], return_inverse=True)
        number = dict(zip(members.tolist(), renumbered.tolist()))
        rows.append((
            int(target[by_target[a]]), block, int((pieces[groups] > 1).any()), b"".join(text[lead]), B.packed([len(x) for x in text[lead]], np.int64), B.packed(np.minimum(sizes[groups], 2), np.uint8), B.packed(keys[used], np.int64),
            B.packed([number[i] for i in lead.tolist()], np.uint32), B.packed(at[lead], np.int64), B.packed([number[i] for i in known.tolist()], np.uint32), B.packed(at[known], np.int64), B.packed(counts[known], np.int64),
        ))
    yield from R.as_rows(rows, [x.split()[0] for x in _SENT.split(", ")], [pa.int64(), pa.int64(), pa.int32()] + [pa.binary()] * 9, each=8)


def _distinct(text: np.ndarray, lengths: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments of unlike text: the text, lengths and summed weights (up to 2) of each, and each segment's number among them."""
    ends = np.cumsum(lengths)
    hashes = [B.range_hash(B.sums_of(B.byte_codes(text, w), w), ends - lengths, ends, w) for w in (0, 1)]
    order = np.lexsort(hashes)
    new = np.append(True, (np.diff(hashes[0][order]) != 0) | (np.diff(hashes[1][order]) != 0))
    rep = np.empty(len(order), np.int64)
    rep[order] = np.cumsum(new) - 1
    chosen = order[new]
    kept = b"".join(text[ends[i] - lengths[i] : ends[i]].tobytes() for i in chosen)
    return np.frombuffer(kept, np.uint8), lengths[chosen], np.minimum(np.bincount(rep, weights), 2), rep


def _repeats(window: int, merges: int):
    """Settles a shard: which windows of its segments start at least twice; windows of split classes go on to the merge."""

    def run(group: pa.Table) -> pa.Table:
        lengths, weights, keys = (R.arrays_of(group, c, k) for c, k in (("lengths", np.int64), ("weights", np.uint8), ("keys", np.int64)))
        docs, known_docs = R.shifted(keys, R.arrays_of(group, "docs", np.uint32), R.arrays_of(group, "known_docs", np.uint32))
        lengths, weights = np.concatenate(lengths), np.concatenate(weights)
        at, known_at, known_counts = (np.concatenate(R.arrays_of(group, c, np.int64)) for c in ("at", "known_at", "known_starts"))
        whole = np.frombuffer(b"".join(group.column("text").to_pylist()), np.uint8)
        text, lengths, heavy, rep = _distinct(whole, lengths, weights)
        base = np.append(0, np.cumsum(lengths))[:-1]
        counts = lengths - window + 1
        owner = np.repeat(np.arange(len(base)), lengths)
        sa = suffix_array(text)
        spots = sa[sa - base[owner[sa]] < counts[owner[sa]]]
        shared = common_prefixes(text, spots, base, counts, window)
        # windows in suffix order; a new group begins where less than a window is shared
        _, label = np.unique(np.cumsum(shared < window), return_inverse=True)
        total = np.bincount(label, heavy[owner[spots]]) if len(spots) else np.zeros(0)
        hit = np.zeros(len(text), bool)
        hit[spots[total[label] >= 2]] = True
        where = np.flatnonzero(hit)
        begins, ends = _runs(where, owner)
        # runs of each distinct segment, given to all its occurrences that no task has settled
        of_run = owner[where[begins]] if len(begins) else np.zeros(0, np.int64)
        first = np.searchsorted(of_run, np.arange(len(base) + 1))
        singles = np.flatnonzero(weights == 1)
        n_runs = np.diff(first)[rep[singles]]
        own = np.repeat(singles, n_runs)
        run = np.arange(len(own)) - np.repeat(np.cumsum(n_runs) - n_runs, n_runs) + first[:-1][rep[own]]
        from_ = at[own] + (where[begins] - base[of_run])[run] if len(own) else np.zeros(0, np.int64)
        to = from_ + (ends - begins)[run] if len(own) else from_
        runs = np.stack([np.concatenate([from_, known_at]), np.concatenate([to, known_at + known_counts])], axis=1)
        out = R.replies(group, keys, np.concatenate([docs[own], known_docs]), runs=runs)
        found = [out.column(i) for i in range(4)]
        rows = []
        if group.column("split").to_numpy().any():
            lone = np.zeros(len(base), np.int64)
            lone[rep] = np.arange(len(rep))
            rows = _for_merge(text, window, spots, label, total, owner, base, docs[lone], at[lone], np.concatenate(keys), merges, int(group.column("shard")[0].as_py()))
        kinds = [pa.int64()] + [pa.binary()] * 3 + [pa.int32(), pa.int64()] + [pa.binary()] * 2
        none = [pa.nulls(out.num_rows, k) for k in kinds[4:]]
        names = [x.split()[0] for x in _SETTLED.split(", ")]
        settled = pa.Table.from_arrays([*found, *none], names=names)
        return pa.concat_tables([settled, pa.Table.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)])

    return run


def _runs(where: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end index in `where` of each run of neighbours in one segment."""
    if not len(where):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.append(True, (np.diff(where) != 1) | (np.diff(owner[where]) != 0))
    begins = np.flatnonzero(new)
    return begins, np.append(begins[1:], len(where))


def _for_merge(text, window, spots, label, total, owner, base, docs, at, keys, merges, shard) -> list[tuple]:
    """Each distinct window of a piece of a split class, with its place if the piece has not settled it: dealt to ranges, in suffix order there."""
    heads = np.flatnonzero(np.append(True, np.diff(label) != 0)) if len(label) else np.zeros(0, np.int64)
    lead, settled = spots[heads], total[label[heads]] >= 2
    own = owner[lead]
    key, place = keys[docs[own]], np.where(settled, -1, at[own] + lead - base[own])
    part = (B.range_hash(B.sums_of(B.byte_codes(text)), lead, lead + window) % B.U64(merges)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    strings = np.lib.stride_tricks.sliding_window_view(text, window) if len(text) >= window else None
    return [
        (None, B.packed(key[own_], np.int64), None, None, p, shard, strings[lead[own_]].tobytes(), B.packed(place[own_], np.int64))
        for p, own_ in ((p, order[a:b]) for p, a, b in runs(part[order]))
    ]


def _merge(window: int):
    """Windows of one range that a binary search finds in the sorted list of another shard as well."""

    def run(group: pa.Table) -> pa.Table:
        lists = [np.frombuffer(x, np.dtype((np.void, window))) for x in group.column("strings").to_pylist()]
        keys, places = (R.arrays_of(group, c, np.int64) for c in ("keys", "at"))
        # the lists are in suffix order each, so sorting all of them merges runs
        everything = np.sort(np.concatenate(lists), kind="stable")
        found_keys, found_runs = [], []
        for strings, key, place in zip(lists, keys, places):
            open_ = np.flatnonzero(place >= 0)
            low, high = (np.searchsorted(everything, strings[open_], side) for side in ("left", "right"))
            hits = open_[high - low >= 2]
            found_keys.append(key[hits])
            found_runs.append(np.stack([place[hits], place[hits] + 1], axis=1))
        found_keys, number = np.unique(np.concatenate(found_keys), return_inverse=True)
        row = (group.column("merge")[0].as_py(), 0, found_keys.tobytes(), number.astype(np.uint32).tobytes(), np.concatenate(found_runs).tobytes())
        # a range may have nothing left to report: all settled by the pieces, or met once
        rows = [row] if len(found_keys) else []
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate([pa.int32(), pa.int64()] + [pa.binary()] * 3)], names=["merge", "block", "keys", "docs", "runs"])

    return run


def settled_shards(docs: DataFrame, window: int, id_col: str, text_col: str, shard_bytes: int = SHARD_BYTES, merge_windows: int = MERGE_WINDOWS) -> DataFrame:
    """Stored replies of the shards: runs of windows that start twice there, and (merge is not null) windows that other shards may have."""
    source = R.keyed(docs.select(id_col, text_col), id_col, text_col)
    anchors = R.possibly_repeated(source, text_col, "bytes", window, GRAM, text_bytes(docs, text_col))
    marked = anchors.agg(F.sum(F.aggregate("at", F.lit(0).cast("long"), lambda s, x: s + (F.length(x) / 4).cast("long")))).first()[0] or 0
    shards = max(1, round(marked * 1.5 * window / shard_bytes + 0.5))
    joined = source.join(anchors.hint("shuffle_hash"), "_key")
    sent = joined.select("_key", text_col, "at", "level").mapInArrow(_segments(window, text_col, shards, shard_bytes), _SENT)
    merges = max(1, round(marked * 100 / merge_windows + 0.5))
    return stored(sent.groupBy("shard").applyInArrow(_repeats(window, merges), _SETTLED), "settled-shards")


def repeated_strings(settled: DataFrame, window: int) -> DataFrame:
    """Stored rows (_key, runs list of binary int64 pairs): starts [from, to) of byte windows that start elsewhere too."""
    merged = settled.where("merge is not null").select("merge", "strings", "keys", "at").groupBy("merge").applyInArrow(_merge(window), "merge int, " + R.replied("runs"))
    # a merge range replies for documents of many blocks; spread those by the range
    merged = merged.select((-F.col("merge") - 1).cast("long").alias("block"), "keys", "docs", "runs")
    return R.by_document(settled.where("merge is null").select("block", "keys", "docs", "runs").unionByName(merged), "runs")


def dedup_strings(docs: DataFrame, window: int = 200, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, merge_windows: int = MERGE_WINDOWS) -> DataFrame:
    """`docs` with kept_bytes, n_bytes, n_removed and n_spans: bytes in a string of `window` bytes that also starts elsewhere are removed.

    Texts are taken as UTF-8; matches never cross texts, may overlap, and are judged on the
    input. All copies go, the first included. Windows whose anchor may repeat (see `repeats`)
    are cut out as segments; segments with the same anchor meet in one shard, where a suffix
    array and common prefixes group their windows. A class of segments larger than `shard_bytes`
    is split over several shards; what these don't settle alone, windows in suffix order, is
    merged by ranges: a binary search on the bytes finds the windows that other shards have too.

    Null text: empty. Texts shorter than `window` keep all. Each row is a document of its own,
    also where rows are alike in id and text. A null id is an id. Text of any length is taken
    whole. An empty table gives an empty result. Columns of `docs` with a result's name are
    replaced; `_key` and `_runs` are reserved.
    """
    found = repeated_strings(settled_shards(docs, window, id_col, text_col, shard_bytes, merge_windows), window).withColumnRenamed("runs", "_runs")
    joined = R.keyed(docs, id_col, text_col).join(found.hint("shuffle_hash"), "_key", "left")
    extra = [T.StructField("kept_bytes", T.BinaryType())] + [T.StructField(x, T.LongType()) for x in ("n_bytes", "n_removed", "n_spans")]
    passed = [f for f in docs.schema if f.name not in {x.name for x in extra}]

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.as_batch(batches, text_col):
            out = []
            for text, blobs in zip(batch.column(text_col).cast(pa.binary()).to_pylist(), batch.column("_runs").to_pylist()):
                text = text or b""
                spans = merged_spans(np.concatenate([np.frombuffer(b, np.int64) for b in blobs]).reshape(-1, 2), window) if blobs else []
                kept, last = [], 0
                for a, b in spans:
                    kept.append(text[last:a])
                    last = b
                kept = b"".join([*kept, text[last:]])
                out.append((kept, len(text), len(text) - len(kept), len(spans)))
            made = [pa.array([x[i] for x in out], k) for i, k in enumerate((pa.binary(), pa.int64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in passed] + made, names=[f.name for f in [*passed, *extra]])

    return joined.mapInArrow(remove, T.StructType([*passed, *extra]))


def merged_spans(runs: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Maximal removed byte ranges, from ranges of window starts."""
    runs = runs[np.argsort(runs[:, 0], kind="stable")]
    begin, end = runs[:, 0], np.maximum.accumulate(runs[:, 1] - 1 + window)
    new = np.append(True, begin[1:] > end[:-1])
    heads = np.flatnonzero(new)
    return list(zip(begin[heads].tolist(), end[np.append(heads[1:], len(runs)) - 1].tolist()))
