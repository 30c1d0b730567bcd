"""Words, rolling hashes and window minima over Arrow text columns, with numpy.

All functions work on the bytes of many documents at once and never look across a
document's end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; one longer document is worked on alone.
SLICE_BYTES = 2 << 20

U64 = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240601))
_BYTE_CODES = _rng.integers(1, 2**63, size=(2, 256), dtype=np.int64).astype(U64) * U64(2) + U64(1)
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

#: True for the bytes \x20 and \x09 to \x0D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: A-Z to a-z, all other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def as_batch(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of `batches` in runs of about `limit` bytes of `text`, and never over that with two rows."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        at = 0
        while at < len(ends):
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def text_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after the other, and where each begins and ends; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word `[^\\x20\\x09-\\x0D]+`, and for each document its first word (and the number of all, last)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~IS_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cut = offsets[:-1][np.diff(offsets) > 0]
    begins[cut] = inside[cut]
    finishes = inside.copy()
    finishes[:-1] &= ~inside[1:]
    cut = offsets[1:][np.diff(offsets) > 0] - 1
    finishes[cut] = inside[cut]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(finishes) + 1, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all bits."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_powers: dict[tuple[int, bool], np.ndarray] = {}


def _power(which: int, n: int, inverse: bool) -> np.ndarray:
    have = _powers.get((which, inverse))
    if have is None or len(have) < n:
        base = pow(_BASES[which], -1, 1 << 64) if inverse else _BASES[which]
        size = 1 << max(16, int(n - 1).bit_length())
        have = np.full(size, base, U64)
        have[0] = 1
        have = np.cumprod(have, dtype=U64)
        if size <= 1 << 22:
            _powers[which, inverse] = have
    return have[:n]


def sums_of(codes: np.ndarray, which: int = 0) -> np.ndarray:
    """Running sums of `codes` times powers of a base, modulo 2**64; a range's hash follows from two of them."""
    out = np.zeros(len(codes) + 1, U64)
    np.cumsum(codes * _power(which, len(codes), False), out=out[1:])
    return out


def range_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """Hash of codes[starts:ends] for each range, the same wherever the range lies."""
    return mix((sums[ends] - sums[starts]) * _power(which, len(sums), True)[starts] + (ends - starts).astype(U64))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    return range_hash(sums_of(_BYTE_CODES[which][data], which), starts, ends, which)


def byte_codes(data: np.ndarray, which: int = 0) -> np.ndarray:
    return _BYTE_CODES[which][data]


def gram_hashes(codes: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """Hash of each `n` codes in a row, those over a document's end included; shorter than `codes` by n - 1."""
    count = max(0, len(codes) - n + 1)
    if not count:
        return np.zeros(0, U64)
    sums = sums_of(codes, which)
    return mix((sums[n:] - sums[:-n]) * _power(which, count, True))


def whole(first: np.ndarray, n: int, count: int) -> np.ndarray:
    """Which of `count` windows of `n` units lie in one document; `first`: each document's first unit and the number of all."""
    ends = np.repeat(first[1:], np.diff(first))[:count]
    return np.arange(count) + n <= ends


def sliding(x: np.ndarray, n: int, best=np.minimum) -> np.ndarray:
    """Least (or greatest) of each `n` numbers in a row; shorter than `x` by n - 1."""
    width = 1
    while width * 2 <= n:
        x = best(x[:-width], x[width:]) if len(x) > width else x[:0]
        width *= 2
    if width < n:
        x = best(x[: -(n - width)], x[n - width :]) if len(x) > n - width else x[:0]
    return x


def anchors(grams: np.ndarray, valid: np.ndarray, per_window: int) -> tuple[np.ndarray, np.ndarray]:
    """Grams that are the least of some valid window, and each window's least gram.

    A window holds `per_window` grams. Equal windows have equal least grams at equal places,
    so a window that repeats has anchors that repeat.
    """
    if not len(valid):  # fewer units in all than one window has
        return np.zeros(0, np.int64), np.zeros(0, U64)
    least = sliding(grams, per_window)[: len(valid)]
    held = np.zeros(len(least) + 2 * (per_window - 1), U64)
    held[per_window - 1 : per_window - 1 + len(least)] = np.where(valid, least, U64(0))
    top = sliding(held, per_window, np.maximum)
    return np.flatnonzero((top == grams[: len(top)]) & (top > 0)), least


def packed(x: np.ndarray, kind) -> bytes:
    return np.ascontiguousarray(x, dtype=kind).tobytes()
