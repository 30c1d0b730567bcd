"""Arrays as messages between tasks: named arrays in one compressed blob, and sorted ones cut by destination."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard


def squeezed(**arrays: np.ndarray) -> bytes:
    """Named arrays as one compressed blob."""
    head = ";".join(f"{k},{a.dtype.str},{len(a)}" for k, a in arrays.items()).encode()
    body = b"".join(planes(a).tobytes() for a in arrays.values())
    return len(head).to_bytes(4, "little") + head + zstandard.ZstdCompressor(level=1).compress(body)


def opened(blob: bytes) -> dict[str, np.ndarray]:
    n = int.from_bytes(blob[:4], "little")
    body, at, out = zstandard.ZstdDecompressor().decompress(blob[4 + n :]), 0, {}
    for part in blob[4 : 4 + n].decode().split(";"):
        name, kind, count = part.split(",")
        kind, count = np.dtype(kind), int(count)
        raw = np.frombuffer(body, np.uint8, kind.itemsize * count, at)
        out[name] = np.ascontiguousarray(raw.reshape(kind.itemsize, count).T).view(kind).ravel() if count else np.zeros(0, kind)
        at += kind.itemsize * count
    return out


def planes(x: np.ndarray) -> np.ndarray:
    """The first bytes of all numbers, then the second ones, and so on: bytes that are alike stand together."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T if len(x) else x


def slim(x: np.ndarray) -> np.ndarray:
    """Whole numbers from 0 on in the smallest type that holds them."""
    most = int(x.max()) if len(x) else 0
    return x.astype(next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if most <= np.iinfo(k).max))


def runs(sorted_values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, start, end) of each run of equal values."""
    if not len(sorted_values):
        return
    starts = np.flatnonzero(np.append(True, sorted_values[1:] != sorted_values[:-1]))
    yield from zip(sorted_values[starts].tolist(), starts.tolist(), np.append(starts[1:], len(sorted_values)).tolist())


def table_of(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)
