"""Word alignment of two texts: the shortest edit script, as spans of words removed and added."""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What Java's `\\s` matches, so that words are the same here and in expressions.
GAP = re.compile(r"[ \t\n\x0B\f\r]+")
#: Words up to which all rows of lengths are kept, 2 MB.
SHORT = 4096
SPANS = T.ArrayType(T.StructType().add("kind", "string").add("at", "integer").add("words", "string"))


def edit_spans(before: Column, after: Column) -> Column:
    """Spans that turn the words of `before` into those of `after` with the fewest words removed and added.

    Each has its kind (`removed` or `added`), the place among the words of `before` where the gap
    between kept words begins, and its words joined by a blank; at one place the removed come first.
    Of several shortest scripts it is the one that keeps the latest words of both. Two words a bit
    are compared at once, so texts of n and m words take n * m / 64 steps, and the memory for the way
    back is that of the square root of m rows: texts of any length are aligned whole. A null text
    gives null; texts without words have no words.
    """
    return _edit_spans(before, after)


#: Rows whose spans are Python objects at a time; then they are Arrow columns.
ROWS = 64


@F.arrow_udf(SPANS)
def _edit_spans(before: pa.Array, after: pa.Array) -> pa.Array:
    return pa.concat_arrays([_columns(before.slice(i, ROWS).to_pylist(), after.slice(i, ROWS).to_pylist()) for i in range(0, max(len(before), 1), ROWS)])


def _columns(before: list[str | None], after: list[str | None]) -> pa.Array:
    """One list of spans a row; an offset of null makes the row null."""
    offsets, found = [], []
    for b, a in zip(before, after):
        offsets.append(None if b is None or a is None else len(found))
        if offsets[-1] is not None:
            found += spans(_words(b), _words(a))
    offsets.append(len(found))
    kinds = {"kind": pa.string(), "at": pa.int32(), "words": pa.string()}
    fields = [pa.array([s[name] for s in found], kind) for name, kind in kinds.items()]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, list(kinds)))


def _words(text: str) -> list[str]:
    return [w for w in GAP.split(text) if w]


def spans(a: list[str], b: list[str]) -> list[dict]:
    found, i, j = [], 0, 0
    for x, y in [*kept_words(a, b), (len(a), len(b))]:
        if x > i:
            found.append({"kind": "removed", "at": i, "words": " ".join(a[i:x])})
        if y > j:
            found.append({"kind": "added", "at": i, "words": " ".join(b[j:y])})
        i, j = x + 1, y + 1
    return found


def kept_words(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of the words of a longest common subsequence, in order."""
    end = 0
    while end < min(len(a), len(b)) and a[-1 - end] == b[-1 - end]:
        end += 1
    tail = [(len(a) - k, len(b) - k) for k in range(end, 0, -1)]
    a, b = a[: len(a) - end], b[: len(b) - end]
    # words of `a` that `b` lacks are passed over on any way back; if all others are those of `b` that `a` has, there is one way
    there, here = set(b), set(a)
    places_a, places_b = [i for i, w in enumerate(a) if w in there], [j for j, w in enumerate(b) if w in here]
    a = [a[i] for i in places_a]
    if a == [b[j] for j in places_b]:
        return [*zip(places_a, places_b), *tail]
    n, full = len(a), (1 << len(a)) - 1
    places: dict[str, list[int]] = {}
    for i, w in enumerate(a):
        places.setdefault(w, []).append(i)
    often: dict[str, int] = {}
    if n <= SHORT:
        for w, at in places.items():
            often[w] = sum(1 << i for i in at)

    def bits(word: str) -> int:
        at = places.get(word)
        if not at:
            return 0
        if word in often:
            return often[word]
        row = bytearray(n // 8 + 1)
        for i in at:
            row[i >> 3] |= 1 << (i & 7)
        value = int.from_bytes(row, "little")
        if len(at) > 64:  # at most n / 64 words, so they may be kept
            often[word] = value
        return value

    def after(row: int, word: str) -> int:
        """The next row of lengths: a zero bit is a place where the length grows by one."""
        hit = row & bits(word)
        return ((row + hit) | (row - hit)) & full

    # short texts keep all rows; of others every step-th, and a block of rows is found again on the way back
    step = len(b) if n <= SHORT and len(b) <= SHORT else math.isqrt(len(b)) + 1
    row, marks = full, [full] if step == len(b) else []
    for j, w in enumerate(b if not marks else []):
        if j % step == 0:
            marks.append(row)
        row = after(row, w)
    found, i = [], n
    for block in range(len(marks) - 1, -1, -1):
        first = block * step
        rows, row = [], marks[block]
        for w in b[first : first + step]:
            row = after(row, w)
            rows.append(row.to_bytes(n // 8 + 1, "little"))
        j = first + len(rows)
        while j > first and i > 0:
            if a[i - 1] == b[j - 1]:
                i, j = i - 1, j - 1
                found.append((places_a[i], j))
            elif rows[j - 1 - first][(i - 1) >> 3] >> ((i - 1) & 7) & 1:
                i -= 1
            else:
                j -= 1
    return found[::-1] + tail


def unlisted(found: Column, listed: Column) -> Column:
    """Removed spans, as words, that stand in none of the removals listed for the text; null lists none."""
    squeezed = F.transform(F.coalesce(listed, F.array().cast("array<string>")), lambda x: F.concat(F.lit(" "), F.array_join(F.filter(F.split(x, r"\s+"), lambda w: w != ""), " "), F.lit(" ")))
    gone = F.transform(F.filter(found, lambda s: s["kind"] == "removed"), lambda s: s["words"])
    return F.filter(gone, lambda s: ~F.exists(squeezed, lambda r: r.contains(F.concat(F.lit(" "), s, F.lit(" ")))))
