"""String, regex, JSON and hash expressions over columns; all run in the JVM."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Any character that a Unicode-aware strip removes; `trim` alone removes blanks only.
SPACE = r"[\p{IsWhite_Space}\x1C-\x1F]"


def bound(value: Column, body) -> Column:
    """`body(value)` with `value` computed once a row, also where `body` uses it inside of lambdas."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, rf"{SPACE}+$", "")


def is_blank(text: Column) -> Column:
    return text.isNull() | (strip(text) == "")


def collapse(text: Column) -> Column:
    """Each run of white space as one blank, none at the ends."""
    return strip(F.regexp_replace(text, rf"{SPACE}+", " "))


def folded(text: Column) -> Column:
    """A form in which texts are alike that differ in case only; `ß` is `ss`."""
    return F.replace(F.lower(F.upper(text)), F.lit("ß"), F.lit("ss"))


def numbered_id(prefix: str, number: Column, width: int = 6) -> Column:
    return F.format_string(f"{prefix}_%0{width}d", number)


def file_stem(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def remap_prefix(path: Column, old: str, new: str) -> Column:
    """`path` below `new` if it is `old` or lies below it, else unchanged."""
    old, new = old.rstrip("/"), new.rstrip("/")
    return F.when(path == old, F.lit(new)).when(path.startswith(old + "/"), F.concat(F.lit(new), F.substring(path, F.lit(len(old) + 1), F.length(path)))).otherwise(path)


def video_id(url: Column, short_host: str = "youtu.be") -> Column:
    """Id in a video URL: the path of the short host, `watch?v=`, `/embed/` or `/v/`; else null."""
    host, path = F.try_parse_url(url, F.lit("HOST")), F.try_parse_url(url, F.lit("PATH"))
    first = lambda s: F.nullif(F.get(F.split(s, "/"), F.lit(0)), F.lit(""))
    below = lambda prefix: first(F.substring(path, F.lit(len(prefix) + 1), F.length(path)))
    return (
        F.when(host == short_host, below("/"))
        .when(path == "/watch", F.try_parse_url(url, F.lit("QUERY"), F.lit("v")))
        .when(path.startswith("/embed/"), below("/embed/"))
        .when(path.startswith("/v/"), below("/v/"))
    )


def safe_id(text: Column, most: int = 20) -> Column:
    """Anything but letters and digits as `_`, the first `most` characters."""
    return F.substring(F.regexp_replace(text, r"(?U)[^\p{Alnum}]", "_"), 1, most)


def marker_count(text: Column, marker: str = "<image>") -> Column:
    return F.regexp_count(text, F.lit(r"\Q" + marker + r"\E"))


def truncated(text: Column, most: int, note: str) -> Column:
    """The first `most` characters, and `note` if there were more."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(note))).otherwise(text)


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def text_parts(parts: Column) -> Column:
    return F.filter(parts, lambda p: p["type"] == "text")


def data_uri(content: Column, mime: Column) -> Column:
    """A data URI of bytes, its payload on one line: `base64` breaks lines at 76 characters."""
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.translate(F.base64(content), "\r\n", ""))


def title_case(text: Column) -> Column:
    """First letter of each run of letters upper, the others lower, with any other character between runs."""
    pieces = F.regexp_extract_all(text, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, F.lit(2), F.length(p))))), "")


def canonical_json(**fields: Column) -> Column:
    """JSON text with keys in order, no blanks and nulls kept."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in sorted(fields.items())]), {"ignoreNullFields": "false"})


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def run_key(*parts: Column) -> Column:
    """Hash of the parts joined by the unit separator; null parts count as empty."""
    return sha256(F.concat_ws("\u001f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def custom_id(task: Column, model: Column, *parts: Column) -> Column:
    """task_model_hash, with a safe model name and 20 hex digits over the parts."""
    joined = F.concat_ws("\u0000", *[F.coalesce(p.cast("string"), F.lit("")) for p in (task, model, *parts)])
    return F.concat_ws("_", task, safe_id(model), F.substring(sha256(joined), 1, 20))


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two arrays; in Arrow batches, with one row of the table at a time."""

    @F.pandas_udf("int")
    def lengths(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([_common(x, y) for x, y in zip(left, right)], dtype="Int32")

    return lengths(a, b)


def _common(x, y) -> int | None:
    if x is None or y is None:
        return None
    number: dict[str, int] = {}
    short, long = sorted((np.array([number.setdefault(t, len(number)) for t in side], np.int64) for side in (x, y)), key=len)
    row = np.zeros(len(long) + 1, np.int32)
    for token in short:
        # the best of leaving this token out and of pairing it, carried on from left to right
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(long == token, row[:-1] + 1, 0)))
    return int(row[-1])


def f1(hits: Column, predicted: Column, wanted: Column) -> Column:
    """Harmonic mean of precision and recall, 0 where either side is empty."""
    precision, recall = F.try_divide(hits, predicted), F.try_divide(hits, wanted)
    return F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))


def clamp_linear(x: Column, low: float, high: float) -> Column:
    """0 up to `low`, 1 from `high`, straight between."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x - low) / (high - low)))


def round_binary(x: Column, digits: int = 3) -> Column:
    """`x` rounded to `digits` places by its exact binary value, as Python does: 2.675 is a little less and goes to 2.67; true ties go to the even digit.

    x * 10**digits is split into a rounded product and its exact error (both factors are cut in
    halves whose products have no error), and what is over a whole number is held against a half.
    Doubles so large that the product has no places are left as they are.
    """
    scale, cut = float(10**digits), 134217729.0  # 2**27 + 1

    def halves(v: Column) -> tuple[Column, Column]:
        high = v * cut - (v * cut - v)
        return high, v - high

    def rounded(a: Column) -> Column:
        (high, low), upper = halves(a), scale * cut - (scale * cut - scale)
        lower, product = scale - upper, a * scale
        error = ((high * upper - product) + high * lower + low * upper) + low * lower
        whole = F.floor(product).cast("double")
        over = (product - whole) - 0.5  # exact: both are multiples of the product's last place
        up = (over + error > 0) | ((over == -error) & (whole % 2 == 1))
        down = (over == -0.5) & (error < 0) & (-error > 0.5)
        return F.when(product >= 2.0**52, a).otherwise((whole + F.when(up, 1.0).when(down, -1.0).otherwise(0.0)) / scale)

    size = F.abs(x)
    return F.when(F.isnan(x) | (size == float("inf")), x).otherwise(bound(size, rounded) * F.when(x < 0, -1.0).otherwise(1.0))
