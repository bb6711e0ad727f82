"""Scalar functions over text, dates and complex numbers, on the JVM side; transforms of whole vectors in Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ascii_lower(value: Column) -> Column:
    return F.translate(value, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def replace_first(value: Column, pattern: str, replacement: str) -> Column:
    """Only the first match is replaced; `replacement` is plain text."""
    at = F.regexp_instr(value, F.lit(f"({pattern})"))
    found = F.regexp_extract(value, f"({pattern})", 1)
    return F.when(at > 0, F.concat(F.substring(value, F.lit(1), at - 1), F.lit(replacement), F.substring(value, at + F.length(found), F.length(value)))).otherwise(value)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dir_name(path: Column) -> Column:
    """The path without its last part; '' if it has only one."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_extract(path, "^(.*)/[^/]*$", 1)).otherwise("")


def top_level(host: Column) -> Column:
    """The part after the last dot; the whole if there is none."""
    return F.element_at(F.split(host, "[.]"), -1)


def parent_domain(host: Column) -> Column:
    """The host without its first label, with the leading dot; '' for a single label."""
    return F.when(F.contains(host, F.lit(".")), F.regexp_replace(host, "^[^.]*", "")).otherwise("")


def underline(title: Column) -> Column:
    return F.repeat(F.lit("-"), F.length(title))


def tag_text(value: Column, tag: str) -> Column:
    """What stands between <tag> and </tag> on a line; null if they do not."""
    hit = f"<{tag}>([^<]*)</{tag}>"
    return F.when(value.rlike(hit), F.regexp_extract(value, hit, 1))


def delete_characters(value: Column, characters: str) -> Column:
    return F.translate(value, characters, "")


def squeeze_characters(value: Column, characters: str) -> Column:
    """Runs of one of the characters shortened to a single one."""
    one = "[" + "".join("\\" + c if not c.isalnum() and c > " " else c for c in characters) + "]"
    return F.regexp_replace(value, f"({one})\\1+", "$1")


def keep_characters(value: Column, characters: str, instead: str = "") -> Column:
    """Runs of other characters replaced, each run by one `instead`; characters is the inside of a character class, such as A-Za-z."""
    return F.regexp_replace(value, f"[^{characters}]+", instead)


def strip_comments(code: Column) -> Column:
    """Program text with strings and characters emptied, and comments taken out."""
    escaped = F.regexp_replace(code, r"\\[\\\"']", "@")
    emptied = F.regexp_replace(F.regexp_replace(escaped, '"[^"\n]*"', '""'), "'[^'\n]*'", "''")
    return F.regexp_replace(emptied, r"(?s)/\*.*?\*/|//[^\n]*", " ")


def week_day(day: Column) -> Column:
    return F.date_format(day, "EEE")


def day_number(seconds: Column) -> Column:
    """Whole days since 1970-01-01."""
    return F.floor(seconds / 86400)


def whole(value: Column) -> Column:
    """Truncated toward zero."""
    return value.cast("bigint")


def percent_decode(text: Column) -> Column:
    """%xx decoded, `+` left as it is."""
    return F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def complex_number(re: Column, im: Column) -> Column:
    return F.struct(re.cast("double").alias("re"), im.cast("double").alias("im"))


def twiddle(stage: int, n: int) -> tuple[float, float]:
    """The n-th power of the first root of unity of order 2**stage, counter-clockwise."""
    angle = 2 * math.pi * n / 2**stage
    return math.cos(angle), math.sin(angle)


def butterfly(a: Column, b: Column, stage: int, n: int) -> tuple[Column, Column]:
    """a + w*b and a - w*b for the twiddle factor w."""
    c, s = twiddle(stage, n)
    re, im = b["re"] * c - b["im"] * s, b["re"] * s + b["im"] * c
    return complex_number(a["re"] + re, a["im"] + im), complex_number(a["re"] - re, a["im"] - im)


def inverse_transform(channels: list[Column]) -> list[Column]:
    """The unscaled transform of 2**k complex channels, by the same network of butterflies a graph of stages would have."""
    n = len(channels)
    bits = n.bit_length() - 1
    if 1 << bits != n:
        raise ValueError("the number of channels must be a power of two")
    x = [channels[int(format(i, f"0{bits}b")[::-1], 2)] if bits else channels[i] for i in range(n)]
    for stage in range(1, bits + 1):
        half = 1 << (stage - 1)
        for begin in range(0, n, 2 * half):
            for k in range(half):
                x[begin + k], x[begin + k + half] = butterfly(x[begin + k], x[begin + k + half], stage, k)
    return x


def transform_stages(df: DataFrame, keep: list[str], channels: list[str]) -> DataFrame:
    """The same network over 2**k columns of numbers, as one projection for each of its stages: (keep, re0, im0, re1, im1, ...).

    A stage names what it makes, and the next one reads it by name, so no expression holds another one twice.
    """
    n = len(channels)
    bits = n.bit_length() - 1
    if 1 << bits != n:
        raise ValueError("the number of channels must be a power of two")
    first = [F.col(channels[int(format(i, f"0{bits}b")[::-1], 2) if bits else 0]).cast("double") for i in range(n)]
    made = df.select(*keep, *[c for i, x in enumerate(first) for c in (x.alias(f"re{i}"), F.lit(0.0).alias(f"im{i}"))])
    for stage in range(1, bits + 1):
        half, out = 1 << (stage - 1), {}
        for begin in range(0, n, 2 * half):
            for k in range(half):
                i, j = begin + k, begin + k + half
                a, b = ({"re": F.col(f"re{x}"), "im": F.col(f"im{x}")} for x in (i, j))
                c, s = twiddle(stage, k)
                re, im = b["re"] * c - b["im"] * s, b["re"] * s + b["im"] * c
                out |= {f"re{i}": a["re"] + re, f"im{i}": a["im"] + im, f"re{j}": a["re"] - re, f"im{j}": a["im"] - im}
        made = made.select(*keep, *[out[f"{p}{i}"].alias(f"{p}{i}") for i in range(n) for p in ("re", "im")])
    return made


def transformed(vector: Column) -> Column:
    """The unscaled transform of arrays of numbers of any length, as arrays of complex numbers; whole batches at a time.

    Null arrays stay null, and empty ones empty; a null number is taken as 0.
    """
    kind = T.StructType([T.StructField("re", T.DoubleType(), False), T.StructField("im", T.DoubleType(), False)])

    @F.arrow_udf(T.ArrayType(kind, False))
    def run(values: pa.Array) -> pa.Array:
        flat = pc.fill_null(values.flatten().cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
        sizes = pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        out = np.empty(len(flat), complex)
        for n in np.unique(sizes[sizes > 0]):  # vectors of one length are one matrix
            at = offsets[:-1][sizes == n][:, None] + np.arange(n)
            out[at] = np.fft.ifft(flat[at], axis=1) * n
        fields = [pa.field("re", pa.float64(), False), pa.field("im", pa.float64(), False)]
        items = pa.StructArray.from_arrays([pa.array(out.real.copy()), pa.array(out.imag.copy())], fields=fields)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items, type=pa.list_(pa.field("element", items.type, False)), mask=values.is_null())

    return run(vector)
