"""Column expressions that Spark lacks or that the operators share; all of them stay in the JVM."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def array_median(values: Column, n: Column | None = None) -> Column:
    """Median of an array without nulls, the mean of the middle two if even; null if empty.

    `values` is sorted once: the middle is one slice of it.  Give n, its size, where it is known otherwise.
    """
    n = F.size(values) if n is None else n
    many = F.when(n % 2 == 0, 2).otherwise(1)
    middle = F.slice(F.sort_array(values), F.floor((n + 1) / 2).cast("int"), many)
    return F.when(n > 0, F.aggregate(middle, F.lit(0.0), lambda total, x: total + x) / many)


def array_mad(values: Column, middle: Column, n: Column | None = None) -> Column:
    """Median absolute deviation from `middle`, which must be a column of its own: it is read for every element."""
    return array_median(F.transform(values, lambda x: F.abs(x - middle)), F.size(values) if n is None else n)


def tolerant_double(text: Column) -> Column:
    """The number a text holds, or null."""
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def tolerant_int(text: Column, kind: str = "int") -> Column:
    """The number a text holds, rounded half away from zero, or null if it isn't one or doesn't fit."""
    return F.round(tolerant_double(text)).try_cast(kind)


@cache
def _folding() -> tuple[str, str]:
    """Letters whose canonical decomposition is one ASCII character and marks, and those characters."""
    letters, plain = [], []
    for code in range(0x80, 0x30000):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and ord(parts[0]) < 128 and all(unicodedata.combining(c) for c in parts[1:]):
            letters.append(chr(code))
            plain.append(parts[0])
    return "".join(letters), "".join(plain)


def search_key(title: Column) -> Column:
    """Lower-case words of letters and digits without accents; & is "and"."""
    plain = F.translate(F.replace(title, F.lit("&"), F.lit(" and ")), *_folding())
    plain = F.lower(F.regexp_replace(plain, r"\p{M}+", ""))
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))


def display_id(tid: Column) -> Column:
    return F.format_string("tt%07d", tid)


def episode_label(season: Column, episode: Column) -> Column:
    return F.concat(F.lit("S"), season.cast("string"), F.lit("E"), episode.cast("string"))


def years_label(start: Column, end: Column) -> Column:
    first, last = start.cast("string"), end.cast("string")
    return F.when(start.isNull(), "year unknown").when(end.isNull(), F.concat(first, F.lit("–"))).when(start == end, first).otherwise(F.concat(first, F.lit("–"), last))
