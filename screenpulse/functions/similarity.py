"""Jaro-Winkler similarity, for the titles that no exact tier matches; an Arrow UDF, as Spark has no such function."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weight of a common prefix, its longest length, and the similarity above which it counts (fixed values).
PREFIX_WEIGHT, PREFIX_LENGTH, BOOST_ABOVE = 0.1, 4, 0.7


def jaro(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken = bytearray(len(b))
    in_a = []
    for i, c in enumerate(a):
        j = b.find(c, max(0, i - reach), i + reach + 1)
        while j >= 0 and taken[j]:
            j = b.find(c, j + 1, i + reach + 1)
        if j >= 0:
            taken[j] = 1
            in_a.append(c)
    m = len(in_a)
    if not m:
        return 0.0
    in_b = [c for c, t in zip(b, taken, strict=True) if t]
    swapped = sum(x != y for x, y in zip(in_a, in_b, strict=True)) // 2
    return (m / len(a) + m / len(b) + (m - swapped) / m) / 3


def jaro_winkler(a: str, b: str) -> float:
    score = jaro(a, b)
    if score <= BOOST_ABOVE:
        return score
    same = 0
    for x, y in zip(a[:PREFIX_LENGTH], b[:PREFIX_LENGTH], strict=False):
        if x != y:
            break
        same += 1
    return score + same * PREFIX_WEIGHT * (1 - score)


def jaro_winkler_to(key: Column, name: str) -> Column:
    """Similarity of each key to one name; null keys stay null."""

    @F.pandas_udf("double")
    def score(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: None if k is None else jaro_winkler(k, name)).astype("float64")

    return score(key)
