"""Exact change-point detection: the cheapest split of a series into flat stretches.

Optimal partitioning over prefix sums, with the pruning of Killick, Fearnhead and Eckley (2012) held back until a
later start is long enough to take over, so a least stretch length loses no optimum.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import accumulate

import numpy as np

from ..config import DEFAULT, Thresholds
from .damping import JUMP_TO_SIGMA


#: Up to so many values, plain lists are faster than arrays.
SHORT = 48


def sigma_of(x: np.ndarray, t: Thresholds = DEFAULT) -> float:
    if len(x) < 2:
        return t.noise_floor
    return max(t.noise_floor, float(np.median(np.abs(x[1:] - x[:-1]))) * JUMP_TO_SIGMA)


def break_penalty(x: np.ndarray, t: Thresholds = DEFAULT) -> float:
    sigma = sigma_of(x, t)
    return t.penalty * sigma * sigma * math.log(max(len(x), 2))


def break_prices(n: int, price: float, premieres: Sequence[int] = (), t: Thresholds = DEFAULT) -> np.ndarray:
    """What a break before each place costs: nothing before the first, less where a season begins."""
    prices = np.full(n + 1, price)
    inside = [p for p in premieres if 0 < p < n]
    prices[inside] = price * t.premiere_discount
    prices[0] = 0.0
    return prices


def stretch_ends(x: Sequence[float], price: float | None = None, premieres: Sequence[int] = (), t: Thresholds = DEFAULT) -> list[int]:
    """End (exclusive) of each stretch; of equally cheap splits the one whose last stretch starts first."""
    x = np.asarray(x, np.float64)
    n, least = len(x), t.least_stretch
    if n < 2 * least:
        return [n] if n else []
    prices = break_prices(n, break_penalty(x, t) if price is None else price, premieres, t)
    if n <= SHORT:
        return _short(x.tolist(), prices.tolist(), least)
    sums, squares = np.r_[0.0, np.cumsum(x)], np.r_[0.0, np.cumsum(x * x)]
    best, came_from = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
    best[0] = 0.0
    last_use = np.full(n + 1, n + 1)  # a start is out from this end on
    start = np.zeros(1, np.int64)
    for end in range(least, n + 1):
        start = start[last_use[start] > end]
        able = start[start <= end - least]
        total = sums[end] - sums[able]
        price_here = best[able] + ((squares[end] - squares[able]) - total * total / (end - able)) + prices[able]
        k = int(price_here.argmin())
        best[end], came_from[end] = price_here[k], able[k]
        lost = able[price_here > best[end] + prices[end]]
        last_use[lost] = np.minimum(last_use[lost], end + least)
        start = np.r_[start, end]
    ends = [n]
    while came_from[ends[-1]] > 0:
        ends.append(int(came_from[ends[-1]]))
    return ends[::-1]


def _short(x: list[float], prices: list[float], least: int) -> list[int]:
    """The same optimum over every start, with the same sums."""
    n = len(x)
    sums, squares = [0.0, *accumulate(x)], [0.0, *accumulate(v * v for v in x)]
    best, came_from = [0.0] + [math.inf] * n, [0] * (n + 1)
    for end in range(least, n + 1):
        low, at = math.inf, 0
        for start in range(end - least + 1):
            total = sums[end] - sums[start]
            here = best[start] + ((squares[end] - squares[start]) - total * total / (end - start)) + prices[start]
            if here < low:
                low, at = here, start
        best[end], came_from[end] = low, at
    ends = [n]
    while came_from[ends[-1]]:
        ends.append(came_from[ends[-1]])
    return ends[::-1]


def split_price(x: Sequence[float], ends: Sequence[int], price: float, premieres: Sequence[int] = (), t: Thresholds = DEFAULT) -> float:
    """What a split costs in all: squared spread within stretches, and breaks."""
    x = np.asarray(x, np.float64)
    prices = break_prices(len(x), price, premieres, t)
    spread = sum(float(((x[a:b] - x[a:b].mean()) ** 2).sum()) for a, b in zip([0, *ends[:-1]], ends, strict=True))
    return spread + float(sum(prices[e] for e in ends[:-1]))
