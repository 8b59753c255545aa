"""A verdict for each series: where it gets good, slumps and low points.

A series is at most some ten thousand episodes; one at a time is in memory.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Thresholds
from .changepoints import sigma_of, stretch_ends


@dataclass(frozen=True)
class Stretch:
    start: int
    end: int
    level: float


@dataclass(frozen=True)
class Verdict:
    kind: str
    at: str | None
    confidence: str
    reason: str
    median: float
    sigma: float
    stretches: tuple[Stretch, ...]
    #: (first label, last label, change, recovered)
    slumps: tuple[tuple[str, str, float, bool], ...]
    low_points: tuple[str, ...]
    damped: tuple[float, ...]


class _Show:
    """One series' episodes, in order, with what the rules ask of them."""

    def __init__(self, season: Sequence[int], number: Sequence[int], rating: Sequence[float], votes: Sequence[int], t: Thresholds):
        self.t = t
        self.votes = np.asarray(votes, np.float64)
        r = np.asarray(rating, np.float64)
        if not (np.isfinite(r).all() and np.isfinite(self.votes).all()):
            raise ValueError("a rating or a vote count is missing")
        mean = float((self.votes * r).sum() / self.votes.sum()) if self.votes.sum() else float(r.mean())
        self.x = (self.votes * r + t.damping * mean) / (self.votes + t.damping) if t.damping else r
        self.labels = [f"S{s}E{n}" for s, n in zip(season, number, strict=True)]
        seasons = np.asarray(season)
        premieres = (np.flatnonzero(seasons[1:] != seasons[:-1]) + 1).tolist()
        ends = stretch_ends(self.x, premieres=premieres, t=t)
        self.parts = tuple(Stretch(a, b, self.mean(a, b)) for a, b in zip([0, *ends[:-1]], ends, strict=True))
        self.sigma, self.median = sigma_of(self.x, t), float(np.median(self.x))

    def mean(self, a: int, b: int) -> float:
        return float(self.x[a:b].mean())

    def by_votes(self) -> str:
        typical = float(np.median(self.votes))
        return "high" if typical >= self.t.high_votes else "medium" if typical >= self.t.medium_votes else "low"

    def lasts(self, i: int, floor: float) -> int:
        """Episodes from part i on until a part falls below the floor."""
        end = next((p.start for p in self.parts[i:] if p.level < floor), len(self.x))
        return end - self.parts[i].start

    def span(self, a: int, b: int) -> str:
        return f"{self.labels[a]}–{self.labels[b - 1]}"

    def turn(self) -> tuple[str, str | None, str, str]:
        t, first = self.t, self.parts[0]
        if len(self.parts) == 1:
            return "steady", None, self.by_votes(), f"All {len(self.x)} episodes form one stretch averaging {first.level:.1f}."
        if first.level >= self.median - t.near_median or first.level > t.good_bar:
            return self.good_from_start()
        for i in range(1, len(self.parts)):
            part, before = self.parts[i], self.parts[i - 1].level
            jump = part.level - before
            if jump >= t.rise and part.level >= self.median - t.near_median and (n := self.lasts(i, before + t.rise)) >= t.turn_episodes:
                return self.gets_good(part.start, n, jump)
        reason = f"It opens at {first.level:.1f}, below the show's median of {self.median:.1f}, and never steps up {t.rise} or more to it."
        return "no_clear_turn", None, self.by_votes(), reason

    def good_from_start(self) -> tuple[str, str | None, str, str]:
        first = self.parts[0]
        reason = f"{self.span(0, first.end)} average {first.level:.1f}, against the show's median of {self.median:.1f}."
        top = first.level
        for i in range(1, len(self.parts)):
            part = self.parts[i]
            if (n := self.lasts(i, top + self.t.rise)) >= self.t.turn_episodes:
                after = self.mean(part.start, part.start + n)
                reason += f" From {self.labels[part.start]} the next {n} episodes average {after:.1f} ({after - top:+.1f})."
                return "good_from_start", self.labels[part.start], self.by_votes(), reason
            top = max(top, part.level)
        return "good_from_start", None, self.by_votes(), reason

    def gets_good(self, at: int, n: int, jump: float) -> tuple[str, str | None, str, str]:
        before, after = self.mean(0, at), self.mean(at, at + n)
        sure = jump >= 2 * self.sigma and float(np.median(self.votes[:at])) >= self.t.high_votes
        confidence = "high" if sure else "medium" if jump >= self.sigma else "low"
        reason = f"{self.span(0, at)} average {before:.1f}. From {self.labels[at]} the next {n} episodes average {after:.1f} ({after - before:+.1f})."
        return "gets_good", self.labels[at], confidence, reason

    def slumps(self) -> tuple[tuple[str, str, float, bool], ...]:
        """Later parts well below all before them; neighbours are one slump."""
        low = [i > 0 and p.level <= self.mean(0, p.start) - self.t.slump_drop for i, p in enumerate(self.parts)]
        out, i = [], 0
        while i < len(low):
            j = i
            while j < len(low) and low[j]:
                j += 1
            if j > i:
                a, b = self.parts[i].start, self.parts[j - 1].end
                before = self.mean(0, a)
                out.append((self.labels[a], self.labels[b - 1], self.mean(a, b) - before, any(p.level >= before - self.t.near_median for p in self.parts[j:])))
            i = max(j, i + 1)
        return tuple(out)

    def low_points(self) -> tuple[str, ...]:
        level = np.repeat([p.level for p in self.parts], [p.end - p.start for p in self.parts])
        return tuple(self.labels[i] for i in np.flatnonzero(self.x < level - self.t.low_sigmas * self.sigma))


def judge(season: Sequence[int], number: Sequence[int], rating: Sequence[float], votes: Sequence[int], t: Thresholds = DEFAULT) -> Verdict:
    """The verdict for one series, its episodes in order; at least one."""
    s = _Show(season, number, rating, votes, t)
    return Verdict(*s.turn(), s.median, s.sigma, s.parts, s.slumps(), s.low_points(), tuple(map(float, s.x)))


VERDICT_SCHEMA = (
    "series int, kind string, at string, confidence string, reason string, median double, sigma double, episodes int, "
    "stretches array<struct<first:string,last:string,episodes:int,level:double>>, "
    "slumps array<struct<first:string,last:string,delta:double,recovered:boolean>>, low_points array<string>, damped array<double>"
)


_ROW = ("series", "kind", "at", "confidence", "reason", "median", "sigma", "episodes", "stretches", "slumps", "low_points", "damped")
_LABELLED = pa.struct([("first", pa.string()), ("last", pa.string()), ("episodes", pa.int32()), ("level", pa.float64())])
_SLUMP = pa.struct([("first", pa.string()), ("last", pa.string()), ("delta", pa.float64()), ("recovered", pa.bool_())])
_ARROW = pa.schema(zip(_ROW, (pa.int32(), *[pa.string()] * 4, pa.float64(), pa.float64(), pa.int32(), pa.list_(_LABELLED), pa.list_(_SLUMP), pa.list_(pa.string()), pa.list_(pa.float64())), strict=True))


def _judged(series: int, season: list[int], number: list[int], x10: list[int], votes: list[int], t: Thresholds) -> tuple:
    s = _Show(season, number, [x / 10 for x in x10], votes, t)
    parts = [{"first": s.labels[p.start], "last": s.labels[p.end - 1], "episodes": p.end - p.start, "level": p.level} for p in s.parts]
    slumps = [dict(zip(("first", "last", "delta", "recovered"), x, strict=True)) for x in s.slumps()]
    return (series, *s.turn(), s.median, s.sigma, len(season), parts, slumps, s.low_points(), s.x)


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, list[list[int]]]]:
    """(series, its columns) of rows that stand together by series; a series may go over batches."""
    held: int | None = None
    columns: list[list[int]] = []
    for batch in batches:
        series, *rest = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if not len(series):
            continue
        starts = np.flatnonzero(np.r_[True, series[1:] != series[:-1]])
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(series)], strict=True):
            some = [c[a:b].tolist() for c in rest]
            if held == series[a]:
                columns = [x + y for x, y in zip(columns, some, strict=True)]
                continue
            if held is not None:
                yield held, columns
            held, columns = int(series[a]), some
    if held is not None:
        yield held, columns


def verdicts(episodes: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """episodes: series, season, number, tid, rating_x10, votes.  A row for each series, VERDICT_SCHEMA.

    Series are dealt out by key and sorted in the JVM; a task then judges run after run of rows, a thousand
    series to an Arrow batch, so that no frame is made for a series.  A series that can't be judged has a null kind and
    says why in reason.  The number of tasks is set, as the shuffle
    is small for what is done with it.
    """

    def judge_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for series, columns in _runs(batches):
            try:
                out.append(_judged(series, *columns, t))
            except (ValueError, ArithmeticError, IndexError, TypeError) as error:
                # One series that can't be judged is a row without a kind, not the end of the job.
                out.append((series, None, None, None, f"{type(error).__name__}: {error}", None, None, len(columns[0]), [], [], [], []))
            if len(out) == 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _ARROW, strict=True)], schema=_ARROW)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _ARROW, strict=True)], schema=_ARROW)

    tasks = int(episodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = episodes.repartition(tasks, "series").sortWithinPartitions("series", "season", "number", "tid")
    return dealt.select(*[F.col(c).cast("long") for c in ("series", "season", "number", "rating_x10", "votes")]).mapInArrow(judge_all, VERDICT_SCHEMA)
