"""Flags on one show that lie close together form an event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, KINDS, Thresholds

CHECKS = ("daily", "launch", "page")


def _place(c: Column, names: tuple[str, ...]) -> Column:
    return F.array_position(F.array(*[F.lit(n) for n in names]), c).cast("int")


def islands(flags: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """flags with `event`: numbered from 1 within a show; a new one when the flag before is over event_days back."""
    order = Window.partitionBy("show").orderBy("day", "tid", _place(F.col("check"), CHECKS))
    new = F.coalesce((F.date_diff("day", F.lag("day").over(order)) > t.event_days).cast("long"), F.lit(1).cast("long"))
    return flags.withColumn("new_event", new).withColumn("event", F.sum("new_event").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("new_event")


def events(flags: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """show, start, end, kind, titles, series_wide, extra_votes, flags.

    kind: the most serious present.  titles: in order of appearance.  extra_votes: daily surges add up; launch
    and page flags repeat one lead each day, so each title's largest counts once.
    """
    numbered = islands(flags, t)
    flag = F.struct("day", "tid", _place(F.col("check"), CHECKS).alias("check_no"), "kind", "check", "votes", "rating", "rating_change", "extra_votes", "z", "ratio", "new_votes_rating")
    titles = numbered.groupBy("show", "event", "tid").agg(
        F.min("day").alias("first"), F.max("day").alias("last"), F.min(_place(F.col("kind"), KINDS)).alias("kind_no"),
        F.sum(F.when(F.col("check") == "daily", F.col("extra_votes")).otherwise(0.0)).alias("daily"),
        F.max(F.when(F.col("check") != "daily", F.col("extra_votes"))).alias("lead"), F.collect_list(flag).alias("flags"),
    )
    found = titles.groupBy("show", "event").agg(
        F.min("first").alias("start"), F.max("last").alias("end"), F.min("kind_no").alias("kind_no"),
        F.transform(F.array_sort(F.collect_list(F.struct("first", "tid"))), lambda x: x["tid"]).alias("titles"),
        (F.max((F.col("tid") == F.col("show")).cast("int")) == 1).alias("page"), F.count_if(F.col("tid") != F.col("show")).alias("n_episodes"),
        (F.sum("daily") + F.coalesce(F.sum("lead"), F.lit(0.0))).alias("extra_votes"), F.array_sort(F.flatten(F.collect_list("flags"))).alias("flags"),
    )
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind_no"))
    return found.select("show", "start", "end", kind.alias("kind"), "titles", (F.col("page") | (F.col("n_episodes") >= t.wide_episodes)).alias("series_wide"), "extra_votes", "flags")


def ranked(found: DataFrame) -> DataFrame:
    """Bombs first, then boosts, then surges; the biggest first within each, then the earliest."""
    return found.orderBy(_place(F.col("kind"), KINDS), F.desc("extra_votes"), "start", "show")


def biggest(found: DataFrame, limit: int = 20, *, every_kind: bool = False) -> DataFrame:
    """The `limit` most serious events, newest first; bombs only unless every_kind."""
    chosen = found if every_kind else found.where(F.col("kind") == "bomb")
    return ranked(chosen).limit(limit).orderBy(F.desc("start"), F.desc("end"), F.desc("show"))
