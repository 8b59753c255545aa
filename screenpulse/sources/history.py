"""The rating history: a row for each title and day, landed by day and folded into months.

Layout under a root: ``days/<day>`` (landing), ``months/<YYYY-MM>`` (sorted by series, tid, date, so that one show's rows
sit together and row groups prune), ``held/<YYYY-MM>`` (the days each month holds; the manifest).
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Thresholds
from ..operators.catalogue import title_id
from .tables import Store

SCHEMA = "tid int, series int, date date, rating_x10 smallint, votes int"
ORDER = ("series", "tid", "date")


def day_rows(ratings: DataFrame, series: DataFrame, episodes: DataFrame, day: date) -> DataFrame:
    """The in-scope rows of a ratings file (text columns) as one day; a series' page names itself as its series."""
    titles = series.select("tid", F.col("tid").alias("series")).unionByName(episodes.select("tid", "series"))
    rated = ratings.select(title_id(F.col("tconst")).alias("r_tid"), F.round(F.col("averageRating").cast("double") * 10).cast("smallint").alias("rating_x10"), F.col("numVotes").cast("int").alias("votes"))
    return titles.join(rated, titles["tid"] == rated["r_tid"]).select("tid", "series", F.lit(day).alias("date"), "rating_x10", "votes")


def write_day(root: Store, rows: DataFrame, day: date) -> int:
    """Land a day; returns its rows.  A day landed again replaces the one that waits."""
    root.publish(rows.sortWithinPartitions(*ORDER), f"days/{day.isoformat()}")
    return root.spark.read.schema(SCHEMA).parquet(root.at(f"days/{day.isoformat()}")).count()


def waiting(root: Store) -> list[date]:
    return [date.fromisoformat(n) for n in root.names("days")]


def known_days(root: Store) -> set[date]:
    """Every day in a month or waiting; reads the manifest only."""
    months = root.names("held")
    held = root.spark.read.schema("date date").parquet(*[root.at(f"held/{m}") for m in months]).collect() if months else []
    return {r["date"] for r in held} | set(waiting(root))


def fold(held: DataFrame | None, landed: DataFrame) -> DataFrame:
    """held rows and those landed on other days: the first copy of a day wins."""
    if held is None:
        return landed
    days = held.select(F.col("date").alias("held_date")).distinct()
    return held.unionByName(landed.join(days, landed["date"] == days["held_date"], "left_anti"))


def compact(root: Store) -> list[str]:
    """Fold waiting days into their months; returns the months rewritten.

    The manifest tells which days a month has; a month none of whose waiting days are new isn't read.  It is
    published before its manifest and landed days go last: a crash between leaves days that are folded again, and
    fold() finds them among the month's rows.
    """
    spark, rewritten = root.spark, []
    days = waiting(root)
    for month in sorted({d.isoformat()[:7] for d in days}):
        mine = [d for d in days if d.isoformat().startswith(month)]
        held = spark.read.schema(SCHEMA).parquet(root.at(f"months/{month}")) if root.exists(f"months/{month}") else None
        have = {r["date"] for r in spark.read.schema("date date").parquet(root.at(f"held/{month}")).collect()} if root.exists(f"held/{month}") else set()
        if new := [d for d in mine if d not in have]:
            landed = spark.read.schema(SCHEMA).parquet(*[root.at(f"days/{d.isoformat()}") for d in new])
            rows = fold(held, landed).repartitionByRange(F.col("series")).sortWithinPartitions(*ORDER)
            root.publish(rows, f"months/{month}")
            rewritten.append(month)
        root.publish(spark.createDataFrame([(d,) for d in sorted(have | set(mine))], "date date").coalesce(1), f"held/{month}")
        for d in mine:
            root.remove(f"days/{d.isoformat()}")
    return rewritten


def with_series(rows: DataFrame, episodes: DataFrame) -> DataFrame:
    """Rows of the old layout, without a series: that of the episode, or the title itself where it isn't known."""
    owner = episodes.select(F.col("tid").alias("e_tid"), F.col("series").alias("e_series"))
    return rows.join(owner, rows["tid"] == owner["e_tid"], "left").select("tid", F.coalesce("e_series", "tid").alias("series"), "date", "rating_x10", "votes")


def upgrade(root: Store, episodes: DataFrame) -> list[str]:
    """Name the series in folders written before rows named it; returns those rewritten."""
    changed = []
    for name in [f"months/{m}" for m in root.names("months")] + [f"days/{d}" for d in root.names("days")]:
        rows = root.spark.read.parquet(root.at(name))
        if "series" not in rows.columns:
            root.publish(with_series(rows, episodes).sortWithinPartitions(*ORDER), name)
            changed.append(name)
    return changed


def source(root: Store, since: date | None = None, until: date | None = None) -> DataFrame | None:
    """The whole history, or the months and days between two dates; None while it is empty."""
    inside = lambda name: (since is None or name >= since.isoformat()[: len(name)]) and (until is None or name <= until.isoformat()[: len(name)])
    every = [f"months/{m}" for m in root.names("months")] + [f"days/{d}" for d in root.names("days")]
    if not every:
        return None
    names = [n for n in every if inside(n.split("/")[1])]
    rows = root.spark.read.schema(SCHEMA).parquet(*map(root.at, names)) if names else root.spark.createDataFrame([], SCHEMA)
    if since is not None:
        rows = rows.where(F.col("date") >= F.lit(since))
    return rows if until is None else rows.where(F.col("date") <= F.lit(until))


def days_table(spark: SparkSession, days: set[date]) -> DataFrame:
    return spark.createDataFrame([(d,) for d in sorted(days)], "date date")


def gaps(days: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """before, after: neighbouring days more than gap_days apart.  days is a day a row: one window over it is small."""
    pairs = days.select(F.lag("date").over(Window.orderBy("date")).alias("before"), F.col("date").alias("after"))
    return pairs.where(F.date_diff("after", "before") > t.gap_days)


def span(days: DataFrame) -> DataFrame:
    return days.agg(F.count("*").alias("days"), F.min("date").alias("first"), F.max("date").alias("last"))


def days_between(spark: SparkSession, first: date, last: date) -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias("date")) if first <= last else spark.createDataFrame([], "date date")
