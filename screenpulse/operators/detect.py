"""The three anomaly checks over a rating history.

history: tid, date, rating_x10 (tenths, so that differences are exact), votes.  episodes: tid, series, season,
episode.  days: date, every day the history holds.  Each check returns FLAG_COLUMNS.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Thresholds
from ..functions.columns import array_mad

FLAG_COLUMNS = ("tid", "show", "day", "kind", "check", "votes", "rating", "rating_change", "extra_votes", "z", "ratio", "new_votes_rating")
#: Listing order; of one title and day, checks stand in alphabetical order, which is daily, launch, page.
FLAG_ORDER = ("day", "show", "tid", "check")


def _typed(history: DataFrame) -> DataFrame:
    return history.select("tid", "date", F.col("rating_x10").cast("int").alias("rating_x10"), F.col("votes").cast("long").alias("votes"))


def _between(day: Column, since: date | None, until: date | None) -> Column:
    wanted = F.lit(True)
    if since is not None:
        wanted = wanted & (day >= F.lit(since))
    if until is not None:
        wanted = wanted & (day <= F.lit(until))
    return wanted


def _flags(df: DataFrame) -> DataFrame:
    missing = {c: F.lit(None).cast("double") for c in ("z", "ratio", "new_votes_rating") if c not in df.columns}
    return df.withColumns(missing).select(*FLAG_COLUMNS)


def _steps(history: DataFrame, t: Thresholds) -> DataFrame:
    """daily_steps with day_no.  All windows, the later baseline's too, share one exchange and one sort by title and day."""
    order = Window.partitionBy("tid").orderBy("day_no")
    around = order.rangeBetween(-t.launch_days, t.launch_days)
    steps = _typed(history).withColumn("day_no", F.unix_date("date")).select(
        "*",
        F.min("date").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("first_day"),
        F.min("votes").over(around).alias("low"), F.max("votes").over(around).alias("high"),
        F.lag("date").over(order).alias("prev_date"), F.lag("rating_x10").over(order).alias("prev_x10"), F.lag("votes").over(order).alias("prev_votes"),
    ).where("prev_date is not null")
    grown = F.col("votes") > F.col("prev_votes")
    more = F.when(grown, F.col("votes") - F.col("prev_votes"))
    gap = F.date_diff("date", "prev_date").cast("long")
    return steps.select(
        "tid", "day_no", "date", "rating_x10", "votes", "first_day",
        (F.col("high") >= F.lit(t.arrival_growth) * F.least("low", "prev_votes")).alias("arriving"),
        gap.alias("gap"),
        F.try_divide((F.col("votes") - F.col("prev_votes")).cast("double"), gap.cast("double")).alias("dv"),
        (F.col("rating_x10") - F.col("prev_x10")).alias("dr_x10"),
        ((F.col("rating_x10") * F.col("votes") - F.col("prev_x10") * F.col("prev_votes")) / more / F.lit(10)).alias("new_votes_rating"),
        (F.lit(0.05) * (F.col("votes") + F.col("prev_votes")) / more).alias("new_votes_error"),
        ((F.col("prev_x10") - F.col("rating_x10")) * F.col("votes") / more).alias("below_x10"),
    )


def daily_steps(history: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """Each title's change since its previous day."""
    return _steps(history, t).drop("day_no")


def _with_prior(steps: DataFrame, t: Thresholds) -> DataFrame:
    """steps with the changes before each (prior), their median (base) and how many they are (base_days).

    base is a window's own output, so what reads it many times doesn't work it out many times.
    """
    before = Window.partitionBy("tid").orderBy("day_no").rowsBetween(-t.baseline_days, -1)
    return steps.select("*", F.collect_list("dv").over(before).alias("prior"), F.percentile("dv", F.lit(0.5)).over(before).alias("base"), F.count("dv").over(before).alias("base_days"))


def _scored(based: DataFrame) -> DataFrame:
    """based with spread, z and extra; the median absolute deviation costs most, so filter first."""
    spread = based.withColumn("spread", array_mad(F.col("prior"), F.col("base"), F.col("base_days").cast("int")))
    above = F.col("dv") - F.col("base")
    return spread.withColumns({"z": above / (F.lit(1.4826) * F.col("spread") + 1), "extra": above * F.col("gap")}).drop("prior", "day_no")


def daily_scores(history: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """daily_steps with base, spread and base_days of the changes before each, z and extra."""
    return _scored(_with_prior(_steps(history, t), t))


def daily_flags(history: DataFrame, episodes: DataFrame, t: Thresholds = DEFAULT, *, since: date | None = None, until: date | None = None, first_days: DataFrame | None = None) -> DataFrame:
    """Days on which a title's new votes surged against its own pace.

    first_days: (tid, first_day), for a history that was cut before: the first day of each title in the whole of it.
    """
    based = _with_prior(_steps(history, t), t)
    if first_days is not None:
        known = first_days.select(F.col("tid").alias("k_tid"), F.col("first_day").alias("k_first"))
        based = based.join(known, based["tid"] == known["k_tid"], "left").withColumn("first_day", F.coalesce("k_first", "first_day"))
    likely = based.where(
        (F.col("votes") >= t.bomb_votes) & (F.col("base_days") >= t.least_baseline) & (F.date_diff("date", "first_day") >= t.launch_days)
        & (F.col("gap") <= t.gap_days) & ~F.col("arriving") & (F.col("dv") - F.col("base") >= F.lit(t.surge_z))
        & (F.col("dv") >= F.greatest(F.lit(float(t.surge_votes)), F.lit(t.surge_share) * F.col("votes"))) & _between(F.col("date"), since, until)
    )
    surged = _scored(likely).where(F.col("z") >= F.lit(t.surge_z))
    drop = F.col("dr_x10")
    kind = F.when((drop <= -t.shock_x10) & (F.col("below_x10") >= t.bomb_gap_x10), "bomb").when(drop >= t.shock_x10, "boost").otherwise("suspicious")
    shows = episodes.select(F.col("tid").alias("e_tid"), F.col("series").alias("e_series"))
    found = surged.join(shows, surged["tid"] == shows["e_tid"], "left")
    return _flags(found.select(
        "tid", F.coalesce("e_series", "tid").alias("show"), F.col("date").alias("day"), kind.alias("kind"), F.lit("daily").alias("check"), "votes",
        (F.col("rating_x10") / 10).alias("rating"), (drop / 10).alias("rating_change"), F.col("extra").alias("extra_votes"), "z",
        F.when(F.col("new_votes_error") <= F.lit(t.new_votes_error), F.col("new_votes_rating")).alias("new_votes_rating"),
    ))


def observed(first_seen: DataFrame, days: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """Titles that the history saw arrive: it holds a day shortly before their first.

    An equi semi-join on the day, against each held day moved on by 1 to gap_days.
    """
    before = days.select(F.explode(F.sequence(F.date_add("date", 1), F.date_add("date", t.gap_days))).alias("seen")).distinct()
    return first_seen.join(before, first_seen["first_day"] == before["seen"], "left_semi")


def launch_days(history: DataFrame, episodes: DataFrame, days: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """The first two weeks of observed episodes: tid, series, season, date, age, rating_x10, votes, finale."""
    rows = _typed(history)
    first = observed(rows.groupBy("tid").agg(F.min("date").alias("first_day")), days, t).withColumnRenamed("tid", "f_tid")
    listed = episodes.select(F.col("tid").alias("e_tid"), "series", "season", "episode", F.max("episode").over(Window.partitionBy("series", "season")).alias("last"))
    aged = rows.join(first, rows["tid"] == first["f_tid"]).withColumn("age", F.date_diff("date", "first_day")).where(F.col("age").between(1, t.launch_days - 1))
    return aged.join(listed, aged["tid"] == listed["e_tid"]).where("episode > 1").select("tid", "series", "season", "date", "age", "rating_x10", "votes", (F.col("episode") == F.col("last")).alias("finale"))


def with_siblings(aged: DataFrame) -> DataFrame:
    """aged with the medians of the season's other episodes at the same age; null for an only one.

    A group is one season at one age.  It is ranked once for each measure; a median without oneself can only be
    one of three places around the middle, whose values are told to the whole group.
    """
    group = Window.partitionBy("series", "season", "age")
    out = aged.withColumn("others", F.count("*").over(group) - 1)
    low = F.floor((F.col("others") + 1) / 2)  # of m others, places floor((m+1)/2) and floor(m/2)+1 are the middle
    for name in ("votes", "rating_x10"):
        out = out.withColumn("place", F.row_number().over(group.orderBy(name, "tid")))
        out = out.select("*", *[F.max(F.when(F.col("place") == low + k, F.col(name))).over(group).alias(f"middle_{k}") for k in range(3)])
        own_below = lambda k: F.col("place") <= low + k  # noqa: E731  # then that place among the others is one on
        first = F.when(own_below(0), F.col("middle_1")).otherwise(F.col("middle_0"))
        second = F.when(F.col("others") % 2 == 1, first).when(own_below(1), F.col("middle_2")).otherwise(F.col("middle_1"))
        short = "votes" if name == "votes" else "x10"
        out = out.withColumn(f"siblings_{short}", F.when(F.col("others") > 0, (first + second) / 2)).drop("place", "middle_0", "middle_1", "middle_2")
    return out.drop("others")


def launch_flags(history: DataFrame, episodes: DataFrame, days: DataFrame, t: Thresholds = DEFAULT, *, since: date | None = None, until: date | None = None) -> DataFrame:
    """Days of an episode's first two weeks with far more votes and a far lower rating than its siblings' at that age."""
    found = with_siblings(launch_days(history, episodes, days, t)).where(
        (F.col("votes") >= t.bomb_votes) & (F.col("siblings_votes") >= t.sibling_votes)
        & (F.col("votes") >= F.when(F.col("finale"), F.lit(t.finale_ratio)).otherwise(F.lit(t.launch_ratio)) * F.col("siblings_votes"))
        & (F.col("rating_x10") <= F.col("siblings_x10") - t.launch_drop_x10) & _between(F.col("date"), since, until)
    )
    return _flags(found.select(
        "tid", F.col("series").alias("show"), F.col("date").alias("day"), F.lit("bomb").alias("kind"), F.lit("launch").alias("check"), "votes",
        (F.col("rating_x10") / 10).alias("rating"), ((F.col("rating_x10") - F.col("siblings_x10")) / 10).alias("rating_change"),
        (F.col("votes") - F.col("siblings_votes")).alias("extra_votes"), (F.col("votes") / F.col("siblings_votes")).alias("ratio"),
    ))


def page_flags(history: DataFrame, episodes: DataFrame, days: DataFrame, t: Thresholds = DEFAULT, *, since: date | None = None, until: date | None = None, pages: DataFrame | None = None) -> DataFrame:
    """Days of a series page's first two weeks rated far below its own episodes, by a gap only a crowd explains.

    pages: (tid) the pages to judge, all if not given; their episodes are read whole either way.
    """
    rows = _typed(history)
    owners = episodes.select(F.col("series").alias("tid")).distinct()
    own = rows.join(owners, "tid", "left_semi")
    if pages is not None:
        own = own.join(pages.select("tid").distinct(), "tid", "left_semi")
    first = observed(own.groupBy("tid").agg(F.min("date").alias("first_day")), days, t).select(F.col("tid").alias("page"), "first_day")
    young = lambda df: df.where(F.date_diff("date", "first_day").between(1, t.launch_days - 1))
    page_days = young(rows.join(first, rows["tid"] == first["page"])).select("tid", "date", "rating_x10", "votes")
    listed = episodes.select(F.col("tid").alias("e_tid"), "series").join(first, F.col("series") == first["page"]).select("e_tid", "page", "first_day")
    of_episodes = young(rows.join(listed, rows["tid"] == listed["e_tid"])).groupBy("page", F.col("date").alias("e_date")).agg(
        F.try_divide(F.sum(F.col("rating_x10").cast("long") * F.col("votes")).cast("double"), F.sum("votes").cast("double")).alias("episodes_x10"), F.sum("votes").alias("episodes_votes")
    )
    both = page_days.join(of_episodes, (page_days["tid"] == of_episodes["page"]) & (page_days["date"] == of_episodes["e_date"]))
    gap = F.col("episodes_x10") - F.col("rating_x10")
    both = both.withColumn("excess", F.try_divide(F.col("votes") * gap, F.col("episodes_x10") - 10))
    found = both.where((F.col("votes") >= t.bomb_votes) & (F.col("episodes_votes") >= t.sibling_votes) & (F.col("rating_x10") <= F.col("episodes_x10") - t.page_drop_x10) & (F.col("excess") >= t.page_excess) & _between(F.col("date"), since, until))
    return _flags(found.select(
        "tid", F.col("tid").alias("show"), F.col("date").alias("day"), F.lit("bomb").alias("kind"), F.lit("page").alias("check"), "votes",
        (F.col("rating_x10") / 10).alias("rating"), (-gap / 10).alias("rating_change"), F.col("excess").alias("extra_votes"),
    ))


def find_flags(history: DataFrame, episodes: DataFrame, days: DataFrame, t: Thresholds = DEFAULT, *, since: date | None = None, until: date | None = None) -> DataFrame:
    """All three checks, in listing order: by day, show and title; daily, launch, page."""
    when = {"since": since, "until": until}
    found = daily_flags(history, episodes, t, **when).unionByName(launch_flags(history, episodes, days, t, **when)).unionByName(page_flags(history, episodes, days, t, **when))
    return found.orderBy(*FLAG_ORDER)


def bounded_history(history: DataFrame, first_days: DataFrame, t: Thresholds = DEFAULT, *, since: date, until: date) -> DataFrame:
    """The rows that the daily check needs to judge [since, until].

    That is a month of rows before and the arrival window after.  A title with holes may have too few rows in
    that month for its baseline: of such titles, older rows are read too.  first_days: (tid, first_day).
    """
    rows = t.baseline_days + 1
    reach = since - timedelta(days=rows + t.gap_days)
    recent = history.where(F.col("date").between(F.lit(reach), F.date_add(F.lit(until), t.launch_days)))
    old = first_days.where(F.col("first_day") < F.lit(reach)).select("tid")
    held = recent.where(F.col("date") < F.lit(since)).groupBy("tid").agg(F.count("*").alias("held")).where(F.col("held") >= rows)
    short = old.join(recent.select("tid").distinct(), "tid", "left_semi").join(held, "tid", "left_anti")
    return recent.unionByName(history.where(F.col("date") < F.lit(reach)).join(short, "tid", "left_semi"))


def sweep_flags(history: DataFrame, episodes: DataFrame, ratings: DataFrame, days: DataFrame, t: Thresholds = DEFAULT, *, since: date, until: date, first_days: DataFrame | None = None) -> DataFrame:
    """Flags of all shows between two days, in one pass.

    Semi-joins before the windows drop titles that never had the votes to be judged (votes only grow).  The daily
    check reads a bounded stretch of the history (bounded_history); the launch check needs the first two weeks of
    all episodes of a voted season, whenever those were.  first_days: (tid, first_day), worked out if not given.
    """
    voted = ratings.where(F.col("votes") >= t.bomb_votes).select("tid")
    near = history.where(F.col("date") <= F.date_add(F.lit(until), t.launch_days))
    when = {"since": since, "until": until}
    mine = near.join(voted, "tid", "left_semi")
    if first_days is None:
        first_days = mine.groupBy("tid").agg(F.min("date").alias("first_day"))
    daily = daily_flags(bounded_history(mine, first_days, t, **when), episodes, t, first_days=first_days, **when)
    seasons = episodes.join(episodes.join(voted, "tid", "left_semi").select(F.col("series").alias("s")).distinct(), F.col("series") == F.col("s"), "left_semi").select("tid")
    launch = launch_flags(near.join(seasons, "tid", "left_semi"), episodes, days, t, **when)
    return daily.unionByName(launch).unionByName(page_flags(near, episodes, days, t, pages=voted, **when))
