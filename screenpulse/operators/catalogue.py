"""The catalogue in scope: series with enough rated episodes, their episodes and the ratings of both.

Input: the source files as text columns.  Output tables are sorted within their partitions as they are stored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, EXCLUDED_GENRES, SERIES_KINDS, Thresholds
from ..functions.columns import search_key, tolerant_int


def title_id(tconst: Column) -> Column:
    """The number in an id; anything else stops the query."""
    return F.substring(tconst, 3, 20).cast("int")


def all_series(basics: DataFrame) -> DataFrame:
    return basics.where(F.col("titleType").isin(*SERIES_KINDS)).select(
        title_id(F.col("tconst")).alias("tid"), F.col("primaryTitle").alias("title"), F.col("titleType").alias("kind"),
        tolerant_int(F.col("startYear"), "smallint").alias("start_year"), tolerant_int(F.col("endYear"), "smallint").alias("end_year"), "genres",
    )


def all_episodes(episode: DataFrame) -> DataFrame:
    return episode.select(
        title_id(F.col("tconst")).alias("tid"), title_id(F.col("parentTconst")).alias("series"),
        tolerant_int(F.col("seasonNumber"), "smallint").alias("season"), tolerant_int(F.col("episodeNumber")).alias("episode"),
    )


def all_ratings(ratings: DataFrame) -> DataFrame:
    return ratings.select(title_id(F.col("tconst")).alias("tid"), F.round(F.col("averageRating").cast("double") * 10).cast("smallint").alias("rating_x10"), F.col("numVotes").cast("int").alias("votes"))


def scope(series: DataFrame, episodes: DataFrame, ratings: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """tid of the series with at least rated_episodes numbered, rated episodes and no excluded genre."""
    excluded = F.array(*[F.lit(g) for g in EXCLUDED_GENRES])
    wanted = series.where(~F.arrays_overlap(F.split(F.coalesce("genres", F.lit("")), ","), excluded)).select("tid")
    numbered = episodes.where("season >= 1 and episode >= 1")
    rated = numbered.join(ratings.select("tid"), "tid").groupBy(F.col("series").alias("tid")).agg(F.count("*").alias("n")).where(F.col("n") >= t.rated_episodes)
    return rated.join(wanted, "tid").select("tid")


def catalogue(basics: DataFrame, episode: DataFrame, ratings: DataFrame, t: Thresholds = DEFAULT) -> dict[str, DataFrame]:
    """series, episodes and ratings in scope."""
    s, e, r = all_series(basics), all_episodes(episode), all_ratings(ratings)
    within = scope(s, e, r, t)
    series = s.join(within, "tid", "left_semi").withColumn("search_key", search_key(F.col("title")))
    episodes = e.where("season >= 1 and episode >= 1").join(within.withColumnRenamed("tid", "series"), "series", "left_semi").select("tid", "series", "season", "episode")
    known = series.select("tid").unionByName(episodes.select("tid")).distinct()
    return {"series": series.sortWithinPartitions("tid"), "episodes": episodes.sortWithinPartitions("series", "season", "episode", "tid"), "ratings": r.join(known, "tid", "left_semi").sortWithinPartitions("tid")}
