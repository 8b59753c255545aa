"""Episode ratings pulled towards their show's mean, noise and the neighbours' medians; column expressions only.

Input: series, season, number, rating_x10, votes, a row for each episode.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Thresholds
from ..functions.columns import array_median, episode_label

ORDER = ("season", "number", "tid")
#: Of Gaussian noise, the median difference between neighbours times this is sigma.
JUMP_TO_SIGMA = 1 / (0.6745 * math.sqrt(2))


def show_mean(rating: Column, votes: Column, by: Window) -> Column:
    """Vote-weighted mean of a show's ratings; the plain mean if nobody voted."""
    total = F.sum(votes).over(by)
    return F.when(total > 0, F.sum(rating * votes).over(by) / total).otherwise(F.avg(rating).over(by))


def damped(episodes: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """episodes with `rating` and `damped`: damping votes' worth of the show's mean in each rating."""
    rating = F.col("rating_x10") / F.lit(10.0)
    rated = episodes.withColumn("rating", rating)
    if not t.damping:
        return rated.withColumn("damped", F.col("rating"))
    by = Window.partitionBy("series")
    # In tenths, so that the weighted sum is of whole numbers and the same in any order.
    mean = show_mean(F.col("rating_x10"), F.col("votes"), by) / 10
    return rated.withColumn("damped", (F.col("votes") * F.col("rating") + t.damping * mean) / (F.col("votes") + t.damping))


def noise(episodes: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """series, episodes, sigma, penalty: the episode-to-episode noise and what a break costs."""
    order = Window.partitionBy("series").orderBy(*ORDER)
    steps = damped(episodes, t).withColumn("jump", F.abs(F.col("damped") - F.lag("damped").over(order)))
    out = steps.groupBy("series").agg(F.count("*").alias("episodes"), F.median("jump").alias("jump"))
    sigma = F.greatest(F.lit(t.noise_floor), F.coalesce(F.col("jump") * JUMP_TO_SIGMA, F.lit(t.noise_floor)))
    out = out.select("series", "episodes", sigma.alias("sigma"))
    return out.withColumn("penalty", F.lit(t.penalty) * F.col("sigma") * F.col("sigma") * F.log(F.greatest("episodes", F.lit(2)).cast("double")))


def contested(episodes: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """series, season, number, episode, votes, rating, neighbour_votes, neighbour_rating, vote_ratio, rating_gap.

    Episodes with far more votes and a far lower rating than up to three on either side in their season.
    """
    season = Window.partitionBy("series", "season")
    order = season.orderBy("number", "tid")
    rated = episodes.withColumn("rating", F.col("rating_x10") / F.lit(10.0))

    def near(name: str) -> Column:
        return F.concat(F.collect_list(name).over(order.rowsBetween(-t.neighbours, -1)), F.collect_list(name).over(order.rowsBetween(1, t.neighbours)))

    rows = rated.select("*", near("votes").alias("near_votes"), near("rating").alias("near_ratings"), F.row_number().over(order).alias("at"), F.count("*").over(season).alias("n"))
    rows = rows.withColumns({"neighbour_votes": array_median(F.col("near_votes")), "neighbour_rating": array_median(F.col("near_ratings"))}).withColumn("rating_gap", F.col("rating") - F.col("neighbour_rating"))
    bar = F.when((F.col("at") == 1) | (F.col("at") == F.col("n")), F.lit(t.contested_edge)).otherwise(F.lit(t.contested_ratio))
    found = rows.where((F.col("votes") >= t.bomb_votes) & (F.size("near_votes") >= 2) & (F.col("neighbour_votes") >= t.sibling_votes) & (F.col("votes") >= bar * F.col("neighbour_votes")) & (F.col("rating_gap") <= F.lit(-t.contested_drop)))
    return found.select("series", "season", "number", episode_label(F.col("season"), F.col("number")).alias("episode"), "votes", "rating", "neighbour_votes", "neighbour_rating", (F.col("votes") / F.col("neighbour_votes")).alias("vote_ratio"), "rating_gap")
