"""Find a series by the name someone types, or by its id.

series: tid, title, start_year, end_year, search_key.  ratings: tid, votes.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Thresholds
from ..functions.columns import search_key
from ..functions.similarity import jaro_winkler_to

TITLE_ID = re.compile(r"(?:tt)?(\d{5,9})")


def with_votes(series: DataFrame, ratings: DataFrame) -> DataFrame:
    votes = ratings.select(F.col("tid").alias("r_tid"), F.col("votes").alias("r_votes"))
    return series.join(votes, series["tid"] == votes["r_tid"], "left").select("tid", "title", "start_year", "end_year", "search_key", F.coalesce("r_votes", F.lit(0)).alias("votes"))


def typed_key(series: DataFrame, name: str) -> str:
    """The key of what was typed, by the same expression as the titles'."""
    return series.sparkSession.range(1).select(search_key(F.lit(name)).alias("k")).first()["k"]


def tiers(key: Column, typed: str) -> Column:
    """4 the whole title, 3 its start, 2 whole words in it, 1 any part; null if none.  Spaces don't count for 4 and 3."""
    bare, want = F.replace(key, F.lit(" "), F.lit("")), typed.replace(" ", "")
    padded = F.concat(F.lit(" "), key, F.lit(" "))
    return F.when(bare == want, 4.0).when(bare.startswith(want), 3.0).when(F.contains(padded, F.lit(f" {typed} ")), 2.0).when(F.contains(key, F.lit(typed)), 1.0)


def scored(series: DataFrame, ratings: DataFrame, name: str, t: Thresholds = DEFAULT) -> DataFrame:
    """Every match with its score; near misses by Jaro-Winkler, only computed where no tier matches.

    A similarity of s needs lengths at least about 3*(s-0.4)/0.6-2 to 1: titles of other lengths are left out before the UDF.
    """
    found, typed = with_votes(series, ratings), typed_key(series, name)
    if not typed:
        return found.limit(0).withColumn("score", F.lit(0.0))
    tier = found.withColumn("tier", tiers(F.col("search_key"), typed))
    exact = tier.where("tier is not null").withColumn("score", F.col("tier"))
    # jaro <= (2 + shorter/longer)/3, and a common prefix of four adds 0.4*(1-jaro) at most
    need = max(0.0, 3 * (t.similarity - 0.4) / 0.6 - 2)
    n, m = F.length("search_key"), len(typed)
    close = tier.where(F.col("tier").isNull() & (F.least(n, F.lit(m)) >= F.lit(need - 1e-9) * F.greatest(n, F.lit(m))))
    near = close.withColumn("score", jaro_winkler_to(F.col("search_key"), typed)).where(F.col("score") >= t.similarity)
    return exact.unionByName(near).drop("tier")


def matches(series: DataFrame, ratings: DataFrame, name: str, *, year: int | None = None, t: Thresholds = DEFAULT) -> DataFrame:
    """The best matches in order (score, votes, tid); the year is looked for among the first `matches` of them."""
    text = name.strip()
    if got := TITLE_ID.fullmatch(text):
        top = with_votes(series, ratings).where(F.col("tid") == int(got[1])).withColumn("score", F.lit(4.0))
    else:
        top = scored(series, ratings, text, t).orderBy(F.desc("score"), F.desc("votes"), "tid").limit(t.matches)
    return top if year is None else top.where(F.col("start_year") == year)


def choices(top: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """matches() with `rank`, and `is_choice`: as good as the best and not one that hardly anyone watches, five at most.

    top is at most `matches` rows, so one window over all of them is bounded.
    """
    order = Window.orderBy(F.desc("score"), F.desc("votes"), "tid")
    best = lambda c: F.first(c).over(order)
    close = F.when(best("score") >= 1, F.floor("score") == F.floor(best("score"))).otherwise(F.col("score") >= best("score") - F.lit(t.similar_within))
    close = close & (F.col("votes") >= F.lit(t.ask_ratio) * best("votes"))
    out = top.withColumns({"rank": F.row_number().over(order), "close": close})
    return out.withColumn("is_choice", F.col("close") & (F.sum(F.col("close").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) <= t.choices)).drop("close", "search_key")
