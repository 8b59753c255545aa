"""Thresholds of every operator, in one frozen object, so that small tables can be judged by smaller bars."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

#: Source files and their columns (fixed values of the file format).
SOURCE_COLUMNS = {
    "title.basics.tsv.gz": ("tconst", "titleType", "primaryTitle", "originalTitle", "isAdult", "startYear", "endYear", "runtimeMinutes", "genres"),
    "title.episode.tsv.gz": ("tconst", "parentTconst", "seasonNumber", "episodeNumber"),
    "title.ratings.tsv.gz": ("tconst", "averageRating", "numVotes"),
}
BASICS, EPISODES, RATINGS = SOURCE_COLUMNS
SERIES_KINDS = ("tvSeries", "tvMiniSeries")
EXCLUDED_GENRES = ("Talk-Show", "News", "Reality-TV", "Game-Show")
HISTORY_START = date(2022, 2, 22)
KINDS = ("bomb", "boost", "suspicious")


@dataclass(frozen=True)
class Thresholds:
    # scope and data quality
    rated_episodes: int = 6
    row_tolerance: float = 0.02
    tolerance_days: int = 30
    unparsed_share: float = 0.001
    least_votes: int = 5
    stale_days: int = 3
    scope_tolerance: float = 0.03
    lost_votes_tolerance: float = 0.01
    # history
    gap_days: int = 3
    settle_days: int = 7
    # verdicts
    damping: float = 10.0
    least_stretch: int = 3
    penalty: float = 3.0
    premiere_discount: float = 0.5
    noise_floor: float = 0.05
    good_bar: float = 8.1
    rise: float = 0.3
    turn_episodes: int = 6
    near_median: float = 0.1
    slump_drop: float = 0.4
    low_sigmas: float = 3.0
    high_votes: int = 100
    medium_votes: int = 20
    # anomaly checks
    bomb_votes: int = 500
    surge_z: float = 8.0
    surge_votes: int = 50
    surge_share: float = 0.02
    baseline_days: int = 28
    least_baseline: int = 7
    launch_days: int = 14
    arrival_growth: float = 5.0
    shock_x10: int = 2
    bomb_gap_x10: int = 20
    new_votes_error: float = 1.0
    launch_ratio: float = 2.0
    finale_ratio: float = 3.0
    launch_drop_x10: int = 5
    page_drop_x10: int = 5
    page_excess: int = 10_000
    # events
    event_days: int = 2
    recent_days: int = 30
    wide_episodes: int = 3
    named_titles: int = 4
    # contested episodes
    neighbours: int = 3
    contested_ratio: float = 2.0
    contested_edge: float = 3.0
    contested_drop: float = 0.5
    sibling_votes: int = 200
    # search
    similarity: float = 0.88
    similar_within: float = 0.03
    ask_ratio: float = 0.05
    choices: int = 5
    matches: int = 20


DEFAULT = Thresholds()
