"""Change points, verdicts, contested episodes, search and similarity."""

from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from screenpulse.functions.similarity import jaro_winkler
from screenpulse.operators import changepoints, damping, scoring, search, verdicts

x10s = st.lists(st.integers(10, 100).map(lambda v: v / 10), min_size=6, max_size=12)


@given(st.lists(st.integers(10, 100).map(lambda v: v / 10), min_size=6, max_size=40), st.floats(0.01, 5))
@settings(max_examples=100, deadline=None)
def test_lists_and_arrays_agree(x, price):
    by_list, short = changepoints.stretch_ends(x, price, [10]), changepoints.SHORT
    try:
        changepoints.SHORT = 0
        assert changepoints.stretch_ends(x, price, [10]) == by_list
    finally:
        changepoints.SHORT = short


@given(x10s, st.floats(0.01, 5), st.sets(st.integers(0, 12)))
@settings(max_examples=200, deadline=None)
def test_no_split_is_cheaper(x, price, premieres):
    n = len(x)
    ends = changepoints.stretch_ends(x, price, sorted(premieres))
    assert ends[-1] == n and min(np.diff([0, *ends])) >= 3
    best = min(changepoints.split_price(x, [*cut, n], price, sorted(premieres)) for k in range(n // 3) for cut in combinations(range(3, n - 2), k) if min(np.diff([0, *cut, n])) >= 3)
    assert changepoints.split_price(x, ends, price, sorted(premieres)) == pytest.approx(best, abs=1e-9)


def test_short_series_and_noise():
    assert changepoints.stretch_ends([]) == [] and changepoints.stretch_ends([8.0] * 5) == [5]
    rng = np.random.default_rng(0)
    split = sum(len(changepoints.stretch_ends(rng.normal(8, 0.3, 60))) > 1 for _ in range(200))
    assert split <= 20


def show(*runs, per_season=10, votes=10_000, ripple=0.2):
    levels = [level for n, level in runs for _ in range(n)]
    return ([i // per_season + 1 for i in range(len(levels))], [i % per_season + 1 for i in range(len(levels))], [v + (ripple if i % 2 else -ripple) for i, v in enumerate(levels)], [votes] * len(levels))


def test_verdicts():
    v = verdicts.judge(*show((6, 7.0), (20, 8.0), per_season=6))
    assert (v.kind, v.at, v.confidence) == ("gets_good", "S2E1", "high")
    assert v.reason == "S1E1–S1E6 average 7.0. From S2E1 the next 20 episodes average 8.0 (+1.0)."
    assert verdicts.judge(*show((30, 8.0))).kind == "steady"
    assert verdicts.judge(*show((20, 8.5), (10, 7.0))).kind == "good_from_start"
    assert verdicts.judge(*show((10, 7.0), (10, 6.0), (10, 7.1))).slumps[0][3]
    assert verdicts.judge(*show((1, 8.0))).kind == "steady"
    better = verdicts.judge(*show((10, 8.2), (10, 8.9)))
    assert (better.kind, better.at) == ("good_from_start", "S2E1")
    s, n, r, votes = show((30, 8.0))
    r[12] = 5.0
    assert verdicts.judge(s, n, r, votes).low_points == ("S2E3",)


def test_verdicts_by_series(spark):
    rows = []
    for series, runs in ((1, [(6, 7.0), (20, 8.0)]), (2, [(12, 8.0)])):
        s, n, r, v = show(*runs, per_season=6)
        rows += [(series, a, b, 100 * series + i, round(x * 10), c) for i, (a, b, x, c) in enumerate(zip(s, n, r, v, strict=True))]
    df = spark.createDataFrame(rows[::-1], "series int, season int, number int, tid int, rating_x10 int, votes long")
    got = {r["series"]: r for r in verdicts.verdicts(df).collect()}
    assert (got[1]["kind"], got[1]["at"], got[2]["kind"], got[1]["episodes"]) == ("gets_good", "S2E1", "steady", 26)
    want = damping.damped(df).where("series = 1").orderBy("season", "number").collect()
    assert [r["damped"] for r in want] == pytest.approx(got[1]["damped"])
    sigma = {r["series"]: r["sigma"] for r in damping.noise(df).collect()}
    assert sigma[1] == pytest.approx(got[1]["sigma"])


def test_a_series_that_cannot_be_judged_is_told(spark):
    rows = [(1, 1, k, k, 80, 100) for k in range(1, 7)] + [(2, 1, k, 10 + k, None, 100) for k in range(1, 7)]
    df = spark.createDataFrame(rows, "series int, season int, number int, tid int, rating_x10 int, votes long")
    got = {r["series"]: r for r in verdicts.verdicts(df).collect()}
    assert got[1]["kind"] == "steady" and got[2]["kind"] is None and "Error" in got[2]["reason"]


def contested(spark, **change):
    rows = {k: (80, 1000) for k in range(1, 10)} | {int(k[1:]): v for k, v in change.items()}
    df = spark.createDataFrame([(1, 1, k, k, r, v) for k, (r, v) in rows.items()], "series int, season int, number int, tid int, rating_x10 int, votes long")
    return [r["episode"] for r in damping.contested(df).orderBy("number").collect()]


def test_contested(spark):
    assert contested(spark, e5=(70, 2500)) == ["S1E5"]
    assert contested(spark, e5=(76, 2500)) == [] and contested(spark, e5=(70, 1900)) == []
    assert contested(spark, e9=(70, 2500)) == [] and contested(spark, e9=(70, 3000)) == ["S1E9"]
    assert contested(spark, **{f"e{k}": (80, 100) for k in range(1, 10) if k != 5}, e5=(70, 2500)) == []


CATALOGUE = [(1, "Agents of S.H.I.E.L.D.", 2013, 2020, 9000), (2, "The Office", 2005, 2013, 60_000), (3, "The Office", 2001, 2003, 20_000), (4, "Office Ladies", 2020, None, 10), (5, "Łódź & Café", 2011, 2011, 7), (6, "Breaking Bad", 2008, 2013, 90_000), (7, "The Office", None, None, 100)]


@pytest.fixture(scope="module")
def catalogue(spark):
    from pyspark.sql import functions as F
    from screenpulse.functions.columns import search_key

    df = spark.createDataFrame(CATALOGUE, "tid int, title string, start_year smallint, end_year smallint, votes int")
    return df.select("tid", "title", "start_year", "end_year", search_key(F.col("title")).alias("search_key")), df.select("tid", "votes")


@pytest.mark.parametrize(("name", "want"), [("agents of shield", 1), ("the office", 2), ("OFFICE", 4), ("lodz and cafe", 5), ("braking bad", 6), ("tt0000006", 6), ("00005", 5)])
def test_search(catalogue, name, want):
    assert search.matches(*catalogue, name).first()["tid"] == want


def test_search_choices(catalogue):
    rows = search.choices(search.matches(*catalogue, "the office")).orderBy("rank").collect()
    assert [r["tid"] for r in rows if r["is_choice"]] == [2, 3]
    assert [r["tid"] for r in search.matches(*catalogue, "the office", year=2001).collect()] == [3]
    assert search.matches(*catalogue, "xyzzy").count() == 0 and search.matches(*catalogue, "!?").count() == 0


def test_jaro_winkler():
    assert jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert jaro_winkler("dixon", "dicksonx") == pytest.approx(0.8133, abs=1e-4)
    assert jaro_winkler("", "a") == 0.0 and jaro_winkler("a", "a") == 1.0 and jaro_winkler("ab", "cd") == 0.0


def test_label_scores(spark):
    rows = [(1, a, b, i, round(x * 10), c) for i, (a, b, x, c) in enumerate(zip(*show((6, 7.0), (20, 8.0), per_season=6), strict=True))]
    rated = spark.createDataFrame(rows, "series int, season int, number int, tid int, rating_x10 int, votes long")
    labels = [(0, 1, "S2E3", None, None, None), (1, 1, "S3E1", True, None, None), (2, 1, None, None, "S3E1", "S1E1"), (3, 9, "S1E1", None, None, None), (4, 1, "S9E9", None, None, None)]
    labels = spark.createDataFrame(labels, "label int, show int, gets_good_at string, good_from_start boolean, slump_from string, low_point string")
    got = {r["label"]: r for r in scoring.turning_points(verdicts.verdicts(rated), rated, labels).collect()}
    assert got[0]["wrong"] == [] and got[0]["said"] == "gets good at S2E1" and got[3]["said"] is None
    assert got[1]["wrong"] == ["expected gets good at S3E1, got gets good at S2E1", "expected good from the start, got gets good at S2E1"]
    assert got[2]["wrong"] == ["expected a slump from S3E1, got slumps: none", "expected a low point at S1E1, got low points: none"]
    assert got[4]["wrong"] == ["expected gets good at S9E9, got gets good at S2E1"]


def test_known_bombs_touch_their_titles(spark):
    from datetime import date

    days = lambda n: date(2024, 1, n)
    found = spark.createDataFrame([(1, days(5), days(6), "bomb", [12]), (1, days(20), days(21), "bomb", [1]), (1, days(1), days(30), "boost", [11])], "show int, start date, end date, kind string, titles array<int>")
    episodes = spark.createDataFrame([(11, 1, 1, 1), (12, 1, 11, 2)], "tid int, series int, season int, episode int")
    known = [(0, ["S11E2"], 6, 9), (1, ["S1"], 1, 30), (2, ["S11"], 1, 30), (3, ["series"], 1, 30), (4, ["series"], 1, 9), (5, ["S11E2", "series"], 1, 30)]
    known = spark.createDataFrame([(n, 1, t, days(a), days(b)) for n, t, a, b in known], "label int, show int, titles array<string>, since date, until date")
    got = {r["label"]: (r["start"] and r["start"].day, r["events"]) for r in scoring.found_bombs(found, episodes, known).collect()}
    assert got == {0: (5, 1), 1: (None, 0), 2: (5, 1), 3: (20, 1), 4: (None, 0), 5: (5, 2)}
    held = spark.createDataFrame([(days(n),) for n in (3, 6, 28)], "date date")
    assert {r["label"] for r in scoring.covered(known, held).collect()} == {0}
