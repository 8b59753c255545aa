import pytest
from made import day, frames, pace, season, surge
from screenpulse.operators import detect, events


def found(spark, rows, episodes=(), **options):
    df = detect.find_flags(*frames(spark, rows, episodes), **options)
    return sorted((r.asDict() for r in df.collect()), key=lambda r: (r["day"], r["tid"], r["check"]))


def quiet(**change):
    return pace(1, range(61), **({"votes": 1000, "per_day": 10, "x10": 85} | change))


def test_a_surge_of_low_votes_is_a_bomb(spark):
    [f] = found(spark, surge(quiet(), 40, 600, 75))
    assert (f["day"], f["kind"], f["check"], f["show"]) == (day(40), "bomb", "daily", 1)
    assert f["extra_votes"] == pytest.approx(600) and f["z"] == pytest.approx(600) and f["rating_change"] == pytest.approx(-1.0)
    assert f["new_votes_rating"] == pytest.approx(5.22, abs=0.01)


@pytest.mark.parametrize(("before", "after", "kind"), [(85, 83, "suspicious"), (70, 75, "boost"), (70, 72, "boost"), (85, 84, "suspicious")])
def test_kinds(spark, before, after, kind):
    assert [f["kind"] for f in found(spark, surge(quiet(x10=before), 40, 600, after))] == [kind]


def test_bars(spark):
    assert [f["kind"] for f in found(spark, surge(quiet(votes=100_000), 40, 3000, 83))] == ["bomb"]
    assert found(spark, surge(quiet(), 10, 600, 75)) == [] and len(found(spark, surge(quiet(), 20, 600, 75))) == 1
    assert found(spark, surge(quiet(votes=200, per_day=1), 40, 100, 60)) == []
    assert len(found(spark, surge(quiet(votes=400, per_day=1), 40, 200, 60))) == 1
    assert found(spark, surge(quiet(votes=100_000), 40, 1000, 83)) == []
    assert found(spark, surge(quiet(), 40, 9000, 75)) == []


def test_missing_days(spark):
    lost = lambda n: [r for r in surge(quiet(), 40, 600, 75) if not day(40 - n) <= r[1] < day(40)]
    [f] = found(spark, lost(2))
    assert f["extra_votes"] == pytest.approx(600)
    assert found(spark, lost(4)) == []


TIDS = [11, 12, 13, 14, 15, 16]


def listed(n=6):
    return [(t, 1, 1, k) for k, t in enumerate(TIDS[:n], 1)]


def test_launch_bomb(spark):
    flags = found(spark, season(1, TIDS, 13), listed())
    assert [f["day"] for f in flags] == [day(n) for n in range(25, 38)]
    assert {(f["tid"], f["kind"], f["check"], f["show"]) for f in flags} == {(13, "bomb", "launch", 1)}
    first = flags[0]
    assert (first["votes"], first["extra_votes"]) == (5000, 3500)
    assert first["ratio"] == pytest.approx(5000 / 1500) and first["rating_change"] == pytest.approx(-2.05)


def test_launch_leaves_premieres_finales_and_unseen_arrivals(spark):
    assert found(spark, season(1, TIDS, 11), listed()) == []
    rows = season(1, TIDS[:5], 15)
    assert len(found(spark, rows, listed(5))) == 13
    gentler = [(t, d, r, v if t != 15 else 1000 + (v - 3000) // 2 + 500) for t, d, r, v in rows]
    assert found(spark, gentler, listed(5)) == []
    late = [r for r in season(1, TIDS, 13) if r[1] >= day(24)]
    assert [f for f in found(spark, late, listed()) if f["tid"] == 13] == []


def test_page_bomb(spark):
    rows = pace(999, range(31), 5000, 10, 80) + pace(1, range(10, 31), 20_000, 5000, 50)
    for k, x10 in enumerate((75, 74, 76), 1):
        rows += pace(100 + k, range(10, 31), 4000 // k, 800 // k, x10)
    episodes = [(100 + k, 1, 1, k) for k in (1, 2, 3)]
    flags = found(spark, rows, episodes)
    assert [f["day"] for f in flags] == [day(n) for n in range(12, 24)]
    assert {f["check"] for f in flags} == {"page"} and flags[0]["votes"] == 30_000
    assert flags[0]["extra_votes"] == pytest.approx(30_000 * 2.5 / 6.5, rel=0.03)
    assert found(spark, [(t, d, 72 if t == 1 else r, v) for t, d, r, v in rows], episodes) == []


def test_since_and_until(spark):
    rows = season(1, TIDS, 13)
    assert [f["day"] for f in found(spark, rows, listed(), since=day(30), until=day(31))] == [day(30), day(31)]


def test_the_sweep_is_the_checks(spark):
    rows = season(1, TIDS, 13) + surge(pace(2, range(61), 1000, 10, 85), 40, 600, 75) + pace(3, range(61), 5, 1, 60)
    history, episodes, days = frames(spark, rows, listed())
    ratings = spark.createDataFrame([(t, max(r[3] for r in rows if r[0] == t)) for t in {r[0] for r in rows}], "tid int, votes long")
    key = lambda df: sorted((r["day"], r["tid"], r["check"]) for r in df.collect())
    assert key(detect.sweep_flags(history, episodes, ratings, days, since=day(20), until=day(60))) == key(detect.find_flags(history, episodes, days, since=day(20), until=day(60)))


def test_listing_order(spark):
    rows = season(1, TIDS, 13) + surge(pace(2, range(61), 1000, 10, 85), 30, 600, 75) + surge(pace(3, range(61), 1000, 10, 85), 30, 600, 75)
    got = [(r["day"], r["show"], r["tid"], r["check"]) for r in detect.find_flags(*frames(spark, rows, listed())).collect()]
    assert got == sorted(got) and len({r[0] for r in got}) > 10 and [r[1] for r in got if r[0] == day(30)] == [1, 2, 3]


def test_a_bounded_read_judges_as_the_whole_history(spark):
    """Titles seen daily, every second day, rarely, and only lately; whatever day the sweep starts on."""
    rows = surge(pace(1, range(130), 1000, 10, 85), 100, 600, 75) + surge(pace(2, range(0, 130, 2), 1000, 10, 85), 100, 900, 75)
    rows += surge(pace(3, range(0, 130, 3), 1000, 10, 85), 102, 900, 75) + surge(pace(4, range(80, 130), 1000, 10, 85), 100, 600, 75) + surge(pace(5, [*range(40), *range(96, 130)], 1000, 10, 85), 100, 600, 75)
    history, episodes, days = frames(spark, rows, [(99, 98, 1, 1)])
    ratings = spark.createDataFrame([(t, 9999) for t in range(1, 6)], "tid int, votes long")
    key = lambda df: sorted((r["day"], r["tid"], r["z"], r["extra_votes"]) for r in df.collect())
    whole = key(detect.find_flags(history, episodes, days))
    assert {t for _, t, _, _ in whole} == {1, 2, 3, 4, 5}
    for since in (90, 99, 101):
        got = key(detect.sweep_flags(history, episodes, ratings, days, since=day(since), until=day(129)))
        assert got == [f for f in whole if f[0] >= day(since)]
    first = history.groupBy("tid").agg({"date": "min"}).toDF("tid", "first_day")
    kept = detect.bounded_history(history, first, since=day(99), until=day(110)).groupBy("tid").count()
    assert {r["tid"]: r["count"] for r in kept.collect()}[1] < 60


def flag(tid, n, show=1, kind="bomb", check="daily", extra=100.0):
    return (tid, show, day(n), kind, check, 1000, 8.0, -0.5, extra, None, None, None)


def grouped(spark, flags):
    schema = "tid int, show int, day date, kind string, check string, votes long, rating double, rating_change double, extra_votes double, z double, ratio double, new_votes_rating double"
    return events.events(spark.createDataFrame(flags, schema))


def test_events(spark):
    rows = grouped(spark, [flag(101, 10), flag(102, 12), flag(101, 15), flag(201, 11, show=2, kind="boost")]).orderBy("start", "show").collect()
    assert [(r["show"], r["start"], r["end"], r["titles"], r["kind"]) for r in rows] == [(1, day(10), day(12), [101, 102], "bomb"), (2, day(11), day(11), [201], "boost"), (1, day(15), day(15), [101], "bomb")]
    [r] = grouped(spark, [flag(1, 10, kind="suspicious"), flag(5, 11, check="launch", extra=300.0), flag(5, 12, check="launch", extra=200.0), flag(6, 12, kind="boost")]).collect()
    assert (r["kind"], r["series_wide"], r["extra_votes"], r["titles"]) == ("bomb", True, 500.0, [1, 5, 6])
    [r] = grouped(spark, [flag(t, 10) for t in (5, 6, 7)]).collect()
    assert r["series_wide"]
    [r] = grouped(spark, [flag(t, 10) for t in (5, 6)]).collect()
    assert not r["series_wide"]
    mixed = grouped(spark, [flag(1, 1, show=1, kind="suspicious", extra=9e9), flag(2, 5, show=2, extra=50.0), flag(3, 9, show=3, extra=70.0), flag(4, 9, show=4, kind="boost")])
    assert [r["show"] for r in events.ranked(mixed).collect()] == [3, 2, 4, 1]
    assert [r["show"] for r in events.biggest(mixed, 2).collect()] == [3, 2]
    assert [r["show"] for r in events.biggest(mixed, 3, every_kind=True).collect()] == [4, 3, 2]
