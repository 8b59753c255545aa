"""The derivations and queries over whole tables leave no row out."""

import duckdb
from screenpulse.plans import fixtures as fx
from screenpulse.plans import oracle

TENTH = "/root/testdata/sf0.1"


def asked(sql):
    con = duckdb.connect()
    for t in ("events", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{TENTH}/{t}.parquet'")
    return con.execute(sql).fetchall()


def test_every_user_has_a_place_in_a_season():
    users = asked("SELECT count(DISTINCT user_id), count(DISTINCT CAST(floor(user_id / 10.0) AS INT)) FROM events")[0]
    assert users[0] == 1500
    assert asked("WITH " + fx.duck(fx.SEASONS) + "SELECT count(DISTINCT tid), count(DISTINCT tid) FILTER (WHERE tid < 10000000) FROM hist") == [(sum(users), users[0])]


def test_history_reads_all_orders():
    assert asked("SELECT count(DISTINCT o_custkey) FROM orders")[0][0] == asked(oracle.SQL["history_span"])[0][0]


def test_gaps_of_a_small_history(spark):
    days = spark.sql("SELECT explode(array(DATE '2024-01-01', DATE '2024-01-04', DATE '2024-01-08')) AS date")
    assert [tuple(map(str, r)) for r in oracle.store.gaps(days).collect()] == [("2024-01-04", "2024-01-08")]


def test_every_event_has_a_rank(spark):
    got = sorted(r["rank"] for r in oracle.QUERIES["event_ranking"](spark, TENTH).collect())
    assert got == list(range(1, len(got) + 1)) and len(got) == asked("SELECT count(*) FROM (" + oracle.SQL["event_groups"] + ")")[0][0] > 50
