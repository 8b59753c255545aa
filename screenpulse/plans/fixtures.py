"""Rating histories, episodes and catalogues derived from the driver's tables; the same SQL in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: A history for the daily check: users are titles, their events are votes; some are bombed, some boosted.
DAILY = """
d AS (SELECT CAST(user_id AS INT) AS tid, CAST(ts AS DATE) AS date, count(*) AS n,
             sum(CAST(round(value * 100) AS BIGINT)) AS s
      FROM {events} GROUP BY user_id, CAST(ts AS DATE)),
cum AS (SELECT tid, date, sum(n) OVER (PARTITION BY tid ORDER BY date) AS cn,
               sum(s) OVER (PARTITION BY tid ORDER BY date) AS cs FROM d),
hist AS (SELECT tid, date,
  CAST(85 + CAST(cs AS BIGINT) % 5
       - CASE WHEN tid % 7 = 0 AND date >= DATE '2024-01-20' THEN 10 ELSE 0 END
       + CASE WHEN tid % 11 = 0 AND date >= DATE '2024-01-22' THEN 5 ELSE 0 END AS INT) AS rating_x10,
  CAST(1000 + 10 * cn
       + CASE WHEN tid % 7 = 0 AND date >= DATE '2024-01-20' THEN 600 ELSE 0 END
       + CASE WHEN tid % 11 = 0 AND date >= DATE '2024-01-22' THEN 700 ELSE 0 END AS BIGINT) AS votes
  FROM cum),
episodes AS (SELECT DISTINCT CAST(user_id AS INT) AS tid, CAST(100000 + user_id % 15 AS INT) AS series, 1 AS season,
             CAST(floor(user_id / 15.0) AS INT) + 1 AS episode FROM {events} WHERE user_id % 2 = 0)
"""

#: Seasons and series pages for the launch and page checks: ten users to a series, so that each episode begins within the month; some surge.
SEASONS = """
episodes AS (SELECT DISTINCT CAST(user_id AS INT) AS tid, CAST(10000000 + floor(user_id / 10.0) AS INT) AS series, 1 AS season,
             CAST(user_id % 10 AS INT) + 1 AS episode FROM {events}),
rows0 AS (SELECT CAST(user_id AS INT) AS tid, CAST(ts AS DATE) AS date FROM {events} GROUP BY user_id, CAST(ts AS DATE)),
hist AS (
  SELECT r.tid, r.date, CAST(85 - CASE WHEN r.tid % 7 = 0 THEN 20 ELSE 0 END AS INT) AS rating_x10,
         CAST((300 + 50 * (day(r.date) - 2 * e.episode)) * CASE WHEN r.tid % 7 = 0 THEN 4 ELSE 1 END
              + CASE WHEN r.tid % 11 = 0 AND r.date >= DATE '2024-01-26' THEN 1500 ELSE 0 END AS BIGINT) AS votes
  FROM rows0 r JOIN episodes e ON e.tid = r.tid WHERE day(r.date) >= 2 * e.episode AND day(r.date) > 1
  UNION ALL
  SELECT CAST(e.series AS INT), r.date, CAST(CASE WHEN e.series % 3 = 0 THEN 55 ELSE 80 END AS INT),
         CAST(40000 + 500 * day(r.date) AS BIGINT)
  FROM rows0 r JOIN episodes e ON e.tid = r.tid WHERE day(r.date) >= 3 GROUP BY e.series, r.date),
days AS (SELECT DISTINCT CAST(ts AS DATE) AS date FROM {events})
"""

#: Rated episodes: a customer's orders are a series, years are seasons.
EPISODES = """
rated AS (SELECT CAST(o_custkey AS INT) AS series, CAST(year(o_orderdate) - 1991 AS INT) AS season,
                 CAST(row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderdate, o_orderkey) AS INT) AS number,
                 CAST(o_orderkey AS INT) AS tid,
                 CAST(40 + CAST(floor(o_totalprice) AS BIGINT) % 56 - CASE WHEN o_orderkey % 29 = 0 THEN 20 ELSE 0 END AS INT) AS rating_x10,
                 CAST(300 + o_orderkey % 400 + CASE WHEN o_orderkey % 29 = 0 THEN 2500 ELSE 0 END AS BIGINT) AS votes
          FROM {orders})
"""

#: A raw catalogue as text, as the source files have it, with bad values among them.
CATALOGUE = """
basics AS (SELECT concat('tt', lpad(CAST(p_partkey AS VARCHAR(20)), 7, '0')) AS tconst,
                  CASE WHEN p_partkey % 5 = 0 THEN 'movie' WHEN p_partkey % 7 = 0 THEN 'tvMiniSeries' ELSE 'tvSeries' END AS titleType,
                  concat(p_name, CASE WHEN p_partkey % 3 = 0 THEN ' & Frères' ELSE '' END) AS primaryTitle,
                  CASE WHEN p_partkey % 13 = 0 THEN NULL WHEN p_partkey % 17 = 0 THEN '19x9' ELSE CAST(1990 + p_partkey % 30 AS VARCHAR(20)) END AS startYear,
                  CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE CAST(2000 + p_partkey % 25 AS VARCHAR(20)) END AS endYear,
                  CASE WHEN p_partkey % 11 = 0 THEN 'Drama,Talk-Show' WHEN p_partkey % 19 = 0 THEN NULL ELSE 'Comedy,Drama' END AS genres
           FROM {part}),
episode AS (SELECT concat('tt', CAST(1000000 + l_orderkey * 10 + l_linenumber AS VARCHAR(20))) AS tconst,
                   concat('tt', lpad(CAST(l_partkey AS VARCHAR(20)), 7, '0')) AS parentTconst,
                   CASE WHEN l_orderkey % 97 = 0 THEN NULL WHEN l_orderkey % 89 = 0 THEN 'x' ELSE CAST(1 + l_suppkey % 3 AS VARCHAR(20)) END AS seasonNumber,
                   CAST(l_orderkey % 40 AS VARCHAR(20)) AS episodeNumber
            FROM {lineitem}),
ratings AS (SELECT concat('tt', CAST(1000000 + l_orderkey * 10 + l_linenumber AS VARCHAR(20))) AS tconst,
                   CAST(CAST(round((10 + CAST(l_quantity AS BIGINT) * 7 % 90)) AS DECIMAL(5, 1)) / 10 AS VARCHAR(20)) AS averageRating,
                   CAST(CAST(floor(l_extendedprice) AS BIGINT) % 900 + 5 AS VARCHAR(20)) AS numVotes
            FROM {lineitem} WHERE l_orderkey % 3 > 0)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver; one whose file can't be split into a part for each core is dealt out first."""
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def load(spark: SparkSession, sf_dir: str, ctes: str, name: str) -> DataFrame:
    """The table `name` of a derivation, over the driver's files."""
    tables = ("events", "orders", "part", "lineitem", "customer")
    used = {t: table(spark, sf_dir, t) for t in tables if f"{{{t}}}" in ctes}
    return spark.sql(f"WITH {ctes} SELECT * FROM {name}", **used)


def duck(ctes: str) -> str:
    out = ctes
    for t in ("events", "orders", "part", "lineitem", "customer"):
        out = out.replace(f"{{{t}}}", t)
    return out
