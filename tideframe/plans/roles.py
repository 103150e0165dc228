"""The driver's tables in their roles, as DataFrames and as SQL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import clip, ratio
from ..operators import volatility as V


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, columns: Sequence[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


def daily(spark: SparkSession, sf_dir: str, key: str = "l_suppkey", few: bool = False) -> DataFrame:
    """key, d, price, shrout, ret (within -2 and 2). Rows are shuffled once, by key, for days, returns and months alike, since few
    share a key and day; with ``few`` keys they are added up by key and day first."""
    from pyspark.sql import Window

    li = table(spark, sf_dir, "lineitem").select(key, "l_shipdate", "l_extendedprice", "l_quantity")
    days = (li if few else li.repartition(key)).groupBy(key, F.to_date("l_shipdate").alias("d")).agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.sum("l_quantity").alias("shrout"))
    return days.withColumn("ret", clip(ratio(F.col("price"), F.lag("price").over(Window.partitionBy(key).orderBy("d"))) - 1, -2.0, 2.0))


def months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.firm_months(daily(spark, sf_dir), "l_suppkey", "d", least_days=3)


def every_month(days: DataFrame) -> DataFrame:
    """Firm-months of a daily table, also those with few days, with their turnover (the sum of price x shrout)."""
    return V.firm_months(days, "l_suppkey", "d", least_days=0, more=[F.sum(F.col("price") * F.col("shrout")).alias("turnover")])


def known_months(every: DataFrame) -> DataFrame:
    """Those of at least three returns, as ``months`` has them."""
    return every.where("n_days >= 3").drop("turnover")


def reported(every: DataFrame) -> DataFrame:
    """A supplier's turnover in March, June, September and December as its debt, reported at the month's end."""
    debt = (F.col("turnover") * 0.4123456789 / 1000).alias("total_debt")
    return every.where(F.month("month_end") % 3 == 0).select("l_suppkey", F.col("month_end").alias("datadate"), debt)


def with_sector(df: DataFrame, spark: SparkSession, sf_dir: str, key: str = "l_suppkey") -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias(key), F.col("s_nationkey").alias("sector"))
    return df.join(s, key)


def daily_sql(key: str = "l_suppkey") -> str:
    return f"""days AS (SELECT {key}, CAST(l_shipdate AS DATE) AS d, avg(l_extendedprice / l_quantity) AS price, sum(l_quantity) AS shrout FROM lineitem GROUP BY 1, 2),
    ret0 AS (SELECT *, price / lag(price) OVER (PARTITION BY {key} ORDER BY d) - 1 AS r FROM days),
    daily AS (SELECT {key}, d, price, shrout, CASE WHEN r IS NOT NULL THEN greatest(least(r, 2.0), -2.0) END AS ret FROM ret0)"""


MONTHS_SQL = f"""{daily_sql()},
    vol AS (SELECT *, CASE WHEN count(ret) OVER w >= 15 THEN stddev_samp(ret) OVER w * sqrt(252.0) END AS rv FROM daily
            WINDOW w AS (PARTITION BY l_suppkey ORDER BY d ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)),
    months0 AS (SELECT l_suppkey, last_day(d) AS month_end, max_by(rv, d) FILTER (WHERE rv IS NOT NULL) AS rv, max_by(price, d) AS p, max_by(shrout, d) AS s, count(ret) AS n_days FROM vol GROUP BY 1, 2 HAVING count(ret) >= 3),
    months AS (SELECT l_suppkey, month_end, CASE WHEN rv IS NOT NULL THEN least(rv, 5.0) END AS realized_vol, abs(p) * s / 1000 AS market_cap, n_days FROM months0)"""

SECTOR_SQL = "(SELECT s_suppkey AS l_suppkey, s_nationkey AS sector FROM supplier)"
