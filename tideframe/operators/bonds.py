"""Bond quotes by issuer and month, and credit-implied volatility by sector."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.credit import implied_volatility
from ..functions.numbers import clip, maturity_bucket


def issuer_months(bonds: DataFrame, issuer: str, date: str, spread: str, years: str, amount: str, rating: str) -> DataFrame:
    """(issuer, month_end, bucket): amount-weighted mean spread, number of bonds and the most frequent rating.

    Spreads outside (0, 0.10] and maturities outside the buckets are left out. An unknown amount weighs 1; if the weights
    sum to no more than 0, the mean is plain. Of ratings equally frequent, the smallest.
    """
    rows = bonds.where((F.col(spread) > 0) & (F.col(spread) <= 0.10)).withColumn("bucket", maturity_bucket(F.col(years))).where("bucket IS NOT NULL")
    w = F.coalesce(F.col(amount), F.lit(1.0))
    mean = F.when(F.sum(w) > 0, F.sum(w * F.col(spread)) / F.sum(w)).otherwise(F.avg(spread))
    return rows.groupBy(issuer, F.last_day(date).alias("month_end"), "bucket").agg(mean.alias("spread"), F.count(F.lit(1)).alias("n_bonds"), F.mode(rating, True).alias("rating"))


def with_implied_vol(df: DataFrame, spread: str, lev: str, years: str | float = 5.0, name: str = "civ") -> DataFrame:
    tau = F.col(years).cast("double") if isinstance(years, str) else F.lit(float(years))
    return df.withColumn(name, implied_volatility(clip(F.col(spread), 1e-5, 0.10), F.col(lev), tau))


def sector_months(civ: DataFrame, sector: str, issuer: str, value: str = "civ", bucket: str = "bucket", preferred: int = 5) -> DataFrame:
    """(sector, month_end): median over issuers of each issuer's median, which is of the preferred bucket if it has any."""
    per = civ.where(F.col(value).isNotNull()).groupBy(sector, "month_end", issuer).agg(F.median(F.when(F.col(bucket) == preferred, F.col(value))).alias("_p"), F.median(value).alias("_all"))
    return per.groupBy(sector, "month_end").agg(F.median(F.coalesce("_p", "_all")).alias(value), F.count(F.lit(1)).alias("n_issuers"))
