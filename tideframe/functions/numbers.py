"""Null-safe arithmetic. Missing values are NULL everywhere; NaN never leaves a reader."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN and infinities of float columns as NULL."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType | T.FloatType)]
    return df.withColumns({c: F.when(finite(F.col(c)), F.col(c)) for c in floats}) if floats else df


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """x within the bounds; NULL stays NULL (least and greatest alone would give the bound)."""
    y = x if low is None else F.greatest(x, F.lit(low))
    y = y if high is None else F.least(y, F.lit(high))
    return F.when(x.isNotNull(), y)


def ratio(a: Column, b: Column) -> Column:
    """a / b; NULL if b is 0 or either is NULL."""
    return F.when(b != 0, a / b)


def correlation(x: Column, y: Column) -> Column:
    """Pearson's, as an aggregate; NULL if either is constant. Rows with a NULL are left out."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return ratio(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def market_cap(price: Column, shares: Column) -> Column:
    """In millions; the sign of a price only tells how it was quoted."""
    return F.abs(price) * shares / 1000


def total_debt(short: Column, long: Column) -> Column:
    """Short-term plus long-term debt; a missing part counts as 0, so the sum is never NULL."""
    return F.coalesce(short, F.lit(0.0)) + F.coalesce(long, F.lit(0.0))


def issuer_id(code: Column) -> Column:
    """The issuer's part of a bond's code: its first six characters."""
    return F.substring(code, 1, 6)


def leverage(debt: Column, equity: Column, low: float = 0.01, high: float = 0.99) -> Column:
    return clip(ratio(debt, debt + equity), low, high)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def interactions(vol: Column, vol_of_asset: Column, lev: Column) -> dict[str, Column]:
    """U: leverage; V: vol x leverage; W: vol x (1 - leverage); X: asset vol x leverage. NULL counts as 0."""
    v, a, z = (F.coalesce(c, F.lit(0.0)) for c in (vol, vol_of_asset, lev))
    return {"metric_u": z, "metric_v": v * z, "metric_w": v * (1 - z), "metric_x": a * z}


def mapped(key: Column, table: Mapping[str, str], default: str | None = None) -> Column:
    """table[key]; without a default, an unmapped key is an error."""
    out = F.lit(default) if default is not None else F.raise_error(F.concat(F.lit("unmapped: "), F.coalesce(key, F.lit("NULL")))).cast("string")
    for k, v in reversed(list(table.items())):
        out = F.when(key == k, v).otherwise(out)
    return out


def with_regime(columns: list[str], flag: Column) -> dict[str, Column]:
    """Each column, the flag, and each column times the flag: 2p + 1 features."""
    return {c: F.col(c) for c in columns} | {"regime_flag": flag} | {f"{c}_x_regime": F.col(c) * flag for c in columns}


def maturity_bucket(years: Column) -> Column:
    """[0, 4] -> 3, (4, 7] -> 5, (7, 30] -> 10, else NULL."""
    return F.when((years >= 0) & (years <= 4), 3).when((years > 4) & (years <= 7), 5).when((years > 7) & (years <= 30), 10)


def pipe_list(text: Column) -> Column:
    """'a|b' as an array, without empty parts."""
    return F.filter(F.split(text, r"\|"), lambda x: x != "")


def digits_id(x: Column, width: int = 10) -> Column:
    return F.lpad(x.cast("string"), width, "0")
