"""From daily series to firm-month and sector-month volatility measures."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import clip, correlation, market_cap, ratio

YEAR = 252.0


def realized_vol(daily: DataFrame, firm: str, date: str, ret: str, window: int = 63, least: int = 15, name: str = "realized_vol") -> DataFrame:
    """Annual standard deviation of the last ``window`` rows of a firm with at least ``least`` returns. Rows count, not days.

    Running sums less those of ``window`` rows before, so a row costs the same whatever the window; returns are fractions
    (within -2 and 2 here), so the sums lose some 1e-14 of the variance, and one below 1e-13 is 0.
    """
    order = Window.partitionBy(firm).orderBy(date)
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    x = F.col(ret).cast("double")
    sums = daily.withColumns({"_n": F.count(ret).over(so_far), "_s": F.coalesce(F.sum(x).over(so_far), F.lit(0.0)), "_ss": F.coalesce(F.sum(x * x).over(so_far), F.lit(0.0))})
    n, s, ss = (F.col(c) - F.coalesce(F.lag(c, window).over(order), F.lit(0)) for c in ("_n", "_s", "_ss"))
    last = sums.withColumns({"_n": n, "_s": s, "_ss": ss})
    n, s, ss = (F.col(c) for c in ("_n", "_s", "_ss"))
    var = (ss - s * s / n) / (n - 1)
    return last.withColumn(name, F.when((n >= least) & (n > 1), F.when(var < 1e-13, 0.0).otherwise(F.sqrt(var)) * F.sqrt(F.lit(YEAR)))).drop("_n", "_s", "_ss")


def last_known(col: str, date: str) -> Column:
    return F.max_by(col, F.when(F.col(col).isNotNull(), F.col(date)))


def firm_months(daily: DataFrame, firm: str, date: str, ret: str = "ret", price: str = "price", shares: str = "shrout", window: int = 63, least: int = 15, least_days: int = 15, more: Sequence[Column] = ()) -> DataFrame:
    """firm, month end, realized_vol, market_cap and n_days: the last known value of each column in the month, and the
    number of returns; ``more``: named aggregates of the month's days. Months with fewer than ``least_days`` returns are
    dropped. Vol and months share one exchange by firm."""
    rows = realized_vol(daily.withColumn(ret, clip(F.col(ret), -2.0, 2.0)), firm, date, ret, window, least)
    months = rows.groupBy(firm, F.last_day(date).alias("month_end")).agg(last_known("realized_vol", date).alias("realized_vol"), last_known(price, date).alias("_p"), last_known(shares, date).alias("_s"), F.count(ret).alias("n_days"), *more)
    extra = [c for c in months.columns if c not in (firm, "month_end", "realized_vol", "_p", "_s", "n_days")]
    months = months.where(F.col("n_days") >= least_days)
    return months.select(firm, "month_end", clip(F.col("realized_vol"), high=5.0).alias("realized_vol"), market_cap(F.col("_p"), F.col("_s")).alias("market_cap"), "n_days", *extra)


def rolling_std(df: DataFrame, firm: str, date: str, value: str, name: str, window: int = 6, least: int = 3) -> DataFrame:
    w = Window.partitionBy(firm).orderBy(date).rowsBetween(1 - window, 0)
    return df.withColumn(name, F.when(F.count(value).over(w) >= least, F.stddev_samp(value).over(w)))


def difference(df: DataFrame, keys: list[str], date: str, value: str, name: str, rows: int = 12) -> DataFrame:
    """x less x ``rows`` rows before; positions, not calendar months."""
    return df.withColumn(name, F.col(value) - F.lag(value, rows).over(Window.partitionBy(*keys).orderBy(date)))


def pct_change(df: DataFrame, keys: list[str], date: str, value: str, name: str, rows: int = 12) -> DataFrame:
    """x / x ``rows`` rows before, less 1, with gaps filled by the last known value first."""
    w = Window.partitionBy(*keys).orderBy(date)
    full = df.withColumn("_f", F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return full.withColumn(name, ratio(F.col("_f"), F.lag("_f", rows).over(w)) - 1).drop("_f")


def market_vol(daily: DataFrame, date: str, ret: str, least: int = 15) -> DataFrame:
    """month_end, market_vol: annual standard deviation of the month; NULL with fewer than ``least`` rows."""
    return daily.groupBy(F.last_day(date).alias("month_end")).agg(F.when(F.count(F.lit(1)) >= least, F.stddev_samp(ret) * F.sqrt(F.lit(YEAR))).alias("market_vol"))


def sector_median(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.median(value).alias(name), F.count(value).alias("n_firms"))


def relative_vol(sector: DataFrame, market: DataFrame, name: str = "metric_a") -> DataFrame:
    """Sector volatility over market volatility; the market has one row a month."""
    return sector.join(market, "month_end", "left").withColumn(name, ratio(F.col("sector_vol"), F.col("market_vol")))


def expanding_gap(df: DataFrame, group: str, date: str, x: str, y: str, name: str = "metric_b", least: int = 10, least_range: float = 0.10, most_slope: float = 5.0) -> DataFrame:
    """(group, date, name): the median of the date's y less its fit by a line through all of the group's rows up to the date.

    NULL with fewer than ``least`` rows of history. If x spans less than ``least_range``, the fit is the mean of y. The slope
    is within ``most_slope``. One sorted pass per group gives the sums of all dates.
    """
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    daily = rows.groupBy(group, date).agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(F.col(x) * F.col(x)).alias("sxx"), F.sum(F.col(x) * F.col(y)).alias("sxy"), F.min(x).alias("lo"), F.max(x).alias("hi"))
    w = Window.partitionBy(group).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    past = daily.select(group, date, *[F.sum(c).over(w).alias(c) for c in ("n", "sx", "sy", "sxx", "sxy")], F.min("lo").over(w).alias("lo"), F.max("hi").over(w).alias("hi"))
    mx, my = F.col("sx") / F.col("n"), F.col("sy") / F.col("n")
    ssx = F.greatest(F.col("sxx") - F.col("n") * mx * mx, F.lit(1e-6))
    slope = clip((F.col("sxy") - F.col("n") * mx * my) / ssx, -most_slope, most_slope)
    slope = F.when(F.col("hi") - F.col("lo") < least_range, 0.0).otherwise(slope)
    lines = past.select(group, date, F.when(F.col("n") >= least, slope).alias("_b"), F.when(F.col("n") >= least, my - slope * mx).alias("_a"))
    return rows.join(lines, [group, date]).groupBy(group, date).agg(F.median(F.col(y) - F.col("_a") - F.col("_b") * F.col(x)).alias(name))


def pairwise_correlation(daily: DataFrame, group: str, firm: str, date: str, ret: str, name: str = "metric_c", days: int = 100, window: int = 63, least: int = 40, least_firms: int = 3, block: int = 4000) -> DataFrame:
    """(group, month_end, name, n_firms): mean correlation of all pairs of firms over the last ``window`` returns of each in
    the ``days`` days up to the month's end, of firms with at least ``least`` of them; NULL below ``least_firms`` firms.

    A firm's returns of a span of months, and of the days before it that its months reach back to, become one row of numbers.
    Rows are dealt to blocks of firms, and pairs of blocks meet in a task, which goes through the span's months: matrix
    products give the sums of all pairs of firms over the days that both have. What is shuffled grows with returns x blocks,
    not with pairs or with the months that a day serves; a pair of blocks sends three numbers a month on.
    """
    span = max(24, days // 28 + 2)  # months; a day serves at most two spans
    month = lambda d: F.floor((F.year(d) * 12 + F.month(d) - 1) / span).cast("int")
    rows = daily.where(F.col(ret).isNotNull()).select(group, firm, F.to_date(date).alias("_d"), F.col(ret).cast("double").alias("_r"))
    served = rows.withColumn("_span", F.explode(F.array_distinct(F.array(month("_d"), month(F.date_add("_d", days))))))
    lines = served.groupBy(group, firm, "_span").agg(F.collect_list(F.struct(F.unix_date("_d").alias("at"), F.col("_r").alias("r"))).alias("_line")).where(F.size("_line") >= least)
    sizes = served.groupBy(group, "_span").agg(F.ceil(F.approx_count_distinct(firm) / block).cast("int").alias("_blocks"))
    dealt = lines.join(sizes, [group, "_span"]).withColumn("_own", F.pmod(F.xxhash64(firm), F.col("_blocks")).cast("int"))
    # a block meets itself and every other block once: the pair's lower block comes first
    other = F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda j: F.struct(F.least(j, F.col("_own")).alias("a"), F.greatest(j, F.col("_own")).alias("b")))
    meet = dealt.select(group, "_span", "_own", F.col("_line.at").alias("_at"), F.col("_line.r").alias("_r"), F.explode(other).alias("_pair")).select(group, "_span", "_own", "_at", "_r", "_pair.*")
    kinds = {f.name: f.dataType.simpleString() for f in meet.schema.fields}
    tasks = 16 * daily.sparkSession.sparkContext.defaultParallelism  # small in bytes, but long
    sums = meet.repartition(tasks, group, "_span", "a", "b").groupBy(group, "_span", "a", "b").applyInArrow(lambda t: _pair_sums(t, group, span, days, window, least), f"`{group}` {kinds[group]}, month_end date, s double, n long, firms long")
    total = sums.groupBy(group, "month_end").agg((F.sum("s") / F.when(F.sum("n") > 0, F.sum("n"))).alias("_m"), F.sum("firms").alias("n_firms")).where("n_firms > 0")
    # a month exists for a group if it has a day in it
    months = rows.select(group, F.last_day("_d").alias("month_end")).distinct()
    return total.join(months, [group, "month_end"], "left_semi").select(group, "month_end", F.when(F.col("n_firms") >= least_firms, F.col("_m")).alias(name), "n_firms")


#: Firms by firms whose sums are made at once, and rows of them that are worked on together.
PAIRS, STRIP = (128, 256), 64


def _pair_sums(table: pa.Table, group: str, span: int, days: int, window: int, least: int) -> pa.Table:
    """(group, month_end, s, n, firms): for each month of a span, the sum and number of the correlations of the pairs of firms
    of two blocks, or of one with itself, and in that case the number of its firms. Rows have _own (the firm's block), a, b
    (the blocks that meet), _at (days) and _r (returns)."""
    lines = table["_at"].combine_chunks()
    own, a, b = np.asarray(table["_own"]), table["a"][0].as_py(), table["b"][0].as_py()
    firm = np.repeat(np.arange(len(own)), np.diff(np.asarray(lines.offsets)))
    day, value = np.asarray(lines.flatten()), np.asarray(table["_r"].combine_chunks().flatten())
    order = np.argsort(day, kind="stable")
    firm, day, value = firm[order], day[order], value[order]
    out = []
    for month in range(table["_span"][0].as_py() * span, (table["_span"][0].as_py() + 1) * span):
        end = int((np.datetime64("0000-01", "M") + month + 1).astype("datetime64[D]").astype(int)) - 1
        u, v = np.searchsorted(day, [end - days, end + 1])
        x, has = np.zeros((len(own), days + 1)), np.zeros((len(own), days + 1))
        x[firm[u:v], end - day[u:v]], has[firm[u:v], end - day[u:v]] = value[u:v], 1.0
        if (has.sum(1) > window).any():
            last = np.cumsum(has, 1) <= window
            x, has = x * last, has * last
        known = has.sum(1) >= least
        if not known.any():
            continue
        x, has = x[known], has[known]
        x = np.where(has > 0, x - (x.sum(1) / has.sum(1))[:, None], 0.0)  # so that sums of squares lose no digits
        first, second = ((x[at], has[at]) for at in (own[known] == a, own[known] == b))
        out.append((end, *_correlations(first, first if a == b else second, a == b), len(first[0]) if a == b else 0))
    ends, s, n, firms = zip(*out, strict=True) if out else ((), (), (), ())
    one = pa.array([table[group][0].as_py()] * len(out), table.schema.field(group).type)
    return pa.table({group: one, "month_end": pa.array(ends, pa.int32()).cast(pa.date32()), "s": pa.array(s, pa.float64()), "n": pa.array(n, pa.int64()), "firms": pa.array(firms, pa.int64())})


def _correlations(first: tuple[np.ndarray, np.ndarray], second: tuple[np.ndarray, np.ndarray], same: bool) -> tuple[float, int]:
    """Sum and number of the correlations of each firm of one block with each of another, or with the later ones of the same:
    (returns, 1 where there is one), firms x days. Pairs without a deviation on their common days have none."""
    (xp, hp), (xq, hq) = first, second
    if not len(xp) or not len(xq):
        return 0.0, 0
    pp, qq = xp * xp, xq * xq
    high, wide = min(PAIRS[0], len(xp)), min(PAIRS[1], len(xq))
    sums, spare = np.empty((6, high, wide)), np.empty((STRIP, wide))
    s, n = 0.0, 0
    for i in range(0, len(xp), high):
        for j in range(i // wide * wide if same else 0, len(xq), wide):
            p, q = slice(i, i + high), slice(j, j + wide)
            w = sums[:, : len(xp[p]), : len(xq[q])]
            for at, (x, y) in enumerate(((hp, hq), (xp, hq), (pp, hq), (hp, xq), (xp, xq), (hp, qq))):
                np.matmul(x[p], y[q].T, out=w[at])
            for k in range(0, w.shape[1], STRIP):
                m, sx, xx, sy, xy, yy = w[:, k : k + STRIP]
                t = spare[: m.shape[0], : m.shape[1]]
                xy *= m
                xy -= np.multiply(sx, sy, out=t)
                xx *= m
                xx -= np.multiply(sx, sx, out=sx)
                yy *= m
                yy -= np.multiply(sy, sy, out=sy)
                m *= 1e-14
                known = np.minimum(xx, yy, out=t) > m
                if same and j < i + k + STRIP:
                    known &= np.arange(j, j + m.shape[1]) > np.arange(i + k, i + k + m.shape[0])[:, None]
                xx *= yy
                xy /= np.sqrt(np.maximum(xx, 1e-300, out=xx), out=xx)
                s, n = s + float(np.einsum("ij,ij->", xy, known.astype(float))), n + int(np.count_nonzero(known))
    return s, n


def cusum(df: DataFrame, group: str, order: list[str], value: str, mean: Column, std: Column, slack: float = 0.5, least: int = 3, name: str = "cusum") -> DataFrame:
    """One-sided upper CUSUM of z = (x - mean) / std: S = max(0, S + z - slack), which is the running sum less its running
    minimum (at most 0). Rows without a value carry S on; groups with fewer than ``least`` values have NULL."""
    z = F.when(F.col(value).isNotNull(), (F.col(value) - mean) / std - slack)
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("_s", F.coalesce(F.sum(z).over(w), F.lit(0.0)))
    out = out.withColumn(name, F.when(F.count(value).over(Window.partitionBy(group)) >= least, F.col("_s") - F.least(F.lit(0.0), F.min("_s").over(w))))
    return out.drop("_s")


def demeaned(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    w = Window.partitionBy(group)
    return df.withColumns({c: F.col(c) - F.avg(c).over(w) for c in columns})


def lead_lag(df: DataFrame, group: str, date: str, x: str, y: str, most: int = 12, least: int = 10) -> DataFrame:
    """(lag, correlation, n): correlation of x with y ``lag`` rows later, over all groups, lags within ``most``; NULL below
    ``least`` pairs. Lags never cross groups."""
    w = Window.partitionBy(group).orderBy(date)
    steps = range(-most, most + 1)
    wide = df.select(F.col(x).alias("_x"), *[(F.lead(y, k) if k >= 0 else F.lag(y, -k)).over(w).alias(f"_{k + most}") for k in steps]).where("_x IS NOT NULL")
    long = wide.select("_x", F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"_{k + most}").alias("v")) for k in steps])).alias("_l")).select("_x", "_l.lag", F.col("_l.v").alias("_y"))
    long = long.where("_y IS NOT NULL")
    return long.groupBy("lag").agg(F.when(F.count(F.lit(1)) >= least, correlation(F.col("_x"), F.col("_y"))).alias("correlation"), F.count(F.lit(1)).alias("n"))


def trailing_mean(df: DataFrame, group: str, date: str, columns: list[str], window: int = 12) -> DataFrame:
    """Mean of the last rows, 0 where there is none."""
    w = Window.partitionBy(group).orderBy(date).rowsBetween(1 - window, 0)
    return df.withColumns({c: F.coalesce(F.avg(c).over(w), F.lit(0.0)) for c in columns})
