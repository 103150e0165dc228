"""Volatility, leverage, joins, bonds and panel queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import credit, dates, numbers
from ..operators import bonds, joins, panel
from ..operators import volatility as V
from ..operators.splits import settled
from ..sources import tables as S
from .roles import MONTHS_SQL, SECTOR_SQL, daily, daily_sql, every_month, known_months, months, reported, rounded, table, with_sector

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"""WITH {MONTHS_SQL},
    sector AS (SELECT sector, month_end, median(realized_vol) AS sector_vol, count(realized_vol) AS n_firms FROM months JOIN {SECTOR_SQL} USING (l_suppkey) GROUP BY 1, 2),
    mkt AS (SELECT d, avg(ret) AS ret FROM daily GROUP BY 1),
    mv AS (SELECT last_day(d) AS month_end, CASE WHEN count(*) >= 15 THEN stddev_samp(ret) * sqrt(252.0) END AS market_vol FROM mkt GROUP BY 1)
    SELECT sector, month_end, round(sector_vol, 6) AS sector_vol, n_firms, round(market_vol, 6) AS market_vol, round(CASE WHEN market_vol <> 0 THEN sector_vol / market_vol END, 6) AS metric_a
    FROM sector LEFT JOIN mv USING (month_end)""")
def metric_a_by_sector_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metric_a(months(spark, sf_dir), spark, sf_dir)


def firm_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All firm-months with their turnover, computed once: what is known of months and reported debt comes from here."""
    return settled(every_month(daily(spark, sf_dir)))


def _metric_a(m: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    sector = V.sector_median(with_sector(m, spark, sf_dir), ["sector", "month_end"], "realized_vol", "sector_vol")
    market = V.market_vol(daily(spark, sf_dir).groupBy("d").agg(F.avg("ret").alias("ret")), "d", "ret")
    out = rounded(V.relative_vol(sector, market), ["sector_vol", "market_vol", "metric_a"])
    return out.select("sector", "month_end", "sector_vol", "n_firms", "market_vol", "metric_a")


@query(f"""WITH {MONTHS_SQL}
    SELECT l_suppkey, month_end, round(CASE WHEN count(realized_vol) OVER w >= 3 THEN stddev_samp(realized_vol) OVER w END, 6) AS vol_of_vol,
      round(realized_vol - lag(realized_vol, 12) OVER o, 6) AS diff12, round(f / nullif(lag(f, 12) OVER o, 0) - 1, 6) AS pct12
    FROM (SELECT *, last_value(market_cap IGNORE NULLS) OVER (PARTITION BY l_suppkey ORDER BY month_end ROWS UNBOUNDED PRECEDING) AS f FROM months)
    WINDOW w AS (PARTITION BY l_suppkey ORDER BY month_end ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), o AS (PARTITION BY l_suppkey ORDER BY month_end)""")
def vol_of_vol_and_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = V.rolling_std(months(spark, sf_dir), "l_suppkey", "month_end", "realized_vol", "vol_of_vol")
    m = V.pct_change(V.difference(m, ["l_suppkey"], "month_end", "realized_vol", "diff12"), ["l_suppkey"], "month_end", "market_cap", "pct12")
    return rounded(m.select("l_suppkey", "month_end", "vol_of_vol", "diff12", "pct12"), ["vol_of_vol", "diff12", "pct12"])


_DEBT = "debt AS (SELECT l_suppkey, last_day(d) AS month_end, sum(price * shrout) * 0.4123456789 / 1000 AS total_debt FROM daily WHERE extract(month FROM d) % 3 = 0 GROUP BY 1, 2)"
_GRID = """span AS (SELECT l_suppkey, {lag}min(month_end) AS a, max(month_end) AS b FROM moved GROUP BY ALL),
    grid AS (SELECT l_suppkey, {lag}last_day(CAST(u AS DATE)) AS month_end FROM span, unnest(generate_series(date_trunc('month', a), date_trunc('month', b), INTERVAL 1 MONTH)) AS g(u)),
    filled AS (SELECT l_suppkey, {lag}month_end, last_value(total_debt IGNORE NULLS) OVER (PARTITION BY l_suppkey{plag} ORDER BY month_end ROWS UNBOUNDED PRECEDING) AS total_debt FROM grid LEFT JOIN moved USING (l_suppkey, {lag}month_end))"""
_LEV = "CASE WHEN total_debt + market_cap <> 0 AND total_debt IS NOT NULL THEN greatest(least(total_debt / (total_debt + market_cap), 0.99), 0.01) END"


@query(f"""WITH {MONTHS_SQL}, {_DEBT},
    lags AS (SELECT unnest([0, 30, 60, 90]) AS lag_days),
    moved AS (SELECT l_suppkey, lag_days, last_day(CAST(month_end + lag_days * INTERVAL 1 DAY AS DATE)) AS month_end, max_by(total_debt, month_end) AS total_debt FROM debt, lags GROUP BY ALL),
    {_GRID.format(lag="lag_days, ", plag=", lag_days")}
    SELECT l_suppkey, lag_days, month_end, round(total_debt, 6) AS total_debt, round({_LEV}, 6) AS leverage
    FROM (SELECT * FROM months, lags) LEFT JOIN filled USING (l_suppkey, lag_days, month_end)""")
def leverage_with_publication_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _lagged_leverage(firm_table(spark, sf_dir))
    return rounded(out.select("l_suppkey", "lag_days", "month_end", "total_debt", "leverage"), ["leverage", "total_debt"])


def _lagged_leverage(every: DataFrame) -> DataFrame:
    """Firm-months with the leverage of reports that become known 0, 30, 60 and 90 days later."""
    lags = F.explode(F.array(*[F.lit(x) for x in (0, 30, 60, 90)]))
    m = known_months(every).withColumn("lag_days", lags)
    moved = reported(every).withColumn("lag_days", lags).withColumn("d", dates.lagged(F.col("datadate"), F.col("lag_days")))
    filled = joins.to_months(moved, ["l_suppkey", "lag_days"], "d", ["total_debt"])
    return m.join(filled, ["l_suppkey", "lag_days", "month_end"], "left").withColumn("leverage", numbers.leverage(F.col("total_debt"), F.col("market_cap")))


def leveraged(spark: SparkSession, sf_dir: str, every: DataFrame | None = None) -> DataFrame:
    """Firm-months with sector, leverage and asset_vol, of ``every`` firm-month if that is at hand."""
    every = firm_table(spark, sf_dir) if every is None else every
    out = joins.firm_leverage(known_months(every), reported(every), "l_suppkey", "total_debt", "datadate", "market_cap")
    return with_sector(out, spark, sf_dir).withColumn("asset_vol", F.col("realized_vol") * (1 - F.col("leverage")))


LEVERAGED_SQL = f"""{MONTHS_SQL}, {_DEBT}, moved AS (SELECT * FROM debt), {_GRID.format(lag="", plag="")},
    lev0 AS (SELECT l_suppkey, month_end, realized_vol, market_cap, sector, {_LEV} AS leverage FROM months LEFT JOIN filled USING (l_suppkey, month_end) JOIN {SECTOR_SQL} USING (l_suppkey)),
    lev AS (SELECT *, realized_vol * (1 - leverage) AS asset_vol FROM lev0)"""


@query(f"""WITH {LEVERAGED_SQL},
    o AS (SELECT * FROM lev WHERE leverage IS NOT NULL AND asset_vol IS NOT NULL),
    h AS (SELECT a.sector, a.month_end, count(*) AS n, avg(b.leverage) AS mx, avg(b.asset_vol) AS my, covar_pop(b.asset_vol, b.leverage) * count(*) AS sxy, greatest(var_pop(b.leverage) * count(*), 1e-6) AS sxx, max(b.leverage) - min(b.leverage) AS span
          FROM (SELECT DISTINCT sector, month_end FROM o) a JOIN o b ON a.sector = b.sector AND b.month_end <= a.month_end GROUP BY 1, 2),
    l AS (SELECT sector, month_end, CASE WHEN n >= 10 THEN CASE WHEN span < 0.10 THEN 0 ELSE greatest(least(sxy / sxx, 5.0), -5.0) END END AS b, mx, my FROM h)
    SELECT sector, month_end, round(median(asset_vol - (my - b * mx) - b * leverage), 5) AS metric_b FROM o JOIN l USING (sector, month_end) GROUP BY 1, 2""")
def expanding_regression_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(V.expanding_gap(leveraged(spark, sf_dir), "sector", "month_end", "leverage", "asset_vol"), ["metric_b"], 5)


@query(f"""WITH {LEVERAGED_SQL},
    s AS (SELECT sector, month_end, median(leverage) AS med_leverage, median(asset_vol) AS metric_d, median(realized_vol) AS v FROM lev GROUP BY 1, 2)
    SELECT sector, month_end, round(metric_d, 6) AS metric_d, round(med_leverage - lag(med_leverage, 12) OVER (PARTITION BY sector ORDER BY month_end), 6) AS metric_f,
      round(coalesce(med_leverage, 0), 6) AS metric_u, round(coalesce(v, 0) * coalesce(med_leverage, 0), 6) AS metric_v, round(coalesce(v, 0) * (1 - coalesce(med_leverage, 0)), 6) AS metric_w, round(coalesce(metric_d, 0) * coalesce(med_leverage, 0), 6) AS metric_x
    FROM s""")
def leverage_metrics_and_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = leveraged(spark, sf_dir).groupBy("sector", "month_end").agg(F.median("leverage").alias("med_leverage"), F.median("asset_vol").alias("metric_d"), F.median("realized_vol").alias("v"))
    s = V.difference(s, ["sector"], "month_end", "med_leverage", "metric_f").withColumns(numbers.interactions(F.col("v"), F.col("metric_d"), F.col("med_leverage")))
    cols = ["metric_d", "metric_f", "metric_u", "metric_v", "metric_w", "metric_x"]
    return rounded(s, cols).select("sector", "month_end", *cols)


@query(f"""WITH {daily_sql("l_linenumber")},
    o AS (SELECT l_linenumber AS firm, l_linenumber % 2 AS sector, d, ret FROM daily WHERE ret IS NOT NULL),
    m AS (SELECT DISTINCT sector, last_day(d) AS month_end FROM o),
    s AS (SELECT m.sector, month_end, firm, d, ret, row_number() OVER (PARTITION BY m.sector, month_end, firm ORDER BY d DESC) AS r FROM m JOIN o ON o.sector = m.sector AND d <= month_end AND d >= month_end - INTERVAL 100 DAY),
    k AS (SELECT *, count(*) OVER (PARTITION BY sector, month_end, firm) AS n FROM s WHERE r <= 63),
    f AS (SELECT * FROM k WHERE n >= 40),
    c AS (SELECT x.sector, x.month_end, x.firm AS a, y.firm AS b, corr(x.ret, y.ret) AS c FROM f x JOIN f y ON x.sector = y.sector AND x.month_end = y.month_end AND x.d = y.d AND x.firm < y.firm GROUP BY 1, 2, 3, 4),
    g AS (SELECT sector, month_end, count(DISTINCT firm) AS n_firms FROM f GROUP BY 1, 2)
    SELECT sector, month_end, round(CASE WHEN n_firms >= 3 THEN m END, 6) AS metric_c, n_firms FROM g LEFT JOIN (SELECT sector, month_end, avg(CASE WHEN NOT isnan(c) THEN c END) AS m FROM c GROUP BY 1, 2) USING (sector, month_end)""")
def mean_pairwise_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = daily(spark, sf_dir, "l_linenumber", few=True).select(F.col("l_linenumber").alias("firm"), (F.col("l_linenumber") % 2).alias("sector"), "d", "ret")
    return rounded(V.pairwise_correlation(d, "sector", "firm", "d", "ret"), ["metric_c"])


@query("""WITH r AS (SELECT *, last_day(CAST(o_orderdate AS DATE)) AS m FROM orders JOIN customer ON o_custkey = c_custkey),
    q AS (SELECT *, date_trunc('quarter', o_orderdate) AS q FROM r),
    l AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, q ORDER BY o_orderdate DESC, o_totalprice DESC, o_orderkey DESC) AS k FROM q),
    s AS (SELECT c_nationkey, last_day(CAST(q AS DATE)) AS stamp, median(o_totalprice) AS price, count(DISTINCT o_custkey) AS n FROM l WHERE k = 1 GROUP BY 1, 2),
    p AS (SELECT c_nationkey, min(stamp) AS a, max(stamp) + INTERVAL 3 MONTH AS b FROM s GROUP BY 1),
    g AS (SELECT c_nationkey, last_day(CAST(u AS DATE)) AS month_end, b FROM p, unnest(generate_series(date_trunc('month', a), date_trunc('month', b), INTERVAL 1 MONTH)) AS t(u))
    SELECT c_nationkey, month_end, round(last_value(price IGNORE NULLS) OVER w, 4) AS price, last_value(n IGNORE NULLS) OVER w AS n_entities
    FROM (SELECT g.c_nationkey, g.month_end, price, n FROM g LEFT JOIN s ON g.c_nationkey = s.c_nationkey AND g.month_end = s.stamp WHERE g.month_end <= b)
    WINDOW w AS (PARTITION BY c_nationkey ORDER BY month_end ROWS UNBOUNDED PRECEDING)""")
def quarterly_medians_to_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey").withColumn("o_date", F.to_date("o_orderdate"))
    q = joins.quarter_medians(o.withColumn("price", F.col("o_totalprice")), "o_custkey", "c_nationkey", "o_orderdate", ["price"], ["o_totalprice", "o_orderkey"], stamp="first_month")
    out = joins.to_months(q, ["c_nationkey"], "stamp", ["price", "n_entities"], 3)
    return rounded(out, ["price"], 4)


@query("""SELECT e.event_id, e.user_id, e.ts, o.o_orderkey AS last_value_id, round(o.value, 6) AS last_value
    FROM (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click') e
    ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS o_orderkey, max_by(value, event_id) AS value FROM events WHERE event_type = 'view' GROUP BY 1, 2) o ON e.user_id = o.user_id AND e.ts >= o.ts""")
def as_of_last_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    right = e.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("last_value_id"), F.col("value").alias("last_value"))
    out = joins.as_of(e.where("event_type = 'click'").select("user_id", "event_id", "ts"), right, ["user_id"], "ts", "ts", ["last_value_id", "last_value"])
    return rounded(out.select("event_id", "user_id", "ts", "last_value_id", "last_value"), ["last_value"])


@query("""WITH t AS (SELECT avg(value) AS m, stddev_samp(value) AS sd FROM events WHERE ts < TIMESTAMP '2024-01-15 00:00:00'),
    z AS (SELECT events.*, CASE WHEN value IS NOT NULL THEN (value - m) / sd - 0.5 END AS z FROM events, t),
    s AS (SELECT *, coalesce(sum(z) OVER w, 0) AS s, count(value) OVER (PARTITION BY user_id) AS n FROM z WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
    SELECT event_id, user_id, round(CASE WHEN n >= 3 THEN s - least(0.0, min(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) END, 5) AS cusum FROM s""")
def cusum_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """z by the mean and deviation of the first half month, the training period."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    train = e.where("ts < TIMESTAMP '2024-01-15 00:00:00'").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("sd"))
    out = V.cusum(e.crossJoin(F.broadcast(train)), "user_id", ["ts", "event_id"], "value", F.col("m"), F.col("sd"))  # one row
    return rounded(out.select("event_id", "user_id", "cusum"), ["cusum"], 5)


@query("SELECT event_id, user_id, round(value - avg(value) OVER (PARTITION BY user_id), 10) AS value FROM events")
def demeaned_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(V.demeaned(table(spark, sf_dir, "events").select("event_id", "user_id", "value"), "user_id", ["value"]), ["value"], 10)


@query(f"""WITH {MONTHS_SQL},
    k AS (SELECT unnest(range(-12, 13)) AS lag),
    n AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY month_end) AS i FROM months),
    p AS (SELECT lag, x.market_cap AS x, y.n_days AS y FROM k, n x JOIN n y ON x.l_suppkey = y.l_suppkey AND y.i = x.i + lag WHERE x.market_cap IS NOT NULL)
    SELECT CAST(lag AS INTEGER) AS lag, round(CASE WHEN count(*) >= 10 THEN corr(x, y) END, 6) AS correlation, count(*) AS n FROM p GROUP BY 1""")
def lead_lag_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(V.lead_lag(months(spark, sf_dir), "l_suppkey", "month_end", "market_cap", "n_days"), ["correlation"])


_BUCKET = "CASE WHEN l_quantity BETWEEN 0 AND 4 THEN 3 WHEN l_quantity > 4 AND l_quantity <= 7 THEN 5 WHEN l_quantity > 7 AND l_quantity <= 30 THEN 10 END"
_BOND_SQL = f"""b AS (SELECT l_suppkey, last_day(CAST(l_shipdate AS DATE)) AS month_end, {_BUCKET} AS bucket, l_discount AS spread, coalesce(l_extendedprice, 1) AS w, l_returnflag AS rating FROM lineitem WHERE l_discount > 0 AND l_discount <= 0.10),
    modes AS (SELECT l_suppkey, month_end, bucket, rating FROM (SELECT l_suppkey, month_end, bucket, rating, row_number() OVER (PARTITION BY l_suppkey, month_end, bucket ORDER BY count(*) DESC, rating) AS k FROM b WHERE bucket IS NOT NULL GROUP BY 1, 2, 3, 4) WHERE k = 1),
    rolled AS (SELECT l_suppkey, month_end, bucket, CASE WHEN sum(w) > 0 THEN sum(w * spread) / sum(w) ELSE avg(spread) END AS spread, count(*) AS n_bonds FROM b WHERE bucket IS NOT NULL GROUP BY 1, 2, 3)"""


def _bonds(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("d", F.to_date("l_shipdate"))
    return bonds.issuer_months(li, "l_suppkey", "d", "l_discount", "l_quantity", "l_extendedprice", "l_returnflag")


@query(f"WITH {_BOND_SQL} SELECT l_suppkey, month_end, bucket, round(spread, 6) AS spread, n_bonds, rating FROM rolled JOIN modes USING (l_suppkey, month_end, bucket)")
def bond_issuer_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_bonds(spark, sf_dir), ["spread"])


@query(f"""WITH {_BOND_SQL}, {LEVERAGED_SQL}, b2 AS (SELECT l_suppkey, date_trunc('quarter', month_end) AS quarter, median(spread) AS spread FROM rolled GROUP BY 1, 2),
    l2 AS (SELECT l_suppkey, date_trunc('quarter', month_end) AS quarter, median(leverage) AS leverage FROM lev GROUP BY 1, 2)
    SELECT l_suppkey, CAST(quarter AS DATE) AS quarter, round(spread, 6) AS spread, round(leverage, 6) AS leverage FROM b2 FULL JOIN l2 USING (l_suppkey, quarter)""")
def issuer_quarter_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An issuer's quarterly medians of spread and leverage."""
    quarter = F.trunc("month_end", "quarter").alias("quarter")
    spread = _bonds(spark, sf_dir).groupBy("l_suppkey", quarter).agg(F.median("spread").alias("spread"))
    lev = leveraged(spark, sf_dir).groupBy("l_suppkey", quarter).agg(F.median("leverage").alias("leverage"))
    return rounded(joins.assemble([spread, lev], ["l_suppkey", "quarter"]), ["spread", "leverage"])


@query(f"""WITH {_BOND_SQL},
    i AS (SELECT sector, month_end, l_suppkey, median(spread) FILTER (WHERE bucket = 5) AS p, median(spread) AS a FROM rolled JOIN {SECTOR_SQL} USING (l_suppkey) GROUP BY 1, 2, 3)
    SELECT sector, month_end, round(median(coalesce(p, a)), 6) AS spread, count(*) AS n_issuers FROM i GROUP BY 1, 2""")
def sector_spread_preferring_five_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bonds.sector_months(with_sector(_bonds(spark, sf_dir), spark, sf_dir), "sector", "l_suppkey", "spread"), ["spread"])


def hart_sql(x: str) -> str:
    top, bottom = str(credit.HART_TOP[0]), str(credit.HART_BOTTOM[0])
    for c in credit.HART_TOP[1:]:
        top = f"({top} * abs({x}) + {c})"
    for c in credit.HART_BOTTOM[1:]:
        bottom = f"({bottom} * abs({x}) + {c})"
    tail = f"exp(-{x} * {x} / 2) * {top} / {bottom}"
    far = f"exp(-{x} * {x} / 2) / ((abs({x}) + 1 / (abs({x}) + 2 / (abs({x}) + 3 / (abs({x}) + 4 / (abs({x}) + 0.65))))) * 2.506628274631)"
    return f"(CASE WHEN abs({x}) > 37 THEN CASE WHEN {x} > 0 THEN 1.0 ELSE 0.0 END WHEN abs({x}) < 7.07106781186547 THEN CASE WHEN {x} > 0 THEN 1 - {tail} ELSE {tail} END ELSE CASE WHEN {x} > 0 THEN 1 - {far} ELSE {far} END END)"


_CREDIT_SQL = "q AS (SELECT l_orderkey, l_linenumber, 0.05 + l_discount * 5 AS sigma, 0.2 + l_tax * 8 AS lev, CASE WHEN l_quantity <= 30 THEN 5.0 ELSE 10.0 END AS tau FROM lineitem), d AS (SELECT *, (-ln(lev) - sigma * sigma * tau / 2) / (sigma * sqrt(tau)) AS d2, (-ln(lev) - sigma * sigma * tau / 2) / (sigma * sqrt(tau)) + sigma * sqrt(tau) AS d1 FROM q)"


def _quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (0.05 + F.col("l_discount") * 5).alias("sigma"), (0.2 + F.col("l_tax") * 8).alias("lev"), F.when(F.col("l_quantity") <= 30, 5.0).otherwise(10.0).alias("tau"))


@query(f"""WITH {_CREDIT_SQL}, v AS (SELECT *, {hart_sql("d2")} + {hart_sql("(-d1)")} / lev AS v FROM d)
    SELECT l_orderkey, l_linenumber, round(greatest(-ln(v) / tau, 0.0), 8) AS spread, round(exp(-d1 * d1 / 2) / 2.5066282746310002 / (lev * sqrt(tau) * v), 6) AS vega FROM v""")
def merton_spread_and_vega(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = credit.with_merton(_quotes(spark, sf_dir), "sigma", "lev", "tau")
    return q.select("l_orderkey", "l_linenumber", F.round("spread", 8).alias("spread"), F.round("vega", 6).alias("vega"))


@query(f"WITH {_CREDIT_SQL}, v AS (SELECT *, {hart_sql('d2')} + {hart_sql('(-d1)')} / lev AS v FROM d) SELECT l_orderkey, l_linenumber, round(sigma, 5) AS civ FROM v WHERE -ln(v) / tau > 1e-4")
def implied_volatility_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = credit.with_merton(_quotes(spark, sf_dir), "sigma", "lev", "tau", "s").where("s > 1e-4")
    return q.select("l_orderkey", "l_linenumber", F.round(credit.implied_volatility("s", "lev", "tau"), 5).alias("civ"))


@query()
def sector_credit_implied_vol(spark: SparkSession, sf_dir: str, lev: DataFrame | None = None) -> DataFrame:
    """Metrics O (sector median), P (less the median asset volatility) and Q (12-row change), with the firm-months of
    ``leveraged`` from ``lev`` if they are at hand."""
    lev = settled(leveraged(spark, sf_dir)) if lev is None else lev
    civ = bonds.with_implied_vol(_bonds(spark, sf_dir).join(lev.select("l_suppkey", "month_end", "leverage", "sector"), ["l_suppkey", "month_end"]), "spread", "leverage", "bucket")
    o = bonds.sector_months(civ, "sector", "l_suppkey", "civ").withColumnRenamed("civ", "metric_o")
    d = lev.groupBy("sector", "month_end").agg(F.median("asset_vol").alias("asset_vol"))
    out = o.join(d, ["sector", "month_end"], "left").withColumn("metric_p", F.col("metric_o") - F.col("asset_vol"))
    return rounded(V.difference(out, ["sector"], "month_end", "metric_o", "metric_q"), ["metric_o", "metric_p", "metric_q"]).drop("asset_vol")


_PANEL_SQL = f"""{MONTHS_SQL}, peaks AS (SELECT l_suppkey, first(month_end ORDER BY market_cap DESC, month_end DESC) AS peak, l_suppkey % 3 = 0 AS bubble FROM months GROUP BY 1),
    aligned AS (SELECT l_suppkey, month_end, realized_vol, market_cap, bubble, (year(month_end) - year(peak)) * 12 + month(month_end) - month(peak) AS tau FROM months JOIN peaks USING (l_suppkey))"""


def event_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Firm-months aligned on the month of a firm's highest market cap; every third firm is a bubble."""
    m = months(spark, sf_dir)
    peaks = m.groupBy("l_suppkey").agg(F.max_by("month_end", F.struct("market_cap", "month_end")).alias("peak")).withColumn("bubble", F.col("l_suppkey") % 3 == 0)
    return m.join(peaks, "l_suppkey")


@query(f"""WITH {_PANEL_SQL} SELECT l_suppkey, month_end, CAST(tau AS INTEGER) AS tau, CAST(CASE WHEN bubble AND tau >= -12 THEN 1 ELSE 0 END AS INTEGER) AS event_12m, CAST(CASE WHEN bubble THEN -tau ELSE 36 END AS INTEGER) AS time_to_peak FROM aligned WHERE tau >= -36 AND tau < 0""")
def event_time_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = panel.pre_peak(event_panel(spark, sf_dir), "month_end", "peak", F.col("bubble"))
    return out.select("l_suppkey", "month_end", "tau", "event_12m", "time_to_peak")


@query(f"WITH {_PANEL_SQL} SELECT l_suppkey, bubble, round(avg(realized_vol), 6) AS realized_vol, round(avg(market_cap), 4) AS market_cap FROM aligned WHERE tau >= -36 AND tau < 0 GROUP BY 1, 2")
def episode_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = panel.collapse(panel.pre_peak(event_panel(spark, sf_dir), "month_end", "peak", F.col("bubble")), ["l_suppkey", "bubble"], ["realized_vol", "market_cap"])
    return rounded(rounded(out, ["realized_vol"]), ["market_cap"], 4)


@query(f"WITH {_PANEL_SQL} SELECT count(*) FILTER (WHERE tau >= 0) AS n_leaks FROM (SELECT * FROM aligned WHERE tau >= -36 AND tau < 0)")
def leak_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = panel.leaks(panel.pre_peak(event_panel(spark, sf_dir), "month_end", "peak", F.col("bubble")))
    return out.agg(F.count(F.lit(1)).alias("n_leaks"))


@query(f"""WITH {_PANEL_SQL}, v AS (SELECT DISTINCT l_suppkey, bubble FROM peaks), s AS (SELECT l_suppkey, bubble, CAST(l_suppkey % 60 AS DOUBLE) AS severity FROM v), t AS (SELECT unnest([30.0, 35.0, 38.0, 40.0, 42.0, 45.0, 50.0])::DOUBLE AS threshold)
    SELECT threshold, count(*) FILTER (WHERE severity >= threshold) AS n_bubbles, count(*) FILTER (WHERE (severity >= threshold) <> bubble) AS n_flipped FROM s, t GROUP BY 1""")
def relabel_by_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_panel(spark, sf_dir).select("l_suppkey", F.col("bubble").cast("int").alias("label")).distinct()
    out = panel.relabel(e, F.col("l_suppkey") % 60, "label", (30, 35, 38, 40, 42, 45, 50))
    return out.groupBy("threshold").agg(F.sum("new_label").alias("n_bubbles"), F.sum(F.col("flipped").cast("int")).alias("n_flipped"))


def cutoffs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("1997-01",), ("1998-06",), ("2000-01",)], "cutoff string")


@query(f"""WITH {_PANEL_SQL}, e AS (SELECT l_suppkey, strftime(peak, '%Y-%m') AS peak_date, CAST(bubble AS INTEGER) AS label FROM peaks), c AS (SELECT unnest(['1997-01', '1998-06', '2000-01']) AS cutoff)
    SELECT * FROM (SELECT cutoff, count(*) FILTER (WHERE peak_date < cutoff AND label = 1) AS train_1, count(*) FILTER (WHERE peak_date < cutoff AND label = 0) AS train_0, count(*) FILTER (WHERE NOT (peak_date < cutoff) AND label = 1) AS test_1, count(*) FILTER (WHERE NOT (peak_date < cutoff) AND label = 0) AS test_0 FROM e, c GROUP BY 1)
    WHERE train_1 >= 2 AND train_0 >= 2 AND test_1 >= 1 AND test_0 >= 1""")
def walk_forward_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_panel(spark, sf_dir).select("l_suppkey", F.date_format("peak", "yyyy-MM").alias("peak_date"), F.col("bubble").cast("int").alias("label")).distinct()
    return panel.enough(panel.walk_forward(e, "peak_date", cutoffs(spark)), ["cutoff"], "is_train", "label")


@query(f"""WITH {_PANEL_SQL}, x AS (SELECT DISTINCT last_day(CAST(o_orderdate AS DATE)) AS month_end, avg(o_totalprice) OVER (PARTITION BY last_day(CAST(o_orderdate AS DATE))) AS v FROM orders WHERE o_orderstatus = 'F')
    SELECT l_suppkey, round(avg(v), 4) AS sentiment, round(avg(CASE WHEN v IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS share_known FROM (SELECT * FROM aligned WHERE tau >= -36 AND tau < 0) LEFT JOIN x USING (month_end) GROUP BY 1 HAVING avg(CASE WHEN v IS NOT NULL THEN 1.0 ELSE 0.0 END) >= 0.5""")
def external_series_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy(F.last_day("o_orderdate").alias("month")).agg(F.avg("o_totalprice").alias("sentiment"))
    out = panel.with_series(panel.pre_peak(event_panel(spark, sf_dir), "month_end", "peak", F.col("bubble")), ["l_suppkey"], "month_end", s, "sentiment")
    return rounded(rounded(out, ["share_known"]), ["sentiment"], 4)


@query(f"""WITH {_PANEL_SQL}, x0 AS (SELECT last_day(CAST(o_orderdate AS DATE)) AS month_end, avg(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
    x AS (SELECT month_end, (v - avg(v) OVER ()) / stddev_samp(v) OVER () AS z FROM x0)
    SELECT l_suppkey, round(avg(z), 5) AS sentiment, round(avg(CASE WHEN z IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS share_known FROM (SELECT * FROM aligned WHERE tau >= -36 AND tau < 0) LEFT JOIN x USING (month_end) GROUP BY 1 HAVING avg(CASE WHEN z IS NOT NULL THEN 1.0 ELSE 0.0 END) >= 0.5""")
def external_series_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As external_series_mean, of the z-scored series."""
    s = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy(F.last_day("o_orderdate").alias("month")).agg(F.avg("o_totalprice").alias("sentiment"))
    out = panel.with_series(panel.pre_peak(event_panel(spark, sf_dir), "month_end", "peak", F.col("bubble")), ["l_suppkey"], "month_end", panel.z_scored(s, "sentiment"), "sentiment")
    return rounded(rounded(out, ["share_known"]), ["sentiment"], 5)


@query("""WITH e AS (SELECT DISTINCT l_suppkey, strftime(l_shipdate, '%Y') || l_returnflag AS episode FROM lineitem WHERE l_discount > 0)
    SELECT l_suppkey, string_agg(episode, '|' ORDER BY episode) AS episodes, CAST(count(*) AS INTEGER) AS n FROM e GROUP BY 1""")
def episodes_of_issuers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An issuer's episodes: the years and flags of its quotes, as a set."""
    quotes = table(spark, sf_dir, "lineitem").where("l_discount > 0").select("l_suppkey", F.concat(F.year("l_shipdate").cast("string"), "l_returnflag").alias("episode"))
    return joins.member_sets(quotes, "l_suppkey", "episode", "episodes").withColumn("episodes", F.array_join("episodes", "|"))


_TAU = "(year({0}) - year(peak)) * 12 + month({0}) - month(peak)"


@query(f"""WITH {_PANEL_SQL}, {_BOND_SQL}, c AS (SELECT l_suppkey, {_TAU.format("month_end")} AS tau, avg(spread) AS spread FROM rolled JOIN peaks USING (l_suppkey) GROUP BY ALL),
    x0 AS (SELECT CAST(substr(source, 4) AS BIGINT) AS l_suppkey, DATE '1996-01-01' + CAST(doc_id % 1000 AS INTEGER) AS d, length(text) AS n FROM documents),
    x AS (SELECT l_suppkey, {_TAU.format("d")} AS tau, avg(n) AS n FROM x0 JOIN peaks USING (l_suppkey) GROUP BY ALL),
    k AS (SELECT l_suppkey, tau FROM aligned UNION SELECT l_suppkey, tau FROM c UNION SELECT l_suppkey, tau FROM x)
    SELECT k.l_suppkey, CAST(k.tau AS INTEGER) AS tau, round(a.realized_vol, 6) AS vol, round(c.spread, 6) AS credit, round(x.n, 6) AS text
    FROM k LEFT JOIN aligned a ON k.l_suppkey = a.l_suppkey AND k.tau = a.tau LEFT JOIN c ON k.l_suppkey = c.l_suppkey AND k.tau = c.tau LEFT JOIN x ON k.l_suppkey = x.l_suppkey AND k.tau = x.tau WHERE k.tau BETWEEN -36 AND 24""")
def multi_channel_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_panel(spark, sf_dir)
    peaks = e.select("l_suppkey", "peak").distinct()
    tau = lambda d: dates.event_month(F.col(d), F.col("peak")).alias("tau")
    vol = e.select("l_suppkey", tau("month_end"), F.col("realized_vol").alias("vol"))
    spread = _bonds(spark, sf_dir).join(peaks, "l_suppkey").groupBy("l_suppkey", tau("month_end")).agg(F.avg("spread").alias("credit"))
    docs = table(spark, sf_dir, "documents").select(F.substring("source", 4, 9).cast("bigint").alias("l_suppkey"), F.date_add(F.lit("1996-01-01").cast("date"), (F.col("doc_id") % 1000).cast("int")).alias("d"), F.length("text").alias("n"))
    text = docs.join(peaks, "l_suppkey").groupBy("l_suppkey", tau("d")).agg(F.avg("n").alias("text"))
    return rounded(panel.multi_channel([vol, spread, text], ["l_suppkey"]), ["vol", "credit", "text"])


_A_SQL = """sv AS (SELECT sector, month_end, median(realized_vol) AS sector_vol FROM months JOIN {sector} USING (l_suppkey) GROUP BY 1, 2),
    mkt AS (SELECT d, avg(ret) AS ret FROM daily GROUP BY 1), mv AS (SELECT last_day(d) AS month_end, CASE WHEN count(*) >= 15 THEN stddev_samp(ret) * sqrt(252.0) END AS market_vol FROM mkt GROUP BY 1),
    ma AS (SELECT sector, month_end, CASE WHEN market_vol <> 0 THEN sector_vol / market_vol END AS metric_a FROM sv LEFT JOIN mv USING (month_end))""".format(sector=SECTOR_SQL)


def _b_sql(source: str, keys: str, name: str) -> str:
    """Metric B of the rows of ``source`` within ``keys``, as table ``name``."""
    k = [x.strip() for x in keys.split(",")]
    same = " AND ".join(f"a.{x} = b.{x}" for x in k)
    return f"""o AS (SELECT * FROM {source} WHERE leverage IS NOT NULL AND asset_vol IS NOT NULL),
    h AS (SELECT {", ".join(f"a.{x}" for x in k)}, a.month_end, count(*) AS n, avg(b.leverage) AS mx, avg(b.asset_vol) AS my, covar_pop(b.asset_vol, b.leverage) * count(*) AS sxy, greatest(var_pop(b.leverage) * count(*), 1e-6) AS sxx, max(b.leverage) - min(b.leverage) AS span
          FROM (SELECT DISTINCT {keys}, month_end FROM o) a JOIN o b ON {same} AND b.month_end <= a.month_end GROUP BY ALL),
    line AS (SELECT {keys}, month_end, CASE WHEN n >= 10 THEN CASE WHEN span < 0.10 THEN 0 ELSE greatest(least(sxy / sxx, 5.0), -5.0) END END AS b, mx, my FROM h),
    {name} AS (SELECT {keys}, month_end, median(asset_vol - (my - b * mx) - b * leverage) AS metric_b FROM o JOIN line USING ({keys}, month_end) GROUP BY ALL)"""


@query(f"""WITH {LEVERAGED_SQL}, {_A_SQL}, {_b_sql("lev", "sector", "mb")},
    s AS (SELECT sector, month_end, median(leverage) AS med_leverage, median(asset_vol) AS metric_d, median(realized_vol) AS v FROM lev GROUP BY 1, 2),
    md AS (SELECT sector, month_end, metric_d, med_leverage, med_leverage - lag(med_leverage, 12) OVER (PARTITION BY sector ORDER BY month_end) AS metric_f, coalesce(v, 0) * coalesce(med_leverage, 0) AS metric_v FROM s),
    k AS (SELECT sector, month_end FROM ma UNION SELECT sector, month_end FROM mb UNION SELECT sector, month_end FROM md)
    SELECT sector, month_end, round(metric_a, 6) AS metric_a, round(metric_b, 5) AS metric_b, round(metric_d, 5) AS metric_d, round(metric_f, 5) AS metric_f, round(med_leverage, 5) AS med_leverage, round(metric_v, 5) AS metric_v
    FROM k LEFT JOIN ma USING (sector, month_end) LEFT JOIN mb USING (sector, month_end) LEFT JOIN md USING (sector, month_end)""")
def sector_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sectors' metrics side by side, a row a sector and month: one grouping of their union."""
    every = firm_table(spark, sf_dir)
    lev = settled(leveraged(spark, sf_dir, every))
    a = _metric_a(known_months(every), spark, sf_dir).select("sector", "month_end", "metric_a")
    b = V.expanding_gap(lev, "sector", "month_end", "leverage", "asset_vol")
    d = lev.groupBy("sector", "month_end").agg(F.median("leverage").alias("med_leverage"), F.median("asset_vol").alias("metric_d"), F.median("realized_vol").alias("_v"))
    d = V.difference(d, ["sector"], "month_end", "med_leverage", "metric_f").withColumn("metric_v", numbers.interactions(F.col("_v"), F.col("metric_d"), F.col("med_leverage"))["metric_v"]).drop("_v")
    return rounded(joins.assemble([a, b, d], ["sector", "month_end"]), ["metric_b", "metric_d", "metric_f", "med_leverage", "metric_v"], 5)


@query(f"""WITH {MONTHS_SQL}, {_DEBT}, {_A_SQL},
    lags AS (SELECT unnest([0, 30, 60, 90]) AS lag_days),
    moved AS (SELECT l_suppkey, lag_days, last_day(CAST(month_end + lag_days * INTERVAL 1 DAY AS DATE)) AS month_end, max_by(total_debt, month_end) AS total_debt FROM debt, lags GROUP BY ALL),
    {_GRID.format(lag="lag_days, ", plag=", lag_days")},
    lev0 AS (SELECT sector, lag_days, month_end, realized_vol, {_LEV} AS leverage FROM (SELECT * FROM months, lags) LEFT JOIN filled USING (l_suppkey, lag_days, month_end) JOIN {SECTOR_SQL} USING (l_suppkey)),
    lev AS (SELECT *, realized_vol * (1 - leverage) AS asset_vol FROM lev0), {_b_sql("lev", "lag_days, sector", "mb")},
    s AS (SELECT lag_days, sector, month_end, median(leverage) AS m FROM lev GROUP BY ALL),
    mf AS (SELECT lag_days, sector, month_end, m - lag(m, 12) OVER (PARTITION BY lag_days, sector ORDER BY month_end) AS metric_f FROM s)
    SELECT CAST(lag_days AS INTEGER) AS lag_days, sector, month_end, round(metric_a, 6) AS metric_a, round(metric_b, 5) AS metric_b, round(metric_f, 5) AS metric_f
    FROM ma JOIN lags ON true LEFT JOIN mb USING (lag_days, sector, month_end) LEFT JOIN mf USING (lag_days, sector, month_end)""")
def panel_with_lagged_fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel's B and F built again on reports that become known 0 to 90 days later, and put in place of its own."""
    lags = F.explode(F.array(*[F.lit(x) for x in (0, 30, 60, 90)]))
    every = firm_table(spark, sf_dir)
    own = _metric_a(known_months(every), spark, sf_dir).select("sector", "month_end", "metric_a").withColumn("lag_days", lags)
    lev = with_sector(_lagged_leverage(every).withColumn("asset_vol", F.col("realized_vol") * (1 - F.col("leverage"))), spark, sf_dir)
    lev = settled(lev.select("lag_days", "sector", "month_end", "leverage", "asset_vol"))
    keys = F.struct("lag_days", "sector").alias("_g")
    b = V.expanding_gap(lev.select("*", keys), "_g", "month_end", "leverage", "asset_vol").select("_g.*", "month_end", "metric_b")
    f = lev.groupBy("lag_days", "sector", "month_end").agg(F.median("leverage").alias("_m"))
    f = V.difference(f, ["lag_days", "sector"], "month_end", "_m", "metric_f").drop("_m")
    at = ["lag_days", "sector", "month_end"]
    return rounded(own.join(b, at, "left").join(f, at, "left"), ["metric_b", "metric_f"], 5)


@query("""WITH d AS (SELECT l_suppkey, sum(l_extendedprice) FILTER (WHERE l_returnflag = 'R' AND l_quantity > 49) AS short, sum(l_extendedprice) FILTER (WHERE l_returnflag = 'N' AND l_quantity < 2) AS long FROM lineitem GROUP BY 1)
    SELECT s_suppkey, lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS cik, substr(s_name, 1, 6) AS issuer, round(coalesce(short, 0) + coalesce(long, 0), 1) AS total_debt FROM supplier LEFT JOIN d ON s_suppkey = l_suppkey""")
def ids_and_total_debt(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda cond: F.sum(F.when(F.expr(cond), F.col("l_extendedprice")))
    d = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(part("l_returnflag = 'R' AND l_quantity > 49").alias("short"), part("l_returnflag = 'N' AND l_quantity < 2").alias("long"))
    s = table(spark, sf_dir, "supplier").join(d, "s_suppkey", "left")
    return s.select("s_suppkey", numbers.digits_id(F.col("s_suppkey")).alias("cik"), numbers.issuer_id(F.col("s_name")).alias("issuer"), F.round(numbers.total_debt(F.col("short"), F.col("long")), 1).alias("total_debt"))


@query("""SELECT c_custkey, max(l_suppkey) AS supplier FROM customer LEFT JOIN (SELECT o_custkey, o_orderkey FROM orders) ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def last_supplier_through_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer to order to supplier; of several suppliers the last one wins."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    return joins.through_bridge(table(spark, sf_dir, "customer").select("c_custkey"), [(orders, "o_custkey", "o_orderkey"), (lines, "l_orderkey", "l_suppkey")], "c_custkey", "supplier")


@query("""SELECT o_orderpriority, count(*) AS n_rows, round(avg(CASE WHEN o_totalprice > 100000 THEN 1.0 ELSE 0.0 END), 6) AS share_large, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END), 6) AS share_final FROM orders GROUP BY 1""")
def coverage_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("large", F.when(F.col("o_totalprice") > 100000, 1)).withColumn("final", F.when(F.col("o_orderstatus") == "F", 1))
    return rounded(joins.coverage(o, ["o_orderpriority"], ["large", "final"]), ["share_large", "share_final"])


@query("""SELECT user_id, ts, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC NULLS LAST, event_id) AS k FROM events) WHERE k = 1""")
def best_event_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = joins.best_row(table(spark, sf_dir, "events"), ["user_id"], [F.desc_nulls_last("value"), F.asc("event_id")])
    return e.select("user_id", "ts", "event_id", "event_type")


@query("""SELECT o_orderkey, s.s_suppkey AS supplier, coalesce(CAST(p.p_partkey AS VARCHAR), 'none') AS code
    FROM orders o LEFT JOIN (SELECT s_nationkey, min(s_suppkey) AS s_suppkey FROM supplier GROUP BY 1) s ON o.o_custkey % 30 = s.s_nationkey LEFT JOIN (SELECT p_size, min(p_partkey) AS p_partkey FROM part GROUP BY 1) p ON o.o_custkey % 70 = p.p_size""")
def lookups_with_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 30).alias("k1"), (F.col("o_custkey") % 70).alias("k2"))
    out = joins.lookup(o, table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k1"), F.col("s_suppkey").alias("supplier")), "k1", "supplier")
    primary = table(spark, sf_dir, "part").select(F.col("p_size").alias("k2"), F.col("p_partkey").alias("part"))
    out = joins.lookup(out, primary, "k2", "part")
    return out.select("o_orderkey", "supplier", F.coalesce(F.col("part").cast("string"), F.lit("none")).alias("code"))


@query("""WITH a AS (SELECT n_nationkey AS k, CAST(n_name AS VARCHAR) AS v FROM nation WHERE n_nationkey % 2 = 0), b AS (SELECT n_nationkey AS k, lower(n_name) AS v FROM nation WHERE n_nationkey % 3 = 0)
    SELECT c_custkey, coalesce(a.v, b.v) AS code FROM customer LEFT JOIN a ON c_nationkey = a.k LEFT JOIN b ON c_nationkey = b.k""")
def lookup_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    first = n.where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("code"))
    second = n.where("n_nationkey % 3 = 0").select(F.col("n_nationkey").alias("k"), F.lower("n_name").alias("code"))
    return joins.first_of(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("k")), [first, second], "k", "code").drop("k")


@query("""WITH s AS (SELECT l_suppkey, min(CAST(l_shipdate AS DATE)) AS a, max(CAST(l_shipdate AS DATE)) AS b FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
    t AS (SELECT l_suppkey, l_linenumber, min(CAST(l_shipdate AS DATE)) AS c, max(CAST(l_shipdate AS DATE)) AS d FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1, 2)
    SELECT s.l_suppkey, l_linenumber, a, b, c, d, date_diff('day', c, d) AS span FROM s JOIN t ON s.l_suppkey = t.l_suppkey AND a <= d AND c <= b""")
def overlapping_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("x", F.to_date("l_shipdate"))
    s = li.where("l_returnflag = 'R'").groupBy("l_suppkey").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    t = li.where("l_returnflag = 'N'").groupBy("l_suppkey", "l_linenumber").agg(F.min("x").alias("c"), F.max("x").alias("d"))
    return joins.overlapping(s, t, "l_suppkey", ("a", "b"), ("c", "d")).withColumn("span", F.datediff("d", "c").cast("bigint"))


@query("""SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)) """)
def linked_through_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    bridge = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("l_orderkey"))
    chosen = table(spark, sf_dir, "lineitem").where("l_quantity > 49")
    return joins.linked_to(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), bridge, chosen, "c_custkey", "l_orderkey")


@query("""SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'""")
def keys_not_yet_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.where("o_orderpriority = '1-URGENT'").select("o_custkey").distinct().join(o.where("o_orderstatus = 'F'").select("o_custkey"), "o_custkey", "left_anti")


@query("""SELECT c_custkey AS key, c_nationkey AS nation, CAST(NULL AS DOUBLE) AS acctbal, 'c' AS kind FROM customer UNION ALL SELECT s_suppkey, s_nationkey, round(s_acctbal, 4), 's' FROM supplier""")
def union_with_missing_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("nation"), F.lit("c").alias("kind"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("nation"), F.round("s_acctbal", 4).alias("acctbal"), F.lit("s").alias("kind"))
    return joins.union_rows(s, c).select("key", "nation", "acctbal", "kind")


@query("""SELECT s_suppkey, CASE WHEN s_nationkey % 4 = 0 THEN 'mania' ELSE 'leverage' END AS regime, round(s_acctbal, 4) AS bal, CAST(s_nationkey % 4 = 0 AS INTEGER) AS regime_flag, round(s_acctbal * CAST(s_nationkey % 4 = 0 AS INTEGER), 4) AS bal_x_regime FROM supplier""")
def regime_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    category = F.element_at(F.array(*[F.lit(x) for x in ("mania", "capex", "financial", "commodity")]), (F.col("s_nationkey") % 4 + 1).cast("int"))
    regime = numbers.mapped(category, {"mania": "mania", "capex": "leverage", "financial": "leverage", "commodity": "leverage"})
    s = table(spark, sf_dir, "supplier").select("s_suppkey", regime.alias("regime"), F.col("s_acctbal").alias("bal"))
    out = s.select("s_suppkey", "regime", *[c.alias(k) for k, c in numbers.with_regime(["bal"], (F.col("regime") == "mania").cast("int")).items()])
    return rounded(out, ["bal", "bal_x_regime"], 4)


@query("""SELECT s_suppkey, make_date(greatest(1994 + s_suppkey % 5 - 3, 1993), 1, 1) AS window_start, make_date(least(1999 + s_suppkey % 7 + 2, 2004), 12, 31) AS window_end FROM supplier""")
def episode_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    w = dates.episode_window((1994 + k % 5).cast("int"), F.lit(None).cast("int"), (1999 + k % 7).cast("int"), cap=2004)
    return table(spark, sf_dir, "supplier").select("s_suppkey", *[c.alias(n) for n, c in w.items()])


@query("""WITH f AS (SELECT source, list({'form': form, 'd': d, 'n': doc_id} ORDER BY doc_id) AS x FROM (SELECT source, doc_id, CASE WHEN doc_id % 3 = 0 THEN '10-K' WHEN doc_id % 3 = 1 THEN '10-Q' ELSE '8-K' END AS form, strftime(DATE '2020-01-01' + CAST(doc_id % 1000 AS INTEGER), '%Y-%m-%d') AS d FROM documents) GROUP BY 1),
    r AS (SELECT source AS cik, unnest(x) AS u FROM f)
    SELECT cik, u.form AS form, u.d AS "filingDate", CAST(u.n AS VARCHAR) AS "accessionNumber", CAST(u.n AS VARCHAR) AS accession FROM r WHERE u.form IN ('10-K', '10-Q') AND u.d BETWEEN '2020-02-01' AND '2021-12-31'""")
def filing_index_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columnar JSON per source, made from documents, and back to rows."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id", F.element_at(F.array(F.lit("10-K"), F.lit("10-Q"), F.lit("8-K")), (F.col("doc_id") % 3 + 1).cast("int")).alias("form"), F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") % 1000).cast("int")), "yyyy-MM-dd").alias("fd"))
    part = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "form", "fd"))), c)
    recent = F.struct(part(lambda s: s["form"]).alias("form"), part(lambda s: s["fd"]).alias("filingDate"), part(lambda s: s["doc_id"].cast("string")).alias("accessionNumber"), part(lambda s: s["doc_id"].cast("string")).alias("primaryDocument"))
    raw = d.groupBy(F.col("source").alias("cik")).agg(F.to_json(F.struct(F.struct(recent.alias("recent")).alias("filings"))).alias("json"))
    out = S.filing_index(S.filing_rows(raw, "json", ["cik"]), ["10-K", "10-Q"], "2020-02-01", "2021-12-31")
    return out.select("cik", "form", "filingDate", "accessionNumber", "accession")


@query("""SELECT l_suppkey, count(*) AS n FROM lineitem WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 5) GROUP BY 1""")
def scan_of_keys_and_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", F.to_date("l_shipdate").alias("d"))
    keys = table(spark, sf_dir, "supplier").where("s_nationkey < 5").select(F.col("s_suppkey").alias("l_suppkey"))
    return S.scan_keys(li, keys, "l_suppkey", "d", "1996-01-01", "1996-12-31").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT user_id, event_id, value FROM (SELECT user_id, event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), 6) AS value FROM events)""")
def trailing_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.struct("ts", "event_id").alias("at"), "value")
    return rounded(V.trailing_mean(e, "user_id", "at", ["value"]).drop("at"), ["value"])
