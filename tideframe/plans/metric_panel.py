"""The panel that a user of the metrics starts from: a row a sector and month, one column a metric. The daily table behind it
is made once, so lineitem is read once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numbers
from ..operators import joins, texts
from ..operators import volatility as V
from ..operators.splits import settled
from . import model_queries as MQ
from . import panel_queries as PQ
from . import text_queries as TQ
from .roles import SECTOR_SQL, daily, every_month, known_months, reported, rounded, table, with_sector

QUERIES: dict = {}
SQL: dict[str, str] = {}
KEYS = ["sector", "month_end"]
METRICS = [*[f"metric_{c}" for c in "abcdefghijklmnopqrsuvwx"], "metric_r_spread"]
#: Thresholds of the correlation of a sector's suppliers, which trade on some seven days a month.
CORR = {"days": 100, "window": 63, "least": 10, "least_firms": 3}


def firms(every: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known firm-months with sector, leverage, asset_vol, vol_of_vol and assets."""
    months = V.rolling_std(known_months(every), "l_suppkey", "month_end", "realized_vol", "vol_of_vol")
    out = with_sector(joins.firm_leverage(months, reported(every), "l_suppkey", "total_debt", "datadate", "market_cap"), spark, sf_dir)
    return out.withColumn("asset_vol", F.col("realized_vol") * (1 - F.col("leverage"))).withColumn("assets", F.col("total_debt") + F.col("market_cap"))


#: Phrases counted in filings, and the columns that the metrics of filings are medians of.
PHRASES = {"offbalance": TQ._PHRASES["offbalance"], "risk_escalation": TQ._PHRASES["covenant"], "growth_narrative": TQ._PHRASES["growth"]}
FILED = {"metric_g": "net_sentiment", "metric_h": "uncertainty_pct", "metric_i": "fog_index", "metric_j": "offbalance_per10k", "metric_k": "risk_escalation_per10k", "metric_l": "growth_narrative_per10k", "metric_n": "negativity_ratio"}
#: Counted rows up to which a table of keys goes to every task.
FEW = 200_000


def last_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, l_suppkey, sector, d and n_words of each supplier's last filing of a quarter. Texts are read once."""
    n = F.regexp_count(F.col("text"), F.lit("[a-zA-Z]+")).cast("double").alias("n_words")
    f = settled(texts.scoreable(table(spark, sf_dir, "documents"), "text", least_words=0).select("doc_id", F.substring("source", 4, 9).cast("bigint").alias("l_suppkey"), F.date_add(F.lit("1996-01-01").cast("date"), (F.col("doc_id") % 1000).cast("int")).alias("d"), n)).where("n_words >= 200")
    last = joins.best_row(f.withColumn("_q", F.trunc("d", "quarter")), ["l_suppkey", "_q"], [F.desc("d"), F.desc("doc_id")])
    return settled(with_sector(last.drop("_q"), spark, sf_dir))


def filing_scores(last: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last filings with the scores behind metrics G to L and N: only their texts are taken apart."""
    keys = last.select("doc_id")
    own = settled(table(spark, sf_dir, "documents").select("doc_id", "text").join(F.broadcast(keys) if keys.count() <= FEW else keys, "doc_id"))
    words = texts.category_scores(own, "doc_id", "text", TQ.dictionary(spark), list(TQ.WORDS)).withColumns(texts.sentiment("negative_count", "positive_count", "word_count"))
    parts = (words, texts.readability(own, "doc_id", "text"), texts.phrase_scores(own, "doc_id", "text", PHRASES))
    return joins.assemble([last, *[p.select("doc_id", *[c for c in FILED.values() if c in p.columns]) for p in parts]], ["doc_id"])


def filing_metrics(spark: SparkSession, sf_dir: str, scored: bool = False) -> DataFrame:
    """Metric M, the 12-row change of the median length of a sector's last filings of a quarter, by month; if ``scored``, the
    medians G to L and N as well."""
    last, more = last_filings(spark, sf_dir), FILED if scored else {}
    f = filing_scores(last, spark, sf_dir) if scored else last
    q = settled(joins.quarter_medians(f, "l_suppkey", "sector", "d", ["n_words", *more.values()], ["doc_id"]))
    m = joins.to_months(q, ["sector"], "stamp", ["n_words", *more.values()], 3)
    return V.pct_change(m, ["sector"], "month_end", "n_words", "metric_m").select(*KEYS, "metric_m", *[F.col(c).alias(k) for k, c in more.items()])


def parts(days: DataFrame, own: DataFrame, spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The metrics of the daily table and of every firm-month, a frame each."""
    market = V.market_vol(days.groupBy("d").agg(F.avg("ret").alias("ret")), "d", "ret")
    medians = own.groupBy(*KEYS).agg(*[F.median(c).alias(n) for c, n in (("realized_vol", "sector_vol"), ("leverage", "med_leverage"), ("asset_vol", "_asset"), ("vol_of_vol", "metric_d"), ("assets", "_assets"))])
    one = V.relative_vol(medians, market)
    one = V.pct_change(V.difference(one, ["sector"], "month_end", "med_leverage", "metric_f"), ["sector"], "month_end", "_assets", "metric_e")
    one = one.withColumns(numbers.interactions(F.col("sector_vol"), F.col("_asset"), F.col("med_leverage")))
    one = one.select(*KEYS, "sector_vol", "market_vol", "med_leverage", "metric_a", "metric_d", "metric_e", "metric_f", "metric_u", "metric_v", "metric_w", "metric_x")
    b = V.expanding_gap(own, "sector", "month_end", "leverage", "asset_vol")
    c = V.pairwise_correlation(with_sector(days, spark, sf_dir), "sector", "l_suppkey", "d", "ret", **CORR).withColumnRenamed("n_firms", "n_firms_corr")
    return [one, b, c]


def _rounded(df: DataFrame) -> DataFrame:
    return rounded(df, [c for c in df.columns if c.startswith("metric_") or c in ("sector_vol", "market_vol", "med_leverage")], 5)


_SQL = f"""WITH {PQ.LEVERAGED_SQL}, {PQ._b_sql("lev", "sector", "mb")},
    vv AS (SELECT l_suppkey, month_end, CASE WHEN count(realized_vol) OVER w >= 3 THEN stddev_samp(realized_vol) OVER w END AS vol_of_vol FROM months WINDOW w AS (PARTITION BY l_suppkey ORDER BY month_end ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)),
    own AS (SELECT lev.*, vol_of_vol, total_debt + market_cap AS assets FROM lev JOIN vv USING (l_suppkey, month_end) LEFT JOIN (SELECT l_suppkey, month_end, total_debt FROM filled) USING (l_suppkey, month_end)),
    mkt AS (SELECT d, avg(ret) AS ret FROM daily GROUP BY 1), mv AS (SELECT last_day(d) AS month_end, CASE WHEN count(*) >= 15 THEN stddev_samp(ret) * sqrt(252.0) END AS market_vol FROM mkt GROUP BY 1),
    s AS (SELECT sector, month_end, median(realized_vol) AS sector_vol, median(leverage) AS med_leverage, median(asset_vol) AS asset, median(vol_of_vol) AS metric_d, median(assets) AS assets FROM own GROUP BY 1, 2),
    p AS (SELECT *, last_value(assets IGNORE NULLS) OVER (PARTITION BY sector ORDER BY month_end ROWS UNBOUNDED PRECEDING) AS padded FROM s),
    one AS (SELECT sector, month_end, sector_vol, market_vol, med_leverage, metric_d, CASE WHEN market_vol <> 0 THEN sector_vol / market_vol END AS metric_a, med_leverage - lag(med_leverage, 12) OVER k AS metric_f, padded / nullif(lag(padded, 12) OVER k, 0) - 1 AS metric_e,
            coalesce(med_leverage, 0) AS metric_u, coalesce(sector_vol, 0) * coalesce(med_leverage, 0) AS metric_v, coalesce(sector_vol, 0) * (1 - coalesce(med_leverage, 0)) AS metric_w, coalesce(asset, 0) * coalesce(med_leverage, 0) AS metric_x
            FROM p LEFT JOIN mv USING (month_end) WINDOW k AS (PARTITION BY sector ORDER BY month_end)),
    r AS (SELECT sector, l_suppkey, d, ret FROM daily JOIN {SECTOR_SQL} USING (l_suppkey) WHERE ret IS NOT NULL),
    ends AS (SELECT DISTINCT sector, last_day(d) AS month_end FROM r),
    served AS (SELECT ends.sector, month_end, l_suppkey, d, ret, row_number() OVER (PARTITION BY ends.sector, month_end, l_suppkey ORDER BY d DESC) AS back FROM ends JOIN r ON r.sector = ends.sector AND d <= month_end AND d >= month_end - INTERVAL {CORR["days"]} DAY),
    counted AS (SELECT *, count(*) OVER (PARTITION BY sector, month_end, l_suppkey) AS n FROM served WHERE back <= {CORR["window"]}), kept AS (SELECT * FROM counted WHERE n >= {CORR["least"]}),
    pair AS (SELECT x.sector, x.month_end, corr(x.ret, y.ret) AS c FROM kept x JOIN kept y ON x.sector = y.sector AND x.month_end = y.month_end AND x.d = y.d AND x.l_suppkey < y.l_suppkey GROUP BY x.sector, x.month_end, x.l_suppkey, y.l_suppkey),
    c AS (SELECT sector, month_end, CASE WHEN n >= {CORR["least_firms"]} THEN m END AS metric_c, n AS n_firms_corr FROM (SELECT sector, month_end, count(DISTINCT l_suppkey) AS n FROM kept GROUP BY 1, 2) LEFT JOIN (SELECT sector, month_end, avg(CASE WHEN NOT isnan(c) THEN c END) AS m FROM pair GROUP BY 1, 2) USING (sector, month_end)),
    w AS (SELECT doc_id, CAST(substr(source, 4) AS BIGINT) AS l_suppkey, DATE '1996-01-01' + CAST(doc_id % 1000 AS INTEGER) AS d, CAST(len(regexp_extract_all(text, '[a-zA-Z]+')) AS DOUBLE) AS n FROM documents WHERE length(text) >= 1000),
    q0 AS (SELECT sector, l_suppkey, date_trunc('quarter', d) AS q, n, row_number() OVER (PARTITION BY l_suppkey, date_trunc('quarter', d) ORDER BY d DESC, doc_id DESC) AS k FROM w JOIN {SECTOR_SQL} USING (l_suppkey) WHERE n >= 200),
    q AS (SELECT sector, last_day(CAST(q + INTERVAL 2 MONTH AS DATE)) AS month_end, median(n) AS n FROM q0 WHERE k = 1 GROUP BY 1, 2),
    qspan AS (SELECT sector, min(month_end) AS a, max(month_end) + INTERVAL 3 MONTH AS b FROM q GROUP BY 1),
    qgrid AS (SELECT sector, last_day(CAST(u AS DATE)) AS month_end FROM qspan, unnest(generate_series(date_trunc('month', a), date_trunc('month', b), INTERVAL 1 MONTH)) AS g(u) WHERE last_day(CAST(u AS DATE)) <= b),
    qfull AS (SELECT sector, month_end, last_value(n IGNORE NULLS) OVER (PARTITION BY sector ORDER BY month_end ROWS UNBOUNDED PRECEDING) AS n FROM qgrid LEFT JOIN q USING (sector, month_end)),
    m AS (SELECT sector, month_end, n / nullif(lag(n, 12) OVER (PARTITION BY sector ORDER BY month_end), 0) - 1 AS metric_m FROM qfull),
    every AS (SELECT sector, month_end FROM one UNION SELECT sector, month_end FROM mb UNION SELECT sector, month_end FROM c UNION SELECT sector, month_end FROM m)
    SELECT sector, month_end, {", ".join(f"round({x}, 5) AS {x}" for x in ("sector_vol", "market_vol", "med_leverage", *(f"metric_{k}" for k in "adefuvwxbcm")))}, n_firms_corr
    FROM every LEFT JOIN one USING (sector, month_end) LEFT JOIN mb USING (sector, month_end) LEFT JOIN c USING (sector, month_end) LEFT JOIN m USING (sector, month_end)"""


def metric_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics A to F, M and U to X by sector and month."""
    days = settled(daily(spark, sf_dir))
    own = settled(firms(settled(every_month(days)), spark, sf_dir))
    return _rounded(joins.assemble([*parts(days, own, spark, sf_dir), filing_metrics(spark, sf_dir)], KEYS))


def whole_metric_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metrics, A to X (there is no T), the number of issuers behind O to Q, and for each metric the share of the sector's
    months that it is known in."""
    days = settled(daily(spark, sf_dir))
    own = settled(firms(settled(every_month(days)), spark, sf_dir))
    credit = PQ.sector_credit_implied_vol(spark, sf_dir, own).withColumnRenamed("n_issuers", "n_firms_civ")
    frames = [*parts(days, own, spark, sf_dir), filing_metrics(spark, sf_dir, True), credit, MQ.text_implied_volatility(spark, sf_dir, own)]
    out = _rounded(joins.assemble(frames, KEYS))
    known = lambda c: F.avg(F.col(c).isNotNull().cast("double")).over(Window.partitionBy("sector"))
    return rounded(out.withColumns({f"share_{c}": known(c) for c in METRICS}), [f"share_{c}" for c in METRICS])


QUERIES["metric_panel"], SQL["metric_panel"] = metric_panel, _SQL
QUERIES["whole_metric_panel"] = whole_metric_panel
