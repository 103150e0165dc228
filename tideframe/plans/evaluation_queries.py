"""Resamples and rank statistics on labelled documents. A document's scores are simple text measures; its regime is its
language, its stratum label and regime."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.draws import draw_unit
from ..operators import evaluation as E
from ..operators import panel
from ..operators import splits as R
from . import panel_queries as PQ
from .roles import rounded, table, with_sector

QUERIES: dict = {}
SQL: dict[str, str] = {}
N = 50


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, label, regime, stratum, s1 (characters), s2 (share of symbols), s3 (lines), category."""
    # texts are measured before they meet labels, so that they stay where they are however many labels there are
    gone = lambda c: F.length("text") - F.length(F.replace("text", F.lit(c), F.lit("")))
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.length("text").alias("_n"), F.regexp_count(F.col("text"), F.lit("[#*$%&!]")).alias("_s"), gone("\n").alias("_l"))
    out = d.join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")
    regime = F.when(F.col("lang") == "en", "leverage").otherwise("mania")
    return out.select(
        "doc_id",
        F.col("label").cast("int").alias("label"),
        regime.alias("regime"),
        F.concat_ws("/", F.col("label").cast("string"), regime).alias("stratum"),
        F.col("_n").cast("double").alias("s1"),
        (-F.col("_s") / F.col("_n")).alias("s2"),
        (1.0 + F.col("_l")).alias("s3"),
        (F.col("doc_id") % 7).alias("cluster"),
    )


UNITS_SQL = """units AS (SELECT d.doc_id, CAST(quality AS INTEGER) AS label, CASE WHEN lang = 'en' THEN 'leverage' ELSE 'mania' END AS regime, CAST(quality AS VARCHAR) || '/' || CASE WHEN lang = 'en' THEN 'leverage' ELSE 'mania' END AS stratum,
    CAST(length(text) AS DOUBLE) AS s1, -(length(text) - length(translate(text, '#*$%&!', ''))) / length(text) AS s2, 1.0 + length(text) - length(replace(text, chr(10), '')) AS s3, d.doc_id % 7 AS cluster FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""
SPLITS_SQL = f"""{UNITS_SQL}, k0 AS (SELECT s AS split, units.*, row_number() OVER (PARTITION BY s, stratum ORDER BY md5('42|' || s || '|' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY s, stratum) AS n FROM units, (SELECT unnest(range(0, {N})) AS s)),
    k AS (SELECT *, r <= greatest(1, round_even(n * 0.2, 0)) AS held FROM k0)"""


def splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = units(spark, sf_dir)
    return R.stratified_holdouts(u, "doc_id", "stratum", N, more=[c for c in u.columns if c not in ("doc_id", "stratum")])


def held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits(spark, sf_dir).where("held")


@query(f"WITH {SPLITS_SQL} SELECT split, doc_id, stratum, held FROM k WHERE held")
def stratified_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return held_out(spark, sf_dir).select("split", "doc_id", "stratum", "held")


@query(f"WITH {SPLITS_SQL}, s AS (SELECT split, list(doc_id ORDER BY doc_id) AS l FROM k WHERE held GROUP BY 1), f AS (SELECT min(split) AS split FROM s GROUP BY l) SELECT split, count(*) FILTER (WHERE held) AS n_held, count(*) AS n FROM k WHERE split IN (SELECT split FROM f) GROUP BY 1")
def unique_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.distinct_splits(R.stratified_holdouts(units(spark, sf_dir), "doc_id", "stratum", N), "doc_id")
    return out.groupBy("split").agg(F.sum(F.col("held").cast("int")).alias("n_held"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {UNITS_SQL}, r AS (SELECT s AS split, doc_id, label, row_number() OVER (PARTITION BY s, label ORDER BY md5('42|' || s || '|' || doc_id), doc_id) AS r FROM units, (SELECT unnest(range(0, 20)) AS s)) SELECT split, doc_id, label FROM r WHERE r <= CASE WHEN label = 1 THEN 5 ELSE 3 END")
def fixed_count_holdouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.fixed_holdouts(units(spark, sf_dir), "doc_id", "label", 20).where("held").select("split", "doc_id", "label")


@query(f"WITH {UNITS_SQL}, c AS (SELECT cluster, avg(label) AS y FROM units GROUP BY 1) SELECT a.cluster AS fold, count(*) AS n_train, round(avg(b.y), 6) AS train_rate FROM c a JOIN c b ON a.cluster <> b.cluster GROUP BY 1")
def leave_one_group_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = units(spark, sf_dir).groupBy("cluster").agg(F.avg("label").alias("y"))
    out = R.leave_one_out(c, "cluster").where("train").groupBy("fold").agg(F.count(F.lit(1)).alias("n_train"), F.avg("y").alias("train_rate"))
    return rounded(out, ["train_rate"])


def _auc_sql(rows: str, keys: str, score: str = "score", name: str = "auc", least: int = 4) -> str:
    part = f"PARTITION BY {keys}, " if keys else "PARTITION BY "
    over = f"PARTITION BY {keys} " if keys else ""
    return f"""SELECT {keys + ", " if keys else ""}round(CASE WHEN n >= {least} AND p > 0 AND n > p THEN (s - p * (p + 1) / 2) / (p * (n - p)) END, 6) AS {name}, n
      FROM (SELECT {keys + ", " if keys else ""}sum(r * label) AS s, sum(label) AS p, count(*) AS n FROM (SELECT *, rank() OVER ({over}ORDER BY {score}) + (count(*) OVER ({part}{score}) - 1) / 2 AS r FROM {rows}) GROUP BY {keys or "1 = 1"})"""


@query(f"WITH {SPLITS_SQL}, h AS (SELECT split, label, s1 AS score FROM k WHERE held) {_auc_sql('h', 'split')}")
def auc_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.auc(held_out(spark, sf_dir), ["split"], "s1", "label"), ["auc"])


@query(f"WITH {SPLITS_SQL}, h AS (SELECT split, regime, label, s1 AS score FROM k WHERE held) {_auc_sql('h', 'split, regime')}")
def auc_by_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.auc(held_out(spark, sf_dir), ["split", "regime"], "s1", "label"), ["auc"])


@query(f"WITH {SPLITS_SQL}, h AS (SELECT split, cluster, max(label) AS label, avg(s2) AS score FROM k WHERE held GROUP BY 1, 2) {_auc_sql('h', 'split')}")
def auc_of_group_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.group_auc(held_out(spark, sf_dir), ["split"], "cluster", "s2", "label"), ["auc"])


@query(f"WITH {SPLITS_SQL}, h AS (SELECT split, 's' || i AS metric, label, CASE i WHEN 1 THEN s1 WHEN 2 THEN s2 ELSE s3 END AS score FROM k, (SELECT unnest([1, 2, 3]) AS i) WHERE held), a AS ({_auc_sql('h', 'split, metric')}) SELECT metric, round(median(auc), 6) AS median_auc, count(auc) AS n_splits FROM a GROUP BY 1")
def naive_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = held_out(spark, sf_dir).unpivot(["split", "doc_id", "label"], ["s1", "s2", "s3"], "metric", "score")
    a = rounded(E.auc(h, ["split", "metric"], "score", "label"), ["auc"])
    return rounded(a.groupBy("metric").agg(F.median("auc").alias("median_auc"), F.count("auc").alias("n_splits")), ["median_auc"])


@query(f"WITH {SPLITS_SQL} SELECT split, round(avg(s1) FILTER (WHERE label = 1), 5) AS mean_1, round(avg(s1) FILTER (WHERE label = 0), 5) AS mean_0, round(avg(s1) FILTER (WHERE label = 1) / nullif(avg(s1) FILTER (WHERE label = 0), 0), 6) AS ratio FROM k WHERE held GROUP BY 1")
def calibration_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(E.calibration(held_out(spark, sf_dir), ["split"], "s1", "label"), ["ratio"]), ["mean_1", "mean_0"], 5)


@query(f"""WITH {SPLITS_SQL}, t AS (SELECT split, avg(s1) AS m, stddev_samp(s1) AS s, avg(s3) AS m3, stddev_samp(s3) AS d3 FROM k WHERE NOT held GROUP BY 1)
    SELECT split, doc_id, round(CASE WHEN s > 1e-8 THEN (s1 - m) / s ELSE 0 END, 6) AS s1, round(CASE WHEN d3 > 1e-8 THEN (s3 - m3) / d3 ELSE 0 END, 6) AS s3 FROM k JOIN t USING (split) WHERE held""")
def standardised_on_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = splits(spark, sf_dir).select("split", "doc_id", "held", "s1", "s3")
    out = E.standardise(k, ["split"], "NOT held", ["s1", "s3"]).where("held").select("split", "doc_id", "s1", "s3")
    return rounded(out, ["s1", "s3"])


_PAIRS_SQL = f"""h AS (SELECT split, label, s1, s3 FROM k WHERE held), a1 AS (SELECT split, auc AS a FROM ({_auc_sql('h', 'split', 's1')})), a3 AS (SELECT split, auc AS b FROM ({_auc_sql('h', 'split', 's3')})), pairs AS (SELECT split, a, b FROM a1 JOIN a3 USING (split))"""


def auc_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """split, a, b: the AUCs of two scores on the same splits."""
    h = held_out(spark, sf_dir)
    a = rounded(E.auc(h, ["split"], "s1", "label", "a"), ["a"]).drop("n")
    return a.join(rounded(E.auc(h, ["split"], "s3", "label", "b"), ["b"]).drop("n"), "split")


@query(f"""WITH {SPLITS_SQL}, {_PAIRS_SQL}, d AS (SELECT a - b AS d FROM pairs WHERE a - b <> 0), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2 AS r, count(*) OVER (PARTITION BY abs(d)) AS t FROM d),
    s AS (SELECT count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w_plus, sum(t * t - 1) AS ties FROM r)
    SELECT n, w_plus, round((w_plus - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48), 6) AS z FROM s""")
def wilcoxon_of_paired_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.wilcoxon(auc_pairs(spark, sf_dir).withColumn("_g", F.lit(0)), ["_g"], "a", "b")
    return rounded(out.select("n", "w_plus", "z"), ["z", "w_plus"])


@query(f"""WITH {UNITS_SQL}, r AS (SELECT regime, rank() OVER (PARTITION BY regime ORDER BY s1) + (count(*) OVER (PARTITION BY regime, s1) - 1) / 2 AS x, rank() OVER (PARTITION BY regime ORDER BY s3) + (count(*) OVER (PARTITION BY regime, s3) - 1) / 2 AS y FROM units),
    c AS (SELECT regime, corr(x, y) AS rho, count(*) AS n FROM r GROUP BY 1), z AS (SELECT *, 0.5 * ln((1 + rho) / (1 - rho)) * sqrt((n - 3) / 1.06) AS z FROM c), q AS (SELECT *, -abs(z) AS q FROM z)
    SELECT regime, round(rho, 6) AS rho, n, round(z, 5) AS z, round(2 * {PQ.hart_sql("q")}, 6) AS p FROM q""")
def spearman_by_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(E.spearman(units(spark, sf_dir), ["regime"], "s1", "s3"), ["rho", "p"]), ["z"], 5)


@query(f"WITH {SPLITS_SQL}, m AS (SELECT split, avg(s1) FILTER (WHERE label = 1) AS a, avg(s1) FILTER (WHERE label = 0) AS b FROM k WHERE held GROUP BY 1) SELECT round(avg(CASE WHEN a > b THEN 1.0 ELSE 0.0 END), 6) AS share, count(*) AS n_splits FROM m WHERE a IS NOT NULL AND b IS NOT NULL")
def share_of_splits_with_higher_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = E.calibration(held_out(spark, sf_dir), ["split"], "s1", "label").where("mean_1 IS NOT NULL AND mean_0 IS NOT NULL")
    return rounded(m.agg(F.avg((F.col("mean_1") > F.col("mean_0")).cast("double")).alias("share"), F.count(F.lit(1)).alias("n_splits")), ["share"])


@query(f"""WITH {PQ._PANEL_SQL}, w AS (SELECT sector, l_suppkey, realized_vol AS score, CASE WHEN bubble AND tau >= -12 THEN 1 ELSE 0 END AS label FROM aligned JOIN {PQ.SECTOR_SQL} USING (l_suppkey) WHERE tau >= -36 AND tau < 0),
    h AS (SELECT * FROM w WHERE score IS NOT NULL AND l_suppkey IN (SELECT l_suppkey FROM w WHERE label = 1)) {_auc_sql('h', 'sector', name='month_auc', least=10)}""")
def month_auc_of_event_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Does volatility tell the twelve months before a peak from the earlier ones, among suppliers that have a peak?"""
    p = with_sector(panel.pre_peak(PQ.event_panel(spark, sf_dir), "month_end", "peak", F.col("bubble")), spark, sf_dir)
    return rounded(E.month_auc(p, ["sector"], "month_end", "l_suppkey", "realized_vol", "event_12m"), ["month_auc"])


@query(f"""WITH {SPLITS_SQL}, {_PAIRS_SQL}, r AS (SELECT a, row_number() OVER (ORDER BY a, split) AS r, count(*) OVER () AS n FROM pairs WHERE a IS NOT NULL),
    t AS (SELECT CAST(p AS DOUBLE) AS percent, CAST(greatest(1, floor(n * p / 100)) AS BIGINT) AS k, a, r FROM r, (SELECT unnest([1, 2, 5, 10, 25]) AS p)) SELECT percent, k, round(avg(a), 6) AS cvar, round(max(a), 6) AS threshold FROM t WHERE r <= k GROUP BY 1, 2""")
def tail_means_of_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.tail_means(auc_pairs(spark, sf_dir).withColumn("_g", F.lit(0)), ["_g"], "a", ["split"])
    return rounded(out.select("percent", F.col("k").cast("bigint").alias("k"), "cvar", "threshold"), ["cvar", "threshold"])


@query(f"""WITH {SPLITS_SQL}, {_PAIRS_SQL}, r AS (SELECT split, row_number() OVER (ORDER BY a, split) AS r, count(*) OVER () AS n FROM pairs), w AS (SELECT split, r, n, greatest(1, floor(n * 0.1)) AS top FROM r),
    m AS (SELECT CAST(k.doc_id AS VARCHAR) AS episode, w.r, w.top, w.n FROM k JOIN w USING (split) WHERE held)
    SELECT episode, count(*) AS n_all, count(*) FILTER (WHERE r <= top) AS n_worst, round((count(*) FILTER (WHERE r <= top) / max(top)) / (count(*) / max(n)), 6) AS enrichment FROM m GROUP BY 1""")
def enrichment_in_worst_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = held_out(spark, sf_dir).groupBy("split").agg(F.concat_ws("|", F.sort_array(F.collect_list(F.col("doc_id").cast("string")))).alias("held"))
    out = E.enrichment(lists.join(auc_pairs(spark, sf_dir).select("split", "a"), "split"), "split", "held", "a")
    return rounded(out, ["enrichment"])


@query(f"WITH {SPLITS_SQL}, {_PAIRS_SQL} SELECT doc_id, round(avg(a) FILTER (WHERE NOT held) - avg(a) FILTER (WHERE held), 6) AS impact, count(*) FILTER (WHERE held) AS n_held FROM k JOIN pairs USING (split) GROUP BY 1")
def impact_of_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = splits(spark, sf_dir).select("split", "doc_id", "held").join(auc_pairs(spark, sf_dir).select("split", "a"), "split")
    return rounded(E.impact(k, "split", "doc_id", "held", "a"), ["impact"])


@query(f"WITH {UNITS_SQL}, t AS (SELECT doc_id, regime, s1 FROM units WHERE label = 0), r AS (SELECT regime AS g, s1 AS ref FROM units WHERE label = 1) SELECT doc_id, round(avg(CASE WHEN ref <= s1 THEN 100.0 ELSE 0.0 END), 5) AS percentile, s1 > max(ref) AS out_of_range FROM t JOIN r ON regime = g GROUP BY doc_id, s1")
def percentile_in_matched_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = units(spark, sf_dir)
    out = E.percentile_rank(u.where("label = 0").select("doc_id", "regime", "s1"), u.where("label = 1"), "regime", "s1")
    return rounded(out.select("doc_id", "percentile", "out_of_range"), ["percentile"], 5)


@query(f"WITH {UNITS_SQL} SELECT regime, quantile_cont(s1, 0.025) AS q0025, quantile_cont(s1, 0.5) AS q0500, quantile_cont(s1, 0.975) AS q0975 FROM units GROUP BY 1")
def interpolated_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.quantiles(units(spark, sf_dir), ["regime"], "s1", (0.025, 0.5, 0.975)), ["q0025", "q0500", "q0975"])


@query(f"WITH {UNITS_SQL} SELECT CAST(CASE WHEN s1 < 0 THEN 0 WHEN s1 >= 10000 THEN 21 ELSE floor(s1 / 500) + 1 END AS BIGINT) AS bin, count(*) AS n FROM units GROUP BY 1")
def fixed_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.histogram(units(spark, sf_dir), "s1", 0.0, 10000.0, 20)


@query(f"""WITH {SPLITS_SQL}, {_PAIRS_SQL}, g AS (SELECT a - b AS gap, row_number() OVER (ORDER BY split) - 1 AS i, count(*) OVER () AS n FROM pairs WHERE a IS NOT NULL AND b IS NOT NULL),
    d AS (SELECT boot, ('0x' || substr(md5('42|' || boot || '|' || k), 1, 8))::UBIGINT % n AS i FROM (SELECT unnest(range(0, 200)) AS boot), (SELECT DISTINCT n FROM g), (SELECT unnest(range(0, {N})) AS k) WHERE k < n),
    m AS (SELECT boot, median(gap) AS m FROM d JOIN g ON d.i = g.i GROUP BY 1) SELECT round(quantile_cont(m, 0.025), 6) AS low, round(median(m), 6) AS middle, round(quantile_cont(m, 0.975), 6) AS high FROM m""")
def bootstrap_of_median_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = auc_pairs(spark, sf_dir).where("a IS NOT NULL AND b IS NOT NULL").select("split", (F.col("a") - F.col("b")).alias("gap"))
    m = R.bootstrap(gaps, ["split"], 200).groupBy("boot").agg(F.median("gap").alias("m"))
    return rounded(m.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.median("m").alias("middle"), F.percentile("m", F.lit(0.975)).alias("high")), ["low", "middle", "high"])


@query(f"""WITH {UNITS_SQL}, p AS (SELECT perm, units.*, row_number() OVER (PARTITION BY regime, perm ORDER BY doc_id) AS k, row_number() OVER (PARTITION BY regime, perm ORDER BY md5('42|' || regime || '|' || perm || '|' || doc_id), doc_id) AS j FROM units, (SELECT unnest(range(1, 101)) AS perm)),
    s AS (SELECT a.regime, a.perm, avg(a.s1) FILTER (WHERE b.label = 1) - avg(a.s1) FILTER (WHERE b.label = 0) AS v FROM p a JOIN p b ON a.regime = b.regime AND a.perm = b.perm AND a.k = b.j GROUP BY 1, 2),
    o AS (SELECT regime, avg(s1) FILTER (WHERE label = 1) - avg(s1) FILTER (WHERE label = 0) AS obs FROM units GROUP BY 1)
    SELECT regime, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS std, round(quantile_cont(v, 0.05), 4) AS q05, round(quantile_cont(v, 0.95), 4) AS q95, round(avg(CASE WHEN v >= obs THEN 1.0 ELSE 0.0 END), 6) AS p, round((count(*) FILTER (WHERE v >= obs) + 1) / (count(*) + 1), 6) AS p1 FROM s JOIN o USING (regime) GROUP BY 1""")
def permutation_of_mean_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = units(spark, sf_dir).select("doc_id", "regime", "label", "s1")
    gap = (F.avg(F.when(F.col("label") == 1, F.col("s1"))) - F.avg(F.when(F.col("label") == 0, F.col("s1")))).alias("v")
    nulls = R.permuted_labels(u, ["regime"], "doc_id", "label", 100).groupBy("regime", "perm").agg(gap)
    out = E.null_summary(nulls, u.groupBy("regime").agg(gap), ["regime"], "v")
    return rounded(rounded(out, ["p", "p1"]), ["mean", "std", "q05", "q95"], 4)


@query(f"""WITH {UNITS_SQL}, c AS (SELECT DISTINCT cluster FROM units), o AS (SELECT cluster, row_number() OVER (ORDER BY cluster) - 1 AS i, count(*) OVER () AS n FROM c),
    d AS (SELECT boot, ('0x' || substr(md5('42|' || boot || '|' || k), 1, 8))::UBIGINT % n AS i FROM (SELECT unnest(range(0, 100)) AS boot), (SELECT DISTINCT n FROM o), (SELECT unnest(range(0, 7)) AS k) WHERE k < n),
    w AS (SELECT boot, cluster, count(*) AS weight FROM d JOIN o USING (i) GROUP BY 1, 2)
    SELECT boot, round(sum(weight * s1 * label) / nullif(sum(weight * label), 0), 4) AS mean_1 FROM w JOIN units USING (cluster) GROUP BY 1""")
def cluster_bootstrap_of_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = units(spark, sf_dir)
    w = R.cluster_weights(u.select("cluster").distinct(), "cluster", 100)
    out = w.join(u, "cluster").groupBy("boot").agg((F.sum(F.col("weight") * F.col("s1") * F.col("label")) / F.nullif(F.sum(F.col("weight") * F.col("label")), F.lit(0))).alias("mean_1"))
    return rounded(out, ["mean_1"], 4)


@query(f"""WITH {SPLITS_SQL}, {_PAIRS_SQL}, y AS (SELECT split, avg(CASE WHEN doc_id % 2 = 0 THEN 1.0 ELSE 0.0 END) AS late FROM k WHERE held GROUP BY 1),
    g AS (SELECT CASE WHEN late > 0.55 THEN 'post' WHEN late < 0.45 THEN 'pre' ELSE 'mixed' END AS era, a FROM y JOIN pairs USING (split)) SELECT era, count(*) AS n, round(median(a), 6) AS median_auc FROM g GROUP BY 1""")
def subgroups_of_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = held_out(spark, sf_dir).groupBy("split").agg(F.avg((F.col("doc_id") % 2 == 0).cast("double")).alias("late"))
    era = F.when(F.col("late") > 0.55, "post").when(F.col("late") < 0.45, "pre").otherwise("mixed").alias("era")
    out = late.join(auc_pairs(spark, sf_dir), "split").groupBy(era).agg(F.count(F.lit(1)).alias("n"), F.median("a").alias("median_auc"))
    return rounded(out, ["median_auc"])


@query(f"""WITH {UNITS_SQL}, b AS (SELECT 'c' || cluster AS name, s1 - 2000 AS beta FROM units) SELECT name, round(median(beta), 4) AS median, round(quantile_cont(beta, 0.025), 4) AS low, round(quantile_cont(beta, 0.975), 4) AS high, round(avg(CASE WHEN beta > 0 THEN 1.0 ELSE 0.0 END), 6) AS share_positive, quantile_cont(beta, 0.025) > 0 OR quantile_cont(beta, 0.975) < 0 AS excludes_0 FROM b GROUP BY 1""")
def coefficient_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = units(spark, sf_dir).select(F.concat(F.lit("c"), F.col("cluster").cast("string")).alias("name"), (F.col("s1") - 2000).alias("beta"))
    return rounded(rounded(E.coefficient_stability(b, "name", "beta"), ["share_positive"]), ["median", "low", "high"], 4)


@query(f"WITH {UNITS_SQL} SELECT doc_id, s1 FROM units ORDER BY abs(s1 - 1000) DESC, doc_id LIMIT 10")
def largest_deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.top_by(units(spark, sf_dir).select("doc_id", "s1"), [F.desc(F.abs(F.col("s1") - 1000)), F.asc("doc_id")], 10)


@query(f"WITH {UNITS_SQL} SELECT doc_id, round(('0x' || substr(md5('7|' || doc_id), 1, 8))::UBIGINT / 4294967296.0, 9) AS u FROM units")
def keyed_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units(spark, sf_dir).select("doc_id", F.round(draw_unit(7, F.col("doc_id")), 9).alias("u"))
