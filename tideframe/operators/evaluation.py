"""Rank statistics and summaries over resamples, as grouped expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.credit import normal_cdf
from ..functions.numbers import correlation, pipe_list, ratio
from .splits import numbered, settled


def average_rank(keys: Sequence[str], value: str) -> Column:
    w = Window.partitionBy(*keys)
    return F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, value)) - 1) / 2


def auc(df: DataFrame, keys: Sequence[str], score: str, label: str, name: str = "auc", least: int = 4) -> DataFrame:
    """keys, name, n: area under the ROC curve with ties counted half; NULL below ``least`` scored rows or with one class.
    Rows without a score or label are left out."""
    rows = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).withColumn("_r", average_rank(keys, score))
    one = (F.col(label) == 1).cast("double")
    sums = rows.groupBy(*keys).agg(F.sum(F.col("_r") * one).alias("_s"), F.sum(one).alias("_p"), F.count(F.lit(1)).alias("n"))
    p, q = F.col("_p"), F.col("n") - F.col("_p")
    value = F.when((F.col("n") >= least) & (p > 0) & (q > 0), (F.col("_s") - p * (p + 1) / 2) / (p * q))
    return sums.select(*keys, value.alias(name), "n")


def group_auc(df: DataFrame, keys: Sequence[str], group: str, score: str, label: str, name: str = "auc") -> DataFrame:
    """AUC of the mean score of each group."""
    return auc(df.groupBy(*keys, group).agg(F.avg(score).alias(score), F.max(label).alias(label)), keys, score, label, name)


def calibration(df: DataFrame, keys: Sequence[str], score: str, label: str) -> DataFrame:
    """Mean score of each class and their ratio."""
    m = lambda y: F.avg(F.when(F.col(label) == y, F.col(score)))
    return df.groupBy(*keys).agg(m(1).alias("mean_1"), m(0).alias("mean_0")).withColumn("ratio", ratio(F.col("mean_1"), F.col("mean_0")))


def month_auc(df: DataFrame, keys: Sequence[str], month: str, group: str, score: str, label: str, least: int = 10, name: str = "month_auc") -> DataFrame:
    """AUC over the single months of groups that have an event at all (``label`` is 1 in some month), of at least ``least``
    rows: does the score tell the months near an event from the others?"""
    events = df.groupBy(*keys, group).agg(F.max(label).alias("_any")).where("_any = 1").drop("_any")
    return auc(df.join(events, [*keys, group]).select(*keys, month, score, label), keys, score, label, name, least)


def standardise(df: DataFrame, keys: Sequence[str], train: str, columns: Sequence[str], sample: bool = True) -> DataFrame:
    """Columns less the train rows' mean over their deviation. sample: ddof 1, and missing values become the train median
    (mean and deviation are taken before that); else ddof 0 after missing became 0. A deviation up to 1e-8 gives 0."""
    x = {c: F.col(c) if sample else F.coalesce(F.col(c), F.lit(0.0)) for c in columns}
    dev = F.stddev_samp if sample else F.stddev_pop
    stats = df.where(train).groupBy(*keys).agg(*[f(x[c]).alias(f"_{k}_{c}") for c in columns for k, f in (("m", F.avg), ("s", dev), *([("q", F.median)] if sample else []))])
    joined = df.join(stats, list(keys)) if keys else df.crossJoin(F.broadcast(stats))
    full = {c: F.coalesce(F.col(c), F.col(f"_q_{c}")) if sample else x[c] for c in columns}
    out = {c: F.when(F.col(f"_s_{c}") > 1e-8, (full[c] - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).otherwise(0.0) for c in columns}
    return joined.withColumns(out).select(*df.columns)


def wilcoxon(df: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """keys, n, w_plus, z, p: signed ranks of a - b, zeros dropped, one-sided (a greater), normal approximation with ties."""
    rows = df.withColumn("_d", F.col(a) - F.col(b)).where("_d <> 0").withColumn("_a", F.abs("_d"))
    rows = rows.withColumn("_r", average_rank(keys, "_a")).withColumn("_t", F.count(F.lit(1)).over(Window.partitionBy(*keys, "_a")))
    s = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("_d") > 0, F.col("_r")).otherwise(0.0)).alias("w_plus"), F.sum(F.col("_t") * F.col("_t") - 1).alias("_ties"))
    n = F.col("n")
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("_ties") / 48
    z = F.when(var > 0, (F.col("w_plus") - n * (n + 1) / 4) / F.sqrt(var))
    return s.select(*keys, "n", "w_plus", z.alias("z"), normal_cdf(-z).alias("p"))


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """keys, rho, n, z, p: correlation of average ranks, and its two-sided p by Fisher's z, which is normal with variance
    1.06 / (n - 3) for ranks (Fieller); NULL below four rows."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("_x", average_rank(keys, x)).withColumn("_y", average_rank(keys, y))
    out = rows.groupBy(*keys).agg(correlation(F.col("_x"), F.col("_y")).alias("rho"), F.count(F.lit(1)).alias("n"))
    near = F.least(F.greatest(F.col("rho"), F.lit(-1 + 1e-12)), F.lit(1 - 1e-12))
    z = F.when((F.col("n") > 3) & F.col("rho").isNotNull(), 0.5 * F.log((1 + near) / (1 - near)) * F.sqrt((F.col("n") - 3) / 1.06))
    return out.withColumn("z", z).withColumn("p", 2 * normal_cdf(-F.abs("z")))


def tail_means(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], percents: Sequence[float] = (1, 2, 5, 10, 25)) -> DataFrame:
    """keys, percent, k, cvar, threshold: mean and largest of the k = max(1, int(n * percent / 100)) smallest values."""
    w = Window.partitionBy(*keys)
    rows = df.where(F.col(value).isNotNull()).withColumn("_r", F.row_number().over(w.orderBy(value, *order))).withColumn("_n", F.count(F.lit(1)).over(w))
    rows = rows.withColumn("percent", F.explode(F.array(*[F.lit(float(p)) for p in percents]))).withColumn("k", F.greatest(F.lit(1), F.floor(F.col("_n") * F.col("percent") / 100)))
    return rows.where("_r <= k").groupBy(*keys, "percent", "k").agg(F.avg(value).alias("cvar"), F.max(value).alias("threshold"))


def enrichment(splits: DataFrame, split: str, listed: str, value: str, percent: float = 10) -> DataFrame:
    """(episode, n_all, n_worst, enrichment): share of an episode ('a|b' lists) among the worst splits over its share in all."""
    ranked, n = numbered(splits, [value, split], "_r")
    k = max(1, int(n * percent // 100))
    rows = ranked.select("_r", F.explode(pipe_list(F.col(listed))).alias("episode"))
    out = rows.groupBy("episode").agg(F.count(F.lit(1)).alias("n_all"), F.sum((F.col("_r") < k).cast("int")).alias("n_worst"))
    return out.select("episode", "n_all", "n_worst", ((F.col("n_worst") / k) / (F.col("n_all") / n)).alias("enrichment"))


def impact(members: DataFrame, split: str, unit: str, held: str, value: str) -> DataFrame:
    """(unit, impact): mean value of the splits without the unit held out less that of those with it."""
    m = lambda c: F.avg(F.when(c, F.col(value)))
    return members.groupBy(unit).agg((m(~F.col(held)) - m(F.col(held))).alias("impact"), F.sum(F.col(held).cast("int")).alias("n_held"))


def percentile_rank(targets: DataFrame, reference: DataFrame, key: str, score: str, parts: int = 64) -> DataFrame:
    """targets with the share (in %) of reference scores of the key that are not greater, and whether it is above them all;
    NULL without a reference or score.

    Scores of a key are counted by value, dealt into ``parts`` ranges of about as many values, and summed up to each value within its range and
    over the ranges before it: no target meets a reference row, and no task needs all values of a key.
    """
    ref = reference.where(F.col(score).isNotNull()).groupBy(F.col(key).alias("_k"), F.col(score).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    own = targets.where(F.col(score).isNotNull()).select(F.col(key).alias("_k"), F.col(score).alias("_v")).distinct().withColumn("_n", F.lit(0).cast("bigint"))
    values = settled(ref.unionByName(own).groupBy("_k", "_v").agg(F.sum("_n").alias("_n")))
    span = values.groupBy("_k").agg(F.percentile_approx("_v", [i / parts for i in range(1, parts)], 10 * parts).alias("_bounds"), F.sum("_n").alias("_all"), F.max(F.when(F.col("_n") > 0, F.col("_v"))).alias("_top"))
    part = F.size(F.filter("_bounds", lambda b: b < F.col("_v")))
    dealt = values.join(F.broadcast(span), "_k").withColumn("_part", part).drop("_bounds")  # a row a key
    before = Window.partitionBy("_k").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("_k", "_part").agg(F.sum("_n").alias("_m")).withColumn("_m", F.coalesce(F.sum("_m").over(before), F.lit(0)))
    cum = F.sum("_n").over(Window.partitionBy("_k", "_part").orderBy("_v")) + F.col("_m")
    ranks = dealt.join(sums, ["_k", "_part"]).select("_k", "_v", F.when(F.col("_all") > 0, cum / F.col("_all") * 100).alias("percentile"), (F.col("_v") > F.col("_top")).alias("out_of_range"))
    return targets.join(ranks, (targets[key] == F.col("_k")) & (targets[score] == F.col("_v")), "left").drop("_k", "_v")


def quantiles(df: DataFrame, keys: Sequence[str], value: str, points: Sequence[float]) -> DataFrame:
    """Exact quantiles with linear interpolation, a column each."""
    return df.groupBy(*keys).agg(*[F.percentile(value, F.lit(p)).alias(f"q{round(p * 1000):04d}") for p in points])


def null_summary(nulls: DataFrame, observed: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean, deviation (ddof 0), 5 and 95 % points of the null values, and the shares of them not below the observed one:
    p plain, p1 with one added to both."""
    rows = nulls.join(observed.withColumnRenamed(value, "_obs"), list(keys))
    hit = F.sum((F.col(value) >= F.col("_obs")).cast("int"))
    n = F.count(F.lit(1))
    return rows.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.percentile(value, F.lit(0.05)).alias("q05"), F.percentile(value, F.lit(0.95)).alias("q95"), (hit / n).alias("p"), ((hit + 1) / (n + 1)).alias("p1"))


def coefficient_stability(betas: DataFrame, name: str, beta: str) -> DataFrame:
    """Median, 2.5 and 97.5 % points, share of positive values and whether the range leaves out 0, for each coefficient."""
    out = betas.groupBy(name).agg(F.median(beta).alias("median"), F.percentile(beta, F.lit(0.025)).alias("low"), F.percentile(beta, F.lit(0.975)).alias("high"), F.avg((F.col(beta) > 0).cast("double")).alias("share_positive"))
    return out.withColumn("excludes_0", (F.col("low") > 0) | (F.col("high") < 0))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n): fixed bins 1 to bins; values outside have bin 0 or bins + 1."""
    return df.where(F.col(value).isNotNull()).groupBy(F.width_bucket(F.col(value), F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def top_by(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)
