"""Panels of groups on event time: windows before the peak, labels, cutoffs, collapse to a row a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import event_month


def pre_peak(df: DataFrame, date: str, peak: str, is_event: Column, months: int = 36, near: int = -12) -> DataFrame:
    """Rows with -months <= tau < 0, with tau, event_12m and time_to_peak: event rows are 1 from ``near`` on and count
    down to the peak, the others are 0 and have the full window."""
    out = df.withColumn("tau", event_month(F.col(date), F.col(peak))).where((F.col("tau") >= -months) & (F.col("tau") < 0))
    out = out.withColumn("event_12m", F.when(is_event & (F.col("tau") >= near), 1).otherwise(0))
    return out.withColumn("time_to_peak", F.when(is_event, -F.col("tau")).otherwise(months))


def leaks(df: DataFrame) -> DataFrame:
    """Rows at or past the peak; there should be none."""
    return df.where("tau >= 0")


def walk_forward(df: DataFrame, peak_date: str, cutoffs: DataFrame, cutoff: str = "cutoff") -> DataFrame:
    """Each row with each cutoff ('YYYY-MM', a short list) and is_train = peak before it."""
    return df.crossJoin(F.broadcast(cutoffs)).withColumn("is_train", F.col(peak_date) < F.col(cutoff))


def enough(df: DataFrame, keys: Sequence[str], train: str, label: str, least_train: int = 2, least_test: int = 1) -> DataFrame:
    """The keys for which both labels have enough train rows and enough test rows."""
    n = lambda t, y: F.sum(((F.col(train) == t) & (F.col(label) == y)).cast("int"))
    counts = df.groupBy(*keys).agg(n(True, 1).alias("train_1"), n(True, 0).alias("train_0"), n(False, 1).alias("test_1"), n(False, 0).alias("test_0"))
    return counts.where((F.col("train_1") >= least_train) & (F.col("train_0") >= least_train) & (F.col("test_1") >= least_test) & (F.col("test_0") >= least_test))


def collapse(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """A row for each group: the mean of each metric over its rows."""
    return df.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in metrics])


def relabel(df: DataFrame, size: Column, label: str, thresholds: Sequence[float]) -> DataFrame:
    """Each row with each threshold, new_label = size >= threshold and flipped = it differs from the label."""
    t = F.explode(F.array(*[F.lit(float(x)) for x in thresholds]))
    out = df.withColumn("threshold", t).withColumn("new_label", (size >= F.col("threshold")).cast("int"))
    return out.withColumn("flipped", F.col("new_label") != F.col(label))


def with_series(df: DataFrame, keys: Sequence[str], month: str, series: DataFrame, value: str, least_share: float = 0.5) -> DataFrame:
    """Mean of an outside monthly series over each group's months, for groups where it is known in enough of them."""
    joined = df.join(series.select(F.col("month").alias(month), value), month, "left")
    out = joined.groupBy(*keys).agg(F.avg(value).alias(value), F.avg(F.col(value).isNotNull().cast("double")).alias("share_known"))
    return out.where(F.col("share_known") >= least_share)


def z_scored(series: DataFrame, value: str) -> DataFrame:
    """The series with its value less the mean over the deviation of all its known months (ddof 1); NULL if it is constant."""
    stats = series.agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    return series.crossJoin(F.broadcast(stats)).withColumn(value, F.when(F.col("_s") > 0, (F.col(value) - F.col("_m")) / F.col("_s"))).drop("_m", "_s")


def multi_channel(frames: Sequence[DataFrame], keys: Sequence[str], low: int = -36, high: int = 24) -> DataFrame:
    """Full outer join of channels (keys, tau, values) on keys and tau within the window: one grouping of their union."""
    values = [[c for c in f.columns if c not in (*keys, "tau")] for f in frames]
    every = [c for v in values for c in v]
    long = None
    for f in frames:
        part = f.select(*keys, "tau", *[F.col(c) if c in f.columns else F.lit(None).cast("double").alias(c) for c in every])
        long = part if long is None else long.unionByName(part)
    return long.where(F.col("tau").between(low, high)).groupBy(*keys, "tau").agg(*[F.max(c).alias(c) for c in every])
