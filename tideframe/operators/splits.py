"""Resamples that depend on keys alone: stratified holdouts, folds, permutations, bootstraps."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import draw_int, draw_key


def _each(n: int) -> Column:
    """A row for each split; rows stay where they are."""
    return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias("split")


def stratified_holdouts(units: DataFrame, unit: str, stratum: str, n: int, share: float = 0.2, seed: int = 42, more: Sequence[str] = ()) -> DataFrame:
    """(split, unit, stratum, held, more): in each split and stratum, the first greatest(1, round-half-even(share * size)) units by
    key are held out. A NULL stratum is one of its own.

    Keys are uniform draws, so the last key held out lies near its share: those within six deviations of it are ordered, the
    others are counted. Units then compare their own draws with that key and stay where they are. Units that occur more than
    once are ordered one by one.
    """
    own = settled(units.select(unit, F.coalesce(stratum, F.lit("unknown")).alias("stratum"), *more))
    key = draw_key(seed, F.col("split"), F.col(unit))
    if not own.groupBy(unit).count().where("count > 1").isEmpty():
        w = Window.partitionBy("split", "stratum")
        rows = own.select(_each(n), "*").withColumn("_r", F.row_number().over(w.orderBy(key, unit))).withColumn("_n", F.count(F.lit(1)).over(w))
        return rows.withColumn("held", F.col("_r") <= F.greatest(F.lit(1), F.bround(F.col("_n") * share, 0).cast("int"))).select("split", unit, "stratum", "held", *more)
    size = own.groupBy("stratum").agg(F.count(F.lit(1)).alias("_n")).withColumn("_k", F.greatest(F.lit(1), F.bround(F.col("_n") * share, 0).cast("int")))
    p = F.col("_k") / F.col("_n")
    far = 6 * F.sqrt(p * (1 - p) / F.col("_n")) + 6 / F.col("_n")
    part = lambda x: F.lpad(F.hex(F.floor(x * F.lit(2.0**32)).cast("bigint")), 8, "0")
    size = settled(size.select("stratum", "_k", F.lower(part(F.greatest(p - far, F.lit(0.0)))).alias("_a"), F.when(p + far >= 1, "g").otherwise(F.lower(part(F.least(p + far, F.lit(1.0))))).alias("_b")))
    drawn = own.select(unit, "stratum").join(F.broadcast(size), "stratum").select(_each(n), "*").withColumn("_d", key)  # a row a stratum
    below = drawn.where("_d < _a").groupBy("split", "stratum").agg(F.count(F.lit(1)).alias("_m"))
    w = Window.partitionBy("split", "stratum").orderBy("_d")
    near = drawn.where("_d >= _a AND _d < _b").select("split", "stratum", "_d", "_k", F.row_number().over(w).alias("_r")).join(F.broadcast(below), ["split", "stratum"], "left")
    last = settled(near.where(F.col("_r") + F.coalesce("_m", F.lit(0)) == F.col("_k")).select("stratum", "split", F.col("_d").alias("_last")))
    if last.count() < n * size.count():  # a draw further away than that
        w = Window.partitionBy("split", "stratum").orderBy("_d")
        last = settled(drawn.withColumn("_r", F.row_number().over(w)).where("_r = _k").select("stratum", "split", F.col("_d").alias("_last")))
    lasts = settled(last.groupBy("stratum").agg(F.collect_list(F.struct("split", "_last")).alias("_l")))  # a broadcast that waits for no stage
    rows = own.join(F.broadcast(lasts), "stratum").select("*", F.inline("_l"))
    return rows.select("split", unit, "stratum", (key <= F.col("_last")).alias("held"), *more)


def distinct_splits(rows: DataFrame, unit: str) -> DataFrame:
    """The first split of each held-out set."""
    sets = rows.where("held").groupBy("split").agg(F.sort_array(F.collect_list(unit)).alias("_s"))
    return rows.join(sets.groupBy("_s").agg(F.min("split").alias("split")).select("split"), "split", "left_semi")


def fixed_holdouts(units: DataFrame, unit: str, label: str, n: int, ones: int = 5, zeros: int = 3, seed: int = 42) -> DataFrame:
    """As stratified_holdouts by label, with a fixed number held out of each."""
    rows = units.select(_each(n), unit, label)
    w = Window.partitionBy("split", label).orderBy(draw_key(seed, F.col("split"), F.col(unit)), unit)
    return rows.withColumn("held", F.row_number().over(w) <= F.when(F.col(label) == 1, ones).otherwise(zeros))


def leave_one_out(units: DataFrame, unit: str, most: int = 5000) -> DataFrame:
    """(fold, unit, train): every unit with every fold, so units are groups, not rows; more than ``most`` are an error."""
    if units.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} units to leave out one by one")
    folds = units.select(F.col(unit).alias("fold"))
    return folds.crossJoin(F.broadcast(units)).withColumn("train", F.col("fold") != F.col(unit))


def permuted_labels(rows: DataFrame, keys: list[str], unit: str, label: str, n: int, seed: int = 42) -> DataFrame:
    """Each row n times (column perm) with a label of its key's rows, shuffled: the k-th row in one keyed order gets the
    label of the k-th in another."""
    many = rows.withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(n))))
    w = Window.partitionBy(*keys, "perm")
    a = many.withColumn("_k", F.row_number().over(w.orderBy(unit)))
    b = many.select(*keys, "perm", F.col(label).alias("_l"), F.row_number().over(w.orderBy(draw_key(seed, *[F.col(k) for k in keys], F.col("perm"), F.col(unit)), unit)).alias("_k"))
    return a.join(b, [*keys, "perm", "_k"]).withColumn(label, F.col("_l")).drop("_k", "_l")


def settled(df: DataFrame) -> DataFrame:
    """df, computed once and checkpointed in the folder of spark.checkpoint.dir; where that is unset, in local mode, in the
    machine's temporary folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = f"{tempfile.gettempdir()}/tideframe-checkpoints"
        context.setCheckpointDir(folder)
    return df.checkpoint()


def numbered(rows: DataFrame, order: Sequence[Column | str], name: str) -> tuple[DataFrame, int]:
    """(rows with ``name``: 0, 1, 2, ... in the order, how many there are). Rows are dealt to tasks by ranges of the order, a
    task numbers its own, and the driver adds up the tasks' counts: no task sees all rows."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = settled(rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order).withColumn("_task", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    counts = own.groupBy("_task").agg(F.min("_at").alias("a"), F.count(F.lit(1)).alias("n")).orderBy("_task").collect()  # a row a task
    starts, total = [], 0
    for r in counts:
        starts.append((r["_task"], total - r["a"]))
        total += r["n"]
    shifts = rows.sparkSession.createDataFrame(starts, "_task int, _shift long")
    return own.join(F.broadcast(shifts), "_task").withColumn(name, F.col("_at") + F.col("_shift")).drop("_task", "_at", "_shift"), total


def _drawn(rows: DataFrame, size: int, n: int, seed: int) -> DataFrame:
    """(boot, _i): as many draws of a number below size as there are rows, for each of n resamples."""
    every = rows.sparkSession.range(n * size).select(F.expr(f"id div {max(size, 1)}").alias("boot"), (F.col("id") % max(size, 1)).alias("_k"))
    return every.select("boot", (draw_int(seed, F.col("boot"), F.col("_k")) % max(size, 1)).alias("_i"))


def bootstrap(rows: DataFrame, order: list[str], n: int, seed: int = 42) -> DataFrame:
    """(boot, the row's columns): n resamples of all rows with replacement, drawn by the number of a row in the order."""
    own, size = numbered(rows, order, "_i")
    return _drawn(rows, size, n, seed).join(own, "_i").drop("_i")


def cluster_weights(units: DataFrame, unit: str, n: int, seed: int = 42) -> DataFrame:
    """(boot, unit, weight): how often each unit is drawn in a resample of units with replacement; draws are counted before
    they meet the units."""
    own, size = numbered(units.select(unit), [unit], "_i")
    return _drawn(units, size, n, seed).groupBy("boot", "_i").agg(F.count(F.lit(1)).alias("weight")).join(own, "_i").select("boot", unit, "weight")
