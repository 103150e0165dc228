"""As-of joins, calendar expansion, lookups with stated ties, interval joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import quarter_stamp
from ..functions.numbers import leverage


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, values: Sequence[str]) -> DataFrame:
    """left with the values of the latest right row of the keys that isn't later; of rows at one time, the largest values.

    Both sides are put in one sorted stream per key, so the cost is that of a sort whatever the number of matches. A right
    row whose value is NULL hides earlier ones.
    """
    own = [c for c in left.columns if c not in keys]
    a = left.select(*keys, F.col(left_time).cast("timestamp").alias("_t"), F.lit(1).alias("_side"), F.struct(*own).alias("_row"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("_v"))
    b = right.select(*keys, F.col(right_time).cast("timestamp").alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), F.struct(*values).alias("_v"))
    w = Window.partitionBy(*keys).orderBy("_t", "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    found = a.unionByName(b).withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    return found.select(*keys, "_row.*", *[F.col(f"_v.{v}").alias(v) for v in values])


def fill_forward(df: DataFrame, keys: Sequence[str], date: str, columns: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def to_months(df: DataFrame, keys: Sequence[str], date: str, columns: Sequence[str], extra_months: int = 0) -> DataFrame:
    """A row for each month end from a key's first date to its last plus ``extra_months``, filled forward.

    The last month is the last whose end is not after the last date moved on by the months with its day kept, so that a
    stamp on a short month's end reaches one month less.
    """
    rows = df.withColumn("_m", F.last_day(date))
    w = Window.partitionBy(*keys, "_m").orderBy(F.desc(date), *[F.desc(c) for c in columns])
    rows = rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    span = rows.groupBy(*keys).agg(F.min("_m").alias("_a"), F.add_months(F.max("_m"), extra_months).alias("_b"))
    steps = F.sequence(F.trunc("_a", "month"), F.trunc("_b", "month"), F.expr("interval 1 month"))
    grid = span.select(*keys, "_b", F.explode(steps).alias("_s")).select(*keys, F.last_day("_s").alias("month_end"), "_b").where("month_end <= _b").drop("_b")
    full = grid.join(rows.select(*keys, F.col("_m").alias("month_end"), *columns), [*keys, "month_end"], "left")
    return fill_forward(full, keys, "month_end", columns)


def quarter_medians(df: DataFrame, entity: str, group: str, date: str, columns: Sequence[str], order: Sequence[str], stamp: str = "quarter_end") -> DataFrame:
    """(group, stamped date, medians, n_entities): the last row of each entity in a quarter, then medians over the group."""
    rows = df.withColumn("_q", F.trunc(date, "quarter"))
    w = Window.partitionBy(entity, "_q").orderBy(F.desc(date), *[F.desc(c) for c in order])
    last = rows.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    out = last.groupBy(group, "_q").agg(*[F.median(c).alias(c) for c in columns], F.countDistinct(entity).alias("n_entities"))
    return out.withColumn("stamp", quarter_stamp(F.col("_q"), stamp)).drop("_q")


def firm_leverage(months: DataFrame, reports: DataFrame, firm: str, debt: str, report_date: str, equity: str, lag_days: int | Column = 0, extend: bool = False) -> DataFrame:
    """months (firm, month_end, equity) with debt and leverage: the reports, moved by the publication lag, by month and
    filled forward between the first and the last report, or also beyond it if ``extend``."""
    moved = reports.withColumn("_d", F.date_add(report_date, lag_days))
    filled = to_months(moved, [firm], "_d", [debt])
    out = months.join(filled, [firm, "month_end"], "left")
    if extend:
        out = fill_forward(out, [firm], "month_end", [debt])
    return out.withColumn("leverage", leverage(F.col(debt), F.col(equity)))


def best_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the stated order, which should have no ties between different rows."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def last_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def lookup(df: DataFrame, table: DataFrame, key: str, value: str, order: Sequence[Column] | None = None) -> DataFrame:
    """df with table's value by key; where a key has several, the first in the order (smallest value)."""
    one = best_row(table.select(key, value), [key], order or [F.col(value).asc_nulls_last()])
    return df.join(one, key, "left")


def first_of(df: DataFrame, tables: Sequence[DataFrame], key: str, value: str) -> DataFrame:
    """The value from the first table that has the key."""
    for i, t in enumerate(tables):
        df = df.join(best_row(t.select(key, F.col(value).alias(f"_v{i}")), [key], [F.col(f"_v{i}").asc_nulls_last()]), key, "left")
    return df.withColumn(value, F.coalesce(*[F.col(f"_v{i}") for i in range(len(tables))])).drop(*[f"_v{i}" for i in range(len(tables))])


def overlapping(left: DataFrame, right: DataFrame, key: str, left_span: tuple[str, str], right_span: tuple[str, str]) -> DataFrame:
    """Pairs of one key whose spans (ends included, NULL end: open) overlap."""
    (a, b), (c, d) = left_span, right_span
    far = F.to_date(F.lit("9999-12-31"))
    r = right.withColumnRenamed(key, "_key")
    return left.join(r, (left[key] == r["_key"]) & (F.col(a) <= F.coalesce(F.col(d), far)) & (F.col(c) <= F.coalesce(F.col(b), far))).drop("_key")


def through_bridge(df: DataFrame, bridges: Sequence[tuple[DataFrame, str, str]], key: str, name: str) -> DataFrame:
    """df with ``name``: what its key leads to over a chain of links (frame, from, to). Of several ends of one key the last
    in order wins, as in a mapping that is written to again and again."""
    ends = df.select(F.col(key).alias("_key")).distinct().withColumn("_at", F.col("_key"))
    for frame, a, b in bridges:
        ends = ends.join(frame.select(F.col(a).alias("_at"), F.col(b).alias("_to")).distinct(), "_at").select("_key", F.col("_to").alias("_at"))
    last = ends.groupBy("_key").agg(F.max("_at").alias(name))
    return df.join(last, df[key] == last["_key"], "left").drop("_key")


def assemble(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Frames of one row a key (keys, own values) side by side, all keys of any: one grouping of their union instead of a
    chain of joins."""
    values = {c: f.schema[c].dataType for f in frames for c in f.columns if c not in keys}
    rows = [f.select(*keys, *[F.col(c) if c in f.columns else F.lit(None).cast(t).alias(c) for c, t in values.items()]) for f in frames]
    out = rows[0]
    for f in rows[1:]:
        out = out.unionByName(f)
    return out.groupBy(*keys).agg(*[F.max(c).alias(c) for c in values])


def linked_to(df: DataFrame, bridge: DataFrame, chosen: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """The rows of df that the bridge (left_key, right_key) links to at least one chosen right_key."""
    ok = bridge.join(chosen.select(right_key).distinct(), right_key, "left_semi").select(left_key).distinct()
    return df.join(ok, left_key, "left_semi")


def member_sets(df: DataFrame, key: str, member: str, name: str) -> DataFrame:
    """(key, name, n): the set of a key's members in order. A set is as large as a key has different members; repeated rows
    are taken out before they meet."""
    return df.select(key, member).where(F.col(member).isNotNull()).distinct().groupBy(key).agg(F.sort_array(F.collect_list(member)).alias(name)).withColumn("n", F.size(name))


def union_rows(*frames: DataFrame, distinct_on: Sequence[str] | None = None) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.dropDuplicates(list(distinct_on)) if distinct_on else out


def coverage(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows and the share of known values of each column."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), *[F.avg(F.col(c).isNotNull().cast("double")).alias(f"share_{c}") for c in columns])
