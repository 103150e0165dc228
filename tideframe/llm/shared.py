"""Helpers that several training-data operators share: written intermediate tables, gapless ranks, byte-level words."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than space and the five ASCII controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of a batch that goes to Python: with Spark's 10,000, a batch of texts of some kilobytes takes 100 MB and more in
#: the executor's JVM and again in its worker.
TEXT_BATCH = 500


def text_batches(spark: SparkSession, rows: int = TEXT_BATCH) -> None:
    """Sets the session's rows a batch for work on whole texts; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


#: Folders named inside each open scratch().
_MADE: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Where that is unset, one machine's temporary folder serves in local mode only; on a cluster it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/tideframe"
    path = f"{base.rstrip('/')}/tideframe-{uuid.uuid4().hex}"
    if _MADE:
        _MADE[-1].append(path)
    return path


def written(df: DataFrame, **options: str) -> DataFrame:
    """df as a Parquet table in the shared folder: it is computed once, and no lost executor makes it run again. Lazy
    results read these tables, so they stay unless the call is inside scratch()."""
    path = shared_folder(df.sparkSession)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Folders that shared_folder() names inside are removed at the end: for work whose result is written elsewhere."""
    _MADE.append([])
    try:
        yield
    finally:
        for path in _MADE.pop():
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores added until df has no such column (Spark ignores case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def unit_hash(seed: int, *cols: Column | str) -> Column:
    """A non-negative 63-bit hash of the columns; the same in every run and partitioning."""
    return F.xxhash64(F.lit(seed), *cols).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))


#: Up to so many rows (of less than 100 bytes each) a table is broadcast; beyond, a join with it shuffles both sides.
BROADCAST_ROWS = 200_000


def light(table: DataFrame) -> DataFrame:
    """A written table, broadcast if its count allows."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def keyed_join(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], spread: Column, how: str = "left", salts: int = 16) -> DataFrame:
    """left with the row of right that has its keys (left name, right name; null equals null). right is a written table
    of short rows, one a key. It is broadcast if its count allows; else both sides are shuffled, and as one key can hold
    most of left, left's rows are dealt to salts by ``spread`` and right's rows are there once for each salt."""
    same = F.lit(True)
    for a, b in on:
        same = same & left[a].eqNullSafe(right[b])
    if right.count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), same, how)
    one, two = free_name(left, "_salt"), free_name(right, "_salt_of")
    dealt = left.withColumn(one, F.pmod(spread, F.lit(salts)).cast("int"))
    many = right.withColumn(two, F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).hint("merge")
    same = F.col(one) == F.col(two)
    for a, b in on:
        same = same & F.col(a).eqNullSafe(F.col(b))
    return dealt.join(many, same, how).drop(one, two)


def spread_over(rows: int) -> int:
    """Buckets that a key's rows are numbered in, by the rows of the table."""
    return max(64, min(8192, rows // 500_000))


def gapless_rank(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], spread: Column, name: str, buckets: int = 64) -> DataFrame:
    """Adds ``name``: 0, 1, 2, ... within each value of ``keys``, without a gap, whatever the size of one key.

    ``spread`` is a non-negative 63-bit hash. A key's rows are ordered by the hash's top bits first, then by ``order``,
    so that each of its buckets is numbered by itself and starts where the counts of the lower buckets end. A key that
    holds most rows is thus numbered by up to ``buckets`` tasks. Rows that tie in every ``order`` column get different
    ranks. Null keys form a group. An empty table gives an empty table.
    """
    b, n, start, rn, of, *ks = free_names(df, "_bucket", "_n", "_start", "_rn", "_bucket_of", *[f"_k{i}_" for i in range(len(keys))])
    df = df.withColumn(b, F.shiftright(F.shiftright(spread, 31) * F.lit(buckets), 32).cast("int"))
    counts = df.groupBy(*keys, b).agg(F.count(F.lit(1)).alias(n))
    before = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(k).alias(x) for k, x in zip(keys, ks, strict=True)], F.col(b).alias(of), F.coalesce(F.sum(n).over(before), F.lit(0)).alias(start))
    own = df.withColumn(rn, F.row_number().over(Window.partitionBy(*keys, b).orderBy(*order)))
    on = F.col(b) == F.col(of)
    for k, x in zip(keys, ks, strict=True):
        on = on & F.col(k).eqNullSafe(F.col(x))
    return own.join(starts, on).withColumn(name, (F.col(rn) - 1 + F.col(start)).cast("long")).drop(b, rn, start, of, *ks)


def free_names(df: DataFrame, *names: str) -> list[str]:
    return [free_name(df, x) for x in names]


# --- bytes and words of Arrow text columns ------------------------------------------------------------------------


def text_blocks(column: pa.Array, most: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of at most ``most`` bytes, or of one longer row.

    Null is taken as empty. Offsets start at 0 and have one entry more than there are rows.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        b = min(b, n)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def text_slices(text: str, most: int = 1 << 20) -> Iterator[str]:
    """The text in stretches of about ``most`` characters that end at a space, or at a longer word's next space."""
    at = 0
    while len(text) - at > most:
        end = text.find(" ", at + most)
        if end < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:] if at else text


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return data | np.where((data >= 65) & (data <= 90), np.uint8(32), np.uint8(0))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word; words end at a row's end."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(offsets, start, "right") - 1


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.cumprod(np.full(n, _BASE, np.uint64)), np.cumprod(np.full(n, _INVERSE, np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, by differences of one running polynomial sum."""
    n = len(data)
    power, inverse = _powers(1 << max(18, int(n).bit_length()))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
    return mix((sums[end] - sums[start]) * inverse[start] if len(start) else np.zeros(0, np.uint64))


def runs_of_words(words: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position of the first word) of each run of k words that lies in one row."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(row[:n] == row[k - 1 :])
    total = np.zeros(len(at), np.uint64)
    for i in range(k):
        total = mix(total + words[at + i] * np.uint64(2 * i + 3))
    return total, at
