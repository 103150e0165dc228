"""Quality rules with adaptive thresholds: each measure's limits come from mergeable quantile sketches per language and
source, in place of fixed cutoffs, and are joined back to filter the documents."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import keyed_join, runs_of_words, span_hashes, text_blocks, word_spans, written

COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
_SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])


def _again(row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is it equal to an earlier one of its row, is there another equal one in its row); both in the given order."""
    n = len(key)
    order = np.lexsort((np.arange(n), key, row))
    same = (row[order][1:] == row[order][:-1]) & (key[order][1:] == key[order][:-1])
    earlier, twin = np.zeros(n, bool), np.zeros(n, bool)
    earlier[order[1:]] = same
    twin[order[1:]] |= same
    twin[order[:-1]] |= same
    return earlier, twin


def count_block(data: np.ndarray, offsets: np.ndarray, window: int = 8) -> dict[str, np.ndarray]:
    """COUNTS of the rows of a block of bytes. Words and lines are compared by 64-bit hashes."""
    n, row_of = len(offsets) - 1, lambda at: np.searchsorted(offsets, at, "right") - 1
    start, end, row = word_spans(data, offsets)
    out = {"n_words": np.bincount(row, minlength=n)}
    points = ~_SPACE[data] & ((data & 0xC0) != 0x80)
    out["word_chars"] = np.bincount(row_of(np.flatnonzero(points)), minlength=n)
    out["n_symbols"] = np.bincount(row_of(np.flatnonzero(_SYMBOLS[data])), minlength=n)
    # lines: between row starts, newlines and row ends; a line counts if a word starts in it
    cut = np.flatnonzero(data == 10)
    first = np.concatenate([offsets[:-1], cut + 1])
    of = np.concatenate([np.arange(n), row_of(cut)]) if len(cut) else np.arange(n)
    order = np.lexsort((first, of))
    first, of = first[order], of[order]
    last = np.concatenate([first[1:] - 1, offsets[-1:]])
    ends_row = np.concatenate([of[1:] != of[:-1], [True]]) if n else np.zeros(0, bool)
    last[ends_row] = offsets[of[ends_row] + 1]
    held = np.searchsorted(start, last) > np.searchsorted(start, first)
    first, last, of = first[held], last[held], of[held]
    earlier, _ = _again(of, span_hashes(data, first, last))
    out["n_lines"] = np.bincount(of, minlength=n)
    out["n_dup_lines"] = np.bincount(of[earlier], minlength=n)
    key, at = runs_of_words(span_hashes(data, start, end), row, window)
    _, twin = _again(row[at], key)
    ends = np.zeros(len(start) + window + 1, np.int64)
    np.add.at(ends, at[twin], 1)
    np.add.at(ends, at[twin] + window, -1)
    out["n_repeat_words"] = np.bincount(row[np.cumsum(ends)[: len(start)] > 0], minlength=n)
    return out


def text_counts(df: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    """The columns of ``keep`` and COUNTS (long) of each whole text; null has none."""
    kinds = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_blocks(batch.column(len(keep))):
                found = count_block(data, offsets)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *[pa.array(found[c].astype(np.int64)) for c in COUNTS]], names=[*keep, *COUNTS])

    return df.select(*keep, F.col(text).alias("_text")).mapInArrow(count, ", ".join([*kinds, *[f"{c} long" for c in COUNTS]]))


#: Measure -> (expression over COUNTS, is there a lower limit, least distance of a limit from its quartile, may the group's
#: far end widen the limit). Most texts repeat nothing, so their quartiles tell nothing of those that repeat a line.
MEASURES: dict[str, tuple[str, bool, float, bool]] = {
    "word_length": ("word_chars / n_words", True, 0.25, False),
    "symbols_a_word": ("n_symbols / n_words", False, 0.1, False),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", False, 0.1, True),
    "repeats": ("n_repeat_words / n_words", False, 0.1, True),
}


GROWTH = 1.02 / 0.98  # of a bucket: quantiles are within 2 %
LOG_GROWTH = math.log(GROWTH)
_ZERO = -(1 << 30)
#: A smaller group takes the limits of its sketch merged with its neighbours': quartiles and far ends of fewer rows are chance.
LEAST_ROWS = 100


def sketches(counts: DataFrame, groups: Sequence[str], where: str = "n_words > 0") -> DataFrame:
    """groups, measure, bucket, n: quantile sketches of the measures, as counts of buckets that grow by a constant factor.
    Zero has a bucket of its own. Sketches merge by adding counts, so they don't depend on how rows are dealt to tasks, and
    a group may hold any share of all rows: each task adds up its own first."""
    rows = counts.where(where).select(*groups, F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.expr(f"CAST({e} AS DOUBLE)").alias("x")) for m, (e, *_) in MEASURES.items()])).alias("_m"))
    bucket = F.when(F.col("_m.x") > 0, F.ceil(F.log("_m.x") / LOG_GROWTH)).otherwise(_ZERO).cast("int")
    return rows.groupBy(*groups, F.col("_m.measure").alias("measure"), bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def limits_of(merged: DataFrame, keys: Sequence[str], spread: float, far: float) -> DataFrame:
    """keys, _rows, and low_ and high_ of each measure, from sketches that are merged by keys."""
    w = Window.partitionBy(*keys, "measure")
    rows = merged.withColumn("_cum", F.sum("n").over(w.orderBy("bucket"))).withColumn("_all", F.sum("n").over(w))
    value = F.when(F.col("bucket") == _ZERO, 0.0).otherwise(2 * F.pow(F.lit(GROWTH), F.col("bucket")) / (1 + GROWTH))
    at = lambda rank: F.min(F.when(F.col("_cum") >= rank, value))
    quantile = lambda p: F.floor((F.col("_all") - 1) * p) + 1
    one = rows.groupBy(*keys, "measure").agg(F.max("_all").alias("_rows"), at(quantile(0.25)).alias("_a"), at(quantile(0.75)).alias("_b"), at(F.greatest(F.lit(1), F.least(quantile(far), F.col("_all") - 2))).alias("_far"))
    pick = lambda m, c: F.max(F.when(F.col("measure") == m, F.col(c)))
    out = [F.max("_rows").alias("_rows")]
    for m, (_, lower, least, wide) in MEASURES.items():
        room = F.greatest(spread * (pick(m, "_b") - pick(m, "_a")), F.lit(least))
        high = pick(m, "_b") + room
        out += [(pick(m, "_a") - room if lower else F.lit(None).cast("double")).alias(f"low_{m}"), (F.greatest(high, pick(m, "_far")) if wide else high).alias(f"high_{m}")]
    return one.groupBy(*keys).agg(*out)


def thresholds(counts: DataFrame, groups: Sequence[str], spread: float = 4.0, where: str = "n_words > 0", far: float = 0.99, least_rows: int = LEAST_ROWS) -> DataFrame:
    """The groups of all rows (null is a group) and, for each measure, ``low_`` and ``high_``: the quartiles less and plus
    ``spread`` times their distance, or the measure's least distance if that is more. For measures of repetition the upper
    limit is at least the ``far`` quantile, or in few rows the third highest value.

    They come from the rows under ``where``. A group of fewer than ``least_rows`` of those has the limits of its sketch
    merged with those of all groups that share its first columns but the last (a source's: the language), and so on up to
    all rows. Without any such row there are no limits.
    """
    sums = written(sketches(counts, groups, where))
    out = counts.select(*groups).distinct()
    limits = [f"{s}_{m}" for m in MEASURES for s in ("low", "high")]
    for depth in range(len(groups), -1, -1):
        keys = list(groups[:depth])
        level = limits_of(sums.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n")), keys, spread, far)
        level = level.where(F.col("_rows") >= (least_rows if depth else 1)).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[F.col(c).alias(f"_{depth}_{c}") for c in limits])
        same = F.lit(True)
        for i, k in enumerate(keys):
            same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        out = out.join(level if depth else F.broadcast(level), same, "left").drop(*[f"_k{i}" for i in range(depth)])
    whole = []
    for m in MEASURES:
        for s in ("low", "high"):
            whole.append(F.coalesce(*[F.col(f"_{d}_{s}_{m}") for d in range(len(groups), -1, -1)]).alias(f"{s}_{m}"))
    return out.select(*groups, *whole)


def judge_quality(df: DataFrame, doc_id: str, text: str, groups: Sequence[str], spread: float = 4.0, least_words: int = 20, most_repeated: int = 30) -> DataFrame:
    """doc_id, the groups, COUNTS, ``base_failed``, ``failed`` (the measures beyond their limits) and ``kept``.

    base_failed: fewer than ``least_words`` words, or more than ``most_repeated`` per cent of them in repeated windows of
    eight. Limits are learned from the rows that pass this; the others are never kept. Null in a group column is a group
    by itself; null or empty text fails; repeated rows each get a row; an empty table gives an empty result. Sketches are
    counts, so reruns agree.
    """
    base = F.expr(f"n_words < {least_words} OR 100 * n_repeat_words > {most_repeated} * n_words")
    counts = written(text_counts(df, text, [doc_id, *groups]).withColumn("base_failed", base))
    limits = thresholds(counts, groups, spread, where="NOT base_failed").select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], *[f"{s}_{m}" for m in MEASURES for s in ("low", "high")])
    out = keyed_join(counts, written(limits), [(g, f"_g{i}") for i, g in enumerate(groups)], F.xxhash64(doc_id))
    tests = [F.when((F.expr(f"{e}") > F.col(f"high_{m}")) | (F.coalesce(F.expr(f"{e}") < F.col(f"low_{m}"), F.lit(False))), F.lit(m)) for m, (e, *_) in MEASURES.items()]
    failed = F.when(F.col("n_words") > 0, F.array_compact(F.array(*tests))).otherwise(F.array().cast("array<string>"))
    out = out.withColumn("failed", failed).withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))
    return out.select(doc_id, *groups, *COUNTS, "base_failed", "failed", "kept")
