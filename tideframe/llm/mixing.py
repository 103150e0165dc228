"""Mixing sources to target weights: how often each document is taken so that every source meets its share of words.

Documents are counted by exact length. A source first takes all its documents as often as the target holds them whole.
What is left of the budget is a bounded subset-sum problem over (length, count): the long way down is greedy, the rest is
met by dynamic programming over a window that grows until the total is met or comes no nearer. A length's count is then met by its first documents in seeded order.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import WORD, free_name, free_names, gapless_rank, keyed_join, light, spread_over, unit_hash, written


def count_words(text: str) -> F.Column:
    """Number of words of a text column; null: none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: Sequence[tuple[str | None, int]], total: float | None = None, weights: Sequence[float] = (1, 2, 3), most: float = 3.0) -> dict[str | None, float]:
    """Target size by source. Sources, by code point and null last, have the weights in turn.

    The total (all sizes, if None) is shared by weight. A source that would get more than ``most`` times its size gets
    just that, and its excess is shared among the rest by weight, until none is above. Without any size all are 0.

    >>> targets([("a", 10), ("b", 100), (None, 90)])
    {'a': 30.0, 'b': 68.0, None: 102.0}
    """
    names = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    left = float(sum(s for _, s in names) if total is None else total)
    open_ = {name: (float(weights[i % len(weights)]), size * most) for i, (name, size) in enumerate(names)}
    out: dict[str | None, float] = {}
    while open_:
        share = left / sum(w for w, _ in open_.values())
        full = [name for name, (w, cap) in open_.items() if w * share >= cap]
        if not full:
            out |= {name: w * share for name, (w, _) in open_.items()}
            break
        for name in full:
            out[name] = open_.pop(name)[1]
            left -= out[name]
    return {name: out[name] for name, _ in names}


def subset_sum(lengths: Sequence[int], counts: Sequence[int], budget: int, exact: int = 1 << 16, enough: int = 1 << 24) -> list[int]:
    """How many items of each length to take, at most its count, so that the total comes near to the budget from below.

    Longest first, items are taken while more than a window of words is left; the rest is an exact bounded knapsack. The
    window is ``exact`` or twice the largest length, if that is more. While the budget is not met and something was taken
    before the window, it doubles; from ``enough`` words on only as long as that brings a smaller shortfall. So a budget of up
    to ``enough`` is met as nearly as can be, and a larger one up to less than the shortest length of which items are left.
    Lengths are divided by their greatest common divisor first. Memory is about five bytes a word of the last window.

    >>> subset_sum([5, 4, 3], [1, 2, 1], 11)
    [0, 2, 1]
    """
    use = [i for i in range(len(lengths)) if lengths[i] and counts[i]]
    taken = [0] * len(lengths)
    if not use or budget <= 0:
        return taken
    unit = math.gcd(*[lengths[i] for i in use])
    order = sorted(use, key=lambda i: -lengths[i])
    size, have = [lengths[i] // unit for i in order], [counts[i] for i in order]
    left = int(budget) // unit
    if sum(a * b for a, b in zip(size, have, strict=True)) <= left:
        got = have
    else:
        window = max(exact, 2 * size[0])
        got, short = _within(size, have, left, window)
        while short and window < left:
            window *= 2
            more, less = _within(size, have, left, window)
            if less < short:
                got, short = more, less
            elif window >= enough:
                break
    for i, k in zip(order, got, strict=True):
        taken[i] = k
    return taken


def _within(lengths: Sequence[int], counts: Sequence[int], budget: int, window: int) -> tuple[list[int], int]:
    """(how many of each, what is missing to the budget): greedy down to the window, then all totals that parts of a power
    of two reach, each with the first part that reached it. Lengths fall."""
    taken, left = [0] * len(lengths), budget
    for i, n in enumerate(lengths):
        if left > window:
            taken[i] = min(counts[i], (left - window // 2) // n)
            left -= taken[i] * n
    goal = left
    mask, reach, parts = (1 << (goal + 1)) - 1, 1, []
    first = np.full(goal + 1, -1, np.int32)
    for i, n in enumerate(lengths):
        free, k = min(counts[i] - taken[i], goal // n), 1
        while free > 0:
            k = min(k, free)
            new = (reach << (k * n)) & mask & ~reach
            if new:
                low = (new & -new).bit_length() - 1 & ~7
                bits = np.unpackbits(np.frombuffer((new >> low).to_bytes((goal + 8 - low) // 8 + 1, "little"), np.uint8), bitorder="little")
                first[low + np.flatnonzero(bits)] = len(parts)
                reach |= new
            parts.append((i, k))
            free, k = free - k, 2 * k
        if reach >> goal & 1:
            break
    at = reach.bit_length() - 1
    short = goal - at
    while at:
        i, k = parts[first[at]]
        taken[i] += k
        at -= k * lengths[i]
    return taken, short


def _budget(pdf: pd.DataFrame) -> pd.DataFrame:
    """One source: a row a length; adds how many of the length's documents are taken once more than the others."""
    target, size = float(pdf["target"].iloc[0]), int(pdf["source_size"].iloc[0])
    whole = int(target // size) if size else 0
    lengths, counts = pdf["size"].astype(int).tolist(), pdf["_n"].astype(int).tolist()
    more = subset_sum(lengths, counts, int(round(target)) - whole * size)
    return pdf.assign(_whole=whole, _more=np.array(more, np.int64))


def mix_sources(df: DataFrame, source: str, size: str, order: Sequence[str], weights: Sequence[float] = (1, 2, 3), most: float = 3.0, total: float | None = None, seed: int = 0, most_sources: int = 100_000) -> DataFrame:
    """Adds ``source_size``, ``target`` and ``times``: how often the mix takes the row (0 to ``most`` rounded up).

    ``size`` is a long column without nulls; a null source is a source. Rows of size 0 are taken as often as the whole
    source is. Which rows of one length are taken once more follows a seeded hash of ``order``, then ``order``, so reruns
    agree. The driver gets one total a source (more than ``most_sources`` sources are an error); one task sees one source's
    counts by length, never its rows. An empty table gives an empty result. Columns named like the added ones are replaced.
    df is read twice: it should be a written table of short rows.
    """
    df = df.drop("source_size", "target", "times")
    src, sz, n, name, whole, more, h, rank, of, plan_src = free_names(df, "_src", "_size", "_n", "_name", "_whole", "_more", "_h", "_rank", "_of", "_plan_src")
    counts = written(df.groupBy(F.col(source).alias(src), F.col(size).alias(sz)).agg(F.count(F.lit(1)).alias(n)))
    sizes = counts.groupBy(src).agg(F.sum(F.col(sz) * F.col(n)).cast("long").alias("source_size"), F.sum(n).alias(n))
    known = sizes.limit(most_sources + 1).collect()
    if len(known) > most_sources:
        raise ValueError(f"more than {most_sources} sources")
    goal = targets([(r[src], int(r["source_size"])) for r in known], total, weights, most)
    per = df.sparkSession.createDataFrame([(r[src], int(r["source_size"]), float(goal[r[src]])) for r in known], f"{name} string, source_size long, target double")
    plan = counts.join(F.broadcast(per), F.col(src).eqNullSafe(F.col(name)))  # at most most_sources rows
    plan = plan.select(F.col(src).alias("src"), F.col(sz).alias("size"), F.col(n).alias("_n"), "source_size", "target")
    plan = plan.groupBy("src").applyInPandas(_budget, "src string, size long, _n long, source_size long, target double, _whole long, _more long")
    plan = written(plan.select(F.col("src").alias(plan_src), F.col("size").alias(of), "source_size", "target", F.col("_whole").alias(whole), F.col("_more").alias(more)))
    spread = unit_hash(seed, *order)
    ranked = gapless_rank(df.withColumn(h, spread), [source, size], [h, *order], F.col(h), rank, spread_over(sum(int(r[n]) for r in known))).drop(h)
    out = keyed_join(ranked, plan, [(source, plan_src), (size, of)], spread, "inner")
    times = F.col(whole) + (F.col(rank) < F.col(more)).cast("long")
    return out.withColumn("times", times).drop(plan_src, of, whole, more, rank)


def repeated(df: DataFrame, times: str) -> DataFrame:
    """Each row as often as ``times`` says."""
    i = free_name(df, "_i")
    return df.where(F.col(times) > 0).withColumn(i, F.explode(F.sequence(F.lit(1), F.col(times).cast("int")))).drop(i)


def mixed_documents(df: DataFrame, source: str, text: str, order: Sequence[str]) -> DataFrame:
    """The rows that a mix by words of ``text`` takes, each as often as it is taken, with the columns of df.

    Only the keys (``order``, a hash of the text, the source) and sizes are mixed; then df's rows are looked up by them, so
    texts are read twice and shuffled at most once. Rows that agree in all keys stand for each other: copies of one of them
    are taken as often as the mix takes them together. Null texts have size 0. An empty table gives an empty result.
    """
    keys = [f"_k{i}" for i in range(len(order))]
    own = [*[F.col(c) for c in order], F.xxhash64(text), F.col(source)]
    slim = written(df.select(*[c.alias(k) for c, k in zip(own, [*keys, "_hash", "_source"], strict=True)], count_words(text).alias("_size")))
    names = [*keys, "_hash", "_source"]
    mixed = mix_sources(slim, "_source", "_size", [*keys, "_hash"])
    taken, rows, *ks = free_names(df, "_taken", "_rows", *[f"{x}_of" for x in names])
    picks = mixed.groupBy(*names).agg(F.sum("times").cast("long").alias(taken), F.count(F.lit(1)).alias(rows))
    picks = written(picks.where(F.col(taken) > 0).select(*[F.col(x).alias(k) for x, k in zip(names, ks, strict=True)], taken, rows))
    same = F.lit(True)
    for c, k in zip(own, ks, strict=True):
        same = same & c.eqNullSafe(F.col(k))
    found = df.join(light(picks), same)
    again = picks.where(F.col(rows) > 1)
    if not again.isEmpty():
        found = found.where(F.col(rows) == 1).unionByName(found.where(F.col(rows) > 1).dropDuplicates(ks))
    return repeated(found, taken).select(*df.columns)
