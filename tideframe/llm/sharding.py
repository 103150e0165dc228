"""Best-fit-decreasing sharding: indivisible groups, largest first, enter the open shard with the tightest room.

Where a group goes depends on its size alone. So the plan is made on the counts of groups of each size: a run of equal
groups fills the tightest shard with room for one, then the next tightest. The plan says for each size which ranks go to
which shard, and a join by size and rank carries it to the groups. The capacity is the smallest, found by bisection, with
which no more than the wanted shards are needed. The driver holds one number for each different size of a group, of which
there are far fewer than groups (sizes that all differ add up to half their square).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, free_names, gapless_rank, keyed_join, spread_over, unit_hash, written


class Rooms:
    """A balanced search tree over (remaining room, shard): an AA tree, so every path is at most twice as long as another.
    Nodes are lists [level, key, left, right]."""

    def __init__(self) -> None:
        self.root: list | None = None

    @staticmethod
    def _skew(t: list) -> list:
        if t[2] is not None and t[2][0] == t[0]:
            x = t[2]
            t[2], x[3] = x[3], t
            return x
        return t

    @staticmethod
    def _split(t: list) -> list:
        if t[3] is not None and t[3][3] is not None and t[3][3][0] == t[0]:
            x = t[3]
            t[3], x[2] = x[2], t
            x[0] += 1
            return x
        return t

    def add(self, key: tuple[int, int]) -> None:
        def put(t: list | None) -> list:
            if t is None:
                return [1, key, None, None]
            side = 2 if key < t[1] else 3
            t[side] = put(t[side])
            return self._split(self._skew(t))

        self.root = put(self.root)

    def remove(self, key: tuple[int, int]) -> None:
        def cut(t: list | None, key: tuple[int, int]) -> list | None:
            if t is None:
                return None
            if key != t[1]:
                side = 2 if key < t[1] else 3
                t[side] = cut(t[side], key)
            elif t[2] is None or t[3] is None:
                return t[3] if t[2] is None else t[2]
            else:
                heir = t[3]
                while heir[2] is not None:
                    heir = heir[2]
                t[1] = heir[1]
                t[3] = cut(t[3], heir[1])
            low = min(x[0] if x is not None else 0 for x in (t[2], t[3])) + 1
            if low < t[0]:
                t[0] = low
                if t[3] is not None and t[3][0] > low:
                    t[3][0] = low
            t = self._skew(t)
            if t[3] is not None:
                t[3] = self._skew(t[3])
                if t[3][3] is not None:
                    t[3][3] = self._skew(t[3][3])
            t = self._split(t)
            if t[3] is not None:
                t[3] = self._split(t[3])
            return t

        self.root = cut(self.root, key)

    def tightest(self, size: int) -> tuple[int, int] | None:
        """The smallest (room, shard) with room for the size."""
        t, best = self.root, None
        while t is not None:
            if t[1][0] >= size:
                best, t = t[1], t[2]
            else:
                t = t[3]
        return best


def plan_shards(counts: Sequence[tuple[int, int]], capacity: int, most: int | None = None) -> list[tuple[int, int, int, int]] | None:
    """(size, first rank, end rank, shard) of best fit decreasing over (size, count); an item over the capacity fills a
    shard of its own. None as soon as more than ``most`` shards are open.

    >>> plan_shards([(7, 1), (6, 1), (4, 1), (3, 1)], 10)
    [(7, 0, 1, 0), (6, 0, 1, 1), (4, 0, 1, 1), (3, 0, 1, 0)]
    """
    rooms, shards, plan = Rooms(), 0, []
    for size, count in sorted(counts, reverse=True):
        rank = 0
        while rank < count:
            found = rooms.tightest(size)
            if found is None:
                found = max(capacity, size), shards
                shards += 1
                if most is not None and shards > most:
                    return None
            else:
                rooms.remove(found)
            room, shard = found
            n = min(count - rank, room // size if size else count)
            plan.append((size, rank, rank + n, shard))
            rooms.add((room - n * size, shard))
            rank += n
    return plan


def fit_into(counts: Sequence[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int]]:
    """The plan of the smallest capacity found that needs no more than ``shards`` shards: steps up double from the least
    that could do, then the last step is halved."""
    total, largest = sum(s * n for s, n in counts), max((s for s, _ in counts), default=0)
    low, step = max(-(-total // shards), largest), 1
    best, high = plan_shards(counts, low, shards), low
    while best is None:
        low, high = high + 1, high + step
        step *= 2
        best = plan_shards(counts, high, shards)
    while low < high:
        middle = (low + high) // 2
        plan = plan_shards(counts, middle, shards)
        if plan is None:
            low = middle + 1
        else:
            high, best = middle, plan
    return best


def shard_groups(df: DataFrame, group: str, size: str, shards: int, order: Sequence[str] = (), seed: int = 0) -> DataFrame:
    """Adds ``shard`` (int, 0 to shards - 1) and ``slot`` (long, gapless from 0 in each shard).

    Rows with one value of ``group`` (a string; null is a value) share a shard. Shards are near equal by the sum of
    ``size`` (null counts as 0), as far as the largest group allows. Groups of one size are taken by a seeded hash. Rows in
    a shard are numbered by a seeded hash of ``order``, then by ``order``; repeated rows each get a slot. Extra columns
    stay. An empty table stays empty. Existing columns named ``shard`` or ``slot`` are replaced.
    """
    df = df.drop("shard", "slot")
    g, s, n, h, rank, a, b, of, g2, s2 = free_names(df, "_group", "_size", "_n", "_spread", "_rank", "_first", "_end", "_shard", "_group_of", "_size_of")
    key, spread = F.coalesce(F.concat(F.lit("="), F.col(group)), F.lit("null")), unit_hash(seed, *order)
    groups = written(df.groupBy(key.alias(g)).agg(F.coalesce(F.sum(size), F.lit(0)).cast("long").alias(s), F.count(F.lit(1)).alias(n)))
    sizes = groups.groupBy(s).agg(F.count(F.lit(1)).alias(n), F.sum(n).alias("rows")).collect()  # one row a different size
    plan = fit_into([(int(r[s]), int(r[n])) for r in sizes], shards)
    rows = sum(int(r["rows"]) for r in sizes)
    table = df.sparkSession.createDataFrame([tuple(map(int, x)) for x in plan], f"{s2} long, {a} long, {b} long, {of} int")
    ranked = gapless_rank(groups.withColumn(h, unit_hash(seed, g)), [s], [h, g], F.col(h), rank, spread_over(rows)).drop(h)
    within = (F.col(s) == F.col(s2)) & (F.col(rank) >= F.col(a)) & (F.col(rank) < F.col(b))
    placed = ranked.join(F.broadcast(table) if len(plan) <= BROADCAST_ROWS else table.hint("merge"), within)
    placed = written(placed.select(F.col(g).alias(g2), n, F.col(of).alias("shard")))
    # a group of copies can hold a third of all rows: groups over 1 / 1,000 of the rows, 1,000 at most, are broadcast
    hot = written(placed.where(F.col(n) * 1000 >= rows).drop(n))
    left = keyed_join(df.withColumn(g, key), hot, [(g, g2)], spread).withColumnRenamed("shard", of).drop(g2)
    apart = F.when(F.col(of).isNull(), F.col(g)).otherwise(F.concat(F.lit("#"), spread.cast("string")))
    left = left.withColumn(g, apart).join(placed.where(F.col(n) * 1000 < rows).drop(n), F.col(g) == F.col(g2), "left")
    out = left.withColumn("shard", F.coalesce(of, "shard")).drop(g, g2, of).withColumn(h, spread)
    return gapless_rank(out, ["shard"], [h, *order], F.col(h), "slot", spread_over(rows)).drop(h)
