"""A Merkle manifest of a dataset: leaves of rows, a root for each group, a root of the groups' roots, and a proof a row.

A group's leaves are numbered in their order. Each aligned block of 256 nodes keeps every level as one string of hex
digits: parents hash its substrings of two digests, a node's sibling at a level is the substring that flanks it, and these
substrings, level by level, are the node's segment of the proof. Block roots are the nodes of the next, smaller table, in
the same form, until a group is one block; the groups' roots are then a group of their own. Paths are carried down again
from the root, a row a block, and only in the last step does a block become its rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import free_names, keyed_join, light, unit_hash, written

#: Levels inside a block, and the hex digits of a digest.
DEPTH, DIGITS = 8, 64
#: A level as bytes: a substring of bytes is found at once, one of characters by counting them.
_LEVELS, _STEPS = "array<binary>", "array<struct<sibling:binary,right:boolean>>"


def field(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    """Hex SHA-256 of the fields of a row, one after the other."""
    return F.sha2(F.concat(*map(field, values)).cast("binary"), 256)


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its siblings lead to, as hex digits."""
    up = lambda node, s: F.sha2(F.when(s["right"], F.concat(s["sibling"], node)).otherwise(F.concat(node, s["sibling"])), 256).cast("binary")
    return F.aggregate(steps, leaf.cast("binary"), up).cast("string")


def siblings(steps: Column) -> Column:
    """The hex digits of all siblings, level by level."""
    return F.array_join(F.transform(steps, lambda s: s["sibling"].cast("string")), "")


def ordered_rank(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str, rows: int) -> DataFrame:
    """df with ``name``: 0, 1, 2, ... of each key's rows (null is a key) in the order of ``order``.

    Rows are dealt to tasks by ranges of (keys, order), so one key may hold them all; a task numbers its own rows, and each
    key's counts by task, at most keys + tasks rows, say where a task's numbers begin. Rows that tie in ``order`` share a
    task and get different numbers.
    """
    task, at, first, n, start, of, *ks = free_names(df, "_task", "_at", "_first", "_n", "_start", "_task_of", *[f"_k{i}_" for i in range(len(keys))])
    by = [*[F.col(k).asc_nulls_first() for k in keys], *order]
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // 500_000)
    dealt = df.repartitionByRange(tasks, *by).sortWithinPartitions(*by)
    own = written(dealt.withColumn(task, F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id()))
    counts = own.groupBy(*keys, task).agg(F.min(at).alias(first), F.count(F.lit(1)).alias(n))
    before = Window.partitionBy(*keys).orderBy(task).rowsBetween(Window.unboundedPreceding, -1)
    starts = written(counts.select(*[F.col(k).alias(x) for k, x in zip(keys, ks, strict=True)], F.col(task).alias(of), first, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(start)))
    same = F.col(task) == F.col(of)
    for k, x in zip(keys, ks, strict=True):
        same = same & F.col(k).eqNullSafe(F.col(x))
    return own.join(light(starts), same).withColumn(name, F.col(at) - F.col(first) + F.col(start)).drop(task, at, of, first, start, *ks)


def _levels(lowest: Column, steps: Column) -> Column:
    """Every level of a block, lowest first: substrings of two digests are hashed to the next; a single last one, alone."""
    two = 2 * DIGITS
    pairs = lambda level: F.sequence(F.lit(0), F.floor((F.octet_length(level) - 1) / two).cast("int"))
    parents = lambda level: F.transform(pairs(level), lambda j: F.sha2(F.substring(level, j * two + 1, F.lit(two)), 256))
    rounds = F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(rounds, F.array(lowest).cast(_LEVELS), lambda levels, _: F.concat(levels, F.array(F.array_join(parents(F.element_at(levels, -1)), "").cast("binary"))))


def _blocks(nodes: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """(g, block, n, members, levels) of nodes (g, n: the group's nodes, place, node); members are in order, with ``carried``."""
    member = F.struct(F.pmod("place", F.lit(1 << DEPTH)).cast("int").alias("at"), "node", *carried)
    one = nodes.groupBy("g", F.shiftright("place", DEPTH).alias("block")).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(member)).alias("members"))
    size = F.size("members")
    # a group's only block goes up to one node; each of several, to its node of the next table
    steps = F.when(F.col("n") > 1 << DEPTH, F.lit(DEPTH)).when(size > 1, F.length(F.bin(size - 1))).otherwise(0).cast("int")
    lowest = F.array_join(F.transform("members", lambda m: m["node"]), "").cast("binary")
    return written(one.withColumn("_lowest", lowest).withColumn("_steps", steps).withColumn("levels", _levels(F.col("_lowest"), F.col("_steps"))).drop("_lowest", "_steps"))


def _top() -> Column:
    return F.element_at("levels", -1).cast("string")


def _tree(nodes: DataFrame, most: int, carried: Sequence[str] = ()) -> list[DataFrame]:
    """Block tables from the leaves up to one block a group. most: nodes of the largest group."""
    tables = [_blocks(nodes, carried)]
    while most > 1 << DEPTH:
        most = -(-most >> DEPTH)
        up = tables[-1].select("g", F.shiftright(F.col("n") + (1 << DEPTH) - 1, DEPTH).alias("n"), F.col("block").alias("place"), _top().alias("node"))
        tables.append(_blocks(up))
    return tables


def _paths(blocks: DataFrame, above: Sequence[str]) -> DataFrame:
    """(g, block, path, above) of the blocks below: each member's steps to the root. blocks has path, that of its own root."""
    m = blocks.select("g", F.col("block").alias("_b"), "levels", "path", *above, F.explode("members").alias("_m"))
    return m.select("g", (F.shiftleft("_b", DEPTH) + F.col("_m.at")).alias("block"), _steps(F.col("_m.at")).alias("path"), *above)


def _steps(at: Column) -> Column:
    """A member's steps: the substrings that flank it at each level of its block, then its block's own path."""
    node = lambda i: F.call_function("shiftright", at, i)
    beside = lambda level, i: F.substring(level, node(i).bitwiseXOR(F.lit(1)) * DIGITS + 1, F.lit(DIGITS))
    step = lambda level, i: F.struct(beside(level, i).alias("sibling"), (node(i).bitwiseAND(F.lit(1)) == 1).alias("right"))
    return F.concat(F.transform(F.slice("levels", 1, F.size("levels") - 1), step), F.col("path"))


def merkle_proofs(df: DataFrame, group: str, order: Sequence[str], leaf: str, carried: Sequence[str] = ()) -> DataFrame:
    """(carried, leaf, subroot, root, steps) of every row: a tree of each group's leaves and one of the groups' roots.

    Leaves ascend by ``order``, then by leaf, nulls first; groups ascend bytewise, null first. ``leaf`` holds hex digests and
    no null. steps are (sibling, right): from the leaf to the root, the other node of the pair (empty if there is none) and
    whether the row's own is the right one; see fold() and siblings(). Repeated rows are leaves each; an empty table gives an
    empty one, and other columns are left out. All leaves with one order value are numbered by one task.
    """
    keep = list(dict.fromkeys(carried))
    names = [f"c{i}" for i in range(len(keep))]
    rows = df.select(F.col(group).alias("grp"), F.struct(*order).alias("ord"), F.col(leaf).alias("node"), *[F.col(c).alias(x) for c, x in zip(keep, names, strict=True)])
    rows = written(rows)  # leaves are hashed once, and the texts stay behind
    sizes = written(rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n")))
    total, most, groups = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0)), F.count(F.lit(1))).first()
    numbered = written(ordered_rank(sizes, [], [F.col("grp").asc_nulls_first()], "g", groups).select(F.col("grp").alias("of"), "n", "g"))
    ranked = ordered_rank(rows, ["grp"], [F.col("ord").asc_nulls_first(), F.col("node")], "place", total)
    nodes = keyed_join(ranked, numbered, [("grp", "of")], unit_hash(1, "place"), "inner").select("g", "n", "place", "node", *names)
    lower = _tree(nodes, most, names)
    upper = _tree(lower[-1].select(F.lit(0).cast("long").alias("g"), F.lit(groups).cast("long").alias("n"), F.col("g").alias("place"), _top().alias("node")), groups)
    # down again: the root tree, then each group's
    down = upper[-1].withColumn("root", _top()).withColumn("path", F.array().cast(_STEPS))
    for table in upper[-2::-1]:
        down = table.join(_paths(down, ["root"]), ["g", "block"])
    down = _paths(down, ["root"]).select(F.col("block").alias("g"), F.lit(0).cast("long").alias("block"), "path", "root")
    down = lower[-1].join(down, ["g", "block"]).withColumn("subroot", _top())
    for table in lower[-2::-1]:
        down = table.join(_paths(down, ["root", "subroot"]), ["g", "block"])
    out = down.select("levels", "path", "root", "subroot", F.explode("members").alias("_m"))
    return out.select(*[F.col(f"_m.{x}").alias(c) for c, x in zip(keep, names, strict=True)], F.col("_m.node").alias("leaf"), "subroot", "root", _steps(F.col("_m.at")).alias("steps"))
