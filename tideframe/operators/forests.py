"""A survival forest of discrete hazards, grown as sums over cells of binned rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .splits import settled

#: Bins of a feature, and points among which its bins' ends are chosen.
BINS, POINTS = 32, 512
#: Cells that share a generator.
BLOCK = 4096


def _binned(df: DataFrame, n: int, ends: Sequence[Sequence[float]]) -> DataFrame:
    """df with _b0, _b1, ...: how many of a feature's ends lie below its value (_x0, _x1, ...)."""
    some = [i for i in range(n) if len(ends[i])]
    if some:
        edges = [[-np.inf, *[float(np.nextafter(e, np.inf)) for e in ends[i]], np.inf] for i in some]
        df = Bucketizer(inputCols=[f"_x{i}" for i in some], outputCols=[f"_b{i}" for i in some], splitsArray=edges, handleInvalid="keep").transform(df)
    return df.withColumns({f"_b{i}": F.col(f"_b{i}").cast("int") if i in some else F.lit(0) for i in range(n)})


def _ends(rows: DataFrame, n: int) -> list[list[float]]:
    """Ends of at most BINS bins of each feature of about as many periods (sums of _time), between values that occur."""
    at = F.array(*[F.lit(i / POINTS) for i in range(POINTS + 1)])
    found = rows.agg(*[F.percentile_approx(f"_x{i}", at, 10_000).alias(f"_q{i}") for i in range(n)]).first()
    fine = []
    for i in range(n):
        u = np.unique(np.array(found[i] or [0.0], float))
        fine.append(((u[1:] + u[:-1]) / 2).tolist())
    kinds = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"_b{i}").alias("b")) for i in range(n)])).alias("_k")
    weight = [np.zeros(len(f) + 1) for f in fine]
    for r in _binned(rows, n, fine).select("_time", kinds).groupBy("_k").agg(F.sum("_time").alias("w")).collect():  # POINTS rows a feature
        weight[r["_k"]["i"]][min(r["_k"]["b"], len(fine[r["_k"]["i"]]))] += r["w"]
    out = []
    for f, w in zip(fine, weight, strict=True):
        if len(f) >= BINS:
            past = np.cumsum(w)
            f = [f[j] for j in np.unique(np.searchsorted(past, past[-1] * np.arange(1, BINS) / BINS)) if j < len(f)]
        out.append(f)
    return out


def _routed(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
    """The node of one tree (heap order, root 1) that each row of bins ends in."""
    at, every = np.ones(len(bins), np.int64), np.arange(len(bins))
    for _ in range(depth):
        f = feature[at]
        at = np.where(f < 0, at, 2 * at + (bins[every, np.maximum(f, 0)] > cut[at]))
    return at


def _split(sums: np.ndarray, allowed: np.ndarray, leaf: int) -> tuple[int, int]:
    """(feature, bin) of the greatest fall of Gini's impurity, of sums (features x bins x 2); (-1, 0) if there is none."""
    left = sums[allowed].cumsum(1).astype(float)
    all_ = left[:, -1:]
    right = all_ - left
    with np.errstate(all="ignore"):
        square = lambda z: np.nan_to_num((z**2).sum(-1) / z.sum(-1))
        gain = (square(left) + square(right) - square(all_)) / all_.sum(-1)
    gain[(left.sum(-1) < leaf) | (right.sum(-1) < leaf)] = -1.0
    i, b = np.unravel_index(gain.argmax(), gain.shape)
    return (int(allowed[i]), int(b)) if gain[i, b] > 1e-12 else (-1, 0)


def survival_forest_scores(train: DataFrame, test: DataFrame, features: Sequence[str], time: str, event: str, unit: str, trees: int = 100, depth: int = 5, leaf: int = 10, seed: int = 42, prune: bool = True) -> DataFrame:
    """(unit, risk): a forest of discrete hazards. A train row of duration t counts in periods 1 to t, in the last with the
    event; risk is the sum of a test row's hazards over all periods. Durations are months: a small whole number. Missing
    features are 0.

    Splits lie between bins, so rows of the same bins, period and event are one cell with a count, and no row is repeated
    for its periods or trees. A tree's resample gives a cell of n rows Poisson(n), which is what n rows of Poisson(1) add
    up to; draws depend on the cells alone, not on partitions. A node splits on the best of the root of the features' number. A
    level of all trees is one pass: tasks add up histograms of nodes, which meet by tree; the driver gets a line a node.

    prune: two leaves on the same side of one half become one, as Spark ML's classifiers do; where no hazard comes near one
    half, that leaves nothing of a tree, and all risks are equal.
    """
    n = len(features)
    x = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"_x{i}") for i, c in enumerate(features)]
    rows = settled(train.select(*x, F.col(time).cast("int").alias("_time"), (F.col(event) == 1).alias("_event")).where("_time >= 1"))
    longest = int(rows.agg(F.max("_time")).first()[0] or 1)
    ends = _ends(rows, n)
    b = [f"_b{i}" for i in range(n)]
    alike = _binned(rows, n, ends).groupBy(*b, "_time", "_event").agg(F.count(F.lit(1)).alias("_n"))
    lived = alike.withColumn("_t", F.explode(F.sequence(F.lit(1), "_time")))
    now = F.col("_event") & (F.col("_t") == F.col("_time"))
    cells = settled(lived.groupBy(*b, "_t").agg(F.sum(F.when(~F.coalesce(now, F.lit(False)), F.col("_n")).otherwise(0)).alias("_0"), F.sum(F.when(now, F.col("_n")).otherwise(0)).alias("_1")))
    blocks = max(1, -(-cells.count() // BLOCK))
    line = F.flatten(F.sort_array(F.collect_list(F.array(*[F.col(c).cast("bigint") for c in (*b, "_t", "_0", "_1")]))))
    packed = settled(cells.groupBy(F.pmod(F.xxhash64(*b, "_t"), F.lit(blocks)).alias("block")).agg(line.alias("cells")))

    d, width, size = n + 1, max(BINS, longest), 2 ** (depth + 1)
    k = int(np.ceil(np.sqrt(d)))
    feature, cut, hazard = np.full((trees, size), -1), np.zeros((trees, size), np.int64), np.zeros((trees, size))
    open_ = np.zeros((trees, size), bool)
    open_[:, 1] = True
    for level in range(depth):
        if not open_.any():
            break

        def add_up(batches: Iterator[pa.RecordBatch], level: int = level) -> Iterator[pa.RecordBatch]:
            total = np.zeros((trees, 2**level, d, width, 2), np.int64)
            for batch in batches:
                for block, flat in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    own = np.asarray(flat.values).reshape(-1, d + 2)
                    bins = own[:, :d] - np.eye(d, dtype=np.int64)[-1]  # period 1 is bin 0
                    drawn = np.random.default_rng([seed, block])
                    for tree in range(trees):
                        w = drawn.poisson(own[:, d:])
                        at = _routed(bins, feature[tree], cut[tree], level)
                        on = np.flatnonzero(open_[tree][at])
                        for f in range(d):
                            place = (at[on] - 2**level) * width + bins[on, f]
                            for c in (0, 1):
                                total[tree, :, f, :, c] += np.bincount(place, w[on, c], 2**level * width).astype(np.int64).reshape(-1, width)
            tree, node = np.nonzero(open_[:, 2**level : 2 ** (level + 1)])
            yield pa.RecordBatch.from_arrays([pa.array(tree), pa.array(node + 2**level), pa.array([total[i, j].tobytes() for i, j in zip(tree, node, strict=True)], pa.binary())], names=["tree", "node", "sums"])

        def chosen(table: pa.Table) -> pa.Table:
            sums: dict[int, np.ndarray] = {}
            for node, part in zip(table["node"].to_pylist(), table["sums"].to_pylist(), strict=True):
                sums[node] = sums.get(node, 0) + np.frombuffer(part, np.int64).reshape(d, width, 2)
            tree, out = table["tree"][0].as_py(), []
            for node, h in sums.items():
                allowed = np.sort(np.random.default_rng([seed, tree, node]).permutation(d)[:k])
                f, at = _split(h, allowed, leaf)
                left = h[max(f, 0), : at + 1].sum(0)
                out.append((tree, node, f, at, h[0].sum(0).tolist(), left.tolist()))
            names = ["tree", "node", "feature", "cut", "all", "left"]
            kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())] * 2
            return pa.table({c: pa.array(v, t) for c, v, t in zip(names, zip(*out, strict=True), kinds, strict=True)})

        lines = packed.mapInArrow(add_up, "tree long, node long, sums binary").groupBy("tree").applyInArrow(chosen, "tree long, node long, feature long, cut long, all array<long>, left array<long>").collect()
        open_ = np.zeros((trees, size), bool)
        for r in lines:
            tree, node, all_, left = r["tree"], r["node"], np.array(r["all"]), np.array(r["left"])
            hazard[tree, node] = all_[1] / max(all_.sum(), 1)
            if r["feature"] >= 0:
                feature[tree, node], cut[tree, node] = r["feature"], r["cut"]
                for child, z in ((2 * node, left), (2 * node + 1, all_ - left)):
                    hazard[tree, child] = z[1] / max(z.sum(), 1)
                    open_[tree, child] = True
    if prune:
        for tree in range(trees):
            for node in range(size // 2 - 1, 0, -1):
                if feature[tree, node] >= 0 and (feature[tree, 2 * node : 2 * node + 2] < 0).all() and (hazard[tree, 2 * node] > 0.5) == (hazard[tree, 2 * node + 1] > 0.5):
                    feature[tree, node] = -1

    @F.pandas_udf("double")
    def risk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for batch in batches:
            out = np.zeros(len(batch))
            for start in range(0, len(batch), 1000):
                own = batch.iloc[start : start + 1000].to_numpy(np.int64)
                grid = np.column_stack([np.repeat(own, longest, 0), np.tile(np.arange(longest), len(own))])
                total = sum(hazard[tree][_routed(grid, feature[tree], cut[tree], depth)] for tree in range(trees))
                out[start : start + 1000] = total.reshape(-1, longest).sum(1) / trees
            yield pd.Series(out)

    scored = _binned(test.select(unit, *x), n, ends)
    return scored.withColumn("_r", risk(F.struct(*b))).groupBy(unit).agg(F.sum("_r").alias("risk"))
