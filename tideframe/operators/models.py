"""Models on two axes of scale: many fits and many rows. Fits are sums over rows (see fits and survival), products of columns,
or Spark ML; what reaches the driver is features x features a fit."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.draws import draw_unit
from ..functions.numbers import sigmoid
from . import fits
from .forests import survival_forest_scores  # noqa: F401

# --- logistic fits ------------------------------------------------------------------------------------------------


def fit_logistic(df: DataFrame, keys: Sequence[str], features: Sequence[str], label: str, penalty: float = 1.0, rounds: int = 30, most_keys: int = 100_000) -> DataFrame:
    """(keys, beta): L2 logistic regression for each key (intercept first, not penalised), by Newton's method over any number of rows.

    A step is one aggregation by key of the gradient and the upper half of the Hessian, partly summed in tasks; the driver
    solves a p x p system a key. Keys that have settled take no part in later steps. Keys with one label are left out.
    """
    q = len(features) + 1
    rows = df.select(*keys, F.col(label).cast("double").alias("_y"), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(features, 1)]).where("_y IS NOT NULL").persist()
    two = rows.groupBy(*keys).agg(F.min("_y").alias("_a"), F.max("_y").alias("_b")).where("_a < _b").select(*keys).limit(most_keys + 1).collect()
    if len(two) > most_keys:
        raise ValueError(f"more than {most_keys} keys to fit")
    beta = {tuple(r): np.zeros(q) for r in two}
    moving, ridge = set(beta), penalty * np.eye(q)
    ridge[0, 0] = 1e-9
    x = [F.lit(1.0), *[F.col(f"_x{i}") for i in range(1, q)]]
    pairs = [(i, j) for i in range(q) for j in range(i, q)]
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    table = lambda some: df.sparkSession.createDataFrame([(*k, beta[k].tolist()) for k in some], f"{kinds}, beta array<double>")
    for _ in range(rounds):
        if not moving:
            break
        z = sum((x[i] * F.col("beta")[i] for i in range(1, q)), F.col("beta")[0])
        now = rows.join(F.broadcast(table(sorted(moving))), list(keys)).withColumn("_p", 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-35.0)), F.lit(35.0)))))
        weight = F.greatest(F.col("_p") * (1 - F.col("_p")), F.lit(1e-9))
        now = now.withColumn("_r", F.col("_y") - F.col("_p")).withColumn("_w", weight)
        sums = now.groupBy(*keys).agg(*[F.sum(F.col("_r") * x[i]).alias(f"g{i}") for i in range(q)], *[F.sum(F.col("_w") * x[i] * x[j]).alias(f"h{i}_{j}") for i, j in pairs]).collect()
        for r in sums:
            k = tuple(r[c] for c in keys)
            hess = ridge.copy()
            for i, j in pairs:
                hess[i, j] += r[f"h{i}_{j}"]
                hess[j, i] = hess[i, j]
            step = np.linalg.solve(hess, np.array([r[f"g{i}"] for i in range(q)]) - ridge @ beta[k])
            beta[k] = beta[k] + np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-9:
                moving.discard(k)
    rows.unpersist()
    return table(sorted(beta))


def _frame(spark: SparkSession, df: DataFrame, keys: Sequence[str], rows: list[tuple], more: str) -> DataFrame:
    """A table of a few values a key."""
    return spark.createDataFrame(rows, ", ".join([*[f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys], more]))


def score_splits(df: DataFrame, keys: Sequence[str], unit: str, features: Sequence[str], label: str, held: str, c: float = 1.0, l1: bool = False, c_column: str | None = None) -> DataFrame:
    """(keys, unit, label, score) of the held-out units of each key: logistic regression on the others, scaled on them. L1
    takes the key's own C if there is a ``c_column``."""
    rows = fits.fit_rows(df, keys, unit, features, label, held)
    own = {tuple(r[k] for k in keys): r["_c"] for r in df.groupBy(*keys).agg(F.max(c_column).alias("_c")).collect()} if c_column else {}
    found = fits.fit_all(rows, fits.Plan(1, (1 / c,), each={i: np.array([1 / own[k]]) for i, k in enumerate(rows.keys) if own.get(k)}), l1=l1)
    rows.close()
    z = _scaled(df, keys, [unit, label], features, held, rows, found, {i: b[0].tolist() for i, b in found.beta.items()}, "_beta array<double>")
    linear = sum((F.col(x) * F.col("_beta")[i] for i, x in enumerate(features, 1)), F.col("_beta")[0])
    return z.select(*keys, unit, label, sigmoid(linear).alias("score"))


def _scaled(df: DataFrame, keys: Sequence[str], more: Sequence[str], features: Sequence[str], held: str, rows: fits.Rows, found: fits.Fitted, value: dict, kind: str) -> DataFrame:
    """The rows held out of the keys that have fits, features on the scale of the fit, with a value of the key."""
    table = [(*rows.keys[i], found.scale[i][0][-1].tolist(), found.scale[i][1][-1].tolist(), v) for i, v in value.items()]
    joined = df.where(F.col(held)).select(*keys, *more, *features).join(F.broadcast(_frame(df.sparkSession, df, keys, table, f"_mean array<double>, _factor array<double>, {kind}")), list(keys))
    return joined.withColumns({x: (F.coalesce(F.col(x).cast("double"), F.lit(0.0)) - F.col("_mean")[i]) * F.col("_factor")[i] for i, x in enumerate(features)})


def permutation_aucs(df: DataFrame, split: str, features: Sequence[str], label: str, held: str, order: str, perms: int = 100, c: float = 1.0, seed: int = 42, grid: Sequence[float] | None = None) -> DataFrame:
    """(split, perm, auc, c): perm 0 is the fit on the true training labels, the others on shuffled ones; AUC is always on the
    true labels held out. With a ``grid``, each split and permutation chooses its own C: the value of best accuracy over
    three keyed folds of its training rows (the smallest of equal ones). Any number of rows a split, see fits."""
    rows = fits.fit_rows(df, [split], order, features, label, held, seed=seed)
    if grid is None:
        found, used = fits.fit_all(rows, fits.Plan(perms + 1, (1 / c,))), {}
    else:
        tried = sorted(grid)
        cv = fits.fit_all(rows, fits.Plan(perms + 1, [1 / x for x in tried], 3))

        def right(k: int, b: dict[str, np.ndarray]) -> dict[int, np.ndarray]:
            if k not in cv.beta:
                return {}
            fold = cv.plan.of(k)[2]
            own, out = cv.plan.fold(b), np.zeros(len(fold))
            for f in range(3):
                part, at = {n: v[own == f] for n, v in b.items()}, np.flatnonzero(fold == f)
                for a in range(0, len(part["y"]), step := max(1, fits.CELLS // len(at))):
                    some = {n: v[a : a + step] for n, v in part.items()}
                    y = fits.labels(some, np.arange(perms + 1), cv.cut[k]) == 1  # fits of a fold are shuffles x penalties
                    up = (fits.scaled(some, cv.scale[k], f) @ cv.beta[k][at].T > 0).reshape(*y.shape, len(tried))
                    out[at] += (up == y[:, :, None]).sum(0).ravel()
            return {k: out}

        hits = fits.sums(rows.table.where("NOT _held"), right)
        used = {k: np.array(tried)[v.reshape(perms + 1, len(tried), 3).sum(2).argmax(1)] for k, v in hits.items()}
        found = fits.fit_all(rows, fits.Plan(perms + 1, each={k: 1 / v for k, v in used.items()}), cut=cv.cut)
    score = lambda k, b, at: fits.scaled(b, found.scale[k], -1) @ found.beta[k][at].T
    value = fits.aucs(rows, found, "_held", lambda k, b: (score(k, b, slice(None)), np.arange(perms + 1)), some=score, many=perms + 1)
    rows.close()
    out = [(rows.keys[k][0], p, v, float(used[k][p]) if k in used else c) for k, own in value.items() for p, v in own.items()]
    return _frame(df.sparkSession, df, [split], out, "perm long, auc double, c double")


def _without_a_row(rows: fits.Rows, plan: fits.Plan, l1: bool) -> dict[int, dict]:
    """The series (fits.series) of the keys of many rows, each a fold of its own; the plan keeps the fits of these keys that
    the series don't settle."""
    train = rows.table.where("NOT _held")
    size = train.groupBy("_k").agg(F.count(F.lit(1)).alias("n"), F.count("_f").alias("f"), (F.max("_f") + 1).alias("m"))
    many = [r["_k"] for r in size.where(f"n >= {fits.SERIES_ROWS} AND n = f AND n = m").collect()]  # a row a key
    if not many:
        return {}
    some = fits.Rows(rows.table.where(F.col("_k").isin(many)), rows.keys, rows.features)
    full = fits.fit_all(some, fits.Plan(1, plan.penalties), l1)
    near = fits.series(train, full, plan.penalties, l1)
    penalties = plan.penalties

    def open_(k: int, b: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        row, c = np.nonzero(~fits.left_out(b, near[k], penalties, l1)[1])
        yield pa.RecordBatch.from_arrays([pa.array([k] * len(row), pa.int32()), pa.array(b["f"][row], pa.int32()), pa.array(c, pa.int32())], names=["k", "f", "c"])

    left = fits.score_rows(rows, near, "NOT _held", open_, "k int, f int, c int").collect()
    for k in near:
        own = sorted((r["c"], r["f"]) for r in left if r["k"] == k)
        plan.only[k] = (np.array([penalties[c] for c, _ in own]), np.array([f for _, f in own], int))
    return near


def choose_c(df: DataFrame, keys: Sequence[str], features: Sequence[str], label: str, order: str, grid: Sequence[float], folds: int | None = 3, l1: bool = False, cluster: str | None = None) -> DataFrame:
    """(keys, c, auc, nonzero): the grid value with the best pooled cross-validated AUC (the smallest of equal ones).
    folds=None leaves one row (``order``) out: a key of many rows has these fits from the series of its loss about the fit to
    all rows (fits.left_out), and only where that is not exact enough by passes over its rows. Folds are keyed draws; with ``cluster``, each of its values is a fold. Rows
    that have one class only outside their fold have no score; keys without an AUC are left out."""
    tried = sorted(grid)
    one = cluster or (order if folds is None else None)
    rows = fits.fit_rows(df, keys, order, features, label, cluster=one)
    penalties = [1 / c for c in tried]
    plan = fits.Plan(1, penalties, 0 if one else folds, bool(one))
    near = _without_a_row(rows, plan, l1) if folds is None and not cluster else {}
    rest = fits.Rows(rows.table.where(~F.col("_k").isin([k for k in near if not len(plan.only[k][0])])), rows.keys, rows.features)
    cv = fits.fit_all(rest if near else rows, plan, l1)

    def scores(k: int, b: dict[str, np.ndarray], at: slice) -> np.ndarray:
        if k in near:
            out, _ = fits.left_out(b, near[k], penalties, l1)
            place = {int(f): i for i, f in enumerate(b["f"])}
            for c, f, beta in zip(*plan.only[k], cv.beta.get(k, ()), strict=True):
                if f in place:
                    mean, factor = cv.scale[k]
                    out[place[f], penalties.index(c)] = beta[0] + ((b["x"][place[f]] - mean[f]) * factor[f]) @ beta[1:]
            return out[:, at]
        beta = cv.beta[k].reshape(len(tried), -1, len(features) + 1)[at]
        own, out = cv.plan.fold(b), np.full((len(b["y"]), len(beta)), np.nan)
        rest = cv.lines[k].sum(0) - cv.lines[k][1:]
        if not len(rest):
            return out
        left = (own >= 0) & ((0 < rest[:, 1]) & (rest[:, 1] < rest[:, 0]))[own]
        mean, factor = cv.scale[k]
        x = np.column_stack([np.ones(left.sum()), (b["x"][left] - mean[own[left]]) * factor[own[left]]])
        out[left] = np.einsum("ni,cni->nc", x, beta[:, own[left]])
        return out

    value = fits.aucs(rows, {*cv.beta, *near}, "NOT _held", lambda k, b: (scores(k, b, slice(None)), np.arange(len(tried))), some=None if near else scores, many=len(tried))
    best = {k: max(own, key=lambda i, own=own: (round(own[i], 12), -i)) for k, own in value.items()}
    full = fits.fit_all(rows, fits.Plan(1, (1.0,), each={k: np.array([1 / tried[i]]) for k, i in best.items()}), l1)
    rows.close()
    out = [(*rows.keys[k], float(tried[i]), value[k][i], int((np.abs(full.beta[k][0, 1:]) > 1e-8).sum())) for k, i in best.items()]
    return _frame(df.sparkSession, df, keys, out, "c double, auc double, nonzero long")


def laplace_each(df: DataFrame, keys: Sequence[str], unit: str, features: Sequence[str], label: str, held: str, prior_sd: float = 1.0, intercept_sd: float = 2.0, n_draws: int = 400, seed: int = 42) -> DataFrame:
    """(keys, unit, label, score, width): Bayesian logistic regression by Laplace's approximation. score is the mean
    prediction over normal draws of the coefficients, width that of its central 95 %. A key's draws go to the tasks, its
    rows stay where they are."""
    rows = fits.fit_rows(df, keys, unit, features, label, held, seed=seed)
    found = fits.fit_all(rows, fits.Plan(1, (prior_sd**-2,)), intercept=intercept_sd**-2)
    normal = np.random.Generator(np.random.PCG64(seed)).standard_normal((n_draws, len(features) + 1))
    prior = np.diag([intercept_sd**-2] + [prior_sd**-2] * len(features))
    at = fits.information(rows.table.where("NOT _held"), found, {k: np.zeros(1, int) for k in found.beta})
    rows.close()
    drawn = {k: found.beta[k][0] + normal @ np.linalg.inv(np.linalg.cholesky(h[0] + prior)) for k, (_, h, _) in at.items()}
    z = _scaled(df, keys, [unit, label], features, held, rows, found, {k: k for k in drawn}, "_k int").select(*keys, unit, label, "_k", F.array(F.lit(1.0), *features).alias("_x"))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, part in pdf.groupby("_k"):
                x, out = np.stack(part["_x"]), part[[*keys, unit, label]].copy()
                means, widths = [], []
                for a in range(0, len(x), 2000):
                    p = fits.sigmoid(drawn[k] @ x[a : a + 2000].T)
                    means.append(p.mean(0))
                    widths.append(np.percentile(p, 97.5, axis=0) - np.percentile(p, 2.5, axis=0))
                yield out.assign(score=np.concatenate(means), width=np.concatenate(widths))

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return z.mapInPandas(score, ", ".join([*[f"`{k}` {kinds[k]}" for k in (*keys, unit, label)], "score double, width double"]))


# --- fits on many rows --------------------------------------------------------------------------------------------


def product_sums(df: DataFrame, fold: str, features: Sequence[str], target: str) -> DataFrame:
    """(fold, i, j, s, n): sums of products of [1, features, target] by fold, for i <= j: one pass, partly summed in tasks."""
    names = ["1", *features, target]
    value = lambda c: F.lit(1.0) if c == "1" else F.col(c).cast("double")
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    wide = df.groupBy(fold).agg(F.count(F.lit(1)).alias("n"), *[F.sum(value(names[i]) * value(names[j])).alias(f"s_{i}_{j}") for i, j in pairs])
    return wide.select(fold, "n", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"s_{i}_{j}").alias("s")) for i, j in pairs])).alias("_e")).select(fold, "_e.*", "n")


def product_matrices(df: DataFrame, fold: str, features: Sequence[str], target: str) -> dict:
    """fold -> the matrix of product_sums over the rows without nulls."""
    q = len(features) + 2
    sums: dict = {}
    for r in product_sums(df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in (*features, target))), fold, features, target).collect():
        m = sums.setdefault(r[fold], np.zeros((q, q)))
        m[r["i"], r["j"]] = m[r["j"], r["i"]] = r["s"]
    return sums


def ridge_path(df: DataFrame, fold: str, features: Sequence[str], target: str, alphas: Sequence[float] = (0.01, 0.1, 1.0, 10.0, 100.0, 1000.0, 10000.0)) -> tuple[float, float, np.ndarray]:
    """(best alpha, its cross-validated R2, coefficients of [1, features] on all rows) from the product sums alone.

    Features are scaled on all rows. The train sums of a fold are the total less its own, so all folds and alphas cost one
    pass over the data; the driver gets (p + 2)^2 / 2 numbers a fold.
    """
    return ridge_from_sums(product_matrices(df, fold, features, target), alphas)


def ridge_from_sums(sums: dict, alphas: Sequence[float] = (0.01, 0.1, 1.0, 10.0, 100.0, 1000.0, 10000.0)) -> tuple[float, float, np.ndarray]:
    """As ridge_path, from the matrix of each fold."""
    total = sum(sums.values())
    q = len(total)
    n = total[0, 0]
    mean = total[0, 1:-1] / n
    sd = np.sqrt(np.maximum(np.diag(total)[1:-1] / n - mean**2, 0))
    scale = np.eye(q)
    for i in range(1, q - 1):
        scale[i, i] = 1 / sd[i - 1] if sd[i - 1] > 1e-8 else 0.0
        scale[0, i] = -mean[i - 1] * scale[i, i]
    sums = {k: scale.T @ m @ scale for k, m in sums.items()}
    total = sum(sums.values())

    def solve(m: np.ndarray, a: float) -> np.ndarray:
        pen = a * np.eye(q - 1)
        pen[0, 0] = 1e-12
        return np.linalg.solve(m[:-1, :-1] + pen, m[:-1, -1])

    best = (-np.inf, 0.0)
    for a in alphas:
        r2 = []
        for m in sums.values():
            b = solve(total - m, a)
            sse = m[-1, -1] - 2 * b @ m[:-1, -1] + b @ m[:-1, :-1] @ b
            sst = m[-1, -1] - m[0, -1] ** 2 / m[0, 0]
            r2.append(1 - sse / sst if sst > 0 else 0.0)
        best = max(best, (float(np.mean(r2)), a))
    return best[1], best[0], scale[:-1, :-1] @ solve(total, best[1])


def linear_score(features: Sequence[str], coefficients: Sequence[float]) -> Column:
    out = F.lit(float(coefficients[0]))
    for c, b in zip(features, coefficients[1:], strict=True):
        out = out + F.col(c) * float(b)
    return out


def forest_scores(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, trees: int = 100, depth: int = 4, leaf: int = 3, seed: int = 42) -> DataFrame:
    """test with score, the forest's probability of label 1. Missing features are 0."""
    vector = lambda d: d.withColumn("_x", array_to_vector(F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features])))
    forest = RandomForestClassifier(featuresCol="_x", labelCol="_y", numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, seed=seed)
    model = forest.fit(vector(train).withColumn("_y", F.col(label).cast("double")).select("_x", "_y"))
    out = model.transform(vector(test)).withColumn("score", vector_to_array("probability")[1])
    return out.select(*test.columns, "score")


def principal_components(df: DataFrame, vector: str, k: int, name: str = "components") -> tuple[DataFrame, list[float]]:
    """df with its vectors' first k components after scaling, and the shares of variance."""
    rows = df.withColumn("_v", array_to_vector(F.col(vector)))
    scaled = StandardScaler(inputCol="_v", outputCol="_z", withMean=True, withStd=True).fit(rows).transform(rows)
    model = PCA(k=k, inputCol="_z", outputCol="_c").fit(scaled)
    return model.transform(scaled).withColumn(name, vector_to_array("_c")).drop("_v", "_z", "_c"), model.explainedVariance.toArray().tolist()


# --- hidden Markov model ------------------------------------------------------------------------------------------


def _posterior(x: np.ndarray, start: np.ndarray, move: np.ndarray, mean: np.ndarray, var: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(state probabilities, summed transition probabilities, log likelihood) of one sequence x (n x p) under m models at
    once, by scaled forward-backward. start: m x s; move: m x s x s; mean, var: m x s x p."""
    n, (m, s) = len(x), start.shape
    logs = -0.5 * (((x[:, None, None] - mean) ** 2 / var + np.log(2 * np.pi * var)).sum(3))  # n x m x s
    top = logs.max(2, keepdims=True)
    e = np.exp(logs - top)
    a, b, scale, pairs = np.zeros((n, m, s)), np.ones((n, m, s)), np.zeros((n, m)), np.zeros((m, s, s))
    for t in range(n):
        v = (start if t == 0 else np.einsum("ms,mst->mt", a[t - 1], move)) * e[t]
        scale[t] = np.maximum(v.sum(1), 1e-300)
        a[t] = v / scale[t][:, None]
    for t in range(n - 2, -1, -1):
        ahead = e[t + 1] * b[t + 1] / scale[t + 1][:, None]
        b[t] = np.einsum("mst,mt->ms", move, ahead)
        pairs += a[t][:, :, None] * move * ahead[:, None]
    return a * b, pairs, np.log(scale).sum(0) + top[..., 0].sum(0)


def _posteriors(x: np.ndarray, size: np.ndarray, start: np.ndarray, move: np.ndarray, mean: np.ndarray, var: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """_posterior of many sequences at once, each under a model of its own: x is n x m x p, of which the first ``size`` rows of
    a sequence count (the others must be finite); probabilities of the others are 0."""
    n, m, s = len(x), *start.shape
    # models are the last axis inside, so that every step is a few operations on long vectors
    start, move, mean, var = (np.ascontiguousarray(np.moveaxis(z, 0, -1)) for z in (start, move, mean, var))
    full = int(size.min(initial=n))  # rows that every sequence has
    live = np.arange(n)[:, None] < size
    e = np.zeros((n, s, m))
    for i in range(x.shape[2]):
        e += (np.ascontiguousarray(x[:, :, i])[:, None] - mean[:, i]) ** 2 / var[:, i] + np.log(2 * np.pi * var[:, i])
    e *= -0.5
    top = e.max(1)
    np.exp(e - top[:, None], out=e)
    a, g, scale = np.zeros((n, s, m)), np.zeros((n, s, m)), np.ones((n, m))
    for t in range(n):
        v = (start if t == 0 else sum(a[t - 1, i] * move[i] for i in range(s))) * e[t]
        scale[t] = np.maximum(v.sum(0), 1e-300)
        if t >= full:
            scale[t] = np.where(live[t], scale[t], 1.0)
            v *= live[t]
        np.divide(v, scale[t], out=a[t])
    b, pairs = np.ones((s, m)), np.zeros((s, s, m))
    g[n - 1] = a[n - 1]
    for t in range(n - 2, -1, -1):
        ahead = e[t + 1] * b / scale[t + 1]
        if t + 1 >= full:
            ahead *= live[t + 1]
        for i in range(s):
            w = move[i] * ahead
            pairs[i] += a[t, i] * w
            b[i] = w.sum(0)
        if t + 1 >= full:
            b = np.where(live[t + 1], b, 1.0)
        np.multiply(a[t], b, out=g[t])
    return g.transpose(0, 2, 1), pairs.transpose(2, 0, 1), (np.log(scale) + np.where(live, top, 0.0)).sum(0)


#: Cells (rows x models) of a block of sequences.
CELLS = 1 << 18


def _packed(rows: DataFrame, sequence: str, order: str, features: Sequence[str], more: Sequence[str] = ()) -> DataFrame:
    """(sequence, _n, _o, _x, more): a row for each sequence, its rows in order; ``more`` are the same in all its rows."""
    one = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), *[F.col(c).alias(f"x{i}") for i, c in enumerate(features)]))).alias("_r")
    packed = rows.groupBy(sequence).agg(one, *[F.first(c).alias(c) for c in more])
    return packed.select(sequence, F.size("_r").alias("_n"), F.col("_r.o").alias("_o"), F.flatten(F.transform("_r", lambda r: F.array(*[r[f"x{i}"] for i in range(len(features))]))).alias("_x"), *more)


def _blocks(batch: pa.RecordBatch, p: int, width: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(numbers of sequences of a batch, their rows: n x sequences x p, their sizes), of near lengths, each as wide as its models."""
    size = np.asarray(batch.column("_n"))
    flat = np.asarray(batch.column("_x").flatten(), float).reshape(-1, p)
    ends = np.cumsum(size)
    order, some, cells = np.argsort(size, kind="stable"), [], 0
    for i in [*order[::-1], None]:  # the longest first
        if some and (i is None or cells + size[some[0]] * width[i] > CELLS or size[i] * 2 < size[some[0]]):
            x = np.zeros((size[some[0]], len(some), p))
            for j, q in enumerate(some):
                x[: size[q], j] = flat[ends[q] - size[q] : ends[q]]
            yield np.array(some), x, size[some]
            some, cells = [], 0
        if i is not None:
            some.append(i)
            cells += size[some[0]] * width[i]


@dataclass(frozen=True)
class Markov:
    """Gaussian hidden Markov models, one a name: start (m x s), move (m x s x s), mean and var (m x s x p)."""

    names: tuple
    start: np.ndarray
    move: np.ndarray
    mean: np.ndarray
    var: np.ndarray

    def of(self, names: Sequence) -> tuple[np.ndarray, ...]:
        at = [self.names.index(x) for x in names]
        return self.start[at], self.move[at], self.mean[at], self.var[at]


def _sequences(df: DataFrame, sequence: str, order: str, features: Sequence[str], members: DataFrame | None, model: str, least_rows: int) -> DataFrame:
    """The rows of sequences of enough rows, missing features as 0, with _models: the models that a sequence belongs to."""
    rows = df.select(sequence, order, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features])
    every = F.array(F.lit(0).cast("bigint"))
    owners = rows.groupBy(sequence).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") >= least_rows)
    if members is None:
        owners = owners.withColumn("_models", every)
    else:
        owners = owners.join(members.groupBy(sequence).agg(F.sort_array(F.collect_set(F.col(model).cast("bigint"))).alias("_models")), sequence)
    return rows.join(owners.drop("_rows"), sequence)


def _expected(p: int, now: Markov) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's expected sums of its sequences under each of their models."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, s = now.start.shape
        total = np.zeros((m, s + s * s + s + 2 * s * p))
        for batch in batches:
            own = batch.column("_models")
            many = np.asarray(own.value_lengths())
            model, first = np.searchsorted(now.names, np.asarray(own.flatten())), np.cumsum(many) - many
            for some, x, size in _blocks(batch, p, many):
                each = np.repeat(np.arange(len(some)), many[some])
                at = np.concatenate([model[first[i] : first[i] + many[i]] for i in some])
                step_ = max(1, CELLS // len(x))
                for a in range(0, len(at), step_):
                    k, w = at[a : a + step_], each[a : a + step_]
                    y = x[:, w]
                    g, pairs, _ = _posteriors(y, size[w], now.start[k], now.move[k], now.mean[k], now.var[k])
                    parts = (g[0], pairs.reshape(len(k), -1), g.sum(0), np.einsum("nms,nmp->msp", g, y).reshape(len(k), -1), np.einsum("nms,nmp->msp", g, y * y).reshape(len(k), -1))
                    np.add.at(total, k, np.concatenate(parts, 1))
        if m:
            yield pa.RecordBatch.from_arrays([pa.array(now.names, pa.int64()), pa.array(list(total), pa.list_(pa.float64()))], names=["model", "v"])

    return step


def fit_hmm(df: DataFrame, sequence: str, order: str, features: Sequence[str], states: int = 3, rounds: int = 15, least_rows: int = 6, members: DataFrame | None = None, model: str = "split") -> Markov:
    """Diagonal Gaussian HMMs by EM: one over all sequences of at least ``least_rows`` rows (name 0), or with ``members``
    (sequence, model: a whole number) one for each model over its sequences; a sequence may be in many.

    A sequence's rows are packed once. The E step takes many sequences of near lengths at once, each under its models; a task
    adds up its own sums (models x states x features), and Spark the tasks'. Every model starts from quantiles of the first feature over its rows.
    """
    rows = _sequences(df, sequence, order, features, members, model, least_rows).persist()
    s, p = states, len(features)
    dealt = rows.withColumn("_model", F.explode("_models"))
    first = dealt.groupBy("_model").agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(features)], *[F.var_pop(c).alias(f"v{i}") for i, c in enumerate(features)], F.percentile_approx(features[0], [(i + 0.5) / s for i in range(s)], 10_000).alias("q")).orderBy("_model").collect()
    names, m = tuple(int(r["_model"]) for r in first), len(first)
    if not m:
        rows.unpersist()
        return Markov((), np.zeros((0, s)), np.zeros((0, s, s)), np.zeros((0, s, p)), np.zeros((0, s, p)))
    mean = np.array([[[r[f"m{i}"] for i in range(p)]] * s for r in first], float)
    mean[:, :, 0] = [r["q"] for r in first]
    var = np.array([[[max(r[f"v{i}"], 1e-4) for i in range(p)]] * s for r in first], float)
    model_now = Markov(names, np.full((m, s), 1 / s), np.tile(np.full((s, s), 0.1 / max(s - 1, 1)) + np.eye(s) * (0.9 - 0.1 / max(s - 1, 1)), (m, 1, 1)), mean, var)
    size = s + s * s + s + 2 * s * p
    packed = _packed(rows, sequence, order, features, ["_models"]).select("_n", "_x", "_models").persist()
    for _ in range(rounds):
        sums = packed.mapInArrow(_expected(p, model_now), "model long, v array<double>")
        out = sums.select("model", F.posexplode("v").alias("i", "v")).groupBy("model", "i").agg(F.sum("v").alias("v")).collect()
        v = np.zeros((m, size))
        for r in out:
            v[names.index(r["model"]), r["i"]] = r["v"]
        start = v[:, :s] / np.maximum(v[:, :s].sum(1, keepdims=True), 1e-12)
        move = v[:, s : s + s * s].reshape(m, s, s) + 1e-6
        at = s + s * s
        w = np.maximum(v[:, at : at + s], 1e-9)[..., None]
        mean = v[:, at + s : at + s + s * p].reshape(m, s, p) / w
        var = np.maximum(v[:, at + s + s * p :].reshape(m, s, p) / w - mean**2, 1e-4)
        model_now = Markov(names, start, move / move.sum(2, keepdims=True), mean, var)
    packed.unpersist()
    rows.unpersist()
    return model_now


def _settled_hmms(x: np.ndarray, size: np.ndarray, states: int, rounds: int, tolerance: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(state probabilities, means, rounds taken) of diagonal Gaussian HMMs fitted to a sequence each by EM, until a model's log
    likelihood grows by less than ``tolerance`` of itself; x and size as in _posteriors."""
    n, m, p = x.shape
    live = (np.arange(n)[:, None] < size)[..., None]
    first = np.sort(np.where(live[..., 0], x[:, :, 0], np.inf), 0)
    middle = x.sum(0, where=live) / size[:, None]
    mean = np.tile(middle[:, None], (1, states, 1))
    for i in range(states):
        mean[:, i, 0] = first[np.maximum(0, np.ceil((i + 0.5) / states * size).astype(int) - 1), np.arange(m)]
    var = np.tile(np.maximum(((x - middle) ** 2).sum(0, where=live) / size[:, None], 1e-4)[:, None], (1, states, 1))
    start = np.full((m, states), 1 / states)
    move = np.tile(np.full((states, states), 0.1 / max(states - 1, 1)) + np.eye(states) * (0.9 - 0.1 / max(states - 1, 1)), (m, 1, 1))
    last, done, open_ = np.full(m, -np.inf), np.zeros(m, int), np.arange(m)
    for _ in range(rounds):
        done[open_] += 1
        y = x[:, open_]
        g, pairs, value = _posteriors(y, size[open_], start[open_], move[open_], mean[open_], var[open_])
        on = value - last[open_] > tolerance * np.maximum(1.0, np.abs(value))
        if not on.any():
            break
        open_, g, pairs, y = open_[on], g[:, on], pairs[on] + 1e-6, y[:, on]
        last[open_] = value[on]
        w = np.maximum(g.sum(0), 1e-9)[..., None]
        start[open_] = g[0] / np.maximum(g[0].sum(1, keepdims=True), 1e-12)
        move[open_] = pairs / pairs.sum(2, keepdims=True)
        mean[open_] = np.einsum("nms,nmp->msp", g, y) / w
        var[open_] = np.maximum(np.einsum("nms,nmp->msp", g, y * y) / w - mean[open_] ** 2, 1e-4)
    return _posteriors(x, size, start, move, mean, var)[0], mean, done


def danger_of_each(df: DataFrame, sequence: str, order: str, features: Sequence[str], states: int = 3, rounds: int = 200, tolerance: float = 1e-6, least_rows: int = 6) -> DataFrame:
    """(sequence, order, danger, rounds): for each row, the probability of the state with the largest mean of the first feature
    under an HMM of its own sequence, for sequences of at least ``least_rows`` rows; rounds taken to settle.

    A model is fitted and applied where its sequence's rows are, many sequences of near lengths at once: nothing of it goes to
    the driver or to another task. Missing features are 0. As every HMM's, a sequence's recursion is one task's work.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    rows = df.select(sequence, order, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features])

    packed = _packed(rows, sequence, order, features).where(F.col("_n") >= least_rows)
    p = len(features)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, values = np.asarray(batch.column("_o").offsets), batch.column("_o").values
            for some, x, size in _blocks(batch, p, np.ones(batch.num_rows, int)):
                g, mean, done = _settled_hmms(x, size, states, rounds, tolerance)
                of = np.repeat(np.arange(len(some)), size)
                row = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
                danger = g[row, of, mean[:, :, 0].argmax(1)[of]]
                yield pa.RecordBatch.from_arrays([batch.column(sequence).take(pa.array(some[of])), values.take(pa.array(starts[some[of]] + row)), pa.array(danger), pa.array(done[of], pa.int32())], names=[sequence, order, "danger", "rounds"])

    return packed.mapInArrow(fit, f"`{sequence}` {kinds[sequence]}, `{order}` {kinds[order]}, danger double, rounds int")


def danger_scores(df: DataFrame, model: Markov, sequence: str, order: str, features: Sequence[str], least_rows: int = 3, members: DataFrame | None = None, name: str = "split") -> DataFrame:
    """(name, sequence, order, danger): for each row under each model that its sequence belongs to (name 0 without
    ``members``), the probability of the state with the largest mean of the first feature."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    rows = _packed(_sequences(df, sequence, order, features, members, name, least_rows), sequence, order, features, ["_models"])
    p, worst = len(features), model.mean[:, :, 0].argmax(1) if len(model.names) else np.zeros(0, int)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.array([model.names.index(x) for x in models if x in model.names], int) for models in batch.column("_models").to_pylist()]
            starts = np.asarray(batch.column("_o").offsets)
            values = batch.column("_o").values
            for some, x, size in _blocks(batch, p, np.array([len(o) for o in own])):
                at, each = np.concatenate([own[i] for i in some]), np.repeat(np.arange(len(some)), [len(own[i]) for i in some])
                step = max(1, CELLS // len(x))
                for a in range(0, len(at), step):
                    k, w = at[a : a + step], each[a : a + step]
                    g, _, _ = _posteriors(x[:, w], size[w], model.start[k], model.move[k], model.mean[k], model.var[k])
                    n = size[w]
                    fit = np.repeat(np.arange(len(k)), n)
                    row = np.arange(len(fit)) - np.repeat(np.cumsum(n) - n, n)
                    yield pa.RecordBatch.from_arrays([batch.column(sequence).take(pa.array(some[w][fit])), values.take(pa.array(starts[some[w]][fit] + row)), pa.array(np.array(model.names)[k][fit], pa.int64()), pa.array(g[row, fit, worst[k][fit]])], names=[sequence, order, name, "danger"])

    return rows.mapInArrow(score, f"`{sequence}` {kinds[sequence]}, `{order}` {kinds[order]}, `{name}` long, danger double")


def keyed_fold(key: Column, folds: int, seed: int = 42) -> Column:
    return F.floor(draw_unit(seed, key) * folds).cast("int")
