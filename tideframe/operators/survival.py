"""Cox models of many keys over any number of rows: Efron's risk-set sums as grouped sums by (key, time) and running sums
from the last time to the first.

For the d events of one time, Efron's terms are sums over j < d of quotients by S0 - (j / d) D0, where S are the sums over
the rows at risk and D those over the events. They need five numbers a time, each a sum over j; all that has the features'
width is multiplied by them. Times are dealt to ranges, so that no task needs all times of a key: a range's running sums
start where those of the later ranges end.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .evaluation import standardise

RANGES = 64
#: The last terms of Efron's sums that are added one by one, rows of a packed unit, cells of a block of rows x fits, and numbers
#: of sums that a task holds.
TAIL, PACKED, CELLS, HELD = 32, 10_000, 1 << 20, 8_000_000


def _moments(p: int) -> list[str]:
    """Names of the sums of 1, x and x x' over rows."""
    return ["0", *[f"1_{i}" for i in range(p)], *[f"2_{i}_{j}" for i in range(p) for j in range(i, p)]]


def _efron(times: DataFrame) -> DataFrame:
    """times with _q: sums over j < d, with f = j / d and q = 1 / (S0 - f D0), of q, f q, q^2, f q^2 and f^2 q^2.

    The last TAIL terms are added. Those before them are as many as there are events at one time: their sums of q and q^2 are
    Euler's and Maclaurin's, whose remainder is below 1e-14 of them so far from the pole, and f q = (S0 q - 1) / D0 gives the others.
    """
    c = F.col
    times = times.withColumn("_h", c("d0") / c("d")).withColumn("_n", F.greatest(c("d") - TAIL, F.lit(0.0)))
    times = times.withColumn("_a", 1 / c("s0")).withColumn("_z", 1 / (c("s0") - c("_n") * c("_h")))
    a, z, h = c("_a"), c("_z"), c("_h")
    odd = ((1, 1 / 12), (3, -1 / 720), (5, 1 / 30240), (7, -1 / 1209600))
    rest = lambda more: sum((F.lit(b * np.prod(np.arange(2.0, n + more + 1))) * F.pow(h, F.lit(n)) * (F.pow(z, F.lit(n + 1 + more)) - F.pow(a, F.lit(n + 1 + more))) for n, b in odd), F.lit(0.0))
    one = -F.log1p(-c("_n") * h * a) / h - (z - a) / 2 + rest(0)
    two = (z - a) / h - (z * z - a * a) / 2 + rest(1)
    many = c("_n") > 0
    times = times.withColumn("_1", F.when(many, one).otherwise(0.0)).withColumn("_2", F.when(many, two).otherwise(0.0))
    f1, f2 = (c("s0") * c("_1") - c("_n")) / c("d0"), (c("s0") * c("_2") - c("_1")) / c("d0")
    start = F.array(c("_1"), F.when(many, f1).otherwise(0.0), c("_2"), F.when(many, f2).otherwise(0.0), F.when(many, (c("s0") * f2 - f1) / c("d0")).otherwise(0.0))

    def more(a: Column, j: Column) -> Column:
        f = j / c("d")
        q = 1 / (c("s0") - f * c("d0"))
        return F.transform(F.array(q, f * q, q * q, f * q * q, f * f * q * q), lambda v, i: v + a[i])

    return times.withColumn("_q", F.aggregate(F.sequence(c("_n").cast("int"), c("d").cast("int") - 1), start, more)).drop("_h", "_n", "_a", "_z", "_1", "_2")


def _steps(times: DataFrame, keys: Sequence[str], p: int) -> DataFrame:
    """(keys, g, h): gradient and information of each key from the sums (s: all rows, d and g: events) of each of its times."""
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    risk = [f"s{n}" for n in _moments(p)]
    after = Window.partitionBy(*keys).orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    later = times.groupBy(*keys, "_part").agg(*[F.sum(c).alias(c) for c in risk]).select(*keys, "_part", *[F.coalesce(F.sum(c).over(after), F.lit(0.0)).alias(f"l{c}") for c in risk])
    inside = Window.partitionBy(*keys, "_part").orderBy(F.desc("_t"))
    own = [c for c in times.columns if c not in risk]
    times = times.select(*own, *[F.sum(c).over(inside).alias(c) for c in risk]).join(later, [*keys, "_part"]).where("d > 0")
    times = _efron(times.select(*own, *[(F.col(c) + F.col(f"l{c}")).alias(c) for c in risk])).withColumn("_m", F.col("dw") / F.col("d"))
    q, m, c = [F.col("_q")[i] for i in range(5)], F.col("_m"), F.col
    grad = [F.sum(c(f"g{i}") - m * (c(f"s1_{i}") * q[0] - c(f"d1_{i}") * q[1])).alias(f"g{i}") for i in range(p)]
    cross = lambda i, j: c(f"s1_{i}") * c(f"s1_{j}") * q[2] - (c(f"s1_{i}") * c(f"d1_{j}") + c(f"d1_{i}") * c(f"s1_{j}")) * q[3] + c(f"d1_{i}") * c(f"d1_{j}") * q[4]
    hess = [F.sum(m * (c(f"s2_{i}_{j}") * q[0] - c(f"d2_{i}_{j}") * q[1] - cross(i, j))).alias(f"h{i}_{j}") for i, j in pairs]
    return times.groupBy(*keys).agg(*grad, *hess)


def fit_cox(df: DataFrame, keys: Sequence[str], features: Sequence[str], time: str, event: str, weight: str | None = None, penalty: float = 0.1, rounds: int = 50, most_keys: int = 100_000) -> DataFrame:
    """(keys, betas): the maximum of the log partial likelihood (Efron's ties) less rows * penalty / 2 * |b|^2, by Newton steps.

    A time's events count by their mean weight. Rows without a time are left out, missing features are 0, and keys without
    an event have no fit. A step is one grouping of the rows by (key, time), partly summed in tasks; the driver solves a
    features x features system a key. Keys that have settled take no part in later steps.
    """
    p = len(features)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    x = [F.col(f"_x{i}") for i in range(p)]
    rows = df.where(F.col(time).isNotNull()).select(*keys, F.col(time).cast("double").alias("_t"), F.coalesce(F.col(event).cast("int") == 1, F.lit(False)).alias("_e"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_w"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"_x{i}") for i, c in enumerate(features)]).persist()
    spans = rows.groupBy(*keys).agg(F.min("_t").alias("_a"), F.max("_t").alias("_b"), F.count(F.lit(1)).alias("n"), F.max("_e").alias("any")).where("any").limit(most_keys + 1).collect()
    if len(spans) > most_keys:
        raise ValueError(f"more than {most_keys} keys to fit")
    key = lambda r: tuple(r[k] for k in keys)
    size, span = {key(r): r["n"] for r in spans}, {key(r): (r["_a"], r["_b"]) for r in spans}
    beta = {k: np.zeros(p) for k in size}
    kinds = [f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys]
    moving = set(beta)
    for _ in range(rounds):
        if not moving:
            break
        table = df.sparkSession.createDataFrame([(*k, *span[k], beta[k].tolist()) for k in sorted(moving)], ", ".join([*kinds, "_a double, _b double, _beta array<double>"]))
        now = rows.join(F.broadcast(table), list(keys))
        linear = sum((x[i] * F.col("_beta")[i] for i in range(p)), F.lit(0.0))
        part = F.when(F.col("_b") > F.col("_a"), F.floor((F.col("_t") - F.col("_a")) / (F.col("_b") - F.col("_a")) * (RANGES - 1))).otherwise(0).cast("int")
        now = now.withColumn("_r", F.col("_w") * F.exp(F.least(F.greatest(linear, F.lit(-35.0)), F.lit(35.0)))).withColumn("_part", part)
        r, on = F.col("_r"), lambda c: F.when(F.col("_e"), c).otherwise(0.0)
        moments = dict(zip(_moments(p), [r, *[r * x[i] for i in range(p)], *[r * x[i] * x[j] for i, j in pairs]], strict=True))
        sums = [F.sum(c).alias(f"s{n}") for n, c in moments.items()] + [F.sum(on(c)).alias(f"d{n}") for n, c in moments.items()]
        sums += [F.sum(on(F.lit(1.0))).alias("d"), F.sum(on(F.col("_w"))).alias("dw"), *[F.sum(on(F.col("_w") * x[i])).alias(f"g{i}") for i in range(p)]]
        times = now.groupBy(*keys, "_part", "_t").agg(*sums)
        for found in _steps(times, keys, p).collect():
            k = key(found)
            h = size[k] * penalty * np.eye(p)
            for i, j in pairs:
                h[i, j] += found[f"h{i}_{j}"]
                h[j, i] = h[i, j]
            step = np.linalg.solve(h, np.array([found[f"g{i}"] for i in range(p)]) - size[k] * penalty * beta[k])
            beta[k] = beta[k] + np.clip(step, -2, 2)
            if np.abs(step).max(initial=0) < 1e-8:
                moving.discard(k)
    rows.unpersist()
    return df.sparkSession.createDataFrame([(*k, b.tolist()) for k, b in sorted(beta.items())], ", ".join([*kinds, "betas array<double>"]))


def cox_dealt(df: DataFrame, deals: DataFrame, unit: str, key: str, name: str, features: Sequence[str], time: str, event: str, penalty: float = 0.1, rounds: int = 50) -> DataFrame:
    """(key, name, betas, slopes, shift): Cox models as fit_cox's for each key and each number ``name`` of ``deals`` (unit, name,
    weight), on the rows of the units that it has, scaled on them. betas are those of scaled features; a row's hazard is the
    exponential of its features times the slopes, less the shift.

    Rows are never repeated for the fits: a unit's rows and its weight in each fit are packed together, and a task takes the
    rows times the fits in blocks, by matrix products. What it sends on is a line for each key, fit and time.
    """
    p = len(features)
    x = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features]
    longest = df.groupBy(unit).count().agg(F.max("count")).first()[0] or 1
    rows = df.select(unit, F.col(key).alias("_key"), F.col(time).cast("double").alias("_t"), F.coalesce(F.col(event).cast("int") == 1, F.lit(False)).cast("double").alias("_e"), *[v.alias(f"_x{i}") for i, v in enumerate(x)])
    stats = rows.groupBy("_key").agg(F.min("_t").alias("a"), F.max("_t").alias("b"), *[f(f"_x{i}").alias(f"{n}{i}") for i in range(p) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).collect()
    number = {r["_key"]: i for i, r in enumerate(sorted(stats, key=lambda r: (r["_key"] is not None, r["_key"])))}
    mean, dev = (np.array([[r[f"{n}{i}"] for i in range(p)] for r in sorted(stats, key=lambda r: number[r["_key"]])], float).reshape(-1, p) for n in "ms")
    unitless = np.where(dev > 0, dev, 1.0)
    kind = df.schema[key].dataType.simpleString()
    keys = df.sparkSession.createDataFrame([(r["_key"], number[r["_key"]], r["a"], r["b"]) for r in stats], f"_key {kind}, _k int, _a double, _b double")
    same = F.col("_k0").eqNullSafe(keys["_key"])
    chunk = F.pmod(F.xxhash64("_t", "_e", *[f"_x{i}" for i in range(p)]), F.lit(-(-longest // PACKED)))
    own = rows.withColumnRenamed("_key", "_k0").join(F.broadcast(keys.select("_key", "_k")), same).groupBy(unit, "_k", chunk.alias("_chunk")).agg(F.flatten(F.collect_list(F.array(F.coalesce("_t", F.lit(float("nan"))), "_e", *[f"_x{i}" for i in range(p)]))).alias("_rows"))
    drawn = deals.groupBy(unit).agg(F.collect_list(F.struct(F.col(name).cast("int").alias("f"), F.col("weight").cast("int").alias("w"))).alias("_d")).select(unit, F.col("_d.f").alias("_f"), F.col("_d.w").alias("_w"))
    packed = own.join(drawn, unit).select("_k", "_rows", "_f", "_w").persist()
    fits = (packed.agg(F.max(F.array_max("_f"))).first()[0] or 0) + 1

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """key, times, events, features less the key's mean over its deviation, weights (rows x fits), by key and time."""
        for batch in batches:
            col = dict(zip(batch.schema.names, batch.columns, strict=True))
            k, flat = np.asarray(col["_k"]), np.asarray(col["_rows"].flatten()).reshape(-1, 2 + p)
            of = np.repeat(np.arange(len(k)), np.asarray(col["_rows"].value_lengths()) // (2 + p))
            at, weight = np.repeat(np.arange(len(k)), np.asarray(col["_f"].value_lengths())), np.asarray(col["_w"].flatten())
            fit = np.asarray(col["_f"].flatten())
            starts = np.searchsorted(at, np.arange(len(k) + 1))
            order = np.lexsort((flat[:, 1], flat[:, 0], k[of]))
            step = max(1, CELLS // fits)
            for a in range(0, len(order), step):
                some = order[a : a + step]
                units, back = np.unique(of[some], return_inverse=True)
                w = np.zeros((len(units), fits))
                for i, u in enumerate(units):
                    w[i, fit[starts[u] : starts[u + 1]]] = weight[starts[u] : starts[u + 1]]
                kk = k[of[some]]
                for one in np.unique(kk):
                    i = np.flatnonzero(kk == one)
                    r = flat[some[i]]
                    yield int(one), r[:, 0], r[:, 1] == 1, (r[:, 2:] - mean[one]) / unitless[one], w[back[i]]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for k, t, e, v, w in blocks(batches):
            on, known = (w > 0).astype(float), ~np.isnan(t)
            new = np.concatenate([np.stack([on.sum(0), on[known].sum(0), on[known & e].sum(0)]), on.T.dot(v).T, on.T.dot(v * v).T])
            total[k] = total[k] + new if k in total else new
        for k, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([v.tobytes()], pa.binary())], names=["k", "v"])

    size, shift, slope = np.zeros((len(number), fits)), np.zeros((len(number), fits, p)), np.zeros((len(number), fits, p))
    lines: dict[int, np.ndarray] = {}
    for r in packed.mapInArrow(counted, "k int, v binary").toLocalIterator():  # a line a key and task
        v = np.frombuffer(r["v"]).reshape(-1, fits)
        lines[r["k"]] = lines[r["k"]] + v if r["k"] in lines else v
    going = np.zeros((len(number), fits), bool)
    for k, v in lines.items():
        n = np.maximum(v[0], 1)[:, None]
        shift[k] = v[3 : 3 + p].T / n
        s = np.sqrt(np.maximum(v[3 + p :].T / n - shift[k] ** 2, 0))
        slope[k] = np.where(s * unitless[k] > 1e-8, 1 / np.maximum(s, 1e-300), 0.0)
        size[k], going[k] = v[1], v[2] > 0
    fitted, beta = going.copy(), np.zeros((len(number), fits, p))
    up = np.triu_indices(p)
    names = [*[f"s{n}" for n in _moments(p)], *[f"d{n}" for n in _moments(p)], "d", "dw", *[f"g{i}" for i in range(p)]]
    schema = "_k int, _fit int, _t double, " + ", ".join(f"{n} double" for n in names)

    def sums(batches: Iterator[pa.RecordBatch], b: np.ndarray, moving: np.ndarray) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, float], np.ndarray] = {}

        def sent() -> Iterator[pa.RecordBatch]:
            for (k, t), v in total.items():
                some = np.flatnonzero(v[:, 0] > 0)
                ids = [pa.array(np.full(len(some), k), pa.int32()), pa.array(np.flatnonzero(moving[k])[some], pa.int32()), pa.array(np.full(len(some), t))]
                yield pa.RecordBatch.from_arrays([*ids, *[pa.array(v[some, i]) for i in range(v.shape[1])]], names=["_k", "_fit", "_t", *names])
            total.clear()

        for k, t, e, v, w in blocks(batches):
            live = moving[k]
            if not live.any():
                continue
            w, own = w[:, live], b[k][live] * slope[k][live]
            r = w * np.exp(np.clip(v @ own.T - (own * shift[k][live]).sum(1), -35, 35))
            f = np.column_stack([np.ones(len(v)), v, v[:, up[0]] * v[:, up[1]]])
            for a, z in zip(c := np.flatnonzero(np.diff(t, prepend=np.nan) != 0), [*c[1:], len(t)], strict=True):
                if np.isnan(t[a]):
                    continue
                m = a + int((~e[a:z]).sum())  # events come last
                line = np.column_stack([r[a:z].T @ f[a:z], r[m:z].T @ f[m:z], (w[m:z] > 0).sum(0), w[m:z].sum(0), w[m:z].T @ v[m:z]])
                at = (k, float(t[a]))
                total[at] = total[at] + line if at in total else line
            if len(total) * len(names) * fits > HELD:
                yield from sent()
        yield from sent()

    for _ in range(rounds):
        if not going.any():
            break
        now = packed.mapInArrow(lambda batches, b=beta.copy(), moving=going.copy(): sums(batches, b, moving), schema).groupBy("_k", "_fit", "_t").agg(*[F.sum(n).alias(n) for n in names])
        part = F.when(F.col("_b") > F.col("_a"), F.floor((F.col("_t") - F.col("_a")) / (F.col("_b") - F.col("_a")) * (RANGES - 1))).otherwise(0).cast("int")
        now = now.join(F.broadcast(keys.select("_k", "_a", "_b")), "_k").withColumn("_part", part).drop("_a", "_b")
        for r in _steps(now, ["_k", "_fit"], p).collect():
            k, i = r["_k"], r["_fit"]
            h = np.zeros((p, p))
            h[up] = [r[f"h{i}_{j}"] for i, j in zip(*up, strict=True)]
            h = (h + np.triu(h, 1).T) * np.outer(slope[k, i], slope[k, i]) + size[k, i] * penalty * np.eye(p)
            step = np.linalg.solve(h, np.array([r[f"g{j}"] for j in range(p)]) * slope[k, i] - size[k, i] * penalty * beta[k, i])
            beta[k, i] += np.clip(step, -2, 2)
            going[k, i] = np.abs(step).max(initial=0) >= 1e-8
    packed.unpersist()
    out = []
    for value, k in number.items():
        for i in np.flatnonzero(fitted[k]):
            own = beta[k, i] * slope[k, i]
            out.append((value, int(i), beta[k, i].tolist(), (own / unitless[k]).tolist(), float((own * (shift[k, i] + mean[k] / unitless[k])).sum())))
    return df.sparkSession.createDataFrame(out, f"`{key}` {kind}, `{name}` {deals.schema[name].dataType.simpleString()}, betas array<double>, slopes array<double>, shift double")


def hazards(features: Sequence[str]) -> Column:
    """A row's hazard by the slopes and shift of cox_dealt."""
    linear = sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * F.col("slopes")[i] for i, c in enumerate(features)), -F.col("shift"))
    return F.exp(F.least(F.greatest(linear, F.lit(-35.0)), F.lit(35.0)))


def cox_each(df: DataFrame, keys: Sequence[str], features: Sequence[str], time: str, event: str, train: str, unit: str, label: str, weight: str | None = None, penalty: float = 0.1) -> DataFrame:
    """(keys, unit, label, hazard, betas) of each key's rows outside ``train``: Cox model on its train rows, scaled on them."""
    columns = list(dict.fromkeys([*keys, *features, time, event, train, unit, label, *([weight] if weight else [])]))
    z = standardise(df.select(*columns), keys, train, features, sample=False)
    betas = fit_cox(z.where(F.col(train)), keys, features, time, event, weight, penalty)
    out = z.where(~F.col(train)).join(F.broadcast(betas), list(keys))
    linear = sum((F.col(c) * F.col("betas")[i] for i, c in enumerate(features)), F.lit(0.0))
    return out.select(*keys, unit, label, F.exp(F.least(F.greatest(linear, F.lit(-35.0)), F.lit(35.0))).alias("hazard"), "betas")


def cox_betas(df: DataFrame, keys: Sequence[str], features: Sequence[str], time: str, event: str, weight: str | None = None, penalty: float = 0.1) -> DataFrame:
    """(keys, betas) of Cox models on all rows of each key, scaled on them."""
    return fit_cox(standardise(df, keys, "true", features, sample=False), keys, features, time, event, weight, penalty)
