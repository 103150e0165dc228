"""Models against plain numpy on the same rows."""

import itertools
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

import plain_models as plain
from tideframe.functions import dates
from tideframe.operators import evaluation, fits, joins, models, survival, texts
from tideframe.sources import tables as S


def panel(spark, seed=0, keys=(0, 1, 2), n=120, p=3):
    rng = np.random.default_rng(seed)
    rows = []
    for k in keys:
        x = rng.normal(size=(n, p)) * [1, 3, 10][:p]
        y = (x[:, 0] * (1 + k) + rng.normal(size=n) > 0).astype(int)
        rows += [(k, i, int(y[i]), i % 4 == 0, *map(float, x[i])) for i in range(n)]
    names = [f"x{i}" for i in range(p)]
    return spark.createDataFrame(rows, "k long, u long, y int, held boolean, " + ", ".join(f"{c} double" for c in names)), names


def test_newton_steps_over_rows_are_the_batched_fit(spark):
    df, names = panel(spark)
    more = spark.createDataFrame([(9, i, 1, False, 0.0, 1.0, 2.0) for i in range(5)], df.schema)
    got = {r["k"]: r["beta"] for r in models.fit_logistic(df.unionByName(more).repartition(5), ["k"], names, "y", 2.0).collect()}
    assert set(got) == {0, 1, 2}  # a key with one label has no fit
    for k in got:
        own = df.where(F.col("k") == k).toPandas()
        want = plain.logistic_batch(own[names].to_numpy(), own["y"].to_numpy(float)[None], np.ones((1, len(own))), 2.0)[0]
        assert np.allclose(got[k], want, atol=1e-6)


@pytest.mark.parametrize("l1", [False, True])
def test_scores_of_splits(spark, l1):
    df, names = panel(spark, 1)
    df = df.withColumn("c", F.lit(0.5))
    got = {(r["k"], r["u"]): r["score"] for r in models.score_splits(df, ["k"], "u", names, "y", "held", 0.5, l1, "c" if l1 else None).collect()}
    for k in (0, 1, 2):
        own = df.where(F.col("k") == k).orderBy("u").toPandas()
        out = own["held"].to_numpy(bool)
        x = plain._scaled(own[names].to_numpy(), ~out)
        y = own["y"].to_numpy(float)
        b = plain.lasso_logistic(x[~out], y[~out], 0.5) if l1 else plain.logistic_batch(x[~out], y[None, ~out], np.ones((1, (~out).sum())), 2.0)[0]
        want = 1 / (1 + np.exp(-(b[0] + x[out] @ b[1:])))
        assert np.allclose([got[k, u] for u in own["u"][out]], want, atol=1e-6)
    assert len(got) == 90


def train_rows(df, names, k):
    """(scaled features, labels, unit draws, held) of a key by unit, as the fits see them."""
    own = df.where(F.col("k") == k).withColumn("key", F.conv(F.substring(F.md5(F.concat_ws("|", F.lit("42"), F.col("k").cast("string"), F.col("u").cast("string"))), 1, 16), 16, 10)).orderBy("u").toPandas()
    out = own["held"].to_numpy(bool)
    return plain._scaled(own[names].to_numpy(), ~out), own["y"].to_numpy(float), np.array([int(x) for x in own["key"]], np.uint64), out


def shuffled(y, keys, perm):
    """The labels of a shuffle: as many ones as there are, at the smallest draws."""
    d = fits.draws(keys, np.array([perm]))[:, 0]
    out = np.zeros(len(y))
    out[np.argsort(d)[: int(y.sum())]] = 1
    return y if perm == 0 else out


@pytest.mark.parametrize("wave", [None, 10])
def test_permutation_aucs_are_numpys(spark, monkeypatch, wave):
    if wave:
        monkeypatch.setattr(fits, "WAVE", wave)
    df, names = panel(spark, 2)
    a = models.permutation_aucs(df.repartition(7), "k", names, "y", "held", "u", 40)
    got = {(r["k"], r["perm"]): r["auc"] for r in a.collect()}
    for k in (0, 1, 2):
        x, y, keys, out = train_rows(df, names, k)
        ys = np.stack([shuffled(y[~out], keys[~out], p) for p in range(41)])
        b = plain.logistic_batch(x[~out], ys, np.ones(ys.shape), 1.0)
        want = plain.rank_auc(b[:, :1] + b[:, 1:] @ x[out].T, y[out])
        assert np.allclose([got[k, p] for p in range(41)], want)
    nulls, seen = a.where("perm > 0"), a.where("perm = 0").select("k", "auc")
    p = {r["k"]: r["p"] for r in evaluation.null_summary(nulls, seen, ["k"], "auc").collect()}
    assert p == {k: pytest.approx(np.mean([got[k, i] >= got[k, 0] for i in range(1, 41)])) for k in (0, 1, 2)}


def test_tasks_pass_on_sums_of_few_keys(spark):
    df, names = panel(spark, 5, range(24), 60)
    rows = fits.fit_rows(df.repartition(8), ["k"], "u", names, "y", "held")
    tasks = 4 * spark.sparkContext.defaultParallelism
    assert rows.table.count() == 24 * 60
    assert rows.table.select(F.spark_partition_id(), "_k").distinct().count() < 24 + tasks  # not 24 from every task
    rows.close()


def test_a_step_sends_tasks_its_moving_fits_alone(spark):
    plan = fits.Plan(100, each={0: np.ones(100), 1: np.ones(100)})
    beta, scale = {0: np.zeros((100, 3)), 1: np.zeros((100, 3))}, (np.zeros((1, 2)), np.ones((1, 2)))
    part, state = fits._step(fits.Fitted(plan, beta, {}, {0: scale, 1: scale}, {}), {1: np.array([4, 7])}, False)
    assert set(state) == {1} and state[1][0].shape == (2, 3)
    held = {n: c.cell_contents for n, c in zip(part.__code__.co_freevars, part.__closure__, strict=True)}
    assert set(held) <= {"loss", "plan"} and not held["plan"].each


def test_fits_with_long_tails_settle(spark):
    rng = np.random.default_rng(4)
    x = np.column_stack([-np.exp(rng.normal(size=600) * 2.5) * (rng.random(600) < 0.3), rng.normal(size=600)])
    y = (rng.random(600) < np.where(x[:, 0] < -3, 0.03, 0.97)).astype(int)
    df = spark.createDataFrame([(0, i, int(y[i]), i % 4 == 0, *map(float, x[i])) for i in range(600)], "k long, u long, y int, held boolean, a double, b double")
    rows = fits.fit_rows(df, ["k"], "u", ["a", "b"], "y", "held")
    t = np.arange(600) % 4 != 0
    z = np.column_stack([np.ones(t.sum()), plain._scaled(x, t)[t]])
    grid = [1e-4, 1e-2, 1.0, 100.0]
    for l1 in (False, True):
        found = fits.fit_all(rows, fits.Plan(1, grid), l1)
        for c, b in zip(grid, found.beta[0], strict=True):
            g = z.T @ (y[t] - fits.sigmoid(z @ b))
            off = np.where(b != 0, g - c * np.sign(b), np.maximum(np.abs(g) - c, 0)) if l1 else g - c * b * [0, 1, 1]
            assert np.abs(off).max() < 1e-5
    rows.close()


def test_lasso_minima_of_nearly_dependent_features():
    """Sweeps over coordinates alone take many thousands here."""
    h = np.array([[867.515, -155.71, 226.197, -198.455], [-155.71, 266.85, -40.619, 223.745], [226.197, -40.619, 58.985, -51.778], [-198.455, 223.745, -51.778, 242.015]])
    r, cost = np.array([2126.57606885, -374.49871254, 557.24723152, -379.00149485]), np.full(4, 1.12883789)
    h += np.eye(4) * max(0.0, 1e-3 - np.linalg.eigvalsh(h)[0])
    b = fits._lasso_minima(h[None], r[None], cost[None], np.array([[0.67274645, -1.60634184, 7.57242568, 2.11884901]]))[0]
    g = r - h @ b
    assert np.where(b != 0, np.abs(g - cost * np.sign(b)), np.abs(g) - cost).max() < 1e-6


def test_shuffles_are_many_different_ones(spark):
    df, names = panel(spark, 3, keys=(0,), n=400)
    rows = fits.fit_rows(df, ["k"], "u", names, "y", "held")
    x, y, keys, out = train_rows(df, names, 0)
    n, m = int((~out).sum()), int(y[~out].sum())
    cut = fits.cuts(rows.table.where("NOT _held"), {0: m}, {0: n}, 300, 4)[0]
    d = fits.draws(keys[~out], np.arange(300)) <= cut
    assert (d[:, 1:].sum(0) == m).all() and len({bytes(c) for c in d[:, 1:].T}) == 299
    share = d[:, 1:].mean(1)
    assert abs(share.mean() - m / n) < 1e-9 and share.std() < 2.5 * np.sqrt(m / n * (1 - m / n) / 299)
    for ones, size in ((0, n), (n, n)):
        assert set(fits.cuts(rows.table.where("NOT _held"), {0: ones}, {0: size}, 3)[0][1:]) == ({-1.0} if not ones else {1.0})
    rows.close()


def test_each_shuffle_chooses_its_penalty(spark):
    df, names = panel(spark, 5, keys=(0, 1), n=90)
    grid = [0.01, 0.1, 1.0, 10.0]
    got = {(r["k"], r["perm"]): (r["c"], r["auc"]) for r in models.permutation_aucs(df, "k", names, "y", "held", "u", 6, grid=grid).collect()}
    for k in (0, 1):
        raw = df.where(F.col("k") == k).orderBy("u").toPandas()[names].to_numpy()
        x, y, keys, out = train_rows(df, names, k)
        fold = fits.fold_of(keys, 3)
        for perm in range(7):
            t, right = ~out, []
            label = np.full(len(y), -1.0)
            label[t] = shuffled(y[t], keys[t], perm)
            for c in grid:
                hits = 0
                for f in range(3):
                    on, off = t & (fold != f), t & (fold == f)
                    z = plain._scaled(raw, on)
                    b = plain.logistic_batch(z[on], label[None, on], np.ones((1, on.sum())), 1 / c)[0]
                    hits += ((b[0] + z[off] @ b[1:] > 0) == (label[off] == 1)).sum()
                right.append(hits)
            c = grid[int(np.argmax(right))]
            b = plain.logistic_batch(x[t], label[None, t], np.ones((1, t.sum())), 1 / c)[0]
            assert got[k, perm] == (c, pytest.approx(plain.rank_auc((b[0] + x[out] @ b[1:])[None], y[out])[0]))


@pytest.mark.parametrize("l1", [False, True])
def test_chosen_penalties_by_clusters_are_the_loop(spark, l1):
    df, names = panel(spark, 6, keys=(0, 1), n=80)
    df = df.withColumn("g", F.when(F.col("u") % 5 < 4, F.col("u") % 5))  # a fifth of the rows is in no cluster
    grid = [0.02, 0.2, 2.0]
    got = {r["k"]: r for r in models.choose_c(df, ["k"], names, "y", "u", grid, l1=l1, cluster="g").collect()}
    for k in (0, 1):
        own = df.where(F.col("k") == k).orderBy("u").toPandas()
        raw, y, g = own[names].to_numpy(), own["y"].to_numpy(float), own["g"].to_numpy(float)
        fit = (lambda x, t, c: plain.lasso_logistic(x, t, c)) if l1 else (lambda x, t, c: plain.logistic_batch(x, t[None], np.ones((1, len(t))), 1 / c)[0])
        best = (-1.0, None)
        for c in grid:
            score = np.full(len(y), np.nan)
            for f in range(4):
                t = g != f
                x = plain._scaled(raw, t)
                b = fit(x[t], y[t], c)
                score[~t] = b[0] + x[~t] @ b[1:]
            has = ~np.isnan(score)
            value = float(plain.rank_auc(score[None, has], y[has])[0])
            if value > best[0] + 1e-12:
                best = (value, c)
        b = fit(plain._scaled(raw, np.ones(len(y), bool)), y, best[1])
        assert (got[k]["c"], got[k]["nonzero"]) == (best[1], int((np.abs(b[1:]) > 1e-8).sum())) and got[k]["auc"] == pytest.approx(best[0])


def test_leaving_one_row_out(spark):
    df, names = panel(spark, 7, keys=(3,), n=24)
    got = models.choose_c(df, ["k"], names, "y", "u", [0.1, 1.0], folds=None, l1=True).first()
    own = df.orderBy("u").toPandas()
    raw, y, best = own[names].to_numpy(), own["y"].to_numpy(float), (-1.0, None)
    for c in (0.1, 1.0):
        score = np.zeros(24)
        for i in range(24):
            t = np.arange(24) != i
            x = plain._scaled(raw, t)
            b = plain.lasso_logistic(x[t], y[t], c)
            score[i] = b[0] + x[i] @ b[1:]
        value = float(plain.rank_auc(score[None], y)[0])
        if value > best[0] + 1e-12:
            best = (value, c)
    assert got["c"] == best[1] and got["auc"] == pytest.approx(best[0])


@pytest.mark.parametrize("l1", [True, False])
def test_leaving_one_of_many_rows_out_by_series_is_the_fits(spark, monkeypatch, l1):
    df, names = panel(spark, 11, keys=(0, 4), n=90)
    grid, asked = [0.02, 0.1, 1.0], []
    want = {r["k"]: r for r in models.choose_c(df, ["k"], names, "y", "u", grid, folds=None, l1=l1).collect()}
    of, rows_off = fits.Plan.of, fits.SERIES_OFF
    monkeypatch.setattr(fits, "SERIES_ROWS", 50)
    monkeypatch.setattr(fits.Plan, "of", lambda self, k: (asked.append(len(self.only[k][0])) if k in self.only else None) or of(self, k))
    for off in (1e9, rows_off, -1.0):  # all by series, some of them, none
        monkeypatch.setattr(fits, "SERIES_OFF", off)
        asked.clear()
        got = {r["k"]: r for r in models.choose_c(df, ["k"], names, "y", "u", grid, folds=None, l1=l1).collect()}
        assert max(asked, default=0) == 0 if off > 1 else max(asked) == 270 if off < 0 else 0 < max(asked) < 270
        for k, r in want.items():
            assert (got[k]["c"], got[k]["nonzero"]) == (r["c"], r["nonzero"]) and got[k]["auc"] == pytest.approx(r["auc"], abs=1e-3 if off > 1 else 1e-9)


def test_aucs_by_ranges_of_the_score_are_the_same(spark):
    df, names = panel(spark, 8)
    rows = fits.fit_rows(df, ["k"], "u", names, "y", "held")
    found = fits.fit_all(rows, fits.Plan(3))
    score = lambda k, b: (np.round(fits.scaled(b, found.scale[k], -1) @ found.beta[k].T, 1), np.arange(3))
    one, many = fits.aucs(rows, found, "_held", score), fits.aucs(rows, found, "_held", score, most=4)
    assert one == {k: pytest.approx(v) for k, v in many.items()} and set(one) == {0, 1, 2}
    rows.close()


def test_permutation_zero_is_the_fit(spark):
    df, names = panel(spark, 2)
    for grid in (None, [0.1, 1.0]):
        a = models.permutation_aucs(df, "k", names, "y", "held", "u", 5, grid=grid)
        assert a.count() == 18
        scored = models.score_splits(df, ["k"], "u", names, "y", "held")
        want = {r["k"]: r["auc"] for r in evaluation.auc(scored, ["k"], "score", "y").collect()}
        if grid is None:
            assert {r["k"]: r["auc"] for r in a.where("perm = 0").collect()} == pytest.approx(want)
        else:
            assert {r["c"] for r in a.collect()} <= set(grid)


def enumerated(x, start, move, mean, var):
    """State probabilities, summed transitions and log likelihood over all state paths."""
    n, s = len(x), len(start)
    dens = np.array([[np.prod(np.exp(-((v - mean[j]) ** 2) / var[j] / 2) / np.sqrt(2 * np.pi * var[j])) for j in range(s)] for v in x])
    total, g, pairs = 0.0, np.zeros((n, s)), np.zeros((s, s))
    for path in itertools.product(range(s), repeat=n):
        w = start[path[0]] * dens[0, path[0]] * np.prod([move[a, b] * dens[t + 1, b] for t, (a, b) in enumerate(itertools.pairwise(path))])
        total += w
        for t, j in enumerate(path):
            g[t, j] += w
        for a, b in itertools.pairwise(path):
            pairs[a, b] += w
    return g / total, pairs / total, np.log(total)


def test_forward_backward_is_the_sum_over_paths():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(5, 2))
    sets = []
    for _ in range(3):
        start, move = rng.dirichlet([1, 1]), rng.dirichlet([1, 1], size=2)
        sets.append((start, move, rng.normal(size=(2, 2)), rng.uniform(0.5, 2, (2, 2))))
    g, pairs, ll = models._posterior(x, *[np.stack(z) for z in zip(*sets, strict=True)])
    for i, m in enumerate(sets):
        want = enumerated(x, *m)
        assert np.allclose(g[:, i], want[0]) and np.allclose(pairs[i], want[1]) and ll[i] == pytest.approx(want[2])


def test_hidden_states_are_found_and_many_models_are_the_single_ones(spark):
    rng = np.random.default_rng(7)
    rows, wild = [], {}
    for s in range(24):
        state = 0
        for t in range(30):
            state = state if rng.random() < 0.9 else 1 - state
            wild[s, t] = state
            rows.append((s, t, float(rng.normal([0.2, 1.5][state], 0.15)), float(rng.normal(state, 1))))
    df = spark.createDataFrame(rows, "s long, t int, v double, w double")
    model = models.fit_hmm(df, "s", "t", ["v", "w"], 2, 10)
    assert sorted(model.mean[0, :, 0].round(1)) == [0.2, 1.5]
    d = models.danger_scores(df, model, "s", "t", ["v", "w"]).collect()
    assert len(d) == len(rows) and np.mean([(r["danger"] > 0.5) == bool(wild[r["s"], r["t"]]) for r in d]) > 0.97
    members = df.select("s").distinct().withColumn("split", F.explode(F.array(F.lit(3), F.lit(5)))).where("split = 3 OR s < 12")
    many = models.fit_hmm(df, "s", "t", ["v", "w"], 2, 10, members=members)
    half = models.fit_hmm(df.where("s < 12"), "s", "t", ["v", "w"], 2, 10)
    assert many.names == (3, 5) and np.allclose(many.mean[0], model.mean[0]) and np.allclose(many.move[1], half.move[0])
    few = models.danger_scores(df, many, "s", "t", ["v", "w"], members=members.where("s = 2"))
    assert {(r["split"], r["s"]) for r in few.collect()} == {(3, 2), (5, 2)}
    assert models.fit_hmm(df.where("s < 0"), "s", "t", ["v", "w"], 2).names == ()


def test_an_hmm_of_each_sequence_is_the_joint_fit_of_it(spark):
    rng = np.random.default_rng(17)
    rows = [(s, t, float(rng.normal([0.2, 1.5][(t // 7 + s) % 2], 0.2)), float(rng.normal())) for s in range(4) for t in range(40 if s else 4)]
    df = spark.createDataFrame(rows, "s long, t int, v double, w double")
    got = models.danger_of_each(df, "s", "t", ["v", "w"], 2).collect()
    assert {r["s"] for r in got} == {1, 2, 3} and all(1 < r["rounds"] < 200 for r in got)
    one = models.fit_hmm(df.where("s = 2"), "s", "t", ["v", "w"], 2, rounds=max(r["rounds"] for r in got if r["s"] == 2) - 1)
    want = {r["t"]: r["danger"] for r in models.danger_scores(df.where("s = 2"), one, "s", "t", ["v", "w"]).collect()}
    assert {r["t"]: r["danger"] for r in got if r["s"] == 2} == {t: pytest.approx(v, abs=1e-5) for t, v in want.items()}


def test_forests_order_what_they_were_shown(spark):
    df, names = panel(spark, 3, keys=(4,), n=200)
    out = models.forest_scores(df.where("NOT held"), df.where("held"), names, "y", trees=30).collect()
    assert all(0 <= r["score"] <= 1 for r in out)
    assert plain.rank_auc(np.array([[r["score"] for r in out]]), np.array([r["y"] for r in out]))[0] > 0.9
    rng = np.random.default_rng(8)
    rows = [(i, x := float(rng.uniform(-1, 1)), max(1, int(rng.exponential(4 * np.exp(-1.5 * x)))) if i % 5 else 6, int(i % 5 > 0)) for i in range(200)]
    life = spark.createDataFrame([(i, x, min(t, 12), e) for i, x, t, e in rows], "u long, x double, t int, e int")
    risk = {r["u"]: r["risk"] for r in models.survival_forest_scores(life, life, ["x"], "t", "e", "u", trees=30).collect()}
    assert np.corrcoef([risk[i] for i, *_ in rows], [x for _, x, *_ in rows])[0, 1] > 0.7


def test_survival_forest_tells_small_hazards_apart_in_any_partitioning(spark):
    rng = np.random.default_rng(11)
    rows = [(i, x := float(rng.uniform(-1, 1)), min(12, 1 + int(rng.exponential(20 * np.exp(-1.5 * x))))) for i in range(400)]
    life = spark.createDataFrame([(i, x, t, int(t < 12)) for i, x, t in rows], "u long, x double, t int, e int")
    score = lambda df: {r["u"]: r["risk"] for r in models.survival_forest_scores(df, life, ["x"], "t", "e", "u", trees=30, prune=False).collect()}
    one = score(life.repartition(1))
    assert one == score(life.repartition(7))
    assert np.corrcoef([one[i] for i, *_ in rows], [x for _, x, _ in rows])[0, 1] > 0.7
    # a known hazard: of 300 rows in period 1 every fourth has its event
    flat = spark.createDataFrame([(i, 0.0, 1, int(i % 4 == 0)) for i in range(300)], "u long, x double, t int, e int")
    assert models.survival_forest_scores(flat, flat.limit(1), ["x"], "t", "e", "u").first()["risk"] == pytest.approx(0.25, abs=0.01)


def test_principal_components_are_the_eigenvectors(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(80, 5)) @ rng.normal(size=(5, 5))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "i int, v array<double>")
    out, shares = models.principal_components(df, "v", 3)
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    values, vectors = np.linalg.eigh(np.cov(z.T))
    assert np.allclose(shares, (values[::-1] / values.sum())[:3])
    got = np.array([r["components"] for r in out.orderBy("i").collect()])
    assert np.allclose(np.abs(got), np.abs(z @ vectors[:, ::-1][:, :3]), atol=1e-8)


def test_laplace_narrows_with_rows_and_agrees_with_the_fit(spark):
    wide, names = panel(spark, 10, keys=(0,), n=60)
    long, _ = panel(spark, 10, keys=(0,), n=2000)
    width = [np.mean([r["width"] for r in models.laplace_each(d, ["k"], "u", names, "y", "held").collect()]) for d in (wide, long)]
    assert width[1] < width[0] / 2
    a = {r["u"]: r["score"] for r in models.laplace_each(long, ["k"], "u", names, "y", "held").collect()}
    b = {r["u"]: r["score"] for r in models.score_splits(long, ["k"], "u", names, "y", "held").collect()}
    assert max(abs(a[u] - b[u]) for u in a) < 0.05


def test_percentile_rank_is_the_count(spark):
    rng = np.random.default_rng(11)
    ref = [("ab"[int(g)], float(v) if v < 8 else None) for g, v in zip(rng.integers(0, 2, 300), rng.integers(0, 10, 300) + rng.choice([0, 0.5], 300), strict=True)]
    own = [(i, "abc"[i % 3], float(v) if i % 7 else None) for i, v in enumerate(rng.uniform(-1, 9, 60).round(1))]
    out = evaluation.percentile_rank(spark.createDataFrame(own, "i int, g string, s double"), spark.createDataFrame(ref, "g string, s double"), "g", "s", 8).collect()
    assert len(out) == 60
    for r in out:
        known = [v for g, v in ref if g == r["g"] and v is not None]
        if r["s"] is None or not known:
            assert r["percentile"] is None
            continue
        assert r["percentile"] == pytest.approx(100 * np.mean([v <= r["s"] for v in known])) and r["out_of_range"] == (r["s"] > max(known))


def test_percentile_ranks_of_a_long_tail_are_dealt_evenly(spark):
    """One huge value doesn't put all others into one range."""
    ref = spark.range(2000).select(F.lit("k").alias("k"), F.when(F.col("id") == 0, 1e12).otherwise(F.col("id").cast("double")).alias("s"))
    out = evaluation.percentile_rank(ref, ref, "k", "s", 16)
    assert {r["s"]: r["percentile"] for r in out.collect()} == {(1e12 if i == 2000 else float(i)): pytest.approx(i / 20) for i in range(1, 2001)}
    tree = out._jdf.queryExecution().analyzed().toString()
    assert "_bounds" in tree


def test_spearman_p_is_near_that_of_permutations(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=60)
    y = 0.25 * x + rng.normal(size=60)
    r = evaluation.spearman(spark.createDataFrame([(0, float(a), float(b)) for a, b in zip(x, y, strict=True)], "g int, x double, y double"), ["g"], "x", "y").first()
    rank = lambda v: np.argsort(np.argsort(v))
    null = np.array([np.corrcoef(rank(x), rng.permutation(60))[0, 1] for _ in range(4000)])
    assert r["rho"] == pytest.approx(np.corrcoef(rank(x), rank(y))[0, 1]) and r["p"] == pytest.approx(np.mean(np.abs(null) >= abs(r["rho"])), abs=0.03)


def test_month_auc_is_within_event_groups(spark):
    rows = [("g", s, m, float(m if s < 2 else -m), int(s < 2 and m >= 6)) for s in range(4) for m in range(12)]
    df = spark.createDataFrame(rows, "g string, s int, m int, v double, y int")
    out = evaluation.month_auc(df, ["g"], "m", "s", "v", "y").first()
    assert (out["month_auc"], out["n"]) == (1.0, 24)
    assert evaluation.month_auc(df.where("m < 4 OR m = 7"), ["g"], "m", "s", "v", "y", 11).first()["month_auc"] is None


def test_bridge_takes_the_last_end_and_frames_are_assembled(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    one = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "x string, y int")
    two = spark.createDataFrame([(1, "p"), (2, "q"), (2, "o")], "y int, z string")
    assert {r["k"]: r["end"] for r in joins.through_bridge(df, [(one, "x", "y"), (two, "y", "z")], "k", "end").collect()} == {"a": "q", "b": None, "c": None}
    out = joins.assemble([spark.createDataFrame([(1, 1.0)], "k int, a double"), spark.createDataFrame([(1, 2.0), (2, 3.0)], "k int, b double")], ["k"]).orderBy("k")
    assert [tuple(r) for r in out.collect()] == [(1, 1.0, 2.0), (2, None, 3.0)]
    both = joins.union_rows(df, spark.createDataFrame([("a", 1)], "k string, v int"), distinct_on=["k"])
    assert both.count() == 3


def test_a_wide_dictionary_gives_words_by_category(spark):
    wide = spark.createDataFrame([("loss", "2009", "0", 1), ("gain ", "0", "2009", 1), ("odd", "-2020", "0", 1), ("may", "2009", "2010", 1)], "word string, Negative string, Positive string, syllables int")
    out = texts.category_words(wide, {"negative": "Negative", "positive": "Positive"})
    assert {(r["word"], r["category"]) for r in out.collect()} == {("LOSS", "negative"), ("GAIN", "positive"), ("MAY", "negative"), ("MAY", "positive")}
    df = spark.createDataFrame([(1, "Loss, loss; MAY. Weiß"), (2, "!")], "k int, t string")
    got = {r["k"]: r for r in texts.category_scores(df, "k", "t", out, ["negative", "positive"]).collect()}
    assert (got[1]["word_count"], got[1]["negative_count"], got[1]["positive_count"]) == (4, 3, 1)
    assert (got[2]["word_count"], got[2]["negative_count"], got[2]["negative_pct"]) == (0, 0, None)


def test_named_files_texts_and_csv(spark, tmp_path):
    for name in ("e1", "e2"):
        spark.createDataFrame([(1, float("nan"))], "a int, b double").toPandas().to_parquet(tmp_path / f"{name}.parquet")
        (tmp_path / f"{name}.txt").write_text(f"text of {name}\n")
    out = S.read_named_files(spark, f"{tmp_path}/*.parquet").collect()
    assert {(r["episode_id"], r["b"]) for r in out} == {("e1", None), ("e2", None)}
    index = spark.createDataFrame([("e2",), ("e9",)], "id string")
    assert [(r["id"], r["text"].strip()) for r in S.read_texts(spark, f"{tmp_path}/*.txt", index, "id").collect()] == [("e2", "text of e2")]
    S.write_csv(index, f"{tmp_path}/csv")
    assert S.read_csv(spark, f"{tmp_path}/csv", "id string").count() == 2
    older = '{"form":["10-K"],"filingDate":["1999-01-02"],"accessionNumber":["0-9"],"primaryDocument":["a"]}'
    rows = S.filing_rows(spark.createDataFrame([("7", older)], "cik string, json string"), "json", ["cik"], S.OLDER_INDEX, "")
    assert [(r["cik"], r["form"]) for r in rows.collect()] == [("7", "10-K")]
    assert spark.range(1).select(dates.year_month(F.lit("2001-07")), dates.year_month(F.lit(200107))).first() == (date(2001, 7, 1), date(2001, 7, 1))


def test_leverage_reaches_past_the_last_report_if_asked(spark):
    months = spark.createDataFrame([("f", date(2020, m, 28), 10.0) for m in (1, 2, 3, 4)], "f string, d date, e double").select("f", F.last_day("d").alias("month_end"), "e")
    reports = spark.createDataFrame([("f", date(2020, 1, 31), 10.0), ("f", date(2020, 2, 29), 30.0)], "f string, r date, debt double")
    get = lambda extend: [r["leverage"] for r in joins.firm_leverage(months, reports, "f", "debt", "r", "e", extend=extend).orderBy("month_end").collect()]
    assert get(False) == [0.5, 0.75, None, None] and get(True) == [0.5, 0.75, 0.75, 0.75]


def test_sector_credit_volatility_is_the_plain_loop(spark, sf_dir):
    from tideframe.functions import credit
    from tideframe.plans import panel_queries as Q

    got = {(r["sector"], r["month_end"]): r for r in Q.sector_credit_implied_vol(spark, sf_dir).collect()}
    lev = Q.leveraged(spark, sf_dir).toPandas()
    b = Q._bonds(spark, sf_dir).toPandas().merge(lev[["l_suppkey", "month_end", "leverage", "sector"]], on=["l_suppkey", "month_end"])
    b["civ"] = credit.invert_spreads(b["spread"].to_numpy(float), b["leverage"].to_numpy(float), b["bucket"].to_numpy(float))
    want = {}
    for key, rows in b.groupby(["sector", "month_end"]):
        firms = []
        for _, own in rows.groupby("l_suppkey"):
            five = own.loc[own["bucket"] == 5, "civ"].dropna()
            firms.append(five.median() if len(five) else own["civ"].median())
        firms = [x for x in firms if x == x]
        if firms:
            want[key] = float(np.median(firms))
    asset = lev.groupby(["sector", "month_end"])["asset_vol"].median()
    assert set(got) == set(want)
    for key, value in want.items():
        assert got[key]["metric_o"] == pytest.approx(value, abs=2e-6)
        if got[key]["metric_p"] is not None:
            assert got[key]["metric_p"] == pytest.approx(value - asset[key], abs=3e-6)
    for sector in {k[0] for k in want}:
        months = sorted(k[1] for k in want if k[0] == sector)
        for before, now in zip(months, months[12:], strict=False):
            assert got[sector, now]["metric_q"] == pytest.approx(want[sector, now] - want[sector, before], abs=3e-6)


@pytest.mark.parametrize("months", [True, False])
def test_cox_sums_are_the_loop_over_risk_sets(spark, months):
    rng = np.random.default_rng(21)
    rows = []
    for k in range(3):
        x = rng.normal(size=(150, 3)) * [1, 5, 0.1]
        t = rng.exponential(10 * np.exp(-0.8 * x[:, 0]))
        t = np.minimum(np.ceil(t), 12) if months else t
        rows += [(k, i, i % 3 > 0, float(t[i]), int(rng.uniform() < 0.7), int(rng.integers(1, 4)), *map(float, x[i])) for i in range(150)]
    rows += [(7, i, True, 3.0, 0, 1, 0.1, 0.2, 0.3) for i in range(5)]  # no event
    names = ["a", "b", "c"]
    df = spark.createDataFrame(rows, "k int, u int, train boolean, t double, e int, w int, a double, b double, c double").withColumn("y", F.lit(1))
    for weight in (None, "w"):
        out = survival.cox_each(df.repartition(5), ["k"], names, "t", "e", "train", "u", "y", weight).collect()
        assert {r["k"] for r in out} == {0, 1, 2}
        for k in range(3):
            own = df.where(F.col("k") == k).orderBy("u").toPandas()
            on = own["train"].to_numpy(bool)
            x = plain._scaled(own[names].to_numpy(), on)
            b = plain.cox_efron(x[on], own["t"].to_numpy()[on], own["e"].to_numpy()[on], own["w"].to_numpy(float)[on] if weight else np.ones(on.sum()))
            mine = {r["u"]: r for r in out if r["k"] == k}
            assert np.allclose(next(iter(mine.values()))["betas"], b, atol=1e-7)
            assert np.allclose([mine[u]["hazard"] for u in own["u"][~on]], np.exp(x[~on] @ b))
    assert survival.fit_cox(df.where("k > 9"), ["k"], names, "t", "e").count() == 0


def test_dealt_cox_models_are_those_of_repeated_rows(spark, monkeypatch):
    """Fits that share units pack their rows once; the coefficients are those of the rows repeated for each fit."""
    monkeypatch.setattr(survival, "PACKED", 7)
    monkeypatch.setattr(survival, "CELLS", 64)
    monkeypatch.setattr(survival, "HELD", 500)
    rng = np.random.default_rng(3)
    rows = [(u, u % 2, int(rng.integers(1, 9)), int(rng.random() < 0.5), float(rng.normal(5, 2)), None if i == 3 else float(rng.normal())) for u in range(12) for i in range(10)]
    df = spark.createDataFrame(rows, "u long, g int, t int, e int, a double, b double").repartition(3)
    deals = spark.createDataFrame([(u, f, int(rng.integers(1, 4))) for f in range(3) for u in range(12) if rng.random() < 0.7], "u long, f long, weight long")
    got = {(r["g"], r["f"]): r for r in survival.cox_dealt(df, deals, "u", "g", "f", ["a", "b"], "t", "e").collect()}
    want = survival.cox_betas(df.join(deals, "u"), ["g", "f"], ["a", "b"], "t", "e", "weight").collect()
    assert set(got) == {(r["g"], r["f"]) for r in want}
    for r in want:
        assert np.allclose(got[r["g"], r["f"]]["betas"], r["betas"], atol=1e-8)


@pytest.mark.parametrize("events", [1, 32, 33, 5000])
@pytest.mark.parametrize("all_events", [False, True])
def test_efron_sums_of_many_events_are_the_loop(spark, events, all_events):
    s0, d0 = (40.0, 40.0) if all_events else (1000.0, 3.0)
    got = survival._efron(spark.createDataFrame([(s0, d0, float(events))], "s0 double, d0 double, d double")).first()["_q"]
    f = np.arange(events) / events
    q = 1 / (s0 - f * d0)
    assert np.allclose(got, [q.sum(), (f * q).sum(), (q * q).sum(), (f * q * q).sum(), (f * f * q * q).sum()], rtol=1e-9)


def test_many_sequences_at_once_are_the_single_ones(spark, monkeypatch):
    rng = np.random.default_rng(8)
    size = np.array([7, 1, 5, 4])
    x = rng.normal(size=(7, 4, 2))
    start, move, mean, var = rng.dirichlet([1, 1, 1], 4), rng.dirichlet([1, 1, 1], (4, 3)), rng.normal(size=(4, 3, 2)), rng.uniform(0.5, 2, (4, 3, 2))
    g, pairs, value = models._posteriors(x, size, start, move, mean, var)
    for i, n in enumerate(size):
        one = models._posterior(x[:n, i], start[i : i + 1], move[i : i + 1], mean[i : i + 1], var[i : i + 1])
        assert np.allclose(g[:n, i], one[0][:, 0]) and not g[n:, i].any() and np.allclose(pairs[i], one[1][0]) and np.allclose(value[i], one[2][0])


def test_hidden_states_of_sequences_of_many_lengths_in_small_blocks(spark, monkeypatch):
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(s, t, float(rng.normal(3 * (t // 5 % 2)))) for s in range(9) for t in range(3 + 4 * s)], "s long, t int, v double").repartition(3)
    each = {(r["s"], r["t"]): (r["danger"], r["rounds"]) for r in models.danger_of_each(df, "s", "t", ["v"], 2).collect()}
    alone = {(r["s"], r["t"]): (r["danger"], r["rounds"]) for r in models.danger_of_each(df.where("s = 4"), "s", "t", ["v"], 2).collect()}
    assert {k for k, _ in each} == set(range(1, 9)) and all(each[k][1] == v[1] and np.isclose(each[k][0], v[0]) for k, v in alone.items())
    now = models.fit_hmm(df, "s", "t", ["v"], 2, 5)
    monkeypatch.setattr(models, "CELLS", 10)
    assert np.allclose(models.fit_hmm(df, "s", "t", ["v"], 2, 5).mean, now.mean)
    assert models.danger_scores(df, now, "s", "t", ["v"]).where("s = 8").count() == 35


def test_texts_are_measured_before_they_meet_labels_and_splits(spark, sf_dir):
    from tideframe.plans import evaluation_queries, model_queries

    plan = evaluation_queries.units(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    join = next(i for i, line in enumerate(plan) if "Join Inner" in line)
    assert "length(text" in plan[join + 1] and not any("length(text" in line for line in plan[:join])
    done = model_queries.text_model_with_and_without_test_units(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "text#" not in done
