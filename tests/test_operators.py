"""Hand-made cases and properties of the panel operators."""

import math
from datetime import date

import numpy as np
import plain_models as plain
import pytest
from pyspark.sql import functions as F

from tideframe.functions import credit, dates, numbers
from tideframe.operators import bonds, evaluation, joins, models, panel, splits, texts
from tideframe.operators import volatility as V
from tideframe.plans import metric_panel, panel_queries, roles
from tideframe.sources import tables as S


def one(df):
    return df.first()[0]


def test_clip_keeps_null_and_ratio_of_zero_is_null(spark):
    df = spark.createDataFrame([(None, 1.0), (3.0, 0.0), (-3.0, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(numbers.clip(F.col("a"), -2.0, 2.0)).collect()] == [None, 2.0, -2.0]
    assert [r[0] for r in df.select(numbers.ratio(F.col("a"), F.col("b"))).collect()] == [None, None, -1.5]


def test_unmapped_key_is_an_error(spark):
    df = spark.createDataFrame([("x",)], "k string")
    with pytest.raises(Exception, match="unmapped"):
        df.select(numbers.mapped(F.col("k"), {"a": "b"})).collect()
    assert one(df.select(numbers.mapped(F.col("k"), {"a": "b"}, "other"))) == "other"


def test_nan_becomes_null(spark):
    df = numbers.nan_to_null(spark.createDataFrame([(float("nan"),), (float("inf"),), (1.0,)], "a double"))
    assert [r[0] for r in df.collect()] == [None, None, 1.0]


def test_quarter_stamps(spark):
    df = spark.createDataFrame([(date(2020, 2, 15),), (date(2020, 12, 1),)], "d date")
    assert [r[0] for r in df.select(dates.quarter_stamp(F.col("d"), "first_month")).collect()] == [date(2020, 1, 31), date(2020, 10, 31)]
    assert [r[0] for r in df.select(dates.quarter_stamp(F.col("d"))).collect()] == [date(2020, 3, 31), date(2020, 12, 31)]


def test_months_reach_one_less_from_a_short_month(spark):
    df = spark.createDataFrame([("a", date(2020, 1, 31), 1), ("b", date(2020, 4, 30), 2)], "k string, d date, v int")
    out = {k: [] for k in "ab"}
    for r in joins.to_months(df, ["k"], "d", ["v"], 3).collect():
        out[r["k"]].append(r["month_end"])
    assert max(out["a"]) == date(2020, 4, 30)
    assert max(out["b"]) == date(2020, 6, 30)


@pytest.mark.parametrize("bucket", [(0, 3), (4, 3), (4.1, 5), (7, 5), (30, 10), (31, None)])
def test_maturity_buckets(spark, bucket):
    assert one(spark.range(1).select(numbers.maturity_bucket(F.lit(float(bucket[0]))))) == bucket[1]


def test_bond_weights_and_mode(spark):
    d = date(2020, 1, 5)
    rows = [("i", d, 0.02, 3.0, 0.0, "B"), ("i", d, 0.04, 3.0, 0.0, "A"), ("j", d, 0.02, 3.0, None, "A"), ("j", d, 0.05, 3.0, 3.0, "A"), ("j", d, 0.11, 3.0, 3.0, "A")]
    df = spark.createDataFrame(rows, "i string, d date, s double, y double, w double, r string")
    out = {r["i"]: r for r in bonds.issuer_months(df, "i", "d", "s", "y", "w", "r").collect()}
    assert out["i"]["spread"] == pytest.approx(0.03) and out["i"]["rating"] == "A"
    assert out["j"]["spread"] == pytest.approx((0.02 + 3 * 0.05) / 4) and out["j"]["n_bonds"] == 2


def test_inversion_round_trip_and_invalid_rows(spark):
    rows = [(s, l, t) for s in (0.05, 0.2, 0.6, 1.0) for l in (0.2, 0.5, 0.9) for t in (1.0, 5.0, 10.0)]
    df = spark.createDataFrame(rows, "s double, l double, t double").withColumn("x", credit.merton_spread(F.col("s"), F.col("l"), F.col("t")))
    for r in df.where("x > 1e-4").withColumn("b", credit.implied_volatility("x", "l", "t")).collect():
        assert r["b"] == pytest.approx(r["s"], abs=1e-7)
    bad = spark.createDataFrame([(0.0, 0.5, 5.0), (0.01, 0.0, 5.0), (0.01, 1.0, 5.0), (0.01, 0.5, 0.0), (None, 0.5, 5.0)], "x double, l double, t double")
    assert [r[0] for r in bad.select(credit.implied_volatility("x", "l", "t")).collect()] == [None] * 5


def test_vega_is_the_slope(spark):
    args = [F.lit(x) for x in (0.3, 0.6, 5.0)]
    h = 1e-5
    r = spark.range(1).select(credit.merton_vega(*args), credit.merton_spread(F.lit(0.3 + h), *args[1:]), credit.merton_spread(F.lit(0.3 - h), *args[1:])).first()
    assert r[0] == pytest.approx((r[1] - r[2]) / (2 * h), rel=1e-5)


def test_normal_cdf(spark):
    x = np.linspace(-8, 8, 33).tolist()
    got = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(credit.normal_cdf(F.col("x"))).collect()]
    assert np.allclose(got, [0.5 * math.erfc(-v / 2**0.5) for v in x], atol=1e-15, rtol=1e-6)


def test_cusum_is_the_recursion(spark):
    rng = np.random.default_rng(1)
    values = [None if i % 7 == 3 else float(v) for i, v in enumerate(rng.normal(0.4, 1, 60))]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "g string, i int, v double")
    s, want = 0.0, []
    for v in values:
        s = s if v is None else max(0.0, s + v - 0.5)
        want.append(s)
    got = [r["cusum"] for r in V.cusum(df, "g", ["i"], "v", F.lit(0.0), F.lit(1.0)).orderBy("i").collect()]
    assert np.allclose(got, want)


def test_expanding_gap_is_the_loop(spark):
    rng = np.random.default_rng(2)
    rows = [("a", date(2020, 1 + i // 8, 28), float(rng.uniform(0, 1)), float(rng.normal())) for i in range(80)]
    df = spark.createDataFrame(rows, "g string, d date, x double, y double")
    got = {r["d"]: r["metric_b"] for r in V.expanding_gap(df, "g", "d", "x", "y").collect()}
    for d in sorted({r[1] for r in rows}):
        h = np.array([(r[2], r[3]) for r in rows if r[1] <= d])
        if len(h) < 10:
            assert got[d] is None
            continue
        b, a = np.polyfit(h[:, 0], h[:, 1], 1)
        now = np.array([(r[2], r[3]) for r in rows if r[1] == d])
        assert got[d] == pytest.approx(np.median(now[:, 1] - a - b * now[:, 0]), abs=1e-9)


def test_auc_ties_reversal_and_null(spark):
    rows = [(0, 1, 1.0), (0, 1, 2.0), (0, 0, 2.0), (0, 0, 0.0), (1, 1, 1.0), (1, 1, 2.0), (1, 1, 3.0), (1, 1, 4.0)]
    df = spark.createDataFrame(rows, "k int, y int, s double")
    a = {r["k"]: r["auc"] for r in evaluation.auc(df, ["k"], "s", "y").collect()}
    b = {r["k"]: r["auc"] for r in evaluation.auc(df.withColumn("s", -F.col("s")), ["k"], "s", "y").collect()}
    assert a[0] == 0.625 and b[0] == 1 - 0.625 and a[1] is None
    assert plain.rank_auc(np.array([[1.0, 2, 2, 0]]), np.array([1, 1, 0, 0]))[0] == 0.625


def test_held_out_rows_do_not_change_train_statistics(spark):
    rows = [(0, i, i % 4 == 0, float(i), None if i == 3 else float(i * i)) for i in range(12)]
    df = spark.createDataFrame(rows, "k int, i int, held boolean, x double, y double")
    moved = df.withColumn("x", F.when(F.col("held"), F.col("x") + 100).otherwise(F.col("x")))
    get = lambda d: sorted(tuple(r) for r in evaluation.standardise(d, ["k"], "NOT held", ["x", "y"]).where("NOT held").collect())
    assert get(df) == get(moved)


def test_splits_are_the_same_however_dealt(spark):
    u = spark.createDataFrame([(i, "ab"[i % 2] if i % 5 else None) for i in range(40)], "u int, s string")
    a = splits.stratified_holdouts(u, "u", "s", 5)
    b = splits.stratified_holdouts(u.repartition(7), "u", "s", 5)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    sizes = a.where("held").groupBy("split", "stratum").count().collect()
    assert {(r["stratum"], r["count"]) for r in sizes} == {("a", 3), ("b", 3), ("unknown", 2)}


def test_as_of_takes_the_latest_not_later(spark):
    left = spark.createDataFrame([("a", 1, date(2020, 1, 10)), ("a", 2, date(2020, 1, 1)), ("b", 3, date(2020, 5, 1))], "k string, id int, t date")
    right = spark.createDataFrame([("a", date(2020, 1, 5), 5.0), ("a", date(2020, 1, 10), 10.0), ("a", date(2020, 2, 1), 20.0)], "k string, u date, v double")
    out = {r["id"]: r["v"] for r in joins.as_of(left, right, ["k"], "t", "u", ["v"]).collect()}
    assert out == {1: 10.0, 2: None, 3: None}


def test_pre_peak_labels(spark):
    peak = date(2020, 12, 1)
    df = spark.createDataFrame([(m, b, date(2017 + (m + 11) // 12, (m + 11) % 12 + 1, 1), peak) for m in (0, 1, 24, 36, 35) for b in (True, False)], "m int, b boolean, d date, p date")
    out = panel.pre_peak(df, "d", "p", F.col("b")).collect()
    assert all(-36 <= r["tau"] < 0 for r in out) and panel.leaks(panel.pre_peak(df, "d", "p", F.col("b"))).isEmpty()
    assert all(r["event_12m"] == int(r["b"] and r["tau"] >= -12) and r["time_to_peak"] == (-r["tau"] if r["b"] else 36) for r in out)


def test_phrases_are_substrings_unless_asked(spark):
    df = spark.createDataFrame([("The movie was a VIE of movies",)], "t string")
    assert one(df.select(texts.phrase_count(F.col("t"), ["vie"]))) == 3
    assert one(df.select(texts.phrase_count(F.col("t"), ["vie"], whole_words=True))) == 1


def test_html_and_chunks(spark):
    html = "<html><style>p{}</style><body>A &amp;lt; <b>b</b><script>x<y</script> c</body></html>"
    assert one(spark.createDataFrame([(html,)], "h string").select(texts.html_to_text(F.col("h")))) == "A &lt; b c"
    words = " ".join(map(str, range(400)))
    out = texts.chunks(spark.createDataFrame([(1, words), (2, "too short")], "k int, t string"), "k", "t").orderBy("chunk").collect()
    assert [(r["k"], r["words"], r["body"].split()[0]) for r in out] == [(1, 256, "0"), (1, 208, "192"), (1, 16, "384")]


def test_json_index(spark):
    j = '{"filings":{"recent":{"form":["10-K","8-K","10-Q"],"filingDate":["2020-01-02","2020-01-03","1990-01-01"],"accessionNumber":["0-1-2","0-1-3","0-1-4"],"primaryDocument":["a","b","c"]}}}'
    raw = spark.createDataFrame([("7", j), ("7", j)], "cik string, json string")
    out = S.filing_index(S.filing_rows(raw, "json", ["cik"]), ["10-K", "10-Q"], "1993-01-01", "2026-01-01").collect()
    assert [(r["cik"], r["accession"]) for r in out] == [("7", "012")]
    m = spark.createDataFrame([('{"0":{"ticker":"abc","cik_str":"12"}}',)], "j string")
    assert [tuple(r) for r in S.ticker_map(m, "j").collect()] == [("ABC", "0000000012")]


def test_stage_files_round_trip(spark, tmp_path):
    cat = S.catalog(spark, [("e1", "n", (1995, 2000, None), "2000-03", "mania", 40, None, None, ["A", "B"], "m", True, False), ("e2", "n", None, None, "capex", None, 20, "x", ["A"], "m", False, True)])
    assert S.bubbles(cat).count() == 1 and S.target_episodes(cat).count() == 1 and S.near_bubbles(cat).count() == 0
    S.write_firm_lists(cat, f"{tmp_path}/firms")
    assert S.read_csv(spark, f"{tmp_path}/firms", "ticker string").count() == 3
    S.write_stage(S.membership(cat), f"{tmp_path}/members")
    assert S.read_table(spark, f"{tmp_path}/members").groupBy("episode_id").count().count() == 2


def test_ridge_from_sums_is_least_squares(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 3))
    y = x @ [1.0, -2.0, 0.5] + 3 + 0.1 * rng.normal(size=300)
    df = spark.createDataFrame([(*map(float, r), float(t), i % 5) for i, (r, t) in enumerate(zip(x, y, strict=True))], "a double, b double, c double, y double, fold int")
    alpha, r2, coef = models.ridge_path(df, "fold", ["a", "b", "c"], "y", [1e-9])
    want = np.linalg.lstsq(np.column_stack([np.ones(300), x]), y, rcond=None)[0]
    assert np.allclose(coef, want, atol=1e-6) and r2 > 0.99 and alpha == 1e-9


def test_logistic_solvers_reach_stationary_points():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 4))
    y = (x[:, 0] + rng.normal(size=120) > 0).astype(float)
    b = plain.logistic_batch(x, y[None], np.ones((1, 120)), 1.0)[0]
    p = 1 / (1 + np.exp(-(b[0] + x @ b[1:])))
    assert np.abs(x.T @ (y - p) - b[1:]).max() < 1e-5 and abs((y - p).sum()) < 1e-5
    c = plain.lasso_logistic(x, y, 0.2)
    p = 1 / (1 + np.exp(-(c[0] + x @ c[1:])))
    g = 0.2 * np.column_stack([np.ones(120), x]).T @ (y - p)
    assert all(abs(gi - np.sign(ci)) < 1e-3 if abs(ci) > 1e-6 else abs(gi) <= 1 + 1e-3 for gi, ci in zip(g, c, strict=True))


def test_cox_gradient_vanishes():
    rng = np.random.default_rng(4)
    x, t = rng.normal(size=(80, 2)), rng.integers(1, 6, 80).astype(float)
    e = rng.uniform(size=80) < 0.6
    b = plain.cox_efron(x, t, e, np.ones(80))

    def loglik(beta):
        r, total = np.exp(x @ beta), -80 * 0.1 / 2 * beta @ beta
        for u in np.unique(t[e]):
            d, risk = (t == u) & e, t >= u
            n = int(d.sum())
            total += (x[d] @ beta).sum() - sum(np.log(r[risk].sum() - j / n * r[d].sum()) for j in range(n))
        return total

    for i in range(2):
        h = np.eye(2)[i] * 1e-5
        assert abs(loglik(b + h) - loglik(b - h)) / 2e-5 < 1e-4


def test_l1_penalty_leaves_out_each_cluster_of_all_rows(spark, sf_dir):
    from tideframe.plans import model_queries as Q

    out = Q.chosen_penalties(spark, sf_dir).where("kind = 'l1'").collect()
    assert sorted(r["split"] for r in out) == list(range(Q.EQ.N))
    got = next(r for r in out if r["split"] == 7)
    rows = Q.EQ.splits(spark, sf_dir).where("split = 7 AND NOT held").toPandas()
    y, raw, cluster = rows["label"].to_numpy(float), rows[Q.FEATURES].to_numpy(float), rows["cluster"].to_numpy()
    assert len(set(cluster)) == 7
    best = (-1.0, 0.0)
    for c in np.logspace(-3, 1, 20):
        score = np.zeros(len(y))
        for k in set(cluster):
            t = cluster != k
            x = plain._scaled(raw, t)
            b = plain.lasso_logistic(x[t], y[t], c)
            score[~t] = b[0] + x[~t] @ b[1:]
        value = float(plain.rank_auc(score[None], y)[0])
        best = (value, c) if value > best[0] + 1e-12 else best
    assert got["auc"] == pytest.approx(best[0], abs=1e-6) and got["c"] == pytest.approx(best[1])


def test_text_model_sees_every_split(spark, sf_dir):
    from tideframe.plans import model_queries as Q

    out = {r["split"]: r for r in Q.text_model_with_and_without_test_units(spark, sf_dir).collect()}
    assert len(out) == Q.EQ.N
    f = Q.text_features(spark, sf_dir).withColumn("y", F.log("n_chars"))
    k = Q.split_rows(spark, sf_dir).where("held AND split = 31").select("split", "doc_id", "label")
    _, _, coef = models.ridge_path(f.join(k, "doc_id", "left_anti"), "fold", Q.TEXT[1:], "y")
    want = evaluation.auc(f.join(k, "doc_id").withColumn("own", models.linear_score(Q.TEXT[1:], coef)), ["split"], "own", "label").first()["auc"]
    assert out[31]["auc_per_fold"] == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("block", [500, 4])
def test_pair_sums_of_blocks_are_pandas_correlations(spark, block):
    import pandas as pd

    rng = np.random.default_rng(31)
    rows = []
    for g in "ab":
        for f in range(11 if g == "a" else 2):
            for i in range(150):
                if rng.uniform() < 0.8:
                    rows.append((g, f, date.fromordinal(date(2020, 1, 1).toordinal() + i), 7.0 if f == 3 else float(1e3 * (f == 5) + rng.normal())))
    df = spark.createDataFrame([*rows, ("a", 1, date(2020, 2, 2), None)], "g string, f int, d date, r double").repartition(5)
    got = {(r["g"], r["month_end"]): (r["metric_c"], r["n_firms"]) for r in V.pairwise_correlation(df, "g", "f", "d", "r", block=block).collect()}
    frame = pd.DataFrame(rows, columns=["g", "f", "d", "r"])
    frame["d"] = pd.to_datetime(frame["d"])
    want = {}
    for (g, month), _ in frame.groupby(["g", frame["d"] + pd.offsets.MonthEnd(0)]):
        own = frame[(frame["g"] == g) & (frame["d"] <= month) & (frame["d"] >= month - pd.Timedelta(days=100))].sort_values("d").groupby("f").tail(63)
        own = own[own.groupby("f")["r"].transform("size") >= 40]
        if len(own):
            wide = own.pivot(index="d", columns="f", values="r")
            with np.errstate(all="ignore"):
                c = wide.drop(columns=[x for x in wide if wide[x].std() == 0]).corr(min_periods=2).to_numpy()
            n = wide.shape[1]
            values = c[np.triu_indices(len(c), 1)]
            want[g, month.date()] = (float(np.nanmean(values)) if n >= 3 else None, n)
    assert got.keys() == want.keys() and len(want) > 6
    for k, (value, n) in want.items():
        assert got[k] == (value if value is None else pytest.approx(value, abs=1e-9), n)


def test_a_stage_is_read_by_its_partitions(spark, tmp_path):
    rows = [(f"e{i % 6}", date(2020, 1 + i % 12, 1), float(i)) for i in range(120)]
    path = f"{tmp_path}/stage"
    S.write_stage(spark.createDataFrame(rows, "episode_id string, d date, v double"), path)
    assert {p.name for p in (tmp_path / "stage").iterdir() if p.is_dir()} == {f"episode_id=e{i}" for i in range(6)}
    stage = spark.read.parquet(path)
    spark.createDataFrame([(f"e{i}", i % 2 if i < 5 else 0) for i in range(6)], "episode_id string, kind int").write.parquet(f"{tmp_path}/catalog")
    some = S.scan_keys(stage, spark.read.parquet(f"{tmp_path}/catalog").where("kind = 1"), "episode_id", "d", "2020-03-01", "2020-09-30")
    plan = some._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan parquet" in line)
    assert "dynamicpruning" in scan.split("PartitionFilters")[1].split("PushedFilters")[0] and "GreaterThanOrEqual(d" in scan
    assert sorted(r["v"] for r in some.collect()) == sorted(v for e, d, v in rows if e in ("e1", "e3") and date(2020, 3, 1) <= d <= date(2020, 9, 30))
    one = stage.where("episode_id = 'e2'")._jdf.queryExecution().executedPlan().toString()
    assert "(episode_id" in one.split("PartitionFilters")[1].split("PushedFilters")[0]


def test_the_metric_panel_is_its_single_queries(spark):
    from tideframe.plans import metric_panel as P
    from tideframe.plans import model_queries as Q
    from tideframe.plans import panel_queries as R

    path = "/root/testdata/sf0.01"
    panel_ = P.whole_metric_panel(spark, path)
    # the daily table is made once: of lineitem's scans, the bond quotes' and the leverage behind them are left
    assert "lineitem" not in P.metric_panel(spark, path)._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["sector"], r["month_end"]): r for r in panel_.collect()}
    assert {f"metric_{c}" for c in "abcdefmopqrsuvwx"} <= set(panel_.columns)
    known = {c: sum(r[c] is not None for r in got.values()) for c in panel_.columns}
    assert all(known[f"metric_{c}"] for c in "abcdefmopqrsuvwx")
    for query, columns in ((R.metric_a_by_sector_month, "a"), (R.expanding_regression_gap, "b"), (R.leverage_metrics_and_interactions, "fuvwx"), (R.sector_credit_implied_vol, "opq"), (Q.text_implied_volatility, "rs")):
        for r in query(spark, path).collect():
            for c in columns:
                mine, want = got[r["sector"], r["month_end"]][f"metric_{c}"], r[f"metric_{c}"]
                assert mine == (want if want is None else pytest.approx(want, abs=2e-5)), (query.__name__, c)


def test_months_of_lineitem_need_one_shuffle(spark, sf_dir):
    plan = roles.months(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_realized_vol_is_the_deviation_of_the_last_rows(spark):
    rng = np.random.default_rng(3)
    rets = [None if i % 11 == 0 else float(np.clip(rng.normal(0, 0.6), -2, 2)) if i < 150 else 0.3 for i in range(260)]
    df = spark.createDataFrame([(f, i, r) for f in range(2) for i, r in enumerate(rets)], "f int, i int, r double")
    got = {r["i"]: r["realized_vol"] for r in V.realized_vol(df, "f", "i", "r").where("f = 1").collect()}
    for i in range(260):
        last = [r for r in rets[max(0, i - 62) : i + 1] if r is not None]
        assert got[i] == (pytest.approx(np.std(last, ddof=1) * np.sqrt(252), abs=1e-6) if len(last) >= 15 else None)


def test_panels_read_lineitem_once_more_at_most(spark, sf_dir):
    for query in (panel_queries.sector_panel, panel_queries.panel_with_lagged_fundamentals):
        plan = query(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("l_shipdate") and plan.count("Relation [") - plan.count("Relation [s_suppkey") == 1


def test_the_whole_panel_takes_firm_months_at_hand(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(panel_queries, "firm_table", lambda *_: pytest.fail("firm-months are made once more"))
    every = splits.settled(roles.every_month(roles.daily(spark, sf_dir)))
    assert panel_queries.leveraged(spark, sf_dir, every).count() == roles.months(spark, sf_dir).count()
    assert metric_panel.whole_metric_panel(spark, sf_dir).columns


def test_the_whole_panel_has_every_metric_and_its_share_of_months(spark):
    from tideframe.plans import text_queries as TQ

    path = "/root/testdata/sf0.01"
    got = [r.asDict() for r in metric_panel.whole_metric_panel(spark, path).collect()]
    names = [f"metric_{c}" for c in "abcdefghijklmnopqrsuvwx"]
    for sector in {r["sector"] for r in got}:
        own = [r for r in got if r["sector"] == sector]
        for c in names:
            share = sum(r[c] is not None for r in own) / len(own)
            assert all(r[f"share_{c}"] == pytest.approx(share, abs=1e-6) for r in own)
    assert all(any(r[c] is not None for r in got) for c in [*names, "n_firms_civ"])
    last = {r["doc_id"]: r for r in metric_panel.last_filings(spark, path).collect()}
    scores = {r["doc_id"]: r for r in metric_panel.filing_scores(metric_panel.last_filings(spark, path), spark, path).collect()}
    assert last.keys() == scores.keys() and len({(r["l_suppkey"], r["d"].year, (r["d"].month - 1) // 3) for r in last.values()}) == len(last)
    single = [TQ.filing_category_scores, TQ.filing_readability, TQ.filing_phrase_scores]
    for query, columns in zip(single, (("net_sentiment", "uncertainty_pct", "negativity_ratio"), ("fog_index",), ("offbalance_per10k",)), strict=True):
        every = {r["doc_id"]: r for r in query(spark, path).collect()}
        for k, r in scores.items():
            assert all(r[c] == pytest.approx(every[k][c], abs=2e-5) for c in columns)


def test_the_metric_panel_reads_texts_once(spark, sf_dir):
    plan = metric_panel.metric_panel(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "text#" not in plan  # scans before the plan's checkpoints are over


def test_a_return_is_sent_to_two_spans_at_most(spark):
    import pandas as pd

    rng = np.random.default_rng(5)
    days = pd.bdate_range("2019-06-03", "2023-10-31")
    frame = pd.DataFrame([(f, d, rng.normal()) for f in range(5) for d in days if rng.uniform() < (0.95 if f < 3 else 0.6)], columns=["f", "d", "r"])
    df = spark.createDataFrame([("g", f, d.date(), float(r)) for f, d, r in frame.itertuples(index=False)], "g string, f int, d date, r double")
    out = V.pairwise_correlation(df, "g", "f", "d", "r", days=130, block=2)
    got = {r["month_end"]: (r["metric_c"], r["n_firms"]) for r in out.collect()}
    assert "_span" in out._jdf.queryExecution().optimizedPlan().toString()
    months = sorted({(d + pd.offsets.MonthEnd(0)) for d in days})
    assert got.keys() <= {m.date() for m in months} and len(got) > 48
    for month in months:
        own = frame[(frame["d"] <= month) & (frame["d"] >= month - pd.Timedelta(days=130))].groupby("f").tail(63)
        own = own[own.groupby("f")["r"].transform("size") >= 40]
        if len(own):
            c = own.pivot(index="d", columns="f", values="r").corr(min_periods=2).to_numpy()
            want = np.nanmean(c[np.triu_indices(len(c), 1)]) if len(c) >= 3 else None
            assert got[month.date()] == (want if want is None else pytest.approx(want, abs=1e-9), len(c))


@pytest.mark.parametrize("few", [0, 3, 200_000])
def test_scores_by_dictionary_are_the_single_ones_whatever_is_sent_to_the_texts(spark, few):
    rows = [(1, "Alpha beta. Gamma alpha epsilon zeta!"), (2, "beta beta of " * 5), (3, "..."), (4, "ALPHA banana. " * 40)]
    df = spark.createDataFrame(rows, "k int, t string")
    known = spark.createDataFrame([("ALPHA", "a", 3), ("ALPHA", "b", 3), ("BETA", "b", 1), ("OF", "a", 4)], "word string, category string, syllables int")
    out = texts.scores_by_dictionary(df, "k", "t", known, ["a", "b"], few)
    got = {r["k"]: r.asDict() for r in out.collect()}
    counts = {r["k"]: r.asDict() for r in texts.category_scores(df, "k", "t", known, ["a", "b"]).collect()}
    read = {r["k"]: r.asDict() for r in texts.readability(df, "k", "t", known).collect()}
    assert got.keys() == counts.keys() and read.keys() == got.keys() - {3}
    for k, r in got.items():
        assert all(r[c] == counts[k][c] for c in ("word_count", "a_count", "b_count"))
        assert all(r[c] == (pytest.approx(read[k][c]) if k in read else None) for c in ("fog_index", "smog", "total_syllables", "ari"))


def test_dictionary_scores_send_rare_words_alone(spark, sf_dir):
    from tideframe.plans import text_queries

    plan = text_queries.dictionary_scores(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning(doc_id" in line]
    assert shuffles and not any(", w#" in line or ", word#" in line for line in shuffles)
