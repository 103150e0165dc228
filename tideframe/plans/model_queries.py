"""Models on labelled documents, suppliers' event panel and vectors. SQL can't fit them; tests/test_models.py compares them with
plain numpy on the same rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import credit, numbers
from ..operators import evaluation as E
from ..operators import joins, panel
from ..operators import models as M
from ..operators import splits as R
from ..operators import survival as SV
from ..operators import volatility as V
from . import evaluation_queries as EQ
from . import panel_queries as PQ
from .roles import rounded, table, with_sector

QUERIES: dict = {}
SQL: dict[str, str] = {}
FEATURES = ["s1", "s2", "s3"]
#: Shuffles of the labels in permutation tests.
PERMS = 500
L2_GRID = [10.0 ** (-4 + 8 * i / 9) for i in range(10)]
C_GRID = [10 ** (-3 + 4 * i / 19) for i in range(20)]
TEXT = ["words", "word_length", "symbols", "lines", "capitals"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def text_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, fold, n_chars and TEXT of every document. Characters are counted by what is left without one or, of a
    set, by matches, which takes less time than F.translate."""
    n = F.greatest(F.col("n_chars"), F.lit(1))
    gone = lambda c: F.length("text") - F.length(F.replace("text", F.lit(c), F.lit("")))
    of = lambda chars: F.regexp_count(F.col("text"), F.lit(f"[{chars}]"))
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.length("text").alias("n_chars"), gone(" ").alias("_b"), gone("\n").alias("_n"), of("#*$%&!").alias("_s"), of("A-Z").alias("_c"))
    words = F.col("_b") + F.col("_n") + 1
    out = d.select("doc_id", "source", F.col("n_chars").cast("double").alias("n_chars"), F.log(words).alias("words"), (n / words).alias("word_length"), (F.col("_s") / n).alias("symbols"), (F.col("_n") / n).alias("lines"), (F.col("_c") / n).alias("capitals"))
    return out.withColumn("fold", M.keyed_fold(F.col("doc_id"), 5))


@query("""WITH f AS (SELECT doc_id, CAST(length(text) AS DOUBLE) AS y, length(text) - length(translate(text, '#*$%&!', '')) AS x, CAST(floor(('0x' || substr(md5('42|' || doc_id), 1, 8))::UBIGINT / 4294967296.0 * 5) AS INTEGER) AS fold FROM documents)
    SELECT fold, i, j, CAST(s AS DOUBLE) AS s, n FROM (SELECT fold, count(*) AS n, sum(1) AS s00, sum(x) AS s01, sum(y) AS s02, sum(x * x) AS s11, sum(x * y) AS s12, sum(y * y) AS s22 FROM f GROUP BY 1) t,
      LATERAL (VALUES (0, 0, s00), (0, 1, s01), (0, 2, s02), (1, 1, s11), (1, 2, s12), (2, 2, s22)) AS v(i, j, s)""")
def ridge_product_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(M.keyed_fold(F.col("doc_id"), 5).alias("fold"), F.length("text").alias("y"), (F.length("text") - F.length(F.translate("text", "#*$%&!", ""))).alias("x"))
    return M.product_sums(d, "fold", ["x"], "y")


@query()
def ridge_model_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-validated R2 of ridge models on three feature sets."""
    f = text_features(spark, sf_dir).withColumn("y", F.log("n_chars"))
    sums, rows = M.product_matrices(f, "fold", TEXT, "y"), []  # one pass over the texts for all models
    for name, cols in (("words", TEXT[:2]), ("marks", TEXT[2:]), ("all", TEXT)):
        at = [0, *[1 + TEXT.index(c) for c in cols], len(TEXT) + 1]
        alpha, r2, coef = M.ridge_from_sums({k: m[np.ix_(at, at)] for k, m in sums.items()})
        rows.append((name, len(cols), float(alpha), round(r2, 6), [round(float(c), 6) for c in coef]))
    return spark.createDataFrame(rows, "model string, n_features int, alpha double, r2 double, coefficients array<double>")


@query()
def text_implied_volatility(spark: SparkSession, sf_dir: str, lev: DataFrame | None = None) -> DataFrame:
    """Ridge on the log of a source's bond-like spread, scored on each filing, inverted with the latest leverage (then the
    sector's median, then 0.40): metric R by sector and quarter, filled to months, and its 12-row change S. Texts are read
    once; the firm-months of ``leveraged`` are from ``lev`` if they are at hand."""
    f = text_features(spark, sf_dir).withColumn("d", F.date_add(F.lit("1996-01-01").cast("date"), (F.col("doc_id") % 1000).cast("int"))).withColumn("l_suppkey", F.substring("source", 4, 9).cast("bigint"))
    f = R.settled(f.select("doc_id", "l_suppkey", "d", "fold", *TEXT))
    spread = PQ._bonds(spark, sf_dir).groupBy("l_suppkey", F.trunc("month_end", "quarter").alias("q")).agg(F.median("spread").alias("spread"))
    train = f.withColumn("q", F.trunc("d", "quarter")).groupBy("l_suppkey", "q", "fold").agg(*[F.median(c).alias(c) for c in TEXT]).join(spread, ["l_suppkey", "q"]).withColumn("y", F.log("spread"))
    _, _, coef = M.ridge_path(train, "fold", TEXT, "y")
    scored = f.withColumn("spread", numbers.clip(F.exp(M.linear_score(TEXT, coef)), 1e-5, 0.10)).withColumn("month", F.last_day("d"))
    lev = (R.settled(PQ.leveraged(spark, sf_dir)) if lev is None else lev).where("leverage IS NOT NULL")
    found = joins.as_of(scored.select("l_suppkey", "doc_id", "d", "month", "spread"), lev.select("l_suppkey", "month_end", "leverage"), ["l_suppkey"], "month", "month_end", ["leverage"])
    sector = lev.groupBy("sector").agg(F.median("leverage").alias("usual"))
    full = with_sector(found, spark, sf_dir).join(sector, "sector", "left").withColumn("lev", F.coalesce("leverage", "usual", F.lit(0.40)))
    civ = full.withColumn("metric_r", credit.implied_volatility("spread", "lev", F.lit(5.0))).withColumn("metric_r_spread", F.col("spread"))
    q = R.settled(joins.quarter_medians(civ, "l_suppkey", "sector", "d", ["metric_r", "metric_r_spread"], ["doc_id"]))
    m = joins.to_months(q, ["sector"], "stamp", ["metric_r", "metric_r_spread"], 3)
    return rounded(V.difference(m, ["sector"], "month_end", "metric_r", "metric_s"), ["metric_r", "metric_r_spread", "metric_s"])


def split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled documents in every split."""
    return EQ.splits(spark, sf_dir)


def _by_model(frames: dict[str, DataFrame], unit: str = "doc_id") -> DataFrame:
    """Median AUC and number of splits of each model."""
    out = None
    for name, f in frames.items():
        a = E.auc(f, ["split"], "score", "label").select("split", "auc").withColumn("model", F.lit(name))
        out = a if out is None else out.unionByName(a)
    return rounded(out.groupBy("model").agg(F.median("auc").alias("median_auc"), F.count("auc").alias("n_splits")), ["median_auc"])


@query()
def logistic_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = split_rows(spark, sf_dir)
    return rounded(E.auc(M.score_splits(k, ["split"], "doc_id", FEATURES, "label", "held"), ["split"], "score", "label"), ["auc"])


@query()
def horse_race(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base, extra only, both, and the bare metric on the same splits."""
    k = split_rows(spark, sf_dir)
    score = lambda cols: M.score_splits(k, ["split"], "doc_id", cols, "label", "held")
    return _by_model({"base": score(["s1"]), "extra": score(["s2"]), "both": score(["s1", "s2"]), "naive": k.where("held").withColumn("score", F.col("s1"))})


@query()
def model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logistic, L1, Laplace and the bare metric on the same splits."""
    k = split_rows(spark, sf_dir)
    return _by_model(
        {
            "logistic": M.score_splits(k, ["split"], "doc_id", FEATURES, "label", "held"),
            "l1": M.score_splits(k, ["split"], "doc_id", FEATURES, "label", "held", c=0.5, l1=True),
            "laplace": M.laplace_each(k, ["split"], "doc_id", FEATURES, "label", "held"),
            "naive": k.where("held").withColumn("score", F.col("s1")),
        }
    )


@query()
def laplace_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.laplace_each(split_rows(spark, sf_dir), ["split"], "doc_id", FEATURES, "label", "held")
    return rounded(out, ["score", "width"])


@query()
def chosen_penalties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The L2 strength by three folds in each split's training rows, and the L1 strength over clusters left out, one at a time."""
    t = split_rows(spark, sf_dir).where("NOT held")
    l2 = M.choose_c(t, ["split"], FEATURES, "label", "doc_id", L2_GRID).withColumn("kind", F.lit("l2"))
    l1 = M.choose_c(t, ["split"], FEATURES, "label", "doc_id", C_GRID, l1=True, cluster="cluster").withColumn("kind", F.lit("l1"))
    return rounded(l2.unionByName(l1), ["auc"])


@query()
def permutation_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed AUC of each split and the share of refits on shuffled labels that reach it."""
    a = M.permutation_aucs(EQ.splits(spark, sf_dir), "split", FEATURES, "label", "held", "doc_id", PERMS)
    seen = a.where("perm = 0").select("split", "auc")
    return rounded(E.null_summary(a.where("perm > 0"), seen, ["split"], "auc"), ["mean", "std", "q05", "q95", "p", "p1"])


@query()
def fixed_or_chosen_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Permutation p with C = 1 and with C chosen by three folds for each split and permutation, side by side: pooled nulls
    against the median observed AUC."""
    out = None
    for arm, grid in (("fixed", None), ("chosen", L2_GRID)):
        a = M.permutation_aucs(split_rows(spark, sf_dir), "split", FEATURES, "label", "held", "doc_id", PERMS, grid=grid)
        middle = a.where("perm = 0").agg(F.median("auc").alias("observed"), F.median("c").alias("median_c"))
        p = a.where("perm > 0").crossJoin(F.broadcast(middle)).groupBy("observed", "median_c").agg(F.avg((F.col("auc") >= F.col("observed")).cast("double")).alias("p"), F.median("auc").alias("null_median")).withColumn("arm", F.lit(arm))
        out = p if out is None else out.unionByName(p)
    return rounded(out, ["observed", "p", "null_median"])


def survival_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event panel rows (suppliers before their peak), computed once."""
    p = panel.pre_peak(PQ.event_panel(spark, sf_dir), "month_end", "peak", F.col("bubble")).where(F.col("realized_vol").isNotNull())
    return R.settled(p.withColumn("label", F.col("bubble").cast("int")).withColumn("size", F.log("market_cap")))


def survival_splits(p: DataFrame, n: int = EQ.N) -> DataFrame:
    """(split, l_suppkey, held): n splits of the panel's suppliers."""
    return R.stratified_holdouts(p.select("l_suppkey", F.col("label").cast("string").alias("stratum")).distinct(), "l_suppkey", "stratum", n, 0.3).select("split", "l_suppkey", "held")


def survival_rows(spark: SparkSession, sf_dir: str, n: int = EQ.N) -> DataFrame:
    """The panel's rows for each of n splits of the suppliers."""
    p = survival_panel(spark, sf_dir)
    return p.join(survival_splits(p, n), "l_suppkey")


def regime_of(sector: str) -> F.Column:
    return F.when(F.col(sector) % 2 == 0, "leverage").otherwise("mania")


COX = ["realized_vol", "size", "n_days"]


def split_cox(p: DataFrame, s: DataFrame) -> DataFrame:
    """A Cox model of each split's training suppliers."""
    return SV.cox_dealt(p.withColumn("_g", F.lit(0)), s.where("NOT held").withColumn("weight", F.lit(1)), "l_suppkey", "_g", "split", COX, "time_to_peak", "event_12m")


def split_cox_auc(p: DataFrame, s: DataFrame, name: str = "auc") -> DataFrame:
    """AUC of each held-out supplier's mean hazard under the models of its splits."""
    h = p.join(s.where("held"), "l_suppkey").join(F.broadcast(split_cox(p, s)), "split").withColumn("hazard", SV.hazards(COX))
    return E.group_auc(h, ["split"], "l_suppkey", "hazard", "label", name)


@query()
def cox_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC of each supplier's mean hazard among those held out."""
    p = survival_panel(spark, sf_dir)
    return rounded(split_cox_auc(p, survival_splits(p)), ["auc"])


@query()
def cox_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = survival_panel(spark, sf_dir)
    b = split_cox(p, survival_splits(p))
    betas = b.select("split", F.explode(F.arrays_zip(F.array(*[F.lit(c) for c in COX]).alias("name"), F.col("betas").alias("beta"))).alias("e")).select("split", "e.*")
    return rounded(E.coefficient_stability(betas, "name", "beta"), ["median", "low", "high", "share_positive"])


@query()
def raw_or_demeaned_cox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same splits on raw and on supplier-demeaned features: paired AUCs and their gap."""
    p = survival_panel(spark, sf_dir)
    s = R.settled(survival_splits(p))
    out = split_cox_auc(p, s, "raw").drop("n").join(split_cox_auc(V.demeaned(p, "l_suppkey", COX), s, "demeaned").drop("n"), "split")
    return rounded(out.withColumn("gap", F.col("raw") - F.col("demeaned")), ["raw", "demeaned", "gap"])


@query()
def cluster_bootstrap_cox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range of Cox coefficients over 500 resamples of suppliers with replacement, by regime (two halves of the sectors)."""
    p = with_sector(survival_panel(spark, sf_dir), spark, sf_dir).withColumn("regime", regime_of("sector")).drop("sector")
    w = R.cluster_weights(p.select("l_suppkey").distinct(), "l_suppkey", 500)
    h = SV.cox_dealt(p, w, "l_suppkey", "regime", "boot", COX, "time_to_peak", "event_12m")
    betas = h.select("regime", F.posexplode("betas").alias("i", "beta")).withColumn("name", F.concat_ws("/", "regime", F.element_at(F.array(*[F.lit(c) for c in COX]), F.col("i") + 1)))
    return rounded(E.coefficient_stability(betas, "name", "beta"), ["median", "low", "high", "share_positive"])


@query()
def random_forest_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the held-out documents of the first split: one forest, so one resample."""
    k = split_rows(spark, sf_dir).where("split = 0")
    out = M.forest_scores(k.where("NOT held"), k.where("held"), FEATURES, "label")
    return rounded(out.select("doc_id", "label", "score"), ["score"])


@query()
def survival_forest_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risks of the first split's held-out suppliers. Hazards of a month are far below one half, so trees are not pruned."""
    k = survival_rows(spark, sf_dir, 1)
    test = panel.collapse(k.where("held"), ["l_suppkey"], COX)
    return rounded(M.survival_forest_scores(k.where("NOT held"), test, COX, "time_to_peak", "event_12m", "l_suppkey", prune=False), ["risk"])


STATES = ["realized_vol", "size"]


def state_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' months with volatility, its label and split-free features, computed once."""
    m = PQ.months(spark, sf_dir).where(F.col("realized_vol").isNotNull())
    return R.settled(m.withColumn("size", F.log("market_cap")).withColumn("label", (F.col("l_suppkey") % 3 == 0).cast("int")))


@query()
def hidden_markov_danger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One three-state Gaussian HMM on suppliers' months: probability of the state with the highest volatility."""
    m = state_rows(spark, sf_dir)
    model = M.fit_hmm(m, "l_suppkey", "month_end", STATES)
    return rounded(M.danger_scores(m, model, "l_suppkey", "month_end", STATES).drop("split"), ["danger"])


@query()
def hidden_markov_auc_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An HMM for each split on the suppliers that it doesn't hold out; AUC of the mean danger of those that it does."""
    m = state_rows(spark, sf_dir)
    s = R.stratified_holdouts(m.select("l_suppkey", F.col("label").cast("string").alias("stratum")).distinct(), "l_suppkey", "stratum", EQ.N, 0.3)
    model = M.fit_hmm(m, "l_suppkey", "month_end", STATES, members=s.where("NOT held"))
    d = M.danger_scores(m, model, "l_suppkey", "month_end", STATES, members=s.where("held")).join(m.select("l_suppkey", "month_end", "label"), ["l_suppkey", "month_end"])
    return rounded(E.group_auc(d, ["split"], "l_suppkey", "danger", "label"), ["auc"])


@query()
def hidden_markov_of_each_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An HMM of each supplier's own months: its danger in the last month."""
    m = state_rows(spark, sf_dir)
    last = joins.last_rows(M.danger_of_each(m, "l_suppkey", "month_end", STATES), ["l_suppkey"], [F.desc("month_end")], 1)
    return rounded(last.select("l_suppkey", "month_end", "danger"), ["danger"])


WALK = ["realized_vol", "size", "n_days"]


@query()
def walk_forward_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At each cutoff, models of the suppliers that peaked before it, on those that peak later: L2 with C = 1, and L1 with
    features by regime and the C that leaving out one supplier at a time chooses (20 values)."""
    p = panel.pre_peak(PQ.event_panel(spark, sf_dir), "month_end", "peak", F.col("bubble")).where(F.col("realized_vol").isNotNull())
    p = with_sector(p.withColumn("size", F.log("market_cap")), spark, sf_dir).withColumn("peak_date", F.date_format("peak", "yyyy-MM"))
    one = panel.collapse(p, ["l_suppkey", "sector", "peak_date", "bubble"], WALK).withColumn("label", F.col("bubble").cast("int"))
    wide = one.select("l_suppkey", "peak_date", "label", *[c.alias(k) for k, c in numbers.with_regime(WALK, (regime_of("sector") == "mania").cast("int")).items()])
    rows = panel.walk_forward(wide, "peak_date", PQ.cutoffs(spark)).withColumn("held", ~F.col("is_train"))
    rows = rows.join(panel.enough(rows, ["cutoff"], "is_train", "label").select("cutoff"), "cutoff", "left_semi").persist()
    every = [c for c in wide.columns if c not in ("l_suppkey", "peak_date", "label")]
    chosen = M.choose_c(rows.where("NOT held"), ["cutoff"], every, "label", "l_suppkey", C_GRID, folds=None, l1=True)
    l1 = M.score_splits(rows.join(chosen.select("cutoff", "c"), "cutoff"), ["cutoff"], "l_suppkey", every, "label", "held", l1=True, c_column="c")
    l2 = M.score_splits(rows, ["cutoff"], "l_suppkey", WALK, "label", "held")
    out = E.auc(l2, ["cutoff"], "score", "label", "auc_l2").join(E.auc(l1, ["cutoff"], "score", "label", "auc_l1").drop("n"), "cutoff").join(chosen.select("cutoff", "c", "nonzero"), "cutoff")
    return rounded(out, ["auc_l1", "auc_l2", "c"])


@query()
def principal_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of variance of the first components of the vectors."""
    _, shares = M.principal_components(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding", 10)
    return spark.createDataFrame([(i + 1, round(float(s), 6)) for i, s in enumerate(shares)], "component int, share double")


def target_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months of suppliers by regime with trailing means; the held-out suppliers of one split are the targets."""
    rows = with_sector(survival_rows(spark, sf_dir, 1), spark, sf_dir).withColumn("regime", regime_of("sector"))
    rows = V.trailing_mean(rows, "l_suppkey", "month_end", COX)
    return R.settled(rows.withColumn("unit", F.concat_ws("/", F.col("l_suppkey").cast("string"), F.col("month_end").cast("string"))))


def ranked_targets(scored: DataFrame, score: str) -> DataFrame:
    """Targets' months ranked among the bubbles' months of their regime."""
    scored = R.settled(scored)
    out = E.percentile_rank(scored, scored.where("label = 1"), "regime", score)
    return rounded(out.select("regime", "unit", score, "percentile", "out_of_range"), [score, "percentile"])


@query()
def target_scores_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model a regime, fitted once on training suppliers' means; targets' months on trailing means."""
    rows = target_rows(spark, sf_dir)
    fit = panel.collapse(rows.where("NOT held"), ["regime", "l_suppkey", "label"], COX).withColumn("held", F.lit(False)).withColumn("unit", F.col("l_suppkey").cast("string"))
    both = fit.drop("l_suppkey").unionByName(rows.where("held").select("regime", "unit", "label", *COX, "held"))
    return ranked_targets(M.score_splits(both, ["regime"], "unit", COX, "label", "held"), "score")


@query()
def target_hazards_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Cox model a regime; targets' hazards month by month."""
    rows = target_rows(spark, sf_dir).withColumn("train", ~F.col("held"))
    h = SV.cox_each(rows, ["regime"], COX, "time_to_peak", "event_12m", "train", "unit", "label")
    return ranked_targets(h, "hazard")


@query()
def text_model_with_and_without_test_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text ridge on all units against one that leaves a split's test units out: AUC of both predictions, by split. Texts are
    measured once, before their measures meet the splits."""
    f = R.settled(text_features(spark, sf_dir).select("doc_id", "fold", F.log("n_chars").alias("y"), *TEXT[1:]))
    k = split_rows(spark, sf_dir).where("held").select("split", "doc_id", "label")
    sums = M.product_matrices(f, "fold", TEXT[1:], "y")
    _, _, all_ = M.ridge_from_sums(sums)
    tested = f.join(k.select("split", "doc_id").distinct(), "doc_id").withColumn("part", F.concat_ws("/", "split", "fold"))
    # a split's train sums are those of all rows less those of its test units: one pass for all splits
    left_out = M.product_matrices(tested, "part", TEXT[1:], "y")
    own = []
    for s in sorted({int(x.split("/")[0]) for x in left_out}):
        rest = {fold: m - left_out.get(f"{s}/{fold}", 0.0) for fold, m in sums.items()}
        own.append((s, [float(b) for b in M.ridge_from_sums({fold: m for fold, m in rest.items() if m[0, 0] > 0.5})[2]]))
    coef = F.broadcast(spark.createDataFrame(own, "split long, _b array<double>"))
    score = sum((F.col(c) * F.col("_b")[i + 1] for i, c in enumerate(TEXT[1:])), F.col("_b")[0])
    out = R.settled(f.join(k, "doc_id").join(coef, "split").select("split", "label", score.alias("own"), M.linear_score(TEXT[1:], all_).alias("pooled")))
    a = E.auc(out, ["split"], "own", "label", "auc_per_fold").drop("n").join(E.auc(out, ["split"], "pooled", "label", "auc_global").drop("n"), "split")
    return rounded(a, ["auc_per_fold", "auc_global"])
