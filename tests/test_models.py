import threading

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from pitspark.plans import boosting as B, diagnostics as G, folds as V, models as M, scaling as X
from tests.conftest import day


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    n = 500
    x, w = rng.normal(size=n), rng.normal(size=n)
    pdf = pd.DataFrame({"id": np.arange(n), "d": [day(i) for i in range(n)], "label_end": [day(i + 3) for i in range(n)],
                        "x": x, "w": w, "y": 0.8 * x + 0.5 * rng.normal(size=n)})
    panel = spark.createDataFrame(pdf, "id bigint, d date, label_end date, x double, w double, y double")
    fo = V.walk_forward(panel, n_folds=2).cache()
    return pdf, panel, fo, fo.join(panel, "id").cache()


def test_folds_are_purged_and_disjoint(data):
    pdf, panel, fo, rows = data
    got = rows.toPandas()
    assert got[got.role == "test"].id.is_unique
    for _, g in got.groupby("fold"):
        test, val, train = [g[g.role == r] for r in ("test", "val", "train")]
        assert max(train.d) < min(val.d) and max(val.d) < min(test.d)
        assert (min(test.d) - max(val.label_end)).days > 5 and (min(val.d) - max(train.label_end)).days > 5
    V.check_folds(fo)
    with pytest.raises(ValueError):
        V.check_folds(fo.where("role = 'test'"))


def test_final_split(data):
    _, panel, _, _ = data
    assert V.final_split(panel).where("role = 'val'").count() == 75
    assert V.final_split(panel.limit(30)).where("role = 'val'").count() == 20


def test_scaler_uses_training_rows_only(data):
    _, panel, fo, rows = data
    m = {r.fold: r for r in X.fold_moments(panel, fo, ["x"]).collect()}
    z = X.apply_scaler(rows.select("fold", "role", "id", "x"), X.fold_moments(panel, fo, ["x"]), ["x"], limit=1.0)
    raw = rows.toPandas()
    for k, r in m.items():
        t = raw[(raw.fold == k) & (raw.role == "train")].x
        assert abs(r.mu - t.mean()) < 1e-12 and abs(r.sd - t.std(ddof=0) - 1e-8) < 1e-12
    assert z.agg(F.max(F.abs("x"))).first()[0] == 1.0


def test_normal_score_round_trip_and_clamp(spark, data):
    _, _, _, rows = data
    r = rows.select("fold", "role", "id", F.round("y", 1).alias("y"))
    knots = X.score_knots(r.where("role = 'train'"), "y")
    back = X.normal_score_inverse(X.normal_score(r, knots, "y", "z"), knots, "z", "back").toPandas()
    for _, g in back.groupby("fold"):
        t = g[g.role == "train"]
        np.testing.assert_allclose(t.back, t.y, atol=1e-6)
        assert g.back.max() <= t.y.max() + 1e-9 and g.back.min() >= t.y.min() - 1e-9
        g = g.sort_values("y")
        assert (np.diff(g.z) >= -1e-9).all()
    with pytest.raises(Exception, match="training labels"):
        X.score_knots(r.limit(5), "y", by=["fold"]).collect()


def test_logistic_matches_newton_in_numpy(data):
    _, _, _, rows = data
    fit = {r.fold: r for r in M.logistic_fit(rows, "x", "y").collect()}
    raw = rows.toPandas()
    t = raw[(raw.fold == 0) & (raw.role == "train")]
    z = (t.x - t.x.mean()) / t.x.std(ddof=0)
    D, b = np.stack([np.ones(len(z)), z], 1), np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-D @ b))
        b -= np.linalg.solve((D * (p * (1 - p))[:, None]).T @ D, D.T @ (p - (t.y > 0)))
    np.testing.assert_allclose([fit[0].a, fit[0].b], b, atol=1e-8)


def spark_ml_weights(train, z, model, alpha):
    """(intercept, weights) of Spark ML, whose quadratic penalty is divided by the label's deviation."""
    n, sd = train.agg(F.count("y"), F.stddev_pop("y")).first()
    l1, l2 = {"ridge": (0.0, alpha / n), "lasso": (alpha, 0.0), "elasticnet": (alpha / 2, alpha / 2)}[model]
    l2 *= sd
    data = train.select(array_to_vector("z").alias("features"), F.col("y").alias("label"))
    fit = LinearRegression(regParam=l1 + l2, elasticNetParam=l1 / (l1 + l2), standardization=False, maxIter=500, tol=1e-12).fit(data)
    return fit.intercept, fit.coefficients.toArray()


@pytest.mark.parametrize("model", ["ridge", "lasso", "elasticnet"])
def test_penalty_path_equals_spark_ml(data, model):
    _, _, _, rows = data
    gaps = rows.withColumn("w", F.when(F.col("id") % 7 == 0, None).otherwise(F.col("w") + 0.5 * F.col("x") + 40))
    z = M.scaled(gaps, ["x", "w"]).cache()
    alphas = (0.01, 0.1, 0.3)
    got = {(r.fold, r.alpha): r for r in M.penalty_path(z, "y", ["x", "w"], model, alphas).collect()}
    assert len(got) == 6
    for (fold, alpha), r in got.items():
        train = M.of_role(z.where(F.col("fold") == fold), "train")
        b, w = spark_ml_weights(train, z, model, alpha)
        np.testing.assert_allclose([r.intercept, *r.w], [b, *w], atol=1e-6)


def test_linear_takes_the_best_penalty_of_each_fold(data):
    _, _, _, rows = data
    alphas, feats = (0.1, 30.0, 3000.0), ["x", "w"]
    fits = {(r.fold, r.alpha): r for r in M.penalty_path(M.scaled(rows, feats), "y", feats, "ridge", alphas).collect()}
    raw, best = M.scaled(rows, feats).toPandas(), {}
    for k, g in raw[raw.role == "val"].groupby("fold"):
        err = {a: np.abs(g.y - (fits[k, a].intercept + np.stack(g.z) @ np.array(fits[k, a].w))).mean() for a in alphas}
        best[k] = min(alphas, key=err.get)
    chosen = {r.fold: r.alpha for r in M.chosen_fit(M.scaled(rows, feats), "y", feats, "ridge", alphas).collect()}
    assert chosen == best
    got = M.linear(rows, "y", feats, alphas=alphas).toPandas().set_index(["fold", "id"])["q0.5"]
    for (k, i), v in got.items():
        r, z = fits[k, best[k]], raw[(raw.fold == k) & (raw.id == i)].z.iloc[0]
        assert abs(v - r.intercept - np.dot(r.w, z)) < 1e-9
    table = M.coefficients(rows, "y", feats, "lasso", alphas=(0.01,)).toPandas()
    assert list(table.feature) == ["x", "w"] and abs(table.coef[0] - 0.8) < 0.15


def test_boosting_stops_with_patience(data):
    assert M.best_round([3, 2, 4, 1, 5, 5, 5], 2) == (4, True) and M.best_round([3, 2, 4, 1], 2) == (4, False)
    assert M.best_round([3, 2, 4, 4, 1], 2) == (2, True) and M.best_round([1], 1) == (1, False)
    _, _, _, rows = data
    part = rows.where("fold = 0")
    model = M.fit_trees(M.of_role(part, "train"), M.of_role(part, "val"), "y", ["x", "w"], rounds=40, patience=3, params={"stepSize": 0.3})
    whole = M.fit_trees(M.of_role(part, "train"), M.of_role(part, "val"), "y", ["x", "w"], rounds=40, patience=40, params={"stepSize": 0.3})
    size = [m.stages[-1].getNumTrees for m in (model, whole)]
    assert 1 <= size[0] <= size[1] <= 40
    score = [M.validation_loss(M.score_with(m, M.of_role(part, "val")), "y", False) for m in (model, whole)]
    assert score[1] <= score[0] < 0.6


def test_search_takes_the_best_configuration(data):
    _, _, _, rows = data
    tune = {"stepSize": [0.001, 0.3]}
    got = M.trees(rows, "y", ["x", "w"], rounds=4, patience=4, tune=tune, n_configs=2).toPandas()
    good = M.trees(rows, "y", ["x", "w"], rounds=4, patience=4, params={"stepSize": 0.3}).toPandas()
    pd.testing.assert_frame_equal(got.sort_values("id").reset_index(drop=True), good.sort_values("id").reset_index(drop=True))


def test_jobs_side_by_side(spark):
    started = threading.Barrier(3, timeout=60)

    def job(n):
        started.wait()                          # none goes on before all run
        return spark.range(n).count()

    assert M.side_by_side([lambda n=n: job(n) for n in (3, 5, 7)], spark, 3) == [3, 5, 7]
    assert M.side_by_side([], spark) == []
    with pytest.raises(ZeroDivisionError):
        M.side_by_side([lambda: 1 // 0], spark)


def test_floor_and_forecast_order(data):
    _, _, _, rows = data
    got = M.naive_feature(rows, "x", "y").toPandas()
    assert ((got["q0.1"] <= got["q0.5"]) & (got["q0.5"] <= got["q0.9"])).all()
    const = M.naive_constant(rows, "y").toPandas()
    assert const.groupby("fold")["q0.5"].nunique().eq(1).all()


def test_permutation_importance_and_null(data):
    _, panel, fo, rows = data
    test = rows.where("role = 'test'").select("fold", "id", "y", "x", "w")
    imp = {r.feature: r.delta_ic for r in G.permutation_importance(
        test, lambda d: d.withColumn("score", F.col("x")), "y", {"x": ["x"], "w": ["w"]}, repeats=2).collect()}
    assert imp["x"] > 0.3 and abs(imp["w"]) < 1e-12

    def predict(p):
        return M.of_role(M.linear_score(fo.join(p, "id"), "x", "y"), "test")
    r = G.permutation_null(panel.select("id", "x", "y"), predict, ["y"], "y", repeats=4).first()
    assert r.actual_ic > 0.5 and r.null_max < 0.4 and r.z > 2


def test_null_panels_are_scans_of_the_shuffles(data):
    """Every repeat reads its panel, which holds what ``shuffled`` gives, without joining or numbering it again."""
    _, panel, fo, _ = data
    rows, seen = panel.select("id", "x", "y", "w"), []

    def predict(p):
        assert "Exchange" not in p._jdf.queryExecution().executedPlan().toString()
        seen.append(sorted(map(tuple, p.collect())))
        return M.of_role(M.linear_score(fo.join(p, "id"), "x", "y"), "test")
    assert G.permutation_null(rows, predict, ["y", "w"], "y", repeats=2, seed=5).first().repeats == 2
    want = [rows, *[G.shuffled(rows, ["y", "w"], [], s) for s in (5, 6)]]
    assert seen == [sorted(map(tuple, df.collect())) for df in want]


def test_shuffle_keeps_rows_together(data):
    _, panel, _, _ = data
    got = G.shuffled(panel.select("id", "x", "y", "w"), ["x", "y"], [], 1).toPandas()
    pdf = panel.toPandas()
    assert sorted(zip(got.x, got.y)) == sorted(zip(pdf.x, pdf.y)) and len(got) == 500
    assert (got.sort_values("id").x.to_numpy() != pdf.sort_values("id").x.to_numpy()).mean() > 0.9


def test_fit_final_round_trip_and_contract(spark, data, tmp_path):
    _, panel, _, _ = data
    path = str(tmp_path / "final")
    M.fit_final(panel, V.final_split(panel), "y", ["x", "w"], path, rounds=3, patience=3, seeds=(0, 1))
    a = M.score_new(panel, path, ["x", "w"]).select("id", "q10", "q50", "q90", "mult_q50").toPandas()
    assert ((a.q10 <= a.q50) & (a.q50 <= a.q90)).all() and np.allclose(a.mult_q50, np.exp(a.q50))
    with pytest.raises(ValueError, match="contract"):
        M.score_new(panel.drop("w"), path, ["x", "w"])
    for names in (["w", "x"], ["x", "w", "y"], ["x"]):
        with pytest.raises(ValueError, match="contract"):
            M.score_new(panel, path, names)
    assert M.score_new(panel.withColumn("w", F.lit(None).cast("double")), path, ["x", "w"]).where("q50 is null").count() == 0


def test_schema_guard_reports_every_block():
    got = X.schema_problems({"a": ["x", "y"], "b": ["z"]}, {"a": ["y", "x"], "b": ["z"], "c": ["q"]})
    assert len(got) == 2 and got[0].startswith("a:") and "missing ['q']" in got[1]
    X.schema_guard({"a": ["x"]}, {"a": ["x"]})


def test_random_search_configs():
    got = M.sample_configs({"a": [1, 2, 3], "b": [4, 5]}, 4, seed=1)
    assert len(got) == 4 and len({tuple(sorted(c.items())) for c in got}) == 4
    assert len(M.sample_configs({"a": [1, 2]}, 9)) == 2


def test_model_queries_take_all_folds_and_penalties(spark, monkeypatch):
    from checks import modelling as Q
    every = spark.range(5).selectExpr("cast(id as int) as fold", "id", "1.0 as p_out", "1.0 as `q0.5`")
    seen = {}

    def keep(name):
        def fit(rows, *a, alphas=M.ALPHAS, **k):
            seen[name] = (rows.count(), tuple(alphas))
            return rows
        return fit
    monkeypatch.setattr(Q, "rows", lambda s, d: every)
    for name in ("linear", "coefficients", "trees"):
        monkeypatch.setattr(Q.M, name, keep(name))
    for run in (Q.m5, Q.m6, Q.m7):
        run(spark, "")
    assert seen == {name: (5, M.ALPHAS) for name in ("linear", "coefficients", "trees")}


@pytest.mark.parametrize("name", ["M4_trees_binary", "M4_trees_quantile", "M7_random_search", "M12_fit_final_score_new",
                                  "M12_score_unlabelled", "G1_permutation_importance", "G2_tree_importance"])
def test_tree_queries_run_with_few_rounds(spark, monkeypatch, name):
    """The registered tree queries on the smallest tables, two rounds a fit instead of all."""
    import __spark_entry__ as entry
    sf, fit = "/root/testdata/sf0.001", M.fit_trees

    def quick(train, val, y, features, binary=False, params=None, seed=0, rounds=0, patience=0):
        return fit(train, val, y, features, binary, params, seed, 2, 2)

    monkeypatch.setattr(M, "fit_trees", quick)
    got = entry.queries()[name](spark, sf).toPandas()
    assert len(got) and not got.drop(columns=[c for c in got if c.endswith("_std")]).isna().any().any()
    if name == "M12_score_unlabelled":
        assert {"id", "d", "grp", "p_out_1", "p_out_3"} == set(got) and got.id.is_unique
        assert got.p_out_3.between(0, 1).all()
    if name == "G1_permutation_importance":
        assert len(got) == 10


def test_bundle_scores_rows_without_labels(spark, data, tmp_path):
    _, panel, _, _ = data
    rows = panel.withColumns({"grp": F.lit("a"), "y_1": F.col("y"), "y_3": F.when(F.col("id") < 450, -F.col("y"))})
    path = str(tmp_path / "bundle")
    M.fit_bundle(rows, V.final_split(rows), (1, 3), ["x", "w"], path, binary=True, rounds=5, patience=5)
    got = M.score_bundle(rows, path, ["x", "w"]).join(rows.select("id", "x"), "id").toPandas()
    assert sorted(got.id) == list(range(450, 500)) and {"p_out_1", "p_out_3"} <= set(got)
    assert got[got.x > 0.5].p_out_1.mean() > got[got.x < -0.5].p_out_1.mean() + 0.3
    assert got[got.x > 0.5].p_out_3.mean() < got[got.x < -0.5].p_out_3.mean() - 0.3
    assert M.score_bundle(rows, path, ["x", "w"], new_only=False).count() == 500
    M.fit_bundle(rows, V.final_split(rows), (1, 3), ["x", "w"], path, rounds=3, patience=3)
    band = M.score_bundle(rows, path, ["x", "w"]).toPandas()
    assert ((band.q10 <= band.q50) & (band.q50 <= band.q90)).all() and np.allclose(band.mult_q50, np.exp(band.q50))


@pytest.mark.parametrize("binary", [False, True])
def test_fits_are_cut_to_the_best_round_without_another_run(spark, data, monkeypatch, binary):
    """The trees of a longer run up to a round are those of a run that ends there; none is fitted again."""
    rows = data[3].where("fold = 0")
    tree, asked = M._tree, []

    def counted(kind, params, seed):
        asked.append(params["maxIter"])
        return tree(kind, params, seed)

    monkeypatch.setattr(M, "_tree", counted)
    train, val = M.of_role(rows, "train"), M.of_role(rows, "val")
    params = {"maxDepth": 4, "stepSize": 0.5}
    several = M.fit_trees(train, val, "y", ["x", "w"], binary, [params, {"maxDepth": 1}], 0, 20, 3)
    assert asked == [20, 20] and len(several) == 2
    model = M.fit_trees(train, val, "y", ["x", "w"], binary, params, 0, 20, 3)
    n = model.stages[-1].getNumTrees
    assert asked == [20, 20, 20] and n < 20
    held = M.of_role(rows, "val")
    assert np.allclose(*[M.score_with(m, held, binary).orderBy("id").toPandas().score for m in (model, several[0])])
    assert M.first_rounds(model.stages[-1], 1, binary).getNumTrees == 1

    both = PipelineModel(model.stages[:-1]).transform(M._tree_data(train, val, "y", binary)).where("not is_val").cache()
    long, short = [tree(binary, {**params, "maxIter": k}, 0).fit(both) for k in (6, 4)]
    cut = M.first_rounds(long, 4, binary)
    assert list(cut.treeWeights) == list(short.treeWeights)
    scores = [PipelineModel([*model.stages[:-1], m]) for m in (cut, short)]
    assert np.allclose(*[M.score_with(m, held, binary).orderBy("id").toPandas().score for m in scores])
    assert np.allclose(cut.featureImportances.toArray(), short.featureImportances.toArray()[:cut.featureImportances.size])


def test_importances_name_features_no_tree_splits_on(spark, data):
    rows = data[3].withColumn("idle", F.lit(0.0))
    got = M.tree_importances(rows, "y", ["x", "idle"], rounds=8, patience=2).toPandas()
    assert len(got) == 2 * rows.select("fold").distinct().count() and (got[got.feature == "idle"].gain == 0).all()


def _importance_before(test, score, y, groups, repeats):
    """The drop per feature from every block shuffled and ranked by itself."""
    pdf = test.toPandas().sort_values(["fold", "id"], kind="stable")
    spark, parts = test.sparkSession, []
    pdf["_i"] = pdf.groupby("fold").cumcount()
    turns = spark.createDataFrame(pdf[["fold", "_i"]], "fold int, _i bigint")
    for rep in range(repeats):
        h = turns.withColumn("h", F.xxhash64("_i", "fold", F.lit(rep + 1000))).toPandas().sort_values(["fold", "h"])
        h["_to"] = h.groupby("fold").cumcount()
        source = dict(zip(zip(h.fold, h._to), h._i))
        for name, cols in groups.items():
            got = pdf.copy()
            at = {k: i for i, k in enumerate(zip(pdf.fold, pdf._i))}
            take = [at[k, source[k, i]] for k, i in zip(pdf.fold, pdf._i)]
            for c in cols:
                got[c] = pdf[c].to_numpy()[take]
            parts.append(got.assign(feature=name, rep=rep))
    parts.append(pdf.assign(feature="", rep=0))
    every = score(pd.concat(parts))
    every = every[np.isfinite(every.score) & np.isfinite(every[y])]
    ic = every.groupby(["feature", "rep", "fold"]).apply(lambda g: g.score.rank().corr(g[y].rank()), include_groups=False)
    drop = ic[""].droplevel(0) - ic.drop("").groupby(["feature", "fold"]).mean()
    return drop.groupby("feature").mean().to_dict()


@pytest.mark.parametrize("holes", [False, True])
def test_importance_of_tied_and_missing_scores(spark, data, holes):
    """Scores with many ties, outcomes with ties and gaps and, on the longer way, rows without a score."""
    test = data[3].where("role = 'test'").select("fold", "id", F.when(F.col("id") % 17 > 0, F.round("y", 1)).alias("y"), "x", "w")
    groups = {"x": ["x"], "w": ["w"], "both": ["x", "w"]}
    gap = 1.5 if holes else 1e9

    def score(d):
        return d.withColumn("score", F.when(F.col("w") < gap, F.round(F.col("x") + F.col("w") / 3, 0)))

    def plain(d):
        return d.assign(score=np.where(d.w < gap, (d.x + d.w / 3).round(), np.nan))

    got = {r.feature: r.delta_ic for r in G.permutation_importance(test, score, "y", groups, repeats=3).collect()}
    assert got == pytest.approx(_importance_before(test, plain, "y", groups, 3), abs=1e-9)


def test_importance_scores_counted_rows(spark, data, monkeypatch):
    """Blocks are not written row by row to be ranked, and outcomes are ranked once, not once a block."""
    ranked = []
    offsets = M.M.value_offsets
    for module in (G, M.M):
        monkeypatch.setattr(module, "value_offsets", lambda df, *a: (ranked.append(df.count()), offsets(df, *a))[1], raising=False)
    test = data[3].where("role = 'test'").select("fold", "id", "y", "x", "w")
    G.permutation_importance(test, lambda d: d.withColumn("score", F.signum("x")), "y", {"x": ["x"], "w": ["w"]}, repeats=4).collect()
    assert max(ranked) == test.count() and sorted(ranked)[:-1] == [2 * 2 * (2 * 4 + 1)]     # two scores, two folds, nine blocks


def test_unlabelled_query_assembles_one_panel(spark, monkeypatch):
    from checks import modelling as Q
    panel = spark.range(40).selectExpr("id", "date'2020-01-01' + cast(id as int) as d", "'a' as grp", "1.0 as y_1",
                                       "case when id < 30 then 1.0 end as y_3", "case when id < 30 then date'2021-01-01' end as d_3")
    made, fitted = [], []
    monkeypatch.setattr(Q, "tables", lambda s, d: None)
    monkeypatch.setattr(Q, "assemble_panel", lambda t, **k: (made.append(k), panel)[1])
    monkeypatch.setattr(Q, "saved", lambda s, d, name, make: make(s, d))
    monkeypatch.setattr(Q.M, "fit_bundle", lambda p, split, *a, **k: fitted.append((p.count(), split.count())))
    monkeypatch.setattr(Q.M, "score_bundle", lambda every, *a: every)
    assert Q.m12n(spark, "").count() == 40
    assert fitted == [(30, 30)] and [k["inference"] for k in made] == [True]


def _ml_scores(rows, features, binary, params, rounds, patience):
    """Test scores by Spark ML, a fit by a fold."""
    out = {}
    for k in M.fold_ids(rows):
        train, val, test = (M.of_role(rows.where(F.col("fold") == k), r) for r in ("train", "val", "test"))
        data = M._tree_data(train, val, "y", binary)
        model = M._ml_models(data, M._assembled(features).fit(data), binary, [params], 0, rounds, patience)[0]
        out |= {r.id: (r.score, model.stages[-1].getNumTrees) for r in M.score_with(model, test, binary).collect()}
    return out


@pytest.mark.parametrize("binary", [False, True])
@pytest.mark.parametrize("apart", [False, True])
def test_trees_are_those_of_spark_ml(data, monkeypatch, binary, apart):
    """Inside one task and by passes over a written table, with forecasts kept once on the way."""
    rows = data[3].withColumn("w", F.when(F.col("id") % 11 > 0, F.round("w", 1))).withColumn("idle", F.lit(0.0))
    features, params = ["x", "w", "idle"], {"maxDepth": 2, "stepSize": 0.3, "maxBins": 16}
    want = _ml_scores(rows, features, binary, params, 6, 4)
    if apart:
        monkeypatch.setattr(B, "ONE_TASK", 50)
        monkeypatch.setattr(B, "KEPT", 2)
    models = M.fold_models(rows, "y", features, binary, params, 0, 6, 4)
    got = {r.id: r for r in M.score_folds(models, M.of_role(rows, "test"), binary).collect()}
    assert sorted(got) == sorted(want)
    for i, r in got.items():
        assert abs(r.score - want[i][0]) < 1e-9 and models[r.fold].stages[-1].getNumTrees == want[i][1]


def test_folds_and_configurations_share_their_passes(data, monkeypatch):
    """No fit of Spark ML, one job a level for all folds and configurations together, and no round fitted again."""
    for kind in (M.GBTClassifier, M.GBTRegressor):
        monkeypatch.setattr(kind, "fit", lambda *a, **k: pytest.fail("fitted one by one"))
    monkeypatch.setattr(B, "ONE_TASK", 50)
    passes, sums = [], B.Written.sums
    monkeypatch.setattr(B.Written, "sums", lambda self, asks: (passes.append(len(asks)), sums(self, asks))[1])
    tune = {"maxDepth": [1, 2], "stepSize": [0.1, 0.3]}
    got = M.trees(data[3], "y", ["x", "w"], binary=True, tune=tune, n_configs=4, rounds=3, patience=3).toPandas()
    assert len(got) == data[3].where("role = 'test'").count() and got.p_out.between(0, 1).all()
    assert len(passes) <= 3 * 2 + 1 and passes[0] == 2 * 4


def test_cuts_of_spark_ml():
    """All cuts between few values, with the zeros that are left out; near-equal shares of many."""
    assert B.cuts_of(np.array([3.0, 0, -1, 3]), np.ones(4), 4, 31).tolist() == [-0.5, 1.5]
    assert B.cuts_of(np.zeros(5), np.ones(5), 5, 31).tolist() == [] and B.cuts_of(np.ones(5), np.ones(5), 5, 31).tolist() == []
    assert B.cuts_of(np.arange(1.0, 9), np.ones(8), 8, 3).tolist() == [2.5, 4.5, 6.5]
    assert sorted(i for p in B.packed((32, 32, 5, 32)) for i in p) == [0, 1, 2, 3] and B.packed(()) == ((),)


def test_refused_rows_are_left_to_spark_ml(data):
    rows = data[3].where("fold = 0")
    train, val = M.of_role(rows, "train"), M.of_role(rows, "val")
    with pytest.raises(ValueError, match="validation"):
        M.fit_trees(train, val.limit(0), "y", ["x", "w"], rounds=2, patience=2)
    some = M.fit_trees(train, val, "y", ["x", "w"], rounds=2, patience=2, params={"subsamplingRate": 0.5})
    assert some.stages[-1].getOrDefault("subsamplingRate") == 0.5
    with pytest.raises(Exception, match="(?i)label"):
        M.fit_trees(train.withColumn("y", F.lit(None).cast("double")), val, "y", ["x", "w"], rounds=2, patience=2)
