import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pitspark.functions.distributions import incomplete_beta, normal_cdf, normal_ppf, t_two_sided_p
from pitspark.plans import calibrate as K, inference as I, metrics as M
from pitspark.sources import predictions as S
from tests.conftest import day


def test_distributions(spark):
    lib = spark.sparkContext._jvm.org.apache.commons.math3.distribution
    df = spark.createDataFrame([(0.3, 1.0), (2.1, 4.0), (-5.0, 30.0), (1.7, 1e6)], "t double, n double")
    for r in df.select("t", "n", t_two_sided_p(F.col("t"), F.col("n")).alias("p")).collect():
        want = 2 * (1 - lib.TDistribution(r.n).cumulativeProbability(abs(r.t)))
        assert abs(r.p - want) < 1e-9
    z = spark.createDataFrame([(0.01,), (0.5,), (0.9772498680518208,)], "p double")
    got = z.select(normal_ppf("p").alias("z")).withColumn("p", normal_cdf("z")).collect()
    assert abs(got[2].z - 2) < 1e-9 and abs(got[1].z) < 1e-12 and abs(got[0].p - 0.01) < 1e-12
    assert incomplete_beta(2, 3, 0) == 0 and incomplete_beta(2, 3, 1) == 1


def frame(spark, n=200, seed=0, same=False):
    rng = np.random.default_rng(seed)
    y = rng.normal(size=n)
    pdf = pd.DataFrame({"id": np.arange(n), "date": [day(i * 8) for i in range(n)], "fold": np.arange(n) * 4 // n,
                        "y_true": y, "q0.1": -1.0, "q0.5": np.round(0.4 * y + rng.normal(size=n), 1), "q0.9": 1.0})
    pdf["b"] = pdf["q0.5"] if same else np.round(rng.normal(size=n), 1)
    return pdf, spark.createDataFrame(pdf)


def ic(a, y):
    return np.corrcoef(pd.Series(a).rank(), pd.Series(y).rank())[0, 1]


def test_block_bootstrap_equals_resampling_rows(spark):
    pdf, df = frame(spark)
    got = {r.score: r for r in I.block_bootstrap(df, [], ["q0.5", "b"], "y_true", F.year("date"), 150, seed=7).collect()}
    groups = [g for _, g in pdf.groupby(pd.to_datetime(pdf.date).dt.year)]
    picks = I.drawn_units(150, len(groups), 7)
    draws = [pd.concat([groups[i] for i in p]) for p in picks]
    a, b = [np.array([ic(d[c].values, d.y_true.values) for d in draws]) for c in ("q0.5", "b")]
    for name, v, est in (("q0.5", a, ic(pdf["q0.5"], pdf.y_true)), ("difference", a - b, None)):
        lo, hi = np.percentile(v, [2.5, 97.5])
        np.testing.assert_allclose([got[name].lo, got[name].hi], [lo, hi], atol=1e-9)
        if est is not None:
            assert abs(got[name].estimate - est) < 1e-9
        share = (v <= 0).mean()
        assert abs(got[name].p_two_sided - min(1, 2 * min(share, 1 - share))) < 1e-12


def test_row_bootstrap_and_identical_models(spark):
    _, df = frame(spark, 120, same=True)
    got = {r.score: r for r in I.row_bootstrap(df, [], ["q0.5", "b"], "y_true", "id", 40).collect()}
    assert got["q0.5"].lo < got["q0.5"].estimate < got["q0.5"].hi and got["q0.5"].n_boot == 40
    assert abs(got["difference"].lo) < 1e-12 and abs(got["difference"].hi) < 1e-12


def test_row_bootstrap_in_runs_of_draws(spark, monkeypatch):
    pdf, df = frame(spark, 60)
    monkeypatch.setattr(I, "DRAWS", 16)             # two runs, the first with the plain rows as draw 0
    got = {r.score: r for r in I.row_bootstrap(df, [], ["q0.5", "b"], "y_true", "id", 24, seed=3).collect()}
    draws = [pdf.iloc[p] for p in I.drawn_units(24, 60, 3)]
    a, b = [np.array([ic(d[c].values, d.y_true.values) for d in draws]) for c in ("q0.5", "b")]
    for name, v in (("q0.5", a), ("b", b), ("difference", a - b)):
        np.testing.assert_allclose([got[name].lo, got[name].hi], np.percentile(v, [2.5, 97.5]), atol=1e-9)
    assert abs(got["q0.5"].estimate - ic(pdf["q0.5"], pdf.y_true)) < 1e-9


def newey_west(v, lags):
    n, e = len(v), v - v.mean()
    var = e @ e / n + sum(2 * (1 - l / (lags + 1)) * (e[l:] @ e[:-l]) / n for l in range(1, lags + 1))
    return np.sqrt(var / n)


def test_newey_west_across_runs(spark, monkeypatch):
    rng = np.random.default_rng(2)
    v = np.cumsum(rng.normal(size=500)) * 0.1 + rng.normal(size=500)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "i int, v double")
    monkeypatch.setattr(I, "RUN", 64)               # several runs with repeated heads
    got = I.t_test(df, [], "v", "i").first()
    lags = int(4 * (500 / 100) ** (2 / 9))
    assert abs(got.se - newey_west(v, lags)) < 1e-9
    assert got.se > I.t_test(df, [], "v", hac=False).first().se
    one = I.t_test(df.where("i = 3"), [], "v", "i").first()
    assert one.t is None and one.p is None and one.n == 1


def test_benjamini_hochberg(spark):
    ps = [0.002, 0.012, 0.03, 0.032, 0.5, None]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(ps)], "i int, p double")
    got = I.benjamini_hochberg(df, "p").orderBy("i").collect()
    # by hand: p * 5 / rank is 0.01, 0.03, 0.05, 0.04, 0.5; from the right, the smallest so far
    np.testing.assert_allclose([r.q_value for r in got[:5]], [0.01, 0.03, 0.04, 0.04, 0.5])
    assert [r.reject for r in got] == [1, 1, 1, 1, 0, 0] and got[5].q_value is None


def test_degenerate_metrics_are_null(spark):
    df = spark.createDataFrame([(i, 0, 0.5, float(i % 2) - 0.5) for i in range(60)], "id int, fold int, p_out double, y double")
    r = M.evaluate_binary(df, ["fold"], "y").first()
    assert r.rank_ic is None and r.auc is None and r.quintile_spread is None and r.brier == 0.25 and r.n == 60
    tiny = M.rank_ic(df.limit(2), [], "p_out", "y").first()
    assert tiny.rank_ic is None


def test_evaluate_against_pandas(spark):
    pdf, df = frame(spark)
    r = M.evaluate(df, [], "y_true", ["q0.1", "q0.5", "q0.9"], [0.1, 0.5, 0.9]).first()
    assert abs(r.rank_ic - ic(pdf["q0.5"], pdf.y_true)) < 1e-9
    assert abs(r.medae - (pdf["q0.5"] - pdf.y_true).abs().median()) < 1e-9
    order = pdf.sort_values(["q0.5", "id"])
    parts = np.array_split(order.y_true.to_numpy(), 5)
    assert abs(r.quintile_spread - (parts[-1].mean() - parts[0].mean())) < 1e-9
    assert abs(r.median_spread - (np.median(parts[-1]) - np.median(parts[0]))) < 1e-9


def test_compare_finds_the_better_model(spark):
    pdf, df = frame(spark, 400)
    good = df.drop("b").withColumn("rung", F.lit("good"))
    base = df.withColumn("q0.5", F.col("b")).drop("b").withColumn("rung", F.lit("base"))
    r = I.compare_rungs(good.unionByName(base), "base", n_boot=100).first()
    assert r.rank_ic_delta > 0 and r.rank_ic_delta_lo > 0 and r.loss_delta < 0 and r.n == 400


def test_calibration_fixes_the_upper_tail(spark):
    rng = np.random.default_rng(5)
    n = 400
    rows = [(f * n + i, f, day(f * n + i), float(np.exp(rng.normal()) - 1.5), -1.2, -0.4, 0.2)
            for f in range(4) for i in range(n)]
    df = spark.createDataFrame(rows, "id int, fold int, date date, y_true double, `q0.2` double, `q0.5` double, `q0.8` double")
    lv = [0.2, 0.5, 0.8]
    out, report = K.calibrate(df, lv)
    rep = {r.fold: r for r in report.collect()}
    assert rep[0].calibrated == 0 and rep[0].n_cal == 0 and rep[3].n_cal == 1200
    pdf = pd.DataFrame(rows, columns=["id", "fold", "date", "y", "lo", "mid", "hi"])
    s = np.sort((pdf.y - pdf.hi)[pdf.fold < 2].to_numpy())
    level = min(1.0, np.ceil((len(s) + 1) * 0.8) / len(s))
    assert abs(rep[2].m_hi - np.quantile(s, level, method="higher")) < 1e-12
    before = K.tail_report(df, lv, folds=[1, 2, 3]).first().frac_above_hi
    after = K.tail_report(out, lv, folds=[1, 2, 3]).first().frac_above_hi
    assert before > 0.27 and abs(after - 0.2) < 0.05
    assert out.where("`q0.2` > `q0.5` or `q0.8` < `q0.5`").count() == 0
    short = K.margins(df, lv, window=100, mode="sym")
    assert {r.n_cal for r in short.collect()} == {0, 100}


def test_quantile_columns(spark):
    _, df = frame(spark, 5)
    assert S.quantile_columns(df) == (["q0.1", "q0.5", "q0.9"], [0.1, 0.5, 0.9])
    assert S.quantile_columns(df.select(F.lit(0.1).alias("p_out"))) == (["p_out"], [0.5])
    with pytest.raises(ValueError):
        S.quantile_columns(df.select("id"))


@pytest.mark.parametrize("blocks", [10, 40])
def test_both_bootstrap_routes_give_the_same_numbers(spark, blocks):
    rng = np.random.default_rng(blocks)
    x = rng.normal(size=150)
    pdf = pd.DataFrame({"id": range(150), "y": x, "s": x + rng.normal(size=150), "unit": rng.integers(0, blocks, 150)})
    df = spark.createDataFrame(pdf)
    a = I.block_bootstrap(df, [], ["s"], "y", "unit", 30, seed=3).first()
    b = I.row_bootstrap(df, [], ["s"], "y", "unit", 30, seed=3).first()
    np.testing.assert_allclose([a.estimate, a.lo, a.hi, a.p_two_sided], [b.estimate, b.lo, b.hi, b.p_two_sided], atol=1e-9)
    assert a.n_boot == b.n_boot == 30
    if blocks == 40:
        with pytest.raises(ValueError, match="row_bootstrap"):
            I.block_bootstrap(df.withColumn("unit", F.col("id")), [], ["s"], "y", "unit", 30)


def test_calibration_effect_has_both_stages(spark):
    rng = np.random.default_rng(5)
    n = 600
    y = rng.normal(size=n) ** 3
    pdf = pd.DataFrame({"id": range(n), "fold": np.arange(n) // 200, "y_true": y, "q0.1": -0.2, "q0.5": 0.0, "q0.9": 0.2})
    pdf["date"] = [day(i) for i in range(n)]
    rows = {r.stage: r for r in K.calibration_effect(spark.createDataFrame(pdf), [0.1, 0.5, 0.9]).collect()}
    assert rows["before"].n == rows["after"].n == 400
    assert abs(rows["after"].coverage - 0.8) < abs(rows["before"].coverage - 0.8)
    with pytest.raises(ValueError):
        K.margins(spark.createDataFrame(pdf), [0.1, 0.9])


def test_additive_bootstrap_equals_numpy(spark):
    r = np.random.default_rng(2)
    n = 400
    pdf = pd.DataFrame({"rung": r.choice(["A", "B"], n), "u": r.integers(0, 9, n), "id": np.arange(n), "y_true": r.normal(size=n)})
    pdf["q0.5"] = 0.3 * pdf.y_true + r.normal(size=n) * 0.2
    pdf["q0.1"], pdf["q0.9"] = pdf["q0.5"] - 0.8, pdf["q0.5"] + 0.9
    names = ["mae", "rmse", "bias", "hit_rate", "r2_vs_zero", "pinball", "coverage", "interval_score", "pearson_ic"]
    got = I.bootstrap_metric(spark.createDataFrame(pdf), ["rung"], [*names, "rank_ic"], "y_true", "u", n_boot=40, seed=3).toPandas()
    assert len(got) == 2 * (len(names) + 1)
    cols, levels = ["q0.1", "q0.5", "q0.9"], [0.1, 0.5, 0.9]

    def metric(rows):
        d = rows.copy()
        d["rung"] = "x"
        e = M.evaluate(spark.createDataFrame(d), ["rung"], "y_true", cols, levels, "id").first()
        return {m: e[m] for m in names}

    for rung, own in pdf.groupby("rung"):
        blocks = [g for _, g in own.groupby("u")]
        picks = I.drawn_units(40, len(blocks), 3)
        err = [pd.concat([blocks[i] for i in p]) for p in picks]
        mae = [np.abs(d["q0.5"] - d.y_true).mean() for d in err]
        r2 = [1 - ((d["q0.5"] - d.y_true) ** 2).sum() / (d.y_true ** 2).sum() for d in err]
        ic = [np.corrcoef(d["q0.5"], d.y_true)[0, 1] for d in err]
        want = metric(own)
        t = got[got.rung == rung].set_index("metric")
        for m in names:
            assert abs(t.estimate[m] - want[m]) < 1e-9
        for m, v in (("mae", mae), ("r2_vs_zero", r2), ("pearson_ic", ic)):
            np.testing.assert_allclose([t.lo[m], t.hi[m]], np.percentile(v, [2.5, 97.5]), atol=1e-9)
    with pytest.raises(ValueError, match="no bootstrap of"):
        I.bootstrap_metric(spark.createDataFrame(pdf), ["rung"], ["medae"], "y_true", "u")


def test_order_metrics_of_constant_tiny_and_tied_groups(spark):
    """``evaluate`` ranks once; the single functions rank by themselves and must agree."""
    r = np.random.default_rng(5)
    rows = []
    for g, n in (("big", 130), ("tied", 120), ("constant", 60), ("small", 12), ("two", 2)):
        for i in range(n):
            s = {"big": r.normal(), "tied": float(r.integers(0, 3)), "constant": 1.0}.get(g, r.normal())
            rows.append((g, len(rows), r.normal(), s - 1, s, s + 1))
    df = spark.createDataFrame(rows, "rung string, id long, y_true double, `q0.1` double, `q0.5` double, `q0.9` double")
    cols, levels = ["q0.1", "q0.5", "q0.9"], [0.1, 0.5, 0.9]
    got = {x["rung"]: x.asDict() for x in M.evaluate(df, ["rung"], "y_true", cols, levels).collect()}
    single = [M.rank_ic(df, ["rung"], "q0.5", "y_true", p_value=True).drop("n"), M.pearson_ic(df, ["rung"], "q0.5", "y_true"),
              M.bucket_spread(df, ["rung"], "q0.5", "y_true", "id", 10, "decile_spread"),
              M.bucket_spread(df, ["rung"], "q0.5", "y_true", "id", 5, "quintile_spread"),
              M.bucket_stats(df, ["rung"], "q0.5", "y_true", "id"), M.level_metrics(df, ["rung"], "q0.5", "y_true"),
              M.interval_metrics(df, ["rung"], "y_true", cols, levels)]
    for part in single:
        for x in part.collect():
            for c in part.columns[1:]:
                a, b = got[x["rung"]][c], x[c]
                assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-12), (x["rung"], c, a, b)
    assert got["constant"]["rank_ic"] is None and got["small"]["quintile_spread"] is None and got["tied"]["decile_spread"] is not None
