"""Queries for predictions, metrics, inference, calibration and diagnostics."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from checks import bindings as B
from checks.registry import query
from pitspark.functions.ordering import average_rank, bucket_at, bucketize, row_index, with_constants
from pitspark.plans import calibrate as K, diagnostics as G, inference as I, metrics as M
from pitspark.session import durable
from pitspark.sources import predictions as S

QS, LV = ["q0.1", "q0.5", "q0.9"], [0.1, 0.5, 0.9]


_SAVED: dict[tuple, DataFrame] = {}


def predictions(spark, sf) -> DataFrame:
    """Saved forecasts of two rungs; like any model's they are computed once and then only read."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _SAVED:
        _SAVED[key] = durable(make_predictions(spark, sf))
    return _SAVED[key]


def make_predictions(spark, sf) -> DataFrame:
    """Two rungs of quantile forecasts and probabilities over priced events with two closes."""
    from pitspark.operators.labels import nth_close

    base = durable(B.events(spark, sf).join(nth_close(B.prices(spark, sf), [1, 2]), "id").where("c_2 is not null"))
    pos = with_constants(row_index(base, [], "d", "id", "_i"), base.agg(F.count(F.lit(1)).alias("_n")))
    rows = pos.select("id", F.col("d").alias("date"), "grp",
                      (bucket_at(F.col("_i"), F.col("_n"), 5) - 1).alias("fold"),
                      (F.log("c_1") - F.log("offer")).alias("y_true"),
                      F.round(0.5 * (F.log("c_2") - F.log("offer")), 3).alias("_a"),
                      (F.log(F.col("size") / 250000) / 10).alias("_b"), "size", "flag_a", "flag_b")
    half = 0.1 + F.col("size") / 1e6
    c = F.col("_c")
    rungs = F.array(*[F.struct(F.lit(r).alias("rung"), F.col(m).alias("_c")) for r, m in (("A", "_a"), ("B", "_b"))])
    return rows.select("*", F.inline(rungs)).withColumns({
        "q0.1": c - half, "q0.5": c + 0.0, "q0.9": c + half, "p_out": 1 / (1 + F.exp(-2 * c))}).drop("_a", "_b", "_c")


B.register("pred", ["ev", "nth"], """
pr0 AS (SELECT ev.id, ev.d AS date, ev.grp, ntile(5) OVER (ORDER BY ev.d, ev.id)-1 AS fold,
   ln(c_1)-ln(offer) AS y_true, round(0.5*(ln(c_2)-ln(offer)),3) AS a, ln(size/250000)/10 AS b, size, flag_a, flag_b
   FROM ev JOIN nth USING (id) WHERE c_2 IS NOT NULL),
pr1 AS (SELECT 'A' AS rung, a AS m, * FROM pr0 UNION ALL SELECT 'B', b, * FROM pr0),
pred AS (SELECT rung, id, date, grp, CAST(fold AS INT) AS fold, y_true, m-(0.1+size/1e6) AS lo, m+0.0 AS md, m+(0.1+size/1e6) AS hi,
   1/(1+exp(-2*m)) AS p, size, flag_a, flag_b FROM pr1)""")


def quant(spark, sf) -> DataFrame:
    return predictions(spark, sf).drop("p_out")


def prob(spark, sf) -> DataFrame:
    return predictions(spark, sf).drop(*QS)


RF = ["rung", "fold"]


@query("S7_predictions_frame", needs="pred", rounds="y_true q50", sql="""
SELECT rung, id, date, grp, fold, y_true, md AS q50 FROM pred""")
def s7(spark, sf):
    p = quant(spark, sf)
    tidy = [S.predictions_frame([p.where((F.col("rung") == r) & (F.col("fold") == k)) for k in range(5)])
            .withColumn("rung", F.lit(r)) for r in ("A", "B")]
    return tidy[0].unionByName(tidy[1]).select("rung", "id", "date", "grp", "fold", "y_true",
                                               F.col("`q0.5`").alias("q50"))


@query("S8_quantile_columns", needs="pred", rounds="level", sql="""
SELECT name, level, count(pred.id) AS n FROM (VALUES ('q0.1',0.1::DOUBLE),('q0.5',0.5),('q0.9',0.9)) t(name, level)
LEFT JOIN pred ON true GROUP BY 1,2""")
def s8(spark, sf):
    p = predictions(spark, sf)
    cols, levels = S.quantile_columns(p)
    got = p.agg(*[F.count(S.quoted(c)).alias(f"n{i}") for i, c in enumerate(cols)])
    return got.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("name"), F.lit(v).alias("level"), F.col(f"n{i}").alias("n"))
        for i, (c, v) in enumerate(zip(cols, levels))])).alias("s")).select("s.*")


@query("W17_average_rank", needs="pred", sql="""
SELECT rung, id, rank() OVER (PARTITION BY rung ORDER BY md) + (count(*) OVER (PARTITION BY rung, md)-1)/2 AS r FROM pred""")
def w17(spark, sf):
    p = quant(spark, sf).select("rung", "id", F.col("`q0.5`").alias("s"))
    return average_rank(p, ["rung"], "s", "r").select("rung", "id", "r")


@query("W18_bucket", needs="pred", sql="""
SELECT rung, id, CAST(ntile(7) OVER (PARTITION BY rung ORDER BY md, id) AS INT) AS b FROM pred""")
def w18(spark, sf):
    p = quant(spark, sf).select("rung", "id", F.col("`q0.5`").alias("s"))
    return bucketize(p, ["rung"], "s", "id", 7, "b").select("rung", "id", "b")


# ---- metrics ----

_RANKED = """rk AS (SELECT *, rank() OVER (PARTITION BY rung,fold ORDER BY md)+(count(*) OVER (PARTITION BY rung,fold,md)-1)/2 AS rs,
  rank() OVER (PARTITION BY rung,fold ORDER BY y_true)+(count(*) OVER (PARTITION BY rung,fold,y_true)-1)/2 AS ry FROM pred)"""


@query("E1_rank_ic", needs="pred", rounds="rank_ic",
       sql=f"WITH {_RANKED} SELECT rung, fold, count(*) AS n, corr(rs, ry) AS rank_ic FROM rk GROUP BY 1,2")
def e1(spark, sf):
    return M.rank_ic(quant(spark, sf), RF, "q0.5", "y_true")


def _t_p(t, df):
    """Two-sided p of Student's t in SQL, by Simpson's rule on 2,000 steps of the density from 0 to |t|."""
    density = f"pow(1 + pow({t} * i / 2000.0, 2) / ({df}), -(({df}) + 1) / 2.0)"
    weight = "CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return (f"CASE WHEN {t} IS NOT NULL THEN 1 - 2 * exp(lgamma((({df}) + 1) / 2.0) - lgamma(({df}) / 2.0)) / sqrt(pi() * ({df})) * abs({t})"
            f" / 6000.0 * list_sum(list_transform(range(2001), lambda i: {weight} * {density})) END")


@query("E1_rank_ic_p", needs="pred", rounds="rank_ic rank_ic_p", sql=f"""
WITH {_RANKED}, c AS (SELECT rung, fold, count(*) AS n, corr(rs, ry) AS rank_ic FROM rk GROUP BY 1,2),
t AS (SELECT *, rank_ic * sqrt((n - 2) / greatest(1 - rank_ic * rank_ic, 1e-300)) AS t FROM c)
SELECT rung, fold, n, rank_ic, {_t_p("t", "n - 2")} AS rank_ic_p FROM t""")
def e1p(spark, sf):
    return M.rank_ic(quant(spark, sf), RF, "q0.5", "y_true", p_value=True)


@query("E2_pearson_ic", needs="pred", rounds="pearson_ic",
       sql="SELECT rung, fold, corr(md, y_true) AS pearson_ic FROM pred GROUP BY 1,2")
def e2(spark, sf):
    return M.pearson_ic(quant(spark, sf), RF, "q0.5", "y_true")


def _tile(k, by="rung, fold", score="md"):
    return f"""t{k} AS (SELECT *, ntile({k}) OVER (PARTITION BY {by} ORDER BY {score}, id) AS b FROM pred)"""


@query("E3_bucket_spread", needs="pred", rounds="decile quintile", sql=f"""
WITH {_tile(10)}, {_tile(5)}, x AS (SELECT rung, fold, avg(y_true) FILTER (b=10)-avg(y_true) FILTER (b=1) AS decile FROM t10 GROUP BY 1,2),
z AS (SELECT rung, fold, avg(y_true) FILTER (b=5)-avg(y_true) FILTER (b=1) AS quintile FROM t5 GROUP BY 1,2)
SELECT * FROM x JOIN z USING (rung, fold)""")
def e3(spark, sf):
    p = quant(spark, sf)
    return M.bucket_spread(p, RF, "q0.5", "y_true", "id", 10, "decile").join(
        M.bucket_spread(p, RF, "q0.5", "y_true", "id", 5, "quintile"), RF)


@query("E4_bucket_stats", needs="pred", sql=f"""
WITH {_tile(5)} SELECT rung, fold, avg(y_true) FILTER (b=5) AS top_bucket_mean, avg(y_true) FILTER (b=1) AS bottom_bucket_mean,
 median(y_true) FILTER (b=5) AS top_bucket_median, median(y_true) FILTER (b=1) AS bottom_bucket_median,
 median(y_true) FILTER (b=5)-median(y_true) FILTER (b=1) AS median_spread FROM t5 GROUP BY 1,2""",
       rounds="top_bucket_mean bottom_bucket_mean top_bucket_median bottom_bucket_median median_spread")
def e4(spark, sf):
    return M.bucket_stats(quant(spark, sf), RF, "q0.5", "y_true", "id")


@query("E5_hit_rate", needs="pred", rounds="hit_rate", sql="""
SELECT rung, fold, avg(CAST(sign(md)=sign(y_true) AS INT)) FILTER (y_true<>0) AS hit_rate FROM pred GROUP BY 1,2""")
def e5(spark, sf):
    return M.level_metrics(quant(spark, sf), RF, "q0.5", "y_true", median=False).select(*RF, "hit_rate")


@query("E6_errors", needs="pred", rounds="mae medae rmse bias r2_vs_zero", sql="""
SELECT rung, fold, avg(abs(md-y_true)) AS mae, median(abs(md-y_true)) AS medae, sqrt(avg((md-y_true)**2)) AS rmse,
 avg(md-y_true) AS bias, 1-sum((md-y_true)**2)/sum(y_true**2) AS r2_vs_zero FROM pred GROUP BY 1,2""")
def e6(spark, sf):
    return M.level_metrics(quant(spark, sf), RF, "q0.5", "y_true").drop("hit_rate")


_PIN = """(greatest(0.1::DOUBLE*(y_true-lo),-0.9::DOUBLE*(y_true-lo))+greatest(0.5::DOUBLE*(y_true-md),-0.5::DOUBLE*(y_true-md))
 +greatest(0.9::DOUBLE*(y_true-hi),(0.9::DOUBLE-1)*(y_true-hi)))/3"""


@query("E7_pinball", needs="pred", rounds="pinball",
       sql=f"SELECT rung, fold, avg({_PIN}) AS pinball FROM pred GROUP BY 1,2")
def e7(spark, sf):
    return M.interval_metrics(quant(spark, sf), RF, "y_true", QS, LV).select(*RF, "pinball")


_IV = "coverage nominal_coverage coverage_error frac_below_lo frac_above_hi mean_interval_width interval_score"


@query("E8_interval", needs="pred", rounds=_IV, sql="""
SELECT rung, fold, avg(CAST(y_true>=lo AND y_true<=hi AS INT)) AS coverage, 0.8::DOUBLE AS nominal_coverage,
 avg(CAST(y_true>=lo AND y_true<=hi AS INT))-0.8::DOUBLE AS coverage_error, avg(CAST(y_true<lo AS INT)) AS frac_below_lo,
 avg(CAST(y_true>hi AS INT)) AS frac_above_hi, avg(hi-lo) AS mean_interval_width,
 avg(hi-lo+10.0::DOUBLE*CASE WHEN y_true<lo THEN lo-y_true WHEN y_true>hi THEN y_true-hi ELSE 0 END) AS interval_score
FROM pred GROUP BY 1,2""")
def e8(spark, sf):
    return M.interval_metrics(quant(spark, sf), RF, "y_true", QS, LV).drop("pinball")


@query("E9_counts", needs="pred", rounds="base_rate mean_p", sql="""
SELECT rung, fold, count(*) FILTER (flag_a=0) AS n, count(*) FILTER (flag_a=1) AS n_dropped,
 avg(CAST(y_true>0 AS INT)) FILTER (flag_a=0) AS base_rate, avg(p) FILTER (flag_a=0) AS mean_p FROM pred GROUP BY 1,2""")
def e9(spark, sf):
    p = prob(spark, sf).withColumn("y_true", F.when(F.col("flag_a") == 0, F.col("y_true")).otherwise(
        F.lit(float("nan"))))
    return M.counts(p, RF, "y_true", ["p_out"]).join(
        M.probability_metrics(p, RF, "p_out", "y_true").select(*RF, "base_rate", "mean_p"), RF)


@query("E10_auc", needs="pred", rounds="auc", sql="""
WITH r AS (SELECT *, rank() OVER (PARTITION BY rung,fold ORDER BY md)+(count(*) OVER (PARTITION BY rung,fold,md)-1)/2 AS r FROM pred)
SELECT rung, fold, (sum(r) FILTER (y_true>0)-count(*) FILTER (y_true>0)*(count(*) FILTER (y_true>0)+1)/2)
 /(count(*) FILTER (y_true>0)*count(*) FILTER (y_true<=0)) AS auc FROM r GROUP BY 1,2""")
def e10(spark, sf):
    return M.auc(prob(spark, sf), RF, "p_out", "y_true")


@query("E11_probability", needs="pred", rounds="base_rate brier logloss accuracy mean_p brier_skill", sql="""
WITH m AS (SELECT rung, fold, avg(CAST(y_true>0 AS INT)) AS base_rate, avg((p-CAST(y_true>0 AS INT))**2) AS brier,
 -avg(CASE WHEN y_true>0 THEN ln(p) ELSE ln(1-p) END) AS logloss, avg(CAST((p>0.5)=(y_true>0) AS INT)) AS accuracy,
 avg(p) AS mean_p FROM pred GROUP BY 1,2) SELECT *, 1-brier/(base_rate*(1-base_rate)) AS brier_skill FROM m""")
def e11(spark, sf):
    return M.probability_metrics(prob(spark, sf), RF, "p_out", "y_true")


@query("E12_adaptive_spread", needs="pred", rounds="spread", sql="""
WITH q AS (SELECT *, year(date)*100+month(date) AS ym, count(*) OVER (PARTITION BY rung, year(date)*100+month(date)) AS n FROM pred),
t AS (SELECT *, CASE WHEN n>=100 THEN 10 ELSE 5 END AS k, ntile(10) OVER w AS b10, ntile(5) OVER w AS b5 FROM q
 WINDOW w AS (PARTITION BY rung, ym ORDER BY md, id))
SELECT rung, CAST(ym AS INT) AS ym, CASE WHEN max(n)>=100 THEN avg(y_true) FILTER (b10=10)-avg(y_true) FILTER (b10=1)
 WHEN max(n)>=25 THEN avg(y_true) FILTER (b5=5)-avg(y_true) FILTER (b5=1) END AS spread FROM t GROUP BY 1,2""")
def e12(spark, sf):
    p = quant(spark, sf).withColumn("ym", F.year("date") * 100 + F.month("date"))
    return M.adaptive_spread(p, ["rung", "ym"], "q0.5", "y_true", "id")


_PER = """pe AS (SELECT *, CAST(last_day(date_trunc('quarter', date) + INTERVAL 2 MONTH) AS DATE) AS period FROM pred),
pk AS (SELECT *, rank() OVER (PARTITION BY rung,period ORDER BY md)+(count(*) OVER (PARTITION BY rung,period,md)-1)/2 AS rs,
 rank() OVER (PARTITION BY rung,period ORDER BY y_true)+(count(*) OVER (PARTITION BY rung,period,y_true)-1)/2 AS ry FROM pe),
ic AS (SELECT rung, period, count(*) AS n, corr(rs,ry) AS rank_ic FROM pk GROUP BY 1,2 HAVING count(*)>=8)"""


@query("E13_ic_by_period", needs="pred", rounds="rank_ic", sql=f"WITH {_PER} SELECT rung, period, n, rank_ic FROM ic")
def e13(spark, sf):
    return M.ic_by_period(quant(spark, sf), ["rung"], "q0.5", "y_true")


@query("E14_fold_mean_ic", needs="pred", rounds="ic_fold_mean", sql=f"""
WITH {_RANKED}, f AS (SELECT rung, fold, corr(rs,ry) AS ic FROM rk GROUP BY 1,2)
SELECT rung, avg(ic) AS ic_fold_mean FROM f GROUP BY 1""")
def e14(spark, sf):
    return M.fold_mean_ic(quant(spark, sf), ["rung"], "q0.5", "y_true")


_ORD = f"""{_RANKED}, {_tile(10)}, {_tile(5)},
od AS (SELECT rung, fold, count(*) AS n, 0 AS n_dropped, corr(rs, ry) AS rank_ic, corr(md, y_true) AS pearson_ic FROM rk GROUP BY 1,2),
o10 AS (SELECT rung, fold, avg(y_true) FILTER (b=10)-avg(y_true) FILTER (b=1) AS decile_spread FROM t10 GROUP BY 1,2),
o5 AS (SELECT rung, fold, avg(y_true) FILTER (b=5) AS top_bucket_mean, avg(y_true) FILTER (b=1) AS bottom_bucket_mean,
 median(y_true) FILTER (b=5) AS top_bucket_median, median(y_true) FILTER (b=1) AS bottom_bucket_median,
 avg(y_true) FILTER (b=5)-avg(y_true) FILTER (b=1) AS quintile_spread,
 median(y_true) FILTER (b=5)-median(y_true) FILTER (b=1) AS median_spread FROM t5 GROUP BY 1,2),
oo AS (SELECT *, rank_ic * sqrt((n - 2) / greatest(1 - rank_ic * rank_ic, 1e-300)) AS t FROM od JOIN o10 USING (rung, fold) JOIN o5 USING (rung, fold)),
ot AS (SELECT * EXCLUDE (t), {_t_p("t", "n - 2")} AS rank_ic_p FROM oo)"""
_ORDN = ("rank_ic rank_ic_p pearson_ic decile_spread quintile_spread top_bucket_mean bottom_bucket_mean top_bucket_median "
         "bottom_bucket_median median_spread ")


@query("E0_evaluate", needs="pred", rounds=_ORDN + "hit_rate mae medae rmse bias r2_vs_zero pinball " + _IV, sql=f"""
WITH {_ORD}, lv AS (SELECT rung, fold, avg(CAST(sign(md)=sign(y_true) AS INT)) FILTER (y_true<>0) AS hit_rate, avg(abs(md-y_true)) AS mae,
 median(abs(md-y_true)) AS medae, sqrt(avg((md-y_true)**2)) AS rmse, avg(md-y_true) AS bias, 1-sum((md-y_true)**2)/sum(y_true**2) AS r2_vs_zero,
 avg({_PIN}) AS pinball, avg(CAST(y_true>=lo AND y_true<=hi AS INT)) AS coverage, 0.8::DOUBLE AS nominal_coverage,
 avg(CAST(y_true>=lo AND y_true<=hi AS INT))-0.8::DOUBLE AS coverage_error, avg(CAST(y_true<lo AS INT)) AS frac_below_lo,
 avg(CAST(y_true>hi AS INT)) AS frac_above_hi, avg(hi-lo) AS mean_interval_width,
 avg(hi-lo+10.0::DOUBLE*CASE WHEN y_true<lo THEN lo-y_true WHEN y_true>hi THEN y_true-hi ELSE 0 END) AS interval_score FROM pred GROUP BY 1,2)
SELECT * FROM ot JOIN lv USING (rung, fold)""")
def evaluate(spark, sf):
    return M.evaluate(quant(spark, sf), RF, "y_true", QS, LV)


@query("E0_evaluate_binary", needs="pred", rounds=_ORDN + "auc hit_rate base_rate brier logloss accuracy mean_p brier_skill",
       sql="WITH " + _ORD.replace("corr(md, y_true)", "corr(p, y_true)") + """,
au AS (SELECT rung, fold, (sum(rs) FILTER (y_true>0)-count(*) FILTER (y_true>0)*(count(*) FILTER (y_true>0)+1)/2)
 /(count(*) FILTER (y_true>0)*count(*) FILTER (y_true<=0)) AS auc FROM rk GROUP BY 1,2),
pm AS (SELECT rung, fold, avg(CAST(y_true>0 AS INT)) AS base_rate, avg((p-CAST(y_true>0 AS INT))**2) AS brier,
 -avg(CASE WHEN y_true>0 THEN ln(p) ELSE ln(1-p) END) AS logloss, avg(CAST((p>0.5)=(y_true>0) AS INT)) AS accuracy, avg(p) AS mean_p FROM pred GROUP BY 1,2)
SELECT *, 1-brier/(base_rate*(1-base_rate)) AS brier_skill, accuracy AS hit_rate FROM ot JOIN au USING (rung, fold) JOIN pm USING (rung, fold)""")
def evaluate_binary(spark, sf):
    return M.evaluate_binary(prob(spark, sf), RF, "y_true")


def _simple(spark, sf):
    got = M._merge([M.level_metrics(quant(spark, sf), RF, "q0.5", "y_true", median=False).select(*RF, "mae", "bias"),
                    M.interval_metrics(quant(spark, sf), RF, "y_true", QS, LV).select(*RF, "pinball")], RF)
    return M.long_metrics(got, RF)


_SIMPLE = f"""fm AS (SELECT rung, fold, unnest(['mae','bias','pinball']) AS metric,
 unnest([avg(abs(md-y_true)), avg(md-y_true), avg({_PIN})]) AS value FROM pred GROUP BY 1,2)"""


@query("A10_aggregate_folds", needs="pred", rounds="mean std", sql=f"""
WITH {_SIMPLE} SELECT rung, metric, avg(value) AS mean, stddev_pop(value) AS std FROM fm GROUP BY 1,2""")
def a10(spark, sf):
    return M.aggregate_folds(_simple(spark, sf))


@query("A11_summarize_folds", needs="pred", rounds="mean std t_stat", digits=5, sql=f"""
WITH {_SIMPLE} SELECT rung, metric, avg(value) AS mean, stddev_pop(value) AS std, count(*) AS n_folds,
 avg(value)/(stddev_samp(value)/sqrt(count(*))) AS t_stat FROM fm GROUP BY 1,2""")
def a11(spark, sf):
    return M.summarize_folds(_simple(spark, sf), metrics=("mae", "bias", "pinball")).drop("p_value")


@query("A12_tail_report", needs="pred", rounds="frac_below_lo frac_above_hi coverage nominal_lo nominal_hi nominal_coverage mean_width",
       sql="""SELECT rung, count(*) AS n, avg(CAST(y_true<lo AS INT)) AS frac_below_lo, avg(CAST(y_true>hi AS INT)) AS frac_above_hi,
 avg(CAST(y_true>=lo AND y_true<=hi AS INT)) AS coverage, 0.1::DOUBLE AS nominal_lo, 0.1::DOUBLE AS nominal_hi,
 0.8::DOUBLE AS nominal_coverage, avg(hi-lo) AS mean_width FROM pred WHERE fold IN (1,2,3) GROUP BY 1""")
def a12(spark, sf):
    return K.tail_report(quant(spark, sf), LV, ["rung"], [1, 2, 3])


@query("S14_write_summary", needs="pred", rounds="mean std pooled", sql=f"""
WITH {_SIMPLE}, po AS (SELECT rung, unnest(['mae','bias','pinball']) AS metric,
 unnest([avg(abs(md-y_true)), avg(md-y_true), avg({_PIN})]) AS pooled FROM pred GROUP BY 1)
SELECT rung, metric, avg(value) AS mean, stddev_pop(value) AS std, max(pooled) AS pooled FROM fm JOIN po USING (rung, metric) GROUP BY 1,2""")
def s14(spark, sf):
    p = quant(spark, sf)
    pooled = M._merge([M.level_metrics(p, ["rung"], "q0.5", "y_true", median=False).select("rung", "mae", "bias"),
                       M.interval_metrics(p, ["rung"], "y_true", QS, LV).select("rung", "pinball")], ["rung"])
    return S.write_summary(_simple(spark, sf), M.long_metrics(pooled, ["rung"]))


# ---- inference ----

_DM = f"""dl AS (SELECT id, date, max({_PIN}) FILTER (rung='B') - max({_PIN}) FILTER (rung='A') AS delta FROM pred GROUP BY 1,2)"""
_NW = """sr AS (SELECT delta-avg(delta) OVER () AS e, row_number() OVER (ORDER BY date, id) AS i FROM dl),
nn AS (SELECT count(*) AS n, avg(delta) AS mean FROM dl), ll AS (SELECT least(floor(4*(n/100.0::DOUBLE)**(2.0::DOUBLE/9.0)), n-1) AS lg FROM nn),
ac AS (SELECT l.l, sum(a.e*b.e) AS s FROM (SELECT unnest(range(0, (SELECT CAST(lg AS INT)+1 FROM ll))) AS l) l
 JOIN sr a ON true JOIN sr b ON b.i=a.i-l.l GROUP BY 1),
nw AS (SELECT sqrt(sum(CASE WHEN l=0 THEN s ELSE 2*(1-l/(lg+1))*s END)/max(n)/max(n)) AS se, max(n) AS n, max(mean) AS mean,
 max(lg) AS lags FROM ac, nn, ll)"""


def _delta(spark, sf):
    pairs = I.aligned(quant(spark, sf), "A")
    return I.loss_difference(pairs, "y_true", QS, LV)


@query("J11_paired_alignment", needs="pred", rounds="a b", sql="""
SELECT y.rung, y.id, y.md AS a, x.md AS b FROM pred y JOIN pred x ON x.id=y.id AND x.rung='A' WHERE y.rung<>'A'""")
def j11(spark, sf):
    return I.aligned(quant(spark, sf), "A").select("rung", "id", S.quoted("q0.5").alias("a"),
                                                   S.quoted("base_q0.5").alias("b"))


@query("I1_newey_west", needs="pred", rounds="se", digits=8, sql=f"""
WITH {_DM}, {_NW} SELECT 'B' AS rung, CAST(n AS BIGINT) AS n, CAST(lags AS INT) AS lags, se FROM nw""")
def i1(spark, sf):
    return I.newey_west(_delta(spark, sf), ["rung"], "delta", "date", "id")


@query("I2_t_test_hac", needs="pred", rounds="mean t", digits=5, sql=f"""
WITH {_DM}, {_NW} SELECT 'B' AS rung, mean, mean/se AS t, CAST(n AS BIGINT) AS n FROM nw""")
def i2(spark, sf):
    return I.t_test(_delta(spark, sf), ["rung"], "delta", "date", "id").select("rung", "mean", "t", "n")


@query("I2_t_test_plain", needs="pred", rounds="mean se t", digits=5, sql=f"""
WITH {_PER} SELECT rung, avg(rank_ic) AS mean, stddev_samp(rank_ic)/sqrt(count(*)) AS se,
 avg(rank_ic)/(stddev_samp(rank_ic)/sqrt(count(*))) AS t, count(*) AS n FROM ic GROUP BY 1""")
def i2p(spark, sf):
    ic = M.ic_by_period(quant(spark, sf), ["rung"], "q0.5", "y_true")
    return I.t_test(ic, ["rung"], "rank_ic", hac=False).drop("p")


@query("F9_student_t_p", needs="pred", rounds="mean se t p", digits=5, sql=f"""
WITH {_PER}, sr AS (SELECT rung, row_number() OVER (PARTITION BY rung ORDER BY period)-1 AS i, rank_ic-avg(rank_ic) OVER (PARTITION BY rung) AS e,
 avg(rank_ic) OVER (PARTITION BY rung) AS mean, count(*) OVER (PARTITION BY rung) AS n FROM ic),
lg AS (SELECT rung, n, mean, greatest(0, least(floor(4*pow(n/100.0, 2/9.0)), n-1)) AS lags FROM sr GROUP BY ALL),
vr AS (SELECT a.rung, sum(CASE WHEN a.i=b.i THEN 1 ELSE 2*(1-(a.i-b.i)/(lags+1.0)) END*a.e*b.e)/max(lg.n) AS v FROM sr a
 JOIN lg ON lg.rung=a.rung JOIN sr b ON b.rung=a.rung AND b.i<=a.i AND a.i-b.i<=lags GROUP BY 1),
tt AS (SELECT lg.rung, mean, sqrt(v/n) AS se, mean/sqrt(v/n) AS t, n FROM lg JOIN vr USING (rung))
SELECT rung, mean, se, t, {_t_p("t", "n - 1")} AS p, n FROM tt""")
def f9(spark, sf):
    ic = M.ic_by_period(quant(spark, sf), ["rung"], "q0.5", "y_true")
    return I.t_test(ic, ["rung"], "rank_ic", "period")


@query("I3_block_bootstrap")
def i3(spark, sf):
    return I.block_bootstrap(quant(spark, sf), ["rung"], ["q0.5"], "y_true", F.year("date"))


_BOOT = """max(v) FILTER (b=0) AS estimate, quantile_cont(v, 0.025::DOUBLE) FILTER (b>0) AS lo, quantile_cont(v, 0.975::DOUBLE) FILTER (b>0) AS hi,
 least(1.0, 2*least(avg(CAST(v<=0 AS INT)) FILTER (b>0), 1-avg(CAST(v<=0 AS INT)) FILTER (b>0))) AS p_two_sided, count(v) FILTER (b>0) AS n_boot"""


def _draws(draws, units):
    """Units that every draw holds, as ``drawn_unit`` draws them, of (rung, i, m) units."""
    return (f"dr AS (SELECT rung, b, CAST('0x'||substr(md5('0,'||b||','||i),1,8) AS BIGINT) % m AS i FROM {units}, "
            f"(SELECT unnest(range(1, {draws + 1})) AS b) d UNION ALL SELECT rung, 0, i FROM {units})")


@query("I3_bootstrap_metric", needs="pred", rounds="estimate lo hi p_two_sided", sql=f"""
WITH u AS (SELECT rung, year(date) AS u, count(*) AS n, sum({_PIN}) AS pin, sum(CAST(y_true>=lo AND y_true<=hi AS INT)) AS cov,
 count(*) FILTER (y_true<>0) AS nz, count(*) FILTER (y_true<>0 AND sign(md)=sign(y_true)) AS hit, sum((md-y_true)**2) AS se, sum(y_true**2) AS sy FROM pred GROUP BY 1,2),
un AS (SELECT *, row_number() OVER (PARTITION BY rung ORDER BY u)-1 AS i, count(*) OVER (PARTITION BY rung) AS m FROM u), {_draws(2000, "un")},
s AS (SELECT dr.rung, b, sum(n) AS n, sum(pin) AS pin, sum(cov) AS cov, sum(nz) AS nz, sum(hit) AS hit, sum(se) AS se, sum(sy) AS sy
 FROM dr JOIN un ON un.rung=dr.rung AND un.i=dr.i GROUP BY 1,2),
v AS (SELECT rung, b, unnest(['pinball','coverage','hit_rate','rmse','r2_vs_zero']) AS metric, unnest([pin/n, cov/n, hit/nz, sqrt(se/n), 1-se/sy]) AS v FROM s)
SELECT rung, metric, {_BOOT} FROM v GROUP BY 1,2""")
def i3m(spark, sf):
    return I.bootstrap_metric(quant(spark, sf), ["rung"], ["pinball", "coverage", "hit_rate", "rmse", "r2_vs_zero"], "y_true", F.year("date"))


@query("I3_row_bootstrap", needs="pred", rounds="estimate lo hi p_two_sided", sql=f"""
WITH pu AS (SELECT *, dense_rank() OVER (PARTITION BY rung ORDER BY year(date)*100+month(date))-1 AS i FROM pred),
un AS (SELECT rung, i, count(*) OVER (PARTITION BY rung) AS m FROM (SELECT DISTINCT rung, i FROM pu)), {_draws(25, "un")},
rw AS (SELECT dr.b, pu.rung, md, y_true FROM dr JOIN pu ON pu.rung=dr.rung AND pu.i=dr.i),
rr AS (SELECT rung, b, rank() OVER (PARTITION BY rung, b ORDER BY md)+(count(*) OVER (PARTITION BY rung, b, md)-1)/2 AS rs,
 rank() OVER (PARTITION BY rung, b ORDER BY y_true)+(count(*) OVER (PARTITION BY rung, b, y_true)-1)/2 AS ry FROM rw),
v AS (SELECT rung, b, corr(rs, ry) AS v FROM rr GROUP BY 1,2)
SELECT rung, 'q0.5' AS score, {_BOOT} FROM v GROUP BY 1""")
def i3r(spark, sf):
    p = quant(spark, sf).withColumn("unit", F.year("date") * 100 + F.month("date"))
    return I.row_bootstrap(p, ["rung"], ["q0.5"], "y_true", "unit", 25)


@query("I4_diebold_mariano", needs="pred", rounds="loss_a loss_b loss_delta dm_t", digits=5, sql=f"""
WITH {_DM}, {_NW} SELECT 'B' AS rung, CAST(n AS BIGINT) AS n, (SELECT avg({_PIN}) FROM pred WHERE rung='B') AS loss_a,
 (SELECT avg({_PIN}) FROM pred WHERE rung='A') AS loss_b, mean AS loss_delta, mean/se AS dm_t FROM nw""")
def i4(spark, sf):
    preds = quant(spark, sf)
    pairs = durable(I.loss_difference(I.aligned(preds, "A"), "y_true", ["q0.1", "q0.5", "q0.9"], LV))
    return I.compare_losses(pairs).drop("dm_p")


_P = """tp AS (SELECT CAST(l_partkey AS BIGINT) AS id, min(l_extendedprice)/110000 AS p FROM lineitem GROUP BY 1),
t2 AS (SELECT id, CASE WHEN id%7=0 THEN NULL ELSE round(p*p*p, 4) END AS p FROM tp)"""


@query("I5_benjamini_hochberg", rounds="q_value", sql=f"""
WITH {_P}, r AS (SELECT id, p, row_number() OVER (ORDER BY p, id) AS k, count(p) OVER () AS m FROM t2 WHERE p IS NOT NULL),
q AS (SELECT id, least(1.0, min(p*m/k) OVER (ORDER BY p, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM r),
u AS (SELECT r.id, min(q.q) OVER (PARTITION BY r.p) AS q_value FROM r JOIN q USING (id))
SELECT t2.id, u.q_value, CAST(coalesce(u.q_value<=0.05,false) AS INT) AS reject FROM t2 LEFT JOIN u USING (id)""")
def i5(spark, sf):
    t = B.table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(
        (F.min("l_extendedprice") / 110000).alias("p"))
    t = t.select("id", F.when(F.col("id") % 7 != 0, F.round(F.col("p") * F.col("p") * F.col("p"), 4)).alias("p"))
    return I.benjamini_hochberg(t, "p").select("id", "q_value", "reject")


@query("W20_suffix_min", rounds="m", sql=f"""
WITH {_P} SELECT id, min(p) OVER (ORDER BY p, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)*1.0 AS m
FROM t2 WHERE p IS NOT NULL""")
def w20(spark, sf):
    from pitspark.functions.ordering import suffix_min
    t = B.table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(
        (F.min("l_extendedprice") / 110000).alias("p"))
    t = t.select("id", F.when(F.col("id") % 7 != 0, F.round(F.col("p") * F.col("p") * F.col("p"), 4)).alias("p"))
    return suffix_min(t.where("p is not null"), [], "p", "p", "m").select("id", "m")


@query("I6_significance")
def i6(spark, sf):
    return I.significance(quant(spark, sf))


@query("I7_rung_vs_baseline")
def i7(spark, sf):
    return I.compare_rungs(quant(spark, sf), "A")


@query("T4_leaderboard", needs="pred", rounds="ic_fold_mean", sql=f"""
WITH {_RANKED}, f AS (SELECT rung, fold, corr(rs,ry) AS ic FROM rk GROUP BY 1,2),
m AS (SELECT rung, avg(ic) AS ic_fold_mean FROM f GROUP BY 1)
SELECT rung, ic_fold_mean, row_number() OVER (ORDER BY ic_fold_mean DESC, rung) AS place, 'B' AS baseline FROM m""")
def t4(spark, sf):
    from pyspark.sql import Window as W
    got = M.fold_mean_ic(quant(spark, sf), ["rung"], "q0.5", "y_true")
    base = I.baseline_of(got.select("rung"), ["Z", "B"]).select(F.col("rung").alias("baseline"))
    return with_constants(got.withColumn(
        "place", F.row_number().over(W.orderBy(F.desc("ic_fold_mean"), "rung"))), base)


# ---- calibration ----

@query("J15_history_of_folds", needs="pred", rounds="s", digits=4, sql="""
SELECT p.rung, f.fold AS for_fold, count(*) AS n, sum(p.y_true) AS s FROM pred p JOIN (SELECT DISTINCT fold FROM pred) f
ON p.fold < f.fold GROUP BY 1,2""")
def j15(spark, sf):
    return K.history_of_folds(quant(spark, sf), ["rung"]).groupBy("rung", "for_fold").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y_true").alias("s"))


def _conf(col, lv):
    return f"""(SELECT rung, fold, v FROM (SELECT rung, fold, {col} AS v, row_number() OVER (PARTITION BY rung, fold ORDER BY {col}) AS rn,
 count(*) OVER (PARTITION BY rung, fold) AS n FROM h) WHERE rn-1=ceil(least(1.0::DOUBLE, ceil((n+1)*{lv}::DOUBLE)/n)*(n-1)))"""


_HIST = "h AS (SELECT p.rung, f.fold, p.lo-p.y_true AS s_lo, p.y_true-p.hi AS s_hi, greatest(p.lo-p.y_true, p.y_true-p.hi) AS s FROM pred p JOIN (SELECT DISTINCT fold FROM pred) f ON p.fold < f.fold)"


@query("K1_conformal_quantile", needs="pred", rounds="m", sql=f"""
WITH {_HIST} SELECT rung, CAST(fold AS INT) AS fold, v AS m FROM {_conf('s_lo', '0.9')}""")
def k1(spark, sf):
    h = K.history_of_folds(quant(spark, sf), ["rung"]).select(
        "rung", F.col("for_fold").alias("fold"), (S.quoted("q0.1") - F.col("y_true")).alias("s"))
    return K.conformal_quantile(h, ["rung", "fold"], "s", 1 - 0.1, "m").drop("n")


_CAL = f"""{_HIST}, mg AS (SELECT a.rung, a.fold, a.v AS m_lo, b.v AS m_hi FROM {_conf('s_lo', '0.9')} a
 JOIN {_conf('s_hi', '0.9')} b ON a.rung=b.rung AND a.fold=b.fold)"""


@query("K2_calibrate_asym", needs="pred", rounds="q_lo q_mid q_hi", digits=9, sql=f"""
WITH {_CAL} SELECT p.rung, p.id, CASE WHEN m_lo IS NULL THEN lo ELSE least(lo-m_lo, md) END AS q_lo, md AS q_mid,
 CASE WHEN m_hi IS NULL THEN hi ELSE greatest(hi+m_hi, md) END AS q_hi FROM pred p LEFT JOIN mg ON mg.rung=p.rung AND mg.fold=p.fold""")
def k2(spark, sf):
    got, _ = K.calibrate(quant(spark, sf), LV, keys=["rung"])
    return got.select("rung", "id", S.quoted("q0.1").alias("q_lo"), S.quoted("q0.5").alias("q_mid"),
                      S.quoted("q0.9").alias("q_hi"))


@query("K2_calibrate_sym_window", needs="pred", rounds="m_lo m_hi", sql=f"""
WITH h0 AS (SELECT p.*, f.fold AS ff, row_number() OVER (PARTITION BY rung, f.fold ORDER BY date DESC, id DESC) AS back
  FROM pred p JOIN (SELECT DISTINCT fold FROM pred) f ON p.fold < f.fold),
h AS (SELECT rung, ff AS fold, greatest(lo-y_true, y_true-hi) AS s FROM h0 WHERE back<=300),
m AS (SELECT rung, fold, v FROM {_conf('s', '0.8')}), c AS (SELECT rung, fold, count(*) AS n FROM h GROUP BY 1,2),
k AS (SELECT DISTINCT rung, fold FROM pred)
SELECT k.rung, k.fold, CAST(coalesce(n,0)>=80 AS INT) AS calibrated, coalesce(n,0) AS n_cal, coalesce(v,0.0) AS m_lo, coalesce(v,0.0) AS m_hi
FROM k LEFT JOIN m ON m.rung=k.rung AND m.fold=k.fold LEFT JOIN c ON c.rung=k.rung AND c.fold=k.fold""")
def k2s(spark, sf):
    return K.margins(quant(spark, sf), LV, mode="sym", window=300, keys=["rung"])


@query("K3_calibration_report", needs="pred", rounds="m_lo m_hi", sql=f"""
WITH {_CAL}, c AS (SELECT rung, fold, count(*) AS n FROM h GROUP BY 1,2), k AS (SELECT DISTINCT rung, fold FROM pred)
SELECT k.rung, k.fold, CAST(coalesce(n,0)>=80 AS INT) AS calibrated, coalesce(n,0) AS n_cal, coalesce(m_lo,0.0) AS m_lo,
 coalesce(m_hi,0.0) AS m_hi FROM k LEFT JOIN mg ON mg.rung=k.rung AND mg.fold=k.fold LEFT JOIN c ON c.rung=k.rung AND c.fold=k.fold""")
def k3(spark, sf):
    return K.margins(quant(spark, sf), LV, keys=["rung"])


# ---- slices ----

_SL = """ct AS (SELECT quantile_cont(size, (1.0/3)::DOUBLE) AS t1, quantile_cont(size, (2.0/3)::DOUBLE) AS t2 FROM pred),
sl AS (SELECT p.*, unnest(list_filter(['group='||grp, CASE WHEN flag_a=1 THEN 'sector=a' END, CASE WHEN flag_b=1 THEN 'sector=b' END,
 CASE WHEN flag_a=0 AND flag_b=0 THEN 'sector=other' END, CASE WHEN size<=t1 THEN 'level=low' WHEN size<=t2 THEN 'level=mid' ELSE 'level=high' END,
 CASE WHEN recent=0 THEN 'recent=none' ELSE 'recent=some' END], lambda x: x IS NOT NULL)) AS slice
 FROM (SELECT pred.*, fold%2 AS recent FROM pred) p, ct)"""
_HOW = dict(group="grp", flags={"a": "flag_a", "b": "flag_b"}, level="size", active="recent")


@query("G3_slice_masks", needs="pred", sql=f"WITH {_SL} SELECT rung, slice, count(*) AS n FROM sl GROUP BY 1,2")
def g3(spark, sf):
    p = quant(spark, sf).withColumn("recent", F.col("fold") % 2)
    return (G.slice_labels(p, **_HOW).withColumn("slice", F.explode("slices"))
            .groupBy("rung", "slice").agg(F.count(F.lit(1)).alias("n")))


_SLM = f"""{_SL}, sk AS (SELECT *, rank() OVER (PARTITION BY rung,slice ORDER BY md)+(count(*) OVER (PARTITION BY rung,slice,md)-1)/2 AS rs,
 rank() OVER (PARTITION BY rung,slice ORDER BY y_true)+(count(*) OVER (PARTITION BY rung,slice,y_true)-1)/2 AS ry,
 ntile(5) OVER (PARTITION BY rung,slice ORDER BY md, id) AS b FROM sl)"""


@query("G4_slice_metrics", needs="pred", rounds="rank_ic quintile_spread mae coverage coverage_error", sql=f"""
WITH {_SLM} SELECT rung, slice, count(*) AS n, corr(rs,ry) AS rank_ic, avg(y_true) FILTER (b=5)-avg(y_true) FILTER (b=1) AS quintile_spread,
 avg(abs(md-y_true)) AS mae, avg(CAST(y_true>=lo AND y_true<=hi AS INT)) AS coverage,
 avg(CAST(y_true>=lo AND y_true<=hi AS INT))-0.8::DOUBLE AS coverage_error FROM sk GROUP BY 1,2 HAVING count(*)>=20""")
def g4(spark, sf):
    p = quant(spark, sf).withColumn("recent", F.col("fold") % 2)
    return G.slice_metrics(G.slice_labels(p, **_HOW), keys=["rung"])


@query("G5_slices_from_predictions", needs="pred", rounds="rank_ic quintile_spread auc brier base_rate", sql=f"""
WITH {_SLM}, au AS (SELECT rung, slice, (sum(rs) FILTER (y_true>0)-count(*) FILTER (y_true>0)*(count(*) FILTER (y_true>0)+1)/2)
 /(count(*) FILTER (y_true>0)*count(*) FILTER (y_true<=0)) AS auc FROM sk GROUP BY 1,2)
SELECT sk.rung, sk.slice, count(*) AS n, corr(rs,ry) AS rank_ic, avg(y_true) FILTER (b=5)-avg(y_true) FILTER (b=1) AS quintile_spread,
 max(au.auc) AS auc, avg((p-CAST(y_true>0 AS INT))**2) AS brier, avg(CAST(y_true>0 AS INT)) AS base_rate
FROM sk JOIN au ON au.rung=sk.rung AND au.slice=sk.slice GROUP BY 1,2 HAVING count(*)>=20""")
def g5(spark, sf):
    saved = prob(spark, sf).drop("size", "flag_a", "flag_b").withColumn("recent", F.col("fold") % 2)
    return G.slice_metrics_from_predictions(saved, B.unpriced_events(spark, sf), keys=["rung"], **_HOW)


@query("J16_predictions_panel", needs="pred ev", rounds="y_true", sql="""
SELECT p.rung, p.id, p.y_true, ev.is_target FROM pred p JOIN ev USING (id)""")
def j16(spark, sf):
    return quant(spark, sf).join(B.unpriced_events(spark, sf).select("id", "is_target"), "id").select(
        "rung", "id", "y_true", "is_target")


@query("P11_finite_rows", needs="pred", sql="""
SELECT rung, count(*) FILTER (flag_a=0 AND flag_b=0) AS n, count(*) FILTER (flag_a=1 OR flag_b=1) AS n_dropped FROM pred GROUP BY 1""")
def p11(spark, sf):
    bad = F.when(F.col("flag_a") == 1, F.lit(float("inf"))).when(F.col("flag_b") == 0, F.col("y_true"))
    return M.counts(quant(spark, sf).withColumn("y_true", bad), ["rung"], "y_true", QS)
