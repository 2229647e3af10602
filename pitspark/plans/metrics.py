"""Out-of-sample metrics (E1-E14, A10, A11) grouped by any keys: rung, fold, period, slice.

Every metric is a grouped query over the predictions table. Ranks, buckets and medians come from the
range-split positions of ``functions.ordering``, so one rung or fold may hold any share of the rows.
"""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from pitspark.functions.distributions import t_two_sided_p
from pitspark.functions.ordering import average_rank, bucket_at, bucketize, quantiles, row_index, value_offsets
from pitspark.functions.scalar import finite, period_end
from pitspark.session import durable
from pitspark.sources.predictions import quoted


def _keys(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    return (df, list(keys)) if keys else (df.withColumn("all", F.lit("all")), ["all"])


def scorable(df: DataFrame, y: str, cols: Sequence[str]) -> DataFrame:
    """Rows whose outcome and forecasts are all finite."""
    return df.where(reduce(lambda a, b: a & b, [finite(quoted(c)) for c in (y, *cols)]))


def counts(df: DataFrame, keys: Sequence[str], y: str, cols: Sequence[str]) -> DataFrame:
    """Scored and dropped rows."""
    df, keys = _keys(df, keys)
    ok = reduce(lambda a, b: a & b, [finite(quoted(c)) for c in (y, *cols)])
    return df.groupBy(*keys).agg(F.count_if(ok).alias("n"),
                                 F.count_if(~F.coalesce(ok, F.lit(False))).alias("n_dropped"))


def ordered(base: DataFrame, keys: Sequence[str], buckets: Sequence[int] = (), tie: str | None = None) -> DataFrame:
    """``base`` rows (keys, tie, _s, _y, ...) with everything that order metrics need: average ranks ``_rs`` and
    ``_ry``, ``_n`` rows of the key and ``_b<k>``, the row's bucket of k by (score, tie). Score and outcome are
    put in order once, whatever is asked of them; only runs of equal scores that straddle a border are
    numbered by tie."""
    keys = list(keys)
    s = value_offsets(base, keys, "_s").select(*keys, "_s", F.col("below").alias("_below"), F.col("cnt").alias("_run"),
                                               F.col("n").alias("_n"))
    t = value_offsets(base, keys, "_y").select(*keys, "_y", (F.col("below") + (F.col("cnt") + 1) / 2).alias("_ry"))
    rows = base.join(s, [*keys, "_s"]).join(t, [*keys, "_y"]).withColumn("_rs", F.col("_below") + (F.col("_run") + 1) / 2)
    if not buckets:
        return rows
    ends = [bucket_at(F.col("_below"), F.col("_n"), k) != bucket_at(F.col("_below") + F.col("_run") - 1, F.col("_n"), k)
            for k in buckets]
    rows = durable(rows.withColumn("_cut", reduce(lambda a, b: a | b, ends)))
    split = row_index(rows.where("_cut"), [*keys, "_s"], None, tie, "_at")
    rows = rows.where("not _cut").withColumn("_at", F.lit(0)).unionByName(split)
    return rows.withColumns({f"_b{k}": bucket_at(F.col("_below") + F.col("_at"), F.col("_n"), k) for k in buckets})


def _rank_ic() -> Column:
    n = F.count(F.lit(1))
    return F.when((n >= 3) & _varies("_s") & _varies("_y"), _corr("_rs", "_ry"))


def _ic_p(ic: Column, n: Column) -> Column:
    return t_two_sided_p(ic * F.sqrt((n - 2) / F.greatest(1 - ic * ic, F.lit(1e-300))), n - 2)


def _end_means(k: int) -> list[Column]:
    """Mean outcome of the top and the bottom bucket of ``ordered`` rows."""
    return [F.when((F.max("_n") >= 5 * k) & _varies("_s"), F.avg(F.when(F.col(f"_b{k}") == b, F.col("_y")))) for b in (k, 1)]


def _spread(k: int) -> Column:
    top, bottom = _end_means(k)
    return top - bottom


def _auc() -> Column:
    up = F.col("_y") > 0
    pos, neg = F.count_if(up), F.count_if(~up)
    num = F.sum(F.when(up, F.col("_rs"))) - pos * (pos + 1) / 2
    return F.when((pos > 0) & (neg > 0) & _varies("_s"), num / (pos * neg))


def _varies(c: str | Column) -> Column:
    return F.min(c) < F.max(c)


def _corr(a: str | Column, b: str | Column) -> Column:
    """Correlation, null rather than an error for a constant side."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def with_ranks(df: DataFrame, keys: Sequence[str], cols: dict[str, str]) -> DataFrame:
    """W17 for several columns, each ranked on the same base rows."""
    out = df
    for col, name in cols.items():
        off = value_offsets(df, keys, col).select(
            *keys, col, (F.col("below") + (F.col("cnt") + 1) / 2).alias(name))
        out = out.join(off, [*keys, col])
    return out


def rank_ic(df: DataFrame, keys: Sequence[str], score: str, y: str, p_value: bool = False) -> DataFrame:
    """Spearman correlation; null under 3 rows or when either side is constant."""
    df, keys = _keys(df, keys)
    base = scorable(df, y, [score]).select(*keys, quoted(score).alias("_s"), F.col(y).alias("_y"))
    got = with_ranks(base, keys, {"_s": "_rs", "_y": "_ry"}).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.when((F.count(F.lit(1)) >= 3) & _varies("_s") & _varies("_y"),
                                             _corr("_rs", "_ry")).alias("rank_ic"))
    return got.withColumn("rank_ic_p", _ic_p(F.col("rank_ic"), F.col("n"))) if p_value else got


def rank_ic_of_groups(groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """E1 of rows counted by score: (keys, _s, _c rows, _w and _v: sums of their centred outcome ranks and of the
    squares, _lo and _hi: the ends of those ranks). Only distinct scores are ranked."""
    off = value_offsets(groups.select(*keys, "_s", "_c"), keys, "_s", F.col("_c"))
    at = off.select(*keys, "_s", "n", (F.col("below") + (F.col("cnt") - F.col("n")) / 2).alias("_rs"))
    n = F.max("n")
    corr = F.try_divide(F.sum(F.col("_rs") * F.col("_w")), F.sqrt(F.sum(F.col("_c") * F.col("_rs") ** 2)) * F.sqrt(F.sum("_v")))
    return groups.join(at, [*keys, "_s"]).groupBy(*keys).agg(
        n.alias("n"), F.when((n >= 3) & _varies("_s") & (F.min("_lo") < F.max("_hi")), corr).alias("rank_ic"))


def pearson_ic(df: DataFrame, keys: Sequence[str], score: str, y: str) -> DataFrame:
    """E2"""
    df, keys = _keys(df, keys)
    return scorable(df, y, [score]).groupBy(*keys).agg(
        F.when((F.count(F.lit(1)) >= 3) & _varies(quoted(score)) & _varies(F.col(y)),
               _corr(quoted(score), F.col(y))).alias("pearson_ic"))


def _bucketed(df: DataFrame, keys: Sequence[str], score: str, y: str, tie: str, k: int) -> DataFrame:
    base = scorable(df, y, [score]).select(*keys, tie, quoted(score).alias("_s"), F.col(y).alias("_y"))
    return bucketize(base, keys, "_s", tie, k, "_b")


def _fit_for(k: int) -> Column:
    return (F.max("n") >= 5 * k) & _varies("_s")


def bucket_spread(df: DataFrame, keys: Sequence[str], score: str, y: str, tie: str, k: int,
                  out: str = "spread") -> DataFrame:
    """Mean outcome of the top bucket less the bottom one; null unless every bucket has 5 rows and
    the score varies."""
    df, keys = _keys(df, keys)
    top, bottom = [F.avg(F.when(F.col("_b") == b, F.col("_y"))) for b in (k, 1)]
    return _bucketed(df, keys, score, y, tie, k).groupBy(*keys).agg(
        F.when(_fit_for(k), top - bottom).alias(out))


def bucket_stats(df: DataFrame, keys: Sequence[str], score: str, y: str, tie: str, k: int = 5) -> DataFrame:
    """Mean and median outcome of the top and bottom bucket and the spread of the medians."""
    df, keys = _keys(df, keys)
    rows = _bucketed(df, keys, score, y, tie, k)
    means = rows.groupBy(*keys).agg(
        _fit_for(k).alias("_ok"), F.avg(F.when(F.col("_b") == k, F.col("_y"))).alias("top_bucket_mean"),
        F.avg(F.when(F.col("_b") == 1, F.col("_y"))).alias("bottom_bucket_mean"))
    mid = quantiles(rows.where(F.col("_b").isin(1, k)), [*keys, "_b"], "_y", {"_m": 0.5})
    mid = mid.groupBy(*keys).agg(F.max(F.when(F.col("_b") == k, F.col("_m"))).alias("top_bucket_median"),
                                 F.max(F.when(F.col("_b") == 1, F.col("_m"))).alias("bottom_bucket_median"))
    got = means.join(mid, keys).withColumn(
        "median_spread", F.col("top_bucket_median") - F.col("bottom_bucket_median"))
    names = ["top_bucket_mean", "bottom_bucket_mean", "top_bucket_median", "bottom_bucket_median",
             "median_spread"]
    return got.select(*keys, *[F.when(F.col("_ok"), F.col(c)).alias(c) for c in names])


def adaptive_spread(df: DataFrame, keys: Sequence[str], score: str, y: str, tie: str) -> DataFrame:
    """10 buckets from 100 rows up, else 5."""
    df, keys = _keys(df, keys)
    n = scorable(df, y, [score]).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return (n.join(bucket_spread(df, keys, score, y, tie, 10, "_ten"), keys)
            .join(bucket_spread(df, keys, score, y, tie, 5, "_five"), keys)
            .select(*keys, F.when(F.col("_n") >= 100, F.col("_ten")).otherwise(F.col("_five"))
                    .alias("spread")))


def hit_rate(point: Column, y: Column) -> Column:
    """E5"""
    return F.avg(F.when(y != 0, (F.signum(point) == F.signum(y)).cast("int")))


def level_metrics(df: DataFrame, keys: Sequence[str], point: str, y: str, median: bool = True) -> DataFrame:
    """Hit rate, errors and R2 against predicting zero. The median error needs positions of the
    errors; without it this is one aggregate."""
    df, keys = _keys(df, keys)
    rows = scorable(df, y, [point]).select(*keys, quoted(point).alias("_p"), F.col(y).alias("_y"),
                                           F.abs(quoted(point) - F.col(y)).alias("_a"))
    got = rows.groupBy(*keys).agg(*_level_columns(F.col("_p"), F.col("_y")))
    if not median:
        return got
    return got.join(quantiles(rows, keys, "_a", {"medae": 0.5}).drop("n"), keys)


def _level_columns(p: Column, y: Column) -> list[Column]:
    e = p - y
    return [hit_rate(p, y).alias("hit_rate"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e ** 2)).alias("rmse"),
            F.avg(e).alias("bias"), F.when(F.sum(y ** 2) > 0, 1 - F.sum(e ** 2) / F.sum(y ** 2)).alias("r2_vs_zero")]


def pinball_row(y: Column, cols: Sequence[str | Column], levels: Sequence[float]) -> Column:
    """Loss of one row averaged over its quantile levels."""
    qs = [quoted(c) if isinstance(c, str) else c for c in cols]
    parts = [F.greatest(q * (y - c), (q - 1.0) * (y - c)) for c, q in zip(qs, levels)]
    return reduce(lambda a, b: a + b, parts) / len(parts)


def interval_metrics(df: DataFrame, keys: Sequence[str], y: str, cols: Sequence[str],
                     levels: Sequence[float], counted: bool = False) -> DataFrame:
    """Pinball, coverage, misses, width and interval score of the outer pair; ``counted`` adds n."""
    df, keys = _keys(df, keys)
    return scorable(df, y, cols).groupBy(*keys).agg(*[F.count(F.lit(1)).alias("n")] * counted,
                                                    *_interval_columns(F.col(y), [quoted(c) for c in cols], levels))


def _interval_columns(o: Column, qs: Sequence[Column], levels: Sequence[float]) -> list[Column]:
    lo, hi = qs[0], qs[-1]
    nominal = levels[-1] - levels[0]
    miss = F.when(o < lo, lo - o).when(o > hi, o - hi).otherwise(0.0)
    cover = F.avg((~(o < lo) & ~(o > hi)).cast("int"))
    score = hi - lo + (2 / (1 - nominal)) * miss if nominal < 1 else hi - lo
    return [F.avg(pinball_row(o, qs, levels)).alias("pinball"), cover.alias("coverage"),
            F.lit(nominal).alias("nominal_coverage"), (cover - nominal).alias("coverage_error"),
            F.avg((o < lo).cast("int")).alias("frac_below_lo"), F.avg((o > hi).cast("int")).alias("frac_above_hi"),
            F.avg(hi - lo).alias("mean_interval_width"), F.avg(score).alias("interval_score")]


def auc(df: DataFrame, keys: Sequence[str], p: str, y: str) -> DataFrame:
    """Rank-sum identity with average ranks; null when a class is absent or p is constant."""
    df, keys = _keys(df, keys)
    base = scorable(df, y, [p]).select(*keys, quoted(p).alias("_s"), (F.col(y) > 0).alias("_up"))
    rows = average_rank(base, keys, "_s", "_r")
    pos, neg = F.count_if("_up"), F.count_if(~F.col("_up"))
    got = rows.groupBy(*keys).agg(pos.alias("_p"), neg.alias("_n"), _varies("_s").alias("_v"),
                                  F.sum(F.when(F.col("_up"), F.col("_r"))).alias("_r"))
    num = F.col("_r") - F.col("_p") * (F.col("_p") + 1) / 2
    return got.select(*keys, F.when((F.col("_p") > 0) & (F.col("_n") > 0) & F.col("_v"),
                                    num / (F.col("_p") * F.col("_n"))).alias("auc"))


def probability_metrics(df: DataFrame, keys: Sequence[str], p: str, y: str) -> DataFrame:
    """Brier score and skill, log loss, accuracy, base rate, mean probability."""
    df, keys = _keys(df, keys)
    got = scorable(df, y, [p]).groupBy(*keys).agg(*_probability_columns(quoted(p), F.col(y)))
    return _with_skill(got)


def _probability_columns(q: Column, y: Column) -> list[Column]:
    up = (y > 0).cast("double")
    c = F.greatest(F.least(q, F.lit(1 - 1e-7)), F.lit(1e-7))
    return [F.avg(up).alias("base_rate"), F.avg((q - up) ** 2).alias("brier"),
            F.avg(-(up * F.log(c) + (1 - up) * F.log(1 - c))).alias("logloss"),
            F.avg(((q > 0.5) == (up > 0.5)).cast("int")).alias("accuracy"), F.avg(q).alias("mean_p")]


def _with_skill(got: DataFrame) -> DataFrame:
    ref = F.col("base_rate") * (1 - F.col("base_rate"))
    return got.withColumn("brier_skill", F.when(ref > 0, 1 - F.col("brier") / ref))


def _merge(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    return reduce(lambda a, b: a.join(b, list(keys), "left"), parts)


def _order_base(rows: DataFrame, keys: Sequence[str], tie: str, point: str, y: str, cols: Sequence[str]) -> DataFrame:
    return durable(rows.select(*keys, tie, quoted(point).alias("_s"), F.col(y).alias("_y"),
                               *[quoted(c).alias(f"_c{i}") for i, c in enumerate(cols)]))


def _order_columns() -> list[Column]:
    top, bottom = _end_means(5)
    return [F.count(F.lit(1)).alias("_m"), _rank_ic().alias("rank_ic"),
            F.when((F.count(F.lit(1)) >= 3) & _varies("_s") & _varies("_y"), _corr("_s", "_y")).alias("pearson_ic"),
            _spread(10).alias("decile_spread"), _spread(5).alias("quintile_spread"), top.alias("top_bucket_mean"),
            bottom.alias("bottom_bucket_mean")]


def _with_medians(got: DataFrame, ranked: DataFrame, keys: list[str]) -> DataFrame:
    mid = quantiles(ranked.where(F.col("_b5").isin(1, 5)), [*keys, "_b5"], "_y", {"_q": 0.5})
    ends = mid.groupBy(*keys).agg(*[F.max(F.when(F.col("_b5") == b, F.col("_q"))).alias(f"{n}_bucket_median")
                                    for b, n in ((5, "top"), (1, "bottom"))])
    ok = F.col("top_bucket_mean").isNotNull()
    names = ["top_bucket_median", "bottom_bucket_median"]
    got = got.join(ends, keys, "left").withColumns({c: F.when(ok, F.col(c)) for c in names})
    return got.withColumns({"median_spread": F.col(names[0]) - F.col(names[1]),
                            "rank_ic_p": _ic_p(F.col("rank_ic"), F.col("_m"))}).drop("_m")


def evaluate(df: DataFrame, keys: Sequence[str], y: str, cols: Sequence[str], levels: Sequence[float],
             tie: str = "id") -> DataFrame:
    """All metrics of quantile forecasts, one row per key: rows are ranked once and added up in one pass."""
    df, keys = _keys(df, keys)
    base = _order_base(scorable(df, y, cols), keys, tie, cols[list(levels).index(0.5)], y, cols)
    ranked = durable(ordered(base, keys, (10, 5), tie))
    got = ranked.groupBy(*keys).agg(*_order_columns(), *_level_columns(F.col("_s"), F.col("_y")), *_interval_columns(
        F.col("_y"), [F.col(f"_c{i}") for i in range(len(cols))], levels))
    errors = quantiles(ranked.withColumn("_a", F.abs(F.col("_s") - F.col("_y"))), keys, "_a", {"medae": 0.5}).drop("n")
    return _merge([counts(df, keys, y, cols), _with_medians(got, ranked, keys), errors], keys)


def evaluate_binary(df: DataFrame, keys: Sequence[str], y: str, p: str = "p_out",
                    tie: str = "id") -> DataFrame:
    """All metrics of probability forecasts; order metrics against the continuous outcome."""
    df, keys = _keys(df, keys)
    ranked = durable(ordered(_order_base(scorable(df, y, [p]), keys, tie, p, y, []), keys, (10, 5), tie))
    got = _with_skill(ranked.groupBy(*keys).agg(*_order_columns(), _auc().alias("auc"),
                                                *_probability_columns(F.col("_s"), F.col("_y"))))
    got = _merge([counts(df, keys, y, [p]), _with_medians(got, ranked, keys)], keys)
    return got.withColumn("hit_rate", F.col("accuracy"))


def long_metrics(wide: DataFrame, keys: Sequence[str]) -> DataFrame:
    names = [c for c in wide.columns if c not in keys]
    return wide.select(*keys, *[F.col(c).cast("double").alias(c) for c in names]).unpivot(
        list(keys), names, "metric", "value")


def aggregate_folds(by_fold: DataFrame, keys: Sequence[str] = ("rung",)) -> DataFrame:
    """A10: mean and population std of each metric over folds, nulls and NaN skipped."""
    v = F.when(~F.isnan("value"), F.col("value"))
    return by_fold.groupBy(*keys, "metric").agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"))


def summarize_folds(by_fold: DataFrame, keys: Sequence[str] = ("rung",),
                    metrics: Sequence[str] = ("rank_ic", "decile_spread", "quintile_spread", "pinball")
                    ) -> DataFrame:
    """A10 with a plain t-test of the mean against zero."""
    rows = by_fold.where(F.col("metric").isin(*metrics) & F.col("value").isNotNull()
                         & ~F.isnan("value"))
    got = rows.groupBy(*keys, "metric").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
        F.count(F.lit(1)).alias("n_folds"),
        F.when((F.count(F.lit(1)) >= 2) & (F.stddev_pop("value") > 0),
               F.avg("value") / (F.stddev_samp("value") / F.sqrt(F.count(F.lit(1))))).alias("t_stat"))
    return got.withColumn("p_value", t_two_sided_p(F.col("t_stat"), F.col("n_folds") - 1))


def ic_by_period(df: DataFrame, keys: Sequence[str], score: str, y: str, date: str = "date",
                 freq: str = "QE", least: int = 8) -> DataFrame:
    """Rank IC within each calendar period, thin and undefined periods dropped."""
    rows = df.withColumn("period", period_end(date, freq))
    return rank_ic(rows, [*keys, "period"], score, y).where(
        (F.col("n") >= least) & F.col("rank_ic").isNotNull())


def ic_by_fold(df: DataFrame, keys: Sequence[str], score: str, y: str) -> DataFrame:
    """E14"""
    return rank_ic(df, [*keys, "fold"], score, y)


def fold_mean_ic(df: DataFrame, keys: Sequence[str], score: str, y: str) -> DataFrame:
    """Mean of the within-fold ICs that are defined."""
    df, keys = _keys(df, keys)
    return ic_by_fold(df, keys, score, y).groupBy(*keys).agg(F.avg("rank_ic").alias("ic_fold_mean"))
