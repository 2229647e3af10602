"""Where a model fails and what it uses."""
from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from pitspark.functions.ordering import quantiles, row_index, value_offsets, with_constants
from pitspark.functions.scalar import finite
from pitspark.plans import metrics as M
from pitspark.session import durable
from pitspark.sources.predictions import quantile_columns, quoted


def slice_labels(df: DataFrame, group: str | None = "grp", flags: dict[str, str] | None = None,
                 level: str | None = None, active: str | None = None) -> DataFrame:
    """``slices``, every slice a row belongs to: its group, each set flag or "other", the tercile of
    ``level`` over all rows, and whether ``active`` is zero."""
    flags = flags or {}
    labels: list[Column] = []
    if group:
        labels.append(F.concat(F.lit("group="), F.col(group)))
    on = {name: F.coalesce(F.col(c) > 0, F.lit(False)) for name, c in flags.items()}
    labels += [F.when(c, f"sector={name}") for name, c in on.items()]
    if len(on) > 1:
        none = ~F.lit(False)
        for c in on.values():
            none = none & ~c
        labels.append(F.when(none, "sector=other"))
    if level:
        df = with_constants(df, quantiles(df, [], level, {"_t1": 1 / 3, "_t2": 2 / 3}).drop("n"))
        labels.append(F.when(F.col(level) <= F.col("_t1"), "level=low")
                      .when(F.col(level) <= F.col("_t2"), "level=mid")
                      .when(F.col(level) > F.col("_t2"), "level=high"))
    if active:
        labels.append(F.when(F.col(active) == 0, "recent=none").when(F.col(active) > 0, "recent=some"))
    return df.withColumn("slices", F.array_compact(F.array(*labels))).drop("_t1", "_t2")


def slice_metrics(labelled: DataFrame, y: str = "y_true", tie: str = "id", least: int = 20,
                  keys: Sequence[str] = ()) -> DataFrame:
    """Per slice with enough rows the order metrics and either probability or band quality."""
    cols, levels = quantile_columns(labelled)
    by, point = [*keys, "slice"], cols[levels.index(0.5)]
    told = durable(labelled.select(*keys, "slices", tie, y, *[quoted(c) for c in cols]))
    rows = told.withColumn("slice", F.explode("slices"))
    base = M._order_base(M.scorable(rows, y, cols), by, tie, point, y, cols)
    o, qs = F.col("_y"), [F.col(f"_c{i}") for i in range(len(cols))]
    own = [M._auc().alias("auc"), *M._probability_columns(F.col("_s"), o)] if cols == ["p_out"] else [
        *M._level_columns(F.col("_s"), o), *M._interval_columns(o, qs, levels)]
    names = ["auc", "brier", "base_rate"] if cols == ["p_out"] else ["mae", "coverage", "coverage_error"]
    got = M.ordered(base, by, [5], tie).groupBy(*by).agg(M._rank_ic().alias("rank_ic"), M._spread(5).alias("quintile_spread"), *own)
    size = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return M._merge([size, got.select(*by, "rank_ic", "quintile_spread", *names)], by)


def slice_metrics_from_predictions(preds: DataFrame, panel: DataFrame, keys: Sequence[str] = (),
                                   **labels) -> DataFrame:
    """Saved predictions matched to the panel by id, then G3 and G4."""
    extra = [c for c in panel.columns if c == "id" or c not in preds.columns]
    return slice_metrics(slice_labels(preds.join(panel.select(*extra), "id"), **labels), keys=keys)


def shuffled(df: DataFrame, cols: Sequence[str], by: Sequence[str], seed: int, id_: str = "id") -> DataFrame:
    """Rows with ``cols`` jointly permuted within ``by``: the i-th row in id order takes the values of the
    i-th row in hash order. Both orders are numbered in ranges, not in one window."""
    own = row_index(df.drop(*cols), by, None, id_, "_i")
    mixed = df.select(*by, id_, *cols).withColumn("_h", F.xxhash64(id_, F.lit(seed)))
    mixed = row_index(mixed, by, None, "_h", "_i").drop(id_, "_h")
    return own.join(mixed, [*by, "_i"]).drop("_i").select(*df.columns)


def permutation_importance(test: DataFrame, score: Callable[[DataFrame], DataFrame], y: str,
                           groups: dict[str, Sequence[str]], repeats: int = 3, seed: int = 0,
                           id_: str = "id") -> DataFrame:
    """G1: drop in rank IC per fold when a feature (or a named group jointly) is shuffled in the test
    block; mean and population std over folds, largest first.

    ``score`` maps rows with a ``fold`` column to the same rows with a ``score`` column. The permutations of all
    repeats are drawn in one numbering of (fold, repeat) and shared by the groups. A row meets the row it takes values from
    once a repeat; groups are told apart in the pass that scores them. Outcomes stay where they are, so they are
    ranked once, and scored rows are added up by score as they come.
    """
    told = test.where(finite(y))
    centred = F.col("below") + (F.col("cnt") - F.col("n")) / 2          # average rank less the mean rank
    ranks = value_offsets(told, ["fold"], y).select("fold", y, centred.alias("_ry"))
    rows = row_index(test, ["fold"], None, id_, "_i")
    rows = durable(rows.join(ranks, ["fold", y], "left").select(*rows.columns, "_ry"))
    turns = rows.select("fold", "_i", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("_rep")).withColumn(
        "_h", F.xxhash64("_i", "fold", F.col("_rep") + seed + 1000))
    taken = durable(row_index(turns, ["fold", "_rep"], None, "_h", "_to").select(
        "fold", "_rep", F.col("_i").alias("_from"), F.col("_to").alias("_i")))
    moved = list(dict.fromkeys(c for cols in groups.values() for c in cols))
    values = rows.select("fold", F.col("_i").alias("_from"), *[F.col(c).alias(f"_new{i}") for i, c in enumerate(moved)])
    paired = durable(rows.join(taken, ["fold", "_i"]).join(values, ["fold", "_from"]))
    kept = [c for c in rows.columns if c not in moved]

    def block(name: str, cols: Sequence[str]) -> Column:
        return F.struct(F.lit(name).alias("feature"), *[F.col(f"_new{i}" if c in cols else c).alias(c) for i, c in enumerate(moved)])

    blocks = paired.select(*kept, "_rep", F.inline(F.array(*[block(name, cols) for name, cols in groups.items()])))
    # with the unshuffled block, named ""
    every = score(rows.withColumns({"feature": F.lit(""), "_rep": F.lit(0)}).unionByName(blocks))
    keys = ["feature", "_rep", "fold"]
    ry = F.col("_ry")
    counted = durable(every.where(finite(y)).groupBy(*keys, F.col("score").alias("_s")).agg(
        F.count(F.lit(1)).alias("_c"), F.sum(ry).alias("_w"), F.sum(ry * ry).alias("_v"), F.min(ry).alias("_lo"),
        F.max(ry).alias("_hi")))
    if counted.where(~F.coalesce(finite("_s"), F.lit(False))).isEmpty():
        every = M.rank_ic_of_groups(counted, keys)
    else:       # rows without a score drop out, which moves the ranks of the other outcomes
        every = M.rank_ic(durable(every.select(*keys, "score", y)), keys, "score", y)
    base = every.where("feature = ''").select("fold", F.col("rank_ic").alias("_base"))
    ics = every.where("feature <> ''")
    drop = (ics.groupBy("feature", "fold").agg(F.avg("rank_ic").alias("_m")).join(base, "fold")
            .select("feature", (F.col("_base") - F.col("_m")).alias("_d")))
    return drop.groupBy("feature").agg(F.avg("_d").alias("delta_ic"), F.stddev_pop("_d").alias("delta_ic_std")
                                       ).orderBy(F.desc("delta_ic"), "feature")


def importance_share(per_fold: DataFrame) -> DataFrame:
    """(fold, feature, gain) to each feature's share of its fold's gain, mean and std over folds."""
    total = per_fold.groupBy("fold").agg(F.greatest(F.sum("gain"), F.lit(1e-12)).alias("_t"))
    share = per_fold.join(total, "fold").withColumn("_s", F.col("gain") / F.col("_t"))
    return share.groupBy("feature").agg(F.avg("_s").alias("gain_share"), F.stddev_samp("_s").alias(
        "gain_share_std")).orderBy(F.desc("gain_share"), "feature")


def permutation_null(rows: DataFrame, predict: Callable[[DataFrame], DataFrame], ys: Sequence[str], main: str,
                     repeats: int = 5, seed: int = 0, id_: str = "id") -> DataFrame:
    """I8: fold-mean IC of the model and of the same model after one permutation of all outcomes
    per repeat; mean, spread and largest of the null, z of the actual value and an alert.

    ``predict`` maps a panel to its test rows with (fold, score, <main>). The permutations are those of ``shuffled``:
    rows are numbered by id once, meet the outcomes of every repeat in one chain of joins by number, and are written,
    so that each panel is a scan of some of the columns.
    """
    rows = durable(rows)
    wide = row_index(rows, [], None, id_, "_i")
    for r in range(repeats):
        mixed = rows.select(F.xxhash64(id_, F.lit(seed + r)).alias("_h"), *[F.col(c).alias(f"_{r}_{c}") for c in ys])
        wide = wide.join(row_index(mixed, [], None, "_h", "_i").drop("_h"), "_i")
    wide = durable(wide.drop("_i"))

    def scored(rep: int) -> DataFrame:
        cols = [F.col(f"_{rep}_{c}").alias(c) if rep >= 0 and c in ys else F.col(c) for c in rows.columns]
        return predict(wide.select(*cols)).select(F.lit(rep).alias("repeat"), "fold", "score", main)

    every = reduce(DataFrame.unionByName, [scored(r) for r in range(-1, repeats)])
    runs = M.fold_mean_ic(durable(every), ["repeat"], "score", main).withColumnRenamed("ic_fold_mean", "ic")
    null, real = F.when(F.col("repeat") >= 0, F.col("ic")), F.when(F.col("repeat") < 0, F.col("ic"))
    got = runs.agg(F.max(real).alias("actual_ic"), F.avg(null).alias("null_mean"),
                   F.stddev_samp(null).alias("null_sd"), F.max(F.abs(null)).alias("null_max"),
                   F.count(null).alias("repeats"))
    return got.withColumns({
        "z": F.when(F.col("null_sd") > 0, (F.col("actual_ic") - F.col("null_mean")) / F.col("null_sd")),
        "alert": (F.abs("null_mean") > 0.05).cast("int")})


def train_gap(scored: DataFrame, y: str) -> DataFrame:
    """Rank IC on training and test rows of each fold and their difference."""
    ics = M.rank_ic(scored.where("role in ('train', 'test')"), ["fold", "role"], "score", y)

    def of(role: str, c: str) -> Column:
        return F.max(F.when(F.col("role") == role, F.col(c)))

    got = ics.groupBy("fold").agg(of("train", "n").alias("n_train"), of("train", "rank_ic").alias("train_ic"),
                                  of("test", "rank_ic").alias("test_ic"))
    return got.withColumn("gap", F.col("train_ic") - F.col("test_ic"))
