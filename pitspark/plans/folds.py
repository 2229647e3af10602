"""Purged walk-forward folds (V1, V3) as a long (fold, id, role) table."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pitspark.functions.ordering import order_stats, row_index, with_constants
from pitspark.session import durable


def walk_forward(panel: DataFrame, n_folds: int = 5, min_train: float = 0.35, val_frac: float = 0.15,
                 embargo: int = 5, at: str = "d", id_: str = "id") -> DataFrame:
    """V1: contiguous test blocks over the later part of the sample; a row trains a fold only when its
    label ended, plus the embargo, before the block starts. The last ``val_frac`` of those rows
    validate, and training rows are purged against them in the same way.

    Positions come from ``row_index`` and are written once, being read by every step; the rest is one
    row per fold, so no row list leaves the executors.
    """
    rows = durable(row_index(panel.select(id_, F.col(at).alias("_t"), "label_end"), [], "_t", id_, "_i"))
    first = F.floor(F.col("_n") * min_train)

    def bound(k):
        return F.bround(first + k * ((F.col("_n") - first) / n_folds)).cast("bigint")

    spec = (rows.agg(F.count(F.lit(1)).alias("_n"))
            .withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))))
            .select("fold", bound(F.col("fold")).alias("_lo"), bound(F.col("fold") + 1).alias("_hi"))
            .where("_hi > _lo"))
    starts = rows.select(F.col("_i").alias("_lo"), F.col("_t").alias("_start"))
    spec = F.broadcast(spec.join(starts, "_lo"))        # n_folds rows

    every = rows.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1)))).join(spec, "fold")
    test = every.where("_i >= _lo and _i < _hi").select("fold", id_, F.lit("test").alias("role"))
    past = every.where((F.col("_i") < F.col("_lo"))
                       & (F.date_add("label_end", embargo) < F.col("_start")))
    cut = order_stats(past, ["fold"], "_i", {
        "_cut": lambda m: m - F.greatest(F.lit(1), F.floor(m * val_frac))})
    cut = cut.select("fold", F.col("_cut").cast("bigint").alias("_cut"))
    begins = past.select("fold", F.col("_i").alias("_cut"), F.col("_t").alias("_val_start"))
    cut = F.broadcast(cut.join(begins, ["fold", "_cut"]))   # n_folds rows
    past = past.join(cut, "fold")
    role = F.when(F.col("_i") >= F.col("_cut"), "val").when(
        F.date_add("label_end", embargo) < F.col("_val_start"), "train")
    past = past.select("fold", id_, role.alias("role")).where("role is not null")
    return past.unionByName(test)


def check_folds(folds: DataFrame) -> DataFrame:
    """Raise when a fold has test rows but nothing left to train on."""
    bad = folds.groupBy("fold").agg(F.count_if(F.col("role") == "train").alias("n")).where("n = 0")
    empty = [r["fold"] for r in bad.collect()]          # at most one row per fold
    if empty:
        raise ValueError(f"no training rows survive purging in folds {sorted(empty)}")
    return folds


def final_split(panel: DataFrame, val_frac: float = 0.15, least: int = 20, at: str = "d",
                id_: str = "id") -> DataFrame:
    """V3: every row; the last max(round(n * val_frac), least) of them validate."""
    rows = with_constants(row_index(panel.select(id_, at), [], at, id_, "_i"),
                          panel.agg(F.count(F.lit(1)).alias("_n")))
    n_val = F.greatest(F.bround(F.col("_n") * val_frac).cast("bigint"), F.lit(least))
    return rows.select(F.lit(0).alias("fold"), id_, F.when(
        F.col("_i") >= F.col("_n") - n_val, "val").otherwise("train").alias("role"))
