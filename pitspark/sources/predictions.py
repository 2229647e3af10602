"""Out-of-sample predictions on disk (S6-S8, S14), one partition per rung."""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BASE = ("id", "date", "grp", "fold", "y_true")


def quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def quantile_columns(df: DataFrame) -> tuple[list[str], list[float]]:
    """The q<level> columns in level order, else ``p_out`` as level 0.5."""
    found = sorted((float(m.group(1)), c) for c in df.columns
                   if (m := re.fullmatch(r"q([0-9.]+)", c)))
    if found:
        return [c for _, c in found], [v for v, _ in found]
    if "p_out" in df.columns:
        return ["p_out"], [0.5]
    raise ValueError(f"no forecast columns in {df.columns}")


def point_column(df: DataFrame) -> str:
    cols, levels = quantile_columns(df)
    return cols[levels.index(0.5)]


def predictions_frame(folds: list[DataFrame]) -> DataFrame:
    """Per-fold forecasts as one tidy frame. Order is a property of the reader (T1), so
    nothing is sorted here."""
    out = folds[0]
    for f in folds[1:]:
        out = out.unionByName(f)
    cols, _ = quantile_columns(out)
    return out.select(*BASE, *[quoted(c) for c in cols])


def write_predictions(df: DataFrame, path: str, rung: str) -> None:
    """Write one rung; writing it again replaces that partition only."""
    (df.withColumn("rung", F.lit(rung)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("rung").parquet(path))


def read_predictions(spark: SparkSession, path: str, rung: str | None = None) -> DataFrame:
    """All rungs, or one of them by partition pruning."""
    df = spark.read.option("mergeSchema", "true").parquet(path)
    if rung is None:
        return df
    if not list_rungs(spark, path).where(F.col("rung") == rung).take(1):
        raise FileNotFoundError(f"no saved predictions for {rung!r} under {path}")
    return df.where(F.col("rung") == rung)


def list_rungs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("rung").distinct()


def write_summary(by_fold: DataFrame, pooled: DataFrame, path: str | None = None) -> DataFrame:
    """Per rung and metric, mean and population std over folds and the pooled value. Both inputs
    are long: (rung, fold, metric, value) and (rung, metric, value)."""
    out = (by_fold.groupBy("rung", "metric")
           .agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
           .join(pooled.select("rung", "metric", F.col("value").alias("pooled")),
                 ["rung", "metric"], "left"))
    if path:
        out.write.mode("overwrite").parquet(path)
    return out
