"""Ordered functions on series.

Statistics are computed once per series row and then as-of joined, instead of once per event.
A dated series has one row per (group, day), so a window partition is bounded by the calendar. For longer
series pass ``chunk``: rows are numbered, cut into runs of ``chunk`` rows with as many rows repeated at
the front as the farthest-reaching expression looks back, and each run becomes its own window partition.
"""
from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from pitspark.functions.ordering import row_index
from pitspark.operators.asof import asof_lookup

YEAR = 252  # trading days


class Frames:
    """Window frames and the 0-based position available to a series expression."""

    def __init__(self, part: Sequence[str], ts: str, pos: Column):
        self.order = W.partitionBy(*part).orderBy(ts)
        self.pos = pos

    def last(self, rows: int):
        return self.order.rowsBetween(1 - rows, 0)


@dataclass(frozen=True)
class Expr:
    """A series expression and how many rows before its own it reads."""

    make: Callable[[Frames], Column]
    reach: int

    def __call__(self, frames: Frames) -> Column:
        return self.make(frames)


def with_series(df: DataFrame, by: Sequence[str], ts: str, exprs: dict[str, Expr],
                chunk: int | None = None) -> DataFrame:
    """Add every expression, evaluated along (by, ts)."""
    if isinstance(df.schema[ts].dataType, (T.StringType, T.BinaryType)):
        raise ValueError(f"{ts} is text; a series needs dates, timestamps or numbers")
    look_back = max((e.reach for e in exprs.values()), default=0)
    if chunk is None:
        part = list(by)
        if not part:
            df, part = df.withColumn("_all", F.lit(0)), ["_all"]
        f = Frames(part, ts, F.col("_pos"))
        df = df.withColumn("_pos", F.row_number().over(f.order) - 1)
        return df.withColumns({m: e(f) for m, e in exprs.items()}).drop("_pos", "_all")
    if chunk < look_back:
        raise ValueError(f"chunk must be at least the look-back of {look_back} rows")
    rows = row_index(df, by, None, ts, "_pos")
    own = F.floor(F.col("_pos") / chunk)
    ahead = F.floor((F.col("_pos") + look_back) / chunk)
    rows = rows.withColumn("_chunk", F.explode(F.array_distinct(F.array(own, ahead))))
    f = Frames([*by, "_chunk"], ts, F.col("_pos"))
    return (rows.withColumns({m: e(f) for m, e in exprs.items()})
            .where(F.col("_chunk") == own).drop("_pos", "_chunk"))


def log_ret(v: str, lag: int) -> Expr:
    """Log return over ``lag`` rows; 0 with fewer prior rows."""
    return Expr(lambda f: F.coalesce(F.log(v) - F.lag(F.log(v), lag).over(f.order), F.lit(0.0)), lag)


def drawdown(v: str, rows: int = YEAR) -> Expr:
    """Log level less its maximum over the last ``rows`` rows."""
    return Expr(lambda f: F.log(v) - F.max(F.log(v)).over(f.last(rows)), rows - 1)


def _diff(x: Column, f: Frames) -> Column:
    return x - F.lag(x, 1).over(f.order)


def realised_vol(step: str, rows: int = 21, least: int = 10) -> Expr:
    """Annualised population std of the last ``rows`` steps; 0 with fewer than ``least``.
    ``step`` is a column of one-row log differences (null on the first row)."""
    return Expr(lambda f: F.when(F.count(step).over(f.last(rows)) >= least,
                                 F.stddev_pop(step).over(f.last(rows)) * math.sqrt(YEAR)).otherwise(0.0), rows - 1)


def log_step(v: str) -> Expr:
    return Expr(lambda f: _diff(F.log(v), f), 1)


def step(v: str) -> Expr:
    return Expr(lambda f: _diff(F.col(v), f), 1)


def rolling_z(v: str, rows: int = YEAR, least: int = 40) -> Expr:
    """Z-score against the last ``rows`` rows; 0 before ``least`` prior rows or without spread."""
    def make(f: Frames) -> Column:
        w = f.last(rows)
        sd = F.stddev_pop(v).over(w)
        return F.when((f.pos >= least) & (sd > 1e-12),
                      (F.col(v) - F.avg(v).over(w)) / sd).otherwise(0.0)
    return Expr(make, rows - 1)


def pct_change(v: str, lag: int = 21) -> Expr:
    """W6"""
    return Expr(lambda f: F.coalesce(F.try_divide(F.col(v), F.lag(v, lag).over(f.order)) - 1, F.lit(0.0)), lag)


def ret_spread(a: str, b: str, lag: int = 63) -> Expr:
    """W7"""
    return Expr(lambda f: log_ret(a, lag)(f) - log_ret(b, lag)(f), lag)


def window_array(v: str, size: int = 21) -> Expr:
    """The last ``size`` values, padded on the left with the earliest of them."""
    def make(f: Frames) -> Column:
        got = F.collect_list(v).over(f.last(size))
        return F.concat(F.array_repeat(F.element_at(got, 1), F.lit(size) - F.size(got)), got)
    return Expr(make, size - 1)


def change_vol(step_: str, levels: int = 63) -> Expr:
    """Annualised population std of the steps inside the last ``levels`` levels."""
    return Expr(lambda f: F.when(f.pos >= levels - 1, F.stddev_pop(step_).over(f.last(levels - 1))
                                 * math.sqrt(YEAR)).otherwise(0.0), levels - 2)


def gap_days(ts: str) -> Expr:
    """W19"""
    return Expr(lambda f: F.datediff(F.col(ts), F.lag(ts, 1).over(f.order)), 1)


def sequence_summaries(seq: str, prefix: str) -> dict[str, Column]:
    """Last, 5-step change, change over the window, mean and population std of an array."""
    a, n = F.col(seq), F.size(seq)
    total = F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    mean = total / n
    var = F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / n
    return {f"{prefix}_level": F.element_at(a, -1),
            f"{prefix}_d5": F.coalesce(F.element_at(a, -1) - F.try_element_at(a, F.lit(-6)),
                                       F.lit(0.0)),
            f"{prefix}_dw": F.element_at(a, -1) - F.element_at(a, 1),
            f"{prefix}_mean": mean, f"{prefix}_std": F.sqrt(var)}


def sequence_diff(seq: str) -> Column:
    """W14"""
    n = F.size(seq)
    return F.zip_with(F.slice(seq, F.lit(2), n - 1), F.slice(seq, F.lit(1), n - 1), lambda x, y: x - y)


def peer_trailing_returns(paths: DataFrame, by: Sequence[str], ts: str, price: str) -> DataFrame:
    """Per (event, peer) price path cut strictly before the event: 21- and 63-row log returns at
    its last row. Fewer than 22 closes give no row, fewer than 64 no long return."""
    newest = W.partitionBy(*by).orderBy(F.desc(ts))
    back = (paths.select(*by, ts, price).withColumn("_rn", F.row_number().over(newest))
            .where("_rn <= 64").groupBy(*by).agg(
                F.max(ts).alias("asof"), *[F.max(F.when(F.col("_rn") == i, F.log(price))).alias(f"_{i}")
                                           for i in (1, 22, 64)]))
    return (back.where("_22 is not null")
            .select(*by, F.round(F.expr("_1 - _22"), 6).alias("ret_21d"),
                    F.round(F.expr("_1 - _64"), 6).alias("ret_63d"), "asof"))


def trailing_returns(series: DataFrame, events: DataFrame, by: Sequence[str], ts: str, price: str, at: str, id_: str,
                     reach: int = 140) -> DataFrame:
    """W16 for events that share their series: the returns of ``peer_trailing_returns`` over the ``reach`` days before
    each event. They are taken once per series row, with the days they start on, and looked up per event; no
    event carries its price path."""
    by = list(by)
    x = Expr(lambda f: F.log(price), 0)
    rows = with_series(series.select(*by, ts, price), by, ts, {"_x": x})

    def back(c: str, k: int) -> Expr:
        return Expr(lambda f: F.lag(c, k).over(f.order), k)

    rows = with_series(rows, by, ts, {"_x21": back("_x", 21), "_x63": back("_x", 63), "_t21": back(ts, 21), "_t63": back(ts, 63)})
    rows = rows.select(*by, ts, F.col(ts).alias("asof"), F.round(F.expr("_x - _x21"), 6).alias("ret_21d"),
                       F.round(F.expr("_x - _x63"), 6).alias("ret_63d"), "_t21", "_t63")
    names = ["asof", "ret_21d", "ret_63d", "_t21", "_t63"]
    seen = asof_lookup(events, rows, by, at, ts, names).select(*by, at, *[F.col(f"before.{c}").alias(c) for c in names])
    got = events.select(id_, *by, at).join(seen, [*by, at])
    first = F.date_sub(at, reach)
    return got.where(F.col("_t21") >= first).select(
        id_, *by, "ret_21d", F.when(F.col("_t63") >= first, F.col("ret_63d")).alias("ret_63d"), "asof")
