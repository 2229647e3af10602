"""Scalar expressions (F1-F7, F10, P3, P10, P12): plain Column builders."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pitspark.operators.asof import neighbours


def normalise_name(c: Column | str) -> Column:
    """Lower case, runs of other characters to one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def blank(c: Column | str) -> Column:
    """True for null and whitespace-only text."""
    return F.coalesce(F.trim(c), F.lit("")) == ""


def clip(z: Column, c: float) -> Column:
    """P10: clamp to +-c; no clamp unless c > 0."""
    return F.greatest(F.least(z, F.lit(float(c))), F.lit(-float(c))) if c > 0 else z


def finite(c: Column | str) -> Column:
    """Not null, not NaN, not infinite."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def guarded(num: Column, den: Column, other: float | None = None, eps: float = 1e-12) -> Column:
    """num / den where |den| > eps, else ``other``."""
    return F.when(F.abs(den) > eps, num / den).otherwise(F.lit(other))


def sigmoid(z: Column, limit: float = 30.0) -> Column:
    """logistic function of a clipped logit."""
    return 1 / (1 + F.exp(-clip(z, limit)))


def period_end(d: Column | str, freq: str) -> Column:
    """last day of the month (ME), quarter (QE) or year (YE) of a date."""
    spans = {"ME": ("month", 0), "QE": ("quarter", 2), "YE": ("year", 11)}
    if freq not in spans:
        raise ValueError(f"freq must be one of {sorted(spans)}")
    unit, months = spans[freq]
    return F.last_day(F.add_months(F.trunc(d, unit), months))


def parse_day(c: Column | str) -> Column:
    """yyyymmdd numbers or date text to a date; null when neither."""
    s = F.trim(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"))
    whole = F.regexp_replace(s, r"\.0$", "")
    return F.when(whole.rlike("^[0-9]{8}$"), F.try_to_timestamp(whole, F.lit("yyyyMMdd")).cast("date")
                  ).otherwise(F.try_to_timestamp(s).cast("date"))


def fill_zero(df: DataFrame, cols: list[str]) -> DataFrame:
    """Null and NaN to 0."""
    return df.withColumns({c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))
                           for c in cols})


def pad_left(a: Column, size: int) -> Column:
    """an array brought to ``size`` elements by repeating its first one in front."""
    return F.concat(F.array_repeat(F.element_at(a, 1), F.greatest(F.lit(size) - F.size(a), F.lit(0))),
                    F.slice(F.reverse(F.slice(F.reverse(a), 1, size)), 1, size))


def interpolate(points: DataFrame, knots: DataFrame, by: list[str], x: str, kx: str, ky: str,
                out: str) -> DataFrame:
    """piecewise linear interpolation through a sorted table of knots, clamped at both ends.

    The knots around each point come from one lookup. Of knots with equal x the last y is used from the left, the
    first from the right.
    """
    both = neighbours(points.select(*by, x), knots, by, x, kx, ky).select(
        *by, x, F.col("left.kx").alias("_x0"), F.col("left.ky").alias("_y0"),
        F.col("right.kx").alias("_x1"), F.col("right.ky").alias("_y1"))
    slope = (F.col("_y1") - F.col("_y0")) / (F.col("_x1") - F.col("_x0"))
    y = F.when(F.isnan(F.col(x).cast("double")) & F.col("_x0").isNotNull(), F.lit(float("nan"))) \
        .when(F.col("_x0").isNull(), F.col("_y1")).when(F.col("_x1").isNull(), F.col("_y0")) \
        .otherwise(F.col("_y0") + slope * (F.col(x) - F.col("_x0")))
    return points.join(both.select(*by, x, y.alias(out)), [*by, x], "left")
