"""Expanding statistics against strictly earlier rows."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pitspark.functions.ordering import celled, row_index, tie_order


def _score(x: Column, k: Column, s: Column, q: Column, low: Column, high: Column) -> Column:
    """z of x against k earlier values with sum s, sum of squares q and extremes; 0 without spread."""
    n = F.when(k >= 2, k)
    sd = F.sqrt(F.greatest((q - s * s / n) / (n - 1), F.lit(0.0)))
    return F.when((high > low) & (sd > 1e-12), (x - s / n) / sd).otherwise(0.0)


def _from_first(df: DataFrame, by: list[str], place: Column, values: dict[str, str]) -> DataFrame:
    """Add every value less the first one of its group: sums of a constant stretch are then exactly zero,
    and nothing that lies ahead enters."""
    first = df.groupBy(*by).agg(*[
        F.min_by(v, F.when(F.col(v).isNotNull(), place)).alias(f"_f_{z}") for z, v in values.items()])
    return df.join(first, by).withColumns({f"_x_{z}": F.col(v) - F.col(f"_f_{z}") for z, v in values.items()})


def expanding_z(df: DataFrame, by: Sequence[str], day: str, tie: str,
                values: dict[str, str]) -> DataFrame:
    """Z-score of each value against the earlier rows of its group in (day, tie) order, by sample
    std; 0 for the first two rows or without spread. Earlier rows of the same day count.

    Count, sum, sum of squares and extremes are taken per (group, day, tie range) first. Windows run
    over those partials, and only inside one such cell over rows.
    """
    by = list(by)
    order = tie_order(df, tie)
    rows = _from_first(celled(df, by, order), by, F.struct(F.col(day), *order), values)
    cell = [*by, day, "_cell"]
    sums = ["_n", *[f"_{k}_{z}" for z in values for k in "sq"]]
    lows, highs = [f"_lo_{z}" for z in values], [f"_hi_{z}" for z in values]
    merge = {**{c: F.sum for c in sums}, **{c: F.min for c in lows}, **{c: F.max for c in highs}}
    none = {c: F.lit(0) if c in sums else F.lit(None).cast("double") for c in merge}

    def row_value(name: str) -> Column:
        x = F.col(f"_x_{name.split('_', 2)[2]}") if name != "_n" else F.lit(1)
        return x * x if name.startswith("_q_") else x

    parts = rows.groupBy(*cell).agg(*[f(row_value(c)).alias(c) for c, f in merge.items()])

    def before(table: DataFrame, part: list[str], order: str, mark: str) -> DataFrame:
        past = W.partitionBy(*part).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
        return table.select(*part, order, *[F.coalesce(f(c).over(past), none[c]).alias(f"{mark}{c}")
                                            for c, f in merge.items()])

    def joined(name: str, a: Column, b: Column) -> Column:
        return a + b if name in sums else F.least(a, b) if name in lows else F.greatest(a, b)

    # Earlier ranges of the day, and earlier days: both windows run over partials only.
    days = parts.groupBy(*by, day).agg(*[f(c).alias(c) for c, f in merge.items()])
    carry = before(parts, [*by, day], "_cell", "c").join(before(days, by, day, "d"), [*by, day]).select(
        *cell, *[joined(c, F.col(f"c{c}"), F.col(f"d{c}")).alias(f"p{c}") for c in merge])
    inside = W.partitionBy(*cell).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.join(carry, cell).withColumns({
        c: joined(c, F.coalesce(f(row_value(c)).over(inside), none[c]), F.col(f"p{c}")) for c, f in merge.items()})
    return rows.withColumns({z: _score(F.col(f"_x_{z}"), F.col("_n"), F.col(f"_s_{z}"), F.col(f"_q_{z}"),
                                       F.col(f"_lo_{z}"), F.col(f"_hi_{z}")) for z in values}
                            ).select(*df.columns, *values)


def expanding_z_daily(df: DataFrame, by: Sequence[str], day: str, tie: str,
                      values: dict[str, str]) -> DataFrame:
    """W8 for values that are the same on all rows of a (by, day).

    The j-th row of a day has seen the earlier days and j copies of its own value, so windows run over one
    row per (by, day) and rows are only numbered.
    """
    by = list(by)
    days = df.groupBy(*by, day).agg(F.count(F.lit(1)).alias("_n"), *[F.max(v).alias(v) for v in values.values()])
    days = _from_first(days, by, F.col(day), values)
    past = W.partitionBy(*by).orderBy(day).rowsBetween(W.unboundedPreceding, -1)
    seen = {"_k": F.coalesce(F.sum("_n").over(past), F.lit(0))}
    for z in values:
        x = F.col(f"_x_{z}")
        seen |= {f"_s_{z}": F.coalesce(F.sum(x * F.col("_n")).over(past), F.lit(0.0)),
                 f"_q_{z}": F.coalesce(F.sum(x * x * F.col("_n")).over(past), F.lit(0.0)),
                 f"_lo_{z}": F.min(x).over(past), f"_hi_{z}": F.max(x).over(past)}
    days = days.select(*by, day, *[f"_x_{z}" for z in values], *[c.alias(m) for m, c in seen.items()])
    rows = row_index(df, [*by, day], None, tie, "_j").join(days, [*by, day])
    j, out = F.col("_j"), {}
    for z in values:
        x = F.col(f"_x_{z}")
        own = F.when(j > 0, x)
        out[z] = _score(x, F.col("_k") + j, F.col(f"_s_{z}") + j * x, F.col(f"_q_{z}") + j * x * x,
                        F.least(F.col(f"_lo_{z}"), own), F.greatest(F.col(f"_hi_{z}"), own))
    return rows.withColumns(out).select(*df.columns, *values)


def day_standing(days: DataFrame, by: Sequence[str], day: str, value: str,
                 times: str) -> DataFrame:
    """Per (by, day): ``n_before`` earlier recorded values, how many were ``below`` this day's value
    and how many ``upto`` it. One row per (group, day), ``times`` being how often it is recorded.

    The days before a day are the left neighbours of the blocks of 1, 2, 4, ... days it lies in on the
    right-hand side. So each day stands in one pair of blocks a size, pairs are ordered by value, and the
    counts of the left blocks are added up: days times the logarithm of their number, no pairs of days.
    """
    by = list(by)
    line = W.partitionBy(*by).orderBy(day)
    rows = days.withColumns({
        "_i": (F.row_number().over(line) - 1).cast("int"), "_d": F.count(F.lit(1)).over(W.partitionBy(*by)),
        "_before": F.coalesce(F.sum(times).over(line.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))})
    sizes = F.sequence(F.lit(0), F.ceil(F.log2("_d")).cast("int"))
    cut = rows.withColumn("_l", F.explode(sizes)).withColumns({
        "_pair": F.expr("shiftright(_i, _l + 1)"), "_right": F.expr("shiftright(_i, _l) % 2 = 1")})
    pair = W.partitionBy(*by, "_l", "_pair")
    left = F.sum(F.when(~F.col("_right"), F.col(times)).otherwise(0))
    cut = cut.withColumns({
        "_upto": left.over(pair.orderBy(value).rangeBetween(W.unboundedPreceding, W.currentRow)),
        "_same": left.over(W.partitionBy(*by, "_l", "_pair", value))}).where("_right")
    got = cut.groupBy(*by, day).agg(F.sum(F.col("_upto") - F.col("_same")).alias("below"), F.sum("_upto").alias("upto"))
    return rows.join(got, [*by, day], "left").select(
        *by, day, value, F.col("_before").alias("n_before"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("below", "upto")])


def expanding_terciles(events: DataFrame, state: DataFrame, by: Sequence[str], day: str, tie: str,
                       value: str, out: str, least: int = 5) -> DataFrame:
    """+1 / 0 / -1 for a value above / between / below the tercile order statistics of the values
    recorded by earlier rows of its group.

    ``state`` holds one value per (by, day): what was known before that day is the same for all its rows.
    Rows without a value are neutral and record nothing. The j-th row of a day sees j more copies of its
    own value, which is arithmetic on the day's counts; so rows are numbered, never collected.
    """
    by = list(by)
    known = state.where(F.col(value).isNotNull()).select(*by, day, value)
    times = events.groupBy(*by, day).agg(F.count(F.lit(1)).alias("_times"))
    stand = day_standing(known.join(times, [*by, day]), by, day, value, "_times")
    rows = row_index(events, [*by, day], None, tie, "_j").join(stand, [*by, day], "left")
    n = F.col("n_before") + F.col("_j")
    hot = F.col("below") > F.floor(2 * n / 3)
    cold = F.col("upto") + F.col("_j") <= F.floor(n / 3)
    flag = F.when(F.col(value).isNull() | (n < least), 0).when(hot, 1).when(cold, -1).otherwise(0)
    return rows.withColumn(out, flag).drop("_j", value, "n_before", "below", "upto")
