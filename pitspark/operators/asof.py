"""As-of joins (J1-J5) and temporal checks.

The answer for a query row depends only on (key, time), so both sides are first reduced to
one row per (key, time) with a map-side combine; a key or a day holding a third of the
rows shrinks to its distinct times before anything is shuffled by key.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from pitspark.functions.ordering import celled
from pitspark.session import durable


def asof_lookup(points: DataFrame, series: DataFrame, by: Sequence[str], at: str, ts: str,
                values: Sequence[str], slice_by: str | None = None) -> DataFrame:
    """One row per distinct (by, at) of ``points`` with two structs of ``values``:

    ``before``: the last series row with ts < at; ``upto``: with ts <= at. Null if none. With several
    series rows at one (by, ts) the greatest struct is used.

    Dated series stay in one window per key, which the calendar bounds. For finer
    timestamps give ``slice_by`` (a ``date_trunc`` unit), for a continuous axis ``slice_by="value"``:
    windows then run inside slices and the last value of earlier slices is carried in through a table of
    one row per slice.
    """
    by = list(by)
    # Distinct first: a hash aggregate with a map-side combine, where the struct maximum below sorts.
    marks = (points.select(*by, F.col(at).alias("_t")).where(F.col("_t").isNotNull()).distinct()
             .select(*by, "_t", F.lit(True).alias("_asked"), F.lit(None).alias("_obs")))
    seen = series.select(*by, F.col(ts).alias("_t"), F.lit(False).alias("_asked"),
                         F.struct(*values).alias("_obs")).where(F.col("_t").isNotNull())
    line = (marks.unionByName(seen).groupBy(*by, "_t")
            .agg(F.max("_asked").alias("_asked"), F.max("_obs").alias("_obs")))
    if not by:
        line, by = line.withColumn("_all", F.lit(0)), ["_all"]
    cell = list(by)
    if slice_by:
        # written once, as the splitters, the slices and the rows each read it
        line = celled(durable(line), by, [F.col("_t")], "_slice", distinct=True) if slice_by == "value" else line.withColumn("_slice", F.date_trunc(slice_by, "_t"))
        cell.append("_slice")
    run = W.partitionBy(*cell).orderBy("_t")
    line = (line
            .withColumn("before", F.last("_obs", True).over(run.rowsBetween(W.unboundedPreceding, -1)))
            .withColumn("upto", F.last("_obs", True).over(run.rowsBetween(W.unboundedPreceding, 0))))
    if slice_by:
        last = F.max(F.when(F.col("_obs").isNotNull(), F.struct("_t", "_obs")))
        ends = line.groupBy(*cell).agg(last["_obs"].alias("_end"))
        past = W.partitionBy(*by).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
        carry = ends.select(*cell, F.last("_end", True).over(past).alias("_carry"))
        line = line.join(carry, cell).withColumns({
            "before": F.coalesce("before", "_carry"), "upto": F.coalesce("upto", "_carry")})
    return (line.where("_asked").select(*[c for c in by if c != "_all"],
                                        F.col("_t").alias(at), "before", "upto"))


def neighbours(points: DataFrame, knots: DataFrame, by: Sequence[str], x: str, kx: str, ky: str) -> DataFrame:
    """One row per distinct (by, x) of ``points`` on a continuous axis: ``left``, the last knot with kx <= x, and
    ``right``, the first one with kx > x, as structs (kx, ky), null if none. Of knots with equal kx, the left one
    has the largest ky and the right one the smallest. Both come from one written line, cut in ranges as in
    ``asof_lookup``; what lies outside a range is carried in through a table of one row per range."""
    by = list(by)
    marks = (points.select(*by, F.col(x).alias("_t")).where(F.col("_t").isNotNull()).distinct()
             .select(*by, "_t", F.lit(True).alias("_asked"), F.lit(None).alias("_up"), F.lit(None).alias("_down")))
    knot = F.struct(F.col(kx).alias("kx"), F.col(ky).alias("ky"))
    seen = knots.where(F.col(kx).isNotNull()).select(
        *by, F.col(kx).alias("_t"), F.lit(False).alias("_asked"), knot.alias("_up"),
        F.when(~F.isnan(F.col(kx).cast("double")), knot).alias("_down"))      # nothing lies below NaN
    line = (marks.unionByName(seen).groupBy(*by, "_t")
            .agg(F.max("_asked").alias("_asked"), F.max("_up").alias("_up"), F.min("_down").alias("_down")))
    if not by:
        line, by = line.withColumn("_all", F.lit(0)), ["_all"]
    line = celled(durable(line), by, [F.col("_t")], "_slice", distinct=True)
    cell = W.partitionBy(*by, "_slice")
    ends = line.groupBy(*by, "_slice").agg(
        F.max(F.when(F.col("_up").isNotNull(), F.struct("_t", "_up")))["_up"].alias("_last"),
        F.min(F.when(F.col("_down").isNotNull(), F.struct("_t", "_down")))["_down"].alias("_first"))
    slices = W.partitionBy(*by)
    ends = ends.select(*by, "_slice", *[
        F.last(c, True).over(slices.orderBy(o).rowsBetween(W.unboundedPreceding, -1)).alias(f"_past{c}")
        for c, o in (("_last", F.asc("_slice")), ("_first", F.desc("_slice")))])
    line = (line.withColumn("left", F.last("_up", True).over(cell.orderBy("_t").rowsBetween(W.unboundedPreceding, 0)))
            # downwards, as a frame of all that follows would be evaluated again for every row
            .withColumn("right", F.last("_down", True).over(cell.orderBy(F.desc("_t")).rowsBetween(W.unboundedPreceding, -1)))
            .join(ends, [*by, "_slice"]))
    return line.where("_asked").select(*[c for c in by if c != "_all"], F.col("_t").alias(x),
                                       F.coalesce("left", "_past_last").alias("left"), F.coalesce("right", "_past_first").alias("right"))


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], at: str, ts: str,
              values: Sequence[str], strict: bool = True,
              slice_by: str | None = None) -> DataFrame:
    """Add the last right row strictly before (or at or before) each left row."""
    look = asof_lookup(left, right, by, at, ts, values, slice_by)
    side = "before" if strict else "upto"
    return left.join(look.select(*by, at, *[F.col(f"{side}.{v}").alias(v) for v in values]),
                     [*by, at], "left")


def asof_join_fallback(left: DataFrame, right: DataFrame, by: Sequence[str], at: str, ts: str,
                       values: Sequence[str]) -> DataFrame:
    """Strict match, or the row's own inclusive match when nothing is earlier."""
    look = asof_lookup(left, right, by, at, ts, values)
    return left.join(look.select(*by, at, *[
        F.coalesce(F.col(f"before.{v}"), F.col(f"upto.{v}")).alias(v) for v in values]),
        [*by, at], "left")


def series_keys(series: DataFrame, by: Sequence[str]) -> list[str]:
    """A series without the group column serves every group, so it is looked up by time
    alone instead of being copied per group."""
    return [c for c in by if c in series.columns]


def unmatched(joined: DataFrame, value: str) -> DataFrame:
    """Guard for J2: number of rows left without a match."""
    return joined.agg(F.count_if(F.col(value).isNull()).alias("unmatched"),
                      F.count(F.lit(1)).alias("n"))


def require_matched(joined: DataFrame, value: str) -> DataFrame:
    n = unmatched(joined, value).first()["unmatched"]
    if n:
        raise ValueError(f"{n} rows have no series value at or before their date")
    return joined


def temporal_violations(children: DataFrame, events: DataFrame, on: str, asof: str,
                        at: str) -> DataFrame:
    """Child rows whose knowledge date is missing or not strictly before the event."""
    return (children.join(events.select(on, at), on)
            .where(F.col(asof).isNull() | (F.col(asof) >= F.col(at))))


def require_pit(children: DataFrame, events: DataFrame, on: str, asof: str, at: str) -> DataFrame:
    if asof not in children.columns:
        raise ValueError(f"column {asof!r} is needed to prove rows predate their event")
    n = temporal_violations(children, events, on, asof, at).count()
    if n:
        raise ValueError(f"{n} rows have {asof} missing or >= {at}")
    return children
