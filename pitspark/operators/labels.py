"""Outcome labels relative to a benchmark."""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pitspark.operators.asof import asof_lookup, series_keys
from pitspark.session import durable

HORIZONS = (1, 3, 5, 21)


def known_entities_only(prices: DataFrame, events: DataFrame, id_: str = "id") -> DataFrame:
    """P5"""
    return prices.join(events.select(id_), id_, "left_semi")


def closes(prices: DataFrame, horizons: Sequence[int], tie: Sequence[str] = ()) -> DataFrame:
    """W1, long form: the closes numbered by date per id, only those a horizon asks for.

    Numbers above the longest horizon are cut before the shuffle, so an id with a very long path costs no
    more than any other.
    """
    path = W.partitionBy("id").orderBy("date", *tie)
    return (prices.withColumn("h", F.row_number().over(path)).where(F.col("h") <= max(horizons))
            .where(F.col("h").isin(*{1, *horizons})).select("id", "h", "date", "close"))


def nth_close(prices: DataFrame, horizons: Sequence[int], tie: Sequence[str] = ()) -> DataFrame:
    """c_<h> and d_<h> per id, null where the path is shorter."""
    rows = closes(prices, horizons, tie)
    at = [F.max(F.when(F.col("h") == h, F.col(c))).alias(f"{p}_{h}")
          for h in sorted({1, *horizons}) for c, p in (("close", "c"), ("date", "d"))]
    return rows.groupBy("id").agg(*at)


def require_anchor(horizons: Sequence[int], anchor: str) -> None:
    if anchor not in ("offer", "first_close"):
        raise ValueError("anchor must be 'offer' or 'first_close'")
    if anchor == "first_close" and 1 in horizons:
        raise ValueError("horizon 1 is always 0 when labels start at the first close")


def returns(events: DataFrame, prices: DataFrame, bench: DataFrame, horizons: Sequence[int] = HORIZONS,
            anchor: str = "offer", adjust: bool = True, tie: Sequence[str] = ()) -> DataFrame:
    """Per priced event and horizon: raw_<h>, exc_<h> (measured from the offer, the second less the
    benchmark's move) and the label y_<h> by ``anchor``; with c_<h> and d_<h>.

    L1: the benchmark's base is its last value before the first price day, or that day's own value
    when there is none (J3). L2: base is the first close and the benchmark on that day.
    """
    hs = sorted(horizons)
    require_anchor(hs, anchor)
    # The inner join also drops paths of unknown ids (P5).
    rows = closes(prices, hs, tie).join(events.select("id", "grp", "offer"), "id")
    by = series_keys(bench, ["grp"])
    look = asof_lookup(rows, bench.withColumn("_lc", F.log("close")), by, "date", "date", ["_lc"])
    rows = rows.join(look, [*by, "date"], "left").withColumns({
        "m": F.col("upto._lc"), "m_prev": F.coalesce(F.col("before._lc"), F.col("upto._lc"))})

    def at(h: int, c: str) -> Column:
        return F.max(F.when(F.col("h") == h, F.col(c)))

    wide = rows.groupBy("id").agg(
        F.first("offer").alias("offer"), at(1, "m_prev").alias("_m0"),
        *[at(h, c).alias(f"{p}_{h}") for h in sorted({1, *hs})
          for c, p in (("close", "c"), ("date", "d"), ("m", "_mh"))])
    return wide.select("id", *measured(hs, anchor, adjust))


def measured(horizons: Sequence[int], anchor: str = "offer", adjust: bool = True) -> list[Column]:
    """The columns of ``returns`` from offer, c_<h>, d_<h>, the benchmark _mh_<h> at each close and its base _m0."""
    hs, out = sorted(horizons), []
    for h in sorted({1, *hs}):
        c, m = F.col(f"c_{h}"), F.col(f"_mh_{h}")
        raw = F.log(c) - F.log("offer")
        exc = raw - (m - F.col("_m0")) if adjust else raw
        first = F.log(c) - F.log("c_1")
        y = exc if anchor == "offer" else first - (m - F.col("_mh_1")) if adjust else first
        out += [F.col(f"c_{h}"), F.col(f"d_{h}"), raw.alias(f"raw_{h}"), exc.alias(f"exc_{h}")]
        if h in hs:
            out.append(y.alias(f"y_{h}"))
    return out


def event_paths(events: DataFrame, prices: DataFrame, horizons: Sequence[int], tie: Sequence[str] = ()) -> DataFrame:
    """Every event with c_<h> and d_<h>, null where it has no such close. Both sides meet once, by id, and are written."""
    return durable(events.join(nth_close(prices, horizons, tie), "id", "left"))


def benchmarked(paths: DataFrame, bench: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """``event_paths`` with the benchmark columns of ``measured``. It is looked up for the distinct days of the
    closes; the answers, a table as large as its calendar, are written and joined on when the events are read."""
    hs = sorted({1, *horizons})
    by = series_keys(bench, ["grp"])
    days = reduce(DataFrame.unionByName, [paths.select(*by, F.col(f"d_{h}").alias("date")).distinct() for h in hs])
    look = durable(asof_lookup(days, bench.withColumn("_lc", F.log("close")), by, "date", "date", ["_lc"]).select(
        *by, "date", F.col("upto._lc").alias("_m"), F.coalesce("before._lc", "upto._lc").alias("_prev")))
    for h in hs:
        paths = paths.join(look.select(*by, F.col("date").alias(f"d_{h}"), F.col("_m").alias(f"_mh_{h}"),
                                       *[F.col("_prev").alias("_m0")] * (h == 1)), [*by, f"d_{h}"], "left")
    return paths


def uncovered(rets: DataFrame) -> DataFrame:
    """L1: rows of ``returns`` that have a price return but none against the benchmark, for some horizon."""
    gaps = [F.col(c).isNotNull() & F.col(f"exc_{c.removeprefix('raw_')}").isNull()
            for c in rets.columns if c.startswith("raw_")]
    return rets.where(reduce(lambda a, b: a | b, gaps))


def require_benchmark(rets: DataFrame) -> None:
    n = uncovered(rets).count()
    if n:
        raise ValueError(f"the benchmark does not reach the price days of {n} events")


def return_basis(h: int, relative: bool = False) -> str:
    """L3: column used by the recent-event factors."""
    return f"exc_{h}" if relative else f"raw_{h}"


def is_target(flag: Column | str) -> Column:
    """A missing flag counts as a target."""
    return F.coalesce(F.col(flag) if isinstance(flag, str) else flag, F.lit(1)) != 0


def binary_label(y: Column | str) -> Column:
    """L5"""
    return ((F.col(y) if isinstance(y, str) else y) > 0).cast("int")


def training_rows(panel: DataFrame, main: int) -> DataFrame:
    """Rows whose main-horizon close exists."""
    return panel.where(F.col(f"d_{main}").isNotNull()).withColumn("label_end", F.col(f"d_{main}"))


def inference_rows(panel: DataFrame, main: int, at: str = "d") -> DataFrame:
    """Every row; the label end falls back to the event date."""
    return panel.withColumn("label_end", F.coalesce(f"d_{main}", at))


def new_only(panel: DataFrame, main: int) -> DataFrame:
    """P8"""
    return panel.where(F.col(f"y_{main}").isNull())
