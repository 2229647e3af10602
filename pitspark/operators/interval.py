"""Trailing-interval joins and aggregates.

History rows are reduced per (group, day) first and windows run over days, so a
window partition is bounded by the calendar and not by how many rows its group has.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def _day_window(by: Sequence[str], days: int):
    return W.partitionBy(*by).orderBy("_n").rangeBetween(-days, -1)


def trailing_aggregate(points: DataFrame, history: DataFrame, by: Sequence[str], at: str, ts: str,
                       spans: dict[str, int], sums: dict[str, str] | None = None) -> DataFrame:
    """Per distinct (by, at) of ``points``, the rows with at - w <= ts < at in the same group.

    Adds ``cnt_<span>`` and ``<name>_<span>`` for every named sum.
    """
    sums = sums or {}
    daily = history.groupBy(*by, F.col(ts).alias("_t")).agg(
        F.count(F.lit(1)).alias("_c"), *[F.sum(c).alias(f"_s_{m}") for m, c in sums.items()])
    marks = points.select(*by, F.col(at).alias("_t")).distinct().withColumn("_asked", F.lit(True))
    line = daily.join(marks, [*by, "_t"], "full").withColumn("_n", F.unix_date("_t"))
    cols = []
    for tag, days in spans.items():
        w = _day_window(by, days)
        cols.append(F.coalesce(F.sum("_c").over(w), F.lit(0)).alias(f"cnt_{tag}"))
        cols += [F.coalesce(F.sum(f"_s_{m}").over(w), F.lit(0.0)).alias(f"{m}_{tag}") for m in sums]
    return line.select(*by, F.col("_t").alias(at), "_asked", *cols).where("_asked").drop("_asked")


def top_k_recent(points: DataFrame, history: DataFrame, by: Sequence[str], at: str, ts: str,
                 tie: str, days: int, k: int, payload: Sequence[str]) -> DataFrame:
    """Per distinct (by, at), ``recent``: the k latest rows with at - days <= ts < at, newest
    first (later date, then larger tie). At most k rows per (group, day) can matter, and
    they are cut before the shuffle by Spark's window group limit. A day with rows holds the k latest ones up to
    it, which lie on the k last such days; a query takes those of the last day before it."""
    newest = W.partitionBy(*by, ts).orderBy(F.desc(tie))
    kept = (history.select(*by, ts, tie, *payload)
            .withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= k))
    item = F.struct(F.col(ts).alias("ts"), F.col(tie).alias("tie"), *payload)
    daily = (kept.groupBy(*by, F.col(ts).alias("_t"))
             .agg(F.array_sort(F.collect_list(item)).alias("_day")))
    order = W.partitionBy(*by).orderBy("_t")
    # days in order, and rows in order within a day: what is joined up is sorted already
    upto = F.flatten(F.collect_list("_day").over(order.rowsBetween(1 - k, 0)))
    daily = daily.select(*by, "_t", F.slice(F.reverse(upto), 1, k).alias("_top"))
    marks = points.select(*by, F.col(at).alias("_t")).distinct().withColumn("_asked", F.lit(True))
    line = daily.join(marks, [*by, "_t"], "full")
    none = F.array().cast(daily.schema["_top"].dataType)
    before = F.coalesce(F.last("_top", True).over(order.rowsBetween(W.unboundedPreceding, -1)), none)
    return (line.withColumn("_top", before).where("_asked").select(
        *by, F.col("_t").alias(at), F.filter("_top", lambda r: r["ts"] >= F.date_sub("_t", days)).alias("recent")))


def observable(recent: Column, at: Column, known: str) -> Column:
    """Of the k candidates, those whose outcome date is known strictly before ``at``. Applied
    after the cut to k, so an unobservable candidate still uses up a place."""
    return F.filter(recent, lambda r: r[known] < at)


def recent_stats(recent: DataFrame, by: Sequence[str], at: str, known: str, ret: str, weight: str,
                 tag: str) -> DataFrame:
    """A1 / A2 over the observable candidates of ``top_k_recent``; zeros when there are none."""
    seen = recent.select(*by, at, F.explode_outer(
        observable(F.col("recent"), F.col(at), known)).alias("r"))
    r, w = F.col("r")[ret], F.col("r")[weight]
    share = F.percentile(r, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    weighted = F.when(F.sum(F.when(r.isNotNull(), w)) > 0,
                      F.sum(r * w) / F.sum(F.when(r.isNotNull(), w))).otherwise(F.avg(r))
    got = seen.groupBy(*by, at).agg(
        share.alias("_p"), weighted.alias(f"vw_{tag}"), F.count(r).cast("double").alias(f"n_{tag}"),
        F.avg((r < 0).cast("double")).alias(f"break_{tag}"),
        F.avg(F.when(r < 0, r)).alias(f"depth_{tag}"))
    zero = {c: F.coalesce(c, F.lit(0.0)) for c in got.columns if c.endswith(f"_{tag}")}
    return got.withColumns(zero).withColumns({
        f"med_{tag}": F.coalesce(F.col("_p")[1], F.lit(0.0)),
        f"iqr_{tag}": F.coalesce(F.col("_p")[2] - F.col("_p")[0], F.lit(0.0))}).drop("_p")


def supply_stats(points: DataFrame, deals: DataFrame, events: DataFrame, by: Sequence[str], at: str,
                 ts: str, amount: str, short: int = 90, long: int = 365) -> DataFrame:
    """A4: deal count, log1p of the amount and event count in the short window, and the pace of the
    short window relative to the long one."""
    d = trailing_aggregate(points, deals, by, at, ts, {"s": short, "l": long}, {"amt": amount})
    e = trailing_aggregate(points, events, by, at, at, {"e": short})
    pace = F.greatest(F.col("cnt_l") * (short / long), F.lit(1.0))
    return (d.join(e, [*by, at])
            .select(*by, at, F.col("cnt_s").cast("double").alias("supply_cnt"),
                    F.log1p("amt_s").alias("supply_amt"),
                    F.col("cnt_e").cast("double").alias("supply_events"),
                    (F.col("cnt_s") / pace).alias("supply_accel")))


def member_share(events: DataFrame, long_members: DataFrame, by: Sequence[str], at: str, id_: str,
                 size: str, days: int) -> DataFrame:
    """A5: per (by, at, member) the member's summed size in the trailing window, where positive.

    Sizes are added per (group, member, day) first. A member is only laid out over the query
    days its window reaches, so the table holds exactly the active (day, member) cells.
    """
    return share_of(long_members.join(events.select(id_, *by, at, size), id_), by, at, size, days)


def share_of(own: DataFrame, by: Sequence[str], at: str, size: str, days: int) -> DataFrame:
    """``member_share`` of members that stand beside their events."""
    daily = own.groupBy(*by, "member", F.unix_date(at).alias("_n")).agg(
        F.sum(size).alias("_s"))
    asked_on = own.select(*by, F.unix_date(at).alias("_n")).distinct()
    step = W.partitionBy(*by, "member").orderBy("_n")
    reach = daily.withColumn("_until", F.least(
        F.col("_n") + days, F.coalesce(F.lead("_n").over(step), F.col("_n") + days)))
    # Every query day in (_n, _until] belongs to exactly one deal row of the member, so a member is laid
    # out over each day at most once.
    asked = (reach.select(*by, "member", F.explode(F.sequence(F.col("_n") + 1, F.col("_until")))
                          .alias("_n"))
             .join(asked_on, [*by, "_n"], "left_semi").withColumn("_asked", F.lit(True)))
    line = daily.join(asked, [*by, "member", "_n"], "full")
    w = W.partitionBy(*by, "member").orderBy("_n").rangeBetween(-days, -1)
    return (line.select(*by, "member", "_n", "_asked", F.sum("_s").over(w).alias("share"))
            .where("_asked and share > 0")
            .select(*by, F.date_from_unix_date("_n").alias(at), "member", "share"))


def last_n_mean(points: DataFrame, history: DataFrame, by: Sequence[str], at: str, ts: str,
                tie: str, known: str, value: str, n: int = 10, least: int = 3) -> DataFrame:
    """Mean of the n most recent observed rows, with unlimited look-back; null under ``least``.

    A row is visible to days after both its own date and its outcome date. Only the n latest rows of
    each (group, visibility day) can ever be among the n latest. Days are numbered, and every block of 1, 2, 4,
    ... days keeps its n latest rows; the days before a query are a few such blocks (one a set bit of its number).
    """
    by = list(by)
    vis = (history.where(F.col(known).isNotNull() & F.col(value).isNotNull())
           .select(*by, F.unix_date(F.greatest(ts, known)).alias("_v"), F.unix_date(ts).alias("_d"),
                   F.col(tie).alias("_tie"), F.col(value).cast("double").alias("_x")))
    latest = W.partitionBy(*by, "_v").orderBy(F.desc("_d"), F.desc("_tie"))
    vis = vis.withColumn("_rn", F.row_number().over(latest)).where(F.col("_rn") <= n).drop("_rn")
    marks = points.select(*by, F.unix_date(at).alias("_v")).distinct()
    days = vis.select(*by, "_v").unionByName(marks).distinct()
    days = days.withColumn("_i", (F.row_number().over(W.partitionBy(*by).orderBy("_v")) - 1).cast("int"))
    top = days.groupBy(*by).agg(F.max("_i").alias("_top"))
    days = days.join(top, by).withColumn("_l", F.explode(F.sequence(F.lit(0), F.floor(F.log2(F.col("_top") + 1)).cast("int"))))
    days = days.withColumn("_block", F.expr("shiftright(_i, _l)"))
    cell = [*by, "_l", "_block"]
    held = W.partitionBy(*cell).orderBy(F.desc("_d"), F.desc("_tie"))
    blocks = (vis.join(days, [*by, "_v"]).withColumn("_rn", F.row_number().over(held)).where(F.col("_rn") <= n)
              .select(*cell, "_d", "_tie", "_x"))
    asked = (marks.join(days, [*by, "_v"]).where("_block % 2 = 1")
             .select(*by, "_v", "_l", (F.col("_block") - 1).alias("_block")))
    seen = F.slice(F.sort_array(F.collect_list(F.struct("_d", "_tie", "_x")), asc=False), 1, n)
    got = asked.join(blocks, cell).groupBy(*by, "_v").agg(seen.alias("_seen"))
    got = marks.join(got, [*by, "_v"], "left")
    size = F.coalesce(F.size("_seen"), F.lit(0))
    total = F.aggregate(F.transform("_seen", lambda r: r["_x"]), F.lit(0.0), lambda s, x: s + x)
    return got.select(*by, F.date_from_unix_date("_v").alias(at), size.cast("long").alias("n_seen"),
                      F.when(size >= least, total / size).alias("mean_seen"))


def event_window(series: DataFrame, events: DataFrame, key: str, ts: str, at: str, id_: str,
                 first: int, last: int) -> DataFrame:
    """Per event, the series rows of its key with at + first <= ts <= at + last (days).

    Both sides meet in day buckets as wide as the window, so a key with a long history is never
    paired with all of its events.
    """
    width = last - first + 1
    block = F.floor(F.unix_date(ts) / width)
    lo, hi = F.unix_date(at) + first, F.unix_date(at) + last
    ev = (events.select(F.col(id_), F.col(key), F.col(at))
          .withColumn("_block", F.explode(F.sequence(F.floor(lo / width), F.floor(hi / width)))))
    return (series.withColumn("_block", block).join(ev, [key, "_block"])
            .where(F.unix_date(ts).between(lo, hi)).drop("_block"))
