"""Data contract (P1, C1-C15): a report of (severity, table_name, rule, n, detail).

Row rules of a table share one aggregation pass; group rules aggregate per key before anything is shuffled.
"""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pitspark.functions.ordering import quantiles, with_constants
from pitspark.functions.scalar import parse_day
from pitspark.operators.series import gap_days, with_series

SCHEMA = "severity string, table_name string, rule string, n bigint, detail string"


def require_columns(df: DataFrame, cols: Sequence[str], table: str = "table") -> DataFrame:
    """P1"""
    gone = [c for c in cols if c not in df.columns]
    if gone:
        raise ValueError(f"{table} is missing required columns {gone}")
    return df


def _row(severity: str | Column, table: str, rule: str, n: Column, detail: Column | str = "") -> list[Column]:
    def lit(x):
        return x if isinstance(x, Column) else F.lit(x)
    return [lit(severity).alias("severity"), F.lit(table).alias("table_name"), F.lit(rule).alias("rule"),
            n.cast("bigint").alias("n"), lit(detail).cast("string").alias("detail")]


def missing_columns(spark: SparkSession, tables: dict[str, DataFrame | None],
                    wanted: dict[str, Sequence[str]], optional: Sequence[str] = ()) -> DataFrame:
    """Absent tables and columns, found at plan time."""
    out = []
    for name, cols in wanted.items():
        df = tables.get(name)
        if df is None:
            kind = "info" if name in optional else "error"
            out.append((kind, name, "missing_table", 1, ""))
            continue
        out += [("error", name, "missing_column", 1, c) for c in cols if c not in df.columns]
    return spark.createDataFrame(out, SCHEMA)


def row_rules(df: DataFrame, table: str, id_: str | None = None, dates: Sequence[str] = (),
              positive: Sequence[str] = (), flags: Sequence[str] = (), positive_severity: str = "warning",
              target: str | None = None) -> DataFrame:
    """C2-C5, C7 in one pass over the table (duplicates: one grouped pass with a map-side combine)."""
    rules: list[tuple[str, str, Column]] = []
    for c in dates:
        rules.append(("error", f"unparseable:{c}", F.count_if(parse_day(c).isNull())))
    for c in positive:
        num = F.expr(f"try_cast(`{c}` as double)")
        rules.append(("error", f"not_numeric:{c}", F.count_if(num.isNull())))
        rules.append((positive_severity, f"not_positive:{c}", F.count_if(num <= 0)))
    for c in flags:
        rules.append(("error", f"not_flag:{c}", F.count_if(~F.coalesce(F.col(c).isin(0, 1), F.lit(False)))))
    if target:
        on = F.count_if(F.coalesce(F.col(target), F.lit(1)) != 0)
        rules += [("info", "target_rows", on), ("info", "universe_rows", F.count(F.lit(1)) - on),
                  ("error", "no_target_rows", (on == 0).cast("int"))]
    wide = df.agg(*[e.alias(f"r{i}") for i, (_, _, e) in enumerate(rules)])
    pairs = F.explode(F.array(*[F.struct(*_row(s, table, r, F.col(f"r{i}")))
                                for i, (s, r, _) in enumerate(rules)]))
    out = wide.select(pairs.alias("p")).select("p.*")
    if id_:
        dup = df.groupBy(id_).agg(F.count(F.lit(1)).alias("_n")).agg(F.count_if(F.col("_n") > 1).alias("d"))
        out = out.unionByName(dup.select(*_row("error", table, f"duplicate:{id_}", F.col("d"))))
    return out.where("n > 0")


def thin_groups(df: DataFrame, table: str, group: str, least: int = 30) -> DataFrame:
    """One line per group under ``least`` rows."""
    got = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") < least)
    return got.select(*_row("warning", table, "thin_group", F.col("_n"), F.col(group)))


def path_coverage(events: DataFrame, prices: DataFrame, id_: str = "id", least: int = 22) -> DataFrame:
    """Events without price rows and with fewer than ``least``."""
    have = prices.groupBy(id_).agg(F.count(F.lit(1)).alias("_n"))
    got = events.select(id_).join(have, id_, "left").agg(
        F.count_if(F.col("_n").isNull()).alias("none"),
        F.count_if(F.coalesce("_n", F.lit(0)) < least).alias("short"))
    return (got.select(*_row("warning", "prices", "no_price_rows", F.col("none"))).unionByName(
        got.select(*_row("warning", "prices", "short_path", F.col("short"))))).where("n > 0")


def uncovered_groups(events: DataFrame, series: DataFrame, table: str, group: str = "grp") -> DataFrame:
    """Event groups without any series row."""
    gone = events.select(group).distinct().join(series.select(group).distinct(), group, "left_anti")
    return gone.select(*_row("error", table, "no_series", F.lit(1), F.col(group)))


def sparse_series(series: DataFrame, table: str, by: Sequence[str], date: str = "date",
                  limit: float = 4) -> DataFrame:
    """C11: series whose median gap is over ``limit`` days."""
    gaps = with_series(series.select(*by, date).distinct(), by, date, {"_g": gap_days(date)})
    mid = quantiles(gaps.withColumn("_g", F.col("_g").cast("double")), by, "_g", {"_m": 0.5})
    who = F.concat_ws("/", *[F.col(c).cast("string") for c in by]) if by else F.lit("")
    return mid.where(F.col("_m") > limit).select(*_row("warning", table, "not_daily", F.floor("_m"), who))


def late_series(events: DataFrame, series: DataFrame, table: str, by: Sequence[str], at: str = "d",
                date: str = "date") -> DataFrame:
    """Series that start on or after the first event they serve."""
    by = list(by)
    first = events.groupBy(*by).agg(F.min(at).alias("_e"))
    start = series.groupBy(*by).agg(F.min(date).alias("_s"))
    both = first.join(start, by) if by else with_constants(first, start)
    who = F.concat_ws("/", *[F.col(c).cast("string") for c in by]) if by else F.lit("")
    return both.where("_s >= _e").select(*_row("error", table, "starts_late", F.datediff("_s", "_e"), who))


def late_children(children: DataFrame, events: DataFrame, table: str, id_: str = "id", asof: str = "asof",
                  at: str = "d") -> DataFrame:
    """C14: child rows without a knowledge date or with one not before the event."""
    if asof not in children.columns:
        return children.sparkSession.createDataFrame([("error", table, "no_asof", 1, asof)], SCHEMA)
    got = children.join(events.select(id_, at), id_).agg(
        F.count_if(F.col(asof) >= F.col(at)).alias("late"), F.count_if(F.col(asof).isNull()).alias("null"))
    return got.select(*_row("error", table, "asof_not_before", F.col("late"))).unionByName(
        got.select(*_row("error", table, "asof_null", F.col("null")))).where("n > 0")


def coverage(df: DataFrame, table: str, id_: str, cols: Sequence[str] = ()) -> DataFrame:
    """Distinct ids, rows and non-null counts."""
    wide = df.agg(F.countDistinct(id_).alias("ids"), F.count(F.lit(1)).alias("rows"),
                  *[F.count(c).alias(f"has:{c}") for c in cols])
    return wide.select(F.explode(F.array(*[F.struct(*_row("info", table, c, F.col(f"`{c}`")))
                                           for c in wide.columns])).alias("p")).select("p.*")


REQUIRED = {"events": ["id", "d", "grp", "offer", "size"], "prices": ["id", "date", "close"], "bench": ["date", "close"],
            "risk": ["date", "v"], "deals": ["date", "grp", "proceeds"], "macro": ["date", "grp"], "macro_global": ["date"],
            "peers": ["id", "ret_21d"], "members": ["id", "member"], "dictionary": ["member", "class", "home"]}
OPTIONAL = ("deals", "macro", "macro_global", "peers", "members", "dictionary")
WANTED = {"macro": ["vol_index", "fx"], "macro_global": ["vix", "hy_oas", "em", "acwi"], "peers": ["ret_63d"]}


def check(tables: dict[str, DataFrame | None], flags: Sequence[str] = (), least_group: int = 30,
          least_path: int = 22) -> DataFrame:
    """The whole contract over the logical tables, one report. A table with missing required columns is
    reported and left out of the rules that need them. Every rule of a table's rows comes from one pass over
    it; groups, paths and child rows are counted before they are joined."""
    spark = next(t for t in tables.values() if t is not None).sparkSession
    report = missing_columns(spark, tables, REQUIRED, OPTIONAL)
    ready = {n: t for n, t in tables.items() if t is not None and set(REQUIRED.get(n, [])) <= set(t.columns)}
    parts = [report]
    events = ready.get("events")
    if events is not None:
        parts += [row_rules(events, "events", "id", ["d"], ["offer", "size"], flags,
                            target="is_target" if "is_target" in events.columns else None),
                  thin_groups(events, "events", "grp", least_group)]
        events = events.withColumn("d", parse_day("d"))
    if "prices" in ready:
        parts.append(row_rules(ready["prices"], "prices", None, ["date"], ["close"], positive_severity="error"))
        if events is not None:
            parts.append(path_coverage(events, ready["prices"], least=least_path))
    for name in ("bench", "risk"):
        if name not in ready:
            continue
        by = ["grp"] if "grp" in ready[name].columns else []
        parts.append(row_rules(ready[name], name, None, ["date"]))
        dated = ready[name].withColumn("date", parse_day("date")).where("date is not null")
        parts.append(sparse_series(dated, name, by))
        if events is not None:
            parts.append(late_series(events, dated, name, by))
            if by:
                parts.append(uncovered_groups(events, dated, name))
    if events is not None and "peers" in ready:
        parts.append(late_children(ready["peers"], events, "peers"))
    for name in ("macro", "macro_global", "peers"):
        if name in ready:
            parts.append(coverage(ready[name], name, "id" if name == "peers" else "date",
                                  [c for c in WANTED[name] if c in ready[name].columns]))
    return reduce(DataFrame.unionByName, parts)


def require_contract(report: DataFrame) -> DataFrame:
    """Raise with every error line of a report."""
    bad = report.where("severity = 'error'").orderBy("table_name", "rule", "detail").limit(50).collect()
    if bad:
        raise ValueError("the tables break the contract:\n" + "\n".join(
            f"- {r['table_name']}: {r['rule']} {r['detail']} ({r['n']})" for r in bad))
    return report


def failed(report: DataFrame) -> bool:
    """Exit status: any error line."""
    return bool(report.where("severity = 'error'").take(1))
