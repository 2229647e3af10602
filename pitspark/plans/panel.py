"""The feature panel (L6): every factor of every event, then the rows to model."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, functions as F

from pitspark.functions.scalar import fill_zero
from pitspark.operators import contract, expanding, interval, labels, members, series
from pitspark.operators.asof import asof_lookup, require_pit, series_keys
from pitspark.session import durable

SPAN_TAG = {1: "1d", 3: "3d", 5: "1w", 21: "1m"}
RISK = ["risk_level", "risk_d5", "risk_dw", "risk_mean", "risk_std", "risk_vol63"]


@dataclass
class Tables:
    """Logical inputs. Optional ones left out switch their features off.

    events: id, d, grp, offer, size, is_target and flags; prices: id, date, close;
    bench: [grp,] date, close; risk: date, v; deals: date, grp, proceeds; macro: grp, date and any of
    vol_index, fx; macro_global: date and any of vix, hy_oas, em, acwi; peers: id, ret_21d, ret_63d, asof;
    members: id, member; dictionary: member, class, home, with the class names, label rules and further flags
    of the member block. ``zero`` names event columns whose missing values count as 0 (P3).
    """

    events: DataFrame
    prices: DataFrame
    bench: DataFrame
    risk: DataFrame | None = None
    deals: DataFrame | None = None
    macro: DataFrame | None = None
    macro_global: DataFrame | None = None
    peers: DataFrame | None = None
    members: DataFrame | None = None
    dictionary: DataFrame | None = None
    price_tie: Sequence[str] = ()
    class_names: Sequence[str] = ()
    rules: Sequence[tuple[str, str]] = ()
    flags: dict[str, str] = field(default_factory=dict)
    zero: Sequence[str] = ("size",)


def one_hot(df: DataFrame, col: str, prefix: str, names: Sequence[str]) -> DataFrame:
    """One 0/1 column for each of ``names``, in sorted order."""
    names = sorted(names)
    return df.withColumns({f"{prefix}{v}": F.coalesce(F.col(col) == v, F.lit(False)).cast("int")
                           for v in names})


def select_groups(df: DataFrame, groups: Sequence[str], keep: Sequence[str] = ("id",)) -> DataFrame:
    """Feature columns whose name before the first "_" is listed; what is not selected is not planned."""
    return df.select(*keep, *[c for c in df.columns if c not in keep and c.split("_")[0] in groups])


def recent_factors(t: Tables, rets: DataFrame, spans: Sequence[int] = (1, 5), days: int = 90, k: int = 10,
                   relative: bool = False) -> DataFrame:
    """f1 / f2 per (grp, d) for each span; ``rets`` are the events with their returns."""
    basis = {h: labels.return_basis(h, relative) for h in spans}
    hist = rets.select("id", "grp", "d", F.coalesce("size", F.lit(0.0)).alias("size"), *[f"d_{h}" for h in spans], *basis.values())
    recent = interval.top_k_recent(t.events, hist, ["grp"], "d", "d", "id", days, k,
                                   ["size", *[f"d_{h}" for h in spans], *basis.values()])
    out = None
    for h in spans:
        tag = SPAN_TAG.get(h, f"{h}d")
        s = interval.recent_stats(recent, ["grp"], "d", f"d_{h}", basis[h], "size", "x")
        s = s.select("grp", "d", *[F.col(f"{a}_x").alias(f"{b}_{tag}") for a, b in (
            ("med", "f1_med"), ("vw", "f1_vw"), ("n", "f1_n"), ("iqr", "f1_iqr"),
            ("break", "f2_break"), ("depth", "f2_depth"))])
        out = s if out is None else out.join(s, ["grp", "d"])
    return out


def bench_factors(bench: DataFrame) -> DataFrame:
    by = series_keys(bench, ["grp"])
    s = series.with_series(bench, by, "date", {"_x": series.log_step("close")})
    return series.with_series(s, by, "date", {
        "m_geo_mom_63d": series.log_ret("close", 63), "m_geo_dd_252": series.drawdown("close"),
        "m_geo_rvol_21d": series.realised_vol("_x")}).drop("_x", "close")


def macro_factors(macro: DataFrame) -> DataFrame:
    exprs = {}
    if "vol_index" in macro.columns:
        exprs["m_vol_index_z"] = series.rolling_z("vol_index")
    if "fx" in macro.columns:
        exprs["m_fx_ret_21d"] = series.log_ret("fx", 21)
    return series.with_series(macro, ["grp"], "date", exprs).select("grp", "date", *exprs)


def global_factors(glob: DataFrame) -> DataFrame:
    exprs = {}
    if "vix" in glob.columns:
        exprs |= {"m_vix_z": series.rolling_z("vix"), "m_vix_chg_21d": series.pct_change("vix", 21)}
    if "hy_oas" in glob.columns:
        exprs["m_hy_oas_z"] = series.rolling_z("hy_oas")
    if {"em", "acwi"} <= set(glob.columns):
        exprs["m_em_vs_dm_63d"] = series.ret_spread("em", "acwi", 63)
    return series.with_series(glob, [], "date", exprs).select("date", *exprs)


def risk_factors(risk: DataFrame, window: int = 21) -> DataFrame:
    s = series.with_series(risk, [], "date", {"_dv": series.step("v")})
    s = series.with_series(s, [], "date", {"risk_seq": series.window_array("v", window),
                                           "risk_vol63": series.change_vol("_dv")})
    return s.withColumns(series.sequence_summaries("risk_seq", "risk")).select("date", "risk_seq", *RISK)


def _before(points: DataFrame, table: DataFrame, by: Sequence[str]) -> DataFrame:
    """Last series row strictly before each distinct (by, d); numbers default to 0."""
    names = [c for c in table.columns if c not in (*by, "date")]
    look = asof_lookup(points, table, by, "d", "date", names)
    zero = {c for c, kind in table.dtypes if kind == "double"}
    return look.select(*by, "d", *[
        F.coalesce(F.col(f"before.{c}"), F.lit(0.0)).alias(c) if c in zero else F.col(f"before.{c}").alias(c)
        for c in names])


def day_factors(t: Tables, rets: DataFrame, spans: Sequence[int] = (1, 5), relative: bool = False) -> DataFrame:
    """Every factor that depends only on (grp, d): one row per group and event day, so these joins are bounded
    by the calendar and the events are joined once."""
    ev = t.events.select("id", "grp", "d")
    by = series_keys(t.bench, ["grp"])
    days = ev.select("grp", "d").distinct()
    out = days.join(recent_factors(t, rets, spans, relative=relative), ["grp", "d"], "left")
    deals = t.deals if t.deals is not None else t.events.select(
        F.col("d").alias("date"), "grp", F.coalesce("size", F.lit(0.0)).alias("proceeds"))
    out = out.join(interval.supply_stats(ev, deals, ev, ["grp"], "d", "date", "proceeds"), ["grp", "d"], "left")
    out = out.join(_before(days, bench_factors(t.bench), by), [*by, "d"], "left")
    if t.macro is not None:
        out = out.join(_before(days, macro_factors(t.macro), ["grp"]), ["grp", "d"], "left")
    if t.macro_global is not None:
        out = out.join(_before(days, global_factors(t.macro_global), []), ["d"], "left")
    if t.risk is not None:
        out = out.join(_before(days, risk_factors(t.risk), []), ["d"], "left")
    return out


def supply_z(rows: DataFrame) -> DataFrame:
    names = {"f3_cnt_3m": "supply_cnt", "f3_prc_3m": "supply_amt", "f3_event_cnt_3m": "supply_events",
             "f3_accel": "supply_accel"}
    return expanding.expanding_z_daily(rows, ["grp"], "d", "id", names).drop(*names.values())


def regime_flags(t: Tables, rets: DataFrame, n: int = 10) -> DataFrame:
    """m_regime_hot / cold per event: mean first return of recent events against its own history."""
    pops = interval.last_n_mean(t.events, rets.select("id", "grp", "d", "d_1", "raw_1"), ["grp"], "d", "d", "id", "d_1", "raw_1", n)
    flag = expanding.expanding_terciles(t.events.select("id", "grp", "d"), pops, ["grp"], "d", "id",
                                        "mean_seen", "_f")
    return flag.select("id", (F.col("_f") == 1).cast("double").alias("m_regime_hot"),
                       (F.col("_f") == -1).cast("double").alias("m_regime_cold"))


def member_features(t: Tables, years: float = 3) -> DataFrame:
    """Syndicate block and prestige per event."""
    own = durable(t.members.join(t.events.select("id", "grp", "d", "size"), "id"))
    out = members.rank_max_of(t.events, own, ["grp"], "d", "id", "size", years)
    if t.dictionary is not None:
        cls = durable(members.classify_members(own, t.dictionary))      # a row per member
        out = out.join(members.block_of(t.events, own, cls, "id", "grp", t.class_names, t.rules, t.flags), "id")
    return out


def assemble_panel(t: Tables, horizons: Sequence[int] = labels.HORIZONS, anchor: str = "offer",
                   adjust: bool = True, spans: Sequence[int] = (1, 5), relative: bool = False,
                   inference: bool = False) -> DataFrame:
    """Factors for every event, universe rows included; only then the rows to model.

    Filtering first would change every expanding and trailing statistic, so the target and label
    filters come last. ``inference`` keeps target rows without a label (P7). Events and their closes
    feed every factor, so they meet once and are written once. A benchmark that
    does not reach a price day is an error, as its rows would have no label.
    """
    main = max(horizons)
    labels.require_anchor(horizons, anchor)
    own = t.events.columns
    hs = {*horizons, *spans}
    paths = labels.event_paths(fill_zero(t.events, [c for c in t.zero if c in own]), t.prices, hs, t.price_tie)
    t = replace(t, events=paths.select(*own))
    paths = labels.benchmarked(paths, t.bench, hs)

    def returns(hs, how):
        return paths.select(*own, *labels.measured(hs, how, adjust))

    rets = returns(sorted({*horizons, *spans, 1}) if anchor == "offer" else horizons, anchor)
    labels.require_benchmark(rets)
    first = rets if anchor == "offer" else returns(sorted({1, *spans}), "offer")
    # one row per group and day, read twice; rows are numbered with the supply factors only, the others come last
    day = durable(day_factors(t, first, spans, relative and adjust))
    supply = [c for c in day.columns if c.startswith("supply_")]
    ys = [c for h in sorted(horizons) for c in (f"y_{h}", f"d_{h}")]
    events = rets.select(*own, *ys)
    rows = supply_z(events.join(day.select("grp", "d", *supply), ["grp", "d"], "left")).join(regime_flags(t, first), "id")
    if t.members is not None:
        rows = rows.join(member_features(t), "id", "left")
    if t.peers is not None:
        p1 = members.peer_stats(t.events, t.peers, "id")
        rows = rows.join(p1.toDF("id", "p1_n", "p1_med_21d", "p1_iqr_21d", "p1_med_63d"), "id", "left")
    rows = rows.select(*[c for c in rows.columns if c not in ys], *ys)
    rows = labels.inference_rows(rows, main) if inference else labels.training_rows(rows, main)
    return rows.where(labels.is_target("is_target")).join(day.drop(*supply), ["grp", "d"], "left")


def checked_panel(t: Tables, **options) -> DataFrame:
    """L6 after the contract (C0): any error line raises with the whole list, before a feature is computed."""
    contract.require_contract(contract.check(
        {n: getattr(t, n) for n in contract.REQUIRED}, [c for c in ("flag_a", "flag_b") if c in t.events.columns]))
    if t.peers is not None:
        require_pit(t.peers, t.events, "id", "asof", "d")
    return assemble_panel(t, **options)
