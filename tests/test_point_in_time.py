"""No factor may see its own day or later, and deleting the future must not change the past."""
import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pitspark.operators import asof, expanding, interval, labels, members, series
from tests.conftest import day


@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.default_rng(3)
    n = 240
    ev = pd.DataFrame({"id": np.arange(n), "d": [day(x) for x in np.sort(rng.integers(60, 400, n))],
                       "grp": rng.choice(["a", "b"], n, p=[0.7, 0.3]), "size": rng.lognormal(3, 1, n).round(2),
                       "offer": rng.lognormal(2, 0.3, n)})
    px = pd.DataFrame([(i, d + dt.timedelta(days=int(k) + int(i % 4 == 0) * 7), float(rng.lognormal(2, 0.4)))
                       for i, d in zip(ev.id, ev.d) if i % 9 for k in range(1 + i % 6)], columns=["id", "date", "close"])
    bm = pd.DataFrame([(g, day(x), 100 * float(np.exp(rng.normal(0, 0.2)))) for g in "ab" for x in range(0, 420, 2)],
                      columns=["grp", "date", "close"])
    return ev, px, bm


def frames(spark, world, until=None):
    ev, px, bm = world
    if until:
        ev, px, bm = ev[ev.d < until], px[px.date < until], bm[bm.date < until]
    return (spark.createDataFrame(ev), spark.createDataFrame(px, "id bigint, date date, close double"),
            spark.createDataFrame(bm, "grp string, date date, close double"))


def factors(spark, world, until=None):
    ev, px, bm = frames(spark, world, until)
    ret = labels.returns(ev, px, bm, (1, 3))
    hist = ev.join(ret, "id", "left")
    recent = interval.top_k_recent(ev, hist, ["grp"], "d", "d", "id", 90, 5, ["size", "d_1", "raw_1"])
    f1 = interval.recent_stats(recent, ["grp"], "d", "d_1", "raw_1", "size", "x")
    pops = interval.last_n_mean(ev, hist, ["grp"], "d", "d", "id", "d_1", "raw_1", 4)
    reg = expanding.expanding_terciles(ev, pops, ["grp"], "d", "id", "mean_seen", "regime").select("id", "regime")
    z = expanding.expanding_z(ev.join(f1, ["grp", "d"]), ["grp"], "d", "id", {"z": "size"})
    return (z.join(pops, ["grp", "d"]).join(reg, "id").toPandas().set_index("id").sort_index())


def test_prefix_stability(spark, world):
    cut = day(250)
    full, part = factors(spark, world), factors(spark, world, cut)
    full = full[full.d < cut]
    assert list(full.index) == list(part.index) and len(part) > 50
    for c in ("med_x", "vw_x", "n_x", "iqr_x", "break_x", "depth_x", "z", "mean_seen", "regime"):
        np.testing.assert_allclose(full[c].astype(float), part[c].astype(float), atol=1e-9)


def test_recent_stats_cut_to_k_before_observability(spark, world):
    ev, px, _ = world
    got = factors(spark, world)
    paths = {i: g.sort_values("date") for i, g in px.groupby("id")}
    for i, row in got.iterrows():
        t0 = row.d
        pool = ev[(ev.grp == row.grp) & (ev.d < t0) & (ev.d >= t0 - dt.timedelta(days=90))]
        pool = pool.sort_values(["d", "id"], ascending=False).head(5)
        seen = [(np.log(paths[j].close.iloc[0] / o), s) for j, o, s in zip(pool.id, pool.offer, pool["size"])
                if j in paths and paths[j].date.iloc[0] < t0]
        r = np.array([x[0] for x in seen])
        assert row.n_x == len(r)
        np.testing.assert_allclose(row.med_x, np.median(r) if len(r) else 0, atol=1e-9)
        if len(r):
            w = np.array([x[1] for x in seen])
            np.testing.assert_allclose(row.vw_x, (r * w).sum() / w.sum(), atol=1e-9)
            np.testing.assert_allclose(row.iqr_x, np.percentile(r, 75) - np.percentile(r, 25), atol=1e-9)
        past = ev[(ev.grp == row.grp) & (ev.d < t0)].sort_values(["d", "id"], ascending=False)
        pops = [np.log(paths[j].close.iloc[0] / o) for j, o in zip(past.id, past.offer)
                if j in paths and paths[j].date.iloc[0] < t0][:4]
        assert (pd.isna(row.mean_seen) and len(pops) < 3) or abs(row.mean_seen - np.mean(pops)) < 1e-9


def test_expanding_z_and_regime_by_row(spark, world):
    got = factors(spark, world)
    for _, g in got.reset_index().sort_values(["d", "id"]).groupby("grp"):
        xs, known = [], []
        for r in g.itertuples():
            xs.append(g.loc[g.id == r.id, "size"].iloc[0])
            r_size = xs[-1]
            want = (r_size - np.mean(xs[:-1])) / np.std(xs[:-1], ddof=1) if len(xs) > 2 else 0.0
            assert abs(r.z - want) < 1e-8
            flag = 0
            if not pd.isna(r.mean_seen):
                s, n = sorted(known), len(known)
                if n >= 5:
                    hi, lo = s[int(2 * n / 3)], s[int(n / 3)]
                    flag = 1 if r.mean_seen > hi else -1 if r.mean_seen < lo else 0
                known.append(r.mean_seen)
            assert r.regime == flag


def test_asof_kinds(spark):
    left = spark.createDataFrame([(1, "a", day(1)), (2, "a", day(3)), (3, "a", day(4)), (4, "b", day(9))],
                                 "id int, g string, t date")
    right = spark.createDataFrame([("a", day(1), 1.0), ("a", day(3), 3.0)], "g string, s date, v double")

    def run(df):
        return {r.id: r.v for r in df.collect()}

    assert run(asof.asof_join(left, right, ["g"], "t", "s", ["v"])) == {1: None, 2: 1.0, 3: 3.0, 4: None}
    assert run(asof.asof_join(left, right, ["g"], "t", "s", ["v"], strict=False)) == {1: 1.0, 2: 3.0, 3: 3.0, 4: None}
    assert run(asof.asof_join_fallback(left, right, ["g"], "t", "s", ["v"])) == {1: 1.0, 2: 1.0, 3: 3.0, 4: None}
    with pytest.raises(ValueError):
        asof.require_matched(asof.asof_join(left, right, ["g"], "t", "s", ["v"], strict=False), "v")


def test_asof_in_slices_equals_one_window(spark):
    t = F.timestamp_seconds
    left = spark.range(400).select(F.col("id"), (F.col("id") % 2).alias("g"), t(F.col("id") * 7919 % 500000).alias("t"))
    right = spark.range(300).select((F.col("id") % 2).alias("g"), t(F.col("id") * 104729 % 500000).alias("s"),
                                    F.col("id").cast("double").alias("v"))
    for strict in (True, False):
        a = asof.asof_join(left, right, ["g"], "t", "s", ["v"], strict)
        b = asof.asof_join(left, right, ["g"], "t", "s", ["v"], strict, slice_by="hour")
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_child_rows_must_predate_events(spark):
    ev = spark.createDataFrame([(1, day(5))], "id int, d date")
    ok = spark.createDataFrame([(1, day(4))], "id int, asof date")
    asof.require_pit(ok, ev, "id", "asof", "d")
    for bad in ([(1, day(5))], [(1, None)]):
        with pytest.raises(ValueError):
            asof.require_pit(spark.createDataFrame(bad, "id int, asof date"), ev, "id", "asof", "d")
    with pytest.raises(ValueError):
        asof.require_pit(ok.drop("asof"), ev, "id", "asof", "d")


def test_chunked_series_equals_one_window(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame([(g, day(i), float(rng.lognormal())) for g in "ab" for i in range(300)], columns=["g", "t", "v"])
    df = spark.createDataFrame(pdf, "g string, t date, v double")
    ex = {"r": series.log_ret("v", 5), "z": series.rolling_z("v", 60), "dd": series.drawdown("v", 60),
          "a": series.window_array("v", 6)}
    a = series.with_series(df, ["g"], "t", ex).toPandas().sort_values(["g", "t"])
    b = series.with_series(df, ["g"], "t", ex, chunk=70).toPandas().sort_values(["g", "t"])
    assert len(a) == len(b) == 600
    for c in ("r", "z", "dd"):
        np.testing.assert_allclose(a[c], b[c], atol=1e-9)
    assert [list(x) for x in a.a] == [list(x) for x in b.a]
    first = a.iloc[0]
    assert list(first.a) == [first.v] * 6


def test_tercile_example(spark):
    xs = [1.0, 2.0, 3.0, 4.0, 5.0, 100.0, -100.0, 3.0]
    ev = spark.createDataFrame([(i, "a", day(i)) for i in range(len(xs))], "id int, g string, d date")
    st = spark.createDataFrame([("a", day(i), x) for i, x in enumerate(xs)], "g string, d date, x double")
    got = expanding.expanding_terciles(ev, st, ["g"], "d", "id", "x", "f").orderBy("id").collect()
    assert [r.f for r in got] == [0, 0, 0, 0, 0, 1, -1, 0]


def test_first_close_anchor_rejects_horizon_one(spark, world):
    with pytest.raises(ValueError):
        labels.returns(*frames(spark, world), horizons=(1, 3), anchor="first_close")


def test_event_window_and_peer_returns(spark):
    path = spark.createDataFrame([("k", day(i), float(np.exp(i / 100))) for i in range(100)], "k string, t date, v double")
    ev = spark.createDataFrame([(1, "k", day(70)), (2, "k", day(30)), (3, "k", day(5))], "id int, k string, d date")
    got = interval.event_window(path, ev, "k", "t", "d", "id", -80, -1)
    assert {r.id: r["count"] for r in got.groupBy("id").count().collect()} == {1: 70, 2: 30, 3: 5}
    ret = {r.id: r for r in series.peer_trailing_returns(got, ["id"], "t", "v").collect()}
    assert set(ret) == {1, 2} and ret[2].ret_63d is None
    assert abs(ret[1].ret_21d - 0.21) < 1e-6 and abs(ret[1].ret_63d - 0.63) < 1e-6 and ret[1].asof == day(69)


def test_a_series_expression_reaches_as_far_as_it_says(spark):
    rng = np.random.default_rng(4)
    rows = [(i, float(v)) for i, v in enumerate(rng.lognormal(size=900))]
    df = spark.createDataFrame(rows, "i long, v double").select(F.timestamp_seconds(F.col("i") * 60).alias("t"), "v")
    ex = {"d": series.drawdown("v", 504), "r": series.log_ret("v", 300)}
    a, b = (series.with_series(df, [], "t", ex, chunk=c).toPandas().sort_values("t") for c in (None, 510))
    for c in ex:
        np.testing.assert_allclose(a[c], b[c], atol=1e-12)
    with pytest.raises(ValueError, match="503"):
        series.with_series(df, [], "t", ex, chunk=400)
    with pytest.raises(ValueError, match="text"):
        series.with_series(df.withColumn("t", F.col("t").cast("string")), [], "t", ex)


def test_expanding_z_has_no_spread_in_a_constant_stretch(spark):
    rng = np.random.default_rng(9)
    rows = []
    for g in range(20):
        level = float(rng.normal() * 1e3)
        rows += [(g, day(i), k, level) for i in range(30) for k in range(2)]
        rows += [(g, day(40 + i), k, level + 7.0 * (i + 1)) for i in range(5) for k in range(2)]
    df = spark.createDataFrame(rows, "g int, d date, id int, v double")
    for f in (expanding.expanding_z, expanding.expanding_z_daily):
        got = f(df, ["g"], "d", "id", {"z": "v"}).toPandas().sort_values(["g", "d", "id"])
        for _, one in got.groupby("g"):
            v, z = one.v.to_numpy(), one.z.to_numpy()
            assert (z[:61] == 0).all()                      # the first row after the jump has seen one value only
            for i in range(61, len(v)):
                assert abs(z[i] - (v[i] - v[:i].mean()) / v[:i].std(ddof=1)) < 1e-6
        early = f(df.where(F.col("d") < day(41)), ["g"], "d", "id", {"z": "v"}).toPandas().sort_values(["g", "d", "id"])
        np.testing.assert_array_equal(early.z, got[got.d < day(41)].z)   # later rows change nothing


def test_peers_of_a_universe_that_repeats_tickers(spark):
    ev = spark.createDataFrame([(1, "T", "s", "g")], "id int, ticker string, subgroup string, grp string")
    rows = [("T", "s", "g", 9.0 + i) for i in range(5)] + [("A", "s", "g", 2.0), ("B", "s", "g", 1.0), ("B", "s", "g", 0.5)]
    universe = spark.createDataFrame(rows, "ticker string, subgroup string, grp string, cap double")
    got = members.peer_select(ev, universe, "id", "ticker", "subgroup", "grp", 2).orderBy("place").collect()
    assert [r.peer for r in got] == ["A", "B"]


def test_a_benchmark_that_starts_late_is_an_error(spark):
    ev = spark.createDataFrame([(1, "g", 10.0), (2, "g", 10.0)], "id int, grp string, offer double")
    px = spark.createDataFrame([(1, day(0), 11.0), (2, day(9), 11.0)], "id int, date date, close double")
    bench = spark.createDataFrame([(day(5), 100.0)], "date date, close double")
    rets = labels.returns(ev, px, bench, [1])
    assert [r.id for r in labels.uncovered(rets).collect()] == [1]
    with pytest.raises(ValueError, match="1 events"):
        labels.require_benchmark(rets)


def test_trailing_returns_of_shared_series_equal_those_of_paths(spark):
    r = np.random.default_rng(1)
    days = sorted(r.choice(400, 230, replace=False).tolist())
    series_ = spark.createDataFrame([(g, day(d), float(r.uniform(1, 9))) for g in "ab" for d in days], "g string, date date, p double")
    events = spark.createDataFrame([(i, "abc"[i % 3], day(r.integers(-10, 430))) for i in range(120)], "id long, g string, d date")
    paths = interval.event_window(series_, events, "g", "date", "d", "id", -140, -1)
    want = series.peer_trailing_returns(paths, ["id", "g"], "date", "p")
    got = series.trailing_returns(series_, events, ["g"], "date", "p", "d", "id")
    cols = ["id", "g", "ret_21d", "ret_63d", "asof"]
    a, b = (sorted(map(tuple, x.select(cols).collect())) for x in (got, want))
    assert a == b and len(a) > 50 and any(x[3] is None for x in a)


def test_contract_report_and_guard(spark):
    from pitspark.operators import contract
    ev = spark.createDataFrame([(i, f"2020-01-{1 + i % 28:02d}", "a", "1.5", "2", 1) for i in range(40)] + [(0, "x", "b", "-1", "z", 2)],
                               "id long, d string, grp string, offer string, size string, flag int")
    px = spark.createDataFrame([(i, day(i), 1.0) for i in range(30)], "id long, date date, close double")
    bench = spark.createDataFrame([("a", day(-5 + 7 * i), 1.0) for i in range(9)], "grp string, date date, close double")
    tables = {"events": ev, "prices": px, "bench": bench, "risk": None, "peers": px.select("id", F.lit(0.1).alias("ret_21d"))}
    got = {(x.severity, x.table_name, x.rule, x.n, x.detail) for x in contract.check(tables, ["flag"]).collect()}
    assert got >= {("error", "risk", "missing_table", 1, ""), ("info", "deals", "missing_table", 1, ""),
                   ("error", "events", "duplicate:id", 1, ""), ("error", "events", "unparseable:d", 1, ""),
                   ("error", "events", "not_numeric:size", 1, ""), ("warning", "events", "not_positive:offer", 1, ""),
                   ("error", "events", "not_flag:flag", 1, ""), ("warning", "events", "thin_group", 1, "b"),
                   ("warning", "prices", "no_price_rows", 10, ""), ("error", "bench", "no_series", 1, "b"),
                   ("warning", "bench", "not_daily", 7, "a"), ("error", "peers", "no_asof", 1, "asof")}
    with pytest.raises(ValueError, match="duplicate:id"):
        contract.require_contract(contract.check(tables, ["flag"]))
    no_prices = contract.check({"events": ev.drop("offer"), "prices": None}).collect()
    assert {(x.rule, x.detail) for x in no_prices} >= {("missing_column", "offer"), ("missing_table", "")}


def test_events_and_closes_meet_once(spark):
    """Returns beside the events equal ``returns``, for every anchor, and reading them shuffles nothing."""
    events = spark.createDataFrame([(i, f"g{i % 2}", day(i % 9), None if i == 5 else 10.0 + i) for i in range(30)],
                                   "id int, grp string, d date, offer double")
    prices = spark.createDataFrame([(i, day(i % 9 + k), 11.0 + i + k * (i % 4)) for i in range(32) for k in range(i % 5)],
                                   "id int, date date, close double")
    bench = spark.createDataFrame([(g, day(k), 50.0 + k * (1 + int(g[1]))) for g in ("g0", "g1") for k in range(0, 14, 2)],
                                  "grp string, date date, close double")
    for series in (bench, bench.where("grp = 'g0'").drop("grp")):
        paths = labels.benchmarked(labels.event_paths(events, prices, (1, 2, 3)), series, (1, 2, 3))
        assert "Exchange hashpartitioning" not in paths._jdf.queryExecution().executedPlan().toString()
        for hs, anchor in (((1, 3), "offer"), ((2, 3), "first_close")):
            want = labels.returns(events, prices, series, hs, anchor)
            got = paths.select("id", *labels.measured(hs, anchor)).where("c_1 is not null")
            assert got.columns == want.columns
            assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_peer_stats_of_events_with_many_peers(spark, monkeypatch):
    from pitspark.operators import members
    events = spark.createDataFrame([(i,) for i in range(8)], "id int")
    rows = [(i, None if (i + k) % 5 == 0 else ((7 * k) % 11) / 8, None if k % 3 == 0 else -k / 16) for i in range(6) for k in range(i * 3)]
    peers = spark.createDataFrame([*rows, (None, 1.0, 1.0), (7, None, 0.25)], "id int, ret_21d double, ret_63d double")
    want = None
    for few in (1024, 6, 0):                # all in one aggregate, both ways, all by ranges
        monkeypatch.setattr(members, "FEW_PEERS", few)
        got = sorted(map(str, members.peer_stats(events, peers, "id").collect()))
        want = want or got
        assert got == want and len(got) == 8
