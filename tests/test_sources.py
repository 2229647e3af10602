import pytest
from pyspark.sql import functions as F

from pitspark.functions import scalar as SC
from pitspark.operators import contract as C, members
from pitspark.sources import predictions as P, tables as T
from tests.conftest import day


def test_csv_types_nan_and_dates(spark, tmp_path):
    f = tmp_path / "t.csv"
    f.write_text("id,d,v\n1,20200102,1.5\n2,2020-01-03,NaN\n3,,\n")
    got = T.read_table(spark, str(f), "id string, d string, v double", dates=["d"]).orderBy("id").collect()
    assert [r.d for r in got] == [day(1), day(2), None] and [r.v for r in got] == [1.5, None, None]
    assert T.read_optional(spark, str(tmp_path / "none.csv"), "id string") is None


def test_dictionary_comments_and_blanks(spark, tmp_path):
    f = tmp_path / "d.csv"
    f.write_text("# note\nbank,class,home_region\nalpha,BB,US\nbeta, ,HK\n# end\ngamma,Local,JP\n")
    got = {r.member: r["class"] for r in T.read_dictionary(spark, str(f)).collect()}
    assert got == {"alpha": "bb", "gamma": "local"}


def test_append_new_is_resumable(spark, tmp_path):
    path = str(tmp_path / "out")
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    T.append_new(a.where("k = 1"), path, "k")
    T.append_new(a, path, "k")
    T.append_new(a, path, "k")
    assert sorted(r.k for r in spark.read.parquet(path).collect()) == [1, 2]


def test_predictions_round_trip(spark, tmp_path):
    path = str(tmp_path / "p")
    df = spark.createDataFrame([(1, day(0), "a", 0, 0.1, -1.0, 0.0, 1.0)],
                               "id int, date date, grp string, fold int, y_true double, `q0.1` double, `q0.5` double, `q0.9` double")
    for r in ("one", "two", "one"):
        P.write_predictions(df, path, r)
    assert sorted(x.rung for x in P.list_rungs(spark, path).collect()) == ["one", "two"]
    assert P.read_predictions(spark, path, "one").count() == 1
    with pytest.raises(FileNotFoundError):
        P.read_predictions(spark, path, "three")


def test_series_needs_a_known_column(spark):
    df = spark.createDataFrame([(20200102, "1.5"), (20200101, "x")], "DAY int, GPRD string")
    assert [tuple(r) for r in T.normalise_series(df, ["day", "DAY"], ["GPRD"]).collect()] == [(day(1), 1.5)]
    with pytest.raises(ValueError):
        T.normalise_series(df.drop("GPRD"), ["DAY"], ["GPRD"])


def test_long_members_and_names(spark):
    df = spark.createDataFrame([(1, 1, None), (2, 0, 2)], "id int, bk_b int, bk_a int")
    assert sorted(map(tuple, members.to_long_members(df, "id", "bk_").collect())) == [(1, "bk_b"), (2, "bk_a")]
    got = spark.createDataFrame([("  Gold-Man  S.A. ",)], "s string").select(SC.normalise_name("s")).first()[0]
    assert got == "gold_man_s_a"


def test_dictionary_match_needs_whole_tokens(spark):
    names = spark.createDataFrame([("CITIC Securities",), ("Citi Asia",), ("Citizen",)], "name string")
    al = spark.createDataFrame([("citi", "bb", "US", 0), ("citic", "regional", "CN", 1),
                                ("citic securities", "regional", "HK", 2)], "alias string, class string, home string, ord int")
    got = {r.name: r.home for r in members.dictionary_match(names, "name", al).collect()}
    assert got == {"CITIC Securities": "HK", "Citi Asia": "US", "Citizen": None}


def test_peers_fall_back_and_exclude_self(spark):
    uni = spark.createDataFrame([("p1", 1, "a", 9.0), ("p2", 1, "a", 8.0), ("p3", 1, "b", 7.0), ("p4", 2, "b", 6.0)],
                                "ticker string, subgroup int, grp string, cap double")
    ev = spark.createDataFrame([(1, "p1", 1, "a"), (2, None, 1, "z"), (3, "p4", 2, "b")],
                               "id int, tk string, sg int, g string")
    got = {}
    for r in members.peer_select(ev, uni, "id", "tk", "sg", "g", 2).collect():
        got.setdefault(r.id, []).append(r.peer)
    assert got == {1: ["p2"], 2: ["p1", "p2"]}


def test_json_answers_are_validated(spark):
    d = spark.createDataFrame([("a", "", ""), ("b", "bb", "US"), ("c", "", ""), ("e", "", "")],
                              "member string, class string, home string")
    text = ['{"items":[{"name":"a","class":"Global","home":"hk"},{"name":"b","class":"local","home":"JP"},'
            '{"name":"c","class":"odd","home":"US"},{"name":"zz","class":"bb","home":"US"},'
            '{"name":"e","class":"unknown","home":"US","confidence":"high"}]}', "not json"]
    p = spark.createDataFrame([(t,) for t in text], "t string")
    got = {r.member: (r["class"], r.home, r.source) for r in members.fill_from_json(d, p, "t", ("bb", "global", "regional", "local")).collect()}
    assert got == {"a": ("global", "HK", "json_low"), "b": ("bb", "US", ""), "c": ("", "", ""), "e": ("", "", "")}


def test_contract_reports_missing_parts(spark):
    ev = spark.createDataFrame([(1, "a")], "id int, grp string")
    rep = C.missing_columns(spark, {"events": ev, "prices": None, "macro": None},
                            {"events": ["id", "d"], "prices": ["id"], "macro": ["date"]}, optional=["macro"])
    assert {(r.severity, r.table_name, r.rule, r.detail) for r in rep.collect()} == {
        ("error", "events", "missing_column", "d"), ("error", "prices", "missing_table", ""),
        ("info", "macro", "missing_table", "")}
    assert C.failed(rep) and not C.failed(rep.where("severity = 'info'"))
    with pytest.raises(ValueError):
        C.require_columns(ev, ["id", "d"])
    late = C.late_series(spark.createDataFrame([(1, day(3))], "id int, d date"),
                         spark.createDataFrame([(day(3), 1.0)], "date date, v double"), "risk", [])
    assert late.count() == 1
    assert C.late_children(ev, ev, "peers").first().rule == "no_asof"


def test_scalars(spark):
    r = spark.createDataFrame([(day(44), [1.0, 2.0], 0.0)], "d date, a array<double>, z double").select(
        SC.period_end("d", "ME").alias("me"), SC.period_end("d", "QE").alias("qe"), SC.period_end("d", "YE").alias("ye"),
        SC.pad_left(F.col("a"), 4).alias("p"), SC.guarded(F.lit(1.0), F.col("z"), 0.0).alias("g"),
        SC.sigmoid(F.lit(1e9)).alias("s")).first()
    assert (str(r.me), str(r.qe), str(r.ye)) == ("2020-02-29", "2020-03-31", "2020-12-31")
    assert r.p == [1.0, 1.0, 1.0, 2.0] and r.g == 0.0 and 0 < 1 - r.s < 1e-12
    with pytest.raises(ValueError):
        SC.period_end("d", "W")


def test_shipments_meet_suppliers_without_a_shuffle(spark, tmp_path):
    from checks import bindings as B
    sf = str(tmp_path)
    made = {"region": ("r_regionkey int, r_name string", [(0, "ASIA"), (1, "EUROPE")]),
            "nation": ("n_nationkey int, n_regionkey int, n_name string", [(3, 0, "A"), (4, 1, "B"), (5, None, "C")]),
            "supplier": ("s_suppkey long, s_nationkey int, s_acctbal double", [(1, 3, 0.0), (2, 4, 0.0), (3, 5, 0.0), (4, None, 0.0), (2, 3, 1.0)]),
            "lineitem": ("l_suppkey long, l_shipdate string, l_extendedprice double, l_quantity double",
                         [(k, "2020-01-02", float(k or 0), 2.0) for k in (1, 2, 3, 4, 9, None)])}
    for name, (schema, rows) in made.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{sf}/{name}.parquet")
    got = B.shipments(spark, sf)
    assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.grp, r.proceeds) for r in got.collect()) == [("ASIA", 1.0), ("ASIA", 2.0), ("EUROPE", 2.0)]
