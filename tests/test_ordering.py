import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window as W, functions as F

from pitspark.functions import ordering as O


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    n = 3000
    pdf = pd.DataFrame({"k": rng.integers(0, 3, n), "id": rng.permutation(n), "v": np.round(rng.normal(size=n), 2)})
    pdf.loc[pdf.index % 3 == 0, "v"] = 0.5          # one value holds a third of the rows
    return pdf, spark.createDataFrame(pdf)


def test_average_rank(data):
    pdf, df = data
    got = O.average_rank(df, ["k"], "v", "r").toPandas().set_index("id").r.sort_index()
    want = pdf.assign(r=pdf.groupby("k").v.rank()).set_index("id").r.sort_index()
    np.testing.assert_allclose(got, want)


@pytest.mark.parametrize("k", [5, 7])
def test_bucketize_is_ntile_with_ties_by_id(data, k):
    pdf, df = data
    got = O.bucketize(df, ["k"], "v", "id", k, "b").select("id", "b").toPandas().set_index("id").b.sort_index()
    want = df.select("id", F.ntile(k).over(W.partitionBy("k").orderBy("v", "id")).alias("b")).toPandas()
    assert len(got) == len(pdf)
    np.testing.assert_array_equal(got, want.set_index("id").b.sort_index())


def test_quantiles_interpolate(data):
    pdf, df = data
    got = O.quantiles(df, ["k"], "v", {"a": 0.1, "m": 0.5, "z": 0.83}).toPandas().set_index("k").sort_index()
    for c, p in (("a", 0.1), ("m", 0.5), ("z", 0.83)):
        np.testing.assert_allclose(got[c], pdf.groupby("k").v.quantile(p).sort_index())


def test_row_index_numbers_everything_once(data):
    pdf, df = data
    got = O.row_index(df, [], "k", "id", "p").toPandas().set_index("id").p.sort_index()
    want = pdf.sort_values(["k", "id"]).assign(p=range(len(pdf))).set_index("id").p.sort_index()
    np.testing.assert_array_equal(got, want)
    text = O.row_index(df.withColumn("id", F.col("id").cast("string")), ["k"], None, "id", "p").toPandas()
    for _, g in text.groupby("k"):
        assert sorted(g.p) == list(range(len(g)))


def test_cells_never_decrease(spark):
    rows = spark.range(20_000).select(F.pmod(F.xxhash64("id"), F.lit(3)).alias("k"), F.when(F.col("id") % 50 == 0, None).otherwise(
        F.randn(1)).alias("x"), F.col("id").cast("string").alias("t"))
    for order in ([F.col("x")], [F.col("x"), F.col("t")]):
        got = O.celled(rows, ["k"], order, "c").toPandas().sort_values(["k", "x", "t"], na_position="first")
        for _, g in got.groupby("k"):
            assert g.c.is_monotonic_increasing and g.c.nunique() >= 8


def test_suffix_min(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 1.0), (3, 4.0), (4, 2.0)], "o int, v double")
    got = {r.o: r.m for r in O.suffix_min(df, [], "o", "v", "m").collect()}
    assert got == {1: 1.0, 2: 1.0, 3: 2.0, 4: 2.0}


def test_ranges_follow_the_values(spark):
    """A thousand times denser values beside outliers, keys of unlike ranges and values in a narrow peak."""
    ids = spark.range(1_000_000).select(F.lit("ids").alias("k"), (F.lit(10.0 ** 12) + F.col("id")).alias("v"))
    ends = spark.createDataFrame([("ids", 0.0), ("ids", 4e12)], "k string, v double")
    peak = spark.range(200_000).select(F.lit("peak").alias("k"), (0.5 + 1e-4 * F.randn(3)).alias("v"))
    both = ids.unionByName(ends).unionByName(peak).unionByName(spark.createDataFrame([("peak", 0.0), ("peak", 1.0)], "k string, v double"))
    sizes = O.celled(both, ["k"], [F.col("v")], "c").groupBy("k", "c").count().toPandas()
    for _, g in sizes.groupby("k"):
        assert len(g) >= 100 and g["count"].max() < 0.05 * g["count"].sum()


def test_positions_along_timestamps(spark):
    df = spark.range(300).select(F.timestamp_micros(F.col("id") * 7_000_000).alias("t"), F.col("id"))
    got = O.row_index(df, [], None, "t", "p")
    assert got.where("p <> id").count() == 0


def test_only_keys_of_many_rows_are_sampled(spark):
    """Keys of few rows meet no window of the splitters' sample: they are dropped before it."""
    df = spark.range(6000).select((F.when(F.col("id") < 3000, 0).otherwise(F.col("id"))).alias("k"), F.col("id").alias("v"))
    plan = O.splitters(df, ["k"], [F.col("v")])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window [row_number") < plan.index("Join LeftSemi")       # an outer node comes first
    got = {r.k: r._cuts for r in O.splitters(df, ["k"], [F.col("v")]).collect()}
    assert list(got) == [0] and got[0] == sorted(got[0])
    pos = {r.v: r.p for r in O.row_index(df, ["k"], None, "v", "p").collect()}
    assert pos == {v: v if v < 3000 else 0 for v in range(6000)}


def test_rows_above_the_hash_limit_are_not_sampled(spark):
    """Of a large key a bounded number of rows is looked at for splitters, of a middling one a small share."""
    rows = spark.range(400_000).select(F.when(F.col("id") < 300_000, 0).otherwise(1 + F.col("id") % 20).alias("k"), F.col("id").alias("_at"))
    got = {r.k: r["count"] for r in O.sampled(rows, ["k"]).groupBy("k").count().collect()}
    assert 512 < got.pop(0) < 6000 and len(got) == 20 and all(50 < n < 250 for n in got.values())
    cuts = {r.k: r.n for r in O.splitters(rows, ["k"], [F.col("_at")]).select("k", F.size("_cuts").alias("n")).collect()}
    assert cuts.pop(0) > 400 and all(4 <= n <= 14 for n in cuts.values())
    same = O.splitters(rows.repartition(7), ["k"], [F.col("_at")])
    assert same.exceptAll(O.splitters(rows, ["k"], [F.col("_at")])).isEmpty()


def test_peer_quantiles_of_few_and_many_rows(spark, monkeypatch):
    from pitspark.operators import members as P
    rows = [(i % 40, None if i % 11 == 0 else float((i * 37) % 23) / 8) for i in range(400)] + [(99, None), (100, 0.5), (101, float("nan"))]
    df = spark.createDataFrame(rows, "id int, x double")
    levels = {"a": 0.25, "b": 0.5, "c": 0.75}
    want = sorted(map(str, O.quantiles(df, ["id"], "x", levels).collect()))
    for few in (1024, 8, 0):                # all in one aggregate, both ways, all by ranges
        monkeypatch.setattr(P, "FEW_PEERS", few)
        assert sorted(map(str, P.peer_quantiles(df, "id", "x", levels).collect())) == want


def test_ranges_are_searched_by_compiled_steps(spark):
    """A range is the number of splitters up to a value; no lambda runs over the splitters for every row."""
    from bisect import bisect_right
    df = spark.range(40_000).select(F.when(F.col("id") % 97 == 0, None).otherwise(F.pmod(F.xxhash64("id"), F.lit(10 ** 6))).alias("v"))
    cut = O.celled(df.withColumn("k", F.lit(0)), ["k"], [F.col("v")], "c")
    assert "filter(_cuts" not in cut._jdf.queryExecution().optimizedPlan().toString()
    points = O.splitters(df.withColumn("k", F.lit(0)), ["k"], [F.col("v")]).first()._cuts
    points = [p for p in points if p is not None]
    assert len(points) > 50
    assert all(r.c == (0 if r.v is None else bisect_right(points, r.v)) for r in cut.collect())


def test_interpolation_needs_one_line(spark, monkeypatch):
    """Both neighbours come from one written line of knots and points, ties of knots and odd points included."""
    from pitspark.functions.scalar import interpolate
    from pitspark.operators import asof
    written = []
    keep = asof.durable
    monkeypatch.setattr(asof, "durable", lambda df: written.append(1) or keep(df))
    rng = np.random.default_rng(5)
    xs, ys = np.sort(rng.choice(np.round(np.linspace(-3, 3, 2400), 4), 2000, replace=False)), rng.normal(size=2000)
    knots = spark.createDataFrame([*zip([0] * 2000, map(float, xs), map(float, ys)), (1, 1.0, 5.0), (1, 1.0, 7.0), (1, 2.0, 9.0)], "g int, a double, b double")
    ask = [float(v) for v in np.round(rng.uniform(-4, 4, 3000), 3)]
    odd = [(1, 1.0), (1, 1.5), (1, 0.5), (1, float("inf")), (1, float("nan")), (1, None), (2, 1.0)]
    points = spark.createDataFrame([(0, v) for v in ask] + odd, "g int, x double")
    got = interpolate(points, knots, ["g"], "x", "a", "b", "o").collect()
    assert len(written) == 1 and len(got) == 3007
    np.testing.assert_allclose([r.o for r in got if r.g == 0], np.interp([r.x for r in got if r.g == 0], xs, ys), atol=1e-9)
    assert {str(r.x): str(r.o) for r in got if r.g == 1} == {
        "1.0": "7.0", "1.5": "8.0", "0.5": "5.0", "inf": "9.0", "nan": "nan", "None": "None"}
    assert [r.o for r in got if r.g == 2] == [None]
