"""Logical tables of the library derived from the benchmark's parquet tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
LINE_ORDER = ("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")

# Member classes, the ordered labels and the further flags the queries ask for.
CLASSES = CLASS_OF = ("bb", "global", "regional", "local")
RULES = (("unclassified", "not (has_bb or has_global or has_regional or has_local)"),
         ("bb_solo", "has_bb and n_members = 1"), ("bb_dom", "has_bb and has_domestic"), ("bb_intl", "has_bb"),
         ("global_led", "has_global"), ("regional_dom", "has_regional and has_domestic"),
         ("regional_intl", "has_regional"), ("local_only", "true"))
FLAGS = {"combo_bb_x_dom": "has_bb and has_domestic", "combo_bb_x_reg": "has_bb and has_regional",
         "solo": "n_members = 1", "jumbo": "n_members >= 6"}


_READ: dict[tuple, DataFrame] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A parquet table; its footer is read once per session."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _READ:
        _READ[key] = spark.read.parquet(f"{sf}/{name}.parquet")
    return _READ[key]


def cents(c: str):
    """Two-decimal amounts as integers, so that sums do not depend on their order."""
    return F.floor(F.col(c) * 100 + 0.5)


def regions(spark, sf, key: str, nation: str, src: str) -> DataFrame:
    """(key, grp) for a table with a nation column."""
    n = table(spark, sf, "nation").join(
        table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return (table(spark, sf, src).join(n, F.col(nation) == F.col("n_nationkey"))
            .select(key, F.col("r_name").alias("grp")))


def events(spark, sf) -> DataFrame:
    offer = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        (F.sum(cents("l_extendedprice") * (100 - cents("l_discount"))) / 1e4 / F.sum("l_quantity")).alias("offer"))
    return unpriced_events(spark, sf).join(offer, "id", "left")


def unpriced_events(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders")
    return (o.join(regions(spark, sf, "c_custkey", "c_nationkey", "customer"),
                   F.col("o_custkey") == F.col("c_custkey"))
            .select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("d"), "grp",
                    F.col("o_totalprice").alias("size"),
                    (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("flag_a"),
                    (F.col("o_orderpriority") == "2-HIGH").cast("int").alias("flag_b"),
                    (F.col("o_orderstatus") != "P").cast("int").alias("is_target")))


def prices(spark, sf) -> DataFrame:
    line = W.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    li = table(spark, sf, "lineitem").withColumn("rn", F.row_number().over(line))
    o = table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("_d"))
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("id"), F.date_add("_d", F.col("rn") - 1).alias("date"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("close"))


def benchmark(spark, sf) -> DataFrame:
    return unpriced_events(spark, sf).groupBy("grp", F.col("d").alias("date")).agg(
        (F.avg(cents("size")) / 100).alias("close"))


def members(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("id"),
        F.concat(F.lit("bk_"), F.lpad((F.col("l_suppkey") % 12).cast("string"), 2, "0")).alias("member")
    ).distinct()


def dictionary(spark) -> DataFrame:
    """Classes of members 0-9; members 10 and 11 stay unclassified."""
    rows = [(f"bk_{i:02d}", CLASS_OF[i // 3] if i < 10 else "", REGIONS[i % 5]) for i in range(12)]
    return spark.createDataFrame(rows, "member string, class string, home string")


def shipments(spark, sf) -> DataFrame:
    """Second event universe: (date, grp, proceeds, qty, tax). Lines meet one small table after the other, whose sizes are
    known; the size of suppliers joined to their regions is not, and lines would be shuffled to meet them."""
    s = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    return (table(spark, sf, "lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey"))
            .join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.to_date("l_shipdate").alias("date"), F.col("r_name").alias("grp"),
                    F.col("l_extendedprice").alias("proceeds"), F.col("l_quantity").alias("qty")))


def macro(spark, sf) -> DataFrame:
    return shipments(spark, sf).groupBy("grp", "date").agg(
        F.avg("qty").alias("vol_index"), (F.avg(cents("proceeds")) / 100).alias("fx"))


def macro_global(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy(F.to_date("l_shipdate").alias("date")).agg(
        F.avg("l_quantity").alias("vix"), ((F.avg(cents("l_tax")) + 1) / 100).alias("hy_oas"),
        (F.sum(cents("l_extendedprice")) / 100).alias("em"), F.sum("l_quantity").alias("acwi"))


def risk(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy(F.to_date("l_shipdate").alias("date")).agg(
        (F.sum(cents("l_extendedprice")) / 1e6).alias("v"))


def peers(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("_d"))
    up = F.col("l_discount") - F.col("l_tax") + F.lit(0.0)
    return table(spark, sf, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("peer"),
        F.round(up, 4).alias("ret_21d"),
        F.when(F.col("l_linenumber") % 3 != 0, F.round(-up, 4)).alias("ret_63d"),
        F.date_sub("_d", F.col("l_linenumber")).alias("asof"))


def universe(spark, sf) -> DataFrame:
    s = regions(spark, sf, "s_suppkey", "s_nationkey", "supplier")
    return table(spark, sf, "supplier").join(s, "s_suppkey").select(
        F.col("s_suppkey").cast("string").alias("ticker"), (F.col("s_suppkey") % 12).alias("subgroup"),
        "grp", F.col("s_acctbal").alias("cap"))


# The same tables as DuckDB CTEs, for the SQL each query is checked against.
_EV = """
offers AS (SELECT l_orderkey AS id, sum(floor(l_extendedprice*100+0.5::DOUBLE)*(100-floor(l_discount*100+0.5::DOUBLE)))/1e4/sum(l_quantity) AS offer
           FROM lineitem GROUP BY 1),
ev AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS d, r_name AS grp, o_totalprice AS size,
         CAST(o_orderpriority='1-URGENT' AS INT) AS flag_a, CAST(o_orderpriority='2-HIGH' AS INT) AS flag_b,
         CAST(o_orderstatus<>'P' AS INT) AS is_target, f.offer
       FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey
       JOIN region ON n_regionkey=r_regionkey LEFT JOIN offers f ON f.id=o_orderkey)"""
_CTES = {
    "ev": ([], _EV),
    "px": ([], """px AS (SELECT l_orderkey AS id, CAST(o_orderdate AS DATE) + CAST(rn-1 AS INT) AS date,
         l_extendedprice/l_quantity AS close, rn FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey
         ORDER BY l_shipdate,l_linenumber,l_partkey,l_suppkey,l_extendedprice) AS rn FROM lineitem)
         JOIN orders ON l_orderkey=o_orderkey)"""),
    "bm": (["ev"], "bm AS (SELECT grp, d AS date, avg(floor(size*100+0.5::DOUBLE))/100 AS close FROM ev GROUP BY 1,2)"),
    "mem": ([], """mem AS (SELECT DISTINCT l_orderkey AS id,
         'bk_'||lpad(CAST(l_suppkey%12 AS VARCHAR),2,'0') AS member FROM lineitem)"""),
    "dict": ([], """dict AS (SELECT 'bk_'||lpad(CAST(i AS VARCHAR),2,'0') AS member,
         CASE WHEN i>=10 THEN '' ELSE (['bb','global','regional','local'])[i//3+1] END AS class,
         (['AFRICA','AMERICA','ASIA','EUROPE','MIDDLE EAST'])[i%5+1] AS home FROM range(12) t(i))"""),
    "ship": ([], """ship AS (SELECT CAST(l_shipdate AS DATE) AS date, r_name AS grp,
         l_extendedprice AS proceeds, l_quantity AS qty FROM lineitem JOIN supplier ON l_suppkey=s_suppkey
         JOIN nation ON s_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey)"""),
    "mac": (["ship"], """mac AS (SELECT grp, date, avg(qty) AS vol_index, avg(floor(proceeds*100+0.5::DOUBLE))/100 AS fx
         FROM ship GROUP BY 1,2)"""),
    "gl": ([], """gl AS (SELECT CAST(l_shipdate AS DATE) AS date, avg(l_quantity) AS vix,
         (avg(floor(l_tax*100+0.5::DOUBLE))+1)/100 AS hy_oas, sum(floor(l_extendedprice*100+0.5::DOUBLE))/100 AS em, sum(l_quantity) AS acwi
         FROM lineitem GROUP BY 1)"""),
    "risk": ([], """risk AS (SELECT CAST(l_shipdate AS DATE) AS date, sum(floor(l_extendedprice*100+0.5::DOUBLE))/1e6 AS v
         FROM lineitem GROUP BY 1)"""),
    "peer": ([], """peer AS (SELECT l_orderkey AS id, l_suppkey AS peer, round(l_discount-l_tax+0.0,4) AS ret_21d,
         CASE WHEN l_linenumber%3<>0 THEN round(-(l_discount-l_tax+0.0),4) END AS ret_63d,
         CAST(o_orderdate AS DATE)-CAST(l_linenumber AS INT) AS ao
         FROM lineitem JOIN orders ON l_orderkey=o_orderkey)"""),
    "uni": ([], """uni AS (SELECT CAST(s_suppkey AS VARCHAR) AS ticker, s_suppkey%12 AS subgroup, r_name AS grp,
         s_acctbal AS cap FROM supplier JOIN nation ON s_nationkey=n_nationkey
         JOIN region ON n_regionkey=r_regionkey)"""),
    "nth": (["px"], """nth AS (SELECT id, max(close) FILTER (rn=1) AS c_1, max(date) FILTER (rn=1) AS d_1,
         max(close) FILTER (rn=2) AS c_2, max(date) FILTER (rn=2) AS d_2,
         max(close) FILTER (rn=3) AS c_3, max(date) FILTER (rn=3) AS d_3,
         max(close) FILTER (rn=5) AS c_5, max(date) FILTER (rn=5) AS d_5, count(*) AS n_closes
         FROM px GROUP BY id)"""),
    # Returns measured from the offer, raw and relative to the benchmark.
    "ret": (["ev", "nth", "bm"], """
lb AS (SELECT grp, date, ln(close) AS lc FROM bm),
e1 AS (SELECT n.*, e.grp, e.offer FROM nth n JOIN ev e USING (id)),
p0 AS (SELECT e1.id, b.lc FROM e1 ASOF LEFT JOIN lb b ON e1.grp=b.grp AND e1.d_1>b.date),
p1 AS (SELECT e1.id, b.lc FROM e1 ASOF LEFT JOIN lb b ON e1.grp=b.grp AND e1.d_1>=b.date),
p3 AS (SELECT e1.id, b.lc FROM e1 ASOF LEFT JOIN lb b ON e1.grp=b.grp AND e1.d_3>=b.date),
p5 AS (SELECT e1.id, b.lc FROM e1 ASOF LEFT JOIN lb b ON e1.grp=b.grp AND e1.d_5>=b.date),
ret AS (SELECT e1.id, c_1,c_3,c_5,d_1,d_3,d_5, p1.lc AS m1, p3.lc AS m3, p5.lc AS m5,
          coalesce(p0.lc,p1.lc) AS m0,
          ln(c_1)-ln(offer) AS raw_1, ln(c_3)-ln(offer) AS raw_3, ln(c_5)-ln(offer) AS raw_5,
          ln(c_1)-ln(offer)-(p1.lc-coalesce(p0.lc,p1.lc)) AS exc_1,
          ln(c_3)-ln(offer)-(p3.lc-coalesce(p0.lc,p1.lc)) AS exc_3,
          ln(c_5)-ln(offer)-(p5.lc-coalesce(p0.lc,p1.lc)) AS exc_5
        FROM e1 LEFT JOIN p0 USING(id) LEFT JOIN p1 USING(id) LEFT JOIN p3 USING(id) LEFT JOIN p5 USING(id))"""),
}


def ctes(*names: str) -> str:
    """CTE text for the named logical tables and what they need, without the leading WITH."""
    done: list[str] = []

    def add(n: str) -> None:
        for dep in _CTES[n][0]:
            add(dep)
        if n not in done:
            done.append(n)

    for n in names:
        add(n)
    return ",\n".join(_CTES[n][1] for n in done)


def register(name: str, needs: list[str], text: str) -> None:
    _CTES[name] = (needs, text)
