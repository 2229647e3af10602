"""Queries for sources, sinks, scalar functions, set operations and the data contract."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window as W, functions as F

from checks import bindings as B
from checks.evaluation import quant
from checks.registry import query
from pitspark.functions import scalar as SC
from pitspark.functions.ordering import row_index
from pitspark.operators import contract as C, members
from pitspark.session import checkpoint_dir
from pitspark.sources import predictions as P, tables as T


# ---- sources and sinks ----

@query("S1_read_table", sql="SELECT o_orderkey, o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders")
def s1(spark, sf):
    return T.read_table(spark, f"{sf}/orders.parquet", "o_orderkey bigint, o_totalprice double, o_orderdate date",
                        kind="parquet")


@query("S2_read_optional", sql="SELECT count(*) AS n, 1 AS absent FROM customer")
def s2(spark, sf):
    here = T.read_optional(spark, f"{sf}/customer.parquet", "c_custkey bigint", kind="parquet")
    gone = T.read_optional(spark, f"{sf}/no_such_table.parquet", "c_custkey bigint")
    return here.agg(F.count(F.lit(1)).alias("n")).withColumn("absent", F.lit(int(gone is None)))


@query("S3_long_members", needs="mem", sql="SELECT id, member FROM mem")
def s3(spark, sf):
    hot = B.members(spark, sf).groupBy("id").agg(*[
        F.max((F.col("member") == f"bk_{i:02d}").cast("int")).alias(f"bk_{i:02d}") for i in range(12)])
    return members.to_long_members(hot, "id", "bk_")


@query("S4_normalise_series", sql="""
WITH s AS (SELECT CAST(l_shipdate AS DATE) AS date, count(*) AS n FROM lineitem GROUP BY 1)
SELECT date, CAST(n AS DOUBLE) AS v FROM s WHERE n % 5 <> 0""")
def s4(spark, sf):
    raw = B.table(spark, sf, "lineitem").groupBy(F.date_format("l_shipdate", "yyyyMMdd").alias("DAY")).agg(
        F.count(F.lit(1)).alias("_n"))
    raw = raw.select(F.col("DAY").cast("int").alias("DAY"),
                     F.when(F.col("_n") % 5 == 0, "missing").otherwise(F.col("_n").cast("string")).alias("GPRD"))
    return T.normalise_series(raw, ["date", "DAY"], ["level", "GPRD"])


@query("S6_write_read_predictions", needs="pred", rounds="q50", sql="SELECT rung, id, md AS q50 FROM pred WHERE rung='B'")
def s6(spark, sf):
    path = f"{checkpoint_dir(spark)}/rungs-{uuid.uuid4().hex}"
    preds = quant(spark, sf)
    for r in ("A", "B"):
        P.write_predictions(preds.where(F.col("rung") == r).drop("rung"), path, r)
    return P.read_predictions(spark, path, "B").select("rung", "id", P.quoted("q0.5").alias("q50"))


@query("S9_append_new", sql="SELECT o_orderkey AS id, o_orderkey%2 AS late FROM orders")
def s9(spark, sf):
    """A load that was cut off after half of its rows, resumed twice: every row is there once."""
    path = f"{checkpoint_dir(spark)}/load-{uuid.uuid4().hex}"
    o = B.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 2).alias("late"))
    for part in (o.where("late = 0"), o, o):
        T.append_new(part, path, "id")
    return spark.read.parquet(path)


_WHY = {"no price": "offer is null", "not a target": "is_target = 0"}


@query("S10_split_failures", needs="ev", sql="""
SELECT id, CASE WHEN offer IS NULL THEN 'no price' WHEN is_target=0 THEN 'not a target' ELSE 'good' END AS reason FROM ev""")
def s10(spark, sf):
    good, bad = T.split_failures(B.events(spark, sf), _WHY)
    return bad.select("id", "reason").unionByName(good.select("id", F.lit("good").alias("reason")))


@query("S11_stack_series", needs="mac", sql="SELECT grp, date, vol_index, CASE WHEN grp<>'EUROPE' THEN fx END AS fx FROM mac")
def s11(spark, sf):
    m = B.macro(spark, sf)
    parts = {g: m.where(F.col("grp") == g).drop("grp") for g in B.REGIONS}
    return T.stack_series(parts | {"EUROPE": parts["EUROPE"].drop("fx")})


@query("S12_align_series", needs="mac", sql="SELECT date, " + ", ".join(
    f"max(vol_index) FILTER (grp='{g}') AS {g.lower().replace(' ', '_')}" for g in B.REGIONS) + " FROM mac GROUP BY 1")
def s12(spark, sf):
    m = B.macro(spark, sf)
    return T.align_series({g.lower().replace(" ", "_"): m.where(F.col("grp") == g).select("date", "vol_index") for g in B.REGIONS})


@query("S13_fill_from_reference", sql="""
WITH c AS (SELECT c_custkey AS id, CASE WHEN c_custkey%3=0 THEN c_mktsegment WHEN c_custkey%3=1 THEN '  ' END AS sub,
  c_custkey AS k FROM customer), r AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey%2=0 THEN ' '||s_name||' ' ELSE '' END AS f1,
  CASE WHEN s_suppkey%5<>0 THEN 'n'||s_nationkey END AS f2 FROM supplier),
j AS (SELECT id, sub, coalesce(nullif(trim(f1),''), nullif(trim(f2),'')) AS ref FROM c LEFT JOIN r USING (k))
SELECT id, coalesce(nullif(trim(sub),''), ref) AS sub, CAST(coalesce(trim(sub),'')='' AND ref IS NOT NULL AS INT) AS filled,
 CAST(coalesce(nullif(trim(sub),''), ref) IS NULL AS INT) AS still_blank FROM j""")
def s13(spark, sf):
    k = F.col("c_custkey")
    c = B.table(spark, sf, "customer").select(k.alias("id"), F.when(k % 3 == 0, F.col("c_mktsegment"))
                                              .when(k % 3 == 1, "  ").alias("sub"))
    s = F.col("s_suppkey")
    ref = B.table(spark, sf, "supplier").select(
        s.alias("id"), F.when(s % 2 == 0, F.concat(F.lit(" "), "s_name", F.lit(" "))).otherwise("").alias("f1"),
        F.when(s % 5 != 0, F.concat(F.lit("n"), F.col("s_nationkey").cast("string"))).alias("f2"))
    return T.fill_from_reference(c, ref, "id", "sub", ["f1", "f2"])


# ---- scalar functions ----

@query("F1_math", rounds="a b c e s r", sql="""
SELECT o_orderkey AS id, ln(o_totalprice) AS a, ln(1+o_totalprice/1e5) AS b, exp(o_totalprice/1e6) AS c, exp(o_totalprice/1e6)-1 AS e,
 sqrt(o_totalprice) AS s, CAST(sign(o_totalprice-250000) AS INT) AS sg, CAST(floor(o_totalprice/1000) AS BIGINT) AS f,
 round(abs(ln(o_totalprice/250000)),3) AS r FROM orders""")
def f1(spark, sf):
    x = F.col("o_totalprice")
    return B.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.log(x).alias("a"), F.log1p(x / 1e5).alias("b"), F.exp(x / 1e6).alias("c"),
        F.expm1(x / 1e6).alias("e"), F.sqrt(x).alias("s"), F.signum(x - 250000).cast("int").alias("sg"),
        F.floor(x / 1000).alias("f"), F.round(F.abs(F.log(x / 250000)), 3).alias("r"))


@query("F2_guarded_division", rounds="q", sql="""
SELECT o_orderkey AS id, CASE WHEN o_orderkey%4<>0 THEN ln(o_totalprice)/(o_orderkey%4) ELSE 0.0 END AS q FROM orders""")
def f2(spark, sf):
    k = F.col("o_orderkey")
    return B.table(spark, sf, "orders").select(k.alias("id"), SC.guarded(
        F.log("o_totalprice"), k % 4, 0.0).alias("q"))


@query("F3_dates", sql="""
SELECT o_orderkey AS id, CAST(o_orderdate AS DATE)+30 AS later, CAST(year(o_orderdate) AS INT) AS y, CAST(last_day(o_orderdate) AS DATE) AS me,
 CAST(last_day(date_trunc('quarter',o_orderdate)+INTERVAL 2 MONTH) AS DATE) AS qe, make_date(year(o_orderdate),12,31) AS ye,
 CAST(o_orderdate AS DATE) AS parsed FROM orders""")
def f3(spark, sf):
    d = F.to_date("o_orderdate")
    text = F.when(F.col("o_orderkey") % 2 == 0, F.date_format(d, "yyyyMMdd")).otherwise(d.cast("string"))
    return B.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.date_add(d, 30).alias("later"), F.year(d).alias("y"),
        *[SC.period_end(d, f).alias(f.lower()) for f in ("ME", "QE", "YE")], SC.parse_day(text).alias("parsed"))


@query("F4_sigmoid", rounds="p", digits=9, sql="""
SELECT o_orderkey AS id, 1/(1+exp(-greatest(-30.0::DOUBLE,least(30.0::DOUBLE,(o_totalprice-250000)/5000)))) AS p FROM orders""")
def f4(spark, sf):
    return B.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"),
                                               SC.sigmoid((F.col("o_totalprice") - 250000) / 5000).alias("p"))


@query("F5_text", sql="""
SELECT p_partkey AS id, lower(p_brand) AS b, regexp_replace(p_brand,'[^0-9]','','g') AS n, CAST(starts_with(p_type,'S') AS INT) AS s FROM part""")
def f5(spark, sf):
    return B.table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.lower("p_brand").alias("b"), F.regexp_replace("p_brand", "[^0-9]", "").alias("n"),
        F.startswith("p_type", F.lit("S")).cast("int").alias("s"))


_JS = "CAST(regexp_extract(props,'[0-9]+') AS INT)"


@query("F6_json_fill", needs="dict", sql=f"""
WITH e AS (SELECT {_JS} AS k FROM events WHERE props IS NOT NULL), v AS (SELECT 'bk_'||lpad(CAST(k%12 AS VARCHAR),2,'0') AS member,
  (['bb','global','unknown','wrong'])[k%4+1] AS class, CASE WHEN k%3=0 THEN 'x1' ELSE 'US' END AS home,
  CASE WHEN k%5=0 THEN 'high' ELSE 'low' END AS conf FROM e WHERE k%10<>0),
g AS (SELECT member, conf, class, home, row_number() OVER (PARTITION BY member ORDER BY conf, class, home) AS rn FROM v
  WHERE class<>'wrong' AND home='US')
SELECT d.member, CASE WHEN trim(d.class)='' AND g.class IS NOT NULL AND g.class<>'unknown' THEN g.class ELSE d.class END AS class,
 CASE WHEN trim(d.class)='' AND g.class IS NOT NULL AND g.class<>'unknown' THEN g.home ELSE d.home END AS home,
 CASE WHEN trim(d.class)='' AND g.class IS NOT NULL AND g.class<>'unknown' THEN 'json_'||g.conf ELSE '' END AS source
FROM dict d LEFT JOIN g ON g.member=d.member AND rn=1""")
def f6(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    e = B.table(spark, sf, "events").select(k.alias("k")).where("k is not null")
    name = F.concat(F.lit("bk_"), F.lpad((F.col("k") % 12).cast("string"), 2, "0"))
    cls = F.element_at(F.array(*map(F.lit, ["bb", "global", "unknown", "wrong"])), F.col("k") % 4 + 1)
    text = F.format_string('{"items":[{"name":"%s","class":" %s ","home":"%s","confidence":"%s"}]}', name, cls,
                           F.when(F.col("k") % 3 == 0, "x1").otherwise("us"),
                           F.when(F.col("k") % 5 == 0, "HIGH").otherwise("so-so"))
    e = e.withColumn("text", F.when(F.col("k") % 10 == 0, F.lit('{"items":[{"name":')).otherwise(text))
    return members.fill_from_json(B.dictionary(spark), e, "text", B.CLASSES)


@query("F7_interpolate", rounds="y", sql="""
WITH k AS (SELECT s_nationkey%5 AS g, s_acctbal AS x, min(ln(20000+s_acctbal)) AS y FROM supplier GROUP BY 1,2),
c AS (SELECT c_custkey AS id, c_nationkey%5 AS g, c_acctbal AS x FROM customer),
a AS (SELECT c.id, k.x AS x0, k.y AS y0 FROM c ASOF LEFT JOIN k ON c.g=k.g AND c.x>=k.x),
b AS (SELECT c.id, k.x AS x1, k.y AS y1 FROM c ASOF LEFT JOIN k ON c.g=k.g AND c.x<k.x)
SELECT c.id, CASE WHEN x0 IS NULL THEN y1 WHEN x1 IS NULL THEN y0 ELSE y0+(y1-y0)/(x1-x0)*(c.x-x0) END AS y
FROM c JOIN a USING (id) JOIN b USING (id)""")
def f7(spark, sf):
    knots = B.table(spark, sf, "supplier").select(
        (F.col("s_nationkey") % 5).alias("g"), F.col("s_acctbal").alias("kx"),
        F.log(20000 + F.col("s_acctbal")).alias("ky"))
    pts = B.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") % 5).alias("g"),
                                                F.col("c_acctbal").alias("x"))
    return SC.interpolate(pts, knots, ["g"], "x", "kx", "ky", "y").select("id", "y")


@query("F10_arrays", sql="""
WITH a AS (SELECT l_orderkey AS id, list_sort(list(l_partkey)) AS a FROM lineitem GROUP BY 1)
SELECT id, a[1] AS first, a[len(a)] AS last, CASE WHEN len(a)>=6 THEN a[len(a)-5] ELSE a[1] END AS pad1, 6 AS n FROM a""")
def f10(spark, sf):
    a = B.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.array_sort(F.collect_list("l_partkey")).alias("a"))
    a = a.withColumn("p", SC.pad_left(F.col("a"), 6))
    return a.select("id", F.element_at("a", 1).alias("first"), F.element_at(F.reverse("a"), 1).alias("last"),
                    F.element_at("p", 1).alias("pad1"), F.size("p").alias("n"))


# ---- sorts and sets ----

@query("T2_top_k_per_group", sql="""
SELECT s_nationkey, s_suppkey FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey)<=2""")
def t2(spark, sf):
    w = W.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey")
    return (B.table(spark, sf, "supplier").withColumn("_rn", F.row_number().over(w)).where("_rn <= 2")
            .select("s_nationkey", "s_suppkey"))


@query("T3_tail_recent", needs="ev", sql="""
SELECT grp, id FROM ev QUALIFY row_number() OVER (PARTITION BY grp ORDER BY d DESC, id DESC) <= 100""")
def t3(spark, sf):
    ev = B.unpriced_events(spark, sf).select("grp", "d", "id")
    n = ev.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    return row_index(ev, ["grp"], "d", "id", "pos").join(n, "grp").where("pos >= n - 100").select("grp", "id")


@query("T5_limit", needs="ev", sql="SELECT id, d FROM ev ORDER BY d DESC, id LIMIT 50")
def t5(spark, sf):
    return B.unpriced_events(spark, sf).select("id", "d").orderBy(F.desc("d"), "id").limit(50)


def _ids(spark, sf):
    return (B.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id")),
            B.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id")))


@query("U1_union", sql="SELECT o_orderkey AS id FROM orders UNION ALL SELECT l_orderkey FROM lineitem")
def u1(spark, sf):
    a, b = _ids(spark, sf)
    return a.unionByName(b)


@query("U2_difference", sql="SELECT o_orderkey AS id FROM orders EXCEPT SELECT l_orderkey FROM lineitem")
def u2(spark, sf):
    a, b = _ids(spark, sf)
    return a.subtract(b)


@query("U3_intersection", sql="SELECT o_orderkey AS id FROM orders INTERSECT SELECT l_orderkey FROM lineitem")
def u3(spark, sf):
    a, b = _ids(spark, sf)
    return a.intersect(b)


@query("U4_dedupe_first", needs="dict", sql="""
WITH m AS (SELECT DISTINCT 'bk_'||lpad(CAST(l_suppkey%12 AS VARCHAR),2,'0') AS member FROM lineitem
 UNION SELECT 'zz_'||l_linenumber FROM lineitem)
SELECT m.member, coalesce(d.class,'') AS class, coalesce(d.home,'') AS home, CAST(d.class IS NULL AS INT) AS unknown
FROM m LEFT JOIN (SELECT * FROM dict WHERE trim(class)<>'') d USING (member)""")
def u4(spark, sf):
    odd = B.table(spark, sf, "lineitem").select(F.concat(F.lit("zz_"), F.col("l_linenumber").cast("string")).alias("member"))
    long = B.members(spark, sf).select("member").unionByName(odd)
    hits = members.classify_members(long, B.dictionary(spark))
    return members.draft_dictionary(hits.unionByName(hits.where("class is not null")))


# ---- data contract ----

def raw_events(spark, sf) -> DataFrame:
    """Orders as an untyped export with faults planted by key."""
    k = F.col("o_orderkey")
    return B.table(spark, sf, "orders").select(
        F.when(k % 50 == 0, k + 1).otherwise(k).alias("id"),
        F.when(k % 40 == 0, "n/a").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("d"),
        F.when(k % 30 == 0, "x").when(k % 31 == 0, "-1").otherwise(F.col("o_totalprice").cast("string")).alias("offer"),
        (k % 3).alias("flag"), F.when(k % 7 == 0, 0).when(k % 7 == 1, 1).alias("is_target"),
        F.concat(F.lit("m"), (F.floor(F.sqrt(k.cast("double")))).cast("string")).alias("grp"))


B.register("rawev", [], """rawev AS (SELECT CASE WHEN o_orderkey%50=0 THEN o_orderkey+1 ELSE o_orderkey END AS id, o_orderkey AS k,
 CASE WHEN o_orderkey%40=0 THEN 'bad' ELSE 'ok' END AS dt, CASE WHEN o_orderkey%30=0 THEN 'x' WHEN o_orderkey%31=0 THEN '-1' ELSE '1' END AS offer,
 o_orderkey%3 AS flag, CASE WHEN o_orderkey%7=0 THEN 0 WHEN o_orderkey%7=1 THEN 1 END AS is_target,
 'm'||CAST(floor(sqrt(o_orderkey)) AS BIGINT) AS grp FROM orders)""")


def _line(sev, rule, n, detail="''", table="events", frm="rawev"):
    return (f"SELECT '{sev}' AS severity, '{table}' AS table_name, '{rule}' AS rule, CAST({n} AS BIGINT) AS n, "
            f"{detail} AS detail FROM {frm}")


_ROW = {
    "C2_duplicate_ids": ("duplicate", [_line("error", "duplicate:id", "count(*)", frm="(SELECT id FROM rawev GROUP BY 1 HAVING count(*)>1)")]),
    "C3_unparseable_dates": ("unparseable", [_line("error", "unparseable:d", "count(*) FILTER (dt='bad')")]),
    "C4_numeric": ("not_numeric not_positive", [_line("error", "not_numeric:offer", "count(*) FILTER (offer='x')"),
                                                _line("warning", "not_positive:offer", "count(*) FILTER (offer='-1')")]),
    "C5_flag_domain": ("not_flag", [_line("error", "not_flag:flag", "count(*) FILTER (flag=2)")]),
    "C7_target_split": ("target_rows universe_rows no_target", [
        _line("info", "target_rows", "count(*) FILTER (coalesce(is_target,1)<>0)"),
        _line("info", "universe_rows", "count(*) FILTER (is_target=0)")]),
}


def _row_rule(name, starts, lines):
    @query(name, needs="rawev", sql=" UNION ALL ".join(lines))
    def run(spark, sf):
        got = C.row_rules(raw_events(spark, sf), "events", "id", ["d"], ["offer"], ["flag"], target="is_target")
        return got.where(F.col("rule").rlike("^(" + "|".join(starts.split()) + ")"))
    return run


for _n, (_s, _l) in _ROW.items():
    _row_rule(_n, _s, _l)


@query("C6_thin_groups", needs="rawev", sql=_line("warning", "thin_group", "n", "grp",
       frm="(SELECT grp, count(*) AS n FROM rawev GROUP BY 1 HAVING count(*)<30)"))
def c6(spark, sf):
    return C.thin_groups(raw_events(spark, sf), "events", "grp")


@query("C8_no_price_rows", needs="ev px", sql=_line("warning", "no_price_rows", "count(*)", table="prices",
       frm="ev WHERE id NOT IN (SELECT id FROM px) HAVING count(*)>0"))
def c8(spark, sf):
    return C.path_coverage(B.unpriced_events(spark, sf), B.prices(spark, sf)).where("rule = 'no_price_rows'")


@query("C9_short_paths", needs="ev px", sql=_line("warning", "short_path", "count(*)", table="prices",
       frm="ev LEFT JOIN (SELECT id, count(*) AS c FROM px GROUP BY 1) USING (id) WHERE coalesce(c,0)<5"))
def c9(spark, sf):
    return C.path_coverage(B.unpriced_events(spark, sf), B.prices(spark, sf), least=5).where("rule = 'short_path'")


@query("C10_uncovered_groups", needs="ev bm", sql=_line("error", "no_series", "1", "grp", table="market",
       frm="(SELECT DISTINCT grp FROM ev WHERE grp NOT IN (SELECT grp FROM bm WHERE grp<>'ASIA'))"))
def c10(spark, sf):
    return C.uncovered_groups(B.unpriced_events(spark, sf), B.benchmark(spark, sf).where("grp <> 'ASIA'"), "market")


@query("C11_not_daily", needs="bm", sql=_line("warning", "not_daily", "floor(m)", "grp", table="market", frm="""
(SELECT grp, median(g) AS m FROM (SELECT grp, date-lag(date) OVER (PARTITION BY grp ORDER BY date) AS g FROM
 (SELECT * FROM bm WHERE day(date) IN (1,10,20))) GROUP BY 1 HAVING median(g)>4)"""))
def c11(spark, sf):
    return C.sparse_series(B.benchmark(spark, sf).where("day(date) in (1, 10, 20)"), "market", ["grp"])


@query("C12_starts_late", needs="ev mac", sql=_line("error", "starts_late", "s-e", "grp", table="macro", frm="""
(SELECT grp, min(d) AS e FROM ev GROUP BY 1) JOIN (SELECT grp, min(date) AS s FROM mac WHERE date>=DATE '1995-02-01' GROUP BY 1) USING (grp) WHERE s>=e"""))
def c12(spark, sf):
    return C.late_series(B.unpriced_events(spark, sf), B.macro(spark, sf).where("date >= date'1995-02-01'"), "macro", ["grp"])


@query("C14_asof_not_before", needs="ev peer", sql=_line("error", "asof_not_before", "count(*)", table="peers",
       frm="(SELECT id, ao+3 AS a FROM peer) JOIN ev USING (id) WHERE a>=d HAVING count(*)>0"))
def c14(spark, sf):
    late = B.peers(spark, sf).withColumn("asof", F.date_add("asof", 3))
    return C.late_children(late, B.unpriced_events(spark, sf), "peers")


@query("C15_coverage", needs="peer", sql=" UNION ALL ".join(
    _line("info", r, n, table="peers", frm="peer") for r, n in (
        ("ids", "count(DISTINCT id)"), ("rows", "count(*)"), ("has:ret_21d", "count(ret_21d)"), ("has:ret_63d", "count(ret_63d)"))))
def c15(spark, sf):
    return C.coverage(B.peers(spark, sf), "peers", "id", ["ret_21d", "ret_63d"])


# ---- the whole contract ----

def faulty_events(spark, sf) -> DataFrame:
    """Events as an untyped export with faults planted by key."""
    k = F.col("id")
    return B.events(spark, sf).select(
        F.when(k % 50 == 0, k + 1).otherwise(k).alias("id"),
        F.when(k % 40 == 0, "n/a").otherwise(F.date_format("d", "yyyy-MM-dd")).alias("d"),
        F.when(k % 30 == 0, "x").when(k % 31 == 0, "-1").otherwise("1").alias("offer"), F.col("size").cast("string").alias("size"),
        (k % 3).alias("flag"), F.when(k % 7 == 0, 0).when(k % 7 == 1, 1).alias("is_target"),
        F.when(k % 997 == 0, F.lit("rare")).otherwise(F.col("grp")).alias("grp"))


_FAULTY = """fe AS (SELECT CASE WHEN id%50=0 THEN id+1 ELSE id END AS id, CASE WHEN id%40<>0 THEN d END AS d, CASE WHEN id%30=0 THEN 'x'
 WHEN id%31=0 THEN '-1' ELSE '1' END AS offer, id%3 AS flag, CASE WHEN id%7=0 THEN 0 WHEN id%7=1 THEN 1 END AS is_target,
 CASE WHEN id%997=0 THEN 'rare' ELSE grp END AS grp FROM ev),
fp AS (SELECT fe.id, (SELECT count(*) FROM px WHERE px.id=fe.id) AS n FROM fe),
late AS (SELECT count(*) FILTER (ao+3>=d) AS n FROM peer JOIN fe USING (id)),
fb AS (SELECT * FROM bm WHERE grp<>'ASIA' AND date>=DATE '1992-03-01'),
lines AS ("""


@query("C0_check", needs="ev px bm risk mac gl peer", sql=f"WITH {_FAULTY}" + " UNION ALL ".join([
    _line("error", "missing_column", "1", "'home'", "dictionary", "(SELECT 1) x"),
    _line("info", "missing_table", "1", "''", "deals", "(SELECT 1) x"),
    _line("error", "duplicate:id", "count(*)", frm="(SELECT id FROM fe GROUP BY 1 HAVING count(*)>1)"),
    _line("error", "unparseable:d", "count(*) FILTER (d IS NULL)", frm="fe"),
    _line("error", "not_numeric:offer", "count(*) FILTER (offer='x')", frm="fe"),
    _line("warning", "not_positive:offer", "count(*) FILTER (offer='-1')", frm="fe"),
    _line("error", "not_flag:flag", "count(*) FILTER (flag=2)", frm="fe"),
    _line("info", "target_rows", "count(*) FILTER (coalesce(is_target,1)<>0)", frm="fe"),
    _line("info", "universe_rows", "count(*) FILTER (is_target=0)", frm="fe"),
    _line("warning", "thin_group", "n", "grp", frm="(SELECT grp, count(*) AS n FROM fe GROUP BY 1 HAVING count(*)<30)"),
    _line("warning", "no_price_rows", "count(*)", table="prices", frm="fp WHERE n=0"),
    _line("warning", "short_path", "count(*)", table="prices", frm="fp WHERE n<5"),
    _line("error", "no_series", "1", "grp", "bench", "(SELECT DISTINCT grp FROM fe WHERE grp NOT IN (SELECT grp FROM fb)) x"),
    _line("warning", "not_daily", "floor(m)", "grp", "bench", "(SELECT grp, median(g) AS m FROM (SELECT grp, date-lag(date) OVER (PARTITION BY grp ORDER BY date) AS g FROM fb) y GROUP BY 1 HAVING median(g)>4) x"),
    _line("error", "starts_late", "s-e", "grp", "bench", "(SELECT grp, min(d) AS e FROM fe GROUP BY 1) x JOIN (SELECT grp, min(date) AS s FROM fb GROUP BY 1) z USING (grp) WHERE s>=e"),
    _line("error", "starts_late", "s-e", "''", "risk", "(SELECT min(d) AS e FROM fe) x, (SELECT min(date) AS s FROM risk) z WHERE s>=e"),
    _line("error", "asof_not_before", "n", table="peers", frm="late"),
    *[_line("info", r, n, table="macro", frm="mac") for r, n in (("ids", "count(DISTINCT date)"), ("rows", "count(*)"), ("has:vol_index", "count(vol_index)"), ("has:fx", "count(fx)"))],
    *[_line("info", r, n, table="macro_global", frm="gl") for r, n in (("ids", "count(DISTINCT date)"), ("rows", "count(*)"), *[(f"has:{c}", f"count({c})") for c in ("vix", "hy_oas", "em", "acwi")])],
    *[_line("info", r, n, table="peers", frm="peer") for r, n in (("ids", "count(DISTINCT id)"), ("rows", "count(*)"), ("has:ret_63d", "count(ret_63d)"))],
]) + ") SELECT * FROM lines WHERE n>0 OR rule='starts_late'")
def c0(spark, sf):
    bench = B.benchmark(spark, sf).where("grp <> 'ASIA' and date >= date'1992-03-01'")
    peers = B.peers(spark, sf).withColumn("asof", F.date_add("asof", 3))
    return C.check({"events": faulty_events(spark, sf), "prices": B.prices(spark, sf), "bench": bench, "risk": B.risk(spark, sf),
                    "deals": None, "macro": B.macro(spark, sf), "macro_global": B.macro_global(spark, sf), "peers": peers,
                    "members": B.members(spark, sf), "dictionary": B.dictionary(spark).drop("home")}, ["flag"], least_path=5)
