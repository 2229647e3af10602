"""Queries for joins, trailing aggregates, series, expanding statistics, members and labels."""
from __future__ import annotations

from pyspark.sql import functions as F

from checks import bindings as B
from checks.registry import query
from pitspark.functions import scalar as SC
from pitspark.functions.ordering import with_constants
from pitspark.operators import asof, expanding, interval, labels, members, series

H = (1, 3, 5)


# ---- joins ----

@query("J1_asof_strict", needs="ev bm", sql="""
SELECT e.id, e.grp, e.d, b.close FROM ev e ASOF LEFT JOIN bm b ON e.grp=b.grp AND e.d > b.date""")
def j1(spark, sf):
    return asof.asof_join(B.unpriced_events(spark, sf).select("id", "grp", "d"), B.benchmark(spark, sf),
                          ["grp"], "d", "date", ["close"])


def _grouped_prices(spark, sf):
    return B.prices(spark, sf).join(B.unpriced_events(spark, sf).select("id", "grp"), "id")


@query("J2_asof_inclusive", needs="ev px bm", sql="""
SELECT p.id, p.date, b.close AS level FROM (SELECT px.*, ev.grp FROM px JOIN ev USING (id)) p
ASOF LEFT JOIN bm b ON p.grp=b.grp AND p.date >= b.date""")
def j2(spark, sf):
    got = asof.asof_join(_grouped_prices(spark, sf),
                         B.benchmark(spark, sf).withColumnRenamed("close", "level"),
                         ["grp"], "date", "date", ["level"], strict=False)
    return got.select("id", "date", "level")


@query("J3_asof_fallback", needs="ret", rounds="base", sql="SELECT id, m0 AS base FROM ret")
def j3(spark, sf):
    first = labels.nth_close(B.prices(spark, sf), [1]).join(
        B.unpriced_events(spark, sf).select("id", "grp"), "id")
    bench = B.benchmark(spark, sf).withColumn("base", F.log("close"))
    return asof.asof_join_fallback(first, bench, ["grp"], "d_1", "date", ["base"]).select("id", "base")


@query("J4_equi_lookup", needs="ev px", sql="""
SELECT px.id, px.date, px.close, ev.grp, ev.offer FROM px JOIN ev USING (id)""")
def j4(spark, sf):
    return B.prices(spark, sf).join(B.events(spark, sf).select("id", "grp", "offer"), "id")


@query("J5_global_series", needs="ev gl", rounds="vix", sql="""
SELECT e.id, g.vix FROM ev e ASOF LEFT JOIN gl g ON e.d > g.date""")
def j5(spark, sf):
    s = B.macro_global(spark, sf)
    return asof.asof_join(B.unpriced_events(spark, sf).select("id", "grp", "d"), s,
                          asof.series_keys(s, ["grp"]), "d", "date", ["vix"]).select("id", "vix")


@query("J6_trailing_interval", needs="ev ship", rounds="amt_q", digits=2, sql="""
WITH dd AS (SELECT grp, date, count(*) AS c, sum(proceeds) AS s FROM ship GROUP BY 1,2),
k AS (SELECT DISTINCT grp, d FROM ev),
w AS (SELECT k.grp, k.d, coalesce(sum(c),0) AS c, coalesce(sum(s),0) AS s FROM k LEFT JOIN dd
  ON dd.grp=k.grp AND dd.date < k.d AND dd.date >= k.d - 90 GROUP BY 1,2)
SELECT e.id, CAST(w.c AS BIGINT) AS cnt_q, w.s AS amt_q FROM ev e JOIN w ON e.grp=w.grp AND e.d=w.d""")
def j6(spark, sf):
    ev = B.unpriced_events(spark, sf).select("id", "grp", "d")
    w = interval.trailing_aggregate(ev, B.shipments(spark, sf), ["grp"], "d", "date", {"q": 90},
                                    {"amt": "proceeds"})
    return ev.join(w, ["grp", "d"]).select("id", "cnt_q", "amt_q")


_RECENT = """recent AS (SELECT k.grp, k.d, h.id AS cand, h.d AS cd, h.size,
  row_number() OVER (PARTITION BY k.grp, k.d ORDER BY h.d DESC, h.id DESC) AS place
  FROM (SELECT DISTINCT grp, d FROM ev) k JOIN ev h ON h.grp=k.grp AND h.d < k.d AND h.d >= k.d - 90
  QUALIFY place <= 10)"""


def _recent(spark, sf, rel=False):
    ev = B.events(spark, sf)
    ret = _returns(spark, sf)
    hist = ev.join(ret, "id", "left")
    return interval.top_k_recent(ev, hist, ["grp"], "d", "d", "id", 90, 10,
                                 ["size", "d_1", "d_5", "raw_1", "raw_5", "exc_1", "exc_5"])


def _returns(spark, sf, **kw):
    return labels.returns(B.events(spark, sf), B.prices(spark, sf), B.benchmark(spark, sf), H, **kw)


@query("J7_top_k_recent", needs="ev", sql=f"WITH {_RECENT} SELECT grp, d, cand, place FROM recent")
def j7(spark, sf):
    ev = B.unpriced_events(spark, sf)
    got = interval.top_k_recent(ev, ev, ["grp"], "d", "d", "id", 90, 10, ["size"])
    return got.select("grp", "d", F.posexplode("recent").alias("_i", "r")).select(
        "grp", "d", F.col("r.tie").alias("cand"), (F.col("_i") + 1).alias("place"))


@query("J8_observable", needs="ev ret", sql=f"""
WITH {_RECENT} SELECT r.grp, r.d, r.cand FROM recent r JOIN ret ON ret.id=r.cand WHERE ret.d_5 < r.d""")
def j8(spark, sf):
    seen = interval.observable(F.col("recent"), F.col("d"), "d_5")
    return _recent(spark, sf).select("grp", "d", F.explode(seen).alias("r")).select(
        "grp", "d", F.col("r.tie").alias("cand"))


@query("J9_temporal_violation", needs="ev peer", sql="""
SELECT p.id, count(*) AS n FROM (SELECT id, ao + 3 AS ao FROM peer) p JOIN ev USING (id)
WHERE p.ao >= ev.d GROUP BY 1""")
def j9(spark, sf):
    late = B.peers(spark, sf).withColumn("asof", F.date_add("asof", 3))
    bad = asof.temporal_violations(late, B.unpriced_events(spark, sf), "id", "asof", "d")
    return bad.groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query("J10_semi_anti", sql="""
SELECT o_orderkey AS id, CAST(EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey=o_orderkey) AS INT) AS priced
FROM orders""")
def j10(spark, sf):
    ids = B.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    have = B.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"))
    return (ids.join(have, "id", "left_semi").withColumn("priced", F.lit(1))
            .unionByName(ids.join(have, "id", "left_anti").withColumn("priced", F.lit(0))))


_ALIAS = [("red", "bb", "R1"), ("red widget", "global", "R2"), ("small ring", "regional", "R3"),
          ("ring", "local", "R4"), ("supplier", "bb", "S1"), ("customer", "global", "C1"),
          ("blue", "bb", "R5"), ("widget", "local", "R6"), ("blue gear", "regional", "R7")]


@query("J12_dictionary_match", sql="""
WITH nm AS (SELECT DISTINCT p_name AS name FROM part UNION SELECT DISTINCT s_name FROM supplier
  UNION SELECT DISTINCT c_name FROM customer),
al(alias, class, home, ord) AS (VALUES """ + ", ".join(
    f"('{a}','{c}','{h}',{i})" for i, (a, c, h) in enumerate(_ALIAS)) + """),
hit AS (SELECT nm.name, al.*, row_number() OVER (PARTITION BY nm.name ORDER BY length(alias) DESC, ord) AS rn
  FROM nm JOIN al ON ('_'||trim(regexp_replace(lower(name),'[^a-z0-9]+','_','g'),'_')||'_')
     LIKE ('%\\_'||replace(alias,' ','\\_')||'\\_%') ESCAPE '\\')
SELECT nm.name, hit.alias, hit.class, hit.home FROM nm LEFT JOIN hit ON nm.name=hit.name AND rn=1""")
def j12(spark, sf):
    names = (B.table(spark, sf, "part").select(F.col("p_name").alias("name"))
             .unionByName(B.table(spark, sf, "supplier").select(F.col("s_name").alias("name")))
             .unionByName(B.table(spark, sf, "customer").select(F.col("c_name").alias("name"))))
    al = spark.createDataFrame([(a, c, h, i) for i, (a, c, h) in enumerate(_ALIAS)],
                               "alias string, class string, home string, ord int")
    return members.dictionary_match(names, "name", al)


@query("J13_classify_members", needs="mem dict", sql="""
SELECT m.member, coalesce(x.class,'') AS class, coalesce(x.home,'') AS home,
  CAST(x.class IS NULL AS INT) AS unknown, m.n
FROM (SELECT member, count(*) AS n FROM mem GROUP BY 1) m
LEFT JOIN (SELECT * FROM dict WHERE trim(class)<>'') x USING (member)""")
def j13(spark, sf):
    long = B.members(spark, sf)
    draft = members.draft_dictionary(members.classify_members(long, B.dictionary(spark)))
    return draft.join(long.groupBy("member").agg(F.count(F.lit(1)).alias("n")), "member")


@query("J14_peer_select", needs="ev uni", sql="""
WITH e AS (SELECT ev.id, CAST(id%97 AS VARCHAR) AS tk, id%12 AS subgroup, grp FROM ev),
near AS (SELECT DISTINCT subgroup, grp FROM uni),
c AS (SELECT e.id, u.ticker, row_number() OVER (PARTITION BY e.id ORDER BY u.cap DESC, u.ticker) AS place
  FROM e LEFT JOIN near n USING (subgroup, grp) JOIN uni u ON u.subgroup=e.subgroup
   AND (n.grp IS NULL OR u.grp=e.grp)
  WHERE u.ticker <> e.tk AND u.ticker <> CAST(e.id AS VARCHAR) QUALIFY place <= 4)
SELECT id, CAST(place AS INT) AS place, ticker AS peer FROM c""")
def j14(spark, sf):
    ev = B.unpriced_events(spark, sf).select("id", "grp", (F.col("id") % 97).cast("string").alias("tk"),
                                             (F.col("id") % 12).alias("subgroup"))
    return members.peer_select(ev, B.universe(spark, sf), "id", "tk", "subgroup", "grp", 4)


@query("J17_event_window", needs="ev mac", sql="""
SELECT e.id, m.date, m.fx FROM ev e JOIN mac m ON m.grp=e.grp AND m.date BETWEEN e.d - 6 AND e.d - 1""")
def j17(spark, sf):
    got = interval.event_window(B.macro(spark, sf), B.unpriced_events(spark, sf), "grp", "date", "d", "id",
                                -6, -1)
    return got.select("id", "date", "fx")


# ---- trailing and grouped aggregates ----

_F1 = _RECENT + """, f1 AS (SELECT r.grp, r.d, r.size, ret.raw_5 AS x FROM recent r JOIN ret ON ret.id=r.cand
   WHERE ret.d_5 < r.d AND ret.raw_5 IS NOT NULL)"""


@query("A1_recent_stats", needs="ev ret", rounds="med vw iqr", sql=f"""
WITH {_F1}, s AS (SELECT grp, d, quantile_cont(x,0.5) AS med,
   CASE WHEN sum(size)>0 THEN sum(x*size)/sum(size) ELSE avg(x) END AS vw, count(*) AS n,
   quantile_cont(x,0.75)-quantile_cont(x,0.25) AS iqr FROM f1 GROUP BY 1,2)
SELECT e.id, coalesce(med,0.0) AS med, coalesce(vw,0.0) AS vw, CAST(coalesce(n,0) AS DOUBLE) AS n,
  coalesce(iqr,0.0) AS iqr FROM ev e LEFT JOIN s ON s.grp=e.grp AND s.d=e.d""")
def a1(spark, sf):
    s = interval.recent_stats(_recent(spark, sf), ["grp"], "d", "d_5", "raw_5", "size", "x")
    return B.unpriced_events(spark, sf).join(s, ["grp", "d"], "left").select(
        "id", *[F.col(f"{c}_x").alias(c) for c in ("med", "vw", "n", "iqr")])


@query("A2_break_stats", needs="ev ret", rounds="brk depth", sql=f"""
WITH {_F1}, s AS (SELECT grp, d, avg(CAST(x<0 AS INT)) AS brk, avg(x) FILTER (x<0) AS depth FROM f1 GROUP BY 1,2)
SELECT e.id, coalesce(brk,0.0) AS brk, coalesce(depth,0.0) AS depth
FROM ev e LEFT JOIN s ON s.grp=e.grp AND s.d=e.d""")
def a2(spark, sf):
    s = interval.recent_stats(_recent(spark, sf), ["grp"], "d", "d_5", "raw_5", "size", "x")
    return B.unpriced_events(spark, sf).join(s, ["grp", "d"], "left").select(
        "id", F.col("break_x").alias("brk"), F.col("depth_x").alias("depth"))


@query("A3_peer_stats", needs="ev peer", rounds="peer_med_21d peer_iqr_21d peer_med_63d", sql="""
SELECT ev.id, CAST(count(ret_21d) AS DOUBLE) AS peer_n, coalesce(quantile_cont(ret_21d,0.5),0.0) AS peer_med_21d,
  CASE WHEN count(ret_21d)>=2 THEN quantile_cont(ret_21d,0.75)-quantile_cont(ret_21d,0.25) ELSE 0.0 END AS peer_iqr_21d,
  coalesce(quantile_cont(ret_63d,0.5),0.0) AS peer_med_63d
FROM ev LEFT JOIN peer ON peer.id=ev.id GROUP BY ev.id""")
def a3(spark, sf):
    return members.peer_stats(B.unpriced_events(spark, sf), B.peers(spark, sf), "id")


_SUPPLY = """dd AS (SELECT grp, date, count(*) AS c, sum(proceeds) AS s FROM ship GROUP BY 1,2),
de AS (SELECT grp, d, count(*) AS c FROM ev GROUP BY 1,2),
s1 AS (SELECT k.grp, k.d, coalesce(sum(dd.c) FILTER (dd.date >= k.d-90),0) AS cnt,
   coalesce(sum(s) FILTER (dd.date >= k.d-90),0) AS amt, coalesce(sum(dd.c),0) AS cl
   FROM de k LEFT JOIN dd ON dd.grp=k.grp AND dd.date<k.d AND dd.date>=k.d-365 GROUP BY 1,2),
s2 AS (SELECT k.grp, k.d, coalesce(sum(h.c),0) AS ce FROM de k LEFT JOIN de h ON h.grp=k.grp AND h.d<k.d
   AND h.d>=k.d-90 GROUP BY 1,2),
sup AS (SELECT s1.grp, s1.d, CAST(cnt AS DOUBLE) AS supply_cnt, ln(1+amt) AS supply_amt,
   CAST(ce AS DOUBLE) AS supply_events, cnt/greatest(cl*(90/365.0::DOUBLE),1.0) AS supply_accel
   FROM s1 JOIN s2 ON s1.grp=s2.grp AND s1.d=s2.d)"""


def _supply(spark, sf):
    ev = B.unpriced_events(spark, sf)
    return interval.supply_stats(ev, B.shipments(spark, sf), ev, ["grp"], "d", "date", "proceeds")


@query("A4_supply_stats", needs="ev ship", rounds="supply_amt supply_accel",
       sql=f"WITH {_SUPPLY} SELECT * FROM sup")
def a4(spark, sf):
    return _supply(spark, sf)


_SHARE = """om AS (SELECT ev.grp, ev.d, mem.member, sum(size) AS s FROM mem JOIN ev USING (id) GROUP BY 1,2,3),
kd AS (SELECT DISTINCT grp, d FROM om),
sh AS (SELECT kd.grp, kd.d, om.member, sum(om.s) AS share FROM kd JOIN om ON om.grp=kd.grp AND om.d<kd.d
   AND om.d>=kd.d-1095 GROUP BY 1,2,3 HAVING sum(om.s)>0)"""


@query("A5_member_share", needs="ev mem", rounds="share", digits=2,
       sql=f"WITH {_SHARE} SELECT grp, d, member, share FROM sh")
def a5(spark, sf):
    return interval.member_share(B.unpriced_events(spark, sf), B.members(spark, sf), ["grp"], "d", "id",
                                 "size", 1095)


@query("W15_percentile_rank_max", needs="ev mem", rounds="prestige", sql=f"""
WITH {_SHARE}, rk AS (SELECT *, row_number() OVER (PARTITION BY grp,d ORDER BY share, member)
   / count(*) OVER (PARTITION BY grp,d) AS r FROM sh),
b AS (SELECT m.id, max(r) AS r FROM mem m JOIN ev USING (id) JOIN rk ON rk.grp=ev.grp AND rk.d=ev.d
   AND rk.member=m.member GROUP BY 1)
SELECT ev.id, coalesce(b.r, 0.0) AS prestige FROM ev LEFT JOIN b USING (id)""")
def w15(spark, sf):
    return members.percentile_rank_max(B.unpriced_events(spark, sf), B.members(spark, sf), ["grp"], "d",
                                       "id", "size")


_BLOCK = """cls AS (SELECT member, class, home FROM dict WHERE trim(class)<>''),
mm AS (SELECT m.id, count(*) AS n, coalesce(bool_or(c.class='bb'),false) AS bb,
   coalesce(bool_or(c.class='global'),false) AS gl, coalesce(bool_or(c.class='regional'),false) AS rg,
   coalesce(bool_or(c.class='local'),false) AS lc, coalesce(bool_or(c.home=ev.grp),false) AS dom
   FROM mem m JOIN ev USING (id) LEFT JOIN cls c USING (member) GROUP BY 1),
fl AS (SELECT ev.id, coalesce(n,0) AS n, coalesce(bb,false) bb, coalesce(gl,false) gl, coalesce(rg,false) rg,
   coalesce(lc,false) lc, coalesce(dom,false) dom FROM ev LEFT JOIN mm USING (id)),
kd AS (SELECT *, CASE WHEN NOT (bb OR gl OR rg OR lc) THEN 'unclassified' WHEN bb AND n=1 THEN 'bb_solo'
   WHEN bb AND dom THEN 'bb_dom' WHEN bb THEN 'bb_intl' WHEN gl THEN 'global_led'
   WHEN rg AND dom THEN 'regional_dom' WHEN rg THEN 'regional_intl' ELSE 'local_only' END AS kind FROM fl)"""


def _block(spark, sf):
    long = B.members(spark, sf)
    cls = members.classify_members(long, B.dictionary(spark))
    return members.syndicate_block(B.unpriced_events(spark, sf), long, cls, "id", "grp", B.CLASSES, B.RULES, B.FLAGS)


@query("A6_syndicate_block", needs="ev mem dict", rounds="log_n_members", sql=f"""
WITH {_BLOCK} SELECT id, CAST(n AS INT) AS n_members, ln(1.0+n) AS log_n_members, CAST(bb AS INT) AS has_bb,
 CAST(gl AS INT) AS has_global, CAST(rg AS INT) AS has_regional, CAST(lc AS INT) AS has_local,
 CAST(dom AS INT) AS has_domestic, CAST(bb AND dom AS INT) AS combo_bb_x_dom,
 CAST(bb AND rg AS INT) AS combo_bb_x_reg, CAST(n=1 AS INT) AS solo, CAST(n>=6 AS INT) AS jumbo, """ + ", ".join(
    f"CAST(kind='{k}' AS INT) AS kind_{k}" for k, _ in B.RULES) + " FROM kd")
def a6(spark, sf):
    return _block(spark, sf)


@query("P13_archetype", needs="ev mem dict", sql=f"WITH {_BLOCK} SELECT id, kind FROM kd")
def p13(spark, sf):
    b = _block(spark, sf)
    return b.unpivot("id", [f"kind_{k}" for k, _ in B.RULES], "kind", "on").where("on = 1").select(
        "id", F.substring("kind", 6, 100).alias("kind"))


@query("A7_category_counts", needs="ev mem dict", sql=f"""
WITH {_BLOCK}, k(kind) AS (VALUES {", ".join(f"('{k}')" for k, _ in B.RULES)}),
c AS (SELECT k.kind, count(kd.id) AS n FROM k LEFT JOIN kd ON kd.kind=k.kind GROUP BY 1)
SELECT kind, n, CAST(kind='unclassified' AND n > 0.2*(SELECT count(*) FROM ev) AS INT) AS alert FROM c""")
def a7(spark, sf):
    return members.category_counts(_block(spark, sf), "unclassified")


@query("A13_distinct_sets", needs="ev px", sql="""
SELECT count(DISTINCT grp) AS groups, count(DISTINCT id) AS ids,
 (SELECT count(DISTINCT id) FROM px) AS priced FROM ev""")
def a13(spark, sf):
    ev = B.unpriced_events(spark, sf).agg(F.countDistinct("grp").alias("groups"),
                                          F.countDistinct("id").alias("ids"))
    return with_constants(ev, B.prices(spark, sf).agg(F.countDistinct("id").alias("priced")))


# ---- series ----

_BW = "WINDOW w AS (PARTITION BY grp ORDER BY date)"


@query("W1_nth_close", needs="nth", sql="""
SELECT id, c_1, d_1, c_3, d_3, c_5, d_5 FROM nth""")
def w1(spark, sf):
    return labels.nth_close(B.prices(spark, sf), H)


def _bench(spark, sf, exprs, **kw):
    return series.with_series(B.benchmark(spark, sf), ["grp"], "date", exprs, **kw)


@query("W2_log_ret", needs="bm", rounds="r", sql=f"""
SELECT grp, date, coalesce(ln(close)-lag(ln(close),63) OVER w, 0.0) AS r FROM bm {_BW}""")
def w2(spark, sf):
    return _bench(spark, sf, {"r": series.log_ret("close", 63)}).select("grp", "date", "r")


@query("W3_drawdown", needs="bm", rounds="dd", sql="""
SELECT grp, date, ln(close)-max(ln(close)) OVER (PARTITION BY grp ORDER BY date
  ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) AS dd FROM bm""")
def w3(spark, sf):
    return _bench(spark, sf, {"dd": series.drawdown("close")}, chunk=512).select("grp", "date", "dd")


@query("W4_realised_vol", needs="bm", rounds="vol", sql=f"""
WITH s AS (SELECT grp, date, ln(close)-lag(ln(close)) OVER w AS x FROM bm {_BW})
SELECT grp, date, CASE WHEN count(x) OVER v >= 10 THEN stddev_pop(x) OVER v * sqrt(252) ELSE 0.0 END AS vol
FROM s WINDOW v AS (PARTITION BY grp ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)""")
def w4(spark, sf):
    s = _bench(spark, sf, {"x": series.log_step("close")})
    return series.with_series(s, ["grp"], "date", {"vol": series.realised_vol("x")}).select(
        "grp", "date", "vol")


@query("W5_rolling_z", needs="mac", rounds="z", sql="""
WITH s AS (SELECT grp, date, vol_index AS v, row_number() OVER (PARTITION BY grp ORDER BY date) AS rn,
 avg(vol_index) OVER f AS m, stddev_pop(vol_index) OVER f AS sd FROM mac
 WINDOW f AS (PARTITION BY grp ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW))
SELECT grp, date, CASE WHEN rn>40 AND sd>1e-12 THEN (v-m)/sd ELSE 0.0 END AS z FROM s""")
def w5(spark, sf):
    return series.with_series(B.macro(spark, sf), ["grp"], "date", {"z": series.rolling_z("vol_index")},
                              chunk=512).select("grp", "date", "z")


@query("W6_pct_change", needs="gl", rounds="chg", sql="""
SELECT date, coalesce(vix/lag(vix,21) OVER (ORDER BY date)-1, 0.0) AS chg FROM gl""")
def w6(spark, sf):
    return series.with_series(B.macro_global(spark, sf), [], "date", {"chg": series.pct_change("vix")}
                              ).select("date", "chg")


@query("W7_ret_spread", needs="gl", rounds="spread", sql="""
SELECT date, coalesce(ln(em)-lag(ln(em),63) OVER w,0.0)-coalesce(ln(acwi)-lag(ln(acwi),63) OVER w,0.0) AS spread
FROM gl WINDOW w AS (ORDER BY date)""")
def w7(spark, sf):
    return series.with_series(B.macro_global(spark, sf), [], "date",
                              {"spread": series.ret_spread("em", "acwi")}).select("date", "spread")


def _z_inputs(spark, sf):
    return B.unpriced_events(spark, sf).join(_supply(spark, sf), ["grp", "d"])


@query("W8_expanding_z", needs="ev ship", rounds="z_amt z_size", sql=f"""
WITH {_SUPPLY}, r AS (SELECT e.id, e.grp, e.d, s.supply_amt AS a, e.size AS b FROM ev e
  JOIN sup s ON s.grp=e.grp AND s.d=e.d)
SELECT id, CASE WHEN count(*) OVER p >= 2 AND stddev_samp(a) OVER p > 1e-12
   THEN (a-avg(a) OVER p)/stddev_samp(a) OVER p ELSE 0.0 END AS z_amt,
 CASE WHEN count(*) OVER p >= 2 AND stddev_samp(b) OVER p > 1e-12
   THEN (b-avg(b) OVER p)/stddev_samp(b) OVER p ELSE 0.0 END AS z_size
FROM r WINDOW p AS (PARTITION BY grp ORDER BY d, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def w8(spark, sf):
    got = expanding.expanding_z(_z_inputs(spark, sf), ["grp"], "d", "id",
                                {"z_amt": "supply_amt", "z_size": "size"})
    return got.select("id", "z_amt", "z_size")


_POPS = """pk AS (SELECT DISTINCT grp, d FROM ev),
pr AS (SELECT ev.grp, ev.d, ev.id, ret.raw_1 AS x, ret.d_1 FROM ev JOIN ret USING (id) WHERE raw_1 IS NOT NULL),
pp AS (SELECT k.grp, k.d, pr.x, row_number() OVER (PARTITION BY k.grp, k.d ORDER BY pr.d DESC, pr.id DESC) AS rn
  FROM pk k JOIN pr ON pr.grp=k.grp AND pr.d<k.d AND pr.d_1<k.d QUALIFY rn<=10),
pop AS (SELECT k.grp, k.d, count(pp.x) AS n_seen, CASE WHEN count(pp.x)>=3 THEN list_sum(list(pp.x ORDER BY rn))/count(pp.x) END AS mean_seen
  FROM pk k LEFT JOIN pp ON pp.grp=k.grp AND pp.d=k.d GROUP BY 1,2)"""


def _pops(spark, sf):
    ev = B.unpriced_events(spark, sf)
    hist = ev.join(_returns(spark, sf), "id")
    return interval.last_n_mean(ev, hist, ["grp"], "d", "d", "id", "d_1", "raw_1")


@query("W9_last_n_mean", needs="ev ret", rounds="mean_seen",
       sql=f"WITH {_POPS} SELECT grp, d, n_seen, mean_seen FROM pop")
def w9(spark, sf):
    return _pops(spark, sf)


@query("W10_expanding_terciles", needs="ev ret", sql=f"""
WITH {_POPS}, rw AS (SELECT e.id, e.grp, e.d, p.mean_seen AS x FROM ev e JOIN pop p ON p.grp=e.grp AND p.d=e.d),
cl AS (SELECT id, grp, x, list(x) OVER (PARTITION BY grp ORDER BY d, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past
  FROM rw WHERE x IS NOT NULL),
so AS (SELECT id, x, len(past) AS n, list_sort(past) AS s FROM cl)
SELECT rw.id, CASE WHEN so.id IS NULL OR coalesce(n,0)<5 THEN 0 WHEN so.x > s[CAST(floor(2*n/3) AS INT)+1] THEN 1
  WHEN so.x < s[CAST(floor(n/3) AS INT)+1] THEN -1 ELSE 0 END AS regime FROM rw LEFT JOIN so USING (id)""")
def w10(spark, sf):
    got = expanding.expanding_terciles(B.unpriced_events(spark, sf), _pops(spark, sf), ["grp"], "d", "id",
                                       "mean_seen", "regime")
    return got.select("id", "regime")


_SEQ = """rs AS (SELECT date, v, row_number() OVER (ORDER BY date) AS rn, v-lag(v) OVER (ORDER BY date) AS dv,
  list(v) OVER (ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) AS a,
  count(*) OVER (ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) AS k FROM risk),
sq AS (SELECT date, list_concat(list_transform(range(21-k), lambda i: a[1]), a) AS seq,
  CASE WHEN rn>=63 THEN stddev_pop(dv) OVER (ORDER BY date ROWS BETWEEN 61 PRECEDING AND CURRENT ROW)*sqrt(252)
  ELSE 0.0 END AS vol FROM rs)"""


def _risk_series(spark, sf):
    s = series.with_series(B.risk(spark, sf), [], "date", {"dv": series.step("v")})
    s = series.with_series(s, [], "date", {"seq": series.window_array("v"), "vol": series.change_vol("dv")})
    return s.withColumns(series.sequence_summaries("seq", "risk"))


@query("W11_window_array", needs="ev risk", rounds="s1 s2 s20 s21", sql=f"""
WITH {_SEQ} SELECT e.id, q.seq[1] AS s1, q.seq[2] AS s2, q.seq[20] AS s20, q.seq[21] AS s21
FROM ev e ASOF LEFT JOIN sq q ON e.d > q.date""")
def w11(spark, sf):
    ev = B.unpriced_events(spark, sf).select("id", "d")         # events before the series starts have none
    got = asof.asof_join(ev, _risk_series(spark, sf), [], "d", "date", ["seq"])
    return got.select("id", *[F.element_at("seq", i).alias(f"s{i}") for i in (1, 2, 20, 21)])


@query("W12_sequence_summaries", needs="risk", rounds="risk_level risk_d5 risk_dw risk_mean risk_std", sql=f"""
WITH {_SEQ} SELECT date, seq[21] AS risk_level, seq[21]-seq[16] AS risk_d5, seq[21]-seq[1] AS risk_dw,
 list_avg(seq) AS risk_mean, list_stddev_pop(seq) AS risk_std FROM sq""")
def w12(spark, sf):
    return _risk_series(spark, sf).select("date", "risk_level", "risk_d5", "risk_dw", "risk_mean", "risk_std")


@query("W13_change_vol", needs="risk", rounds="vol", digits=4, sql=f"WITH {_SEQ} SELECT date, vol FROM sq")
def w13(spark, sf):
    return _risk_series(spark, sf).select("date", "vol")


@query("W14_sequence_diff", needs="risk", rounds="d1 d20", sql=f"""
WITH {_SEQ} SELECT date, seq[2]-seq[1] AS d1, seq[21]-seq[20] AS d20, 20 AS n FROM sq""")
def w14(spark, sf):
    a = _risk_series(spark, sf).select("date", series.sequence_diff("seq").alias("a"))
    return a.select("date", F.element_at("a", 1).alias("d1"), F.element_at("a", 20).alias("d20"),
                    F.size("a").alias("n"))


@query("W16_peer_trailing_returns", needs="ev mac", sql="""
WITH p AS (SELECT e.id, e.grp, m.date, ln(m.fx) AS lx, row_number() OVER (PARTITION BY e.id ORDER BY m.date DESC) AS rn
  FROM ev e JOIN mac m ON m.grp=e.grp AND m.date BETWEEN e.d-140 AND e.d-1)
SELECT id, grp, round(max(lx) FILTER (rn=1)-max(lx) FILTER (rn=22),6)+0.0 AS ret_21d,
 round(max(lx) FILTER (rn=1)-max(lx) FILTER (rn=64),6)+0.0 AS ret_63d, max(date) AS "asof" FROM p GROUP BY 1,2
HAVING count(*) >= 22""")
def w16(spark, sf):
    ev = B.unpriced_events(spark, sf).select("id", "grp", "d")
    return series.trailing_returns(B.macro(spark, sf), ev, ["grp"], "date", "fx", "d", "id")


@query("W19_gap_days", needs="bm", sql=f"""
SELECT grp, date, CAST(date - lag(date) OVER w AS INT) AS gap FROM bm {_BW}""")
def w19(spark, sf):
    return _bench(spark, sf, {"gap": series.gap_days("date")}).select("grp", "date", "gap")


# ---- labels ----

@query("L1_labels_offer", needs="ret", rounds="y_1 y_3 y_5", sql="""
SELECT id, exc_1 AS y_1, exc_3 AS y_3, exc_5 AS y_5 FROM ret""")
def l1(spark, sf):
    return _returns(spark, sf).select("id", "y_1", "y_3", "y_5")


@query("L2_labels_first_close", needs="ret", rounds="y_3 y_5", sql="""
SELECT id, ln(c_3)-ln(c_1)-(m3-m1) AS y_3, ln(c_5)-ln(c_1)-(m5-m1) AS y_5 FROM ret""")
def l2(spark, sf):
    got = labels.returns(B.events(spark, sf), B.prices(spark, sf), B.benchmark(spark, sf), (3, 5),
                         anchor="first_close")
    return got.select("id", "y_3", "y_5")


@query("L3_return_basis", needs="ret", rounds="raw rel", sql="""
SELECT id, raw_5 AS raw, exc_5 AS rel FROM ret""")
def l3(spark, sf):
    return _returns(spark, sf).select("id", F.col(labels.return_basis(5)).alias("raw"),
                                      F.col(labels.return_basis(5, True)).alias("rel"))


@query("L4_label_end", needs="ev ret", sql="""
SELECT id, d_5 AS label_end FROM ret JOIN ev USING (id) WHERE d_5 IS NOT NULL""")
def l4(spark, sf):
    p = B.unpriced_events(spark, sf).join(_returns(spark, sf), "id", "left")
    return labels.training_rows(p, 5).select("id", "label_end")


@query("L5_binary_label", needs="ret", sql="SELECT id, CAST(exc_5>0 AS INT) AS up FROM ret")
def l5(spark, sf):
    return _returns(spark, sf).select("id", labels.binary_label("y_5").alias("up"))


# ---- projections and filters ----

@query("P2_is_target", sql="""
SELECT o_orderkey AS id, CAST(coalesce(CASE WHEN o_orderstatus='F' THEN NULL ELSE CAST(o_orderstatus<>'P' AS INT) END,1)<>0
 AS INT) AS target FROM orders""")
def p2(spark, sf):
    o = B.table(spark, sf, "orders")
    flag = F.when(F.col("o_orderstatus") != "F", (F.col("o_orderstatus") != "P").cast("int"))
    return o.select(F.col("o_orderkey").alias("id"), labels.is_target(flag).cast("int").alias("target"))


@query("P3_fill_zero", needs="ev", sql="SELECT id, coalesce(offer,0.0) AS offer FROM ev")
def p3(spark, sf):
    return SC.fill_zero(B.events(spark, sf), ["offer"]).select("id", "offer")


@query("P4_one_hot", needs="ev", sql="SELECT id, " + ", ".join(
    f"CAST(grp='{r}' AS INT) AS \"mkt_{r}\"" for r in B.REGIONS) + " FROM ev")
def p4(spark, sf):
    from pitspark.plans.panel import one_hot
    return one_hot(B.unpriced_events(spark, sf), "grp", "mkt_", B.REGIONS).select(
        "id", *[f"mkt_{r}" for r in B.REGIONS])


@query("P5_known_entities", needs="px ev", sql="""
SELECT id, count(*) AS n FROM px WHERE id IN (SELECT id FROM ev WHERE grp='ASIA') GROUP BY 1""")
def p5(spark, sf):
    ev = B.unpriced_events(spark, sf).where("grp = 'ASIA'")
    return labels.known_entities_only(B.prices(spark, sf), ev).groupBy("id").agg(
        F.count(F.lit(1)).alias("n"))


@query("P6_complete_labels", needs="ev ret", sql="""
SELECT id FROM ev JOIN ret USING (id) WHERE c_3 IS NOT NULL AND is_target=1""")
def p6(spark, sf):
    p = B.unpriced_events(spark, sf).join(_returns(spark, sf), "id", "left")
    return labels.training_rows(p, 3).where(labels.is_target("is_target")).select("id")


@query("P7_inference_mode", needs="ev ret", rounds="y_5", sql="""
SELECT ev.id, exc_5 AS y_5, coalesce(d_5, d) AS label_end FROM ev LEFT JOIN ret USING (id) WHERE is_target=1""")
def p7(spark, sf):
    p = B.unpriced_events(spark, sf).join(_returns(spark, sf), "id", "left")
    return labels.inference_rows(p, 5).where(labels.is_target("is_target")).select("id", "y_5", "label_end")


@query("P8_new_only", needs="ev ret", sql="""
SELECT ev.id, d FROM ev LEFT JOIN ret USING (id) WHERE exc_5 IS NULL AND is_target=1""")
def p8(spark, sf):
    p = B.unpriced_events(spark, sf).join(_returns(spark, sf), "id", "left")
    return labels.new_only(p.where(labels.is_target("is_target")), 5).select("id", "d")


@query("P10_clip", sql="""
SELECT o_orderkey AS id, greatest(least((o_totalprice-250000)/50000, 2.0), -2.0) AS z FROM orders""",
       rounds="z")
def p10(spark, sf):
    z = (F.col("o_totalprice") - 250000) / 50000
    return B.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), SC.clip(z, 2.0).alias("z"))


@query("P12_normalise_name", sql="""
SELECT o_orderkey AS id, trim(regexp_replace(lower(o_orderpriority),'[^a-z0-9]+','_','g'),'_') AS k FROM orders""")
def p12(spark, sf):
    return B.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"),
                                               SC.normalise_name("o_orderpriority").alias("k"))


@query("P14_exclude_self", needs="ev uni", sql="""
SELECT e.id, u.ticker AS peer FROM ev e JOIN uni u ON u.subgroup = e.id%12 AND u.grp = e.grp
WHERE u.ticker <> CAST(e.id%97 AS VARCHAR) AND u.ticker <> CAST(e.id AS VARCHAR)
QUALIFY row_number() OVER (PARTITION BY e.id ORDER BY u.cap DESC, u.ticker) <= 1""")
def p14(spark, sf):
    ev = B.unpriced_events(spark, sf).select("id", "grp", (F.col("id") % 97).cast("string").alias("tk"),
                                             (F.col("id") % 12).alias("subgroup"))
    near = B.universe(spark, sf).select("subgroup", "grp").distinct()
    return members.peer_select(ev.join(near, ["subgroup", "grp"], "left_semi"), B.universe(spark, sf),
                               "id", "tk", "subgroup", "grp", 1).select("id", "peer")
