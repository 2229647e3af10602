"""Queries for the panel, folds, scaling and model rungs."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from checks import bindings as B
from checks.features import _F1, _POPS, _RECENT, _SEQ, _SHARE, _SUPPLY  # noqa: F401
from checks.registry import query
from pitspark.functions.ordering import row_index
from pitspark.operators.labels import training_rows
from pitspark.plans import diagnostics as G, folds as V, models as M, scaling as X
from pitspark.plans.panel import Tables, assemble_panel, select_groups
from pitspark.session import checkpoint_dir, durable

FEATURES = ["size", "f1_med_1w", "f1_n_1d", "f3_prc_3m", "m_geo_mom_63d", "prestige", "p1_med_21d", "n_members"]
_SAVED: dict[tuple, DataFrame] = {}


def saved(spark, sf, name, make) -> DataFrame:
    """Panels and fold tables are written once per session and then only read."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _SAVED:
        _SAVED[key] = durable(make(spark, sf))
    return _SAVED[key]


def tables(spark, sf) -> Tables:
    return Tables(events=B.events(spark, sf), prices=B.prices(spark, sf), bench=B.benchmark(spark, sf),
                  risk=B.risk(spark, sf), deals=B.shipments(spark, sf), macro=B.macro(spark, sf),
                  macro_global=B.macro_global(spark, sf), peers=B.peers(spark, sf),
                  members=B.members(spark, sf), dictionary=B.dictionary(spark), class_names=B.CLASSES,
                  rules=B.RULES, flags=B.FLAGS)


def panel(spark, sf) -> DataFrame:
    return saved(spark, sf, "panel", lambda s, d: assemble_panel(tables(s, d), horizons=(1, 3)))


def folds(spark, sf) -> DataFrame:
    return saved(spark, sf, "folds", lambda s, d: V.walk_forward(panel(s, d)))


def rows(spark, sf) -> DataFrame:
    """Panel rows of every fold with the features used by the model rungs."""
    return saved(spark, sf, "rows", lambda s, d: folds(s, d).join(
        panel(s, d).select("id", "d", "grp", "y_1", "y_3", "flag_a", "flag_b", *FEATURES), "id"))


B.register("pn", ["ev", "ret"], """
pn AS (SELECT id, ev.grp, ev.d, ret.d_3 AS le, ret.exc_1 AS y_1, ret.exc_3 AS y_3, ev.size, ev.flag_a, ev.flag_b,
  row_number() OVER (ORDER BY ev.d, id)-1 AS i, count(*) OVER () AS n FROM ev JOIN ret USING (id)
  WHERE ret.c_3 IS NOT NULL AND ev.is_target=1)""")
B.register("fo", ["pn"], """
fb AS (SELECT k AS fold, CAST(round_even(f+k*((n-f)/5),0) AS BIGINT) AS lo, CAST(round_even(f+(k+1)*((n-f)/5),0) AS BIGINT) AS hi
  FROM (SELECT unnest(range(5)) AS k) r, (SELECT max(n) AS n, floor(max(n)*0.35::DOUBLE) AS f FROM pn) x),
fs AS (SELECT fb.*, pn.d AS start FROM fb JOIN pn ON pn.i=fb.lo),
ca AS (SELECT fs.fold, pn.id, pn.i, pn.d, pn.le, row_number() OVER (PARTITION BY fold ORDER BY i DESC) AS rb,
  count(*) OVER (PARTITION BY fold) AS m FROM pn JOIN fs ON pn.i < fs.lo AND pn.le + 5 < fs.start),
vs AS (SELECT fold, min(d) AS vstart FROM ca WHERE rb <= greatest(1, floor(m*0.15::DOUBLE)) GROUP BY 1),
fo AS (SELECT CAST(fold AS INT) AS fold, id, 'test' AS role FROM fs JOIN pn ON pn.i>=lo AND pn.i<hi
  UNION ALL SELECT CAST(ca.fold AS INT), id, 'val' FROM ca WHERE rb <= greatest(1, floor(m*0.15::DOUBLE))
  UNION ALL SELECT CAST(ca.fold AS INT), id, 'train' FROM ca JOIN vs USING (fold) WHERE rb > greatest(1, floor(m*0.15::DOUBLE)) AND le + 5 < vstart)""")


# ---- panel ----

@query("L6_assemble_panel", needs="ev ret ship bm peer pn", digits=5,
       rounds="y_1 y_3 f1_med_1w f1_n_1w f3_prc_3m m_geo_mom_63d p1_med_21d", sql=f"""
WITH {_F1}, f1s AS (SELECT grp, d, quantile_cont(x,0.5) AS med, CAST(count(*) AS DOUBLE) AS n FROM f1 GROUP BY 1,2), {_SUPPLY},
zr AS (SELECT e.id, e.grp, e.d, s.supply_amt AS a FROM ev e JOIN sup s ON s.grp=e.grp AND s.d=e.d),
zz AS (SELECT id, CASE WHEN count(*) OVER p >= 2 AND stddev_samp(a) OVER p > 1e-12 THEN (a-avg(a) OVER p)/stddev_samp(a) OVER p ELSE 0.0 END AS z
  FROM zr WINDOW p AS (PARTITION BY grp ORDER BY d, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
bs AS (SELECT grp, date, coalesce(ln(close)-lag(ln(close),63) OVER (PARTITION BY grp ORDER BY date),0.0) AS r FROM bm),
bj AS (SELECT e.id, b.r FROM ev e ASOF LEFT JOIN bs b ON e.grp=b.grp AND e.d>b.date),
ps AS (SELECT id, quantile_cont(ret_21d,0.5) AS med FROM peer GROUP BY 1)
SELECT pn.id, pn.grp, pn.d, pn.le AS label_end, y_1, y_3, coalesce(f1s.med,0.0) AS f1_med_1w, coalesce(f1s.n,0.0) AS f1_n_1w,
 zz.z AS f3_prc_3m, coalesce(bj.r,0.0) AS m_geo_mom_63d, coalesce(ps.med,0.0) AS p1_med_21d
FROM pn LEFT JOIN f1s ON f1s.grp=pn.grp AND f1s.d=pn.d JOIN zz USING (id) JOIN bj USING (id) LEFT JOIN ps USING (id)""")
def l6(spark, sf):
    return panel(spark, sf).select("id", "grp", "d", "label_end", "y_1", "y_3", "f1_med_1w", "f1_n_1w",
                                   "f3_prc_3m", "m_geo_mom_63d", "p1_med_21d")


@query("P9_select_groups", needs="pn ev ret", rounds="f2_depth_1w", sql=f"""
WITH {_F1}, s AS (SELECT grp, d, avg(x) FILTER (x<0) AS depth FROM f1 GROUP BY 1,2)
SELECT pn.id, coalesce(s.depth,0.0) AS f2_depth_1w FROM pn LEFT JOIN s ON s.grp=pn.grp AND s.d=pn.d""")
def p9(spark, sf):
    return select_groups(panel(spark, sf), ["f2"]).select("id", "f2_depth_1w")


# ---- folds ----

@query("V1_walk_forward", needs="fo", sql="SELECT fold, id, role FROM fo")
def v1(spark, sf):
    return V.walk_forward(panel(spark, sf).select("id", "d", "label_end"))


@query("V3_final_split", needs="pn", sql="""
SELECT 0 AS fold, id, CASE WHEN i >= n-greatest(CAST(round_even(n*0.15::DOUBLE,0) AS BIGINT),20) THEN 'val' ELSE 'train' END AS role FROM pn""")
def v3(spark, sf):
    return V.final_split(panel(spark, sf).select("id", "d"))


@query("T1_chronological_order", needs="pn", sql="SELECT id, i AS pos FROM pn")
def t1(spark, sf):
    return row_index(panel(spark, sf).select("id", "d"), [], "d", "id", "pos").select("id", "pos")


# ---- scaling ----

@query("A8_fold_moments", needs="fo", rounds="mu sd", digits=5, sql="""
WITH t AS (SELECT fo.fold, pn.* FROM fo JOIN pn USING (id) WHERE role='train')
SELECT fold, 'y_1' AS "column", avg(y_1) AS mu, stddev_pop(y_1)+1e-8 AS sd FROM t GROUP BY 1
UNION ALL SELECT fold, 'y_3', avg(y_3), stddev_pop(y_3)+1e-8 FROM t GROUP BY 1""")
def a8(spark, sf):
    return X.fold_moments(panel(spark, sf), folds(spark, sf), ["y_1", "y_3"])


@query("A8_sequence_moments", needs="fo risk", rounds="mu sd", digits=4, sql=f"""
WITH {_SEQ}, q AS (SELECT pn.id, sq.seq FROM pn ASOF LEFT JOIN sq ON pn.d > sq.date),
u AS (SELECT fo.fold, unnest(q.seq) AS v FROM fo JOIN q USING (id) WHERE role='train')
SELECT fold, avg(v) AS mu, stddev_pop(v)+1e-8 AS sd FROM u GROUP BY 1""")
def a8s(spark, sf):
    got = X.fold_moments(panel(spark, sf), folds(spark, sf), ["size"], seq="risk_seq")
    return got.where("column = 'risk_seq'").select("fold", "mu", "sd")


_RARE = """ms AS (SELECT DISTINCT member FROM mem), ff AS (SELECT DISTINCT fold FROM fo),
tc AS (SELECT fold, member, count(*) AS n FROM fo JOIN mem USING (id) WHERE role='train' GROUP BY 1,2),
lim AS (SELECT quantile_disc(n, 0.5) AS v FROM tc),
ra AS (SELECT ff.fold, ms.member, coalesce(tc.n,0) AS n, CAST(coalesce(tc.n,0) >= 300 AS INT) AS keep
  FROM ff CROSS JOIN ms LEFT JOIN tc ON tc.fold=ff.fold AND tc.member=ms.member)"""


@query("A9_rare_members", needs="fo mem", sql=f"WITH {_RARE} SELECT fold, member, n, keep FROM ra")
def a9(spark, sf):
    return X.rare_members(B.members(spark, sf), folds(spark, sf), least=300)


def _bucketed(spark, sf):
    long, fo = B.members(spark, sf), folds(spark, sf)
    return X.bucketed_members(long, fo, X.rare_members(long, fo, least=300))


@query("X1_apply_scaler", needs="fo", rounds="y_1 y_3", digits=5, sql="""
WITH t AS (SELECT fold, avg(y_1) AS a1, stddev_pop(y_1)+1e-8 AS s1, avg(y_3) AS a3, stddev_pop(y_3)+1e-8 AS s3
 FROM fo JOIN pn USING (id) WHERE role='train' GROUP BY 1)
SELECT fo.fold, fo.id, greatest(least((y_1-a1)/s1,3.0::DOUBLE),-3.0::DOUBLE) AS y_1, greatest(least((y_3-a3)/s3,3.0::DOUBLE),-3.0::DOUBLE) AS y_3
FROM fo JOIN pn USING (id) JOIN t ON t.fold=fo.fold""")
def x1(spark, sf):
    r = rows(spark, sf).select("fold", "id", "y_1", "y_3")
    return X.apply_scaler(r, X.fold_moments(panel(spark, sf), folds(spark, sf), ["y_1", "y_3"]),
                          ["y_1", "y_3"], limit=3.0)


_NAMES = [f"bk_{i:02d}" for i in range(12)] + [X.OTHER]


@query("X2_static_matrix", needs="fo mem", rounds="y_1", digits=5, sql=f"""
WITH {_RARE}, t AS (SELECT fold, avg(y_1) AS a, stddev_pop(y_1)+1e-8 AS s FROM fo JOIN pn USING (id) WHERE role='train' GROUP BY 1),
bm2 AS (SELECT fo.fold, fo.id, """ + ", ".join(
    f"max(CASE WHEN {'ra.keep=1 AND mem.member=' + repr(m) if m != X.OTHER else 'ra.keep=0'} THEN 1 ELSE 0 END) AS {m}" for m in _NAMES)
    + """ FROM fo JOIN mem USING (id) JOIN ra ON ra.fold=fo.fold AND ra.member=mem.member GROUP BY 1,2)
SELECT fo.fold, fo.id, fo.role, flag_a, flag_b, (y_1-a)/s AS y_1, """ + ", ".join(
        f"coalesce({m},0) AS {m}" for m in _NAMES) + """ FROM fo JOIN pn USING (id) JOIN t ON t.fold=fo.fold
LEFT JOIN bm2 ON bm2.fold=fo.fold AND bm2.id=fo.id""")
def x2(spark, sf):
    r = rows(spark, sf).select("fold", "id", "role", "flag_a", "flag_b", "y_1")
    m = X.fold_moments(panel(spark, sf), folds(spark, sf), ["y_1"])
    return X.static_matrix(r, m, _bucketed(spark, sf), _NAMES, ["flag_a", "flag_b"], ["y_1"])


_BUCKETS = """bm2 AS (SELECT fo.fold, fo.id, """ + ", ".join(
    f"max(CASE WHEN {'ra.keep=1 AND mem.member=' + repr(m) if m != X.OTHER else 'ra.keep=0'} THEN 1 ELSE 0 END) AS {m}" for m in _NAMES) + """
 FROM fo JOIN mem USING (id) JOIN ra ON ra.fold=fo.fold AND ra.member=mem.member GROUP BY 1,2)"""


@query("X3_engineered_table", needs="ev ret ship bm peer mem fo", rounds="f1_med_1w f3_prc_3m m_geo_mom_63d prestige p1_med_21d", digits=5, sql=f"""
WITH {_F1}, f1s AS (SELECT grp, d, quantile_cont(x,0.5) AS med FROM f1 GROUP BY 1,2),
f1d AS (SELECT r.grp, r.d, CAST(count(*) AS DOUBLE) AS n FROM recent r JOIN ret ON ret.id=r.cand WHERE ret.d_1<r.d AND ret.raw_1 IS NOT NULL GROUP BY 1,2),
{_SUPPLY}, zr AS (SELECT e.id, e.grp, e.d, s.supply_amt AS a FROM ev e JOIN sup s ON s.grp=e.grp AND s.d=e.d),
zz AS (SELECT id, CASE WHEN count(*) OVER p >= 2 AND stddev_samp(a) OVER p > 1e-12 THEN (a-avg(a) OVER p)/stddev_samp(a) OVER p ELSE 0.0 END AS z
  FROM zr WINDOW p AS (PARTITION BY grp ORDER BY d, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
bs AS (SELECT grp, date, coalesce(ln(close)-lag(ln(close),63) OVER (PARTITION BY grp ORDER BY date),0.0) AS r FROM bm),
bj AS (SELECT e.id, b.r FROM ev e ASOF LEFT JOIN bs b ON e.grp=b.grp AND e.d>b.date),
ps AS (SELECT id, quantile_cont(ret_21d,0.5) AS med FROM peer GROUP BY 1), {_SHARE},
rkp AS (SELECT *, row_number() OVER (PARTITION BY grp,d ORDER BY share, member)/count(*) OVER (PARTITION BY grp,d) AS r FROM sh),
pb AS (SELECT m.id, max(r) AS r FROM mem m JOIN ev USING (id) JOIN rkp ON rkp.grp=ev.grp AND rkp.d=ev.d AND rkp.member=m.member GROUP BY 1),
nm AS (SELECT id, CAST(count(*) AS INT) AS n FROM mem GROUP BY 1), {_RARE}, {_BUCKETS}
SELECT fo.fold, fo.id, fo.role, pn.size, coalesce(f1s.med,0.0) AS f1_med_1w, coalesce(f1d.n,0.0) AS f1_n_1d, zz.z AS f3_prc_3m,
 coalesce(bj.r,0.0) AS m_geo_mom_63d, coalesce(pb.r,0.0) AS prestige, coalesce(ps.med,0.0) AS p1_med_21d, coalesce(nm.n,0) AS n_members, """ + ", ".join(
    f"coalesce({m},0) AS {m}" for m in _NAMES) + """ FROM fo JOIN pn USING (id) LEFT JOIN f1s ON f1s.grp=pn.grp AND f1s.d=pn.d
LEFT JOIN f1d ON f1d.grp=pn.grp AND f1d.d=pn.d JOIN zz ON zz.id=pn.id JOIN bj ON bj.id=pn.id LEFT JOIN pb ON pb.id=pn.id LEFT JOIN ps ON ps.id=pn.id
LEFT JOIN nm ON nm.id=pn.id LEFT JOIN bm2 ON bm2.fold=fo.fold AND bm2.id=fo.id""")
def x3(spark, sf):
    return X.engineered_table(rows(spark, sf), _bucketed(spark, sf), _NAMES, FEATURES)


@query("X4_raw_table", needs="pn risk", sql=f"""
WITH {_SEQ} SELECT pn.id, sq.seq[1] AS risk_m21, sq.seq[21] AS risk_m01 FROM pn ASOF LEFT JOIN sq ON pn.d > sq.date""")
def x4(spark, sf):
    p = panel(spark, sf)
    return X.raw_table(p.select("id"), p, "risk_seq", 21).select("id", "risk_m21", "risk_m01")


@query("X5_normal_score")
def x5(spark, sf):
    r = rows(spark, sf).select("fold", "role", "id", "y_3")
    knots = X.score_knots(r.where("role = 'train'"), "y_3")
    z = X.normal_score(r, knots, "y_3", "z")
    return X.normal_score_inverse(z, knots, "z", "back")


_PHI = ("(0.5 + z / 1200.0 * 0.3989422804014327 * list_sum(list_transform(range(401), lambda i: "
        "CASE WHEN i=0 OR i=400 THEN 1 WHEN i%2=1 THEN 4 ELSE 2 END * exp(-pow(z*i/400.0, 2)/2))))")


@query("F8_normal_functions", needs="pn", rounds="z p", digits=4, sql=f"""
WITH q AS (SELECT id, 1/(1+exp(-y_3)) AS p FROM pn)
SELECT id, list_reduce(list_concat([CAST((p-0.5)*2.5 AS DOUBLE)], list_transform(range(25), lambda k: CAST(k AS DOUBLE))),
 lambda z, k: z - ({_PHI} - p) / (0.3989422804014327 * exp(-z*z/2))) AS z, p FROM q""")
def f8(spark, sf):
    from pitspark.functions.distributions import normal_cdf, normal_ppf
    p = 1 / (1 + F.exp(-F.col("y_3")))
    return panel(spark, sf).select("id", normal_ppf(p).alias("z")).withColumn("p", normal_cdf("z"))


# ---- rungs ----

_TEST = "SELECT fo.fold, pn.id, pn.y_3 FROM fo JOIN pn USING (id) WHERE role='test'"


@query("M1_naive_constant", needs="fo", rounds="q10 q50 q90", sql=f"""
WITH md AS (SELECT fold, median(y_3) AS m FROM fo JOIN pn USING (id) WHERE role='train' GROUP BY 1),
of AS (SELECT fo.fold, quantile_cont(y_3-m,0.1) AS a, quantile_cont(y_3-m,0.5) AS b, quantile_cont(y_3-m,0.9) AS c
 FROM fo JOIN pn USING (id) JOIN md ON md.fold=fo.fold WHERE role='val' GROUP BY 1)
SELECT t.fold, t.id, m+a-b AS q10, m AS q50, m+c-b AS q90 FROM ({_TEST}) t JOIN md USING (fold) JOIN of USING (fold)""")
def m1(spark, sf):
    got = M.naive_constant(rows(spark, sf), "y_3")
    return got.select("fold", "id", *[F.col(f"`{M.q_name(p)}`").alias(f"q{int(p * 100)}") for p in M.LEVELS])


@query("M1_base_rate", needs="fo", rounds="p_out", sql=f"""
WITH r AS (SELECT fold, avg(CAST(y_3>0 AS INT)) AS p_out FROM fo JOIN pn USING (id) WHERE role='train' GROUP BY 1)
SELECT t.fold, t.id, p_out FROM ({_TEST}) t JOIN r USING (fold)""")
def m1b(spark, sf):
    return M.naive_constant(rows(spark, sf), "y_3", binary=True).select("fold", "id", "p_out")


@query("M2_naive_feature", needs="fo", rounds="q10 q50 q90", digits=5, sql=f"""
WITH f AS (SELECT fold, regr_slope(y_3, size) AS b, regr_intercept(y_3, size) AS a FROM fo JOIN pn USING (id) WHERE role='train' GROUP BY 1),
of AS (SELECT fo.fold, quantile_cont(y_3-(a+b*size),0.1) AS o1, quantile_cont(y_3-(a+b*size),0.5) AS o2, quantile_cont(y_3-(a+b*size),0.9) AS o3
 FROM fo JOIN pn USING (id) JOIN f ON f.fold=fo.fold WHERE role='val' GROUP BY 1)
SELECT fo.fold, pn.id, a+b*size+o1-o2 AS q10, a+b*size AS q50, a+b*size+o3-o2 AS q90
FROM fo JOIN pn USING (id) JOIN f ON f.fold=fo.fold JOIN of ON of.fold=fo.fold WHERE role='test'""")
def m2(spark, sf):
    got = M.naive_feature(rows(spark, sf), "size", "y_3")
    return got.select("fold", "id", *[F.col(f"`{M.q_name(p)}`").alias(f"q{int(p * 100)}") for p in M.LEVELS])


_F1W = f"{_F1}, f1s AS (SELECT grp, d, quantile_cont(x,0.5) AS med FROM f1 GROUP BY 1,2)"
_ROWS = "SELECT fo.fold, fo.role, pn.id, pn.y_3, coalesce(f1s.med, 0.0) AS x FROM fo JOIN pn USING (id) LEFT JOIN f1s ON f1s.grp=pn.grp AND f1s.d=pn.d"


@query("M3_naive_logistic", needs="ev ret fo", rounds="p_out", digits=5, sql=f"""
WITH RECURSIVE {_F1W}, rw AS ({_ROWS}), mo AS (SELECT fold, avg(x) AS mu, stddev_pop(x)+1e-12 AS sd FROM rw WHERE role='train' GROUP BY 1),
tr AS MATERIALIZED (SELECT fold, (x-mu)/sd AS z, CAST(y_3>0 AS DOUBLE) AS up FROM rw JOIN mo USING (fold) WHERE role='train'),
st AS (SELECT fold, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0 AS k FROM mo UNION ALL
 SELECT fold, a+(hzz*g0-hz*g1)/(h*hzz-hz*hz), b+(h*g1-hz*g0)/(h*hzz-hz*hz), k+1 FROM (
  SELECT fold, a, b, k, sum(up-p) AS g0, sum((up-p)*z) AS g1, sum(greatest(p*(1-p),1e-6)) AS h, sum(greatest(p*(1-p),1e-6)*z) AS hz,
   sum(greatest(p*(1-p),1e-6)*z*z) AS hzz FROM (SELECT st.*, tr.z, tr.up, 1/(1+exp(-(a+b*z))) AS p FROM st JOIN tr USING (fold) WHERE k<15) GROUP BY 1,2,3,4))
SELECT rw.fold, rw.id, 1/(1+exp(-(a+b*(x-mu)/sd))) AS p_out FROM rw JOIN mo USING (fold) JOIN st ON st.fold=rw.fold AND k=15 WHERE role='test'""")
def m3(spark, sf):
    return M.naive_logistic(rows(spark, sf), "f1_med_1w", "y_3").select("fold", "id", "p_out")


@query("M4_trees_binary")
def m4b(spark, sf):
    return M.trees(rows(spark, sf), "y_3", FEATURES, binary=True).select("fold", "id", "p_out")


@query("M4_trees_quantile")
def m4(spark, sf):
    return M.trees(rows(spark, sf), "y_3", FEATURES).select("fold", "id", "`q0.1`", "`q0.5`", "`q0.9`")


@query("M5_ridge")
def m5(spark, sf):
    return M.linear(rows(spark, sf), "y_3", FEATURES).select("fold", "id", "`q0.5`")


@query("M5_ridge_pair", needs="fo", rounds="q10 q50 q90", digits=6, sql=f"""
WITH rw AS (SELECT fo.fold, fo.role, pn.id, y_3, size AS u, CAST(flag_a AS DOUBLE) AS v FROM fo JOIN pn USING (id)),
mo AS (SELECT fold, avg(u) AS mu, stddev_pop(u)+1e-9 AS su, avg(v) AS mv, stddev_pop(v)+1e-9 AS sv, avg(y_3) AS my FROM rw WHERE role='train' GROUP BY 1),
z AS (SELECT rw.*, (u-mu)/su AS a, (v-mv)/sv AS b, my FROM rw JOIN mo USING (fold)),
g AS (SELECT fold, sum(a*a) AS aa, sum(a*b) AS ab, sum(b*b) AS bb, sum(a*(y_3-my)) AS ay, sum(b*(y_3-my)) AS "by" FROM z WHERE role='train' GROUP BY 1),
w AS (SELECT fold, k, alpha, ((bb+alpha)*ay-ab*"by")/((aa+alpha)*(bb+alpha)-ab*ab) AS wa, ((aa+alpha)*"by"-ab*ay)/((aa+alpha)*(bb+alpha)-ab*ab) AS wb
 FROM g, (SELECT unnest(range({len(M.ALPHAS)})) AS k, unnest({[float(a) for a in M.ALPHAS]}::DOUBLE[]) AS alpha)),
er AS (SELECT fold, k, avg(abs(y_3-(my+wa*a+wb*b))) AS e FROM z JOIN w USING (fold) WHERE role='val' GROUP BY 1,2),
be AS (SELECT fold, k FROM er QUALIFY row_number() OVER (PARTITION BY fold ORDER BY e, k)=1),
sc AS (SELECT z.fold, z.role, z.id, z.y_3, my+wa*a+wb*b AS s FROM z JOIN be USING (fold) JOIN w ON w.fold=z.fold AND w.k=be.k),
of AS (SELECT fold, quantile_cont(y_3-s,0.1) AS o1, quantile_cont(y_3-s,0.5) AS o2, quantile_cont(y_3-s,0.9) AS o3 FROM sc WHERE role='val' GROUP BY 1)
SELECT fold, id, s+o1-o2 AS q10, s AS q50, s+o3-o2 AS q90 FROM sc JOIN of USING (fold) WHERE role='test'""")
def m5p(spark, sf):
    got = M.linear(rows(spark, sf), "y_3", ["size", "flag_a"])
    return got.select("fold", "id", *[F.col(f"`{M.q_name(p)}`").alias(f"q{int(p * 100)}") for p in M.LEVELS])


@query("M6_coefficients")
def m6(spark, sf):
    return M.coefficients(rows(spark, sf), "y_3", FEATURES, "lasso")


@query("M7_random_search")
def m7(spark, sf):
    return M.trees(rows(spark, sf), "y_3", FEATURES, binary=True, n_configs=9, rounds=20, patience=5, tune={
        "maxDepth": [1, 2, 3], "stepSize": [0.05, 0.1, 0.2]}).select("fold", "id", "p_out")


@query("M8_run_folds", needs="ev mem fo", rounds="q0_5", digits=5, sql=f"""
WITH {_SHARE}, rk AS (SELECT *, row_number() OVER (PARTITION BY grp,d ORDER BY share, member)/count(*) OVER (PARTITION BY grp,d) AS r FROM sh),
b AS (SELECT m.id, max(r) AS r FROM mem m JOIN ev USING (id) JOIN rk ON rk.grp=ev.grp AND rk.d=ev.d AND rk.member=m.member GROUP BY 1),
rw AS (SELECT fo.fold, fo.role, pn.id, y_3, coalesce(b.r, 0.0) AS x FROM fo JOIN pn USING (id) LEFT JOIN b ON b.id=pn.id),
f AS (SELECT fold, regr_slope(y_3, x) AS b, regr_intercept(y_3, x) AS a FROM rw WHERE role='train' GROUP BY 1)
SELECT fold, id, a+b*x AS q0_5 FROM rw JOIN f USING (fold) WHERE role='test'""")
def m8(spark, sf):
    def nearest(train, val, test):
        return M.with_band(M.linear_score(train.unionByName(val).unionByName(test), "prestige", "y_3"), "y_3")
    return M.run_folds(rows(spark, sf), nearest).select("fold", "id", F.col("`q0.5`").alias("q0_5"))


@query("M9_ladder")
def m9(spark, sf):
    r = rows(spark, sf)
    _, report = M.ladder({"constant": lambda: M.naive_constant(r, "y_3"),
                          "recent": lambda: M.naive_feature(r, "f1_med_1w", "y_3")}, "y_3")
    return report


@query("M10_class_balance", needs="fo", rounds="weight", sql="""
WITH w AS (SELECT fold, count(*) FILTER (y_3<=0)/greatest(count(*) FILTER (y_3>0),1) AS w FROM fo JOIN pn USING (id) WHERE role='train' GROUP BY 1)
SELECT fo.fold, pn.id, CASE WHEN y_3>0 THEN w ELSE 1.0 END AS weight FROM fo JOIN pn USING (id) JOIN w ON w.fold=fo.fold""")
def m10(spark, sf):
    return M.class_balance_weight(rows(spark, sf), "y_3").select("fold", "id", "weight")


@query("M11_ensemble_mean", needs="pn", rounds="p", sql="""
SELECT id, (1/(1+exp(-y_1))+1/(1+exp(-y_3)))/2 AS p FROM pn""")
def m11(spark, sf):
    p = panel(spark, sf)
    both = [p.select("id", (1 / (1 + F.exp(-F.col(c)))).alias("p")) for c in ("y_1", "y_3")]
    return M.ensemble_mean(both[0].unionByName(both[1]), ["id"], ["p"])


@query("M12_fit_final_score_new")
def m12(spark, sf):
    path = f"{checkpoint_dir(spark)}/final-{uuid.uuid4().hex}"
    p = panel(spark, sf)
    M.fit_final(p, V.final_split(p), "y_3", FEATURES, path, seeds=(0, 1))
    return M.score_new(p, path, FEATURES).select("id", "q10", "q50", "q90", "mult_q50")


# ---- diagnostics that fit models ----

@query("M12_score_unlabelled")
def m12n(spark, sf):
    """One probability per horizon for the events whose label window is not over."""
    path = f"{checkpoint_dir(spark)}/bundle-{uuid.uuid4().hex}"
    every = saved(spark, sf, "inference", lambda s, d: assemble_panel(tables(s, d), horizons=(1, 3), inference=True))
    p = training_rows(every, 3)             # the panel's rows, which are not assembled twice
    M.fit_bundle(p, V.final_split(p), (1, 3), FEATURES, path, binary=True)
    return M.score_bundle(every, path, FEATURES)


_NAMED = {"size": ["size"], "recent": ["f1_med_1w", "f1_n_1d"], "supply": ["f3_prc_3m"], "market": ["m_geo_mom_63d"],
          "syndicate": ["prestige", "n_members"], "peers": ["p1_med_21d"]}


@query("G1_permutation_importance")
def g1(spark, sf):
    """Every feature and every named group of more than one, on the trees of every fold."""
    r = rows(spark, sf)
    fits = M.fold_models(r, "y_3", FEATURES)
    test = M.of_role(r, "test").select("fold", "id", "y_3", *FEATURES)
    groups = {f: [f] for f in FEATURES} | {f"group:{g}": c for g, c in _NAMED.items() if len(c) > 1}
    return G.permutation_importance(test, lambda d: M.score_folds(fits, d), "y_3", groups, repeats=5)


@query("G2_tree_importance")
def g2(spark, sf):
    return G.importance_share(M.tree_importances(rows(spark, sf), "y_3", FEATURES))


@query("I8_permutation_null")
def i8(spark, sf):
    # the folds of an event go with it, so they meet the panel once and not in every repeat
    of = folds(spark, sf).groupBy("id").agg(F.collect_list(F.struct("fold", "role")).alias("folds"))
    p = panel(spark, sf).select("id", "f1_med_1w", "y_1", "y_3").join(of, "id", "left")

    def predict(p):
        rows = p.select("f1_med_1w", "y_3", F.inline("folds"))
        return M.of_role(M.linear_score(rows, "f1_med_1w", "y_3"), "test")
    return G.permutation_null(p, predict, ["y_1", "y_3"], "y_3", repeats=5)


@query("I9_train_gap", needs="ev ret fo", rounds="train_ic test_ic gap", digits=5, sql=f"""
WITH {_F1W}, rw AS ({_ROWS}), sl AS (SELECT fold, sign(regr_slope(y_3, x)) AS s FROM rw WHERE role='train' GROUP BY 1),
sc AS (SELECT rw.*, s*x AS v FROM rw JOIN sl USING (fold) WHERE role IN ('train','test')),
rk AS (SELECT fold, role, rank() OVER (PARTITION BY fold, role ORDER BY v)+(count(*) OVER (PARTITION BY fold, role, v)-1)/2 AS a,
 rank() OVER (PARTITION BY fold, role ORDER BY y_3)+(count(*) OVER (PARTITION BY fold, role, y_3)-1)/2 AS b FROM sc),
ic AS (SELECT fold, role, count(*) AS n, corr(a, b) AS c FROM rk GROUP BY 1,2)
SELECT fold, max(n) FILTER (role='train') AS n_train, max(c) FILTER (role='train') AS train_ic, max(c) FILTER (role='test') AS test_ic,
 max(c) FILTER (role='train')-max(c) FILTER (role='test') AS gap FROM ic GROUP BY 1""")
def i9(spark, sf):
    return G.train_gap(M.linear_score(rows(spark, sf), "f1_med_1w", "y_3"), "y_3")
