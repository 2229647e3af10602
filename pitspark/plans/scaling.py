"""Train-only scaling and member bucketing per fold."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pitspark.functions.distributions import normal_cdf, normal_ppf
from pitspark.functions.ordering import value_offsets, with_constants
from pitspark.functions.scalar import clip, interpolate
from pitspark.session import durable

EPS = 1e-8
OTHER = "bk_other"


def _array_mean(a: str) -> Column:
    return F.aggregate(F.col(a), F.lit(0.0), lambda s, x: s + x) / F.size(a)


def fold_moments(panel: DataFrame, folds: DataFrame, cols: Sequence[str], seq: str | None = None,
                 id_: str = "id") -> DataFrame:
    """(fold, column, mu, sd) over training rows; sd is the population std plus 1e-8.

    A fixed-length sequence gets one pooled pair: windows have equal lengths, so the pooled variance is the
    mean within-window variance plus the variance of window means, without exploding the windows.
    """
    train = folds.where("role = 'train'").join(panel.select(id_, *cols, *([seq] if seq else [])), id_)
    aggs = [e for c in cols for e in (F.avg(c).alias(f"m_{c}"), (F.stddev_pop(c) + EPS).alias(f"s_{c}"))]
    names = list(cols)
    if seq:
        train = train.withColumn("_m", _array_mean(seq))
        train = train.withColumn("_v", F.aggregate(
            F.col(seq), F.lit(0.0), lambda s, x: s + (x - F.col("_m")) * (x - F.col("_m"))) / F.size(seq))
        aggs += [F.avg("_m").alias(f"m_{seq}"),
                 (F.sqrt(F.avg("_v") + F.var_pop("_m")) + EPS).alias(f"s_{seq}")]
        names.append(seq)
    wide = train.groupBy("fold").agg(*aggs)
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m_{c}").alias("mu"),
                                         F.col(f"s_{c}").alias("sd")) for c in names]))
    return wide.select("fold", pairs.alias("p")).select("fold", "p.*")


def apply_scaler(rows: DataFrame, moments: DataFrame, cols: Sequence[str], limit: float = 0.0,
                 seq: str | None = None) -> DataFrame:
    """(x - mu) / sd with the moments of the row's fold; other columns pass through."""
    names = [*cols, *([seq] if seq else [])]
    wide = moments.groupBy("fold").pivot("column", names).agg(F.first("mu").alias("mu"),
                                                              F.first("sd").alias("sd"))
    out = rows.join(F.broadcast(wide), "fold")              # one row per fold
    out = out.withColumns({c: clip((F.col(c) - F.col(f"{c}_mu")) / F.col(f"{c}_sd"), limit) for c in cols})
    if seq:
        out = out.withColumn(seq, F.transform(seq, lambda x: clip(
            (x - F.col(f"{seq}_mu")) / F.col(f"{seq}_sd"), limit)))
    return out.select(*rows.columns)


def rare_members(long_members: DataFrame, folds: DataFrame, least: int = 20, id_: str = "id") -> DataFrame:
    """(fold, member, n, keep) with training counts; members under ``least`` are pooled."""
    seen = (folds.where("role = 'train'").join(long_members, id_)
            .groupBy("fold", "member").agg(F.count(F.lit(1)).alias("n")))
    all_folds = folds.agg(F.collect_set("fold").alias("_folds"))
    every = with_constants(long_members.select("member").distinct(), all_folds).select(
        "member", F.explode("_folds").alias("fold"))
    return every.join(seen, ["fold", "member"], "left").select(
        "fold", "member", F.coalesce("n", F.lit(0)).alias("n"),
        (F.coalesce("n", F.lit(0)) >= least).cast("int").alias("keep"))


def bucketed_members(long_members: DataFrame, folds: DataFrame, keep: DataFrame,
                     id_: str = "id") -> DataFrame:
    """(fold, id, member) with rare members replaced by one shared name, once per row."""
    rows = folds.join(long_members, id_).join(keep.select("fold", "member", "keep"), ["fold", "member"])
    name = F.when(F.col("keep") == 1, F.col("member")).otherwise(OTHER)
    return rows.select("fold", id_, name.alias("member")).distinct()


def member_matrix(bucketed: DataFrame, names: Sequence[str], id_: str = "id") -> DataFrame:
    """One 0/1 column per member name."""
    return bucketed.groupBy("fold", id_).agg(*[
        F.max((F.col("member") == m).cast("int")).alias(m) for m in names])


def static_matrix(rows: DataFrame, moments: DataFrame, members: DataFrame, names: Sequence[str],
                  sector: Sequence[str], continuous: Sequence[str], binary: Sequence[str] = (),
                  group: Sequence[str] = (), limit: float = 0.0, id_: str = "id") -> DataFrame:
    """Sector flags, group columns if wanted, scaled counts and extras, binary extras, members."""
    scaled = apply_scaler(rows, moments, continuous, limit)
    out = scaled.join(member_matrix(members, names, id_), ["fold", id_], "left")
    return out.select("fold", id_, "role", *sector, *group, *continuous, *binary,
                      *[F.coalesce(m, F.lit(0)).alias(m) for m in names])


def engineered_table(rows: DataFrame, members: DataFrame, names: Sequence[str], features: Sequence[str],
                     id_: str = "id") -> DataFrame:
    """Unscaled flat table of features and bucketed members."""
    out = rows.join(member_matrix(members, names, id_), ["fold", id_], "left")
    keep = [c for c in ("fold", id_, "role") if c in rows.columns]
    return out.select(*keep, *features, *[F.coalesce(m, F.lit(0)).alias(m) for m in names])


def raw_table(table: DataFrame, panel: DataFrame, seq: str, size: int, prefix: str = "risk_m",
              id_: str = "id") -> DataFrame:
    """X3 with the sequence as columns, 01 being the latest."""
    cols = [F.element_at(seq, -i).alias(f"{prefix}{i:02d}") for i in range(size, 0, -1)]
    return table.join(panel.select(id_, *cols), id_)


# ---- X5 ----

def score_knots(train: DataFrame, y: str, by: Sequence[str] = ("fold",), least: int = 10) -> DataFrame:
    """X5 fit: training values with their plotting positions i / (n + 1), one row per distinct value and end
    of its run of ties. Groups under ``least`` rows raise an error when evaluated."""
    off = value_offsets(train, list(by), y)
    n = F.when(F.col("n") < least, F.raise_error(F.lit(f"need at least {least} training labels"))
               ).otherwise(F.col("n"))
    ends = F.explode(F.array_distinct(F.array((F.col("below") + 1) / (n + 1.0),
                                              (F.col("below") + F.col("cnt")) / (n + 1.0))))
    return off.select(*by, F.col(y).alias("v"), ends.alias("p"))


def normal_score(rows: DataFrame, knots: DataFrame, y: str, out: str,
                 by: Sequence[str] = ("fold",)) -> DataFrame:
    """X5 transform: value to Gaussian score through the training distribution, clamped at its ends."""
    named = knots.withColumnRenamed("v", "_kx")
    got = interpolate(rows, named, list(by), y, "_kx", "p", "_p")
    return got.withColumn(out, normal_ppf("_p")).drop("_p")


def normal_score_inverse(rows: DataFrame, knots: DataFrame, z: str, out: str,
                         by: Sequence[str] = ("fold",)) -> DataFrame:
    """X5 inverse: score to value, never beyond the training range."""
    asked = durable(rows.withColumn("_p", normal_cdf(z)))       # read by the lookup and by the join back
    named = knots.withColumnRenamed("p", "_kx")
    return interpolate(asked, named, list(by), "_p", "_kx", "v", out).drop("_p")


# ---- X6 ----

def schema_problems(found: dict[str, Sequence[str]], contract: dict[str, Sequence[str]]) -> list[str]:
    """Every feature block whose names or their order differ from the stored ones."""
    out = []
    for block, names in contract.items():
        have = list(found.get(block, []))
        if have != list(names):
            gone, new = sorted(set(names) - set(have)), sorted(set(have) - set(names))
            out.append(f"{block}: stored {len(names)} columns, data has {len(have)}; "
                       f"missing {gone}, new {new}")
    return out


def schema_guard(found: dict[str, Sequence[str]], contract: dict[str, Sequence[str]]) -> None:
    problems = schema_problems(found, contract)
    if problems:
        raise ValueError("features differ from the stored contract:\n- " + "\n- ".join(problems))
