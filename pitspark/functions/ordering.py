"""Exact positions, ranks and order statistics without one-task sorts.

A plain ``row_number() over (partition by key order by value)`` puts a whole key in one
task. Here every key is first cut into ranges at splitters taken from its own values: those with the least
hashes, up to 512 of them and about one for 512 values (only rows of low hashes are looked at), so that ranges hold near-equal shares of the key
whatever its values look like and however unlike other keys are. Which values these are depends on the set of
values only, so every evaluation of a plan finds the same ranges. Counts per range are added up in a table of
one row per range and positions inside a range come from an
ordinary window. Repeated values are collapsed to one counted row before that, so a value
shared by a third of the rows costs one row. The cut only steers the split; results are exact.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

RANGES = 512                # of a key, at most; a larger limit would not be cut before the shuffle
PER_RANGE = 512             # distinct values that a range is meant for; keys of fewer than twice as many stay whole
SPARE = 8                   # times as many values are looked at as are wanted as splitters
_STEPS = (256, 64, 16, 4, 1)    # of the search among up to 1,023 splitters, each a quarter of the one before


def splitters(df: DataFrame, keys: Sequence[str], order: Sequence[Column], distinct: bool = False) -> DataFrame:
    """(keys, _cuts): sorted values that cut a key into ranges. ``distinct`` says that no values of a key repeat. Keys of few rows stay whole, so only the rows of the others are sampled."""
    rows = sampled(df.select(*keys, _point(order).alias("_at")), keys)
    rows = rows if distinct else rows.distinct()
    rank = F.row_number().over(W.partitionBy(*keys).orderBy("_turn", "_at"))
    few = rows.withColumn("_rank", rank).where(F.col("_rank") <= RANGES)
    few = few.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_turn", "_at"))).alias("_few"))
    # the share of all hashes that lies below the last one taken tells how many values there are
    share = (F.element_at("_few", -1)["_turn"].cast("double") + 2.0 ** 63) / 2.0 ** 64
    many = F.size("_few") / F.greatest(share, F.lit(2.0 ** -64))
    take = F.least(F.lit(RANGES), F.floor(many / PER_RANGE) - 1).cast("int")
    return few.withColumn("_take", take).where("_take > 0").select(*keys, F.array_sort(F.transform(
        F.slice("_few", F.lit(1), F.col("_take")), lambda x: x["_at"])).alias("_cuts"))


def sampled(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, _at, _turn): the rows of large keys with the least hashes, 64 rows and ``SPARE`` for every splitter the key could
    ask for. What lies above its key's limit is dropped in the scan, so no key is shuffled or sorted whole to be sampled."""
    large = rows.groupBy(*[F.col(k).alias(f"_of_{k}") for k in keys]).agg(F.count(F.lit(1)).alias("_rows"))
    large = large.where(F.col("_rows") >= 2 * PER_RANGE)        # at most a row for 1,024 rows
    wanted = F.least(F.lit(float(RANGES)), F.col("_rows") / PER_RANGE)
    share = F.least(F.lit(1.0), (SPARE * wanted + 64) / F.col("_rows"))
    large = large.select(*[f"_of_{k}" for k in keys], (share * 2.0 ** 64 - 2.0 ** 63).alias("_limit"))
    same = [F.col(k) == F.col(f"_of_{k}") for k in keys]
    low = F.col("_turn").cast("double") <= F.col("_limit")
    return rows.withColumn("_turn", F.xxhash64(*keys, "_at")).join(F.broadcast(large), [*same, low], "left_semi")


def _point(order: Sequence[Column]) -> Column:
    return order[0] if len(order) == 1 else F.struct(*order)


def celled(df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str = "_cell",
           distinct: bool = False) -> DataFrame:
    """Add the number of the key's range that a row falls in: the splitters up to it in ``order``. They are searched
    by steps of plain comparisons, which compile with the scan; lambdas over the array would not."""
    df, ks, added = _keyed(df, keys)
    # at most a value for 512 rows, and none where all keys stay whole: rows meet them without a shuffle by key
    rows = df.join(F.broadcast(splitters(df, ks, order, distinct)), ks, "left").withColumn("_at", _point(order))
    rows = rows.withColumn(out, F.lit(0))
    for step in _STEPS:
        reached = [F.coalesce((F.get("_cuts", F.col(out) + (i * step - 1)) <= F.col("_at")).cast("int"), F.lit(0))
                   for i in (1, 2, 3)]
        rows = rows.withColumn(out, F.col(out) + step * (reached[0] + reached[1] + reached[2]))
    return rows.drop("_at", "_cuts", *["_all"] * added)


def with_constants(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row table (an ungrouped aggregate) to every row."""
    return (df.withColumn("_one", F.lit(1))
            .join(F.broadcast(one_row.withColumn("_one", F.lit(1))), "_one").drop("_one"))


def tie_order(df: DataFrame, tie: str) -> list[Column]:
    """The order of ties: strings by (crc32, string), all else by itself."""
    if not isinstance(df.schema[tie].dataType, T.StringType):
        return [F.col(tie)]
    return [F.crc32(F.col(tie).cast("binary")), F.col(tie)]


def _keyed(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str], bool]:
    if keys:
        return df, list(keys), False
    return df.withColumn("_all", F.lit(0)), ["_all"], True


def value_offsets(df: DataFrame, keys: Sequence[str], value: str,
                  weight: Column | None = None) -> DataFrame:
    """One row per distinct (keys, value): ``cnt``, ``below`` (rows with a smaller value in
    the key) and ``n`` (rows in the key). ``weight`` counts a row several times."""
    df, keys, _ = _keyed(df, keys)
    counts = (df.groupBy(*keys, value)
              .agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("cnt")))
    counts = celled(counts, keys, [F.col(value)], distinct=True)
    cells = counts.groupBy(*keys, "_cell").agg(F.sum("cnt").alias("_in_cell"))
    by_key = W.partitionBy(*keys)
    cells = cells.select(
        *keys, "_cell",
        (F.sum("_in_cell").over(by_key.orderBy("_cell").rowsBetween(W.unboundedPreceding, 0))
         - F.col("_in_cell")).alias("_base"),
        F.sum("_in_cell").over(by_key).alias("n"))
    inside = (W.partitionBy(*keys, "_cell").orderBy(value)
              .rowsBetween(W.unboundedPreceding, 0))
    return (counts
            .withColumn("_upto", F.sum("cnt").over(inside))
            .join(cells, [*keys, "_cell"])
            .select(*keys, value, "cnt", "n",
                    (F.col("_base") + F.col("_upto") - F.col("cnt")).alias("below")))


def average_rank(df: DataFrame, keys: Sequence[str], value: str, out: str,
                 weight: str | None = None) -> DataFrame:
    """Rank with ties averaged, 1-based, within ``keys``."""
    df, ks, added = _keyed(df, keys)
    off = value_offsets(df, ks, value, None if weight is None else F.col(weight))
    ranks = off.select(*ks, value, (F.col("below") + (F.col("cnt") + 1) / 2).alias(out))
    res = df.join(ranks, [*ks, value])
    return res.drop("_all") if added else res


def order_stats(df: DataFrame, keys: Sequence[str], value: str,
                picks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Exact order statistics: each pick maps the group size n to a 0-based index, which may be
    fractional (then neighbours are interpolated linearly)."""
    df, ks, added = _keyed(df.where(F.col(value).isNotNull()), keys)
    off = value_offsets(df, ks, value)

    def at(index: Column) -> Column:
        hit = (F.col("below") <= index) & (index < F.col("below") + F.col("cnt"))
        return F.max(F.when(hit, F.col(value)))

    aggs = [F.max("n").alias("n")]
    for name, pick in picks.items():
        idx = pick(F.col("n"))
        aggs += [at(F.floor(idx)).alias(f"_lo_{name}"), at(F.ceil(idx)).alias(f"_hi_{name}"),
                 F.max(idx - F.floor(idx)).alias(f"_f_{name}")]
    got = off.groupBy(*ks).agg(*aggs)
    res = got.select(*ks, "n", *[
        (F.col(f"_lo_{m}") + F.col(f"_f_{m}") * (F.col(f"_hi_{m}") - F.col(f"_lo_{m}"))).alias(m)
        for m in picks])
    return res.drop("_all") if added else res


def quantiles(df: DataFrame, keys: Sequence[str], value: str,
              levels: dict[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation, one column per named level."""
    def at(p: float) -> Callable[[Column], Column]:
        return lambda n: F.lit(float(p)) * (n - 1)
    return order_stats(df, keys, value, {m: at(p) for m, p in levels.items()})


def row_index(df: DataFrame, keys: Sequence[str], day: str | None, tie: str,
              out: str) -> DataFrame:
    """0-based position of every row in (day, tie) order within ``keys``.

    Rows are numbered inside ranges of (day, tie), so neither a hot key nor a hot day is one task, and range
    sizes are added up.
    """
    df, ks, added = _keyed(df, keys)
    order = [*([F.col(day)] if day else []), *tie_order(df, tie)]
    cut = celled(df, ks, order)
    cells = cut.groupBy(*ks, "_cell").agg(F.count(F.lit(1)).alias("_c"))
    upto = W.partitionBy(*ks).orderBy("_cell").rowsBetween(W.unboundedPreceding, 0)
    base = cells.select(*ks, "_cell", (F.sum("_c").over(upto) - F.col("_c")).alias("_base"))
    inside = W.partitionBy(*ks, "_cell").orderBy(*order)
    res = (cut.withColumn("_rn", F.row_number().over(inside))
           .join(base, [*ks, "_cell"])
           .withColumn(out, F.col("_base") + F.col("_rn") - 1)
           .drop("_cell", "_rn", "_base"))
    return res.drop("_all") if added else res


def bucket_at(pos: Column, n: Column, k: int) -> Column:
    """1-based bucket of a 0-based position when n rows are cut in k near-equal runs, the
    first n mod k runs being one longer."""
    size, extra = F.floor(n / k), n % k
    long_rows = extra * (size + 1)
    return F.when(pos < long_rows, F.floor(pos / (size + 1))).otherwise(
        extra + F.floor((pos - long_rows) / F.greatest(size, F.lit(1)))).cast("int") + 1


def bucketize(df: DataFrame, keys: Sequence[str], score: str, tie: str, k: int,
              out: str) -> DataFrame:
    """Rows cut into k near-equal runs of (score, tie) within ``keys``; also gives ``n``.

    A run of equal scores that falls inside one bucket needs no tie order. Only
    runs that straddle a boundary (at most k - 1 scores per key) are numbered by tie.
    """
    df, ks, added = _keyed(df, keys)
    off = value_offsets(df, ks, score).select(
        *ks, score, "below", "n", F.col("cnt").alias("_run"))
    first = bucket_at(F.col("below"), F.col("n"), k)
    last = bucket_at(F.col("below") + F.col("_run") - 1, F.col("n"), k)
    rows = df.join(off.withColumn("_b1", first).withColumn("_b2", last), [*ks, score])
    whole = rows.where("_b1 = _b2").withColumn(out, F.col("_b1"))
    split = row_index(rows.where("_b1 <> _b2"), [*ks, score], None, tie, "_pos")
    split = split.withColumn(out, bucket_at(F.col("below") + F.col("_pos"), F.col("n"), k))
    res = whole.unionByName(split.drop("_pos")).drop("below", "_run", "_b1", "_b2")
    return res.drop("_all") if added else res


def suffix_min(df: DataFrame, keys: Sequence[str], order: str, value: str, out: str) -> DataFrame:
    """Smallest ``value`` among the rows of the key whose ``order`` is at least as large."""
    df, ks, added = _keyed(df, keys)
    low = df.groupBy(*ks, order).agg(F.min(value).alias("_v"))
    low = celled(low, ks, [F.col(order)], distinct=True)
    cells = low.groupBy(*ks, "_cell").agg(F.min("_v").alias("_m"))
    cells = cells.select(*ks, "_cell", F.min("_m").over(
        W.partitionBy(*ks).orderBy("_cell").rowsBetween(1, W.unboundedFollowing)).alias("_after"))
    inside = W.partitionBy(*ks, "_cell").orderBy(order).rowsBetween(0, W.unboundedFollowing)
    got = (low.withColumn("_in", F.min("_v").over(inside)).join(cells, [*ks, "_cell"])
           .select(*ks, order, F.least("_in", "_after").alias(out)))
    res = df.join(got, [*ks, order])
    return res.drop("_all") if added else res
