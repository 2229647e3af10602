"""Multi-valued members of an event: dictionaries, classes, rankings, peers."""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pitspark.functions.ordering import quantiles, with_constants
from pitspark.functions.scalar import blank, normalise_name
from pitspark.operators.interval import share_of
from pitspark.session import durable

FEW_PEERS = 1024            # rows of an event whose values are sorted in one aggregate


def member_columns(df: DataFrame, prefix: str) -> list[str]:
    """S3: multi-hot columns by prefix, in name order."""
    return sorted(c for c in df.columns if c.startswith(prefix))


def to_long_members(df: DataFrame, id_: str, prefix: str) -> DataFrame:
    """S3: one row per (id, member) for every positive multi-hot column."""
    cols = member_columns(df, prefix)
    if not cols:
        raise ValueError(f"no {prefix}* columns in {df.columns}")
    return (df.select(id_, *[F.col(c).cast("double").alias(c) for c in cols])
            .unpivot(id_, cols, "member", "_on").where("_on > 0").drop("_on"))


def classify_members(long_members: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Class and home of every distinct member, null when the dictionary has no class for it."""
    words = (dictionary.where(~blank(F.col("class")))
             .select(normalise_name("member").alias("member"), F.lower("class").alias("class"), "home"))
    return long_members.select("member").distinct().join(words, "member", "left")


def unmatched_members(long_members: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Members without a class."""
    return classify_members(long_members, dictionary).where("class is null").select("member")


def draft_dictionary(matched: DataFrame) -> DataFrame:
    """One row per member, blank cells for unknown ones, which come first."""
    first = W.partitionBy("member").orderBy(F.col("class").isNotNull(), "class", "home")
    one = matched.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")
    return one.select("member", F.coalesce("class", F.lit("")).alias("class"),
                      F.coalesce("home", F.lit("")).alias("home"),
                      F.col("class").isNull().cast("int").alias("unknown"))


def dictionary_match(names: DataFrame, name: str, aliases: DataFrame) -> DataFrame:
    """Longest alias whose tokens appear as a contiguous run in the name, ties by ``ord``.

    Names are cut into token runs no longer than the longest alias and equi-joined, so the work is
    names x runs whatever the size of the alias table.
    """
    words = aliases.withColumn("_run", normalise_name("alias"))
    longest = words.agg(F.max(F.size(F.split("_run", "_"))).alias("_max"))
    keys = names.select(name).distinct().withColumn("_tok", F.split(normalise_name(name), "_"))
    runs = with_constants(keys, longest).select(name, "_tok", F.posexplode("_tok").alias("_at", "_word"), "_max")
    runs = runs.select(name, F.explode(F.transform(
        F.sequence(F.lit(1), F.least(F.col("_max"), F.size("_tok") - F.col("_at"))),
        lambda n: F.array_join(F.slice(F.col("_tok"), F.col("_at") + 1, n), "_"))).alias("_run"))
    best = F.min(F.struct(-F.length("alias"), F.col("ord"), F.col("alias"), F.col("class"),
                          F.col("home"))).alias("_b")
    hit = runs.distinct().join(words, "_run").groupBy(name).agg(best)
    return names.select(name).distinct().join(hit, name, "left").select(
        name, F.col("_b.alias").alias("alias"), F.col("_b.class").alias("class"),
        F.col("_b.home").alias("home"))


def first_label(rules: Sequence[tuple[str, str]]) -> Column:
    """Label of the first rule whose SQL condition holds; a last condition ``true`` catches the rest."""
    out = F.lit(None).cast("string")
    for label, condition in reversed(list(rules)):
        out = F.when(F.expr(condition), label).otherwise(out)
    return out


def syndicate_block(events: DataFrame, long_members: DataFrame, classes: DataFrame, id_: str, group: str,
                    class_names: Sequence[str], rules: Sequence[tuple[str, str]],
                    flags: dict[str, str]) -> DataFrame:
    """Per event the member count, whether each class and a member from the event's group is present,
    further 0/1 ``flags`` and the one-hot label of ``rules``. Conditions are SQL over ``n_members``,
    ``has_<class>`` and ``has_domestic``."""
    own = long_members.join(events.select(id_, group), id_)
    return block_of(events, own, classes, id_, group, class_names, rules, flags)


def block_of(events: DataFrame, own: DataFrame, classes: DataFrame, id_: str, group: str, class_names: Sequence[str],
             rules: Sequence[tuple[str, str]], flags: dict[str, str]) -> DataFrame:
    """``syndicate_block`` of members that stand beside their events."""
    rows = own.select(id_, "member", F.col(group).cast("string").alias("_g")).join(classes, "member", "left")
    per = rows.groupBy(id_).agg(
        F.count(F.lit(1)).alias("n_members"), F.bool_or(F.col("home") == F.col("_g")).alias("has_domestic"),
        *[F.bool_or(F.col("class") == c).alias(f"has_{c}") for c in class_names])
    here = [*[f"has_{c}" for c in class_names], "has_domestic"]
    full = events.select(id_).join(per, id_, "left").select(
        id_, F.coalesce("n_members", F.lit(0)).cast("int").alias("n_members"),
        *[F.coalesce(c, F.lit(False)).alias(c) for c in here]).withColumn("_label", first_label(rules))
    return full.select(
        id_, "n_members", F.log1p(F.col("n_members").cast("double")).alias("log_n_members"),
        *[F.col(c).cast("int").alias(c) for c in here],
        *[F.expr(condition).cast("int").alias(name) for name, condition in flags.items()],
        *[F.coalesce(F.col("_label") == label, F.lit(False)).cast("int").alias(f"kind_{label}") for label, _ in rules])


def category_counts(block: DataFrame, watched: str, share: float = 0.2) -> DataFrame:
    """Rows per label, with an alert when the ``watched`` one has more than its share."""
    labels = [c for c in block.columns if c.startswith("kind_")]
    total = F.sum(F.col("n")).over(W.partitionBy(F.lit(0)))
    counts = block.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c.removeprefix("kind_")) for c in labels])
    return (counts.unpivot([], [c.removeprefix("kind_") for c in labels], "kind", "n")
            .withColumn("alert", ((F.col("kind") == watched) & (F.col("n") > share * total)).cast("int")))


def member_rank(shares: DataFrame, by: Sequence[str], at: str) -> DataFrame:
    """Ordinal rank of each active member's share over the number of active members."""
    cell = W.partitionBy(*by, at)
    return shares.withColumn("rank", F.row_number().over(cell.orderBy("share", "member"))
                             / F.count(F.lit(1)).over(cell))


def percentile_rank_max(events: DataFrame, long_members: DataFrame, by: Sequence[str], at: str,
                        id_: str, size: str, years: float = 3, supplied: str | None = None,
                        out: str = "prestige") -> DataFrame:
    """The event's best member rank; 0 without any. A supplied column wins."""
    if supplied:
        return events.select(id_, F.coalesce(F.col(supplied).cast("double"), F.lit(0.0)).alias(out))
    own = durable(long_members.join(events.select(id_, *by, at, size), id_))
    return rank_max_of(events, own, by, at, id_, size, years, out)


def rank_max_of(events: DataFrame, own: DataFrame, by: Sequence[str], at: str, id_: str, size: str, years: float = 3,
                out: str = "prestige") -> DataFrame:
    """``percentile_rank_max`` of written members that stand beside their events. Ranks are written as well: a row
    for each active member of a day, which meets the members without a shuffle where it is small."""
    ranks = durable(member_rank(share_of(own, by, at, size, int(years * 365.25)), by, at).select(*by, at, "member", "rank"))
    best = own.join(ranks, [*by, at, "member"]).groupBy(id_).agg(F.max("rank").alias("_r"))
    return events.select(id_).join(best, id_, "left").select(
        id_, F.coalesce("_r", F.lit(0.0)).alias(out))


def peer_select(events: DataFrame, universe: DataFrame, id_: str, ticker: str, subgroup: str,
                group: str, k: int) -> DataFrame:
    """Up to k peers per event by size, from its own group if that has any, never itself.

    A ticker stands once in a pool, at its largest size. Each pool is cut to its k + 2 largest tickers before
    meeting the events (an event can strike out two names: its id and its ticker), so no (event, universe)
    pairs are formed beyond the answer.
    """
    def pool(keys: list[str], out: str) -> DataFrame:
        largest = W.partitionBy(*keys).orderBy(F.desc_nulls_last("cap"), "ticker")
        once = universe.where(F.col("ticker").isNotNull()).groupBy(*keys, "ticker").agg(F.max("cap").alias("cap"))
        top = (once.withColumn("_rn", F.row_number().over(largest))
               .where(F.col("_rn") <= k + 2))
        return top.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_rn", "ticker"))).alias(out))

    near = pool(["subgroup", "grp"], "_near")
    wide = pool(["subgroup"], "_wide")
    ev = events.where(F.col(subgroup).isNotNull()).select(
        id_, F.col(ticker).alias("_self"), F.col(subgroup).alias("subgroup"), F.col(group).alias("grp"))
    got = ev.join(near, ["subgroup", "grp"], "left").join(wide, ["subgroup"], "left")
    mine = F.filter(F.coalesce("_near", "_wide"), lambda p: (p["ticker"] != F.col(id_).cast("string"))
                    & ~F.coalesce(p["ticker"] == F.col("_self").cast("string"), F.lit(False)))
    return (got.select(id_, F.posexplode(F.slice(mine, 1, k)).alias("_i", "_p"))
            .select(id_, (F.col("_i") + 1).alias("place"), F.col("_p.ticker").alias("peer")))


def _few_quantiles(values: Column, levels: Sequence[float]) -> list[Column]:
    """Quantiles of a short sorted array, with linear interpolation; null for an empty one."""
    out = []
    for p in levels:
        at = F.lit(float(p)) * (F.size(values) - 1)
        low, high = F.get(values, F.floor(at).cast("int")), F.get(values, F.ceil(at).cast("int"))
        out.append(low + (at - F.floor(at)) * (high - low))
    return out


def peer_quantiles(peers: DataFrame, id_: str, value: str, levels: dict[str, float]) -> DataFrame:
    """``quantiles`` per event: events of at most ``FEW_PEERS`` rows, which are nearly all, sort their values in
    one aggregate; only the others are cut in ranges."""
    rows = peers.where(F.col(value).isNotNull()).select(id_, value)
    many = rows.groupBy(id_).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > FEW_PEERS).select(id_)
    few = rows.join(many, id_, "left_anti").groupBy(id_).agg(F.sort_array(F.collect_list(F.col(value) + 0)).alias("_v"))
    few = few.select(id_, F.size("_v").cast("long").alias("n"), *[
        q.alias(m) for m, q in zip(levels, _few_quantiles(F.col("_v"), list(levels.values())))])
    return few.unionByName(quantiles(rows.join(many, id_, "left_semi"), [id_], value, levels))


def peer_stats(events: DataFrame, peers: DataFrame, id_: str) -> DataFrame:
    """A3: count, median and spread of peer returns; zeros for events without peers."""
    levels = {"ret_21d": {"q1": 0.25, "med": 0.5, "q3": 0.75}, "ret_63d": {"peer_med_63d": 0.5}}
    levels = {v: m for v, m in levels.items() if v in peers.columns}
    rows = peers.where(F.col(id_).isNotNull()).select(id_, *levels)
    # as in ``peer_quantiles``, with all values of an event in one aggregate
    many = durable(rows.groupBy(id_).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > FEW_PEERS).select(id_))
    # values travel as rows: arrays of the few that a map task sees of an event would be larger
    few = rows.join(many, id_, "left_anti").repartition(id_)
    few = few.groupBy(id_).agg(*[F.sort_array(F.collect_list(F.col(v) + 0)).alias(v) for v in levels])
    few = few.select(id_, F.size("ret_21d").cast("long").alias("n"), *[
        q.alias(m) for v, at in levels.items() for m, q in zip(at, _few_quantiles(F.col(v), list(at.values())))])
    large = rows.join(many, id_, "left_semi")
    parts = [quantiles(large, [id_], v, at) for v, at in levels.items()]
    whole = few.unionByName(reduce(lambda a, b: a.join(b.drop("n"), id_, "full"), parts))
    got = whole.select(id_, F.col("n").cast("double").alias("peer_n"), F.col("med").alias("peer_med_21d"),
                       F.when(F.col("n") >= 2, F.col("q3") - F.col("q1")).otherwise(0.0).alias("peer_iqr_21d"),
                       F.col("peer_med_63d") if "ret_63d" in levels else F.lit(0.0).alias("peer_med_63d"))
    names = ["peer_n", "peer_med_21d", "peer_iqr_21d", "peer_med_63d"]
    return (events.select(id_).join(got, id_, "left")
            .select(id_, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in names]))


def fill_from_json(dictionary: DataFrame, payloads: DataFrame, text: str,
                   class_names: Sequence[str]) -> DataFrame:
    """blank dictionary rows filled from JSON answers that pass validation.

    Answers outside the class names, with a malformed home code or for a name that was not asked are
    dropped, ``unknown`` fills nothing, and a malformed payload contributes nothing.
    """
    entry = "items array<struct<name string, class string, home string, confidence string>>"
    got = (payloads.select(F.from_json(F.col(text), entry).alias("_j"))
           .select(F.explode("_j.items").alias("e")).where("e is not null")
           .select(F.trim("e.name").alias("member"), F.lower(F.trim("e.class")).alias("_class"),
                   F.upper(F.trim("e.home")).alias("_home"),
                   F.when(F.lower(F.trim("e.confidence")) == "high", "high").otherwise("low").alias("_conf"))
           .where(F.col("_class").isin(*class_names, "unknown") & F.col("_home").rlike("^[A-Z]{2,6}$")))
    got = got.groupBy("member").agg(F.min(F.struct("_conf", "_class", "_home")).alias("_g"))
    rows = dictionary.join(got, "member", "left")
    empty = blank("class") | blank("home")
    fill = empty & F.col("_g").isNotNull() & (F.col("_g._class") != "unknown")
    old = F.col("source") if "source" in dictionary.columns else F.lit("")
    return rows.select("member", F.when(fill, F.col("_g._class")).otherwise(F.col("class")).alias("class"),
                       F.when(fill, F.col("_g._home")).otherwise(F.col("home")).alias("home"),
                       F.when(fill, F.concat(F.lit("json_"), F.col("_g._conf"))).otherwise(old)
                       .alias("source"))
