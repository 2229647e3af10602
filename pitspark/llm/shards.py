"""Operator 4 (native): shards by a k-d tree over row metadata.

The tree splits at weighted medians, the weight being bytes, along the dimension that is widest in the node
compared with the whole, until every leaf holds about the target bytes. A node that has to become an odd number
of leaves is split where its lighter side weighs that many shares. A median is found by counting
bytes in equal ranges of the dimension and looking again inside the range that holds it, all nodes of a
level in one pass over a narrow table; the driver sees a fixed number of sums a pass. Only DataFrame
operations are used.

Rows of equal text stay in one shard, unless they alone weigh more than a stated share of the target:
such a group is placed row by row, as it could not be balanced otherwise.

Defined results: a null text has no bytes and checksum 0; a null dimension counts as 0; rows with a null
or repeated id are all placed; equal rows may share a shard but never a slot; an empty table gives an empty
result; further columns are not read.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from pitspark.llm.registry import query, table
from pitspark.session import durable

SHARDS = 8
BINS = 4096                 # ranges that a pass counts in, for each node
WHOLE_SHARE = 0.05          # of the target: heavier groups of equal text are placed row by row
EXACT_SHARE = 0.0005        # of the target: a range of fewer bytes is not looked into again


class Cut:
    """Rows below ``(key, tie, part) < (at...)`` go left; ``at`` may be a prefix of the three."""

    def __init__(self, dim: str, at: list[int]) -> None:
        self.columns, self.at = [dim, "_tie", "_part"][:len(at)], at

    def below(self) -> Column:
        out = F.lit(False)
        for name, value in reversed(list(zip(self.columns, self.at))):
            out = (F.col(name) < value) | ((F.col(name) == value) & out)
        return out


def leaf_of(cuts: dict[int, Cut], node: int = 1) -> Column:
    """Number of the leaf a unit falls in; the children of node n are 2n and 2n + 1."""
    if node not in cuts:
        return F.lit(node)
    return F.when(cuts[node].below(), leaf_of(cuts, 2 * node)).otherwise(leaf_of(cuts, 2 * node + 1))


def _medians(units: DataFrame, cuts: dict[int, Cut], widest: dict[int, str], stats: dict[int, dict],
             leaves: dict[int, int], fine: float, bins: int) -> dict[int, Cut]:
    """A cut near the weighted median of each node in ``widest``, along its dimension: half of the node's leaves,
    rounded down, go to the left."""
    placed = units.withColumn("_node", leaf_of(cuts)).where(F.col("_node").isin(list(widest)))
    state = {n: {"prefix": [], "low": stats[n][f"low_{d}"], "high": stats[n][f"high_{d}"], "before": 0,
                 "half": stats[n]["w"] * (leaves[n] // 2) / leaves[n]} for n, d in widest.items()}
    found: dict[int, Cut] = {}
    while len(found) < len(widest):
        value, low, step, inside = F.lit(None).cast("long"), F.lit(None).cast("long"), F.lit(1), F.lit(False)
        open_ = [n for n in widest if n not in found]
        for n in open_:
            s, names = state[n], [widest[n], "_tie", "_part"]
            here = F.col("_node") == n
            same = here
            for name, v in zip(names, s["prefix"]):
                same = same & (F.col(name) == v)
            column = F.col(names[len(s["prefix"])])
            s["step"] = max(1, -(-(s["high"] - s["low"] + 1) // bins))
            same = same & column.between(s["low"], s["high"])
            value, low = F.when(here, column).otherwise(value), F.when(here, F.lit(s["low"])).otherwise(low)
            step, inside = F.when(here, F.lit(s["step"])).otherwise(step), inside | same
        counted = (placed.where(inside).withColumn("_bin", F.floor((value - low) / step))
                   .groupBy("_node", "_bin")
                   .agg(F.sum("_w").alias("w"), F.min(value).alias("low"), F.max(value).alias("high"),
                        F.min("_tie").alias("low_tie"), F.max("_tie").alias("high_tie"),
                        F.min("_part").alias("low_part"), F.max("_part").alias("high_part")).collect())
        for n in open_:
            s = state[n]
            rows = sorted((r for r in counted if r["_node"] == n), key=lambda r: r["low"])
            upto = s["before"]
            for i, r in enumerate(rows):
                if upto + r["w"] >= s["half"] or i == len(rows) - 1:
                    break
                upto += r["w"]
            last = len(s["prefix"]) == 2 or r["low_part"] == r["high_part"] and r["low_tie"] == r["high_tie"]
            if r["w"] <= fine or r["low"] == r["high"] and last:
                left = upto + r["w"] - s["half"] <= s["half"] - upto       # the nearer side takes the range
                left = (left or upto == 0) and upto + r["w"] < stats[n]["w"]    # and neither side is empty
                found[n] = Cut(widest[n], [*s["prefix"], r["high"] + 1 if left else r["low"]])
            elif r["low"] == r["high"]:
                level = "tie" if not s["prefix"] else "part"
                s.update(prefix=[*s["prefix"], r["low"]], low=r[f"low_{level}"], high=r[f"high_{level}"], before=upto)
            else:
                s.update(low=r["low"], high=r["high"], before=upto)
    return found


def tree(units: DataFrame, dims: list[str], shards: int, target: float, bins: int = BINS,
         exact_share: float = EXACT_SHARE) -> dict[int, Cut]:
    """Cuts of a k-d tree over (dims, _tie, _part, _w) units with ``shards`` leaves that weigh about the target;
    fewer where a node is a single unit."""
    cuts: dict[int, Cut] = {}
    leaves = {1: shards}
    whole: dict | None = None
    while True:
        stats = {r["_node"]: r.asDict() for r in units.withColumn("_node", leaf_of(cuts)).groupBy("_node").agg(
            F.sum("_w").alias("w"), F.count(F.lit(1)).alias("n"),
            *[f(d).alias(f"{side}_{d}") for d in dims for side, f in (("low", F.min), ("high", F.max))]).collect()}
        whole = whole or stats.get(1)
        open_ = {n: s for n, s in stats.items() if leaves[n] > 1 and s["n"] > 1}
        if not open_:
            return cuts

        def spread(s: dict, d: str) -> float:
            return (s[f"high_{d}"] - s[f"low_{d}"]) / max(1, whole[f"high_{d}"] - whole[f"low_{d}"])

        widest = {n: max(dims, key=lambda d: (spread(s, d), -dims.index(d))) for n, s in open_.items()}
        cuts |= _medians(units, cuts, widest, stats, leaves, exact_share * target, bins)
        for n in open_:
            leaves[2 * n], leaves[2 * n + 1] = leaves[n] // 2, leaves[n] - leaves[n] // 2


def numbered(placed: DataFrame, group: str, order: list[str], out: str) -> DataFrame:
    """Gapless numbers from 0 within ``group`` in ``order``. Rows are dealt by ranges of (group, order), so
    that a task numbers its own range and takes the start from a table of one row per range."""
    parts = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = durable(placed.repartitionByRange(parts, group, *order).withColumn("_range", F.spark_partition_id()))
    counts = dealt.groupBy("_range", group).agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("_range", group, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = W.partitionBy("_range", group).orderBy(*order)
    return (dealt.withColumn("_row", F.row_number().over(own)).join(starts, ["_range", group])
            .withColumn(out, F.col("_start") + F.col("_row") - 1).drop("_range", "_row", "_start"))


def assign(docs: DataFrame, dims: dict[str, Column], shards: int = SHARDS, id_col: str = "doc_id",
           text_col: str = "text", whole_share: float = WHOLE_SHARE, bins: int = BINS,
           exact_share: float = EXACT_SHARE) -> DataFrame:
    """(id, size, text_crc32, shard, slot) of every row. ``dims`` are whole-number columns of the rows; a
    group of equal texts stands at its smallest values."""
    names = [f"_dim_{d}" for d in dims]
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = durable(docs.select(
        docs[id_col].alias("_id"), (F.octet_length(text) + 1).cast("long").alias("_size"),
        F.crc32(text.cast("binary")).alias("_crc"), F.shiftrightunsigned(F.xxhash64(text), 1).alias("_tie"),
        *[F.coalesce(c.cast("long"), F.lit(0)).alias(n) for n, c in zip(names, dims.values())]))
    total = rows.agg(F.sum("_size")).head()[0] or 0
    target = max(1.0, total / shards)
    # fewer than shards / whole_share groups can weigh that much
    heavy = [r["_tie"] for r in rows.groupBy("_tie").agg(F.sum("_size").alias("w"))
             .where(F.col("w") > whole_share * target).select("_tie").collect()]
    alone = F.shiftrightunsigned(F.xxhash64("_id", "_size", *names), 1)
    rows = rows.withColumn("_part", F.when(F.col("_tie").isin(heavy), alone).otherwise(F.lit(0)) if heavy
                           else F.lit(0).cast("long"))
    units = durable(rows.groupBy("_tie", "_part").agg(F.sum("_size").alias("_w"), *[F.min(n).alias(n) for n in names]))
    cuts = tree(units, names, shards, target, bins, exact_share)
    leaves = _leaves(cuts)
    place = F.create_map(*[F.lit(x) for i, n in enumerate(leaves) for x in (n, i)])
    leaf = units.select("_tie", "_part", place[leaf_of(cuts)].cast("int").alias("shard"))
    placed = rows.join(leaf, ["_tie", "_part"]).select(
        F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), "shard")
    return numbered(placed, "shard", [id_col, "text_crc32", "size"], "slot")


def _leaves(cuts: dict[int, Cut], node: int = 1) -> list[int]:
    """Leaves from left to right, so that neighbours in the tree get neighbouring numbers."""
    if node not in cuts:
        return [node]
    return _leaves(cuts, 2 * node) + _leaves(cuts, 2 * node + 1)


@query("op4_kd_shards")
def op4_kd_shards(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    dims = {"size": F.octet_length("text"), "doc_id": F.col("doc_id"), "source": F.crc32(F.col("source").cast("binary")),
            "lang": F.crc32(F.col("lang").cast("binary"))}
    placed = assign(docs, dims)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))
