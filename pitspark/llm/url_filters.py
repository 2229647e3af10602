"""Operator 13 (native): url filters by rules and, where no rule fits, by a path-template tree.

Every host has a tree of path templates, which grows from the host down, all nodes of a level in one pass over
the distinct paths. A node first takes all segments that its paths have in common. Then a segment value that
stands for a stated share of the node's rows is a branch of its own; all other values are variable and become
a wildcard, which keeps a frequent file ending. Branches whose rows go on alike are merged: from the largest
branch on, each joins the first larger one from which none of its shares (paths that end there, kinds of the next
segment, labels) differs by more than a Hoeffding bound. A leaf is a template. It is rejected if its purity,
the share of bad rows among the labelled ones smoothed with a few rows of the overall share, reaches a threshold.

Only DataFrame operations are used. A node has at most 100 literal branches and 100 wildcards as each stands
for 1 % of its rows, so the merging looks at a bounded list; a host of any size is spread over its paths.

Defined results: host and path of a null url or one without ``://`` are empty; rows with a null or repeated id
are all judged; equal urls have equal verdicts; a node of fewer than ``least`` rows is not split further (``/**``);
an empty table gives an empty result; further columns are not read.
"""
from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pitspark.functions.ordering import with_constants
from pitspark.llm.registry import query, table
from pitspark.session import durable

LEAST = 8                   # rows of a node that is split, and of a literal branch
SHARE = 0.01                # of a node's rows: least of a literal branch or of a file ending
ALPHA = 0.05                # of the Hoeffding bound that keeps branches apart
PRIOR_ROWS, PURITY = 4.0, 0.9
BLOCK, ALLOW = "block", "allow"

# fixed values: the rules of the registered query, as verdict, host and path
RULES = [(BLOCK, "net", "/"), (ALLOW, "example.net", "/en/"), (BLOCK, "example.com", "/de/"), (ALLOW, "org", "/fr/")]

PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SALTS = 32
TRAITS = ["n_end", "n_empty", "n_digits", "n_letters", "bad", "good"]


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits, the first of equally long ones, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for told, h, p in reversed(sorted(rules, key=lambda r: -len(r[1] + r[2]))):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, told).otherwise(verdict)
    return rule, verdict


def _name(segment: Column) -> Column:
    """A literal segment; signs that templates use are escaped."""
    for sign, code in (("%", "%25"), ("*", "%2A"), ("{", "%7B"), (",", "%2C")):
        segment = F.replace(segment, F.lit(sign), F.lit(code))
    return segment


def _alike(a: Column, b: Column, alpha: float) -> Column:
    reach = math.sqrt(0.5 * math.log(2 / alpha)) * (1 / F.sqrt(a["n"]) + 1 / F.sqrt(b["n"]))
    return reduce(lambda x, y: x & y, [F.abs(a[t] / a["n"] - b[t] / b["n"]) <= reach for t in TRAITS])


def _merged(branches: Column, alpha: float) -> Column:
    """Groups (leader, members) of the sorted branches of a node."""
    def place(groups: Column, b: Column) -> Column:
        hit = F.array_position(F.transform(groups, lambda g: _alike(g["leader"], b, alpha)), True)
        joined = F.transform(groups, lambda g, i: F.struct(
            g["leader"].alias("leader"),
            F.when(i + 1 == hit, F.concat(g["members"], F.array(b["name"]))).otherwise(g["members"]).alias("members")))
        own = F.array(F.struct(b.alias("leader"), F.array(b["name"]).alias("members")))
        return F.when(hit > 0, joined).otherwise(F.concat(groups, own))

    none = F.slice(F.transform(branches, lambda b: F.struct(b.alias("leader"), F.array(b["name"]).alias("members"))), 1, 0)
    return F.aggregate(branches, none, place)


def split_level(rows: DataFrame, least: int, share: float, alpha: float) -> DataFrame:
    """One level of the tree for (host, path, node, rest, n, bad, good) rows with a non-empty ``rest``."""
    at = ["host", "node"]
    after = F.get("rest", F.lit(1))
    rows = rows.withColumn("segment", F.get("rest", F.lit(0)))
    kinds = {"n_end": F.size("rest") == 1, "n_empty": after == "", "n_digits": after.rlike("^[0-9]+$"),
             "n_letters": after.rlike("^[A-Za-z]+$")}
    values = rows.groupBy(*at, "segment").agg(
        *[F.sum(c).alias(c) for c in ("n", "bad", "good")],
        *[F.sum(F.when(k, F.col("n")).otherwise(0)).alias(c) for c, k in kinds.items()],
        F.min("rest").alias("low"), F.max("rest").alias("high"))
    nodes = values.groupBy(*at).agg(F.sum("n").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"))
    # segments that all paths of the node begin with: those of the least and the greatest one
    agree = F.transform("low", lambda x, i: F.coalesce(x == F.get(F.col("high"), i), F.lit(False)))
    differ = F.array_position(agree, False)
    nodes = nodes.select(*at, "total", F.when(differ > 0, differ - 1).otherwise(F.size("low")).cast("int").alias("common"))
    # a large node's values meet its totals in several tasks, and are added up there before they come together
    values = values.drop("low", "high").withColumn("salt", F.pmod(F.xxhash64("segment"), F.lit(SALTS)).cast("int"))
    values = values.join(nodes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*at, "salt"])
    literal = (F.col("n") >= least) & (F.col("n") >= share * F.col("total"))
    ending = F.regexp_extract("segment", r"(\.[A-Za-z][A-Za-z0-9]{0,4})$", 1)
    sums = [F.sum(c).alias(c) for c in ("n", *TRAITS)]
    branches = (values.where((F.col("common") == 0) & (F.col("total") >= least))
                .groupBy(*at, "total", F.when(literal, F.col("segment")).alias("literal"),
                         F.when(~literal, ending).alias("ending")).agg(*sums))
    kept = (F.col("n") >= share * F.col("total")) & (F.col("ending") != "")
    branches = branches.withColumn("ending", F.when(F.col("ending").isNull() | kept, F.col("ending")).otherwise(""))
    branches = branches.groupBy(*at, "literal", "ending").agg(*sums)
    name = F.coalesce(_name(F.col("literal")), F.concat(F.lit("*"), F.col("ending")))
    item = F.struct((-F.col("n")).alias("turn"), name.alias("name"), "n", *TRAITS, "literal", "ending")
    merged = (branches.groupBy(*at).agg(F.sort_array(F.collect_list(item)).alias("branches"))
              .withColumn("groups", _merged(F.col("branches"), alpha))
              .withColumn("names", F.transform("groups", lambda g: F.when(
                  F.size(g["members"]) == 1, g["members"][0]).otherwise(
                  F.concat(F.lit("{"), F.array_join(F.array_sort(g["members"]), ","), F.lit("}"))))))

    def named(kind: str) -> Column:
        own = F.filter("branches", lambda b: b[kind].isNotNull())
        return F.map_from_entries(F.transform(own, lambda b: F.struct(b[kind], F.element_at(F.col("names"), F.array_position(
            F.transform("groups", lambda g: F.array_contains(g["members"], b["name"])), True).cast("int")))))

    merged = merged.select(*at, named("literal").alias("literals"), named("ending").alias("wildcards"))
    told = rows.join(nodes.join(merged, at, "left"), at)
    step = F.coalesce(F.get(F.map_values(F.map_filter("literals", lambda k, v: k == F.col("segment"))), F.lit(0)),
                      F.get(F.map_values(F.map_filter("wildcards", lambda k, v: k == ending)), F.lit(0)),
                      F.get(F.map_values(F.map_filter("wildcards", lambda k, v: k == "")), F.lit(0)))
    few, chain = F.col("total") < least, F.col("common") > 0
    chained = F.array_join(F.transform(F.slice("rest", F.lit(1), F.col("common")), _name), "/")
    node = F.concat("node", F.lit("/"), F.when(few, F.lit("**")).when(chain, chained).otherwise(step))
    taken = F.when(few, F.size("rest")).when(chain, F.col("common")).otherwise(1)
    return told.select("host", "path", node.alias("node"), F.slice("rest", taken + 1, F.size("rest")).alias("rest"),
                       "n", "bad", "good")


def templates(urls: DataFrame, least: int = LEAST, share: float = SHARE, alpha: float = ALPHA) -> DataFrame:
    """(host, path, template, n, bad, good) of (host, path, n, bad, good) rows, one row per path of a host."""
    rest = F.split(F.substr("path", F.lit(2)), "/", -1)
    rows = urls.select("host", "path", F.lit("").alias("node"),
                       F.when(F.col("path") != "", rest).otherwise(F.array().cast("array<string>")).alias("rest"),
                       "n", "bad", "good")
    closed = []
    rows = durable(rows)
    while True:
        closed.append(rows.where(F.size("rest") == 0))
        rows = rows.where(F.size("rest") > 0)
        if rows.isEmpty():
            break
        rows = durable(split_level(rows, least, share, alpha))
    return reduce(DataFrame.unionByName, closed).select("host", "path", F.col("node").alias("template"), "n", "bad", "good")


def judged(pages: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url",
           label: Column | None = None, purity: float = PURITY, prior_rows: float = PRIOR_ROWS, least: int = LEAST,
           share: float = SHARE, alpha: float = ALPHA) -> DataFrame:
    """(id, host, path, rule, verdict, template, purity) of every row. ``label`` is 1 for bad rows, 0 for good
    ones and null for others; by default rows have their rule's verdict as label."""
    url = pages[url_col]
    rows = pages.select(pages[id_col].alias("id"), host_of(url).alias("host"), path_of(url).alias("path"),
                        (F.lit(None) if label is None else label).cast("int").alias("label"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "told": verdict})
    if label is None:
        rows = rows.withColumn("label", F.when(F.col("told") == BLOCK, 1).when(F.col("told") == ALLOW, 0))
    urls = rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 1).alias("bad"),
                                            F.count_if(F.col("label") == 0).alias("good"))
    found = durable(templates(urls, least, share, alpha))
    prior = found.agg(((F.sum("bad") + 1) / (F.sum("bad") + F.sum("good") + 2)).alias("prior"))
    leaves = with_constants(found.groupBy("host", "template").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")), prior)
    leaves = leaves.select("host", "template", ((F.col("bad") + prior_rows * F.col("prior"))
                                                / (F.col("bad") + F.col("good") + prior_rows)).alias("purity"))
    by_path = found.select("host", "path", "template").join(leaves, ["host", "template"])
    own = F.when(F.col("purity") >= purity, BLOCK).otherwise(ALLOW)
    return rows.join(by_path, ["host", "path"]).select(
        F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("told", own).alias("verdict"), "template", "purity")


@query("op13_url_filters")
def op13_url_filters(spark: SparkSession, sf: str) -> DataFrame:
    return judged(table(spark, sf, "pages"), RULES)
