"""Operator 12: a Merkle manifest of a table by time-forward processing.

The tree is a graph whose nodes are labelled so that every child comes before its parent. Nodes are taken
in the order of their labels; a node's digest is sent to its parent as a message, and a priority queue ordered
by label hands each node the messages of its children when its turn comes. The reversed sweep goes from the
root down: a node sends each child the child's proof suffix, which is the child's sibling before the node's
own suffix.

The queue is external: labels are cut into blocks of aligned subtrees, a message to another block is a row
of a table, dealt by block and sorted by label, and only the messages inside one block (1,024 nodes of a
level) lie in a heap. A layer of blocks raises the tree by ten levels, so a thousand million leaves need
three layers, and no task holds more than a block whatever a group's size.

Defined results: a null value is ``-``; a null group comes first and a null id before all others; rows of
one id stand in the order of their leaves; a group of one leaf is its own subroot; a null id or counter is
never changed by tampering; an empty table gives an empty result; other columns only matter if listed.
"""
from __future__ import annotations

import heapq
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from pitspark.llm.registry import query, table
from pitspark.llm.runs import whole_runs
from pitspark.session import durable

BITS = 10                   # levels that one layer of blocks raises the tree
LEFT, RIGHT, ALONE = "<", ">", "."      # where a proof step's sibling stands
TOP = -1                    # number of the group of subroots


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def leaf_digest(*values: Column) -> Column:
    """Digest of values one after the other: ``-`` for null, else UTF-8 byte count, ``:`` and the value."""
    def part(v: Column) -> Column:
        s = v.cast("string")
        return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))

    return F.sha2(F.concat(*map(part, values)).cast("binary"), 256)


def fold(leaf: str, proof: str) -> str:
    """The root that a leaf and its proof lead to. A step is a mark and the sibling's 64 hex digits."""
    at, end = 0, len(proof)
    while at < end:
        mark = proof[at]
        at += 1
        if mark == ALONE:
            leaf = digest(leaf)
            continue
        sibling = proof[at:at + 64]
        at += 64
        leaf = digest(sibling + leaf if mark == LEFT else leaf + sibling)
    return leaf


def siblings(proof: str) -> str:
    """The digests of a proof, leaf to root."""
    return proof.replace(LEFT, "").replace(RIGHT, "").replace(ALONE, "")


def levels(n: int, bits: int) -> int:
    """Levels that a block raises nodes of a group that has ``n`` of them."""
    return min(bits, (n - 1).bit_length())


def climb(nodes: list[str], height: int) -> list[list[str]]:
    """Digests of the levels 0 to ``height`` of a block, by a queue of (label of the parent and side, digest)
    messages; a label is level and place."""
    done = [nodes] + [[] for _ in range(height)]
    if not height:
        return done
    queue = [((1 << 40) + i, d) for i, d in enumerate(nodes)]      # sorted, and so a heap
    while queue:
        label, child = heapq.heappop(queue)
        if queue and queue[0][0] >> 1 == label >> 1:
            child += heapq.heappop(queue)[1]
        level, place = label >> 40, (label & ((1 << 40) - 1)) >> 1
        own = digest(child)
        done[level].append(own)
        if level < height:
            heapq.heappush(queue, (((level + 1) << 40) + place, own))
    return done


def descend(done: list[list[str]], suffix: str) -> list[str]:
    """Proofs of the nodes of a block, by a queue of (label, proof suffix) messages from the root down."""
    height = len(done) - 1
    proofs = [""] * len(done[0])
    queue = [(-(height << 40), suffix)]
    while queue:
        label, own = heapq.heappop(queue)
        level, place = -label >> 40, -label & ((1 << 40) - 1)
        if not level:
            proofs[place] = own
            continue
        below, first = done[level - 1], 2 * place
        base = (level - 1) << 40
        if first + 1 < len(below):
            heapq.heappush(queue, (-(base + first), RIGHT + below[first + 1] + own))
            heapq.heappush(queue, (-(base + first + 1), LEFT + below[first] + own))
        else:
            heapq.heappush(queue, (-(base + first), ALONE + own))
    return proofs


def _dealt(rows: DataFrame) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "g", "block").sortWithinPartitions("g", "block", "pos")


def raised(nodes: DataFrame, bits: int) -> DataFrame:
    """(g, pos, n, digest) of the blocks' roots; ``n`` is the number of nodes of the group in the layer."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, key, borders in whole_runs(batches, ["g", "block"]):
            digests, count = rows.column("digest").to_pylist(), rows.column("n").to_pylist()
            heads = borders[:-1]
            tops = [climb(digests[a:b], levels(count[a], bits))[-1][0] for a, b in zip(borders, borders[1:])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[0, heads]), pa.array(key[1, heads]),
                 pa.array([-(-count[a] >> bits) for a in heads], pa.int64()), pa.array(tops, pa.string())],
                ["g", "pos", "n", "digest"])

    rows = nodes.select("g", F.shiftright("pos", bits).alias("block"), "pos", "n", "digest")
    return _dealt(rows).mapInArrow(work, "g long, pos long, n long, digest string")


def lowered(nodes: DataFrame, messages: DataFrame, bits: int, extra: dict[str, str], out: str, finish) -> DataFrame:
    """Bring the (g, pos, suffix, subroot, root) messages of block roots down to the ``nodes`` of the layer.
    ``finish`` turns (rows, proofs, message of each row's block) into the arrays of the ``out`` schema."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, key, borders in whole_runs(batches, ["g", "block"]):
            digests, count = rows.column("digest").to_pylist(), rows.column("n").to_pylist()
            told = [rows.column(c).to_pylist() for c in ("suffix", "subroot", "root")]
            keep, proofs, message = [], [], []
            for a, b in zip(borders, borders[1:]):
                if b - a < 2:
                    raise ValueError("a block without nodes or without a message")
                proofs += descend(climb(digests[a + 1:b], levels(count[a + 1], bits)), told[0][a])
                keep += range(a + 1, b)
                message += [(told[1][a], told[2][a])] * (b - a - 1)
            yield finish(rows.take(pa.array(keep, pa.int64())), proofs, message)

    own = nodes.select("g", F.shiftright("pos", bits).alias("block"), "pos", "n", "digest", *extra,
                       *[F.lit(None).cast("string").alias(c) for c in ("suffix", "subroot", "root")])
    sent = messages.select("g", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"),
                           F.lit(None).cast("long").alias("n"), F.lit(None).cast("string").alias("digest"),
                           *[F.lit(None).cast(t).alias(c) for c, t in extra.items()], "suffix", "subroot", "root")
    return _dealt(own.unionByName(sent)).mapInArrow(work, out)


def _messages(rows: pa.Table, proofs: list[str], message: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [rows.column("g").combine_chunks(), rows.column("pos").combine_chunks(), pa.array(proofs, pa.string()),
         pa.array([m[0] for m in message], pa.string()), pa.array([m[1] for m in message], pa.string())],
        ["g", "pos", "suffix", "subroot", "root"])


MESSAGE = "g long, pos long, suffix string, subroot string, root string"


def layers(nodes: DataFrame, bits: int) -> list[DataFrame]:
    """The layers of block roots above ``nodes``, up to one node of each group."""
    found = [nodes]
    while (found[-1].agg(F.max("n")).head()[0] or 0) > 1:
        found.append(durable(raised(found[-1], bits)))
    return found


def placed(rows: DataFrame, group: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with ``g`` (number of their group in its order), ``pos`` (gapless in ``order`` within it) and
    ``n``, and the groups (g, group, n). Rows are sorted by ranges that cut a large group, and a range's
    start is counted in a table of one row per range and group."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = durable(rows.repartitionByRange(parts, group, *order).withColumn("_range", F.spark_partition_id()))
    counts = dealt.groupBy("_range", group).agg(F.count(F.lit(1)).alias("_c"))
    own = W.partitionBy(group)
    before = own.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    counts = durable(counts.select("_range", F.col(group).alias("_group"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_start"),
                                   F.sum("_c").over(own).alias("n")))
    heads = counts.where("_start = 0").select("_range", "_group", "n")
    # a range holds whole groups or one part of a group, so groups are numbered by range, then inside it
    in_range = heads.groupBy("_range").agg(F.count(F.lit(1)).alias("_groups"))
    starts = in_range.select("_range", (F.sum("_groups").over(W.orderBy("_range")) - F.col("_groups")).alias("_first"))
    groups = durable(heads.join(starts, "_range").select(
        (F.col("_first") + F.row_number().over(W.partitionBy("_range").orderBy("_group")) - 1).cast("long").alias("g"),
        "_group", "n"))
    at = counts.join(groups.select("g", F.col("_group").alias("_named")), F.col("_group").eqNullSafe(F.col("_named")))
    at = at.select(F.col("_range").alias("_r"), "_group", "_start", "n", "g")
    same = (F.col("_range") == F.col("_r")) & F.col(group).eqNullSafe(F.col("_group"))
    numbered = dealt.withColumn("_row", F.row_number().over(W.partitionBy("_range", group).orderBy(*order)))
    return (numbered.join(at, same).withColumn("pos", F.col("_start") + F.col("_row") - 1)
            .drop("_range", "_r", "_group", "_start", "_row")), groups


def manifest(leaves: DataFrame, id_col: str, group_col: str, leaf_col: str = "leaf", check_col: str | None = None,
             bits: int = BITS, proofs: bool = False) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root [, proof]) of every row of ``leaves``. The root
    is folded from ``check_col`` where it is not null, else from the leaf, along the row's proof."""
    kind = leaves.schema[id_col].dataType.simpleString()
    rows = leaves.select(leaves[id_col].alias("id"), leaves[group_col].alias("grp"), leaves[leaf_col].alias("digest"),
                         (F.lit(None).cast("string") if check_col is None else leaves[check_col]).alias("check"))
    # equal rows have equal leaves; the turn only lets the sort cut through many of them
    rows = durable(rows.withColumn("turn", F.monotonically_increasing_id()))
    nodes, groups = placed(rows, "grp", ["id", "digest", "turn"])
    nodes = durable(nodes.select("g", "pos", "n", "digest", "id", "check"))
    below = layers(nodes, bits)
    subroots = below[-1].select("g", "digest")
    total = groups.agg(F.count(F.lit(1))).head()[0]
    top = layers(durable(subroots.select(F.lit(TOP).cast("long").alias("g"), F.col("g").alias("pos"),
                                         F.lit(total).cast("long").alias("n"), "digest")), bits)
    sent = top[-1].select("g", "pos", F.lit("").alias("suffix"), F.lit(None).cast("string").alias("subroot"),
                          F.col("digest").alias("root"))
    for layer in top[-2::-1] if len(top) > 1 else []:
        sent = durable(lowered(layer, sent, bits, {}, MESSAGE, _messages))
    sent = (sent.select(F.col("pos").alias("g"), F.lit(0).cast("long").alias("pos"), "suffix", "root")
            .join(subroots.withColumnRenamed("digest", "subroot"), "g"))
    for layer in below[-2:0:-1]:
        sent = durable(lowered(layer, sent, bits, {}, MESSAGE, _messages))

    names = ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root"] + ["proof"] * proofs

    def finish(rows: pa.Table, found: list[str], message: list[tuple]) -> pa.RecordBatch:
        leaf, check = rows.column("digest").to_pylist(), rows.column("check").to_pylist()
        arrays = [rows.column("id").combine_chunks(), *[pa.array(x, pa.string()) for x in (
            leaf, [m[0] for m in message], [m[1] for m in message], [digest(siblings(p)) for p in found],
            [fold(x if c is None else c, p) for x, c, p in zip(leaf, check, found)])]]
        return pa.RecordBatch.from_arrays(arrays + [pa.array(found, pa.string())] * proofs, names)

    out = f"id {kind}, " + ", ".join(f"{c} string" for c in names[1:])
    sent = sent.select("g", "pos", "suffix", "subroot", "root")
    return lowered(nodes, sent, bits, {"id": kind, "check": "string"}, out, finish).withColumnRenamed("id", id_col)


def tampered(docs: DataFrame, id_col: str, counter: str) -> Column:
    """The counter, one more where 7 divides the checksum of the id."""
    hit = F.crc32(docs[id_col].cast("string").cast("binary")) % 7 == 0
    return F.when(F.coalesce(hit, F.lit(False)), docs[counter] + 1).otherwise(docs[counter])


_RULE = """
WITH RECURSIVE bits AS (
  SELECT doc_id AS crc_of, 4294967295::BIGINT AS crc, 0 AS i FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
  UNION ALL
  SELECT crc_of, list_reduce(list_concat([xor(crc, ascii(substr(crc_of::VARCHAR, i + 1, 1))::BIGINT)], [0,0,0,0,0,0,0,0]),
           lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384::BIGINT) ELSE a // 2 END), i + 1
  FROM bits WHERE i < length(crc_of::VARCHAR)
), hit AS (
  SELECT crc_of FROM bits WHERE i = length(crc_of::VARCHAR) AND xor(crc, 4294967295::BIGINT) % 7 = 0
), parts AS (
  SELECT doc_id, lang, n_chars, n_chars + CASE WHEN crc_of IS NULL THEN 0 ELSE 1 END AS changed,
         concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
                coalesce(strlen(lang) || ':' || lang, '-')) AS head,
         coalesce(strlen(text) || ':' || text, '-') AS tail
  FROM documents LEFT JOIN hit ON doc_id = crc_of
), leaves AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
         sha256(head || coalesce(strlen(changed::VARCHAR) || ':' || changed, '-') || tail) AS bent
  FROM parts
), ordered AS (
  SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         count(*) OVER (PARTITION BY lang) AS n
  FROM leaves
), low AS (
  SELECT g, 0 AS level, pos, n, leaf AS d FROM ordered
  UNION ALL
  SELECT g, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(d, '' ORDER BY pos))
  FROM low WHERE n > 1 GROUP BY g, level, pos // 2, n
), high AS (
  SELECT 0 AS level, g AS pos, (SELECT count(DISTINCT g) FROM ordered) AS n, d FROM low WHERE n = 1
  UNION ALL
  SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(d, '' ORDER BY pos))
  FROM high WHERE n > 1 GROUP BY level, pos // 2, n
), walk AS (
  SELECT doc_id, g, leaf, bent AS folded, pos, n, 0 AS level, '' AS proof FROM ordered
  UNION ALL
  SELECT w.doc_id, w.g, w.leaf, CASE WHEN s.d IS NULL THEN sha256(folded) WHEN w.pos % 2 = 1 THEN sha256(s.d || folded)
           ELSE sha256(folded || s.d) END, w.pos // 2, (w.n + 1) // 2, w.level + 1, proof || coalesce(s.d, '')
  FROM walk w LEFT JOIN low s ON s.g = w.g AND s.level = w.level AND s.pos = xor(w.pos, 1::BIGINT)
  WHERE w.n > 1
), up AS (
  SELECT doc_id, w.g, leaf, folded, w.g AS pos, (SELECT count(DISTINCT g) FROM ordered) AS n, 0 AS level, proof
  FROM walk w WHERE w.n = 1
  UNION ALL
  SELECT w.doc_id, w.g, w.leaf, CASE WHEN s.d IS NULL THEN sha256(folded) WHEN w.pos % 2 = 1 THEN sha256(s.d || folded)
           ELSE sha256(folded || s.d) END, w.pos // 2, (w.n + 1) // 2, w.level + 1, proof || coalesce(s.d, '')
  FROM up w LEFT JOIN high s ON s.level = w.level AND s.pos = xor(w.pos, 1::BIGINT)
  WHERE w.n > 1
)
SELECT doc_id, leaf, low.d AS subroot, high.d AS root, sha256(proof) AS proof_sha256, folded AS folded_root,
       folded = high.d AS verified
FROM up JOIN low ON low.g = up.g AND low.n = 1, high WHERE up.n = 1 AND high.n = 1
"""


@query("op12_merkle", _RULE)
def op12_merkle(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")

    def leaf(counter: Column) -> Column:
        return leaf_digest(docs["doc_id"], docs["source"], docs["lang"], counter, docs["text"])

    bent = tampered(docs, "doc_id", "n_chars")
    leaves = docs.select("doc_id", "lang", leaf(docs["n_chars"]).alias("leaf"),
                         F.when(~bent.eqNullSafe(docs["n_chars"]), leaf(bent)).alias("bent"))
    told = manifest(leaves, "doc_id", "lang", "leaf", "bent")
    return told.withColumn("verified", F.col("folded_root") == F.col("root"))
