"""Operator 10: near-duplicate embeddings by cross-polytope hashing.

A vector is rotated by three rounds of random signs and a fast Hadamard transform; the nearest signed axis
is a hash, several of them name a bucket of a table, and the next nearest axes name further buckets
(multiprobe). Vectors that meet in a bucket of a table are compared in double precision. Equal vectors are
one class with a count. Full buckets are compared in blocks, spread over tasks; a pair that meets in several
buckets counts in the first only, and a task hands on sums and a spanning forest, never pairs.

Defined results: a vector that is null, empty, zero or has null or non-finite components, a null label and
a null id link with nothing; vectors of different lengths never link; rows of one id count as vectors of
their own with the same id; an empty table gives an empty result; further columns are not read.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from pitspark.llm.graph import components
from pitspark.llm.registry import query, table
from pitspark.llm.runs import in_blocks, sides, whole_runs
from pitspark.llm.words import mix
from pitspark.session import durable

THRESHOLD = 0.98
TABLES, HASHES, PROBES = 10, 3, 4
BLOCK = 1024                # vectors of a bucket that are compared with as many others at once
PAIRS = 1 << 15             # pairs looked at in one numpy step


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of every row; the row length is a power of two."""
    n, d = x.shape
    step = 1
    while step < d:
        y = x.reshape(n, d // (2 * step), 2, step)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(n, d)
        step *= 2
    return x / np.sqrt(d)


def bucket_keys(x: np.ndarray, group: np.ndarray, tables: int, hashes: int, probes: int, seed: int) -> np.ndarray:
    """(rows, tables, probes) bucket keys; the first probe is the nearest axis of every hash."""
    n, d = x.shape
    size = 1 << max(1, (d - 1).bit_length())
    padded = np.zeros((n, size))
    padded[:, :d] = x
    rng = np.random.default_rng([seed, size])
    keys = np.zeros((n, tables, probes), np.uint64)
    rows = np.arange(n)
    for t in range(tables):
        codes, cost = np.zeros((n, hashes), np.int64), []
        options = []
        for h in range(hashes):
            y = padded
            for signs in rng.choice([-1.0, 1.0], (3, size)):
                y = hadamard(y * signs)
            level = np.abs(y)
            rank = np.argsort(-level, 1, kind="stable")[:, :3]
            code = rank * 2 + (y[rows[:, None], rank] < 0)
            codes[:, h] = code[:, 0]
            for r in range(1, min(3, size)):
                options.append((h, code[:, r]))
                cost.append((level[rows, rank[:, 0]] - level[rows, rank[:, r]]) ** 2)
        order = np.argsort(np.stack(cost, 1), 1, kind="stable")
        for p in range(probes):
            own = codes.copy()
            if p:
                pick = order[:, (p - 1) % order.shape[1]]
                for i, (h, code) in enumerate(options):
                    at = pick == i
                    own[at, h] = code[at]
            key = group + np.uint64(t)
            for h in range(hashes):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + own[:, h].astype(np.uint64))
            keys[:, t, p] = key
    return keys


def first_meeting(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest key that both of each pair of (tables, probes) key sets hold in the same table."""
    same = (a[:, :, :, None] == b[:, :, None, :]).any(3)
    return np.where(same, a, np.iinfo(np.int64).max).reshape(len(a), -1).min(1)


class Run:
    """Vectors of one bucket (or of two blocks of it) and what the comparison of all of them finds."""

    def __init__(self, key: int, reps: np.ndarray, count: np.ndarray, x: np.ndarray, keys: np.ndarray,
                 side: np.ndarray) -> None:
        self.key, self.reps, self.count, self.x, self.keys, self.side = key, reps, count, x, keys, side

    def compare(self, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """(vectors linked here and met here first, smallest member of the forest's tree) of each."""
        n = len(self.reps)
        links, root = np.zeros(n, np.int64), np.arange(n)
        left = np.flatnonzero(self.side != 1)           # 0: in both blocks, -1: left only, 1: right only
        pairs = []
        for i in range(0, len(left), 256):
            rows = left[i:i + 256]
            cosine = self.x[rows] @ self.x.T
            a, b = np.nonzero(cosine >= threshold - 1e-9)
            a = rows[a]
            fine = np.where((self.side[a] == 0) & (self.side[b] == 0), a < b, self.side[b] == 1)
            pairs.append(np.stack([a[fine], b[fine]]))
        a, b = np.concatenate(pairs, 1) if pairs else np.zeros((2, 0), np.int64)
        exact = np.einsum("ij,ij->i", self.x[a], self.x[b]) >= threshold
        a, b = a[exact], b[exact]
        for i in range(0, len(a), PAIRS):
            p, q = a[i:i + PAIRS], b[i:i + PAIRS]
            new = first_meeting(self.keys[p], self.keys[q]) == self.key
            np.add.at(links, p[new], self.count[q[new]])
            np.add.at(links, q[new], self.count[p[new]])
        while True:                                     # smallest number reachable, to a fixed point
            low = np.minimum(root[a], root[b])
            then = root.copy()
            np.minimum.at(then, a, low)
            np.minimum.at(then, b, low)
            then = then[then]
            if (then == root).all():
                return links, self.reps[root]
            root = then


def _unit(raw: list[bytes | None]) -> np.ndarray:
    x = np.stack([np.frombuffer(r, np.float64) for r in raw])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def prepared(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, raw): the vector's doubles as bytes, null where it links with nothing."""
    src = vectors.select(vectors[id_col].alias("id"), vectors[label_col].alias("label"),
                         vectors[vector_col].cast("array<double>").alias("v"))
    fine = (F.size("v") > 0) & F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    src = src.withColumn("v", F.when(fine & F.exists("v", lambda e: e != 0) & F.col("label").isNotNull()
                                     & F.col("id").isNotNull(), F.col("v")))
    kinds = src.schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = []
            for v in b.column("v").to_pylist():
                x = None if v is None else np.asarray(v, np.float64)
                if x is not None:
                    x = x / np.abs(x).max()             # so that no square overflows or vanishes
                raw.append(None if x is None else x.tobytes())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array(raw, pa.binary())],
                                             ["id", "label", "raw"])

    return src.mapInArrow(work, f"id {kinds['id'].dataType.simpleString()}, "
                                f"label {kinds['label'].dataType.simpleString()}, raw binary")


def hashed(classes: DataFrame, tables: int, hashes: int, probes: int, seed: int) -> DataFrame:
    """Bucket keys of every class (same, rep, n, grp, raw)."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.array([len(r) for r in b.column("raw").to_pylist()])
            for s in np.unique(size):
                part = b.take(pa.array(np.flatnonzero(size == s)))
                x = _unit(part.column("raw").to_pylist())
                group = np.array(part.column("grp").to_pylist(), np.int64).view(np.uint64)
                keys = bucket_keys(x, group, tables, hashes, probes, seed).view(np.int64).reshape(len(x), -1)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(list(keys), pa.list_(pa.int64()))], [*part.schema.names, "keys"])

    return classes.mapInArrow(work, "same string, rep long, n long, grp long, raw binary, keys array<long>")


def compared(members: DataFrame, threshold: float, tables: int, probes: int) -> DataFrame:
    """(rep, links, root) found in every (key, i, j) run of the sorted partitions of ``members``."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, key, borders in whole_runs(batches, ["key", "i", "j"]):
            reps, count = rows.column("rep").to_numpy(), rows.column("n").to_numpy()
            block, raw = rows.column("block").to_numpy(), rows.column("raw").to_pylist()
            keys = np.array(rows.column("keys").to_pylist(), np.int64).reshape(rows.num_rows, tables, probes)
            out = []
            for a, b in zip(borders, borders[1:]):
                if b - a < 2 or len(set(map(len, raw[a:b]))) > 1:
                    continue
                run = Run(int(key[0, a]), reps[a:b], count[a:b], _unit(raw[a:b]), keys[a:b], sides(key, a, block[a:b]))
                links, root = run.compare(threshold)
                some = (links > 0) | (root != reps[a:b])
                out.append(np.stack([reps[a:b][some], links[some], root[some]]))
            if out:
                yield pa.RecordBatch.from_arrays(list(map(pa.array, np.concatenate(out, 1))), ["rep", "links", "root"])

    return members.mapInArrow(work, "rep long, links long, root long")


def link(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
         threshold: float = THRESHOLD, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES,
         block: int = BLOCK, seed: int = 10) -> DataFrame:
    """(id, n_links, component_id, kept) of every row. Ids are whole numbers."""
    rows = prepared(vectors, id_col, vector_col, label_col)
    rows = rows.withColumn("grp", F.xxhash64("label", F.length("raw")))
    # equal vectors of one label have one name; null where the vector links with nothing
    rows = durable(rows.withColumn("same", F.md5(F.concat("raw", F.col("grp").cast("string").cast("binary")))))
    classes = rows.where("same is not null").groupBy("same").agg(
        F.min(F.col("id").cast("long")).alias("rep"), F.count(F.lit(1)).alias("n"),
        F.min("grp").alias("grp"), F.min("raw").alias("raw"))
    # one id may stand for several classes, so they get numbers of their own
    classes = durable(hashed(classes, tables, hashes, probes, seed).withColumn("uid", F.monotonically_increasing_id()))
    met = classes.select("uid", F.explode(F.array_distinct("keys")).alias("key"))
    full = met.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    met = in_blocks(met.join(full, "key"), "key", "uid", F.col("size"), block).select("uid", "key", "block", "i", "j")
    members = met.join(classes, "uid").select("key", "i", "j", "block", F.col("uid").alias("rep"), "n", "raw", "keys")
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    members = members.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    found = durable(compared(members, threshold, tables, probes))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    tree = components(found.where("rep <> root"), "rep", "root")
    placed = (classes.select("uid", "same", "rep", "n").join(tree, F.col("uid") == F.col("node"), "left")
              .select("uid", "same", "rep", "n", F.coalesce("root", "uid").alias("root")))
    least = placed.groupBy("root").agg(F.min("rep").alias("component"))
    told = (placed.join(least, "root").join(links.withColumnRenamed("rep", "uid"), "uid", "left")
            .select("same", "component", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    done = rows.select("id", "same").join(told, "same", "left")
    own = F.when(F.col("id").isNotNull(), F.coalesce("component", F.col("id").cast("long")))
    return done.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"),
                       own.alias("component_id"), F.coalesce(own == F.col("id"), F.lit(False)).alias("kept"))


@query("op10_embeddings")
def op10_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return link(table(spark, sf, "embeddings"))
