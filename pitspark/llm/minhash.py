"""Operator 1: near-duplicate texts by improved consistent weighted sampling.

A text is the set of its five-word shingles, weighted by how often it holds them times an inverse document
frequency. That of a shingle is the mean over its words, whose document frequencies are counted over all
texts in a table of fixed size (words share its cells by hash). Each of 64 samples draws one shingle of a
text with a chance in proportion to its weight, so that two texts draw the same one as often as their
weighted Jaccard similarity says; four samples make a band, and texts that agree in a band are candidates.

Equal texts are one node. In a band's bucket every text is first compared with one of them only. Buckets that
still hold several groups are then compared whole, in blocks spread over tasks: each text with all of other
groups at once, groups growing together as links are found, of which only a spanning forest is handed
on. So no link between candidates is lost, and no bucket is expanded in pairs.
A link is a pair whose weighted Jaccard similarity, taken exactly from both whole texts, reaches the threshold.

Defined results: a null text is a class of its own; empty and wordless texts are grouped with equal texts only;
a text of fewer than five words is one shingle; a null id counts as the smallest; rows of one id are placed
by their texts; an empty table gives an empty result; further columns are not read.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F

from pitspark.llm.graph import components
from pitspark.llm.registry import query, table
from pitspark.llm.runs import in_blocks, sides, whole_runs
from pitspark.llm.tally import summed
from pitspark.llm.words import Hasher, Texts, mix, slices, texts_of, word_grams, words_of
from pitspark.session import durable

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 16, 4
DF_BITS = 21                # cells of the document frequency table: 8 MB, whatever the size of the corpus
POOL_BITS = 16              # variates a sample chooses from by hash
BLOCK, BLOCK_BYTES = 2048, 1 << 22      # texts, and their bytes, of a block of a bucket
SMALLEST = -(1 << 63)


class Sampler:
    """Consistent weighted samples. For an element x of weight w and variates r, c ~ Gamma(2, 1) and
    b ~ U(0, 1) of x: t = floor(ln w / r + b), ln a = ln c - r (t - b + 1); the least a is drawn, with its t."""

    def __init__(self, samples: int, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        size = 1 << POOL_BITS
        self.r = rng.gamma(2.0, 1.0, size).astype(np.float32)
        self.inverse = (1.0 / self.r).astype(np.float32)
        self.c = np.log(rng.gamma(2.0, 1.0, size)).astype(np.float32)
        self.b = rng.random(size, np.float32)
        self.odd = rng.integers(1, 1 << 63, samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def draw(self, code: np.ndarray, weight: np.ndarray, first: np.ndarray) -> np.ndarray:
        """(sets, samples) 32-bit hashes of (element, t); set i holds elements first[i]:first[i+1], sorted
        by code, at least one."""
        log = np.log(weight).astype(np.float32)
        count = np.diff(first)
        out = np.zeros((len(count), len(self.odd)), np.uint32)
        shift = np.uint64(64 - POOL_BITS)
        for j, odd in enumerate(self.odd):
            at = ((code * odd) >> shift).astype(np.int32)
            r, b = self.r[at], self.b[at]
            t = np.floor(log * self.inverse[at] + b)
            a = self.c[at] - r * (t - b + np.float32(1))
            low = np.flatnonzero(a == np.repeat(np.minimum.reduceat(a, first[:-1]), count))
            low = low[np.searchsorted(low, first[:-1])]         # the first of equal ones
            drawn = mix(code[low] + t[low].astype(np.int64).astype(np.uint64) * odd)
            out[:, j] = (drawn >> np.uint64(32)).astype(np.uint32)
        return out


def shingles(texts: Texts, hasher: Hasher, idf: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, weight) of the distinct shingles of every text, sorted by both."""
    words = words_of(texts, hasher)
    own = idf[(words.code >> np.uint64(64 - DF_BITS)).astype(np.int64)].astype(np.float64)
    code, owner = word_grams(words, n)
    count = np.diff(words.first)
    sums = np.concatenate([[0.0], np.cumsum(own)])
    each = np.maximum(count - n + 1, 0)
    place = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(words.first[:-1], each)
    short = np.flatnonzero((count > 0) & (count < n))
    mean = np.concatenate([(sums[place + n] - sums[place]) / n,
                           (sums[words.first[1:][short]] - sums[words.first[:-1][short]]) / np.maximum(count[short], 1)])
    order = np.lexsort((code, owner))
    owner, code, mean = owner[order], code[order], mean[order]
    new = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (owner[1:] != owner[:-1]))) if len(code) else np.zeros(0, int)
    times = np.diff(np.append(new, len(code)))
    # rounded, as running sums differ in their last bits with what stands before
    return owner[new], code[new], np.round(mean[new], 4) * times


def document_frequencies(rows: DataFrame) -> np.ndarray:
    """Inverse document frequency of each cell: 1 + ln((1 + texts) / (1 + texts with a word of the cell))."""
    cells = 1 << DF_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        hasher, found = Hasher(), np.zeros(cells + 1, np.int32)
        for part, texts in slices(batches, "text"):
            words = words_of(texts, hasher)
            owner = np.repeat(np.arange(part.num_rows), np.diff(words.first))
            key = np.unique((owner << DF_BITS) | (words.code >> np.uint64(64 - DF_BITS)).astype(np.int64))
            cell, times = np.unique(key & (cells - 1), return_counts=True)
            found[cell] += times.astype(np.int32)
            found[-1] += part.num_rows
        return found

    found = summed(rows.select("text"), count, cells + 1)
    return (1.0 + np.log((1 + found[-1]) / (1 + found[:-1]))).astype(np.float32)


def sketches(rows: DataFrame, idf: Broadcast, n: int, bands: int, band_rows: int) -> DataFrame:
    """(id, t, bytes, bands) of every (id, t, text) row; no bands without words."""
    kind = rows.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, sampler = Hasher(), Sampler(bands * band_rows)
        salt = mix(np.arange(1, bands + 1, dtype=np.uint64))
        for part, texts in slices(batches, "text"):
            owner, code, weight = shingles(texts, hasher, idf.value, n)
            some, first = np.unique(owner, return_index=True)
            keys = [None] * part.num_rows
            if len(some):
                drawn = sampler.draw(code, weight, np.append(first, len(code)))
                key = np.broadcast_to(salt, (len(some), bands)).copy()
                for i in range(band_rows):
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + drawn[:, i::band_rows].astype(np.uint64))
                for i, k in zip(some.tolist(), key.view(np.int64)):
                    keys[i] = k
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("t"), pa.array(np.diff(texts.at)), pa.array(keys, pa.list_(pa.int64()))],
                ["id", "t", "bytes", "bands"])

    return rows.select("id", "t", "text").mapInArrow(work, f"id {kind}, t long, bytes long, bands array<long>")


def similarities(left: Texts, right: Texts, hasher: Hasher, idf: np.ndarray, n: int) -> np.ndarray:
    """Weighted Jaccard similarity of the i-th texts of both sides."""
    count = len(left.at) - 1
    sets = [shingles(x, hasher, idf, n) for x in (left, right)]
    whole = sum(np.bincount(s[0], s[2], minlength=count) for s in sets)
    owner, code, weight = (np.concatenate(x) for x in zip(*sets))
    order = np.lexsort((code, owner))
    owner, code, weight = owner[order], code[order], weight[order]
    twice = np.flatnonzero((code[1:] == code[:-1]) & (owner[1:] == owner[:-1]))
    both = np.bincount(owner[twice], np.minimum(weight[twice], weight[twice + 1]), minlength=count)
    return np.where(whole > 0, both / np.maximum(whole - both, 1e-300), 0.0)


def verified(pairs: DataFrame, texts: DataFrame, idf: Broadcast, n: int, threshold: float) -> DataFrame:
    """The (a, b) pairs of text keys whose texts are alike enough."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            sides_ = [texts_of(batch.column(c)) for c in ("x", "y")]
            size = np.diff(sides_[0].at) + np.diff(sides_[1].at)
            turn = np.cumsum(size) // (1 << 21)
            for rows in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(turn)) + 1):
                if not len(rows):
                    continue
                part = batch.slice(rows[0], len(rows))
                left, right = (texts_of(part.column(c)) for c in ("x", "y"))
                left, right = (Texts(t.data[t.at[0]:t.at[-1]], t.at - t.at[0]) for t in (left, right))
                fine = pa.array(similarities(left, right, hasher, idf.value, n) >= threshold)
                yield part.select(["a", "b"]).filter(fine)

    one = pairs.join(texts.select(F.col("t").alias("a"), F.col("text").alias("x")), "a")
    two = one.join(texts.select(F.col("t").alias("b"), F.col("text").alias("y")), "b")
    return two.select("a", "b", "x", "y").mapInArrow(work, "a long, b long").distinct()


def between_groups(texts: Texts, hasher: Hasher, idf: np.ndarray, n: int, threshold: float, root: np.ndarray,
                   side: np.ndarray) -> list[tuple[int, int]]:
    """Links that join the groups ``root`` of some texts, one for every two groups that grow together; every
    pair of different groups (and of both sides) is compared exactly unless the groups have met before."""
    owner, code, weight = shingles(texts, hasher, idf, n)
    count = len(root)
    first = np.searchsorted(owner, np.arange(count + 1))
    total = np.bincount(owner, weight, minlength=count)
    distinct, number = np.unique(code, return_inverse=True)
    own = np.zeros(len(distinct))
    label = np.unique(root, return_inverse=True)[1]
    links = []
    for a in np.flatnonzero(side != 1):
        other = np.arange(a + 1, count) if side[a] == 0 else np.flatnonzero(side == 1)
        near = np.minimum(total[other], total[a]) >= threshold * np.maximum(total[other], total[a]) * (1 - 1e-9)
        other = other[near & (label[other] != label[a])]
        if not len(other):
            continue
        mine = slice(first[a], first[a + 1])
        own[number[mine]] = weight[mine]
        size = first[other + 1] - first[other]
        starts = np.cumsum(size) - size
        at = np.arange(size.sum()) + np.repeat(first[other] - starts, size)
        both = np.add.reduceat(np.minimum(own[number[at]], weight[at]), starts)
        own[number[mine]] = 0.0
        for b in other[both / (total[a] + total[other] - both) >= threshold].tolist():
            if label[b] != label[a]:
                links.append((int(a), b))
                label[label == label[b]] = label[a]
    return links


def across_groups(members: DataFrame, idf: Broadcast, n: int, threshold: float) -> DataFrame:
    """(a, b) links between groups within the runs (key, i, j) of the sorted partitions of ``members``."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for rows, key, borders in whole_runs(batches, ["key", "i", "j"]):
            node, root, block = (rows.column(c).to_numpy() for c in ("t", "root", "block"))
            for x, y in zip(borders, borders[1:]):
                if y - x < 2 or (root[x:y] == root[x]).all():
                    continue
                texts = texts_of(rows.column("text").slice(x, y - x))
                texts = Texts(texts.data[texts.at[0]:texts.at[-1]], texts.at - texts.at[0])
                links = between_groups(texts, hasher, idf.value, n, threshold, root[x:y], sides(key, x, block[x:y]))
                if links:
                    pair = node[x:y][np.array(links)]
                    yield pa.RecordBatch.from_arrays([pa.array(pair.min(1)), pa.array(pair.max(1))], ["a", "b"])

    return members.mapInArrow(work, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE,
                    threshold: float = THRESHOLD, bands: int = BANDS, band_rows: int = ROWS,
                    block: int = BLOCK) -> DataFrame:
    """(id, class_id, kept, text_key) of every row: the smallest id of its class, whether it is that id,
    and a hash of the text."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(SMALLEST)).alias("id"),
                       docs[text_col].alias("text"))
    rows = rows.withColumn("t", F.when(F.col("text").isNotNull(), F.xxhash64("text")))
    idf = spark.sparkContext.broadcast(document_frequencies(rows))
    drawn = durable(sketches(rows, idf, n, bands, band_rows))
    nodes = durable(drawn.where("t is not null and bands is not null").groupBy("t").agg(
        F.min("id").alias("low"), F.first("bytes").alias("bytes"), F.first("bands").alias("bands")))
    met = nodes.select("t", F.explode("bands").alias("key"))
    heads = met.groupBy("key").agg(F.min("t").alias("a"), F.count(F.lit(1)).alias("size")).where("size > 1")
    first = durable(met.join(heads, "key").where("t <> a").select("a", F.col("t").alias("b")).distinct())
    shared = met.join(heads.select("key"), "key")
    wanted = shared.select("t").distinct().join(nodes.select("t", F.col("low").alias("id")), "t")
    texts = durable(rows.where("t is not null").join(wanted, ["id", "t"]).select("t", "text"))
    links = durable(verified(first, texts, idf, n, threshold))
    tree = components(links, "a", "b")
    placed = nodes.join(tree, F.col("t") == F.col("node"), "left").select(
        "t", "bytes", F.coalesce("root", "t").alias("root"))
    grouped = shared.join(placed, "t")
    mixed = grouped.groupBy("key").agg(F.min("root").alias("_x"), F.max("root").alias("_y"),
                                       F.count(F.lit(1)).alias("size"), F.sum("bytes").alias("_bytes"))
    mixed = mixed.where("_x <> _y").select("key", F.greatest(F.col("size") / block, F.col("_bytes") / BLOCK_BYTES).alias("full"))
    members = in_blocks(grouped.join(mixed, "key"), "key", "t", F.col("full"), 1)
    members = members.join(texts, "t").select("key", "i", "j", "block", "t", "root", "text")
    members = members.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    more = across_groups(members, idf, n, threshold)
    tree = components(durable(links.unionByName(more)), "a", "b")
    named = (drawn.where("t is not null").groupBy("t").agg(F.min("id").alias("low"))
             .join(tree, F.col("t") == F.col("node"), "left").select("t", "low", F.coalesce("root", "t").alias("root")))
    classes = named.select("t", "root").join(named.groupBy("root").agg(F.min("low").alias("class_id")), "root")
    done = drawn.select("id", "t").join(classes.select("t", "class_id"), "t", "left")
    own = F.coalesce("class_id", "id")
    return done.select(F.when(F.col("id") > SMALLEST, F.col("id")).alias(id_col),
                       F.when(own > SMALLEST, own).alias("class_id"), (own == F.col("id")).alias("kept"),
                       F.col("t").alias("text_key"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows, with all their columns, of one document of each class; rows equal in id and text are one."""
    keep = near_duplicates(docs, id_col, text_col, **options).where("kept")
    keep = keep.select(F.col(id_col).alias("_id"), F.col("text_key").alias("_t")).distinct()
    key = F.when(docs[text_col].isNotNull(), F.xxhash64(docs[text_col]))
    same = docs[id_col].eqNullSafe(F.col("_id")) & F.col("_key").eqNullSafe(F.col("_t"))
    rows = docs.withColumn("_key", key)
    return rows.join(keep, same, "left_semi").dropDuplicates([id_col, "_key"]).drop("_key")


@query("op1_minhash")
def op1_minhash(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(table(spark, sf, "documents"))
