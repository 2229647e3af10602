"""Operator 5: benchmark decontamination by winnowing.

Of every ``window - k + 1`` consecutive k-word grams the one with the smallest hash (the last of equal ones)
is kept, on both sides, so two texts that share ``window`` words share a kept gram at the same place in
them. Kept grams of the documents that cannot be in the benchmark fall to a bitmap of fixed size; the others
are joined, and each hit is extended word by word, as text, to the run the two sides share around it.
Items of fewer words than a window are looked up whole.

Defined results: a null or empty text has no words, is never hit and, as an item, hits nothing; every
document row has its own result, also with a repeated or null id; repeated item ids count as one item, a
null item id as the empty one; empty tables on either side work; further columns are not read.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from pitspark.llm.registry import query, table
from pitspark.llm.words import BASE, Hasher, Words, mix, slices, words_of
from pitspark.session import durable

WINDOW, GRAM = 10, 5
BITMAP_BITS = 24            # 2 MB, whatever the size of the benchmark

_FOUND = "uid long, h long, n int, pos long, before array<string>, gram string, after array<string>"


def gram_hashes(code: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(max(len(code) - n + 1, 0), np.uint64)
    for i in range(n):
        out = out * BASE + code[i:i + len(out)]
    return mix(out + np.uint64(n))


def kept_grams(words: Words, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of the first word, hash) of the winnowed grams of all texts."""
    hashes = gram_hashes(words.code, k)
    span = window - k + 1
    count = len(words.code) - window + 1
    if count <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    low, at = hashes[:count].copy(), np.arange(count)
    for i in range(1, span):
        other = hashes[i:i + count]
        less = other <= low
        low[less], at[less] = other[less], np.flatnonzero(less) + i
    owner = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    at = np.unique(at[owner[:count] == owner[window - 1:]])
    return at, hashes[at]


def _rows(words: Words, at: np.ndarray, hashes: np.ndarray, n: int, reach: int, uid: list[int]) -> list[tuple]:
    """Rows of the kept grams with the words around them, nearest first."""
    owner = np.searchsorted(words.first, at, "right") - 1
    out = []
    for i, h, t in zip(at.tolist(), hashes.view(np.int64).tolist(), owner.tolist()):
        low, high = max(int(words.first[t]), i - reach), min(int(words.first[t + 1]), i + n + reach)
        said = [words.data[a:b].tobytes().decode() for a, b in zip(words.start[low:high], words.end[low:high])]
        out.append((uid[t], h, n, i - int(words.first[t]), said[:i - low][::-1], " ".join(said[i - low:i - low + n]),
                    said[i - low + n:]))
    return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.string(), pa.list_(pa.string())]
    names = ["uid", "h", "n", "pos", "before", "gram", "after"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


def item_grams(items: DataFrame, window: int, k: int) -> DataFrame:
    """Fingerprints of (uid, text) rows; items of fewer words than the window as one gram."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for part, texts in slices(batches, "text"):
            words, uid = words_of(texts, hasher), part.column("uid").to_pylist()
            rows = _rows(words, *kept_grams(words, window, k), k, window - k, uid)
            size = np.diff(words.first)
            for n in sorted(set(size[(size > 0) & (size < window)].tolist())):
                at = words.first[:-1][size == n]
                rows += _rows(words, at, gram_hashes(words.code, n)[at], n, 0, uid)
            yield _batch(rows)

    return items.mapInArrow(work, _FOUND)


def document_grams(docs: DataFrame, bitmap: np.ndarray, short: list[int], window: int, k: int) -> DataFrame:
    """Fingerprints of (uid, id, text) rows that the bitmap holds, and for every row one with its id,
    n = 0 and the number of words as ``pos``."""
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)
    kind = docs.schema["id"].dataType.simpleString()

    def held(hashes: np.ndarray) -> np.ndarray:
        bit = hashes >> np.uint64(64 - BITMAP_BITS)
        return (sent.value[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for part, texts in slices(batches, "text"):
            words, uid = words_of(texts, hasher), part.column("uid").to_pylist()
            size = np.diff(words.first)
            rows = [(u, 0, 0, n, None, None, None) for u, n in zip(uid, size.tolist())]
            at, hashes = kept_grams(words, window, k)
            some = held(hashes)
            rows += _rows(words, at[some], hashes[some], k, window - k, uid)
            owner = np.repeat(np.arange(len(size)), size)
            for n in short:
                hashes = gram_hashes(words.code, n)
                at = np.flatnonzero(held(hashes))
                at = at[owner[at] == owner[at + n - 1]]
                rows += _rows(words, at, hashes[at], n, 0, uid)
            ids = part.column("id")
            ids = pa.concat_arrays([ids, pa.nulls(len(rows) - len(ids), ids.type)])
            found = _batch(rows)
            yield pa.RecordBatch.from_arrays([*found.columns, ids], [*found.schema.names, "id"])

    return docs.mapInArrow(work, f"{_FOUND}, id {kind}")


def _shared(left: str, right: str) -> str:
    """SQL for the number of leading equal elements of two arrays."""
    same = f"zip_with({left}, {right}, (x, y) -> coalesce(x = y, false))"
    return f"coalesce(nullif(array_position({same}, false), 0) - 1, size({same}))"


def spans(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          item_col: str = "item_id", item_text: str = "text", window: int = WINDOW,
          k: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """(every document row: uid, id, n_words; shared runs: uid, item, start, stop in words)."""
    if not 0 < k <= window:
        raise ValueError("a gram has at least one word and no more than the window")
    bench = items.select(F.coalesce(items[item_col].cast("string"), F.lit("")).alias("item"),
                         items[item_text].alias("text")).withColumn("uid", F.monotonically_increasing_id())
    bench = durable(bench)
    marks = durable(item_grams(bench.select("uid", "text"), window, k)
                    .join(bench.select("uid", "item"), "uid").drop("uid"))
    bit = F.shiftrightunsigned("h", 64 - BITMAP_BITS)
    set_ = (marks.select(F.shiftright(bit, 3).alias("at"), F.pow(F.lit(2), bit % 8).cast("int").alias("b"))
            .groupBy("at").agg(F.bit_or("b").alias("b")).toArrow())         # at most 2^21 rows
    bitmap = np.zeros(1 << (BITMAP_BITS - 3), np.uint8)
    bitmap[set_.column("at").to_numpy()] = set_.column("b").to_numpy()
    short = [r["n"] for r in marks.where(F.col("n") < window).where(F.col("n") != k).select("n").distinct().collect()]
    if k < window and marks.where((F.col("n") == k) & (F.size("before") + F.size("after") == 0)).head(1):
        short.append(k)         # an item of just k words is looked up at every place
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    rows = rows.withColumn("uid", F.monotonically_increasing_id())
    found = durable(document_grams(rows, bitmap, sorted(short), window, k))
    sizes = found.where("n = 0").select("uid", "id", F.col("pos").alias("n_words"))
    told = marks.select("h", "n", "item", F.col("gram").alias("gram_"), F.col("before").alias("before_"),
                        F.col("after").alias("after_"))
    hit = (found.where("n > 0").join(told, ["h", "n"]).where("gram = gram_")
           .withColumn("l", F.expr(_shared("before", "before_"))).withColumn("r", F.expr(_shared("after", "after_")))
           .where((F.col("l") + F.col("n") + F.col("r") >= window)
                  | ((F.size("before_") + F.size("after_") == 0) & (F.col("n") < window)))
           .select("uid", "item", (F.col("pos") - F.col("l")).alias("start"),
                   (F.col("pos") + F.col("n") + F.col("r")).alias("stop")).distinct())
    return sizes, hit


def report(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **names) -> DataFrame:
    """One row per document row: words, words hit, items with a shared run, whether there is any."""
    sizes, hit = spans(docs, items, id_col, **names)
    hit = durable(hit)
    before = W.partitionBy("uid").orderBy("start", "stop").rowsBetween(W.unboundedPreceding, -1)
    places = hit.select("uid", "start", "stop").distinct()
    places = places.withColumn("reached", F.coalesce(F.max("stop").over(before), F.lit(0)))
    words = places.groupBy("uid").agg(
        F.sum(F.greatest(F.lit(0), F.col("stop") - F.greatest("start", "reached"))).alias("n_hit"))
    named = hit.groupBy("uid").agg(F.array_sort(F.collect_set("item")).alias("items"))
    done = sizes.join(words, "uid", "left").join(named, "uid", "left")
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    return done.select(F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
                       F.size(items_).cast("long").alias("n_items"),
                       F.sha2(F.array_join(items_, ",").cast("binary"), 256).alias("items_sha256"),
                       (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **names) -> DataFrame:
    """The rows, with all their columns, that share no window with an item."""
    rows = docs.withColumn("_key", F.xxhash64(docs[id_col], docs[text_col]))
    bad = report(rows, items, "_key", text_col=text_col, **names).where("contaminated").select("_key").distinct()
    return rows.join(bad, "_key", "left_anti").select(docs.columns)


# Fixed value: the pattern of words.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_SQL = f"""
WITH item_words AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i
        FROM item_words WHERE len(w) > 0) q),
doc_words AS (SELECT doc_id, {_WORDS} AS w FROM documents),
doc_windows AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM doc_words, (SELECT DISTINCT n FROM item_windows) k WHERE len(w) >= n) q),
hits AS (SELECT d.doc_id, d.i, d.n, b.item_id FROM doc_windows d JOIN item_windows b ON d.n = b.n AND d.s = b.s),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) q
           GROUP BY doc_id),
named AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(p.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(len(n.items), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(n.items, ','), '')) AS items_sha256, coalesce(p.n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN places p ON d.doc_id = p.doc_id LEFT JOIN named n ON d.doc_id = n.doc_id
"""


@query("op5_decontamination", _SQL)
def op5_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return report(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
