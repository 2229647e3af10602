"""Operator 11: hard-negative mining with an inverted multi-index.

Vectors are cut in two halves, each half has a codebook, and a vector lies in the cell of its two nearest code
words. A half's score against a code word is at most (anchor . word) + |anchor| x radius, the radius being the
greatest distance of the word's rows from it, so the sum of two such bounds holds for every row of a cell. For
an anchor the multi-sequence algorithm takes the cells of a block from a heap in the order of these sums and
stops as soon as the greatest bound left cannot change what is wanted: the first positives, or the first
negatives of every window of scores. What it returns is therefore exact, whatever the codebooks are; they
only decide how much is looked at.

Rows are dealt in blocks of neighbouring cells, and a full cell is cut by hash, so a hot cell fills several
blocks; a block is small enough for every task to have two, and large enough to be worth the anchors. Anchors travel to the blocks packed by the hundred; a task holds one block and one pack, and sends on
at most a few rows per anchor and block, of which a window by anchor keeps the first.

The codebooks are fitted on a sample of at most ``SAMPLE`` rows (those with the least hashes); every row is indexed.

Defined results: rows with a null id, label or vector and those with a null or non-finite component take no part;
rows of one id are rows of their own, in the order of their numbers; an empty vector scores 0, and vectors of
different lengths are compared on the components that both have; an anchor without positives, or a positive
without negatives, gives no row; scores must fit 64 bits, else the query fails; an empty table gives an empty
result; further columns are not read.
"""
from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from pitspark.llm.registry import query, table
from pitspark.session import durable

WORDS = 32                  # code words of a half
SAMPLE = 8192               # rows that the codebooks are fitted on, at most
ROUNDS = 10                 # of k-means
SMALL_BLOCK, LARGE_BLOCK = 1024, 65536      # rows of a block: half a task's share between these
PACK = 128                  # anchors that travel together
POSITIVES, NEGATIVES = 5, 5
LOW, HIGH, WHOLE = 80, 100, 100     # a negative's score lies between LOW and HIGH hundredths of the positive's
EXACT = float(1 << 53)      # whole numbers below are exact as doubles


def fit_words(x: np.ndarray, words: int, rounds: int, seed: int) -> np.ndarray:
    """K-means code words of the rows; fewer where there are fewer distinct rows."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    if len(distinct) <= words:
        return distinct
    centres = distinct[rng.choice(len(distinct), words, replace=False)]
    for _ in range(rounds):
        near = nearest(x, centres)
        count = np.bincount(near, minlength=words)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(1) - 2 * x @ centres.T, axis=1)


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number rows with ``q``."""
    if len(x) and np.abs(x).max(initial=0.0) * np.abs(q).max(initial=0.0) * max(1, x.shape[1]) < EXACT:
        return (x @ q).astype(np.int64)
    whole = [int(v) for v in q]
    return np.array([sum(int(a) * b for a, b in zip(row, whole)) for row in x.tolist()], np.int64)


class Block:
    """Rows of a block by cell."""

    def __init__(self, uid: np.ndarray, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, books: list[np.ndarray]) -> None:
        cut = books[0].shape[1]
        halves = [x[:, :cut], x[:, cut:]]
        codes = [nearest(h, b) for h, b in zip(halves, books)]
        order = np.lexsort((codes[1], codes[0]))
        self.uid, self.ids, self.labels, self.x = uid[order], ids[order], labels[order], x[order]
        self.cut, self.words, self.radius, place = cut, [], [], []
        for h, b, c in zip(halves, books, codes):
            used, at = np.unique(c, return_inverse=True)
            far = np.zeros(len(used))
            np.maximum.at(far, at, np.sqrt(((h - b[c]) ** 2).sum(1)))
            self.words.append(b[used])
            self.radius.append(far)
            place.append(at[order])
        cell = place[0] * len(self.words[1]) + place[1]
        heads = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.zeros(0, np.int64)
        ends = np.append(heads[1:], len(cell))
        self.cells = {int(cell[a]): (int(a), int(b)) for a, b in zip(heads, ends)}

    def visit(self, q: np.ndarray) -> Iterator[tuple[float, tuple[int, int] | None]]:
        """(bound of this and all later cells, rows of the cell) in falling order of the bounds."""
        bounds = []
        for part, words, radius in zip((q[:self.cut], q[self.cut:]), self.words, self.radius):
            high = words @ part + np.sqrt((part * part).sum()) * radius
            # rounding must not bring a bound below a score
            high = high + 1e-9 * (np.abs(words) @ np.abs(part) + np.sqrt((part * part).sum()) * radius + 1.0)
            turn = np.argsort(-high, kind="stable")
            bounds.append((high[turn].tolist(), turn.tolist()))
        (one, first), (two, second) = bounds
        if not one or not two:
            return
        heap, width = [(-one[0] - two[0], 0, 0)], len(second)
        while heap:
            bound, i, j = heapq.heappop(heap)
            yield -bound, self.cells.get(first[i] * width + second[j])
            if j + 1 < width:
                heapq.heappush(heap, (-one[i] - two[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(first):
                heapq.heappush(heap, (-one[i + 1] - two[0], i + 1, 0))

    def positives(self, q: np.ndarray, uid: int, label: int, count: int) -> list[tuple[int, int, int]]:
        """First (-score, id, uid) of the other rows of the label."""
        best: list[tuple[int, int, int]] = []
        for bound, rows in self.visit(q):
            if len(best) == count and bound < -best[-1][0]:
                break
            if rows is None:
                continue
            a, b = rows
            some = a + np.flatnonzero((self.labels[a:b] == label) & (self.uid[a:b] != uid))
            best = self._first(best, some, products(self.x[some], q), count)
        return best

    def negatives(self, q: np.ndarray, label: int, tops: list[int], lows: list[int], count: int) -> list[list[tuple]]:
        """First (-score, id, uid) of the rows of other labels with a score in each window [low, top]."""
        best: list[list[tuple]] = [[] for _ in tops]
        for bound, rows in self.visit(q):
            # a window is certified when no cell left reaches its lower end or the last of its rows
            if all(bound < (-b[-1][0] if len(b) == count else low) for b, low in zip(best, lows)):
                break
            if rows is None:
                continue
            a, b = rows
            some = a + np.flatnonzero(self.labels[a:b] != label)
            score = products(self.x[some], q)
            for w, (top, low) in enumerate(zip(tops, lows)):
                inside = (score >= low) & (score <= top)
                best[w] = self._first(best[w], some[inside], score[inside], count)
        return best

    def _first(self, best: list[tuple], some: np.ndarray, score: np.ndarray, count: int) -> list[tuple]:
        if len(some) > count:
            some_, score_ = some, score
            order = np.lexsort((self.uid[some_], self.ids[some_], -score_))[:count]
            some, score = some_[order], score_[order]
        found = [(-int(s), int(self.ids[i]), int(self.uid[i])) for i, s in zip(some.tolist(), score.tolist())]
        return sorted(best + found)[:count]


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, label: Column, scale: float) -> DataFrame:
    """(uid, id, label, x) of the rows that take part; x holds floor(scale * component) as doubles."""
    v = vectors[vector_col].cast("array<double>")
    fine = v.isNotNull() & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    # floor to long would cut off large doubles: large ones are whole already
    whole = F.transform(v, lambda e: F.when(F.abs(scale * e) < 2.0 ** 52, F.floor(scale * e).cast("double")).otherwise(scale * e))
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), label.cast("long").alias("label"),
                          F.when(fine, whole).alias("x")).where("id is not null and label is not null and x is not null")
    return durable(rows.select(F.monotonically_increasing_id().alias("uid"), "id", "label", "x"))


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of an array<double> column, shorter ones filled up with zeros."""
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(size), width))
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def fit_books(rows: DataFrame, width: int, words: int, sample: int, seed: int) -> list[np.ndarray]:
    """The codebooks of both halves, from the rows with the least hashes."""
    picked = rows.orderBy(F.xxhash64("uid", F.lit(seed)), "uid").limit(sample).select("x").toArrow()
    x = matrix(picked.column("x").combine_chunks(), width) if picked.num_rows else np.zeros((1, width))
    return [fit_words(h, words, ROUNDS, seed) for h in (x[:, :width // 2], x[:, width // 2:])]


def in_cells(rows: DataFrame, books: list[np.ndarray], width: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("x"), width)
            cut = books[0].shape[1]
            cell = nearest(x[:, :cut], books[0]) * len(books[1]) + nearest(x[:, cut:], books[1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32())], [*b.schema.names, "cell"])

    return rows.mapInArrow(work, "uid long, id long, label long, x array<double>, cell int")


def in_blocks(cells: DataFrame, size: int | None) -> tuple[DataFrame, int]:
    """Rows with the number of their block: neighbouring cells fill a block, a larger cell is cut by hash.
    The driver sees one row per cell, at most WORDS x WORDS."""
    counts = sorted((r["cell"], r["n"]) for r in cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect())
    if size is None:
        tasks = 2 * int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        size = min(LARGE_BLOCK, max(SMALL_BLOCK, -(-sum(n for _, n in counts) // tasks)))
    first, pieces, block, held = [], [], 0, 0
    for cell, n in counts:
        parts = -(-n // size)
        if held and (parts > 1 or held + n > size):
            block, held = block + 1, 0
        first += [F.lit(cell), F.lit(block)]
        pieces += [F.lit(cell), F.lit(parts)]
        block, held = (block + parts, 0) if parts > 1 else (block, held + n)
    if not counts:
        return cells.withColumn("block", F.lit(0)), 0
    place = F.create_map(*first)[F.col("cell")] + F.pmod(F.xxhash64("uid"), F.create_map(*pieces)[F.col("cell")])
    return cells.withColumn("block", place.cast("int")), block + (held > 0)


def searched(rows: DataFrame, anchors: DataFrame, blocks: int, books: list[np.ndarray], width: int, count: int,
             low: tuple[int, int] | None) -> DataFrame:
    """(anchor, window, score, id, uid): the first rows of every block for every anchor (uid, label, x, tops);
    positives, or with ``low`` (hundredths and whole) negatives below each of ``tops``."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, block = -1, [], None
        for b in batches:
            numbers, packs = b.column("block").to_numpy(), b.column("pack").to_numpy()
            cuts = np.flatnonzero((numbers[1:] != numbers[:-1]) | ((packs[1:] < 0) != (packs[:-1] < 0))) + 1
            for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
                if a == z:
                    continue
                part = b.slice(a, z - a)
                if numbers[a] != number:
                    number, held, block = numbers[a], [], None
                if packs[a] < 0:
                    held.append((*(part.column(c).to_numpy() for c in ("uid", "id", "label")), matrix(part.column("x"), width)))
                    continue
                if block is None and held:
                    block, held = Block(*(np.concatenate(c) for c in zip(*held)), books), []
                for i in range(part.num_rows if block is not None else 0):
                    uid, label, x, tops = part.column("anchors").slice(i, 1).flatten().flatten()
                    yield found(block, uid.to_numpy(), label.to_numpy(), matrix(x, width), tops.to_pylist())

    def found(block: Block, uid: np.ndarray, labels: np.ndarray, x: np.ndarray, tops: list) -> pa.RecordBatch:
        out = []
        for u, l, q, own in zip(uid.tolist(), labels.tolist(), x, tops):
            if low is None:
                windows = [block.positives(q, u, l, count)]
            else:
                windows = block.negatives(q, l, own, [-(-low[0] * t // low[1]) for t in own], count)
            out += [(u, w, -s, i, v) for w, rows_ in enumerate(windows) for s, i, v in rows_]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)],
                                          ["anchor", "window", "score", "id", "uid"])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    many = F.greatest(F.lit(1), F.ceil(F.lit(anchors.count()) / PACK))
    packs = (anchors.groupBy(F.pmod(F.xxhash64("uid"), many).alias("pack"))
             .agg(F.collect_list(F.struct("uid", "label", "x", "tops")).alias("anchors"))
             .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(max(0, blocks - 1))))))
    own = rows.select("block", F.lit(-1).cast("long").alias("pack"), "uid", "id", "label", "x")
    both = own.unionByName(packs.select("block", F.col("pack").cast("long"), "anchors"), allowMissingColumns=True)
    both = both.repartition(parts, "block").sortWithinPartitions("block", "pack")
    return both.mapInArrow(work, "anchor long, window int, score long, id long, uid long")


def first_of(found: DataFrame, keys: list[str], count: int) -> DataFrame:
    own = W.partitionBy(*keys).orderBy(F.desc("score"), "id", "uid")
    return found.withColumn("place", F.row_number().over(own)).where(F.col("place") <= count)


def hard_negatives(vectors: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding",
                   label: Column | None = None, scale: float = 256.0, positives: int = POSITIVES,
                   negatives: int = NEGATIVES, low: tuple[int, int] = (LOW, WHOLE), words: int = WORDS,
                   sample: int = SAMPLE, block: int | None = None, seed: int = 11) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score). ``anchor`` says of the
    whole-number ``id`` which rows are anchors; ``label`` is a whole number."""
    rows = whole_vectors(vectors, id_col, vector_col, vectors["label"] if label is None else label, scale)
    width = max(2, rows.agg(F.max(F.size("x"))).head()[0] or 0)
    books = fit_books(rows, width, words, sample, seed)
    dealt, blocks = in_blocks(in_cells(rows, books, width), block)
    dealt = durable(dealt)
    anchors = dealt.where(anchor).select("uid", "id", "label", "x")
    close = searched(dealt, anchors.withColumn("tops", F.lit(None).cast("array<long>")), blocks, books, width, positives, None)
    close = durable(first_of(close, ["anchor"], positives).select(
        "anchor", (F.col("place") - 1).alias("turn"), "score", F.col("id").alias("positive")))
    windows = close.groupBy("anchor").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "score"))),
                                                      lambda p: p["score"]).alias("tops"))
    asked = durable(anchors.join(windows.withColumnRenamed("anchor", "uid"), "uid"))
    far = searched(dealt, asked, blocks, books, width, negatives, low)
    far = first_of(far, ["anchor", "window"], negatives)
    told = (far.select("anchor", F.col("window").alias("turn"), F.col("place").alias("rank"), F.col("id").alias("negative_id"),
                       F.col("score").alias("negative_score"))
            .join(close.withColumnRenamed("score", "positive_score"), ["anchor", "turn"])
            .join(anchors.select(F.col("uid").alias("anchor"), F.col("id").alias("anchor_id")), "anchor"))
    return told.select("anchor_id", F.col("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"),
                       "negative_id", "positive_score", "negative_score")


_SQL = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda e: floor(256 * e::DOUBLE)::BIGINT) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), scores AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id,
         list_sum(list_transform(range(1, least(len(a.x), len(b.x)) + 1), lambda i: a.x[i] * b.x[i]))::BIGINT AS score
  FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, row_number() OVER own AS rank, n.vec_id AS negative_id, positive_score,
       n.score AS negative_score
FROM positives p JOIN scores n ON n.anchor_id = p.anchor_id AND NOT n.same
  AND 80 * positive_score <= 100 * n.score AND 100 * n.score <= 100 * positive_score
WINDOW own AS (PARTITION BY p.anchor_id, positive_id ORDER BY n.score DESC, n.vec_id)
QUALIFY row_number() OVER own <= 5
"""


@query("op11_hard_negatives", _SQL)
def op11_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings")
    label = F.when(rows["vec_id"] % 7 == 0, (rows["label"] + 1) % 10).otherwise(rows["label"])
    return hard_negatives(rows, F.col("id") % 100 == 0, label=label)
