"""Operator 8: toxicity by FTRL-proximal logistic regression.

Features are hashed word unigrams (of words, and of the first characters of longer ones), bigrams and
skip-grams of words one apart, each counted once a text. Those of under five texts are left out, whatever
the size of the sample. Training takes a bounded sample of labelled texts: shards learn side by side with
per-coordinate rates, and what they moved is averaged in tasks after each round, so that no task sees the
whole sample and the driver holds one state. L1 keeps most weights at zero; the rest are broadcast as one
array of fixed size.

Defined results: the bounds on the sample take other shares of the two classes, and the intercept
is set back by the log of the ratio, so that a score does not rise with the size of the table; a null or
empty text has the score of the intercept alone; null labels are not learned
from; several labels of one id all count; rows repeated in the documents are scored each; an empty table
gives an empty result. Where no text is labelled 1 there is nothing to find, and every score is 0.
"""
from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from pitspark.llm.language import held_out
from pitspark.llm.registry import query, table
from pitspark.llm.tally import BLOCKS, summed
from pitspark.llm.words import BASE, Hasher, Texts, mix, slices, words_of
from pitspark.session import durable

BITS = 20                   # 2^BITS weights
MOST_TOXIC, MOST_CLEAN = 6000, 12_000       # labelled texts that training reads at most
SHARDS, ROUNDS = 8, 8
ALPHA, BETA, L1, L2 = 2.0, 1.0, 1.5, 0.1
SEEN = 5                    # texts that a feature must occur in
STEMS = (4, 5)
THRESHOLD = 0.3


def features(texts: Texts, hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """(weight number, text number) of every feature; a feature may occur several times."""
    words = words_of(texts, hasher)
    code, n = words.code, len(texts.at) - 1
    owner = np.repeat(np.arange(n), np.diff(words.first))
    found, whose = [code], [owner]
    for gap in (1, 2):
        same = owner[gap:] == owner[:-gap]
        found.append(mix(code[:-gap][same] * BASE + code[gap:][same] + np.uint64(gap)))
        whose.append(owner[gap:][same])
    sums = hasher.sums(words.data)
    chars = np.append(np.flatnonzero((words.data & 0xC0) != 0x80), len(words.data))
    low = np.searchsorted(chars, words.start)
    for length in STEMS:            # a longer word's first characters stand for its family
        cut = chars[np.minimum(low + length, len(chars) - 1)]
        long = cut < words.end
        found.append(mix(hasher.ranges(sums, words.start[long], cut[long]) + np.uint64(length)))
        whose.append(owner[long])
    return (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(whose)


def distinct(feature: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique((owner << BITS) | feature)
    return key & ((1 << BITS) - 1), key >> BITS


def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    pull = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
    return np.where(np.abs(z) <= L1, 0.0, pull)


def learn(z: np.ndarray, n: np.ndarray, feature: np.ndarray, label: int) -> None:
    """One FTRL-proximal step on one text, in place; the last weight is the intercept."""
    w = weights(z[feature], n[feature])
    chance = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35)))
    slope = chance - label
    grown = n[feature] + slope * slope
    z[feature] += slope - (np.sqrt(grown) - np.sqrt(n[feature])) / ALPHA * w
    n[feature] = grown


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Spark removes the shuffle files of each action as it ends; else those of all rounds would lie on disk."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def train(labelled: DataFrame, text_col: str, label_col: str, shards: int = SHARDS,
          rounds: int = ROUNDS) -> np.ndarray:
    """Weights (the last is the intercept) from a bounded table of labelled texts."""
    spark = labelled.sparkSession
    src = labelled.select(labelled[text_col].alias("text"), labelled[label_col].cast("int").alias("label"))
    src = src.where("label is not null")
    size = 1 << BITS

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        hasher, found = Hasher(), np.zeros(size + 2, np.int64)
        for part, texts in slices(batches, "text"):
            found[:-2] += np.bincount(distinct(*features(texts, hasher))[0], minlength=size)
            found[-2:] += np.bincount(part.column("label").to_numpy() == 1, minlength=2)
        return found

    found = summed(src, count, size + 2)
    if not found[-1]:
        none = np.zeros(size + 1)
        none[-1] = -np.inf
        return none
    kept = np.flatnonzero(found[:-2] >= SEEN)
    place = np.full(size, -1, np.int32)
    place[kept] = np.arange(len(kept))
    place = spark.sparkContext.broadcast(place)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for part, texts in slices(batches, "text"):
            feature, owner = distinct(*features(texts, hasher))
            feature = place.value[feature]
            feature, owner = feature[feature >= 0], owner[feature >= 0]
            ends = np.searchsorted(owner, np.arange(part.num_rows + 1))
            yield pa.RecordBatch.from_arrays(
                [part.column("label"),
                 pa.array([feature[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary())], ["label", "features"])

    examples = src.mapInArrow(encode, "label int, features binary").withColumn("turn", F.xxhash64("features", "label"))
    examples = examples.withColumn("shard", F.pmod("turn", F.lit(shards)).cast("int"))
    with swept(spark):
        examples = durable(examples.repartition(shards, "shard").sortWithinPartitions("shard", "turn"))
    z, n = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)
    kind = "block int, at binary, z binary, n binary"
    cuts = np.arange(1, BLOCKS) * -(-len(z) // BLOCKS)      # first places of the blocks

    def moves(block, at, z, n) -> pa.RecordBatch:
        packs = ([np.asarray(x, t).tobytes() for x in c] for c, t in ((at, np.int32), (z, np.float32), (n, np.float32)))
        return pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), *(pa.array(c, pa.binary()) for c in packs)],
                                          ["block", "at", "z", "n"])

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, ...]]] = {}
        for b in batches:
            for block, *packs in zip(*(c.to_pylist() for c in b.columns)):
                held.setdefault(block, []).append(tuple(map(np.frombuffer, packs, (np.int32, np.float32, np.float32))))
        for block, states in held.items():
            at, of = np.unique(np.concatenate([x[0] for x in states]), return_inverse=True)
            z, n = (np.bincount(of, np.concatenate([x[c] for x in states]), len(at)) / len(states) for c in (1, 2))
            yield moves([block], [at], [z], [n])

    for _ in range(rounds):
        state = spark.sparkContext.broadcast((z, n))

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for b in batches:
                for shard, label, raw in zip(*(b.column(c).to_pylist() for c in ("shard", "label", "features"))):
                    if shard not in own:
                        own[shard] = state.value[0].copy(), state.value[1].copy()
                    learn(*own[shard], np.append(np.frombuffer(raw, np.int32), len(state.value[0]) - 1), label)
            for mine in own.values():
                moved = np.flatnonzero((mine[0] != state.value[0]) | (mine[1] != state.value[1]))
                by = (x[moved] - y[moved] for x, y in zip(mine, state.value))
                packs = [np.split(x, np.searchsorted(moved, cuts)) for x in (moved.astype(np.int32), *by)]
                yield moves(range(BLOCKS), *packs)

        # every state sends every block, so that the rows of a block count the states
        with swept(spark):
            parts = examples.select("shard", "label", "features").mapInArrow(step, kind).repartition(16, "block")
            ends = parts.mapInArrow(mean, kind).collect()
        for r in ends:
            at = np.frombuffer(r["at"], np.int32)
            z[at] += np.frombuffer(r["z"], np.float32)
            n[at] += np.frombuffer(r["n"], np.float32)
        state.destroy()
    model = np.zeros(size + 1)
    model[np.append(kept, size)] = weights(z, n)
    return model


def score(docs: DataFrame, model: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row, over whole texts."""
    used = np.flatnonzero(model)
    sent = docs.sparkSession.sparkContext.broadcast((used, model[used].astype(np.float32)))
    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = src.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        dense = np.zeros((1 << BITS) + 1, np.float32)
        dense[sent.value[0]] = sent.value[1]
        for part, texts in slices(batches, "text"):
            feature, owner = features(texts, hasher)
            some = np.flatnonzero(dense[feature])
            feature, owner = distinct(feature[some], owner[some])
            total = np.bincount(owner, dense[feature], minlength=part.num_rows) + float(dense[-1])
            chance = np.where(np.isfinite(total), 1.0 / (1.0 + np.exp(-np.clip(total, -35, 35))), 0.0)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(chance, pa.float64())], ["id", "score"])

    return src.mapInArrow(work, f"id {kind}, score double").withColumnRenamed("id", id_col)


def sample(labels: DataFrame, id_col: str, label_col: str, most_toxic: int = MOST_TOXIC,
           most_clean: int = MOST_CLEAN) -> DataFrame:
    """At most so many labelled ids of each kind, first by a hash of the id."""
    rows = labels.select(labels[id_col].alias("_id"), labels[label_col].alias("_label"))
    rows = rows.where("_id is not null").withColumn("_turn", F.xxhash64("_id", F.lit(8)))
    pick = [rows.where(F.col("_label") == k).orderBy("_turn", "_id").limit(most)
            for k, most in ((1, most_toxic), (0, most_clean))]
    return pick[0].unionByName(pick[1]).drop("_turn")


def shift(labels: DataFrame, label_col: str, most_toxic: int, most_clean: int, id_col: str = "doc_id") -> float:
    """What ``sample`` with these bounds has to add to the log odds of a model: the log of toxic rows for each one
    drawn over clean rows for each one drawn, 0 where neither bound binds."""
    rows = labels.where(labels[id_col].isNotNull()).groupBy(labels[label_col].alias("label")).count()
    n = {r["label"]: r["count"] for r in rows.where("label in (0, 1)").collect()}
    toxic, clean = (n.get(k, 0) / max(1, min(n.get(k, 0), most)) for k, most in ((1, most_toxic), (0, most_clean)))
    return float(np.log(toxic / clean)) if toxic and clean else 0.0


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
        most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN) -> np.ndarray:
    """Weights from the texts of a bounded sample of labelled ids, for the class shares of all labels."""
    picked = sample(labels, id_col, label_col, most_toxic, most_clean)
    # the picked ids are at most most_toxic + most_clean rows of two numbers
    labelled = docs.select(id_col, text_col).join(F.broadcast(picked), F.col(id_col) == F.col("_id"))
    model = train(labelled, text_col, "_label")
    model[-1] += shift(labels, label_col, most_toxic, most_clean, id_col)
    return model


@query("op8_toxicity")
def op8_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    scored = score(docs, fit(docs, labels.where(~held_out(F.col("doc_id")))))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
