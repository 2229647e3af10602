"""Operator 2: language identification by words first, backing off to characters.

The model holds, for every language, the log frequency of frequent words and of frequent character
n-grams inside words. A known word scores by its own frequencies; an unseen one by its longest n-grams
that the model knows, shorter ones only where no longer one is known. A text's score is the mean over its
words. Training reads a bounded sample of labelled texts; prediction reads whole texts.

Defined results: a null text, or one without a letter, is ``und`` with score 0; a text of which nothing is
known gets the commonest language; a null label or id, repeated rows and further columns change nothing;
empty tables give empty results. Where no labelled text was found to learn from, every text is ``und``.
"""
from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from pitspark.llm.registry import query, table
from pitspark.llm.words import Hasher, Texts, Words, slices, words_of

UNKNOWN = "und"
LONGEST = 4                 # characters of the longest n-gram
SAMPLE_PER_LANGUAGE = 3000  # distinct labelled texts of a language that training reads at most
KEPT_WORDS = 120_000        # words in the model
KEPT_GRAMS = 40_000         # n-grams of each length in the model
SMOOTHING = 0.5
FIRM_WORDS = 20             # words from which on a text counts as long


class Model(NamedTuple):
    languages: list[str]
    prior: np.ndarray                   # log share of each language
    codes: list[np.ndarray]             # sorted hashes: words, then n-grams of 1, 2, ... characters
    scores: list[np.ndarray]            # log frequency of each hash in each language


def held_out(id_col: Column) -> Column:
    """Rows whose crc32 of the id as text leaves 2 modulo 4; false for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def grams(words: Words, sums: np.ndarray, hasher: Hasher, pick: np.ndarray,
          n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position in ``pick``) of every run of n characters inside the picked words; runs at a
    word's start and end are marked."""
    head = (words.data & 0xC0) != 0x80
    chars = np.append(np.flatnonzero(head), len(words.data))
    low = np.searchsorted(chars, words.start[pick])
    size = np.searchsorted(chars, words.end[pick]) - low
    each = np.maximum(size - n + 1, 0)
    owner = np.repeat(np.arange(len(pick)), each)
    place = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    first = np.repeat(low, each) + place
    code = hasher.ranges(sums, chars[first], chars[first + n])
    code ^= (place == 0).astype(np.uint64) << np.uint64(1)
    code ^= (place == np.repeat(each, each) - 1).astype(np.uint64) << np.uint64(2)
    return code, owner


def find(codes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each hash in the sorted ones; -1 where it is missing."""
    if not len(codes):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(codes, wanted), len(codes) - 1)
    return np.where(codes[at] == wanted, at, -1)


def word_scores(model: Model, words: Words, hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """(scores by language, known at all) of every word."""
    out = np.zeros((len(words.code), len(model.languages)), np.float32)
    at = find(model.codes[0], words.code)
    known = at >= 0
    out[known] = model.scores[0][at[known]]
    unseen, first, back = np.unique(words.code[~known], return_index=True, return_inverse=True)
    if len(unseen):
        pick = np.flatnonzero(~known)[first]
        sums = hasher.sums(words.data)
        score = np.zeros((len(pick), out.shape[1]))
        done = np.zeros(len(pick), bool)
        for n in range(LONGEST, 0, -1):
            left = np.flatnonzero(~done)
            code, owner = grams(words, sums, hasher, pick[left], n)
            hit = find(model.codes[n], code)
            owner, hit = owner[hit >= 0], hit[hit >= 0]
            count = np.bincount(owner, minlength=len(left))
            got = count > 0
            for j in range(out.shape[1]):
                total = np.bincount(owner, model.scores[n][hit, j], minlength=len(left))
                score[left[got], j] = total[got] / count[got]
            done[left[got]] = True
        out[~known], known[~known] = score[back], done[back]
    return out, known


def has_letter(texts: Texts) -> np.ndarray:
    data, at = texts
    folded = data | 0x20
    seen = np.concatenate([[0], np.cumsum((folded >= 97) & (folded <= 122))])
    found = seen[at[1:]] > seen[at[:-1]]
    for i in np.flatnonzero(~found):
        found[i] = any(c.isalpha() for c in data[at[i]:at[i + 1]].tobytes().decode("utf-8", "replace"))
    return found


def predict_slice(model: Model, texts: Texts, hasher: Hasher) -> tuple[list[str], np.ndarray]:
    n = len(texts.at) - 1
    if not model.languages:
        return [UNKNOWN] * n, np.zeros(n)
    words = words_of(texts, hasher)
    scores, known = word_scores(model, words, hasher)
    owner = np.repeat(np.arange(n), np.diff(words.first))[known]
    count = np.bincount(owner, minlength=n)
    total = np.stack([np.bincount(owner, scores[known, j], minlength=n) for j in range(scores.shape[1])], 1)
    mean = total / np.maximum(count, 1)[:, None]
    level = mean * np.minimum(count, FIRM_WORDS)[:, None] + model.prior
    chance = np.exp(level - level.max(1, keepdims=True))
    chance /= chance.sum(1, keepdims=True)
    best = level.argmax(1)
    fine = has_letter(texts)
    names = [model.languages[b] if ok else UNKNOWN for b, ok in zip(best, fine)]
    return names, np.where(fine, chance[np.arange(n), best], 0.0)


def draw(src: DataFrame, per_language: int) -> DataFrame:
    """One row for each of the first ``per_language`` distinct texts of each language, by a hash of the text."""
    src = src.withColumn("turn", F.xxhash64("text"))
    kinds = src.select("lang", "turn").distinct()
    sizes = {r["lang"]: r["n"] for r in kinds.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    # a quarter more than wanted, so that the order is made of few rows; the limit is exact behind it
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items()
                           for x in (lang, min(1.0, (1.25 * per_language + 100) / n))])
    near = kinds.where(F.shiftrightunsigned("turn", 32) < share[F.col("lang")] * (1 << 32))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.shiftrightunsigned("turn", 32), "turn"))
    first = near.withColumn("place", place).where(F.col("place") <= per_language).select("lang", "turn")
    # at most per_language rows of two values a language
    return src.join(F.broadcast(first), ["lang", "turn"]).dropDuplicates(["lang", "turn"]).select("text", "lang")


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang",
          per_language: int = SAMPLE_PER_LANGUAGE, kept_words: int = KEPT_WORDS,
          kept_grams: int = KEPT_GRAMS) -> Model:
    """Fit on at most ``per_language`` distinct texts of each language, first by a hash of the text; copies
    count for the share of a language, not for its words. Counting runs on Spark; the driver receives the
    kept entries only."""
    src = docs.select(docs[text_col].alias("text"), docs[lang_col].alias("lang"))
    src = src.where("text is not null and lang is not null and length(text) > 0")
    sizes = {r["lang"]: r["n"] for r in src.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Model([], np.zeros(0), [], [])
    languages = sorted(sizes)
    drawn = draw(src, per_language)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, number = Hasher(), {lang: i for i, lang in enumerate(languages)}
        for part, texts in slices(batches, "text"):
            words = words_of(texts, hasher)
            if not len(words.code):
                continue
            lang = np.array([number[x] for x in part.column("lang").to_pylist()])
            owner = np.repeat(lang, np.diff(words.first))
            order = np.lexsort((words.code, owner))
            code, own = words.code[order], owner[order]
            new = np.append(True, (code[1:] != code[:-1]) | (own[1:] != own[:-1]))
            first = np.flatnonzero(new)
            times = np.diff(np.append(first, len(code)))
            found = [(np.zeros(len(first), np.int64), code[first], own[first], times)]
            sums = hasher.sums(words.data)
            for n in range(1, LONGEST + 1):
                gram, who = grams(words, sums, hasher, order[first], n)
                found.append((np.full(len(gram), n), gram, own[first][who], times[who]))
            size, code, own, times = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((own, code, size))
            size, code, own, times = size[order], code[order], own[order], times[order]
            new = np.append(True, (code[1:] != code[:-1]) | (own[1:] != own[:-1]) | (size[1:] != size[:-1]))
            first = np.flatnonzero(new)
            yield pa.RecordBatch.from_arrays(
                [pa.array(size[first]), pa.array(code[first].view(np.int64)), pa.array(own[first]),
                 pa.array(np.add.reduceat(times, first))], ["size", "code", "lang", "n"])

    counts = drawn.mapInArrow(count, "size long, code long, lang long, n long")
    wide = counts.groupBy("size", "code").agg(
        F.sum("n").alias("n"), *[F.sum(F.when(F.col("lang") == i, F.col("n")).otherwise(0)).alias(f"n{i}")
                                 for i in range(len(languages))])
    codes, scores = [], []
    wide = wide.repartition("size", "code").persist()
    totals = {r["size"]: r for r in wide.groupBy("size").agg(
        *[F.sum(f"n{i}").alias(f"n{i}") for i in range(len(languages))]).collect()}
    for size in range(LONGEST + 1):
        # by the largest share an entry has of a language, so that a small language keeps its words beside large ones
        rate = F.greatest(*[F.col(f"n{i}") / max(1, totals[size][f"n{i}"]) if size in totals else F.lit(0.0)
                            for i in range(len(languages))], F.lit(0.0))
        kept = (wide.where(F.col("size") == size).orderBy(rate.desc(), F.desc("n"), "code")
                .limit(kept_grams if size else kept_words).drop("size", "n").toArrow())
        table_ = np.stack([kept.column(f"n{i}").to_numpy() for i in range(len(languages))], 1).astype(np.float64)
        total = np.array([totals[size][f"n{i}"] for i in range(len(languages))]) if size in totals else 0.0
        logs = np.log(table_ + SMOOTHING) - np.log(total + SMOOTHING * (len(table_) + 1))
        code = kept.column("code").to_numpy().astype(np.int64).view(np.uint64)
        order = np.argsort(code)
        codes.append(code[order])
        scores.append(logs[order].astype(np.float32).reshape(len(code), len(languages)))
    wide.unpersist()
    prior = np.log(np.array([sizes[x] for x in languages]) / sum(sizes.values()))
    return Model(languages, prior, codes, scores)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row. The model has a fixed number of entries, so it is broadcast."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = src.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for part, texts in slices(batches, "text"):
            names, score = predict_slice(sent.value, texts, hasher)
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(names, pa.string()), pa.array(score, pa.float64())],
                ["id", "lang_pred", "score"])

    return src.mapInArrow(work, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def identified(docs: DataFrame, model: Model, least: float, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose language is told with a score of ``least`` or more."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"c{i}" for i in range(len(docs.columns))]     # so that names may clash
    src = docs.toDF(*names)
    text = names[docs.columns.index(text_col)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for part, texts in slices(batches, text):
            found, score = predict_slice(sent.value, texts, hasher)
            yield part.filter(pa.array((np.array(found) != UNKNOWN) & (score >= least)))

    return src.mapInArrow(work, src.schema).toDF(*docs.columns)


@query("op2_language")
def op2_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
