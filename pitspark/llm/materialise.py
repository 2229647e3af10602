"""Operator 3: token ids in training order, written as shards of fixed stride.

Token ids are those of an array column, in ``width`` bytes each (little-endian), or the bytes of a text; an id of
its own ends a document: 255, which no UTF-8 text holds, unless another is given. The documents, in the
order of the input's partitions, are one stream, cut into sequences of equal length. A keyed Feistel network
permutes the sequence numbers (walking on while it leaves the domain), which gives each sequence its
global slot. A shard is a range of slots; one task sorts and writes it as one file of records, each the ids of
a sequence and a line feed, so slot s lies in shard s // per_shard at byte (s % per_shard) * stride. A reader
that stopped goes on from any slot.

As with zipWithIndex, the input is read twice and must give the same rows in the same partitions, as files do;
any other input (such as the ids of an encoder) should be written first. A task that finds other lengths than were
counted fails.

Defined results: a null or empty text or array is one id, the end; repeated rows, null document ids and further
columns change nothing; the last sequence is filled up with ends; an empty table writes nothing and gives an empty
result. A token id that is null, negative, the end itself or too large for the width is an error.
"""
from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from pitspark.llm.registry import query, table
from pitspark.llm.words import SLICE_BYTES, mix, slices
from pitspark.session import folder

END = 255                   # of a document of bytes
SEQUENCE = 2048             # ids of a sequence
PER_SHARD = 16_384          # sequences of a shard: 34 MB
KEY, FEISTEL_ROUNDS = 20_240_607, 6


class Layout(NamedTuple):
    sequences: int
    length: int
    per_shard: int
    key: int
    width: int = 1          # bytes of an id

    @property
    def stride(self) -> int:
        return self.length * self.width + 1

    @property
    def shards(self) -> int:
        return -(-self.sequences // self.per_shard)

    def locate(self, slot: int) -> tuple[int, int]:
        """(shard, byte) where a slot's record starts."""
        return slot // self.per_shard, slot % self.per_shard * self.stride


def _network(x: np.ndarray, half: int, keys: list[int]) -> np.ndarray:
    mask = np.uint64((1 << half) - 1)
    left, right = x >> np.uint64(half), x & mask
    for k in keys:
        left, right = right, left ^ (mix(right + np.uint64(k)) & mask)
    return (right << np.uint64(half)) | left


def _walk(numbers: np.ndarray, size: int, key: int, back: bool) -> np.ndarray:
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    keys = mix(np.arange(1, FEISTEL_ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key)).tolist()
    out = np.asarray(numbers).astype(np.uint64)
    left = np.arange(len(out))
    while len(left):
        out[left] = _network(out[left], half, keys[::-1] if back else keys)
        left = left[out[left] >= np.uint64(size)]
    return out.astype(np.int64)


def slot_of(sequence: np.ndarray, size: int, key: int) -> np.ndarray:
    """Slot of each sequence number below ``size``: a keyed permutation."""
    return _walk(sequence, size, key, back=False)


def sequence_of(slot: np.ndarray, size: int, key: int) -> np.ndarray:
    return _walk(slot, size, key, back=True)


def _count(docs: DataFrame, column: str) -> Column:
    """Ids of a document, its end included."""
    lists = isinstance(docs.schema[column].dataType, T.ArrayType)
    n = F.array_size(docs[column]) if lists else F.octet_length(docs[column])
    return F.coalesce(n, F.lit(0)).cast("long") + 1


def _runs(batches: Iterator[pa.RecordBatch], width: int, end: int) -> Iterator[np.ndarray]:
    """Ids of some documents at a time, the end after each, from a column ``text`` of texts or arrays."""
    kind = np.dtype(f"<u{width}")
    for b in batches:
        column = b.column("text")
        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
            for _, texts in slices(iter([b]), "text"):
                yield np.insert(texts.data.astype(kind, copy=False), texts.at[1:], end)
            continue
        at = np.cumsum(np.append(0, pc.fill_null(pc.list_value_length(column), 0).to_numpy()))
        values = column.flatten()
        if values.null_count:
            raise ValueError("a token id is null")
        ids, low = values.to_numpy(), 0
        if ((ids < 0) | (ids == end) | (ids >> (8 * width) > 0)).any():
            raise ValueError(f"a token id is negative, {end} or over {width} bytes")
        while low < b.num_rows:
            high = max(low + 1, int(np.searchsorted(at, at[low] + SLICE_BYTES, "right")) - 1)
            yield np.insert(ids[at[low]:at[high]].astype(kind), at[low + 1:high + 1] - at[low], end)
            low = high


def _starts(docs: DataFrame, text_col: str) -> tuple[dict[int, int], dict[int, int], int]:
    """First stream place and number of ids of every partition, and the total: one row a partition."""
    rows = docs.select(F.spark_partition_id().alias("p"), _count(docs, text_col).alias("n")).groupBy("p").agg(F.sum("n").alias("n")).collect()
    size = {r["p"]: r["n"] for r in rows}
    starts, at = {}, 0
    for p in sorted(size):
        starts[p], at = at, at + size[p]
    return starts, size, at


def write(docs: DataFrame, path: str, text_col: str = "text", length: int = SEQUENCE, per_shard: int = PER_SHARD,
          key: int = KEY, width: int = 1, end: int = END) -> Layout:
    """Write all shards below ``path``; file part-<shard> is a shard. ``text_col`` holds texts or arrays of ids."""
    if width not in (1, 2, 4) or not END <= end < min(1 << (8 * width), 1 << 31):
        raise ValueError("an id takes 1, 2 or 4 bytes, and the end is an id of that width from 255 on")
    starts, size, total = _starts(docs, text_col)
    layout = Layout(-(-total // length), length, per_shard, key, width)
    if not total:
        return layout

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        me = TaskContext.get().partitionId()
        at = starts.get(me, 0)
        for ids in _runs(batches, width, end):
            cuts = np.arange(at - at % length + length, at + len(ids), length) - at
            first = np.concatenate([[0], cuts])
            ends = np.append(cuts, len(ids)).tolist()
            sequence, inside = np.divmod(first + at, length)
            raw = ids.tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array(slot_of(sequence, layout.sequences, key)), pa.array(inside.astype(np.int32)),
                 pa.array([raw[a * width:b * width] for a, b in zip(first.tolist(), ends)], pa.binary())], ["slot", "at", "ids"])
            at += len(ids)
        if at != starts.get(me, 0) + size.get(me, 0):
            raise ValueError("the input gave other rows than when it was counted; write it to a table first")

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, held = -1, []
        for b in batches:
            out = []
            for s, ids in zip(b.column("slot").to_pylist(), b.column("ids").to_pylist()):
                if s != slot and held:
                    out.append(b"".join(held))
                    held = []
                slot = s
                held.append(ids)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["record"])

    parts = docs.select(docs[text_col].alias("text")).mapInArrow(pieces, "slot long, at int, ids binary")
    shard = F.floor(F.col("slot") / per_shard).cast("int")
    sorted_ = parts.repartitionById(layout.shards, shard).sortWithinPartitions("slot", "at")
    full = F.rpad(F.col("record"), length * width, F.lit(end.to_bytes(width, "little")))
    (sorted_.mapInArrow(records, "record binary").select(full.cast("string").alias("value"))
     .write.option("lineSep", "\n").option("compression", "none").text(path))
    return layout


def read(spark: SparkSession, path: str, layout: Layout, first_slot: int = 0) -> DataFrame:
    """(slot, shard, at, sequence, ids) of the records from ``first_slot`` on, ids as their bytes; shards before it
    are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    number = F.regexp_extract("path", r"part-(\d+)", 1).cast("int")
    files = files.where(number >= first_slot // layout.per_shard).select(number.alias("shard"), "content")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, content in zip(b.column("shard").to_pylist(), b.column("content")):
                raw, step = memoryview(content.as_buffer()), layout.stride
                for low in range(0, len(raw), step * 1024):
                    at = np.arange(low, min(low + step * 1024, len(raw)), step)
                    slot = shard * layout.per_shard + at // step
                    at, slot = at[slot >= first_slot], slot[slot >= first_slot]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(slot), pa.array(np.full(len(at), shard, np.int32)), pa.array(at),
                         pa.array(sequence_of(slot, layout.sequences, layout.key)),
                         pa.array([bytes(raw[a:a + step - 1]) for a in at.tolist()], pa.binary())],
                        ["slot", "shard", "at", "sequence", "ids"])

    return files.mapInArrow(cut, "slot long, shard int, at long, sequence long, ids binary")


def unpacked(records: DataFrame, layout: Layout) -> DataFrame:
    """The records with their ids as arrays of numbers."""
    others = [c for c in records.columns if c != "ids"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low in range(0, b.num_rows, 1024):
                part = b.slice(low, 1024)
                ids = np.frombuffer(b"".join(part.column("ids").to_pylist()), f"<u{layout.width}").astype(np.int32)
                at = pa.array(np.arange(part.num_rows + 1) * layout.length, pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(c) for c in others] + [pa.ListArray.from_arrays(at, ids)],
                                                 [*others, "ids"])

    schema = T.StructType([records.schema[c] for c in others]).add("ids", T.ArrayType(T.IntegerType()))
    return records.select(*others, "ids").mapInArrow(work, schema)


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = SEQUENCE) -> DataFrame:
    """(id, start, n_ids, first_sequence, last_sequence) of every document row in the stream."""
    starts, size, _ = _starts(docs, text_col)
    src = docs.select(docs[id_col].alias("id"), _count(docs, text_col).alias("n"))
    kind = src.schema["id"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        me = TaskContext.get().partitionId()
        at = starts.get(me, 0)
        for b in batches:
            n = b.column("n").to_numpy()
            start = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(start), b.column("n")], ["id", "start", "n_ids"])
        if at != starts.get(me, 0) + size.get(me, 0):
            raise ValueError("the input gave other rows than when it was counted; write it to a table first")

    placed = src.mapInArrow(place, f"id {kind}, start long, n_ids long")
    return placed.select(F.col("id").alias(id_col), "start", "n_ids",
                         F.floor(F.col("start") / length).cast("long").alias("first_sequence"),
                         F.floor((F.col("start") + F.col("n_ids") - 1) / length).cast("long").alias("last_sequence"))


@query("op3_materialise")
def op3_materialise(spark: SparkSession, sf: str) -> DataFrame:
    """One row per sequence as read back from the shards, with the documents it holds ids of."""
    docs = table(spark, sf, "documents")
    path = folder(spark)
    layout = write(docs, path)
    held = (index(docs).select("doc_id", F.explode(F.sequence("first_sequence", "last_sequence")).alias("sequence"))
            .groupBy("sequence").agg(F.array_sort(F.collect_set("doc_id")).alias("doc_ids")))
    if not layout.shards:
        return held.select(F.lit(0).cast("long").alias("slot"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("at"),
                           "sequence", F.lit(0).alias("n_ids"), F.lit("").alias("ids_sha256"), "doc_ids")
    records = read(spark, path, layout)
    return (records.select("slot", "shard", "at", "sequence", F.octet_length("ids").alias("n_ids"),
                           F.sha2("ids", 256).alias("ids_sha256")).join(held, "sequence")
            .select("slot", "shard", "at", "sequence", "n_ids", "ids_sha256", "doc_ids"))
