"""Whole runs of equal keys from the batches of a partition that is sorted by them."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray, list[int]]]:
    """(rows, key columns, borders of the runs): every run of equal ``keys`` comes in one piece."""
    held: list[pa.RecordBatch] = []

    def cut(rows: pa.Table) -> tuple[pa.Table, np.ndarray, list[int]]:
        key = np.stack([rows.column(c).to_numpy() for c in keys])
        return rows, key, [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), rows.num_rows]

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows, _, borders = cut(pa.Table.from_batches(held))
        whole = borders[-2]                     # the last run may go on
        if whole:
            yield cut(rows.slice(0, whole))
        held = rows.slice(whole).combine_chunks().to_batches()
    if held:
        yield cut(pa.Table.from_batches(held))


def in_blocks(members: DataFrame, key: str, node: str, size: Column, block: int) -> DataFrame:
    """Members of a key dealt out for comparison: the key is cut in blocks of about ``block`` members by a
    hash, and each member goes to the runs (key, i, j) of its block with every other, its own included."""
    cut = (members.withColumn("_blocks", F.ceil(size / block).cast("int"))
           .withColumn("block", F.pmod(F.xxhash64(node, key), F.col("_blocks")).cast("int"))
           .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))))
    return (cut.withColumn("i", F.least("block", "_other")).withColumn("j", F.greatest("block", "_other"))
            .drop("_blocks", "_other"))


def sides(key: np.ndarray, at: int, block: np.ndarray) -> np.ndarray:
    """Of a run (key, i, j): 0 where i = j, else -1 for members of block i and 1 for those of j. Members
    are compared with each other within 0 and across -1 and 1."""
    return np.zeros(len(block), int) if key[1, at] == key[2, at] else np.where(block == key[1, at], -1, 1)
