"""Sums of a fixed number of counters over a table."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLOCKS = 64


def summed(rows: DataFrame, count: Callable[[Iterator[pa.RecordBatch]], np.ndarray], size: int) -> np.ndarray:
    """``count`` turns the batches of a partition into ``size`` whole numbers; their sums over all
    partitions come back. Only counters that are not zero travel, in blocks, which are added up in tasks,
    not on the driver."""
    step = -(-size // BLOCKS)

    def packed(blocks: list[int], at: list[np.ndarray], n: list[np.ndarray]) -> pa.RecordBatch:
        packs = [[x.astype(t).tobytes() for x in c] for c, t in ((at, np.int32), (n, np.int64))]
        return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), *(pa.array(c, pa.binary()) for c in packs)],
                                          ["block", "at", "n"])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.asarray(count(batches))
        some = np.flatnonzero(found)
        ends = np.searchsorted(some, np.arange(BLOCKS + 1) * step)
        for i, (a, b) in enumerate(zip(ends, ends[1:])):
            if a < b:
                yield packed([i], [some[a:b] - i * step], [found[some[a:b]]])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for block, at, n in zip(*(c.to_pylist() for c in b.columns)):
                mine = sums.setdefault(block, np.zeros(step, np.int64))
                mine[np.frombuffer(at, np.int32)] += np.frombuffer(n, np.int64)
        some = {i: np.flatnonzero(x) for i, x in sums.items()}
        yield packed(list(sums), list(some.values()), [sums[i][x] for i, x in some.items()])

    kind = "block int, at binary, n binary"
    out = np.zeros(BLOCKS * step, np.int64)
    for r in rows.mapInArrow(own, kind).repartition(16, "block").mapInArrow(add, kind).collect():
        out[r["block"] * step + np.frombuffer(r["at"], np.int32)] = np.frombuffer(r["n"], np.int64)
    return out[:size]
