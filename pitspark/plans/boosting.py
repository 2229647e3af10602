"""Gradient-boosted regression trees on blocks of binned rows.

The trees are those of Spark ML's GBT with the same parameters: candidate cuts from a sample of max(10,000, bins^2)
rows, squared or logistic loss, splits by the gain in variance, leaves that hold the weighted mean of the gradient.
What differs is how the sums are taken. A row is one byte a feature and its outcome, rows lie in blocks of some
16,000 as buffers of one written table, and a task adds a block up in a few histograms. All parts (folds or seeds) and all
configurations of a search read the table together, and a pass that begins a round also gives the validation loss of
the rounds before, so that fitting stops where the patience ends and no round is fitted twice. Forecasts are taken
from the trees in the pass itself and written every ``KEPT`` rounds. A part that fits one task is boosted inside one.

Equal gains (but for rounding) go to the first feature and the lowest cut, so trees do not depend on partitions.
"""
from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from pitspark.session import folder

BLOCK = 16_384          # rows of a block, to which a batch is added whole
ONE_TASK = 1 << 18      # rows that are boosted inside one task
KEPT = 8                # rounds between two written forecasts
CELLS = 1024            # of a histogram over several features
MOST_BINS, MOST_DEPTH = 256, 8
ROUGH = 1e-13           # of the mean square, what rounding may add to a gain

_BLOCKS = "part int, is_val boolean, n int, bins binary, label binary, f binary"
_KINDS = [pa.int32(), pa.bool_(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
_NAMES = ["part", "is_val", "n", "bins", "label", "f"]
# buffers are large values, so pages and row groups are measured after every row
_WRITE = {"parquet.page.size.row.check.min": "1", "parquet.block.size.row.check.min": "1",
          "parquet.page.size.row.check.max": "16", "parquet.block.size.row.check.max": "16",
          "parquet.block.size": str(32 << 20), "parquet.enable.dictionary": "false"}


@dataclass(frozen=True)
class Params:
    """Of one configuration."""
    depth: int
    step: float
    min_rows: int
    min_share: float        # of the weight of all rows
    min_gain: float


@dataclass(frozen=True)
class Shape:
    """What all tasks know of a part: bins of every feature that has a cut, those that share a histogram, weights of
    the labels 0 and 1 (none for a squared loss)."""
    bins: tuple[int, ...]
    packs: tuple[tuple[int, ...], ...]
    weights: tuple[float, float] | None


@dataclass(frozen=True)
class Part:
    """Rows that are fitted by themselves: the cuts of every feature, weights of the labels and the numbers of rows."""
    cuts: list[np.ndarray]
    weights: tuple[float, float] | None
    n_train: int
    n_val: int

    @property
    def live(self) -> list[int]:
        return [i for i, c in enumerate(self.cuts) if len(c)]

    @property
    def shape(self) -> Shape:
        bins = tuple(len(self.cuts[i]) + 1 for i in self.live)
        return Shape(bins, packed(bins), self.weights)


@dataclass
class Node:
    """Sums of weights, gradients and their squares and the number of rows, and the split if it has one."""
    w: float
    s: float
    ss: float
    n: int
    gain: float = 0.0
    feature: int = -1
    cut: int = -1

    @property
    def value(self) -> float:
        return self.s / self.w if self.w else 0.0

    @property
    def impurity(self) -> float:
        return (self.ss - self.s * self.s / self.w) / self.w if self.w else 0.0


Tree = dict[int, Node]          # by heap number: children of i are 2 i and 2 i + 1, 1 is the root


# ---- candidate cuts ----

def cuts_of(values: np.ndarray, weights: np.ndarray, expected: float, most: int) -> np.ndarray:
    """Thresholds of a feature from sampled values, as Spark ML takes them: halfway between neighbouring values, all of them
    or at most ``most`` of near-equal weight. ``expected`` is the weight of the sample; zeros stand for what is missing."""
    some = values != 0
    distinct, at = np.unique(values[some], return_inverse=True)
    counts = np.bincount(at, weights=weights[some], minlength=len(distinct)).astype(float)
    if not len(distinct):
        return np.empty(0)
    zeros = expected - counts.sum()
    if zeros > np.finfo(float).eps * some.sum() * 100:
        place = np.searchsorted(distinct, 0.0)
        distinct, counts = np.insert(distinct, place, 0.0), np.insert(counts, place, zeros)
    between = (distinct[:-1] + distinct[1:]) / 2.0
    if len(between) <= most:
        return between
    stride, seen = expected / (most + 1), np.cumsum(counts)
    found, target = [], stride
    for i in range(1, len(distinct)):
        if abs(seen[i - 1] - target) < abs(seen[i] - target):
            found.append(between[i - 1])
            target += stride
    return np.array(found)


def packed(bins: Sequence[int], cells: int = CELLS) -> tuple[tuple[int, ...], ...]:
    """Features that share a histogram, whose cells are the product of their bins; largest first."""
    packs: list[list[int]] = []
    for i in sorted(range(len(bins)), key=lambda i: -bins[i]):
        for p in packs:
            if math.prod(bins[j] for j in p) * bins[i] <= cells:
                p.append(i)
                break
        else:
            packs.append([i])
    return tuple(map(tuple, packs)) or ((),)


# ---- what a task does ----

def binned(cuts: Sequence[dict[str, np.ndarray]], binary: bool) -> Callable:
    """Rows of (part, is_val, label and features) to blocks. ``cuts`` are those of every part by name of the feature."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[tuple[int, bool], list] = {}

        def block(part: int, val: bool) -> pa.RecordBatch:
            own = open_.pop((part, val))
            bins, label = np.concatenate([p[0] for p in own], 1), np.concatenate([p[1] for p in own])
            return one_block(part, val, len(label), bins.tobytes(), label.tobytes(), b"")

        for b in batches:
            held = b.column("is_val").to_numpy(zero_copy_only=False).astype(bool)
            parts = b.column("part").to_numpy()
            label = b.column("label").to_numpy().astype(np.uint8 if binary else np.float64)
            for part in np.unique(parts).tolist():
                for val in (False, True):
                    mine = np.flatnonzero((parts == part) & (held == val))
                    if not len(mine):
                        continue
                    bins = np.empty((len(cuts[part]), len(mine)), np.uint8)
                    for i, (name, c) in enumerate(cuts[part].items()):
                        bins[i] = np.searchsorted(c, b.column(name).to_numpy()[mine])
                    open_.setdefault((part, val), []).append((bins, label[mine]))
                    if sum(len(p[1]) for p in open_[part, val]) >= BLOCK:
                        yield block(part, val)
        for key in sorted(open_):
            yield block(*key)
    return run


def one_block(*values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _KINDS)], _NAMES)


@dataclass
class Block:
    part: int
    is_val: bool
    bins: np.ndarray
    label: np.ndarray
    f: np.ndarray           # a row for each configuration, or none before the first ones are kept


def blocks_of(batch: pa.RecordBatch, shapes: Sequence[Shape]) -> Iterator[Block]:
    for i in range(batch.num_rows):
        part, n = batch.column("part")[i].as_py(), batch.column("n")[i].as_py()
        bins, label, f = (batch.column(c)[i].as_buffer() for c in ("bins", "label", "f"))
        shape = shapes[part]
        yield Block(part, batch.column("is_val")[i].as_py(), np.frombuffer(bins, np.uint8).reshape(len(shape.bins), n),
                    np.frombuffer(label, np.float64 if shape.weights is None else np.uint8),
                    np.frombuffer(f, np.float64).reshape(-1, n))


def placed(bins: np.ndarray, splits: dict[int, tuple[int, int]], slots: dict[int, int], other: int) -> np.ndarray:
    """The slot of the node that each row comes to; ``other`` for nodes without one."""
    n = bins.shape[1]
    masks: dict[int, np.ndarray | None] = {1: None}
    for i in sorted(splits):
        feature, cut = splits[i]
        own, right = masks.pop(i), bins[feature] > cut
        masks[2 * i], masks[2 * i + 1] = (~right, right) if own is None else (own > right, own & right)
    kind = np.uint8 if max([other, *slots.values()]) < 256 else np.uint16
    out = np.zeros(n, kind)
    for i, own in masks.items():
        slot = slots.get(i, other)
        if own is None:
            out += kind(slot)
        elif slot:
            out += own.view(np.uint8) * kind(slot)
    return out


@dataclass
class Ask:
    """What a pass takes for one configuration of a part: forecasts are the kept ones (row ``at`` of a block) and those of ``trees``
    as (splits, slots of leaves, values); sums over the nodes of ``slots``, which ``splits`` lead to."""
    part: int
    at: int
    trees: list[tuple[dict, dict, np.ndarray]]
    splits: dict[int, tuple[int, int]]
    slots: dict[int, int]
    first: bool
    sums: bool
    squares: bool       # in every cell, not only by node
    loss: bool


def forecast(block: Block, ask: Ask) -> np.ndarray:
    f = block.f[ask.at].copy() if len(block.f) else np.zeros(block.bins.shape[1])
    for splits, slots, values in ask.trees:
        f += values.take(placed(block.bins, splits, slots, 0))
    return f


def sizes(ask: Ask, shape: Shape) -> tuple[list[int], int]:
    """Cells of every pack and of the nodes, with one node more for rows that are in none."""
    each = (len(ask.slots) + 1) * (1 if shape.weights is None else 2)
    return [each * math.prod(shape.bins[i] for i in p) for p in shape.packs], each


def sums_of(blocks: Iterator[Block], asks: Sequence[Ask], shapes: Sequence[Shape]) -> list[list[np.ndarray]]:
    """For every ask: [losses, squares by node, then rows, gradients and squares by cell of every pack]."""
    out = []
    for a in asks:
        cells, nodes = sizes(a, shapes[a.part])
        out.append([np.zeros(3), np.zeros(nodes), *[np.zeros(c) for c in cells for _ in range(3 if a.squares else 2)]])
    for block in blocks:
        for ask, got in zip(asks, out):
            if ask.part != block.part:
                continue
            if block.is_val and ask.loss:
                got[0] += losses(block.label, forecast(block, ask), shapes[block.part])
            elif ask.sums and not block.is_val:
                _add(block, ask, shapes[block.part], got)
    return out


def losses(label: np.ndarray, f: np.ndarray, shape: Shape) -> np.ndarray:
    """Sums of the weights, of the weighted loss that stops boosting and of the loss that configurations are compared by."""
    if shape.weights is None:
        e = np.abs(label - f).sum()
        return np.array([len(label), e, e])
    margin = np.where(label, f, -f) * 2.0
    with np.errstate(over="ignore"):
        p = np.clip(1 / (1 + np.exp(-2.0 * f)), 1e-7, 1 - 1e-7)
    w = np.where(label, shape.weights[1], shape.weights[0])
    return np.array([w.sum(), (w * 2.0 * np.logaddexp(0.0, -margin)).sum(), -np.log(np.where(label, p, 1 - p)).sum()])


def _add(block: Block, ask: Ask, shape: Shape, got: list[np.ndarray]) -> None:
    label, binary = block.label, shape.weights is not None
    if ask.first:
        g = np.where(label, 1.0, -1.0) if binary else label
    elif binary:
        y = np.where(label, 1.0, -1.0)
        with np.errstate(over="ignore"):
            g = 4.0 * y / (1.0 + np.exp(2.0 * y * forecast(block, ask)))
    else:
        g = 2.0 * (label - forecast(block, ask))
    squares = g * g
    node = placed(block.bins, ask.splits, ask.slots, len(ask.slots)).astype(np.uint32)
    flag = label.astype(np.uint32) if binary else None

    def cell(features: Sequence[int]) -> np.ndarray:
        code = node
        for i in features:
            code = code * np.uint32(shape.bins[i]) + block.bins[i]
        return (code * np.uint32(2) + flag if binary else code).astype(np.intp)

    got[1] += np.bincount(cell(()), weights=squares, minlength=len(got[1]))
    each = 3 if ask.squares else 2
    for k, pack in enumerate(shape.packs):
        code, at = cell(pack), 2 + each * k
        got[at] += np.bincount(code, minlength=len(got[at]))
        got[at + 1] += np.bincount(code, weights=g, minlength=len(got[at]))
        if ask.squares:
            got[at + 2] += np.bincount(code, weights=squares, minlength=len(got[at]))


# ---- what is done with the sums ----

@dataclass
class Fit:
    """The state of one configuration of a part."""
    part: int
    params: Params
    trees: list[Tree] = field(default_factory=list)
    curve: list[float] = field(default_factory=list)        # losses that stop boosting, by round
    compared: list[float] = field(default_factory=list)     # losses that configurations are compared by
    best: int = 0
    done: bool = False
    growing: Tree = field(default_factory=dict)
    level: int = 0
    kept: int = 0           # trees in the kept forecasts
    weight: float = 0.0     # of all rows

    def state(self) -> tuple:
        """In plain values, as a task has no module to name a class of."""
        trees = [{i: (n.w, n.s, n.ss, n.n, n.gain, n.feature, n.cut) for i, n in t.items()} for t in self.trees]
        return trees, self.curve, self.compared, self.best

    @classmethod
    def of(cls, part: int, params: Params, state: tuple) -> Fit:
        trees, curve, compared, best = state
        return cls(part, params, [{i: Node(*n) for i, n in t.items()} for t in trees], curve, compared, best, True)

    def scored(self, since: int) -> list[tuple[dict, dict, np.ndarray]]:
        out = []
        for i, tree in enumerate(self.trees[since:], since):
            leaves = [j for j, node in tree.items() if node.feature < 0]
            step = self.params.step if i else 1.0
            out.append(({j: (node.feature, node.cut) for j, node in tree.items() if node.feature >= 0},
                        {j: k for k, j in enumerate(leaves)}, np.array([step * tree[j].value for j in leaves])))
        return out

    def open_nodes(self) -> list[int]:
        return [1] if not self.level else [2 * i + k for i, node in sorted(self.growing.items()) for k in (0, 1)
                                           if node.feature >= 0 and i >= 1 << (self.level - 1)]

    def ask(self, at: int, rounds: int) -> Ask:
        splits = {i: (node.feature, node.cut) for i, node in self.growing.items() if node.feature >= 0}
        slots = {i: k for k, i in enumerate(self.open_nodes())}
        return Ask(self.part, at, self.scored(self.kept), splits, slots, not self.trees, len(self.trees) < rounds,
                   self.level + 1 == self.params.depth, bool(self.trees) and not self.level)

    def take(self, got: list[np.ndarray], ask: Ask, shape: Shape, rounds: int, n_val: int, stop: Callable) -> None:
        if ask.loss:
            self.curve.append(got[0][1] / got[0][0])
            self.compared.append(got[0][2] / n_val)
            self.best, self.done = stop(self.curve)
            self.done = self.done or len(self.trees) >= rounds
            if self.done:
                return
        nodes = node_sums(got, ask, shape)
        if not self.trees and not self.level:
            self.weight = float(nodes["total"]["w"][0])
        least = self.params.min_share * self.weight
        for i, slot in ask.slots.items():
            node, children = split(slot, nodes, self.params, least)
            self.growing[i] = node
            if children and self.level + 1 == self.params.depth:
                self.growing[2 * i], self.growing[2 * i + 1] = children
        self.level += 1
        if self.level >= self.params.depth or not self.open_nodes():
            self.trees.append(self.growing)
            self.growing, self.level = {}, 0


def node_sums(got: list[np.ndarray], ask: Ask, shape: Shape) -> dict:
    """Rows, weights, gradients and squares: by node, and by (node, bin) for every feature."""
    w = np.ones(1) if shape.weights is None else np.array(shape.weights)
    each, features = (3 if ask.squares else 2), {}
    total = {}
    for k, pack in enumerate(shape.packs):
        sides = [got[2 + each * k + j].reshape(-1, *[shape.bins[i] for i in pack], len(w)) for j in range(each)]
        parts = {"n": sides[0].sum(-1), "w": sides[0] @ w, "s": sides[1] @ w, **({"ss": sides[2] @ w} if ask.squares else {})}
        if not k:
            total = {c: v.sum(tuple(range(1, v.ndim))) for c, v in parts.items()}
        for j, i in enumerate(pack, 1):
            features[i] = {c: v.sum(tuple(a for a in range(1, v.ndim) if a != j)) for c, v in parts.items()}
    total["ss"] = got[1].reshape(-1, len(w)) @ w
    return {"total": total, "features": features}


def split(slot: int, nodes: dict, params: Params, min_weight: float) -> tuple[Node, tuple[Node, Node] | None]:
    """The node with its best split and, where squares are known by cell, the nodes on both sides of it."""
    total = {c: v[slot] for c, v in nodes["total"].items()}
    node = Node(float(total["w"]), float(total["s"]), float(total["ss"]), int(total["n"]))
    best, rough, gains = 0.0, ROUGH * node.ss / node.w if node.w else 0.0, {}
    for i in sorted(nodes["features"]):
        left = {c: np.cumsum(v[slot])[:-1] for c, v in nodes["features"][i].items()}
        whole = {c: v[slot].sum() for c, v in nodes["features"][i].items()}
        right = {c: whole[c] - left[c] for c in left}
        fits = ((left["n"] >= params.min_rows) & (right["n"] >= params.min_rows) & (left["w"] > 0) & (right["w"] > 0)
                & (left["w"] >= min_weight) & (right["w"] >= min_weight))
        with np.errstate(divide="ignore", invalid="ignore"):
            # the gain in variance, in which the squares cancel
            apart = left["s"] / left["w"] - right["s"] / right["w"]
            gain = left["w"] * right["w"] / (whole["w"] * whole["w"]) * apart * apart
        gain = np.where(fits, gain, -1.0)
        gains[i] = (np.where(gain >= params.min_gain, gain, -1.0), left, right)
        best = max(best, gains[i][0].max(initial=-1.0))
    if best <= rough:
        return node, None
    for i, (gain, left, right) in gains.items():
        near = np.flatnonzero(gain >= best * (1 - 1e-9) - rough)
        if len(near):
            k = int(near[0])
            node.gain, node.feature, node.cut = float(gain[k]), i, k
            if "ss" not in left:
                return node, ()
            return node, tuple(Node(float(h["w"][k]), float(h["s"][k]), float(h["ss"][k]), int(h["n"][k])) for h in (left, right))
    return node, None


def boosted(fits: list[Fit], table: Here | Written, parts: Sequence[Part], rounds: int, stop: Callable, every: int) -> None:
    """Grow all configurations of all parts until each has stopped. ``table`` has ``sums`` and ``keep``."""
    shapes, going, at = [p.shape for p in parts], [f for f in fits if not f.done], {}

    def placing() -> None:
        """Forecasts of a part are kept in the order of its configurations that go on."""
        for k in range(len(parts)):
            at.update({id(f): i for i, f in enumerate(f for f in going if f.part == k)})

    placing()
    while going:
        asks = [f.ask(at[id(f)], rounds) for f in going]
        for f, ask, got in zip(going, asks, table.sums(asks)):
            f.take(got, ask, shapes[f.part], rounds, parts[f.part].n_val, stop)
        going = [f for f in going if not f.done]
        if going and max(len(f.trees) - f.kept for f in going) >= every:
            table.keep([Ask(f.part, at[id(f)], f.scored(f.kept), {}, {}, False, False, False, False) for f in going])
            placing()
            for f in going:
                f.kept = len(f.trees)


# ---- where the blocks are ----

def kept(block: Block, asks: Sequence[Ask]) -> np.ndarray:
    return np.stack([forecast(block, a) for a in asks if a.part == block.part])


class Here:
    """Blocks in the memory of one task."""
    def __init__(self, blocks: list[Block], shapes: Sequence[Shape]):
        self.blocks, self.shapes = blocks, shapes

    def sums(self, asks: Sequence[Ask]) -> list[list[np.ndarray]]:
        return sums_of(iter(self.blocks), asks, self.shapes)

    def keep(self, asks: Sequence[Ask]) -> None:
        for b in self.blocks:
            b.f = kept(b, asks)


class Written:
    """Blocks of a written table, a pass over which is one job. They stay in memory as far as they fit."""
    def __init__(self, table: DataFrame, shapes: Sequence[Shape]):
        self.table, self.shapes, self.path = table.persist(StorageLevel.MEMORY_AND_DISK), shapes, None

    def sums(self, asks: Sequence[Ask]) -> list[list[np.ndarray]]:
        shapes = self.shapes

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = sums_of((b for batch in batches for b in blocks_of(batch, shapes)), asks, shapes)
            flat = np.concatenate([a for part in got for a in part])
            yield pa.RecordBatch.from_arrays([pa.array([flat.tobytes()], pa.binary())], ["sums"])

        parts = [np.frombuffer(r["sums"], np.float64) for r in self.table.mapInArrow(run, "sums binary").collect()]
        flat, out, at = sum(parts[1:], parts[0]), [], 0
        for a in asks:
            cells, nodes = sizes(a, shapes[a.part])
            own = []
            for size in [3, nodes, *[c for c in cells for _ in range(3 if a.squares else 2)]]:
                own.append(flat[at:at + size])
                at += size
            out.append(own)
        return out

    def keep(self, asks: Sequence[Ask]) -> None:
        shapes, going = self.shapes, sorted({a.part for a in asks})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, b in enumerate(blocks_of(batch, shapes)):
                    same = [batch.column(c)[i].as_py() for c in _NAMES[:-1]]
                    yield one_block(*same, kept(b, asks).tobytes())

        old, before = self.table, self.path
        table, self.path = written(old.where(F.col("part").isin(going)).mapInArrow(run, _BLOCKS))
        self.table = table.persist(StorageLevel.MEMORY_AND_DISK)
        old.unpersist()
        if before:          # read by nobody else
            sc = self.table.sparkSession.sparkContext
            path = sc._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)

    def close(self) -> None:
        self.table.unpersist()


def written(blocks: DataFrame) -> tuple[DataFrame, str]:
    path = folder(blocks.sparkSession)
    blocks.write.options(**_WRITE).parquet(path)
    return blocks.sparkSession.read.schema(_BLOCKS).parquet(path), path


def boost(rows: DataFrame, names: Sequence[str], parts: Sequence[Part], params: Sequence[Params], rounds: int,
          stop: Callable[[Sequence[float]], tuple[int, bool]], side_by_side: Callable) -> list[list[Fit]]:
    """Boost every configuration on every part of ``rows`` of (part, is_val, label, names). ``stop`` is asked after every
    round for the best one so far and whether that is the end."""
    shapes = [p.shape for p in parts]
    run = binned([{names[i]: p.cuts[i] for i in p.live} for p in parts], parts[0].weights is not None)
    sizes_ = [p.n_train + p.n_val for p in parts]
    few = math.ceil(sum(sizes_) / ONE_TASK)
    rows = rows.select("part", "is_val", "label", *names)
    table, _ = written((rows.coalesce(few) if few < rows.sparkSession.sparkContext.defaultParallelism else rows)
                       .mapInArrow(run, _BLOCKS))

    def alone(k: int) -> list[Fit]:
        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fits = [Fit(k, p) for p in params]
            boosted(fits, Here([b for batch in batches for b in blocks_of(batch, shapes)], shapes), parts, rounds, stop, 1)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps([f.state() for f in fits])], pa.binary())], ["fits"])

        states = pickle.loads(table.where(F.col("part") == k).coalesce(1).mapInArrow(whole, "fits binary").first()["fits"])
        return [Fit.of(k, p, state) for p, state in zip(params, states)]

    def together(large: list[int]) -> list[Fit]:
        fits = [Fit(k, p) for k in large for p in params]
        blocks = Written(table.where(F.col("part").isin(large)), shapes)
        try:
            boosted(fits, blocks, parts, rounds, stop, KEPT)
        finally:
            blocks.close()
        return fits

    large = [k for k, n in enumerate(sizes_) if n > ONE_TASK]
    jobs = [partial(alone, k) for k in range(len(parts)) if k not in large]
    every = side_by_side([*[partial(together, large)] * bool(large), *jobs], table.sparkSession)
    out: list[list[Fit]] = [[] for _ in parts]
    for f in (f for some in every for f in some):
        out[f.part].append(f)
        for node in (n for tree in f.trees for n in tree.values() if n.feature >= 0):
            node.feature = parts[f.part].live[node.feature]
    return out
