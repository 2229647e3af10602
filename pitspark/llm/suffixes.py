"""Operator 9: removal of repeated byte strings by a distributed suffix sort.

Every byte that lies in a string of ``length`` bytes which also starts earlier in the corpus goes. Earlier is
(document id, place); documents of one id stand in the order of a hash of their text.

Suffixes are sampled where equal strings agree: each window of ``length`` bytes is stood for by its anchor, the
``gram``-byte string with the smallest hash in it (the first of equal ones), so two equal windows have the
same anchor at the same place. Anchors whose hash occurs once in the corpus cannot repeat and are left out.
The suffixes that start at the others are sorted in the map tasks and exchanged by ranges as front-coded
runs (length of the prefix shared with the one before, and the rest). A task merges the runs of a range by
a loser tree that carries common prefix lengths and never compares a known prefix again; the merged order and
its prefix lengths say, together with the bytes before the anchors, which windows are equal. Suffixes of a run
that agree in all bytes that matter are exchanged once.

A range is cut at the first ``gram`` bytes, so an anchor that stands in very many places would fill one. Anchors
with over ``HOT`` occurrences (a hundred thousand such anchors at most) therefore take a way of their own: each of
their windows is a row with its hash of 128 bits, of which a task hands on the first of equal ones only, and
equal ones of all tasks meet in sorted order.

Defined results: a null or empty text and one shorter than ``length`` lose nothing; a null id comes before
all others; rows equal in id and text are one document, and each of them gets its result; an empty table
gives an empty result; further columns are not read.
"""
from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from pitspark.llm.registry import query, table
from pitspark.llm.words import Hasher, Texts, slices, texts_of
from pitspark.session import durable

LENGTH, GRAM = 100, 32
CHUNK = 1 << 17             # bytes looked at in one numpy step; less than 2^24
HELD_ANCHORS = 1 << 18      # anchors that a task holds before it sends them on
HELD_SUFFIXES = 1 << 15     # suffixes in a sorted run
SAMPLE = 20_000             # anchors whose bytes set the range limits
RANGES_PER_PART = 4
HOT, MOST_HOT = 1 << 16, 1 << 17        # occurrences of an anchor that is not sorted; number of such anchors


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[:len(x) - (width - size)], x[width - size:]) if width > size else x


def anchors(texts: Texts, hasher: Hasher, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(anchor place, first and last window start it stands for, hash) of all windows inside the texts."""
    data, at = texts
    found = []
    bits = np.uint64(24)
    for low in range(0, max(len(data) - length + 1, 0), CHUNK):
        part = data[low:low + CHUNK + length - 1]
        sums = hasher.sums(part)
        hashes = hasher.grams(sums, gram)
        keyed = ((hashes >> bits) << bits) | np.arange(len(hashes), dtype=np.uint64)
        least = sliding_min(keyed, length - gram + 1)
        anchor = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
        start = np.arange(len(anchor))
        fits = np.zeros(len(anchor), bool)
        edges = np.clip(at - low, 0, len(part))
        for i in np.flatnonzero(np.diff(edges) >= 1):       # windows that end inside their text
            fits[edges[i]:max(edges[i], min(len(anchor), at[i + 1] - low - length + 1))] = True
        start, anchor = start[fits], anchor[fits]
        if not len(start):
            continue
        cut = np.append(True, (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1))
        heads = np.flatnonzero(cut)
        tails = np.append(heads[1:], len(start)) - 1
        found.append((anchor[heads] + low, start[heads] + low, start[tails] + low, hashes[anchor[heads]]))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found))


def _prepared(docs: DataFrame, id_col: str, text_col: str, carried: list[str]) -> DataFrame:
    src = docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(-(1 << 63))).alias("id"),
                      F.coalesce(docs[text_col], F.lit("")).alias("text"), docs[text_col].isNull().alias("void"),
                      *[docs[c].alias(f"c{i}") for i, c in enumerate(carried)])
    return src.withColumn("k", F.xxhash64("id", "text"))


def repeated_anchors(rows: DataFrame, length: int, gram: int, buckets: int, hot: int = HOT) -> DataFrame:
    """Packed (keys, places) of anchors whose hash occurs more than once, by group g of keys, (sample,
    turn) rows with some anchors' bytes, and packed (hashes, counts) of those with ``hot`` occurrences or more
    beside the number ``n`` of all. Hashes travel packed, a hash that repeats in a task once."""
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, size = Hasher(), [], 0

        def flush() -> pa.RecordBatch:
            hashes, keys, places = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(hashes, kind="stable")
            hashes, keys, places = hashes[order], keys[order], places[order]
            new = np.append(True, hashes[1:] != hashes[:-1])
            again = ~new | ~np.append(new[1:], True)
            out = [(-1 - g, None, k, p, None, None, None) for g, k, p in _by_group(keys[again], places[again], buckets)]
            times = np.diff(np.append(np.flatnonzero(new), len(new))).astype(np.int32)
            hashes, keys, places = hashes[new], keys[new], places[new]
            bucket = (hashes >> np.uint64(40)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            ends = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
            for i, (a, b) in enumerate(zip(ends, ends[1:])):
                if a < b:
                    o = np.sort(order[a:b])
                    o = o[np.argsort(keys[o], kind="stable")]
                    out.append((i, hashes[o].tobytes(), keys[o].tobytes(), places[o].tobytes(), None, None, times[o].tobytes()))
            out += samples
            samples.clear()
            held.clear()
            kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)],
                                              ["bucket", "hashes", "keys", "places", "sample", "turn", "times"])

        samples: list[tuple] = []
        for part, texts in slices(batches, "text"):
            key = part.column("k").to_numpy()
            place, _, _, hashes = anchors(texts, hasher, length, gram)
            if not len(place):
                continue
            new = np.append(True, place[1:] != place[:-1])      # an anchor at a chunk's edge comes twice
            place, hashes = place[new], hashes[new]
            owner = np.searchsorted(texts.at, place, "right") - 1
            held.append((hashes, key[owner], (place - texts.at[owner]).astype(np.int64)))
            for i in np.flatnonzero(hashes % np.uint64(997) == 0):
                samples.append((-1, None, None, None, texts.data[place[i]:place[i] + gram].tobytes(),
                                int(hashes[i] >> np.uint64(1)), None))
            size += len(place)
            if size >= HELD_ANCHORS:
                yield flush()
                size = 0
        if held:
            yield flush()

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        for b in batches:
            out = []
            for bucket, hashes, keys, places, sample, turn, times in zip(*(c.to_pylist() for c in b.columns)):
                if bucket < 0:
                    out.append((-1 - bucket, keys, places, sample, turn, None, None, None))
                else:
                    kinds = ((hashes, np.uint64), (keys, np.int64), (places, np.int64), (times, np.int32))
                    held.setdefault(bucket, []).append(tuple(np.frombuffer(*x) for x in kinds))
            yield found(out)
        for packs in held.values():
            hashes, keys, places, times = (np.concatenate(x) for x in zip(*packs))
            order = np.argsort(hashes, kind="stable")
            hashes = hashes[order]
            new = np.append(True, hashes[1:] != hashes[:-1])
            again = order[~new | ~np.append(new[1:], True)]
            heads = np.flatnonzero(new)
            many = np.add.reduceat(times[order].astype(np.int64), heads)
            full = many >= hot
            yield found([(*pack, None, None, None, None, None) for pack in _by_group(keys[again], places[again], buckets)]
                        + [(None, None, None, None, None, hashes[heads[full]].tobytes(), many[full].tobytes(), int(many.sum()))])

    def found(rows_: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows_], t) for i, t in enumerate(kinds)],
                                          ["g", "keys", "places", "sample", "turn", "hot", "many", "n"])

    packed = rows.select("k", "text").mapInArrow(
        gather, "bucket int, hashes binary, keys binary, places binary, sample binary, turn long, times binary")
    spread = F.when(F.col("bucket") >= 0, F.col("bucket")).otherwise(F.pmod(F.xxhash64("keys", "turn"), F.lit(buckets)))
    return packed.repartition(buckets, spread).mapInArrow(
        match, "g int, keys binary, places binary, sample binary, turn long, hot binary, many binary, n long")


def hot_anchors(found: DataFrame, hot: int) -> np.ndarray:
    """Sorted hashes with ``hot`` occurrences or more, or as many more as leave at most ``MOST_HOT`` of them."""
    total = found.agg(F.sum("n")).head()[0] or 0
    least = max(hot, -(-total // MOST_HOT))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for hashes, many in zip(b.column("hot").to_pylist(), b.column("many").to_pylist()):
                full = np.frombuffer(hashes, np.uint64)[np.frombuffer(many, np.int64) >= least]
                yield pa.RecordBatch.from_arrays([pa.array(full.view(np.int64))], ["hash"])

    got = found.where("n is not null").select("hot", "many").mapInArrow(pick, "hash long").collect()
    return np.sort(np.array([r["hash"] for r in got], np.int64).view(np.uint64))


def _by_group(keys: np.ndarray, places: np.ndarray, groups: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(group, keys, places) packed by group of keys, sorted by key."""
    group = (keys.view(np.uint64) >> np.uint64(20)) % np.uint64(groups)
    order = np.lexsort((places, keys, group))
    ends = np.searchsorted(group[order], np.arange(groups + 1, dtype=np.uint64))
    for g, (a, b) in enumerate(zip(ends.tolist(), ends[1:].tolist())):
        if a < b:
            yield g, keys[order[a:b]].tobytes(), places[order[a:b]].tobytes()


def places_by_key(found: DataFrame, groups: int) -> DataFrame:
    """(k, places): one row per key with all its packed places."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs = [(np.frombuffer(k, np.int64), np.frombuffer(p, np.int64)) for b in batches
                 for k, p in zip(b.column("keys").to_pylist(), b.column("places").to_pylist())]
        if not packs:
            return
        keys, places = (np.concatenate(x) for x in zip(*packs))
        order = np.argsort(keys, kind="stable")
        keys, places = keys[order], places[order]
        heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        ends = np.append(heads[1:], len(keys))
        for i in range(0, len(heads), 4096):
            some = [places[a:b].tobytes() for a, b in zip(heads[i:i + 4096], ends[i:i + 4096])]
            yield pa.RecordBatch.from_arrays([pa.array(keys[heads[i:i + 4096]]), pa.array(some, pa.binary())],
                                             ["k", "places"])

    return (found.where("keys is not null").select("g", "keys", "places").repartition(groups, "g")
            .mapInArrow(work, "k long, places binary"))


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the shared prefix of two strings that share ``known`` bytes."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (differ.bit_length() + 7) // 8


def front_code(strings: list[bytes]) -> tuple[bytes, bytes, bytes]:
    """Shared prefix lengths, lengths of the rests, and the rests of sorted strings of up to 255 bytes."""
    shared, before = bytearray(), b""
    rests = []
    for s in strings:
        c = common_prefix(before, s, 0) if s != before else len(s)
        shared.append(c)
        rests.append(s[c:])
        before = s
    return bytes(shared), bytes(map(len, rests)), b"".join(rests)


def front_decode(shared: bytes, sizes: bytes, rests: bytes) -> list[bytes]:
    out, before, at = [], b"", 0
    for c, n in zip(shared, sizes):
        before = before[:c] + rests[at:at + n]
        at += n
        out.append(before)
    return out


def merge_runs(runs: list[tuple[list[bytes], bytes]]) -> tuple[list[tuple[int, int]], list[int]]:
    """Merge sorted runs (strings, shared prefix lengths) by a loser tree.

    ``depth[r]`` is the length of the prefix that the head of run r shares with the string it was last
    compared against, which at the time of a match is the string put out last. Of two heads the one that
    shares more with it is smaller; only equal depths are compared, behind the known prefix. Returns (run,
    place) in order and the shared prefix length of each with the one before.
    """
    count = len(runs)
    leaves = 1 << max(0, (count - 1).bit_length())
    head = [0] * leaves
    depth = [0 if i < count and runs[i][0] else -1 for i in range(leaves)]      # -1: no head left
    strings = [r[0] for r in runs] + [[]] * (leaves - count)
    lost = [-1] * leaves
    order: list[tuple[int, int]] = []
    shared: list[int] = []

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser)."""
        if depth[a] != depth[b]:
            return (a, b) if depth[a] > depth[b] else (b, a)
        if depth[a] < 0:
            return a, b
        x, y = strings[a][head[a]], strings[b][head[b]]
        c = common_prefix(x, y, depth[a])
        if x[c:c + 1] <= y[c:c + 1]:
            depth[b] = c
            return a, b
        depth[a] = c
        return b, a

    winners = list(range(leaves))
    level = leaves
    while level > 1:
        level //= 2
        nexts = []
        for i in range(level):
            w, x = play(winners[2 * i], winners[2 * i + 1])
            lost[level + i] = x
            nexts.append(w)
        winners = nexts
    top = winners[0] if winners else 0
    while depth[top] >= 0:
        place = head[top]
        order.append((top, place))
        shared.append(depth[top])
        place += 1
        head[top] = place
        depth[top] = runs[top][1][place] if place < len(strings[top]) else -1
        node = (top + leaves) >> 1
        while node:
            other = lost[node]
            if depth[other] > depth[top]:
                lost[node], top = top, other
            elif depth[other] == depth[top] and depth[top] >= 0:
                top, lost[node] = play(top, other)
            node >>= 1
    return order, shared


_RUN = ("range int, shared binary, sizes binary, rests binary, befores binary, facts binary, "
        "window binary, id long, k long, start long")
_RUN_KINDS = [pa.int32()] + [pa.binary()] * 6 + [pa.int64()] * 3
_RUN_NAMES = [c.split()[0] for c in _RUN.split(", ")]
KNOWN, WINDOW = -1, -2      # instead of a range: spans known to repeat, and windows of hot anchors
FACTS = np.dtype([("id", "<i8"), ("k", "<i8"), ("place", "<i8"), ("low", "u1"), ("high", "u1")])


def sorted_runs(rows: DataFrame, limits: list[bytes], length: int, gram: int, hot: np.ndarray) -> DataFrame:
    """Front-coded runs of the suffixes at repeated anchors of (id, k, text, places) rows, by range, spans
    (KNOWN, facts) that are known to repeat already, and the windows (WINDOW, window, id, k, start) of anchors
    with a ``hot`` hash."""
    rare = rows.sparkSession.sparkContext.broadcast(hot)        # at most MOST_HOT numbers

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        held: list[tuple[bytes, bytes, tuple]] = []     # suffix, bytes before the anchor, facts
        windows: list[tuple[bytes, int, int, int]] = []         # hash, id, k, start

        def batch(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(_RUN_KINDS)], _RUN_NAMES)

        def first_windows() -> pa.RecordBatch:
            windows.sort()
            out, known, before = [], [], None
            for w in windows:
                if before is None or w[0] != before[0]:
                    out.append((WINDOW, None, None, None, None, None, *w))
                    before = w
                elif w != before:
                    known.append((w[1], w[2], w[3] + length, length, length))
            windows.clear()
            if known:
                out.append((KNOWN, None, None, None, None, np.array(sorted(set(known)), FACTS).tobytes(), None, None, None, None))
            return batch(out)

        def flush() -> pa.RecordBatch:
            held.sort()
            out, kept, known = [], [], []
            for item in held:
                if kept and kept[-1][0] == item[0] and kept[-1][1] == item[1]:
                    if kept[-1][2][:3] != item[2][:3]:
                        known.append(item[2])
                else:
                    kept.append(item)
            held.clear()
            if known:
                out.append((KNOWN, None, None, None, None, np.array(known, FACTS).tobytes(), None, None, None, None))
            a = 0
            while a < len(kept):
                number = bisect_right(limits, kept[a][0][:gram])
                b = len(kept)
                if number < len(limits):
                    low, high = a, b                # first suffix of the next range
                    while low < high:
                        middle = (low + high) // 2
                        if kept[middle][0][:gram] < limits[number]:
                            low = middle + 1
                        else:
                            high = middle
                    b = low
                out.append((number, *front_code([x[0] for x in kept[a:b]]), b"".join(x[1] for x in kept[a:b]),
                            np.array([x[2] for x in kept[a:b]], FACTS).tobytes(), None, None, None, None))
                a = b
            return batch(out)

        for part, texts in slices(batches, "text"):
            place, low, high, hashes = anchors(texts, hasher, length, gram)
            full = np.isin(hashes, rare.value)
            owner = np.searchsorted(texts.at, place, "right") - 1
            inside = place - texts.at[owner]
            ids, keys = part.column("id").to_pylist(), part.column("k").to_pylist()
            ends = np.searchsorted(owner, np.arange(part.num_rows + 1))
            data = texts.data.tobytes()
            for i, pack in enumerate(part.column("places").to_pylist()):
                wanted = np.frombuffer(pack, np.int64)
                a, b = ends[i], ends[i + 1]
                some = a + np.flatnonzero(np.isin(inside[a:b], wanted))
                for s, e in zip(low[some[full[some]]].tolist(), high[some[full[some]]].tolist()):
                    windows += [(hashlib.blake2b(data[x:x + length], digest_size=16).digest(), ids[i], keys[i],
                                 x - int(texts.at[i])) for x in range(s, e + 1)]
                if len(windows) >= HELD_SUFFIXES:
                    yield first_windows()
                some = some[~full[some]]
                for p, s, e, q in zip(place[some].tolist(), low[some].tolist(), high[some].tolist(),
                                      inside[some].tolist()):
                    held.append((data[p:e + length], data[s:p], (ids[i], keys[i], q, p - e, p - s)))
                if len(held) >= HELD_SUFFIXES:
                    yield flush()
        if held:
            yield flush()
        if windows:
            yield first_windows()

    return rows.mapInArrow(work, _RUN)


def repeats(shared: np.ndarray, befores: list[bytes], facts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(least, most) bytes before the anchor at which a repeated window starts, -1 for none, of merged
    suffixes. ``shared[i]`` is the prefix length that suffix i shares with the one before."""
    n = len(facts)
    least, most = np.full(n, -1), np.full(n, -1)
    width = int(facts["high"].max()) if n else 0
    back = np.zeros((n, width + (-width) % 8), np.uint8)
    for i, b in enumerate(befores):
        back[i, :len(b)] = np.frombuffer(b, np.uint8)[::-1]
    columns = back.view(">u8").astype(np.uint64) if width else np.zeros((n, 0), np.uint64)
    group = np.cumsum(shared < length - width)
    order = np.lexsort([*columns.T[::-1], group])
    sorted_back = back[order]
    same = sorted_back[1:] == sorted_back[:-1]
    agree = np.append(0, np.where(same.all(1), width, (~same).argmax(1)) if width else np.zeros(max(n - 1, 0), int))
    turn = np.lexsort((facts["place"], facts["k"], facts["id"]))
    low, high = facts["low"][turn], facts["high"][turn]
    key, place = facts["k"][turn], facts["place"][turn]
    for l in range(int(facts["low"].min()) if n else 0, width + 1):
        right = np.cumsum(shared < length - l)
        left = np.zeros(n, np.int64)
        left[order] = np.cumsum(agree < l)
        some = np.flatnonzero((low <= l) & (l <= high))
        own = turn[some]
        _, first, back_ = np.unique(right[own] * (n + 1) + left[own], return_index=True, return_inverse=True)
        earliest = some[first][back_]
        again = (key[some] != key[earliest]) | (place[some] != place[earliest])
        hit = own[again]
        most[hit] = l
        least[hit[least[hit] < 0]] = l
    return least, most


def merged(runs: DataFrame, ranges: int, length: int) -> DataFrame:
    """(k, start, stop) of repeated bytes, from the runs of each range."""
    def spans(facts: np.ndarray, least: np.ndarray, most: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(facts["k"]), pa.array(facts["place"] - most), pa.array(facts["place"] - least + length)],
            ["k", "start", "stop"])

    def one(packs: list[tuple]) -> pa.RecordBatch:
        strings = [front_decode(*p[:3]) for p in packs]
        order, shared = merge_runs([(s, p[0]) for s, p in zip(strings, packs)])
        facts = [np.frombuffer(p[4], FACTS) for p in packs]
        befores = []
        for p, f in zip(packs, facts):
            ends = np.cumsum(np.append(0, f["high"].astype(np.int64))).tolist()
            befores.append([p[3][a:b] for a, b in zip(ends, ends[1:])])
        starts = np.cumsum([0, *map(len, facts)])
        at = np.array([starts[r] + i for r, i in order], np.int64)
        every = np.concatenate(facts)[at]
        least, most = repeats(np.array(shared), [befores[r][i] for r, i in order], every, length)
        some = least >= 0
        return spans(every[some], least[some], most[some])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, packs, first = -1, [], None
        for b in batches:
            again = []
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[0] == WINDOW:                    # in the order of window, id, k and start
                    if first is None or row[6] != first[0]:
                        first = row[6:]
                    elif row[6:] != first:
                        again.append((row[7], row[8], row[9] + length, length, length))
                    continue
                if row[0] == KNOWN:
                    facts = np.frombuffer(row[5], FACTS)
                    yield spans(facts, facts["low"].astype(np.int64), facts["high"].astype(np.int64))
                    continue
                if row[0] != number and packs:
                    yield one(packs)
                    packs = []
                number = row[0]
                packs.append(row[1:])
            if again:
                facts = np.array(again, FACTS)
                yield spans(facts, facts["low"].astype(np.int64), facts["high"].astype(np.int64))
        if packs:
            yield one(packs)

    target = F.when(F.col("range") >= 0, F.col("range")).otherwise(F.pmod(F.xxhash64("facts", "window"), F.lit(ranges)))
    return (runs.repartition(ranges, target).sortWithinPartitions("range", "window", "id", "k", "start")
            .mapInArrow(work, "k long, start long, stop long"))


def repeated_spans(rows: DataFrame, length: int, gram: int, hot: int = HOT) -> DataFrame:
    """(k, start, stop) of repeated bytes of (id, k, text) rows; spans may overlap."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = durable(repeated_anchors(rows, length, gram, parts, hot))
    # about twice as many as wanted by their hashes, so that a partition does not send as many by itself
    sampled = found.where("sample is not null")
    share = min(1.0, 2.0 * SAMPLE / max(1, sampled.count()))
    near = sampled.where(F.col("turn") < F.lit(int(share * (1 << 63)) - 1)) if share < 1 else sampled
    picked = sorted(r["sample"] for r in near.orderBy("turn").limit(SAMPLE).select("sample").collect())
    ranges = RANGES_PER_PART * parts
    limits = sorted({picked[len(picked) * i // ranges] for i in range(1, ranges)}) if picked else []
    wanted = places_by_key(found, parts)
    # all columns, so that the later join finds the same exchange and shuffles no text again
    at_anchors = rows.join(wanted, "k")
    return merged(sorted_runs(at_anchors, limits, length, gram, hot_anchors(found, hot)), ranges, length)


def kept_bytes(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """(what is left, bytes removed, maximal removed runs)."""
    parts, at, removed, runs, stop = [], 0, 0, 0, -1
    for a, b in sorted(spans):
        if a > stop:
            parts.append(text[at:a])
            runs += 1
            stop = a
        removed += max(0, b - stop)
        stop = max(stop, b)
        at = stop
    parts.append(text[at:])
    return b"".join(parts), removed, runs


def _with_spans(rows: DataFrame, length: int, gram: int, hot: int) -> DataFrame:
    if not 0 < gram <= length <= 255:
        raise ValueError("needs 0 < gram <= length <= 255")
    spans = repeated_spans(rows, length, gram, hot).groupBy("k").agg(
        F.collect_set(F.struct("start", "stop")).alias("spans"))
    return rows.join(spans, "k", "left")


def _left(part: pa.RecordBatch) -> list[tuple[bytes, int, int]]:
    spans = [[(s["start"], s["stop"]) for s in x or ()] for x in part.column("spans").to_pylist()]
    return [kept_bytes(t.encode(), s) for t, s in zip(part.column("text").to_pylist(), spans)]


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
          gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """One row per document row: id, n_bytes, n_removed, n_spans, kept_sha256."""
    rows = _prepared(docs, id_col, text_col, [])
    joined = _with_spans(rows, length, gram, hot)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "text"):
            done = _left(part)
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(np.diff(texts.at)), pa.array([d[1] for d in done], pa.int64()),
                 pa.array([d[2] for d in done], pa.int64()),
                 pa.array([hashlib.sha256(d[0]).hexdigest() for d in done], pa.string())],
                ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    done = joined.mapInArrow(work, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return done.withColumn("id", F.when(F.col("id") > -(1 << 63), F.col("id"))).withColumnRenamed("id", id_col)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                    gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """The rows with all their columns and the text that is left, less characters that lost a byte; a null
    text stays null."""
    columns = docs.columns
    others = [c for c in columns if c != text_col]
    rows = _prepared(docs, id_col, text_col, others)
    wanted = ["text" if c == text_col else f"c{others.index(c)}" for c in columns]
    schema = T.StructType([T.StructField(c, rows.schema[c].dataType) for c in wanted])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _ in slices(batches, "text"):
            kept = pa.array([d[0].decode("utf-8", "ignore") for d in _left(part)], pa.string())
            kept = pc.if_else(part.column("void"), pa.scalar(None, pa.string()), kept)
            yield pa.RecordBatch.from_arrays([kept if c == "text" else part.column(c) for c in wanted], wanted)

    return _with_spans(rows, length, gram, hot).mapInArrow(work, schema).toDF(*columns)


@query("op9_suffixes")
def op9_suffixes(spark: SparkSession, sf: str) -> DataFrame:
    return dedup(table(spark, sf, "documents"))
