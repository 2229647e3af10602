"""Words and rolling hashes of Arrow text columns, computed on whole batches with numpy.

A word is a maximal run of digits, letters a-z (after lower-casing A-Z) and bytes of non-ASCII
characters, which is the pattern ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` on the lower-cased text.
Texts are taken as UTF-8 bytes; a null text is an empty one. Whole texts are processed.
"""
from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20       # texts are handled in slices of about this size, one text at least


class Texts(NamedTuple):
    data: np.ndarray        # bytes of all texts, one after the other
    at: np.ndarray          # n + 1 offsets of the texts in data


class Words(NamedTuple):
    data: np.ndarray        # lower-cased bytes
    start: np.ndarray       # first byte of each word
    end: np.ndarray         # byte after each word
    first: np.ndarray       # n + 1 offsets of the texts' words
    code: np.ndarray        # 64-bit hash of each word


def _lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def _word_table() -> np.ndarray:
    table = np.zeros(256, bool)
    table[48:58] = table[97:123] = table[128:] = True
    return table


LOWER, IN_WORD = _lower_table(), _word_table()
BYTE_CODES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Hasher:
    """Hashes of any byte range of a buffer from one running sum (arithmetic modulo 2^64)."""

    def __init__(self) -> None:
        self.up = self.down = np.zeros(0, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            n = 1 << max(18, (n - 1).bit_length())
            self.up, self.down = powers(n, BASE), powers(n, BASE_INVERSE)

    def sums(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        terms = BYTE_CODES[data]
        terms *= self.up[:len(data)]
        np.cumsum(terms, out=out[1:])
        return out

    def ranges(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((sums[end] - sums[start]) * self.down[start])

    def grams(self, sums: np.ndarray, size: int) -> np.ndarray:
        """Hashes of all ranges of ``size`` bytes."""
        return mix((sums[size:] - sums[:len(sums) - size]) * self.down[:len(sums) - size])


def texts_of(column: pa.Array | pa.ChunkedArray) -> Texts:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    if not len(at):
        return Texts(data[:0], np.zeros(1, np.int64))
    return Texts(data[at[0]:at[-1]], at - at[0])    # a slice shares the buffer of the whole column


def slices(batches: Iterator[pa.RecordBatch], column: str,
           limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Batches cut by rows so that each holds about ``limit`` bytes of text, or one longer text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts, at = texts_of(batch.column(column)), 0
        while at < batch.num_rows:
            to = int(np.searchsorted(texts.at, texts.at[at] + limit, "right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            low, high = int(texts.at[at]), int(texts.at[to])
            yield batch.slice(at, to - at), Texts(texts.data[low:high], texts.at[at:to + 1] - low)
            at = to


def words_of(texts: Texts, hasher: Hasher) -> Words:
    data = LOWER[texts.data]
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(len(texts.at), np.int64), np.zeros(0, np.uint64))
    inside = IN_WORD[data]
    begin, stop = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    stop[:-1] &= ~inside[1:]
    some = texts.at[:-1] < texts.at[1:]             # a word ends where its text ends
    heads, tails = texts.at[:-1][some], texts.at[1:][some] - 1
    begin[heads], stop[tails] = inside[heads], inside[tails]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    code = hasher.ranges(hasher.sums(data), start, end)
    return Words(data, start, end, np.searchsorted(start, texts.at), code)


def word_grams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every run of ``n`` consecutive words of one text; a text of fewer
    words, but not none, is one run of all its words."""
    count = np.diff(words.first)
    code = words.code
    if len(code) >= n:
        mixed = np.zeros(len(code) - n + 1, np.uint64)
        for i in range(n):
            mixed = mixed * BASE + code[i:len(code) - n + 1 + i]
        mixed = mix(mixed)
    else:
        mixed = np.zeros(0, np.uint64)
    each = np.maximum(count - n + 1, 0)
    owner = np.repeat(np.arange(len(count)), each)
    place = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(words.first[:-1], each)
    out = mixed[place]
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for j, s in enumerate(short):
            h = 0
            for c in code[words.first[s]:words.first[s + 1]].tolist():
                h = (h * int(BASE) + c) & 0xFFFFFFFFFFFFFFFF
            whole[j] = h ^ int(count[s])
        out, owner = np.concatenate([out, mix(whole)]), np.concatenate([owner, short])
    return out, owner
