"""Operator 6: byte-level BPE encoding and decoding.

The ranks file gives the vocabulary: the rank of a byte string is its id. The tokenizers library
encodes the pieces of Arrow batches; it works on one printable character per byte, so the vocabulary and its merges
are written in those characters, and decoding reverses the table. Texts are encoded whole, each match
of the split pattern by itself, without special tokens.

Defined results: a null or empty text has no ids and decodes to nothing; any other column may be null;
repeated rows give repeated results; an empty table gives an empty one; only ``id`` and ``text`` are read.
"""
from __future__ import annotations

import base64
import codecs
import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer, models

from pitspark.llm.registry import query, table
from pitspark.llm.words import Texts, slices, texts_of

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: printable Latin-1 for itself, the rest
    from U+0100 on in byte order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    at = {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}
    return [at[b] for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Byte string of each id."""
    with open(path, "rb") as f:
        found = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, f)}
    return [found[i] for i in range(len(found))]


def tokenizer_json(tokens: list[bytes], pattern: str) -> str:
    """A byte-level BPE model equal to the ranks: every way to put a token together from two others
    is a merge, in the order of the token made."""
    chars = byte_characters()
    written = ["".join(chars[b] for b in t) for t in tokens]
    known = set(written)
    merges = [[w[:i], w[i:]] for w in written for i in range(1, len(w)) if w[:i] in known and w[i:] in known]
    return json.dumps({
        "version": "1.0", "added_tokens": [], "truncation": None, "padding": None, "normalizer": None,
        "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": pattern}, "behavior": "Isolated", "invert": False},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False}]},
        "post_processor": None, "decoder": None,
        "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None,
                  "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": True,
                  "vocab": {w: i for i, w in enumerate(written)}, "merges": merges}}, ensure_ascii=False)


#: A single space between two characters that are no white space: no match of the pattern reaches over it.
CUT = re.compile(r"(?<=\S) (?=\S)")
# Bytes of ASCII white space, and the first two bytes of all other white space in UTF-8.
SPACES = [*range(0x09, 0x0E), *range(0x1C, 0x21)]
WIDE_SPACES = [(0xC2, 0x85), (0xC2, 0xA0), (0xE1, 0x9A), (0xE2, 0x80), (0xE2, 0x81), (0xE3, 0x80)]
KEPT_PARTS = 1 << 19        # parts whose ids a task remembers; it then starts anew, which bounds its memory


class Parts(dict):
    """Number of each text part met so far, its ids and their decimal digits. A part in a tuple is the
    first of a text, any other follows a space. Parts are encoded when first asked for."""

    def __init__(self, model: models.BPE, pattern: regex.Pattern) -> None:
        self.model, self.pattern = model, pattern
        self.characters = dict(enumerate(byte_characters()))
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.ids, self.ends = array("i"), array("q", [0])
        self.digits, self.digit_ends = bytearray(), array("q", [0])

    def _model_ids(self, piece: str) -> list[int]:
        seen = piece.encode().decode("latin-1").translate(self.characters)
        return [t.id for t in self.model.tokenize(seen)]

    def _piece_ids(self, piece: str) -> tuple[int, ...]:
        ids = self.pieces.get(piece)
        if ids is None:
            ids = self.pieces[piece] = tuple(self._model_ids(piece))
        return ids

    def __missing__(self, part: str | tuple[str]) -> int:
        if type(part) is str and part.isalpha():        # letters behind a space are one match
            ids = self._model_ids(" " + part)
        else:
            text = " " + part if type(part) is str else part[0]
            ids = [i for piece in self.pattern.findall(text) for i in self._piece_ids(piece)]
        number = self[part] = len(self)
        self.ids.extend(ids)
        self.ends.append(len(self.ids))
        if ids:
            self.digits += (",".join(map(str, ids)) + ",").encode()
        self.digit_ends.append(len(self.digits))
        return number


def plain_spaced(texts: Texts) -> np.ndarray:
    """Which texts surely have single spaces between other characters only, so that every space is a cut."""
    data, at = texts
    space, odd = data == 0x20, np.zeros(len(data), bool)
    white = np.isin(data, SPACES)
    odd[1:] = space[1:] & white[:-1]
    odd[:-1] |= space[:-1] & white[1:]
    for first, second in WIDE_SPACES:
        odd[:-1] |= (data[:-1] == first) & (data[1:] == second)
    filled = at[:-1] < at[1:]
    heads, tails = at[:-1][filled], at[1:][filled] - 1
    odd[heads] |= space[heads]
    odd[tails] |= space[tails]
    bad = np.zeros(len(at) - 1, bool)
    bad[np.searchsorted(at, np.flatnonzero(odd), "right") - 1] = True
    return ~bad


def gather(values: np.ndarray, ends: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``picks`` of ``values`` one after the other, and the offsets of the runs in the result."""
    low, size = ends[picks], ends[picks + 1] - ends[picks]
    at = np.zeros(len(picks) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    return values[np.arange(at[-1]) + np.repeat(low - at[:-1], size)], at


class Codec:
    """Encoder and decoder of one task, built from the model text.

    Texts are cut where no match can reach over, and equal parts are encoded once.
    """

    def __init__(self, model: str, pattern: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # Spark gives each task one core
        self.encoder = Tokenizer.from_str(model)
        self.pattern = regex.compile(pattern)
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        vocab = sorted(self.encoder.get_vocab(with_added_tokens=False).items(), key=lambda x: x[1])
        tokens = [bytes(byte_of[c] for c in w) for w, _ in vocab]
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.token_ends = np.cumsum([0, *map(len, tokens)])
        self.parts = Parts(self.encoder.model, self.pattern)

    def _numbers(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all parts of the texts, and offsets of the texts in them."""
        if len(self.parts) > KEPT_PARTS:
            self.parts = Parts(self.encoder.model, self.pattern)
        plain = plain_spaced(texts_of(column)).tolist()
        cut = [(t or "").split(" ") if p else CUT.split(t) for t, p in zip(column.to_pylist(), plain)]
        for parts in cut:
            parts[0] = (parts[0],)
        total = sum(map(len, cut))
        numbers = np.fromiter(map(self.parts.__getitem__, chain.from_iterable(cut)), np.int64, total)
        return numbers, np.cumsum([0, *map(len, cut)])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the offsets of the texts in them."""
        numbers, at = self._numbers(texts)
        ids, ends = gather(np.array(self.parts.ids, np.int32), np.array(self.parts.ends), numbers)
        return ids, ends[at]

    def encode_with_digits(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """As ``encode``, and the decimal ids, a comma after each, with the texts' offsets in them."""
        numbers, at = self._numbers(texts)
        ids, ends = gather(np.array(self.parts.ids, np.int32), np.array(self.parts.ends), numbers)
        digits, stops = gather(np.frombuffer(bytes(self.parts.digits), np.uint8),
                               np.array(self.parts.digit_ends), numbers)
        return ids, ends[at], digits, stops[at]

    def offsets(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        """Character range of each id. Ids that are parts of one character share its range."""
        return [e.offsets for e in self.encoder.encode_batch(texts, add_special_tokens=False)]

    def decode(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of id runs with offsets ``at``, and the offsets of the runs' bytes."""
        raw, ends = gather(self.token_bytes, self.token_ends, ids)
        return raw, ends[at]


def decode_stream(pieces: Iterator[bytes]) -> Iterator[str]:
    """Text of decoded runs that arrive one after the other; a character that is split between two of
    them comes out with the second one."""
    held = codecs.getincrementaldecoder("utf-8")("replace")
    for piece in pieces:
        yield held.decode(piece)
    yield held.decode(b"", final=True)


def encode(docs: DataFrame, id_col: str, text_col: str, ranks: str = RANKS, pattern: str = PATTERN,
           with_offsets: bool = False) -> DataFrame:
    """(id, ids array, and with ``with_offsets`` starts and ends in characters) of every text."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(tokenizer_json(read_ranks(ranks), pattern))    # a few MB, the vocabulary
    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    extra = ", starts array<int>, ends array<int>" if with_offsets else ""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model.value, pattern)
        for part, _ in slices(batches, "text"):
            ids, at = codec.encode(part.column("text"))
            cols = [part.column("id"), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))]
            if with_offsets:
                spans = codec.offsets([t or "" for t in part.column("text").to_pylist()])
                cols += [pa.array([[s[k] for s in one] for one in spans], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(cols, ["id", "ids", "starts", "ends"][:len(cols)])

    return src.mapInArrow(work, f"id {kind}, ids array<int>{extra}")


def decode(encoded: DataFrame, ranks: str = RANKS) -> DataFrame:
    """(id, bytes, text) of id lists; bytes that are no whole character become U+FFFD in ``text`` only."""
    tokens = encoded.sparkSession.sparkContext.broadcast(read_ranks(ranks))
    kind = encoded.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [b"".join(map(tokens.value.__getitem__, ids or [])) for ids in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(raw, pa.binary()),
                 pa.array([r.decode("utf-8", "replace") for r in raw], pa.string())], ["id", "bytes", "text"])

    return encoded.select("id", "ids").mapInArrow(work, f"id {kind}, bytes binary, text string")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS,
            pattern: str = PATTERN) -> DataFrame:
    """Encode every text and decode its ids in one pass: number of ids, SHA-256 of the decimal ids
    joined by commas and of the decoded bytes."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(tokenizer_json(read_ranks(ranks), pattern))
    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = src.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model.value, pattern)

        def sha(data: np.ndarray, at: np.ndarray, less: int) -> pa.Array:
            raw = memoryview(data)
            return pa.array([hashlib.sha256(raw[a:max(a, b - less)]).hexdigest() for a, b in zip(at, at[1:])], pa.string())

        for part, _ in slices(batches, "text"):
            ids, at, digits, stops = codec.encode_with_digits(part.column("text"))
            raw, ends = codec.decode(ids, at)
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(np.diff(at)), sha(digits, stops.tolist(), 1), sha(raw, ends.tolist(), 0)],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    done = src.mapInArrow(work, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return done.withColumnRenamed("id", id_col)


@query("op6_byte_bpe")
def op6_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return digests(table(spark, sf, "documents"))
