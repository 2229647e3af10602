"""Operator 7: licence scan.

One Aho-Corasick automaton finds notice phrases, word by word, in the lower-cased text, and the words of
the identifier tag. The licence expression behind a tag is parsed by shunting-yard (``with`` binds closer
than ``and``, ``and`` closer than ``or``) and evaluated against a set of permitted licences. It ends at the first
part that cannot go on, with the line, or at the next tag; closing punctuation is no part of it.

Defined results: a null or empty text has no words and no labels; a tag without a readable expression, or
whose line breaks off behind an operator or within brackets, adds no label; every row has its own result,
repeated or not; only ``id`` and ``text`` are read.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pitspark.llm.registry import query, table
from pitspark.llm.words import slices

# The phrases and labels every scan must count.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Further notice phrases, each with its label.
MORE_PHRASES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "isc license": "isc",
    "boost software license": "bsl",
    "creative commons attribution": "cc-by",
    "permission is hereby granted free of charge": "mit",
    "all rights reserved": "proprietary",
    "public domain": "public-domain",
}
# The first part of a licence identifier and the label of its family.
FAMILIES = {
    "gpl": "gpl", "lgpl": "lgpl", "agpl": "agpl", "apache": "apache", "mit": "mit", "bsd": "bsd", "mpl": "mpl",
    "epl": "epl", "isc": "isc", "bsl": "bsl", "cc0": "public-domain", "unlicense": "public-domain",
}
PERMITTED = frozenset({"apache", "mit", "bsd", "isc", "bsl", "cc-by", "public-domain"})
TAG = "spdx license identifier"
BINDS = {"or": 1, "and": 2, "with": 3}
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
TAG_LINE = re.compile(r"spdx-license-identifier:[ \t]*([^\r\n]*?)(?=spdx-license-identifier:|[\r\n]|\Z)")
PART = re.compile(r"[()]|[a-z0-9.+\-]+")


def lower(text: str) -> str:
    """A-Z only, so that no other character changes."""
    return text.lower() if text.isascii() else text.translate(_LOWER)


_LOWER = {c: c + 32 for c in range(65, 91)}


def postfix(expression: str) -> list[str] | None:
    """Operands and operators in postfix order; None where the expression is not well formed."""
    out: list[str] = []
    held: list[str] = []
    operand_next = True
    for part in PART.findall(expression):
        if part == "(" and operand_next:
            held.append(part)
        elif part == ")" and not operand_next:
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                return None
            held.pop()
        elif part in BINDS and not operand_next:
            while held and BINDS.get(held[-1], 0) >= BINDS[part]:
                out.append(held.pop())
            held.append(part)
            operand_next = True
        elif part not in BINDS and part not in "()" and operand_next:
            out.append(part)
            operand_next = False
        else:
            return None
    if operand_next or "(" in held:
        return None
    return out + held[::-1]


def leading(line: str) -> list[str] | None:
    """Postfix order of the expression that a line begins with: where some part cannot go on, of the longest
    well-formed one before it."""
    parts: list[str] = []
    whole, depth, operand_next = 0, 0, True
    for found in PART.finditer(line):
        part = found[0].rstrip(".-") if found[0].strip(".-+") else ""
        if part == "(" and operand_next:
            depth += 1
        elif part == ")" and not operand_next and depth:
            depth -= 1
        elif part in BINDS and not operand_next:
            operand_next = True
        elif part and part not in BINDS and part not in "()" and operand_next:
            operand_next = False
        else:
            break
        parts.append(part)
        if not operand_next and not depth:
            whole = len(parts)
    else:
        whole = len(parts)
    return postfix(" ".join(parts[:whole]))


def family(licence: str) -> str:
    """Label of a licence identifier: its family where known, else itself."""
    if licence.startswith("cc-by"):
        return "cc-by"
    return FAMILIES.get(licence.rstrip("+").split("-")[0], licence)


def evaluate(order: list[str], permitted: frozenset[str]) -> tuple[bool, set[str]]:
    """(may it be used under the permitted licences, labels of the licences named)."""
    stack: list[tuple[bool, set[str]]] = []
    for part in order:
        if part not in BINDS:
            label = family(part)
            stack.append((label in permitted, {label}))
            continue
        right, left = stack.pop(), stack.pop()
        if part == "with":          # an exception widens the licence on its left and is none itself
            stack.append(left)
        else:
            allowed = left[0] and right[0] if part == "and" else left[0] or right[0]
            stack.append((allowed, left[1] | right[1]))
    return stack[0]


def automaton(phrases: dict[str, tuple[str, bool]]) -> ahocorasick.Automaton:
    """Phrases between spaces, so that a match covers whole words."""
    found = ahocorasick.Automaton()
    for phrase, (label, base) in phrases.items():
        found.add_word(f" {phrase} ", (len(phrase) + 2, phrase.count(" ") + 1, label, base))
    found.make_automaton()
    return found


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         base: dict[str, str] = BASE_PHRASES, more: dict[str, str] = MORE_PHRASES,
         permitted: frozenset[str] = PERMITTED) -> DataFrame:
    """One row per document: words, places of base phrases, labels, tagged expressions and whether all
    of them are permitted (null without any), and a score: the share of doubt that the evidence removes,
    0.9 for each tag, 0.7 for each base place and 0.4 for each other notice, taken as independent."""
    phrases = {p: (label, False) for p, label in more.items()} | {p: (label, True) for p, label in base.items()}
    phrases[TAG] = ("", False)
    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = src.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = automaton(phrases)

        def one(text: str) -> tuple:
            low = lower(text)
            words = WORD.findall(low)
            # the word split keeps a space of its own around every word; phrases may share one
            line = f" {' '.join(words)} "
            starts, labels, first_labels, notices, tagged = [], set(), set(), 0, False
            for stop, (length, n, label, is_base) in matcher.iter(line):
                if not label:
                    tagged = True
                elif is_base:
                    starts.append((stop - length + 1, n))
                    first_labels.add(label)
                else:
                    notices += 1
                    labels.add(label)
            at = [line.count(" ", 0, min(starts)[0] + 1) - 1, line.count(" ", 0, max(starts)[0] + 1) - 1] if starts else [None, None]
            expressions, allowed = [], None
            for found in TAG_LINE.finditer(low) if tagged else ():
                order = leading(found[1])
                if order is not None:
                    fine, named = evaluate(order, permitted)
                    expressions.append(" ".join(order))
                    allowed = fine if allowed is None else allowed and fine
                    labels |= named
            doubt = 0.1 ** len(expressions) * 0.3 ** len(starts) * 0.6 ** notices
            return (len(words), len(starts), *at, ",".join(sorted(first_labels)),
                    ",".join(sorted(first_labels | labels)), 1.0 - doubt, expressions, allowed)

        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(),
                 pa.list_(pa.string()), pa.bool_()]
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "expressions",
                 "allowed"]
        for part, _ in slices(batches, "text"):
            rows = [one(t or "") for t in part.column("text").to_pylist()]
            cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([part.column("id"), *cols], ["id", *names])

    done = src.mapInArrow(work, f"id {kind}, n_words long, n_base long, first_word long, last_word long, "
                                "base_labels string, labels string, score double, expressions array<string>, "
                                "allowed boolean")
    return done.withColumnRenamed("id", id_col)


@query("op7_licences")
def op7_licences(spark: SparkSession, sf: str) -> DataFrame:
    return scan(table(spark, sf, "documents"))
