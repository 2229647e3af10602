"""Word helpers, language identification, licences, toxicity and BPE on small texts."""
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pitspark.llm import byte_bpe, language, licences, toxicity
from pitspark.llm.words import Hasher, texts_of, word_grams, words_of

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.1"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [None, "", "  ", "...", "one", "Ä1 é_x", "a b", "ab", "Über-maß\n\nTail", "x" * 300_000, "w " * 40_000, "one"]


def odd_docs(spark, extra="string"):
    """Null, empty, wordless, very long and repeated texts, repeated and null ids, clashing columns."""
    ids = [*range(len(ODD) - 2), None, 4]
    rows = [(i, t, "en", "s", 1, "c") for i, t in zip(ids, ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score long, id string")


def words(text):
    return WORD.findall((text or "").translate(LOW))


def test_words_equal_the_pattern():
    got = words_of(texts_of(pa.array(ODD, pa.string())), Hasher())
    for i, text in enumerate(ODD):
        span = range(got.first[i], got.first[i + 1])
        assert [got.data[got.start[j]:got.end[j]].tobytes().decode() for j in span] == words(text)
    codes = {}
    for j in range(len(got.code)):
        codes.setdefault(got.data[got.start[j]:got.end[j]].tobytes(), set()).add(int(got.code[j]))
    assert all(len(c) == 1 for c in codes.values()) and len({c for s in codes.values() for c in s}) == len(codes)


def test_grams_do_not_cross_texts():
    texts = ["a b c d e f", "a b c d e", "a b", "", "a b"]
    code, owner = word_grams(words_of(texts_of(pa.array(texts)), Hasher()), 5)
    by = {i: set(code[owner == i].tolist()) for i in range(5)}
    assert [len(by[i]) for i in range(5)] == [2, 1, 1, 0, 1]
    assert by[1] < by[0] and by[2] == by[4] and not by[2] & by[0]


def test_language_is_told_for_texts_it_has_not_seen(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.train(docs.where(~language.held_out(F.col("doc_id"))))
    got = language.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id")
    rows = got.where(language.held_out(F.col("doc_id"))).collect()
    assert len(rows) > 200 and np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.98
    odd = language.predict(odd_docs(spark), model).collect()
    assert len(odd) == len(ODD)
    by = dict(zip(ODD, odd))
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for t, r in by.items() if t in (None, "", "  ", "..."))
    assert all(r["lang_pred"] in model.languages for t, r in by.items() if t and words(t) and "1" not in t)
    assert all(0 <= r["score"] <= 1 for r in odd)
    kept = language.identified(odd_docs(spark), model, 0.0)
    assert kept.columns == odd_docs(spark).columns and kept.count() == len(ODD) - 4
    assert language.predict(docs.limit(0), model).count() == 0


def language_by_hand(train, texts):
    """(language, score) of every text; train: distinct (text, language) rows."""
    langs = sorted({x for _, x in train})
    tables = [{} for _ in range(5)]

    def pieces(word, n):
        return [(word[i:i + n], i == 0, i == len(word) - n) for i in range(len(word) - n + 1)]

    for text, lang in train:
        for w in words(text):
            for n in range(5):
                for key in pieces(w, n) if n else [w]:
                    own = tables[n].setdefault(key, [0] * len(langs))
                    own[langs.index(lang)] += 1
    totals = [[sum(v[j] for v in t.values()) for j in range(len(langs))] for t in tables]

    def log(n, key):
        return [math.log(tables[n][key][j] + 0.5) - math.log(totals[n][j] + 0.5 * (len(tables[n]) + 1)) for j in range(len(langs))]

    def mean(rows):
        return [sum(c) / len(rows) for c in zip(*rows)]

    out = []
    for text in texts:
        scores = []
        for w in words(text):
            if w in tables[0]:
                scores.append(log(0, w))
                continue
            for n in (4, 3, 2, 1):
                known = [k for k in pieces(w, n) if k in tables[n]]
                if known:
                    scores.append(mean([log(n, k) for k in known]))
                    break
        level = [(mean(scores)[j] * min(len(scores), language.FIRM_WORDS) if scores else 0.0)
                 + math.log(sum(x == lang for _, x in train) / len(train)) for j, lang in enumerate(langs)]
        chance = [math.exp(x - max(level)) for x in level]
        best = max(range(len(langs)), key=lambda j: chance[j])
        out.append((langs[best], chance[best] / sum(chance)) if any(c.isalpha() for c in text or "") else ("und", 0.0))
    return out


def test_language_equals_brute_force(spark):
    rows = {(r["text"], r["lang"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect() if r["text"]}
    rows = sorted(rows, key=lambda x: zlib.crc32(x[0].encode()))
    train, asked = [(t[:400], x) for t, x in rows[:60]], [t[:150] for t, _ in rows[60:120]] + ["zq", "Ünseen 12", "..."]
    train = sorted(set(train))
    model = language.train(spark.createDataFrame(train, "text string, lang string"))
    docs = spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in language.predict(docs, model).collect()}
    for i, (lang, score) in enumerate(language_by_hand(train, asked)):
        assert got[i]["lang_pred"] == lang and abs(got[i]["score"] - score) < 1e-5, asked[i]


def test_a_small_language_keeps_its_words(spark):
    rows = [(" ".join(f"big{i * 7 + j}x{j % 3}" for j in range(7)), "big") for i in range(300)] + [("petit mot ici", "small")] * 2
    model = language.train(spark.createDataFrame(rows, "text string, lang string"), kept_words=40, kept_grams=40)
    docs = spark.createDataFrame([(1, "petit mot"), (2, "big3x0")], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in language.predict(docs, model).collect()} == {1: "small", 2: "big"}


def test_language_without_labels(spark):
    docs = spark.createDataFrame([(1, "a word", None)], "doc_id long, text string, lang string")
    assert language.predict(docs, language.train(docs)).head()["lang_pred"] == "und"


def test_copies_of_a_text_do_not_outweigh_a_language(spark):
    rows = [(f"der hund und katze {i % 7}", "de") for i in range(40)] + [(f"the dog and cat {i}", "en") for i in range(40)]
    plain, copied = (language.train(spark.createDataFrame(x, "text string, lang string"))
                     for x in (rows, rows + [("the dog and cat 3", "en")] * 400))
    assert all((a == b).all() for a, b in zip(plain.codes + plain.scores, copied.codes + copied.scores))
    src = spark.createDataFrame(rows + rows, "text string, lang string")
    for most, want in ((5, {"de": 5, "en": 5}), (9, {"de": 7, "en": 9})):
        got = language.draw(src, most)
        assert {r["lang"]: r["count"] for r in got.groupBy("lang").count().collect()} == want
        assert got.distinct().count() == got.count()


def test_backoff_goes_to_shorter_runs():
    known = words_of(texts_of(pa.array(["abcd"])), Hasher())
    hasher = Hasher()
    grams, _ = language.grams(known, hasher.sums(known.data), hasher, np.array([0]), 2)
    codes = [np.zeros(0, np.uint64) for _ in range(5)]
    scores = [np.zeros((0, 2), np.float32) for _ in range(5)]
    codes[2], scores[2] = np.sort(grams[:1]), np.array([[-1.0, -9.0]], np.float32)
    model = language.Model(["x", "y"], np.log([0.5, 0.5]), codes, scores)
    for text, share in (("abzz", 1.0), ("zzzz", 0.5)):
        names, score = language.predict_slice(model, texts_of(pa.array([text])), hasher)
        assert names == ["x"] and abs(score[0] - share) < 1e-3


def encoding():
    tokens = byte_bpe.read_ranks(byte_bpe.RANKS)
    return tiktoken.Encoding("own", pat_str=byte_bpe.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)},
                             special_tokens={}), tokens


def test_bpe_equals_tiktoken_and_round_trips(spark):
    public, tokens = encoding()
    r = random.Random(6)
    atoms = ["a", "aa", "the", " ", "  ", "\n", "1", "é", "中", "😀", "'s", "...", "　", "\x85", "\x1c", "​", "\t"]
    texts = ["".join(r.choice(atoms) * r.randint(1, 5) for _ in range(r.randint(0, 30))) for _ in range(3000)]
    texts += [t or "" for t in ODD]
    codec = byte_bpe.Codec(byte_bpe.tokenizer_json(tokens, byte_bpe.PATTERN), byte_bpe.PATTERN)
    ids, at = codec.encode(pa.array(texts))
    raw, ends = codec.decode(ids, at)
    for i, t in enumerate(texts):
        assert ids[at[i]:at[i + 1]].tolist() == public.encode_ordinary(t)
        assert raw[ends[i]:ends[i + 1]].tobytes() == t.encode()
    ids, _ = codec.encode(pa.array(["😀中"]))
    raw, ends = codec.decode(ids, np.arange(len(ids) + 1))
    pieces = [raw[a:b].tobytes() for a, b in zip(ends, ends[1:])]
    assert len(pieces) > 2 and "".join(byte_bpe.decode_stream(iter(pieces))) == "😀中"
    got = byte_bpe.digests(odd_docs(spark)).collect()
    for row, t in zip(got, ODD):
        want = public.encode_ordinary(t or "")
        assert row["n_tokens"] == len(want)
        assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_bpe_offsets_and_decoding_tables(spark):
    docs = spark.createDataFrame([(1, "naïve 😀 text"), (2, None)], "doc_id long, text string")
    rows = byte_bpe.encode(docs, "doc_id", "text", with_offsets=True)
    first = rows.where("id = 1").head()
    pieces = ["naïve 😀 text"[a:b] for a, b in zip(first["starts"], first["ends"])]
    assert first["starts"][0] == 0 and first["ends"][-1] == 12 and " text" in pieces
    back = {r["id"]: r["text"] for r in byte_bpe.decode(rows).collect()}
    assert back == {1: "naïve 😀 text", 2: ""}


def test_licence_places_and_labels(spark):
    texts = ODD + [
        "Apache License mit license MIT-License", "GNU General Public License; cc by, CC BY-NC", "ccby gnu general public",
        "// SPDX-License-Identifier: (MIT OR GPL-3.0+) AND Apache-2.0 WITH LLVM-exception\ncode",
        "SPDX-License-Identifier: MIT AND", "cc cc by by"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row, text in zip(licences.scan(docs).orderBy("doc_id").collect(), texts):
        w = words(text)
        found = [(i, label) for p, label in licences.BASE_PHRASES.items() for i in range(len(w))
                 if w[i:i + len(p.split())] == p.split()]
        assert (row["n_words"], row["n_base"]) == (len(w), len(found))
        assert row["first_word"] == min((i for i, _ in found), default=None)
        assert row["last_word"] == max((i for i, _ in found), default=None)
        assert row["base_labels"] == ",".join(sorted({x for _, x in found}))
        assert set(row["base_labels"].split(",")) <= set(row["labels"].split(",")) | {""}
        assert 0 <= row["score"] <= 1
    tagged = licences.scan(docs).where(F.size("expressions") > 0).collect()
    assert [(r["labels"], r["allowed"]) for r in tagged] == [("apache,gpl,mit", True)]


def test_expressions():
    order = licences.postfix("mit or (gpl-2.0 with classpath-exception and bsd-3-clause)")
    assert order == ["mit", "gpl-2.0", "classpath-exception", "with", "bsd-3-clause", "and", "or"]
    assert licences.evaluate(order, frozenset({"bsd"})) == (False, {"mit", "gpl", "bsd"})
    assert licences.evaluate(order, frozenset({"bsd", "gpl"}))[0]
    for bad in ("", "mit or", "or mit", "(mit", "mit)", "mit gpl", "()", "mit (gpl)"):
        assert licences.postfix(bad) is None


def test_expressions_with_more_behind_them(spark):
    tag = "SPDX-License-Identifier: "
    cases = [(f"<!-- {tag}MIT -->", ["mit"], "mit"), (f"/* {tag}MIT*/ int x;", ["mit"], "mit"),
             (f"{tag}Apache-2.0 Copyright 2020 The Authors", ["apache-2.0"], "apache"), (f"{tag}MIT.", ["mit"], "mit"),
             (f"{tag}MIT-->", ["mit"], "mit"), (f"{tag}GPL-2.0+ and (see the file)", ["gpl-2.0+"], "gpl"),
             (f"({tag}(MIT OR ISC) AND BSD-3-Clause) text", ["mit isc or bsd-3-clause and"], "bsd,isc,mit"),
             (f"{tag}MIT {tag}ISC.\n{tag}BSD-2-Clause\r\n", ["mit", "isc", "bsd-2-clause"], "bsd,isc,mit"),
             (f"{tag}MIT OR", [], ""), (f"{tag}(MIT", [], ""), (f"{tag}-- MIT", [], ""), (tag, [], "")]
    docs = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "doc_id long, text string")
    got = [(r["expressions"], r["labels"]) for r in licences.scan(docs).orderBy("doc_id").collect()]
    assert got == [c[1:] for c in cases]


def test_toxicity_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{LARGER}/{t}.parquet") for t in ("documents", "labels"))
    got = entry.queries()["op8_toxicity"](spark, LARGER).join(labels, "doc_id").where("held_out").collect()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1
    score, toxic = np.array([r["score"] for r in got]), np.array([r["toxic"] == 1 for r in got])
    rank = score.argsort().argsort()
    area = (rank[toxic].sum() - toxic.sum() * (toxic.sum() - 1) / 2) / toxic.sum() / (~toxic).sum()
    assert area > 0.97 and (score[~toxic] >= 0.3).mean() < 0.02


def test_toxicity_equals_plain_ftrl(spark):
    r = random.Random(2)
    rows = [(" ".join(r.choice(["good", "bad", "foul", "day", "night", "words", "longerword"]) for _ in range(r.randint(1, 9))),
             int(r.random() < 0.4)) for _ in range(120)]
    rows = [(t, int("foul" in t or y == 1 and "bad" in t)) for t, y in rows]
    found = [toxicity.features(texts_of(pa.array([t])), Hasher())[0] for t, _ in rows]
    own = [sorted(set(f.tolist())) for f in found]
    count = {}
    for f in own:
        for x in f:
            count[x] = count.get(x, 0) + 1
    place = {x: i for i, x in enumerate(sorted(x for x, c in count.items() if c >= toxicity.SEEN))}
    packed = [(np.array([place[x] for x in f if x in place], np.int32).tobytes(), y, i) for i, (f, (_, y)) in enumerate(zip(own, rows))]
    turns = spark.createDataFrame([(bytearray(b), y, i) for b, y, i in packed], "f binary, y int, i int")
    order = [x["i"] for x in turns.orderBy(F.xxhash64("f", "y"), "i").collect()]
    z, n = {}, {}

    def weight(k):
        a, b = z.get(k, 0.0), n.get(k, 0.0)
        return 0.0 if abs(a) <= toxicity.L1 else -(a - math.copysign(toxicity.L1, a)) / ((toxicity.BETA + b ** 0.5) / toxicity.ALPHA + toxicity.L2)

    for _ in range(3):
        for i in order:
            keys = [x for x in own[i] if x in place] + ["intercept"]
            w = {k: weight(k) for k in keys}
            slope = 1 / (1 + math.exp(-sum(w.values()))) - rows[i][1]
            for k in keys:
                grown = n.get(k, 0.0) + slope * slope
                z[k] = z.get(k, 0.0) + slope - (grown ** 0.5 - n.get(k, 0.0) ** 0.5) / toxicity.ALPHA * w[k]
                n[k] = grown
    model = toxicity.train(spark.createDataFrame(rows, "text string, label int"), "text", "label", shards=1, rounds=3)
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    got = {x["doc_id"]: x["score"] for x in toxicity.score(docs, model).collect()}
    for i, f in enumerate(own):
        assert abs(got[i] - 1 / (1 + math.exp(-sum(weight(k) for k in f + ["intercept"] if k in place or k == "intercept")))) < 1e-5
    assert max(got.values()) > 0.8 > 0.2 > min(got.values())


def test_toxicity_of_empty_documents_beside_labels(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert toxicity.score(docs, toxicity.fit(docs, labels)).count() == 0


def test_toxicity_of_odd_texts_and_without_labels(spark):
    rows = [("good day to you", 0)] * 30 + [("bad foul day", 1)] * 30 + [(None, 1), ("", 0), ("x", None)]
    model = toxicity.train(spark.createDataFrame(rows, "text string, label int"), "text", "label")
    got = toxicity.score(odd_docs(spark), model)
    assert got.columns == ["doc_id", "score"] and got.count() == len(ODD)
    told = spark.createDataFrame([(1, "foul"), (2, "good")], "doc_id long, text string")
    by = {r["doc_id"]: r["score"] for r in toxicity.score(told, model).collect()}
    assert by[1] > by[2]
    none = toxicity.train(spark.createDataFrame([], "text string, label int"), "text", "label")
    assert {r["score"] for r in toxicity.score(told, none).collect()} == {0.0}


def test_toxicity_learns_rare_words_of_a_large_sample(spark):
    rows = [(f"good day number {i}", 0) for i in range(4000)] + [("bad foul day", 1)] * 200 + [("so vile", 1)] * 5
    model = toxicity.train(spark.createDataFrame(rows, "text string, label int"), "text", "label")
    told = spark.createDataFrame([(1, "vile"), (2, "unseen")], "doc_id long, text string")
    by = {r["doc_id"]: r["score"] for r in toxicity.score(told, model).collect()}
    assert by[1] > by[2] + 0.1


def test_toxicity_scores_do_not_depend_on_the_bounds_of_the_sample(spark):
    labels = spark.range(2000).selectExpr("id as doc_id", "cast(id % 20 = 0 as int) as toxic")
    # words say nothing of the label, so that only its share can be learned
    docs = labels.selectExpr("doc_id", "concat_ws(' ', *)".replace("*", ", ".join(
        f"'w' || pmod(xxhash64(doc_id, {k}), 40)" for k in range(6))) + " as text")
    for bounds in ({}, {"most_toxic": 50, "most_clean": 50}, {"most_clean": 200}):
        model = toxicity.fit(docs, labels, **bounds)
        scores = [r["score"] for r in toxicity.score(docs, model).collect()]
        assert 0.02 < np.mean(scores) < 0.1, bounds


def test_licences_and_bpe_of_empty_tables(spark, tmp_path):
    odd_docs(spark).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("op6_byte_bpe", "op7_licences"):
        assert entry.queries()[name](spark, str(tmp_path)).count() == 0


def test_texts_of_a_slice_stand_alone():
    column = pa.array(["a  b", "plain text", None, " c", "d"])
    for a, n in ((1, 2), (2, 3), (0, 5), (4, 1), (5, 0)):
        got, want = texts_of(column.slice(a, n)), texts_of(pa.array(column.slice(a, n).to_pylist(), pa.string()))
        assert got.data.tobytes() == want.data.tobytes() and got.at.tolist() == want.at.tolist()
        assert byte_bpe.plain_spaced(got).tolist() == [t not in ("a  b", " c") for t in column.slice(a, n).to_pylist()]
