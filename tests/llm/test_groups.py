"""Near duplicates, repeated bytes, embeddings and decontamination against brute force."""
import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from checks.compare import compare, connect
from pitspark.llm import decontaminate, embeddings, minhash, suffixes
from pitspark.llm.graph import components
from pitspark.llm.registry import ORACLES, QUERIES
from pitspark.llm.words import Hasher, texts_of
from tests.llm.test_texts import ODD, odd_docs, words

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    ok, note = compare(spark, connect(SF), QUERIES[name], ORACLES[name], SF)
    assert ok, note


def roots(pairs, nodes):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_components(spark):
    r = random.Random(3)
    pairs = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)]
    pairs += [(1000, i) for i in range(1001, 1100)]
    got = components(spark.createDataFrame([*pairs, (7, None)], "a long, b long"), "a", "b").collect()
    want = {n: t for n, t in roots(pairs, {x for p in pairs for x in p}).items() if n != t}
    assert {r["node"]: r["root"] for r in got} == want and len(got) == len(want)


def weighted_jaccard(a, b, idf):
    def vector(text):
        w = words(text)
        grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else [])
        out = {}
        for g in grams:
            out[g] = out.get(g, 0) + round(sum(idf(x) for x in g) / len(g), 4)
        return out

    x, y = vector(a), vector(b)
    low = sum(min(x[g], y[g]) for g in x.keys() & y.keys())
    whole = sum(x.values()) + sum(y.values()) - low
    return low / whole if whole else 0.0


def planted(r, n=40):
    """Texts with near and exact copies of some, and one passage that many share."""
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [r.choice(vocabulary) for _ in range(40)]
    texts = []
    for i in range(n):
        base = [r.choice(vocabulary) for _ in range(r.randint(20, 160))]
        if i % 3 == 0:
            base[5:5] = passage
        texts.append(" ".join(base))
        for _ in range(r.choice([0, 0, 1, 3])):
            copy = list(base)
            for _ in range(r.randint(0, 3)):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            texts.append(" ".join(copy))
    r.shuffle(texts)
    return texts


def test_near_duplicates_equal_brute_force(spark):
    texts = planted(random.Random(11))
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, class_id int")
    idf_cells = minhash.document_frequencies(docs)
    hasher = Hasher()

    def idf(word):
        data = np.frombuffer(word.encode(), np.uint8)
        code = hasher.ranges(hasher.sums(data), np.array([0]), np.array([len(data)]))
        return float(idf_cells[int(code[0] >> np.uint64(64 - minhash.DF_BITS))])

    alike = {(i, j): weighted_jaccard(texts[i], texts[j], idf) for i in range(len(texts)) for j in range(i + 1, len(texts))}
    some = list(alike)[::37]
    left, right = (texts_of(pa.array([texts[p[k]] for p in some])) for k in (0, 1))
    got = minhash.similarities(left, right, hasher, idf_cells, 5)
    assert np.allclose(got, [alike[p] for p in some])
    want = roots([p for p, s in alike.items() if s >= 0.8], range(len(texts)))
    assert {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs, block=8).collect()} == want
    kept = minhash.one_of_each(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(want.values())


def test_samples_agree_as_often_as_texts_are_alike():
    r = np.random.default_rng(5)
    code = np.sort(r.integers(1, 1 << 62, 300, dtype=np.uint64))
    one, two = r.random(300) * 5 + 0.1, r.random(300) * 5 + 0.1
    sampler = minhash.Sampler(4000, seed=9)
    ends = np.array([0, 300])
    agree = (sampler.draw(code, one, ends) == sampler.draw(code, two, ends)).mean()
    assert abs(agree - np.minimum(one, two).sum() / np.maximum(one, two).sum()) < 0.04


def test_near_duplicates_of_odd_rows(spark):
    got = minhash.near_duplicates(odd_docs(spark)).collect()
    assert len(got) == len(ODD)
    assert sum(r["class_id"] == 4 and r["doc_id"] == 4 for r in got) == 2      # equal rows
    assert all(r["kept"] for r in got)
    assert minhash.one_of_each(odd_docs(spark)).count() == len(ODD) - 1
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(empty).count() == 0


def repeats_by_hand(docs, length):
    """docs: (order key, text bytes); same key is one document."""
    seen, out = {}, {}
    for key, text in sorted(docs):
        gone = bytearray(len(text))
        for p in range(len(text) - length + 1):
            if seen.setdefault(text[p:p + length], (key, p)) != (key, p):
                gone[p:p + length] = b"\1" * length
        runs = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(gone)))
        out[key] = (len(text), sum(gone), runs, hashlib.sha256(bytes(t for t, g in zip(text, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("length, gram, chunk, hot", [(20, 6, 1 << 21, 1 << 16), (20, 20, 64, 3), (12, 3, 50, 1)])
def test_repeated_bytes_equal_brute_force(spark, monkeypatch, length, gram, chunk, hot):
    r = random.Random(length + gram)
    passages = ["".join(r.choice("abcé ") for _ in range(r.randint(10, 70))) for _ in range(12)]
    texts = ["".join(r.choice(passages) if r.random() < 0.4 else "".join(r.choice("xyzß") for _ in range(9))
                     for _ in range(r.randint(0, 14))) for _ in range(60)] + ["a" * 90, "a" * 40, ""]
    monkeypatch.setattr(suffixes, "CHUNK", chunk)
    monkeypatch.setattr(suffixes, "HELD_ANCHORS", 50)
    monkeypatch.setattr(suffixes, "HELD_SUFFIXES", 40)
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, k int").repartition(5)
    got = {r["doc_id"]: tuple(r)[1:] for r in suffixes.dedup(docs, length=length, gram=gram, hot=hot).collect()}
    assert got == repeats_by_hand([(i, t.encode()) for i, t in enumerate(texts)], length)


def test_a_frequent_notice_fills_no_range(spark):
    """A notice shorter than a repeat, in a third of the documents with other text around it: 10 anchors in 500 places."""
    r = random.Random(8)
    notice = "".join(r.choice("NOTICE ") for _ in range(66))

    def noise(n):
        return "".join(r.choice("abcdefghijklmnop ") for _ in range(n))

    texts = [noise(150) + (notice if i % 3 == 0 else "") + noise(150) + (notice + noise(50)) * (i % 90 == 0) for i in range(1500)]
    texts += [texts[3], texts[0][100:300] + noise(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: tuple(x)[1:] for x in suffixes.dedup(docs, hot=100).collect()}
    assert got == repeats_by_hand([(i, t.encode()) for i, t in enumerate(texts)], 100)
    rows = suffixes._prepared(docs, "doc_id", "text", [])
    found = suffixes.repeated_anchors(rows, 100, 32, 8, 100).cache()
    hot = suffixes.hot_anchors(found, 100)
    assert 1 <= len(hot) <= 66
    runs = suffixes.sorted_runs(rows.join(suffixes.places_by_key(found, 8), "k"), [], 100, 32, hot).collect()
    sizes = [len(x["facts"]) // suffixes.FACTS.itemsize for x in runs if x["range"] >= 0]
    assert sum(sizes) < 1500 and sum(x["range"] == suffixes.WINDOW for x in runs) > 10_000


def test_repeats_in_odd_rows(spark):
    docs = odd_docs(spark)
    got = suffixes.dedup(docs).collect()
    assert len(got) == len(ODD)
    by = {(r["doc_id"], r["n_bytes"]): r for r in got}
    assert by[None, 80_000]["n_removed"] == 80_000 - 2 and by[9, 300_000]["n_removed"] == 300_000 - 1
    left = suffixes.without_repeats(docs)
    assert left.columns == docs.columns and left.dtypes == docs.dtypes
    texts = {r["doc_id"]: r["text"] for r in left.collect()}
    assert texts[0] is None and texts[1] == "" and texts[9] == "x" and texts[None] == "w "
    assert suffixes.dedup(docs.limit(0)).count() == 0


def test_loser_tree_merges_and_knows_prefixes():
    r = random.Random(2)
    runs = []
    for _ in range(r.randint(5, 9)):
        strings = sorted("".join(r.choice("ab") for _ in range(r.randint(0, 9))).encode() for _ in range(r.randint(0, 40)))
        coded = suffixes.front_code(strings)
        assert suffixes.front_decode(*coded) == strings
        runs.append((strings, coded[0]))
    order, shared = suffixes.merge_runs(runs)
    merged = [runs[i][0][j] for i, j in order]
    assert merged == sorted(s for x, _ in runs for s in x)
    assert shared[1:] == [suffixes.common_prefix(a, b, 0) for a, b in zip(merged, merged[1:])]


def vectors():
    r = np.random.default_rng(4)
    centres = r.normal(size=(12, 24))
    rows = []
    for i in range(400):
        c = centres[r.integers(12)] + r.normal(size=24) * r.choice([0.02, 0.05, 0.3])
        rows.append([float(x) for x in c])
    rows += [rows[3]] * 5 + [[2 * x for x in rows[8]]]
    return [(i, v, int(i % 3)) for i, v in enumerate(rows)]


@pytest.mark.parametrize("block", [16, 1024])
def test_embeddings_equal_brute_force(spark, block):
    rows = vectors()
    odd = [(900, None, 1), (901, [], 1), (902, [0.0] * 24, 1), (903, [math.nan] + [1.0] * 23, 1),
           (904, [None] + [1.0] * 23, 1), (905, rows[0][1], None), (906, [1.0, 2.0], 0), (907, [math.inf] * 24, 1),
           (None, rows[0][1], 0)]
    frame = spark.createDataFrame([(*r, "x") for r in rows + odd],
                                  "vec_id long, embedding array<double>, label int, component_id string")
    got = {r["vec_id"]: r for r in embeddings.link(frame, block=block).collect()}
    assert len(got) == len(rows) + len(odd)
    x = np.array([v for _, v, _ in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([c for _, _, c in rows])
    near = (x @ x.T >= 0.98) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    want = roots(list(zip(*np.nonzero(near))), range(len(rows)))
    assert [got[i]["n_links"] for i in range(len(rows))] == near.sum(1).tolist()
    assert [got[i]["component_id"] for i in range(len(rows))] == [want[i] for i in range(len(rows))]
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in range(900, 908))
    assert got[None]["component_id"] is None and not got[None]["kept"]
    assert embeddings.link(frame.limit(0)).count() == 0


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(1).normal(size=(5, 16))
    y = embeddings.hadamard(x)
    assert np.allclose(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)) and np.allclose(embeddings.hadamard(y), x)


def shared_by_hand(text, items, window=10):
    w, hit, named = words(text), set(), set()
    for name, item in items:
        v = words(item)
        n = min(window, len(v))
        grams = {tuple(v[i:i + n]) for i in range(len(v) - n + 1)} if n else set()
        for i in range(len(w) - n + 1 if n else 0):
            if tuple(w[i:i + n]) in grams:
                hit |= set(range(i, i + n))
                named.add(str(name if name is not None else ""))
    return len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)


def test_contamination_equals_brute_force(spark):
    r = random.Random(8)
    vocabulary = "abcdefgh"
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice([0, 1, 2, 5, 7, 9, 10, 11, 30])))) for i in range(30)]
    items = [(i, t) for i, t in items if len(t) != 1] + [(40, None), (None, "a b c d e f"), (41, items[3][1]), (3, "h h h h h")]
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.randint(0, 60))) for _ in range(60)]
    texts += [t or "" for t in ODD] + [f"{items[k][1]} X {items[k + 1][1]}" for k in range(10)]
    docs = spark.createDataFrame([(i, t or None, 0) for i, t in enumerate(texts)], "doc_id long, text string, uid int")
    bench = spark.createDataFrame([(*i, 5) for i in items], "item_id long, text string, n int")
    got = {r["doc_id"]: tuple(r)[1:] for r in decontaminate.report(docs, bench).collect()}
    assert got == {i: shared_by_hand(t, items) for i, t in enumerate(texts)}
    clean = decontaminate.clean(docs, bench)
    assert clean.columns == docs.columns
    assert {r["doc_id"] for r in clean.collect()} == {i for i, x in got.items() if not x[-1]}


def test_contamination_of_empty_tables(spark):
    docs = odd_docs(spark)
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontaminate.report(docs, none).collect()
    assert len(got) == len(ODD) and not any(r["contaminated"] for r in got)
    bench = spark.createDataFrame([(1, "w w w w w w w w w w w")], "item_id long, text string")
    assert decontaminate.report(docs.limit(0), bench).count() == 0
    hit = [r for r in decontaminate.report(docs, bench).collect() if r["contaminated"]]
    assert [(r["doc_id"], r["n_hit"]) for r in hit] == [(None, 40_000)]
