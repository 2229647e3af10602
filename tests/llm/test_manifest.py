"""The Merkle manifest against a tree built by hand."""
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from pitspark.llm import merkle
from pitspark.llm.merkle import leaf_digest, manifest

SF = "/root/testdata/sf0.001"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_by_hand(*values):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def root_and_proofs(nodes):
    """(root, [(place among its run, run)] per node and level) of a list of digests."""
    at, steps, level = list(range(len(nodes))), [[] for _ in nodes], nodes
    while len(level) > 1:
        runs = [level[i:i + 2] for i in range(0, len(level), 2)]
        for k in range(len(nodes)):
            steps[k].append((at[k] % 2, runs[at[k] // 2]))
            at[k] //= 2
        level = [h(*r) for r in runs]
    return level[0], steps


def manifest_by_hand(docs):
    """{doc_id: columns} for rows (doc_id, source, lang, n_chars, text) with ids of their own."""
    leaf = {r[0]: leaf_by_hand(*r) for r in docs}
    langs = sorted({r[2] for r in docs}, key=lambda x: (x is not None, (x or "").encode()))
    groups = [sorted((r[0] for r in docs if r[2] == x), key=lambda i: (i is not None, i)) for x in langs]
    trees = [root_and_proofs([leaf[i] for i in g]) for g in groups]
    root, above = root_and_proofs([t[0] for t in trees])
    out = {}
    for k, (g, (subroot, steps)) in enumerate(zip(groups, trees)):
        for i, own in zip(g, steps):
            row = next(r for r in docs if r[0] == i)
            bent = i is not None and zlib.crc32(str(i).encode()) % 7 == 0 and row[3] is not None
            folded = leaf_by_hand(*row[:3], row[3] + 1, row[4]) if bent else leaf[i]
            path = own + above[k]
            for side, run in path:
                folded = h(*[folded if j == side else d for j, d in enumerate(run)])
            proof = h(*[d for side, run in path for j, d in enumerate(run) if j != side])
            out[i] = (leaf[i], subroot, root, proof, folded, folded == root)
    return out


def told(df):
    return {r["doc_id"]: (r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"], r["verified"])
            for r in df.collect()}


KIND = "doc_id long, source string, lang string, n_chars long, text string"
ODD = [(1, None, None, None, None), (2, "", "", 0, ""), (3, "ü-1", "é", -5, "a\x00b"), (7, "s", "z", 3, "x" * 200_000),
       (None, "s", "z", 4, "null id"), (9, "s", None, None, "t"), (14, "s", None, 2, "t")]


def written(spark, tmp_path, rows, kind=KIND, **more):
    df = spark.createDataFrame(rows, kind).withColumns({k: F.lit(v) for k, v in more.items()})
    df.write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 33, 70])
def test_query_equals_tree_by_hand(spark, tmp_path, monkeypatch, n):
    monkeypatch.setattr(manifest, "__defaults__", ("leaf", None, 2, False))     # small blocks: several layers
    rows = [(i * 3, f"s{i % 4}", None if i % 5 == 0 else "abcdefg"[i % 7 % (1 + n // 3)], i, f"text {i}") for i in range(n)]
    df = merkle.op12_merkle(spark, written(spark, tmp_path, rows))
    got, want = told(df), manifest_by_hand(rows)
    assert df.count() == n and got == want
    assert n < 30 or {v[-1] for v in got.values()} == {True, False}


def test_odd_rows_and_clashing_names(spark, tmp_path):
    sf = written(spark, tmp_path, ODD, g=1, pos="x", digest=2.0, block="b", leaf="c", suffix=None, bent=1, turn=3, n=4)
    assert told(merkle.op12_merkle(spark, sf)) == manifest_by_hand(ODD)


def test_repeated_rows_and_empty_table(spark, tmp_path):
    rows = [(5, "s", "en", 1, "same")] * 300 + [(6, "s", "en", 1, "other")] * 3 + [(6, "s", "en", 2, "another")]
    got = merkle.op12_merkle(spark, written(spark, tmp_path, rows)).collect()
    leaves = [leaf_by_hand(*r) for r in rows]
    leaves = leaves[:300] + sorted(leaves[300:])
    root, _ = root_and_proofs(leaves)
    assert len(got) == 304 and {r["root"] for r in got} == {root}
    assert all(r["verified"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 != 0) for r in got)
    empty = spark.createDataFrame([], KIND).select("doc_id", "lang", leaf_digest(F.col("text")).alias("leaf"))
    assert manifest(empty, "doc_id", "lang").count() == 0


def test_proofs_fold_to_the_root(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    leaves = docs.select("doc_id", "lang", leaf_digest(F.col("doc_id"), F.col("text")).alias("leaf"))
    for r in manifest(leaves, "doc_id", "lang", bits=3, proofs=True).collect():
        assert merkle.fold(r["leaf"], r["proof"]) == r["root"] == r["folded_root"]
        assert merkle.fold(h("other"), r["proof"]) != r["root"]
