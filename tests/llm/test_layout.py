"""Shards, training-order files and the pipeline."""
import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pitspark.llm import byte_bpe, language, materialise, shards, suffixes
from pitspark.session import durable, folder
from tests.llm.test_groups import repeats_by_hand, shared_by_hand
from tests.llm.test_texts import ODD, odd_docs

SF = "/root/testdata/sf0.001"


def test_permutation():
    for n in (1, 2, 3, 5, 64, 1000, 4097):
        slot = materialise.slot_of(np.arange(n), n, 7)
        assert sorted(slot.tolist()) == list(range(n))
        assert (materialise.sequence_of(slot, n, 7) == np.arange(n)).all()
    assert (materialise.slot_of(np.arange(1000), 1000, 7) != materialise.slot_of(np.arange(1000), 1000, 8)).mean() > 0.9


def test_shards_hold_the_stream(spark):
    docs = durable(spark.read.parquet(f"{SF}/documents.parquet").repartition(5))
    path = folder(spark)
    layout = materialise.write(docs, path, length=100, per_shard=64)
    rows = materialise.read(spark, path, layout).collect()
    assert sorted(r["slot"] for r in rows) == list(range(layout.sequences))
    assert all(layout.locate(r["slot"]) == (r["shard"], r["at"]) for r in rows)
    stream = b"".join(bytes(r["ids"]) for r in sorted(rows, key=lambda r: r["sequence"]))
    texts = [(r["text"] or "").encode() for r in docs.collect()]
    assert stream.rstrip(b"\xff") == b"\xff".join(texts).rstrip(b"\xff")
    places = {r["doc_id"]: r for r in materialise.index(docs, length=100).collect()}
    for r in docs.collect():
        p = places[r["doc_id"]]
        assert stream[p["start"]:p["start"] + p["n_ids"]] == r["text"].encode() + b"\xff"
    late = materialise.read(spark, path, layout, first_slot=100)
    assert late.count() == layout.sequences - 100 and late.agg(F.min("shard")).head()[0] == 1


@pytest.mark.parametrize("width, end", [(2, 65_535), (4, 1_000_000)])
def test_shards_of_token_ids(spark, width, end):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    encoded = durable(byte_bpe.encode(docs, "doc_id", "text").repartition(3))
    path = folder(spark)
    layout = materialise.write(encoded, path, "ids", length=100, per_shard=64, width=width, end=end)
    records = materialise.read(spark, path, layout)
    rows = materialise.unpacked(records, layout).collect()
    assert layout.stride == 100 * width + 1 and sorted(r["slot"] for r in rows) == list(range(layout.sequences))
    assert all(layout.locate(r["slot"]) == (r["shard"], r["at"]) and len(r["ids"]) == 100 for r in rows)
    stream = np.concatenate([r["ids"] for r in sorted(rows, key=lambda r: r["sequence"])])
    want = {r["id"]: r["ids"] for r in encoded.collect()}
    tokens = byte_bpe.read_ranks(byte_bpe.RANKS)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    places = materialise.index(encoded, "id", "ids", length=100).collect()
    assert len(places) == len(want)
    for p in places:
        ids = stream[p["start"]:p["start"] + p["n_ids"]].tolist()
        assert ids == want[p["id"]] + [end]
        assert b"".join(tokens[i] for i in ids[:-1]).decode() == texts[p["id"]]
    used = sum(p["n_ids"] for p in places)
    assert (stream[used:] == end).all() and len(stream) - used < 100


def test_shards_of_odd_token_ids(spark):
    data = [(1, [1, 2, 3]), (None, None), (2, []), (1, [1, 2, 3]), (3, list(range(2000)))]
    docs = durable(spark.createDataFrame(data, "doc_id long, ids array<int>").coalesce(1))
    path = folder(spark)
    layout = materialise.write(docs, path, "ids", length=7, per_shard=16, width=2, end=9999)
    rows = materialise.unpacked(materialise.read(spark, path, layout), layout).collect()
    stream = [i for r in sorted(rows, key=lambda r: r["sequence"]) for i in r["ids"]]
    places = materialise.index(docs, "doc_id", "ids", length=7).collect()
    got = sorted((p["doc_id"] or 0, stream[p["start"]:p["start"] + p["n_ids"]]) for p in places)
    assert got == sorted((i or 0, (ids or []) + [9999]) for i, ids in data)
    assert materialise.write(docs.limit(0), folder(spark), "ids", width=2, end=9999).shards == 0
    for ids in ([1, None], [-1], [9999], [70_000]):
        bad = durable(spark.createDataFrame([(1, ids)], "doc_id long, ids array<int>"))
        with pytest.raises(Exception, match="token id"):
            materialise.write(bad, folder(spark), "ids", width=2, end=9999)
    for width, end in ((3, 300), (1, 256), (2, 65_536), (2, 7)):
        with pytest.raises(ValueError):
            materialise.write(docs, folder(spark), "ids", width=width, end=end)


def test_shards_of_odd_rows(spark):
    path = folder(spark)
    docs = durable(odd_docs(spark).coalesce(2))
    layout = materialise.write(docs, path)
    rows = materialise.read(spark, path, layout).collect()
    stream = b"".join(bytes(r["ids"]) for r in sorted(rows, key=lambda r: r["sequence"]))
    assert stream.rstrip(b"\xff").count(b"\xff") >= len([t for t in ODD if t is not None]) - 1
    assert materialise.write(docs.limit(0), folder(spark)).shards == 0


def test_index_of_odd_rows(spark):
    docs = durable(odd_docs(spark).coalesce(1))
    rows = sorted(materialise.index(docs, length=100).collect(), key=lambda r: r["start"])
    assert len(rows) == len(ODD) and rows[0]["start"] == 0
    assert all(a["start"] + a["n_ids"] == b["start"] for a, b in zip(rows, rows[1:]))
    assert sorted(r["n_ids"] for r in rows) == sorted(len((t or "").encode()) + 1 for t in ODD)
    assert all(r["first_sequence"] == r["start"] // 100 and r["last_sequence"] == (r["start"] + r["n_ids"] - 1) // 100 for r in rows)
    assert materialise.index(docs.limit(0)).count() == 0


def test_shards_of_clashing_names_and_hot_ties(spark):
    rows = [(None, "same", 1)] * 500 + [(5, "same", 1)] * 500 + [(i, f"text {i}" * (i % 9), 2) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int").withColumns(
        {c: F.lit(7) for c in ("slot", "size", "_tie", "_part", "_w", "_node", "_range", "_row")})
    got = shards.assign(docs, {"size": F.octet_length("text"), "id": F.col("doc_id")}, shards=4).collect()
    assert len(got) == 1400
    for s in range(4):
        own = [r["slot"] for r in got if r["shard"] == s]
        assert own and sorted(own) == list(range(len(own)))


def tree_by_hand(rows, shards_):
    """rows: (dims, tie, weight). Exact weighted-median k-d tree; leaves from left to right."""
    total = sum(r[-1] for r in rows)
    whole = [max(r[0][d] for r in rows) - min(r[0][d] for r in rows) for d in range(len(rows[0][0]))]

    def split(part):
        weight = sum(r[-1] for r in part)
        if weight <= 1.5 * total / shards_ or len(part) < 2:
            return [part]
        spread = [(max(r[0][d] for r in part) - min(r[0][d] for r in part)) / max(1, whole[d]) for d in range(len(whole))]
        d = max(range(len(whole)), key=lambda d: (spread[d], -d))
        part = sorted(part, key=lambda r: (r[0][d], r[1]))
        best, upto = None, 0
        for i, r in enumerate(part[:-1]):
            upto += r[-1]
            if best is None or abs(upto - weight / 2) <= best[0]:
                best = (abs(upto - weight / 2), i + 1)
        return split(part[:best[1]]) + split(part[best[1]:])

    return split(rows)


def test_tree_equals_brute_force(spark):
    r = np.random.default_rng(3)
    data = [(i, "t%d" % i * int(r.integers(1, 60)), int(r.integers(0, 6)), int(r.integers(0, 1000))) for i in range(300)]
    docs = spark.createDataFrame(data, "doc_id long, text string, a long, b long")
    got = shards.assign(docs, {"a": F.col("a"), "b": F.col("b")}, bins=5, exact_share=0.0)
    where = {x["doc_id"]: x["shard"] for x in got.collect()}
    tie = {x["doc_id"]: x["h"] for x in docs.select("doc_id", F.shiftrightunsigned(F.xxhash64("text"), 1).alias("h")).collect()}
    leaves = tree_by_hand([((a, b), (tie[i], i), len(t) + 1) for i, t, a, b in data], 8)
    weights = [sum(x[-1] for x in leaf) for leaf in leaves]
    own = [sum(len(t) + 1 for i, t, _, _ in data if where[i] == s) for s in range(8)]
    assert len(leaves) == 8 and own == weights
    assert all({where[x[1][1]] for x in leaf} == {s} for s, leaf in enumerate(leaves))


def test_shard_contract(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    copies = docs.limit(1).drop("doc_id").crossJoin(spark.range(50_000, 50_700).withColumnRenamed("id", "doc_id")).select(docs.columns)
    docs = docs.unionByName(copies).unionByName(odd_docs(spark).select(docs.columns[:1] + ["text", "lang", "source"])
                                                .withColumn("n_chars", F.lit(0).cast("long")).where("length(text) < 999 or text is null"))
    dims = {"size": F.octet_length("text"), "doc_id": F.col("doc_id")}
    rows = shards.assign(docs, dims).collect()
    assert len(rows) == docs.count()
    size = [sum(r["size"] for r in rows if r["shard"] == s) for s in range(8)]
    assert max(size) < 1.1 * min(size)
    for s in range(8):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    for r in docs.collect()[:50]:
        raw = (r["text"] or "").encode()
        assert any(x["size"] == len(raw) + 1 and x["text_crc32"] == zlib.crc32(raw) for x in rows if x["doc_id"] == r["doc_id"])
    few = [r for r in shards.assign(docs.where("doc_id < 1000"), dims).collect()]
    by = {}
    for r in few:
        by.setdefault((r["text_crc32"], r["size"]), set()).add(r["shard"])
    assert all(len(x) == 1 for x in by.values())
    assert shards.assign(docs.limit(0), dims).count() == 0


@pytest.mark.parametrize("n", [1, 3, 5, 6, 12])
def test_any_number_of_shards(spark, n):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    dims = {"size": F.octet_length("text"), "doc_id": F.col("doc_id")}
    size = {r["shard"]: r["w"] for r in shards.assign(docs, dims, shards=n).groupBy("shard").agg(F.sum("size").alias("w")).collect()}
    assert sorted(size) == list(range(n)) and max(size.values()) < 1.1 * min(size.values())


def test_pipeline_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    told = durable(corpus_pipeline.tell_language(spark, docs, SF))
    assert told.columns == docs.columns and told.count() == docs.count()
    kept = durable(corpus_pipeline.drop_near_duplicates(spark, told, SF))
    assert len({r["text"] for r in kept.collect()}) == kept.count() < told.count()
    cut = durable(corpus_pipeline.cut_repeats(spark, kept, SF))
    want = repeats_by_hand([(r["doc_id"], r["text"].encode()) for r in kept.collect()], 100)
    for r in cut.collect():
        assert len(r["text"].encode()) <= want[r["doc_id"]][0] - want[r["doc_id"]][1] and r["n_chars"] == len(r["text"])
    clean = durable(corpus_pipeline.drop_contaminated(spark, cut, SF))
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in cut.collect() if not shared_by_hand(r["text"], items)[-1]}
    done = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert {r["doc_id"]: hashlib.sha256(r["text"].encode()).hexdigest() for r in clean.collect()} == \
        {i: r["decoded_sha256"] for i, r in done.items()}


def test_pipeline_on_odd_rows(spark):
    docs = odd_docs(spark).withColumn("n_chars", F.length("text").cast("long"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = durable(stage(spark, docs, SF))
        assert docs.columns == columns
    assert docs.where("text is null").count() == 0
    empty = odd_docs(spark).withColumn("n_chars", F.lit(1).cast("long")).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = durable(stage(spark, empty, SF))
    assert empty.count() == 0


def test_training_sample_leaves_out_held_out_rows(spark):
    rows = spark.range(2000).select("id", language.held_out(F.col("id")).alias("h")).collect()
    assert [r["h"] for r in rows] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in range(2000)]
