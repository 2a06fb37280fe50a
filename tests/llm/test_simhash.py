import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafmill.llm import copies, simhash


def brute_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def brute_components(ids, fps):
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [least.get(root(i)) for i in range(len(ids))]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aBcÄé \t\n.x0", max_size=120), max_size=6))
def test_fingerprints_equal_brute_force(texts):
    got = simhash.fingerprints(pa.array(texts, pa.large_string())).tolist()
    assert got == [brute_fingerprint(t) for t in texts]


def test_hash_equals_xxhash_at_every_length():
    data = np.frombuffer(random.Random(1).randbytes(400), dtype=np.uint8)
    start, end = np.zeros(200, np.int64) + 3, 3 + np.arange(200)
    assert simhash.xxh64(data, start, end).tolist() == [xxhash.xxh64_intdigest(data[3 : 3 + n].tobytes(), seed=42) for n in range(200)]


def test_fingerprint_of_more_shingles_than_a_packed_counter_holds():
    text = " ".join(random.Random(2).choice("abcdefgh") for _ in range(70_000))
    assert simhash.fingerprints(pa.array([text], pa.large_string())).tolist() == [brute_fingerprint(text)]


@pytest.mark.parametrize("size", [64, 31, 17, 16, 8])
def test_cover_leaves_out_any_three_bits(size):
    bits = random.Random(size).sample(range(64), size)
    masks = simhash.cover(bits)
    for a in bits:
        for b in bits:
            for c in bits:
                assert any(not m & (1 << a | 1 << b | 1 << c) for m in masks)


def test_components_equal_brute_force(spark, docs, odd):
    r = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta"]
    texts = odd[:-1] + [" ".join(r.choice(words) for _ in range(60)) for _ in range(20)]
    for _ in range(40):
        w = texts[r.randrange(9, len(texts))].split()
        w[r.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    ids = [None if i == 3 else 7 * i % 101 for i in range(len(texts))]
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.components(docs(texts, ids, extra=True)).collect()), key=str)
    fps = [brute_fingerprint(t) for t in texts]
    assert got == sorted(((i, f"{f:016x}", c) for i, f, c in zip(ids, fps, brute_components(ids, fps))), key=str)


def test_large_buckets_lose_no_link(spark):
    r = random.Random(9)
    centre = r.getrandbits(64)
    fps = {centre ^ sum(1 << b for b in r.sample(range(12), r.randint(0, 6))) ^ (1 << 60 if i % 5 == 0 else 0) for i in range(3000)} | {r.getrandbits(64) for _ in range(300)}
    fps = sorted(fps)
    assert len(fps) > 1200
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    got = {tuple(sorted((x.a, x.b))) for x in simhash.links(df).distinct().collect()}
    signed = np.array(fps, dtype=np.uint64)
    want = set()
    for i in range(len(signed)):
        for j in np.flatnonzero(np.bitwise_count(signed[i + 1 :] ^ signed[i]) <= 3) + i + 1:
            want.add(tuple(sorted((int(signed[i].astype(np.int64)), int(signed[j].astype(np.int64))))))
    assert got == want


def test_keep_first_keeps_one_of_each_group(spark, docs, odd):
    texts = odd[:-1] + ["same text here again", "other words stand in this one"]
    ids = [9, 8, 7, 6, 5, 4, 3, 3, 2, 10, 1]
    kept = simhash.keep_first(docs(texts, ids, extra=True))
    assert kept.columns == docs([], extra=True).columns
    groups = brute_components(ids, [brute_fingerprint(t) for t in texts])
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(groups))


def test_empty(docs):
    assert simhash.components(docs([])).collect() == []
    assert simhash.keep_first(docs([])).collect() == []


def test_long_chain_is_one_component(spark):
    nodes = random.Random(4).sample(range(10**6), 400)
    edges = spark.createDataFrame(list(zip(nodes, nodes[1:])) + [(-5, -3), (-3, -4)], "a long, b long")
    got = {r.node: r.label for r in simhash.label_components(edges).collect()}
    assert got == {n: min(nodes) for n in nodes} | {n: -5 for n in (-5, -4, -3)}


def test_exploded_rows_are_not_broadcast(spark):
    """Spark sizes exploded rows like those before them, so under its threshold a join of them would broadcast many times as much."""
    fps = spark.range(100).select(F.col("id").alias("fp"))
    rows = simhash.grouped(simhash.tables(fps, simhash.cover(list(range(64)), 5)), ["t", "key"])
    sets = spark.createDataFrame([(1, 2, [5, 6]), (2, 2, [5, 7])], "sid long, n long, first array<long>")
    met = copies._buckets(sets, spark.createDataFrame([], "node long, label long"))
    for df in (rows, simhash.pairs(rows, ["t", "key"], 5), copies._pairs(met.drop("label").withColumn("label", F.lit(None).cast("long")))):
        joins = [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x]
        assert any("SortMergeJoin" in x for x in joins)
        assert not [x for x in joins if "BroadcastHashJoin" in x and ("tok#" in x or "key#" in x)]
    assert {(r.tok, r.sid) for r in met.collect()} == {(5, 1), (5, 2)}
