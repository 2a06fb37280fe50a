import random
import re

import pyarrow as pa
import pytest
import xxhash

import corpus_pipeline
from leafmill.llm import copies, simhash


def brute_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or ({" ".join(w)} if w else set())


def brute_kept(ids, texts):
    sets = [brute_set(t) for t in texts]
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, d in enumerate(ids):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted(least.values())


def changed(r, text, n):
    w = text.split()
    for i in r.sample(range(len(w)), n):
        w[i] = f"new{r.randrange(10**6)}"
    return " ".join(w)


def mixed(r):
    """Copies near the bound on both sides, a crowd around one text, a crowd that holds no centre, and a common line."""
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(r.choices(words, k=r.randint(5, 150))) for _ in range(40)]
    texts = [changed(r, b, r.randint(1, min(4, len(b.split())))) for b in base for _ in range(3)] + base
    crowd = " ".join(r.choices(words, k=60))
    texts += [crowd] + [changed(r, crowd, 1) for _ in range(40)]
    other = " ".join(r.choices(words, k=90))
    texts += [changed(r, changed(r, other, 1), 1) for _ in range(40)]
    line = "this one line stands in very many of the documents here"
    texts += [f"{line} {' '.join(r.choices(words, k=r.randint(0, 12)))}" for _ in range(60)]
    return texts


@pytest.mark.parametrize("max_bucket", [2, 8, copies.MAX_BUCKET])
def test_stage_equals_brute_force(spark, docs, odd, max_bucket):
    texts = odd + mixed(random.Random(max_bucket))
    ids = [7 * i % 1009 for i in range(len(texts))]
    kept = copies.keep_first(docs(texts, ids, extra=True), max_bucket)
    assert kept.columns == docs([], extra=True).columns
    assert sorted(r.doc_id for r in kept.collect()) == brute_kept(ids, texts)


def test_pipeline_stage_finds_copies_beyond_three_bits(spark, docs, tiny):
    r = random.Random(3)
    texts = [" ".join(f"w{r.randrange(500)}" for _ in range(80)) for _ in range(6)]
    texts += [changed(r, t, 1) for t in texts]
    got = corpus_pipeline.near_duplicates(spark, docs(texts), tiny)
    assert sorted(x.doc_id for x in got.collect()) == list(range(6))


def test_sets_equal_brute_force():
    texts = ["", "a B c", "a b C", "one two three four five", "one two three four five six one two three four five", "x " * 50]
    h, bounds = copies.shingle_sets(pa.array(texts, pa.large_string()))
    assert [int(x) for x in bounds[1:] - bounds[:-1]] == [len(brute_set(t)) for t in texts]
    keys = copies.set_keys(h, bounds).tolist()
    assert [[x == y for x in keys] for y in keys] == [[brute_set(s) == brute_set(t) for s in texts] for t in texts]


def test_empty(docs):
    assert copies.keep_first(docs([])).collect() == []


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 5]).encode(), seed=42) for i in range(max(len(w) - 4, min(len(w), 1)))]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def brute_covered(texts):
    """Groups of texts that are linked by five or fewer differing bits of their fingerprints and a similarity of 0.8."""
    sets, fps, label = [brute_set(t) for t in texts], [brute_fingerprint(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 5 and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                label = [label[j] if x == label[i] else x for x in label]
    return label


def test_cover_leaves_out_any_five_bits():
    r, masks = random.Random(6), simhash.cover(list(range(64)), copies.RADIUS)
    assert copies.RADIUS == 5 and len(masks) == 63 and all(31 <= m.bit_count() <= 34 for m in masks)
    for _ in range(20_000):
        bits = sum(1 << b for b in r.sample(range(64), 5))
        assert any(not m & bits for m in masks)


def test_stage_links_by_covered_fingerprints(spark, docs, odd, tiny, monkeypatch):
    """What the stage keeps if nothing but fingerprints, covering and verification finds links."""
    texts = odd + mixed(random.Random(12))
    words = [f"w{i}" for i in range(300)]
    for k in range(20):
        long = " ".join(random.Random(k).choices(words, k=600))
        texts += [long] + [changed(random.Random(k), long, n) for n in (1, 2, 4)]
    monkeypatch.setattr(copies, "links", lambda documents, base, *more: spark.createDataFrame([], "a long, b long"))
    kept = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs(texts), tiny).collect())
    least = {}
    for i, x in enumerate(brute_covered(texts)):
        least.setdefault(x, i)
    assert kept == sorted(least.values()) and len(kept) < len({frozenset(brute_set(t)) for t in texts}) - 60


@pytest.mark.parametrize("max_bucket", [2, simhash.MAX_BUCKET])
def test_near_fingerprints_equal_brute_force(spark, max_bucket):
    r = random.Random(8)
    centre = r.getrandbits(64)
    fps = sorted({centre ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 4))) for _ in range(60)} | {r.getrandbits(64) for _ in range(200)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    with copies.scratch(spark, "leafmill") as own:
        got = [tuple(x) for x in copies.near_fingerprints(spark.createDataFrame([(f,) for f in signed], "fp long"), own, max_bucket).collect()]
    near = lambda most: {tuple(sorted((signed[i], signed[j]))) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= most}
    assert len(got) == len(set(got))
    # Pairs beyond three bits in large buckets are left to the prefixes.
    assert set(got) == near(5) if max_bucket > 2 else near(3) <= set(got) <= near(5)
