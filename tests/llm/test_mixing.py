import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.llm import mixing
from leafmill.llm.common import table


def skewed(spark, seed=3):
    """Cells in which one source has a third of the tokens and some categories have very few."""
    r = random.Random(seed)
    rows = []
    for s in range(24):
        for lang in ("en", "de", "fr", None):
            for t in range(5):
                n = r.randint(0, 400) * (40 if s == 0 else 1) // (9 if lang is None else 1) // (1 + 3 * (t == 4))
                rows.append((f"s{s}" if s < 23 else None, lang, t, n))
    return spark.createDataFrame(rows, "source string, lang string, topic long, tokens long")


def margins(rows, dim, weight):
    out = {}
    for r in rows:
        out[r[dim]] = out.get(r[dim], 0.0) + r.tokens * weight(r)
    return out


@pytest.mark.parametrize("targets", [mixing.Targets(), mixing.Targets({"lang": {"en": 0.3, "de": 0.4, "fr": 0.25, None: 0.05}}, 0.7, 0.3), mixing.Targets({"topic": {0: 0.2, 1: 0.2, 2: 0.2, 3: 0.35, 4: 0.05}, "source": {"s1": 0.1, "s0": 0.2} | {f"s{k}": 0.7 / 22 for k in range(2, 23)}}, 0.5, 0.25)])
def test_expected_tokens_meet_every_marginal(spark, targets):
    cells = skewed(spark)
    by, raked = mixing.chances(cells, targets)
    found = {(r.source, r.lang, r.topic): r for r in by.collect()}
    rows = cells.collect()
    total = sum(r.tokens for r in rows)
    chance = lambda r: found[r.source, r.lang, r.topic].chance
    assert raked.step == 0 and len(found) == len(rows) and all(0 <= r.chance <= 1 for r in found.values())
    for dim in mixing.DIMS:
        held = margins(rows, dim, lambda r: 1.0)
        names = [k for k in held if held[k] > 0]
        shares = mixing.wanted_shares(held, dim, targets)
        goal = mixing.within_reach(np.array([shares[k] * targets.budget * total for k in names]), np.array([held[k] for k in names]), max(mixing.REACH, targets.budget))
        got = margins(rows, dim, chance)
        for k, want in zip(names, goal):
            assert got[k] == pytest.approx(want, rel=1e-3, abs=1e-6 * total), (dim, k)


def test_chances_have_one_factor_for_each_category(spark):
    """The chances that are not cut at 1 are products of three factors, and those that are have products of 1 or more: this and the marginals single out one solution."""
    cells = skewed(spark)
    by, _ = mixing.chances(cells, mixing.Targets())
    rows = [r for r in by.collect() if r.weight > 0]
    columns = {k: i for i, k in enumerate(dict.fromkeys((d, r[d]) for r in rows for d in mixing.DIMS))}
    a = np.zeros((len(rows), len(columns)))
    for i, r in enumerate(rows):
        for d in mixing.DIMS:
            a[i, columns[d, r[d]]] = 1
    y = np.log([r.weight for r in rows])
    assert np.abs(a @ np.linalg.lstsq(a, y, rcond=None)[0] - y).max() < 1e-8
    assert all(r.chance == min(1.0, r.weight) for r in rows)


def test_shares_that_contradict_each_other_move_to_the_corpus_own(spark):
    # Language and topic are the same thing twice, and are asked for different shares.
    rows = [(f"s{s}", "en" if t else "de", t, 100) for s in range(4) for t in (0, 1)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic long, tokens long")
    targets = mixing.Targets({"lang": {"en": 0.8, "de": 0.2}, "topic": {0: 0.7, 1: 0.3}}, budget=0.5)
    by, raked = mixing.chances(cells, targets)
    assert 0.5 < raked.step <= 1 and raked.gap < mixing.TOLERANCE
    told = {(r.dimension, r.category): r for r in mixing.report(cells, targets, by).collect()}
    assert told["lang", "en"].wanted == pytest.approx(0.8) and told["lang", "en"].expected == pytest.approx(0.5, abs=0.1) and told["lang", "en"].held == 0.5
    assert sum(r.expected for (d, _), r in told.items() if d == "topic") == pytest.approx(1)


def test_packs_on_executors_give_the_same(spark):
    cells = skewed(spark, 5)
    targets = mixing.Targets(flatten=0.8, budget=0.2)
    (a, x), (b, y) = ((mixing.chances(cells, targets, most)) for most in (10_000, 0))
    a, b = ({(r.source, r.lang, r.topic): r.chance for r in f.collect()} for f in (a, b))
    assert x.step == y.step and a.keys() == b.keys()
    assert all(a[k] == pytest.approx(b[k], rel=1e-9, abs=1e-12) for k in a)


def test_sample_meets_targets_and_decides_by_hash(spark, small):
    documents = table(spark, small, "documents")
    targets = mixing.Targets({"lang": {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}}, budget=0.2)
    rows = mixing.sample(documents, targets, keep=["doc_id", "lang"]).collect()
    total, expected = sum(r._lm_tokens for r in rows), {}
    for r in rows:
        expected[r.lang] = expected.get(r.lang, 0) + r._lm_tokens * r._lm_chance
    assert len(rows) == documents.count()
    assert {k: v / (0.2 * total) for k, v in expected.items()} == pytest.approx({"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}, rel=1e-3)
    u = {r.doc_id: r.u for r in documents.select("doc_id", mixing.uniform(F.col("doc_id"), F.col("text")).alias("u")).collect()}
    assert all(r._lm_sampled == (u[r.doc_id] < r._lm_chance) for r in rows)
    assert 0.15 * total < sum(r._lm_tokens for r in rows if r._lm_sampled) < 0.25 * total
    texts = {r.doc_id: r.text for r in documents.collect()}
    words = {i: len(__import__("re").findall(r"[0-9a-z\x80-\U0010ffff]+", __import__("re").sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for i, t in texts.items()}
    assert all(r._lm_tokens == words[r.doc_id] for r in rows)
    kept = {r.doc_id for r in mixing.mix(documents, targets).collect()}
    assert kept == {r.doc_id for r in rows if r._lm_sampled}


def test_topics_do_not_hang_on_partitions(spark, tiny):
    documents = table(spark, tiny, "documents")
    got = [sorted((r.doc_id, r._lm_topic, r._lm_chance) for r in mixing.sample(documents.repartition(k), keep=["doc_id"]).collect()) for k in (1, 5)]
    assert [x[:2] for x in got[0]] == [x[:2] for x in got[1]] and np.allclose([x[2] for x in got[0]], [x[2] for x in got[1]])


def test_odd_tables(docs, odd):
    df = docs(odd, lang=None, source=None, extra=True)
    got = mixing.sample(df)
    assert got.count() == len(odd) and got.columns[: len(df.columns)] == df.columns
    assert {r.doc_id for r in got.where("_lm_tokens = 0 AND _lm_chance = 1").collect()} == {0, 1, 2}
    assert mixing.mix(df).columns == df.columns
    assert mixing.sample(docs([])).collect() == [] and mixing.mix(docs([])).collect() == []
