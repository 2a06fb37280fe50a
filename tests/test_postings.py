import math
import random

import pyarrow as pa
import pytest

from leafmill.functions import text as tx
from leafmill.operators import postings, retrieve
from pyspark.sql import functions as F

WORDS = ["cat", "dog", "bird", "fish", "the", "a", "of"]


def corpus():
    rng = random.Random(7)
    return [(d, k, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(0, 9)))) for d in range(1, 15) for k in range(1, rng.randrange(2, 7))]


def brute(rows, queries, whole):
    """Scores and literal matches of every pair by the formula, chunk by chunk."""
    terms = {r[:2]: [w for w in r[2].split() if w not in tx.STOP_WORDS] for r in rows}
    out = {}
    for q, text in queries:
        asked = {w for w in text.split() if w not in tx.STOP_WORDS}
        for d, k, t in rows:
            own = [v for key, v in terms.items() if whole or key[0] == d]
            avg = sum(map(len, own)) / len(own) or 1.0
            score = 0.0
            for w in asked & set(terms[d, k]):
                df, tf = sum(w in x for x in own), terms[d, k].count(w)
                score += math.log(1 + (len(own) - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.6 + 0.4 * len(terms[d, k]) / avg))
            literal = f" {text} " in f" {t} "
            if score or literal:
                out[q, d, k] = (literal, round(score, 9))
    return out


QUERIES = [(1, "cat dog"), (2, "bird"), (3, "the"), (4, "fish of a cat"), (5, "unseen")]


@pytest.mark.parametrize("whole", [True, False])
def test_scores_and_best_against_brute_force(spark, monkeypatch, whole):
    """Several packs, blocks of few rows, and corpora that cross batches."""
    monkeypatch.setattr(postings, "PACK_TERMS", 3)
    monkeypatch.setattr(postings, "CELLS", 4)
    rows = [r for r in corpus() if r[2]]
    if whole:
        rows = [(0, 100 * d + k, t) for d, k, t in rows]
    df, asked = spark.createDataFrame(rows, "doc_id long, chunk_index long, text string"), spark.createDataFrame(QUERIES, "query_id long, text string")
    by = [] if whole else ["doc_id"]
    place = lambda r: (r.query_id, 0 if whole else r.doc_id, r.chunk_index)
    want = brute(rows, QUERIES, whole)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = {place(r): round(r.score, 9) for r in retrieve.bm25(df, asked, by).collect()}
        best = [(place(r), r.rank, r.literal) for r in retrieve.search(df, asked, by, 4, snippets=False).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {k: s for k, (_, s) in want.items() if s}
    ranked = {q: sorted((k for k in want if k[0] == q), key=lambda k: (not want[k][0], -want[k][1], k)) for q, _ in QUERIES}
    assert sorted(best) == sorted((k, i, want[k][0]) for keys in ranked.values() for i, k in enumerate(keys[:4], start=1))


def test_each_task_keeps_the_best_of_its_chunks(spark):
    """Of 2,000 chunks with the word, as many as the limit leave each task, and the first of equals win."""
    df = spark.range(1, 2001, 1, 4).selectExpr("id AS chunk_index", "'word other' AS text")
    asked = spark.createDataFrame([(1, "word")], "query_id long, text string")
    (pack,) = postings.packs(asked, retrieve.literal_pattern(asked["text"]))
    assert postings.hits(df, pack, [], "chunk_index", True, 3).count() <= 3 * 8
    assert [r.chunk_index for r in retrieve.search(df, asked, [], 3).orderBy("rank").collect()] == [1, 2, 3]


def test_no_pair_of_scores_travels(spark):
    df = spark.createDataFrame([(1, "cat dog"), (2, "dog")], "chunk_index long, text string")
    made = retrieve.bm25(df, spark.createDataFrame([(1, "dog")], "query_id long, text string"), [])
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString() and made.count() == 2


def test_no_query_gives_no_hit(spark):
    df = spark.createDataFrame([(1, "cat")], "chunk_index long, text string")
    none = spark.createDataFrame([(1, "..."), (2, None)], "query_id long, text string")
    assert retrieve.bm25(df, none, []).count() == 0 and retrieve.search(df, none, []).count() == 0


def test_words_on_bytes_are_those_of_search_words(spark):
    """Letters, marks and digits of many scripts, signs that are none, words of texts that meet, and texts without any."""
    texts = ["Straße des 17. Juni", "it’s “quoted” — isn't it?", "naïve é ́x", "日本語、テキスト", "١٢٣ ½ ²", "𝒳𝒴 😀cat😀dog", "a b c﻿d", "İstanbul K", "under_score 'x' ’", "tail", "head", "", None, "...", " \n\t", "Ünï", "x\0y", "end"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", tx.search_plain("text").alias("plain"), tx.search_words("text").alias("words")).orderBy("i")
    rows = df.collect()
    plain = pa.array([None, *[r.plain for r in rows]], pa.string())
    for given in (plain, plain.slice(1), plain.slice(3, 4), plain.slice(11, 5), plain.slice(12, 1), plain.slice(0, 0)):
        spans, sizes = postings.cut(given)
        want = [rows[i].words or [] for i in (next(k for k, r in enumerate(rows) if r.plain == t) if t is not None else 12 for t in given.to_pylist())]
        assert sizes.tolist() == [len(w) for w in want] and spans.to_pylist()[::2] == [w for each in want for w in each]


def test_no_array_of_words_is_made(spark, monkeypatch):
    """Texts travel to the worker as they are; as arrays of words they took most of the time."""
    plans = []
    monkeypatch.setattr(postings, "staged", lambda df, *a: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df)
    (pack,) = postings.packs(spark.createDataFrame([(1, "dog")], "query_id long, text string"), retrieve.literal_pattern(F.col("text")))
    plans.clear()
    postings.numbered(spark.createDataFrame([(1, "cat dog")], "chunk_index long, text string"), pack, ["chunk_index"], False)
    assert plans and "regexp_extract_all" not in plans[0]


def test_rounded_is_round(spark):
    rng = random.Random(3)
    xs = [rng.uniform(0, 10 ** rng.randrange(-8, 9)) for _ in range(3000)] + [k / 1e6 + d for k in range(200) for d in (5e-7, 4.9999999e-7, 5.0000001e-7)] + [0.0, -1.2345675, 2.5e-7, 1e300, 1.0000005, 123456.7890125, float("inf"), float("nan"), None]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select(F.round("x", 6).alias("a"), tx.rounded(F.col("x"), 6).alias("b"))
    assert df.count() == len(xs) and df.where("NOT (a <=> b)").collect() == []
