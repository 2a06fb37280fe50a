import numpy as np
import pyarrow as pa

from leafmill.llm import boost, toxicity
from leafmill.llm.common import held_out, table
from pyspark.sql import functions as F


def auc(bad, good):
    return float((bad[:, None] > good).mean() + 0.5 * (bad[:, None] == good).mean())


def test_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    documents, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    scored = toxicity.score(documents, toxicity.fit(documents, labels), ["doc_id"]).join(labels, "doc_id").where(held_out(F.col("doc_id")))
    rows = scored.select("toxic", "score").collect()
    bad, good = (np.array([r.score for r in rows if r.toxic == k]) for k in (1, 0))
    assert auc(bad, good) > 0.95 and (bad >= 0.5).mean() > 0.85 and (good >= 0.5).mean() < 0.02


def test_odd_texts_and_labels(spark, docs, odd):
    df = docs(odd, extra=True)
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)] + [(None, 1), (3, None), (4, 1), (4, 0)], "doc_id long, toxic int")
    for given in (labels, labels.where("false"), labels.where("toxic = 0")):
        got = toxicity.score(df, toxicity.fit(df, given), ["doc_id"]).collect()
        assert len(got) == len(odd) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(docs([]), toxicity.fit(docs([]), labels), ["doc_id"]).collect() == []


def test_features_see_obfuscation_and_second_person():
    lexicon = toxicity.Lexicon(["idiot"], [3.0])
    f = toxicity.features(pa.array(["you are an idiot", "he said idiot", "an 1d10t here", "a clean text", ""], pa.large_string()), lexicon)
    assert f.shape == (5, toxicity.FEATURES)
    assert f[0, 5] > 0 and f[1, 5] == 0 and f[1, 3] > 0 and f[2, 7] > 0 and f[2, 3] == 0 and not f[3, [1, 2, 3, 7]].any()


def test_isotonic_is_monotone_and_fits():
    r = np.random.default_rng(1)
    s = r.normal(size=500)
    y = (r.random(500) < 1 / (1 + np.exp(-3 * s))).astype(float)
    knots, levels = boost.isotonic(s, y)
    assert (np.diff(levels) >= 0).all() and abs(np.interp(s, knots, levels).mean() - y.mean()) < 0.02


def test_trees_learn_an_interaction():
    r = np.random.default_rng(2)
    x = r.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = boost.fit(x[:2000], y[:2000], x[2000:], y[2000:])
    assert ((model.predict(x) >= 0.5) == y).mean() > 0.95


def brute_features(text, lexicon):
    """The fourteen measures of one text, in the plainest way."""
    import math
    import re

    weights = {w: round(x * 1024) / 1024 for w, x in zip(lexicon.words, lexicon.weights)}
    data = text.encode()
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", low)
    hits = [weights.get(w, 0.0) for w in words]
    second = [w in toxicity.PRONOUNS for w in words]
    near = [any(second[j] for j in range(max(0, i - 3), min(len(words), i + 4)) if j != i) for i in range(len(words))]
    leet = str.maketrans("0134578@$!", "oieastbasi")
    hidden = 0.0
    for w in re.findall(r"[0-9a-z@$!*\x80-\U0010ffff]+", low):
        if len(w.encode()) > 2 and weights.get(w, 0.0) == 0:
            hidden += weights.get(w.translate(leet), 0.0)
    upper = [65 <= b <= 90 for b in data]
    letter = [u or 97 <= b <= 122 or b >= 128 for u, b in zip(upper, data)]
    sign = [32 < b < 128 and not x and not 48 <= b <= 57 for b, x in zip(data, letter)]
    twice = [i > 1 and data[i] == data[i - 1] == data[i - 2] and letter[i] for i in range(len(data))]
    n, size = max(1, len(words)), max(1, len(data))
    found = [h > 0 for h in hits]
    return [
        math.log1p(len(words)), sum(found) / n, sum(hits) / n, math.log1p(sum(found)), math.log1p(sum(hits)), sum(a and b for a, b in zip(found, near)) / n, sum(second) / n, math.log1p(hidden),
        sum(upper) / max(1, sum(letter)), sum(b in b"!?" for b in data) / size, sum(sign) / size, sum(48 <= b <= 57 for b in data) / size, sum(twice) / size, sum(letter) / n,
    ]


def brute_score(model, x):
    """The sum of the leaves that a row reaches, on the calibration's line."""
    raw = model.trees.base
    for t in model.trees.trees:
        i = 0
        while t.feature[i] >= 0:
            i = t.left[i] if x[t.feature[i]] <= t.threshold[i] else t.right[i]
        raw += t.value[i]
    k, v = model.trees.knots.tolist(), model.trees.levels.tolist()
    if raw <= k[0]:
        return v[0]
    for a, b, p, q in zip(k, k[1:], v, v[1:]):
        if raw <= b:
            return p + (q - p) * (raw - a) / (b - a) if b > a else q
    return v[-1]


def test_scores_equal_brute_force(spark, docs):
    import random

    r = random.Random(5)
    bad, good = ["idiot", "trash", "moron", "vile"], [f"w{i}" for i in range(40)] + ["you", "are", "the"]
    texts, marks = [], []
    for i in range(400):
        toxic = i % 4 == 0
        w = [r.choice(good) for _ in range(r.randint(3, 30))]
        if toxic:
            for _ in range(r.randint(1, 4)):
                w.insert(r.randrange(len(w)), r.choice(bad))
            w.append(r.choice(["!!!", "YOU", "1d10t", "m0ron"]))
        texts.append(" ".join(w))
        marks.append(int(toxic))
    df = docs(texts)
    model = toxicity.fit(df, spark.createDataFrame(list(enumerate(marks)), "doc_id long, toxic int"))
    assert set(bad) <= set(model.lexicon.words) and model.trees.trees
    asked = texts[:80] + ["", "!", "ÄÖÜ äöü", "you idiot", "Y0U 1D10T!!! aaaa", "x" * 500, "trash" * 3]
    f = toxicity.features(pa.array(asked, pa.large_string()), model.lexicon)
    scores = model.score(pa.array(asked, pa.large_string()))
    for i, t in enumerate(asked):
        want = brute_features(t, model.lexicon)
        assert np.allclose(f[i], want, atol=1e-9), (t, f[i], want)
        assert abs(scores[i] - min(1.0, max(0.0, brute_score(model, f[i])))) < 1e-9, t


def test_learning_writes_no_file(spark, docs):
    """On check_h the tables that were staged came to 422 files."""
    from pathlib import Path

    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    held = lambda: {str(f) for f in folder.rglob("*.parquet")} if folder.exists() else set()
    before = held()
    df = docs(["you idiot"] * 20 + ["a clean text"] * 60)
    model = toxicity.fit(df, spark.createDataFrame([(i, int(i < 20)) for i in range(80)], "doc_id long, toxic int"))
    assert "idiot" in model.lexicon.words and held() == before


def test_each_lexicon_learns_from_its_halves_only(spark):
    rows = [(0, k, "idiot" if k else "fine") for k in (0, 1) for _ in range(20)] + [(1, k, "moron" if k else "fine") for k in (0, 1) for _ in range(20)]
    counts = toxicity._document_counts(spark.createDataFrame(rows, "half int, toxic int, text string"))
    sizes = {(h, k): 20 for h in (0, 1) for k in (0, 1)}
    assert [x.words for x in toxicity._learn_lexicons(counts, sizes, [(0,), (1,), (0, 1)], toxicity.LEAST_Z)] == [["idiot"], ["moron"], ["idiot", "moron"]]
    assert [x.words for x in toxicity._learn_lexicons(counts, {(0, 0): 20}, [(0,), (0, 1)], toxicity.LEAST_Z)] == [[], []]
    lexicons = [toxicity.Lexicon(["idiot"], [3.0]), toxicity.Lexicon(["moron"], [2.0])]
    texts = pa.array(["idiot", "idiot", "moron", ""], pa.large_string())
    got = toxicity._crossed_features(texts, np.array([0, 1, 1, 0]), lexicons)
    assert all((got[i] == toxicity.features(texts.slice(i, 1), lexicons[h])[0]).all() for i, h in enumerate([0, 1, 1, 0]))
