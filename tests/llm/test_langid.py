from leafmill.llm import langid
from leafmill.llm.common import held_out, table
from pyspark.sql import functions as F


def test_held_out_accuracy(spark, small):
    documents = table(spark, small, "documents")
    got = langid.identify(documents, langid.fit(documents), ["doc_id", "lang"]).where(held_out(F.col("doc_id")))
    right = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.97


def test_odd_texts(spark, tiny, docs, odd):
    model = langid.fit(table(spark, tiny, "documents"))
    got = {r.doc_id: r for r in langid.identify(docs(odd), model, ["doc_id"]).collect()}
    assert [got[i].lang_pred for i in range(4)] == ["und"] * 4 and [got[i].score for i in range(4)] == [0.0] * 4
    assert all(got[i].lang_pred in model.langs and 0 <= got[i].score <= 1 for i in range(4, len(odd)))
    assert (got[6].lang_pred, got[6].score) == (got[7].lang_pred, got[7].score)


def test_stage_keeps_columns_and_drops_what_has_no_language(spark, tiny, docs):
    model = langid.fit(table(spark, tiny, "documents"))
    df = docs(["the thing and the other of that", "12 34", None], extra=True)
    kept = langid.keep_identified(df, model)
    assert kept.columns == df.columns and [r.doc_id for r in kept.collect()] == [0]


def test_words_beat_ngrams_and_ngrams_back_off(spark, docs):
    df = docs(["uno dos tres"] * 30 + [None], lang="es").union(docs(["one two three"] * 30, ids=range(100, 130), lang="en"))
    model = langid.fit(df)
    names = model.score(__import__("pyarrow").array(["uno dos", "two", "tresx", "threexyz", "ζ"], "large_string"))[0]
    assert names[:4] == ["es", "en", "es", "en"] and names[4] in ("en", "es")


def test_without_training_rows(spark, docs):
    assert langid.identify(docs(["a text"]), langid.fit(docs([])), ["doc_id"]).first().lang_pred == "und"
    assert langid.identify(docs([]), langid.fit(docs(["a b c"] * 9)), ["doc_id"]).collect() == []


def brute_model(texts, langs, least):
    """Words and n-grams by plain counting, for a model that is read once more in the plainest way."""
    import math
    import re
    from collections import Counter

    names = sorted(set(langs))
    words = Counter((k, w) for t, k in zip(texts, langs) for w in re.findall(r"[a-z\x80-\U0010ffff]+", t.lower()))
    grams = Counter()
    for (k, w), n in words.items():
        e = f"^{w}$"
        for size in langid.ORDERS:
            for i in range(len(e) - size + 1):
                grams[k, e[i : i + size]] += n
    every = lambda c, x: sum(c[k, x] for k in names)
    vocab = {w for _, w in words if every(words, w) >= least}
    known = {g for _, g in grams if every(grams, g) >= least}
    total = {k: sum(n for (j, _), n in words.items() if j == k) for k in names}
    by_size = {(k, s): sum(n for (j, g), n in grams.items() if j == k and len(g) == s) for k in names for s in langid.ORDERS}
    of_size = Counter(len(g) for g in known)

    def word_score(w, k):
        if w in vocab:
            return math.log((words[k, w] + 0.1) / (max(total[k], 1) + 0.1 * (len(vocab) + 1)))
        e, at, out = f"^{w}$", 0, 0.0
        while at < len(e):
            for tried, s in enumerate(langid.ORDERS):
                g = e[at : at + s]
                if len(g) == s and g in known:
                    out += math.log((grams[k, g] + 0.1) / (max(by_size[k, s], 1) + 0.1 * (of_size[s] + 1))) + tried * math.log(langid.BACKOFF)
                    at += s
                    break
            else:
                out, at = out + langid.FLOOR, at + 1
        return out

    prior = {k: math.log(max(langs.count(k), 0.5) / len(langs)) for k in names}

    def score(text):
        found = re.findall(r"[a-z\x80-\U0010ffff]+", text.lower())
        if not re.search(r"[^\W\d_]", text):
            return "und", 0.0
        sums = [prior[k] + sum(word_score(w, k) for w in found) for k in names]
        calm = [math.exp((s - max(sums)) / math.sqrt(max(1, len(found)))) for s in sums]
        best = max(range(len(names)), key=lambda i: (sums[i], -i))
        return names[best], calm[best] / sum(calm)

    return score


def test_scores_equal_brute_force(spark, docs):
    import random

    import pyarrow as pa

    r = random.Random(8)
    alphabet = {"x": "abcdeé", "y": "cdefgh", "z": "aehkñ"}
    word = lambda k: "".join(r.choice(alphabet[k]) for _ in range(r.randint(1, 7)))
    common = {k: [word(k) for _ in range(15)] for k in alphabet}
    texts, langs = [], []
    for _ in range(120):
        k = r.choice("xyz")
        texts.append(" ".join(r.choice(common[k]) if r.random() < 0.7 else word(k) for _ in range(r.randint(1, 25))))
        langs.append(k)
    parts = [docs([t for t, k in zip(texts, langs) if k == x], [i for i, k in enumerate(langs) if k == x], lang=x) for x in "xyz"]
    from functools import reduce

    df = reduce(lambda a, b: a.union(b), parts)
    learned = {row.doc_id for row in df.where(~held_out(F.col("doc_id"))).collect()}
    model = langid.fit(df)
    brute = brute_model([t for i, t in enumerate(texts) if i in learned], [k for i, k in enumerate(langs) if i in learned], langid.LEAST_COUNT)
    asked = texts + ["", "12 !", "zzzz qqqq", "é", "a" * 300, "Abc-dÉf 9 hk"] + [" ".join(word(r.choice("xyz")) for _ in range(6)) for _ in range(40)]
    names, scores = model.score(pa.array(asked, pa.large_string()))
    for text, name, score in zip(asked, names, scores):
        want = brute(text)
        assert name == want[0] and abs(score - want[1]) < 1e-4, text
