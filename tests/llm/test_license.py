import random
import re

from leafmill.llm import license

PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def brute(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at = [(i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in at]
    return len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


def test_base_equals_brute_force(docs, odd):
    r = random.Random(4)
    vocab = ["mit", "License", "apache", "general", "PUBLIC", "the", "ä", "1"]
    texts = odd + ["MIT License", "mit. license", "mit-license MIT\nLICENSE", "mitlicense", "General  Public, License", "MİT license", "xmit license", "mit license" * 3, "apache license mit license general public license " * 400]
    texts += [" ".join(r.choice(vocab) for _ in range(r.randint(1, 30))) for _ in range(200)]
    got = {r.doc_id: r for r in license.scan(docs(texts, extra=True)).collect()}
    for i, t in enumerate(texts):
        g = got[i]
        assert (g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels) == brute(t), t
        assert set(filter(None, g.base_labels.split(","))) <= set(filter(None, g.labels.split(","))) and 0 <= g.score <= 1


def test_templates_need_their_phrase_in_place(docs):
    texts = [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "granted hereby is permission free charge of software copy person",
        "Licensed under CC BY-NC 4.0.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted",
        "We redistribution and use in source",
        "All rights reserved.",
    ]
    got = {r.doc_id: r.labels for r in license.scan(docs(texts)).collect()}
    assert [got[i] for i in range(6)] == ["mit", "", "cc-by-nc", "bsd", "", "reserved"]


def test_empty(docs):
    assert license.scan(docs([])).collect() == []


def brute_labels(text, rarity):
    """Every template tried at every place of the text."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    base = brute(text)
    labels, score = set(filter(None, base[4].split(","))), 0.5 if base[1] else 0.0
    for label, phrase, template in license.TEMPLATES:
        key, parts = phrase.split(), template.split()
        off = next(i for i in range(len(parts)) if parts[i : i + len(key)] == key)
        starts = [i - off for i in range(len(w)) if w[i : i + len(key)] == key]
        if starts:
            share = sum(any(0 <= s + i < len(w) and w[s + i] == x for s in starts) for i, x in enumerate(parts)) / len(parts)
            if share >= license.LEAST_SHARE:
                labels.add(label)
                score = max(score, share)
    return ",".join(sorted(labels)), score


def test_labels_and_score_equal_brute_force(docs, odd):
    r = random.Random(12)
    vocab = license.vocabulary()
    texts = odd + [t for _, _, t in license.TEMPLATES] + [p for _, p, _ in license.TEMPLATES]
    for _ in range(150):
        w = r.choice(license.TEMPLATES)[2].split()
        for _ in range(r.randint(0, 6)):
            k = r.randrange(len(w))
            w[k : k + r.randint(0, 1)] = [r.choice(vocab + ["other", "ä"])]
        texts.append(" ".join([r.choice(vocab) for _ in range(r.randint(0, 5))] + w + [r.choice(vocab) for _ in range(r.randint(0, 5))]).title())
    texts += ["the worK is licensed", "permissİon is hereby granted free of charge", "MIT License " * 3000]
    got = {x.doc_id: x for x in license.scan(docs(texts)).collect()}
    for i, t in enumerate(texts):
        labels, score = brute_labels(t, None)
        assert got[i].labels == labels and abs(got[i].score - score) < 1e-12, t


def test_rarest_word_chooses_the_templates():
    rarity = {w: 1.0 for w in license.vocabulary()} | {"hereby": 9.0, "mit": 5.0}
    rows = license.index_rows(rarity)
    assert rows[0][0] == "hereby" and rows[2][0] == "mit" and rows[2][3] == "mit"
    for (anchor, at, idf, _, key, words), (_, phrase, template) in zip(rows, license.TEMPLATES):
        assert template.split()[at] == anchor and idf == max(rarity[w] for w in phrase.split())
        assert sorted([*[w for w, _ in key], anchor]) == sorted(phrase.split()) and [w for w, _ in words] == template.split()


def test_a_template_is_not_tried_without_its_anchor(docs):
    """Frequencies come from the corpus: the word of a phrase that fewest texts hold is its anchor, and texts without it have no places kept."""
    texts = ["license public"] * 20 + ["general license public"] * 3 + ["the gnu general public license version two"]
    found = license.positions(docs(texts))
    assert license.inverse_frequencies(found)["license"] < license.inverse_frequencies(found)["general"]
    assert {r.doc_id for r in found.where("hits IS NOT NULL").collect()} == {20, 21, 22, 23}
    assert [r.labels for r in license.scan(docs(texts)).orderBy("doc_id").collect()] == [""] * 23 + ["gpl"]


def test_plan_runs_no_python(docs):
    plan = license.scan(docs(["a"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
