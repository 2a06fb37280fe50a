import hashlib
import random
import re

from leafmill.llm import decontam


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(texts, items):
    out = []
    for text in texts:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            b = words(t)
            m = min(10, len(b))
            for k in range(len(b) - m + 1 if m else 0):
                for i in range(len(w) - m + 1):
                    if w[i : i + m] == b[k : k + m]:
                        hit |= set(range(i, i + m))
                        found.add("null" if item is None else str(item))
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def case(n=60):
    r = random.Random(3)
    vocab = ["a", "b", "Ünï", "x1", "q"]
    some = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    items = [(i, some(r.choice([1, 4, 10, 12, 15]))) for i in range(5)] + [(None, "only null id words stand here so it has more than ten of them"), (7, None), (8, ""), (9, "!!"), (1, "a second text of item one")]
    texts = [None, "", "..", "x " * 20_000] + [some(r.randint(1, 40)) for _ in range(n)]
    texts += [f"{some(3)}. {items[k % 6][1].upper()}; {some(2)}" for k in range(12)]
    return texts, items


def bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def test_scan_equals_brute_force(spark, docs):
    texts, items = case()
    for limit in (decontam.MAX_BROADCAST_BYTES, 60):
        got = decontam.scan(docs(texts, extra=True), bench(spark, items), max_bytes=limit).collect()
        want = brute(texts, items)
        assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got} == dict(enumerate(want))


def test_clean_cuts_passages_and_keeps_the_rest(spark, docs):
    passage = "the quick brown fox jumps over the lazy dog and runs far away"
    texts = [f"Before it, ä. {passage.upper()}! After it all words stay as they are, and these are many more words.", passage, "clean ä text", None, ""]
    df = docs(texts, extra=True)
    got = {r.doc_id: r for r in decontam.clean(df, bench(spark, [(1, passage)])).collect()}
    assert set(got) == {0, 2, 3, 4}
    assert got[0].text == "Before it, ä. ! After it all words stay as they are, and these are many more words." and got[0].n_chars == len(got[0].text)
    assert [got[k].text for k in (2, 3, 4)] == texts[2:]
    assert decontam.clean(df, bench(spark, [(1, passage)])).columns == df.columns


def test_empty_tables(spark, docs):
    assert decontam.scan(docs([]), bench(spark, [(1, "a b")])).collect() == []
    assert not decontam.scan(docs(["a b"]), bench(spark, [])).first().contaminated
