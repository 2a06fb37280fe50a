import math
import re

from pyspark.sql import functions as F

from leafmill.operators import retrieve


def chunks(spark, texts, **extra):
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts, start=1)], "doc_id long, chunk_index long, text string")
    return df.withColumns({k: F.lit(v) for k, v in extra.items()})


def ask(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")


def test_bm25(spark):
    got = retrieve.bm25(chunks(spark, ["alpha beta", "gamma delta"]), ask(spark, "alpha"), ["doc_id"]).collect()
    assert len(got) == 1 and math.isclose(got[0].score, math.log(2))
    corpus = ["the cat sat cat", "a dog and a cat", "birds fly", "dog dog dog runs"]

    def plain(query):
        docs = [[w for w in re.findall(r"\w+", t) if w not in ("the", "a", "and")] for t in corpus]
        avg, out = sum(map(len, docs)) / len(docs), {}
        for i, d in enumerate(docs, start=1):
            s = 0.0
            for q in set(query.split()):
                n, tf = sum(q in x for x in docs), d.count(q)
                if tf:
                    s += math.log(1 + (len(docs) - n + 0.5) / (n + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.6 + 0.4 * len(d) / avg))
            if s:
                out[i] = round(s, 9)
        return out

    for q in ("cat dog", "dog", "birds cat unseen"):
        assert {r.chunk_index: round(r.score, 9) for r in retrieve.bm25(chunks(spark, corpus), ask(spark, q), ["doc_id"]).collect()} == plain(q)


def test_literal_matches_come_first(spark):
    df = chunks(spark, ["AstraZeneca makes drugs drugs drugs", "AZ is a ticker", "costs €1.2m (b)(ii)", "drugs"])
    hit = lambda q: [r.chunk_index for r in retrieve.literal_hits(df, ask(spark, q), ["doc_id"]).collect()]
    assert hit("AZ") == [2] and hit("€1.2m") == [3] and hit("(b)(ii)") == [3] and hit("az IS a") == [2] and hit("") == []
    found = retrieve.search(df, ask(spark, "drugs"), ["doc_id"], 3).orderBy("rank").collect()
    assert [r.literal for r in found] == [True, True] and found[0].score >= found[1].score


def test_search_takes_one_of_a_heading_and_skips_covers(spark):
    df = chunks(spark, ["word one", "word two", "word three", "word"]).withColumns({"h": F.when(F.col("chunk_index") < 3, "A").otherwise("B"), "section": F.when(F.col("chunk_index") == 4, "coverpage")})
    got = retrieve.search(df, ask(spark, "word"), ["doc_id"], 8, heading="h").orderBy("rank").collect()
    assert [r.chunk_index for r in got] == [1, 3]
    assert [r.term for r in retrieve.unmatched_terms(df, ask(spark, "word zebra the")).collect()] == ["zebra"]


def test_snippets(spark):
    long = " ".join(f"w{i}" for i in range(300))
    df = spark.createDataFrame([("short text", "text"), (long, "w200"), (long, "nothing"), (long, "w0 w1")], "t string, q string")
    got = [r[0] for r in df.select(retrieve.snippet(F.col("t"), retrieve.anchor(F.col("t"), F.col("q")))).collect()]
    assert got[0] == "short text" and "w200" in got[1] and got[1].startswith("… w") and got[1].endswith(" …") and len(got[1]) <= 324
    assert got[2].startswith("w0 ") and got[3].startswith("w0 w1") and not re.search(r"w\d+w", got[1])


TREE = [(1, 1, None, "Financials", 1), (1, 2, 1, "Statements", 2), (1, 3, 2, "Operations", 3), (1, 4, None, "Discussion", 4), (1, 5, 4, "Operations", 5), (1, 6, 4, "Results of operations", 6), (1, 7, 99, "Orphan", 7), (1, 8, 9, "Loop", 8), (1, 9, 8, "Loop2", 9)]


def paths(spark):
    return retrieve.with_paths(spark.createDataFrame(TREE, "doc_id long, heading_id long, parent_heading_id long, text string, ord long")).cache()


def test_paths(spark):
    got = {r.heading_id: r for r in paths(spark).collect()}
    assert got[3].path == ["Financials", "Statements", "Operations"] and got[3].depth == 3 and got[7].depth == 1 and len(got) == 9 and got[8].depth == got[9].depth == 1
    assert paths(spark).where("heading_id = 3").select(retrieve.breadcrumb(F.col("path"))).first()[0] == "# Financials\n## Statements\n### Operations"
    ids = lambda df: sorted(r.heading_id for r in df.collect())
    assert ids(retrieve.level(paths(spark), 2)) == [2, 5, 6] and ids(retrieve.level(paths(spark), 2, 4)) == [5, 6]
    assert ids(retrieve.find_heading(paths(spark), "operations")) == [3, 5, 6] and ids(retrieve.find_heading(paths(spark), "Operations", True)) == [3, 5]
    assert ids(retrieve.resolve(paths(spark), "operations")) == [3, 5] and ids(retrieve.resolve(paths(spark), "Discussion > Operations")) == [5] and ids(retrieve.resolve(paths(spark), "Results")) == [6]
    assert ids(retrieve.drop_nested(paths(spark).where("heading_id IN (1, 3, 5)"))) == [1, 5]


def test_under_and_costs(spark):
    rows = spark.createDataFrame([(1, h, 100 * h) for h in range(1, 7)], "doc_id long, heading_id long, token_count long")
    top = paths(spark).where("heading_id = 1")
    ids = lambda df: sorted(r.heading_id for r in df.collect())
    assert ids(retrieve.under(rows, paths(spark), top)) == [1, 2, 3] and ids(retrieve.under(rows, paths(spark), top, False)) == [1]
    got = {r.heading_id: r.line for r in retrieve.outline_costs(paths(spark), rows).collect()}
    assert got[1] == "- Financials  ~600" and got[3] == "    - Operations  ~300" and got[4] == "- Discussion  ~1.5k"


def test_whole_or_outline(spark):
    df = spark.createDataFrame([(5000, 50, 100), (7000, 2, 100), (7000, 50, 100), (7000, 50, 9000), (13_000, 1, 1)], "tokens long, headings long, outline_chars long")
    assert [r.whole for r in retrieve.serve_whole(df).collect()] == [True, True, False, True, False]


def test_rendering(spark):
    rows = [(1, 1, 1, None, "heading", "Title"), (1, 2, 1, None, "paragraph", "a"), (1, 3, 2, "S-2", "paragraph", "b"), (1, 4, 2, "S-2", "page_label", "2")]
    df = spark.createDataFrame(rows, "doc_id long, ord long, page_number long, page_label string, block_type string, text string")
    assert retrieve.rendered(df).first().text == "[Page 1]\n\n## Title\n\na\n\n[Page S-2]\n\nb"
    assert [r.ord for r in retrieve.by_page(df, 2).collect()] == [3, 4] and [r.ord for r in retrieve.by_page(df, "S-2").collect()] == [3, 4]
    c = chunks(spark, ["## A\n\none", "## A\n\ntwo", "three", "## B\n\nfour"])
    assert retrieve.joined_chunks(c).first().text == "## A\n\none\n\ntwo\n\nthree\n\n## B\n\nfour"


def test_prune(spark):
    import datetime as dt

    day = lambda d, h=0: dt.datetime(2024, 1, d, h)
    df = spark.createDataFrame([("a", 5, day(3)), ("b", 5, day(2, 5)), ("c", 5, day(2, 1)), ("d", 5, day(1))], "path string, size long, mtime timestamp")
    assert sorted(r.path for r in retrieve.prune_plan(df, 10).collect()) == ["c", "d"]


def test_paths_of_a_tree_deeper_than_32_levels(spark):
    rows = [(1, i, i - 1 if i > 1 else None, f"h{i}", i) for i in range(1, 37)]
    got = retrieve.with_paths(spark.createDataFrame(rows, "doc_id long, heading_id long, parent_heading_id long, text string, ord long"))
    assert {r.heading_id: r.depth for r in got.collect()} == {i: i for i in range(1, 37)}
