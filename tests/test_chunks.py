import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from leafmill.operators import blocks, chunks
from leafmill.operators.chunks import Sizes

BLOCK = "doc_id long, block_id long, ord long, block_type string, text string, heading_id long, parent_heading_id long, heading_level long"


def test_sizes_are_clamped_and_ordered():
    s = Sizes(100_000, 10, 5000, 5000)
    assert (s.most, s.optimal, s.soft, s.least) == (8000, 400, 400, 400)
    assert Sizes() == Sizes(3200, 1500, 700, 400)


def test_greedy_cut_and_fold_agree(spark):
    assert chunks.greedy_cut([500, 600, 700, 900], 0, Sizes()) == [1, 1, 2, 3]
    r = random.Random(1)
    rows = [([r.randint(1, 3000) for _ in range(r.randint(0, 30))],) for _ in range(50)]
    df = spark.createDataFrame(rows, "n array<long>")
    got = [r[0] for r in df.select(chunks.greedy_fold(F.col("n"), F.lit(0), Sizes())).collect()]
    assert got == [chunks.greedy_cut(n, 0, Sizes()) for (n,) in rows]


def test_least_cost_cut_is_optimal():
    r, sizes = random.Random(2), Sizes()
    for _ in range(150):
        lens, heading = [r.randint(50, 1500) for _ in range(r.randint(1, 9))], r.choice([0, 40])
        total = heading + sum(lens)
        low = max(1, -(-total // sizes.most))
        high = max(low, min(len(lens), -(-total // sizes.optimal) + 1))

        def cost(cuts):
            parts = [heading + sum(lens[a:b]) for a, b in itertools.pairwise([0, *cuts, len(lens)])]
            return float(chunks.length_cost(np.array(parts), sizes).sum())

        best = min((cost(c) for k in range(low, min(high, len(lens)) + 1) for c in itertools.combinations(range(1, len(lens)), k - 1)), default=np.inf)
        got = chunks.least_cost_cut(lens, heading, sizes)
        cuts = [i for i in range(1, len(lens)) if got[i] != got[i - 1]]
        assert got[0] == 1 and all(b - a in (0, 1) for a, b in itertools.pairwise(got))
        assert not np.isfinite(best) or abs(cost(cuts) - best) < 1e-6


def test_split_text_loses_nothing_and_keeps_the_ceiling():
    r = random.Random(3)
    for _ in range(100):
        text = "".join(r.choice("abc .,\n") for _ in range(r.randint(1, 9000)))
        parts = chunks.split_text(text, 3200, 1500, 700)
        assert all(len(p) <= 3200 for p in parts)
        assert "".join("".join(parts).split()) == "".join(text.split())
    assert chunks.break_near("One. Two", 5) == 4 and chunks.break_near("a\nb c", 4) == 2


def doc(*rows, doc_id=1):
    return [(doc_id, i, i, kind, text, hid, parent, level) for i, (kind, text, hid, parent, level) in enumerate(rows, start=1)]


def test_chunks_carry_their_heading(spark):
    rows = doc(("paragraph", "before", None, None, None), ("heading", "Title", 1, None, 1), *[("paragraph", "x" * 1000, None, None, None)] * 5, ("page_label", "7", None, None, None), ("hybrid_heading_paragraph", "Risk. The rest", 2, 1, 2))
    df = spark.createDataFrame(rows, BLOCK).withColumn("hybrid_heading_text", F.when(F.col("block_type").startswith("hybrid"), "Risk."))
    got = chunks.chunks(chunks.assign_chunks(df)).orderBy("chunk_index").collect()
    assert [r.chunk_heading for r in got] == [None, "Title", "Title", "Title", "Risk."]
    assert got[0].text == "before" and got[1].text.startswith("## Title\n\nx") and got[4].text == "## Risk.\n\nThe rest"
    assert all(r.embed_char_count <= 3200 for r in got) and not any("7" in r.text for r in got)


def test_small_chunks_merge(spark):
    def rows(*own):
        return spark.createDataFrame([(1, i, h, p, n, f"t{h}", f"h{h}", [], False) for i, (h, p, n) in enumerate(own, start=1)], "doc_id long, chunk_index long, heading_id long, parent_heading_id long, embed_char_count long, text string, chunk_heading string, table_ids array<string>, contains_table boolean")

    plan = lambda df: [r.merge_mode for r in chunks.merge_plan(df).orderBy("chunk_index").collect()]
    assert plan(rows((1, None, 100), (2, 1, 100), (3, 1, 100))) == ["parent_plus_children"] * 3
    assert plan(rows((1, None, 3100), (2, 1, 100), (3, 1, 100))) == [None, "children_tail", "children_tail"]
    assert plan(rows((1, None, 100), (2, 1, 100), (3, 2, 900), (4, 1, 100), (5, 1, 100))) == [None, None, None, "children_tail", "children_tail"]
    assert plan(rows((2, 1, 100), (3, 1, 100), (4, 1, 100))) == ["children_tail"] * 3
    merged = chunks.merged(chunks.merge_plan(rows((2, 1, 100), (3, 1, 100), (4, 1, 100)))).collect()
    assert [(r.chunk_heading, r.text, r.chunk_index) for r in merged] == [("h2 | h3 | h4", "t2\n\nt3\n\nt4", 1)]


def test_build_is_deterministic_and_whole(spark):
    r = random.Random(4)
    rows = []
    for d in (1, 2, 3):
        rows += doc(*[("heading", f"H{i}", i, None, 1) if i % 7 == 0 else ("paragraph", " ".join(f"w{d}x{i}y{k}" for k in range(r.randint(1, 500))), None, None, None) for i in range(1, 40)], doc_id=d)
    df = spark.createDataFrame(rows, BLOCK)
    a, b = (sorted(map(str, chunks.build(x).collect())) for x in (df.repartition(1), df.repartition(5)))
    assert a == b
    text = " ".join(r.text for r in chunks.build(df).collect())
    assert all(word in text for row in rows for word in row[4].split()[:3])


def test_lines_and_blocks(spark):
    d = spark.createDataFrame([(1, "a\nb\n\n• c\nd | e\nf | g"), (2, None), (3, "")], "doc_id long, text string")
    laid = blocks.paragraph_layout(blocks.lines(d)).withColumn("heading_id", F.lit(None).cast("long"))
    got = [(r.doc_id, r.block_id, r.text) for r in blocks.blocks(blocks.with_block_id(laid)).orderBy("doc_id", "block_id").collect()]
    assert got == [(1, 1, "a b"), (1, 2, "• c"), (1, 3, "d | e f | g"), (3, 1, "")]


def test_block_ids_follow_headings(spark):
    rows = [(1, 1, 1, None), (1, 2, 1, 5), (1, 3, 2, 5), (1, 4, 2, 6), (1, 5, 3, None)]
    df = spark.createDataFrame(rows, "doc_id long, ord long, layout_id long, heading_id long")
    assert [r.block_id for r in blocks.with_block_id(df).orderBy("ord").collect()] == [1, 1, 1, 2, 3]


def test_fragments(spark):
    rows = [(1, 1, "inter-"), (1, 2, "national"), (1, 3, "[^1]"), (1, 4, " "), (1, 5, "▪ x"), (1, 6, "-"), (1, 7, "y")]
    df = spark.createDataFrame(rows, "k long, ord long, text string")
    assert blocks.join_fragments(df, ["k"], dehyphenate=True, bullet_sep="\n").first().text == "inter-national[^1]\n▪ x - y"
    assert blocks.join_table_row(df, ["k"]).first().text == "inter- | national | [^1] | ▪ x | - | y"


def test_texts_move_once_for_merges(spark):
    """Joins and windows of the plan carry numbers; texts are dealt by document once."""
    df = spark.range(1, 5).selectExpr("1L AS doc_id", "id AS chunk_index", "id AS heading_id", "IF(id > 1, 1L, NULL) AS parent_heading_id", "'h' AS chunk_heading", "concat('some text', id % 1) AS text", "100L AS embed_char_count", "25L AS token_count", "array('t') AS table_ids", "false AS contains_table")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = chunks.merged(chunks.merge_plan(df.repartition(2)))
        plan = spark._jvm.PythonSQLUtils.explainString(made._jdf.queryExecution(), "formatted")
        got = [(r.chunk_index, r.merge_mode, r.text) for r in made.collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    moves = [b for b in plan.split("\n\n") if "Exchange" in b.split("\n")[0] and "hashpartitioning" in b and ("text#" in b or "buf#" in b)]
    assert len(moves) == 1 and got == [(1, "parent_plus_children", "\n\n".join(["some text0"] * 4))]


def test_chunks_without_parents_are_the_same(spark):
    """Without parent_chunk_id nothing joins texts after they are cut, and all else stays."""
    rows = doc(("heading", "T", 1, None, 1), ("paragraph", "x " * 2000, None, None, None), ("heading", "U", 2, 1, 2), ("paragraph", "y " * 900, None, None, None))
    df = spark.createDataFrame(rows, BLOCK)
    slim = chunks.build(df, parents=False)
    assert sorted(map(str, slim.select("doc_id", "chunk_index", "chunk_id", "text").collect())) == sorted(map(str, chunks.build(df).select("doc_id", "chunk_index", "chunk_id", "text").collect()))
    assert "parent_chunk_id" not in slim.columns
