from pyspark.sql import functions as F

from leafmill.operators import geometry, metadata, rollup
from leafmill.operators.rollup import Agg


def test_policies(spark):
    rows = [(1, 1, 3, None, "a", ["x"], {"k": 1}, 0.5, True), (1, 2, 5, "b", None, ["y", "x"], {"k": 2, "j": 1}, 1.0, None), (1, 3, 5, "c", "z", None, None, None, False), (2, 4, 0, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, ord long, char_count long, page_label string, font_family string, link_url array<string>, struct_attributes map<string,int>, bold_ratio double, is_x boolean")
    got = {r.doc_id: r for r in rollup.roll_up(df, ["doc_id"], overrides={"ord": Agg.LIST}, size_as="n").collect()}
    r = got[1]
    assert (r.ord, r.char_count, r.page_label, r.font_family, r.link_url, r.struct_attributes, r.is_x, r.n) == ([1, 2, 3], 13, "b", None, ["x", "y"], {"k": 2, "j": 1}, True, 3)
    assert r.bold_ratio == (0.5 * 3 + 1.0 * 5) / 8 and got[2].bold_ratio == 0.0 and got[2].link_url is None and got[2].is_x is False
    custom = rollup.roll_up(df, ["doc_id"], overrides={"char_count": lambda c, o: F.max(c)}).where("doc_id = 1").first()
    assert custom.char_count == 5
    derived = rollup.with_derived(rollup.roll_up(df, ["doc_id"])).where("doc_id = 1").first()
    assert derived.is_bold is True


def test_resolution():
    assert [rollup.policy_of(c)[0] for c in ("is_a", "page_x", "my_count", "my_ratio", "_hidden", "new")] == [Agg.ANY, Agg.FIRST, Agg.SUM, Agg.WEIGHTED_RATIO, Agg.DROP, Agg.FIRST]
    assert rollup.policy_of("word_count", {"word_count": "max"}) == (Agg.MAX, "override")


WORD = "doc_id long, page_number long, word_id long, x_left double, y_top double, x_right double, y_bottom double"


def test_overlap_and_containment(spark):
    words = spark.createDataFrame([(1, 1, 1, 0.0, 0.0, 10.0, 10.0), (1, 1, 2, 100.0, 100.0, 110.0, 110.0), (1, 2, 3, 0.0, 0.0, 10.0, 10.0)], WORD)
    boxes = spark.createDataFrame([(1, 1, 7, 0.0, 0.0, 6.0, 10.0), (1, 1, 8, 0.0, 0.0, 8.0, 400.0), (1, 1, 9, 99.5, 99.5, 110.5, 110.5)], WORD.replace("word_id", "box_id"))
    assert {(r.word_id, r.box_id, r.ratio) for r in geometry.overlap(words, boxes, "box_id").collect()} == {(1, 8, 0.8), (2, 9, 1.0)}
    assert {(r.word_id, r.box_id) for r in geometry.contained(words, boxes, "box_id").collect()} == {(2, 9)}
    assert {(r.box_id, r.container) for r in geometry.containers(boxes, key="box_id").collect()} == {(7, 8)}


def test_rules(spark):
    words = spark.createDataFrame([(1, 1, 1, 0.0, 50.0, 10.0, 60.0)], WORD)
    rules = spark.createDataFrame([(1, 1, 1, 0.0, 10.0, 45.0), (1, 1, 2, 0.0, 10.0, 20.0), (1, 1, 3, 0.0, 10.0, 70.0), (1, 1, 4, 8.0, 90.0, 62.0)], "doc_id long, page_number long, rule_id long, x_left double, x_right double, y_top double")
    r = geometry.nearest_rules(words, rules).first()
    assert (r.rule_above, r.rule_below) == (1, 3)


def test_lines_cells_and_layouts(spark):
    rows = [(1, 1, 1, 0.0, 0.0, 10.0, 10.0), (1, 1, 2, 12.0, 2.0, 20.0, 12.0), (1, 1, 3, 60.0, 1.0, 70.0, 11.0), (1, 1, 4, 0.0, 20.0, 10.0, 30.0)]
    df = spark.createDataFrame(rows, WORD).withColumns({"text": F.lit("w"), "font_size": F.lit(10.0)})
    got = {r.word_id: (r.line_id, r.cell_id) for r in geometry.with_cell_id(geometry.with_line_id(df)).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 2), 4: (2, 1)}
    assert {r.word_id: r.line_id for r in geometry.with_anchored_line_id(df).collect()} == {1: 1, 2: 1, 3: 1, 4: 2}
    lines = spark.createDataFrame([(1, 1, k, y, y + 10, 10.0) for k, y in enumerate([0.0, 12.0, 24.0, 60.0, 72.0])], "doc_id long, page_number long, line_id long, y_top double, y_bottom double, font_size double")
    assert [r.layout_id for r in geometry.with_layout_id(lines).orderBy("line_id").collect()] == [1, 1, 1, 2, 2]


def test_reading_order():
    two_columns = [(0, 0, 100, 10), (0, 20, 45, 90), (55, 20, 100, 50), (55, 60, 100, 90), (0, 95, 100, 99)]
    assert geometry.xy_cut(two_columns) == [0, 1, 2, 3, 4]
    assert geometry.xy_cut([(55, 20, 100, 90), (0, 20, 45, 90)]) == [1, 0] and geometry.xy_cut([]) == []


def test_rotation_and_global_y(spark):
    df = spark.createDataFrame([(1, 1, 1, 10.0, 20.0, 30.0, 40.0)], WORD)
    r = geometry.rotated(df, F.lit(180), F.lit(100.0), F.lit(200.0)).first()
    assert (r.x_left, r.y_top, r.x_right, r.y_bottom) == (70.0, 160.0, 90.0, 180.0)
    pages = spark.createDataFrame([(1, 1, 100.0), (1, 2, 100.0)], "doc_id long, page_number long, height double")
    assert geometry.global_y(df.withColumn("page_number", F.lit(2).cast("long")), pages).first().y_top == 120.0


def test_page_info_and_ocr(spark):
    lines = spark.createDataFrame([(1, 1, "x" * 10), (2, 1, "y" * 500)], "doc_id long, page_number long, text string")
    pages = spark.createDataFrame([(1, 1, 595.0, 842.0), (1, 2, 842.0, 595.0), (2, 1, 612.0, 792.0)], "doc_id long, page_number long, width double, height double")
    info = {r.doc_id: r for r in metadata.page_info(lines, pages).collect()}
    assert (info[1].page_count, info[1].page_format, info[1].mixed_page_sizes, info[2].char_count) == (2, "A4", True, 500)
    images = spark.createDataFrame([(1, 1, 0.0, 0.0, 595.0, 842.0), (1, 2, 0.0, 0.0, 842.0, 595.0), (2, 1, 0.0, 0.0, 612.0, 792.0)], "doc_id long, page_number long, x_left double, y_top double, x_right double, y_bottom double")
    assert {r.doc_id: r.needs_ocr for r in metadata.ocr_need(pages, images, lines).collect()} == {1: True, 2: False}


def test_text_metadata(spark):
    df = spark.createDataFrame([(1, 1, 1, 10.0, "small text"), (1, 2, 1, 20.0, "The Title"), (1, 3, 1, 20.0, "A Later One"), (1, 4, 1, 10.0, "Mary Miller"), (1, 5, 9, 99.0, "Too far away")], "doc_id long, ord long, page_number long, font_size double, text string")
    assert metadata.title_from_text(df).first().title == "The Title"
    assert [r.author for r in metadata.author_lines(df).collect()] == ["Mary Miller"]
    native = spark.createDataFrame([(1, "", "Microsoft Word", "unknown"), (2, "N", "Nina Vogel", "de")], "doc_id long, title string, author string, language string")
    texts = spark.createDataFrame([(1, "T", "Mary", "en"), (3, "U", "123", None)], "doc_id long, title string, author string, language string")
    got = {r.doc_id: tuple(r)[1:] for r in metadata.consolidate(native, texts).collect()}
    assert got == {1: ("T", "Mary", "en"), 2: ("N", "Nina Vogel", "de"), 3: ("U", None, "unknown")}


def test_checks_of_long_words_take_one_pass(spark):
    """A word of 400,000 letters without an @ was read again from each of them."""
    import time

    from leafmill.operators import headings

    rows = [("a" * 400_000,), ("Write to jo@x.org",), ("A @ b.org1",), ("Sum α ∑",), ("x = y α",), ("Part One",), ("é@é.de now",), ("@x.de",)]
    df = spark.createDataFrame(rows, "text string").selectExpr("text", "CAST(NULL AS STRING) AS hierarchy_marker", "CAST(NULL AS STRING) AS block_type").coalesce(1)
    began = time.time()
    got = [r[0] for r in df.select(headings.may_be_heading()).collect()]
    assert got == [True, False, True, False, False, True, False, True]
    assert time.time() - began < 30
