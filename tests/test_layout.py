from pyspark.sql import functions as F

from leafmill import cli
from leafmill.operators import grids, labels
from tests.test_sources import HTML, slides, word

BOX = "x_left double, y_top double, x_right double, y_bottom double"


def test_label_series():
    rows = [(1, "arabic", "", 7), (5, "roman", "", 1), (9, "roman", "", 2), (12, "arabic", "", 99), (14, "roman", "", 3), (20, "arabic", "", 1), (30, "arabic", "", 2), (40, "arabic", "", 3), (50, "arabic", "", 4)]
    assert labels.best_series(rows) == [1, 2, 4, 5, 6, 7, 8]


def test_label_path():
    a = lambda v, s=1.0: ("arabic", "", v, s)
    assert labels.best_path([[a(1)], [a(50, 1.2), a(2)], [], [a(4)], [a(5), a(17)]]) == [0, 1, None, 0, 0]
    assert labels.best_path([]) == []


def test_labels_on_lines(spark):
    texts = ["Intro", "1", "text", "Page 2", "more", "- 3 -", "x", "4 of 9", "2024"]
    df = spark.createDataFrame([(1, i, (i + 1) // 2, t) for i, t in enumerate(texts, start=1)], "doc_id long, ord long, page_number long, text string")
    found = labels.candidates(df)
    assert [r.page_label for r in labels.label_series(found).orderBy("ord").collect()] == ["1", "2", "3", "4"]
    assert [r.page_label for r in labels.label_path(labels.with_place_score(found)).orderBy("page_number").collect()] == ["1", "2", "3", "4"]


def test_margin_numbers(spark):
    rows = [(1, p, 10 * p + k, 10.0, 20.0 * k, 16.0, 20.0 * k + 9, str(k)) for p in (1, 2) for k in range(1, 7)] + [(1, 1, 99, 100.0, 20.0, 110.0, 29.0, "5"), (1, 2, 98, 100.0, 40.0, 140.0, 49.0, "word")]
    df = spark.createDataFrame(rows, f"doc_id long, page_number long, word_id long, {BOX}, text string")
    assert labels.line_numbers(df).count() == 12


def test_touching_and_cells(spark):
    rules = [(0, 0, 100, 0), (0, 20, 100, 20), (50, 40, 100, 40), (0, 60, 100, 60), (0, 0, 0, 60), (50, 0, 50, 60), (100, 0, 100, 60), (300, 300, 400, 300)]
    assert grids.touching([tuple(map(float, r)) for r in rules]) == [1] * 7 + [2]
    got = {(r[:4]) for r in grids.cells_between([tuple(map(float, r)) for r in rules[:7]])}
    assert got == {(0, 0, 1, 1), (0, 1, 1, 1), (1, 0, 2, 1), (1, 1, 1, 1), (2, 1, 1, 1)}
    df = spark.createDataFrame([(1, 1, k, *map(float, r)) for k, r in enumerate(rules)], f"doc_id long, page_number long, shape_id long, {BOX}")
    parts = grids.components(df)
    cells = grids.grid_cells(df.join(parts, ["doc_id", "page_number", "shape_id"]))
    assert cells.count() == 5


def test_tables_from_cells(spark):
    rows = [(1, 1, 1, 1, 0.0, 0.0, 40.0, 10.0), (1, 1, 1, 2, 60.0, 1.0, 90.0, 11.0), (1, 1, 1, 3, 5.0, 20.0, 30.0, 30.0), (1, 1, 1, 4, 62.0, 20.0, 95.0, 30.0)]
    df = spark.createDataFrame(rows, f"doc_id long, page_number long, table_id long, cell_id long, {BOX}")
    got = {r.cell_id: (r.row_start, r.col_start) for r in grids.table_rows(grids.table_columns(df)).collect()}
    assert got == {1: (0, 0), 2: (0, 1), 3: (1, 0), 4: (1, 1)}
    tall = spark.createDataFrame([(1, 1, 1, 0.0, 0.0, 40.0, 10.0), (1, 1, 2, 0.0, 12.0, 40.0, 22.0), (1, 1, 3, 60.0, 0.0, 90.0, 22.0), (1, 1, 4, 0.0, 40.0, 40.0, 50.0)], f"doc_id long, page_number long, cell_id long, {BOX}")
    rows = {r.cell_id: r.row_id for r in grids.logical_rows(tall).collect()}
    assert rows[1] == rows[2] == rows[3] != rows[4]


def test_gutters():
    boxes = [(0.0, 0.0, 100.0, 10.0), (0.0, 20.0, 45.0, 120.0), (60.0, 20.0, 100.0, 150.0), (0.0, 130.0, 48.0, 150.0)]
    found = grids.gutters(boxes)
    assert found and all(not (b[0] < g[2] and g[0] < b[2] and b[1] < g[3] and g[1] < b[3]) for g in found for b in boxes)
    assert found[0][0] >= 45 and found[0][2] <= 60 and found[0][3] - found[0][1] >= 100 and grids.gutters([]) == []


def test_rule_roles(spark):
    words = spark.createDataFrame([(1, 1, 0.0, 0.0, 50.0, 10.0), (1, 1, 0.0, 30.0, 200.0, 40.0)], f"doc_id long, page_number long, {BOX}")
    rules = spark.createDataFrame([(1, 1, 1, 0.0, 11.0, 50.0, 11.0), (1, 1, 2, 0.0, 35.0, 60.0, 35.0), (1, 1, 3, 0.0, 100.0, 200.0, 100.0), (1, 1, 4, 0.0, 120.0, 20.0, 120.0)], f"doc_id long, page_number long, rule_id long, {BOX}")
    assert {r.rule_id: r.role for r in grids.rule_roles(rules, words).collect()} == {1: "underline", 2: "strike", 3: "separator", 4: "rule"}


def test_a_folder_of_files(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(word())
    (tmp_path / "b.pptx").write_bytes(slides())
    (tmp_path / "c.html").write_text(HTML)
    (tmp_path / "d.docx").write_bytes(b"PK\x03\x04 broken")
    got = cli.parse_folder(spark, str(tmp_path))
    assert got["files"].count() == 4 and got["errors"].count() == 1
    texts = {r.text for r in got["headings"].collect()}
    assert {"Head", "Title", "First", "Second"} <= texts
    chunks = got["chunks"].cache()
    assert chunks.select("doc_id").distinct().count() == 3 and chunks.where(F.col("text").contains("Page two link")).count() == 1


def _labels_by_pairs(leaves, widgets):
    """form_labels() by its definition, pair by pair."""
    inside = [(m, 0, 0, w) for m, e, up, r in leaves for w, o, k in widgets if o in up]
    others = [(w, k) for w, o, k in widgets if w not in {x[3] for x in inside}]
    found = list(inside)
    for w, k in others:
        before = [(r, e) for m, e, up, r in leaves if r < k]
        if before:
            r, e = max(before)
            found += [(m, 1, k - r, w) for m, own, up, _ in leaves if own == e]
    return {m: min(x[1:] for x in found if x[0] == m)[2] for m in {x[0] for x in found}}


def test_form_labels_against_all_pairs(spark):
    import random

    from leafmill.operators import layouts

    rng = random.Random(7)
    leaves = [(i, rng.randrange(12), [rng.randrange(40) for _ in range(rng.randrange(3))], r) for i, r in enumerate(rng.sample(range(200), 60))]
    widgets = [(100 + i, rng.randrange(50), rng.randrange(200)) for i in range(20)]
    texts = spark.createDataFrame([(1, 1, *x) for x in leaves], "doc_id long, page_number long, mcid long, elem_id long, ancestor_ids array<long>, rank long")
    forms = spark.createDataFrame([(1, 1, *x) for x in widgets], "doc_id long, page_number long, widget_id long, elem_id long, rank long")
    got = layouts.form_labels(texts, forms)
    assert {r.mcid: r.widget_id for r in got.collect()} == _labels_by_pairs(leaves, widgets)
    # Texts and widgets of a page never meet one by one.
    joins = [x for x in got._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x and "[doc_id#" in x]
    assert joins and all(x.split("[", 1)[1].split("]")[0].count("#") > 2 for x in joins)


def test_struct_groups_hold_no_set_for_each_word(spark):
    from leafmill.operators import layouts

    rows = [(1, 1, 1, 5, None), (1, 1, 2, None, 3), (1, 1, 3, 6, None), (1, 2, 4, 5, 1), (1, 2, 5, 5, 2), (1, 2, 6, None, None)]
    got = layouts.struct_groups(spark.createDataFrame(rows, "doc_id long, page_number long, word_id long, struct_tag_id long, mcid long"))
    assert [r.struct_group_id for r in got.orderBy("word_id").collect()] == [1, None, 2, 1, 2, None]
    assert "collect_set" not in got._jdf.queryExecution().executedPlan().toString()
