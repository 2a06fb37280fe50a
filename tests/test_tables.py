import json

from pyspark.sql import functions as F

from leafmill.operators import export, tables

CELL = "doc_id long, table_id long, row_start int, col_start int, rowspan int, colspan int, table_cell_role string, text string"


def wrapped(spark):
    rows = [(0, 0, "header", "Metric"), (0, 1, "header", "Total credit provided\nand capital raised"), (1, 0, "row_label", "$3.3\ntrillion"), (1, 1, "data", "$ 71,477\n$ 119,333")]
    return spark.createDataFrame([(1, 1, r, c, 1, 1, role, t) for r, c, role, t in rows], CELL)


def test_wrapped_cells(spark):
    md = tables.markdown(wrapped(spark)).first().text.split("\n")
    assert len(md) == 3 and all(x.startswith("|") for x in md) and "<br>" in md[0] and md[1] == "|---|---|"
    assert tables.melted(wrapped(spark)).first().text == "$3.3 trillion | Total credit provided and capital raised | $ 71,477 $ 119,333"
    line = tables.jsonl(wrapped(spark)).first().text
    assert json.loads(line) == {"Metric": "$3.3 trillion", "Total credit provided and capital raised": "$ 71,477 $ 119,333"} and "\n" not in line


def test_spans_and_header_paths(spark):
    rows = [(0, 0, 2, 1, "header", ""), (0, 1, 1, 2, "header", "Year"), (1, 1, 1, 1, "header", "2023"), (1, 2, 1, 1, "header", "2024"), (2, 0, 1, 1, "row_label", "A"), (2, 1, 1, 1, "data", "1"), (2, 2, 1, 1, "data", "2"), (3, 0, 1, 1, "row_label", "Only label"), (3, 1, 1, 1, "data", ""), (4, 0, 1, 1, "row_label", 'B "q"'), (4, 1, 1, 2, "data", "3")]
    df = spark.createDataFrame([(1, 1, *r) for r in rows], CELL)
    assert tables.markdown(df).first().text == '|  | Year | Year |\n|  | 2023 | 2024 |\n|---|---|---|\n| A | 1 | 2 |\n| Only label |  |  |\n| B "q" | 3 | 3 |'
    assert tables.melted(df).first().text == 'A | Year > 2023 | 1\nA | Year > 2024 | 2\nOnly label\nB "q" | Year > 2023 | 3'
    assert [json.loads(x) for x in tables.jsonl(df).first().text.split("\n")] == [{"Metric": "A", "Year_2023": "1", "Year_2024": "2"}, {"Metric": "Only label"}, {"Metric": 'B "q"', "Year_2023": "3"}]
    one = tables.markdown(export.one_header_row(df)).first().text.split("\n")
    assert one[0] == "| col_0 | Year > 2023 | Year > 2024 |" and one[1] == "|---|---|---|"
    assert {len(x) for x in export.aligned(tables.markdown(df)).first().text.split("\n")} == {len("| Only label | Year | Year |")}


def roles(spark, grid, **flags):
    rows = [(1, 1, r, c, 1, 1, None, t) for r, line in enumerate(grid) for c, t in enumerate(line)]
    df = spark.createDataFrame(rows, CELL).drop("table_cell_role")
    for k, v in flags.items():
        df = df.withColumn(k, v())
    got = tables.with_roles(df)
    return {(r.row_start, r.col_start): r.table_cell_role for r in got.collect()}


def test_header_rows(spark):
    got = roles(spark, [["", "2023", "2024"], ["Revenue", "1,200", "1,300"], ["Cost", "(700)", "(800)"]])
    assert [got[r, 0] for r in range(3)] == ["header", "row_label", "row_label"] and got[1, 1] == "data"
    assert roles(spark, [["a", "b"]])[0, 1] == "data"
    assert roles(spark, [["5", "6"], ["7", "8"], ["9", "1"]])[0, 1] == "data"
    marked = roles(spark, [["5", "6"], ["7", "8"]], table_header_flag=lambda: F.col("row_start") == 1)
    assert marked[1, 0] == "header" and marked[0, 0] == "row_label"
    bold = roles(spark, [["Name", "Kind"], ["x", "y"], ["z", "w"]], is_bold=lambda: F.col("row_start") == 0)
    assert bold[0, 0] == "header" and bold[1, 0] == "row_label"


def test_blank_rows_and_columns_go(spark):
    rows = [(0, 0, 1, 3, "h"), (1, 0, 1, 1, "a"), (1, 1, 1, 1, ""), (1, 2, 1, 1, "b"), (2, 0, 1, 1, " "), (2, 1, 1, 1, ""), (2, 2, 1, 1, ""), (3, 0, 1, 1, "c"), (3, 2, 1, 1, "d")]
    df = spark.createDataFrame([(1, 1, r, c, rs, cs, None, t) for r, c, rs, cs, t in rows], CELL)
    got = {(r.row_start, r.col_start): (r.text, r.colspan) for r in tables.without_blank(df).where("trim(text) <> ''").collect()}
    assert got == {(0, 0): ("h", 3), (1, 0): ("a", 1), (1, 2): ("b", 1), (2, 0): ("c", 1), (2, 2): ("d", 1)}


def test_charts(spark):
    rows = [(1, 1, "pie", 0, "S", k, c, v) for k, (c, v) in enumerate([("a", 1.0), ("b", 3.0)])]
    df = spark.createDataFrame(rows, "doc_id long, chart_id long, chart_type string, series_index int, series_name string, point_index int, category string, value double")
    assert tables.chart_melted(df).first().text == "S | a | 1 (25.0%)\nS | b | 3 (75.0%)"
    assert tables.chart_markdown(df).first().text == "|  | S |\n|---|---|\n| a | 1 |\n| b | 3 |"
    assert [json.loads(x) for x in tables.chart_jsonl(df).first().text.split("\n")] == [{"category": "a", "S": 1}, {"category": "b", "S": 3}]
