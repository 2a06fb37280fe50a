from pyspark.sql import functions as F

from leafmill.operators import headings, hierarchy, structure

LINE = "doc_id long, ord long, text string, hierarchy_type string, hierarchy_marker string, block_type string, font_size double, font_size_ratio double"


def lines(spark, n_docs=1):
    rows = [(1, "1. One", "1.", 10.0), (2, "1.1 Sub", "1.1", None), (3, "text", None, None), (4, "2. Two", "2.", 10.1), (5, "3. Small", "3.", 6.0), (6, "9. Alone", "9.", float("nan"))]
    made = [(d, o, t, "numbered_heading" if m else None, m, None, s, None) for d in range(1, n_docs + 1) for o, t, m, s in rows]
    return spark.createDataFrame(made, LINE)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_series_with_unknown_sizes(spark):
    got = {(r.ord, r.series, r.depth) for r in headings.numbered_series(lines(spark)).collect()}
    assert got == {(1, 1, 1), (2, 1, 2), (4, 1, 1)}


def test_a_document_is_no_frame_of_its_own(spark):
    """A frame for each document costs about 10 ms, and one task may have all documents, as their rows are small."""
    df = headings.with_style(lines(spark, 300)).withColumns({"heading_id": F.col("ord"), "heading_fp": F.lit(1), "heading_type": F.coalesce("hierarchy_type", F.lit("free_form"))})
    tree = hierarchy.tree(df)
    for made in (headings.repaired_parens(df), headings.numbered_series(df), headings.merged_styles(df), tree):
        assert "InPandas" not in plan(made)
    assert tree.count() == 1800 and {(r.heading_id, r.parent_heading_id) for r in tree.where("doc_id = 300").collect()} >= {(1, None), (2, 1)}


def test_lines_are_made_once(spark):
    """What makes the lines is not done again for each of the readers of marked()."""
    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    df = lines(spark).mapInArrow(seen, LINE)
    structure.marked(df.withColumn("link_type", F.lit("internal")))
    assert made.value == 6
