"""Lines and cells on laid-out pages: what a layout is, script words in a cell, vertical lines, cells of slide tables, tagged objects and form labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.operators.geometry import PAGE, with_line_id

#: Points by measure of a layout, tried in order (fixed values): comparison, bound, points.
BANDS = {
    "cells": ((">", 10, 10.0), (">", 5, 5.0), (">", 2, 1.0), ("<=", 1, -5.0), ("<=", 2, -1.0)),
    "rules": ((">", 15, 20.0), (">", 10, 10.0), (">", 4, 5.0), (">", 2, 1.0), ("=", 0, -2.0)),
    "prior": (("<", -8, -10.0), ("<", -5, -5.0), ("<", -2, -2.0), ("<", 0, -2.0), (">", 8, 10.0), (">", 5, 5.0), (">", 2, 2.0)),
    "lines": (("=", 1, -10.0), ("<", 4, -1.0), (">", 10, 2.0), (">=", 4, 1.0)),
}
TABLE_FROM = 1.0
CHARTS, TEXTS = ("chart",), ("toc", "toc_heading", "exhibits", "exhibit_heading", "heading", "code", "block_quote", "footnote", "header", "footer")
#: Words that may stand above or below a line (fixed values): small and roman numbers, ordinals, a letter, signs, short formulas, boxes.
SCRIPT = r"^(?:[(\[]?[-+–−]?\d{1,3}[)\].,]?|\d{1,2}(?:st|nd|rd|th)|[(\[]?[A-Za-z][)\].]?|[ivxlcIVXLC]{1,3}|[-+*/=<>~^·•°′″†‡§¶±×÷…()\[\]]+|(?=[A-Za-z0-9+\-*/=^_·×÷–−]{2,5}$)[A-Za-z0-9]+(?:[-+*/=^_·×÷–−][A-Za-z0-9]+)+|[☐☑☒✓✗✔✘])$"


def points(measure: str, value: Column) -> Column:
    """The points of the first band that a measure falls in; none for an unknown one."""
    tests = {">": lambda b: value > b, ">=": lambda b: value >= b, "<": lambda b: value < b, "<=": lambda b: value <= b, "=": lambda b: value == b}
    out = F.when(F.lit(False), F.lit(0.0))
    for sign, bound, score in BANDS[measure]:
        out = out.when(tests[sign](bound), score)
    return out.otherwise(0.0)


def layout_types(lines: DataFrame) -> DataFrame:
    """doc_id, layout_id, layout_type (text, table or chart) and layout_score. A chart block, a table id, a text block or single cells decide by themselves, without a score; else the points of four measures do."""
    have = lambda c, kind: F.col(c) if c in lines.columns else F.lit(None).cast(kind)
    block = F.lower(F.trim(F.coalesce(have("block_type", "string"), F.lit(""))))
    rules = F.array_compact(F.array(have("rule_above", "long"), have("rule_below", "long")))
    cells = F.coalesce(F.col("cell_count").cast("double"), F.lit(0.0)) if "cell_count" in lines.columns else F.lit(1.0)
    got = lines.groupBy("doc_id", "layout_id").agg(
        F.count(F.lit(1)).alias("lines"),
        F.median(cells).alias("cells"),
        F.max(cells).alias("most"),
        F.median(have("line_score", "double")).alias("prior"),
        F.size(F.array_distinct(F.flatten(F.collect_list(rules)))).alias("rules"),
        F.bool_or(block.isin(*CHARTS)).alias("chart"),
        F.bool_or(block.isin(*TEXTS)).alias("text"),
        F.bool_or(have("table_id", "long").isNotNull()).alias("table"),
    )
    score = sum((points(m, F.col(m)) for m in BANDS), F.lit(0.0))
    sure = F.when(F.col("chart"), "chart").when(F.col("table"), "table").when(F.col("text") | (F.col("most") <= 1), "text")
    got = got.withColumns({"_sure": sure, "_score": score})
    return got.select("doc_id", "layout_id", F.coalesce("_sure", F.when(F.col("_score") > TABLE_FROM, "table").otherwise("text")).alias("layout_type"), F.when(F.col("_sure").isNull(), F.col("_score")).alias("layout_score"))


def cell_scripts(words: DataFrame, small: float = 0.85, body: float = 0.9, shift: float = 0.15) -> DataFrame:
    """script_type of words by size and base line within their cell: smaller than its largest word, off the base line of its body, shaped like a script, and outnumbered by the body. Cells of several lines and of tables have none."""
    cell = Window.partitionBy(*PAGE, "cell_id")
    have = lambda c, kind: F.col(c) if c in words.columns else F.lit(None).cast(kind)
    lines = F.size(F.collect_set("line_id").over(cell)) == 1 if "line_id" in words.columns else F.lit(True)
    df = words.withColumns({"_free": have("script_type", "string").isNull() & have("table_id", "long").isNull() & lines, "_ref": F.max("font_size").over(cell)})
    df = df.withColumns({"_small": F.col("_free") & (F.col("_ref") > 0) & (F.col("font_size") < small * F.col("_ref")), "_body": F.col("_free") & (F.col("_ref") > 0) & (F.col("font_size") >= body * F.col("_ref"))})
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).over(cell)
    df = df.withColumns({"_base": F.median(F.when(F.col("_body"), F.col("y_bottom"))).over(cell), "_ok": count(F.col("_small")) <= count(F.col("_free") & ~F.col("_small"))})
    fits = F.col("_small") & F.col("_ok") & F.trim("text").rlike(SCRIPT)
    off = F.col("_base") - F.col("y_bottom")
    made = F.when(fits & (off > shift * F.col("_ref")), "superscript").when(fits & (off < -shift * F.col("_ref")), "subscript")
    return df.withColumn("script_type", F.coalesce(have("script_type", "string"), made)).drop("_free", "_ref", "_small", "_body", "_base", "_ok")


def vertical_lines(words: DataFrame, tolerance: float = 5.0) -> DataFrame:
    """line_id of words set upright: the rule of lines with the axes swapped."""
    swapped = lambda df: df.withColumns({"x_left": F.col("y_top"), "y_top": F.col("x_left"), "x_right": F.col("y_bottom"), "y_bottom": F.col("x_right")})
    return swapped(with_line_id(swapped(words), tolerance))


def slide_cell_boxes(cells: DataFrame, columns: DataFrame, rows: DataFrame, tables: DataFrame) -> DataFrame:
    """cells (doc_id, table_id, row_start, col_start, colspan) with their boxes, from columns (col, width), rows (row, height) and the table's own box, to which stale widths and heights are scaled."""
    table = ["doc_id", "table_id"]
    box = tables.select(*table, F.col("x_left").alias("_x"), F.col("y_top").alias("_y"), (F.col("x_right") - F.col("x_left")).alias("_w"), (F.col("y_bottom") - F.col("y_top")).alias("_h"))

    def edges(df: DataFrame, key: str, size: str, whole: str) -> DataFrame:
        w = Window.partitionBy(*table).orderBy(key)
        scaled = df.join(box.select(*table, whole), table).withColumn("_s", F.col(size) * F.col(whole) / F.nullif(F.sum(size).over(Window.partitionBy(*table)), F.lit(0.0)))
        end = F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))
        return scaled.select(*table, key, (end - F.col("_s")).alias("_from"), end.alias("_to"))

    across, down = edges(columns, "col", "width", "_w"), edges(rows, "row", "height", "_h")
    last = F.least(F.col("col_start") + F.coalesce("colspan", F.lit(1)) - 1, F.col("_last"))
    most = columns.groupBy(*table).agg(F.max("col").alias("_last"))
    got = cells.join(box, table).join(most, table).withColumn("_end", last)
    got = got.join(across.select(*table, F.col("col").alias("col_start"), F.col("_from").alias("_l")), [*table, "col_start"]).join(across.select(*table, F.col("col").alias("_end"), F.col("_to").alias("_r")), [*table, "_end"])
    got = got.join(down.select(*table, F.col("row").alias("row_start"), F.col("_from").alias("_t"), F.col("_to").alias("_b")), [*table, "row_start"])
    made = {"x_left": F.col("_x") + F.col("_l"), "y_top": F.col("_y") + F.col("_t"), "x_right": F.col("_x") + F.col("_r"), "y_bottom": F.col("_y") + F.col("_b")}
    return got.select(*cells.columns, *[c.alias(n) for n, c in made.items()])


TAG_FIELDS = ("struct_tag", "struct_tag_id", "block_type", "table_id")


def repaired_tags(words: DataFrame, fields: tuple[str, ...] = TAG_FIELDS) -> DataFrame:
    """words of an object whose tag is missing get the tag fields of the first tagged word of that object on the page; what they have stays."""
    w = Window.partitionBy(*PAGE, "text_object_id").orderBy("word_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tagged = F.col("struct_tag_id").isNotNull()
    needs = ~tagged & F.col("text_object_id").isNotNull()
    known = [c for c in fields if c in words.columns]
    first = {f"_f_{c}": F.first(F.when(tagged, F.col(c)), ignorenulls=True).over(w) for c in known}
    df = words.withColumns({"_needs": needs} | first)
    return df.withColumns({c: F.when(F.col("_needs"), F.coalesce(c, f"_f_{c}")).otherwise(F.col(c)) for c in known}).drop("_needs", *first)


def struct_groups(words: DataFrame) -> DataFrame:
    """struct_group_id of words: by tag where pages have more than one, else by marked content, else by text object; numbered on the page in order of appearance."""
    page = Window.partitionBy(*PAGE)
    # The least and the largest tell as much as the set of all, which would be held and copied for each word.
    several = lambda c: F.coalesce(F.min(c).over(page) < F.max(c).over(page), F.lit(False))
    keys = [F.when(several(c) & F.col(c).isNotNull(), F.concat(F.lit(f"{n}:"), F.col(c).cast("string"))) for n, c in enumerate(("struct_tag_id", "mcid", "text_object_id")) if c in words.columns]
    df = words.withColumn("_key", F.coalesce(*keys))
    since = F.min("word_id").over(Window.partitionBy(*PAGE, "_key"))
    df = df.withColumn("_since", F.when(F.col("_key").isNotNull(), since))
    rank = F.dense_rank().over(Window.partitionBy(*PAGE, F.col("_key").isNotNull()).orderBy("_since"))
    return df.withColumn("struct_group_id", F.when(F.col("_key").isNotNull(), rank)).drop("_key", "_since")


def form_labels(leaves: DataFrame, widgets: DataFrame) -> DataFrame:
    """doc_id, page_number, mcid and widget_id: the widget that each marked text labels. A text inside the widget's element is its label; else the text last before it in reading order, and of several widgets the nearest. leaves: mcid, elem_id, ancestor_ids, rank; widgets: widget_id, elem_id, rank.

    No text meets every widget: ancestors are joined by their ids, the text before comes from one ordered pass over the page, and of the widgets of one element the best is found before its texts are joined.
    """
    own = F.struct("_way", "_far", "widget_id").alias("_own")
    w = widgets.select(*PAGE, "widget_id", F.col("elem_id").alias("_owner"), F.col("rank").alias("_rank"))
    above = leaves.select(*PAGE, "mcid", F.explode(F.array_distinct("ancestor_ids")).alias("_owner"))
    held = w.join(above.select(*PAGE, "_owner").distinct(), [*PAGE, "_owner"], "left_semi")
    inner = held.withColumns({"_way": F.lit(0), "_far": F.lit(0).cast("long")}).groupBy(*PAGE, "_owner").agg(F.min(own).alias("_own"))
    inside = above.join(inner, [*PAGE, "_owner"]).select(*PAGE, "mcid", "_own")
    others = w.join(held.select(*PAGE, "widget_id").distinct(), [*PAGE, "widget_id"], "left_anti")
    text = F.struct("rank", "elem_id")
    # Texts at a widget's own rank come after it, as they are not before it.
    texts = leaves.where("rank IS NOT NULL").groupBy(*PAGE, "rank").agg(F.max(text).alias("_text")).select(*PAGE, F.col("rank").alias("_at"), F.lit(1).alias("_side"), "_text", F.lit(None).cast(w.schema["widget_id"].dataType).alias("widget_id"))
    asked = others.where("_rank IS NOT NULL").select(*PAGE, F.col("_rank").alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(texts.schema["_text"].dataType).alias("_text"), "widget_id")
    before = Window.partitionBy(*PAGE).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = texts.unionByName(asked).withColumn("_text", F.last("_text", ignorenulls=True).over(before)).where("_side = 0 AND _text IS NOT NULL")
    last = placed.groupBy(*PAGE, "widget_id").agg(F.max(F.struct(F.col("_text.rank").alias("rank"), F.col("_text.elem_id").alias("elem_id"), (F.col("_at") - F.col("_text.rank")).cast("long").alias("far"))).alias("_l"))
    near = last.select(*PAGE, "widget_id", F.col("_l.elem_id").alias("elem_id"), F.lit(1).alias("_way"), F.col("_l.far").alias("_far")).groupBy(*PAGE, "elem_id").agg(F.min(own).alias("_own"))
    after = leaves.select(*PAGE, "elem_id", "mcid").join(near, [*PAGE, "elem_id"]).select(*PAGE, "mcid", "_own")
    return inside.unionByName(after).groupBy(*PAGE, "mcid").agg(F.min("_own").alias("_own")).select(*PAGE, "mcid", F.col("_own.widget_id").alias("widget_id"))


def renumbered(cells: DataFrame, key: str, order: list[str]) -> DataFrame:
    """key numbered from 1 on each page, in the order of its first cell."""
    first = F.min(F.struct(*order)).over(Window.partitionBy(*PAGE, key))
    df = cells.withColumn("_first", first)
    return df.withColumn(key, F.dense_rank().over(Window.partitionBy(*PAGE).orderBy("_first", key)).cast("long")).drop("_first")
