"""Roles and formats of table cells; a cell has doc_id, table_id, row_start, col_start, rowspan, colspan and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import text as tx

TABLE = ("doc_id", "table_id")
YEAR = r"(?i)\b(?:FY\s?'?\d{2,4}|(?:19|20)\d{2}[AEF]?)\b"
DATE = r"(?i)\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.? \d{1,2},? \d{4}\b"
UNIT_CELL = r"(?i)^\(?\s*(?:[$€£¥%]|us\$|usd|eur|gbp|(?:in )?(?:thousands|millions|billions)|[$€£](?:k|m|bn|'?000s?))\s*\)?$"
UNIT_PHRASE = r"\bin (?:us )?(?:dollars|thousands|millions|billions|percent|%)|\b(?:thousands|millions|billions) of\b"
THRESHOLD = 1.0


def row_features(cells: DataFrame) -> DataFrame:
    """Measures of each row of each table that tell headers from data."""
    t = tx.strip("text")
    full, first = t != "", F.col("col_start") == 0
    numeric = tx.is_numeric_value("text") & ~t.rlike(YEAR)
    flag = lambda name: F.coalesce(F.col(name), F.lit(False)) if name in cells.columns else F.lit(False)
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    rows = cells.groupBy(*TABLE, "row_start").agg(
        count(full).alias("n_populated"),
        count(full & ~first).alias("_eligible"),
        count(numeric & full & ~first).alias("_numeric"),
        (count(flag("is_bold") & full) / F.nullif(count(full), F.lit(0))).alias("frac_bold"),
        any_(flag("table_header_flag")).alias("has_th"),
        any_(t.rlike(YEAR) | t.rlike(DATE)).alias("has_year_or_date"),
        any_(full & t.rlike(UNIT_CELL)).alias("_unit_cell"),
        F.lower(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col_start", t.alias("t")))), lambda x: x["t"]), " ")).alias("_joined"),
        (~any_(full & first)).alias("col0_blank"),
        any_(F.coalesce(F.col("colspan"), F.lit(1)) > 1).alias("has_colspan"),
        F.max(F.length(tx.text("text"))).alias("max_chars"),
        F.max(F.coalesce(F.col("rowspan"), F.lit(1))).alias("_span"),
        (any_(tx.strip("ix") != "") if "ix" in cells.columns else F.lit(False)).alias("has_ix"),
    )
    w = Window.partitionBy(*TABLE)
    rows = rows.withColumns({"first_row": F.min("row_start").over(w), "n_rows": F.count(F.lit(1)).over(w)})
    style = F.when(F.col("n_populated") == 0, "blank").when(F.col("_numeric") / F.nullif(F.col("_eligible"), F.lit(0)) >= 0.5, "numeric").otherwise("text")
    span = F.max(F.when(F.col("row_start") == F.col("first_row"), F.col("_span"))).over(w)
    rows = rows.withColumns({"row_style": style, "has_unit": F.col("_unit_cell") | F.col("_joined").rlike(UNIT_PHRASE), "in_first_span": (F.col("row_start") > F.col("first_row")) & (F.col("row_start") < F.col("first_row") + span)})
    return rows.drop("_eligible", "_numeric", "_unit_cell", "_joined", "_span")


def header_score(rows: DataFrame) -> DataFrame:
    """rows with header_score: what speaks for a header less what speaks against it. A cue counts only if at most half the table's rows have it."""
    w = Window.partitionBy(*TABLE)
    rare = lambda c, points: F.when(c & (F.avg(F.when(c, 1.0).otherwise(0.0)).over(w) <= 0.5), points).otherwise(0.0)
    given = lambda c, points: F.when(c, points).otherwise(0.0)
    depth = F.col("row_start") - F.col("first_row")
    chars = F.col("max_chars")
    score = (
        rare(F.coalesce(F.col("frac_bold") >= 0.5, F.lit(False)), 3.0)
        + rare(F.col("has_year_or_date"), 2.0)
        + rare(F.col("has_unit"), 3.0)
        + given(F.col("col0_blank"), 3.0)
        + given(F.col("row_style") == "numeric", -10.0)
        + given(depth == 0, 1.0)
        + given(F.col("in_first_span"), 1.0)
        + given(F.col("has_ix"), -2.0)
        + given(F.col("has_colspan"), 1.0)
        + given((depth != 0) & (F.col("n_populated") == 1), -3.0)
        + given(F.col("n_rows") == 2, -1.0)
        + F.when(chars > 300, -5.0).when(chars > 200, -2.0).when(chars > 100, -1.0).otherwise(0.0)
        + F.when(depth == 2, -2.0).when(depth == 3, -3.0).when(depth == 4, -4.0).when(depth > 4, -8.0).otherwise(0.0)
    )
    return rows.withColumn("header_score", score)


def with_roles(cells: DataFrame, row_label: bool = True) -> DataFrame:
    """cells with table_cell_role: rows marked as headers, and the unbroken run of rows from the first that score as such, are headers; a lone row only if marked."""
    rows = header_score(row_features(cells))
    like = F.col("has_th") | (F.col("header_score") >= THRESHOLD)
    run = F.min(F.when(like, 1).otherwise(0)).over(Window.partitionBy(*TABLE).orderBy("row_start").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.select(*TABLE, "row_start", (F.col("has_th") | ((F.col("n_rows") > 1) & (run == 1))).alias("_header"), "row_style", "header_score")
    role = F.when(F.col("_header"), "header").when((F.col("col_start") == 0) & F.lit(row_label), "row_label").otherwise("data")
    return cells.join(rows, [*TABLE, "row_start"]).withColumn("table_cell_role", role).drop("_header")


def flat(text: Column, sep: str) -> Column:
    return F.regexp_replace(tx.strip(text), r"\s*\n\s*", sep)


def spread(cells: DataFrame, rows: bool = True) -> DataFrame:
    """A row for each grid position that a cell covers: row and col."""
    one = F.lit(1)
    out = cells.withColumn("col", F.explode(F.sequence(F.col("col_start"), F.col("col_start") + F.coalesce("colspan", one) - 1)))
    return out.withColumn("row", F.explode(F.sequence(F.col("row_start"), F.col("row_start") + F.coalesce("rowspan", one) - 1))) if rows else out.withColumn("row", F.col("row_start"))


def _ordered(*columns) -> Column:
    return F.array_sort(F.collect_list(F.struct(*columns)))


def markdown(cells: DataFrame) -> DataFrame:
    """doc_id, table_id and text: a row between bars for each grid row, spans repeated, a rule under the last header row."""
    grid = spread(cells).withColumn("_t", flat(F.col("text"), "<br>"))
    grid = grid.groupBy(*TABLE, "row", "col").agg(F.max_by("_t", F.struct("row_start", "col_start")).alias("_t"))
    ends = cells.groupBy(*TABLE).agg(F.max("col_start").alias("last"), F.max(F.when(F.col("table_cell_role") == "header", F.col("row_start"))).alias("rule"))
    rows = grid.groupBy(*TABLE, "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "_t"))).alias("m")).join(ends, [*TABLE])
    line = F.concat(F.lit("| "), F.array_join(F.transform(F.sequence(F.lit(0), F.col("last").cast("int")), lambda c: F.coalesce(F.try_element_at("m", c), F.lit(""))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.array_join(F.array_repeat(F.lit("---"), F.col("last").cast("int") + 1), "|"), F.lit("|"))
    rows = rows.withColumn("line", F.when(F.col("row") == F.col("rule"), F.concat(line, F.lit("\n"), rule)).otherwise(line))
    return rows.groupBy(*TABLE).agg(F.array_join(F.transform(_ordered("row", "line"), lambda x: x["line"]), "\n").alias("text"))


def header_paths(cells: DataFrame, sep: str) -> DataFrame:
    """doc_id, table_id, col and path: the header texts above a column, from the top."""
    heads = spread(cells.where(F.col("table_cell_role") == "header"), rows=False).withColumn("_t", flat(F.col("text"), " "))
    parts = F.transform(F.array_sort(F.collect_list(F.when(F.col("_t") != "", F.struct("row", "_t")))), lambda x: x["_t"])
    out = heads.groupBy(*TABLE, "col").agg(F.array_join(parts, sep).alias("path"))
    return out.withColumn("path", F.when(F.col("path") == "", F.concat(F.lit("col_"), F.col("col"))).otherwise(F.col("path")))


def facts(cells: DataFrame) -> DataFrame:
    """doc_id, table_id, row_start, col_start, label, header and value of each data cell; rows without values have their label alone."""
    body = cells.where(F.col("table_cell_role") != "header").withColumn("_t", flat(F.col("text"), " "))
    w = Window.partitionBy(*TABLE, "row_start")
    label = F.min_by("_t", F.when(F.col("table_cell_role") == "row_label", F.col("col_start"))).over(w)
    value = F.col("table_cell_role") == "data"
    empty = ~F.coalesce(F.bool_or(F.when(value, F.col("_t") != "")).over(w), F.lit(False))
    body = body.withColumns({"label": F.coalesce(label, F.concat(F.lit("row_"), F.col("row_start"))), "_empty": empty, "_first": F.min("col_start").over(w)})
    kept = body.where((~F.col("_empty") & value) | (F.col("_empty") & (F.col("col_start") == F.col("_first")) & (F.trim("label") != "")))
    out = kept.join(header_paths(cells, " > ").withColumnRenamed("col", "col_start"), [*TABLE, "col_start"], "left")
    return out.select(*TABLE, "row_start", "col_start", "label", F.when(~F.col("_empty"), F.coalesce("path", F.concat(F.lit("col_"), F.col("col_start")))).alias("header"), F.when(~F.col("_empty"), F.col("_t")).alias("value"))


def melted(cells: DataFrame) -> DataFrame:
    """doc_id, table_id and text: a line "label | header > path | value" for each fact."""
    got = facts(cells).withColumn("line", F.concat_ws(" | ", "label", "header", "value"))
    return got.groupBy(*TABLE).agg(F.array_join(F.transform(_ordered("row_start", "col_start", "line"), lambda x: x["line"]), "\n").alias("text"))


def jsonl(cells: DataFrame) -> DataFrame:
    """doc_id, table_id and text: a JSON object for each data row, by header; of equal headers the last counts."""
    body = cells.where(F.col("table_cell_role") != "header").withColumn("_t", flat(F.col("text"), " "))
    body = body.join(header_paths(cells, "_").withColumnRenamed("col", "col_start"), [*TABLE, "col_start"], "left")
    name = F.when(F.col("path").isNotNull() & ~((F.col("col_start") == 0) & (F.col("path") == "col_0")), F.col("path")).when(F.col("col_start") == 0, "Metric").otherwise(F.concat(F.lit("col_"), F.col("col_start")))
    filled = F.bool_or(F.when(F.col("table_cell_role") == "data", F.col("_t") != ""))
    rows = body.withColumn("_k", name).groupBy(*TABLE, "row_start").agg(_ordered("col_start", "_k", "_t").alias("c"), F.coalesce(filled, F.lit(False)).alias("_full"), F.max(F.when(F.col("col_start") == 0, F.col("_t"))).alias("_label"))
    quoted = lambda v: F.regexp_replace(F.to_json(F.struct(v.alias("v"))), r'^\{"v":|\}$', "")
    names = F.array_distinct(F.transform("c", lambda x: x["_k"]))
    fields = F.transform(names, lambda k: F.concat(quoted(k), F.lit(": "), quoted(F.element_at(F.filter("c", lambda x: x["_k"] == k), -1)["_t"])))
    lone = F.when(F.coalesce("_label", F.lit("")) != "", F.concat(F.lit('{"Metric": '), quoted(F.col("_label")), F.lit("}")))
    rows = rows.withColumn("line", F.when(F.col("_full"), F.concat(F.lit("{"), F.array_join(fields, ", "), F.lit("}"))).otherwise(lone)).where("line IS NOT NULL")
    return rows.groupBy(*TABLE).agg(F.array_join(F.transform(_ordered("row_start", "line"), lambda x: x["line"]), "\n").alias("text"))


def spans_as_grid(cells: DataFrame) -> DataFrame:
    """doc_id, table_id, row, col and text of every grid position, as a table export needs it."""
    grid = spread(cells).groupBy(*TABLE, "row", "col").agg(F.max_by("text", F.struct("row_start", "col_start")).alias("text"))
    return grid


def without_blank(cells: DataFrame) -> DataFrame:
    """cells without blank rows and columns, positions renumbered and spans shortened accordingly."""
    full = spread(cells).where(tx.strip("text") != "")
    rows = full.select(*TABLE, "row").distinct().withColumn("_r", F.dense_rank().over(Window.partitionBy(*TABLE).orderBy("row")) - 1)
    cols = full.select(*TABLE, "col").distinct().withColumn("_c", F.dense_rank().over(Window.partitionBy(*TABLE).orderBy("col")) - 1)
    placed = spread(cells).join(rows, [*TABLE, "row"]).join(cols, [*TABLE, "col"])
    others = [c for c in cells.columns if c not in (*TABLE, "row_start", "col_start", "rowspan", "colspan")]
    out = placed.groupBy(*TABLE, "row_start", "col_start").agg(F.min("_r").alias("r"), F.min("_c").alias("c"), (F.max("_r") - F.min("_r") + 1).alias("rowspan"), (F.max("_c") - F.min("_c") + 1).alias("colspan"), *[F.first(c).alias(c) for c in others])
    return out.select(*TABLE, F.col("r").alias("row_start"), F.col("c").alias("col_start"), "rowspan", "colspan", *others)


_OPENING = r"^(?:\d|\([a-zA-Z0-9]+\)|[•◦▪▸·‣⁃●○►▶◆◇□■])"


def lone_rows(lines: DataFrame, least: int = 5, most_marked: float = 0.1) -> DataFrame:
    """Lines (ord, text, table_id, table_row_id, cell_count) after tables of one row are dealt with: a run of least or more of them with equal cells, few of which open with a number or mark, is one table; others are text again. Tables are numbered anew in order of appearance."""
    doc = Window.partitionBy("doc_id").orderBy("ord")
    rows = F.size(F.collect_set("table_row_id").over(Window.partitionBy(*TABLE)))
    df = lines.withColumn("_lone", F.col("table_id").isNotNull() & (rows == 1))
    follows = F.coalesce(F.lag("_lone").over(doc), F.lit(False)) & F.coalesce(F.lag("cell_count").over(doc).eqNullSafe(F.col("cell_count")), F.lit(False))
    df = df.withColumn("_new", F.col("_lone") & ~follows)
    df = df.withColumn("_run", F.when(F.col("_lone"), F.sum(F.when(F.col("_new"), 1).otherwise(0)).over(doc.rowsBetween(Window.unboundedPreceding, 0))))
    run = Window.partitionBy("doc_id", "_run")
    n = F.count(F.lit(1)).over(run)
    marked = F.sum(F.when(tx.strip("text").rlike(_OPENING), 1).otherwise(0)).over(run)
    df = df.withColumn("_joined", F.col("_lone") & (n >= least) & (marked <= most_marked * n))
    row = F.row_number().over(Window.partitionBy("doc_id", "_run").orderBy("ord"))
    key = F.when(F.col("_joined"), F.concat(F.lit("r"), F.col("_run"))).when(~F.col("_lone") & F.col("table_id").isNotNull(), F.concat(F.lit("t"), F.col("table_id")))
    df = df.withColumns({"_key": key, "table_row_id": F.when(F.col("_joined"), row.cast("long")).when(~F.col("_lone"), F.col("table_row_id")), "text": F.when(F.col("_lone") & ~F.col("_joined"), F.replace("text", F.lit(" | "), F.lit(" "))).otherwise(F.col("text"))})
    df = df.withColumn("_since", F.min("ord").over(Window.partitionBy("doc_id", "_key")))
    number = F.dense_rank().over(Window.partitionBy("doc_id", F.col("_key").isNotNull()).orderBy("_since"))
    return df.withColumn("table_id", F.when(F.col("_key").isNotNull(), number.cast("long"))).drop("_lone", "_new", "_run", "_joined", "_key", "_since")


def records(cells: DataFrame) -> DataFrame:
    """A record for each table: doc_id, table_id, page_number, page_label, caption (the first that there is), box, markdown, and its cells in order."""
    have = lambda c, kind: F.col(c) if c in cells.columns else F.lit(None).cast(kind)
    place = F.struct("row_start", "col_start")
    cell = F.struct("row_start", "col_start", F.coalesce("rowspan", F.lit(1)).alias("rowspan"), F.coalesce("colspan", F.lit(1)).alias("colspan"), F.coalesce("table_cell_role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    first = lambda c, kind: F.min_by(have(c, kind), F.when(have(c, kind).isNotNull(), place))
    box = F.struct(F.min(have("x_left", "double")).alias("x_left"), F.min(have("y_top", "double")).alias("y_top"), F.max(have("x_right", "double")).alias("x_right"), F.max(have("y_bottom", "double")).alias("y_bottom"))
    got = cells.groupBy(*TABLE).agg(F.coalesce(first("page_number", "long"), F.lit(0)).alias("page_number"), first("page_label", "string").alias("page_label"), first("caption", "string").alias("caption"), box.alias("box"), F.array_sort(F.collect_list(cell)).alias("cells"))
    return got.join(markdown(cells).withColumnRenamed("text", "markdown"), list(TABLE))


def chart_records(points: DataFrame) -> DataFrame:
    """A record for each chart: doc_id, chart_id, chart_type, title, page_number, series names, markdown, and its points in order."""
    have = lambda c, kind: F.col(c) if c in points.columns else F.lit(None).cast(kind)
    place = F.struct("series_index", "point_index")
    first = lambda c, kind: F.min_by(have(c, kind), F.when(have(c, kind).isNotNull(), place))
    point = F.struct("series_index", "point_index", "series_name", "category", "value")
    got = points.groupBy("doc_id", "chart_id").agg(first("chart_type", "string").alias("chart_type"), first("chart_title", "string").alias("title"), F.coalesce(first("page_number", "long"), F.lit(0)).alias("page_number"), F.array_sort(F.collect_list(point)).alias("points"))
    got = got.withColumn("series", F.array_distinct(F.transform("points", lambda p: p["series_name"])))
    return got.join(chart_markdown(points).withColumnRenamed("text", "markdown"), ["doc_id", "chart_id"])


# Charts: doc_id, chart_id, chart_type, series_index, series_name, point_index, category, value.


def with_percent(points: DataFrame) -> DataFrame:
    """percent of the series' sum."""
    total = F.sum("value").over(Window.partitionBy("doc_id", "chart_id", "series_index"))
    return points.withColumn("percent", F.round(100 * F.col("value") / F.nullif(total, F.lit(0.0)), 1))


def _shown(value: Column) -> Column:
    return F.when(value == F.floor(value), value.cast("long").cast("string")).otherwise(value.cast("string"))


def chart_melted(points: DataFrame) -> DataFrame:
    """doc_id, chart_id and text: a line "series | category | value" for each point; parts of a pie have their percent."""
    pie = F.when(F.col("chart_type") == "pie", F.concat(F.lit(" ("), F.col("percent"), F.lit("%)"))).otherwise("")
    line = F.concat(F.concat_ws(" | ", "series_name", "category", _shown(F.col("value"))), pie)
    got = with_percent(points).withColumn("line", line)
    return got.groupBy("doc_id", "chart_id").agg(F.array_join(F.transform(_ordered("series_index", "point_index", "line"), lambda x: x["line"]), "\n").alias("text"))


def chart_markdown(points: DataFrame) -> DataFrame:
    """doc_id, chart_id and text: categories down, series across."""
    cells = points.select("doc_id", F.col("chart_id").alias("table_id"), (F.col("point_index") + 1).alias("row_start"), (F.col("series_index") + 1).alias("col_start"), _shown(F.col("value")).alias("text"), F.lit("data").alias("table_cell_role"))
    heads = points.groupBy("doc_id", F.col("chart_id").alias("table_id"), (F.col("series_index") + 1).alias("col_start")).agg(F.first("series_name").alias("text")).selectExpr("doc_id", "table_id", "0 AS row_start", "col_start", "text", "'header' AS table_cell_role")
    names = points.groupBy("doc_id", F.col("chart_id").alias("table_id"), (F.col("point_index") + 1).alias("row_start")).agg(F.first("category").alias("text")).selectExpr("doc_id", "table_id", "row_start", "0 AS col_start", "text", "'row_label' AS table_cell_role")
    every = cells.unionByName(heads).unionByName(names).withColumns({"rowspan": F.lit(1), "colspan": F.lit(1)})
    return markdown(every).withColumnRenamed("table_id", "chart_id")


def chart_jsonl(points: DataFrame) -> DataFrame:
    """doc_id, chart_id and text: a JSON object for each category, by series."""
    quoted = lambda v: F.regexp_replace(F.to_json(F.struct(v.alias("v"))), r'^\{"v":|\}$', "")
    pair = points.withColumn("_f", F.concat(quoted(F.col("series_name")), F.lit(": "), _shown(F.col("value"))))
    rows = pair.groupBy("doc_id", "chart_id", "point_index").agg(F.first("category").alias("category"), _ordered("series_index", "_f").alias("f"))
    line = F.concat(F.lit('{"category": '), quoted(F.col("category")), F.lit(", "), F.array_join(F.transform("f", lambda x: x["_f"]), ", "), F.lit("}"))
    return rows.withColumn("line", line).groupBy("doc_id", "chart_id").agg(F.array_join(F.transform(_ordered("point_index", "line"), lambda x: x["line"]), "\n").alias("text"))
