"""Exports: Markdown, plain text, contents, outline, JSON and files by level."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import text as tx
from leafmill.operators.blocks import HEADINGS, NOISE

LEVELS = ("chunks", "blocks", "tables", "charts", "headings", "metadata")


def _kept(blocks: DataFrame, tables: bool, toc: bool, furniture: bool) -> DataFrame:
    drop = [] if furniture else [*NOISE, "header", "footer"]
    drop += [] if tables else ["table"]
    drop += [] if toc else ["toc", "toc_heading"]
    return blocks.where(~F.coalesce(F.col("block_type").isin(*drop), F.lit(False)) & (tx.strip("text") != ""))


def _joined(df: DataFrame, sep: str = "\n\n") -> DataFrame:
    return df.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "_t"))), lambda x: x["_t"]), sep).alias("text"))


def markdown(blocks: DataFrame, page_markers: bool = True, tables: bool = True, toc: bool = False, furniture: bool = False) -> DataFrame:
    """doc_id and text: headings at their level (2 if unknown, 1 to 6), a comment where the page turns, other blocks as they are."""
    df = _kept(blocks, tables, toc, furniture)
    w = Window.partitionBy("doc_id").orderBy("ord")
    turn = ~F.coalesce(F.lag("page_number").over(w) == F.col("page_number"), F.lit(False))
    level = F.least(F.lit(6), F.greatest(F.lit(1), F.coalesce("heading_level", F.lit(2)))).cast("int")
    body = F.when(F.col("block_type").isin(*HEADINGS), F.concat(F.repeat(F.lit("#"), level), F.lit(" "), tx.strip("text"))).otherwise(tx.strip("text"))
    page = F.coalesce("page_label", F.col("page_number").cast("string")) if "page_label" in blocks.columns else F.col("page_number").cast("string")
    df = df.withColumn("_turn", turn)
    mark = F.when(F.col("_turn"), F.concat(F.lit("<!-- page "), page, F.lit(" -->\n\n"))).otherwise("") if page_markers else F.lit("")
    return _joined(df.withColumn("_t", F.concat(mark, body)))


def plain(blocks: DataFrame, tables: bool = True, toc: bool = False, furniture: bool = False) -> DataFrame:
    return _joined(_kept(blocks, tables, toc, furniture).withColumn("_t", tx.strip("text")))


def contents(blocks: DataFrame) -> DataFrame:
    return _joined(blocks.where(F.col("block_type").isin("toc", "toc_heading")).withColumn("_t", tx.strip("text")), "\n")


def aligned(table_text: DataFrame) -> DataFrame:
    """Tables of doc_id, table_id and text (rows between bars) with bars under each other."""
    rows = table_text.select("doc_id", "table_id", F.posexplode(F.split("text", "\n")).alias("row", "line"))
    cells = rows.select("doc_id", "table_id", "row", F.posexplode(F.split(F.regexp_replace("line", r"^\|\s*|\s*\|$", ""), r"\s*\|\s*")).alias("col", "cell"))
    rule = F.col("cell").rlike("^-+$")
    wide = F.max(F.when(~rule, F.length("cell"))).over(Window.partitionBy("doc_id", "table_id", "col"))
    wide = F.greatest(F.coalesce(wide, F.lit(0)), F.lit(3)).cast("int")
    cells = cells.withColumn("_w", wide)
    shown = F.when(rule, F.repeat(F.lit("-"), F.col("_w"))).otherwise(F.concat(F.col("cell"), F.repeat(F.lit(" "), F.col("_w") - F.length("cell"))))
    lines = cells.withColumn("_s", shown).groupBy("doc_id", "table_id", "row").agg(F.concat(F.lit("| "), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "_s"))), lambda x: x["_s"]), " | "), F.lit(" |")).alias("line"))
    return lines.groupBy("doc_id", "table_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]), "\n").alias("text"))


def one_header_row(cells: DataFrame) -> DataFrame:
    """Cells whose header rows are joined to one by " > ", or that get a blank one."""
    from leafmill.operators.tables import TABLE, header_paths, spread

    paths = header_paths(cells, " > ")
    body = cells.where(F.col("table_cell_role") != "header")
    first = body.groupBy(*TABLE).agg(F.min("row_start").alias("_first"))
    body = body.join(first, list(TABLE)).withColumn("row_start", F.col("row_start") - F.col("_first") + 1).drop("_first")
    columns = spread(cells).select(*TABLE, "col").distinct()
    head = columns.join(paths, [*TABLE, "col"], "left").select(*TABLE, F.lit(0).alias("row_start"), F.col("col").alias("col_start"), F.lit(1).alias("rowspan"), F.lit(1).alias("colspan"), F.coalesce("path", F.lit("")).alias("text"), F.lit("header").alias("table_cell_role"))
    return body.select(*head.columns).unionByName(head)


def as_json(levels: dict[str, DataFrame], version: str = "1") -> DataFrame:
    """doc_id and json: one versioned object for each document with an array for each level."""
    out = None
    for name, df in levels.items():
        order = next((c for c in ("ord", "chunk_index", "heading_id") if c in df.columns), df.columns[1])
        own = df.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*[c for c in df.columns if c != "doc_id"]).alias("r")))).alias("_a"))
        own = own.select("doc_id", F.transform("_a", lambda x: x["r"]).alias(name))
        out = own if out is None else out.join(own, "doc_id", "full")
    return out.select("doc_id", F.to_json(F.struct(F.lit(version).alias("version"), "doc_id", *levels)).alias("json"))


def from_json(texts: DataFrame, level: str, schema: str) -> DataFrame:
    """The rows of one level of as_json()."""
    parsed = texts.select(F.from_json("json", f"struct<doc_id:long,{level}:array<struct<{schema}>>>").alias("v"))
    return parsed.select("v.doc_id", F.inline(f"v.{level}"))


def save(df: DataFrame, path: str, kind: str | None = None) -> None:
    """Write a level by the path's suffix or kind: Parquet, JSON lines or CSV; nested columns go to CSV as JSON."""
    kind = kind or path.rstrip("/").rpartition(".")[2].lower()
    if kind == "csv":
        flat = [F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("array", "struct", "map") else F.col(f"`{f.name}`") for f in df.schema.fields]
        df.select(*flat).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    elif kind in ("jsonl", "json"):
        df.write.mode("overwrite").json(path)
    else:
        df.write.mode("overwrite").parquet(path)


def save_all(levels: dict[str, DataFrame], folder: str) -> None:
    """One Parquet table for each level."""
    for name, df in levels.items():
        df.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}")


def outline(paths: DataFrame) -> DataFrame:
    """doc_id and text: headings in reading order, indented by depth."""
    line = F.concat(F.repeat(F.lit("  "), F.col("depth") - 1), F.col("text"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("preorder", line.alias("l")))), lambda x: x["l"])
    return paths.groupBy("doc_id").agg(F.array_join(parts, "\n").alias("text"))


def dump(steps: dict[str, DataFrame], folder: str) -> None:
    """One CSV table for each step of a run, in order and with the document and order columns first; nested columns as JSON."""
    lead = ("doc_id", "page_number", "ord", "line_id", "block_id", "chunk_index")
    for k, (name, df) in enumerate(steps.items(), start=1):
        columns = [c for c in lead if c in df.columns] + sorted(c for c in df.columns if c not in lead)
        save(df.select(*[F.col(f"`{c}`") for c in columns]), f"{folder.rstrip('/')}/{k:02d}_{name}", "csv")
