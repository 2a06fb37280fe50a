"""Lines of documents, and runs of lines that form blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import text as tx
from leafmill.operators.rollup import ordered_join

NOISE = ("page_label", "vertical_text", "navigation", "hr", "image", "suppressed_repeated_heading")
HEADINGS = ("heading", "toc_heading", "exhibit_heading", "hybrid_heading_paragraph")


def lines(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ord (from 1) and text of every line; a null text has none."""
    return documents.select(F.col(key).alias("doc_id"), F.posexplode(F.split(text, "\n")).alias("ord", "text")).withColumn("ord", (F.col("ord") + 1).cast("long"))


def with_features(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumns(tx.features(text))


def document_window(*order: str) -> Window:
    return Window.partitionBy("doc_id").orderBy(*(order or ("ord",)))


def islands(starts: Column, window: Window) -> Column:
    """Number of the run that a row is in, counted from 1; starts marks the first row of each run."""
    return F.sum(F.when(starts, 1).otherwise(0)).over(window.rowsBetween(Window.unboundedPreceding, 0))


def with_block_id(df: DataFrame) -> DataFrame:
    """block_id of lines with layout_id and heading_id: a new block where the layout changes, unless both lines share a heading, and where known headings differ."""
    w = document_window()
    h, before = F.col("heading_id"), F.lag("heading_id").over(w)
    layout = ~F.col("layout_id").eqNullSafe(F.lag("layout_id").over(w))
    starts = F.lag("ord").over(w).isNull() | (layout & ~F.coalesce(h == before, F.lit(False))) | F.coalesce(h != before, F.lit(False))
    return df.withColumn("_starts", starts).withColumn("block_id", islands(F.col("_starts"), w)).drop("_starts")


def paragraph_layout(df: DataFrame) -> DataFrame:
    """layout_id of plain lines: a table row (cells between bars) and other text do not share a layout, nor do lines across a blank one."""
    w = document_window()
    row = F.col("text").contains(" | ")
    blank = tx.strip("text") == ""
    starts = F.lag("ord").over(w).isNull() | ~row.eqNullSafe(F.lag(row).over(w)) | F.coalesce(F.lag(blank).over(w), F.lit(False))
    return df.withColumn("_starts", starts).withColumn("layout_id", islands(F.col("_starts"), w)).drop("_starts")


def separator(text: Column, block_type: Column | None = None, marker: Column | None = None) -> Column:
    """What leads a line that is joined to the one before: a new line for contents, bullets and markers, else a space."""
    own = tx.is_bullet_line(text)
    if block_type is not None:
        own = own | block_type.isin("toc", "exhibits")
    if marker is not None:
        own = own | marker.isNotNull()
    return F.when(own, "\n").otherwise(" ")


def blocks(df: DataFrame) -> DataFrame:
    """doc_id, block_id, ord, text, n_lines and embed_char_count of the blocks of lines with block_id; blank lines add nothing."""
    t = tx.strip("text")
    kept = F.when(t != "", t)
    out = df.groupBy("doc_id", "block_id").agg(F.min("ord").alias("ord"), F.count(F.lit(1)).alias("n_lines"), ordered_join(kept, F.col("ord"), separator(F.col("text"))).alias("text"))
    return out.withColumn("embed_char_count", F.length("text").cast("long"))


def attach_flag(text: Column, before: Column, dehyphenate: bool = False) -> Column:
    """Whether a fragment joins the one before without a separator: script marks do, and parts of a hyphenated word if asked."""
    flag = F.substring(text, 1, 2).isin("[^", "[_")
    return flag | (before.endswith("-") & (F.length(before) > 1)) if dehyphenate else flag


def join_fragments(df: DataFrame, by: list[str], sep: str = " ", dehyphenate: bool = False, bullet_sep: str | None = None) -> DataFrame:
    """by and text: the fragments of each group in order; blank ones are skipped."""
    kept = df.where(tx.strip("text") != "")
    kept = kept.withColumn("_before", F.lag("text").over(Window.partitionBy(*by).orderBy("ord")))
    attach, own = F.coalesce(attach_flag(F.col("text"), F.col("_before"), dehyphenate), F.lit(False)), F.lit(sep)
    if bullet_sep is not None:
        attach, own = attach & ~tx.is_strict_bullet("text"), F.when(tx.is_strict_bullet("text"), bullet_sep).otherwise(sep)
    return kept.groupBy(*by).agg(ordered_join(F.col("text"), F.col("ord"), own, attach).alias("text"))


def join_table_row(df: DataFrame, by: list[str], sep: str = " | ") -> DataFrame:
    t = tx.strip("text")
    return df.groupBy(*by).agg(ordered_join(F.when(t != "", t), F.col("ord"), sep).alias("text"))


def with_active_heading(df: DataFrame) -> DataFrame:
    """active_heading_id: the last heading at or before each block."""
    w = document_window().rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("active_heading_id", F.last("heading_id", ignorenulls=True).over(w))


def without_noise(df: DataFrame) -> DataFrame:
    return df.where(~F.coalesce(F.col("block_type").isin(*NOISE), F.lit(False)))
