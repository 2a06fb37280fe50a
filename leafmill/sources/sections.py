"""Sections of Word files: printed page labels and the headers and footers of each page, from the settings of sections.

Sections are rows of doc_id, section_id, page_number_start, page_number_format, has_title_page and has_even_and_odd; pages of doc_id,
page_number and section_id; parts of doc_id, section_id, kind (header or footer), type (first, even or default), part, has_page_field.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import text as tx


def lettered(n: Column) -> Column:
    """1 to 26 as A to Z, then AA, AB and so on to ZZ."""
    letter = lambda k: F.chr((65 + k).cast("long"))
    return F.when(n <= 26, letter(n - 1)).when(n <= 702, F.concat(letter(F.floor((n - 1) / 26) - 1), letter((n - 1) % 26)))


def formatted(n: Column, kind: Column) -> Column:
    """A page number in the format that a section asks for; decimal if it asks for none or one that is not known."""
    decimal = n.cast("string")
    made = F.when(kind == "lowerRoman", F.lower(tx.roman_text(n))).when(kind == "upperRoman", tx.roman_text(n)).when(kind == "lowerLetter", F.lower(lettered(n))).when(kind == "upperLetter", lettered(n)).when(kind == "decimalZero", F.lpad(decimal, 2, "0"))
    return F.coalesce(F.when(n > 0, made), decimal)


def numbered(pages: DataFrame, sections: DataFrame) -> DataFrame:
    """pages with page_in_section and number: a section counts from its own start, or on from the section before it; the first from its first page."""
    spans = pages.groupBy("doc_id", "section_id").agg(F.min("page_number").alias("_first"), (F.max("page_number") - F.min("page_number") + 1).alias("_n"))
    s = spans.join(sections.select("doc_id", "section_id", "page_number_start"), ["doc_id", "section_id"], "left")
    w = Window.partitionBy("doc_id").orderBy("section_id")
    own = F.coalesce("page_number_start", F.when(F.row_number().over(w) == 1, F.col("_first")))
    s = s.withColumn("_own", own).withColumn("_run", F.count("_own").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy("doc_id", "_run").orderBy("section_id")
    before = F.coalesce(F.sum("_n").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    s = s.withColumn("_start", F.first("_own").over(run) + before)
    got = pages.join(s.select("doc_id", "section_id", "_first", "_start"), ["doc_id", "section_id"], "left")
    at = F.col("page_number") - F.coalesce("_first", "page_number")
    return got.withColumns({"page_in_section": at + 1, "number": F.coalesce("_start", "page_number") + at}).drop("_first", "_start")


def furniture(pages: DataFrame, sections: DataFrame, parts: DataFrame) -> DataFrame:
    """doc_id, page_number, section_id, kind, type, part and has_page_field: the header and the footer of each page. The first page of a section that has a title page takes the part for first pages, even pages that for even ones where they differ, others the default, and without one the first that there is."""
    told = numbered(pages, sections).join(sections.select("doc_id", "section_id", "has_title_page", "has_even_and_odd"), ["doc_id", "section_id"], "left")
    got = told.join(parts, ["doc_id", "section_id"])
    first = F.coalesce("has_title_page", F.lit(False)) & (F.col("page_in_section") == 1) & (F.col("type") == "first")
    even = F.coalesce("has_even_and_odd", F.lit(False)) & (F.col("page_number") % 2 == 0) & (F.col("type") == "even")
    rank = F.when(first, 1).when(even, 2).when(F.col("type") == "default", 3).otherwise(4)
    best = F.row_number().over(Window.partitionBy("doc_id", "page_number", "section_id", "kind").orderBy(rank, "part"))
    return got.withColumn("_k", best).where("_k = 1").select("doc_id", "page_number", "section_id", "kind", "type", "part", "has_page_field")


def page_labels(pages: DataFrame, sections: DataFrame, parts: DataFrame) -> DataFrame:
    """doc_id, page_number, section_id, page_label and page_label_type: the number that the page's footer prints, where it prints one."""
    feet = furniture(pages, sections, parts).where("kind = 'footer' AND has_page_field").select("doc_id", "page_number", "section_id", F.lit(True).alias("_shown"))
    got = numbered(pages, sections).join(sections.select("doc_id", "section_id", "page_number_format"), ["doc_id", "section_id"], "left").join(feet, ["doc_id", "page_number", "section_id"], "left")
    label = F.when(F.col("_shown"), formatted(F.col("number"), F.col("page_number_format")))
    return got.withColumn("page_label", label).select("doc_id", "page_number", "section_id", "page_label", tx.page_label_type("page_label").alias("page_label_type"))


def without_invisible(runs: DataFrame) -> DataFrame:
    """runs without those in the zero-width font that some tools mark tags with."""
    return runs.where(~F.coalesce(F.lower(F.trim("font_name")) == "zwadobef", F.lit(False)))
