"""HTML pages as relations: boxes, lines, table cells and metadata of many pages at once."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.functions import text as tx
from leafmill.operators.rollup import ordered_join
from leafmill.sources.htmltree import Boxes

BOX = (
    "ord long, kind string, text string, tag string, block_no long, split_reason string, ancestors array<string>, roles array<string>, keywords array<string>, link_url string, is_bold boolean, is_italic boolean, is_underlined boolean, "
    "is_strikethrough boolean, script_type string, font_size double, font_family string, text_align string, non_stroking_color string, table_id long, row_start long, col_start long"
)
CELL = "table_id long, row_start long, col_start long, rowspan long, colspan long, table_header_flag boolean, text string"
PARSED = f"doc_id long, boxes array<struct<{BOX.replace(' ', ':').replace(',:', ',')}>>, cells array<struct<{CELL.replace(' ', ':').replace(',:', ',')}>>, meta map<string,string>, error string"

# Elements, roles and class words of page furniture.
FURNITURE_TAGS = ("nav", "footer", "aside", "header", "form", "button", "menu", "dialog")
FURNITURE_ROLES = ("navigation", "banner", "contentinfo", "search", "complementary", "menu", "dialog", "alert")
FURNITURE_WORDS = ("ad", "ads", "advert", "advertisement", "banner", "breadcrumb", "breadcrumbs", "cookie", "comments", "footer", "menu", "modal", "nav", "navbar", "newsletter", "popup", "promo", "related", "share", "sidebar", "social", "sponsored", "subscribe", "widget")


#: Characters of pages whose boxes a worker holds at once; a longer page is a batch of its own. Boxes take many times the room of their page.
BATCH_CHARS = 1 << 20


def parsed_batches(batches: Iterator[pa.RecordBatch], arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, held = [], 0
        for doc, source in zip(*batch.columns):
            doc, source = doc.as_py(), source.as_py() or ""
            try:
                p = Boxes().finish(source)
                rows.append({"doc_id": doc, "boxes": p.boxes, "cells": p.cells, "meta": list(p.meta.items()), "error": None})
            except Exception as e:  # noqa: BLE001  a bad page is a row, not the end of the job
                rows.append({"doc_id": doc, "boxes": [], "cells": [], "meta": [], "error": f"{type(e).__name__}: {e}"})
            held += len(source)
            if held >= BATCH_CHARS:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)


def parse(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """doc_id, boxes, cells, meta and error of every page. A page that cannot be read has its error and nothing else; no page stops the others."""
    schema = T._parse_datatype_string(PARSED)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    return pages.select(F.col(key).cast("long").alias("doc_id"), F.col(html).alias("html")).mapInArrow(lambda batches: parsed_batches(batches, arrow), schema)


def boxes(parsed: DataFrame) -> DataFrame:
    return parsed.select("doc_id", F.inline("boxes"))


def cells(parsed: DataFrame) -> DataFrame:
    return parsed.select("doc_id", F.inline("cells"))


def without_furniture(df: DataFrame, most: float = 0.8) -> DataFrame:
    """Boxes outside page furniture, by element, role or class word. A word that at least most of a page's boxes have marks nothing; h1 always stays."""
    n = F.count(F.lit(1)).over(Window.partitionBy("doc_id"))
    df = df.withColumn("_n", n)
    marks = F.filter("keywords", lambda w: w.isin(*FURNITURE_WORDS))
    held = df.select("doc_id", "_n", F.explode(marks).alias("w")).groupBy("doc_id", "w").agg(F.count(F.lit(1)).alias("k"), F.first("_n").alias("_n"))
    common = held.where(F.col("k") >= most * F.col("_n")).groupBy("doc_id").agg(F.collect_set("w").alias("_common"))
    df = df.join(common, "doc_id", "left")
    word = F.size(F.array_except(marks, F.coalesce("_common", F.array().cast("array<string>")))) > 0
    tag = F.exists("ancestors", lambda t: t.isin(*FURNITURE_TAGS))
    role = F.exists("roles", lambda r: r.isin(*FURNITURE_ROLES))
    return df.where(F.array_contains("ancestors", "h1") | ~(tag | role | word)).drop("_n", "_common")


def heading_level() -> Column:
    """The number of the innermost h1 to h6 around a box."""
    found = F.filter("ancestors", lambda t: t.rlike("^h[1-6]$"))
    return F.substring(F.try_element_at(found, F.lit(-1)), 2, 1).cast("int")


def lines(df: DataFrame) -> DataFrame:
    """Lines of boxes: boxes of one block join unless a break or a line of code parts them; the cells of a table row join with bars.

    font_size_ratio is against the median of the page's lines. There are no coordinates, so line_gap is null.
    """
    df = df.where(F.col("kind") == "text")
    w = Window.partitionBy("doc_id").orderBy("ord")
    row = F.when(F.col("table_id").isNotNull() & F.col("row_start").isNotNull(), F.concat_ws("-", "table_id", "row_start"))
    df = df.withColumn("_row", row)
    joined = F.when(F.col("_row").isNotNull(), F.col("_row").eqNullSafe(F.lag("_row").over(w))).otherwise((F.lag("block_no").over(w) == F.col("block_no")) & ~F.col("split_reason").isin("br", "code_line", "hr", "img") & F.lag("_row").over(w).isNull())
    df = df.withColumn("_new", ~F.coalesce(joined, F.lit(False)))
    df = df.withColumn("line_id", F.sum(F.when(F.col("_new"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    next_cell = F.col("_row").isNotNull() & ~F.col("col_start").eqNullSafe(F.lag("col_start").over(w))
    df = df.withColumn("_sep", F.when(next_cell, " | ").when(F.col("script_type").isNotNull(), "").otherwise(" "))
    shown = tx.inline_markup("text", F.col("script_type"), F.col("is_strikethrough"))
    size = F.length("text")
    ratio = lambda c: F.sum(F.when(F.col(c), size).otherwise(0)) / F.sum(size) > 0.75
    dominant = lambda c: F.max_by(c, F.struct(size, -F.col("ord")))
    out = df.groupBy("doc_id", "line_id").agg(
        F.min("ord").alias("ord"),
        ordered_join(shown, F.col("ord"), F.col("_sep")).alias("text"),
        *[ratio(f"is_{k}").alias(f"is_{k}") for k in ("bold", "italic", "underlined", "strikethrough")],
        *[dominant(c).alias(c) for c in ("font_size", "font_family", "text_align", "non_stroking_color")],
        F.array_compact(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ord", "link_url"))), lambda x: x["link_url"]))).alias("link_urls"),
        F.min_by("table_id", "ord").alias("table_id"),
        F.max(heading_level()).alias("html_level"),
        F.bool_or(F.array_contains("ancestors", "pre") | F.array_contains("ancestors", "code")).alias("_code"),
        F.bool_or(F.array_contains("ancestors", "blockquote")).alias("_quote"),
        F.min_by("block_no", "ord").alias("layout_id"),
    )
    link = F.get("link_urls", F.lit(0))
    kind = F.when(F.col("html_level").isNotNull(), "heading").when(F.col("table_id").isNotNull(), "table").when(F.col("_code"), "code").when(F.col("_quote"), "block_quote")
    out = out.withColumns(tx.features("text") | {"link_url": link, "has_link": link.isNotNull(), "link_type": tx.link_type(link), "block_type": kind, "heading_source": F.when(F.col("html_level").isNotNull(), "html"), "line_gap": F.lit(None).cast("double"), "page_number": F.lit(1).cast("long")})
    ordered = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")).cast("long")
    return out.withColumns({"font_size_ratio": F.col("font_size") / F.median("font_size").over(Window.partitionBy("doc_id")), "is_uppercase": F.coalesce(F.col("uppercase_count") / F.nullif(F.col("alpha_count"), F.lit(0)) > 0.9, F.lit(False)), "ord": ordered}).drop("_code", "_quote", "line_id")


def written_title() -> Column:
    """The title as the page has it, with the signs that markup needs decoded and all else (quotes, entities that are cut off) left as written; null without a title."""
    raw = F.trim(F.try_element_at("meta", F.lit("title_written")))
    return reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")), raw)


def metadata(parsed: DataFrame) -> DataFrame:
    """doc_id, title, author, language, published, modified, generator, url and title_written of every page: linked data first, then meta elements, then the head."""
    m = lambda k: F.nullif(F.trim(F.try_element_at("meta", F.lit(k))), F.lit(""))
    first = lambda *keys: F.coalesce(*[m(k) for k in keys])
    return parsed.select(
        "doc_id",
        first("ld:title", "og:title", "title").alias("title"),
        first("ld:author", "author", "article:author").alias("author"),
        F.coalesce(tx.normalized_language(first("lang", "og:locale", "language")), F.lit("unknown")).alias("language"),
        first("ld:published", "article:published_time", "date").alias("published"),
        first("ld:modified", "article:modified_time").alias("modified"),
        first("generator").alias("generator"),
        first("canonical", "og:url").alias("url"),
        written_title().alias("title_written"),
    )
