"""spark-submit leafmill/cli.py FOLDER OUT [--recursive]: chunks, headings and metadata of the office and HTML files of a folder as Parquet."""

from __future__ import annotations

import argparse
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators import blocks, chunks, export, headings, hierarchy, rollup, structure
from leafmill.functions import text as tx
from leafmill.parse import Config
from leafmill.plans.session import importable
from leafmill.plans.staging import staged
from leafmill.sources import detect, ooxml, pages


def levels(lines: DataFrame, config: Config | None = None) -> dict[str, DataFrame]:
    """Headings and chunks of lines of any source."""
    found = staged(headings.detect(structure.marked(lines)))
    placed = staged(hierarchy.tree(found).withColumn("heading_level", F.col("heading_level").cast("long")))
    made = blocks.with_block_id(found.withColumn("layout_id", F.coalesce("layout_id", F.col("ord"))))
    merged = made.groupBy("doc_id", "block_id").agg(F.min("ord").alias("ord"), F.min_by("page_number", "ord").alias("page_number"), F.min_by("block_type", "ord").alias("block_type"), F.min_by("heading_id", "ord").alias("heading_id"), rollup.ordered_join(tx.strip("text"), F.col("ord"), blocks.separator(F.col("text"))).alias("text"))
    named = found.where("heading_id IS NOT NULL").groupBy("doc_id", "heading_id").agg(F.min("ord").alias("ord"), F.min_by("text", "ord").alias("text"))
    full = merged.join(placed, ["doc_id", "heading_id"], "left")
    return {"blocks": full, "headings": named.join(placed, ["doc_id", "heading_id"], "left"), "chunks": chunks.build(full, config.sizes, config.merge_small) if config else chunks.build(full)}


def parse_folder(spark: SparkSession, folder: str, recursive: bool = False, config: Config | None = None) -> dict[str, DataFrame]:
    """Levels of all supported files of a folder, and errors of those that cannot be read."""
    files = staged(detect.read_folder(spark, folder, recursive).select("doc_id", "path", "kind", "content"))
    return parse_files(files, config) | {"files": files.drop("content")}


def parse_files(files: DataFrame, config: Config | None = None) -> dict[str, DataFrame]:
    """Levels of files (doc_id, path, kind, content), and errors of those that cannot be read."""
    web = staged(pages.parse(files.where("kind = 'html'").withColumn("content", F.make_valid_utf8(F.col("content").cast("string"))), "doc_id", "content"))
    word, deck, scan = staged(ooxml.read_word(files)), staged(ooxml.read_slides(files)), staged(detect.pdf_words(files))
    office = [ooxml.lines(word.where("error IS NULL")), ooxml.lines(deck.where("error IS NULL"), slides=True)]
    every = headings.with_style(pages.lines(pages.without_furniture(pages.boxes(web))))
    for df in office:
        counted = df.withColumns(tx.features("text") | {"link_type": tx.link_type("link_url"), "has_link": F.col("link_url").isNotNull()})
        every = every.unionByName(headings.with_style(counted), allowMissingColumns=True)
    errors = reduce(DataFrame.unionByName, [df.select("doc_id", "error") for df in (web, word, deck, scan)]).where("error IS NOT NULL")
    return levels(every, config) | {"errors": errors}


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("folder")
    parser.add_argument("out")
    parser.add_argument("--recursive", action="store_true")
    given = parser.parse_args()
    spark = importable(SparkSession.builder.appName("leafmill").getOrCreate())
    export.save_all(parse_folder(spark, given.folder, given.recursive), given.out)


if __name__ == "__main__":
    main()
