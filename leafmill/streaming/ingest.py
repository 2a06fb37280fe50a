"""Documents that arrive as a stream: each is chunked once, and a later version of a document takes the place of the earlier one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leafmill.operators import blocks, chunks


def arrivals(spark: SparkSession, folder: str, schema: str = "doc_id long, text string, version timestamp") -> DataFrame:
    """Parquet files of documents as they land in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def once(documents: DataFrame, delay: str = "1 hour") -> DataFrame:
    """documents without repeats of one version of one text within the delay."""
    marked = documents.withColumn("fingerprint", F.xxhash64("doc_id", "text"))
    return marked.withWatermark("version", delay).dropDuplicatesWithinWatermark(["doc_id", "fingerprint"])


def line_counts(documents: DataFrame, window: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """Documents and lines that arrived in each window; late ones within the delay count."""
    sized = documents.withColumn("lines", F.size(F.split("text", "\n")))
    return sized.withWatermark("version", delay).groupBy(F.window("version", window)).agg(F.count(F.lit(1)).alias("documents"), F.sum("lines").alias("lines"))


def chunk_batch(documents: DataFrame) -> DataFrame:
    """Chunks of plain documents, with the batch's latest version of each."""
    latest = documents.groupBy("doc_id").agg(F.max_by("text", "version").alias("text"), F.max("version").alias("version"))
    laid = blocks.paragraph_layout(blocks.lines(latest)).withColumn("heading_id", F.lit(None).cast("long"))
    made = blocks.blocks(blocks.with_block_id(laid)).withColumns({"block_type": F.lit("paragraph"), "heading_id": F.lit(None).cast("long")})
    return chunks.build(made).join(latest.select("doc_id", "version"), "doc_id")


def run(documents: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Chunk whatever has arrived and stop. Each batch is a folder of its own, so a repeated batch overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        chunk_batch(batch).write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={number}")

    return documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, out: str) -> DataFrame:
    """Chunks of the latest version of every document."""
    every = spark.read.parquet(out)
    last = every.groupBy("doc_id").agg(F.max(F.struct("version", "batch")).alias("_l")).select("doc_id", "_l.version", "_l.batch")
    return every.join(last, ["doc_id", "version", "batch"], "left_semi").drop("batch")
