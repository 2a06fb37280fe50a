"""What a file is, by its first bytes, its name and its text; and readers of whole folders."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import text as tx

SUFFIXES = {"pdf": "pdf", "docx": "docx", "pptx": "pptx", "html": "html", "htm": "html", "xhtml": "html"}


def looks_like_html(text: Column) -> Column:
    """Whether text is HTML itself and no path: a doctype, a root or body element, or a closed element near its start."""
    head = F.lower(F.substring(F.regexp_replace(tx.text(text), r"^\s+", ""), 1, 512))
    return tx.any_of(head.startswith("<!doctype html"), head.startswith("<html"), head.contains("<body"), head.contains("<head"), head.rlike(r"^<[a-z][^>]*>.*</[a-z]+>"))


def kind_of(content: Column, path: Column) -> Column:
    """pdf, zip (an office file still to be told apart), html or unknown: first bytes, then the name's suffix, then the text."""
    magic = F.hex(F.substring(content, 1, 4))
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)(?:[?#].*)?$", 1))
    named = F.create_map(*[F.lit(x) for pair in SUFFIXES.items() for x in pair])[suffix]
    return F.when(magic == "25504446", "pdf").when(magic == "504B0304", F.when(named.isin("docx", "pptx"), named).otherwise("zip")).when(named == "html", "html").when(looks_like_html(F.make_valid_utf8(F.substring(content, 1, 2048).cast("string"))), "html").otherwise(F.coalesce(named, F.lit("unknown")))


def read_folder(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """doc_id (from path, size and time), path, content and kind of every supported file; others are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    named = files.withColumn("kind", kind_of(F.col("content"), F.col("path")))
    told = _told_apart(named)
    return told.where(F.col("kind").isin(*set(SUFFIXES.values()))).withColumn("doc_id", F.xxhash64("path", "length", "modificationTime"))


def _told_apart(files: DataFrame) -> DataFrame:
    """Archives by the part that names their kind of document."""

    @F.pandas_udf("string")
    def inside(content):
        def of(data):
            if data is None:
                return None
            try:
                names = set(zipfile.ZipFile(io.BytesIO(data)).namelist())
            except zipfile.BadZipFile:
                return "unknown"
            return "docx" if "word/document.xml" in names else "pptx" if "ppt/presentation.xml" in names else "unknown"

        return content.map(of)

    known = F.when(F.col("kind") == "zip", inside(F.when(F.col("kind") == "zip", F.col("content")))).otherwise(F.col("kind"))
    return files.withColumn("kind", known)


def decoded(files: DataFrame, decode, schema: str) -> DataFrame:
    """Rows of decode(bytes) -> list of dicts for every file, with doc_id; a file that fails gives one row with its error and no file stops the others."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    full = T._parse_datatype_string(f"doc_id long, error string, {schema}")
    arrow = to_arrow_schema(full)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    rows = [{"doc_id": doc, "error": None} | r for r in decode(content.as_py())]
                except Exception as e:  # noqa: BLE001  a bad file is a row, not the end of the job
                    rows = [{"doc_id": doc, "error": f"{type(e).__name__}: {e}"}]
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return files.select("doc_id", "content").mapInArrow(run, full)


def pdf_words(files: DataFrame) -> DataFrame:
    """Words of PDF files, if a decoder is installed; else each file's row says that none is."""

    def decode(data: bytes) -> list[dict]:
        try:
            import pypdfium2
        except ImportError as e:
            raise RuntimeError("no PDF decoder is installed") from e
        out = []
        for number, page in enumerate(pypdfium2.PdfDocument(data), start=1):
            text = page.get_textpage()
            height = page.get_height()
            for k in range(text.count_rects()):
                left, bottom, right, top = text.get_rect(k)
                out.append({"page_number": number, "word_id": k, "text": text.get_text_bounded(left, bottom, right, top), "x_left": left, "y_top": height - top, "x_right": right, "y_bottom": height - bottom})
        return out

    return decoded(files.where("kind = 'pdf'"), decode, "page_number long, word_id long, text string, x_left double, y_top double, x_right double, y_bottom double")
