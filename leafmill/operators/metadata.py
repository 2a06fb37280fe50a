"""Measures of whole documents: pages, need of OCR, title, authors and language from the text, and the choice among sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import text as tx

#: Words that give a language away (fixed values).
LANGUAGE_WORDS = {
    "en": ("the", "and", "of", "to", "in", "is", "that", "it", "for", "with"),
    "de": ("der", "die", "das", "und", "nicht", "ist", "mit", "von", "ein", "zu"),
    "fr": ("le", "la", "les", "et", "des", "que", "est", "pour", "dans", "un"),
    "es": ("el", "la", "los", "de", "que", "y", "en", "un", "por", "con"),
}
#: Given names in lower case that mark a line as naming an author (a sample; the list is a parameter).
GIVEN_NAMES = ("james", "john", "robert", "michael", "william", "david", "mary", "patricia", "jennifer", "linda", "elizabeth", "anna", "peter", "thomas", "maria", "paul", "laura", "sarah", "daniel", "emma")
#: Names of tools and placeholders that are no authors (fixed values).
NO_AUTHORS = ("admin", "administrator", "user", "unknown", "author", "owner", "microsoft", "word", "acrobat", "adobe", "scanner", "default", "test", "na", "n/a", "none", "anonymous")


def page_info(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, page_count, page_width, page_height, page_format, mixed_page_sizes and char_count; pages has page_number, width and height."""
    sizes = pages.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("page_count"),
        F.min_by("width", "page_number").alias("page_width"),
        F.min_by("height", "page_number").alias("page_height"),
        (F.count_distinct(F.round("width", 1), F.round("height", 1)) > 1).alias("mixed_page_sizes"),
    )
    chars = lines.groupBy("doc_id").agg(F.sum(F.length(tx.text("text"))).alias("char_count"))
    return sizes.withColumn("page_format", tx.page_format(F.col("page_width"), F.col("page_height"))).join(chars, "doc_id", "left").withColumn("char_count", F.coalesce("char_count", F.lit(0)))


def ocr_need(pages: DataFrame, images: DataFrame, lines: DataFrame, few_chars: int = 80, least_cover: float = 0.6, least_pages: float = 0.6) -> DataFrame:
    """doc_id, image_pages and needs_ocr: pages of few characters that are mostly image, and whether most pages are."""
    area = images.groupBy("doc_id", "page_number").agg(F.sum((F.col("x_right") - F.col("x_left")) * (F.col("y_bottom") - F.col("y_top"))).alias("_a"))
    chars = lines.groupBy("doc_id", "page_number").agg(F.sum(F.length(tx.text("text"))).alias("_c"))
    got = pages.join(area, ["doc_id", "page_number"], "left").join(chars, ["doc_id", "page_number"], "left")
    scanned = (F.coalesce("_c", F.lit(0)) < few_chars) & (F.coalesce("_a", F.lit(0.0)) / (F.col("width") * F.col("height")) > least_cover)
    out = got.groupBy("doc_id").agg(F.sum(F.when(scanned, 1).otherwise(0)).alias("image_pages"), F.count(F.lit(1)).alias("_n"))
    return out.select("doc_id", "image_pages", (F.col("image_pages") / F.col("_n") > least_pages).alias("needs_ocr"))


def title_from_text(lines: DataFrame) -> DataFrame:
    """doc_id and title: the line of the largest type on the first three pages, of more than five characters; the first of equals."""
    near = lines.where((F.col("page_number") <= 3) & (F.length(tx.strip("text")) > 5))
    return near.groupBy("doc_id").agg(F.max_by(tx.strip("text"), F.struct(F.col("font_size"), -F.col("ord"))).alias("title"))


def author_lines(lines: DataFrame, names: tuple[str, ...] = GIVEN_NAMES, within: int = 20, most: int = 5) -> DataFrame:
    """doc_id, ord and author: lines among the first that are short, in title case, and hold a given name."""
    words = tx.words(F.lower("text"))
    named = F.exists(words, lambda w: F.regexp_replace(w, r"[^\p{L}]", "").isin(*names))
    found = lines.where((F.col("ord") <= within) & (F.length("text") <= 100) & tx.is_title_case("text") & named)
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord"))
    return found.withColumn("_k", rank).where(F.col("_k") <= most).select("doc_id", "ord", tx.strip("text").alias("author"))


def is_fake_author(name: Column) -> Column:
    """Names of tools and placeholders as whole words, and names without letters."""
    words = F.split(F.lower(tx.strip(name)), r"[\s,._-]+")
    return ~name.rlike(r"\p{L}") | F.exists(words, lambda w: w.isin(*NO_AUTHORS))


def language_vote(documents: DataFrame, within: int | None = 10_000, least: int = 50) -> DataFrame:
    """doc_id, language and votes: the language whose words are most among the first within characters (all of them if within is None); none under least characters or without votes; ties go to the first by name."""
    seen = F.col("text") if within is None else F.substring("text", 1, within)
    words = F.regexp_extract_all(F.lower(seen), F.lit(r"\p{L}+"), F.lit(0))
    counts = F.array(*[F.struct(_votes(own).alias("n"), F.lit(code).alias("code")) for code, own in sorted(LANGUAGE_WORDS.items())])
    got = documents.select("doc_id", F.length("text").alias("_n"), words.alias("_w")).withColumn("_v", counts)
    best = F.array_sort(F.transform("_v", lambda v: F.struct((-v["n"]).alias("n"), v["code"].alias("code"))))
    top = F.get(best, F.lit(0))
    return got.select("doc_id", F.when((F.col("_n") >= least) & (top["n"] < 0), top["code"]).otherwise("unknown").alias("language"), F.coalesce(-top["n"], F.lit(0)).cast("long").alias("votes"))


def _votes(own: tuple[str, ...]) -> Column:
    return F.size(F.filter("_w", lambda w: w.isin(*own)))


def consolidate(native: DataFrame, from_text: DataFrame) -> DataFrame:
    """doc_id, title, author and language: what the file says, else what its text shows; authors that are none are dropped."""
    n, t = native.select("doc_id", *[F.col(c).alias(f"n_{c}") for c in ("title", "author", "language")]), from_text.select("doc_id", *[F.col(c).alias(f"t_{c}") for c in ("title", "author", "language")])
    got = n.join(t, "doc_id", "full")
    real = lambda c: F.when(~is_fake_author(F.col(c)), F.col(c))
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return got.select("doc_id", F.coalesce(blank("n_title"), blank("t_title")).alias("title"), F.coalesce(real("n_author"), real("t_author")).alias("author"), F.coalesce(F.nullif(F.col("n_language"), F.lit("unknown")), F.col("t_language"), F.lit("unknown")).alias("language"))
