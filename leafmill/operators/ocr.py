"""Words that OCR read: text without its noise, font sizes by bands, colours by frequency, and rule signs that lie on rules."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import text as tx
from leafmill.operators.geometry import PAGE

# What signs that OCR and typesetting put in stand for.
LIGATURES = (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st"))
ONE_FOR_ONE = (("\xa0", " "), ("‘", "'"), ("’", "'"), ("“", '"'), ("”", '"'), ("‚", ","), ("„", '"'), ("‹", "<"), ("›", ">"), ("«", '"'), ("»", '"'), ("−", "-"), ("‐", "-"), ("‑", "-"), ("‒", "-"), ("―", "—"))
UNSEEN = "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f\\ufeff\\u200b\\u200c\\u200d]"
MISREAD_BULLETS = ("{", "=", "=m", "m=", "m", "«", "+", "—", "*", "o", "e", "s", "]", "=“", '="', "¢", "-—", "=»", "«=", "«*", '*"', "°", "0", "©")
FLAT_RULE, UPRIGHT_RULE = "^[-_=—–−]{1,2}$", "^[|¦│\\]\\[=]{1,2}$"
#: Upper bounds of heights in points, and the font size that each stands for; beyond the last, heights are rounded (fixed values).
SIZES = ((5.5, 5.0), (6.5, 6.0), (7.5, 7.0), (8.5, 8.0), (9.5, 9.0), (10.5, 10.0), (11.5, 11.0), (13.0, 12.0), (15.0, 14.0), (17.0, 16.0), (19.0, 18.0), (21.0, 20.0), (26.0, 24.0), (32.0, 28.0), (40.0, 36.0))
#: A glyph's box is smaller than its em, and a line without tall or hanging letters smaller still.
EM, MISSING = 1.18, 0.20


def cleaned_text(text: Column, open_before: Column | None = None) -> Column:
    """A word without control characters, with plain signs, without rules read as text, without closing brackets that footnote marks were read as (open_before: brackets open on the line), and without repeated signs."""
    t = F.regexp_replace(text, UNSEEN, "")
    for sign, letters in LIGATURES:
        t = F.replace(t, F.lit(sign), F.lit(letters))
    t = F.translate(t, "".join(a for a, _ in ONE_FOR_ONE), "".join(b for _, b in ONE_FOR_ONE))
    t = F.when((F.length(F.trim(t)) >= 3) & t.rlike(r"^[—–\-_=\s]+$"), "").otherwise(t)
    excess = F.regexp_count(t, F.lit(r"\)")) - F.regexp_count(t, F.lit(r"\(")) - (open_before if open_before is not None else 0)
    cut = F.aggregate(F.sequence(F.lit(1), F.greatest(excess, F.lit(1))), t, lambda acc, _: F.regexp_replace(acc, r"[^\p{L}\p{N}(]*(?<![\p{L}\p{N}])\)([^)]*)$", "$1"))
    t = F.when(excess > 0, cut).otherwise(t)
    for found, kept in ((r"\.{4,}", "..."), (",{2,}", ","), (r"\?{2,}", "?"), ("!{2,}", "!"), (" {2,}", " ")):
        t = F.regexp_replace(t, found, kept)
    return F.trim(t)


def cleaned_words(words: DataFrame) -> DataFrame:
    """words (line_id, word_id, text and, if known, is_line_start) with text cleaned and text_raw; signs at a line's start that bullets are read as become one."""
    w = Window.partitionBy(*PAGE, "line_id").orderBy("word_id").rowsBetween(Window.unboundedPreceding, -1)
    held = F.regexp_count("text", F.lit(r"\(")) - F.regexp_count("text", F.lit(r"\)"))
    df = words.withColumns({"text_raw": F.col("text"), "_open": F.greatest(F.coalesce(F.sum(held).over(w), F.lit(0)), F.lit(0))})
    clean = cleaned_text(F.col("text"), F.col("_open"))
    if "is_line_start" in words.columns:
        clean = F.when(F.coalesce(F.col("is_line_start"), F.lit(False)) & F.trim("text_raw").isin(*MISREAD_BULLETS), "•").otherwise(clean)
    return df.withColumn("text", clean).drop("_open")


def without_rule_words(words: DataFrame, shapes: DataFrame, pad: float = 3.0) -> DataFrame:
    """words whose text of one or two rule signs is blanked where it lies on a shape of that direction (shapes: shape_id, orientation horizontal or vertical)."""
    names = ("x_left", "y_top", "x_right", "y_bottom")
    s = shapes.select(*PAGE, "orientation", *[F.col(n).alias(f"s_{n}") for n in names])
    flat, upright = F.trim("text").rlike(FLAT_RULE), F.trim("text").rlike(UPRIGHT_RULE)
    few = words.where(flat | upright).select(*PAGE, "word_id", "text", *names).join(s, list(PAGE))
    wide, high = F.when(F.col("orientation") == "vertical", pad).otherwise(0.0), F.when(F.col("orientation") == "horizontal", pad).otherwise(0.0)
    over = (F.col("x_left") <= F.col("s_x_right") + wide) & (F.col("x_right") >= F.col("s_x_left") - wide) & (F.col("y_top") <= F.col("s_y_bottom") + high) & (F.col("y_bottom") >= F.col("s_y_top") - high)
    fits = ((F.col("orientation") == "horizontal") & flat) | ((F.col("orientation") == "vertical") & upright)
    gone = few.where(over & fits).select(*PAGE, "word_id").distinct().withColumn("_gone", F.lit(True))
    return words.join(gone, [*PAGE, "word_id"], "left").withColumn("text", F.when(F.col("_gone"), "").otherwise(F.col("text"))).drop("_gone")


def snapped_size(height: Column) -> Column:
    out = F.when(F.lit(False), F.lit(0.0))
    for bound, size in SIZES:
        out = out.when(height < bound, size)
    return out.otherwise(F.round(height))


def font_sizes(words: DataFrame) -> DataFrame:
    """doc_id, layout_id and font_size: the most frequent height of a layout's lines (the smallest of equals), each raised for the letters that it lacks above and below, as a font size."""
    t = F.col("text")
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    lines = words.groupBy("doc_id", "layout_id", "line_id").agg(F.median(F.greatest(F.col("y_bottom") - F.col("y_top"), F.lit(0.0))).alias("h"), any_(t.rlike("[A-Zbdfhijklt]")).alias("tall"), any_(t.rlike("[gjpqyQ]")).alias("deep"))
    raised = F.col("h") * (1 + F.when(F.col("tall"), 0.0).otherwise(MISSING) + F.when(F.col("deep"), 0.0).otherwise(MISSING))
    counts = lines.withColumn("h", F.round(raised, 1)).groupBy("doc_id", "layout_id", "h").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("doc_id", "layout_id").agg(F.max_by("h", F.struct("n", -F.col("h"))).alias("h")).select("doc_id", "layout_id", snapped_size(F.col("h") * EM).alias("font_size"))


def canonical_colors(counts: list[tuple[str, int]], most: float) -> dict[str, str]:
    """Each colour's more frequent neighbour within most in RGB, or itself; frequent ones are settled first."""
    out: dict[str, str] = {}
    centres: list[tuple[str, tuple[int, ...]]] = []
    for name, _ in sorted(counts, key=lambda c: (-c[1], c[0])):
        try:
            rgb = tuple(int(name[k : k + 2], 16) for k in (1, 3, 5))
        except ValueError:
            out[name] = name
            continue
        apart = [(sum((a - b) ** 2 for a, b in zip(rgb, other)), i) for i, (_, other) in enumerate(centres)]
        best = min(apart, default=(most * most + 1, -1))
        if best[0] <= most * most:
            out[name] = centres[best[1]][0]
        else:
            centres.append((name, rgb))
            out[name] = name
    return out


def snapped_colors(words: DataFrame, column: str = "non_stroking_color", most: float = 24.0) -> DataFrame:
    """words with colours of a document drawn to its frequent ones. Only a document's different colours and their counts reach Python."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found = canonical_colors(list(zip(rows["c"], rows["n"])), most)
        return pd.DataFrame({"doc_id": rows["doc_id"], "c": rows["c"], "to": [found[c] for c in rows["c"]]})

    counts = words.where(F.col(column).isNotNull()).groupBy("doc_id", F.col(column).alias("c")).agg(F.count(F.lit(1)).alias("n"))
    made = counts.groupBy("doc_id").applyInPandas(run, "doc_id long, c string, to string").withColumnsRenamed({"doc_id": "_d", "c": "_c", "to": "_to"})
    got = words.join(made, (words["doc_id"] == made["_d"]) & (words[column] == made["_c"]), "left")
    return got.withColumn(column, F.coalesce("_to", column)).drop("_d", "_c", "_to")


def collinear(rules: DataFrame, across: float = 2.0, along: float = 6.0) -> DataFrame:
    """Horizontal rules whose heights agree within across and that follow each other within along as one: rule_id of the first, and the box of all."""
    level = F.round((F.col("y_top") + F.col("y_bottom")) / 2 / across)
    w = Window.partitionBy(*PAGE, "_level").orderBy("x_left", "x_right", "rule_id")
    reach = F.max("x_right").over(w.rowsBetween(Window.unboundedPreceding, -1))
    df = rules.withColumn("_level", level).withColumn("_new", F.coalesce(F.col("x_left") - reach > along, F.lit(True)))
    df = df.withColumn("_run", F.sum(F.when(F.col("_new"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df.groupBy(*PAGE, "_level", "_run").agg(F.min("rule_id").alias("rule_id"), F.min("x_left").alias("x_left"), F.min("y_top").alias("y_top"), F.max("x_right").alias("x_right"), F.max("y_bottom").alias("y_bottom")).drop("_level", "_run")


def is_noise(text: Column) -> Column:
    return tx.strip(text) == ""
