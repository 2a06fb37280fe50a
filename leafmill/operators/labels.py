"""Printed page labels: candidates on lines, and the series of them that number the pages.

Both choices are made per document over its few candidates: greedily by long series where pages are not known (HTML), or as the
best path over pages where they are (PDF).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import text as tx


def candidates(lines: DataFrame) -> DataFrame:
    """doc_id, ord, page_number, token, kind, value and prefix of lines that are a page label, alone or after "Page"."""
    token = F.regexp_replace(F.regexp_replace(tx.strip("text"), r"(?i)^page\s+", ""), r"(?i)\s+of\s+\d+$", "")
    token = F.regexp_replace(token, r"^[-–—\s]+|[-–—\s]+$", "")
    df = lines.withColumn("token", token).withColumn("kind", tx.page_label_type("token")).where("kind IS NOT NULL")
    return df.select("doc_id", "ord", "page_number", "token", "kind", tx.label_value("token", F.col("kind")).cast("long").alias("value"), F.coalesce(tx.label_prefix("token", F.col("kind")), F.lit("")).alias("prefix"))


def embedded(text) -> Column:
    """The page label inside a longer text: N of "N of M" at its end (0 < N <= M), what stands after the last bar, or a last word with a hyphen."""
    t = tx.strip(text)
    n, m = (F.regexp_extract(t, r"(?i)\b(\d{1,4})\s+of\s+(\d{1,4})\s*$", k) for k in (1, 2))
    counted = F.when((n != "") & (n.try_cast("int") > 0) & (n.try_cast("int") <= m.try_cast("int")), n)
    after = F.when(t.contains("|"), F.nullif(F.trim(F.substring_index(t, "|", -1)), F.lit("")))
    last = F.when(t.contains(" ") & F.substring_index(t, " ", -1).contains("-"), F.substring_index(t, " ", -1))
    return F.coalesce(counted, after, last)


def without_crowds(found: DataFrame, lines: DataFrame, most_in_band: int = 3) -> DataFrame:
    """Candidates outside contents, tables and lines with a link, on pages whose first or last lines hold at most most_in_band of them: a crowd of labels is a list, no page number."""
    hidden = lines.where(F.coalesce(F.col("block_type").isin("toc", "toc_heading", "table", "exhibits"), F.lit(False)) | F.coalesce(F.col("has_link"), F.lit(False))).select("doc_id", "ord")
    kept = found.join(hidden, ["doc_id", "ord"], "left_anti")
    page = Window.partitionBy("doc_id", "page_number")
    kept = kept.withColumn("_n", F.count(F.lit(1)).over(page)).where(F.col("_n") <= most_in_band)
    return kept.drop("_n")


def alternating(sides: list[str]) -> bool:
    """Whether labels stand left and right in turn, as in a bound book: four at least, and all but one in five change sides."""
    turns = [a != b for a, b in zip(sides, sides[1:])]
    return len(sides) >= 4 and set(sides) <= {"left", "right"} and sum(turns) >= 0.8 * len(turns)


def best_series(rows: list[tuple[int, str, str, int]], least: int = 3) -> list[int]:
    """Indexes of the rows (place, kind, prefix, value) that number pages: of all runs that count on by one in one kind and prefix, the longest first, as long as their stretches do not overlap."""
    open_runs: dict[tuple, list[int]] = {}
    runs = []
    for i, (_, kind, prefix, value) in enumerate(rows):
        run = open_runs.pop((kind, prefix, value), [])
        if not run:
            runs.append(run)
        run.append(i)
        open_runs[kind, prefix, value + 1] = run
    taken: list[tuple[int, int]] = []
    chosen = []
    for run in sorted((r for r in runs if len(r) >= least), key=lambda r: (-len(r), r[0])):
        low, high = rows[run[0]][0], rows[run[-1]][0]
        if all(high < a or b < low for a, b in taken):
            taken.append((low, high))
            chosen += run
    return sorted(chosen)


def label_series(found: DataFrame, least: int = 3) -> DataFrame:
    """doc_id, ord and page_label of the candidates that number pages."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.dropna(subset=["value"]).sort_values("ord").reset_index(drop=True)
        picked = best_series(list(rows[["ord", "kind", "prefix", "value"]].itertuples(index=False, name=None)), least)
        return rows.loc[picked, ["doc_id", "ord", "token"]].rename(columns={"token": "page_label"})

    return found.groupBy("doc_id").applyInPandas(run, "doc_id long, ord long, page_label string")


def best_path(pages: list[list[tuple[str, str, int, float]]], blank: float = 0.0, step: float = 2.0, change: float = -1.0) -> list[int | None]:
    """For each page the index of its label (kind, prefix, value, score) or None on the best path: a label that counts on from the last one by the pages between gains step, another kind or value costs change."""
    states: list[tuple[float, tuple | None, tuple]] = [(0.0, None, ())]
    for n, options in enumerate(pages):
        found: dict[tuple | None, tuple[float, tuple | None, tuple]] = {}
        for total, last, path in states:
            moves = [(total + blank, last, (*path, None))]
            for k, (kind, prefix, value, score) in enumerate(options):
                fits = last is not None and last[:2] == (kind, prefix) and value - last[2] == n - last[3]
                gain = score + (step if fits else change if last is not None else 0.0)
                moves.append((total + gain, (kind, prefix, value, n), (*path, k)))
            for move in moves:
                # Labels that predict the same next label are one state.
                key = move[1] and (*move[1][:2], move[1][2] - move[1][3])
                if key not in found or move[0] > found[key][0]:
                    found[key] = move
        states = list(found.values())
    return list(max(states, key=lambda s: s[0])[2]) if pages else []


def label_path(found: DataFrame) -> DataFrame:
    """doc_id, page_number and page_label on the best path over the pages; found has score too."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.dropna(subset=["value"]).sort_values(["page_number", "ord"])
        numbers = list(range(int(rows["page_number"].min()), int(rows["page_number"].max()) + 1)) if len(rows) else []
        held = {p: g for p, g in rows.groupby("page_number")}
        options = [[(r.kind, r.prefix, int(r.value), float(r.score)) for r in held[p].itertuples()] if p in held else [] for p in numbers]
        out = [(int(rows["doc_id"].iloc[0]), p, held[p]["token"].iloc[k]) for p, k in zip(numbers, best_path(options)) if k is not None]
        return pd.DataFrame(out, columns=["doc_id", "page_number", "page_label"])

    return found.groupBy("doc_id").applyInPandas(run, "doc_id long, page_number long, page_label string")


def with_place_score(found: DataFrame, reach: int = 5) -> DataFrame:
    """score of candidates: near the page's top or bottom, and of the kind that most candidates within reach pages have."""
    page = Window.partitionBy("doc_id", "page_number")
    edge = (F.col("ord") == F.min("ord").over(page)) | (F.col("ord") == F.max("ord").over(page))
    counts = found.groupBy("doc_id", "page_number", "kind").agg(F.count(F.lit(1)).alias("_n"))
    near = Window.partitionBy("doc_id", "kind").orderBy("page_number").rangeBetween(-reach, reach)
    every = Window.partitionBy("doc_id").orderBy("page_number").rangeBetween(-reach, reach)
    share = counts.withColumn("_share", F.sum("_n").over(near) / F.sum("_n").over(every)).select("doc_id", "page_number", "kind", "_share")
    df = found.withColumn("_edge", edge).join(share, ["doc_id", "page_number", "kind"])
    return df.withColumn("score", F.when(F.col("_edge"), 1.0).otherwise(0.25) + F.when(F.col("_share") > 0.5, 0.5).otherwise(0.0)).drop("_edge", "_share")


def line_numbers(words: DataFrame, least_pages: float = 0.8, least_run: int = 4) -> DataFrame:
    """doc_id, page_number and word_id of numbers in the margin that count lines: leftmost integers of one right edge that grow down the page, on most pages."""
    left = F.min("x_left").over(Window.partitionBy("doc_id", "page_number"))
    number = F.when(F.trim("text").rlike(r"^\d{1,4}$"), F.trim("text").cast("int"))
    df = words.withColumns({"_left": left, "_v": number}).where(F.col("_v").isNotNull() & (F.col("x_left") <= F.col("_left") + 30))
    df = df.withColumn("_edge", F.round(F.col("x_right") / 3))
    w = Window.partitionBy("doc_id", "page_number", "_edge").orderBy("y_top", "word_id")
    df = df.withColumn("_up", F.coalesce(F.col("_v") > F.lag("_v").over(w), F.lit(True)))
    own = Window.partitionBy("doc_id", "page_number", "_edge")
    df = df.withColumns({"_n": F.count(F.lit(1)).over(own), "_mono": F.min(F.col("_up").cast("int")).over(own) == 1}).where(F.col("_mono") & (F.col("_n") >= least_run))
    total = words.groupBy("doc_id").agg(F.count_distinct("page_number").alias("_pages"))
    held = df.groupBy("doc_id", "_edge").agg(F.count_distinct("page_number").alias("_k")).join(total, "doc_id").where(F.col("_k") >= least_pages * F.col("_pages"))
    return df.join(held, ["doc_id", "_edge"], "left_semi").select("doc_id", "page_number", "word_id")
