"""The tree of headings. Weights are windows; the walk that keeps a path of open headings runs per document, on headings only."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.operators.headings import NUMBERED
from leafmill.operators.passes import per_document

#: Kinds of heading by rank, the strongest first (fixed values). Those of rank 0 begin a new tree.
RANKS = (
    ("exhibit", "volume", "appendix", "annex", "schedule", "attachment", "form", "book", "amendment", "endnote"),
    ("title",),
    ("subtitle",),
    ("chapter", "part"),
    ("subchapter", "subpart", "item", "division"),
    ("subdivision",),
    ("note", "section", "proposal"),
    ("subsection", "section_symbol", "section_abbreviated"),
    ("article", "rule"),
    ("free_form",),
    ("table", "figure"),
)
RANK = {kind: rank for rank, kinds in enumerate(RANKS) for kind in kinds}
WEIGHTS = {"is_bold": 1.0, "is_uppercase": 1.0, "is_italic": -0.5}
CENTERED = 1.0


def with_weights(headings: DataFrame) -> DataFrame:
    """static (from style) and dynamic (against the heading before it in its section) of each heading."""
    static = sum((F.when(F.coalesce(F.col(c), F.lit(False)), w).otherwise(0.0) for c, w in WEIGHTS.items()), F.lit(0.0)) + F.when(F.lower("text_align") == "center", CENTERED).otherwise(0.0)
    rank = F.create_map(*[F.lit(x) for k, v in RANK.items() for x in (k, v)])[F.col("heading_type")]
    w = Window.partitionBy("doc_id", F.coalesce("section", F.lit(""))).orderBy("ord")
    sign = lambda a, b: F.coalesce(F.signum((a - b).cast("double")), F.lit(0.0))
    dynamic = sign(F.col("font_size_ratio"), F.lag("font_size_ratio").over(w)) + sign(F.lag(rank).over(w), rank)
    return headings.withColumns({"static": F.greatest(F.lit(0.0), static), "dynamic": dynamic})


def numeric_depth(text: str, kind: str) -> int:
    if kind in ("roman_numbered_heading", "alpha_numbered_heading"):
        return 1
    if m := re.match(r"\s*(\d+(?:\.\d+)*)", text or ""):
        return m[1].count(".") + 1
    m = re.match(r"\s*[A-Za-z]\.?\d+(?:\.\d+)*", text or "")
    return max(1, m[0].count(".")) if m else 1


class _Walk:
    """The open path while the headings of one section are read in order."""

    def __init__(self) -> None:
        self.path: list[dict] = []
        self.pairs: set[tuple] = set()

    def place(self, h: dict) -> tuple[int | None, int]:
        """Parent id and level of the next heading."""
        keep, learn = self._cut(h)
        del self.path[keep:]
        parent = self.path[-1] if self.path else None
        if parent is not None and learn:
            self.pairs.add((parent["fp"], h["fp"]))
        h["level"] = parent["level"] + 1 if parent else 1
        self.path.append(h)
        return (parent["id"] if parent else None), h["level"]

    def _cut(self, h: dict) -> tuple[int, bool]:
        """How much of the path stays above the heading, and whether the pair it makes is remembered."""
        path, numbered = self.path, h["kind"] in NUMBERED
        if not path or (RANK.get(h["kind"]) == 0 and h["block"] != "toc_heading"):
            return 0, False
        top, n = path[-1], len(path)
        if top["fp"] == h["fp"]:
            if not (numbered and top["kind"] in NUMBERED) or h["depth"] == top["depth"]:
                return n - 1, True
            if h["depth"] > top["depth"]:
                return n, True
            at = self._last(lambda x: x["kind"] in NUMBERED and x["depth"] <= h["depth"])
            return (0, False) if at is None else (at + (path[at]["depth"] < h["depth"]), True)
        if top["block"] == "heading" and not numbered and h["first"] == top["last"] + 1:
            return n, True
        if any(x["fp"] == h["fp"] for x in path):
            at = self._last(lambda x: x["fp"] == h["fp"] and x["kind"] in NUMBERED and x["depth"] <= h["depth"]) if numbered else None
            at = self._last(lambda x: x["fp"] == h["fp"]) if at is None else at
            return at + (numbered and path[at]["depth"] != h["depth"]), numbered
        total = h["static"] + h["dynamic"]
        if total < top["static"] or (total == top["static"] and (h["fp"], top["fp"]) not in self.pairs):
            return n, True
        at = self._last(lambda x: x["kind"] not in ("free_form", "table", "figure"))
        if at is not None:
            return at + 1, True
        return (0 if RANK.get(h["kind"], 99) <= 2 else n - 1), True

    def _last(self, test) -> int | None:
        return next((i for i in range(len(self.path) - 1, -1, -1) if test(self.path[i])), None)


_TREE = "heading_id long, parent_heading_id long, heading_level int"
_READ = ("heading_id", "heading_fp", "heading_type", "block_type", "section", "text", "static", "dynamic")


def placed(rows: list[tuple]) -> list[tuple]:
    """heading_id, parent and level of the headings of a document; rows are its heading lines in order, with what _READ names."""
    own: dict[tuple, list[tuple]] = {}
    for row in rows:
        own.setdefault((row[5] or "", row[1]), []).append(row)
    out, walks = [], {}
    for (section, hid), lines in own.items():
        first, _, fp, kind, block, _, text, static, dynamic = lines[0]
        kind = kind or "free_form"
        h = {"id": hid, "fp": fp, "kind": kind, "block": block, "static": static, "dynamic": dynamic, "depth": numeric_depth(text, kind), "first": first, "last": lines[-1][0]}
        out.append((hid, *walks.setdefault(section, _Walk()).place(h)))
    return out


def tree(headings: DataFrame) -> DataFrame:
    """doc_id, heading_id, parent_heading_id and heading_level. headings are lines with heading_id, in order; a section has a tree of its own."""
    return per_document(with_weights(headings.where("heading_id IS NOT NULL")), {c: F.col(c) for c in _READ}, _TREE, placed)
