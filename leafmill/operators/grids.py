"""Rules, grids and columns on pages: components of touching lines, cells between rules, rows of wrapped cells, columns of tables, gutters.

Grouped functions work on one page (or one grid) at a time.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.operators.geometry import PAGE

BOX = ("x_left", "y_top", "x_right", "y_bottom")


class Union:
    """Sets of 0 to n - 1 that can be joined."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def touching(boxes: list[tuple[float, float, float, float]], tolerance: float = 2.0) -> list[int]:
    """A number for each box, equal for boxes that touch within the tolerance, directly or through others; a sweep from the left compares near ones only."""
    sets = Union(len(boxes))
    order, live = sorted(range(len(boxes)), key=lambda i: boxes[i][0]), []
    for i in order:
        left, top, _, bottom = boxes[i]
        live = [j for j in live if boxes[j][2] + tolerance >= left]
        for j in live:
            if boxes[j][1] - tolerance <= bottom and top <= boxes[j][3] + tolerance:
                sets.join(i, j)
        live.append(i)
    seen: dict[int, int] = {}
    return [seen.setdefault(sets.root(i), len(seen) + 1) for i in range(len(boxes))]


def components(shapes: DataFrame, key: str = "shape_id", tolerance: float = 2.0) -> DataFrame:
    """doc_id, page_number, key and component of the shapes of each page."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(key)
        return rows.assign(component=touching(list(rows[list(BOX)].itertuples(index=False, name=None)), tolerance))[["doc_id", "page_number", key, "component"]]

    return shapes.select(*PAGE, key, *BOX).groupBy(*PAGE).applyInPandas(run, f"doc_id long, page_number long, {key} long, component long")


def merged_places(values: list[float], tolerance: float = 3.0) -> list[float]:
    """Means of values that lie within the tolerance of the one before."""
    groups: list[list[float]] = []
    for v in sorted(values):
        if groups and v - groups[-1][-1] <= tolerance:
            groups[-1].append(v)
        else:
            groups.append([v])
    return [sum(g) / len(g) for g in groups]


def cells_between(rules: list[tuple[float, float, float, float]], tolerance: float = 3.0) -> list[tuple[int, int, int, int, float, float, float, float]]:
    """Row, column, row span, column span and box of the cells that horizontal and vertical rules enclose; a missing inner rule joins cells."""
    flat = [r for r in rules if r[3] - r[1] <= r[2] - r[0]]
    upright = [r for r in rules if r not in flat]
    ys, xs = merged_places([r[1] for r in flat], tolerance), merged_places([r[0] for r in upright], tolerance)
    rows, cols = len(ys) - 1, len(xs) - 1
    if rows < 1 or cols < 1:
        return []
    near = lambda a, b: abs(a - b) <= tolerance
    above = lambda r, c: any(near(f[1], ys[r]) and f[0] <= xs[c] + tolerance and f[2] >= xs[c + 1] - tolerance for f in flat)
    beside = lambda r, c: any(near(u[0], xs[c]) and u[1] <= ys[r] + tolerance and u[3] >= ys[r + 1] - tolerance for u in upright)
    sets = Union(rows * cols)
    for r in range(rows):
        for c in range(cols):
            if r and not above(r, c):
                sets.join(r * cols + c, (r - 1) * cols + c)
            if c and not beside(r, c):
                sets.join(r * cols + c, r * cols + c - 1)
    held: dict[int, list[tuple[int, int]]] = {}
    for r in range(rows):
        for c in range(cols):
            held.setdefault(sets.root(r * cols + c), []).append((r, c))
    out = []
    for own in held.values():
        r0, r1, c0, c1 = min(r for r, _ in own), max(r for r, _ in own), min(c for _, c in own), max(c for _, c in own)
        out.append((r0, c0, r1 - r0 + 1, c1 - c0 + 1, xs[c0], ys[r0], xs[c1 + 1], ys[r1 + 1]))
    return sorted(out)


_CELL = "doc_id long, page_number long, grid_id long, row_start int, col_start int, rowspan int, colspan int, x_left double, y_top double, x_right double, y_bottom double"


def grid_cells(rules: DataFrame) -> DataFrame:
    """Cells of each grid (component) of rules."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found = cells_between(list(rows[list(BOX)].itertuples(index=False, name=None)))
        made = pd.DataFrame(found, columns=["row_start", "col_start", "rowspan", "colspan", *BOX])
        for k, c in enumerate(("doc_id", "page_number", "grid_id")):
            made.insert(k, c, rows[c].iloc[0])
        return made

    return rules.select(*PAGE, F.col("component").alias("grid_id"), *BOX).groupBy(*PAGE, "grid_id").applyInPandas(run, _CELL)


def logical_rows(cells: DataFrame, most_gap: float = 4.0) -> DataFrame:
    """doc_id, page_number, cell_id and row_id: cells that stand under each other in one column with a small gap are one row if a neighbour spans them in height."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["y_top", "x_left", "cell_id"]).reset_index(drop=True)
        box = list(rows[list(BOX)].itertuples(index=False, name=None))
        sets = Union(len(box))
        for i, a in enumerate(box):
            for j in range(i + 1, len(box)):
                b = box[j]
                if b[1] > a[3]:
                    break
                if min(a[3], b[3]) - max(a[1], b[1]) > 0.5 * min(a[3] - a[1], b[3] - b[1]) and (b[0] >= a[2] or a[0] >= b[2]):
                    sets.join(i, j)
        ids: dict[int, int] = {}
        return rows.assign(row_id=[ids.setdefault(sets.root(i), len(ids) + 1) for i in range(len(box))])[["doc_id", "page_number", "cell_id", "row_id"]]

    return cells.select(*PAGE, "cell_id", *BOX).groupBy(*PAGE).applyInPandas(run, "doc_id long, page_number long, cell_id long, row_id long")


def table_columns(cells: DataFrame) -> DataFrame:
    """cells with col_start: cells of a table whose x ranges overlap, directly or through others, are one column, from the left."""
    w = Window.partitionBy("doc_id", "table_id").orderBy("x_left", "x_right", "cell_id")
    reach = F.max("x_right").over(w.rowsBetween(Window.unboundedPreceding, -1))
    df = cells.withColumn("_new", F.coalesce(F.col("x_left") >= reach, F.lit(True)))
    return df.withColumn("col_start", (F.sum(F.when(F.col("_new"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int")).drop("_new")


def table_rows(cells: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """cells with row_start: a new row where the top lies further than the tolerance below the one before."""
    w = Window.partitionBy("doc_id", "table_id").orderBy("page_number", "y_top", "x_left", "cell_id")
    jump = (F.col("page_number") != F.lag("page_number").over(w)) | (F.col("y_top") - F.lag("y_top").over(w) > tolerance)
    df = cells.withColumn("_new", F.coalesce(jump, F.lit(True)))
    return df.withColumn("row_start", (F.sum(F.when(F.col("_new"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int")).drop("_new")


def gutters(boxes: list[tuple[float, float, float, float]], least_width: float = 8.0, least_height: float = 60.0) -> list[tuple[float, float, float, float]]:
    """Upright strips between boxes that no box enters: the widest free rectangles of at least that size between the boxes' extremes, the tallest first; those inside another are left out."""
    if not boxes:
        return []
    x0, x1 = min(b[0] for b in boxes), max(b[2] for b in boxes)
    edges = sorted({b[1] for b in boxes} | {b[3] for b in boxes})
    found = []
    # Free stretches of x in each band of y, grown downward as long as they stay wide enough.
    live: list[tuple[float, float, float]] = []
    for top, bottom in zip(edges, edges[1:]):
        taken, free, at = sorted((b[0], b[2]) for b in boxes if b[1] < bottom and b[3] > top), [], x0
        for a, b in taken:
            if a - at >= least_width and at > x0:
                free.append((at, a))
            at = max(at, b)
        grown = []
        for left, right, start in live:
            parts = [(max(left, a), min(right, b), start) for a, b in free if min(right, b) - max(left, a) >= least_width]
            if not parts or all((b - a) < (right - left) for a, b, _ in parts):
                found.append((left, start, right, top))
            grown += parts
        known = {(a, b) for a, b, _ in grown}
        live = list({(a, b): (a, b, s) for a, b, s in sorted(grown, key=lambda g: -g[2])}.values()) + [(a, b, top) for a, b in free if (a, b) not in known]
    found += [(a, s, b, edges[-1]) for a, b, s in live]
    tall = sorted((g for g in found if g[3] - g[1] >= least_height and g[2] < x1), key=lambda g: (-(g[3] - g[1]), g))
    inside = lambda g, h: g != h and h[0] <= g[0] and h[1] <= g[1] and h[2] >= g[2] and h[3] >= g[3]
    return [g for k, g in enumerate(tall) if g not in tall[:k] and not any(inside(g, h) for h in tall)]


def page_gutters(boxes: DataFrame) -> DataFrame:
    """Gutters of each page."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        made = pd.DataFrame(gutters(list(rows[list(BOX)].itertuples(index=False, name=None))), columns=list(BOX))
        made.insert(0, "doc_id", rows["doc_id"].iloc[0])
        made.insert(1, "page_number", rows["page_number"].iloc[0])
        return made

    return boxes.select(*PAGE, *BOX).groupBy(*PAGE).applyInPandas(run, "doc_id long, page_number long, x_left double, y_top double, x_right double, y_bottom double")


def rule_roles(rules: DataFrame, words: DataFrame, near: float = 3.0) -> DataFrame:
    """doc_id, page_number, rule_id and role of horizontal rules: underline just below words that it is as wide as, strike through the middle of words, separator across most of the page, else rule."""
    names = [F.col(c).alias(f"w_{c}") for c in BOX]
    wide = F.least("x_right", "w_x_right") - F.greatest("x_left", "w_x_left")
    got = rules.select(*PAGE, "rule_id", *BOX).join(words.select(*PAGE, *names), list(PAGE), "left")
    middle = (F.col("w_y_top") + F.col("w_y_bottom")) / 2
    under = (wide > 0) & (F.col("y_top") - F.col("w_y_bottom")).between(-near, near)
    struck = (wide > 0) & (F.abs(F.col("y_top") - middle) <= 0.2 * (F.col("w_y_bottom") - F.col("w_y_top")))
    page = got.groupBy(*PAGE, "rule_id").agg(F.min("x_left").alias("_l"), F.max("x_right").alias("_r"), F.sum(F.when(under, wide)).alias("_u"), F.sum(F.when(struck, wide)).alias("_s"), (F.max("w_x_right") - F.min("w_x_left")).alias("_w"))
    length = F.col("_r") - F.col("_l")
    role = F.when(F.col("_s") >= 0.5 * length, "strike").when(F.col("_u") >= 0.8 * length, "underline").when(length >= 0.8 * F.col("_w"), "separator").otherwise("rule")
    return page.select(*PAGE, "rule_id", role.alias("role"))
