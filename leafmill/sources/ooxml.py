"""Word and presentation files: paragraphs, tables, charts and properties, read with zipfile and ElementTree.

A decoder gives rows of one shape for both: part (body, header, footer, footnote, comment, notes, table, chart, meta), text and
place. Page numbers of Word files come from their breaks; presentations have a page for each slide.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
from xml.etree import ElementTree as ET

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.sources.detect import decoded

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_C = "{http://schemas.openxmlformats.org/drawingml/2006/chart}"
_REL = "{http://schemas.openxmlformats.org/package/2006/relationships}"
EMU_PER_POINT = 12_700
MOST_BYTES = 512 << 20
ROW = (
    "part string, ord long, page_number long, text string, style string, outline_level int, list_level int, list_id string, is_bold boolean, is_italic boolean, is_underlined boolean, is_strikethrough boolean, font_size double, text_align string, non_stroking_color string, "
    "link_url string, note_id string, table_id long, row_start long, col_start long, rowspan long, colspan long, table_header_flag boolean, chart_id long, chart_type string, series_index long, series_name string, point_index long, category string, value double, "
    "shape_id long, x_left double, y_top double, x_right double, y_bottom double, break_before boolean, meta_key string"
)


class Package:
    """Parts of an office file and their relationships."""

    def __init__(self, data: bytes) -> None:
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        if sum(i.file_size for i in self.zip.infolist()) > MOST_BYTES:
            raise ValueError("the file unpacks to more than is allowed")
        self.names = set(self.zip.namelist())

    def xml(self, name: str):
        return ET.fromstring(self.zip.read(name)) if name in self.names else None

    def links(self, name: str) -> dict[str, tuple[str, str]]:
        """Kind and target of each relationship of a part; targets inside the package are full names."""
        folder, base = posixpath.split(name)
        root = self.xml(posixpath.join(folder, "_rels", f"{base}.rels"))
        out = {}
        for r in root.iter(f"{_REL}Relationship") if root is not None else ():
            target = r.get("Target", "")
            if r.get("TargetMode") != "External":
                target = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
            out[r.get("Id")] = (r.get("Type", "").rpartition("/")[2], target)
        return out

    def properties(self) -> list[dict]:
        out = []
        for name in ("docProps/core.xml", "docProps/app.xml"):
            root = self.xml(name)
            for e in root if root is not None else ():
                if (e.text or "").strip():
                    out.append({"part": "meta", "meta_key": e.tag.rpartition("}")[2].lower(), "text": e.text.strip()})
        return out


def _on(props, tag: str) -> bool | None:
    e = props.find(f"{_W}{tag}") if props is not None else None
    return None if e is None else e.get(f"{_W}val", "true").lower() not in ("0", "false", "none", "off")


class Styles:
    """What a paragraph style and those it is based on say."""

    def __init__(self, root) -> None:
        self.styles = {s.get(f"{_W}styleId"): s for s in (root.iter(f"{_W}style") if root is not None else ())}

    def chain(self, style: str | None) -> list:
        out, seen = [], set()
        while style in self.styles and style not in seen:
            seen.add(style)
            out.append(self.styles[style])
            base = self.styles[style].find(f"{_W}basedOn")
            style = base.get(f"{_W}val") if base is not None else None
        return out

    def name(self, style: str | None) -> str | None:
        found = self.styles.get(style)
        e = found.find(f"{_W}name") if found is not None else None
        return e.get(f"{_W}val") if e is not None else style

    def flag(self, style: str | None, tag: str) -> bool:
        return next((v for s in self.chain(style) if (v := _on(s.find(f"{_W}rPr"), tag)) is not None), False)

    def value(self, style: str | None, props: str, tag: str) -> str | None:
        for s in self.chain(style):
            e = s.find(f"{_W}{props}/{_W}{tag}")
            if e is not None:
                return e.get(f"{_W}val")
        return None


class _Word:
    def __init__(self, package: Package) -> None:
        self.package, self.styles = package, Styles(package.xml("word/styles.xml"))
        self.rows: list[dict] = []
        self.page, self.tables = 1, 0

    def paragraph(self, p, part: str, links: dict, place: dict) -> str:
        props = p.find(f"{_W}pPr")
        get = lambda tag: (e.get(f"{_W}val") if (e := props.find(f"{_W}{tag}")) is not None else None) if props is not None else None
        style = get("pStyle")
        text, weight, href, notes, broke = [], dict.fromkeys(("b", "i", "u", "strike"), 0), None, [], False
        size = color = None
        hyper = {r: h for h in p.iter(f"{_W}hyperlink") for r in h.iter(f"{_W}r")}
        for r in p.iter(f"{_W}r"):
            rp = r.find(f"{_W}rPr")
            piece = []
            for e in r:
                tag = e.tag.removeprefix(_W)
                if tag == "t":
                    piece.append(e.text or "")
                elif tag == "tab":
                    piece.append("\t")
                elif tag == "br" and e.get(f"{_W}type") == "page" or tag == "lastRenderedPageBreak":
                    self.page, broke = self.page + 1, True
                elif tag == "br":
                    piece.append("\n")
                elif tag in ("footnoteReference", "endnoteReference", "commentReference"):
                    notes.append(f"{tag.removesuffix('Reference')}:{e.get(f'{_W}id')}")
            got = "".join(piece)
            text.append(got)
            for k in weight:
                on = _on(rp, k)
                weight[k] += len(got) * (self.styles.flag(style, k) if on is None else on)
            if rp is not None and got.strip():
                half, paint = rp.find(f"{_W}sz"), rp.find(f"{_W}color")
                size = size or (float(half.get(f"{_W}val")) / 2 if half is not None else None)
                color = color or (f"#{paint.get(f'{_W}val').lower()}" if paint is not None and paint.get(f"{_W}val", "auto") != "auto" else None)
            if r in hyper and href is None:
                href = links.get(hyper[r].get(f"{_R}id"), (None, None))[1] or (f"#{a}" if (a := hyper[r].get(f"{_W}anchor")) else None)
        joined = "".join(text)
        n = max(1, len(joined))
        half = size or (float(v) / 2 if (v := self.styles.value(style, "rPr", "sz")) else None)
        level = get("outlineLvl") or self.styles.value(style, "pPr", "outlineLvl")
        number = props.find(f"{_W}numPr") if props is not None else None
        num = lambda tag: (e.get(f"{_W}val") if number is not None and (e := number.find(f"{_W}{tag}")) is not None else None)
        if joined.strip() and not place:
            self.rows.append(
                {"part": part, "page_number": self.page, "text": joined.strip(), "style": self.styles.name(style), "outline_level": int(level) if level and level.isdigit() else None, "list_level": int(num("ilvl") or 0) if num("numId") else None, "list_id": num("numId"), "is_bold": weight["b"] > 0.75 * n, "is_italic": weight["i"] > 0.75 * n, "is_underlined": weight["u"] > 0.75 * n, "is_strikethrough": weight["strike"] > 0.75 * n, "font_size": half, "text_align": get("jc") or self.styles.value(style, "pPr", "jc"), "non_stroking_color": color, "link_url": href, "note_id": ",".join(notes) or None, "break_before": broke}
            )
        return joined.strip()

    def table(self, t, part: str, links: dict) -> None:
        self.tables += 1
        number, open_cells = self.tables, {}
        for r, row in enumerate(t.findall(f"{_W}tr")):
            header, col = row.find(f"{_W}trPr/{_W}tblHeader") is not None, 0
            for cell in row.findall(f"{_W}tc"):
                props = cell.find(f"{_W}tcPr")
                span = props.find(f"{_W}gridSpan") if props is not None else None
                width = int(span.get(f"{_W}val")) if span is not None else 1
                merge = props.find(f"{_W}vMerge") if props is not None else None
                text = "\n".join(filter(None, (self.paragraph(p, part, links, {"cell": True}) for p in cell.iter(f"{_W}p"))))
                if merge is not None and merge.get(f"{_W}val") != "restart" and col in open_cells:
                    open_cells[col]["rowspan"] += 1
                else:
                    made = {"part": "table", "page_number": self.page, "text": text, "table_id": number, "row_start": r, "col_start": col, "rowspan": 1, "colspan": width, "table_header_flag": header}
                    self.rows.append(made)
                    open_cells[col] = made
                col += width

    def walk(self, root, part: str, links: dict) -> None:
        for e in root:
            if e.tag == f"{_W}p":
                self.paragraph(e, part, links, {})
            elif e.tag == f"{_W}tbl":
                self.table(e, part, links)
            elif e.tag in (f"{_W}sdt", f"{_W}sdtContent", f"{_W}body"):
                self.walk(e, part, links)


def word_rows(data: bytes) -> list[dict]:
    """Rows of a Word file in reading order; headers, footers, notes and comments follow the body."""
    package = Package(data)
    w, links = _Word(package), package.links("word/document.xml")
    w.walk(package.xml("word/document.xml"), "body", links)
    for kind, target in sorted(set(links.values())):
        root = package.xml(target) if kind in ("header", "footer", "footnotes", "endnotes", "comments") else None
        if root is not None:
            inner = package.links(target)
            if kind in ("header", "footer"):
                w.walk(root, kind, inner)
            else:
                for note in root:
                    if note.get(f"{_W}type") not in ("separator", "continuationSeparator"):
                        before = len(w.rows)
                        w.walk(note, kind.removesuffix("s"), inner)
                        for row in w.rows[before:]:
                            row["note_id"] = f"{kind.removesuffix('s')}:{note.get(f'{_W}id')}"
        if kind == "chart" and target in package.names:
            w.rows += chart_rows(package.xml(target), len({r.get("chart_id") for r in w.rows} - {None}) + 1, 1)
    return _numbered(w.rows + package.properties())


def chart_rows(root, number: int, page: int) -> list[dict]:
    """Points of a chart part from the values that it caches."""
    out = []
    plot = next((e for e in root.iter() if e.tag.startswith(_C) and e.tag.endswith("Chart") and e.tag != f"{_C}chart"), None)
    kind = plot.tag.removeprefix(_C).removesuffix("Chart").removesuffix("3D") if plot is not None else None
    for s, series in enumerate(root.iter(f"{_C}ser")):
        points = lambda tag: {int(p.get("idx")): p.findtext(f"{_C}v") for p in series.iterfind(f"{_C}{tag}//{_C}pt")}
        names = points("tx")
        categories, values = points("cat") or points("xVal"), points("val") or points("yVal")
        for k, v in sorted(values.items()):
            try:
                value = float(v)
            except (TypeError, ValueError):
                continue
            out.append({"part": "chart", "page_number": page, "chart_id": number, "chart_type": kind, "series_index": s, "series_name": names.get(0, f"Series {s + 1}"), "point_index": k, "category": categories.get(k), "value": value})
    return out


def slide_rows(data: bytes) -> list[dict]:
    """Rows of a presentation: paragraphs of shapes with their boxes in points, tables, charts and notes, slide by slide."""
    package = Package(data)
    links = package.links("ppt/presentation.xml")
    order = [links[e.get(f"{_R}id")][1] for e in package.xml("ppt/presentation.xml").iter(f"{_P}sldId") if e.get(f"{_R}id") in links]
    rows, tables, charts = [], 0, 0
    for number, name in enumerate(order, start=1):
        root, own = package.xml(name), package.links(name)
        for shape_id, shape in enumerate(e for e in root.iter() if e.tag in (f"{_P}sp", f"{_P}graphicFrame")):
            off, ext = next(shape.iter(f"{_A}off"), None), next(shape.iter(f"{_A}ext"), None)
            box = {}
            if off is not None and ext is not None and ext.get("cx"):
                x, y, w, h = (int(v) / EMU_PER_POINT for v in (off.get("x"), off.get("y"), ext.get("cx"), ext.get("cy")))
                box = {"x_left": x, "y_top": y, "x_right": x + w, "y_bottom": y + h}
            holder = next(shape.iter(f"{_P}ph"), None)
            style = holder.get("type", "body") if holder is not None else None
            table = next(shape.iter(f"{_A}tbl"), None)
            if table is not None:
                tables += 1
                first = table.find(f"{_A}tblPr")
                for r, row in enumerate(table.findall(f"{_A}tr")):
                    for c, cell in enumerate(row.findall(f"{_A}tc")):
                        if cell.get("hMerge") == "1" or cell.get("vMerge") == "1":
                            continue
                        text = "\n".join("".join(t.text or "" for t in p.iter(f"{_A}t")) for p in cell.iter(f"{_A}p")).strip()
                        rows.append({"part": "table", "page_number": number, "text": text, "table_id": tables, "row_start": r, "col_start": c, "rowspan": int(cell.get("rowSpan", 1)), "colspan": int(cell.get("gridSpan", 1)), "table_header_flag": r == 0 and first is not None and first.get("firstRow") == "1"})
                continue
            chart = next((own.get(e.get(f"{_R}id"), ("", ""))[1] for e in shape.iter(f"{_C}chart")), None)
            if chart and chart in package.names:
                charts += 1
                rows += chart_rows(package.xml(chart), charts, number)
                continue
            for p in shape.iter(f"{_A}p"):
                text = "".join((e.text or "") if e.tag == f"{_A}t" else "\n" for e in p.iter() if e.tag in (f"{_A}t", f"{_A}br")).strip()
                runs = [e for e in p.iter(f"{_A}rPr")]
                props = p.find(f"{_A}pPr")
                if text:
                    flag = lambda k, off=("0", "none", "noStrike", "false"): bool(runs) and all(e.get(k, "0") not in off for e in runs)
                    size = next((float(e.get("sz")) / 100 for e in runs if e.get("sz")), None)
                    rows.append({"part": "body", "page_number": number, "text": text, "style": style, "list_level": int(props.get("lvl", 0)) if props is not None else 0, "is_bold": flag("b"), "is_italic": flag("i"), "is_underlined": flag("u"), "is_strikethrough": flag("strike"), "font_size": size, "text_align": {"ctr": "center", "r": "right", "l": "left"}.get(props.get("algn")) if props is not None else None, "shape_id": shape_id} | box)
        for kind, target in own.values():
            if kind == "notesSlide" and (notes := package.xml(target)) is not None:
                for p in notes.iter(f"{_A}p"):
                    text = "".join(t.text or "" for t in p.iter(f"{_A}t")).strip()
                    if text:
                        rows.append({"part": "speaker_notes", "page_number": number, "text": text})
    return _numbered(rows + package.properties())


def _numbered(rows: list[dict]) -> list[dict]:
    return [{"ord": k} | r for k, r in enumerate(rows, start=1)]


def read_word(files: DataFrame) -> DataFrame:
    return decoded(files.where("kind = 'docx'"), word_rows, ROW)


def read_slides(files: DataFrame) -> DataFrame:
    return decoded(files.where("kind = 'pptx'"), slide_rows, ROW)


def lines(rows: DataFrame, slides: bool = False) -> DataFrame:
    """Lines of the paragraphs: block_type from named styles, one title for each slide; notes stand right after the paragraph that refers to them."""
    text = rows.where("text IS NOT NULL AND part NOT IN ('table', 'chart', 'meta')")
    refs = text.where("part = 'body' AND note_id IS NOT NULL").select("doc_id", F.explode(F.split("note_id", ",")).alias("note_id"), F.col("ord").alias("_at"), F.col("page_number").alias("_page"))
    refs = refs.groupBy("doc_id", "note_id").agg(F.min("_at").alias("_at"), F.min_by("_page", "_at").alias("_page"))
    notes = text.where("part IN ('footnote', 'endnote', 'comment')").join(refs, ["doc_id", "note_id"], "left")
    body = text.where("part NOT IN ('footnote', 'endnote', 'comment')").withColumns({"_at": F.lit(None).cast("long"), "_page": F.lit(None).cast("long")})
    every = body.unionByName(notes)
    level = F.regexp_extract(F.lower("style"), r"^heading (\d)$", 1)
    title = F.lower("style").isin("title", "ctrtitle") if slides else F.lower("style").isin("title")
    kind = F.when(F.col("part") != "body", F.col("part")).when((level != "") | title, "heading")
    every = every.withColumns({"block_type": kind, "heading_source": F.when((level != "") | title, F.lit("pptx" if slides else "docx")), "page_number": F.coalesce("_page", "page_number")})
    if slides:
        first = F.row_number().over(Window.partitionBy("doc_id", "page_number", F.coalesce(F.col("block_type") == "heading", F.lit(False))).orderBy("ord")) == 1
        every = every.withColumn("_first", first).withColumn("block_type", F.when((F.col("block_type") == "heading") & ~F.col("_first"), None).otherwise(F.col("block_type"))).withColumn("slide_index", F.col("page_number")).drop("_first")
    order = Window.partitionBy("doc_id").orderBy(F.coalesce("_at", "ord"), F.col("_at").isNotNull(), "ord")
    return every.withColumn("_o", F.row_number().over(order).cast("long")).withColumn("ord", F.col("_o")).drop("_o", "_at", "_page")


def furniture_by_page(rows: DataFrame) -> DataFrame:
    """Headers and footers once for each page of their document."""
    pages = rows.groupBy("doc_id").agg(F.max("page_number").alias("_n"))
    return rows.where("part IN ('header', 'footer')").join(pages, "doc_id").withColumn("page_number", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))).drop("_n")


def metadata(rows: DataFrame) -> DataFrame:
    """doc_id, title, author, created, modified and generator from the file's properties."""
    m = rows.where("part = 'meta'")
    get = lambda k: F.max(F.when(F.col("meta_key") == k, F.col("text")))
    return m.groupBy("doc_id").agg(get("title").alias("title"), get("creator").alias("author"), get("created").alias("created"), get("modified").alias("modified"), get("language").alias("language"), get("application").alias("generator"))
