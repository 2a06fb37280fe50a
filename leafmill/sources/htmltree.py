"""HTML to boxes: one pass of a tolerant tree builder over each page, without a tree in memory.

A box is a run of text of one element and one link. Elements whose end tag may be left out close as HTML says they do, and inline
elements close where a block begins after them. Hidden elements, scripts, styles and comments give nothing.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

#: Elements that begin a block of their own (fixed values of the HTML standard).
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template svg".split())
#: An open element of the first kind ends where one of the others begins.
ENDS = {"p": BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr", "tbody", "thead", "tfoot"}, "th": {"td", "th", "tr", "tbody", "thead", "tfoot"}, "tr": {"tr", "tbody", "thead", "tfoot"}, "thead": {"tbody", "tfoot"}, "tbody": {"tbody", "tfoot"}, "option": {"option", "optgroup"}}
#: Where the search for an element to end stops.
FENCE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "td": {"table"}, "th": {"table"}, "tr": {"table"}, "thead": {"table"}, "tbody": {"table"}}
INLINE_STYLE = {"b": "bold", "strong": "bold", "i": "italic", "em": "italic", "cite": "italic", "u": "underlined", "ins": "underlined", "s": "struck", "del": "struck", "strike": "struck", "sup": "superscript", "sub": "subscript"}
HEADING_SIZE = {"h1": 32.0, "h2": 24.0, "h3": 18.7, "h4": 16.0, "h5": 13.3, "h6": 10.7}
_NAMED_SIZE = {"xx-small": 9.0, "x-small": 10.0, "small": 13.0, "medium": 16.0, "large": 18.0, "x-large": 24.0, "xx-large": 32.0}


def css_px(value: str, parent: float = 16.0) -> float | None:
    """A CSS size in pixels."""
    value = value.strip().lower()
    if value in _NAMED_SIZE:
        return _NAMED_SIZE[value]
    m = re.fullmatch(r"([\d.]+)(px|pt|em|rem|%|in|cm)?", value)
    if not m or m[1].count(".") > 1 or m[1] == ".":
        return None
    return float(m[1]) * {"px": 1.0, None: 1.0, "pt": 4 / 3, "em": parent, "rem": 16.0, "%": parent / 100, "in": 96.0, "cm": 96 / 2.54}[m[2]]


def css(style: str) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (part.partition(":") for part in style.split(";")) if v}


def is_bold_weight(value: str) -> bool:
    return value in ("bold", "bolder") or value.isdigit() and int(value) >= 600


@dataclass
class Element:
    tag: str
    number: int
    attrs: dict[str, str]
    size: float
    bold: bool
    italic: bool
    underlined: bool
    struck: bool
    script: str | None
    align: str | None
    color: str | None
    family: str | None
    href: str | None
    hidden: bool


@dataclass
class Cell:
    row: int
    col: int
    rowspan: int
    colspan: int
    header: bool
    parts: list[str] = field(default_factory=list)


class Table:
    """Places of cells in one table; nested tables add their text to the cell that holds them."""

    def __init__(self, number: int) -> None:
        self.number, self.row, self.taken, self.cells, self.head, self.depth = number, -1, set(), [], False, 0

    def add(self, attrs: dict[str, str], header: bool) -> Cell:
        self.row = max(self.row, 0)
        col = 0
        while (self.row, col) in self.taken:
            col += 1
        span = lambda k: max(1, min(1000, int(v))) if (v := attrs.get(k, "1").strip()).isdigit() else 1
        cell = Cell(self.row, col, span("rowspan"), span("colspan"), header or self.head)
        self.taken.update((self.row + r, col + c) for r in range(cell.rowspan) for c in range(cell.colspan))
        self.cells.append(cell)
        return cell


class Boxes(HTMLParser):
    """boxes, cells and metadata of one page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.boxes: list[dict] = []
        self.cells: list[dict] = []
        self.meta: dict[str, str] = {}
        self.stack: list[Element] = []
        self.count = self.tables = 0
        self.table: list[Table] = []
        self.cell: list[Cell | None] = []
        self.held: list[str] = []
        self.held_from: Element | None = None
        self.silent = 0
        self.reason = "block"
        self.capture: str | None = None

    # Elements.

    def _open(self, tag: str, attrs: dict[str, str]) -> Element:
        up = self.stack[-1] if self.stack else None
        self.count += 1
        style = css(attrs.get("style", ""))
        size = (up.size if up else 16.0) if tag not in HEADING_SIZE else HEADING_SIZE[tag]
        size = (css_px(style.get("font-size", ""), size) or size) if "font-size" in style else size
        mark, deco = INLINE_STYLE.get(tag), style.get("text-decoration", "") + style.get("text-decoration-line", "")
        weight = style.get("font-weight")
        return Element(
            tag, self.count, attrs, size,
            is_bold_weight(weight) if weight else mark == "bold" or tag in HEADING_SIZE or tag == "th" or bool(up and up.bold),
            style["font-style"] in ("italic", "oblique") if "font-style" in style else mark == "italic" or bool(up and up.italic),
            "underline" in deco or mark == "underlined" or bool(up and up.underlined),
            "line-through" in deco or mark == "struck" or bool(up and up.struck),
            mark if mark in ("superscript", "subscript") else (up.script if up else None),
            style.get("text-align") or attrs.get("align") or ("center" if tag == "center" else up.align if up else None),
            style.get("color") or attrs.get("color") or (up.color if up else None),
            style.get("font-family") or attrs.get("face") or (up.family if up else None),
            attrs.get("href") if tag == "a" else (up.href if up else None),
            bool(up and up.hidden) or style.get("display") == "none" or style.get("visibility") == "hidden" or "hidden" in attrs,
        )

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        given = {k: v or "" for k, v in attrs}
        if self.silent or tag in SILENT:
            if tag in SILENT and tag not in VOID:
                if tag == "script" and given.get("type") == "application/ld+json":
                    self.capture = ""
                self.silent += 1
            return
        if tag == "meta":
            name = (given.get("name") or given.get("property") or ("charset" if "charset" in given else "")).lower()
            if name:
                self.meta.setdefault(name, given.get("content") or given.get("charset", ""))
            return
        if tag == "link" and given.get("rel") == "canonical":
            self.meta.setdefault("canonical", given.get("href", ""))
        if tag == "html" and given.get("lang"):
            self.meta["lang"] = given["lang"]
        self._imply(tag)
        if tag in BLOCK:
            self.flush("block")
        if tag in ("br", "hr", "img"):
            self.flush(tag)
            if tag != "br" and not (self.stack and self.stack[-1].hidden):
                self._emit(given.get("alt", "") if tag == "img" else "", self._open(tag, given), tag)
            return
        if tag in VOID:
            return
        if tag == "a":
            self.flush("link")
        if tag == "table":
            self.tables += 1
            if self.table:
                self.table[-1].depth += 1
            else:
                self.table.append(Table(self.tables))
                self.cell.append(None)
        elif self.table and not self.table[-1].depth:
            if tag == "tr":
                self.table[-1].row += 1
            elif tag in ("thead", "tbody", "tfoot"):
                self.table[-1].head = tag == "thead"
            elif tag in ("td", "th"):
                self.cell[-1] = self.table[-1].add(given, tag == "th")
        self.stack.append(self._open(tag, given))

    def _imply(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            open_tag = self.stack[i].tag
            if tag in ENDS.get(open_tag, ()):
                self.flush("block")
                del self.stack[i:]
                return self._imply(tag)
            if open_tag in BLOCK and open_tag not in ENDS or open_tag in FENCE.get(tag, ()):
                break
        # An inline element that was left open around finished blocks ends with them.
        if tag in BLOCK:
            while self.stack and self.stack[-1].tag in INLINE_STYLE:
                self.stack.pop()

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and not self.silent:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if self.silent:
            if tag in SILENT:
                self.silent -= 1
                if not self.silent and self.capture is not None:
                    self._linked_data(self.capture)
                    self.capture = None
            return
        at = next((i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i].tag == tag), None)
        if at is None:
            return
        self.flush("block" if tag in BLOCK else "link" if tag == "a" else None)
        del self.stack[at:]
        if tag == "table" and self.table:
            if self.table[-1].depth:
                self.table[-1].depth -= 1
            else:
                done = self.table.pop()
                self.cell.pop()
                self.cells += [{"table_id": done.number, "row_start": c.row, "col_start": c.col, "rowspan": c.rowspan, "colspan": c.colspan, "table_header_flag": c.header, "text": " ".join(c.parts)} for c in done.cells]

    # Text.

    def handle_data(self, data: str) -> None:
        if self.capture is not None:
            self.capture += data
        if self.silent or not self.stack or self.stack[-1].hidden:
            return
        if self.stack[-1].tag == "title" and any(e.tag == "head" for e in self.stack):
            self.meta["title"] = (self.meta.get("title", "") + data).strip()
            return
        if any(e.tag == "pre" for e in self.stack):
            for k, line in enumerate(data.split("\n")):
                if k:
                    self.flush("code_line")
                self.held.append(line)
                self.held_from = self.held_from or self.stack[-1]
            return
        if data.strip() or self.held:
            if data.strip() and self.held_from is None:
                self.held_from = self.stack[-1]
            self.held.append(data)

    def flush(self, reason: str | None) -> None:
        if reason is None:
            return
        text = "".join(self.held)
        source = self.held_from
        self.held, self.held_from = [], None
        if source is not None:
            pre = any(e.tag == "pre" for e in self.stack)
            text = text.rstrip() if pre else re.sub(r"\s+", " ", text).strip()
            if text:
                self._emit(text, source, "text")
        self.reason = reason

    def _emit(self, text: str, e: Element, kind: str) -> None:
        path = [x.tag for x in self.stack]
        block = next((x.number for x in reversed(self.stack) if x.tag in BLOCK), 0)
        cell = self.cell[-1] if self.cell else None
        if cell is not None and kind == "text":
            cell.parts.append(text)
        words = " ".join(f"{x.attrs.get('class', '')} {x.attrs.get('id', '')}" for x in self.stack).lower().split()
        self.boxes.append(
            {
                "ord": len(self.boxes) + 1, "kind": kind, "text": text, "tag": e.tag, "block_no": block, "split_reason": self.reason, "ancestors": path, "roles": [x.attrs["role"].lower() for x in self.stack if x.attrs.get("role")], "keywords": sorted(set(words)),
                "link_url": e.href, "is_bold": e.bold, "is_italic": e.italic, "is_underlined": e.underlined, "is_strikethrough": e.struck, "script_type": e.script, "font_size": e.size, "font_family": e.family, "text_align": e.align, "non_stroking_color": e.color,
                "table_id": self.table[-1].number if self.table else None, "row_start": cell.row if cell else None, "col_start": cell.col if cell else None,
            }
        )

    def _linked_data(self, text: str) -> None:
        try:
            found = json.loads(text)
        except ValueError:
            return
        for item in found if isinstance(found, list) else [found]:
            if isinstance(item, dict):
                author = item.get("author")
                author = author.get("name") if isinstance(author, dict) else author
                for key, value in (("ld:title", item.get("headline") or item.get("name")), ("ld:author", author), ("ld:published", item.get("datePublished")), ("ld:modified", item.get("dateModified"))):
                    if isinstance(value, str):
                        self.meta.setdefault(key, value)

    def finish(self, html: str) -> Boxes:
        if written := re.search(r"<title>([^<]*)</title>", html):
            self.meta["title_written"] = written[1]
        self.feed(html)
        self.close()
        self.flush("block")
        return self
