"""Navigation, tables of contents, exhibit lists and sections, from lines; windows over the document throughout.

A line has doc_id, ord and text and, null where unknown, page_number, block_type, link_type, table_id, cell_count, page_label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import text as tx
from leafmill.operators.blocks import document_window, islands
from leafmill.operators.passes import per_document
from leafmill.plans.staging import staged

OPTIONAL = {"page_number": "long", "block_type": "string", "link_type": "string", "table_id": "long", "cell_count": "long"}
FURNITURE = ("image", "hr", "page_label", "navigation", "vertical_text", "header", "footer", "footnote", "endnote", "comment", "speaker_notes", "chart", "shape", "math", "toc", "toc_heading")


def complete(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.lit(None).cast(k) for c, k in OPTIONAL.items() if c not in df.columns})


def _hidden(*more: str) -> Column:
    return F.coalesce(F.lower(F.trim("block_type")).isin(*FURNITURE, *more), F.lit(False))


def _times(c: Column) -> Column:
    return F.sum(F.when(c, 1).otherwise(0))


# Navigation.


def mark_navigation(df: DataFrame, least: int = 3) -> DataFrame:
    """Internal links whose text stands on at least three pages (or three times where pages are unknown) become navigation."""
    inside = F.coalesce(F.col("link_type") == "internal", F.lit(False))
    places = F.coalesce(F.col("page_number"), F.col("ord"))
    seen = df.where(inside).groupBy("doc_id", "text").agg(F.count_distinct(places).alias("_k")).where(F.col("_k") >= least)
    df = df.join(seen, ["doc_id", "text"], "left")
    return df.withColumn("block_type", F.when(inside & F.col("_k").isNotNull(), "navigation").otherwise(F.col("block_type"))).drop("_k")


# Tables of contents.

LEADERS = r"[.…⋯∙·•‧](?:\s*[.…⋯∙·•‧]){2,}"
_HEADING = r"(?:(?i)table\s+of\s+(?:contents?|figures?|tables?))|^\s*(?-i:Contents?|CONTENTS?)\b|^\s*(?-i:Index|INDEX)\b|\b(?-i:Index|INDEX)\s*$"
_LEADER = ""
_EDGES = "[(\\[{.,;:)\\]}\"'“”‘’]+"


def _label(token: Column) -> Column:
    return tx.page_label_type(F.regexp_replace(token, f"^{_EDGES}|{_EDGES}$", ""))


def _row(guard: Column) -> Column:
    """Kind of the page label that anchors a row of contents, at its end or at its start; the other side holds a real word. Inside a table the label's neighbour must not be a number. _seen has each token's label, and whether it is a word and a number."""
    n = F.size("_seen")
    at = lambda i: F.get("_seen", i)

    def side(label: Column, beside: Column, title: Column) -> Column:
        word = F.exists(title, lambda t: t["label"].isNull() & t["word"])
        alone = ~guard | ~(at(beside)["label"].isNotNull() | at(beside)["number"])
        return F.when(at(label)["label"].isNotNull() & alone & word, at(label)["label"])

    last = side(n - 1, n - 2, F.slice("_seen", 1, n - 1))
    first = side(F.lit(0), F.lit(1), F.slice("_seen", 2, n - 1))
    return F.when(n >= 2, F.coalesce(last, first))


def toc_marks(df: DataFrame, most_chars: int = 250, most_cells: int = 5, most_heading: int = 80) -> DataFrame:
    """toc_heading, toc_leaders and toc_type (kind of page label of a row of contents, else null) of every line."""
    t = tx.text("text")
    spaced = F.trim(F.regexp_replace(F.regexp_replace(F.replace(t, F.lit("|"), F.lit(" ")), LEADERS, f" {_LEADER} "), r"\s+", " "))
    # What several tests read is a column, which Spark makes once; as an expression it would be made anew for each of them. Lines that cannot be rows are not taken apart.
    may = ~t.rlike("[$€£¥]") & ~_hidden() & (F.coalesce("cell_count", F.lit(0)) <= most_cells)
    df = df.withColumn("_spaced", F.when(may, spaced))
    short = F.length(F.replace("_spaced", F.lit(_LEADER), F.lit(""))) <= most_chars
    df = df.withColumn("_tokens", F.when(short, F.filter(F.split("_spaced", " "), lambda x: x != ""))).drop("_spaced")
    ends = F.array(F.get("_tokens", F.lit(0)), F.try_element_at("_tokens", F.lit(-1)))
    df = df.withColumn("_cheap", F.when(F.size("_tokens") >= 2, F.exists(ends, lambda x: _label(x).isNotNull())).otherwise(False))
    seen = F.transform("_tokens", lambda x: F.struct(_label(x).alias("label"), (F.lower(x) != F.upper(x)).alias("word"), tx.is_numeric_value(x).alias("number")))
    df = df.withColumn("_seen", F.when(F.col("_cheap"), seen)).drop("_cheap", "_tokens")
    return df.withColumns({"toc_heading": t.rlike(_HEADING) & (F.length(t) <= most_heading) & ~_hidden(), "toc_leaders": t.rlike(LEADERS), "toc_type": F.when(F.col("_seen").isNotNull(), _row(F.col("table_id").isNotNull()))}).drop("_seen")


class Segments:
    """Numbers of segments by line; a line belongs to the first that claims it."""

    def __init__(self, tables: list) -> None:
        self.of: list[int | None] = [None] * len(tables)
        self.tables: dict[object, list[int]] = {}
        for i, t in enumerate(tables):
            if t is not None:
                self.tables.setdefault(t, []).append(i)
        self.count = 0

    def claim(self, lines) -> None:
        for i in lines:
            if self.of[i] is None:
                self.of[i] = self.count
        self.count += 1

    def fill(self, lines: list[int], number: int) -> None:
        for i in lines:
            if self.of[i] is None:
                self.of[i] = number

    def claim_left(self, wanted: list[bool]) -> None:
        """Stretches of wanted lines that no segment has."""
        run: list[int] = []
        for i, w in enumerate([*wanted, False]):
            if w and i < len(self.of) and self.of[i] is None:
                run.append(i)
            elif run:
                self.claim(run)
                run = []

    def groups(self) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in range(self.count)]
        for i, k in enumerate(self.of):
            if k is not None:
                out[k].append(i)
        return [g for g in out if g]


def parted(members: list[int], near) -> list[list[int]]:
    """Runs of members of which each is near the one before."""
    runs: list[list[int]] = []
    for i in members:
        if runs and near(runs[-1][-1], i):
            runs[-1].append(i)
        else:
            runs.append([i])
    return runs


_TOC_SEEN = "ord heading leaders row kind inside hidden table page_line".split()


def _toc_pass(bridge: int, least_ratio: float, table_least: int, table_ratio: float, least_rows: int, least_score: float, back: int):
    def work(lines: list[tuple]) -> list[tuple]:
        seen = dict(zip(_TOC_SEEN, map(list, zip(*lines))))
        row, leaders = seen["row"], [x and not h for x, h in zip(seen["leaders"], seen["hidden"])]
        if not any(row):
            return []
        segments = Segments(seen["table"])
        members = [i for i in range(len(lines)) if not seen["hidden"][i] and (leaders[i] or seen["inside"][i])]
        for run in parted(members, lambda a, b: b - a <= bridge + 1):
            dotted = [i for i in run if leaders[i]]
            first = next((i for i in run if row[i]), None)
            if first is not None and (not dotted or sum(row[i] for i in dotted) >= least_ratio * len(dotted)):
                segments.claim(range(first, run[-1] + 1))
        for own in segments.tables.values():
            number = next((segments.of[i] for i in own if segments.of[i] is not None), None)
            if number is not None:
                segments.fill(own, number)
            elif sum(row[i] for i in own) >= max(table_least, table_ratio * len(own)):
                segments.claim(own)
        segments.claim_left(row)
        kinds: dict[int, str] = {}
        scores: dict[int, float] = {}
        for own in segments.groups():
            if len(own) < least_rows:
                continue
            share = lambda flags: sum(bool(flags[i]) for i in own) / len(own)
            above = range(max(0, own[0] - back), own[0])
            score = 5.0 * (share(leaders) > 0.5) + 5.0 * (share(seen["inside"]) > 0.5) + 2.0 * any(seen["heading"][i] for i in above) + 1.0 * any(seen["page_line"][i] for i in (*above, own[0]))
            score += 1.0 * (sum(row[i] and seen["table"][i] is not None for i in own) > 5) - 1.0 * (len({seen["kind"][i] for i in own} - {None}) > 1)
            scores |= dict.fromkeys(own, score)
            if score >= least_score:
                kinds |= {i: "toc" for i in own if not seen["hidden"][i]}
                kinds |= {i: "toc_heading" for i in above if seen["heading"][i]}
        return [(seen["ord"][i], kinds.get(i), scores.get(i)) for i in sorted(kinds.keys() | scores.keys())]

    return work


def mark_toc(df: DataFrame, bridge: int = 3, least_ratio: float = 0.5, table_least: int = 2, table_ratio: float = 0.5, least_rows: int = 4, least_score: float = 2.0, back: int = 3) -> DataFrame:
    """Rows of contents become toc and their headings toc_heading. A segment is scored by leaders, links, a heading or page line above it, tables and mixed kinds of label.

    What a line is by itself is an expression; segments carry state from line to line, so they are found in one pass over flags.
    """
    df = toc_marks(complete(df))
    flag = lambda c: F.coalesce(c, F.lit(False))
    page_line = tx.text("text").rlike(r"(?i)^\s*pages?\s*(?:no\.?|numbers?|#)?\s*$")
    columns = {"heading": F.col("toc_heading"), "leaders": F.col("toc_leaders"), "row": F.col("toc_type").isNotNull(), "kind": F.col("toc_type"), "inside": flag(F.col("link_type") == "internal"), "hidden": _hidden(), "table": F.col("table_id"), "page_line": page_line}
    found = per_document(df, columns, "_ord long, _kind string, _score double", _toc_pass(bridge, least_ratio, table_least, table_ratio, least_rows, least_score, back)).withColumnRenamed("doc_id", "_doc")
    got = df.join(found, df["doc_id"].eqNullSafe(found["_doc"]) & (df["ord"] == found["_ord"]), "left")
    return got.withColumns({"block_type": F.coalesce("_kind", "block_type"), "toc_score": F.col("_score")}).drop("_doc", "_ord", "_kind", "_score")


# Exhibit lists. How rows and headings of exhibit lists begin; strong patterns mark a row by themselves.

EXHIBIT_ROWS = (
    ("multi_parens", r"(?i)^\s*\([A-Za-z0-9]+\)(?:[-\s]*\([^)]*\))+", "strong"),
    ("alpha_with_parens", r"(?i)^\s*[A-Za-z](?:[-\s]*\([^)]*\))+", "strong"),
    ("number_with_parens", r"(?i)^\s*\d{1,3}(?:[-\s]*\([^)]*\))+", "strong"),
    ("dotted_with_parens", r"(?i)^\s*\d{1,3}\.\d+\([A-Za-z0-9]+\)\s", "strong"),
    ("numeric_or_dotted", r"^\s*\d{1,3}(?:\.\d+)*\s", "weak"),
    ("exhibit_prefix_row", r"(?i)^\s*exhibit\s+(?!index\b)[A-Za-z0-9.]+\b", "strong"),
    ("ex_code_row", r"(?i)^\s*EX-\d{3}\.[A-Za-z0-9]+", "strong"),
    ("subpart_not_applicable", r"(?i)^\s*\([a-z]\)\s+not\s+applicable\.?\s*$", "strong"),
    ("hundred_series_exhibit", r"(?i)^\s*(?:exhibit\s+)?1\d{2}\b", "strong"),
)
EXHIBIT_HEADINGS = (r"(?i)^\s*item\s+\d+(?:\.\d+)?[.\s\-–—:]+.*exhibits?\b", r"(?i)^\s*exhibit\s+index", r"(?i)^\s*index\s+to\s+exhibits?\s*$", r"(?i)^\s*exhibits\s*\.?\s*$", r"(?i)^\s*\([a-z0-9]+\)\s+exhibits?\b")
_MARKS = r"[*†‡§+#^]+"


def exhibit_marks(df: DataFrame, most_heading: int = 150, most_row: int = 500) -> DataFrame:
    """exhibit_heading; exhibit_row (name of the first pattern that fits, in their order), exhibit_strength and exhibit_number of every line.

    Footnote marks do not count for the pattern, but make a row strong. A line of two or more numbers and no letter inside a table
    is a row of figures and none of exhibits.
    """
    t = tx.strip("text")
    bare = F.regexp_replace(t, _MARKS, "")
    hidden = _hidden("exhibits", "exhibit_heading")
    tokens = tx.words(F.replace(t, F.lit("|"), F.lit(" ")))
    figures = F.col("table_id").isNotNull() & ~t.rlike(r"\p{L}") & (F.size(tokens) >= 2) & F.forall(tokens, lambda w: tx.is_numeric_value(w))
    fits = F.when(F.lit(False), F.struct(F.lit("").alias("name"), F.lit("").alias("strength")))
    for name, pattern, strength in EXHIBIT_ROWS:
        fits = fits.when(bare.rlike(pattern), F.struct(F.lit(name).alias("name"), F.lit(strength).alias("strength")))
    may = ~hidden & (t != "") & (F.length(t) <= most_row) & ~figures
    code = F.when(F.col("_fits.name") == "exhibit_prefix_row", F.regexp_extract(bare, r"(?i)^\s*exhibit\s+([A-Za-z0-9.]+)\b", 1)).when(F.col("_fits.name") == "hundred_series_exhibit", F.regexp_extract(bare, r"(?i)^\s*(?:exhibit\s+)?(1\d{2})\b", 1)).otherwise(F.get(tx.words(bare), F.lit(0)))
    df = df.withColumn("_fits", F.when(may, fits))
    return df.withColumns({
        "exhibit_heading": tx.any_of(*[bare.rlike(p) for p in EXHIBIT_HEADINGS]) & (F.length("text") <= most_heading) & ~hidden,
        "exhibit_row": F.col("_fits.name"),
        "exhibit_strength": F.when(F.col("_fits").isNotNull(), F.when(bare != t, "strong").otherwise(F.col("_fits.strength"))),
        "exhibit_number": F.when(F.col("_fits").isNotNull(), code),
    }).drop("_fits")


def _exhibit_pass(most_plain: int, most_lines: int, table_least: int, table_ratio: float, back: int):
    def work(lines: list[tuple]) -> list[tuple]:
        ords, heading, row, hidden, table, linked = map(list, zip(*lines))
        at = [i for i in range(len(lines)) if row[i] and not hidden[i]]
        if not at or not any(heading):
            return []
        plain = [0]
        for x in linked:
            plain.append(plain[-1] + (not x))
        segments = Segments(table)
        for run in parted(at, lambda a, b: b - a - 1 <= most_lines and plain[b] - plain[a + 1] <= most_plain):
            segments.claim(range(run[0], run[-1] + 1))
        held = [segments.of.count(k) for k in range(segments.count)]
        for own in segments.tables.values():
            number = next((segments.of[i] for i in own if segments.of[i] is not None), None)
            if number is None:
                continue
            rows = sum(i in set(at) for i in own)
            if rows >= max(table_least, table_ratio * len(own)) or held[number] > sum(segments.of[i] == number for i in own):
                segments.fill(own, number)
        kinds: dict[int, str] = {}
        for own in segments.groups():
            above = [i for i in range(max(0, own[0] - back), own[0] + 1) if heading[i]]
            if above:
                kinds |= {i: "exhibits" for i in own if not hidden[i]}
                kinds |= dict.fromkeys(above, "exhibit_heading")
        return [(ords[i], kinds[i]) for i in sorted(kinds)]

    return work


def mark_exhibits(df: DataFrame, most_plain: int = 5, most_lines: int = 10, table_least: int = 2, table_ratio: float = 0.5, back: int = 5) -> DataFrame:
    """Rows of an exhibit list under a heading of one become exhibits, the heading exhibit_heading. Rows belong together across at most most_lines others, at most most_plain of them without a link."""
    df = exhibit_marks(complete(df))
    linked = F.coalesce(F.col("has_link"), F.lit(False)) if "has_link" in df.columns else F.col("link_type").isNotNull()
    columns = {"heading": F.col("exhibit_heading"), "row": F.col("exhibit_row").isNotNull(), "hidden": _hidden("exhibits", "exhibit_heading"), "table": F.col("table_id"), "linked": linked}
    found = per_document(df, columns, "_ord long, _kind string", _exhibit_pass(most_plain, most_lines, table_least, table_ratio, back)).withColumnRenamed("doc_id", "_doc")
    got = df.join(found, df["doc_id"].eqNullSafe(found["_doc"]) & (df["ord"] == found["_ord"]), "left")
    return got.withColumn("block_type", F.coalesce("_kind", "block_type")).drop("_doc", "_ord", "_kind")


def marked(lines: DataFrame) -> DataFrame:
    """lines with navigation, contents and exhibit lists marked, staged before and between the steps, as each reads its lines twice."""
    return staged(mark_exhibits(staged(mark_toc(staged(mark_navigation(staged(complete(lines))))))))


# Sections of paged documents.

ARABIC, ROMAN, LETTERED = ("arabic", "arabic_sub"), ("roman",), ("alpha_numeric", "alpha_numeric_sub")
COUNTED = (*ARABIC, *ROMAN, *LETTERED, "alpha_roman", "roman_numeric")
#: Pages that a cover has at most, pages within which contents are early, and blank pages that a first label counts back at most.
COVER_PAGES, TOC_WITHIN, COUNTED_BACK = 5, 5, 3
#: Lines of which several on the first pages, with a box to tick, give away the cover of a filing (fixed values).
FILING_LINES = (
    "SECURITIES AND EXCHANGE COMMISSION",
    "Washington, D.C. 20549",
    "(I.R.S. Employer Identification No.)",
    "(Exact name of Registrant as specified in its charter)",
    "(Name of Registrant as Specified In Its Charter)",
    "(Registrant's telephone number, including area code)",
    "(CUSIP Number of Class of Securities)",
)
FILING_LEAST, BOXES = 3, "[☐☒]"
_MAIL = r"(?i)\b[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}\b"
_CALL = r"(?<!\w)\+?\d[\d(). -]{6,}\d(?!\w)"
PAGE_SIGNS = {"background_share": "double", "filing_lines": "array<string>", "has_box": "boolean", "has_contact": "boolean", "source_section": "long", "label_series": "long"}


def page_index(lines: DataFrame) -> DataFrame:
    """A row for each page: its first label's type, value and prefix, blank, and what covers and last pages show: contents, characters, shares of centred lines and of lines on a coloured ground, lines of filings, boxes to tick, an address or number to call."""
    label = F.nullif(tx.strip("page_label"), F.lit(""))
    kind = tx.page_label_type(F.col("page_label"))
    first = lambda c: F.min_by(c, F.when(label.isNotNull(), F.col("ord")))
    t = tx.strip("text")
    have = lambda c, made, other: made if c in lines.columns else other
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    # The first number of a page decides, as it stands.
    call = F.regexp_extract(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", t.alias("t")))), lambda x: x["t"]), " "), _CALL, 0)
    out = lines.groupBy("doc_id", "page_number").agg(
        first(kind).alias("label_type"),
        first(tx.label_value("page_label", kind)).alias("label_value"),
        first(tx.label_prefix("page_label", kind)).alias("label_prefix"),
        F.coalesce(F.bool_or(F.col("block_type").isin("toc", "toc_heading")), F.lit(False)).alias("has_toc"),
        F.sum(F.length(tx.text("text"))).alias("chars"),
        share(F.lower("text_align") == "center").alias("center_share"),
        have("background_color", share(F.coalesce(F.trim("background_color") != "", F.lit(False))) if "background_color" in lines.columns else None, F.lit(0.0)).alias("background_share"),
        F.collect_set(F.when(F.lower(t).isin(*[x.lower() for x in FILING_LINES]), F.lower(t))).alias("filing_lines"),
        F.bool_or(t.rlike(BOXES)).alias("has_box"),
        (F.bool_or(t.rlike(_MAIL)) | (F.length(F.regexp_replace(call, "[^0-9]", "")) >= 9)).alias("has_contact"),
        have("section_id", F.min_by("section_id", "ord") if "section_id" in lines.columns else None, F.lit(None)).cast("long").alias("source_section"),
    )
    return out.withColumn("blank", F.col("label_type").isNull())


def _boundaries(pages: DataFrame) -> DataFrame:
    """section_no: a section begins where the source says so, where the kind of label changes, where its value restarts at 1 (or at a blank page before a 2), but not inside one series of labels; blank pages that the first label of a section counts back over belong to it."""
    w = Window.partitionBy("doc_id").orderBy("page_number")
    kind, value, blank = F.coalesce("label_type", F.lit("")), F.col("label_value"), F.col("blank")
    before, prior = F.lag(kind).over(w), F.lag("label_value").over(w)
    source = F.lag("source_section").over(w) != F.col("source_section")
    restart = (kind == before) & kind.isin(*COUNTED) & (value == 1) & (prior > 1)
    blank_restart = blank & before.isin(*COUNTED) & (F.lead(kind).over(w) == before) & (F.lead("label_value").over(w) == 2) & (prior > 2)
    behind = F.last("label_series", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    ahead = F.first("label_series", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    starts = F.coalesce(source, F.lit(False)) | F.coalesce((kind != before) | restart | blank_restart, F.lit(False))
    df = pages.withColumns({"_start": before.isNull() | (starts & ~F.coalesce(behind == ahead, F.lit(False))), "_at": F.row_number().over(w)})
    after = w.rowsBetween(1, Window.unboundedFollowing)
    named = lambda c: F.first(F.when(~F.col("blank"), c), ignorenulls=True).over(after)
    df = df.withColumns({"_next": named(F.struct(F.col("_at").alias("at"), kind.alias("kind"), value.alias("value"), F.col("_start").alias("start")))})
    gap = F.col("_next.at") - F.col("_at")
    pulled = blank & F.col("_next.start") & F.col("_next.kind").isin(*COUNTED) & (F.col("_next.value") > 1) & (gap <= F.least(F.col("_next.value") - 1, F.lit(COUNTED_BACK)))
    df = df.withColumn("_pulled", F.coalesce(pulled, F.lit(False)))
    held = F.coalesce(F.lag("_pulled").over(w), F.lit(False))
    df = df.withColumn("_start", F.when(held, False).when(F.col("_pulled"), True).otherwise(F.col("_start")))
    return df.withColumn("section_no", islands(F.col("_start"), w)).drop("_start", "_at", "_next", "_pulled")


def sections(pages: DataFrame) -> DataFrame:
    """pages with section_no and section.

    The cover is the first of these that there is: blank sections at the front, of few pages together; the sections before early
    contents; in documents without any label, the first pages that stand out by two of centring, thinness and ground; there too, the
    pages up to the last line or box of a filing's cover. The last page is a lone blank page at the end, or a section of one page
    that stands out by two of thinness, ground and an address. F labels are financials, S schedules, other letters an annex; the
    longest arabic section is the body, and the rest front or back matter.
    """
    given = pages.withColumns({c: F.lit(None).cast(k) for c, k in PAGE_SIGNS.items() if c not in pages.columns})
    w = Window.partitionBy("doc_id").orderBy("page_number")
    doc = Window.partitionBy("doc_id")
    every = lambda c, over: F.min(c.cast("int")).over(over) == 1
    some = lambda c, over: F.coalesce(F.max(c.cast("int")).over(over) == 1, F.lit(False))
    prefix = w.rowsBetween(Window.unboundedPreceding, 0)
    df = _boundaries(given)
    own = Window.partitionBy("doc_id", "section_no")
    df = df.withColumns({"_blank": every(F.col("blank"), own), "_start": F.min("page_number").over(own), "_toc": some(F.col("has_toc"), own), "_bare": every(F.col("blank"), doc), "_rank": F.row_number().over(w)})
    df = df.withColumn("_end_rank", F.max("_rank").over(own))
    df = df.withColumn("_c1", every(F.col("_blank"), prefix) & ~F.col("_bare") & (F.col("_end_rank") <= COVER_PAGES))
    toc_start = F.min(F.when(F.col("_toc") & (F.col("_start") <= TOC_WITHIN), F.col("_start"))).over(doc)
    df = df.withColumn("_c2", F.coalesce((F.col("_start") < toc_start) & (F.col("_end_rank") <= COVER_PAGES), F.lit(False)))
    centre, density, ground = (F.median(c).over(doc) for c in ("center_share", "chars", "background_share"))
    point = lambda c: F.when(F.coalesce(c, F.lit(False)), 1).otherwise(0)
    colored = lambda times: point((ground <= 0) & (F.col("background_share") >= 0.1) | (ground > 0) & (F.col("background_share") >= times * ground))
    looks = point((centre <= 0) & (F.col("center_share") >= 0.3) | (centre > 0) & (F.col("center_share") >= 2.0 * centre)) + point((density > 0) & (F.col("chars") <= 0.5 * density)) + colored(2.0)
    early = some(F.col("has_toc") & (F.col("page_number") <= TOC_WITHIN), doc)
    df = df.withColumns({"_looks": F.col("_bare") & ~early & (looks >= 2) & (F.col("_rank") <= COVER_PAGES), "_tail": point((density > 0) & (F.col("chars") <= 0.75 * density)) + colored(1.5) + point(F.col("has_contact"))})
    near = F.col("page_number") <= COVER_PAGES
    told = F.size(F.array_distinct(F.flatten(F.collect_list(F.when(near, F.col("filing_lines"))).over(doc)))) >= FILING_LEAST
    filing = F.col("_bare") & told & some(near & F.col("has_box"), doc)
    last_sign = F.max(F.when(near & ((F.size("filing_lines") > 0) | F.coalesce("has_box", F.lit(False))), F.col("page_number"))).over(doc)
    df = df.withColumns({"_c3": every(F.col("_looks"), prefix), "_c4": F.coalesce(filing & (F.col("page_number") <= last_sign), F.lit(False))})
    cover = F.when(some(F.col("_c1"), doc), F.col("_c1")).when(some(F.col("_c2"), doc), F.col("_c2")).when(some(F.col("_c3"), doc), F.col("_c3")).otherwise(F.col("_c4"))
    df = df.withColumn("_cover", cover)
    # A cover by pages may end inside a section.
    parted = F.coalesce((F.lag("section_no").over(w) != F.col("section_no")) | (F.lag("_cover").over(w) != F.col("_cover")), F.lit(True))
    df = df.withColumn("_new", parted).withColumn("section_no", islands(F.col("_new"), w))
    df = df.withColumns({"_n": F.count(F.lit(1)).over(own), "_last": F.max("section_no").over(doc)})
    stray = some(F.col("blank") & ~F.col("_cover"), doc) & ~F.col("_bare")
    first_way = F.col("_blank") & ~F.col("_bare")
    lone = (F.col("section_no") == F.col("_last")) & (F.col("_n") == 1)
    df = df.withColumn("section", F.when(lone & (first_way | (~stray & (F.col("_tail") >= 2))), "last_page").when(F.col("_cover"), "coverpage"))
    start = F.coalesce(F.max("label_prefix").over(own), F.lit(""))
    letter = F.when(F.col("label_type").isin(*LETTERED), F.when(start == "F", "financials").when(start == "S", "schedules").otherwise("annex")).when(F.col("label_type") == "alpha_roman", "annex")
    df = df.withColumn("section", F.coalesce("section", letter))
    free = F.col("section").isNull()
    arabic = free & F.coalesce(F.col("label_type").isin(*ARABIC), F.lit(False))
    df = df.withColumns({"_arabic": arabic, "_start": F.min("page_number").over(own)})
    eligible = F.when(some(F.col("_arabic"), doc), F.col("_arabic")).otherwise(free & F.col("blank"))
    body = F.min_by("section_no", F.when(eligible, F.struct(-F.col("_n"), F.col("_start")))).over(doc)
    df = df.withColumn("_body", body)
    body_start = F.min(F.when(F.col("section_no") == F.col("_body"), F.col("page_number"))).over(doc)
    rest = F.when(F.col("section_no") == F.col("_body"), "body").when(F.col("page_number") < body_start, "front_matter").when(F.col("_body").isNotNull(), "back_matter").otherwise("body")
    return df.withColumn("section", F.coalesce("section", rest)).select(*pages.columns, "section_no", "section")


def classify(lines: DataFrame) -> DataFrame:
    """lines with the section of their page."""
    made = sections(page_index(lines)).select("doc_id", "page_number", F.col("section").alias("_section"))
    return lines.drop("section").join(made, ["doc_id", "page_number"], "left").withColumnRenamed("_section", "section")


# Pages that are inferred.


def infer_pages(df: DataFrame) -> DataFrame:
    """page_number from page labels (a page ends with its label), else from full-width rules, else 1."""
    w = document_window()
    labelled = F.max((F.col("page_label").isNotNull()).cast("int")).over(Window.partitionBy("doc_id")) == 1
    ends = F.when(labelled, F.col("page_label").isNotNull()).otherwise(F.coalesce(F.col("block_type") == "hr", F.lit(False)))
    df = df.withColumn("_ends", ends)
    before = F.coalesce(_times(F.col("_ends")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("page_number", (before + 1).cast("long")).drop("_ends")


def spread_labels(df: DataFrame) -> DataFrame:
    """The label of a page on all of its lines; where none is on the page, the next one below."""
    own = F.min_by("page_label", F.when(F.col("page_label").isNotNull(), F.col("ord"))).over(Window.partitionBy("doc_id", "page_number"))
    later = F.first("page_label", ignorenulls=True).over(document_window().rowsBetween(0, Window.unboundedFollowing))
    return df.withColumns({"_own": own, "_later": later}).withColumn("page_label", F.coalesce("_own", "_later")).drop("_own", "_later")


def drop_unreliable_labels(pages: DataFrame, least_run: int = 3) -> DataFrame:
    """Labels outside a run of at least least_run pages that count on by one (of one kind and prefix) are cleared."""
    w = Window.partitionBy("doc_id").orderBy("page_number")
    key = F.concat_ws("|", F.coalesce("label_type", F.lit("")), F.coalesce("label_prefix", F.lit("")), (F.col("page_number") - F.col("label_value")).cast("string"))
    df = pages.withColumn("_key", F.when(F.col("label_value").isNotNull(), key))
    df = df.withColumn("_new", ~F.coalesce(F.col("_key") == F.lag("_key").over(w), F.lit(False)))
    df = df.withColumn("_run", islands(F.col("_new"), w))
    n = F.count(F.lit(1)).over(Window.partitionBy("doc_id", "_run"))
    ok = F.col("_key").isNotNull() & (n >= least_run)
    df = df.withColumn("_ok", ok)
    return df.withColumns({c: F.when(F.col("_ok"), F.col(c)) for c in ("label_type", "label_value", "label_prefix")}).drop("_key", "_new", "_run", "_ok")
