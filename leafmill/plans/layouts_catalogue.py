"""Registered queries over laid-out pages, office sections, records and the read tools, each beside its SQL twin."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from leafmill.functions import text as tx
from leafmill.operators import labels, layouts, ocr, retrieve, tables
from leafmill.plans.catalogue import _pick, _quoted
from leafmill.plans.oracles import _TERMS, BLOCKS, LINES
from leafmill.plans.oracles import ORACLES as FIRST
from leafmill.plans.queries import _lines, _points, _table, _tree, _words, _years_by_region
from leafmill.sources import sections

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _with(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


_W = """w AS (SELECT CAST(l_orderkey % 50 AS BIGINT) AS doc_id, CAST(l_partkey // 400 AS BIGINT) AS page_number, CAST(l_orderkey AS BIGINT) * 10 + l_linenumber AS word_id, CAST(l_partkey % 500 AS DOUBLE) AS x0, CAST((l_orderkey * 7 + l_linenumber * 13) % 700 AS DOUBLE) AS y0, x0 + CAST(l_quantity AS DOUBLE) + 1 AS x1, y0 + 10 AS y1 FROM lineitem)"""


@_with("""WITH l AS (SELECT l_orderkey % 50 AS d, l_orderkey // 64 AS lay, l_linenumber % 4 + CASE WHEN l_orderkey // 64 % 3 = 0 THEN 6 ELSE 0 END AS c, CAST(l_quantity AS DOUBLE) - 25 + CASE WHEN l_orderkey // 64 % 2 = 0 THEN 15 ELSE -15 END AS s, CASE WHEN l_linenumber % 2 = 0 THEN l_suppkey END AS r, CASE WHEN l_orderkey // 64 % 11 = 0 AND l_linenumber = 1 THEN 'chart' WHEN l_orderkey // 64 % 13 = 0 AND l_linenumber = 1 THEN 'heading' END AS b, CASE WHEN l_orderkey // 64 % 7 = 0 AND l_linenumber = 2 THEN 1 END AS t FROM lineitem),
g AS (SELECT d, lay, count(*) AS n, median(c) AS mc, max(c) AS xc, median(s) AS ms, count(DISTINCT r) AS k, bool_or(coalesce(b = 'chart', false)) AS ch, bool_or(coalesce(b = 'heading', false)) AS tx, bool_or(t IS NOT NULL) AS tb FROM l GROUP BY ALL),
p AS (SELECT *, CASE WHEN mc > 10 THEN 10 WHEN mc > 5 THEN 5 WHEN mc > 2 THEN 1 WHEN mc <= 1 THEN -5 WHEN mc <= 2 THEN -1 ELSE 0 END + CASE WHEN k > 15 THEN 20 WHEN k > 10 THEN 10 WHEN k > 4 THEN 5 WHEN k > 2 THEN 1 WHEN k = 0 THEN -2 ELSE 0 END
 + CASE WHEN ms < -8 THEN -10 WHEN ms < -5 THEN -5 WHEN ms < 0 THEN -2 WHEN ms > 8 THEN 10 WHEN ms > 5 THEN 5 WHEN ms > 2 THEN 2 ELSE 0 END + CASE WHEN n = 1 THEN -10 WHEN n < 4 THEN -1 WHEN n > 10 THEN 2 ELSE 1 END AS score, CASE WHEN ch THEN 'chart' WHEN tb THEN 'table' WHEN tx OR xc <= 1 THEN 'text' END AS sure FROM g)
SELECT CAST(d AS BIGINT) AS doc_id, CAST(lay AS BIGINT) AS layout_id, coalesce(sure, CASE WHEN score > 1 THEN 'table' ELSE 'text' END) AS layout_type, CASE WHEN sure IS NULL THEN CAST(score AS DOUBLE) END AS layout_score FROM p""")
def layout_types(spark, sf_dir):
    li, lay, n = _table(spark, sf_dir, "lineitem"), F.floor(F.col("l_orderkey") / 64), F.col("l_linenumber")
    lines = li.select(
        (F.col("l_orderkey") % 50).cast("long").alias("doc_id"), lay.cast("long").alias("layout_id"), (n % 4 + F.when(lay % 3 == 0, 6).otherwise(0)).alias("cell_count"), (F.col("l_quantity").cast("double") - 25 + F.when(lay % 2 == 0, 15).otherwise(-15)).alias("line_score"),
        F.when(n % 2 == 0, F.col("l_suppkey")).cast("long").alias("rule_above"), F.when((lay % 11 == 0) & (n == 1), "chart").when((lay % 13 == 0) & (n == 1), "heading").alias("block_type"), F.when((lay % 7 == 0) & (n == 2), 1).cast("long").alias("table_id"),
    )
    return layouts.layout_types(lines)


@_with(f"""WITH {_W}, c AS (SELECT *, word_id // 10 AS cell, CASE WHEN word_id % 10 = 1 THEN 7.0 ELSE 10.0 END AS f, y0 - y0 + CASE WHEN word_id % 20 = 1 THEN 95.0 WHEN word_id % 20 = 11 THEN 105.0 ELSE 100.0 END AS yb, CASE WHEN word_id % 30 < 10 THEN '2' WHEN word_id % 30 < 20 THEN 'th' ELSE '(a)' END AS t FROM w),
r AS (SELECT *, max(f) OVER p AS ref FROM c WINDOW p AS (PARTITION BY doc_id, page_number, cell)), s AS (SELECT *, f < 0.85 * ref AS small FROM r),
b AS (SELECT *, median(CASE WHEN f >= 0.9 * ref THEN yb END) OVER p AS base, sum(CASE WHEN small THEN 1 ELSE 0 END) OVER p <= sum(CASE WHEN small THEN 0 ELSE 1 END) OVER p AS ok FROM s WINDOW p AS (PARTITION BY doc_id, page_number, cell))
SELECT doc_id, page_number, word_id, CASE WHEN small AND ok AND t <> 'th' THEN CASE WHEN base - yb > 0.15 * ref THEN 'superscript' WHEN base - yb < -0.15 * ref THEN 'subscript' END END AS script_type FROM b""")
def cell_scripts(spark, sf_dir):
    k = F.col("word_id")
    words = _words(spark, sf_dir).withColumns({"cell_id": F.floor(k / 10), "font_size": F.when(k % 10 == 1, 7.0).otherwise(10.0), "y_bottom": F.when(k % 20 == 1, 95.0).when(k % 20 == 11, 105.0).otherwise(100.0), "text": F.when(k % 30 < 10, "2").when(k % 30 < 20, "th").otherwise("(a)")})
    return layouts.cell_scripts(words).select("doc_id", "page_number", "word_id", "script_type")


@_with(f"""WITH {_W}, j AS (SELECT *, CASE WHEN x0 - lag(x0) OVER o <= 5 THEN 0 ELSE 1 END AS s FROM w WINDOW o AS (PARTITION BY doc_id, page_number ORDER BY x0, y0, word_id))
SELECT doc_id, page_number, word_id, CAST(sum(s) OVER (PARTITION BY doc_id, page_number ORDER BY x0, y0, word_id) AS BIGINT) AS line_id FROM j""")
def vertical_word_lines(spark, sf_dir):
    return layouts.vertical_lines(_words(spark, sf_dir)).select("doc_id", "page_number", "word_id", "line_id")


@_with("""WITH t AS (SELECT s_suppkey AS t, 10.0 * s_nationkey AS x, 5.0 * s_nationkey AS y FROM supplier), k AS (SELECT unnest(range(0, 4)) AS k),
c AS (SELECT t, a.k AS r, b.k AS c, CASE WHEN b.k = 1 THEN 2 ELSE 1 END AS span, x, y FROM t, k a, k b WHERE a.k < 3 AND b.k <> 2), e AS (SELECT k, sum(20.0 + k) OVER (ORDER BY k) * 400 / 86 AS cto, (sum(20.0 + k) OVER (ORDER BY k) - 20 - k) * 400 / 86 AS cfrom FROM k), f AS (SELECT k, sum(10.0 + k) OVER (ORDER BY k) * 90 / 33 AS rto, (sum(10.0 + k) OVER (ORDER BY k) - 10 - k) * 90 / 33 AS rfrom FROM k WHERE k < 3)
SELECT CAST(t AS BIGINT) AS table_id, CAST(r AS INTEGER) AS row_start, CAST(c AS INTEGER) AS col_start, round(CAST(x + a.cfrom AS DOUBLE), 6) AS x_left, round(CAST(y + rfrom AS DOUBLE), 6) AS y_top, round(CAST(x + b.cto AS DOUBLE), 6) AS x_right, round(CAST(y + rto AS DOUBLE), 6) AS y_bottom FROM c JOIN e a ON a.k = c.c JOIN e b ON b.k = least(c.c + span - 1, 3) JOIN f ON f.k = c.r""")
def slide_cells(spark, sf_dir):
    s = _table(spark, sf_dir, "supplier").select(F.lit(1).cast("long").alias("doc_id"), F.col("s_suppkey").cast("long").alias("table_id"), (10.0 * F.col("s_nationkey")).alias("x_left"), (5.0 * F.col("s_nationkey")).alias("y_top"))
    boxes = s.withColumns({"x_right": F.col("x_left") + 400.0, "y_bottom": F.col("y_top") + 90.0})
    places = lambda n, name: s.select("doc_id", "table_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name))
    columns, rows = places(4, "col").withColumn("width", 20.0 + F.col("col")), places(3, "row").withColumn("height", 10.0 + F.col("row"))
    cells = rows.join(columns.where("col <> 2"), ["doc_id", "table_id"]).select("doc_id", "table_id", F.col("row").alias("row_start"), F.col("col").alias("col_start"), F.when(F.col("col") == 1, 2).otherwise(1).alias("colspan"))
    got = layouts.slide_cell_boxes(cells, columns, rows, boxes)
    return got.select("table_id", "row_start", "col_start", *[F.round(c, 6).alias(c) for c in ("x_left", "y_top", "x_right", "y_bottom")])


@_with(f"""WITH {_W}, t AS (SELECT *, CASE WHEN word_id % 5 > 0 THEN word_id // 10 % 8 END AS o, CASE WHEN word_id % 3 = 0 THEN word_id % 10 END AS tag, CASE WHEN word_id % 6 = 0 THEN 'heading' WHEN word_id % 7 = 0 THEN 'table' END AS b FROM w),
f AS (SELECT *, first_value(CASE WHEN tag IS NOT NULL THEN tag END IGNORE NULLS) OVER p AS ft, first_value(CASE WHEN tag IS NOT NULL THEN b END IGNORE NULLS) OVER p AS fb FROM t WINDOW p AS (PARTITION BY doc_id, page_number, o ORDER BY word_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT doc_id, page_number, word_id, CASE WHEN tag IS NULL AND o IS NOT NULL THEN ft ELSE tag END AS struct_tag_id, CASE WHEN tag IS NULL AND o IS NOT NULL THEN coalesce(b, fb) ELSE b END AS block_type FROM f""")
def repaired_tags(spark, sf_dir):
    k = F.col("word_id")
    words = _words(spark, sf_dir).withColumns({"text_object_id": F.when(k % 5 > 0, F.floor(k / 10) % 8), "struct_tag_id": F.when(k % 3 == 0, k % 10), "block_type": F.when(k % 6 == 0, "heading").when(k % 7 == 0, "table")})
    return layouts.repaired_tags(words).select("doc_id", "page_number", "word_id", "struct_tag_id", "block_type")


@_with(f"""WITH {_W}, t AS (SELECT *, CASE WHEN word_id % 3 = 0 THEN word_id // 10 % 6 END AS tag, CASE WHEN word_id % 3 <> 0 AND word_id % 4 = 0 THEN word_id // 10 % 5 END AS m FROM w),
c AS (SELECT doc_id, page_number, count(DISTINCT tag) > 1 AS a, count(DISTINCT m) > 1 AS b FROM t GROUP BY ALL), k AS (SELECT t.*, coalesce(CASE WHEN a AND tag IS NOT NULL THEN '0:' || tag END, CASE WHEN b AND m IS NOT NULL THEN '1:' || m END) AS key FROM t JOIN c USING (doc_id, page_number)),
s AS (SELECT *, min(word_id) OVER (PARTITION BY doc_id, page_number, key) AS since FROM k)
SELECT doc_id, page_number, word_id, CASE WHEN key IS NOT NULL THEN CAST(dense_rank() OVER (PARTITION BY doc_id, page_number, key IS NOT NULL ORDER BY since) AS INTEGER) END AS struct_group_id FROM s""")
def tagged_groups(spark, sf_dir):
    k = F.col("word_id")
    words = _words(spark, sf_dir).withColumns({"struct_tag_id": F.when(k % 3 == 0, F.floor(k / 10) % 6), "mcid": F.when((k % 3 != 0) & (k % 4 == 0), F.floor(k / 10) % 5)})
    return layouts.struct_groups(words).select("doc_id", "page_number", "word_id", "struct_group_id")


@_with(f"""WITH {_W}, c AS (SELECT doc_id, page_number, word_id, word_id % 97 AS k, y0, x0 FROM w), f AS (SELECT *, min(struct_pack(a := y0, b := x0, c := word_id)) OVER (PARTITION BY doc_id, page_number, k) AS first FROM c)
SELECT doc_id, page_number, word_id, CAST(dense_rank() OVER (PARTITION BY doc_id, page_number ORDER BY first, k) AS BIGINT) AS cell_id FROM f""")
def renumbered_cells(spark, sf_dir):
    words = _words(spark, sf_dir).withColumn("cell_id", F.col("word_id") % 97)
    return layouts.renumbered(words, "cell_id", ["y_top", "x_left", "word_id"]).select("doc_id", "page_number", "word_id", "cell_id")


@_with("""WITH leaf AS (SELECT o_custkey % 40 AS d, o_orderkey AS m, o_orderkey % 5 AS e, o_orderkey * 2 AS r FROM orders), w AS (SELECT o_custkey % 40 AS d, o_orderkey AS id, o_orderkey * 2 + 1 AS r FROM orders WHERE o_orderkey % 9 = 0),
p AS (SELECT w.d, id, w.r, arg_max(leaf.e, leaf.r) AS e, max(leaf.r) AS lr FROM w JOIN leaf ON leaf.d = w.d AND leaf.r < w.r GROUP BY ALL), o AS (SELECT leaf.d, m, id, p.r - lr AS far FROM p JOIN leaf ON leaf.d = p.d AND leaf.e = p.e),
b AS (SELECT *, row_number() OVER (PARTITION BY d, m ORDER BY far, id) AS k FROM o) SELECT CAST(d AS BIGINT) AS doc_id, CAST(m AS BIGINT) AS mcid, CAST(id AS BIGINT) AS widget_id FROM b WHERE k = 1""")
def form_labels(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).cast("long").alias("doc_id"), F.lit(1).cast("long").alias("page_number"), F.col("o_orderkey").cast("long").alias("mcid"))
    leaves = o.withColumns({"elem_id": F.col("mcid") % 5, "ancestor_ids": F.array(F.lit(-1).cast("long")), "rank": F.col("mcid") * 2})
    widgets = o.where(F.col("mcid") % 9 == 0).select("doc_id", "page_number", F.col("mcid").alias("widget_id"), F.lit(-2).cast("long").alias("elem_id"), (F.col("mcid") * 2 + 1).alias("rank"))
    return layouts.form_labels(leaves, widgets).select("doc_id", "mcid", "widget_id")


@_with(rf"""WITH {LINES}, t AS (SELECT doc_id, ord, text, CASE WHEN ord % 12 < 9 THEN ord WHEN ord % 12 = 11 THEN NULL ELSE 100000 + ord // 12 END AS t, CASE WHEN ord // 12 % 2 = 0 THEN 3 ELSE ord % 2 END AS c FROM line),
l AS (SELECT *, t IS NOT NULL AND count(DISTINCT ord) OVER (PARTITION BY doc_id, t) = 1 AS lone FROM t), n AS (SELECT *, CASE WHEN lone AND NOT (coalesce(lag(lone) OVER o, false) AND lag(c) OVER o = c) THEN 1 ELSE 0 END AS s FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY ord)),
r AS (SELECT *, CASE WHEN lone THEN sum(s) OVER (PARTITION BY doc_id ORDER BY ord) END AS run FROM n), j AS (SELECT *, lone AND count(*) OVER (PARTITION BY doc_id, run) >= 5 AND sum(CASE WHEN regexp_matches(regexp_replace(text, '^\s+', ''), '^(\d|\([a-zA-Z0-9]+\)|[•◦▪▸·‣⁃●○►▶◆◇□■])') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, run) <= 0.1 * count(*) OVER (PARTITION BY doc_id, run) AS joined FROM r),
k AS (SELECT *, CASE WHEN joined THEN 'r' || run WHEN NOT lone AND t IS NOT NULL THEN 't' || t END AS key FROM j), f AS (SELECT *, min(ord) OVER (PARTITION BY doc_id, key) AS since FROM k)
SELECT doc_id, ord, CASE WHEN key IS NOT NULL THEN dense_rank() OVER (PARTITION BY doc_id, key IS NOT NULL ORDER BY since) END AS table_id, CASE WHEN joined THEN row_number() OVER (PARTITION BY doc_id, run ORDER BY ord) WHEN NOT lone THEN ord END AS table_row_id FROM f""")
def lone_table_rows(spark, sf_dir):
    """Tables of one row: nine in a row, then one of two rows and a line of text."""
    k = F.col("ord") % 12
    df = _lines(spark, sf_dir).withColumns({"table_id": F.when(k < 9, F.col("ord")).when(k < 11, 100000 + F.floor(F.col("ord") / 12)), "table_row_id": F.col("ord"), "cell_count": F.when(F.floor(F.col("ord") / 12) % 2 == 0, 3).otherwise(F.col("ord") % 2)})
    return tables.lone_rows(df).select("doc_id", "ord", "table_id", "table_row_id")


@_with(f"""SELECT m.table_id, m.text AS markdown, k.n AS n_cells FROM ({FIRST["table_markdown"]}) m JOIN (SELECT table_id, count(*) AS n FROM ({FIRST["table_roles"]}) GROUP BY table_id) k USING (table_id)""")
def table_records(spark, sf_dir):
    got = tables.records(tables.with_roles(_years_by_region(spark, sf_dir)))
    return got.select("table_id", "markdown", F.size("cells").cast("long").alias("n_cells"))


@_with("""SELECT CAST(1 AS BIGINT) AS chart_id, 'pie' AS chart_type, (SELECT string_agg(s, ',' ORDER BY s) FROM (SELECT DISTINCT event_type AS s FROM events)) AS series, (SELECT count(*) FROM (SELECT DISTINCT event_type, hour(ts) FROM events)) AS n_points""")
def chart_records(spark, sf_dir):
    return tables.chart_records(_points(spark, sf_dir)).select("chart_id", "chart_type", F.array_join("series", ",").alias("series"), F.size("points").cast("long").alias("n_points"))


_FOOTS = ("Page 2 of 20", "Apple Inc. | Q1 2026 | 2", "Annex A-1-86", "3 of 10 items", "7 of 3", "Revenue 5", "", "Exhibit F-5", "a | ", "12 OF 12 ")


@_with(f"""SELECT p_partkey, ['2', '2', 'A-1-86', NULL, NULL, NULL, NULL, 'F-5', NULL, '12'][p_partkey % {len(_FOOTS)} + 1] AS label FROM part""")
def embedded_labels(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", labels.embedded(_pick(_FOOTS, F.col("p_partkey"))).alias("label"))


@_with("""WITH c AS (SELECT conv_id, count(*) AS n FROM (SELECT DISTINCT conv_id, turn FROM conversations) GROUP BY conv_id) SELECT conv_id AS doc_id, CASE conv_id % 4 WHEN 0 THEN 'Top > First' WHEN 1 THEN 'Top > Second' WHEN 2 THEN 'Top > Third' ELSE 'Top > First' END AS heading FROM c""")
def hit_headings(spark, sf_dir):
    """Which of a merged chunk's headings a place stands under."""
    text = F.lit("## First\n\nwords of one\n\n## Second\n\nwords of two\n\n## Third\n\nlast words")
    at = F.instr(text, _pick(("one", "two", "last", "## First"), F.col("conv_id"))) - 1
    path = F.array(F.lit("# Top"), F.lit("## First | Second | Third"))
    return _table(spark, sf_dir, "conversations").select("conv_id").distinct().select(F.col("conv_id").alias("doc_id"), retrieve.hit_heading(path, text, at).alias("heading"))


@_with("""SELECT CAST(1 AS BIGINT) AS doc_id, string_agg(CASE WHEN k = 1 OR n_regionkey <> b THEN '[Page ' || n_regionkey || ']' || chr(10) || chr(10) ELSE '' END || 'about ' || s_name, chr(10) || chr(10) ORDER BY s_suppkey) AS text
FROM (SELECT *, row_number() OVER (ORDER BY s_suppkey) AS k, lag(n_regionkey) OVER (ORDER BY s_suppkey) AS b FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' OR n_name = 'FRANCE')""")
def read_sections(spark, sf_dir):
    """What stands under a region and under one nation of another, as one text."""
    paths = retrieve.with_paths(_tree(spark, sf_dir))
    s = _table(spark, sf_dir, "supplier").join(_table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    made = s.select(F.lit(1).cast("long").alias("doc_id"), (1000 + F.col("s_suppkey")).cast("long").alias("heading_id"), F.col("s_suppkey").cast("long").alias("ord"), F.concat(F.lit("about "), "s_name").alias("text"), F.lit("paragraph").alias("block_type"), F.col("n_regionkey").alias("page_number"), F.lit(None).cast("string").alias("page_label"))
    return retrieve.read(made, paths, ["ASIA", "EUROPE > FRANCE", "ASIA > CHINA"])


@_with(f"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'own' END AS g, source || '_' || lang AS s FROM documents), l AS (SELECT doc_id, list_concat(CASE WHEN g IS NULL THEN [] ELSE [g] END, [split_part(s, '_', 1), lower(split_part(s, '_', 1)), upper(split_part(s, '_', 1)), split_part(s, '_', 2), lower(split_part(s, '_', 2)), upper(split_part(s, '_', 2)), '2024'], {_quoted(tx.COMMON_PASSWORDS)}) AS l FROM d),
u AS (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM l) SELECT doc_id, string_agg(l[i], '|' ORDER BY i) AS candidates FROM u WHERE list_position(l, l[i]) = i GROUP BY doc_id""")
def password_lists(spark, sf_dir):
    d = _table(spark, sf_dir, "documents")
    found = tx.password_candidates(F.when(F.col("doc_id") % 2 == 0, "own"), F.concat(F.lit("a/"), "source", F.lit("_"), "lang", F.lit("_2024.pdf")))
    # All but the whole name.
    return d.select("doc_id", F.array_join(F.filter(found, lambda p: ~p.contains("_2024")), "|").alias("candidates"))


_FORMATS = (None, "lowerRoman", "upperRoman", "lowerLetter", "upperLetter", "decimalZero")


def _office(spark, sf_dir):
    c = _table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    pages = c.select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("page_number"), F.floor(F.col("turn") / 3).alias("section_id"))
    own = pages.select("doc_id", "section_id").distinct().withColumn("k", F.col("doc_id") + F.col("section_id"))
    made = own.select("doc_id", "section_id", F.when(F.col("k") % 3 == 0, F.col("k") % 9 + 1).alias("page_number_start"), _pick(_FORMATS, F.col("k")).alias("page_number_format"), (F.col("k") % 2 == 0).alias("has_title_page"), (F.col("k") % 4 == 1).alias("has_even_and_odd"))
    parts = own.select("doc_id", "section_id", F.lit("footer").alias("kind"), F.explode(F.array(F.lit("first"), F.lit("even"), F.lit("default"))).alias("type")).withColumns({"part": F.concat(F.col("type"), F.lit(".xml")), "has_page_field": F.col("type") != "first"})
    return pages, made, parts


_OFFICE = f"""p AS (SELECT conv_id AS d, turn + 1 AS p, turn // 3 AS s, conv_id + turn // 3 AS k FROM (SELECT DISTINCT conv_id, turn FROM conversations)),
s AS (SELECT d, s, k, min(p) AS f, max(p) - min(p) + 1 AS n, CASE WHEN k % 3 = 0 THEN k % 9 + 1 END AS st, {_quoted(_FORMATS)}[k % 6 + 1] AS fmt FROM p GROUP BY ALL),
o AS (SELECT *, coalesce(st, CASE WHEN row_number() OVER (PARTITION BY d ORDER BY s) = 1 THEN f END) AS own FROM s), r AS (SELECT *, count(own) OVER (PARTITION BY d ORDER BY s) AS run FROM o),
b AS (SELECT *, first_value(own) OVER (PARTITION BY d, run ORDER BY s) + coalesce(sum(n) OVER (PARTITION BY d, run ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM r),
g AS (SELECT p.d, p.p, p.s, p.k, fmt, start + p.p - f AS num, CASE WHEN p.k % 2 = 0 AND p.p = f THEN 'first' WHEN p.k % 4 = 1 AND p.p % 2 = 0 THEN 'even' ELSE 'default' END AS type FROM p JOIN b ON p.d = b.d AND p.s = b.s)"""


@_with(f"""WITH {_OFFICE}, x AS (SELECT *, ['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'][CAST(num // 10 % 10 AS INTEGER) + 1] || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][CAST(num % 10 AS INTEGER) + 1] AS roman, CASE WHEN num <= 26 THEN chr(CAST(64 + num AS INTEGER)) ELSE chr(CAST(64 + (num - 1) // 26 AS INTEGER)) || chr(CAST(65 + (num - 1) % 26 AS INTEGER)) END AS letter FROM g)
SELECT d AS doc_id, p AS page_number, CASE WHEN type <> 'first' THEN CASE fmt WHEN 'lowerRoman' THEN lower(roman) WHEN 'upperRoman' THEN roman WHEN 'lowerLetter' THEN lower(letter) WHEN 'upperLetter' THEN letter WHEN 'decimalZero' THEN printf('%02d', CAST(num AS INTEGER)) ELSE CAST(CAST(num AS BIGINT) AS VARCHAR) END END AS page_label FROM x""")
def office_page_labels(spark, sf_dir):
    """Printed page labels from the settings of sections: conversations as files, three turns a section."""
    return sections.page_labels(*_office(spark, sf_dir)).select("doc_id", "page_number", "page_label")


@_with(f"""WITH {_OFFICE} SELECT d AS doc_id, p AS page_number, type, type || '.xml' AS part FROM g""")
def office_footers(spark, sf_dir):
    """The footer of each page by the rule of first, even and other pages."""
    return sections.furniture(*_office(spark, sf_dir)).select("doc_id", "page_number", "type", "part")


@_with("""SELECT o_orderkey FROM orders WHERE o_orderkey % 4 <> 1""")
def visible_runs(spark, sf_dir):
    return sections.without_invisible(_table(spark, sf_dir, "orders").withColumn("font_name", _pick(("Arial", " ZWAdobeF ", None, "Times"), F.col("o_orderkey")))).select("o_orderkey")


_READ = ("ﬁne", "“quoted”", "a​b", "-----", "wait....", "what??", "x − y", "two  words ", "a‐b", "«so»", "—_—", "no,,")


@_with(f"""SELECT p_partkey, ['fine', '"quoted"', 'ab', '', 'wait...', 'what?', 'x - y', 'two words', 'a-b', '"so"', '', 'no,'][p_partkey % {len(_READ)} + 1] AS text FROM part""")
def ocr_words(spark, sf_dir):
    """Words as OCR reads them, without their noise."""
    return _table(spark, sf_dir, "part").select("p_partkey", ocr.cleaned_text(_pick(_READ, F.col("p_partkey"))).alias("text"))


@_with(f"""WITH {_W}, l AS (SELECT doc_id, page_number AS lay, word_id // 10 AS line, median(8.0 + word_id % 5) AS h, bool_or(word_id % 4 <> 0) AS tall, bool_or(word_id % 3 = 0) AS deep FROM w GROUP BY ALL),
r AS (SELECT doc_id, lay, round(h * (1 + CASE WHEN tall THEN 0 ELSE 0.2 END + CASE WHEN deep THEN 0 ELSE 0.2 END), 1) AS h, count(*) AS n FROM l GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lay ORDER BY n DESC, h) AS k FROM r), z AS (SELECT doc_id, lay, h * 1.18 AS h FROM b WHERE k = 1)
SELECT doc_id, lay AS layout_id, CAST(CASE WHEN h < 5.5 THEN 5 WHEN h < 6.5 THEN 6 WHEN h < 7.5 THEN 7 WHEN h < 8.5 THEN 8 WHEN h < 9.5 THEN 9 WHEN h < 10.5 THEN 10 WHEN h < 11.5 THEN 11 WHEN h < 13 THEN 12 WHEN h < 15 THEN 14 WHEN h < 17 THEN 16 WHEN h < 19 THEN 18 WHEN h < 21 THEN 20 ELSE 24 END AS DOUBLE) AS font_size FROM z""")
def ocr_font_sizes(spark, sf_dir):
    k = F.col("word_id")
    words = _words(spark, sf_dir).withColumns({"layout_id": F.col("page_number"), "line_id": F.floor(k / 10), "y_top": F.lit(0.0), "y_bottom": 8.0 + k % 5, "text": F.concat(F.when(k % 4 != 0, "T").otherwise("x"), F.when(k % 3 == 0, "g").otherwise("x"))})
    return ocr.font_sizes(words)


@_with(f"""WITH {_W}, t AS (SELECT *, {_quoted(("-", "|", "word", "==", "]"))}[word_id % 5 + 1] AS text FROM w), s AS (SELECT CAST(p_partkey % 50 AS BIGINT) AS doc_id, CAST(p_partkey // 400 AS BIGINT) AS page_number, p_partkey % 2 = 0 AS flat, CAST(p_partkey % 400 AS DOUBLE) AS x0, CAST(p_partkey * 17 % 700 AS DOUBLE) AS y0 FROM part),
g AS (SELECT DISTINCT t.word_id, t.doc_id, t.page_number FROM t JOIN s ON t.doc_id = s.doc_id AND t.page_number = s.page_number AND ((flat AND t.text IN ('-', '==') AND t.x0 <= s.x0 + 300 AND t.x1 >= s.x0 AND t.y0 <= s.y0 + 1 + 3 AND t.y1 >= s.y0 - 3) OR (NOT flat AND t.text IN ('|', '==', ']') AND t.x0 <= s.x0 + 1 + 3 AND t.x1 >= s.x0 - 3 AND t.y0 <= s.y0 + 300 AND t.y1 >= s.y0)))
SELECT t.doc_id, t.page_number, t.word_id, CASE WHEN g.word_id IS NOT NULL THEN '' ELSE text END AS text FROM t LEFT JOIN g ON t.doc_id = g.doc_id AND t.page_number = g.page_number AND t.word_id = g.word_id""")
def rule_words(spark, sf_dir):
    """Rule signs that lie on rules."""
    p, flat = F.col("p_partkey"), F.col("p_partkey") % 2 == 0
    shapes = _table(spark, sf_dir, "part").select((p % 50).cast("long").alias("doc_id"), F.floor(p / 400).cast("long").alias("page_number"), F.when(flat, "horizontal").otherwise("vertical").alias("orientation"), (p % 400).cast("double").alias("x_left"), (p * 17 % 700).cast("double").alias("y_top"), flat.alias("f"))
    shapes = shapes.withColumns({"x_right": F.col("x_left") + F.when(F.col("f"), 300.0).otherwise(1.0), "y_bottom": F.col("y_top") + F.when(F.col("f"), 1.0).otherwise(300.0)}).drop("f")
    words = _words(spark, sf_dir).withColumn("text", _pick(("-", "|", "word", "==", "]"), F.col("word_id")))
    return ocr.without_rule_words(words, shapes).select("doc_id", "page_number", "word_id", "text")


@_with(f"""WITH {_W}, l AS (SELECT *, round((y0 + y0 + 1) / 2 / 2) AS lev, max(x1) OVER (PARTITION BY doc_id, page_number, round((y0 + y0 + 1) / 2 / 2) ORDER BY x0, x1, word_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM w),
s AS (SELECT *, CASE WHEN reach IS NULL OR x0 - reach > 6 THEN 1 ELSE 0 END AS s FROM l), r AS (SELECT *, sum(s) OVER (PARTITION BY doc_id, page_number, lev ORDER BY x0, x1, word_id) AS run FROM s)
SELECT doc_id, page_number, min(word_id) AS rule_id, min(x0) AS x_left, max(x1) AS x_right FROM r GROUP BY doc_id, page_number, lev, run""")
def merged_rules(spark, sf_dir):
    """Rules on one height that follow each other, as one."""
    rules = _words(spark, sf_dir).withColumn("rule_id", F.col("word_id")).withColumn("y_bottom", F.col("y_top") + 1)
    return ocr.collinear(rules).select("doc_id", "page_number", "rule_id", "x_left", "x_right")


@_with("""WITH b AS (SELECT s_suppkey, s_name, n_name, r_name, n_nationkey, r_regionkey, length(s_name) * 37 AS t FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
h AS (SELECT r_regionkey AS a, -1 AS b, -1 AS c, r_name AS t, 1 AS d, (SELECT coalesce(sum(t), 0) FROM b WHERE b.r_regionkey = region.r_regionkey) AS n FROM region UNION ALL SELECT n_regionkey, 100 + n_nationkey, -1, n_name, 2, (SELECT coalesce(sum(t), 0) FROM b WHERE b.n_nationkey = nation.n_nationkey) FROM nation UNION ALL SELECT r_regionkey, 100 + n_nationkey, 1000 + s_suppkey, s_name, 3, t FROM b)
SELECT CAST(1 AS BIGINT) AS doc_id, string_agg(repeat('  ', d - 1) || '- ' || t || '  ~' || CASE WHEN n >= 10000 THEN CAST(CAST(round_even(n / 1000, 0) AS BIGINT) AS VARCHAR) || 'k' WHEN n >= 1000 THEN format('{:.1f}', n / 1000) || 'k' ELSE CAST(n AS VARCHAR) END, chr(10) ORDER BY a, b, c) AS text FROM h""")
def priced_outline(spark, sf_dir):
    """The outline tool: each heading with what reading it costs."""
    from leafmill.plans.queries import _tree_blocks

    return retrieve.outline_tool(retrieve.with_paths(_tree(spark, sf_dir)), _tree_blocks(spark, sf_dir))


@_with(rf"""WITH {BLOCKS}, c AS (SELECT doc_id, block_id AS b, text, {_TERMS} AS w FROM block WHERE regexp_replace(text, '^\s+|\s+$', '', 'g') <> ''),
q AS (SELECT item_id AS q, trim(text) AS t, {_TERMS} AS w FROM benchmark), asked AS (SELECT DISTINCT q, unnest(w) AS term FROM q),
tf AS (SELECT doc_id, b, term, count(*) AS tf, any_value(n) AS len FROM (SELECT doc_id, b, unnest(w) AS term, len(w) AS n FROM c) GROUP BY ALL), df AS (SELECT doc_id, term, count(*) AS df FROM tf GROUP BY ALL), st AS (SELECT doc_id, count(*) AS n, avg(len(w)) AS a FROM c GROUP BY doc_id),
sc AS (SELECT q, doc_id, b, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.6 + 0.4 * len / CASE WHEN a = 0 THEN 1 ELSE a END))) AS score FROM asked JOIN tf USING (term) JOIN df USING (doc_id, term) JOIN st USING (doc_id) GROUP BY ALL),
lit AS (SELECT q, doc_id, b FROM q, c WHERE t <> '' AND regexp_matches(c.text, '(?i)' || CASE WHEN regexp_matches(t, '^[\p{{L}}\p{{N}}_]') THEN '(^|[^\p{{L}}\p{{M}}\p{{N}}_])' ELSE '' END || regexp_escape(t) || CASE WHEN regexp_matches(t, '[\p{{L}}\p{{N}}_]$') THEN '($|[^\p{{L}}\p{{M}}\p{{N}}_])' ELSE '' END)),
hit AS (SELECT q, doc_id, b, coalesce(score, 0) AS score, lit.b IS NOT NULL AS literal FROM sc FULL JOIN lit USING (q, doc_id, b)), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY literal DESC, round(score, 9) DESC, doc_id, b) AS k FROM hit),
x AS (SELECT r.*, c.text, q.t, list_filter(list_transform(list_sort(list_transform(list_distinct(q.w), lambda z: struct_pack(a := -length(z), b := z))), lambda z: instr(replace(lower(c.text), 'ß', 'ss'), z.b)), lambda p: p > 0) AS spots FROM r JOIN c USING (doc_id, b) JOIN q USING (q) WHERE k <= 8),
y AS (SELECT *, length(text) AS n, CASE WHEN literal THEN instr(lower(text), lower(t)) - 1 WHEN len(spots) > 0 THEN spots[1] - 1 ELSE 0 END AS p FROM x), z AS (SELECT *, greatest(0, p - 106) AS low, least(n, greatest(0, p - 106) + 320) AS high FROM y),
v AS (SELECT *, CASE WHEN low > 0 AND instr(substr(text, low + 1, p + 1 - low), ' ') > 0 THEN low + instr(substr(text, low + 1, p + 1 - low), ' ') ELSE low END AS s, CASE WHEN high < n AND instr(reverse(substr(text, p + 1, high - p)), ' ') > 0 THEN high - instr(reverse(substr(text, p + 1, high - p)), ' ') ELSE high END AS e FROM z)
SELECT q AS query_id, CAST(k AS INTEGER) AS rank, doc_id, b AS chunk_index, literal, round(score, 6) AS score, CASE WHEN n <= 320 THEN regexp_replace(text, '^\s+|\s+$', '', 'g') ELSE CASE WHEN s > 0 THEN '… ' ELSE '' END || regexp_replace(substr(text, s + 1, e - s), '^\s+|\s+$', '', 'g') || CASE WHEN e < n THEN ' …' ELSE '' END END AS snippet FROM v""")
def search_snippets(spark, sf_dir):
    from leafmill.plans.queries import search_snippets as made

    return made(spark, sf_dir)
