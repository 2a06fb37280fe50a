import io
import zipfile

from pyspark.sql import functions as F

from leafmill.operators import export
from leafmill.sources import detect, htmltree, ooxml, pages
from leafmill.streaming import ingest

HTML = """<html lang="en-GB"><head><title>T &amp; x</title><meta name="author" content="Jo Doe"><script>var t="</p>";</script>
<script type="application/ld+json">{"headline": "Linked", "author": {"name": "Ann"}, "datePublished": "2024-01-02"}</script></head>
<body><nav><a href="/a">nav</a></nav><div class="ad">Buy</div><h1>Head</h1><p><b>Bold text<br><p>second <i>para</i> <a href="#x">link</a> tail<sup>1</sup>
<table><tr><th>A<th colspan=2>B<tr><td rowspan=2>1<td>2<td>3<tr><td>4<td><table><tr><td>in</table></table><pre>x = 1
  y</pre><div style="display:none">no</div><ul><li>one<li>two</ul><!-- c --><footer>f</footer>"""


def parsed(spark, *html):
    return pages.parse(spark.createDataFrame(list(enumerate(html)), "page_id long, html string")).cache()


def test_tree(spark):
    p = htmltree.Boxes().finish(HTML)
    texts = [b["text"] for b in p.boxes]
    assert texts == ["nav", "Buy", "Head", "Bold text", "second para", "link", "tail1", "A", "B", "1", "2", "3", "4", "in", "x = 1", "  y", "one", "two", "f"]
    by = {b["text"]: b for b in p.boxes}
    assert by["Bold text"]["is_bold"] and not by["second para"]["is_bold"] and by["link"]["link_url"] == "#x" and by["two"]["ancestors"][-2:] == ["ul", "li"]
    assert {(c["row_start"], c["col_start"], c["rowspan"], c["colspan"], c["text"]) for c in p.cells} == {(0, 0, 1, 1, "A"), (0, 1, 1, 2, "B"), (1, 0, 2, 1, "1"), (1, 1, 1, 1, "2"), (1, 2, 1, 1, "3"), (2, 1, 1, 1, "4"), (2, 2, 1, 1, "in")}


def test_lines_and_metadata(spark):
    got = parsed(spark, HTML, None, "", "<p>" * 2000 + "deep")
    lines = pages.lines(pages.without_furniture(pages.boxes(got))).where("doc_id = 0").orderBy("ord").collect()
    assert [r.text for r in lines] == ["Head", "Bold text", "second para link tail1", "A | B", "1 | 2 | 3", "4 | in", "x = 1", "  y", "one", "two"]
    assert [r.block_type for r in lines] == ["heading", None, None, "table", "table", "table", "code", "code", None, None]
    assert lines[2].link_type == "internal" and lines[0].font_size_ratio == 2.0
    meta = {r.doc_id: r for r in pages.metadata(got).collect()}
    assert (meta[0].title, meta[0].author, meta[0].language, meta[0].published) == ("Linked", "Ann", "en", "2024-01-02") and meta[1].language == "unknown" and meta[1].title is None
    assert got.where("error IS NOT NULL").count() == 0


def test_common_words_do_not_drop_a_page(spark):
    html = '<div class="widget">' + "".join(f"<p>t{i}</p>" for i in range(9)) + "</div><p>end</p>"
    assert pages.without_furniture(pages.boxes(parsed(spark, html))).count() == 10
    assert pages.without_furniture(pages.boxes(parsed(spark, '<div class="widget"><p>x</p></div><p>a</p><p>b</p>'))).count() == 2


def test_css():
    assert [htmltree.css_px(x) for x in ("12px", "12pt", "2em", "50%", "large", "x", ".")] == [12.0, 16.0, 32.0, 8.0, 18.0, None, None]
    assert htmltree.css("a:b; C : d;e") == {"a": "b", "c": "d"} and htmltree.is_bold_weight("700") and not htmltree.is_bold_weight("400")


def test_kinds(spark):
    df = spark.createDataFrame([(bytearray(b"%PDF-1.4"), "x"), (bytearray(b"PK\x03\x04"), "a.docx"), (bytearray(b"PK\x03\x04"), "a"), (bytearray(b"  <!DOCTYPE html><p>"), "u"), (bytearray(b"hi"), "b.HTM"), (bytearray(b"hi"), "b.txt")], "c binary, p string")
    assert [r[0] for r in df.select(detect.kind_of(F.col("c"), F.col("p"))).collect()] == ["pdf", "docx", "zip", "html", "html", "unknown"]


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
RELS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'


def word():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="H1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:rPr><w:b/></w:rPr><w:t>Bold</w:t></w:r><w:r><w:footnoteReference w:id="2"/></w:r></w:p><w:p><w:r><w:br w:type="page"/><w:t>Page two</w:t></w:r><w:hyperlink r:id="r9"><w:r><w:t> link</w:t></w:r></w:hyperlink></w:p><w:tbl><w:tr><w:trPr><w:tblHeader/></w:trPr><w:tc><w:p><w:r><w:t>A</w:t></w:r></w:p></w:tc><w:tc><w:tcPr><w:vMerge w:val="restart"/></w:tcPr><w:p><w:r><w:t>B</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>1</w:t></w:r></w:p></w:tc><w:tc><w:tcPr><w:vMerge/></w:tcPr><w:p/></w:tc></w:tr></w:tbl></w:body></w:document>')
        z.writestr("word/styles.xml", f'<w:styles {W}><w:style w:styleId="H1"><w:name w:val="heading 1"/><w:rPr><w:b/><w:sz w:val="32"/></w:rPr></w:style></w:styles>')
        z.writestr("word/footnotes.xml", f'<w:footnotes {W}><w:footnote w:id="2"><w:p><w:r><w:t>A note</w:t></w:r></w:p></w:footnote></w:footnotes>')
        z.writestr("word/header1.xml", f'<w:hdr {W}><w:p><w:r><w:t>Running head</w:t></w:r></w:p></w:hdr>')
        t = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/"
        z.writestr("word/_rels/document.xml.rels", RELS.format(f'<Relationship Id="r1" Type="{t}footnotes" Target="footnotes.xml"/><Relationship Id="r2" Type="{t}header" Target="header1.xml"/><Relationship Id="r9" Type="{t}hyperlink" Target="http://x.y" TargetMode="External"/>'))
        z.writestr("docProps/core.xml", '<c:coreProperties xmlns:c="c" xmlns:dc="dc"><dc:title>Doc</dc:title><dc:creator>Ann</dc:creator></c:coreProperties>')
    return out.getvalue()


def slides():
    a, p = "http://schemas.openxmlformats.org/drawingml/2006/main", "http://schemas.openxmlformats.org/presentationml/2006/main"
    r, c = "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "http://schemas.openxmlformats.org/drawingml/2006/chart"
    shape = lambda kind, text, y: f'<p:sp><p:nvSpPr><p:nvPr><p:ph type="{kind}"/></p:nvPr></p:nvSpPr><p:spPr><a:xfrm><a:off x="12700" y="{y}"/><a:ext cx="127000" cy="127000"/></a:xfrm></p:spPr><p:txBody><a:p><a:r><a:rPr b="1" sz="2400"/><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("ppt/presentation.xml", f'<p:presentation xmlns:p="{p}" xmlns:r="{r}"><p:sldIdLst><p:sldId r:id="r2"/><p:sldId r:id="r1"/></p:sldIdLst></p:presentation>')
        z.writestr("ppt/_rels/presentation.xml.rels", RELS.format('<Relationship Id="r1" Type="x/slide" Target="slides/slide1.xml"/><Relationship Id="r2" Type="x/slide" Target="slides/slide2.xml"/>'))
        z.writestr("ppt/slides/slide1.xml", f'<p:sld xmlns:p="{p}" xmlns:a="{a}" xmlns:r="{r}" xmlns:c="{c}">{shape("title", "Second", 0)}<p:graphicFrame><c:chart r:id="r5"/></p:graphicFrame></p:sld>')
        z.writestr("ppt/slides/_rels/slide1.xml.rels", RELS.format('<Relationship Id="r5" Type="x/chart" Target="../charts/chart1.xml"/>'))
        z.writestr("ppt/charts/chart1.xml", f'<c:chartSpace xmlns:c="{c}"><c:chart><c:plotArea><c:barChart><c:ser><c:tx><c:strRef><c:strCache><c:pt idx="0"><c:v>S</c:v></c:pt></c:strCache></c:strRef></c:tx><c:cat><c:strRef><c:strCache><c:pt idx="0"><c:v>a</c:v></c:pt></c:strCache></c:strRef></c:cat><c:val><c:numRef><c:numCache><c:pt idx="0"><c:v>4.5</c:v></c:pt></c:numCache></c:numRef></c:val></c:ser></c:barChart></c:plotArea></c:chart></c:chartSpace>')
        z.writestr("ppt/slides/slide2.xml", f'<p:sld xmlns:p="{p}" xmlns:a="{a}">{shape("title", "First", 0)}{shape("title", "Twice", 9)}{shape("body", "Text", 127000)}</p:sld>')
    return out.getvalue()


def test_office_files(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(word())
    (tmp_path / "b.pptx").write_bytes(slides())
    (tmp_path / "c.docx").write_bytes(b"PK\x03\x04 broken")
    (tmp_path / "d.pdf").write_bytes(b"%PDF-1.4")
    (tmp_path / "e.txt").write_bytes(b"no")
    files = detect.read_folder(spark, str(tmp_path)).cache()
    assert sorted(r.kind for r in files.collect()) == ["docx", "docx", "pdf", "pptx"]
    rows = ooxml.read_word(files).cache()
    assert rows.where("error IS NOT NULL").count() == 1
    lines = ooxml.lines(rows.where("error IS NULL")).orderBy("ord").collect()
    assert [(r.text, r.block_type, r.page_number) for r in lines] == [("Title", "heading", 1), ("Bold", None, 1), ("A note", "footnote", 1), ("Page two link", None, 2), ("Running head", "header", 2)]
    assert lines[0].is_bold and lines[0].font_size == 16.0 and lines[1].is_bold and lines[3].link_url == "http://x.y"
    cells = {(r.row_start, r.col_start): (r.text, r.rowspan, r.table_header_flag) for r in rows.where("part = 'table'").collect()}
    assert cells == {(0, 0): ("A", 1, True), (0, 1): ("B", 2, True), (1, 0): ("1", 1, False)}
    assert ooxml.metadata(rows).first().author == "Ann"
    assert ooxml.furniture_by_page(rows.where("error IS NULL")).count() == 2
    deck = ooxml.read_slides(files).cache()
    got = ooxml.lines(deck, slides=True).orderBy("ord").collect()
    assert [(r.text, r.block_type, r.page_number) for r in got] == [("First", "heading", 1), ("Twice", None, 1), ("Text", None, 1), ("Second", "heading", 2)]
    assert (got[0].x_left, got[2].y_top, got[0].font_size) == (1.0, 10.0, 24.0)
    point = deck.where("part = 'chart'").first()
    assert (point.chart_type, point.series_name, point.category, point.value) == ("bar", "S", "a", 4.5)
    assert "no PDF decoder" in detect.pdf_words(files).first().error


def test_exports(spark, tmp_path):
    rows = [(1, 1, 1, "heading", 1, "T"), (1, 2, 1, "toc", None, "c ... 1"), (1, 3, 1, "paragraph", None, "a"), (1, 4, 2, "table", None, "| x |"), (1, 5, 2, "page_label", None, "2")]
    df = spark.createDataFrame(rows, "doc_id long, ord long, page_number long, block_type string, heading_level int, text string")
    assert export.markdown(df).first().text == "<!-- page 1 -->\n\n# T\n\na\n\n<!-- page 2 -->\n\n| x |"
    assert export.plain(df, tables=False).first().text == "T\n\na" and export.contents(df).first().text == "c ... 1"
    packed = export.as_json({"blocks": df, "chunks": df.select("doc_id", F.col("ord").alias("chunk_index"), "text")})
    assert export.from_json(packed, "chunks", "chunk_index:long,text:string").count() == 5
    for kind in ("csv", "jsonl", "parquet"):
        export.save(df.withColumn("list", F.array("text")), f"{tmp_path}/out.{kind}")
    assert spark.read.parquet(f"{tmp_path}/out.parquet").count() == spark.read.option("header", True).csv(f"{tmp_path}/out.csv").count() == 5
    tree = spark.createDataFrame([(1, 1, "A", [1]), (2, 2, "B", [1, 2])], "heading_id long, depth int, text string, preorder array<long>").withColumn("doc_id", F.lit(1))
    assert export.outline(tree).first().text == "A\n  B"


def test_stream(spark, tmp_path):
    import datetime as dt

    schema = "doc_id long, text string, version timestamp"
    put = lambda name, *rows: spark.createDataFrame(list(rows), schema).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")
    read = lambda: ingest.arrivals(spark, f"{tmp_path}/in/*", schema)
    put("a", (1, "one\ntwo", dt.datetime(2024, 1, 1)), (2, "x", dt.datetime(2024, 1, 1)), (2, "x", dt.datetime(2024, 1, 1)))
    ingest.run(ingest.once(read()), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    put("b", (1, "three", dt.datetime(2024, 1, 1, 0, 5)))
    ingest.run(ingest.once(read()), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert sorted((r.doc_id, r.text) for r in ingest.current(spark, f"{tmp_path}/out").collect()) == [(1, "three"), (2, "x")]
    q = ingest.line_counts(read()).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.documents, r.lines) for r in spark.table("counts").collect()] == [(4, 5)]


def test_titles_with_cut_entities(spark, tmp_path):
    import __spark_entry__ as entry

    titles = ("A &amp; b &lt;c&gt; &amp", "Q &quot;x&quot; &quo", "R &amp;&amp;&amp;&am", "S &amp;lt;")
    rows = [(i, f'<!DOCTYPE html><html lang="en"><head><title> {t}</title></head><body><p>x</p></body></html>') for i, t in enumerate(titles)]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = entry.queries()["page_metadata"](spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [r.title for r in got] == ["A & b <c> &amp", "Q &quot;x&quot; &quo", "R &&&&am", "S &lt;"]
    assert [r.title for r in pages.metadata(pages.parse(spark.read.parquet(f"{tmp_path}/pages.parquet"))).orderBy("doc_id").collect()][:2] == ["A & b <c> &", 'Q "x" &quo']


def test_boxes_of_few_pages_are_held_at_once(spark):
    import pyarrow as pa
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(T._parse_datatype_string(pages.PARSED))
    page = "<p>some text</p>" * 20_000
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(12)), "html": [page] * 10 + [None, "<p>x</p>"]}, schema=pa.schema([("doc_id", pa.int64()), ("html", pa.string())]))
    made = list(pages.parsed_batches(iter([batch]), arrow))
    assert len(made) == 3 and [d for b in made for d in b.column(0).to_pylist()] == list(range(12))
