import pytest

from leafmill.operators import labels, ocr
from leafmill.parse import Config, Parser, UnreadableSource, UnsupportedSource, kind_of_delivery

PAGE = "<html><body><h1>A heading</h1><p>Words of the first paragraph.</p><h1>Another</h1><p>And more words.</p></body></html>"


@pytest.mark.parametrize("wrong", [{"most": 0}, {"soft": -1}, {"optimal": "1500"}, {"most": True}, {"soft": 2000}, {"optimal": 4000}, {"table_representation": "html"}])
def test_wrong_configuration_raises(wrong):
    with pytest.raises(ValueError):
        Config(**wrong)


def test_sources_of_every_form(spark, tmp_path):
    p = Parser(spark, Config(soft=200))
    for source in (PAGE, PAGE.encode()):
        made = p.parse(source)
        assert [r.text for r in made["headings"].orderBy("ord").collect()] == ["A heading", "Another"]
        assert all(r.embed_char_count == len(r.text) for r in made["chunks"].collect())
    fetched = Parser(spark, fetch=lambda url: (PAGE.encode(), "text/html")).parse("https://a.example/file.pdf")
    assert fetched["headings"].count() == 2


def test_errors(spark, tmp_path):
    p = Parser(spark)
    with pytest.raises(FileNotFoundError):
        p.parse(str(tmp_path / "none.pdf"))
    with pytest.raises(UnsupportedSource):
        p.parse("http://a.example/x.html")
    old = tmp_path / "old.doc"
    old.write_bytes(b"\xd0\xcf\x11\xe0")
    with pytest.raises(UnsupportedSource):
        p.parse(str(old))
    with pytest.raises(UnsupportedSource):
        p.parse(b"PK\x03\x04 no archive")
    bad = tmp_path / "bad.pdf"
    bad.write_bytes(b"%PDF-1.7 nothing")
    with pytest.raises(UnreadableSource):
        p.parse(str(bad))
    assert [kind_of_delivery(*x) for x in ((b"%PDF-", ""), (b"PK\x03\x04", ""), (b"<html>", "text/html"), (b"x", "Application/PDF"))] == ["pdf", "zip", "html", "pdf"]


def test_colours_settle_on_frequent_ones():
    found = ocr.canonical_colors([("#404040", 50), ("#405050", 3), ("#ff0000", 9), ("#fe0101", 9), ("none", 1)], 24)
    assert found == {"#404040": "#404040", "#405050": "#404040", "#fe0101": "#fe0101", "#ff0000": "#fe0101", "none": "none"}


def test_labels_of_a_bound_book_alternate():
    assert labels.alternating(["left", "right"] * 4) and not labels.alternating(["left"] * 8) and not labels.alternating(["left", "right"])


def test_words_of_ocr_by_line(spark):
    rows = [(1, 1, 1, i, t, i == 1) for i, t in enumerate(["o", "costs®)", "(see", "below)", 'end")'], 1)]
    df = spark.createDataFrame(rows, "doc_id long, page_number long, line_id long, word_id long, text string, is_line_start boolean")
    got = {r.word_id: r.text for r in ocr.cleaned_words(df).collect()}
    assert got == {1: "•", 2: "costs", 3: "(see", 4: "below)", 5: "end"}
