import math
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafmill.functions import color
from leafmill.functions import text as tx


def over(spark, values, *columns, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i long, v {kind}")
    return [tuple(r)[1:] for r in df.select("i", *[c.alias(f"c{k}") for k, c in enumerate(columns)]).orderBy("i").collect()]


def one(spark, values, column, kind="string"):
    return [r[0] for r in over(spark, values, column, kind=kind)]




def test_features(spark):
    got = over(spark, ["Hello World 12", "", None, "É a_b ß9"], *tx.features("v").values())
    assert got == [(14, 10, 2, 2, 3, 2, 2), (0,) * 7, (0,) * 7, (8, 4, 1, 0, 3, 3, 1)]


def test_bullets(spark):
    values = ["•", " o ", "October", "- x", "• item", "", None, "✓done", "+2y"]
    assert over(spark, values, tx.is_bullet_token("v"), tx.is_bullet_line("v"), tx.is_strict_bullet("v")) == [(True, True, True), (True, True, False), (False, False, False), (False, True, False), (False, True, True), (False, False, False), (False, False, False), (False, True, True), (False, True, False)]


def test_list_markers(spark):
    yes = ["1.", "1.1.", "2.3.1", "4.3(a)(i)", "(a)", "(iv)", "(28)", "1)", "a)", "iv)", "[1]", "iv.", "viii", "XIV.", "A.", "•"]
    no = ["mild", "did", "word", "", "(abcde)", "123)", "1 x", ")", "."]
    assert one(spark, yes + no, tx.is_list_marker("v")) == [True] * len(yes) + [False] * len(no)


def test_numbers(spark):
    yes = ["123", "1,234.5", "$5", "12%", "(123)", "57 (42, 72)", "10.3 - 11.2", "-", "—", "NA", "n/a", "N.A.", "$", "%", "*", "— %", "$ –", "N/A%", "1999"]
    no = ["2024", "(2025)", "", "5 mg", "FY2025", "a", "$%"]
    assert one(spark, yes + no, tx.is_numeric_value("v")) == [True] * len(yes) + [False] * len(no)
    lines = ["1,633 1,584 1,258", "2023 2024 2025", "£185k", "1.2bn (259)m", "12 apples", "", "5 km"]
    assert one(spark, lines, tx.is_numeric_line("v")) == [True] * 4 + [False] * 3


@settings(max_examples=30, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="0123456789.,()% $-abk\n", max_size=14), min_size=1, max_size=8))
def test_numeric_value_equals_a_plain_reading(spark, values):
    def plain(s):
        t = s.strip()
        if t in ("-", "%", "*", "$"):
            return True
        if re.fullmatch(r"[(\[]?\s*20[0-4]\d\s*[)\]]?", t):
            return False
        return bool(t) and (any(c.isdigit() for c in t.partition("\n")[0]) and all(c in "0123456789.,()% $-\n" for c in t)) or bool(re.fullmatch(r"(?:[$%]\s*)?-\s*[$%]?", t))

    assert one(spark, values, tx.is_numeric_value("v")) == [plain(v) for v in values]


def test_markup(spark):
    df = spark.createDataFrame([("1", "superscript", False), ("th", "superscript", False), ("2", "subscript", True), ("x", None, True), (" ", "superscript", True)], "t string, s string, k boolean")
    assert [r[0] for r in df.select(tx.inline_markup("t", F.col("s"), F.col("k"))).collect()] == ["[^1]", "th", "[_~~2~~]", "~~x~~", " "]


def test_fonts(spark):
    assert one(spark, ["Helvetica-Oblique", "ABCDEE+Calibri-Bold", "TimesNewRomanPSMT", "Arial", ""], tx.font_family("v")) == ["Helvetica", "Calibri", "TimesNewRoman", "Arial", ""]
    assert over(spark, ["CMBX10", "CMTI10", "Hiragino W6", "Arial-BoldItalic"], tx.is_bold_font("v"), tx.is_italic_font("v")) == [(True, False), (False, True), (True, False), (True, True)]


def test_numerals(spark):
    assert one(spark, ["iv", "XIV", "MCMXC", "abc", ""], tx.roman_value("v")) == [4, 14, 1990, None, None]
    assert one(spark, [1, 4, 1990, 3999, 0, 4000], tx.roman_text(F.col("v")), kind="int") == ["I", "IV", "MCMXC", "MMMCMXCIX", None, None]
    assert one(spark, [1, 26, 27, 53, 0], tx.alpha_text(F.col("v")), kind="int") == ["a", "z", "aa", "aaa", None]
    assert over(spark, ["12", "iv", "F-3", "S-iv", "II-3", "A-1-86", "347/1", "hello", "1234567890"], tx.page_label_type("v"), tx.label_value("v", tx.page_label_type("v")), tx.label_prefix("v", tx.page_label_type("v"))) == [("arabic", 12, None), ("roman", 4, None), ("alpha_numeric", 3, "F"), ("alpha_roman", 4, "S"), ("roman_numeric", 3, "II"), ("alpha_numeric_sub", 86, "A"), ("arabic_sub", 347, None), (None, None, None), (None, None, None)]


def test_strings_of_metadata(spark):
    assert one(spark, ["D:20240131120000+02'00'", "D:2024", "20240131Z", "x"], tx.pdf_date("v")) == ["2024-01-31T12:00:00+02:00", "2024-01-01T00:00:00", "2024-01-31T00:00:00+00:00", None]
    assert one(spark, ["Hello, World!", "--a--", "É"], tx.slug("v")) == ["hello-world", "a", ""]
    assert one(spark, ["en-US", "DE", "english", ""], tx.normalized_language("v")) == ["en", "de", None, None]
    assert one(spark, [900, 2149, 48200, 9999], tx.human_tokens(F.col("v")), kind="long") == ["900", "2.1k", "48k", "10.0k"]
    assert one(spark, ["Risk factors. The Group, is", "no delimiter", "a: b. c"], tx.hybrid_heading("v")) == ["Risk factors.", None, "a: b."]
    assert one(spark, ["John Smith", "the John", "Anna de la Cruz", "JOHN", ""], tx.is_title_case("v")) == [True, True, True, True, False]
    assert one(spark, ["#a", "/a", "", None, " "], tx.link_type("v")) == ["internal", "external", None, None, None]
    assert one(spark, ["The Straße of it’s 12"], tx.search_terms("v")) == [["strasse", "it’s", "12"]]
    df = spark.createDataFrame([(595.0, 842.0), (792.0, 612.0), (960.0, 540.0), (100.0, 700.0)], "w double, h double")
    assert [r[0] for r in df.select(tx.page_format(F.col("w"), F.col("h"))).collect()] == ["A4", "Letter", "16:9", "Custom"]
    a = spark.range(1).select(tx.document_handle(source=F.lit("x"), size=F.lit(1)), tx.document_handle(size=F.lit(1), source=F.lit("x"))).first()
    assert a[0] == a[1] and re.fullmatch("[0-9a-f]{8}", a[0])


# Pairs and distances from the published test data of the formula.
PAIRS = [((50.0, 2.6772, -79.7751), (50.0, 0.0, -82.7485), 2.0425), ((50.0, 3.1571, -77.2803), (50.0, 0.0, -82.7485), 2.8615), ((50.0, -1.3802, -84.2814), (50.0, 0.0, -82.7485), 1.0), ((50.0, 2.5, 0.0), (73.0, 25.0, -18.0), 27.1492), ((60.2574, -34.0099, 36.2677), (60.4626, -34.1751, 39.4387), 1.2644), ((2.0776, 0.0795, -1.135), (0.9033, -0.0636, -0.5514), 0.9082)]


@pytest.mark.parametrize("p,q,want", PAIRS)
def test_color_distance(spark, p, q, want):
    lab = lambda v: F.struct(*[F.lit(x).alias(n) for x, n in zip(v, "lab")])
    assert math.isclose(spark.range(1).select(color.distance(lab(p), lab(q))).first()[0], want, abs_tol=1e-4)


def test_colors(spark):
    df = spark.createDataFrame([([0.0],), ([1.0, 0.0, 0.0],), ([0.0, 1.0, 1.0, 0.0],), ([],)], "v array<double>")
    assert [r[0] for r in df.select(color.to_hex(F.col("v"))).collect()] == ["#000000", "#ff0000", "#ff0000", None]
    lab = spark.createDataFrame([("#ffffff",)], "v string").select(color.to_lab(F.col("v")).alias("l")).first().l
    assert abs(lab.l - 100) < 0.01 and abs(lab.a) < 0.02 and abs(lab.b) < 0.02


def test_whole_lines_of_ordinals_are_marked(spark):
    df = spark.createDataFrame([("Th", "superscript"), ("x", "superscript"), ("st", "subscript")], "t string, s string")
    assert [r[0] for r in df.select(tx.inline_markup("t", F.col("s"), F.lit(False), plain=())).collect()] == ["[^Th]", "[^x]", "[_st]"]


def test_inline_marks_of_an_ordinal_line(spark, tmp_path):
    import __spark_entry__ as entry

    spark.createDataFrame([(1, "Th\na\nb\nRD")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = entry.queries()["inline_marks"](spark, str(tmp_path)).orderBy("ord").collect()
    assert [r.shown for r in got] == ["[^Th]", "[_a]", "b", "[^RD]"]
