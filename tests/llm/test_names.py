"""Extra columns whose names operators use themselves: nothing crashes, is lost, or shows what was taken out of a text."""

import pytest
from pyspark.sql import functions as F

from leafmill.llm import copies, decontam, langid, license, mixing, ogg, pii, simhash, toxicity, urlfilter, warc

NAMES = ("_text", "_merged", "_placed", "_new", "_chosen", "_swept", "_kept", "_at_email", "_c_secret", "_lm_runs", "_lm_words", "_lm_items", "_lm_u", "_lm_text", "_lm_key", "_lm_a", "_lm_b", "_lm_base", "_lm_lang", "_lm_score",
         "_lm_topic", "_lm_tokens", "_lm_chance", "_lm_vector", "_k0", "_s", "_l", "_u", "Score", "lang_pred", "action", "key", "hits", "media", "feature", "sid", "n", "first", "sketch", "fp", "words", "shard", "digest", "id")
HIDDEN = "write to jane@mail.example"
PASSAGE = "one two three four five six seven eight nine ten eleven"


@pytest.fixture
def rows(docs):
    return docs(["the first text of all the texts", HIDDEN, f"{PASSAGE} and a good many other words that follow after it in this text", None]).withColumns({n: F.lit(f"own {n}") for n in NAMES})


def passed(out, rows, tmp_path, but=()):
    """What was written holds the rows' own values under every name but those that the operator makes."""
    path = f"file://{tmp_path}/out"
    out.write.parquet(path)
    got = out.sparkSession.read.parquet(path).collect()
    assert got
    for r in got:
        for n in NAMES:
            if n.lower() not in but:
                assert r[n] == f"own {n}", n
    return got


def test_pii(rows, tmp_path):
    out = pii.redact(rows)
    assert out.columns == rows.columns
    for r in passed(out, rows, tmp_path):
        assert not any(isinstance(v, str) and "jane@" in v for v in r)
    spans = passed(pii.spans(rows), rows, tmp_path / "spans", ("_lm_base",))
    assert [len(r._lm_base) for r in sorted(spans, key=lambda r: r.doc_id)] == [0, 1, 0, 0]


def test_decontam(spark, rows, tmp_path):
    bench = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    out = decontam.clean(rows, bench, max_share=0.9)
    assert out.columns == rows.columns and not any("seven" in (r.text or "") for r in passed(out, rows, tmp_path))
    assert decontam.clean(rows, bench, max_share=0.9, max_bytes=1).count() == 4


def test_near_duplicates(rows, tmp_path):
    for k, f in enumerate((copies.keep_first, simhash.keep_first)):
        out = f(rows.union(rows))
        assert out.columns == rows.columns and len(passed(out, rows, tmp_path / str(k))) == 4


def test_language_and_toxicity(spark, rows, docs, tmp_path):
    model = langid.fit(docs(["the first text of all"] * 9, lang="en").union(docs(["ein erster text von vielen"] * 9, lang="de")))
    assert len(passed(langid.identify(rows, model), rows, tmp_path, ("score", "lang_pred"))) == 4
    assert langid.keep_identified(rows, model).columns == rows.columns
    labels = spark.createDataFrame([(0, 1)], "doc_id long, toxic int")
    assert len(passed(toxicity.score(rows, toxicity.fit(rows, labels)), rows, tmp_path / "t", ("score",))) == 4


def test_mixing(rows, tmp_path):
    out = mixing.mix(rows, mixing.Targets(budget=1.0))
    assert out.columns == rows.columns and len(passed(out, rows, tmp_path)) == 4
    assert len(passed(mixing.sample(rows), rows, tmp_path / "s", ("_lm_topic", "_lm_tokens", "_lm_chance"))) == 4


def test_media(rows, tmp_path):
    out = ogg.describe(ogg.store(rows, rows.columns), rows.columns)
    assert len(passed(out, rows, tmp_path, ("media", "feature"))) == 4


def test_urls_licences_and_archives(spark, rows, tmp_path):
    pages = rows.withColumns({"url": F.lit("http://a.org/x"), "page_id": F.col("doc_id"), "html": F.col("text")})
    assert len(passed(urlfilter.judge(pages, urlfilter.listed_table(spark)), rows, tmp_path)) == 4
    assert license.scan(rows).count() == 4
    folder = f"file://{tmp_path}/w"
    warc.write(pages, folder)
    assert warc.read(spark, folder).count() == 4
