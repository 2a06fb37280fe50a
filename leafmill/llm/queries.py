"""The queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import decontam, langid, license, mixing, ogg, pii, simhash, toxicity, urlfilter, warc
from leafmill.llm.common import bounded_batches, held_out, shared_dir, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    documents = table(spark, sf_dir, "documents")
    model = toxicity.fit(documents, table(spark, sf_dir, "labels"))
    scored = toxicity.score(documents, model, ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    folder = f"{shared_dir(spark)}/warc"
    warc.write(table(spark, sf_dir, "pages"), folder)
    return warc.read(spark, folder).drop("url")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    documents = table(spark, sf_dir, "documents")
    found = langid.identify(documents, langid.fit(documents), ["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op5_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return ogg.describe(ogg.store(table(spark, sf_dir, "documents"), ["doc_id"]), ["doc_id"])


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    mixed = mixing.sample(table(spark, sf_dir, "documents"), keep=["doc_id", "source", "lang"])
    return mixed.select("doc_id", "source", "lang", *[F.col(f"_lm_{c}").alias(c) for c in ("topic", "tokens", "weight", "chance", "sampled")])


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return decontam.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


def op8_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(table(spark, sf_dir, "documents"))


def op9_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), urlfilter.listed_table(spark)).drop("url")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return simhash.components(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_warc,
        op3_language,
        op4_pii,
        op5_ogg,
        op6_mixing,
        op7_decontamination,
        op8_license,
        op9_urlfilter,
        op10_simhash,
    )
}

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES: dict[str, str] = {
    "op2_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
last AS (SELECT h, max(page_id) AS k FROM p WHERE octet_length(encode(h)) >= 1000 GROUP BY h)
SELECT page_id, CAST(octet_length(encode(p.h)) AS BIGINT) AS payload_bytes, sha1(p.h) AS payload_digest,
       CASE WHEN k IS NOT NULL AND k <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN k <> page_id THEN k END AS refers_to
FROM p LEFT JOIN last ON p.h = last.h""",
    "op7_decontamination": f"""
WITH item AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
sized AS (SELECT item, w, least(10, len(w)) AS m FROM item WHERE len(w) > 0),
wins AS (SELECT DISTINCT item, m, array_to_string(w[i:i + m - 1], ' ') AS win FROM (SELECT item, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM sized)),
doc AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
spot AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM doc WHERE len(w) > 0),
firsts AS (SELECT DISTINCT m, split_part(win, ' ', 1) AS f FROM wins),
cand AS (SELECT r, i, m, array_to_string(w[i:i + m - 1], ' ') AS win FROM spot JOIN firsts ON w[i] = f WHERE i + m - 1 <= len(w)),
hit AS (SELECT r, i, c.m, item FROM cand c JOIN wins USING (m, win)),
hits AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest(range(i, i + m)) AS k FROM (SELECT DISTINCT r, i, m FROM hit)) GROUP BY r),
items AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM doc LEFT JOIN hits h USING (r) LEFT JOIN items i USING (r)""",
    "op9_urlfilter": f"""
WITH parts AS (SELECT row_number() OVER () AS r, page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
page AS (SELECT r, page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*', 0)) + 1), '^[^?#]*', 0) AS path FROM parts),
listed(host, path, action, is_rule) AS (VALUES {", ".join(f"('{k.split('/', 1)[0]}', '/{k.split('/', 1)[1]}', '{a}', true)" for a, k in urlfilter.RULES)},
  {", ".join(f"('{x}.{d}', '/', 'block', false)" for x in urlfilter.SITES for d in urlfilter.DOMAINS)}),
fits AS (SELECT r, l.host || l.path AS rule, action, is_rule, row_number() OVER (PARTITION BY r ORDER BY is_rule DESC, length(l.host || l.path) DESC) AS k
         FROM page p JOIN listed l ON (p.host = l.host OR ends_with(p.host, '.' || l.host)) AND starts_with(p.path, l.path))
SELECT page_id, host, path, CASE WHEN is_rule THEN rule END AS rule, coalesce(action, 'allow') AS verdict FROM page LEFT JOIN (SELECT * FROM fits WHERE k = 1) USING (r)""",
}
