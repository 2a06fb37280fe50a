"""From raw documents to a training mix: language, near-duplicates, benchmark passages, personal data, target weights.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread as the next stage's docs.
All stages return the columns of documents, with extra ones whatever their names; all but decontamination and personal data leave
texts as they are, and texts are worked on whole, however long. Defined results on odd input, of every stage: an empty table stays
empty. Stage by stage, for documents with a null or empty text, equal rows, and ties:
language drops what has no letter (null and empty texts too), and keeps equal rows; equally likely languages are one decision;
near_duplicates keeps one of equal rows, and of equal texts that with the smallest doc_id, a null one last;
decontamination leaves null and empty texts and keeps equal rows; a document of which half the words are benchmark stays, cut;
personal_data leaves null and empty texts and keeps equal rows; of equally likely spans that overlap the first, longest stays;
target_mix keeps texts without words, and equal rows (id and text) share their fate; null sources and languages are categories.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leafmill.llm import copies, decontam, langid, mixing, pii
from leafmill.llm.common import bounded_batches, materialize, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told stay."""
    bounded_batches(spark)
    return langid.keep_identified(docs, langid.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (similarity 0.8 of 5-word shingles; SimHash and covering, then what they miss) stays."""
    bounded_batches(spark)
    return copies.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that are mostly benchmark go."""
    bounded_batches(spark)
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind."""
    return pii.redact(docs)


def target_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample at the target weights of source, language and topic."""
    bounded_batches(spark)
    return mixing.mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("target_mix", target_mix),
]

#: Language models, fingerprints and boosted trees are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of documents, each written and reread."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
