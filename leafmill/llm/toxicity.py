"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities of a lexicon and of its weights, hits near a second-person pronoun, hits after undoing obfuscation
(digits and signs for letters), shares of capitals, of exclamation and question marks, of signs and of repeated letters, and
size. The lexicon is learned: words that mark toxic documents among the labelled ones that may be learned from. Labels, language,
source and doc_id are no inputs.

Fitted on at most about MAX_TRAIN_DOCS labelled documents, picked by a hash; a document of several rows is learned from once. The
trees see features by a lexicon of the other half of these documents; a quarter is kept for calibration. A lexicon holds all words
whose log-odds pass LEAST_Z deviations and LEAST_ODDS.

Defined results: null and empty texts are scored on zero features; without labels of both classes every score is the observed
share (0 without labels); several labels of one document count as toxic if any does; null labels are not learned from; very long
texts are scored whole; repeated rows each get their row, and equal texts (ties) equal scores; an empty table gives an empty
result; extra columns pass through score() if kept, whatever their names, but that score takes the place of one so named.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm import boost
from leafmill.llm.bytewords import ALNUM, LOWER, Words, raw, words
from leafmill.llm.common import bounded_batches, held_out, per_slice, settle, text_slices

MAX_TRAIN_DOCS = 24_000
#: What sets a word of the lexicon apart: log-odds over their deviation, log-odds, and toxic documents that hold it.
LEAST_Z, LEAST_ODDS, LEAST_DOCS = 3.0, 2.0, 3
#: Words to each side in which a second-person pronoun counts as near.
REACH = 3
#: Second-person pronouns of the languages at hand (fixed values).
PRONOUNS = ("you", "your", "youre", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tu", "te", "toi", "ton", "ta", "vous", "votre", "usted", "ustedes", "ti", "tus")
#: Signs and digits that stand for letters.
LEET = LOWER.copy()
for _sign, _letter in zip(b"0134578@$!", b"oieastbasi"):
    LEET[_sign] = _letter
#: Bytes of words that may be obfuscated.
MASKED = ALNUM.copy()
MASKED[[ord(c) for c in "@$!*"]] = True
FEATURES = 14


def _keys(listed: list[str]) -> np.ndarray:
    return words(pa.array(listed, pa.large_string()), ALNUM).hashes() if listed else np.zeros(0, np.uint64)


@dataclass
class Lexicon:
    words: list[str]
    weights: list[float]

    def __post_init__(self) -> None:
        keys = _keys(self.words)
        order = np.argsort(keys)
        # Whole multiples of a small unit, so that sums are exact and equal texts score equally wherever they stand.
        self.keys, self.weight = keys[order], np.rint(np.array(self.weights, dtype=float)[order] * 1024) / 1024
        self.pronouns = np.sort(_keys(list(PRONOUNS)))

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """Each word's weight, or 0."""
        if not len(self.keys):
            return np.zeros(len(hashes))
        spot = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[spot] == hashes, self.weight[spot], 0.0)


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    run = np.concatenate(([0.0], np.cumsum(values, dtype=float)))
    return run[bounds[1:]] - run[bounds[:-1]]


def features(strings: pa.Array, lexicon: Lexicon) -> np.ndarray:
    data, bounds = raw(strings)
    w = words(strings, ALNUM)
    hashes = w.hashes()
    weight = lexicon.of(hashes)
    hit = weight > 0
    second = np.isin(hashes, lexicon.pronouns)
    owner = w.owner()
    near = np.zeros(len(hashes), dtype=bool)
    for k in range(1, REACH + 1):
        if len(hashes) > k:
            same = owner[k:] == owner[:-k]
            near[k:] |= second[:-k] & same
            near[:-k] |= second[k:] & same
    size, n = np.maximum(np.diff(bounds), 1), np.maximum(w.counts, 1)
    upper = (data >= 65) & (data <= 90)
    letter = upper | ((data >= 97) & (data <= 122)) | (data >= 128)
    sign = (data > 32) & (data < 128) & ~letter & ~((data >= 48) & (data <= 57))
    twice = np.zeros(len(data), dtype=bool)
    if len(data) > 2:
        twice[2:] = (data[2:] == data[1:-1]) & (data[2:] == data[:-2]) & letter[2:]
    # Words once more, with signs and digits read as letters.
    masked = Words(w.low, bounds, *_spans(w.low, bounds))
    solid = (masked.end - masked.start) > 2
    veiled = Words(LEET[w.low], bounds, masked.start, masked.end, masked.first)
    hidden = lexicon.of(veiled.hashes())
    hidden[~solid | (lexicon.of(masked.hashes()) > 0)] = 0
    digits = _sums((w.low >= 48) & (w.low <= 57), bounds)
    columns = [
        np.log1p(w.counts),
        _sums(hit, w.first) / n,
        _sums(weight, w.first) / n,
        np.log1p(_sums(hit, w.first)),
        np.log1p(_sums(weight, w.first)),
        _sums(hit & near, w.first) / n,
        _sums(second, w.first) / n,
        np.log1p(_sums(hidden, masked.first)),
        _sums(upper, bounds) / np.maximum(_sums(letter, bounds), 1),
        _sums((data == 33) | (data == 63), bounds) / size,
        _sums(sign, bounds) / size,
        digits / size,
        _sums(twice, bounds) / size,
        _sums(letter, bounds) / n,
    ]
    return np.stack(columns, axis=1)


def _spans(low: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = np.concatenate(([False], MASKED[low], [False]))
    cut = np.zeros(len(low) + 1, dtype=bool)
    cut[bounds] = True
    start = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
    return start, np.flatnonzero(inside[:-1] & (~inside[1:] | cut)), np.searchsorted(start, bounds)


@dataclass
class Model:
    lexicon: Lexicon
    trees: boost.Boosted

    def score(self, strings: pa.Array) -> np.ndarray:
        return np.clip(self.trees.predict(features(strings, self.lexicon)), 0.0, 1.0)


def _document_counts(sample: DataFrame) -> DataFrame:
    """word and n_HALF_TOXIC: in how many documents of each half and label of sample each word stands; counts are summed in the worker before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            counts: Counter[tuple[bytes, tuple[int, int]]] = Counter()
            for first, strings in text_slices(batch.column(2)):
                w = words(strings, ALNUM)
                data, owner = w.low.tobytes(), w.owner().tolist()
                seen = {(d, data[a:b]) for d, a, b in zip(owner, w.start.tolist(), w.end.tolist())}
                counts.update((word, kind[first + d]) for d, word in seen)
            settle()
            if counts:
                columns = [pa.array([k[0].decode() for k in counts]), *[pa.array([k[1][i] for k in counts], pa.int32()) for i in (0, 1)], pa.array(list(counts.values()), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["word", "half", "toxic", "n"])

    n = lambda h, k: F.sum(F.when((F.col("half") == h) & (F.col("toxic") == k), F.col("n")).otherwise(0)).alias(f"n_{h}_{k}")
    return sample.select("half", "toxic", "text").mapInArrow(run, "word string, half int, toxic int, n long").groupBy("word").agg(*[n(h, k) for h in (0, 1) for k in (0, 1)])


def _learn_lexicons(counts: DataFrame, sizes: dict[tuple[int, int], int], wanted: list[tuple[int, ...]], least_z: float) -> list[Lexicon]:
    """For each of the wanted halves, words whose share among their toxic documents exceeds that among the others by far, by the log-odds over their deviation. All come from one pass; only words of a lexicon reach the driver."""
    columns = {}
    for i, halves in enumerate(wanted):
        bad, good = (sum(sizes.get((h, k), 0) for h in halves) for k in (1, 0))
        if not bad or not good:
            continue
        b, g = (reduce(Column.__add__, [F.col(f"n_{h}_{k}") for h in halves]) for k in (1, 0))
        odds = F.log((b + 0.5) / (bad - b + 0.5)) - F.log((g + 0.5) / (good - g + 0.5))
        spread = F.sqrt(1 / (b + 0.5) + 1 / (g + 0.5))
        columns[i] = F.when((b >= LEAST_DOCS) & (odds / spread > least_z) & (odds > LEAST_ODDS), odds).alias(f"w{i}")
    if not columns:
        return [Lexicon([], []) for _ in wanted]
    top = counts.select("word", *columns.values()).where(F.coalesce(*[F.col(f"w{i}") for i in columns]).isNotNull())
    rows = sorted(top.collect(), key=lambda r: r.word)
    held = [[r for r in rows if i in columns and r[f"w{i}"] is not None] for i in range(len(wanted))]
    return [Lexicon([r.word for r in own], [float(r[f"w{i}"]) for r in own]) for i, own in enumerate(held)]


def _crossed_features(strings: pa.Array, half: np.ndarray, lexicons: list[Lexicon]) -> np.ndarray:
    """Each text's features by the lexicon of its half."""
    out = np.zeros((len(strings), FEATURES))
    for h, lexicon in enumerate(lexicons):
        own = np.flatnonzero(half == h)
        if len(own):
            out[own] = features(strings.take(pa.array(own)), lexicon)
    return out


def fit(documents: DataFrame, labels: DataFrame, max_docs: int = MAX_TRAIN_DOCS, least_z: float = LEAST_Z) -> Model:
    """Nothing is staged: what is picked and learned is small by its bound, and a written file costs an executor more than it holds."""
    spark = documents.sparkSession
    bounded_batches(spark)
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).cast("int").alias("toxic"))
    order = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    n = usable.count()
    if n > max_docs:
        usable = usable.where(order < int((1 << 40) * max_docs / n))
    # About max_docs rows of 16 bytes: small by its bound, and so the whole texts are not shuffled.
    draw = lambda name, k: F.pmod(F.xxhash64("doc_id", F.lit(name)), F.lit(k)).cast("int")
    picked = usable.select("doc_id", "toxic", draw("half", 2).alias("half"), draw("part", 4).alias("part"))
    picked = F.broadcast(spark.createDataFrame(picked.toArrow(), picked.schema))
    train = documents.select("doc_id", "text").join(picked, "doc_id").select("doc_id", "toxic", "half", "part", "text")
    sizes = {(r[0], r[1]): r[2] for r in train.groupBy("half", "toxic").count().collect()}
    # Each half's features come from the other half's lexicon, as those of unseen documents come from words learned elsewhere.
    *others, whole = _learn_lexicons(_document_counts(train), sizes, [(1,), (0,), (0, 1)], least_z)
    crossed = spark.sparkContext.broadcast(others)
    work = lambda s, half: [pa.array(list(_crossed_features(s, half.to_numpy(zero_copy_only=False), crossed.value)), pa.list_(pa.float64()))]
    made = per_slice(train, "text", ["doc_id", "toxic", "part", "half"], "x array<double>", work, beside="half")
    # One row for each document of the sample, however often it is repeated.
    rows = made.groupBy("doc_id", "toxic", "part").agg(F.min("x").alias("x")).collect()
    rows.sort(key=lambda r: (r.doc_id, r.x))
    x = np.array([r.x for r in rows], dtype=float).reshape(len(rows), FEATURES)
    y, cal = np.array([r.toxic for r in rows], dtype=float), np.array([r.part == 0 for r in rows], dtype=bool)
    return Model(whole, boost.fit(x[~cal], y[~cal], x[cal], y[cal]))


def score(documents: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The columns keep (all by default) with score, the chance of label 1."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in (documents.columns if keep is None else keep) if c.lower() != "score"]
    return per_slice(documents, "text", kept, "score double", lambda s: [pa.array(shared.value.score(s), pa.float64())])
