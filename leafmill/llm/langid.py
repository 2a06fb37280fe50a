"""Language identification by words first, then by ever shorter character n-grams.

A word (a run of letters, lower-cased) that the model knows scores its log frequency in each language. An unknown word is walked
from its start: at each place the longest known n-gram (5 characters down to 1, with marks for the word's edges) scores its
discounted log frequency. A text's score is the sum over its words.

The model is fitted on a bounded sample of the labelled documents (MAX_TRAIN_DOCS, picked by a hash) and holds all their words and
n-grams that stand there LEAST_COUNT times or more, as hashes and numbers, so what is broadcast is bounded by the sample.

Defined results: a null, empty or letterless text is "und" with score 0; without any training document every text is "und"; ties
go to the language that sorts first; very long texts are scored whole; repeated rows each get their row; an empty table gives an
empty result; extra columns pass through identify(), whose two columns take the place of any so named, and keep_identified(),
whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.bytewords import U, mix, words
from leafmill.llm.common import columns_of, free_names, held_out, materialize, per_slice, settle, small_rows, text_slices

MAX_TRAIN_DOCS = 12_000
#: How often a word or n-gram must stand in the sample to be known; those that stand once are left to the shorter n-grams.
LEAST_COUNT = 2
ORDERS = (5, 4, 3, 2, 1)
#: Factor on an n-gram's frequency for each order that was tried and not known before it.
BACKOFF = 0.4
UNKNOWN = "und"
FLOOR = -14.0
_UNIT = 1 << 20
_Q = U(0x9FB21C651E98DF25)

#: a-z and all bytes beyond ASCII.
LETTERS = np.zeros(256, dtype=bool)
LETTERS[97:123] = LETTERS[128:] = True


def _lowered(strings: pa.Array) -> pa.Array:
    return pc.utf8_lower(strings)


def _word_counts(sample: DataFrame) -> DataFrame:
    """lang, word, n over the whole texts of sample; counts are summed in the worker before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_pylist()
            counts: Counter[tuple[str, str]] = Counter()
            for first, strings in text_slices(batch.column(1)):
                w = words(_lowered(strings), LETTERS)
                data, owner = w.low.tobytes(), w.owner().tolist()
                counts.update((langs[first + d], data[a:b]) for d, a, b in zip(owner, w.start.tolist(), w.end.tolist()))
            settle()
            if counts:
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts]), pa.array([k[1].decode(errors="replace") for k in counts]), pa.array(list(counts.values()), pa.int64())], names=["lang", "word", "n"])

    return sample.select("lang", "text").mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(U)


def gram_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each stretch of n characters."""
    total = np.zeros(max(0, len(codes) - n + 1), dtype=U)
    with np.errstate(over="ignore"):
        for k in range(n):
            total = total * _Q + codes[k : k + len(total)] + U(1)
        return mix(total + U(n))


class Listed:
    """Log frequencies by language of hashed keys."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, totals: list[float]) -> None:
        order = np.argsort(keys)
        self.keys = keys[order]
        self.scores = np.log((counts[order] + 0.1) / (np.maximum(np.array(totals, dtype=float), 1) + 0.1 * (len(keys) + 1)))

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are known, and their rows of scores."""
        if not len(self.keys):
            return np.zeros(len(hashes), dtype=bool), np.zeros(len(hashes), dtype=np.int64)
        spot = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return self.keys[spot] == hashes, spot


class Model:
    """What is known of words and of n-grams of each order."""

    def __init__(self, langs: list[str], prior: list[float], listed: Listed | None, grams: dict[int, Listed]) -> None:
        self.langs, self.words, self.grams = langs, listed, grams
        self.prior = np.log(np.maximum(np.array(prior, dtype=float), 0.5) / max(1.0, sum(prior))) if langs else np.zeros(0)

    def unseen(self, unknown: list[bytes]) -> np.ndarray:
        """Scores of unknown words: all are walked at once, a step for each n-gram."""
        codes = _codes(b"".join(b"^" + w + b"$" for w in unknown).decode())
        starts, ends = np.flatnonzero(codes == U(94)), np.flatnonzero(codes == U(36)) + 1
        room = np.repeat(ends, ends - starts) - np.arange(len(codes))
        step, score = np.zeros(len(codes), dtype=np.int64), np.full((len(codes), len(self.langs)), FLOOR)
        for tried, n in enumerate(ORDERS):
            at = np.flatnonzero((step == 0) & (room >= n))
            found, rows = self.grams[n].find(gram_hashes(codes, n)[at])
            at = at[found]
            step[at], score[at] = n, self.grams[n].scores[rows[found]] + tried * np.log(BACKOFF)
        step[step == 0] = 1
        total, place = np.zeros((len(unknown), len(self.langs))), starts.copy()
        live = np.arange(len(unknown))
        while len(live):
            total[live] += score[place[live]]
            place[live] += step[place[live]]
            live = live[place[live] < ends[live]]
        return total

    def score(self, strings: pa.Array) -> tuple[list[str], list[float]]:
        n = len(strings)
        if not self.langs or not n:
            return [UNKNOWN] * n, [0.0] * n
        lettered = pc.match_substring_regex(strings, r"\p{L}").to_pylist()
        w = words(_lowered(strings), LETTERS)
        keys, one, back = np.unique(w.hashes(), return_index=True, return_inverse=True)
        known, rows = self.words.find(keys)
        table = np.zeros((len(keys), len(self.langs)))
        table[known] = self.words.scores[rows[known]]
        if len(new := np.flatnonzero(~known)):
            table[new] = self.unseen([w.word(i) for i in one[new].tolist()])
        # Whole multiples of a small unit, so that sums are exact and equal texts score equally wherever they stand.
        total = np.zeros((len(back) + 1, len(self.langs)), dtype=np.int64)
        np.cumsum(np.rint(table * _UNIT).astype(np.int64)[back], axis=0, out=total[1:])
        sums = (total[w.first[1:]] - total[w.first[:-1]]) / _UNIT + self.prior
        # Words of a text are far from independent: the evidence counts as that of the square root of their number.
        calm = (sums - sums.max(axis=1, keepdims=True)) / np.sqrt(np.maximum(w.counts, 1))[:, None]
        share = np.exp(calm)
        share /= share.sum(axis=1, keepdims=True)
        best = sums.argmax(axis=1)
        return [self.langs[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), lettered)], [float(share[d, b]) if ok else 0.0 for d, (b, ok) in enumerate(zip(best.tolist(), lettered))]


def _counted(rows: DataFrame, key: str, langs: list[str], least: int) -> DataFrame:
    """key and counts (one for each language) of the keys that stand least times or more."""
    by = F.array(*[F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)) for x in langs])
    return rows.groupBy(key).agg(F.sum("n").alias("n"), by.alias("counts")).where(F.col("n") >= least).select(key, "counts")


def _gathered(counted: DataFrame, grams: bool, langs: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Hashes and counts by length (0 for words), packed on the executors; they are bounded by the sample that they come from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = batch.column(0), batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, langs)
            out = []
            if not grams:
                out.append((0, words(texts.cast(pa.large_string()), LETTERS).hashes(), counts))
            else:
                sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
                for n in np.unique(sizes).tolist():
                    on = np.flatnonzero(sizes == n)
                    codes = _codes("".join(texts.take(pa.array(on)).to_pylist()))
                    out.append((n, gram_hashes(codes, n)[::n] if len(codes) else np.zeros(0, U), counts[on]))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1].tobytes() for x in out], pa.binary()), pa.array([x[2].tobytes() for x in out], pa.binary())], names=["size", "keys", "counts"])

    with small_rows(counted.sparkSession):
        rows = counted.mapInArrow(run, "size long, keys binary, counts binary").collect()
    out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for size in (ORDERS if grams else (0,)):
        own = [r for r in rows if r["size"] == size]
        out[size] = (np.frombuffer(b"".join(r["keys"] for r in own), dtype=U), np.frombuffer(b"".join(r["counts"] for r in own), dtype=np.int64).reshape(-1, langs))
    return out


def fit(documents: DataFrame, max_docs: int = MAX_TRAIN_DOCS, least: int = LEAST_COUNT) -> Model:
    """Fit on at most about max_docs labelled documents outside the held-out fold; text and lang alone are learned from."""
    usable = documents.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    n = usable.count()
    if n > max_docs:
        usable = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < int((1 << 40) * max_docs / n))
    prior = {r[0]: float(r[1]) for r in usable.groupBy("lang").count().collect()}
    langs = sorted(prior)
    if not langs:
        return Model([], [], None, {})
    counts = materialize(_word_counts(usable))
    edged = F.concat(F.lit("^"), F.col("word"), F.lit("$"))
    size = F.length(edged)

    def of_size(n: int) -> Column:
        found = F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substring(edged, i, F.lit(n)))
        return F.when(size >= n, found).otherwise(F.array().cast("array<string>"))

    pieces = F.flatten(F.array(*[of_size(n) for n in ORDERS]))
    gram_counts = materialize(counts.select("lang", "n", F.explode(pieces).alias("gram")).groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    word_total = {r[0]: float(r[1]) for r in counts.groupBy("lang").agg(F.sum("n")).collect()}
    gram_total: dict[int, list[float]] = {n: [0.0] * len(langs) for n in ORDERS}
    for lang, size_of, total in gram_counts.groupBy("lang", F.length("gram")).agg(F.sum("n")).collect():
        gram_total[size_of][langs.index(lang)] = float(total)
    listed = _gathered(_counted(counts, "word", langs, least), False, len(langs))[0]
    grams = _gathered(_counted(gram_counts, "gram", langs, least), True, len(langs))
    return Model(langs, [prior[x] for x in langs], Listed(*listed, [word_total.get(x, 0.0) for x in langs]), {n: Listed(*grams[n], gram_total[n]) for n in ORDERS})


def identify(documents: DataFrame, model: Model, keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns keep (all by default) with the predicted language and its score under the given names."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def work(strings: pa.Array) -> list[pa.Array]:
        langs, scores = shared.value.score(strings)
        return [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]

    made = {n.lower() for n in names}
    kept = [c for c in (documents.columns if keep is None else keep) if c.lower() not in made]
    return per_slice(documents, "text", kept, f"`{names[0]}` string, `{names[1]}` double", work)


def keep_identified(documents: DataFrame, model: Model, least_score: float = 0.35) -> DataFrame:
    """documents without those whose language cannot be told: no letter at all, or a best language under least_score."""
    lang, score = free_names(documents.columns, "_lm_lang", "_lm_score")
    got = identify(documents, model, names=(lang, score))
    return got.where((F.col(lang) != UNKNOWN) & (F.col(score) >= least_score)).select(*columns_of(documents))
