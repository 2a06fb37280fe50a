"""Benchmark decontamination: a broadcast set of hashed benchmark windows, scanned over the word windows of every text.

A window is 10 consecutive words of a benchmark item; an item of fewer words, but not none, is one window. Hashed windows of a
text that are in the set are verified word by word. The windows themselves are broadcast only while the benchmark's text stays
under MAX_BROADCAST_BYTES. Of a larger benchmark only a bit filter of bounded size is broadcast: one pass over the texts keeps
the windows that it lets through, with their words, and a join with the benchmark's windows on the words verifies them.

Defined results: a null or empty text has no words and no hits; a null item text has no windows; the windows of an item with a
null id count as hits and for n_items under the id "null"; repeated documents each get their row; repeated items with one id
count once, and windows that several items hold (ties) count for each; very long texts are scanned whole; an empty benchmark hits
nothing and an empty table gives an empty result. Extra columns pass through clean() and are ignored by scan(), whatever their names.
"""

from __future__ import annotations


from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from leafmill.llm.bytewords import ALNUM, U, Words, mix, words
from leafmill.llm.common import bit_filter, materialize, per_slice

WINDOW = 10
#: Bytes of benchmark text in one broadcast set.
MAX_BROADCAST_BYTES = 4 << 20
_Q = 0xD6E8FEB86659FD93
_BITS = 20


def window_hashes(w: Words, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of size words that lie in one text, and the index of each window's first word."""
    if len(hashes) < size:
        return np.zeros(0, U), np.zeros(0, np.int64)
    n = len(hashes) - size + 1
    with np.errstate(over="ignore"):
        total = np.zeros(n, dtype=U)
        for k in range(size):
            total *= U(_Q)
            total += hashes[k : k + n]
    last = np.repeat(w.first[1:], w.counts)[:n]
    whole = np.flatnonzero(np.arange(n) + size <= last)
    return mix(total[whole]), whole


class WindowSet:
    """Benchmark windows by length: hashes for the scan, texts for the verification."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW) -> None:
        self.owners: dict[int, dict[bytes, set[str]]] = {}
        for item, text in items:
            got = words(pa.array([text], pa.large_string()), ALNUM)
            parts = [got.word(i) for i in range(len(got.start))]
            size = min(window, len(parts))
            for i in range(len(parts) - size + 1 if size else 0):
                self.owners.setdefault(size, {}).setdefault(b" ".join(parts[i : i + size]), set()).add(item)
        self.sets: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size, texts in self.owners.items():
            listed = words(pa.array([t.decode() for t in texts], pa.large_string()), ALNUM)
            hashed = np.unique(window_hashes(listed, listed.hashes(), size)[0])
            coarse = np.zeros(1 << _BITS, dtype=bool)
            coarse[(hashed >> U(64 - _BITS)).astype(np.int64)] = True
            self.sets[size] = (coarse, hashed)

    def hits(self, w: Words) -> tuple[np.ndarray, list[set[str]]]:
        """For each word if it is in an occurrence of a window; for each text the items whose windows occur."""
        edge = np.zeros(len(w.start) + 1, dtype=np.int64)
        items: list[set[str]] = [set() for _ in range(len(w.first) - 1)]
        if not self.sets or not len(w.start):
            return edge[:-1] > 0, items
        hashes = w.hashes()
        for size, (coarse, hashed) in self.sets.items():
            found, at = window_hashes(w, hashes, size)
            near = np.flatnonzero(coarse[(found >> U(64 - _BITS)).astype(np.int64)])
            found, at = found[near], at[near]
            spot = np.minimum(np.searchsorted(hashed, found), len(hashed) - 1)
            at = at[hashed[spot] == found]
            texts = np.searchsorted(w.first, at, side="right") - 1
            known = self.owners[size]
            for i, d in zip(at.tolist(), texts.tolist()):
                if (who := known.get(b" ".join(w.word(k) for k in range(i, i + size)))) is not None:
                    edge[i] += 1
                    edge[i + size] -= 1
                    items[d] |= who
        return np.cumsum(edge[:-1]) > 0, items


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.coalesce("text", F.lit("")).alias("text"))


def _runs(w: Words, hit: np.ndarray, d: int) -> list[tuple[int, int]]:
    """Byte spans of text d, from its start, that runs of hit words cover."""
    a, b = w.first[d], w.first[d + 1]
    flags = np.concatenate(([False], hit[a:b], [False]))
    on, off = np.flatnonzero(flags[1:] & ~flags[:-1]), np.flatnonzero(flags[:-1] & ~flags[1:])
    return [(int(w.start[a + i] - w.bounds[d]), int(w.end[a + j - 1] - w.bounds[d])) for i, j in zip(on, off)]


def _per_text(w: Words, hit: np.ndarray) -> np.ndarray:
    run = np.concatenate(([0], np.cumsum(hit)))
    return run[w.first[1:]] - run[w.first[:-1]]


def _word_runs(w: Words, hit: np.ndarray, d: int) -> list[int]:
    """First and last + 1 word of each run of hit words of text d, one after the other."""
    flags = np.concatenate(([False], hit[w.first[d] : w.first[d + 1]], [False]))
    return np.flatnonzero(flags[1:] != flags[:-1]).tolist()


_MADE = "_lm_words long, _lm_runs array<long>, _lm_items array<string>"


def _found(documents: DataFrame, benchmark: DataFrame, keep: list[str], window: int, max_bytes: int, cut: bool = False) -> DataFrame:
    """The columns keep with _lm_words (number of words), _lm_runs (runs of hit words) and _lm_items (sorted ids) of every document; if cut, also _lm_new, the text without the runs (null where there are none)."""
    items = _items(benchmark)
    if (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > max_bytes:
        found = _joined(documents, items, keep, window)
        return _with_cuts(found) if cut else found
    # At most max_bytes of text come to the driver.
    shared = documents.sparkSession.sparkContext.broadcast(WindowSet([tuple(r) for r in items.distinct().collect()], window))

    def work(strings: pa.Array) -> list[pa.Array]:
        w = words(strings, ALNUM)
        hit, found = shared.value.hits(w)
        runs = [_word_runs(w, hit, d) if found[d] else [] for d in range(len(strings))]
        out = [pa.array(w.counts, pa.int64()), pa.array(runs, pa.list_(pa.int64())), pa.array([sorted(x) for x in found], pa.list_(pa.string()))]
        return [*out, pa.array([cut_runs(strings[d].as_py(), w, hit, d) if runs[d] else None for d in range(len(strings))], pa.string())] if cut else out

    return per_slice(documents, "text", keep, _MADE + ", _lm_new string" * cut, work)


def _windows(w: Words, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first word and text number of each window of size words."""
    found, at = window_hashes(w, hashes, size)
    return found, at, np.searchsorted(w.first, at, side="right") - 1


def benchmark_windows(items: DataFrame, window: int) -> DataFrame:
    """h, size, win (the words) and item of every window, once each."""

    def work(strings: pa.Array) -> list[pa.Array]:
        w = words(strings, ALNUM)
        hashes, out = w.hashes(), [[] for _ in range(len(strings))]
        sizes = np.minimum(w.counts, window)
        for size in np.unique(sizes[sizes > 0]).tolist():
            for h, i, d in zip(*(x.tolist() for x in _windows(w, hashes, size))):
                if sizes[d] == size:
                    out[d].append({"h": int(np.uint64(h).astype(np.int64)), "size": size, "win": b" ".join(w.word(k) for k in range(i, i + size)).decode()})
        return [pa.array(out, pa.list_(pa.struct([("h", pa.int64()), ("size", pa.int64()), ("win", pa.string())])))]

    return per_slice(items, "text", ["item"], "windows array<struct<h:long,size:long,win:string>>", work).select("item", F.inline("windows")).distinct()


def _joined(documents: DataFrame, items: DataFrame, keep: list[str], window: int) -> DataFrame:
    """The same for a benchmark of any size."""
    listed = materialize(benchmark_windows(items, window))
    sizes = sorted(r[0] for r in listed.select("size").distinct().collect())  # as many as a window has words at most
    shared = documents.sparkSession.sparkContext.broadcast(bit_filter(listed, "h"))

    def candidates(strings: pa.Array) -> list[pa.Array]:
        w = words(strings, ALNUM)
        hashes, out = w.hashes(), [[] for _ in range(len(strings))]
        for size in sizes:
            found, at, own = _windows(w, hashes, size)
            on = shared.value.may_hold(found)
            for i, d in zip(at[on].tolist(), own[on].tolist()):
                out[d].append({"at": i - int(w.first[d]), "size": size, "win": b" ".join(w.word(k) for k in range(i, i + size)).decode()})
        return [pa.array(out, pa.list_(pa.struct([("at", pa.int64()), ("size", pa.int64()), ("win", pa.string())])))]

    def counts(strings: pa.Array) -> list[pa.Array]:
        return [pa.array(words(strings, ALNUM).counts, pa.int64())]

    # Equal texts have equal hits, so that hits are kept by two hashes of the text and its length.
    named = documents.withColumns({"_lm_a": F.xxhash64("text"), "_lm_b": F.xxhash64("text", F.lit("b")), "_lm_n": F.length("text")})
    key = ["_lm_a", "_lm_b", "_lm_n"]
    passed = per_slice(named, "text", key, "cand array<struct<at:long,size:long,win:string>>", candidates).where(F.size("cand") > 0)
    hits = passed.select(*key, F.inline("cand")).distinct().join(listed.select("size", "win", "item"), ["size", "win"])
    of_doc = hits.groupBy(*key).agg(F.flatten(F.collect_set(F.array(F.col("at"), F.col("at") + F.col("size")))).alias("_lm_runs"), F.array_sort(F.collect_set("item")).alias("_lm_items"))
    merged = materialize(of_doc)
    counted = per_slice(named, "text", [*keep, *key], "_lm_words long", counts)
    none = lambda kind: F.array().cast(kind)
    return counted.join(merged, key, "left").select(*[F.col(f"`{c}`") for c in keep], "_lm_words", F.coalesce("_lm_runs", none("array<long>")).alias("_lm_runs"), F.coalesce("_lm_items", none("array<string>")).alias("_lm_items"))


def _flags(n: int, runs: list[int]) -> np.ndarray:
    """For each of n words if a run covers it; runs may overlap."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, runs[::2], 1)
    np.add.at(edge, runs[1::2], -1)
    return np.cumsum(edge[:-1]) > 0


def _covered(runs: str) -> Column:
    """How many words the runs cover."""
    pairs = F.array_sort(F.array_compact(F.transform(runs, lambda x, i: F.when(i % 2 == 0, F.struct(x.alias("a"), F.get(runs, i + 1).alias("b"))))))

    def step(acc: Column, p: Column) -> Column:
        return F.struct((acc["n"] + F.greatest(F.lit(0).cast("long"), p["b"] - F.greatest(acc["end"], p["a"]))).alias("n"), F.greatest(acc["end"], p["b"]).alias("end"))

    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    return F.when(F.size(runs) > 0, F.aggregate(pairs, zero, step, lambda a: a["n"])).otherwise(F.lit(0).cast("long"))


def scan(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Hits of every document: doc_id, n_words, n_hit, n_items, items (sorted ids), items_sha256, contaminated."""
    got = _found(documents, benchmark, ["doc_id"], window, max_bytes).withColumn("n_hit", _covered("_lm_runs"))
    digest = F.sha2(F.array_join("_lm_items", ",").cast("binary"), 256)
    return got.select("doc_id", F.col("_lm_words").alias("n_words"), "n_hit", F.size("_lm_items").cast("long").alias("n_items"), F.col("_lm_items").alias("items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def cut_runs(text: str, w: Words, hit: np.ndarray, d: int) -> str:
    """Text d without the words that are hit and what stands between neighbours among them."""
    data, out, at = text.encode(), [], 0
    for a, b in _runs(w, hit, d):
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]]).decode()


def clean(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_share: float = 0.5, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """documents without the hit spans; a document of which more than max_share of the words are hit goes. n_chars follows a changed text."""
    # Columns go by number inside, so that no name of theirs meets one of ours.
    held = {c: "text" if c == "text" else f"_k{i}" for i, c in enumerate(documents.columns)}
    named = documents.select(*[F.col(f"`{c}`").alias(k) for c, k in held.items()])
    got = _found(named, benchmark, named.columns, window, max_bytes, cut=True)
    kept = got.where(_covered("_lm_runs") <= max_share * F.col("_lm_words"))
    changed = F.col("_lm_new").isNotNull()
    shown = {"text": F.coalesce("_lm_new", "text")}
    if "n_chars" in held:
        shown["n_chars"] = F.when(changed, F.length("_lm_new")).otherwise(F.col(held["n_chars"])).cast(documents.schema["n_chars"].dataType)
    return kept.select(*[shown.get(c, F.col(k)).alias(c) for c, k in held.items()])


def _with_cuts(found: DataFrame) -> DataFrame:
    """found with _lm_new."""
    schema = StructType([*found.schema.fields, *StructType.fromDDL("_lm_new string").fields])
    at, runs_at = found.columns.index("text"), found.columns.index("_lm_runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = []
            for text, runs in zip(batch.column(at), batch.column(runs_at).to_pylist()):
                if not runs:
                    new.append(None)
                    continue
                w = words(pa.array([text.as_py()], pa.large_string()), ALNUM)
                new.append(cut_runs(text.as_py(), w, _flags(len(w.start), runs), 0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(new, pa.string())], names=schema.names)

    return found.mapInArrow(run, schema)
