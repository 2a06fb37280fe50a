"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints: 64 majority bits over the XXH64 (seed 42) of all 3-word shingles, repeats included. Links: 3 or fewer differing bits.

Covering: each of the 64 bits has a non-zero label in GF(2)**4, and table v (v = 1 to 15) keeps the bits whose label has an odd
product with v. The labels of three or fewer differing bits span three dimensions at most, so some v is orthogonal to all of
them and table v keeps none of the differing bits: each pair within the radius collides in some table. A bucket of more than
max_bucket different fingerprints is not compared pair by pair; the bits that it leaves free are covered again by 15 smaller
tables, for as long as buckets stay large. The free bits fall from 32 at most to 16 and 8, which leave 256 different fingerprints
at most, so comparisons stay in proportion to a bucket's size and no link is lost.

Copies are linked by their fingerprint; only different fingerprints enter the tables. Components come from label propagation
with pointer jumping over the links.

Defined results: a null or empty text has fingerprint zero and links like any other; one or two words are one shingle; repeated
rows each get their row; null ids never become a component's id unless all ids of the component are null; an empty table gives
an empty result; texts are fingerprinted whole, however long. Extra columns are ignored by components() and pass through
keep_first(), whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.bytewords import SOLID, U, words
from leafmill.llm.common import columns_of, free_names, materialize, per_slice
from leafmill.plans.staging import Scratch, scratch

SHINGLE = 3
RADIUS = 3
SEED = 42
#: Different fingerprints in a bucket that are still compared pair by pair.
MAX_BUCKET = 256

_P1, _P2, _P3, _P4, _P5 = (U(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotate(x: np.ndarray, n: int) -> np.ndarray:
    return (x << U(n)) | (x >> U(64 - n))


def xxh64(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of data[start[i]:end[i]] for every i, as the published algorithm has it, one step for all i at a time."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    long8 = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))
    long4 = np.ndarray(len(data) + 1, dtype="<u4", buffer=padded, strides=(1,))
    size = end - start
    seed64 = U(seed)
    with np.errstate(over="ignore"):
        h = np.full(len(start), seed64 + _P5, dtype=U)
        at = start.copy()
        if len(wide := np.flatnonzero(size >= 32)):
            lanes = [np.full(len(wide), x, dtype=U) for x in (seed64 + _P1 + _P2, seed64 + _P2, seed64, seed64 - _P1)]
            todo, place = size[wide] // 32, at[wide].copy()
            for step in range(int(todo.max())):
                on = np.flatnonzero(todo > step)
                for k in range(4):
                    lanes[k][on] = _rotate(lanes[k][on] + long8[place[on] + 8 * k] * _P2, 31) * _P1
                place[on] += 32
            merged = _rotate(lanes[0], 1) + _rotate(lanes[1], 7) + _rotate(lanes[2], 12) + _rotate(lanes[3], 18)
            for lane in lanes:
                merged = (merged ^ (_rotate(lane * _P2, 31) * _P1)) * _P1 + _P4
            h[wide], at[wide] = merged, place
        h += size.astype(U)
        on = np.flatnonzero(end - at >= 8)
        while len(on):
            h[on] = _rotate(h[on] ^ (_rotate(long8[at[on]] * _P2, 31) * _P1), 27) * _P1 + _P4
            at[on] += 8
            on = on[end[on] - at[on] >= 8]
        on = np.flatnonzero(end - at >= 4)
        h[on] = _rotate(h[on] ^ (long4[at[on]].astype(U) * _P1), 23) * _P2 + _P3
        at[on] += 4
        on = np.flatnonzero(end > at)
        while len(on):
            h[on] = _rotate(h[on] ^ (padded[at[on]].astype(U) * _P5), 11) * _P1
            at[on] += 1
            on = on[end[on] > at[on]]
        h = (h ^ (h >> U(33))) * _P2
        h = (h ^ (h >> U(29))) * _P3
        return h ^ (h >> U(32))


#: Counters of 16 bits stand side by side in a 64-bit sum; longer texts are summed bit by bit.
_LANES = U(0x0001000100010001)
_FULL = 65535


def fingerprints(strings: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    w = words(strings, SOLID)
    # The words with one space after each, so that shingles are stretches of bytes.
    size = w.end - w.start
    spot = np.concatenate(([0], np.cumsum(size + 1)))
    flat = np.full(int(spot[-1]), 32, dtype=np.uint8)
    solid = np.zeros(len(w.low) + 1, dtype=np.int8)
    np.add.at(solid, w.start, 1)
    np.add.at(solid, w.end, -1)
    held = np.cumsum(solid[:-1]) > 0
    source = np.flatnonzero(held)
    flat[source - np.repeat(w.start - spot[:-1], size)] = w.low[source]
    counts = w.counts
    n = np.where(counts >= shingle, counts - shingle + 1, np.minimum(counts, 1))
    own = np.concatenate(([0], np.cumsum(n)))
    first = np.repeat(w.first[:-1] - own[:-1], n) + np.arange(own[-1])
    last = first + np.repeat(np.minimum(counts, shingle), n) - 1
    h = xxh64(flat, spot[first], spot[last] + size[last])
    out = np.zeros(len(counts), dtype=U)
    some = np.flatnonzero(n)
    if not len(some):
        return out
    cuts, half = own[:-1][some], n[some]
    result = np.zeros(len(some), dtype=U)
    for i in range(16):
        packed = np.add.reduceat((h >> U(i)) & _LANES, cuts)
        for lane in range(4):
            count = ((packed >> U(16 * lane)) & U(0xFFFF)).astype(np.int64)
            result |= (2 * count > half).astype(U) << U(16 * lane + i)
    for k in np.flatnonzero(half > _FULL):
        part, bits = h[cuts[k] : cuts[k] + half[k]], 0
        for i in range(64):
            bits |= int(2 * int(((part >> U(i)) & U(1)).sum()) > half[k]) << i
        result[k] = U(bits)
    out[some] = result
    return out


def with_fingerprint(documents: DataFrame, keep: list[str]) -> DataFrame:
    """The columns keep and fp, the fingerprint as a signed long, of every document."""
    return per_slice(documents, "text", keep, "fp long", lambda strings: [pa.array(fingerprints(strings).view(np.int64))])


def cover(bits: list[int], radius: int = RADIUS) -> list[int]:
    """15 masks over the given bits such that any three of the bits are all left out of some mask. For any radius: labels in GF(2)**(radius + 1), as many masks as there are labels."""
    labels = 2 ** (radius + 1) - 1
    label = {b: i % labels + 1 for i, b in enumerate(bits)}
    return [sum(1 << b for b in bits if (label[b] & v).bit_count() % 2) for v in range(1, labels + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def tables(fps: DataFrame, masks: list[int]) -> DataFrame:
    """Each fingerprint in each table: t, key, fp."""
    rows = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)])
    return fps.select("fp", F.inline(rows)).select("t", "key", "fp")


def grouped(rows: DataFrame, by: list[str]) -> DataFrame:
    """The rows of buckets of two or more, with the bucket's size n. Sizes are pre-aggregated; no bucket is gathered.

    Spark sizes exploded rows like those before, so a join without a hint would broadcast many times what it may.
    """
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return rows.join(sizes.hint("merge"), by)


def pairs(rows: DataFrame, by: list[str], radius: int) -> DataFrame:
    """Links a < b within the buckets of rows."""
    a, b = rows.select(*by, F.col("fp").alias("a")), rows.select(*by, F.col("fp").alias("b"))
    return a.join(b.hint("merge"), by).where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)).select("a", "b")


def links(fps: DataFrame, max_bucket: int = MAX_BUCKET, keep: Callable[[DataFrame], DataFrame] = materialize) -> DataFrame:
    """All links a < b between different fingerprints; fps has each fingerprint once. A link may be listed more than once. keep writes and rereads a table."""
    if max_bucket < MAX_BUCKET:
        raise ValueError(f"max_bucket is {MAX_BUCKET} at least, the most that the third covering can leave")
    masks, by = cover(list(range(64))), ["t", "key"]
    rows = keep(grouped(tables(fps, masks), by))
    out = pairs(rows.where(F.col("n") <= max_bucket), by, RADIUS)
    while (hot := rows.where(F.col("n") > max_bucket)).take(1):
        deeper = [[mask | m for m in cover([b for b in range(64) if not mask >> b & 1])] for mask in masks]
        own = F.element_at(F.array(*[F.array(*[F.lit(_signed(m)) for m in group]) for group in deeper]), F.col("t") + 1)
        parts = F.transform(own, lambda m, i: F.struct((F.col("t") * 15 + i).alias("t"), F.col("fp").bitwiseAND(m).alias("key")))
        rows = keep(grouped(hot.select("fp", F.inline(parts)), by))
        masks = [m for group in deeper for m in group]
        out = out.union(pairs(rows.where(F.col("n") <= max_bucket), by, RADIUS))
    return out


def label_components(edges: DataFrame, keep: Callable[[DataFrame], DataFrame] = materialize) -> DataFrame:
    """node and label (the smallest node reachable) of every node of the undirected edges a, b.

    Each round takes the least label among a node's neighbours and then, for that label, its own label or the least that any node
    so labelled has met, so whole groups move at once and long chains take few rounds. Labels only fall, so the rounds end. State
    is written to the shared folder by keep, so a lost executor costs one round at most.
    """
    both = keep(edges.union(edges.select(F.col("b"), F.col("a"))).distinct().toDF("node", "other"))
    labels = keep(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("m"))
        step = keep(labels.join(near, "node").select("node", "label", F.least("label", "m").alias("l1")))
        if not step.where("l1 < label").take(1):
            return labels
        jump = labels.union(step.select("label", "l1")).toDF("l1", "l2").groupBy("l1").agg(F.min("l2").alias("l2"))
        labels = keep(step.select("node", "l1").join(jump, "l1", "left").select("node", F.least("l1", "l2").alias("label")))


def _by_fingerprint(docs: DataFrame, least: Column, own: Scratch) -> DataFrame:
    """fp and least (the least of all documents' values in its component) of each fingerprint of docs."""
    groups = own.slim(docs.groupBy("fp").agg(least.alias("least")))
    labels = label_components(links(groups.select("fp"), keep=own.keep), own.slim)
    named = groups.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    return named.join(named.groupBy("label").agg(F.min("least").alias("first")), "label").select("fp", "first")


def components(documents: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits) and component_id of every document."""
    docs = materialize(with_fingerprint(documents, ["doc_id"]))
    with scratch(documents.sparkSession, "leafmill") as own:
        by_fp = materialize(_by_fingerprint(docs, F.min("doc_id"), own))
    return docs.join(by_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("first").alias("component_id"))


def keep_first(documents: DataFrame) -> DataFrame:
    """One document of each component: that with the smallest doc_id (then the smallest hash of its text); of repeated rows one stays."""
    a, b = free_names(documents.columns, "_lm_a", "_lm_b")
    named = documents.withColumns({a: F.xxhash64("doc_id", "text"), b: F.xxhash64("text", F.lit(1), "doc_id")})
    slim = named.select("doc_id", "text", F.col(a).alias("_lm_a"), F.col(b).alias("_lm_b"), F.xxhash64("text").alias("_lm_text"))
    with scratch(documents.sparkSession, "leafmill") as own:
        docs = own.keep(with_fingerprint(slim, ["doc_id", "_lm_a", "_lm_b", "_lm_text"]))
        least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_lm_text").alias("text"), F.col("_lm_a").alias("a"), F.col("_lm_b").alias("b")))
        kept = materialize(_by_fingerprint(docs, least, own).select(F.col("first.a").alias(a), F.col("first.b").alias(b)).distinct())
    return named.join(kept, [a, b], "left_semi").dropDuplicates([a, b]).select(*columns_of(documents))
