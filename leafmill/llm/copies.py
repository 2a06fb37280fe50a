"""Near copies by exact Jaccard similarity: sets of 5-word shingles, similarity 0.8 or more. The form of operator 10 for stages.

First comes the method of operator 10, on 5-word shingles: SimHash fingerprints, and covering of up to 5 differing bits by 63 tables
of GF(2)^6 labels. Candidates are verified on the whole sets, and components are labelled. A bucket of more different fingerprints
than simhash compares goes to its covering of three bits, which covers large buckets again. Of sets with one fingerprint all are
compared with the smallest, which stands for them in the tables; then pairs of fingerprints that no component holds yet are.

A similarity of 0.8 is about 8 of 64 differing SimHash bits, and up to 22 were seen, which no covering of a payable size reaches.
So the pairs of sets that covering has not brought to one component are found by prefixes, which lose none: if all sets are sorted
by one order, two sets that are similar enough share an element of their first n - ceil(0.8 n) + 1. Pairs of one component are left
out of these joins, and so are buckets whose sets all are of one. Pairs whose sketches (counts of shingles by hash) or marks (places
that shingles fall to) rule the similarity out are dropped; the others are verified on the whole sets. The texts are read five
times, as shingles are cheaper to make anew than to keep: for fingerprints, prefixes, sketches and marks of all, and for what the
steps below need of some.

The first order is that of the hashes. Sets that meet in a shingle of at most max_bucket sets are compared there. Sets that meet
in a larger bucket are joined once more among themselves, by an order that puts shingles of many of these sets last, the most
common at the very end: a pair that shares a small bucket is found by the first order, and one that shares large ones only is
among these sets, so no pair is lost. What still is a large bucket is a crowd of near copies; all its sets are compared with one
pivot. The Jaccard distance is a metric, so sets further than 0.4 from the pivot have no link to sets within 0.2 of it, and only
those between must meet the near ones; near ones are in the pivot's component already. What is left gets a new pivot, and after
PIVOT_ROUNDS all pairs.

Words are as in simhash (white space parts them, A-Z is lowered); one to four words are one shingle. Shingles are 64-bit hashes.

Defined results of keep_first(): equal sets are one node, all texts without a word (null, empty, blank) among them; of a component
the document with the smallest doc_id stays, then that with the smallest hash of its text; a null doc_id stays only if all are
null; of rows that repeat a doc_id and text one stays; an empty table stays empty; texts are compared whole, however long; extra
columns pass through, whatever their names.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm import simhash
from leafmill.llm.bytewords import SOLID, U, mix, words
from leafmill.llm.common import bit_filter, columns_of, free_names, materialize, per_slice, small_rows
from leafmill.llm.decontam import window_hashes
from leafmill.llm.simhash import label_components
from leafmill.plans.staging import Scratch, scratch

SHINGLE = 5
#: Differing bits that the covering tables reach. It has no bearing on results.
RADIUS = 5
#: Sets of a shingle that are still compared pair by pair.
MAX_BUCKET = 64
#: Shingles that the second order puts last, the most common first. The order has no bearing on results.
MAX_COMMON = 1 << 18
PIVOT_ROUNDS = 4
#: Counts in a sketch; sets with a count beyond 255 have none and are always verified.
SKETCH = 256
#: Words of 64 bits that mark which of as many places as they have bits a set's shingles fall to.
MARKS = 16
_Q = U(0xD6E8FEB86659FD93)


def shingle_sets(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The different shingles of all texts, sorted within each text, and where each text's begin and the last's end."""
    w = words(strings, SOLID)
    hashes, counts = w.hashes(), w.counts
    h, at = window_hashes(w, hashes, SHINGLE)
    d = np.searchsorted(w.first, at, side="right") - 1
    if len(short := np.flatnonzero((counts > 0) & (counts < SHINGLE))):
        total = np.zeros(len(short), dtype=U)
        with np.errstate(over="ignore"):
            for k in range(SHINGLE - 1):
                on = counts[short] > k
                total[on] = total[on] * _Q + hashes[w.first[short[on]] + k]
        h, d = np.concatenate((h, mix(total + counts[short].astype(U)))), np.concatenate((d, short))
        by = np.argsort(d, kind="stable")
        h, d = h[by], d[by]
    ends = np.searchsorted(d, np.arange(len(strings) + 1))
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        h[a:b].sort()
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return h[new], np.concatenate(([0], np.cumsum(new)))[ends]


def set_keys(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit key of each set; 0 of the empty one."""
    with np.errstate(over="ignore"):
        run = np.concatenate((np.zeros(1, U), np.cumsum(mix(h ^ U(0x9E3779B97F4A7C15)), dtype=U)))
        n = np.diff(bounds)
        return np.where(n > 0, mix(run[bounds[1:]] - run[bounds[:-1]] + n.astype(U)), U(0))


def _lists(h: np.ndarray, n: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(h.view(np.int64)))


def sketches(h: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """How many shingles of each set fall to each of SKETCH parts, one byte each. Two sets share at most the sum of the smaller counts."""
    n = len(bounds) - 1
    part = np.repeat(np.arange(n), np.diff(bounds)) * SKETCH + (mix(h) % U(SKETCH)).astype(np.int64)
    counts = np.bincount(part, minlength=n * SKETCH).reshape(n, SKETCH)
    return pa.array([None if c.max() > 255 else c.astype(np.uint8).tobytes() for c in counts], pa.binary())


def marks(h: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Which places the shingles of each set fall to, as MARKS longs. Each place that only one of two sets marks is a shingle that they do not share, at least."""
    n, places = len(bounds) - 1, 64 * MARKS
    flags = np.zeros(n * places, dtype=bool)
    flags[np.repeat(np.arange(n), np.diff(bounds)) * places + (mix(h ^ U(0x5851F42D4C957F2D)) % U(places)).astype(np.int64)] = True
    packed = np.packbits(flags.reshape(n, places), axis=1, bitorder="little")
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * MARKS, pa.int32()), pa.array(packed.reshape(-1).view("<i8")))


def _near_marks(a: Column, b: Column, n: Column) -> Column:
    """Whether the marks of two sets of n shingles together leave room for a similarity of 0.8."""
    apart = sum((F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(MARKS)), F.lit(0))
    return 9 * apart <= n


def prefix_sizes(n: np.ndarray) -> np.ndarray:
    return np.where(n > 0, n - (4 * n + 4) // 5 + 1, 0)


def _described(documents: DataFrame, keep: list[str]) -> DataFrame:
    """keep, fp (the SimHash fingerprint of its 5-word shingles), sid, n, first (the prefix by hash), sketch and marks of every document."""

    def work(strings: pa.Array) -> list[pa.Array]:
        fp = simhash.fingerprints(strings, SHINGLE).view(np.int64)
        h, bounds = shingle_sets(strings)
        n = np.diff(bounds)
        size = prefix_sizes(n)
        inside = np.arange(len(h)) - np.repeat(bounds[:-1], n) < np.repeat(size, n)
        return [pa.array(fp), pa.array(set_keys(h, bounds).view(np.int64)), pa.array(n, pa.int64()), _lists(h[inside], size), sketches(h, bounds), marks(h, bounds)]

    return per_slice(documents, "text", keep, "fp long, sid long, n long, first array<long>, sketch binary, marks array<long>", work)


def _items(documents: DataFrame, ids: DataFrame, heads: bool = False) -> DataFrame:
    """sid, n and items (heads: twice the prefix by hash) of the sets in ids, once each. A bit filter spares the rest the way; the join is exact."""
    sent = documents.sparkSession.sparkContext.broadcast(bit_filter(ids, "sid"))

    def work(strings: pa.Array) -> list[pa.Array]:
        h, bounds = shingle_sets(strings)
        sid, n = set_keys(h, bounds), np.diff(bounds)
        on = sent.value.may_hold(sid)
        kept = np.where(on, np.minimum(n, 2 * prefix_sizes(n)) if heads else n, 0)
        inside = np.arange(len(h)) - np.repeat(bounds[:-1], n) < np.repeat(kept, n)
        return [pa.array(sid.view(np.int64), mask=~on), pa.array(n, pa.int64()), _lists(h[inside], kept)]

    found = per_slice(documents, "text", [], "sid long, n long, items array<long>", work).where("sid IS NOT NULL")
    return found.dropDuplicates(["sid"]).join(ids, "sid", "left_semi")


def _late_prefixes(sets: DataFrame, common: DataFrame) -> DataFrame:
    """sid, n and first of sets by the order that puts common (tok, k) last, by k; first is null where the items at hand do not reach."""
    listed = common.orderBy(F.desc("k"), "tok").limit(MAX_COMMON).collect()
    toks = np.array([r.tok for r in listed], dtype=np.int64).view(U)[::-1]
    by = np.argsort(toks)
    sent = sets.sparkSession.sparkContext.broadcast((toks[by], by))

    def run(batches):
        known, rank = sent.value
        for batch in batches:
            lists, n = batch.column(2), batch.column(1).to_numpy()
            h, held = lists.flatten().to_numpy(zero_copy_only=False).view(U), np.diff(lists.offsets.to_numpy())
            late = np.zeros(len(h), dtype=np.int64)
            if len(known) and len(h):
                spot = np.minimum(np.searchsorted(known, h), len(known) - 1)
                late = np.where(known[spot] == h, rank[spot] + 1, 0)
            owner = np.repeat(np.arange(len(n)), held)
            size = prefix_sizes(n)
            reach = (held == n) | (np.bincount(owner[late == 0], minlength=len(n)) >= size)
            size = np.where(reach, size, 0)
            inside = np.arange(len(h)) - np.repeat(np.cumsum(held) - held, held) < size[owner]
            first = _lists(h[np.lexsort((h, late, owner))][inside], size)
            first = pa.ListArray.from_arrays(first.offsets, first.values, mask=pa.array(~reach))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), first], names=["sid", "n", "first"])

    return sets.select("sid", "n", "items").mapInArrow(run, "sid long, n long, first array<long>")


def _rows(sets: DataFrame) -> DataFrame:
    return sets.select("sid", "n", F.posexplode("first").alias("pos", "tok"))


def _buckets(sets: DataFrame, labels: DataFrame) -> DataFrame:
    """tok, sid, n, pos, held (sets in the bucket) and label (the component by covering, if any) of the prefix elements that several sets share. Sizes are pre-aggregated; no bucket is gathered, and none of the exploded rows, which Spark sizes like the sets, is broadcast."""
    sizes = _rows(sets).groupBy("tok").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    return _rows(sets).join(sizes.hint("merge"), "tok").join(labels.withColumnRenamed("node", "sid"), "sid", "left")


def _mixed(rows: DataFrame) -> DataFrame:
    """The rows of buckets whose sets are not all of one component."""
    own = F.coalesce("label", "sid")
    several = rows.groupBy("tok").agg(F.min(own).alias("x"), F.max(own).alias("y")).where("x < y").select("tok")
    return rows.join(several.hint("merge"), "tok", "left_semi")


def _apart(x: Column, y: Column) -> Column:
    """Whether two labels, null for a set on its own, leave it open that their sets are linked."""
    return F.coalesce(x != y, F.lit(True))


def _pairs(rows: DataFrame) -> DataFrame:
    """Pairs a < b of different components, once each, that meet in a bucket and whose sizes and places there (and marks, if rows have them) let them be similar."""
    side = lambda c: rows.select("tok", F.col("sid").alias(c), F.col("n").alias(f"n_{c}"), F.col("pos").alias(f"p_{c}"), F.col("label").alias(f"l_{c}"), *[F.col(m).alias(f"m_{c}") for m in rows.columns if m == "marks"])
    x, y = side("a"), side("b")
    most = F.least("p_a", "p_b") + 1 + F.least(F.col("n_a") - F.col("p_a") - 1, F.col("n_b") - F.col("p_b") - 1)
    fits = (x["tok"] == y["tok"]) & (F.col("a") < F.col("b")) & (9 * most >= 4 * (F.col("n_a") + F.col("n_b"))) & _apart(F.col("l_a"), F.col("l_b"))
    if "marks" in rows.columns:
        fits = fits & _near_marks(F.col("m_a"), F.col("m_b"), F.col("n_a") + F.col("n_b"))
    return x.join(y.hint("merge"), fits).select("a", "b").distinct()


def _possible(pairs: DataFrame, base: DataFrame, own: Scratch) -> DataFrame:
    """The pairs a, b that their sketches do not rule out."""
    side = lambda c: base.select(F.col("sid").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))

    def run(batches):
        for batch in batches:
            on = []
            for m, n, x, y in zip(*(batch.column(i).to_pylist() for i in range(2, 6))):
                most = m + n if x is None or y is None else int(np.minimum(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)).sum())
                on.append(9 * most >= 4 * (m + n))
            yield batch.select([0, 1]).filter(pa.array(on, pa.bool_()))

    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "n_a", "n_b", "s_a", "s_b")
    with small_rows(base.sparkSession, 4096):
        return own.slim(both.mapInArrow(run, "a long, b long"))


def _measured(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (a, b, once each) with o, the shared shingles, and u, those of either."""
    side = lambda c: sets.select(F.col("sid").alias(c), F.col("n").alias(f"n_{c}"), F.col("items").alias(f"i_{c}"))
    got = pairs.join(side("b"), "b").join(side("a"), "a").withColumn("o", F.size(F.array_intersect("i_a", "i_b")).cast("long"))
    return got.select("a", "b", "o", (F.col("n_a") + F.col("n_b") - F.col("o")).alias("u"))


def _linked(measured: DataFrame) -> DataFrame:
    return measured.where("5 * o >= 4 * u").select("a", "b")


def _around_pivots(rows: DataFrame, sets: DataFrame, base: DataFrame, own: Scratch) -> list[DataFrame]:
    """Links of the sets in large buckets."""
    out = []
    # Pivots are the sets whose buckets are the largest for their size: the text that others were copied from shares most with them.
    weighed = rows.withColumn("weight", F.sum("held").over(Window.partitionBy("sid")) / F.col("n"))
    rows = own.slim(weighed.join(base.select("sid", "marks"), "sid"))
    for _ in range(PIVOT_ROUNDS):
        if not rows.take(1):
            return out
        pivots = rows.groupBy("tok").agg(F.max(F.struct("weight", "sid", "n")).alias("p")).select("tok", F.col("p.sid").alias("p"), F.col("p.n").alias("p_n"))
        placed = own.slim(rows.join(pivots, "tok"))
        asked = placed.where((F.col("sid") != F.col("p")) & (5 * F.col("n") >= 3 * F.col("p_n")) & (5 * F.col("p_n") >= 3 * F.col("n")))
        measured = own.slim(_measured(sets, asked.select(F.least("sid", "p").alias("a"), F.greatest("sid", "p").alias("b")).distinct()))
        out.append(_linked(measured))
        apart = measured.union(measured.select("b", "a", "o", "u")).toDF("sid", "p", "o", "u").select("sid", "p", (1 - F.col("o") / F.col("u")).alias("d"), (5 * F.col("o") >= 4 * F.col("u")).alias("on"))
        far = placed.where(F.col("sid") != F.col("p")).join(apart, ["sid", "p"], "left").withColumns({"d": F.coalesce("d", F.lit(1.0)), "on": F.coalesce("on", F.lit(False))})
        far = own.slim(far.drop("p_n"))
        # Buckets of one crowd have one pivot, so sets meet by pivot.
        seen = own.slim(far.where("on OR d <= 0.4 + 1e-9").select("p", "sid", "n", "d", "on", "marks").distinct())
        if seen.where("NOT on").take(1):
            x, y = seen.where("NOT on").alias("x"), seen.where("on").alias("y")
            near = F.col("x.d") - F.col("y.d") <= 0.2 + 1e-9
            alike = (5 * F.col("x.n") >= 4 * F.col("y.n")) & (5 * F.col("y.n") >= 4 * F.col("x.n"))
            alike = alike & _near_marks(F.col("x.marks"), F.col("y.marks"), F.col("x.n") + F.col("y.n"))
            crossed = x.join(y, (F.col("x.p") == F.col("y.p")) & near & alike)
            crossed = crossed.select(F.least("x.sid", "y.sid").alias("a"), F.greatest("x.sid", "y.sid").alias("b")).distinct()
            out.append(_linked(own.slim(_measured(sets, _possible(crossed, base, own)))))
        left = far.where(~F.col("on")).drop("p", "d", "on", "held")
        rows = own.slim(left.join(left.groupBy("tok").agg(F.count(F.lit(1)).alias("held")).where("held > 1"), "tok"))
    if rows.take(1):
        out.append(_linked(own.slim(_measured(sets, _possible(_pairs(rows), base, own)))))
    return out


def _ids(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, [f.select(F.col(c).alias("sid")) for f in frames for c in f.columns if c in ("a", "b", "sid")]).distinct()


def _joined(labels: DataFrame, more: DataFrame) -> DataFrame:
    """Links that give the components of labels and the links more (a, b) together: one of each node, and those of more between components, once for each two."""
    label = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"l_{c}"))
    more = more.join(label("a"), "a", "left").join(label("b"), "b", "left").select(F.coalesce("l_a", "a").alias("a"), F.coalesce("l_b", "b").alias("b"))
    return labels.where("node != label").select(F.col("label").alias("a"), F.col("node").alias("b")).union(more.where("a != b").distinct())


def near_fingerprints(fps: DataFrame, own: Scratch, max_bucket: int = simhash.MAX_BUCKET) -> DataFrame:
    """Pairs a < b of fingerprints (fp, once each) that differ in RADIUS bits or fewer, once each; in buckets of more than max_bucket those of simhash's radius."""
    by = ["t", "key"]
    rows = own.keep(simhash.grouped(simhash.tables(fps, simhash.cover(list(range(64)), RADIUS)), by))
    out = simhash.pairs(rows.where(F.col("n") <= max_bucket), by, RADIUS)
    hot = own.slim(rows.where(F.col("n") > max_bucket).select("fp").distinct())
    if hot.take(1):
        out = out.union(simhash.links(hot, keep=own.keep))
    out = own.slim(out.distinct())
    own.tidy(rows, hot)
    return out


def covered(documents: DataFrame, base: DataFrame, own: Scratch) -> DataFrame:
    """Components (node, label) by links between different sets whose fingerprints covering brings together, verified on whole sets; base has sid, fp, n and sketch once each."""
    groups = own.slim(base.groupBy("fp").agg(F.min("sid").alias("least"), F.count(F.lit(1)).alias("k")))
    side = lambda c: groups.select(F.col("fp").alias(c), F.col("least").alias(f"s_{c}"))
    near = near_fingerprints(groups.select("fp"), own).join(side("a"), "a").join(side("b"), "b")
    near = own.slim(near.select(F.least("s_a", "s_b").alias("a"), F.greatest("s_a", "s_b").alias("b")))
    same = base.select("fp", "sid").join(groups.where("k > 1"), "fp").where("least < sid").select(F.col("least").alias("a"), F.col("sid").alias("b"))
    # One link of each set at first, as a crowd's other ones are mostly within its component then and need not be verified.
    first = own.slim(same.union(near.groupBy("a").agg(F.min("b").alias("b"))))
    sets = own.keep(_items(documents, own.slim(_ids(first, near))))
    labels = label_components(own.slim(_linked(_measured(sets, first))), own.slim)
    label = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"l_{c}"))
    open_ = near.join(first, ["a", "b"], "left_anti").join(label("a"), "a", "left").join(label("b"), "b", "left").where(_apart(F.col("l_a"), F.col("l_b")))
    more = own.slim(_linked(_measured(sets, _possible(open_.select("a", "b"), base, own))))
    if more.take(1):
        labels = label_components(own.slim(_joined(labels, more)), own.slim)
    own.tidy(sets, near, groups)
    return labels


def links(documents: DataFrame, base: DataFrame, labels: DataFrame, own: Scratch, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """Links a < b between different sets that with those of the components in labels give the components of all pairs of similarity 0.8 or more; base has sid, n, first, sketch and marks once each."""
    spark = documents.sparkSession
    met = own.keep(_buckets(base, labels))
    own.tidy()
    big = F.col("held") > max_bucket
    pairs = _possible(_pairs(met.where(~big)), base, own)
    again = own.slim(_ids(_mixed(met.where(big))))
    own.tidy(met)
    crowded = again.limit(0).select("sid")
    if again.take(1):
        heads = own.keep(_items(documents, again, heads=True))
        common = own.slim(heads.select(F.explode("items").alias("tok")).groupBy("tok").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > max_bucket))
        with small_rows(spark, 1024):
            laid = own.keep(_late_prefixes(heads, common))
            own.tidy(heads)
            deep = own.slim(laid.where("first IS NULL").select("sid"))
        whole = own.slim(_items(documents, deep))
        with small_rows(spark, 256):
            deep_laid = own.slim(_late_prefixes(whole, common))
        met = own.keep(_buckets(laid.where("first IS NOT NULL").unionByName(deep_laid), labels))
        own.tidy(whole, laid, deep_laid)
        pairs = own.slim(pairs.union(_possible(_pairs(met.where(~big)), base, own)).distinct())
        crowded = own.slim(_mixed(met.where(big)))
    sets = own.keep(_items(documents, own.slim(_ids(pairs, crowded))))
    out = [own.slim(_linked(_measured(sets, pairs)))]
    own.tidy()
    if "tok" in crowded.columns:
        out += _around_pivots(crowded, sets, base, own)
    own.tidy()
    return reduce(DataFrame.union, out)


def keep_first(documents: DataFrame, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """One document of each component, as the defined results have it."""
    spark = documents.sparkSession
    a, b = free_names(documents.columns, "_lm_a", "_lm_b")
    # What tells rows apart: two hashes of id and text.
    named = documents.withColumns({a: F.xxhash64("doc_id", "text"), b: F.xxhash64("text", F.lit(1), "doc_id")})
    with scratch(spark, "leafmill") as own:
        slim = named.select("doc_id", "text", F.col(a).alias("_lm_a"), F.col(b).alias("_lm_b"), F.xxhash64("text").alias("_lm_text"))
        docs = own.keep(_described(slim, ["doc_id", "_lm_a", "_lm_b", "_lm_text"]))
        order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_lm_text").alias("text"), F.col("_lm_a").alias("a"), F.col("_lm_b").alias("b"))
        groups = own.slim(docs.groupBy("sid").agg(F.min(order).alias("least")))
        base = own.keep(docs.select("sid", "fp", "n", "first", "sketch", "marks").dropDuplicates(["sid"]))
        own.tidy(docs)
        labels = covered(documents, base, own)
        labels = label_components(own.slim(_joined(labels, links(documents, base, labels, own, max_bucket))), own.slim)
        known = groups.join(labels.withColumnRenamed("node", "sid"), "sid", "left").withColumn("label", F.coalesce("label", "sid"))
        kept = materialize(known.groupBy("label").agg(F.min("least").alias("first")).select(F.col("first.a").alias(a), F.col("first.b").alias(b)))
    # Both the join and the choice among repeated rows ask for the same partitioning and order.
    return named.join(kept, [a, b], "left_semi").dropDuplicates([a, b]).select(*columns_of(documents))
