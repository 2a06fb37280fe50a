"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic. A table of targets says what share of the sample's tokens each source,
language and topic is to have. Raking finds chances of the form min(1, a * b * c), with a factor for each category, such that
the expected tokens (tokens times chance) of every category are its share of the budget: each factor in turn is set so that its
category is met, with the chances that reach 1 held there, until all hold. A hash of the document decides.

A category that has too few tokens for its part of the budget is asked for REACH of what it has, and the rest goes to the others
of its dimension. Shares that cannot be met together because two dimensions contradict each other are all moved towards the corpus's own shares, which can always be met, by the least step that is enough (a multiple of
1/STEPS); Raked.step says how far, and report() lists wanted, used and expected shares. Nothing is missed silently.

Topics come from spherical k-means over all documents, on hashed word counts less the mean of the document's language, as topics
that follow languages could not be raked beside them: vectors are stored once as bytes, and each round sums
them exactly (in whole numbers) by topic, so that the fit hangs neither on partitions nor on the order of sums. Cells are summed
before they are shuffled. Raking needs the factors of languages and topics on the driver and those of sources nowhere at once:
cells are packed by source, and each round a pass over the packs solves the sources and adds up the others. Up to MAX_CELLS cells
are one pack on the driver; more are packs on the executors, by the same code, so the result is the same.

Defined results: null sources and languages are categories of their own; a null or empty text has no tokens, falls in topic 0 and
has chance 1 (it costs nothing); repeated rows share their fate, and so do documents of equal id and text (ties); very long texts
count whole; a target for a category without tokens is spread over the others in proportion; an empty table gives an empty result;
extra columns pass through, whatever their names, but that the five columns that sample() makes take the place of any so named.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from leafmill.llm.bytewords import ALNUM, U, words
from leafmill.llm.common import columns_of, free_names, materialize, per_slice, small_rows

TOPICS = 8
HASHED = 256
TOPIC_ROUNDS = 4
#: Cells that are raked as one pack on the driver.
MAX_CELLS = 100_000
#: Rounds in which shares must be met, to within TOLERANCE of each, to count as possible together.
ROUNDS = 400
TOLERANCE = 1e-4
STEPS = 32
#: Part of its tokens that a category is asked for at most.
REACH = 0.95
DIMS = ("source", "lang", "topic")


@dataclass
class Targets:
    """Wanted shares by dimension and category; a dimension without them gets the observed shares to the power flatten."""

    shares: dict[str, dict[object, float]] = field(default_factory=dict)
    flatten: float = 0.5
    #: Expected tokens of the sample as a share of all tokens.
    budget: float = 0.5


# Topics.


def word_vectors(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of square-rooted hashed word counts in bytes (255 is 1), one row for each text, and the number of words."""
    w = words(strings, ALNUM)
    spot = w.owner() * HASHED + (w.hashes() >> U(64 - HASHED.bit_length() + 1)).astype(np.int64)
    counts = np.sqrt(np.bincount(spot, minlength=len(strings) * HASHED).reshape(len(strings), HASHED))
    unit = counts / np.maximum(np.linalg.norm(counts, axis=1, keepdims=True), 1e-12)
    return np.rint(255 * unit).astype(np.uint8), w.counts


@dataclass
class Topics:
    """Mean vector of each language (in whole numbers) and centres of what documents have beyond it."""

    means: dict[object, np.ndarray]
    centres: np.ndarray

    def beyond(self, vectors: np.ndarray, langs: list) -> np.ndarray:
        none = np.zeros(HASHED, dtype=np.int64)
        names = list(dict.fromkeys(langs))
        held = np.stack([self.means.get(k, none) for k in names]) if names else none[None, :]
        place = {k: i for i, k in enumerate(names)}
        return vectors.astype(np.int64) - held[[place[k] for k in langs]] if langs else np.zeros((0, HASHED), np.int64)

    def of(self, vectors: np.ndarray, langs: list) -> np.ndarray:
        """The centre of the largest product, the first of equals; products are of whole numbers, so they are exact. Texts without words are in topic 0."""
        best = (self.beyond(vectors, langs).astype(np.float64) @ self.centres.T).argmax(axis=1)
        return np.where(vectors.any(axis=1), best, 0)


def _unit(sums: np.ndarray) -> np.ndarray:
    """Sums as centres: directions in whole numbers."""
    return np.rint(4095 * sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12))


def _unpacked(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, HASHED)


def _summed(vectors: DataFrame, kind: str, work: Callable[[np.ndarray, list], tuple[np.ndarray, list]]) -> dict[object, tuple[np.ndarray, int]]:
    """Sum of vectors and their number by key, over all documents with words; work(vectors, langs) gives the vectors to add and their keys. A row for each key and place comes to the driver; sums are of whole numbers, so no order changes them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[object, np.ndarray] = {}
        for batch in batches:
            x, langs = _unpacked(batch.column(0)), batch.column(1).to_pylist()
            on = np.flatnonzero(x.any(axis=1))
            added, keys = work(x[on], [langs[i] for i in on])
            of = np.array([hash(k) for k in keys])
            for k in dict.fromkeys(keys):
                own = added[of == hash(k)]
                total[k] = total.get(k, 0) + np.append(own.sum(axis=0, dtype=np.int64), len(own))
        for k, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * (HASHED + 1), pa.string() if kind == "string" else pa.int64()), pa.array(np.arange(HASHED + 1)), pa.array(v)], names=["key", "place", "v"])

    with small_rows(vectors.sparkSession, 4096):
        rows = vectors.select("_lm_vector", F.col("_l").cast("string")).mapInArrow(run, f"key {kind}, place long, v long").groupBy("key", "place").agg(F.sum("v").alias("v")).collect()
    out: dict[object, np.ndarray] = {}
    for r in rows:
        out.setdefault(r.key, np.zeros(HASHED + 1, dtype=np.int64))[r.place] = r.v
    return {k: (v[:HASHED], int(v[HASHED])) for k, v in out.items()}


def fit_topics(vectors: DataFrame, topics: int = TOPICS, rounds: int = TOPIC_ROUNDS) -> Topics:
    """Spherical k-means over all documents, of what they have beyond their language's mean, so that topics are not languages once more. It starts from the sides of fixed planes; a topic that empties keeps its centre."""
    means = {k: np.rint(v / n).astype(np.int64) for k, (v, n) in _summed(vectors, "string", lambda x, langs: (x, langs)).items()}
    bits = max(1, (topics - 1).bit_length())
    planes = np.random.default_rng(17).integers(-8, 9, (HASHED, bits)).astype(np.float64)
    found = Topics(means, np.zeros((topics, HASHED)))

    def sides(x: np.ndarray, langs: list) -> tuple[np.ndarray, list]:
        rest = found.beyond(x, langs)
        return rest, (((rest.astype(np.float64) @ planes > 0) @ (1 << np.arange(bits))) % topics).tolist()

    def own(x: np.ndarray, langs: list) -> tuple[np.ndarray, list]:
        return found.beyond(x, langs), found.of(x, langs).tolist()

    for k in range(rounds + 1):
        sums = _summed(vectors, "long", own if k else sides)
        grown = np.stack([_unit(sums[t][0][None, :].astype(float))[0] if t in sums else found.centres[t] for t in range(topics)])
        if k and np.array_equal(grown, found.centres):
            break
        found = Topics(means, grown)
    return found


def _vectors(documents: DataFrame, keep: list[str]) -> DataFrame:
    def work(strings: pa.Array) -> list[pa.Array]:
        vectors, counts = word_vectors(strings)
        return [pa.array([v.tobytes() for v in vectors], pa.binary()), pa.array(counts, pa.int64())]

    return per_slice(documents, "text", keep, "_lm_vector binary, _lm_tokens long", work)


def _topics_of(vectors: DataFrame, topics: Topics, keep: list[str]) -> DataFrame:
    """keep, _lm_topic and _lm_tokens of stored vectors."""
    out = StructType([vectors.schema[c] for c in keep] + StructType.fromDDL("_lm_topic long, _lm_tokens long").fields)
    shared = vectors.sparkSession.sparkContext.broadcast(topics)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = shared.value.of(_unpacked(batch.column(len(keep))), batch.column(len(keep) + 2).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(own, pa.int64()), batch.column(len(keep) + 1)], names=out.names)

    return vectors.select(*keep, "_lm_vector", "_lm_tokens", F.col("_l").cast("string").alias("_lm_lang")).mapInArrow(run, out)


def _with_topic(documents: DataFrame, topics: Topics, keep: list[str]) -> DataFrame:
    """keep, _lm_topic and _lm_tokens of documents that still have their text."""
    shared = documents.sparkSession.sparkContext.broadcast(topics)

    def work(strings: pa.Array, langs: pa.Array) -> list[pa.Array]:
        vectors, counts = word_vectors(strings)
        return [pa.array(shared.value.of(vectors, langs.to_pylist()), pa.int64()), pa.array(counts, pa.int64())]

    return per_slice(documents, "text", keep, "_lm_topic long, _lm_tokens long", work, beside="_l")


# Raking.


@dataclass
class Pack:
    """Cells of whole sources: the number of the source in the pack, of the language and of the topic, and tokens of each cell; tokens wanted of each source."""

    own: np.ndarray
    lang: np.ndarray
    topic: np.ndarray
    tokens: np.ndarray
    goal: np.ndarray


def _factor(goal: np.ndarray, capped: np.ndarray, free: np.ndarray) -> np.ndarray:
    """What to multiply the factor of a category by, given the tokens that its cells with chance 1 hold and those expected of the others: exact while the same cells stay capped, and never past the aim."""
    with np.errstate(divide="ignore", invalid="ignore"):
        raised = np.where(free > 0, (goal - capped) / np.where(free > 0, free, 1), 1.0)
        lowered = np.where(capped + free > 0, goal / np.where(capped + free > 0, capped + free, 1), 1.0)
    return np.where(goal > capped, raised, lowered)


def chances_in(pack: Pack, lang: np.ndarray, topic: np.ndarray, most: int = 60) -> np.ndarray:
    """The chance of each cell once each source's factor is such that the source is met, for given factors of languages and topics."""
    pull = lang[pack.lang] * topic[pack.topic]
    n = len(pack.goal)
    factor = np.ones(n)
    for _ in range(most):
        q = factor[pack.own] * pull
        high = q >= 1
        move = _factor(pack.goal, np.bincount(pack.own, pack.tokens * high, n), np.bincount(pack.own, pack.tokens * np.where(high, 0, q), n))
        factor *= move
        if np.abs(move - 1).max(initial=0) < 1e-13:
            break
    return factor[pack.own] * pull


def _added(pack: Pack, lang: np.ndarray, topic: np.ndarray) -> tuple[np.ndarray, float]:
    """For each language and then each topic: tokens of cells with chance 1, and expected tokens of the others; and the largest gap of a source."""
    q = chances_in(pack, lang, topic)
    high = q >= 1
    capped, free = pack.tokens * high, pack.tokens * np.where(high, 0, q)
    sums = np.stack([np.concatenate([np.bincount(pack.lang, v, len(lang)), np.bincount(pack.topic, v, len(topic))]) for v in (capped, free)])
    return sums, _gap(pack.goal, np.bincount(pack.own, capped + free, len(pack.goal)))


@dataclass
class Raked:
    """Factors by language and topic, how far the wanted shares were moved towards the corpus's own (0: not at all, 1: wholly), and the largest gap left, as a part of a category's wanted tokens."""

    lang: np.ndarray
    topic: np.ndarray
    step: float
    gap: float


def _gap(goal: np.ndarray, got: np.ndarray) -> float:
    return float((np.abs(got - goal) / np.maximum(goal, 1e-300))[goal > 0].max(initial=0.0))


def rake(passes: Callable[[np.ndarray, np.ndarray, float], tuple[np.ndarray, float]], lang: tuple[np.ndarray, np.ndarray], topic: tuple[np.ndarray, np.ndarray], rounds: int = ROUNDS, tolerance: float = TOLERANCE, steps: int = STEPS) -> Raked:
    """Factors at which all shares are met. passes(lang factors, topic factors, step) is _added() summed over all packs, with the sources' goals at that step; lang and topic are wanted and own tokens of each category."""

    def tried(step: float) -> Raked:
        goals = [(1 - step) * wanted + step * own for wanted, own in (lang, topic)]
        b, c = np.where(goals[0] > 0, 1.0, 0.0), np.where(goals[1] > 0, 1.0, 0.0)
        gap, least, since = np.inf, np.inf, 0
        for _ in range(rounds):
            (capped, free), of_sources = passes(b, c, step)
            got = capped + free
            gap = max(_gap(goals[0], got[: len(b)]), _gap(goals[1], got[len(b) :]), of_sources)
            if gap < tolerance:
                break
            # What has not come nearer for long never will.
            least, since = (gap, 0) if gap < 0.98 * least else (least, since + 1)
            if since > 40:
                break
            b = b * _factor(goals[0], capped[: len(b)], free[: len(b)])
            (capped, free), _ = passes(b, c, step)
            c = c * _factor(goals[1], capped[len(b) :], free[len(b) :])
        return Raked(b, c, step, gap)

    got = tried(0.0)
    if got.gap < tolerance:
        return got
    low, high, best = 0, steps, tried(1.0)
    while high - low > 1:
        mid = (low + high) // 2
        got = tried(mid / steps)
        low, high, best = (low, mid, got) if got.gap < tolerance else (mid, high, best)
    return best


def wanted_shares(observed: dict[object, float], dim: str, targets: Targets) -> dict[object, float]:
    """The wanted share of each category that has tokens; they sum to 1."""
    held = {k: v for k, v in observed.items() if v > 0}
    wanted = {k: max(0.0, targets.shares[dim].get(k, 0.0)) for k in held} if dim in targets.shares else {k: v**targets.flatten for k, v in held.items()}
    total = sum(wanted.values())
    if not total:
        wanted, total = held, sum(held.values())
    return {k: v / total for k, v in wanted.items()}


def within_reach(wanted: np.ndarray, held: np.ndarray, most: float) -> np.ndarray:
    """Wanted tokens, none above most times what its category holds; what is over goes to the others in proportion."""
    out, total = wanted.copy(), wanted.sum()
    for _ in range(len(out)):
        over = out > most * held
        free = ~over & (out > 0)
        if not over.any() or not out[free].sum():
            break
        out[over] = most * held[over]
        out[free] *= (total - out[~free].sum()) / out[free].sum()
    return out


def _order(k: object) -> tuple:
    return (k is not None, k if k is not None else 0)


def _goals(cells: DataFrame, dim: str, targets: Targets, tokens: float) -> tuple[list, np.ndarray, np.ndarray]:
    """Categories of languages or topics, their wanted tokens and their own part of the budget; a row for each category comes to the driver."""
    observed = {r[0]: float(r[1]) for r in cells.groupBy(dim).agg(F.sum("tokens")).collect()}
    names = sorted(observed, key=_order)
    shares, held = wanted_shares(observed, dim, targets), np.array([observed[k] for k in names])
    return names, within_reach(targets.budget * tokens * np.array([shares.get(k, 0.0) for k in names]), held, max(REACH, targets.budget)), targets.budget * held


def _source_goals(cells: DataFrame, targets: Targets, tokens: float) -> DataFrame:
    """source, wanted and own (parts of the budget in tokens) of each source with tokens."""
    spark = cells.sparkSession
    held = cells.groupBy("source").agg(F.sum("tokens").alias("held")).where("held > 0")
    if "source" in targets.shares:
        kind = dict(cells.dtypes)["source"]
        listed = spark.createDataFrame([(k, max(0.0, float(v))) for k, v in targets.shares["source"].items()], f"name {kind}, share double")
        held = held.join(listed, held["source"].eqNullSafe(listed["name"]), "left").withColumn("share", F.coalesce("share", F.lit(0.0))).drop("name")
    else:
        held = held.withColumn("share", F.pow(F.col("held").cast("double") / tokens, F.lit(targets.flatten)))
    held = materialize(held)
    total, most = float(held.agg(F.sum("share")).first()[0] or 0.0), max(REACH, targets.budget)
    wanted = (F.col("share") / total if total else F.col("held") / tokens) * targets.budget * tokens
    # As within_reach() has it: what is over the limit is spread over the sources under it, until none is over.
    scale = 1.0
    for _ in range(100):
        over = scale * wanted > most * F.col("held")
        sums = held.agg(F.sum(F.when(over, most * F.col("held"))).alias("full"), F.sum(F.when(~over, wanted)).alias("rest"), F.sum(wanted).alias("all")).first()
        grown = (sums.all - (sums.full or 0.0)) / sums.rest if sums.rest else scale
        if grown <= scale * (1 + 1e-12):
            break
        scale = grown
    return held.select("source", F.least(scale * wanted, most * F.col("held")).alias("wanted"), (F.col("held") * targets.budget).alias("own"))


def _packed(table: pa.Table, step: float) -> Pack:
    keys, own = np.unique(table.column("source_key").to_numpy(), return_inverse=True)
    goal = (1 - step) * table.column("wanted").to_numpy() + step * table.column("own").to_numpy()
    goals = np.zeros(len(keys))
    goals[own] = goal
    return Pack(own, table.column("lang").to_numpy().astype(np.int64), table.column("topic").to_numpy().astype(np.int64), table.column("tokens").to_numpy().astype(float), goals)


def chances(cells: DataFrame, targets: Targets, max_cells: int = MAX_CELLS) -> tuple[DataFrame, Raked]:
    """source, lang, topic, weight (wanted tokens over held ones at the budget, the chance before it is cut at 1) and chance of every cell, and how raking went; cells has source, lang, topic and tokens once each."""
    spark = cells.sparkSession
    cells = materialize(cells)
    tokens = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    if not tokens:
        return cells.select(*DIMS, F.lit(0.0).alias("weight"), F.lit(1.0).alias("chance")), Raked(np.zeros(0), np.zeros(0), 0.0, 0.0)
    langs, lang_goal, lang_own = _goals(cells, "lang", targets, tokens)
    topics, topic_goal, topic_own = _goals(cells, "topic", targets, tokens)
    number = lambda names, kind, name: spark.createDataFrame([(k, i) for i, k in enumerate(names)], f"_{name} {kind}, _{name}_no int")
    kinds = dict(cells.dtypes)
    by_lang, by_topic, by_source = number(langs, kinds["lang"], "lang"), number(topics, kinds["topic"], "topic"), _source_goals(cells, targets, tokens).withColumnRenamed("source", "_source")
    full = cells.where("tokens > 0").withColumn("source_key", F.xxhash64("source", F.col("source").isNull()))
    for other, name in ((by_lang, "lang"), (by_topic, "topic"), (by_source, "source")):
        full = full.join(other, full[name].eqNullSafe(other[f"_{name}"])).drop(f"_{name}")
    laid = full.select(*[F.col(d).alias(f"c_{d}") for d in DIMS], "source_key", F.col("_lang_no").alias("lang"), F.col("_topic_no").alias("topic"), F.col("tokens").cast("long").alias("tokens"), "wanted", "own")
    few = cells.count() <= max_cells
    laid = materialize(laid)
    slim = laid.select("source_key", "lang", "topic", "tokens", "wanted", "own")
    numbers = [(lang_goal, lang_own), (topic_goal, topic_own)]
    if few:
        table = slim.toArrow().sort_by([("source_key", "ascending"), ("lang", "ascending"), ("topic", "ascending")])
        packs: dict[float, Pack] = {}
        raked = rake(lambda b, c, step: _added(packs.setdefault(step, _packed(table, step)), b, c), *numbers)
    else:
        raked = rake(lambda b, c, step: _passed(slim, b, c, step), *numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if rows:
            whole = pa.Table.from_batches(rows)
            q = chances_in(_packed(whole, raked.step), raked.lang, raked.topic)
            for batch in whole.select([f"c_{d}" for d in DIMS]).append_column("weight", pa.array(q)).append_column("chance", pa.array(np.minimum(1.0, q))).combine_chunks().to_batches():
                yield pa.RecordBatch.from_arrays(batch.columns, names=[*DIMS, "weight", "chance"])

    schema = ", ".join(f"{d} {kinds[d]}" for d in DIMS) + ", weight double, chance double"
    with small_rows(spark):
        # All cells of a source are in one pack; a source has as many as there are languages and topics at most.
        made = materialize((laid.coalesce(1) if few else laid.repartition("source_key")).mapInArrow(run, schema))
    return made.union(cells.where("tokens <= 0").select(*DIMS, F.lit(0.0), F.lit(1.0))), raked


def _passed(slim: DataFrame, lang: np.ndarray, topic: np.ndarray, step: float) -> tuple[np.ndarray, float]:
    """_added() over packs on the executors, one for each partition; the driver gets two numbers for each language and topic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if rows:
            (capped, free), gap = _added(_packed(pa.Table.from_batches(rows), step), lang, topic)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(capped))), pa.array(np.concatenate(([gap], capped))), pa.array(np.concatenate(([0.0], free)))], names=["k", "capped", "free"])

    out, worst = np.zeros((2, len(lang) + len(topic))), 0.0
    with small_rows(slim.sparkSession):
        rows = slim.repartition("source_key").mapInArrow(run, "k long, capped double, free double").groupBy("k").agg(F.sum("capped").alias("capped"), F.sum("free").alias("free"), F.max("capped").alias("most")).collect()
    for r in rows:
        if r.k < 0:
            worst = r.most
        else:
            out[:, r.k] = r.capped, r.free
    return out, worst


# Sampling.


def uniform(*by: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(F.lit("mix"), *by), F.lit(1 << 40)) / float(1 << 40)


MADE = ("_lm_topic", "_lm_tokens", "_lm_weight", "_lm_chance", "_lm_sampled")


def _sampled(documents: DataFrame, targets: Targets, topics: int, max_cells: int, keep: list[str], made: list[str]) -> DataFrame:
    """The columns keep and, under the names in made, what MADE lists."""
    # Columns go by number inside, so that no name of theirs meets one of ours.
    held = {c: f"_k{i}" for i, c in enumerate(dict.fromkeys([*keep, "text"]))}
    named = documents.select(*[F.col(f"`{c}`").alias(k) for c, k in held.items()], F.col("source").alias("_s"), F.col("lang").cast("string").alias("_l"), uniform(F.col("doc_id"), F.col("text")).alias("_u"))
    named = named.withColumnRenamed(held["text"], "text")
    kept = [held[c] if c != "text" else "text" for c in keep] + ["_s", "_l", "_u"]
    slim = [c for c in kept if c != "text"] if "text" not in keep else ["_s", "_l", "_u"]
    vectors = materialize(_vectors(named, slim))
    found = fit_topics(vectors, topics)
    with small_rows(documents.sparkSession, 4096):
        placed = materialize(_topics_of(vectors, found, slim))
    cells = placed.groupBy(F.col("_s").alias("source"), F.col("_l").alias("lang"), F.col("_lm_topic").alias("topic")).agg(F.sum("_lm_tokens").alias("tokens"))
    by, _ = chances(cells, targets, max_cells)
    by = by.toDF("_c_source", "_c_lang", "_c_topic", "_c_weight", "_c_chance")
    got = _with_topic(named, found, kept) if "text" in keep else placed
    same = got["_s"].eqNullSafe(by["_c_source"]) & got["_l"].eqNullSafe(by["_c_lang"]) & (got["_lm_topic"] == by["_c_topic"])
    some = F.col("_lm_tokens") > 0
    chance = F.when(some, F.col("_c_chance")).otherwise(1.0)
    values = (F.col("_lm_topic"), F.col("_lm_tokens"), F.when(some, F.col("_c_weight")).otherwise(0.0), chance, F.col("_u") < chance)
    return got.join(by, same).select(*[F.col(k).alias(c) for c, k in zip(keep, kept)], *[v.alias(n) for v, n in zip(values, made)])


def sample(documents: DataFrame, targets: Targets | None = None, topics: int = TOPICS, max_cells: int = MAX_CELLS, keep: list[str] | None = None) -> DataFrame:
    """The columns keep (all by default) with _lm_topic, _lm_tokens, _lm_weight, _lm_chance and _lm_sampled."""
    kept = [c for c in (documents.columns if keep is None else keep) if c.lower() not in MADE]
    return _sampled(documents, targets or Targets(), topics, max_cells, kept, list(MADE))


def mix(documents: DataFrame, targets: Targets | None = None) -> DataFrame:
    """The sampled documents, with the columns of documents."""
    made = free_names(documents.columns, *MADE)
    got = _sampled(documents, targets or Targets(), TOPICS, MAX_CELLS, documents.columns, made)
    return got.where(F.col(made[-1])).select(*columns_of(documents))


def report(cells: DataFrame, targets: Targets, by: DataFrame) -> DataFrame:
    """dimension, category, held (own share of all tokens), wanted and expected (share of the sample's expected tokens) of every category; by is that of chances()."""
    same = F.lit(True)
    for d in DIMS:
        same = same & cells[d].eqNullSafe(by[d])
    met = materialize(cells.join(by.select(*DIMS, "chance"), same).select(*[cells[d] for d in DIMS], "tokens", (F.col("tokens") * F.col("chance")).alias("e")))
    total = met.agg(F.sum("tokens").alias("t"), F.sum("e").alias("e")).first()
    out = None
    for d in DIMS:
        rows = met.groupBy(d).agg(F.sum("tokens").alias("t"), F.sum("e").alias("e")).where("t > 0")
        if d in targets.shares:
            listed = cells.sparkSession.createDataFrame([(k, max(0.0, float(v))) for k, v in targets.shares[d].items()], f"name {dict(cells.dtypes)[d]}, share double")
            rows = rows.join(listed, rows[d].eqNullSafe(listed["name"]), "left").withColumn("share", F.coalesce("share", F.lit(0.0))).drop("name")
        else:
            rows = rows.withColumn("share", F.pow(F.col("t") / total.t, F.lit(targets.flatten)))
        every = float(rows.agg(F.sum("share")).first()[0] or 1.0)
        part = rows.select(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("category"), (F.col("t") / (total.t or 1)).alias("held"), (F.col("share") / every).alias("wanted"), (F.col("e") / (total.e or 1)).alias("expected"))
        out = part if out is None else out.unionByName(part)
    return out
