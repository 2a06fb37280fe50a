"""Size-bounded chunks that carry their heading.

Blocks are grouped by the heading they stand under. A group that fits is one chunk; a larger one is cut where the summed cost of
the chunks' lengths is least. Small neighbours are merged. Sizes are in characters and include the heading, which every chunk of
its group repeats. All but two steps are expressions and windows over (doc_id); cutting a long text and the least-cost cut run as
Arrow-batched functions, and only on the rows that need them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.operators.blocks import HEADINGS, document_window, islands, with_active_heading, without_noise
from leafmill.operators.rollup import ordered_join
from leafmill.plans.staging import staged

#: Bounds of the sizes that a caller may ask for.
BOUNDS = {"most": (800, 8000), "optimal": (400, 4000), "soft": (200, 2000), "least": (100, 1000)}
#: Blocks of a group, and work estimate, up to which the least-cost cut is searched.
DP_BLOCKS, DP_WORK = 100, 800_000


@dataclass(frozen=True)
class Sizes:
    """Chunk sizes in characters; out-of-range ones are clamped, then put in order."""

    most: int = 3200
    optimal: int = 1500
    soft: int = 700
    least: int = 400

    def __post_init__(self) -> None:
        ceiling = None
        for name in ("most", "optimal", "soft", "least"):
            low, high = BOUNDS[name]
            value = min(max(int(getattr(self, name)), low), high)
            ceiling = value if ceiling is None else min(ceiling, value)
            object.__setattr__(self, name, ceiling)


# Cutting one long text.

_BREAKS = (("\n", True), (".!?", False), (",", False), (" ", True))


def break_near(text: str, at: int, reach: int = 200) -> int:
    """The best place to cut near at: after a new line, a sentence, a comma or a blank; nearer the front first, by kind."""
    if at >= len(text) or at <= 0:
        return min(max(at, 0), len(text))
    low, high = max(0, at - reach), min(len(text), at + reach)
    order = [*range(at, low - 1, -1), *range(at + 1, high)]
    for signs, consumed in _BREAKS:
        for i in order:
            if consumed and text[i] in signs:
                return i + 1
            if not consumed and i > 0 and text[i - 1] in signs and text[i] in " \n\t":
                return i
    return at


def split_text(text: str, most: int, target: int, soft: int) -> list[str]:
    """Parts of at most most characters, near target: packed paragraphs, else packed lines, else slices at good breaks."""
    if len(text) <= most:
        return [text]
    joiner = "\n\n" if "\n\n" in text else "\n" if "\n" in text else ""
    if joiner:
        parts, held = [], ""
        for unit in filter(None, text.split(joiner)):
            if len(unit) > most:
                parts += [held] * bool(held) + split_text(unit, most, target, soft)
                held = ""
                continue
            grown = len(held) + len(joiner) * bool(held) + len(unit)
            if held and (grown > most or len(held) >= max(soft, target) and grown > target + target // 2):
                parts.append(held)
                held = ""
            held = f"{held}{joiner}{unit}" if held else unit
        parts += [held] * bool(held)
        if len(parts) > 1 and len(parts[-1]) < soft and len(parts[-2]) + len(joiner) + len(parts[-1]) <= most:
            parts[-2:] = [joiner.join(parts[-2:])]
        return parts
    parts, at, step = [], 0, min(most, max(1, target))
    while len(text) - at > step:
        end = break_near(text, at + step)
        end = end if at < end <= at + most else at + step
        parts.append(text[at:end])
        at = end
    parts.append(text[at:])
    if len(parts) > 1 and 0 < (need := soft - len(parts[-1])) and len(parts[-2]) - need >= soft:
        parts[-2:] = [parts[-2][:-need], parts[-2][-need:] + parts[-1]]
    return [p for p in parts if p]


def split_column(sizes: Sizes):
    @F.pandas_udf("array<string>")
    def split(texts: pd.Series, budget: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else split_text(t, int(b), min(sizes.optimal, int(b)), min(sizes.soft, int(b))) for t, b in zip(texts, budget)], dtype=object)

    return split


def in_parts(df: DataFrame, long: Column, budget: Column, sizes: Sizes) -> DataFrame:
    """df with the texts of long rows cut (part from 1), others whole (part 0). Only long texts travel to Python."""
    cut = df.withColumns({"_long": long, "_parts": split_column(sizes)(F.when(long, F.col("text")), budget)})
    shown = F.when(F.col("_long"), F.col("_parts")).otherwise(F.array("text"))
    out = cut.select(*[c for c in df.columns if c != "text"], "_long", F.posexplode(shown).alias("part", "text"))
    return out.withColumn("part", F.when(F.col("_long"), F.col("part") + 1).otherwise(0)).drop("_long")


# Cutting a group of blocks.


def length_cost(length: np.ndarray, sizes: Sizes) -> np.ndarray:
    cost = (length - sizes.optimal) ** 2.0
    short = np.maximum(0, sizes.soft - length) ** 2.0 * 5 * (length >= sizes.least) + np.maximum(0, sizes.least - length) ** 2.0 * 50
    return np.where(length > sizes.most, np.inf, cost + short)


def greedy_cut(lengths: list[int], heading: int, sizes: Sizes) -> list[int]:
    """Chunk number of each block: a chunk closes before it would pass the optimal size."""
    out, number, held = [], 1, 0
    for n in lengths:
        if held and (heading + held + n > sizes.optimal):
            number, held = number + 1, 0
        out.append(number)
        held += n
    return out


def least_cost_cut(lengths: list[int], heading: int, sizes: Sizes) -> list[int]:
    """Chunk number of each block in the cut into contiguous chunks of least cost; the fewest chunks of equals. Without a finite cost, and for large groups, the greedy cut."""
    n = len(lengths)
    ends = np.concatenate(([0], np.cumsum(lengths)))
    total = heading + int(ends[-1])
    low = max(1, -(-total // sizes.most))
    high = max(low, min(n, -(-total // sizes.optimal) + 1))
    if n > DP_BLOCKS or high * high * n > DP_WORK:
        return greedy_cut(lengths, heading, sizes)
    # cost[j, i]: one chunk of blocks j to i - 1. One table of the best cuts serves every number of chunks.
    span = heading + ends[None, :] - ends[:, None]
    cost = np.where(np.arange(n + 1)[:, None] < np.arange(n + 1)[None, :], length_cost(span.astype(float), sizes), np.inf)
    best, back = np.full(n + 1, np.inf), []
    best[0] = 0
    finals = []
    for _ in range(min(high, n)):
        through = best[:, None] + cost
        back.append(through.argmin(axis=0))
        best = through.min(axis=0)
        finals.append(best[n])
    options = [(c, k) for k, c in enumerate(finals, start=1) if k >= low and np.isfinite(c)]
    if not options:
        return greedy_cut(lengths, heading, sizes)
    k, at, out = min(options)[1], n, np.zeros(n, dtype=int)
    for layer in range(k - 1, -1, -1):
        start = int(back[layer][at])
        out[start:at] = layer + 1
        at = start
    return out.tolist()


def greedy_fold(lengths: Column, heading: Column, sizes: Sizes) -> Column:
    """The greedy cut as an expression over an array of lengths."""

    def step(acc: Column, n: Column) -> Column:
        turn = (acc["held"] > 0) & (heading + acc["held"] + n > sizes.optimal)
        number = acc["number"] + F.when(turn, 1).otherwise(0)
        return F.struct(number.alias("number"), F.when(turn, n).otherwise(acc["held"] + n).alias("held"), F.concat(acc["out"], F.array(number)).alias("out"))

    zero = F.struct(F.lit(1).alias("number"), F.lit(0).cast("long").alias("held"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(lengths, zero, step, lambda a: a["out"])


def cut_column(sizes: Sizes):
    @F.pandas_udf("array<int>")
    def cut(lengths: pd.Series, heading: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else least_cost_cut([int(x) for x in v], int(h), sizes) for v, h in zip(lengths, heading)], dtype=object)

    return cut


def assign_chunks(blocks: DataFrame, sizes: Sizes = Sizes(), exact: bool = True) -> DataFrame:
    """Blocks without noise, long ones in parts (part from 1, else 0), with active_heading_id, is_heading and chunk_index from 1 in each document.

    blocks has doc_id, block_id, ord, block_type, text and heading_id. The rows of a heading group travel as one array, so no
    join brings the cuts back. Without exact, all cuts are greedy and stay expressions.
    """
    df = without_noise(with_active_heading(blocks))
    df = df.withColumns({"is_heading": F.coalesce(F.col("block_type").isin(*HEADINGS), F.lit(False)), "text": F.coalesce("text", F.lit(""))})
    group = Window.partitionBy("doc_id", "active_heading_id")
    size = F.length("text").cast("long")
    df = df.withColumn("heading_chars", F.coalesce(F.sum(F.when(F.col("is_heading"), size)).over(group), F.lit(0)))
    df = df.withColumn("_budget", F.greatest(F.lit(sizes.least).cast("long"), sizes.most - F.col("heading_chars")))
    df = in_parts(df, ~F.col("is_heading") & (size > F.col("_budget")), F.col("_budget"), sizes).drop("_budget").withColumn("embed_char_count", size)
    held = [c for c in df.columns if c not in ("doc_id", "active_heading_id", "heading_chars", "ord", "part")]
    packed = df.groupBy("doc_id", "active_heading_id", "heading_chars").agg(F.array_sort(F.collect_list(F.struct("ord", "part", F.struct(*held).alias("r")))).alias("rows"))
    body = F.filter("rows", lambda x: ~x["r"]["is_heading"])
    packed = packed.withColumns({"_lens": F.transform(body, lambda x: x["r"]["embed_char_count"]), "_heads": F.filter("rows", lambda x: x["r"]["is_heading"]), "_body": body})
    total = F.col("heading_chars") + F.aggregate("_lens", F.lit(0).cast("long"), lambda a, n: a + n)
    over = F.when(total > sizes.most, F.col("_lens"))
    packed = packed.withColumn("_cut", cut_column(sizes)(over, "heading_chars") if exact else F.when(total > sizes.most, greedy_fold(F.col("_lens"), F.col("heading_chars"), sizes)))
    numbered = F.transform("_body", lambda x, i: F.struct(x.alias("x"), F.coalesce(F.get("_cut", i), F.lit(1)).alias("cut")))
    every = F.concat(F.transform("_heads", lambda x: F.struct(x.alias("x"), F.lit(1).alias("cut"))), numbered)
    rows = packed.select("doc_id", "active_heading_id", "heading_chars", F.get("rows", F.lit(0))["ord"].alias("_group"), F.inline(every))
    rows = rows.select("doc_id", "active_heading_id", "heading_chars", "_group", "cut", "x.ord", "x.part", "x.r.*")
    return rows.withColumn("chunk_index", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("_group", "cut")).cast("long")).drop("_group", "cut")


def hybrid_parts(text: Column, hybrid: Column) -> tuple[Column, Column]:
    """Heading and body of a paragraph that opens with its heading."""
    head = F.coalesce(F.nullif(hybrid, F.lit("")), text)
    return head, F.when(text.startswith(F.trim(head)), F.trim(F.substring(text, F.length(F.trim(head)) + 1, F.length(text)))).otherwise("")


def chunks(assigned: DataFrame) -> DataFrame:
    """Chunks of assign_chunks(): chunk_heading, heading_id, parent_heading_id, page_number, text (heading first) and embed_char_count."""
    for name, kind in (("hybrid_heading_text", "string"), ("parent_heading_id", "long"), ("heading_level", "long"), ("page_number", "long"), ("section", "string"), ("table_id", "string")):
        if name not in assigned.columns:
            assigned = assigned.withColumn(name, F.lit(None).cast(kind))
    head, body = hybrid_parts(F.coalesce("text", F.lit("")), F.col("hybrid_heading_text"))
    hybrid = F.col("block_type") == "hybrid_heading_paragraph"
    df = assigned.withColumns({"_head": F.when(F.col("is_heading"), F.when(hybrid, head).otherwise(F.col("text"))), "_body": F.when(F.col("is_heading"), F.when(hybrid, F.nullif(body, F.lit("")))).otherwise(F.col("text"))})
    order = F.struct("ord", "part")
    group = Window.partitionBy("doc_id", "active_heading_id")
    lead = lambda c: F.min_by(c, F.when(F.col("is_heading"), F.col("ord"))).over(group)
    df = df.withColumns({"chunk_heading": lead("_head"), "parent_heading_id": lead("parent_heading_id"), "heading_level": lead("heading_level")})
    shown = F.when(F.trim("_body") != "", F.col("_body"))
    out = df.groupBy("doc_id", "chunk_index").agg(
        *[F.first(c).alias(n) for c, n in (("active_heading_id", "heading_id"), ("parent_heading_id", "parent_heading_id"), ("heading_level", "heading_level"), ("chunk_heading", "chunk_heading"))],
        F.min_by("page_number", order).alias("page_number"),
        F.min_by("section", order).alias("section"),
        F.array_sort(F.collect_set("table_id")).alias("table_ids"),
        F.bool_or(F.coalesce(F.col("block_type") == "table", F.lit(False))).alias("contains_table"),
        ordered_join(shown, order, "\n\n").alias("_content"),
    )
    titled = F.when(F.coalesce("chunk_heading", F.lit("")) != "", F.concat(F.lit("## "), F.col("chunk_heading")))
    text = F.concat_ws("\n\n", titled, F.nullif(F.col("_content"), F.lit("")))
    return with_size(out.withColumn("text", text).drop("_content"))


def with_size(df: DataFrame) -> DataFrame:
    """embed_char_count, and token_count as a fourth of it."""
    return df.withColumn("embed_char_count", F.length("text").cast("long")).withColumn("token_count", F.floor(F.col("embed_char_count") / 4))


def merge_plan(chunks_df: DataFrame, sizes: Sizes = Sizes(), least_children: int = 2) -> DataFrame:
    """chunks with merge_key and merge_mode (null: stays as it is).

    A heading's first chunk takes all chunks of its children if each is small and a leaf and the sum fits. Else runs of at least
    two small leaf siblings with adjacent numbers merge if the whole run fits. The plan is made of numbers alone; texts move once, by
    document, and merged() needs no more.
    """
    df = chunks_df.select("doc_id", "chunk_index", "heading_id", "parent_heading_id", "embed_char_count")
    parents = df.where("parent_heading_id IS NOT NULL").select("doc_id", F.col("parent_heading_id").alias("heading_id")).distinct().withColumn("_parent", F.lit(True))
    df = df.join(parents, ["doc_id", "heading_id"], "left").withColumns({"_leaf": F.col("_parent").isNull(), "_tiny": F.col("embed_char_count") < sizes.soft}).drop("_parent")
    first = F.row_number().over(Window.partitionBy("doc_id", "heading_id").orderBy("chunk_index")) == 1
    df = df.withColumn("_first", first & F.col("heading_id").isNotNull())
    families = df.where("parent_heading_id IS NOT NULL").groupBy("doc_id", "parent_heading_id").agg(F.bool_and(F.col("_tiny") & F.col("_leaf")).alias("_all"), F.sum("embed_char_count").alias("_sum"))
    heads = df.where("_first").select("doc_id", F.col("heading_id").alias("parent_heading_id"), F.col("embed_char_count").alias("_own"))
    whole = families.join(heads, ["doc_id", "parent_heading_id"]).where(F.col("_all") & (F.col("_sum") + F.col("_own") <= sizes.most)).select("doc_id", F.col("parent_heading_id").alias("_family"))
    up = whole.withColumnRenamed("_family", "parent_heading_id").withColumn("_a", F.lit(True))
    own = whole.withColumnRenamed("_family", "heading_id").withColumn("_b", F.lit(True))
    df = df.join(up, ["doc_id", "parent_heading_id"], "left").join(own, ["doc_id", "heading_id"], "left")
    joins_own = F.col("_b").isNotNull() & F.col("_first")
    df = df.withColumn("_whole", F.when(joins_own, F.col("heading_id")).when(F.col("_a").isNotNull(), F.col("parent_heading_id")))
    sibling = Window.partitionBy("doc_id", "parent_heading_id").orderBy("chunk_index")
    small = F.col("_tiny") & F.col("_leaf") & F.col("_whole").isNull() & F.col("parent_heading_id").isNotNull()
    starts = ~F.coalesce(F.lag(small).over(sibling) & (F.lag("chunk_index").over(sibling) == F.col("chunk_index") - 1), F.lit(False))
    df = df.withColumn("_starts", starts).withColumn("_run", islands(F.col("_starts"), sibling))
    run = Window.partitionBy("doc_id", "parent_heading_id", "_run", small)
    tail = small & (F.count(F.lit(1)).over(run) >= least_children) & (F.sum("embed_char_count").over(run) <= sizes.most)
    mode = F.when(F.col("_whole").isNotNull(), "parent_plus_children").when(tail, "children_tail")
    key = F.when(F.col("_whole").isNotNull(), F.concat(F.lit("p"), F.col("_whole"))).when(tail, F.concat_ws("-", F.lit("c"), F.col("parent_heading_id"), F.col("_run")))
    plan = df.select("doc_id", "chunk_index", key.alias("merge_key"), mode.alias("merge_mode")).where("merge_mode IS NOT NULL")
    plan = plan.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("chunk_index", F.struct("merge_key", "merge_mode")))).alias("_plan"))
    own = F.try_element_at("_plan", F.col("chunk_index"))
    return chunks_df.repartition("doc_id").join(plan, "doc_id", "left").withColumns({c: own[c] for c in ("merge_key", "merge_mode")}).select(*chunks_df.columns, "merge_key", "merge_mode")


def merged(planned: DataFrame) -> DataFrame:
    """Chunks after the plan: texts of a group joined by a blank line, headings by a bar; numbers run from 1 again."""
    key = F.coalesce("merge_key", F.concat(F.lit("s"), F.col("chunk_index")))
    w = F.col("chunk_index")
    firsts = [F.min_by(c, w).alias(c) for c in planned.columns if c not in ("doc_id", "chunk_index", "text", "chunk_heading", "merge_key", "merge_mode", "embed_char_count", "token_count", "table_ids", "contains_table")]
    out = planned.groupBy("doc_id", key.alias("_key")).agg(
        F.min("chunk_index").alias("chunk_index"),
        *firsts,
        F.max("merge_mode").alias("merge_mode"),
        F.array_distinct(F.flatten(F.collect_list("table_ids"))).alias("table_ids"),
        F.bool_or("contains_table").alias("contains_table"),
        ordered_join(F.nullif(F.col("chunk_heading"), F.lit("")), w, " | ").alias("chunk_heading"),
        ordered_join(F.nullif(F.col("text"), F.lit("")), w, "\n\n").alias("text"),
    )
    return with_size(out.drop("_key").withColumn("chunk_index", F.row_number().over(document_window("chunk_index")).cast("long")))


def enforce_most(chunks_df: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    """Chunks over the ceiling in parts; numbers run from 1 again."""
    out = in_parts(chunks_df, F.col("embed_char_count") > sizes.most, F.lit(sizes.most), sizes)
    return with_size(out.withColumn("chunk_index", F.row_number().over(document_window("chunk_index", "part")).cast("long")).drop("part"))


def with_chunk_id(chunks_df: DataFrame) -> DataFrame:
    """chunk_id from content and place, so that a repeated task gives the same."""
    return chunks_df.withColumn("chunk_id", F.sha2(F.concat_ws("|", "doc_id", "chunk_index", "text"), 256))


def with_ids(chunks_df: DataFrame) -> DataFrame:
    """chunk_id; parent_chunk_id is the first chunk of the parent heading."""
    df = with_chunk_id(chunks_df)
    first = df.where("heading_id IS NOT NULL").groupBy("doc_id", F.col("heading_id").alias("parent_heading_id")).agg(F.min_by("chunk_id", "chunk_index").alias("parent_chunk_id"))
    return df.join(first, ["doc_id", "parent_heading_id"], "left")


def build(blocks: DataFrame, sizes: Sizes = Sizes(), merge_small: bool = True, exact: bool = True, parents: bool = True) -> DataFrame:
    """Blocks to chunks, all steps. Chunks are staged before the plan of merges and before parent_chunk_id, which both read them more than once; without parents it is left out, and texts are neither written nor joined for it."""
    out = chunks(assign_chunks(blocks, sizes, exact))
    if merge_small:
        out = merged(merge_plan(staged(out), sizes))
    out = enforce_most(out, sizes)
    return with_ids(staged(out)) if parents else with_chunk_id(out)
