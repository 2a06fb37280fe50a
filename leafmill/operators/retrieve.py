"""Queries over chunks and headings: search, snippets, outlines, sections, pages.

Everything is keyed by document. Searches read texts once and score chunks where they are (postings); reading and outlines are joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import text as tx
from leafmill.operators import postings
from leafmill.plans.staging import staged

SNIPPET = 320
SKIPPED_SECTIONS = ("toc", "header", "footer", "coverpage")
#: Token bounds below which a document is served whole.
WHOLE, CEILING = 6_000, 12_000


def term_counts(chunks: DataFrame, by: list[str]) -> DataFrame:
    """by, term and tf of every term of every chunk."""
    return chunks.select(*by, F.explode(tx.search_terms("text")).alias("term")).groupBy(*by, "term").agg(F.count(F.lit(1)).alias("tf"))


def bm25(chunks: DataFrame, queries: DataFrame, corpus: list[str], key: str = "chunk_index") -> DataFrame:
    """query_id, corpus columns, key and score of each chunk that shares a term with a query.

    corpus names the columns whose chunks are scored against each other: ["doc_id"] for one document, [] for all; key names one
    chunk of its corpus. A chunk's terms stay together, so its scores are summed where it is and no pair travels.
    """
    by = [*corpus, key]
    made = [postings.hits(chunks, asked, corpus, key, literal=False).select("query_id", *by, "score") for asked in postings.packs(queries, literal_pattern(F.col("text")))]
    return reduce(DataFrame.unionByName, made) if made else _none(chunks, queries, by).select("query_id", *by, "score")


def _none(chunks: DataFrame, queries: DataFrame, by: list[str]) -> DataFrame:
    """No hit, in the form of hits."""
    return queries.select("query_id").crossJoin(chunks.select(*by)).where(F.lit(False)).withColumns({"score": F.lit(0.0), "literal": F.lit(False), "_best": F.lit(0.0)})


def literal_pattern(query: Column) -> Column:
    """A whole-word pattern of the query; boundaries stand only at ends that are word characters."""
    q = tx.strip(query)
    head = F.when(q.rlike(r"^[\p{L}\p{N}_]"), r"\b").otherwise("")
    tail = F.when(q.rlike(r"[\p{L}\p{N}_]$"), r"\b").otherwise("")
    return F.when(q != "", F.concat(F.lit("(?iuU)"), head, F.lit(r"\Q"), F.replace(q, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"), tail))


def literal_hits(chunks: DataFrame, queries: DataFrame, corpus: list[str], key: str = "chunk_index") -> DataFrame:
    """query_id, corpus columns and key of chunks that hold a query as it stands.

    A chunk must hold the query's longest term, or its longest word if it has stop words only, so candidates come from a join; a
    query without a word has none.
    """
    longest = lambda words: F.get(F.array_sort(F.transform(words, lambda t: F.struct((-F.length(t)).alias("l"), t.alias("t")))), F.lit(0))["t"]
    q = queries.select("query_id", F.col("text").alias("_query"), F.coalesce(longest(tx.search_terms("text")), longest(tx.search_words("text"))).alias("term")).where("term IS NOT NULL")
    held = chunks.select(*corpus, key, "text", F.explode(F.array_distinct(tx.search_words("text"))).alias("term"))
    return held.join(q, "term").where(F.regexp_like(F.col("text"), literal_pattern(F.col("_query")))).select("query_id", *corpus, key)


def anchor(text: Column, query: Column) -> Column:
    """Where a snippet centres, from 0: the query as it stands, else its longest term that occurs."""
    at = F.regexp_instr(text, literal_pattern(query))
    longest = F.array_sort(F.transform(F.array_distinct(tx.search_terms(query)), lambda t: F.struct((-F.length(t)).alias("l"), t.alias("t"))))
    # The folded text is an argument, so that it is made once and not for each term.
    within = lambda low: F.filter(F.transform(longest, lambda t: F.instr(low, t["t"])), lambda p: p > 0)
    spots = F.get(F.transform(F.array(tx.folded(text)), within), F.lit(0))
    return F.when(F.coalesce(at, F.lit(0)) > 0, at - 1).when(F.size(spots) > 0, F.get(spots, F.lit(0)) - 1).otherwise(0)


def snippet(text: Column, at: Column, width: int = SNIPPET) -> Column:
    """A window of the text around at, cut at blanks and marked where it is cut."""
    n = F.length(text)
    low = F.greatest(F.lit(0), at - width // 3)
    high = F.least(n, low + width)
    lead = F.instr(F.substring(text, low + 1, at + 1 - low), " ")
    start = F.when((low > 0) & (lead > 0), low + lead).otherwise(low)
    tail = F.substring(text, at + 1, high - at)
    last = F.instr(F.reverse(tail), " ")
    end = F.when((high < n) & (last > 0), high - last).otherwise(high)
    cut = F.concat(F.when(start > 0, "… ").otherwise(""), tx.strip(F.substring(text, start + 1, end - start)), F.when(end < n, " …").otherwise(""))
    return F.when(n <= width, tx.strip(text)).otherwise(cut)


def search(chunks: DataFrame, queries: DataFrame, corpus: list[str], limit: int = 8, key: str = "chunk_index", heading: str | None = None, snippets: bool = True) -> DataFrame:
    """The best chunks of each query: literal matches first, then by score, then in order; one for each heading if it is named; limit of them, numbered by rank, with a snippet unless told otherwise.

    Each task keeps the best of its chunks, and only these meet; with a heading all hits do.
    """
    if "section" in chunks.columns:
        chunks = chunks.where(~F.coalesce(F.col("section").isin(*SKIPPED_SECTIONS), F.lit(False)))
    texts, chunks = chunks, chunks.where(F.col("text").rlike(r"(?U)\S"))
    by = ["query_id", *corpus, key]
    made = [postings.hits(chunks, asked, corpus, key, True, None if heading else limit) for asked in postings.packs(queries, literal_pattern(F.col("text")))]
    hits = reduce(DataFrame.unionByName, made) if made else _none(chunks, queries, by[1:])
    # Sums differ in their last digits by the order of their terms; equal scores go by order.
    best = [F.desc("literal"), F.desc("_best"), *corpus, key]
    if heading:
        hits = hits.join(chunks.select(*corpus, key, heading), [*corpus, key])
        own = Window.partitionBy("query_id", *corpus, heading).orderBy(*best)
        hits = hits.withColumn("_k", F.row_number().over(own)).where("_k = 1").drop("_k")
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*best))).where(F.col("rank") <= limit).drop("_best")
    if not snippets:
        return ranked
    # Written, so that Spark knows how few they are when it plans how texts meet them.
    shown = staged(ranked, "ranked").join(texts.select(*corpus, key, "text"), [*corpus, key]).join(queries.select("query_id", F.col("text").alias("_query")), "query_id")
    # The place is found once; a snippet refers to it many times.
    return shown.withColumn("_at", anchor(F.col("text"), F.col("_query"))).withColumn("snippet", snippet(F.col("text"), F.col("_at"))).drop("_query", "_at", "text")


def unmatched_terms(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id and term of query terms that no chunk holds."""
    asked = queries.select("query_id", F.explode(F.array_distinct(tx.search_terms("text"))).alias("term"))
    return asked.join(term_counts(chunks, []), "term", "left_anti")


# Heading trees: doc_id, heading_id, parent_heading_id, text, ord.


def with_paths(headings: DataFrame) -> DataFrame:
    """headings with path (texts), ids (heading ids from the root), depth from 1 and preorder key.

    Parents are looked up level by level, for as many levels as there are. A parent that is missing makes its children roots; of a
    cycle no member is reached, so each becomes a root. Levels are written once, so deep trees have no deep plan.
    """
    h = headings.select("doc_id", "heading_id", "parent_heading_id", "text", "ord")
    known = h.select("doc_id", F.col("heading_id").alias("parent_heading_id")).distinct().withColumn("_known", F.lit(True))
    h = h.join(known, ["doc_id", "parent_heading_id"], "left").withColumn("parent_heading_id", F.when(F.col("_known"), F.col("parent_heading_id"))).drop("_known")
    root = h.where("parent_heading_id IS NULL")
    shape = lambda df: df.select("doc_id", "heading_id", "parent_heading_id", "text", "ord", F.array("text").alias("path"), F.array("heading_id").alias("ids"), F.array("ord").alias("preorder"))
    level, rest = staged(shape(root)), staged(h.where("parent_heading_id IS NOT NULL"))
    levels = [level]
    while True:
        up = level.select("doc_id", F.col("heading_id").alias("parent_heading_id"), F.col("path").alias("_path"), F.col("ids").alias("_ids"), F.col("preorder").alias("_pre"))
        below = rest.join(up, ["doc_id", "parent_heading_id"]).where(~F.array_contains("_ids", F.col("heading_id")))
        level = staged(below.select("doc_id", "heading_id", "parent_heading_id", "text", "ord", F.array_append("_path", F.col("text")).alias("path"), F.array_append("_ids", F.col("heading_id")).alias("ids"), F.array_append("_pre", F.col("ord")).alias("preorder")))
        if not level.take(1):
            break
        levels.append(level)
    reached = reduce(DataFrame.unionByName, levels)
    lost = rest.join(reached.select("doc_id", "heading_id"), ["doc_id", "heading_id"], "left_anti")
    return reached.unionByName(shape(lost)).withColumn("depth", F.size("ids"))


def breadcrumb(path: Column) -> Column:
    """One line for each ancestor, with as many number signs as its depth."""
    return F.array_join(F.transform(path, lambda t, i: F.concat(F.repeat(F.lit("#"), i + 1), F.lit(" "), t)), "\n")


def level(paths: DataFrame, n: int, parent: int | None = None) -> DataFrame:
    """Headings at depth n, below parent if one is given."""
    at = paths.where(F.col("depth") == n)
    return at if parent is None else at.where(F.array_contains(F.slice("ids", 1, F.greatest(F.size("ids") - 1, F.lit(0))), parent))


def find_heading(paths: DataFrame, text: str, case_sensitive: bool = False) -> DataFrame:
    return paths.where(F.col("text").contains(text) if case_sensitive else F.lower("text").contains(text.lower()))


def resolve(paths: DataFrame, query: str) -> DataFrame:
    """Headings that "A > B" names: B exactly, else as a part, under headings that hold A, in order."""
    *above, leaf = [p.strip() for p in query.split(" > ")]
    named = paths.where(tx.folded("text").contains(leaf.casefold()))
    own = F.transform("path", lambda p: tx.folded(p))

    def walk(acc: Column, p: Column) -> Column:
        want = F.get(F.array(*[F.lit(a.casefold()) for a in above]) if above else F.array().cast("array<string>"), acc)
        return acc + F.when(want.isNotNull() & p.contains(want), 1).otherwise(0)

    named = named.where(F.aggregate(own, F.lit(0), walk) >= len(above)) if above else named
    exact = (tx.folded(tx.strip("text")) == leaf.casefold()).cast("int")
    best = F.max(exact).over(Window.partitionBy("doc_id"))
    return named.withColumn("_exact", exact).withColumn("_best", best).where("_exact = _best").drop("_exact", "_best")


def under(rows: DataFrame, paths: DataFrame, chosen: DataFrame, recursive: bool = True) -> DataFrame:
    """Rows (chunks, blocks, tables, charts by heading_id) under the chosen headings, with their subsections unless told otherwise."""
    if not recursive:
        return rows.join(chosen.select("doc_id", "heading_id").distinct(), ["doc_id", "heading_id"], "left_semi")
    inside = paths.select("doc_id", "heading_id", F.explode("ids").alias("_top")).join(chosen.select("doc_id", F.col("heading_id").alias("_top")).distinct(), ["doc_id", "_top"], "left_semi")
    return rows.join(inside.select("doc_id", "heading_id").distinct(), ["doc_id", "heading_id"], "left_semi")


def drop_nested(chosen: DataFrame) -> DataFrame:
    """Chosen headings (with ids) without those that stand below another chosen one."""
    above = chosen.select("doc_id", "heading_id", F.explode(F.slice("ids", 1, F.greatest(F.size("ids") - 1, F.lit(0)))).alias("_up"))
    nested = above.join(chosen.select("doc_id", F.col("heading_id").alias("_up")), ["doc_id", "_up"], "left_semi")
    return chosen.join(nested.select("doc_id", "heading_id").distinct(), ["doc_id", "heading_id"], "left_anti")


def hit_heading(path: Column, text: Column, at: Column) -> Column:
    """The path of the heading that a hit at place at (from 0) of a chunk stands under, as resolve() reads it: of a merged chunk's headings the one whose part holds the place."""
    named = F.transform(path, lambda p: F.trim(F.regexp_replace(p, "^#+", "")))
    parts = F.split(F.element_at(named, -1), r" \| ")
    begins = F.transform(parts, lambda p: F.struct(F.trim(p).alias("p"), (F.instr(text, F.concat(F.lit("## "), F.trim(p))) - 1).alias("s")))
    rest = lambda x: F.instr(F.substring(text, x["s"] + F.length(x["p"]) + 4, F.length(text)), "\n## ")
    stop = lambda x: F.when(rest(x) > 0, x["s"] + F.length(x["p"]) + 2 + rest(x)).otherwise(F.length(text))
    held = F.filter(begins, lambda x: (x["s"] >= 0) & (x["s"] <= at) & (at < stop(x)))
    own = F.when(F.size(parts) < 2, F.element_at(named, -1)).otherwise(F.coalesce(F.get(held, F.lit(0))["p"], F.trim(F.get(parts, F.lit(0)))))
    return F.when(F.size(path) > 0, F.array_join(F.concat(F.slice(named, 1, F.size(named) - 1), F.array(own)), " > ")).otherwise("")


def read(blocks: DataFrame, paths: DataFrame, requests: list[str]) -> DataFrame:
    """doc_id and text of what stands under the requested headings, subsections included, each block once: "A > B" names a heading under others. Blocks carry heading_id."""
    named = reduce(DataFrame.unionByName, [resolve(paths, r) for r in requests]).dropDuplicates(["doc_id", "heading_id"])
    return rendered(under(blocks, paths, drop_nested(named)))


def outline_tool(paths: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_id and text: a line for each heading with what reading it costs."""
    lines = outline_costs(paths, blocks)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("preorder", "line"))), lambda x: x["line"])
    return lines.groupBy("doc_id").agg(F.array_join(parts, "\n").alias("text"))


def by_page(rows: DataFrame, page) -> DataFrame:
    """Rows on a page, by number or by printed label."""
    if isinstance(page, int):
        return rows.where(F.col("page_number") == page)
    return rows.where(F.col("page_label") == page)


def outline_costs(paths: DataFrame, blocks: DataFrame) -> DataFrame:
    """Headings in reading order with tokens (subsections included) and a printable line."""
    own = blocks.groupBy("doc_id", "heading_id").agg(F.sum("token_count").alias("tokens"))
    above = paths.select("doc_id", "heading_id", F.explode("ids").alias("_top"))
    sums = above.join(own, ["doc_id", "heading_id"]).groupBy("doc_id", F.col("_top").alias("heading_id")).agg(F.sum("tokens").alias("tokens"))
    out = paths.join(sums, ["doc_id", "heading_id"], "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    line = F.concat(F.repeat(F.lit("  "), F.col("depth") - 1), F.lit("- "), F.col("text"), F.lit("  ~"), tx.human_tokens(F.col("tokens")))
    return out.withColumn("line", line)


def serve_whole(documents: DataFrame, budget: int = WHOLE, ceiling: int = CEILING) -> DataFrame:
    """documents (tokens, headings, outline_chars) with whole: small ones, and middling ones whose outline says little."""
    t = F.col("tokens")
    poor = (F.col("headings") < 3) | (F.floor(F.col("outline_chars") / 4) * 4 >= t)
    return documents.withColumn("whole", (F.lit(budget) > 0) & ((t <= budget) | ((t <= min(ceiling, 2 * budget)) & poor)))


def rendered(blocks: DataFrame) -> DataFrame:
    """doc_id and text: blocks in order under "## " headings, with a "[Page X]" line where the page turns. Furniture is left out."""
    from leafmill.operators.blocks import HEADINGS, NOISE

    kept = blocks.where(~F.coalesce(F.col("block_type").isin(*NOISE), F.lit(False)) & (tx.strip("text") != ""))
    w = Window.partitionBy("doc_id").orderBy("ord")
    turn = ~F.col("page_number").eqNullSafe(F.lag("page_number").over(w)) | F.lag("ord").over(w).isNull()
    page = F.coalesce("page_label", F.col("page_number").cast("string"))
    body = F.when(F.col("block_type").isin(*HEADINGS), F.concat(F.lit("## "), tx.strip("text"))).otherwise(tx.strip("text"))
    marked = kept.withColumn("_turn", turn).withColumn("_t", F.concat(F.when(F.col("_turn"), F.concat(F.lit("[Page "), page, F.lit("]\n\n"))).otherwise(""), body))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("ord", "_t"))), lambda x: x["_t"])
    return marked.groupBy("doc_id").agg(F.array_join(parts, "\n\n").alias("text"))


def joined_chunks(chunks: DataFrame) -> DataFrame:
    """doc_id and text: chunks in order, without headings that repeat the one before."""
    w = Window.partitionBy("doc_id").orderBy("chunk_index")
    head = F.when(F.col("text").startswith("## "), F.substring_index("text", "\n\n", 1))
    seen = F.last(head, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rest = F.when(F.instr("text", "\n\n") > 0, F.substring(F.col("text"), F.instr("text", "\n\n") + 2, F.length("text"))).otherwise("")
    own = chunks.withColumn("_t", F.when(head == seen, rest).otherwise(F.col("text")))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "_t"))), lambda x: x["_t"])
    return own.groupBy("doc_id").agg(F.array_join(F.filter(parts, lambda t: t != ""), "\n\n").alias("text"))


def prune_plan(files: DataFrame, limit_bytes: int) -> DataFrame:
    """Stored documents (path, size, mtime) that go so that the most recent within limit_bytes stay. Sizes are summed by day first, so the running sum over days is short; only the day of the cut is ranked."""
    day = F.to_date("mtime")
    days = files.groupBy(day.alias("day")).agg(F.sum("size").alias("size"))
    newer = Window.orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)
    before = days.withColumn("before", F.coalesce(F.sum("size").over(newer), F.lit(0))).select("day", "before")
    own = Window.partitionBy("day").orderBy(F.desc("mtime"), "path").rowsBetween(Window.unboundedPreceding, 0)
    held = files.withColumn("day", day).join(before, "day").withColumn("_sum", F.col("before") + F.sum("size").over(own))
    return held.where(F.col("_sum") > limit_bytes).select("path", "size", "mtime")
