"""Roll-up of a level to its parent: how each column aggregates is declared once and compiled to one groupBy.

Policies (nulls are blanks): FIRST non-null in row order; MIN, MAX, SUM; ANY true; DOMINANT, the value of the row with the most
characters, null or not, the first of equals; LIST in order; SORTED_UNIQUE_LIST; UNIQUE_LIST in order of first appearance,
flattened; MERGE_MAPS, where later keys win; WEIGHTED_RATIO by characters; DROP.
"""

from __future__ import annotations

from collections.abc import Callable
from enum import Enum

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Agg(Enum):
    FIRST = "first"
    MIN = "min"
    MAX = "max"
    SUM = "sum"
    ANY = "any"
    DOMINANT = "dominant"
    LIST = "list"
    SORTED_UNIQUE_LIST = "sorted_unique_list"
    UNIQUE_LIST = "unique_list"
    MERGE_MAPS = "merge_maps"
    WEIGHTED_RATIO = "weighted_ratio"
    DROP = "drop"


REGISTRY: dict[str, Agg] = (
    dict.fromkeys(("doc_id", "page_number", "page_label", "block_type", "section", "heading_id", "parent_heading_id", "heading_level", "heading_type", "heading_source", "layout_id", "table_id", "chart_id", "list_label", "section_id", "slide_index"), Agg.FIRST)
    | dict.fromkeys(("x_left", "y_top", "line_gap"), Agg.MIN)
    | dict.fromkeys(("x_right", "y_bottom"), Agg.MAX)
    | dict.fromkeys(("char_count", "alpha_count", "digit_count", "uppercase_count", "word_count", "alpha_word_count", "capitalized_word_count", "embed_char_count", "token_count"), Agg.SUM)
    | dict.fromkeys(("font_size", "font_family", "non_stroking_color", "text_align", "script_type"), Agg.DOMINANT)
    | dict.fromkeys(("link_url", "link_type", "image_ids"), Agg.UNIQUE_LIST)
    | dict.fromkeys(("mcid", "line_ids"), Agg.SORTED_UNIQUE_LIST)
    | {"struct_attributes": Agg.MERGE_MAPS, "ord": Agg.MIN}
)
Override = Agg | str | Callable[[Column, Column], Column]


def policy_of(column: str, overrides: dict[str, Override] | None = None) -> tuple[Override, str]:
    """The policy of a column and where it comes from."""
    if overrides and column in overrides:
        own = overrides[column]
        return (Agg(own) if isinstance(own, str) else own), "override"
    if column in REGISTRY:
        return REGISTRY[column], "registry"
    if column.startswith("_"):
        return Agg.DROP, "private"
    for start, policy in (("is_", Agg.ANY), ("has_", Agg.ANY), ("inside_", Agg.ANY), ("page_", Agg.FIRST)):
        if column.startswith(start):
            return policy, "prefix"
    for end, policy in (("_count", Agg.SUM), ("_ratio", Agg.WEIGHTED_RATIO)):
        if column.endswith(end):
            return policy, "suffix"
    return Agg.FIRST, "default"


def compiled(policy: Override, c: Column, ord: Column, weight: Column, kind: T.DataType) -> Column:
    """The aggregate expression of a policy for column c in the order of ord."""
    if not isinstance(policy, Agg):
        return policy(c, ord)
    if policy is Agg.FIRST:
        return F.min_by(c, F.when(c.isNotNull(), ord))
    if policy is Agg.ANY:
        return F.coalesce(F.bool_or(c), F.lit(False))
    if policy is Agg.DOMINANT:
        return F.max_by(c, F.struct(F.coalesce(weight, F.lit(0)), -ord))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(ord.alias("o"), c.alias("v")))), lambda x: x["v"]) if policy in (Agg.LIST, Agg.UNIQUE_LIST) else None
    if policy is Agg.LIST:
        return ordered
    if policy is Agg.SORTED_UNIQUE_LIST:
        return F.array_sort(F.collect_set(c))
    if policy is Agg.UNIQUE_LIST:
        lists = F.flatten(F.filter(ordered, lambda v: v.isNotNull())) if isinstance(kind, T.ArrayType) else ordered
        distinct = F.filter(F.array_distinct(lists), lambda v: v.isNotNull() & (v.cast("string") != ""))
        return F.when(F.size(distinct) > 0, distinct)
    if policy is Agg.MERGE_MAPS:
        listed = F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct(ord.alias("o"), F.map_entries(c).alias("v")))))
        entries = F.flatten(F.transform(listed, lambda x: x["v"]))
        keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
        return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"]))
    if policy is Agg.WEIGHTED_RATIO:
        return F.coalesce(F.sum(c * weight) / F.nullif(F.sum(F.when(c.isNotNull(), weight)), F.lit(0)), F.lit(0.0))
    return {Agg.MIN: F.min, Agg.MAX: F.max, Agg.SUM: F.sum}[policy](c)


def roll_up(df: DataFrame, by: list[str], ord: str = "ord", weight: str = "char_count", overrides: dict[str, Override] | None = None, drop: tuple[str, ...] = (), size_as: str | None = None) -> DataFrame:
    """One row for each value of by; every other column by its policy, in one aggregation."""
    fields = df.schema.fields
    # Under names of their own, as the results take the names of the columns they are made of.
    df = df.withColumns({"_ord_": F.col(ord), "_weight_": F.col(weight) if weight in df.columns else F.lit(1)})
    out = []
    for f in fields:
        if f.name in by or f.name in drop:
            continue
        policy, _ = policy_of(f.name, overrides)
        if policy is not Agg.DROP:
            out.append(compiled(policy, F.col(f.name), F.col("_ord_"), F.col("_weight_"), f.dataType).alias(f.name))
    if size_as:
        out.append(F.count(F.lit(1)).alias(size_as))
    return df.groupBy(*by).agg(*out)


def with_derived(df: DataFrame, document: str = "doc_id") -> DataFrame:
    """df with the measures that follow from rolled-up ones, as far as their columns are there."""
    have, new = set(df.columns), {}
    if {"x_left", "x_right"} <= have:
        new["width"] = F.col("x_right") - F.col("x_left")
    if {"y_top", "y_bottom"} <= have:
        new["height"] = F.col("y_bottom") - F.col("y_top")
    for name in ("bold", "italic", "underlined", "strikethrough"):
        if f"{name}_ratio" in have:
            new[f"is_{name}"] = F.col(f"{name}_ratio") > 0.75
    if {"uppercase_count", "alpha_count"} <= have:
        new["is_uppercase"] = F.coalesce(F.col("uppercase_count") / F.nullif(F.col("alpha_count"), F.lit(0)) > 0.90, F.lit(False))
    if "font_size" in have:
        new["font_size_ratio"] = F.col("font_size") / F.median("font_size").over(Window.partitionBy(document))
    return df.withColumns(new) if new else df


def explain(spark: SparkSession, columns: list[str], overrides: dict[str, Override] | None = None) -> DataFrame:
    """column, policy and source of each column."""
    rows = [(c, p.value if isinstance(p, Agg) else "custom", s) for c in columns for p, s in [policy_of(c, overrides)]]
    return spark.createDataFrame(rows, "column string, policy string, source string")


def ordered_join(texts: Column, ord: Column, sep: Column | str, attach: Column | None = None) -> Column:
    """Join texts in order; each but the first is led by its own separator, or by none where attach holds."""
    sep = F.lit(sep) if isinstance(sep, str) else sep
    own = F.when(attach, F.lit("")).otherwise(sep) if attach is not None else sep
    parts = F.array_sort(F.collect_list(F.when(texts.isNotNull(), F.struct(ord.alias("o"), own.alias("s"), texts.alias("t")))))
    return F.array_join(F.transform(parts, lambda x, i: F.when(i == 0, x["t"]).otherwise(F.concat(x["s"], x["t"]))), "")
