"""One ordered pass over the rows of each document, for rules that carry state from row to row.

Rows of a document travel together and in order; a worker holds one document at a time and only the columns that the rule reads.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def per_document(df: DataFrame, columns: dict[str, Column], schema: str, work: Callable[[list[tuple]], list[tuple]], key: str = "doc_id", order: str = "ord") -> DataFrame:
    """key and schema: what work makes of each document's rows, tuples of order and columns."""
    out = T.StructType([df.schema[key], *T._parse_datatype_string(schema).fields])
    arrow = to_arrow_schema(out)
    slim = df.select(F.col(key), F.col(order), *[c.alias(n) for n, c in columns.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        made: list[tuple] = []

        def close() -> None:
            if held:
                made.extend((held[0][0], *row) for row in work([r[1:] for r in held]))
                held.clear()

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][0] != row[0]:
                    close()
                held.append(row)
            if len(made) > 4096:
                yield batch_of(made)
                made.clear()
        close()
        if made:
            yield batch_of(made)

    return slim.repartition(key).sortWithinPartitions(key, order).mapInArrow(run, out)
