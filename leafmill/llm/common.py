"""What the training-data operators share: tables, folds, shared folders, batch bounds, names of working columns and bit filters."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from leafmill.plans.session import importable
from leafmill.plans.staging import shared_folder, staged

#: Rows in one Arrow batch. Texts are long, so Spark's default of 10,000 rows would not fit a worker.
ARROW_ROWS = 256
#: Bytes of text that a Python worker works on at once; a longer single text is a slice of its own.
SLICE_BYTES = 1 << 18
#: Bits of a filter for each key, hash functions, and bits of the largest filter (32 MiB). Beyond it more false positives pass.
FILTER_BITS, FILTER_HASHES, MOST_FILTER_BITS = 16, 4, 1 << 28
_CHUNK = 1 << 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bound the rows that travel to Python at once, for the session, and let workers import this package."""
    importable(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") != str(ARROW_ROWS):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


@contextlib.contextmanager
def small_rows(spark: SparkSession, rows: int = 1 << 16) -> Iterator[None]:
    """Larger batches for what is run inside and has no texts."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents that no model learns from; a null id is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def shared_dir(spark: SparkSession) -> str:
    """A new folder that the driver and all executors see."""
    return shared_folder(spark, "leafmill")


def materialize(df: DataFrame) -> DataFrame:
    """Write and reread df as Parquet in the shared folder: later stages neither recompute it nor need the executor that made it."""
    return staged(df, "leafmill")


def free_names(taken: Iterable[str], *wanted: str) -> list[str]:
    """The wanted names, each with as many underscores more as it takes to differ from those taken, in any case."""
    held, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out


def columns_of(df: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in df.columns]


def ascii_lower(text: Column) -> Column:
    """Text in lower case, for comparing words of ASCII letters: letters beyond ASCII may change too, but none becomes an ASCII one and no word border moves.

    The two letters whose lower case holds an ASCII letter (Kelvin sign and I with a dot) are replaced first.
    """
    return F.lower(F.replace(F.replace(text, F.lit("\u212a"), F.lit("\ue000")), F.lit("\u0130"), F.lit("\ue000")))


_libc = None


def settle() -> None:
    """Give memory that a slice has freed back to the system, so that a worker's size is that of one slice and not of its largest ones together."""
    global _libc
    pa.default_memory_pool().release_unused()
    if _libc is None:
        try:
            _libc = ctypes.CDLL(None)
            _libc.malloc_trim.argtypes = [ctypes.c_size_t]
        except (OSError, AttributeError):
            _libc = False
    if _libc:
        _libc.malloc_trim(0)


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Split a string column into runs of rows of at most limit bytes (one row at least), with the index of each run's first row."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    sizes = pc.binary_length(column).to_pylist()
    first, held = 0, 0
    for i, n in enumerate(sizes):
        if i > first and held + n > limit:
            yield first, column.slice(first, i - first)
            first, held = i, 0
        held += n
    if len(sizes) > first:
        yield first, column.slice(first)


def per_slice(df: DataFrame, text: str, keep: list[str], schema: str, work, beside: str | None = None) -> DataFrame:
    """Apply work to slices of the text column; the columns keep pass through. work(strings) -> list of Arrow arrays, one for each added column of schema; work(strings, values) if beside names a kept column that it needs too.

    schema lists the added columns only; their names must differ from those kept. Texts stay whole; a null text arrives as an empty one.
    """
    bounded_batches(df.sparkSession)
    added = StructType.fromDDL(schema)
    kept = StructType([df.schema[c] for c in keep])
    if clash := {c.lower() for c in added.names} & {c.lower() for c in keep}:
        raise ValueError(f"columns {sorted(clash)} are made here; rename or leave out those that the rows have")
    out = StructType(kept.fields + added.fields)
    sent = list(keep) if text in keep else [*keep, text]
    at = sent.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, strings in text_slices(batch.column(at)):
                arrays = work(strings) if beside is None else work(strings, batch.column(keep.index(beside)).slice(first, len(strings)))
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(first, len(strings)) for i in range(len(keep))] + arrays, names=out.names)
            settle()

    return df.select(*[F.col(f"`{c}`") for c in sent]).mapInArrow(run, out)


class BitFilter:
    """Bits that tell for 64-bit hashes whether a set may hold them. A hash's positions are taken from its halves, so it must be well mixed."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), dtype=bool)
        for at in _positions(hashes, len(self.bits) * 8):
            out &= (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1
        return out


def _positions(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    low, high = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(32)) | np.uint64(1)
    return [(low + np.uint64(k) * high) & np.uint64(bits - 1) for k in range(FILTER_HASHES)]


def bit_filter(keys: DataFrame, key: str, most_bits: int = MOST_FILTER_BITS) -> BitFilter:
    """The filter of a column of longs. Positions are made distinct and packed by chunks of 8 KiB on the executors; the driver gets at most most_bits bits."""
    n, bits = keys.count(), _CHUNK
    while bits < n * FILTER_BITS and bits < most_bits:
        bits *= 2

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            at = np.unique(np.concatenate([p.astype(np.int64) for p in _positions(hashes, bits)])) if len(hashes) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at // _CHUNK, pa.int32()), pa.array(at % _CHUNK, pa.int32())], names=["chunk", "at"])

    def pack(key, rows):
        held = np.zeros(_CHUNK, dtype=np.uint8)
        held[rows.column("at").to_numpy()] = 1
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(held, bitorder="little").tobytes()], pa.binary())})

    # A chunk has 65,536 different positions at most, however many keys there are.
    places = keys.where(F.col(key).isNotNull()).select(key).mapInArrow(place, "chunk int, at int").distinct()
    out = np.zeros(bits // 8, dtype=np.uint8)
    with small_rows(keys.sparkSession):
        packed = places.groupBy("chunk").applyInArrow(pack, "chunk int, bits binary").collect()
    for row in packed:
        out[row.chunk * (_CHUNK // 8) : (row.chunk + 1) * (_CHUNK // 8)] = np.frombuffer(row.bits, dtype=np.uint8)
    return BitFilter(out)
