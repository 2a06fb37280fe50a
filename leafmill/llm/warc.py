"""Deterministic sharded WARC writer, and a reader.

Records are sorted by range of record id: bytes are summed by id, and exact running sums over the sorted ids give the bounds of the
shards, so that they hang on the data alone and not on samples or on how rows lie in partitions. An id that outgrows a shard by
itself is cut by ranges of the digest, so that records stay sorted by id and digest across shards. Each shard is sorted and rolled
into files by compressed size; every record is a gzip member of its own with time zero, and headers, record ids and digests are made
anew from the record.

Commit: a task writes files under temporary names that no other attempt uses, and returns their manifest rows, which are written as
a table that keeps the rows of one attempt of each task. Then the files that it names get their final names, others are removed,
the manifest is written into the archive, and a marker with its totals is written last. Readers open an archive by its folder: they
ask for the marker, take what the manifest lists, and check its totals and each file's SHA-256. Losing an executor repeats a
task under new temporary names; repeating the commit finds what is already renamed. A folder that holds anything is refused.

Of records with equal payloads of REVISIT_FROM bytes at least, that with the largest id is the response; others are revisits of
it, without payload. Smaller ones are all responses.

Defined results: a null payload is empty; a null id sorts first and is written as empty and read back as null, and never is the
response of others unless all ids are null; rows that repeat an id and payload (ties) are all responses if that id is the largest;
very long payloads are written whole; an empty table gives an archive without records; extra columns are ignored, whatever their
names.
"""

from __future__ import annotations

import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.llm.common import materialize

REVISIT_FROM = 1000
#: Compressed bytes after which a file is closed.
ROLL_BYTES = 64 << 20
#: Least and most payload bytes of a shard.
SHARD_BYTES = (2 << 20, 256 << 20)
#: Tasks that write, at most; beyond it a task writes several shards.
MAX_TASKS = 100_000
DATE = "2020-01-01T00:00:00Z"
#: Names in an archive's folder: the table of its files, and the marker that it is whole.
LISTED, MARKER = "manifest", "_COMMITTED"
MANIFEST = "shard long, seq long, temp string, final string, records long, bytes long, sha256 string"


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI; Spark writes local ones with one slash too."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def _rows(pages: DataFrame, record_id: str, url: str, payload: str) -> DataFrame:
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = pages.select(F.col(record_id).cast("long").alias("id"), F.col(url).alias("url"), body.alias("payload"))
    return rows.withColumn("n", F.octet_length("payload").cast("long"))


def classified(rows: DataFrame) -> DataFrame:
    """rows with digest, record_type and refers_to.

    Digests are grouped and those that repeat are written first, so that Spark knows their size when it plans the join and moves
    payloads for it only if they are many.
    """
    rows = rows.withColumns({"digest": F.sha1("payload"), "same": F.sha2("payload", 256)})
    last = rows.where(F.col("n") >= REVISIT_FROM).groupBy("same").agg(F.max("id").alias("last"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    got = rows.join(materialize(last), "same", "left").drop("same")
    revisit = F.col("last").isNotNull() & ~F.col("id").eqNullSafe(F.col("last"))
    return got.withColumns({"record_type": F.when(revisit, "revisit").otherwise("response"), "refers_to": F.when(revisit, F.col("last"))}).drop("last")


def shards_of(rows: DataFrame, shard_bytes: int | None = None) -> tuple[Column, int]:
    """The shard of a record, as an expression of id and digest, and the number of shards; rows has id and n of every record.

    A shard takes a 64th of all bytes, within SHARD_BYTES, unless shard_bytes says otherwise.
    """
    low = -(1 << 63)
    # Repeated ids are summed before they move; a null id sorts first.
    sums = rows.groupBy(F.coalesce("id", F.lit(low).cast("long")).alias("id")).agg(F.sum(F.col("n") + 512).alias("bytes"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = materialize(sums.repartitionByRange(parts, "id").withColumn("part", F.spark_partition_id()))
    # A row for each partition.
    held = {r.part: r.bytes for r in laid.groupBy("part").agg(F.sum("bytes").alias("bytes")).collect()}
    before, total = {}, 0
    for part in sorted(held):
        before[part], total = total, total + held[part]
    if not total:
        return F.lit(0).cast("long"), 1
    target = shard_bytes or min(max(total // 64, SHARD_BYTES[0]), SHARD_BYTES[1])
    offset = F.create_map(*[F.lit(x) for part, n in before.items() for x in (part, n)])[F.col("part")]
    own = Window.partitionBy("part").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    placed = laid.withColumn("at", offset + F.coalesce(F.sum("bytes").over(own), F.lit(0)))
    heavy = F.col("bytes") > target
    # The first id of each stretch of target bytes, and ids that outgrow a shard: as many rows as there are shards at most.
    starts = placed.where(~heavy).groupBy(F.floor(F.col("at") / target).alias("k")).agg(F.min("id").alias("id")).select("id", F.lit(0).cast("long").alias("bytes"))
    bounds: dict[int, int] = {low: 1}
    for r in starts.union(placed.where(heavy).select("id", "bytes")).collect():
        bounds[r.id] = max(1, -(-r.bytes // target))
        if r.bytes:
            bounds.setdefault(r.id + 1, 1)
    ids = sorted(bounds)
    pieces = [bounds[i] for i in ids]
    first = np.concatenate(([0], np.cumsum(pieces)))[:-1].tolist()
    listed = lambda values: F.from_json(F.lit(json.dumps(values)), "array<long>")  # noqa: E731  one constant
    steps = F.array(*[F.lit(1 << k) for k in range(len(ids).bit_length() - 1, -1, -1)])
    value = F.coalesce("id", F.lit(low).cast("long"))
    place = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.coalesce(F.get(listed(ids), at + step) <= value, F.lit(False)), at + step).otherwise(at))
    cut = F.lit(0).cast("long")
    if max(pieces) > 1:
        cut = F.floor(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") * F.get(listed(pieces), place) / F.lit(1 << 32)).cast("long")
    return F.get(listed(first), place) + cut, sum(pieces)


def record_id(page: str, digest: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind}:{page}:{digest}')}>"


def record(page: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit has the response's HTTP head but no payload."""
    name = "" if page is None else str(page)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + (payload if kind == "response" else b"")
    target = "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "")
    fields = [("WARC-Type", kind), ("WARC-Record-ID", record_id(name, digest, kind)), ("WARC-Date", DATE), ("WARC-Target-URI", target)]
    fields += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{hashlib.sha1(block).hexdigest()}"), ("X-Page-Id", name)]
    if kind == "revisit":
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(str(refers_to), digest, "response")), ("X-Refers-To-Page-Id", str(refers_to))]
    fields.append(("Content-Length", str(len(block))))
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member with time zero."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class _Roller:
    """Writes one shard's records into files of about roll bytes under temporary names."""

    def __init__(self, folder: str, shard: int, roll: int) -> None:
        self.fs, self.path = _filesystem(folder)
        self.shard, self.roll, self.seq, self.out, self.done = shard, roll, 0, None, []

    def add(self, data: bytes) -> None:
        packed = member(data)
        if self.out is None:
            self.temp = f".tmp-{self.shard:08d}-{self.seq:05d}-{uuid.uuid4().hex}.warc.gz"
            self.out, self.sha, self.bytes, self.records = self.fs.open_output_stream(f"{self.path}/{self.temp}", compression=None), hashlib.sha256(), 0, 0
        self.out.write(packed)
        self.sha.update(packed)
        self.bytes += len(packed)
        self.records += 1
        if self.bytes >= self.roll:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.shard, self.seq, self.temp, f"part-{self.shard:08d}-{self.seq:05d}.warc.gz", self.records, self.bytes, self.sha.hexdigest()))
            self.out, self.seq = None, self.seq + 1


def write(pages: DataFrame, folder: str, roll: int = ROLL_BYTES, shard_bytes: int | None = None, record_id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Write pages as WARC files into a new shared folder and commit them; the manifest is returned."""
    rows = _rows(pages, record_id, url, payload)
    fs, path = _filesystem(folder)
    fs.create_dir(path, recursive=True)
    if fs.get_file_info(pafs.FileSelector(path)):
        raise FileExistsError(f"{folder} holds something already; an archive goes to a folder of its own")
    shard, shards = shards_of(rows, shard_bytes)
    ordered = classified(rows).withColumn("shard", shard).repartition(min(2 * shards, MAX_TASKS), "shard").sortWithinPartitions("shard", "id", "digest", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, done = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if roller is None or roller.shard != row["shard"]:
                    if roller is not None:
                        roller.close()
                        done += roller.done
                    roller = _Roller(folder, row["shard"], roll)
                roller.add(record(row["id"], row["url"], row["payload"], row["digest"], row["record_type"], row["refers_to"]))
        if roller is not None:
            roller.close()
            done += roller.done
        columns = list(zip(*done)) or [()] * 7
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["shard", "seq", "temp", "final", "records", "bytes", "sha256"])

    manifest = materialize(ordered.mapInArrow(run, MANIFEST))
    commit(manifest, folder)
    return manifest


def commit(manifest: DataFrame, folder: str) -> None:
    """Give the manifest's files their final names, remove what else lies under temporary names, and write the marker."""

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _filesystem(folder)
        for batch in batches:
            for row in batch.to_pylist():
                if fs.get_file_info(f"{path}/{row['temp']}").type != pafs.FileType.NotFound:
                    fs.move(f"{path}/{row['temp']}", f"{path}/{row['final']}")
            yield pa.RecordBatch.from_arrays([batch.column(3)], names=["final"])

    manifest.mapInArrow(rename, "final string").write.format("noop").mode("overwrite").save()
    fs, path = _filesystem(folder)
    for info in fs.get_file_info(pafs.FileSelector(path)):
        if info.base_name.startswith(".tmp-"):
            fs.delete_file(info.path)
    manifest.select("final", "shard", "seq", "records", "bytes", "sha256").write.mode("overwrite").json(f"{folder}/{LISTED}")
    with fs.open_output_stream(f"{path}/{MARKER}") as out:
        out.write(json.dumps(_totals(manifest)).encode())


def _totals(manifest: DataFrame) -> dict[str, int]:
    got = manifest.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("records"), F.lit(0)).alias("records"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    return got.asDict()


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest of a committed archive: final, shard, seq, records, bytes and sha256 of each file."""
    fs, path = _filesystem(folder)
    if fs.get_file_info(f"{path}/{MARKER}").type == pafs.FileType.NotFound:
        raise FileNotFoundError(f"{folder} holds no committed archive")
    with fs.open_input_stream(f"{path}/{MARKER}") as source:
        totals = json.loads(source.read())
    manifest = spark.read.schema("final string, shard long, seq long, records long, bytes long, sha256 string").json(f"{folder}/{LISTED}")
    if (found := _totals(manifest)) != totals:
        raise ValueError(f"the manifest of {folder} lists {found}; {totals} were committed")
    return manifest


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of an uncompressed WARC stream."""
    while line := stream.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"no record begins with {line[:40]!r}")
        fields: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            k, _, v = line.decode().partition(":")
            fields[k] = v.strip()
        block = stream.read(int(fields["Content-Length"]))
        if stream.read(4) != b"\r\n\r\n" or hashlib.sha1(block).hexdigest() != fields["WARC-Block-Digest"].removeprefix("sha1:"):
            raise ValueError(f"{fields['WARC-Record-ID']} is damaged")
        yield fields, block


class _Members(io.RawIOBase):
    """The uncompressed bytes of concatenated gzip members, with the SHA-256 of the compressed ones."""

    def __init__(self, source) -> None:
        self.source, self.sha, self.rest, self.ready, self.engine = source, hashlib.sha256(), b"", b"", None

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while not self.ready:
            if not self.rest:
                self.rest = self.source.read(1 << 16)
                if not self.rest:
                    return 0
                self.sha.update(self.rest)
            if self.engine is None:
                self.engine = zlib.decompressobj(31)
            self.ready = self.engine.decompress(self.rest, 1 << 18)
            self.rest = self.engine.unconsumed_tail or self.engine.unused_data
            if self.engine.eof:
                self.engine = None
        n = min(len(buffer), len(self.ready))
        buffer[:n], self.ready = self.ready[:n], self.ready[n:]
        return n


def read(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type and refers_to of every record of a committed archive; digests of responses are those of the bytes read."""
    manifest = listed(spark, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _filesystem(folder)
        for batch in batches:
            for name, sha in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []
                with fs.open_input_stream(f"{path}/{name}", compression=None) as source:
                    members = _Members(source)
                    for fields, block in parse(io.BufferedReader(members, 1 << 18)):
                        head, _, payload = block.partition(b"\r\n\r\n")
                        length = int(head.rpartition(b"Content-Length: ")[2].split(b"\r\n")[0])
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        if fields["WARC-Type"] == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
                            raise ValueError(f"{fields['WARC-Record-ID']} has another payload than its head says")
                        page, target = fields["X-Page-Id"], fields.get("X-Refers-To-Page-Id")
                        rows.append((int(page) if page else None, fields["WARC-Target-URI"], length, digest, fields["WARC-Type"], int(target) if target else None))
                        if len(rows) >= 4096:
                            yield _batch(rows)
                            rows = []
                if members.sha.hexdigest() != sha:
                    raise ValueError(f"{name} is not the file that was committed")
                if rows:
                    yield _batch(rows)

    files = manifest.select("final", "sha256")
    spread = files.repartition(max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "final")
    return spread.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])
