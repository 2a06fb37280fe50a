import gzip
import hashlib
import io
from pathlib import Path

import pytest

from leafmill.llm import warc


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, record_type string")


def rows():
    big, other = "ä" * 700, "y" * 1000
    out = [(1, "http://a/1", big), (2, "http://a/2", "small"), (3, "http://a/3", big), (4, "http://a/4", "small"), (5, None, None), (6, "http://a/6 x\r\n", ""), (9, "http://a/9", big), (8, "http://a/8", other), (7, "http://a/7", other)]
    out += [(None, "http://a/n", other), (10, "http://a/10", "z" * 200_000), (11, "http://a/11", "x" * 999), (12, "http://a/12", "x" * 999)]
    out += [(100 + i, f"http://b/{i}", f"{i} " * 400) for i in range(60)]
    return [(*r, "extra") for r in out]


def brute(given):
    last = {}
    for i, _, h, _ in given:
        if len((h or "").encode()) >= 1000 and i is not None:
            last[h] = max(last.get(h, i), i)
    out = {}
    for i, _, h, _ in given:
        data = (h or "").encode()
        revisit = h in last and last[h] != i
        out[i] = (len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", last[h] if revisit else None)
    return out


def test_round_trip(spark, tmp_path):
    folder = f"file://{tmp_path}/w"
    manifest = warc.write(pages(spark, rows()).repartition(3), folder, roll=4000, shard_bytes=20_000)
    # The folder is all that a reader needs.
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read(spark, folder).collect()}
    assert got == brute(rows())
    names = {p.name for p in Path(f"{tmp_path}/w").iterdir() if not p.name.startswith(".") or p.name.startswith(".tmp")}
    assert names == {r.final for r in manifest.collect()} | {"_COMMITTED", "manifest"} and {r.final for r in warc.listed(spark, folder).collect()} < names
    assert len(names) > 5
    with pytest.raises(FileExistsError):
        warc.write(pages(spark, rows()), folder)
    with pytest.raises(FileNotFoundError):
        warc.read(spark, f"file://{tmp_path}/none")


def test_files_do_not_hang_on_partitions(spark, tmp_path):
    sums = []
    for k in (1, 7):
        folder = f"{tmp_path}/w{k}"
        warc.write(pages(spark, rows()).repartition(k), f"file://{folder}", roll=4000, shard_bytes=20_000)
        sums.append({p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in Path(folder).glob("part-*")})
    assert sums[0] == sums[1]


def test_records_are_in_order_and_whole_members(spark, tmp_path):
    folder = f"{tmp_path}/w"
    # Two ids lie so far out that ranges of equal width would hold all others in one.
    far = [(-(2**62), "http://low", "low " * 300, "e"), (2**62, "http://high", "high " * 300, "e")]
    manifest = warc.write(pages(spark, rows() + far), f"file://{folder}", shard_bytes=20_000)
    assert len({r.shard for r in manifest.collect()}) > 6
    ids = []
    for r in sorted(manifest.collect(), key=lambda r: r.final):
        for fields, block in warc.parse(io.BytesIO(gzip.decompress(Path(folder, r.final).read_bytes()))):
            assert int(fields["Content-Length"]) == len(block)
            ids.append(fields["X-Page-Id"])
    assert len(ids) == len(rows()) + 2 and [int(x) for x in ids if x] == sorted(int(x) for x in ids if x) and ids[0] == ""


def test_commit_can_be_repeated_and_damage_is_seen(spark, tmp_path):
    folder = f"{tmp_path}/w"
    manifest = warc.write(pages(spark, rows()), f"file://{folder}")
    Path(folder, ".tmp-left-over").write_bytes(b"x")
    warc.commit(manifest, f"file://{folder}")
    assert not Path(folder, ".tmp-left-over").exists()
    assert warc.read(spark, f"file://{folder}").count() == len(rows())
    file = next(Path(folder).glob("part-*"))
    data = bytearray(file.read_bytes())
    data[4] ^= 1  # the member's time, which no checksum of gzip covers
    file.write_bytes(bytes(data))
    with pytest.raises(Exception, match="not the file that was committed"):
        warc.read(spark, f"file://{folder}").collect()


def test_hot_id_range_is_cut(spark, tmp_path):
    many = [(7, f"http://a/{i}", f"{i} " * 300, "e") for i in range(200)]
    folder = f"file://{tmp_path}/w"
    manifest = warc.write(pages(spark, many), folder, shard_bytes=20_000)
    assert len({r.shard for r in manifest.collect()}) > 5 and warc.read(spark, folder).count() == 200


def test_empty(spark, tmp_path):
    folder = f"file://{tmp_path}/w"
    manifest = warc.write(pages(spark, []), folder)
    assert manifest.count() == 0 and warc.read(spark, folder).count() == 0
