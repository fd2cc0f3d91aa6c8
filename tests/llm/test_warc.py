import hashlib
import io
import struct

import pytest
import zstandard

from tileflow.llm import warc
from tileflow.plans.lineage import shared_path

PAGES = "page_id long, url string, html string"


def test_round_trip(spark):
    big, other = "é" * 600, "<p>" + "x" * 5000
    rows = [(1, "http://a/1", big), (2, None, big), (3, "http://a/ 3\n", other), (4, "u", None), (5, "u", ""), (6, "u", "small"), (7, "u", "small"), (2, "u", big), (None, "u", big), (None, None, None)]
    table = spark.createDataFrame([(*r, 1) for r in rows], PAGES + ", digest int").repartition(3)
    out = warc.archive_pages(spark, table).collect()
    expected = []
    for i, _, html in rows:
        raw = (html or "").encode()
        revisit = html == big and i != 2
        expected.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", 2 if revisit else None))
    assert sorted(map(repr, map(tuple, out))) == sorted(map(repr, expected))
    assert warc.archive_pages(spark, spark.createDataFrame([], PAGES)).count() == 0


def test_payloads_and_dictionary(spark):
    rows = [(k, f"http://h/{k}", f"<html><body>page {k} " + "the same boilerplate " * 300 + "</body></html>") for k in range(600)]
    folder = shared_path(spark, "warc-test")
    manifest = warc.write_archives(spark, warc.record_kinds(spark.createDataFrame(rows, PAGES)).coalesce(1), folder)
    paths = [r.path for r in manifest.collect()]
    assert sum(r.records for r in manifest.collect()) == 600
    with open(paths[0].removeprefix("file://"), "rb") as f:
        assert struct.unpack("<I", f.read(4))[0] == warc.DICTIONARY_MAGIC
    records = warc.read_archives(spark, manifest).where("record_type = 'response'").collect()
    assert {(r.page_id, r.target_uri, bytes(r.payload).decode()) for r in records} == set(rows)
    assert all(r.problem is None for r in records)


def frames_of(*frames):
    return list(warc.frames(io.BytesIO(b"".join(frames))))


def test_frames_and_dictionaries():
    plain = zstandard.ZstdCompressor()
    samples = [b"header: value %d\r\n" % k * 20 for k in range(400)]
    learned = zstandard.train_dictionary(4096, samples)
    coded = zstandard.ZstdCompressor(dict_data=learned)
    raw = learned.as_bytes()
    skip = lambda magic, x: struct.pack("<II", magic, len(x)) + x
    for d in (raw, plain.compress(raw)):
        assert frames_of(skip(warc.DICTIONARY_MAGIC, d), coded.compress(b"one"), skip(0x184D2A50, b"ignored"), coded.compress(b"two")) == [b"one", b"two"]
    assert frames_of(plain.compress(b"x" * 3_000_000), plain.compress(b"")) == [b"x" * 3_000_000, b""]
    assert frames_of() == []
    for broken in ([plain.compress(b"abc" * 100)[:-4]], [b"not a frame at all"], [coded.compress(samples[0])], [skip(warc.DICTIONARY_MAGIC, raw)[:100]]):
        assert isinstance(frames_of(*broken)[-1], ValueError)


GOOD = warc.page_record(5, "http://x/", b"payload", hashlib.sha1(b"payload").hexdigest(), None)


@pytest.mark.parametrize(
    "raw, problem",
    [
        (GOOD, None),
        (GOOD.replace(b"WARC/1.1", b"WARC/9"), "no version line"),
        (GOOD.replace(b"WARC-Date", b"X-Date"), "missing: WARC-Date"),
        (GOOD[:-1], "Content-Length"),
        (GOOD + b"more", "Content-Length"),
        (GOOD.replace(b"payload\r\n", b"Payload\r\n"), "digest"),
        (GOOD.replace(b"Content-Length: 7", b"Content-Length: 8"), "payload has 7"),
        (GOOD.replace(b"Content-Length: 7", b"Content-Length: y"), "no number"),
        (b"WARC/1.1\r\nno colon\r\n\r\n", "not a header"),
        (b"", "no version line"),
    ],
)
def test_records_are_checked(raw, problem):
    found = warc.parse_record(raw)
    assert found["problem"] is None if problem is None else problem in found["problem"]


def test_a_broken_file_gives_a_row_and_the_rest_is_read(spark, tmp_path):
    z = zstandard.ZstdCompressor()
    (tmp_path / "a.warc.zst").write_bytes(z.compress(GOOD) + b"garbage!!" + z.compress(GOOD))
    (tmp_path / "b.warc.zst").write_bytes(z.compress(GOOD) * 2)
    (tmp_path / "c.warc.zst").write_bytes(z.compress(GOOD) + z.compress(GOOD)[:-9])
    paths = spark.createDataFrame([(f"file://{tmp_path}/{n}.warc.zst",) for n in "abc"], "path string")
    out = warc.read_archives(spark, paths).collect()
    assert sorted((r.path[-10], r.problem is None) for r in out) == [("a", False), ("a", True), ("a", True), ("b", True), ("b", True), ("c", False), ("c", True)]


def test_reading_goes_on_behind_what_is_broken(monkeypatch):
    monkeypatch.setattr(warc, "READ_BYTES", 50)
    monkeypatch.setattr(warc, "PIECE_BYTES", 16)
    z = zstandard.ZstdCompressor(write_checksum=True)
    one, two = z.compress(b"first" * 30), z.compress(bytes(range(256)) * 3)
    bad = bytearray(two)
    bad[40] ^= 255
    kinds = lambda *parts: [x if isinstance(x, bytes) else None for x in frames_of(*parts)]
    assert kinds(one, bytes(bad), two, one) == [b"first" * 30, None, bytes(range(256)) * 3, b"first" * 30]
    assert kinds(one, warc.FRAME_MAGIC + b"no", warc.FRAME_MAGIC, one) == [b"first" * 30, None, b"first" * 30]
    assert kinds(one, two[:-1]) == [b"first" * 30, None]
    assert kinds(b"\x28\xb5\x2f", one) == [None, b"first" * 30]


def test_a_path_without_scheme_is_the_default_file_systems(spark, tmp_path):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    (tmp_path / "mounted").mkdir()
    conf.set("fs.viewfs.mounttable.tests.link./data", f"file://{tmp_path}/mounted")
    conf.set("fs.defaultFS", "viewfs://tests/")
    try:
        folder = warc.resolved(spark, "/data/archives")
        assert folder == f"file://{tmp_path}/mounted/archives"
        conf.set("fs.defaultFS", f"file://{tmp_path}")
        assert warc.address("s3a://bucket/x") == "s3://bucket/x" and warc.address("file:/x/y") == "file:///x/y"
        (tmp_path / "p.warc.zst").write_bytes(zstandard.ZstdCompressor().compress(GOOD))
        conf.set("fs.defaultFS", "file:///")
        assert warc.read_archives(spark, spark.createDataFrame([(f"{tmp_path}/p.warc.zst",)], "path string")).count() == 1
    finally:
        conf.set("fs.defaultFS", before)


def test_archives_are_deleted(spark):
    from pathlib import Path

    from tileflow.plans.lineage import shared_base

    base = Path("/" + shared_base(spark).removeprefix("file:").lstrip("/"))
    before = set(base.glob("**/*.warc.zst"))
    warc.archive_pages(spark, spark.createDataFrame([(1, "u", "x")], PAGES)).collect()
    assert set(base.glob("**/*.warc.zst")) == before
