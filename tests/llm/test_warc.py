import gzip
import hashlib
import os
import tempfile

import oracle
import pytest

from textquarry.llm import queries, storage, warc
from textquarry.session import scratch_path

FOLDER = "/root/testdata/sf0.001"
BIG = "<p>é漢</p>" * 200


def test_query_equals_sql(spark):
    con = oracle.connect(FOLDER)
    name = "op8_warc"
    assert oracle.compare(queries.QUERIES[name](spark, FOLDER), con, queries.ORACLES[name]) is None


def odd_pages(spark):
    rows = [
        (1, "http://a/", BIG, "x"), (2, None, BIG, "x"), (9, "http://b/\r\nX: y", BIG, "x"), (9, "http://c/", BIG, None),
        (3, "http://é/", None, None), (4, "u", "", None), (5, "u", "small", None), (6, "u", "small", None),
        (None, "u", BIG, None), (None, "u", None, None), (7, "u", "z" * 2_000_000, None),
        (8, "u", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n" * 50, None),
    ]
    return spark.createDataFrame(rows, "page_id long, url string, html string, record_type string")


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_round_trip_of_odd_rows(spark, compression):
    warc.register(spark)
    path = scratch_path(spark, "warc")
    records = warc.page_records(odd_pages(spark))
    records.write.format("warc").mode("append").option("compression", compression).save(path)
    got = warc.read_warc(spark, path).collect()
    want = records.collect()
    key = lambda r: (r["record_id"], r["record_type"], r["payload_digest"], r["payload_bytes"], r["refers_to"])
    assert sorted(map(key, got), key=repr) == sorted(map(key, want), key=repr)
    by_id = {r["record_id"]: r for r in got}
    kinds = sorted((r["record_type"], r["payload_bytes"]) for r in got if r["record_id"] == "urn:page:none")
    assert kinds == [("response", 0), ("response", len(BIG.encode()))]
    assert bytes(by_id["urn:page:9"]["payload"]).decode() == BIG
    assert by_id["urn:page:1"]["refers_to"] == by_id["urn:page:2"]["refers_to"] == "urn:page:9"
    assert bytes(by_id["urn:page:1"]["payload"]) == b"" and by_id["urn:page:1"]["payload_bytes"] == len(BIG.encode())
    for r in got:
        if r["record_type"] == "response":
            assert hashlib.sha1(bytes(r["payload"])).hexdigest() == r["payload_digest"]
    assert sum(r["record_type"] == "response" for r in got if r["record_id"] == "urn:page:9") == 2
    assert by_id["urn:page:2"]["target_uri"] is None
    assert "\n" not in by_id["urn:page:9"]["target_uri"]


def test_no_pages(spark):
    path = scratch_path(spark, "warc")
    warc.write_pages(odd_pages(spark).where("false"), path)
    assert warc.read_warc(spark, path).count() == 0


def test_filters_are_pushed_and_payloads_skipped(spark):
    path = scratch_path(spark, "warc")
    warc.write_pages(odd_pages(spark), path)
    frame = warc.read_warc(spark, path, "record_id string, record_type string, target_uri string")
    wanted = frame.where("record_type = 'revisit' and target_uri like 'http://%'")
    plan = wanted._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.replace("RuntimeFilters", "")
    assert [r["record_id"] for r in wanted.collect()] == ["urn:page:1"]
    assert frame.where("record_id in ('urn:page:3', 'urn:page:4')").count() == 2


class Counted:
    """A file that counts the bytes read from it."""

    def __init__(self, path):
        self.source, self.bytes = open(path, "rb"), 0

    def size(self):
        return os.fstat(self.source.fileno()).st_size

    def seek(self, at):
        self.source.seek(at)

    def read(self, n):
        data = self.source.read(n)
        self.bytes += len(data)
        return data


def record(i, payload):
    return warc.record_bytes(
        {"record_id": f"r{i}", "record_type": "response", "target_uri": "u", "payload": payload,
         "payload_bytes": len(payload), "payload_digest": hashlib.sha1(payload).hexdigest()}
    )


def test_skipping_reads_little():
    payloads = [os.urandom(400_000) for _ in range(5)]
    folder = tempfile.mkdtemp(prefix="run-")
    for name, make in (("a.warc", bytes), ("a.warc.gz", warc.gzip_member)):
        path = f"{folder}/{name}"
        with open(path, "wb") as out:
            out.write(b"".join(make(record(i, p)) for i, p in enumerate(payloads)))
        source = Counted(path)
        assert len(list(warc._Stream(source))) == 5
        assert source.bytes < 60_000
        blocks = [read() for _, read in warc._Stream(source)]
        assert [b.partition(b"\r\n\r\n")[2] for b in blocks] == payloads


def test_members_without_lengths_and_foreign_digests():
    folder = tempfile.mkdtemp(prefix="run-")
    path = f"{folder}/b.warc.gz"
    with open(path, "wb") as out:
        for i in range(3):
            out.write(gzip.compress(record(i, b"x" * (i * 50_000))))
    system, inner = storage.filesystem(path)
    with system.open_input_file(inner) as source:
        assert [len(read().partition(b"\r\n\r\n")[2]) for _, read in warc._Stream(source)] == [0, 50_000, 100_000]
    assert warc._digest_hex("sha1:" + "AB" * 20) == "ab" * 20
    assert warc.gzip_member(b"abc" * 100) and gzip.decompress(warc.gzip_member(b"abc" * 100)) == b"abc" * 100


def test_partitions_are_planned_by_size(spark):
    path = scratch_path(spark, "warc")
    warc.register(spark)
    records = warc.page_records(odd_pages(spark)).repartition(6)
    records.write.format("warc").mode("append").save(path)
    one = spark.read.format("warc").load(path)
    many = spark.read.format("warc").option("splitBytes", "1").load(path)
    assert one.rdd.getNumPartitions() == 1 and many.rdd.getNumPartitions() > 3
    assert one.count() == many.count() == 12


@pytest.mark.parametrize("zipped", [False, True])
def test_malformed_headers_have_null_lengths(spark, tmp_path, zipped):
    """Lengths that are no numbers and odd digests do not stop the read."""
    head = "WARC/1.1\r\nWARC-Record-ID: <urn:page:{}>\r\nWARC-Type: response\r\nContent-Type: application/http; msgtype=response\r\n{}\r\n\r\n"
    http = b"HTTP/1.1 200 OK\r\n\r\n"
    records = [
        (head.format(1, "Content-Length: many\r\nWARC-Payload-Digest: sha1:" + "!" * 32).encode() + http + b"first"),
        (head.format(2, f"Content-Length: {len(http) + 6}\r\nX-Payload-Length: -6").encode() + http + b"second"),
        (head.format(3, "X-Note: no length at all").encode() + http + b"third"),
    ]
    pack = gzip.compress if zipped else bytes
    (tmp_path / ("x.warc.gz" if zipped else "x.warc")).write_bytes(b"".join(pack(r + b"\r\n\r\n") for r in records))
    got = {r["record_id"]: r for r in warc.read_warc(spark, str(tmp_path)).collect()}
    assert [bytes(got[f"urn:page:{k}"]["payload"]) for k in (1, 2, 3)] == [b"first", b"second", b"third"]
    assert [got[f"urn:page:{k}"]["payload_bytes"] for k in (1, 2, 3)] == [None, None, None]
    assert got["urn:page:1"]["payload_digest"] == "!" * 32
