import base64
import hashlib
import random
import zlib

from pyarrow import fs

from conftest import canonical
from stockflow.llm import common, warc

PAGES = "page_id long, url string, html string, digest string, path string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], PAGES)


def round_trip(spark, pages, **options):
    manifest = warc.write_archives(pages, common.new_path(spark, "warc-test"), **options)
    return warc.read_archives(manifest, keep_payload=True).collect()


def test_round_trip(spark):
    rng = random.Random(1)
    long = "".join(rng.choice("abcdefgh é€\n\r") for _ in range(700_000))
    rows = [(1, "http://a/1", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "u\r\nX: y", None), (4, "u", ""), (5, "u", long), (6, "u", "\r\n\r\n"), (None, "u", "lone"), (7, "u", "é"), (7, "u", "é")]
    got = round_trip(spark, table(spark, rows))
    assert len(got) == len(rows) and all(r.error is None for r in got)
    by_id = {}
    for r in got:
        by_id.setdefault(r.page_id, []).append(r)
    for page_id, _, html in rows:
        data = (html or "").encode()
        assert all((r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode()) for r in by_id[page_id])
    assert [(by_id[i][0].record_type, by_id[i][0].refers_to) for i in (1, 2, 3, 4)] == [("revisit", 2), ("response", None), ("revisit", 4), ("response", None)]
    assert by_id[5][0].payload == long.encode() and by_id[1][0].payload == b"" and by_id[2][0].payload == b"<p>x</p>"
    assert {r.record_type for r in by_id[7]} == {"response"} and by_id[None][0].record_type == "response"
    assert by_id[3][0].url == "u%0D%0AX: y" and by_id[2][0].url is None


def test_least_size_and_empty_table(spark):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")]
    got = {r.page_id: r.record_type for r in round_trip(spark, table(spark, rows), min_bytes=3)}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}
    assert round_trip(spark, table(spark, []), min_bytes=0) == []


def test_damage_is_found():
    whole = warc.gzip_member(warc.record(1, "u", b"hello", None), 6)
    other = warc.gzip_member(warc.record(2, "u", b"other", None), 6)
    plain = zlib.decompress(whole, 31)

    class File:
        def __init__(self, data):
            self.data = data

        def read(self, n):
            got, self.data = self.data[:n], self.data[n:]
            return got

    read = lambda data: [(r[0], r[6]) for r in warc.read_records(File(data))]
    assert read(whole + other) == [(1, None), (2, None)] and read(b"") == []
    assert read(warc.gzip_member(plain.replace(b"hello", b"jello"), 6)) == [(1, "block digest differs")]
    assert read(whole + other[:-20])[0] == (1, None) and "EOFError" in read(whole + other[:-20])[1][1]
    assert "doesn't end" in read(warc.gzip_member(plain + b"more", 6))[0][1]
    assert read(warc.gzip_member(b"WARC/1.1\r\n\r\n", 6))[0][1].startswith("KeyError")


def test_archives_are_cut(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 1000)
    rng = random.Random(2)
    rows = [(i, "u", "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(900))) for i in range(10)]
    folder = common.new_path(spark, "warc-test")
    manifest = warc.write_archives(table(spark, rows).coalesce(1), folder)
    assert manifest.count() >= 1 and sum(r.records for r in manifest.collect()) == 10
    store, root = fs.FileSystem.from_uri(folder)
    assert len(store.get_file_info(fs.FileSelector(root))) == manifest.count()


def test_query(spark, sf, duck):
    assert canonical(warc.op1_warc(spark, sf).toPandas()) == canonical(duck.execute(warc.OP1_SQL).df())
