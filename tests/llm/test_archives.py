import gzip
import hashlib
from collections import defaultdict

import pytest

from creditloom.llm.archives import arc_records, arc_to_warc, convert, warc_captures, warc_records, with_originals, write_arc
from creditloom.llm.files import read_files, run_folder

SCHEMA = "page_id long, url string, html string, refers_to string"


def archive(spark, rows):
    arc, warc = run_folder(spark, "arc"), run_folder(spark, "warc")
    write_arc(spark.createDataFrame(rows, SCHEMA), arc, file_bytes=3000)
    arc_to_warc(spark, arc, warc)
    return arc, warc


def test_round_trip(spark):
    big, small = "<p>" + "é" * 80, "short"
    rows = [(i, f"http://x/{i}", f"<html>{i}</html>" * (i % 40)) for i in range(120)]
    rows += [(200, "http://a b\n/", big), (150, "u", big), (151, None, big), (152, "u", small), (153, "u", small), (154, "u", None), (155, "u", ""),
             (None, "u", big), (156, "u", "\r\n\r\nHTTP/1.1 x\r\nX-Page-Id: 9\r\n\r\n" * 9), (157, "u", "\n" * 500), (150, "u", big)]
    _, warc = archive(spark, [(*r, "c") for r in rows])
    got = with_originals(warc_captures(spark, warc)).collect()
    first = defaultdict(list)
    for i, _, html in rows:
        first[html or ""].append(i)
    assert len(got) == len(rows)
    count = defaultdict(int)
    for r in got:
        count[r.payload_digest, r.record_type] += 1
    for html, ids in first.items():
        body = html.encode()
        mine = [r for r in got if r.payload_digest == hashlib.sha256(body).hexdigest()]
        least = min(i for i in ids if i is not None)
        assert sorted(map(str, ids)) == sorted(str(r.page_id) for r in mine) and {r.payload_bytes for r in mine} == {len(body)}
        if len(body) >= 100:
            assert sum(r.record_type == "response" for r in mine) == 1
            assert all((r.page_id, r.refers_to) == (least, None) if r.record_type == "response" else r.refers_to == least for r in mine)
        else:
            assert all(r.record_type == "response" and r.refers_to is None for r in mine)


def test_files_are_plain_gzip_archives(spark):
    arc, warc = archive(spark, [(i, "u", f"page {i} " * 50, "c") for i in range(60)])
    for folder, start in ((arc, b"filedesc://"), (warc, b"WARC/1.1\r\n")):
        files = [bytes(r.content) for r in read_files(spark, folder).collect()]
        assert files and all(gzip.decompress(f).startswith(start) for f in files)
    ids = [r["warc-record-id"] for r in read_files(spark, warc).collect() for r in warc_records(bytes(r.content))]
    assert len(ids) == len(set(ids)) > 60


def test_both_versions_and_declared_lengths():
    v1 = b"filedesc://a.arc 0.0.0.0 19960923142103 text/plain 76\n1 0 origin\nURL IP-address Archive-date Content-type Archive-length\n\n"
    v1 = v1.replace(b" 76\n", b" %d\n" % len(v1.split(b"\n", 1)[1]))
    block = b"HTTP/1.0 200 OK\r\nA: b\r\n\r\n" + b"line\nline\nline\n1"
    record = b"http://x/ 1.2.3.4 19961104142103 text/html %d\n" % len(block) + block + b"\n"
    assert [r["URL"] for r in arc_records(gzip.compress(v1 + record))] == [b"filedesc://a.arc", b"http://x/"]
    assert len(list(arc_records(gzip.compress(v1) + gzip.compress(record) + gzip.compress(record)))) == 3
    out = list(convert("f", gzip.compress(v1 + record + b"dns:x 1.2.3.4 19961104142104 text/dns 3\nabc\n"), {}))
    assert b"WARC-Type: warcinfo" in out[0] and b"WARC-Type: response" in out[1] and b"WARC-Type: resource" in out[2]
    assert b"WARC-Date: 1996-11-04T14:21:03Z" in out[1] and b"Content-Type: text/dns" in out[2]
    v2 = b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
    body = b"2 0 origin\n" + v2 + b"\n\n"
    two = b"filedesc://b.arc 0.0.0.0 19970101000000 text/plain 200 - - 0 b.arc %d\n" % len(body) + body + b"http://y/ 0.0.0.0 19970101000000 text/html 200 sum - 9 b.arc 2\nok\n"
    assert list(arc_records(gzip.compress(two)))[1]["Checksum"] == b"sum"
    for broken in (v1 + record[:-20], v1 + record.replace(b"1.2.3.4 ", b""), record, v1.replace(b"1 0 origin", b"3 0 origin")):
        with pytest.raises((ValueError, KeyError)):
            list(arc_records(gzip.compress(broken)))


def test_empty_table(spark):
    _, warc = archive(spark, [])
    assert with_originals(warc_captures(spark, warc)).collect() == []


def test_reading_members_takes_linear_time():
    import os
    import time

    from creditloom.llm.archives import member, members

    def seconds(n):
        data = member(os.urandom(300)) * n
        took = []
        for _ in range(3):
            start = time.process_time()
            assert sum(1 for _ in members(data)) == n
            took.append(time.process_time() - start)
        return min(took)

    assert seconds(16000) < 3 * seconds(8000)
    whole = member(b"x" * 50) + member(os.urandom(200_000)) + member(b"")
    assert [len(x) for x in members(whole)] == [50, 200_000]
    for cut in (1, 9, 5000):
        with pytest.raises(ValueError):
            list(members(whole[:-cut]))
