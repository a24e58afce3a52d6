"""Archived records against a plain reader of WARC files."""

import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from traceflow.llm import warc

BIG = "é\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n" * 60
ROWS = [
    (1, "http://a/é", BIG),
    (2, None, BIG),
    (3, "u\r\nX: y", BIG),
    (4, "u", None),
    (5, "u", ""),
    (6, "u", "small\r\n\r\n"),
    (7, "u", "small\r\n\r\n"),
    (8, "u", "long \u0000" * 100_000),
    (None, "u", BIG),
    (7, "u", "small\r\n\r\n"),
]


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    clashing = pages.withColumns({c: F.lit(1) for c in ("digest", "payload", "header", "record", "bytes", "_salt")})
    folder = str(tmp_path_factory.mktemp("warc") / "archive")
    warc.write_archive(clashing, folder)
    return folder


def plain_records(data):
    """Records of the bytes of a file: (fields, block), by nothing but their lengths."""
    found = []
    while data:
        head, rest = data.split(b"\r\n\r\n", 1)
        version, *lines = head.split(b"\r\n")
        assert version == b"WARC/1.1"
        fields = dict(line.split(b": ", 1) for line in lines)
        size = int(fields[b"Content-Length"])
        assert rest[size : size + 4] == b"\r\n\r\n"
        found.append((fields, rest[:size]))
        data = rest[size + 4 :]
    return found


def test_files_are_read_by_a_plain_reader(spark, archive, tmp_path):
    warc.write_files(warc.read_archive(spark, archive), str(tmp_path / "files"))
    found = []
    for part in sorted(Path(tmp_path / "files").glob("part-*")):
        found += plain_records(part.read_bytes())
    assert len(found) == len(ROWS)
    got = []
    for fields, block in found:
        http, payload = block.split(b"\r\n\r\n", 1)
        assert http.startswith(b"HTTP/1.1 200 OK\r\n")
        assert fields[b"Content-Type"] == b"application/http;msgtype=response"
        kind = fields[b"WARC-Type"].decode()
        assert (kind == "revisit") == (b"WARC-Refers-To" in fields) == (b"WARC-Profile" in fields)
        if kind == "response":
            assert fields[b"WARC-Payload-Digest"] == b"sha1:" + hashlib.sha1(payload).hexdigest().encode()
        else:
            assert payload == b""
        got.append((fields[b"WARC-Record-ID"].decode(), kind, fields[b"WARC-Payload-Digest"][5:].decode()))
    want = []
    for page, _, html in ROWS:
        data = (html or "").encode()
        kind = "revisit" if len(data) >= 1000 and page is not None and page < 2 else "response"
        want.append((f"<urn:x-page:{page}>" if page is not None else "<urn:x-page>", kind, hashlib.sha1(data).hexdigest()))
    # Pages 1 and 2 revisit page 3.
    want[1] = (want[1][0], "revisit", want[1][2])
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("shared_rows", [warc.SHARED_ROWS, 1])
def test_fields_come_from_the_bytes(spark, archive, shared_rows):
    read = warc.read_archive(spark, archive, shared_rows).withColumn("page_id", F.lit(-5)).withColumn("header", F.lit(b""))
    # A response's payload is cut from its record, whatever stands beside it.
    read = read.withColumn("payload", F.when(F.octet_length("record") < 700, F.col("payload")).otherwise(F.lit(b"other")))
    got = [tuple(r) for r in warc.parse_records(read).select("page_id", "record_type", "refers_to", "target", F.decode("payload", "UTF-8")).collect()]
    want = []
    for page, url, html in ROWS:
        revisit = html == BIG and page in (1, 2)
        target = url and url.replace("\r", "%0D").replace("\n", "%0A")
        want.append((page, "revisit" if revisit else "response", 3 if revisit else None, target, html or ""))
    order = lambda row: str(row)
    assert sorted(got, key=order) == sorted(want, key=order)


def test_changed_records_stop_the_job(spark, archive):
    read = warc.read_archive(spark, archive).where("page_id = 6")
    longer = read.withColumn("record", F.concat("record", F.lit(b"x")))
    with pytest.raises(Exception, match="another length"):
        warc.parse_records(longer).collect()
    text = F.decode("record", "UTF-8")
    changed = read.withColumn("record", F.encode(F.replace(text, F.lit("small"), F.lit("smelt")), "UTF-8"))
    with pytest.raises(Exception, match="another payload"):
        warc.parse_records(changed).collect()
    cut = read.withColumn("record", F.lit(b"WARC/1.1\r\n"))
    with pytest.raises(Exception, match="another length"):
        warc.parse_records(cut).collect()
