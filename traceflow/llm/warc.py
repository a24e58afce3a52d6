"""A content-addressed archive of WARC records.

Two tables make the archive: ``payloads`` holds each distinct payload once
under its SHA-256, ``records`` holds the exact header bytes of every record, those of its
HTTP response included, and the digest of its payload. Original records are put together again by a join on
the digest, and no payload is accepted that does not have its digest. What a record says is then
read from its bytes, by the lengths it states.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traceflow.llm.common import store
from traceflow.operators.joins import salted_join

# Payloads of fewer bytes are always stored as responses of their own.
REVISIT_BYTES = 1000
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# The pages carry no time of capture.
CAPTURED = "1970-01-01T00:00:00Z"
_RECORD = "<urn:x-page:"
_EOL = "\r\n"
_BLANK = _EOL + _EOL
# Records that share a payload and are given it by one task.
SHARED_ROWS = 200_000


def _field(name: str, value: Column) -> Column:
    """A header line, or nothing for a null value; line ends in values are percent-encoded."""
    safe = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit(_EOL)), F.lit(""))


def _record_id(page: Column) -> Column:
    return F.concat(F.lit(_RECORD), page.cast("string"), F.lit(">"))


def _header() -> Column:
    """Header bytes of a record and of its HTTP response, up to and with the second empty line.

    The pages carry no HTTP headers; the least that tells how to read the payload takes their place.
    """
    size = F.col("bytes").cast("string")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_EOL}Content-Type: text/html; charset=utf-8{_EOL}Content-Length: "), size, F.lit(_BLANK))
    revisit = F.col("refers_to").isNotNull()
    lines = [
        F.lit(VERSION + _EOL),
        _field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _field("WARC-Record-ID", F.coalesce(_record_id(F.col("page_id")), F.lit("<urn:x-page>"))),
        _field("WARC-Date", F.lit(CAPTURED)),
        _field("WARC-Target-URI", F.col("url")),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _field("WARC-Refers-To", _record_id(F.col("refers_to"))),
        _field("WARC-Profile", F.when(revisit, PROFILE)),
        _field("Content-Type", F.lit("application/http;msgtype=response")),
        _field("Content-Length", F.length(http) + F.when(revisit, 0).otherwise(F.col("bytes"))),
        F.lit(_EOL),
        http,
    ]
    return F.encode(F.concat(*lines), "UTF-8")


def write_archive(pages: DataFrame, folder: str, revisit_bytes: int = REVISIT_BYTES) -> None:
    """Write the records and payloads of ``pages`` (page_id, url, html) below ``folder``.

    The payload is the html in UTF-8, empty for null. Of records with equal
    payloads of at least ``revisit_bytes`` bytes, that with the largest page_id
    is the response and the others are revisits of it; rows without a page_id
    and rows that repeat the response's page_id are responses too. A null url
    leaves the target out. Rows that are equal are records each. No pages give an empty archive; other
    columns are not read. One html has to fit a task. Only digests are compared, and a payload many pages
    share is reduced to one copy in each task before it is shuffled.
    """
    payload = F.coalesce(F.encode(F.col("html").cast("string"), "UTF-8"), F.lit(b""))
    rows = pages.select("page_id", "url", payload.alias("payload")).select(
        "*", F.unhex(F.sha2("payload", 256)).alias("digest")
    )
    (
        rows.groupBy("digest")
        .agg(F.first("payload").alias("payload"))
        .write.option("compression", "zstd")
        .parquet(f"{folder}/payloads")
    )
    light = store(
        rows.select(
            "page_id", "url", "digest", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("bytes")
        )
    )
    heads = (
        light.where(F.col("bytes") >= revisit_bytes)
        .groupBy("digest")
        .agg(F.max("page_id").alias("_response"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1")
    )
    linked = salted_join(light, heads.drop("_n"), "digest", "left", ["page_id", "url"])
    refers_to = F.when(F.col("page_id") < F.col("_response"), F.col("_response"))
    (
        linked.withColumn("refers_to", refers_to)
        .select("page_id", "digest", _header().alias("header"))
        .write.option("compression", "zstd")
        .parquet(f"{folder}/records")
    )


def read_archive(spark: SparkSession, folder: str, shared_rows: int = SHARED_ROWS) -> DataFrame:
    """The original records: page_id, header, payload, record.

    ``record`` is the exact record with its closing line ends; a revisit ends after its
    HTTP headers, while ``payload`` is the full payload for both kinds. A payload
    that is missing or has another digest stops the job. A payload with more than ``shared_rows`` records is
    sent to several tasks.
    """
    records = spark.read.parquet(f"{folder}/records")
    payloads = spark.read.parquet(f"{folder}/payloads").withColumn("_found", F.lit(True))
    joined = salted_join(records, payloads, "digest", "left", ["page_id", "header"], shared_rows)
    good = F.col("_found") & (F.unhex(F.sha2("payload", 256)) == F.col("digest"))
    checked = F.when(good, F.col("payload")).otherwise(
        F.raise_error(F.concat(F.lit("bad or missing payload "), F.hex("digest"))).cast("binary")
    )
    block = F.when(header_field("header", "WARC-Type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return joined.withColumn("payload", checked).select(
        "page_id", "header", "payload", F.concat("header", block, F.lit(_BLANK.encode())).alias("record")
    )


def parse_records(read: DataFrame, kind: str = "long") -> DataFrame:
    """What the bytes of ``record`` say: page_id, record_type, target, refers_to, payload_digest, payload.

    The header ends at the first empty line and the block has the stated Content-Length; inside it the
    payload starts after the HTTP headers. A revisit holds none, its payload is that of ``read``. A record
    whose length or SHA-1 is not the stated one stops the job.
    """
    # One character per byte, so that places found in the text are places in the record.
    plain = F.decode("record", "ISO-8859-1")
    cut = read.withColumn("_head", F.length(F.substring_index(plain, _BLANK, 1))).withColumn(
        "_heads", F.length(F.substring_index(plain, _BLANK, 2))
    )
    cut = cut.withColumn("_fields", F.substring("record", F.lit(1), F.col("_head") + 2))
    size = header_field("_fields", "Content-Length").cast("int")
    end = F.col("_head") + 4 + size
    whole = F.octet_length("record") == end + 4
    held = F.substring("record", F.col("_heads") + 5, end - F.col("_heads") - 4)
    record_type = header_field("_fields", "WARC-Type")
    stated = F.regexp_extract(header_field("_fields", "WARC-Payload-Digest"), "^sha1:(.*)$", 1)
    found = cut.select(
        header_page("_fields", "WARC-Record-ID", kind).alias("page_id"),
        record_type.alias("record_type"),
        header_field("_fields", "WARC-Target-URI").alias("target"),
        header_page("_fields", "WARC-Refers-To", kind).alias("refers_to"),
        stated.alias("payload_digest"),
        F.when(record_type == "revisit", F.col("payload")).otherwise(held).alias("payload"),
        F.coalesce(whole, F.lit(False)).alias("_whole"),
    )
    named = F.coalesce("payload_digest", F.lit("none"))
    wrong = F.when(~F.col("_whole"), F.lit("a record has another length than it states")).otherwise(
        F.concat(F.lit("a record has another payload than it states: "), named)
    )
    same = F.col("_whole") & (F.sha1("payload") == F.col("payload_digest"))
    checked = F.when(same, F.col("payload")).otherwise(F.raise_error(wrong).cast("binary"))
    return found.withColumn("payload", checked).drop("_whole")


def write_files(read: DataFrame, folder: str) -> None:
    """The records as files of one record after the other, which any WARC reader takes.

    A payload is text in UTF-8, so the text writer leaves its bytes as they are; it adds the
    empty lines that end a record.
    """
    bare = F.substring("record", F.lit(1), F.octet_length("record") - len(_BLANK))
    read.select(bare.cast("string").alias("value")).write.option("lineSep", _BLANK).text(folder)


def header_field(header: str, name: str) -> Column:
    """The value of a field in header bytes, null if it is not there."""
    value = F.regexp_extract(F.decode(header, "UTF-8"), f"\r\n{name}: ([^\r]*)\r\n", 1)
    return F.when(value != "", value)


def header_page(header: str, name: str, kind: str = "long") -> Column:
    """The page a record id field names."""
    page = F.regexp_extract(header_field(header, name), f"^{_RECORD}(.*)>$", 1)
    return F.when(page != "", page).cast(kind)
