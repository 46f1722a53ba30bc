"""Content-addressed WARC archive.

An archive is two tables in shared storage. ``payloads`` holds the bytes of
every distinct payload once, under its SHA-256; ``records`` holds the exact
header bytes of every record (WARC and HTTP header) with the digest of the
payload the record stands for. A record is rebuilt by joining the two; the
digest of the stored bytes is computed again on the way and a mismatch stops the
read. Of records with one payload the one with the smallest id is a ``response``
and carries the bytes, the others are ``revisit`` records that refer to it.

Everything is DataFrame expressions: hashing, base32 and header parsing included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir

HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload):
    """Upper-case base32 (RFC 4648) of the SHA-1 of a binary column.

    ``conv`` writes 40 bits as 8 digits of the extended-hex alphabet, which
    ``translate`` maps to the standard one.
    """
    hexed = F.sha1(payload)
    return F.concat(
        *[
            F.translate(
                F.lpad(F.conv(F.substring(hexed, 10 * i + 1, 10), 16, 32), 8, "0"),
                "0123456789ABCDEFGHIJKLMNOPQRSTUV",
                "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
            )
            for i in range(4)
        ]
    )


def write_archive(pages: DataFrame, path: str, min_payload: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Archive ``pages`` (page_id, url, html; other columns are ignored) below ``path``.

    A null html is an empty payload. A null url is written without a target URI;
    line breaks in a url are percent-encoded. Rows without page_id become records
    without a page, and revisit any page that has their payload. Payloads of fewer
    than ``min_payload`` bytes are always stored as responses. Repeated rows give
    repeated records. An empty table gives an empty archive.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    base = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A").alias("url"),
        payload.alias("payload"),
    ).withColumns({"digest": F.sha2("payload", 256), "sha1": base32_sha1(F.col("payload")), "bytes": F.octet_length("payload").cast("long")})
    # bytes that share a digest but not length and SHA-1 would come out as two rows, which the reader refuses
    base.select("digest", "sha1", "bytes", "payload").dropDuplicates(["digest", "sha1", "bytes"]).write.parquet(f"{path}/payloads")
    heads = base.select("page_id", "url", "digest", "sha1", "bytes")
    first = heads.groupBy("digest").agg(F.min("page_id").alias("first_id"))
    revisit = (F.col("bytes") >= min_payload) & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))
    joined = heads.join(first, "digest").withColumn("revisit", revisit)
    headers = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        line("WARC-Record-ID", urn("page_id")),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", F.col("url")), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(F.col("revisit"), F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", urn("first_id")))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", (F.when(F.col("revisit"), 0).otherwise(F.col("bytes")) + len(HTTP)).cast("string")),
        F.lit("\r\n"),
        F.lit(HTTP),
    )
    joined.select(headers.cast("binary").alias("headers"), "digest").write.parquet(f"{path}/records")


def _verified(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/payloads").select(
        "digest",
        "payload",
        F.assert_true(F.sha2("payload", 256) == F.col("digest"), F.lit("stored payload does not match its digest")).alias("ok"),
    )


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(record binary): every record of the archive, byte for byte as a WARC file would hold it."""
    kind = F.regexp_extract(F.col("headers").cast("string"), "\r\nWARC-Type: (\\w+)", 1)
    return (
        spark.read.parquet(f"{path}/records")
        .join(_verified(spark, path).where("ok is null").select("digest", "payload"), "digest")
        .select(
            F.concat("headers", F.when(kind == "response", F.col("payload")).otherwise(F.lit(b"")), F.lit(b"\r\n\r\n")).alias("record")
        )
    )


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """One row per record, from its header and its stored payload.

    (page_id, payload_bytes, payload_digest, record_type, refers_to, url). The
    digest is computed from the payload bytes read and must equal the header's.
    """
    stored = (
        _verified(spark, path)
        .where("ok is null")
        .select("digest", base32_sha1(F.col("payload")).alias("sha1"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    )
    text = F.col("headers").cast("string")
    field = lambda pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    records = spark.read.parquet(f"{path}/records").select(
        "digest",
        field("\r\nWARC-Record-ID: <urn:page:(-?[0-9]+)>").cast("long").alias("page_id"),
        field("\r\nWARC-Type: (\\w+)").alias("record_type"),
        field("\r\nWARC-Refers-To: <urn:page:(-?[0-9]+)>").cast("long").alias("refers_to"),
        field("\r\nWARC-Payload-Digest: sha1:([A-Z2-7]+)").alias("said"),
        field("\r\nWARC-Target-URI: ([^\r]*)").alias("url"),
    )
    return (
        records.join(stored, "digest")
        .withColumn("ok", F.assert_true(F.col("said") == F.col("sha1"), F.lit("payload digest of a header does not match")))
        .where("ok is null")
        .select("page_id", "payload_bytes", F.col("sha1").alias("payload_digest"), "record_type", "refers_to", "url")
    )


def op3_warc(spark, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "warc")
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_index(spark, path)


_DIGITS = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast((x{g} >> {35 - 5 * i}) & 31 as integer), 1)" for g in range(4) for i in range(8)
)
_GROUPS = ", ".join(f"cast('0x' || substr(h, {10 * g + 1}, 10) as bigint) as x{g}" for g in range(4))
OP3_SQL = f"""
    with payloads as (select page_id, url, coalesce(html, '') as p, sha1(coalesce(html, '')) as h from pages),
    groups as (select *, {_GROUPS}, min(page_id) over (partition by p) as first_id from payloads)
    select page_id, cast(strlen(p) as bigint) as payload_bytes, {_DIGITS} as payload_digest,
           case when page_id = first_id then 'response' else 'revisit' end as record_type,
           case when page_id <> first_id then first_id end as refers_to, url
    from groups"""
