"""A content-addressed WARC archive: payload bytes once, exact record headers beside them, records rebuilt by joins.

``write`` makes two tables in a folder. ``payloads`` holds each distinct payload once under its address, the SHA-256
digest; an address is taken as proof of equality only after length and SHA-1 of all its rows were found equal too, else
the job fails. ``records`` holds for every page the exact bytes of its record up to the payload (WARC header, blank
line, HTTP header) and the address. Of the records with equal payloads of at least ``min_bytes`` bytes, that of the
greatest page_id is a response and the others are revisits that refer to it; records of smaller payloads are responses.
``read`` joins the two tables on the address, checks every payload against it and returns the original records, byte
for byte, each with its whole payload, revisits included; ``parse`` reads the header fields of such a record.

Skew. A payload that a third of all pages share is aggregated before the shuffle, so it crosses the network once per
task; in the joins on its address only the side of the records is skewed, which adaptive execution splits.

Nulls: a null html is an empty payload, a null url leaves out its field, and line ends in a url are percent-encoded. A
page without page_id has an empty record id: nothing refers to it, and where all pages of a payload are so, all are
responses. Rows that repeat the page_id and payload of a response are the same response again, stored with one
payload; repeated revisits are revisits each. An empty table makes an empty archive; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_shuffles, whole_text

LINE = "\r\n"
ID = "urn:x-page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def base32(hex_digest: Column) -> Column:
    """A SHA-1 digest in base 32, from its forty hexadecimal digits."""
    groups = [F.lpad(F.conv(F.substring(hex_digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def pages_hashed(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, bytes, address, sha1) of every page."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.encode(whole_text("html"), "utf-8").alias("payload"))
    return rows.select("*", F.octet_length("payload").cast("long").alias("bytes"), F.sha2("payload", 256).alias("address"), F.sha1("payload").alias("sha1"))


def lines(*fields: tuple[str, Column]) -> Column:
    """Header lines; a null field has none."""
    return F.concat(*[F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(LINE)), F.lit("")) for name, value in fields])


def head(date: str) -> Column:
    """All bytes of a record before its payload, as text."""
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{LINE}"), lines(("Content-Type", F.lit("text/html; charset=utf-8")), ("Content-Length", F.col("bytes"))), F.lit(LINE))
    name = lambda i: F.concat(F.lit(f"<{ID}"), i.cast("string"), F.lit(">"))
    fields = lines(
        ("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        ("WARC-Record-ID", name(F.coalesce(F.col("page_id").cast("string"), F.lit("")))),
        ("WARC-Date", F.lit(date)),
        ("WARC-Target-URI", F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        ("WARC-Refers-To", F.when(revisit, name(F.col("refers_to")))),
        ("WARC-Profile", F.when(revisit, PROFILE)),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha1")))),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("bytes"))),
    )
    return F.concat(F.lit(f"WARC/1.1{LINE}"), fields, F.lit(LINE), http)


def write(pages: DataFrame, folder: str, min_bytes: int = 0, date: str = DATE) -> None:
    """Archive ``pages`` (page_id, url, html) in ``folder``, which must be new."""
    spark = pages.sparkSession
    free_shuffles(spark)
    hashed = pages_hashed(pages)
    proof = F.struct("bytes", "sha1")
    once = hashed.groupBy("address").agg(
        F.max("page_id").alias("response"), F.min(proof).alias("low"), F.max(proof).alias("high"), F.any_value("payload").alias("payload")
    )
    same = F.when(F.col("low") == F.col("high"), F.col("payload")).otherwise(F.raise_error(F.lit("different payloads have one address")).cast("binary"))
    once.select("address", "response", same.alias("payload")).write.parquet(f"{folder}/payloads")
    first = spark.read.parquet(f"{folder}/payloads").select("address", "response")
    refers = F.when((F.col("bytes") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("response")), F.col("response"))
    records = hashed.drop("payload").join(first, "address").withColumn("refers_to", refers)
    records.select("address", head(date).alias("head")).write.parquet(f"{folder}/records")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(record, payload) of every record of an archive: its exact bytes, and the whole payload it stands for."""
    payloads, records = (spark.read.parquet(f"{folder}/{t}") for t in ("payloads", "records"))
    sound = F.when(F.sha2("payload", 256) == F.col("address"), F.col("payload")).otherwise(F.raise_error(F.lit("a payload does not match its address")).cast("binary"))
    payloads = payloads.select("address", sound.alias("payload"))
    body = F.when(F.startswith("head", F.lit(f"WARC/1.1{LINE}WARC-Type: revisit{LINE}")), F.lit(b"")).otherwise(F.col("payload"))
    record = F.concat(F.encode("head", "utf-8"), body, F.lit((LINE + LINE).encode()))
    return records.join(payloads, "address").select(record.alias("record"), "payload")


def parse(records: DataFrame) -> DataFrame:
    """page_id, url, record_type, refers_to, digest (as the header states it) and payload of records."""
    top = F.substring_index(F.col("record").cast("string"), LINE + LINE, 1)

    def field(name: str, value: str = "([^\\r]*)") -> Column:
        found = F.regexp_extract(F.concat("_head", F.lit(LINE)), f"\\r\\n{name}: {value}\\r\\n", 1)
        return F.when(found != "", found)

    return records.select(top.alias("_head"), "payload").select(
        field("WARC-Record-ID", f"<{ID}([^>]*)>").cast("long").alias("page_id"), field("WARC-Target-URI").alias("url"),
        field("WARC-Type").alias("record_type"), field("WARC-Refers-To", f"<{ID}([^>]*)>").cast("long").alias("refers_to"),
        field("WARC-Payload-Digest", "sha1:([^\\r]*)").alias("digest"), "payload",
    )
