"""A content-addressed web archive.

`write` keeps two tables in a shared folder: payload bytes once for each SHA-256 digest,
and the exact header block of every record. `read` checks each stored payload against its
address and its SHA-1 again and joins headers to payloads; `reconstruct` gives every
record's bytes back, `parse` splits such bytes, and `export` writes plain .warc files.

A null html is an empty payload. Rows of equal page_id are records of their own, with ids of
their own; among equal payloads the least page_id is the response, and of rows that share it
the one of the least url, then the first read. A null page_id comes after all others. Line breaks in a url are escaped.
An empty table gives an archive without records.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import dropped, saved
from lodestone.session import shared_dir

CRLF = "\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"  # fixed values of RFC 4648
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Archive:
    spark: SparkSession
    path: str

    @property
    def headers(self) -> DataFrame:
        return self.spark.read.schema("page_id long, sha256 binary, header binary").parquet(f"{self.path}/headers")

    @property
    def payloads(self) -> DataFrame:
        return self.spark.read.schema("sha256 binary, payload binary").parquet(f"{self.path}/payloads")


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the 20 bytes, four letters from every five hex digits."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def _uuid(text: Column) -> Column:
    m = F.md5(text.cast("binary"))
    at = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(m, i, n) for i, n in at]), F.lit(">"))


def write(pages: DataFrame, path: str | None = None, min_bytes: int = 0, date: str = DATE) -> Archive:
    """One record per row of (page_id, url, html). Payloads of fewer bytes than min_bytes
    are always responses."""
    spark = pages.sparkSession
    path = path or shared_dir(spark, "warc")
    records = pages.select(
        "page_id",
        F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A").alias("url"),
        F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary")).alias("payload"),
    ).withColumn("sha256", F.unhex(F.sha2("payload", 256)))

    # Bytes leave the map side once per digest and task; the rest of the plan is small.
    records.groupBy("sha256").agg(F.first("payload").alias("payload")).write.parquet(f"{path}/payloads")

    # Written, so that row numbers are the same wherever they are used.
    facts = saved(
        records.select(
            "page_id", "url", "sha256", F.octet_length("payload").cast("long").alias("n"), base32_sha1(F.col("payload")).alias("sha1"), F.monotonically_increasing_id().alias("row")
        ),
        "warc-facts",
    )
    last = F.coalesce("page_id", F.lit((1 << 63) - 1))
    several = (
        facts.where(F.col("n") >= min_bytes)
        .groupBy("sha256")
        .agg(F.count("*").alias("copies"), F.min(F.struct(last.alias("k"), "page_id", "url", "row")).alias("first"))
        .where("copies > 1")
        .select("sha256", "first")
    )
    typed = facts.join(several, "sha256", "left").withColumn("revisit", F.col("first").isNotNull() & (F.col("row") != F.col("first.row")))
    header = F.concat(
        F.lit("WARC/1.1" + CRLF + "WARC-Type: "),
        F.when(F.col("revisit"), "revisit").otherwise("response"),
        F.lit(CRLF + "WARC-Record-ID: "),
        _uuid(F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("null")), "url", F.hex("sha256"), "row")),
        F.lit(CRLF + f"WARC-Date: {date}" + CRLF + "WARC-Target-URI: "),
        F.col("url"),
        F.lit(CRLF + "WARC-Payload-Digest: sha1:"),
        F.col("sha1"),
        F.when(
            F.col("revisit"),
            F.concat(
                F.lit(CRLF + f"WARC-Profile: {PROFILE}" + CRLF + "WARC-Refers-To-Page: "),
                F.coalesce(F.col("first.page_id").cast("string"), F.lit("null")),
                F.lit(CRLF + "WARC-Payload-Length: "),
                F.col("n").cast("string"),
                F.lit(CRLF + "Content-Length: 0"),
            ),
        ).otherwise(F.concat(F.lit(CRLF + "Content-Type: text/html" + CRLF + "Content-Length: "), F.col("n").cast("string"))),
        F.lit(CRLF + CRLF),
    )
    typed.select("page_id", "sha256", header.cast("binary").alias("header")).write.parquet(f"{path}/headers")
    dropped(facts)
    return Archive(spark, path)


def field(header: Column, name: str) -> Column:
    value = F.regexp_extract(header, rf"(?m)^{name}: ([^\r\n]*)\r?$", 1)
    return F.when(value != "", value)


def read(archive: Archive) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, record_id, verified).

    Length and digest are taken from the stored payload anew; `verified` says that its
    address and the header's digest and length agree with it.
    """
    stored = archive.payloads.select(
        "sha256",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32_sha1(F.col("payload")).alias("payload_digest"),
        (F.unhex(F.sha2("payload", 256)) == F.col("sha256")).alias("_sound"),
    )
    text = F.decode("header", "UTF-8")
    heads = archive.headers.select(
        "page_id",
        "sha256",
        field(text, "WARC-Type").alias("record_type"),
        field(text, "WARC-Record-ID").alias("record_id"),
        field(text, "WARC-Payload-Digest").alias("_digest"),
        field(text, "WARC-Refers-To-Page").try_cast("long").alias("refers_to"),
        F.coalesce(field(text, "WARC-Payload-Length"), field(text, "Content-Length")).cast("long").alias("_length"),
    )
    sound = F.col("_sound") & (F.concat(F.lit("sha1:"), "payload_digest") == F.col("_digest")) & (F.col("_length") == F.col("payload_bytes"))
    return heads.join(stored, "sha256").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", sound.alias("verified")
    )


def reconstruct(archive: Archive) -> DataFrame:
    """(page_id, record): header, block and the two closing line breaks, as first written."""
    response = F.decode("header", "UTF-8").contains(f"{CRLF}WARC-Type: response{CRLF}")
    heads = archive.headers.withColumn("key", F.when(response, F.col("sha256")))
    end = F.lit(CRLF + CRLF).cast("binary")
    block = F.coalesce("payload", F.lit("").cast("binary"))
    stored = archive.payloads.withColumnRenamed("sha256", "key")
    return heads.join(stored, "key", "left").select("page_id", F.concat("header", block, end).alias("record"))


def export(archive: Archive, path: str) -> None:
    """Plain .warc files, one per partition, each a run of whole records. The text writer
    ends each row with a line feed, so every record leaves its last one to it."""
    record = F.expr("substring(record, 1, octet_length(record) - 1)").cast("string")
    reconstruct(archive).select(record.alias("value")).write.text(path, lineSep="\n")


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of one record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split(CRLF)[1:])
    return fields, rest[: int(fields["Content-Length"])]
