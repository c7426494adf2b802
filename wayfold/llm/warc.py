"""Content-addressed archive of web records.

An archive is a folder of two tables. `payloads` holds the bytes of every distinct payload once, addressed by its SHA-256.
`headers` holds the exact header bytes of every record with the address of its payload. Records are put together again
by joining the two, and every payload is checked against its address when it is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut

# Fixed values of the record format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE_32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RADIX_32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
NEW_LINE = "\r\n"

HEADERS = "page_id long, address string, header binary"
PAYLOADS = "address string, payload binary"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of binary `data`: five hexadecimal digits are four digits of radix 32."""
    digest = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), RADIX_32, BASE_32)


def _payload() -> Column:
    return F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")


def _field(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(NEW_LINE))


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def _header(date: str) -> Column:
    """Header bytes of a record: the archive fields, an empty line, and the reply's own header."""
    revisit = F.col("record_type") == "revisit"
    reply = F.concat(
        F.lit(f"HTTP/1.1 200 OK{NEW_LINE}"),
        _field("Content-Type", F.lit("text/html; charset=utf-8")),
        _field("Content-Length", F.col("payload_bytes").cast("string")),
        F.lit(NEW_LINE),
    )
    block = F.length(reply) + F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))
    # Control characters and spaces of an address would break the header apart; they are written as percent escapes.
    target = F.col("url")
    for code in [*range(33), 127]:
        target = F.replace(target, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    text = F.concat(
        F.lit(VERSION + NEW_LINE),
        _field("WARC-Type", F.col("record_type")),
        _field("WARC-Record-ID", _record_id(F.col("page_id"))),
        _field("WARC-Date", F.lit(date)),
        F.when(F.col("url").isNull(), F.lit("")).otherwise(_field("WARC-Target-URI", target)),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(_field("WARC-Profile", F.lit(PROFILE)), _field("WARC-Refers-To", _record_id(F.col("first"))))).otherwise(F.lit("")),
        _field("Content-Type", F.lit("application/http; msgtype=response")),
        _field("Content-Length", block.cast("string")),
        F.lit(NEW_LINE),
        reply,
    )
    return F.encode(text, "UTF-8")


def write_archive(pages: DataFrame, folder: str, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write one record per row of `pages` (page_id, url, html) to `folder`.

    Of rows with equal payloads of at least `min_bytes` bytes, those with the largest page_id are responses and the others
    revisit it; below that size every row is a response. A null html is an empty payload, a null page_id is smaller than any
    other (a group of nulls alone consists of responses), a null url leaves its field out. Rows that repeat the largest
    page_id are each written as a response; their bytes are stored once. An empty table gives an empty archive. Other
    columns of `pages` are not read.
    """
    rows = pages.select("page_id", "url", _payload().alias("payload"))
    facts = rows.select(
        "page_id",
        "url",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("address"),
        base32_sha1(F.col("payload")).alias("digest"),
    )
    # Written first, so that the join below is one of plain tables and Spark can split a payload with very many pages.
    firsts = cut(facts.groupBy("address").agg(F.max("page_id").alias("first")))
    typed = facts.join(firsts, "address").withColumn(
        "record_type",
        F.when((F.col("payload_bytes") >= min_bytes) & F.coalesce(F.col("page_id") < F.col("first"), F.col("first").isNotNull()), "revisit").otherwise("response"),
    )
    typed.select("page_id", "address", _header(date).alias("header")).write.parquet(f"{folder}/headers")
    # One row per task and address moves at most, however many pages carry the payload.
    rows.select(F.sha2("payload", 256).alias("address"), "payload").dropDuplicates(["address"]).write.parquet(f"{folder}/payloads")


def read_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """address, payload of each distinct payload; fails if stored bytes do not have the digest they are stored under."""
    stored = spark.read.schema(PAYLOADS).parquet(f"{folder}/payloads")
    good = F.sha2("payload", 256) == F.col("address")
    broken = F.raise_error(F.concat(F.lit("damaged payload "), F.col("address"))).cast("binary")
    return stored.select("address", F.when(good, F.col("payload")).otherwise(broken).alias("payload"))


def _value(name: str) -> Column:
    return F.regexp_extract(F.col("fields"), rf"\r\n{name}: ([^\r\n]*)", 1)


def read_headers(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record with what its header bytes say."""
    stored = spark.read.schema(HEADERS).parquet(f"{folder}/headers")
    number = lambda name: F.expr(f"try_cast({name} as long)")
    return (
        stored.withColumn("fields", F.decode("header", "UTF-8"))
        .select(
            "address",
            "header",
            _value("WARC-Type").alias("record_type"),
            F.regexp_extract(_value("WARC-Record-ID"), r"^<urn:page:(.*)>$", 1).alias("own"),
            F.regexp_extract(_value("WARC-Refers-To"), r"^<urn:page:(.*)>$", 1).alias("other"),
            F.regexp_extract(_value("WARC-Payload-Digest"), r"^sha1:(.*)$", 1).alias("digest"),
            F.nullif(_value("WARC-Target-URI"), F.lit("")).alias("target"),
        )
        .select(number("own").alias("page_id"), "target", "record_type", number("other").alias("refers_to"), "digest", "address", "header")
    )


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """Every record as first written, and its payload: page_id, record_type, refers_to, target, record, payload (both binary).

    A revisit's `record` ends with its header, as the format wants; its `payload` is that of the record it refers to.
    """
    records = read_headers(spark, folder).join(read_payloads(spark, folder), "address")
    block = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return records.select(
        "page_id", "record_type", "refers_to", "target", F.concat("header", block, F.lit(b"\r\n\r\n")).alias("record"), "payload"
    )


def read_facts(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, the first two measured on the stored bytes.

    Fails if a header's digest is not that of the payload which the record is joined with.
    """
    measured = read_payloads(spark, folder).select(
        "address", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest")
    )
    joined = read_headers(spark, folder).drop("header").join(measured, "address")
    differs = F.raise_error(F.concat(F.lit("header and payload differ for "), F.col("address"))).cast("string")
    return joined.select(
        "page_id",
        "payload_bytes",
        F.when(F.col("digest") == F.col("payload_digest"), F.col("payload_digest")).otherwise(differs).alias("payload_digest"),
        "record_type",
        "refers_to",
    )
