"""Content-addressed WARC archive: payload bytes once, exact record headers apart, records by join.

An archive is two tables. ``payloads`` holds every distinct payload once, under its SHA-256, with its
length and SHA-1. ``records`` holds, per record, the exact header bytes of its WARC record and the
digest it refers to. A payload's first holder (the one with the largest id) is a response record; the
others are revisit records that name it. Records smaller than ``min_revisit_bytes`` are all responses.
Reading verifies every stored payload against its digest again, and reconstruct() joins header and
payload into the bytes of the original record. A revisit names its payload's SHA-256 in its header too, since one SHA-1 may
have several payloads. catalogue() reads those bytes: type, reference and digests from the header, the length
and the digest of the body that follows it; nothing else about a record is taken from the tables.

Only digests, sizes and ids are shuffled to find the holders; payloads move once, to be written, and
only the holders' do. Digests, base32 included, are column expressions.

Defined cases: a null payload is the empty one; a null id sorts first and is written as the record id
``null``; rows that share an id and payload become one response and revisits of it; a null url is
empty; line ends in a url are written as %0A and %0D; an empty table gives empty archives. Further
columns are ignored. All records of an archive bear one date, that of its writing unless another is given.
"""

from __future__ import annotations

import uuid
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from haplolake.llm.storage import shared_dir, written

#: Fixed value: the base32 alphabet, for the digits that conv() writes.
_DIGITS, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"


def base32_of_hex(c: Column, digits: int = 40) -> Column:
    """Base32 without padding of a hexadecimal string whose number of digits is a multiple of five."""
    groups = [F.lpad(F.conv(F.substring(c, i, 5), 16, 32), 4, "0") for i in range(1, digits + 1, 5)]
    return F.translate(F.concat(*groups), _DIGITS, _BASE32)


def sha1_base32(payload: Column) -> Column:
    return base32_of_hex(F.sha1(payload))


def _headers(page: Column, url: Column, kind: Column, digest: Column, strong: Column, refers: Column, length: Column, date: str) -> Column:
    uri = F.replace(F.replace(F.coalesce(url, F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), kind),
        F.concat(F.lit("WARC-Record-ID: "), name(page)),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), digest),
        F.when(kind == "revisit", F.concat(F.lit("WARC-Refers-To: "), name(refers))),
        F.when(kind == "revisit", F.concat(F.lit("X-Payload-SHA256: "), strong)),
        F.when(kind == "revisit", F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(kind == "revisit", F.lit(0)).otherwise(length).cast("string")),
    ]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF)).cast("binary")


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = 0, date: str | None = None) -> None:
    """Write the two tables of the archive under ``path``, which all executors must share. date: as 2024-01-31T23:59:59Z."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    narrow = base.select("page_id", "url", F.sha2("payload", 256).alias("sha256"), F.octet_length("payload").cast("long").alias("payload_bytes"), sha1_base32(F.col("payload")).alias("payload_digest"))
    holders = narrow.filter(F.col("payload_bytes") >= min_revisit_bytes).groupBy("sha256").agg(F.max("page_id").alias("holder"), F.count(F.lit(1)).alias("n"))
    # Payloads held once need no second look; only the others' few rows are joined.
    shared = holders.filter("n > 1").select(F.col("sha256").alias("_s"), "holder")
    joined = narrow.join(shared, F.col("sha256") == F.col("_s"), "left")
    # Equal rows of one id: the first in order of url is the response.
    again = F.row_number().over(Window.partitionBy("page_id", "sha256").orderBy("url"))
    typed = joined.withColumn("_nth", again).withColumn("record_type", F.when(F.col("_s").isNull() | (F.col("page_id").eqNullSafe(F.col("holder")) & (F.col("_nth") == 1)), "response").otherwise("revisit"))
    refers = F.when(F.col("record_type") == "revisit", F.col("holder"))
    typed = typed.withColumn("header", _headers(F.col("page_id"), F.col("url"), F.col("record_type"), F.col("payload_digest"), F.col("sha256"), refers, F.col("payload_bytes"), date))
    typed.select("page_id", "header", "sha256").write.option("compression", "zstd").parquet(f"{path}/records")

    spark = pages.sparkSession
    kept = spark.read.schema("page_id long, header binary, sha256 string").parquet(f"{path}/records").filter(F.col("header").cast("string").contains(f"{CRLF}WARC-Type: response{CRLF}"))
    kept = kept.groupBy("sha256").agg(F.max("page_id").alias("page_id")) if min_revisit_bytes <= 0 else kept.groupBy("sha256").agg(F.max_by("page_id", F.coalesce("page_id", F.lit(-1))).alias("page_id"))
    keep = kept.select(F.col("page_id").alias("_p"), F.col("sha256").alias("_s"))
    keyed = base.withColumn("sha256", F.sha2("payload", 256))
    once = keyed.join(keep, F.col("page_id").eqNullSafe(F.col("_p")) & (F.col("sha256") == F.col("_s")), "left_semi")
    nth = F.row_number().over(Window.partitionBy("page_id", "sha256").orderBy("url"))
    stored = spark.read.schema("page_id long, header binary, sha256 string").parquet(f"{path}/records")
    repeats = not stored.groupBy("page_id", "sha256").count().filter("count > 1").isEmpty()  # an id that holds a payload twice
    once = once.withColumn("_nth", nth).filter("_nth = 1") if repeats else once
    once.select("sha256", F.octet_length("payload").cast("long").alias("payload_bytes"), "payload").write.option("compression", "zstd").parquet(f"{path}/payloads")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """sha256, payload; a stored payload that does not match its digest is an error."""
    stored = spark.read.schema("sha256 string, payload_bytes long, payload binary").parquet(f"{path}/payloads")
    right = (F.sha2("payload", 256) == F.col("sha256")) & (F.octet_length("payload") == F.col("payload_bytes"))
    checked = F.when(right, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload does not match its digest "), F.col("sha256"))).cast("binary"))
    return stored.select("sha256", checked.alias("payload"))


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """record: the exact bytes of every WARC record (header, body, two line ends). Only responses are joined with payloads."""
    stored = spark.read.schema("page_id long, header binary, sha256 string").parquet(f"{path}/records")
    response = F.col("header").cast("string").contains(f"{CRLF}WARC-Type: response{CRLF}")
    end = F.lit(CRLF + CRLF).cast("binary")
    full = stored.filter(response).join(read_payloads(spark, path), "sha256").select(F.concat("header", "payload", end).alias("record"))
    return full.unionByName(stored.filter(~response).select(F.concat("header", end).alias("record")))


def parse_records(records: DataFrame, record: str = "record") -> DataFrame:
    """page_id, record_type, refers_to, target_uri, date, header_digest, header_sha256, body of WARC records, from their bytes alone.

    A record whose length is not that of its header, its body and two line ends is an error.
    """
    head = F.concat(F.substring_index(F.col(record).cast("string"), CRLF + CRLF, 1), F.lit(CRLF))
    named = records.select(record, head.alias("head")).withColumn("size", F.octet_length("head") + 2)
    field = lambda name: F.regexp_extract("head", f"\r\n{name}: ([^\r]*)\r\n", 1)
    page = lambda name: F.regexp_extract("head", f"\r\n{name}: <urn:page:(-?[0-9]+)>\r\n", 1).try_cast("long")
    length = field("Content-Length").cast("int")
    whole = F.octet_length(record) == F.col("size") + length + 4
    body = F.when(whole, F.substring(F.col(record), F.col("size") + 1, length)).otherwise(F.raise_error(F.concat(F.lit("broken record: "), F.col("head"))).cast("binary"))
    return named.select(
        page("WARC-Record-ID").alias("page_id"), field("WARC-Type").alias("record_type"), page("WARC-Refers-To").alias("refers_to"), field("WARC-Target-URI").alias("target_uri"), field("WARC-Date").alias("date"),
        F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("header_digest"), F.nullif(field("X-Payload-SHA256"), F.lit("")).alias("header_sha256"), body.alias("body"),
    )


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record, parsed from reconstructed records.

    Of a response, length and digest are those of its body; a header that names another digest is an error.
    A revisit has no body: it has the length of the body with the SHA-256 that its header names, if that body also has the
    SHA-1 it names.
    """
    parsed = parse_records(reconstruct(spark, path))
    measured = parsed.filter("record_type = 'response'").select("page_id", F.octet_length("body").cast("long").alias("payload_bytes"), sha1_base32(F.col("body")).alias("digest"), F.sha2("body", 256).alias("sha256"), "header_digest", "record_type", "refers_to")
    digest = F.when(F.col("header_digest") == F.col("digest"), F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("header and body differ in record "), F.col("page_id").cast("string"))).cast("string"))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    responses = written(measured.withColumn("payload_digest", digest).select(*columns, "sha256"), "responses")
    again = parsed.filter("record_type = 'revisit'").select("page_id", F.col("header_digest").alias("payload_digest"), F.col("header_sha256").alias("sha256"), "record_type", "refers_to")
    # Bodies are measured once a digest; only those that some revisit names are joined, and Spark may send so few to all tasks.
    named = again.select("sha256").distinct()
    lengths = responses.join(named, "sha256", "left_semi").groupBy("sha256", "payload_digest").agg(F.max("payload_bytes").alias("payload_bytes"))
    revisits = again.join(lengths, ["sha256", "payload_digest"], "left")
    return responses.select(columns).unionByName(revisits.select(columns))


def new_archive_path(spark: SparkSession) -> str:
    """A folder in the shared one that does not exist yet, for an archive that need not outlast the driver."""
    return f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
